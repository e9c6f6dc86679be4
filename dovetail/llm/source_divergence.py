"""Source divergence audit: how far the word distributions of the sources of a language lie apart, and the terms that set one off.

1. Each task counts the terms of its documents in one pass: occurrences, and documents, of each (lang, source, term). Counts are
   summed before and after the shuffle. Terms in ``least_docs`` documents of their language or more are kept.
2. Kept terms of a language are dealt to blocks of some ``BLOCK_TERMS``, its sources to blocks of some ``BLOCK_GROUPS``. A tile is the dense
   int64 matrix of the counts of one block of sources by one block of terms.
3. Two blocks of sources meet in each block of terms. Their smoothed shares, in billionths, are broadcast against each other, all
   pairs at a time, and summed over the terms; these partial pair matrices are summed over the blocks of terms.
4. Each tile also gives every source the ``top`` terms that it uses more than its language, from a heap; the heaps of all blocks are merged.

All arithmetic is in whole numbers: a share is floored by long division in base 1000, so counts of up to 9e15 stay exact. Null text, lang
and source are empty. A source without terms is judged by its smoothed shares; a language without kept terms has divergences of 0
and no terms. Ties are ranked by the UTF-8 bytes of the item. Repeated rows count as often as they stand. A very long text is counted
piece by piece; what is held besides is its distinct terms. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dovetail.llm import common

LEAST_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
BLOCK_TERMS, BLOCK_GROUPS = 2048, 128
#: Entries that a task's counters hold before they are given on; bytes of a text that are counted at a time; numbers broadcast at a time.
MOST_ENTRIES, PIECE_BYTES, MOST_NUMBERS = 400_000, 1_000_000, 1_000_000
#: Letters in lower case and bytes beyond ASCII stand for themselves, everything else is white space.
_TERM = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def _words(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece at a time."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TERM)
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[at:end].split(b" ")
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it); a null term stands for the group itself, with no counts."""
    names = ["lang", "source", "term", "n", "docs"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_) in held.items():
                n.pop(b"", None)
                terms = list(n)
                columns = ([lang] * (len(terms) + 1), [source] * (len(terms) + 1), [None, *(t.decode() for t in terms)], [0, *n.values()], [0, *(docs_[t] for t in terms)])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in _words(text):
                    n.update(words)
                    seen.update(words)
                docs_.update(seen)
                size += 1 + len(n) - before
                if size > MOST_ENTRIES:
                    yield from given()
                    size = 0
        yield from given()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    made = common.map_arrow(docs.select(blank("lang"), blank("source"), blank("text")), run, "lang string, source string, term string, n long, docs long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * kept)), exactly: three steps of long division in base 1000."""
    rest, below = count + SMOOTHING, total + SMOOTHING * kept
    out = np.zeros(np.broadcast_shapes(rest.shape, below.shape), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + digit
    return out + 1


def pair_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The summed absolute differences of all rows of ``a`` and of ``b``; some rows of ``a`` at a time."""
    step = max(1, MOST_NUMBERS // max(1, b.size))
    return np.concatenate([np.abs(a[i : i + step, None, :] - b[None, :, :]).sum(2) for i in range(0, len(a), step)])


def _kept(counts: DataFrame, least_docs: int) -> DataFrame:
    """lang, term, total, block, slot, ``rows`` (of ``counts``) of the kept terms."""
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.count("*").alias("rows"))
    terms = common.stash(terms.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    blocks = terms.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_TERMS).cast("int").alias("blocks"))
    dealt = terms.join(blocks, "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).drop("blocks")
    slot = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1  # a block is of bounded size
    return common.stash(dealt.withColumn("slot", slot), "slots")


def _group_table(counts: DataFrame, used: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, size (occurrences of kept terms), kept (number of them), lang_size, group_block, row (in the block)."""
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sizes = used.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = counts.where("term is null").select("lang", "source")
    groups = groups.join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["size", "kept", "lang_size"])
    blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK_GROUPS).cast("int").alias("blocks"))
    dealt = groups.join(blocks, "lang").withColumn("group_block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")).drop("blocks")
    row = F.row_number().over(Window.partitionBy("lang", "group_block").orderBy("source")) - 1
    return common.stash(dealt.withColumn("row", row), "groups")


def _tiles(used: DataFrame, kept: DataFrame, groups: DataFrame) -> DataFrame:
    """A row for each block of sources and of terms: the counts as an int64 matrix, and what its rows and columns are."""
    members = groups.where("kept > 0").groupBy("lang", "group_block", "kept", "lang_size").agg(F.sort_array(F.collect_list(F.struct("row", "source", "size"))).alias("m"))
    columns = kept.groupBy("lang", "block").agg(F.sort_array(F.collect_list(F.struct("slot", "term", "total"))).alias("t"))
    cells = used.groupBy("lang", "group_block", "block").agg(F.collect_list("row").alias("row"), F.collect_list("slot").alias("slot"), F.collect_list("n").alias("n"))
    frame = members.join(columns, "lang").join(cells, ["lang", "group_block", "block"], "left")
    part = lambda a, f: F.transform(a, lambda x: x[f]).alias(f"{f}s")
    return frame.select("lang", "group_block", "block", "kept", "lang_size", part("m", "source"), part("m", "size"), part("t", "term"), part("t", "total"), "row", "slot", "n")


def _dense(tile: dict) -> np.ndarray:
    counts = np.zeros((len(tile["sources"]), len(tile["terms"])), np.int64)
    if tile["row"]:
        counts[tile["row"], tile["slot"]] = tile["n"]
    return counts


def _shares_of(tile: dict) -> np.ndarray:
    return shares(_dense(tile), np.array(tile["sizes"], np.int64)[:, None], tile["kept"])


def _tile_terms(tiles: DataFrame, top: int) -> DataFrame:
    """lang, source, item, value: the ``top`` terms of each source in each tile, from a heap."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm import source_divergence as s

        for batch in batches:
            for tile in batch.to_pylist():
                counts, p = s._dense(tile), s._shares_of(tile)
                above = p - s.shares(np.array(tile["totals"], np.int64), np.array(tile["lang_size"]), tile["kept"])
                terms, rows = [t.encode() for t in tile["terms"]], []
                for i, source in enumerate(tile["sources"]):
                    mine = np.flatnonzero((counts[i] > 0) & (above[i] > 0))
                    best = heapq.nsmallest(top, zip((-above[i, mine]).tolist(), [terms[k] for k in mine]))
                    rows += [(tile["lang"], source, term.decode(), -f) for f, term in best]
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "item", "value"])

    return common.map_arrow(tiles, run, "lang string, source string, item string, value long")


def _tile_pairs(tiles: DataFrame) -> DataFrame:
    """lang, source, item, value: partial pair sums of each block of terms, in both directions, for all pairs of blocks of sources."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    others = tiles.select("lang", "group_block").distinct().groupBy("lang").agg(F.collect_set("group_block").alias("others"))
    pair = F.struct(F.least("group_block", "o").alias("x"), F.greatest("group_block", "o").alias("y"))
    sides = tiles.join(others, "lang").select(*tiles.columns, F.explode("others").alias("o")).withColumn("pair", pair).drop("o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm import source_divergence as s

        def summed(first: dict, second: dict) -> pa.RecordBatch:
            same = first["group_block"] == second["group_block"]
            sums = s.pair_sums(s._shares_of(first), s._shares_of(second))
            rows = []
            for i, a in enumerate(first["sources"]):
                for j, b in enumerate(second["sources"]):
                    if not same or i != j:
                        rows.append((first["lang"], a, b, int(sums[i, j])))
                        if not same:
                            rows.append((first["lang"], b, a, int(sums[i, j])))
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "item", "value"])

        waiting = None
        for batch in batches:
            for tile in batch.to_pylist():
                if tile["pair"]["x"] == tile["pair"]["y"]:
                    yield summed(tile, tile)
                elif waiting is None:
                    waiting = tile
                else:
                    yield summed(waiting, tile)
                    waiting = None

    keys = ["lang", "block", "pair.x", "pair.y"]
    dealt = sides.repartition(*keys).sortWithinPartitions(*keys, "group_block")
    return common.map_arrow(dealt, run, "lang string, source string, item string, value long")


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank, as the module's text says; ``top`` bounds the terms of a source."""
    counts = common.stash(term_counts(docs), "counts")
    kept = _kept(counts, least_docs)
    terms = counts.where("term is not null").select("lang", "source", "term", "n")
    used = common.stash(common.spread_join(terms, kept.select("lang", "term", "block", "slot", "rows"), ["term", "lang"], ["source"], "inner"), "used")
    groups = _group_table(counts, used, kept)
    placed = used.join(groups.select("lang", "source", "group_block", "row"), ["lang", "source"]).select("lang", "group_block", "block", "row", "slot", "n")
    tiles = common.stash(_tiles(placed, kept, groups), "tiles")
    sums = _tile_pairs(tiles).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    empty = groups.where("kept = 0").select("lang", "source")
    zero = empty.alias("a").join(empty.alias("b"), (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    pairs = sums.unionByName(zero.select("a.lang", "a.source", F.col("b.source").alias("item"), F.lit(0).cast("long").alias("value")))
    heaps = _tile_terms(tiles, top)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(heaps, "term").where(F.col("rank") <= top))
