"""Line dedup: digests of normalised lines grouped globally, the earliest ranked occurrence kept, original offsets retained.

1. Every line gets a 128-bit digest of its normalised words (letter case and white space do not count). Digests are grouped globally
   for the first row that has them, in the order of (doc_id, hash of the text), null ids first. Every later line goes, whatever its length: in
   later rows, and further down in the same row. A paragraph that repeats goes with its lines.
2. Passages that were set into the middle of a line are found by windows: a line is cut into tiles after the words that rank least of
   some ``CUT_WINDOW`` words in a row, by their hash, ends of sentences before others; a window is a tile and those after it up to
   ``WINDOW_WORDS`` words. Cuts depend on the words around them only, so within ``CUT_WINDOW`` words of its ends a passage is cut alike
   wherever it stands: of a passage of 51 words that stands in two lines anywhere, 21 at least go from the later.
3. Of what only windows mark, runs of ``min_words`` words or more go (lines that go count in), or all of a document; so a short
   phrase inside lines of many documents is left alone. This floor does not touch whole lines.

Digests are made once and stored. Those that more than a thousandth of all repeated units have are a thousand at most, whatever the corpus; they
are found by their counts, and the join spreads them over salts. Words that are not ASCII and have no spaces count by their bytes.

Equal rows (of doc_id and text) get equal results and do not remove each other's lines. Null texts stay null; empty texts stay empty. A very
long text is hashed in one piece, as a line may be that long; it needs some 60 bytes a byte. Other columns are kept, whatever their names and
types; ``remove_repeats`` replaces columns called ``kept`` and ``n_removed``. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.llm import common

WINDOW_WORDS, CUT_WINDOW, MIN_WORDS = 8, 12, 20
#: Bytes of text that are hashed together; a word that is not ASCII counts as one for every ``WIDE_BYTES`` bytes beyond ``LONG_BYTES``.
SLICE_BYTES, LONG_BYTES, WIDE_BYTES = 1_000_000, 48, 6
_FIRST = np.iinfo(np.int64).min
_OTHER_BASE = 0xC2B2AE3D27D4EB4F
#: Tells the digest of a whole line from that of a window with the same words.
_WHOLE_LINE = np.int64(0x2545F4914F6CDD1D)
#: Small differences in place of places that grow, so that the stored table is small: ``reach`` tiles from ``first``, ``gap`` characters
#: before a tile and ``long`` in it, ``lines`` from the tile before. The ``reach`` of a whole line is negative.
_UNITS = "doc_id long, th long, k1 array<long>, k2 array<long>, first array<int>, reach array<int>, own array<int>, gap array<int>, long array<int>, words array<int>, lines array<int>, size long"


def _lowered(text: str) -> bytes:
    """In lower case, letter by letter, where that keeps the bytes of a letter; so places are those of the text."""
    raw = text.encode("utf-8", "surrogatepass")
    low = text.lower().replace("ς", "σ").encode("utf-8", "surrogatepass") if not text.isascii() else raw.lower()
    if len(low) != len(raw):
        low = "".join([x if len((x := c.lower()).encode("utf-8", "surrogatepass")) == len(c.encode("utf-8", "surrogatepass")) else c for c in text]).replace("ς", "σ").encode("utf-8", "surrogatepass")
    return low


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end: at white space, and after a full stop of writing without spaces."""
    from dovetail.llm.shingles import SPACE

    space = SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    if (data == 0xE3).any() or (data == 0xEF).any():
        a, b, c = data[:-3], data[1:-2], data[2:-1]
        stop = ((a == 0xE3) & (b == 0x80) & (c == 0x82)) | ((a == 0xEF) & (b == 0xBC) & ((c == 0x81) | (c == 0x9F)))
        after = np.flatnonzero(stop) + 3
        after = after[~space[after]]
        starts, ends = np.sort(np.concatenate([starts, after])), np.sort(np.concatenate([ends, after]))
    return starts, ends


def _winnowed(h: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Which words have the least rank of some ``CUT_WINDOW`` words in a row of one line."""
    n = len(h) - CUT_WINDOW + 1
    if n < 1:
        return np.zeros(len(h), bool)
    least = h[:n].copy()
    for k in range(1, CUT_WINDOW):
        np.minimum(least, h[k : k + n], out=least)
    least[line[:n] != line[CUT_WINDOW - 1 :]] = -1
    most = np.full(len(h), -1, np.int64)  # of the windows that hold the word, the largest least
    for k in range(CUT_WINDOW):
        np.maximum(most[k : k + n], least, out=most[k : k + n])
    return most == h


class Units:
    """Tiles and digests of some texts: tiles ``start`` to ``end`` (code points) of text ``tile_text``, with ``words`` and ``line``;
    digests ``k1``, ``k2`` of tiles ``first`` to before ``last`` of ``text``; ``whole`` marks those of lines, ``own`` those that repeat one further up."""

    def __init__(self, texts: list[str]):
        from dovetail.llm.shingles import BASE, mix, prefix_sums, span_hashes

        low = [_lowered(t) for t in texts]
        data = np.frombuffer(b"\n" + b"\n".join(low) + b"\n", np.uint8)
        limits = np.cumsum([1, *(len(x) + 1 for x in low)])  # of the texts
        starts, ends = _words(data)
        n = len(starts)
        text = np.searchsorted(limits, starts, "right") - 1
        bytes_ = data.astype(np.uint64) + np.uint64(1)
        one = span_hashes(prefix_sums(bytes_), starts, ends)
        two = span_hashes(prefix_sums(bytes_, _OTHER_BASE), starts, ends, _OTHER_BASE)
        del bytes_
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        high = np.concatenate([[0], np.cumsum(data > 0x7F)])
        size = ends - starts
        weight = np.where((size > LONG_BYTES) & (high[ends] > high[starts]), size // WIDE_BYTES, 1)
        line = np.concatenate([[0], np.cumsum(data == 10)])[starts] if n else np.zeros(0, np.int64)
        new_line = np.ones(n, bool)
        new_line[1:] = line[1:] != line[:-1]
        last = data[ends - 1]
        stops = (last == 46) | (last == 33) | (last == 63)
        stops[:-1] |= ends[:-1] == starts[1:]
        begins = new_line.copy()
        rank = (mix(one + np.uint64(1)) >> np.uint64(1)).astype(np.int64)
        begins[1:] |= _winnowed(np.where(stops, rank >> 20, rank), line)[:-1]  # ends of sentences come first
        cut = np.flatnonzero(begins)
        edge = np.append(cut, n)  # tiles are words edge[t] to before edge[t + 1]
        tiles = len(cut)
        total = np.concatenate([[0], np.cumsum(weight)])[edge]
        self.tile_text = text[cut]
        base = points[limits[:-1]]
        self.start = points[starts[cut]] - base[self.tile_text]
        self.end = points[ends[edge[1:] - 1]] - base[self.tile_text]
        self.words, self.line = np.diff(total), line[cut]
        self.size = points[limits[1:] - 1] - base
        heads = np.flatnonzero(new_line[cut])  # first tiles of lines
        line_end = np.append(heads[1:], tiles)[: len(heads)]
        of_line = np.repeat(line_end, np.diff(np.append(heads, tiles)))
        sub_end = np.searchsorted(total, total[:-1] + WINDOW_WORDS, "left")
        fits = np.flatnonzero(sub_end <= of_line) if tiles else np.zeros(0, np.int64)
        first = np.concatenate([np.arange(tiles)[fits], heads])
        end = np.concatenate([sub_end[fits], line_end])
        whole = np.arange(len(first)) >= len(fits)
        order = np.lexsort((whole, end, first))
        self.first, self.last, self.whole = first[order], end[order], whole[order]
        self.text = self.tile_text[self.first]
        with np.errstate(over="ignore"):
            self.k1 = span_hashes(prefix_sums(one), edge[self.first], edge[self.last]).view(np.int64)
            self.k1[self.whole] ^= _WHOLE_LINE
            self.k2 = span_hashes(prefix_sums(mix(two), _OTHER_BASE), edge[self.first], edge[self.last], _OTHER_BASE).view(np.int64)
        assert BASE != _OTHER_BASE
        order = np.lexsort((self.first, self.k2, self.k1, self.text))
        key = np.stack([self.text[order], self.k1[order], self.k2[order]])
        new = np.ones(len(order), bool)
        new[1:] = (key[:, 1:] != key[:, :-1]).any(0)
        head = np.flatnonzero(new)
        reach = np.repeat(self.last[order][head], np.diff(np.append(head, len(order))))
        self.own = np.zeros(len(order), bool)
        self.own[order] = self.first[order] >= reach


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind.to_pandas_dtype()), kind))


def unit_rows(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: doc_id, th (hash of the text), its digests and its tiles, with places within the text."""
    names = [c.split()[0] for c in _UNITS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.line_dedup import Units, _lists
        from dovetail.llm.ngram_join import _slices

        for keys, texts in _slices(batches, SLICE_BYTES):
            u, n = Units([t or "" for t in texts]), len(texts)
            tiles, digests = np.bincount(u.tile_text, minlength=n), np.bincount(u.text, minlength=n)
            base = np.concatenate([[0], np.cumsum(tiles)])[:-1]
            place = np.concatenate([[0], np.cumsum(digests)])[:-1]
            own = np.flatnonzero(u.own)
            small = pa.int32()
            head = np.ones(len(u.tile_text), bool)  # first tiles of texts
            head[1:] = u.tile_text[1:] != u.tile_text[:-1]
            before = np.where(head, 0, np.roll(u.end, 1)) if len(head) else u.end
            lines = np.where(head, 0, u.line - np.roll(u.line, 1)) if len(head) else u.line
            columns = [
                *(pa.array(c, pa.int64()) for c in zip(*keys)),
                _lists(u.k1, digests, pa.int64()),
                _lists(u.k2, digests, pa.int64()),
                _lists(u.first - base[u.text], digests, small),
                _lists(np.where(u.whole, u.first - u.last, u.last - u.first), digests, small),
                _lists(own - place[u.text[own]], np.bincount(u.text[own], minlength=n), small),
                _lists(u.start - before, tiles, small),
                _lists(u.end - u.start, tiles, small),
                _lists(u.words, tiles, small),
                _lists(lines, tiles, small),
                pa.array(u.size, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return common.map_arrow(docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("k"), "text"), run, _UNITS)


def repeated_units(units: DataFrame) -> DataFrame:
    """row and ``elsewhere``: the numbers of a row's digests that an earlier row has. ``units``: stored, of ``unit_rows``, with a number ``row``."""
    rank = F.coalesce("doc_id", F.lit(_FIRST))
    twice = units.select(rank.alias("owner"), "th").groupBy("owner").agg(F.min("th").alias("a"), F.max("th").alias("b")).where("a <> b")
    if not twice.isEmpty():  # where ids are told apart by themselves, the hash need not travel with every digest
        rank = F.struct(rank.alias("owner"), "th")
    rows = units.select("row", rank.alias("rank"), F.posexplode(F.arrays_zip("k1", "k2")).alias("idx", "k"))
    rows = rows.select("row", "rank", "idx", "k.k1", "k.k2")
    keys = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    keys = common.stash(keys.where("first <> last").select("k1", "k2", "n", "first"), "unit-keys")
    found = common.spread_join(rows, keys, ["k1", "k2"], ["row"], "inner", "n").where("first < rank")
    return found.groupBy("row").agg(F.collect_set("idx").alias("elsewhere"))


def kept_spans(sure: np.ndarray, going: np.ndarray, start: np.ndarray, end: np.ndarray, words: np.ndarray, line: np.ndarray, size: int, min_words: int) -> list[tuple[int, int]]:
    """What stays of a text of ``size`` characters without the ``sure`` tiles and the runs of ``going`` tiles that have ``min_words`` words, or are all of it."""
    n = len(going)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], going.astype(np.int8), [0]])))
    goes = sure.copy()
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        if (a == 0 and b == n) or words[a:b].sum() >= min_words:
            goes[a:b] = True
    edge = np.flatnonzero(np.diff(np.concatenate([[0], goes.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        begin = 0 if a == 0 else int(start[a])
        # what follows moves up; but where only the end of a line goes, its line break stays
        ends_line = b < n and line[b] != line[b - 1]
        from_line_start = a == 0 or line[a] != line[a - 1]
        stop = size if b == n else int(end[b - 1]) if ends_line and not from_line_start else int(start[b])
        if begin > at:
            out.append((at, begin))
        at = stop
    if at < size:
        out.append((at, size))
    return out


def span_rows(units: DataFrame, min_words: int) -> DataFrame:
    """doc_id, th, kept, n_removed for the documents of ``units`` that lose something."""
    columns = ["doc_id", "th", "first", "reach", "own", "gap", "long", "words", "lines", "size"]
    joined = units.select("row", *columns).join(repeated_units(units), "row", "left")
    touched = joined.where(F.col("elsewhere").isNotNull() | (F.size("own") > 0)).select(*columns, "elsewhere")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.line_dedup import kept_spans

        for batch in batches:
            kept, removed, which = [], [], []
            for i in range(batch.num_rows):
                first, reach, own, gap, long, words, lines = (batch.column(k)[i].values.to_numpy() for k in range(2, 9))
                end = np.cumsum(gap + long)
                start, last, line = end - long, first + np.abs(reach), np.cumsum(lines)
                size, elsewhere = batch.column(9)[i].as_py(), batch.column(10)[i].values
                places = own if elsewhere is None else np.union1d(own, elsewhere.to_numpy())
                marks = np.zeros((2, len(start) + 1), np.int64)  # of whole lines, of all
                for k, some in enumerate((places[reach[places] < 0], places)):
                    np.add.at(marks[k], first[some], 1)
                    np.add.at(marks[k], last[some], -1)
                sure, going = np.cumsum(marks[:, :-1], 1) > 0
                spans = kept_spans(sure, going, start, end, words, line, size, min_words)
                gone = size - sum(b - a for a, b in spans)
                if gone:
                    which.append(i)
                    kept.append([{"start": a, "end": b} for a, b in spans])
                    removed.append(gone)
            ids = batch.take(pa.array(which, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids.column(0), ids.column(1), pa.array(kept, span), pa.array(removed, pa.int64())], names=["doc_id", "th", "kept", "n_removed"])

    return common.map_arrow(touched, run, "doc_id long, th long, kept array<struct<start:long,end:long>>, n_removed long").distinct()


def _cut(docs: DataFrame, min_words: int) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` beside what stays of each row, and columns of it: ``text``, ``kept`` and ``n_removed``."""
    units = common.stash(unit_rows(docs).withColumn("row", F.monotonically_increasing_id()), "units")
    spans = common.stash(span_rows(units, min_words), "spans")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64("d.text") == F.col("s.th"))
    joined = docs.alias("d").join(spans.alias("s"), same, "left")
    text, touched = F.col("d.text"), F.col("s.kept").isNotNull()

    @F.pandas_udf("string")
    def pieces(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else "".join([t[x:y] for x, y in zip(a, b)]) for t, a, b in zip(text, start, end)], dtype=object)

    part = lambda f: F.transform("s.kept", lambda k: k[f])
    left = pieces(F.when(touched, text), part("start"), part("end"))
    size = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    whole = F.when(size > 0, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("end")))).otherwise(none)
    made = {
        "text": F.when(touched, left).otherwise(text),
        "kept": F.coalesce(F.col("s.kept"), whole),
        "n_removed": F.coalesce(F.col("s.n_removed"), F.lit(0).cast("bigint")),
    }
    return joined, {name: column.alias(name) for name, column in made.items()}


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with what stays of ``text``, and ``kept`` (start and end of each kept span in the original), n_removed (characters)."""
    joined, made = _cut(docs, min_words)
    others = [c for c in docs.columns if c not in ("kept", "n_removed")]
    return joined.select(*(made["text"] if c == "text" else F.col(common.quoted(c, "d")) for c in others), made["kept"], made["n_removed"])


def cut_texts(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with what stays of ``text`` and, where there is a column of that name, its length as ``n_chars``; all other columns as they are."""
    joined, made = _cut(docs, min_words)
    made["n_chars"] = F.char_length(made["text"]).cast("bigint").alias("n_chars")
    return joined.select(*(made[c] if c in ("text", "n_chars") else F.col(common.quoted(c, "d")) for c in docs.columns))
