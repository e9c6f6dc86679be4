"""Benchmark decontamination with a distributed positional inverted index, in DataFrame functions only.

1. Windows of the test items (13 words, or a shorter item's whole text), each once, with the items that have it.
2. The postings of all their terms over the corpus are counted.
3. The index: for the terms that some window or item is looked up by, its ``LISTS`` or ``NEAR_TERMS`` rarest ones, a stored table of
   term, document and all positions. A term that nothing is looked up by is not stored.
4. Exact phrases: the list of a window's rarest term, less the term's offset in the window, is intersected with the list of its
   next rarest, less its own. Where starts are left, all words of the window are compared with the document's.
5. Proximity: documents where the rarest terms of an item all stand near the rarest one, in any order, from the same index.

Tables whose size goes with the benchmark are broadcast only while their counted rows stay below a bound; beyond it, they are joined
by shuffle, with frequent keys dealt to parts.

Null and empty texts have no words and no items. Items with a null id mark words but are not listed; rows of one item_id are one
item. Rows that share an id and a text share their result; each row is returned. Documents are read whole: their words
are one array, their positions of a term another. Other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dovetail.llm import common

#: What separates words once A-Z may still stand in the text, and the letters that change case.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that may be broadcast: of test terms, of windows and what is looked up by a term (some 500 bytes each), of documents (16 bytes).
MOST_TERMS, MOST_WINDOWS, MOST_KEYS = 500_000, 50_000, 200_000
#: Lists that are intersected for a window; rarest terms of an item that have to stand within ``NEAR_WORDS`` words of the rarest.
LISTS, NEAR_TERMS, NEAR_WORDS = 2, 3, 10


def raw_words(text: Column) -> Column:
    """The words of a text, in their own case."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def windows(benchmark: DataFrame, width: int = 13) -> DataFrame:
    """item_id and w (its words) of every distinct window of every item."""
    words = benchmark.select("item_id", F.transform(raw_words(F.col("text")), lower_ascii).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - (width - 1)))
    return words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, width))).alias("w")).distinct()


def _few(df: DataFrame, most: int) -> tuple[DataFrame, bool]:
    few = df.limit(most + 1).count() <= most
    return (F.broadcast(df) if few else df), few


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How many postings each of ``terms`` (term) has in ``docs``; terms without any are left out."""
    held, _ = _few(terms, MOST_TERMS)
    # outer, so that no filter on the array's size splits every text twice
    postings = docs.select(F.explode_outer(raw_words(F.col("text"))).alias("word")).select(lower_ascii(F.col("word")).alias("term"))
    return postings.join(held, "term").groupBy("term").agg(F.count("*").alias("postings"))


def _meet(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join with a stored table of one row for each key: broadcast if it has few rows, else spread by counts of ``left``."""
    held, few = _few(right, MOST_WINDOWS)
    if few:
        return left.join(held, key)
    sizes = left.groupBy(key).agg(F.count("*").alias("rows"))
    return common.spread_join(left, common.stash(right.join(sizes, key), "counted"), [key], ["doc_id", "th"], "inner")


def _rarest(rows: DataFrame, counts: DataFrame, most: int, *keys: str) -> DataFrame:
    """k (from 0), term, o and n (of them) of the ``most`` rarest terms of each group of ``rows`` (keys, term, o), where all terms occur."""
    rank = F.struct(F.coalesce("postings", F.lit(0)).alias("postings"), F.col("term"), F.col("o"))
    rare = rows.join(counts, "term", "left").groupBy(*keys).agg(F.sort_array(F.collect_list(rank)).alias("rare"))
    rare = rare.where(F.col("rare")[0]["postings"] > 0).select(*keys, F.slice("rare", 1, most).alias("rare"))
    return rare.select(*keys, F.size("rare").alias("n"), F.posexplode("rare").alias("k", "r")).select(*keys, "n", "k", "r.term", "r.o")


class Index:
    """The positional index of ``docs`` (doc_id, text) for the items of ``benchmark`` (item_id, text), and what is found in it."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, width: int = 13):
        self.docs = docs
        found = windows(benchmark, width)
        grouped = found.groupBy("w").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        grouped = common.stash(grouped, "grouped-windows").select(F.monotonically_increasing_id().alias("win"), "w", "items")
        self.windows = common.stash(grouped, "windows")
        words = benchmark.where("item_id is not null").select("item_id", F.explode(F.transform(raw_words(F.col("text")), lower_ascii)).alias("term")).distinct()
        placed = self.windows.select("win", F.posexplode("w").alias("o", "term"))
        self.counts = common.stash(term_counts(docs, placed.select("term").union(words.select("term")).distinct()), "term-counts")
        self.seeds = common.stash(_rarest(placed, self.counts, LISTS, "win"), "seeds")
        self.near = common.stash(_rarest(words.withColumn("o", F.lit(0)), self.counts, NEAR_TERMS, "item_id"), "rare-terms")
        self.postings = common.stash(self._postings(), "postings")

    def _postings(self) -> DataFrame:
        """term, doc_id, th (hash of the text) and ascending positions (from 0)."""
        held, _ = _few(common.stash(self.seeds.select("term").union(self.near.select("term")).distinct(), "looked-up"), MOST_TERMS)
        # outer, so that no filter on the array's size splits every text twice; all of it is one generated loop
        words = self.docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode_outer(raw_words(F.col("text"))).alias("p", "word"))
        met = words.select("doc_id", "th", "p", lower_ascii(F.col("word")).alias("term")).join(held, "term")
        return met.groupBy("term", "doc_id", "th").agg(F.array_sort(F.collect_set("p")).alias("positions"))

    def exact(self) -> DataFrame:
        """doc_id, th, start, win, len of every occurrence of a window."""
        looks = self.seeds.groupBy("term").agg(F.collect_list(F.struct("win", "k", "n", "o")).alias("looks"))
        lists = _meet(self.postings, common.stash(looks, "looks"), "term").select("doc_id", "th", "positions", F.explode("looks").alias("s"))
        starts = F.filter(F.transform("positions", lambda p: p - F.col("s.o")), lambda p: p >= 0)
        lists = common.stash(lists.select("doc_id", "th", "s.win", "s.k", "s.n", starts.alias("starts")).where(F.size("starts") > 0), "lists")
        # a list for each of the window's terms, the rarest first; what is left are the starts that all of them have
        ordered = lists.groupBy("doc_id", "th", "win", "n").agg(F.sort_array(F.collect_set(F.struct("k", "starts"))).alias("lists")).where(F.size("lists") == F.col("n"))
        left = F.aggregate("lists", F.col("lists")[0]["starts"], lambda acc, x: F.array_intersect(acc, x["starts"]))
        left = ordered.select("doc_id", "th", "win", left.alias("starts")).where(F.size("starts") > 0)
        phrases = _meet(common.stash(left, "starts"), self.windows.select("win", "w"), "win")
        wanted = phrases.groupBy("doc_id", "th").agg(F.collect_list(F.struct("win", "w", "starts")).alias("wanted"))
        wanted = common.stash(wanted.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "wanted"), "wanted")
        keys, _ = _few(wanted.select("d", "t"), MOST_KEYS)
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t"))
        texts = self.docs.select("doc_id", "text").join(keys, same, "left_semi")
        held = texts.join(wanted, same).select("doc_id", F.col("t").alias("th"), raw_words(F.col("text")).alias("words"), F.explode("wanted").alias("c"))
        there = lambda s: F.transform(F.slice("words", s + 1, F.size("c.w")), lower_ascii) == F.col("c.w")
        seen = held.select("doc_id", "th", "c.win", F.size("c.w").alias("len"), F.explode(F.filter("c.starts", there)).alias("start"))
        return seen.select("doc_id", "th", "start", "win", "len").distinct()

    def proximity(self, span: int = NEAR_WORDS) -> DataFrame:
        """doc_id, th, item_id, at: the positions of an item's rarest term that all its rarest terms stand within ``span`` words of."""
        looks = self.near.groupBy("term").agg(F.collect_list(F.struct("item_id", "k", "n")).alias("looks"))
        lists = _meet(self.postings, common.stash(looks, "near-looks"), "term").select("doc_id", "th", "positions", F.explode("looks").alias("s"))
        lists = lists.select("doc_id", "th", "s.item_id", "s.n", "s.k", "positions")
        lists = lists.groupBy("doc_id", "th", "item_id", "n").agg(F.sort_array(F.collect_set(F.struct("k", "positions"))).alias("lists"))
        lists = lists.where(F.size("lists") == F.col("n"))
        beside = lambda p: F.forall("lists", lambda x: F.exists(x["positions"], lambda q: F.abs(q - p) <= span))
        at = F.filter(F.col("lists")[0]["positions"], beside)
        return lists.select("doc_id", "th", "item_id", at.alias("at")).where(F.size("at") > 0)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (a ``share``-th of its words or more is hit),
    n_near (items whose rarest terms stand near one another), th (hash of the text)."""
    index = Index(docs, benchmark, width)
    hits = _meet(common.stash(index.exact(), "hits"), index.windows.select("win", "items"), "win")
    items = F.array_distinct(F.flatten(F.collect_set("items")))
    by_doc = hits.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), items.alias("items"))
    # words under the union of the spans, by ascending start
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))
    end = lambda acc, x: F.greatest(acc["end"], x["start"] + x["len"])
    union = F.aggregate("spans", zero, lambda acc, x: F.struct(end(acc, x).alias("end"), (acc["n"] + (end(acc, x) - F.greatest(acc["end"], x["start"]))).cast("bigint").alias("n")))
    marked = by_doc.select("doc_id", "th", union["n"].alias("hit"), F.array_sort("items").alias("items"), F.lit(0).cast("bigint").alias("near"))
    near = index.proximity().groupBy("doc_id", "th").agg(F.count_distinct("item_id").alias("near"))
    near = near.select("doc_id", "th", F.lit(None).cast("bigint").alias("hit"), F.lit(None).cast("array<string>").alias("items"), "near")
    both = marked.unionByName(near).groupBy("doc_id", "th").agg(F.max("hit").alias("hit"), F.max("items").alias("items"), F.max("near").alias("near"))
    both = both.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "hit", "items", "near")
    sizes = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(raw_words(F.col("text"))).cast("bigint").alias("n_words"))
    joined = sizes.join(both, sizes["doc_id"].eqNullSafe(both["d"]) & (sizes["th"] == both["t"]), "left")
    none = F.lit(0).cast("bigint")
    n_hit, listed = F.coalesce("hit", none), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(listed).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("near", none).alias("n_near"),
        "th",
    )
