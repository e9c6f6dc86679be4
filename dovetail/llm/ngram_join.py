"""N-gram Jaccard self-join: rare-first prefix filtering, and the classes of the links.

Shingles that only one class of equal sets has cannot be shared, so they come first in the order (rarest first, ties
by hash) and cost nothing beyond being counted. What is counted travels as packed blocks, sorted by hash, one for
each slice of text and part of the hash space, not as a row for each shingle.

1. Every text becomes its set of shingles; equal sets are one class (128-bit digest of the set).
2. Blocks of (shingle, class) meet by part of the hash space, which gives every shingle's document frequency. Those in
   two classes or more go back to their class.
3. A class whose prefix (n - ceil(t n) + 1 shingles, rarest first) has only shingles of its own is done.
   The others post their prefix; classes that post the same shingle are a list.
4. Star: each class of a list is held against the list's smallest class, after the length and positional filters, with
   the suffix filter before the full count. A class's set travels once for each such hub, the hub's once for 64 classes.
5. Components of the links found. In lists that still hold several components, pairs across components meet in blocks of
   bounded bytes. Within two blocks, those that share a token of an open list, pass the length and positional filters
   and were not seen by the star are verified once each: few of them by the suffix filter and a count, many as a product
   of the blocks. Blocks hold classes of one hub, and large components apart, so a large group that has become one
   component costs nothing here. Each pair of blocks sends on a spanning set of its links.

So no pair that the prefix filter leaves is lost, none within a component is made, and no list is capped.

Null and empty texts have the empty set and link with nothing. Rows with a null id take part and keep the smallest other id of
their class. Repeated rows are each returned. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import common, components

#: Bytes of text that are hashed together; postings in a part of the hash space, on average; classes and bytes in a block.
SLICE_BYTES, PART_ROWS, BLOCK_CLASSES, BLOCK_BYTES = 1_500_000, 2_000_000, 256, 256_000
#: Bits of a part's number at most; partitions of a shuffle at most, in which parts beyond that follow one another.
PART_BITS, MOST_PARTITIONS = 24, 32_768
_I = np.int64


def prefix_length(n: int, percent: int) -> int:
    """How many of n shingles, rarest first, two sets that link must share one of."""
    return n - -(-percent * n // 100) + 1


def least_overlap(n: int, m: int, percent: int) -> int:
    """The smallest intersection with which sets of n and m elements link."""
    return -(-percent * (n + m) // (100 + percent))


def suffix_bound(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """At least so many elements are in only one of two ascending arrays: halves are split at one's middle element."""
    if depth == 0 or not len(a) or not len(b):
        return abs(len(a) - len(b))
    mid = len(a) // 2
    lo, hi = np.searchsorted(b, a[mid], "left"), np.searchsorted(b, a[mid], "right")
    return suffix_bound(a[:mid], b[:lo], depth - 1) + suffix_bound(a[mid + 1 :], b[hi:], depth - 1) + int(hi == lo)


def _slices(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list, list]]:
    """Keys and texts of rows, some ``most`` bytes of text at a time; a longer text stands alone."""
    most = most or SLICE_BYTES
    ids, texts, size = [], [], 0
    for batch in batches:
        first = batch.column(0)
        keys = zip(*(c.to_pylist() for c in first.flatten())) if pa.types.is_struct(first.type) else first.to_pylist()
        for key, text in zip(keys, batch.column(1)):
            ids.append(key)
            texts.append(text.as_py())
            size += text.as_buffer().size if text.is_valid else 0
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _halves(digests: list[bytes]) -> np.ndarray:
    """128-bit digests as two signed numbers each."""
    return np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, c1, c2 (digest of the set) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.shingles import hash_shingles, set_digest

        for ids, texts in _slices(batches):
            hashes, at = hash_shingles(texts, width)
            digests = _halves([set_digest(hashes[a:b]) for a, b in zip(at, at[1:])])
            doc_ids, th = zip(*ids)
            columns = (doc_ids, th, np.diff(at), digests[:, 0], digests[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "th", "n_shingles", "c1", "c2"])

    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("k"), "text")
    return common.map_arrow(keyed, run, "doc_id long, th long, n_shingles long, c1 long, c2 long")


def _rows(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _left_out(parts: int) -> int:
    """How many low bits of a shingle its part stands for: all of the part's own, and at least 16, so that 48 are packed."""
    return max(16, parts.bit_length() - 1)


def _blocks(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Packed postings: a row for each slice of text and part of the hash space; ``cls`` holds the digests of its sets."""
    shift = _left_out(parts)
    names = ["part", "high", "low", "idx", "cls", "n"]
    kinds = [pa.int32(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.shingles import hash_shingles, set_digest

        for _, texts in _slices(batches):
            hashes, at = hash_shingles(texts, width)
            if not len(hashes):
                continue
            sizes = np.diff(at)
            digests = [set_digest(hashes[a:b]) for a, b in zip(at, at[1:])]
            cls, seen = _halves(digests), set()
            keep = np.zeros(len(digests), bool)
            for i, d in enumerate(digests):  # a set once a slice
                keep[i] = sizes[i] > 0 and d not in seen
                seen.add(d)
            owner = np.repeat(np.arange(len(cls)), sizes)
            mine = keep[owner]
            hashes, owner = hashes[mine], owner[mine]
            part = (hashes & np.uint64(parts - 1)).astype(np.int32)
            order = np.lexsort((owner, hashes >> np.uint64(shift), part))
            part, top, owner = part[order], hashes[order] >> np.uint64(shift), owner[order]
            del hashes, order
            cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)).tolist()
            rows = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                local, index = np.unique(owner[a:b], return_inverse=True)
                t = top[a:b]
                high, low = (t >> np.uint64(16)).astype("<u4").tobytes(), (t & np.uint64(0xFFFF)).astype("<u2").tobytes()
                index = index.astype("<u4" if len(local) > 0xFFFF else "<u2").tobytes()
                rows.append((int(part[a]), high, low, index, cls[local].astype("<i8").tobytes(), sizes[local].astype("<u4").tobytes()))
                if len(rows) == 32:
                    yield _rows(names, kinds, rows)
                    rows = []
            if rows:
                yield _rows(names, kinds, rows)

    return common.map_arrow(docs.select("doc_id", "text"), run, "part int, high binary, low binary, idx binary, cls binary, n binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Rows of batches that are sorted by their first ``keys`` columns, group by group."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def _shared(blocks: DataFrame, parts: int, homes: int) -> DataFrame:
    """From the blocks of each part of the hash space, the shingles in two classes or more, packed for the classes' homes."""
    shift = _left_out(parts)
    names = ["home", "token", "df", "cls", "n", "runs"]
    kinds = [pa.int32(), *[pa.binary()] * 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (part,), rows in _groups(batches, 1):
            t = np.concatenate([np.frombuffer(high, "<u4").astype(np.uint64) << np.uint64(16) | np.frombuffer(low, "<u2") for high, low, *_ in rows])
            order = np.argsort(t, kind="stable")
            st = t[order]
            twin = np.zeros(len(st), bool)  # shingles that stand more than once; the others go at once
            twin[1:] = st[1:] == st[:-1]
            twin[:-1] |= twin[1:]
            keep = np.zeros(len(st), bool)
            keep[order[twin]] = True
            del order, st, twin
            kept, at = [], 0
            for high, _, idx, cls, n in rows:
                size = len(high) // 4
                here = np.flatnonzero(keep[at : at + size])
                i = np.frombuffer(idx, "<u2" if len(idx) == 2 * size else "<u4")[here]
                both = np.frombuffer(cls, "<i8").reshape(-1, 2)
                kept.append((t[at : at + size][here], both[i, 0], both[i, 1], np.frombuffer(n, "<u4")[i]))
                at += size
            rows.clear()
            t, c, d, n = (np.concatenate(x) for x in zip(*kept))
            del kept, keep
            if not len(t):
                continue
            order = np.lexsort((d, c, t))
            t, c, d, n = t[order], c[order], d[order], n[order]
            new = np.ones(len(t), bool)  # copies of a class count once
            new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1]) | (d[1:] != d[:-1])
            t, c, d, n = t[new], c[new], d[new], n[new]
            start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            df = np.repeat(np.diff([*start, len(t)]), np.diff([*start, len(t)]))
            more = df > 1
            t, c, d, n, df = t[more], c[more], d[more], n[more], df[more]
            home = (c.view(np.uint64) % np.uint64(homes)).astype(np.int32)
            order = np.lexsort((t, d, c, home))
            t, c, d, n, df, home = t[order], c[order], d[order], n[order], df[order], home[order]
            token = (t << np.uint64(shift)) | np.uint64(part)
            cuts = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, _I)
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(home)]):
                new = np.flatnonzero(np.concatenate([[True], (c[a + 1 : b] != c[a : b - 1]) | (d[a + 1 : b] != d[a : b - 1])]))
                cls = np.stack([c[a:b][new], d[a:b][new]], 1)
                runs = np.diff([*new, b - a])
                out.append((int(home[a]), token[a:b].astype("<u8").tobytes(), df[a:b].astype("<u4").tobytes(), cls.astype("<i8").tobytes(), n[a:b][new].astype("<u4").tobytes(), runs.astype("<u4").tobytes()))
            if out:
                yield _rows(names, kinds, out)

    dealt = blocks.repartition(min(MOST_PARTITIONS, parts), "part").sortWithinPartitions("part")
    return common.map_arrow(dealt, run, "home int, token binary, df binary, cls binary, n binary, runs binary")


def _active(shared: DataFrame, homes: int, percent: int) -> DataFrame:
    """Classes that may link: c1, c2, n, tokens (ascending, those in two classes or more), prefix and the places of its tokens in the order."""
    names = ["c1", "c2", "n", "tokens", "prefix", "places"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 1):
            token = np.concatenate([np.frombuffer(r[0], "<u8") for r in rows])
            df = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
            runs = np.concatenate([np.frombuffer(r[4], "<u4") for r in rows])
            both = np.concatenate([np.frombuffer(r[2], "<i8").reshape(-1, 2) for r in rows])
            c, d = np.repeat(both[:, 0], runs), np.repeat(both[:, 1], runs)
            n = np.repeat(np.concatenate([np.frombuffer(r[3], "<u4") for r in rows]), runs)
            rows.clear()
            order = np.lexsort((token, df, d, c))
            token, c, d, n = token[order], c[order], d[order], n[order]
            cuts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (d[1:] != d[:-1])]))
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(c)]):
                size, own = int(n[a]), int(n[a]) - int(b - a)
                length = prefix_length(size, percent) - own
                if length <= 0:
                    continue
                places = list(range(own, own + min(length, int(b - a))))
                out.append((int(c[a]), int(d[a]), size, np.sort(token[a:b]).tobytes(), token[a:b][:length].view(_I).tolist(), places))
                if len(out) == 500:
                    yield _rows(names, kinds, out)
                    out = []
            if out:
                yield _rows(names, kinds, out)

    dealt = shared.repartition(min(MOST_PARTITIONS, homes), "home").sortWithinPartitions("home")
    return common.map_arrow(dealt, run, "c1 long, c2 long, n long, tokens binary, prefix array<long>, places array<long>")


def _star_links(postings: DataFrame, active: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between each class and the smallest class of a list it is in; and the lists (token, hub)."""
    lists = postings.groupBy("token").agg(F.min(F.struct("cls", "n", "place")).alias("hub"), F.count("*").alias("k")).where("k > 1").select("token", "hub")
    lists = common.stash(lists, "lists")
    a, b = F.col("n"), F.col("hub.n")
    enough = F.ceil(percent * (a + b) / (100 + percent))
    pairs = (
        postings.join(lists, "token")
        .where((F.col("cls") != F.col("hub.cls")) & (100 * F.least(a, b) >= percent * F.greatest(a, b)))  # length
        .where(F.least(a - F.col("place"), b - F.col("hub.place")) + F.least("place", "hub.place") >= enough)  # positional
        .select(F.col("hub.cls").alias("hub"), "cls")
        .distinct()
    )
    pairs = common.stash(pairs.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(1 << 20))), "pairs")
    groups = pairs.groupBy("hub").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 64)).alias("groups"))
    salted = pairs.join(groups, "hub").select("hub", (F.col("salt") % F.col("groups")).alias("salt"), "cls")
    sets = active.select("cls", "n", "tokens")
    members = salted.join(sets, "cls").select("hub", "salt", F.lit(1).alias("kind"), "cls", "n", "tokens")
    hubs = groups.select("hub", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("salt")).join(sets.withColumnRenamed("cls", "hub"), "hub")
    rows = members.unionByName(hubs.select("hub", "salt", F.lit(0).alias("kind"), F.col("hub").alias("cls"), "n", "tokens"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, salt, n_hub, of_hub = None, None, 0, None
        for batch in batches:
            found = []
            for h, s, kind, cls, n, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(tokens, "<u8")
                if kind == 0:
                    hub, salt, n_hub, of_hub = h, s, n, own
                    continue
                if (h, s) != (hub, salt):
                    raise ValueError("a hub's set is missing")
                need = least_overlap(n, n_hub, percent)
                # what stands on one side only, besides the shingles of one class
                if len(own) + len(of_hub) - suffix_bound(own, of_hub) < 2 * need:
                    continue
                both = len(np.intersect1d(own, of_hub, assume_unique=True))
                if 100 * both >= percent * (n + n_hub - both):
                    found.append((h, cls))
            columns = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])

    links = common.map_arrow(rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "kind"), verify, "u long, v long")
    return links, lists


def _cross_links(postings: DataFrame, lists: DataFrame, active: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links across components, in lists that still hold several."""
    labelled = postings.select("token", "cls", "place").join(roots, "cls", "left").select("token", "cls", "place", F.coalesce("root", "cls").alias("root"))
    several = labelled.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("token")
    open_ = common.stash(labelled.join(several, "token").join(lists.select("token", F.col("hub.cls").alias("hub")), "token"), "open")
    # a class's home is the smallest hub of its lists; homes are cut into blocks, large components apart
    posts = F.sort_array(F.collect_list(F.struct("token", "place", "hub"))).alias("posts")  # a prefix at most
    home = open_.groupBy("cls", "root").agg(F.min("hub").alias("home"), posts).join(active.select("cls", F.length("tokens").alias("bytes")), "cls")
    home = common.stash(home, "home")
    sizes = home.groupBy("home", "root").agg(F.count("*").alias("k"))
    home = home.join(sizes, ["home", "root"]).withColumn("root_block", F.when(F.col("k") >= BLOCK_CLASSES // 4, F.col("root")).otherwise(F.lit(None)))
    cuts = home.groupBy("home", "root_block").agg(F.ceil(F.greatest(F.sum("bytes") / BLOCK_BYTES, F.count("*") / BLOCK_CLASSES)).alias("cuts"))
    same = (F.col("h.home") == F.col("c.home")) & F.col("h.root_block").eqNullSafe(F.col("c.root_block"))
    block = F.xxhash64("h.home", "h.root_block", F.pmod(F.xxhash64("h.cls"), F.greatest("c.cuts", F.lit(1))))
    blocks = home.alias("h").join(cuts.alias("c"), same).select("h.cls", "h.root", "h.root_block", "h.posts", block.alias("block"))
    blocks = common.stash(blocks, "blocks")
    inside = open_.select("token", "cls").join(blocks.select("cls", "block", "root_block"), "cls").select("token", "block", "root_block").distinct()
    left, right = inside.alias("l"), inside.alias("r")
    # a list of many classes has few blocks, so this is not a join of its classes
    pairs = (
        left.join(right, (F.col("l.token") == F.col("r.token")) & (F.col("l.block") <= F.col("r.block")))
        .where(F.col("l.root_block").isNull() | F.col("r.root_block").isNull() | (F.col("l.root_block") != F.col("r.root_block")))
        .select(F.col("l.block").alias("x"), F.col("r.block").alias("y"))
        .distinct()
    )
    pairs = common.stash(pairs, "block-pairs")
    second = pairs.where("x <> y").select("x", "y", F.col("y").alias("block"), F.lit(1).alias("side"))
    sides = pairs.select("x", "y", F.col("x").alias("block"), F.lit(0).alias("side")).unionByName(second)
    sets = blocks.select("cls", "root", "block", "posts").join(active.select("cls", "n", "tokens"), "cls")
    post = lambda name: F.transform("posts", lambda p: p[name]).alias(name)
    rows = sides.join(sets, "block").select("x", "y", "side", "cls", "root", "n", "tokens", post("token"), post("place"), post("hub"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (x, y), held in _groups(batches, 2):
            first = [r for r in held if r[0] == 0]
            yield _products(first, first if x == y else [r for r in held if r[0] == 1], percent)

    return common.map_arrow(rows.repartition("x", "y").sortWithinPartitions("x", "y", "side"), verify, "u long, v long")


def _candidates(first: list, second: list, percent: int) -> np.ndarray:
    """Which pairs of two blocks share a token of an open list and pass the length and positional filters; not those of a list's hub,
    which the star has seen, nor those within a component."""
    n, root, cls = (tuple(np.array([r[k] for r in side], _I) for side in (first, second)) for k in (3, 2, 1))
    posts = []
    for side in (first, second):
        owner = np.repeat(np.arange(len(side)), [len(r[5]) for r in side])
        token, place, hub = (np.array([v for r in side for v in r[k]], _I) for k in (5, 6, 7))
        order = np.argsort(token, kind="stable")
        posts.append((token[order], owner[order], place[order], hub[order]))
    (ta, oa, pa_, ha), (tb, ob, pb, _) = posts
    enough = -(-percent * (n[0][:, None] + n[1][None, :]) // (100 + percent))
    met, out = np.zeros((len(first), len(second)), bool), np.zeros((len(first), len(second)), bool)
    lo, hi = np.searchsorted(ta, tb, "left"), np.searchsorted(ta, tb, "right")
    for a in range(0, len(tb), 4096):  # the postings of a token on both sides
        width = (hi - lo)[a : a + 4096]
        j = np.repeat(np.arange(a, a + len(width)), width)
        i = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[a : a + 4096], width)
        x, y = oa[i], ob[j]
        met[x, y] = True
        most = np.minimum(n[0][x] - pa_[i], n[1][y] - pb[j]) + np.minimum(pa_[i], pb[j])
        seen = (cls[0][x] == ha[i]) | (cls[1][y] == ha[i])
        drop = seen | (most < enough[x, y])
        out[x[drop], y[drop]] = True
    fits = 100 * np.minimum(n[0][:, None], n[1][None, :]) >= percent * np.maximum(n[0][:, None], n[1][None, :])
    return met & ~out & fits & (root[0][:, None] != root[1][None, :])


def _products(first: list, second: list, percent: int) -> pa.RecordBatch:
    """A spanning set of the links between two blocks of (side, cls, root, n, tokens, token, place, hub), across components only."""
    wanted = _candidates(first, second, percent)
    if first is second:
        wanted = np.triu(wanted)  # each pair once
    tokens = [[np.frombuffer(r[4], "<u8") for r in side] for side in (first, second)]
    n = [[r[3] for r in side] for side in (first, second)]
    pairs = np.argwhere(wanted)
    if len(pairs) <= 4 * (len(first) + len(second)):
        linked = []
        for i, j in pairs.tolist():
            a, b, need = tokens[0][i], tokens[1][j], least_overlap(n[0][i], n[1][j], percent)
            if len(a) + len(b) - suffix_bound(a, b) >= 2 * need and len(np.intersect1d(a, b, assume_unique=True)) >= need:
                linked.append((i, j))
    else:
        both = _overlaps(tokens)
        sizes = np.array(n[0], _I)[:, None] + np.array(n[1], _I)[None, :]
        linked = np.argwhere(wanted & (100 * both >= percent * (sizes - both))).tolist()
    parent: dict[int, int] = {}

    def find(k: int) -> int:
        while parent.setdefault(k, k) != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    found = []
    for i, j in linked:
        a, b = find(first[i][2]), find(second[j][2])
        if a != b:
            parent[a] = b
            found.append((first[i][1], second[j][1]))
    columns = list(zip(*found)) or [(), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v"])


def _overlaps(tokens: list[list[np.ndarray]]) -> np.ndarray:
    """The sizes of all intersections between two blocks of sets, by products of their incidence, some columns at a time."""
    known, inverse = np.unique(np.concatenate([t for side in tokens for t in side]), return_inverse=True)
    at, index = 0, []
    for side in tokens:
        owner = np.repeat(np.arange(len(side)), [len(t) for t in side])
        index.append((owner, inverse[at : at + len(owner)]))
        at += len(owner)
    both = np.zeros((len(tokens[0]), len(tokens[1])), np.float32)
    for a in range(0, len(known), 8192):
        planes = []
        for side, (owner, column) in zip(tokens, index):
            m = np.zeros((len(side), min(8192, len(known) - a)), np.float32)
            here = (column >= a) & (column < a + 8192)
            m[owner[here], column[here] - a] = 1
            planes.append(m)
        both += planes[0] @ planes[1].T
    return both.astype(_I)


def similarity_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, root (of the component), component_id for every row of ``docs`` (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of ``width``-word shingles. ``root`` tells components apart
    that have no id.
    """
    rows = common.stash(shingle_sets(docs, width), "sets")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    parts = 1 << min(PART_BITS, max(6, int(total // PART_ROWS).bit_length()))  # a part is the low bits of a shingle, which its block leaves out
    homes = max(64, parts // 4)
    found = _active(_shared(_blocks(docs, width, parts), parts, homes), homes, percent)
    # from here on, the classes that may link go by a number: that of their row in the stored table
    active = common.stash(found, "active").withColumn("cls", F.monotonically_increasing_id())
    active = common.stash(active, "numbered")
    postings = active.select("cls", "n", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("cls", "n", F.col("p.prefix").alias("token"), F.col("p.places").alias("place"))
    star, lists = _star_links(postings, active, percent)
    star = common.stash(star, "star")
    roots = components.components(star).select(F.col("node").alias("cls"), "root")
    cross = _cross_links(postings, lists, active, roots, percent)
    # the links across components tie roots to roots; the first roots stay below them
    ties = cross.join(roots.select(F.col("cls").alias("u"), F.col("root").alias("ru")), "u", "left").join(roots.select(F.col("cls").alias("v"), F.col("root").alias("rv")), "v", "left")
    ties = common.stash(ties.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v")), "ties")
    if not ties.isEmpty():
        again = components.components(ties)
        alone = ties.select(F.explode(F.array("u", "v")).alias("cls")).distinct().join(roots.select("cls"), "cls", "left_anti")
        roots = (
            roots.unionByName(alone.select("cls", F.col("cls").alias("root")))
            .join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            .select("cls", F.coalesce("top", "root").alias("root"))
        )
    numbered = active.select("c1", "c2", "cls").join(roots, "cls", "left").select("c1", "c2", F.coalesce("root", "cls").alias("root"))
    classes = rows.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    classes = common.stash(classes.join(numbered, ["c1", "c2"], "left"), "classes")
    top = common.stash(classes.where("root is not null").groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("k")), "tops")
    linked = common.spread_join(classes.where("root is not null"), top, ["root"], ["c1", "c2"], "inner", "k")
    alone = classes.where("root is null").withColumn("component_id", F.col("least"))
    # a class that shares no shingle has no number and is told apart by its own digest
    name = lambda root: F.concat_ws(":", *root)
    of_class = linked.select("c1", "c2", "rows", name([F.col("root")]).alias("root"), "component_id").unionByName(alone.select("c1", "c2", "rows", name([F.col("c1"), F.col("c2")]).alias("root"), "component_id"))
    placed = common.spread_join(rows, common.stash(of_class, "of-class"), ["c1", "c2"], ["doc_id", "th"])
    return placed.select("doc_id", "th", "n_shingles", "root", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
