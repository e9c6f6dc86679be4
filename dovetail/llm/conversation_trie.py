"""The prefix trie of conversations: what turns they share from the start, by distributed MSD radix partitioning.

1. Turns are numbered within their conversation by a range partitioning of all turns, so a conversation may span tasks. Each distinct
   turn gets an id (a dictionary by the MD5 of role and text); a conversation is the row of its turns' ids. Equal conversations are one,
   with their number, from here on.
2. All conversations are one bucket, the root. A bucket of over ``LOCAL_IDS`` ids is partitioned by the next turn id; each part is a node
   and a bucket one turn deeper. Counts are summed before they travel. Buckets of at most that many ids, and what is left of
   one very long conversation alone, leave the recursion; the buckets that stay are few (all ids by ``LOCAL_IDS``) in each round.
3. A bucket that is small enough is sorted in one task, many at a time, by multikey quicksort: three parts around the turn id of a pivot
   at the current depth; the middle one is a node, and goes on one turn deeper. Turns that one conversation has to itself are a chain of nodes.
4. Counts of leaves and saved bytes go up through the nodes of the radix rounds, deepest first.

What a node saves is held once instead of ``n_convs`` times. Turns stand in the order of turn, role, text (nulls first); null roles and texts
are empty; repeated rows count as often as they stand; rows without a conv_id take no part. Texts are not held beyond the ordering, so
long ones do no harm. The digest of the conversations that end at a node is a stream over their sorted ids, bounded in memory: ids are written
out as text in many tasks, and one task hashes what belongs to one node. Rounds are as many as turns that buckets of over ``LOCAL_IDS``
ids share. Other columns are ignored; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dovetail.llm import common

#: Turn ids that one task sorts at a time; ids of conversations that one row joins; turns in a chunk of a long chain.
LOCAL_IDS, MOST_JOINED, CHUNK_TURNS = 200_000, 1_000, 65_536
#: Nodes of a round that may be broadcast (some 60 bytes each).
MOST_NODES = 100_000
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, p1 long, p2 long"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
_LOW = (1 << 33) - 1  # of a row number: the row in its partition


def number_turns(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), digest (of role and text), bytes (of the text), n (turns of the conversation)."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", blank("role"), blank("text"))
    # equal rows may be many: a number of their own deals them to several ranges
    turns = turns.withColumn("own", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "role", "text", "own"]
    digest = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"))
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("digest"), F.octet_length("text").alias("bytes"))
    ordered = common.stash(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    task = F.shiftrightunsigned("at", 33)
    heads = ordered.groupBy("conv_id", task.alias("task")).agg(F.min("at").alias("first"), F.count("*").alias("k"))
    whole = Window.partitionBy("conv_id")
    so_far = F.sum("k").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
    heads = heads.select("conv_id", "task", "first", so_far.alias("before"), F.sum("k").over(whole).alias("n"))
    placed = ordered.withColumn("task", task).join(heads, ["conv_id", "task"])
    return placed.select("conv_id", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "digest", "bytes", "n")


def encode_turns(turns: DataFrame) -> DataFrame:
    """``turns`` with ``id``, the number of the distinct turn, in place of its digest."""
    known = turns.groupBy("digest").agg(F.count("*").alias("rows")).withColumn("id", F.monotonically_increasing_id())
    return common.spread_join(turns, common.stash(known, "dictionary"), ["digest"], ["conv_id", "pos"], "inner").drop("digest")


def share_openings(turns: DataFrame, group: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length) and turns (conv_id, pos, id, bytes) rebuilt: conversation c opens with the first h turns of conversation c - c % ``group``,
    h being its CRC-32 (of the decimal id) modulo ``most`` + 1, in place of its own first h. Remainders have the sign of c."""
    convs = turns.where("pos = 0").select("conv_id", "n")
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = convs.withColumn("base", base).withColumn("h", F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)))
    convs = convs.join(convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = common.stash(convs.withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))), "openings")
    own = common.spread_join(turns, convs.select("conv_id", "h", "m", F.col("n").alias("rows")), ["conv_id"], ["pos"], "inner").where("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "id", "bytes")
    opening = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "id", "bytes")
    taken = opening.join(convs.where("m > 0").select("conv_id", "base", "m"), "base").where("pos < m").select("conv_id", "pos", "id", "bytes")
    length = F.col("m") + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    return convs.select("conv_id", length.cast("long").alias("length")), common.stash(own.unionByName(taken), "rebuilt")


def ends_digests(members: DataFrame, most_joined: int = MOST_JOINED) -> DataFrame:
    """rep, sha: the SHA-256 of the decimal conv_ids of each class, ascending, comma-joined. ``members``: conv_id, rep, k (of the class)."""
    few = members.where(F.col("k") <= most_joined).groupBy("rep").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    few = few.select("rep", F.sha2(F.array_join(F.transform("ids", lambda c: c.cast("string")), ",").cast("binary"), 256).alias("sha"))
    many = members.where(F.col("k") > most_joined).select("rep", "conv_id")
    names, kinds = ["rep", "first", "ids"], [pa.int64(), pa.int64(), pa.string()]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.append(True, rep[1:] != rep[:-1])) if len(rep) else []
            rows = [(int(rep[a]), int(ids[a]), ",".join(map(str, ids[a:b].tolist()))) for a, b in zip(cuts, [*cuts[1:], len(rep)])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 3, kinds)], names=names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, sha = None, None
        done: list[tuple[int, str]] = []
        for batch in batches:
            for r, text in zip(batch.column(0).to_pylist(), batch.column(2)):
                if r != rep:
                    if sha:
                        done.append((rep, sha.hexdigest()))
                    rep, sha = r, hashlib.sha256(text.as_py().encode())
                else:
                    sha.update(b"," + text.as_py().encode())
        if sha:
            done.append((rep, sha.hexdigest()))
        columns = list(zip(*done)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["rep", "sha"])

    ranges = many.repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id")
    texts = common.map_arrow(ranges, chunks, "rep long, first long, ids string")
    return few.unionByName(common.map_arrow(texts.repartition("rep").sortWithinPartitions("rep", "first"), stream, "rep long, sha string"))


def classes(convs: DataFrame, turns: DataFrame, most_joined: int = MOST_JOINED) -> DataFrame:
    """conv_id (the smallest), n (conversations), length, sha (of the ids of all) of each distinct sequence of turns."""
    part = lambda *x: F.bit_xor(F.xxhash64(*x))
    prints = turns.groupBy("conv_id").agg(part("pos", "id").alias("s1"), part(F.lit(1), "id", "pos").alias("s2"))
    prints = convs.join(prints, "conv_id", "left").fillna(0, ["s1", "s2"])
    prints = common.stash(prints, "sequences")
    keys = ["s1", "s2", "length"]
    found = common.stash(prints.groupBy(*keys).agg(F.min("conv_id").alias("rep"), F.count("*").alias("rows")), "classes")
    members = common.spread_join(prints, found.select(*keys, "rep", F.col("rows").alias("k"), "rows"), keys, ["conv_id"], "inner")
    ends = ends_digests(common.stash(members.select("conv_id", "rep", "k"), "members"), most_joined)
    return found.select("rep", F.col("rows").alias("n"), "length").join(ends, "rep").withColumnRenamed("rep", "conv_id")


def _with_ids(seqs: DataFrame, turns: DataFrame, start: int, most: int) -> DataFrame:
    """``seqs`` with ids and sizes (bytes) of at most ``most`` turns from ``start`` on."""
    here = turns.where((F.col("pos") >= start) & (F.col("pos") < start + most))
    listed = here.join(seqs.select("conv_id"), "conv_id").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("t"))
    part = lambda f, kind: F.coalesce(F.transform("t", lambda x: x[f]), F.array().cast(f"array<{kind}>"))
    joined = seqs.join(listed, "conv_id", "left")
    return joined.select(*seqs.columns, F.lit(start).cast("long").alias("base"), part("id", "bigint").alias("ids"), part("bytes", "int").alias("sizes"))


def multikey_sort(order: np.ndarray, ranges: list[tuple[int, int, int]], digit) -> Iterator[tuple[int, int, int]]:
    """Multikey quicksort of ``order`` in place, from ranges (low, high, depth) on that share their first ``depth`` turns; emits (low, high, depth) of
    every deeper node with several rows. ``digit(rows, depth)``: their ids at that depth, -1 after the end."""
    stack = [r for r in ranges if r[1] - r[0] > 1]
    while stack:
        low, high, depth = stack.pop()
        rows = order[low:high]
        d = digit(rows, depth)
        a, b, c = d[0], d[len(d) // 2], d[-1]
        pivot = max(min(a, b), min(max(a, b), c))
        less, more = rows[d < pivot], rows[d > pivot]
        same = rows[d == pivot]
        order[low:high] = np.concatenate([less, same, more])
        mid, end = low + len(less), low + len(less) + len(same)
        if len(less) > 1:
            stack.append((low, mid, depth))
        if len(more) > 1:
            stack.append((end, high, depth))
        if len(same) > 1:
            yield mid, end, depth + 1
            stack.append((mid, end, depth + 1))


def local_nodes(bucket: np.ndarray, top: np.ndarray, conv: np.ndarray, n: np.ndarray, length: np.ndarray, base: np.ndarray, ids: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
    """All nodes of some whole buckets of distinct sequences: rows in the order of ``bucket``, each at depth ``top``; the ids of row i begin at
    ``first[i]``, that of depth ``base[i]``. ``parent`` is the place of a node's parent, -1 for the top of a bucket, whose row is ``row``; ``ender``
    is the row that ends at a node, or -1."""
    rows = len(bucket)
    order = np.arange(rows)

    def digit(some: np.ndarray, depth: int) -> np.ndarray:
        inside = length[some] > depth
        out = np.full(len(some), -1, np.int64)
        out[inside] = ids[first[some][inside] + depth - base[some][inside]]
        return out

    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    edges = np.append(heads, rows)
    ranges = [(int(a), int(b), int(top[a])) for a, b in zip(edges[:-1], edges[1:])]
    deep = top.copy()
    shared = list(ranges)
    for low, high, depth in multikey_sort(order, ranges, digit):
        shared.append((low, high, depth))
        deep[low:high] = np.maximum(deep[low:high], depth)
    conv, n, length, base, first = conv[order], n[order], length[order], base[order], first[order]
    chain = length - deep
    row = np.repeat(np.arange(rows), chain)
    step = np.arange(len(row)) - np.repeat(np.cumsum(chain) - chain, chain)
    s = np.array(shared, np.int64)
    low, high, depth = np.concatenate([s[:, 0], row]), np.concatenate([s[:, 1], row + 1]), np.concatenate([s[:, 2], deep[row] + 1 + step])
    least = np.concatenate([np.array([conv[a:b].min() for a, b, _ in shared], np.int64), conv[row]])
    is_top = np.zeros(len(low), bool)
    is_top[: len(ranges)] = True
    pre = np.lexsort((depth, low))
    low, high, depth, least, is_top = low[pre], high[pre], depth[pre], least[pre], is_top[pre]
    weight = np.cumsum(np.append(0, n))
    alone = np.zeros(rows, bool)
    alone[heads] = np.diff(edges) == 1
    leaf = np.cumsum(np.append(0, (deep < length) | alone))
    n_convs = weight[high] - weight[low]
    own = np.zeros(len(low), np.int64)
    some = depth > 0
    own[some] = (n_convs[some] - 1) * sizes[first[low[some]] + depth[some] - 1 - base[low[some]]]
    saved = np.cumsum(np.append(0, own))
    by_depth = np.lexsort((low, depth))
    key = depth[by_depth] * (rows + 1) + low[by_depth]
    place = lambda d, at: by_depth[np.searchsorted(key, d * (rows + 1) + at, "right") - 1]
    parent = np.where(is_top, -1, place(depth - 1, low))
    ender = np.full(len(low), -1, np.int64)
    ender[place(length, np.arange(rows))] = order
    return {
        "conv_id": least, "depth": depth, "n_convs": n_convs, "n_children": np.bincount(parent[parent >= 0], minlength=len(low)),
        "n_leaves": leaf[high] - leaf[low], "saved_tokens": saved[np.searchsorted(low, high, "left")] - saved[:-1], "parent": parent, "ender": ender, "row": order[low],
    }


def _local(buckets: DataFrame, partitions: int) -> DataFrame:
    """The nodes of all small buckets (k1, k2, p1, p2, top, and the columns of sequences)."""
    names = [c.split()[0] for c in _NODE.split(", ")]

    def nodes(table: pa.Table) -> pa.RecordBatch:
        from dovetail.llm import conversation_trie as c

        table = table.combine_chunks()
        col = lambda name: table.column(name).to_numpy()
        k1, k2 = col("k1"), col("k2")
        bucket = np.cumsum(np.append(0, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        lists = [table.column(x).combine_chunks() for x in ("ids", "sizes")]
        lists = [x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in lists]
        counts = np.diff(lists[0].offsets.to_numpy())
        first = np.cumsum(counts) - counts
        ids, sizes = (x.flatten().to_numpy().astype(np.int64) for x in lists)
        found = c.local_nodes(bucket, *(col(x) for x in ("top", "conv_id", "n", "length", "base")), ids, sizes, first)
        parent, ender, tops = found["parent"], found["ender"], found["parent"] < 0
        sha = table.column("sha").to_pylist()

        def of_tops(name: str) -> pa.Array:
            key = table.column(name)
            there = key.is_valid().to_numpy()[found["row"]] & tops
            return pa.array(key.fill_null(0).to_numpy()[found["row"]], pa.int64(), mask=~there)

        columns = [
            *(pa.array(found[x], pa.int64()) for x in ("conv_id", "depth")),
            pa.array(found["conv_id"][parent], pa.int64(), mask=tops),
            *(pa.array(found[x], pa.int64()) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
            pa.array([sha[r] if r >= 0 else _NO_ENDS for r in ender.tolist()], pa.string()),
            of_tops("p1"),
            of_tops("p2"),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size += batch.column(batch.schema.get_field_index("ids")).flatten().__len__() + batch.num_rows
            held.append(batch)
            if size < LOCAL_IDS:
                continue
            table = pa.Table.from_batches(held)
            k1, k2 = table.column("k1").to_numpy(), table.column("k2").to_numpy()
            heads = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            if len(heads):  # the last bucket may go on
                cut = int(heads[-1])
                yield nodes(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size = sum(len(b.column(b.schema.get_field_index("ids")).flatten()) + b.num_rows for b in held)
        if held:
            yield nodes(pa.Table.from_batches(held))

    columns = ["k1", "k2", "p1", "p2", "top", "conv_id", "n", "length", "base", "sha", "ids", "sizes"]
    dealt = buckets.select(*columns).repartition(partitions, "k1", "k2").sortWithinPartitions("k1", "k2")
    return common.map_arrow(dealt, run, _NODE)


def _chains(heads: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations that are alone from a node on (``heads``) and too long for one task."""
    mine = turns.join(heads.drop("bytes"), "conv_id").where(F.col("pos") + 1 >= F.col("depth")).withColumn("chunk", F.floor(F.col("pos") / CHUNK_TURNS))
    later = Window.partitionBy("conv_id").orderBy(F.col("chunk").desc())
    chunks = mine.groupBy("conv_id", "chunk").agg(F.sum("bytes").alias("of_chunk")).withColumn("below", F.sum("of_chunk").over(later) - F.col("of_chunk"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("pos").desc())
    placed = mine.join(chunks.drop("of_chunk"), ["conv_id", "chunk"]).withColumn("rest", F.sum("bytes").over(inside) + F.col("below"))
    at, first, last = F.col("pos") + 1, F.col("pos") + 1 == F.col("depth"), F.col("pos") + 1 == F.col("length")
    return placed.select(
        "conv_id",
        at.alias("depth"),
        F.when(~first, F.col("conv_id")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"),
        F.when(last, F.col("sha")).otherwise(_NO_ENDS).alias("ends_sha256"),
        F.when(first, F.col("p1")).alias("p1"),
        F.when(first, F.col("p2")).alias("p2"),
    )


def _few(nodes: DataFrame) -> DataFrame:
    return F.broadcast(nodes) if nodes.limit(MOST_NODES + 1).count() <= MOST_NODES else nodes


def trie(seqs: DataFrame, turns: DataFrame, local_ids: int = LOCAL_IDS) -> DataFrame:
    """All nodes, without p1 and p2, of the distinct sequences ``seqs`` (conv_id, n, length, sha) over ``turns`` (conv_id, pos, id, bytes)."""
    now = common.stash(_with_ids(seqs, turns, 0, 2 * local_ids), "bucket-rows")
    size = lambda depth: F.sum(F.col("length") - depth)
    ender = lambda depth: F.max(F.when(F.col("length") == depth, F.col("sha")))
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    root = now.agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), size(0).alias("rest"), F.count("*").alias("k"), ender(0).alias("sha"))
    root = root.where("k > 0").select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), "*", F.lit(0).alias("bytes"))
    root = common.stash(root, "root")
    stats = root.first()
    total = stats.rest if stats else 0
    now = now.select("*", zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"))
    partitions = max(8, min(8192, -(-int(total) // local_ids)))
    if total <= local_ids:
        return _local(now.withColumn("top", zero), 1).drop("p1", "p2")
    rounds, buckets, chains, depth, start = [root], [], [], 0, 0
    while True:
        if depth - start >= local_ids:  # the rows hold what any task may need from here on
            start = depth - 1
            now = common.stash(_with_ids(now.drop("base", "ids", "sizes"), turns, start, 2 * local_ids + 1), "bucket-rows")
        at = F.col("ids")[F.lit(depth) - F.col("base").cast("int")]
        cut = now.where(F.col("length") > depth).withColumn("bytes", F.col("sizes")[F.lit(depth) - F.col("base").cast("int")])
        cut = cut.withColumns({"p1": F.col("k1"), "p2": F.col("k2"), "k1": F.xxhash64("k1", at), "k2": F.xxhash64(F.lit(1), "k2", at)})
        depth += 1
        nodes = cut.groupBy("k1", "k2", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), size(depth - 1).alias("rest"), F.count("*").alias("k"), ender(depth).alias("sha"), F.min("bytes").alias("bytes"))
        large = common.stash(nodes.where(F.col("rest") > local_ids), "large-nodes")
        if large.isEmpty():
            buckets.append(cut.withColumn("top", F.lit(depth).cast("long")))
            break
        kinds = _few(large.select("k1", "k2", "k"))
        marked = cut.join(kinds, ["k1", "k2"], "left")
        buckets.append(marked.where("k is null").drop("k").withColumn("top", F.lit(depth).cast("long")))
        alone = marked.where("k = 1").select("conv_id", "n", "length", "sha", "bytes", "p1", "p2", F.lit(depth).cast("long").alias("depth"))
        chains.append(_chains(common.stash(alone, "alone"), turns))
        inner = large.where("k > 1")
        if inner.isEmpty():
            break
        rounds.append(inner)
        now = common.stash(marked.where("k > 1").drop("k", "bytes"), "bucket-rows")
    rows = buckets[0].drop("bytes")
    for more in buckets[1:]:
        rows = rows.unionByName(more.drop("bytes"))
    low = _local(rows, partitions)
    for more in chains:
        low = low.unionByName(more)
    low = common.stash(low, "low-nodes")
    keys = ["p1", "p2"]
    upward = [F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    of_tops = low.where("p1 is not null").groupBy(*keys).agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    of_tops = common.stash(of_tops, "of-tops")
    high, below = [], of_tops
    for level in reversed(range(len(rounds))):
        gathered = below.groupBy(*keys).agg(*upward).select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), "children", "leaves", "saved")
        own = (F.col("n_convs") - 1) * F.col("bytes") + F.col("saved")
        done = rounds[level].join(gathered, ["k1", "k2"]).select("k1", "k2", "p1", "p2", "conv_id", "n_convs", "sha", "children", "leaves", own.alias("saved"), F.lit(level).cast("long").alias("depth"))
        high.append(common.stash(done, "high-nodes"))
        below = of_tops.unionByName(high[-1].select("p1", "p2", F.lit(1).cast("long").alias("children"), "leaves", "saved"))
    upper = high[0]
    for more in high[1:]:
        upper = upper.unionByName(more)
    columns = [c.split()[0] for c in _NODE.split(", ")]
    upper = upper.select("conv_id", "depth", none.alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(_NO_ENDS)).alias("ends_sha256"), "p1", "p2", "k1", "k2")
    names = _few(upper.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent")))
    inner = low.where("p1 is null").select(*columns)
    tops = low.where("p1 is not null").unionByName(upper.drop("k1", "k2")).join(names, keys, "left").withColumn("parent_conv_id", F.col("parent")).select(*columns)
    return inner.unionByName(tops).drop("p1", "p2")


def conversation_trie(rows: DataFrame, local_ids: int = LOCAL_IDS, most_joined: int = MOST_JOINED) -> DataFrame:
    """The trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text): a row for each node."""
    turns = common.stash(encode_turns(common.stash(number_turns(rows), "numbered")), "turns")
    convs, rebuilt = share_openings(turns)
    seqs = common.stash(classes(convs, rebuilt, most_joined), "seqs")
    return trie(seqs, rebuilt, local_ids)
