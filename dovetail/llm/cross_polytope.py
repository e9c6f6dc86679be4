"""Approximate nearest neighbours by cross-polytope hashing, for the largest inner product.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) takes a unit vector to its nearest signed
axis: its bucket, in each of ``tables`` tables. A query looks into the ``probes`` buckets whose signed axes are nearest to it,
and all candidates of a bucket are ranked exactly against all queries that look into it, as a product of blocks. Queries that find fewer than
``k`` although there are more candidates look into all buckets of a table, which is exact. Equal
vectors are one class that keeps its ``k + 1`` smallest ids, which is all that a list of ``k`` can need. Buckets are cut
into blocks of bounded rows, by counted sizes, and so are their queries; no candidate is left out. A vector is one row and held whole: it is
padded to the next power of two components, and blocks hold ``BLOCK_ROWS`` of them, so they are meant for some thousands of components at most.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a null id. Rows
repeated with id and vector count once. Only vectors of the same number of components meet. Score ties go to the smaller
id. Other columns are ignored; an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dovetail.llm import common

#: Rows of a bucket, and of the queries that look into it, in one block.
BLOCK_ROWS, BLOCK_QUERIES = 8192, 2048


def rotate(x: np.ndarray, table: int, seed: int = 7) -> np.ndarray:
    """Rows of ``x`` under the pseudo-rotation of ``table``, padded to a power of two."""
    n, d = x.shape
    size = 1 << max(0, (d - 1).bit_length())
    y = np.zeros((n, size))
    y[:, :d] = x
    signs = np.random.default_rng([seed, table, size]).integers(0, 2, (3, size)) * 2.0 - 1.0
    for row in signs:
        y *= row
        half = 1
        while half < size:
            z = y.reshape(n, size // (2 * half), 2, half)
            y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(n, size)
            half *= 2
        y /= np.sqrt(size)
    return y


def nearest_axes(x: np.ndarray, table: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes of each row, nearest first; axis j is 2j, its opposite 2j + 1."""
    y = rotate(x, table)
    signed = np.stack([y, -y], 2).reshape(len(x), -1)
    count = min(count, signed.shape[1])
    if count == 1:
        return signed.argmax(1)[:, None]
    some = np.argpartition(-signed, count - 1, axis=1)[:, :count]
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(signed, some, 1), 1, kind="stable"), 1)


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _axes(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """``rows`` (c1, c2, vec, dim) once for each table and each of the nearest axes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.cross_polytope import _matrix, nearest_axes

        for batch in batches:
            names = batch.schema.names
            dims = batch.column(names.index("dim")).to_numpy()
            for dim in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                x = _matrix(part.column(names.index("vec")))
                x = x / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(1, keepdims=True)
                for table in range(tables):
                    axes = nearest_axes(x, table, probes)
                    out = part.take(pa.array(np.repeat(np.arange(len(x)), axes.shape[1])))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(out.num_rows, table, np.int32)), pa.array(axes.ravel().astype(np.int32))], names=[*names, "tab", "axis"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return common.map_arrow(rows, run, f"{kinds}, tab int, axis int")


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    _, first = np.unique(ids, return_index=True)
    first = np.sort(first)[:k]
    return ids[first], scores[first]


_FOUND = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])


def search(vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 6, probes: int = 28) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` (vec_id, embedding) with ``is_query``, the ``k`` nearest found of all others."""
    common.ship(vectors.sparkSession)
    rows = vectors.where(F.col("vec_id").isNotNull() & _valid(F.col("embedding"))).select("vec_id", F.col("embedding").alias("vec"), is_query.alias("asks"))
    keyed = rows.select("vec_id", "vec", "asks", F.size("vec").alias("dim"), F.xxhash64("vec").alias("c1"), F.xxhash64(F.lit(1), "vec").alias("c2"))
    smallest = keyed.withColumn("r", F.dense_rank().over(Window.partitionBy("c1", "c2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    classes = smallest.groupBy("c1", "c2", "dim").agg(F.first("vec").alias("vec"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    index = common.stash(_axes(classes.select("c1", "c2", "dim", "vec", "ids"), tables, 1), "index")
    asking = keyed.where("asks").select("vec_id", "c1", "c2", "dim", "vec")
    classes_asking = common.stash(asking.groupBy("c1", "c2", "dim").agg(F.first("vec").alias("vec")), "asking")
    found = common.stash(_look(index, _axes(classes_asking, tables, probes), k), "found")
    known = common.stash(classes.groupBy("dim").agg(F.least(F.sum(F.size("ids")), F.lit(k + 1)).alias("most")), "known")
    short = classes_asking.join(known, "dim").join(found.select("c1", "c2", F.size("ids").alias("n")), ["c1", "c2"], "left").where(F.coalesce("n", F.lit(0)) < F.col("most")).select("c1", "c2", "dim", "vec")
    short = common.stash(short, "short")
    if not short.isEmpty():
        again = _look(index.where("tab = 0"), _axes(short, 1, 1 << 30), k)
        found = found.join(short, ["c1", "c2"], "left_anti").unionByName(again)
    pairs = asking.select(F.col("vec_id").alias("query_id"), "c1", "c2").distinct().join(found, ["c1", "c2"])
    others = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda x: x["ids"] != F.col("query_id")), 1, k)
    ranked = pairs.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))


def _look(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """c1, c2, ids, scores: the ``k + 1`` best of all classes in the buckets that each query class of ``probes`` looks into."""
    asks = common.stash(probes, "probes")
    bucket = ["dim", "tab", "axis"]
    blocks = index.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("subs"))
    chunks = asks.groupBy(*bucket).agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("chunks"))
    sizes = common.stash(blocks.join(chunks, bucket), "bucket-sizes")  # two rows for each component, table and number of components
    zero = F.lit(0).cast("bigint")
    left = index.join(sizes, bucket).withColumns({"sub": F.pmod(F.xxhash64("c1"), F.col("subs")), "chunk": F.explode(F.sequence(zero, F.col("chunks") - 1))})
    right = asks.join(sizes, bucket).withColumns({"chunk": F.pmod(F.xxhash64("c2"), F.col("chunks")), "sub": F.explode(F.sequence(zero, F.col("subs") - 1))})
    keys = [*bucket, "sub", "chunk"]

    def rank(have: pa.Table, want: pa.Table) -> pa.Table:
        from dovetail.llm.cross_polytope import _FOUND, _matrix, _top

        if not have.num_rows or not want.num_rows:
            return _FOUND.empty_table()
        x, q = _matrix(have.column("vec")), _matrix(want.column("vec"))
        lists = have.column("ids").to_pylist()
        sizes = np.array([len(i) for i in lists])
        most = min(len(x), k + 1)
        # twice the rounding of a product, which is at most components x epsilon x both lengths, each way
        lengths = np.sqrt((q * q).sum(1))
        margin = 4 * (x.shape[1] + 2) * np.finfo(np.float64).eps * np.sqrt((x * x).sum(1).max())
        out_ids, out_scores = [], []
        for a in range(0, len(q), 256):
            near = q[a : a + 256] @ x.T
            # all that rounding could put at or above the last place that counts, so that ties are told apart by their ids
            cut = np.partition(near, len(x) - most, axis=1)[:, len(x) - most] - margin * lengths[a : a + 256]
            for row, about, least in zip(q[a : a + 256], near, cut):
                chosen = np.flatnonzero(about >= least)
                exact = (x[chosen] * row).sum(1)  # the same sum in whatever block
                ids = np.array([i for c in chosen for i in lists[c]])
                ids, scores = _top(ids, np.repeat(exact, sizes[chosen]), k + 1)
                out_ids.append(ids.tolist())
                out_scores.append(scores.tolist())
        return pa.table([want.column("c1"), want.column("c2"), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))], schema=_FOUND)

    here = left.select(*keys, "vec", "ids").groupBy(*keys).cogroup(right.select(*keys, "c1", "c2", "vec").groupBy(*keys))
    found = here.applyInArrow(rank, "q1 long, q2 long, ids array<long>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.cross_polytope import _FOUND, _top
        from dovetail.llm.ngram_join import _groups

        out = []
        for (q1, q2), held in _groups(batches, 2):
            ids, scores = (np.concatenate([np.array(r[i], t) for r in held]) for i, t in ((0, np.int64), (1, np.float64)))
            ids, scores = _top(ids, scores, k + 1)
            out.append((q1, q2, ids.tolist(), scores.tolist()))
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)

    return common.map_arrow(found.repartition("q1", "q2").sortWithinPartitions("q1", "q2"), merge, "c1 long, c2 long, ids array<long>, scores array<double>")
