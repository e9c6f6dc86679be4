"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Documents are cut into pieces of at most ``capacity`` tokens. Only the histogram of the piece lengths (``capacity``
numbers, whatever the corpus) reaches the driver. There, patterns of a few lengths that fill a sequence exactly get
repeat counts by non-negative least squares, rounded within what the histogram has; what remains is packed best
fit, longest first. The plan says for each length which ranks go to which sequences at which offset; pieces are
ranked within their length in groups of bounded size, and look their place up.

Null and empty texts make one piece of the end id. Repeated rows are packed as often as they stand. Null ids stay
null. Other columns are ignored, and an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dovetail.llm import common

#: Rows of a length that are ranked together, on average.
GROUP_ROWS = 512
_PIECES = ("doc_id", "piece", "start", "length", "ids_crc32")


def patterns(capacity: int) -> np.ndarray:
    """Rows of up to four lengths (0: none) that add up to ``capacity``: all pairs, and triples and quadruples around each length."""
    found = set()
    for a in range(1, capacity // 2 + 1):
        found.add((0, 0, a, capacity - a))
    for a in range(1, capacity - 1):
        rest = capacity - a
        for share in (0.2, 0.3, 0.4, 0.5):
            b = int(rest * share)
            if b and rest - b > 0:
                found.add((0, *sorted((a, b, rest - b))))
        b = rest // 3
        if b and rest - 2 * b > 0:
            found.add(tuple(sorted((a, b, b, rest - 2 * b))))
    return np.array(sorted(found), dtype=np.int64).reshape(-1, 4)


def nonnegative_fit(rows: np.ndarray, target: np.ndarray, steps: int = 300) -> np.ndarray:
    """x >= 0 that minimises the squared distance of the lengths used by x times each pattern from ``target``.

    Accelerated projected gradient; the patterns are kept as index lists, so a step costs their number only.
    """
    size = len(target)
    used = lambda x: np.bincount(rows.ravel(), np.repeat(x, rows.shape[1]), size)
    wanted = target.astype(float)
    wanted[0] = 0
    scale = np.zeros(size)
    np.add.at(scale, rows.ravel(), 1.0)
    scale[0] = 0
    bound = 16.0 * max(1.0, np.sqrt(scale.max()))
    # the largest eigenvalue, by the power method
    v = np.random.default_rng(0).random(len(rows))
    for _ in range(20):
        u = used(v)
        u[0] = 0
        v = u[rows].sum(1)
        bound = np.linalg.norm(v) or 1.0
        v /= bound
    x = y = np.zeros(len(rows))
    t = 1.0
    for _ in range(steps):
        gap = used(y) - wanted
        gap[0] = 0
        new = np.maximum(0, y - gap[rows].sum(1) / (1.05 * bound))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan(histogram: np.ndarray, capacity: int) -> tuple[np.ndarray, int, int]:
    """Where each rank of each length goes: rows (length, first rank, ranks, first sequence, offset), the sequences, and those from patterns.

    ``histogram[k]``: how many pieces have length k, from 0 to ``capacity``.
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def take(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, int(taken[length]), n, sequence, offset))
        taken[length] += n
        left[length] -= n

    if left[capacity]:
        n = int(left[capacity])
        take(capacity, n, 0, 0)
        sequences = n
    if left.sum():
        rows = patterns(capacity)
        rows = rows[(left[rows] > 0).all(1, where=rows > 0)]
        times = np.rint(nonnegative_fit(rows, left)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        for k in np.argsort(-times, kind="stable"):
            if times[k] == 0:
                break
            need = np.unique(rows[k][rows[k] > 0], return_counts=True)
            n = int(min(times[k], *(left[need[0]] // need[1])))
            if n > 0:
                offset = 0
                for length in rows[k][::-1]:
                    if length:
                        take(int(length), n, sequences, offset)
                        offset += int(length)
                sequences += n
    by_pattern = sequences
    # the rest, longest first, each into the least space that holds it; equal spaces are handled as runs of sequences
    space: dict[int, deque] = defaultdict(deque)
    open_at = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = np.flatnonzero(open_at[length:])
            if len(fits):
                room = length + int(fits[0])
                first, count = space[room].popleft()
                open_at[room] = bool(space[room])
            else:
                room, first, count = capacity, sequences, -(-int(left[length]) // (capacity // length))
                sequences += count
            each = room // length
            n = min(count, max(1, int(left[length]) // each))
            each = min(each, int(left[length]) // n)
            for j in range(each):
                take(length, n, first, capacity - room + j * length)
            if n < count:
                space[room].appendleft((first + n, count - n))
                open_at[room] = True
            if room - each * length:
                space[room - each * length].append((first, n))
                open_at[room - each * length] = True
    return np.array(runs, dtype=np.int64).reshape(-1, 5), sequences, by_pattern


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of ``docs`` (doc_id, text)."""
    width = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm.encoding import worker_encoder

        encode, end = worker_encoder(tokenizer).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=list(_PIECES))

    return common.map_arrow(docs.select("doc_id", "text"), cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset. Read several times, so pass a table that is stored."""
    spark = pieces.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # a row for each length: capacity at most
        histogram[r["length"]] = r["count"]
    runs, _, _ = plan(histogram, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    groups = F.array(*[F.lit(int(max(1, -(-n // GROUP_ROWS)))) for n in histogram])
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(groups, (F.col("length") + 1).cast("int"))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(base, ["length", "salt"]).select(*_PIECES, (F.col("rank") + F.col("base")).alias("rank"))
    # the plan's size is bounded by the capacity, not by the corpus
    held = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_rows = held.value
        stride = 1 << 40
        keys = plan_rows[:, 0] * stride + plan_rows[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            k = np.searchsorted(keys, length * stride + rank, "right") - 1
            found = plan_rows[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(found[:, 3] + rank - found[:, 1]), pa.array(found[:, 4])], names=[*_PIECES, "sequence_id", "offset"])

    return common.map_arrow(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
