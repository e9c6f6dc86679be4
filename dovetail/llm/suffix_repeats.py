"""Substring dedup by enhanced suffix arrays: maximal repeats of ``least`` bytes or more from the tree of common-prefix intervals.

1. A window is a string of ``least`` bytes of one document. Its key is the smallest hash of the strings of ``GRAM`` bytes in it, so equal
   windows have equal keys wherever they stand. Windows in a row with one key make a span, of ``RUN`` windows at most.
2. The keys of all spans travel as packed 32-bit prints, one row for each slice of text and part of the hash space; a part tells
   which of its keys stand more than once. The other spans, most of them, hold nothing that repeats and go no further.
3. The bytes of the spans left meet by key. Equal spans are one, with all their places. The suffixes that begin with a window seen in
   several spans are sorted, with the lengths of the prefixes they share with the one before. A stack-scan over these lengths gives the
   tree of common-prefix intervals of ``least`` bytes or more; those whose occurrences differ in the byte to the left (or stand at the
   start of a span) are the maximal repeats, each with all its occurrences, not only neighbours.
4. What a repeat covers in documents with a larger ``doc_id`` than its smallest goes. A window lies in the maximal repeat that has
   the same occurrences, so this is every byte covered by a window that also starts in a document with a smaller ``doc_id``.

A repeat longer than a span comes as overlapping pieces, one for each span, each with all occurrences of that piece. Keys that more than
``HOT`` spans share (a phrase that many documents use) are not gathered in one place: equal spans are grouped by a 128-bit digest before
they travel, the windows of what is left by another, and all places meet them again over salts; each window that repeats is a
repeat of ``least`` bytes. Everything else is compared byte by byte.

A null id counts as the smallest. Rows of one id do not remove each other's bytes. Null texts are empty; texts shorter than ``least``
bytes stay. Repeated rows get equal results, told apart by doc_id and a 64-bit hash of the text. A very long text is hashed in one piece, at
some 90 bytes a byte. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dovetail.llm import common

LEAST, GRAM, RUN, HOT = 50, 20, 32, 20_000
#: Bytes and rows of text that are hashed together; keys in a part of the hash space, and spans in a part, on average.
SLICE_BYTES, SLICE_ROWS, PART_KEYS, PART_SPANS = 1_000_000, 20_000, 2_000_000, 60_000
#: Partitions of a shuffle at most; parts beyond that follow one another in a partition.
MOST_PARTITIONS = 8192
_FIRST = np.iinfo(np.int64).min
_U = np.uint64
_OTHER = 0xC2B2AE3D27D4EB4F


def _slices(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[list[tuple], list[bytes]]]:
    """The first ``columns`` columns of rows, and the bytes of their texts, the column after; some ``SLICE_BYTES`` at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        keys = zip(*(batch.column(i).to_pylist() for i in range(columns)))
        for key, text in zip(keys, batch.column(columns)):
            raw = text.as_py()
            raw = b"" if raw is None else raw if isinstance(raw, bytes) else raw.encode("utf-8", "surrogatepass")
            rows.append(key)
            texts.append(raw)
            size += len(raw)
            if size >= SLICE_BYTES or len(rows) >= SLICE_ROWS:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


class Spans:
    """The spans of some texts: ``text`` they are in, ``start`` in it, ``size`` in bytes, and ``key``. ``data`` is all texts, ``base`` where each begins."""

    def __init__(self, texts: list[bytes], least: int):
        from dovetail.llm.shingles import mix, powers, prefix_sums

        gram = min(GRAM, least)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.base = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data) - least + 1
        if n < 1:
            self.text = self.start = self.size = np.zeros(0, np.int64)
            self.key = np.zeros(0, np.uint64)
            return
        sums = prefix_sums(self.data.astype(np.uint64) + _U(1))
        with np.errstate(over="ignore"):
            hashes = mix((sums[gram:] - sums[:-gram]) * powers(len(sums))[1][: len(sums) - gram])
        del sums
        width, have = least - gram + 1, 1
        while have * 2 <= width:
            hashes = np.minimum(hashes[:-have], hashes[have:])
            have *= 2
        if width > have:
            hashes = np.minimum(hashes[: len(hashes) - (width - have)], hashes[width - have :])
        text = np.repeat(np.arange(len(texts)), sizes)
        whole = text[:n] == text[least - 1 :]
        new = np.ones(n, bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:n] != text[: n - 1])
        new[1:] |= whole[1:] != whole[:-1]
        first = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        cut = np.flatnonzero((place % RUN == 0) & whole)
        ends = np.flatnonzero(np.append((place[1:] % RUN == 0) | ~whole[1:], True) & whole) + 1
        self.text = text[cut]
        self.start = cut - self.base[self.text]
        self.size = ends - cut + least - 1
        self.key = mix(hashes[cut])


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> _U(33)) % _U(parts)).astype(np.int64)


def _steps(at: np.ndarray) -> bytes:
    """Ascending numbers as differences, in two bytes each where they fit."""
    steps = np.diff(at, prepend=0)
    return steps.astype("<u2" if steps.max() <= 0xFFFF else "<u4").tobytes()


def _from_steps(raw: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64))


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of batches that are sorted by their first column, group by group."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != key:
                if held:
                    yield key, held
                key, held = row[0], []
            held.append(row[1:])
    if held:
        yield key, held


def _prints(docs: DataFrame, least: int, parts: int) -> DataFrame:
    """Packed prints: a row for each slice and part, with the ordinals of its spans in the slice (as steps); and a row for each slice that says
    what its rows are, which any part passes on."""
    names = ["part", "slice", "print", "at", "doc_id", "th", "spans"]
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), longs, longs, longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from dovetail.llm import suffix_repeats as s

        task = TaskContext.get().partitionId() << 32
        for number, (keys, texts) in enumerate(s._slices(batches, 2)):
            spans = s.Spans(texts, least)
            if not len(spans.key):
                continue
            counts = np.bincount(spans.text, minlength=len(texts))
            mine = np.flatnonzero(counts)
            rows = [(number % parts, task + number, None, None, [keys[i][0] for i in mine], [keys[i][1] for i in mine], counts[mine].tolist())]
            part = s._part(spans.key, parts)
            order = np.argsort(part, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(part[order]) > 0)), len(order))
            print_ = spans.key.astype(np.uint32)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                at = order[a:b]
                rows.append((int(part[at[0]]), task + number, print_[at].astype("<u4").tobytes(), s._steps(at), None, None, None))
                if len(rows) == 64:
                    yield s._batch(names, kinds, rows)
                    rows = []
            if rows:
                yield s._batch(names, kinds, rows)

    schema = "part long, slice long, print binary, at binary, doc_id array<long>, th array<long>, spans array<long>"
    return common.map_arrow(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), run, schema)


def _repeated_keys(prints: DataFrame, partitions: int, hot: int) -> DataFrame:
    """slice, at, often: the ordinals of spans whose key stands more than once, and which of them do over ``hot`` times; and the rows of part -1."""
    names = ["slice", "kind", "at", "often", "doc_id", "th", "spans"]
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), longs, longs, longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm import suffix_repeats as s

        for _, rows in s._groups(batches):
            about = [(r[0], 0, None, None, *r[3:]) for r in rows if r[1] is None]
            if about:
                yield s._batch(names, kinds, about)
            rows = [r for r in rows if r[1] is not None]
            if not rows:
                continue
            print_ = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
            order = np.argsort(print_)
            sorted_ = print_[order]
            heads = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
            sizes = np.diff(np.append(heads, len(sorted_)))
            count = np.empty(len(print_), np.int64)
            count[order] = np.repeat(sizes, sizes)
            del order, sorted_, print_
            out, begin = [], 0
            for slice_, packed, at, *_ in rows:
                mine = count[begin : begin + len(packed) // 4]
                begin += len(mine)
                which = np.flatnonzero(mine > 1)
                if len(which):
                    out.append((slice_, 1, s._from_steps(at, len(mine))[which].astype("<u4").tobytes(), (mine[which] > hot).tobytes(), None, None, None))
                if len(out) == 64:
                    yield s._batch(names, kinds, out)
                    out = []
            if out:
                yield s._batch(names, kinds, out)

    schema = "slice long, kind int, at binary, often binary, doc_id array<long>, th array<long>, spans array<long>"
    dealt = prints.repartition(partitions, "part").sortWithinPartitions("part")
    return common.map_arrow(dealt, run, schema)


def _marked(repeated: DataFrame, partitions: int) -> DataFrame:
    """doc_id, th, at (ordinals of the document's spans that go on), often (which of them have a hot key), hot (whether any does)."""
    names = ["doc_id", "th", "at", "often", "hot"]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm import suffix_repeats as s

        for _, rows in s._groups(batches):
            (ids, th, spans), rest = rows[0][3:], rows[1:]
            if not rest:
                continue
            at = np.concatenate([np.frombuffer(r[1], "<u4") for r in rest])
            order = np.argsort(at)
            at, often = at[order].astype(np.int64), np.concatenate([np.frombuffer(r[2], bool) for r in rest])[order]
            edge = np.cumsum([0, *spans])
            cuts = np.searchsorted(at, edge)
            out = []
            for i in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[i], cuts[i + 1]
                out.append((ids[i], th[i], (at[a:b] - edge[i]).astype("<u4").tobytes(), often[a:b].tobytes(), bool(often[a:b].any())))
            yield s._batch(names, kinds, out)

    dealt = repeated.repartition(partitions, "slice").sortWithinPartitions("slice", "kind")
    return common.map_arrow(dealt, run, "doc_id long, th long, at binary, often binary, hot boolean").dropDuplicates(["doc_id", "th"])


def _digests(spans: Spans, p: np.ndarray, least: int) -> tuple[np.ndarray, list[bytes | None]]:
    """128-bit digests of the spans ``p``, and of the windows of the first of equal ones."""
    from dovetail.llm.shingles import mix, prefix_sums, span_hashes

    bytes_ = spans.data.astype(np.uint64) + _U(1)
    one, two = prefix_sums(bytes_), prefix_sums(mix(bytes_), _OTHER)
    digest = lambda a, b: np.stack([span_hashes(one, a, b), span_hashes(two, a, b, _OTHER)], 1).astype("<u8")
    begin = spans.base[spans.text[p]] + spans.start[p]
    whole = digest(begin, begin + spans.size[p])
    windows: list[bytes | None] = [None] * len(p)
    for i in np.unique(whole[:, 0], return_index=True)[1].tolist():
        at = begin[i] + np.arange(spans.size[p[i]] - least + 1)
        windows[i] = digest(at, at + least).tobytes()
    return whole, windows


def _span_bytes(texts: DataFrame, least: int, parts: int) -> DataFrame:
    """Packed spans: a row for each slice and part with its documents, and in ``idx`` the document of each span. Those with a hot key are one row
    of any part, with digests in place of their bytes, and in ``windows`` the digests of the windows of the first of equal ones."""
    names = ["part", "doc_id", "th", "idx", "start", "size", "bytes", "windows"]
    longs = pa.list_(pa.int64())
    kinds = [pa.int64(), longs, longs, *[pa.binary()] * 4, pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm import suffix_repeats as s

        for number, (keys, texts) in enumerate(s._slices(batches, 4)):
            spans = s.Spans(texts, least)
            first = np.searchsorted(spans.text, np.arange(len(texts)))
            marked_ = np.concatenate([np.frombuffer(k[2], "<u4").astype(np.int64) + first[i] for i, k in enumerate(keys)])
            hot = np.concatenate([np.frombuffer(k[3], bool) for k in keys])
            packed = lambda p: [[keys[i][c] for i in np.unique(spans.text[p])] for c in (0, 1)]
            if hot.any():
                p = marked_[hot]
                idx = np.unique(spans.text[p], return_inverse=True)[1]
                digests, windows = s._digests(spans, p, least)
                small = (idx.astype("<u4").tobytes(), spans.start[p].astype("<u4").tobytes(), spans.size[p].astype("<u2").tobytes())
                yield s._batch(names, kinds, [(number % parts, *packed(p), *small, digests.tobytes(), windows)])
            picked = marked_[~hot]
            part = s._part(spans.key[picked], parts)
            picked = picked[np.lexsort((spans.key[picked], part))]
            part = s._part(spans.key[picked], parts)
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else [0]
            rows = []
            for a, b in zip(edges[:-1], edges[1:]):
                mine = picked[a:b]
                idx = np.unique(spans.text[mine], return_inverse=True)[1]
                size = spans.size[mine]
                from_ = spans.base[spans.text[mine]] + spans.start[mine]
                at = np.repeat(from_ - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rows.append((int(part[a]), *packed(mine), idx.astype("<u4").tobytes(), spans.start[mine].astype("<u4").tobytes(), size.astype("<u2").tobytes(), pa.compress(spans.data[at].tobytes(), "zstd", asbytes=True), None))
                if len(rows) == 64:
                    yield s._batch(names, kinds, rows)
                    rows = []
            if rows:
                yield s._batch(names, kinds, rows)

    return common.map_arrow(texts.select("doc_id", "th", "at", "often", "text"), run, "part long, doc_id array<long>, th array<long>, idx binary, start binary, size binary, bytes binary, windows array<binary>")


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """Stack-scan: (length, first, last) of every interval of common prefixes of ``least`` or more; ``lcp[i]`` is shared by suffixes i - 1 and i."""
    stack: list[tuple[int, int]] = []
    for i, shared in enumerate([*lcp, 0]):
        first = i - 1
        while stack and stack[-1][0] > shared:
            length, first = stack.pop()
            yield length, first, i - 1
        if shared >= least and (not stack or stack[-1][0] < shared):
            stack.append((shared, first))


class Repeats:
    """The maximal repeats among distinct spans (``data`` one after the other, ``size`` of each): ``length``, and suffixes ``low`` to before ``high``,
    which stand at ``offset`` of span ``span``."""

    def __init__(self, data: np.ndarray, size: np.ndarray, least: int):
        from dovetail.llm.shingles import mix, powers, prefix_sums

        base = np.cumsum(size) - size
        windows = size - least + 1
        span = np.repeat(np.arange(len(size)), windows)
        offset = np.arange(len(span)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = base[span] + offset
        sums = prefix_sums(data.astype(np.uint64) + _U(1))
        with np.errstate(over="ignore"):
            hashes = mix((sums[at + least] - sums[at]) * powers(len(sums))[1][at])
        del sums
        order = np.argsort(hashes)
        twin = np.append(False, hashes[order[1:]] == hashes[order[:-1]])
        twin[:-1] |= twin[1:]
        keep = order[twin]
        hashes, span, at, offset = hashes[keep], span[keep], at[keep], offset[keep]
        left = (base[span] + size[span] - at).astype(np.int64)  # bytes up to the span's end
        padded = np.append(data, np.zeros(least + RUN + 8, np.uint8))
        words = lambda k, n: np.stack([padded[at + k + j] for j in range(n)], 1)
        tail = words(least, RUN)  # no more bytes than that follow a window in its span
        tail[np.arange(RUN) >= (left - least)[:, None]] = 0  # what follows the span is not of it: zeros, then the shorter first, is the order of suffixes
        order = np.lexsort((left, *tail.view(">u8").astype(np.uint64).T[::-1], hashes))
        head = words(0, least)
        same = (head[order[1:]] == head[order[:-1]]).all(1) | (hashes[order[1:]] != hashes[order[:-1]])
        if not same.all():  # two windows of one hash: sort by all bytes
            order = np.lexsort((left, *tail.T[::-1], *head.T[::-1]))
        self.span, self.offset = span[order], offset[order]
        left, tail, head = left[order], tail[order], head[order]
        n = len(order)
        lcp = np.zeros(n, np.int64)
        if n > 1:
            unlike = np.ones((n - 1, RUN + 1), bool)
            np.not_equal(tail[1:], tail[:-1], out=unlike[:, :RUN])
            shared = np.minimum(least + unlike.argmax(1), np.minimum(left[1:], left[:-1]))
            lcp[1:] = np.where((head[1:] == head[:-1]).all(1), shared, 0)
        before = np.where(self.offset > 0, padded[at[order] - 1].astype(np.int64), -1)
        # intervals of two suffixes are read off; the stack-scan takes those of more
        classes = np.flatnonzero(np.append(True, lcp[1:] < least)) if n else np.zeros(0, np.int64)
        counts = np.diff(np.append(classes, n))
        pair = classes[counts == 2]
        length, low, high = [lcp[pair + 1]], [pair], [pair + 2]
        several = np.repeat(counts > 2, counts)
        if several.any():
            where = np.flatnonzero(several)
            found = np.array(list(intervals(lcp[where].tolist(), least)), np.int64).reshape(-1, 3)
            length.append(found[:, 0])
            low.append(where[found[:, 1]])
            high.append(where[found[:, 2]] + 1)
        self.length, self.low, self.high = (np.concatenate(x) for x in (length, low, high))
        changes = np.cumsum(np.append(0, (before[1:] != before[:-1]) if n else []))
        starts = np.cumsum(np.append(0, before < 0))
        diverse = (changes[self.high - 1] > changes[self.low]) | (starts[self.high] > starts[self.low])
        self.length, self.low, self.high = self.length[diverse], self.low[diverse], self.high[diverse]


class Part:
    """The spans of one part of the hash space: distinct ones, with their ``places`` (doc_id, th, start), and the repeats among them."""

    def __init__(self, rows: list[tuple], least: int):
        owner, th, start, seen, which = [], [], [], {}, []
        for ids, hashes, idx, from_, size, raw, _ in rows:
            i = np.frombuffer(idx, "<u4")
            owner.append(np.array([_FIRST if d is None else d for d in ids], np.int64)[i])
            th.append(np.array(hashes, np.int64)[i])
            start.append(np.frombuffer(from_, "<u4").astype(np.int64))
            at, size = 0, np.frombuffer(size, "<u2")
            raw = pa.decompress(raw, int(size.sum(dtype=np.int64)), "zstd", asbytes=True)
            for n in size.tolist():
                which.append(seen.setdefault(raw[at : at + n], len(seen)))
                at += n
        self.owner, self.th, self.start, self.which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, th, start, [np.array(which, np.int64)]))
        self.size = np.array([len(s) for s in seen], np.int64)
        self.data = np.frombuffer(b"".join(seen), np.uint8)
        self.least_owner = np.full(len(seen), np.iinfo(np.int64).max)
        np.minimum.at(self.least_owner, self.which, self.owner)
        self.repeats = Repeats(self.data, self.size, least)

    def removed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """owner, th, start and end (in the document) of what goes."""
        r, n = self.repeats, len(self.size)
        base = np.cumsum(self.size) - self.size
        marks = np.zeros(len(self.data) + n + 1, np.int32)  # each span has a place after its end
        if len(r.length):
            owners = self.least_owner[r.span]
            total = np.cumsum(r.high - r.low)
            cuts = np.unique(np.searchsorted(total, np.arange(0, total[-1] + 1_000_000, 1_000_000)))
            for x, y in zip(cuts, np.append(cuts[1:], len(total))):  # a bounded number of occurrences at a time
                low, counts = r.low[x:y], (r.high - r.low)[x:y]
                heads = np.cumsum(counts) - counts
                member = np.repeat(low - heads, counts) + np.arange(counts.sum())
                if not len(member):
                    continue
                first = np.repeat(np.minimum.reduceat(owners[member], heads), counts)
                later = np.flatnonzero(owners[member] > first)
                m, length = member[later], np.repeat(r.length[x:y], counts)[later]
                at = base[r.span[m]] + r.span[m] + r.offset[m]
                np.add.at(marks, at, 1)
                np.add.at(marks, at + length, -1)
        goes = np.cumsum(marks) > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[0], goes.astype(np.int8), [0]])))
        a, b = edge[0::2], edge[1::2]
        wide = base + np.arange(n)
        run_span = np.searchsorted(wide, a, "right") - 1
        first_run = np.searchsorted(run_span, np.arange(n + 1))
        own = self.owner == self.least_owner[self.which]
        whole = np.flatnonzero(~own)
        mine = np.flatnonzero(own)
        k = (first_run[self.which[mine] + 1] - first_run[self.which[mine]]).astype(np.int64)
        place = np.repeat(mine, k)
        run = np.repeat(first_run[self.which[mine]] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        shift = self.start[place] - wide[self.which[place]]
        return (
            np.concatenate([self.owner[whole], self.owner[place]]),
            np.concatenate([self.th[whole], self.th[place]]),
            np.concatenate([self.start[whole], a[run] + shift]),
            np.concatenate([self.start[whole] + self.size[self.which[whole]], b[run] + shift]),
        )

    def groups(self, part: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """number, length and the owner, th, start of all occurrences of each repeat; a span that stands more than once is one."""
        order = np.argsort(self.which, kind="stable")
        first = np.searchsorted(self.which[order], np.arange(len(self.size) + 1))
        r, number = self.repeats, part << 32
        for low, high, length in zip(r.low, r.high, r.length):
            places = np.concatenate([order[first[s] : first[s + 1]] for s in r.span[low:high]])
            shift = np.concatenate([np.full(first[s + 1] - first[s], o) for s, o in zip(r.span[low:high], r.offset[low:high])])
            yield number, int(length), self.owner[places], self.th[places], self.start[places] + shift
            number += 1
        counts = r.high - r.low
        member = np.repeat(r.low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        whole = (r.offset[member] == 0) & (np.repeat(r.length, counts) == self.size[r.span[member]])
        told = set(r.span[member][whole].tolist())  # their other places are among a repeat's
        for s in range(len(self.size)):
            places = order[first[s] : first[s + 1]]
            if len(places) > 1 and s not in told:
                yield number, int(self.size[s]), self.owner[places], self.th[places], self.start[places]
                number += 1


_FOUND = "repeat long, owner long, th long, start long, size long, s1 long, s2 long, windows binary"


def _of_parts(spans: DataFrame, least: int, partitions: int, whole_groups: bool) -> DataFrame:
    """What the parts find: owner, th, start and size of what goes, or of all occurrences of every ``repeat``; and all spans with a hot key, which
    have digests (s1, s2), unpacked."""
    names = [c.split()[0] for c in _FOUND.split(", ")]

    def made(repeat, owner, th, start, size, s1=None, s2=None, windows=None) -> pa.RecordBatch:  # noqa: ANN001
        n = len(owner)
        columns = [pa.nulls(n, pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (repeat, owner, th, start, size, s1, s2)]
        return pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.binary()) if windows is None else pa.array(windows, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dovetail.llm import suffix_repeats as s

        for number, rows in s._groups(batches):
            for ids, hashes, idx, from_, size, digests, windows in (r for r in rows if r[6] is not None):
                i, both = np.frombuffer(idx, "<u4"), np.frombuffer(digests, "<i8").reshape(-1, 2)
                owner = np.array([s._FIRST if d is None else d for d in ids], np.int64)[i]
                start, size = np.frombuffer(from_, "<u4").astype(np.int64), np.frombuffer(size, "<u2").astype(np.int64)
                yield made(None, owner, np.array(hashes, np.int64)[i], start, size, both[:, 0], both[:, 1], windows)
            rows = [r for r in rows if r[6] is None]
            if not rows:
                continue
            part = s.Part(rows, least)
            rows.clear()
            if whole_groups:
                for repeat, length, owner, th, start in part.groups(number):
                    yield made(np.full(len(owner), repeat), owner, th, start, np.full(len(owner), length))
            else:
                owner, th, start, end = part.removed()
                yield made(None, owner, th, start, end - start)

    dealt = spans.repartition(partitions, "part").sortWithinPartitions("part")
    return common.map_arrow(dealt, run, _FOUND)


def _hot_windows(kinds: DataFrame) -> DataFrame:
    """s1, s2, first, offset, k1, k2 of the windows of distinct spans that stand more than once, with ``least``, the smallest owner of the same bytes."""
    names = ["s1", "s2", "first", "places", "offset", "k1", "k2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [np.frombuffer(w, "<i8").reshape(-1, 2) for w in batch.column(4).to_pylist()]
            n = np.array([len(w) for w in both], np.int64)
            all_ = np.concatenate(both) if both else np.zeros((0, 2), np.int64)
            offset = np.arange(len(all_)) - np.repeat(np.cumsum(n) - n, n)
            columns = (*(np.repeat(batch.column(i).to_numpy(), n) for i in range(4)), offset, all_[:, 0], all_[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    windows = common.map_arrow(kinds.select("s1", "s2", "first", "rows", "windows"), run, ", ".join(f"{n} long" for n in names))
    keys = windows.groupBy("k1", "k2").agg(F.min("first").alias("least"), F.sum("places").alias("n"), F.count("*").alias("rows")).where("n > 1").drop("n")
    return common.spread_join(windows.drop("places"), common.stash(keys, "hot-keys"), ["k1", "k2"], ["s1", "offset"], "inner")


def _hot(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The spans with a hot key among what the parts found, the distinct ones (s1, s2, first, rows, windows), and the windows of those."""
    spans = found.where("s1 is not null")
    kinds = common.stash(spans.groupBy("s1", "s2").agg(F.min("owner").alias("first"), F.count("*").alias("rows"), F.max("windows").alias("windows")), "hot-kinds")
    return spans.select("owner", "th", "start", "size", "s1", "s2"), kinds, _hot_windows(kinds)


def _hot_groups(found: DataFrame, least: int) -> DataFrame:
    """repeat, length, owner, th, start of the windows of hot keys that stand more than once."""
    spans, kinds, windows = _hot(found)
    seen = windows.groupBy("s1", "s2").agg(F.collect_list(F.struct("offset", F.xxhash64("k1", "k2").alias("repeat"))).alias("w"))  # RUN at most
    placed = common.spread_join(spans, kinds.select("s1", "s2", "rows").join(seen, ["s1", "s2"]), ["s1", "s2"], ["owner", "th", "start"], "inner")
    each = placed.select("owner", "th", "start", F.explode("w").alias("w"))
    return each.select(F.col("w.repeat").alias("repeat"), F.lit(least).cast("long").alias("length"), "owner", "th", (F.col("start") + F.col("w.offset")).alias("start"))


def _hot_removed(found: DataFrame, least: int) -> DataFrame:
    """owner, th, start, end of what goes of the spans with a hot key."""
    spans, kinds, windows = _hot(found)
    earlier = windows.where("least < first").groupBy("s1", "s2").agg(F.collect_list("offset").alias("offsets"))  # RUN at most
    placed = common.spread_join(spans, kinds.select("s1", "s2", "first", "rows").join(earlier, ["s1", "s2"], "left"), ["s1", "s2"], ["owner", "th", "start"], "inner")
    whole = placed.where("owner > first").select("owner", "th", "start", (F.col("start") + F.col("size")).alias("end"))
    part = placed.where("owner = first").select("owner", "th", "start", F.explode("offsets").alias("offset"))
    return whole.unionByName(part.select("owner", "th", (F.col("start") + F.col("offset")).alias("start"), (F.col("start") + F.col("offset") + least).alias("end")))


def _found(docs: DataFrame, least: int, hot: int, whole_groups: bool) -> tuple[DataFrame, bool]:
    """What the parts find, stored; and whether there are hot keys."""
    if least < 8:
        raise ValueError("repeats have 8 bytes at least")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(64, -(-size // (8 * PART_KEYS)))  # a key for each 16 bytes or so
    partitions = min(MOST_PARTITIONS, parts)
    marked = common.stash(_marked(_repeated_keys(_prints(docs, least, parts), partitions, hot), partitions), "marked")
    many, any_hot = marked.agg(F.sum(F.octet_length("at") / 4), F.max("hot")).first()
    parts = max(64, -(-int(many or 0) // PART_SPANS))
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.xxhash64("d.text") == F.col("m.th"))
    texts = docs.select("doc_id", "text").alias("d").join(marked.alias("m"), same).select("m.doc_id", "m.th", "m.at", "m.often", "d.text")
    return common.stash(_of_parts(_span_bytes(texts, least, parts), least, min(MOST_PARTITIONS, parts), whole_groups), "found"), bool(any_hot)


def maximal_repeats(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """repeat (a number), length (bytes), doc_id, th, start (byte) of all occurrences of every maximal repeat, one row each."""
    found, any_hot = _found(docs, least, hot, True)
    groups = found.where("s1 is null").select("repeat", F.col("size").alias("length"), "owner", "th", "start")
    if any_hot:
        groups = groups.unionByName(_hot_groups(found, least))
    return groups.select("repeat", "length", F.when(F.col("owner") != _FIRST, F.col("owner")).alias("doc_id"), "th", "start")


def removed_spans(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """owner (doc_id, or the smallest number for null), th, spans (start and end in bytes, in any order) of documents that lose something."""
    found, any_hot = _found(docs, least, hot, False)
    gone = found.where("s1 is null").select("owner", "th", "start", (F.col("start") + F.col("size")).alias("end"))
    if any_hot:
        gone = gone.unionByName(_hot_removed(found, least))
    return gone.groupBy("owner", "th").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, least: int = LEAST, hot: int = HOT) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), removed (start and end in bytes, ascending), n_bytes of every row of ``docs``."""
    spans = removed_spans(docs, least, hot)
    owner = F.coalesce(F.col("d.doc_id").cast("long"), F.lit(_FIRST))
    joined = docs.select("doc_id", "text").alias("d").join(spans.alias("s"), (owner == F.col("s.owner")) & (F.xxhash64("d.text") == F.col("s.th")), "left")
    names = ["doc_id", "kept", "removed", "n_bytes"]
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, sizes = [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                if not found.is_valid:
                    kept.append(raw)
                    removed.append([])
                    continue
                start, end = (np.array(found.values.field(i)) for i in (0, 1))
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.append(True, start[1:] > end[:-1])
                a, b = start[new].tolist(), end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)].tolist()
                removed.append([{"start": x, "end": y} for x, y in zip(a, b)])
                kept.append(b"".join(raw[x:y] for x, y in zip([0, *b], [*a, len(raw)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(removed, span), pa.array(sizes, pa.int64())], names=names)

    return common.map_arrow(joined.select("d.doc_id", "d.text", "s.spans"), run, "doc_id long, kept binary, removed array<struct<start:long,end:long>>, n_bytes long")


def digest(found: DataFrame) -> DataFrame:
    """Counts and the SHA-256 of what stays, of rows of ``remove_repeats``."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
