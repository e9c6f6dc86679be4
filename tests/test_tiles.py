"""Links of images by tiles against all pairs: components, weak links and counts, over several tiles, with edits and images whose links are known."""

import random

from dovetail.operators import duplicates, tiles


def _near(a, b):
    bands = {(i, a[1][12 - 4 * i : 16 - 4 * i]) for i in range(4)} & {(i, b[1][12 - 4 * i : 16 - 4 * i]) for i in range(4)}
    bits = lambda k: (int(a[k], 16) ^ int(b[k], 16)).bit_count()
    r, s = a[3] / a[4], b[3] / b[4]
    return bool(bands) and bits(1) <= 10 and bits(2) <= 8 and abs(r - s) / max(r, s) <= 0.01, bits(1) > 6


def _groups(pairs):
    of = {}
    for a, b, _ in pairs:
        x, y = of.setdefault(a, {a}), of.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                of[k] = x
    return {frozenset(x): any(w for a, _, w in pairs if a in x) for x in of.values()}


def _rows(seed):
    rng = random.Random(seed)
    flip = lambda text, n: f"{int(text, 16) ^ sum(1 << k for k in rng.sample(range(64), n)):016x}"
    heads = [(f"{rng.getrandbits(64):016x}", f"{rng.getrandbits(64):016x}") for _ in range(4)]
    return [(k, flip(p, rng.randint(0, 6)), flip(d, rng.randint(0, 5)), *rng.choice([(400, 300), (401, 300), (300, 300)])) for k in range(160) for p, d in [rng.choice(heads)]]


def test_ties_and_counts_equal_all_pairs(spark):
    rows = _rows(3)
    edits = [(k, k - 1) for k in range(1, 160, 9)]
    old = {k for k in range(160) if k % 3 == 0}
    each = duplicates.bands(spark.createDataFrame(rows, "id long, phash string, dhash string, width int, height int"))
    pairs = [(a[0], b[0], w) for i, a in enumerate(rows) for b in rows[i + 1 :] for ok, w in [_near(a, b)] if ok]
    for size in (7, 10_000):
        assert {(r.id, r.n_links, r.n_weak) for r in tiles.link_counts(each, tile=size).collect()} == {(k, len(m), sum(m)) for k in range(160) for m in [[w for a, b, w in pairs if k in (a, b)]] if m}
        of = spark.createDataFrame(edits, "edited_id long, original_id long")
        free = [p for p in pairs if (p[1], p[0]) not in edits]
        assert _groups([tuple(r) for r in duplicates.image_ties(each, of).collect()]) == _groups(free)
        ties = [tuple(r) for r in tiles.ties(each.withColumn("old", each["id"] % 3 == 0), tile=size).collect()]
        assert _groups(ties) == _groups([p for p in pairs if not {p[0], p[1]} <= old])


def test_clips_of_one_signature_meet_once(spark):
    sig = lambda s, a, b: f"{s}s:1920x1080:{a:016x}:{b:016x}:?"
    texts = [sig(10, 5, 9), sig(10, 5, 9), sig(11, 4, 9), sig(13, 5, 9), "10s:1920x1080:?:?", "no signature"]
    clips = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id long, video_sig string")
    assert {tuple(r) for r in duplicates.video_links(clips).collect()} == {(0, 0, 2), (1, 0, 2), (2, 2, 2), (3, 3, 0), (4, 4, 0), (5, 5, 0)}
    edits = spark.createDataFrame([(1, 0)], "edited_id long, original_id long")
    ties = {tuple(sorted(r)) for r in duplicates.clip_ties(duplicates.clip_places(clips), edits).collect()}
    assert ties == {(0, 2), (1, 2)}
