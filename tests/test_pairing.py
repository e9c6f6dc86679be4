"""Pairing in turn against the sequential version, on random files with bursts, shared names and missing times."""

import random

import pytest

from dovetail.operators import duplicates

COLUMNS = "id long, source string, rel_path string, kind string, camera_model string, exif_dto string"


def _sequential(rows):
    key = lambda r: (r[1], r[2], r[0])
    stem = lambda r: r[2].rsplit("/", 1)[1].rsplit(".", 1)[0]
    second = lambda r: None if not r[5] else int(r[5][14:16]) * 60 + int(r[5][17:19])
    found, used = set(), set()
    for d in {r[2].rsplit("/", 1)[0] for r in rows}:
        inside = sorted((r for r in rows if r[2].rsplit("/", 1)[0] == d), key=key)
        others = [r for r in inside if not r[2].endswith(".dng")]
        for raw in (r for r in inside if r[2].endswith(".dng")):
            match = next((j for j in others if j[0] not in used and stem(j) == stem(raw)), None)
            if match is None and raw[4] and raw[5]:
                match = next((j for j in others if j[0] not in used and j[4] == raw[4] and j[5] and abs(second(j) - second(raw)) <= 1), None)
            if match:
                found.add((raw[0], match[0]))
                used.add(match[0])
    return found


@pytest.mark.parametrize("seed,seconds,stems,n", [(1, 3, 1000, 60), (2, 12, 6, 80), (3, 2, 3, 60), (4, 40, 40, 150)])
def test_pairs_equal_those_made_one_by_one(spark, seed, seconds, stems, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        time = None if rng.random() < 0.1 else f"2020-01-01T00:00:{rng.randrange(seconds):02d}"
        rows.append((i, rng.choice(["a", "b"]), f"{rng.choice(['x', 'x', 'y/z'])}/n{rng.randrange(stems)}.{rng.choice(['dng', 'jpg', 'png'])}", "image", rng.choice(["C", "C", "D", "", None]), time))
    got = {tuple(r) for r in duplicates.pair_raw_jpeg(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == _sequential(rows) and got


def test_a_burst_takes_few_rounds_and_many_tasks(spark, monkeypatch):
    from dovetail.operators import pairing

    rounds = []
    made = pairing._proposals
    monkeypatch.setattr(pairing, "_proposals", lambda *x: rounds.append(1) or made(*x))
    rows = [(i, "s", f"flat/{'r' if i % 2 else 'j'}{i:05d}.{'dng' if i % 2 else 'jpg'}", "image", "C", f"2020-01-01T00:{i // 2000:02d}:00") for i in range(4000)]
    got = {tuple(r) for r in duplicates.pair_raw_jpeg(spark.createDataFrame(rows, COLUMNS).repartition(4)).collect()}
    assert got == {(i + 1, i) for i in range(0, 4000, 2)} and len(rounds) <= 3


def test_nothing_to_pair(spark):
    assert duplicates.pair_raw_jpeg(spark.createDataFrame([], COLUMNS)).count() == 0
    rows = [(1, "s", "a/x.dng", "image", None, None), (2, "s", "b/x.jpg", "image", None, None), (3, "s", "a/x.mp4", "video", None, None)]
    assert duplicates.pair_raw_jpeg(spark.createDataFrame(rows, COLUMNS)).count() == 0
