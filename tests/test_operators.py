import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from dovetail.operators import duplicates, reconcile, review, stats, verify
from dovetail.sources import files, store


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(12)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in duplicates.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert duplicates.components(spark.createDataFrame([], "a long, b long")).count() == 0


def _media(spark, rows):
    return spark.createDataFrame(rows, "id long, source string, rel_path string, kind string, camera_model string, exif_dto string")


def test_greedy_pairs(spark):
    rows = [
        (1, "L", "d/a.dng", "image", "P", "2015-04-18T09:30:00"),
        (2, "L", "d/a.jpg", "image", "P", "2015-04-18T09:30:00"),
        (3, "L", "d/b.dng", "image", "P", "2015-04-18T09:30:05"),
        (4, "L", "d/x.jpg", "image", "P", "2015-04-18T09:30:06"),
        (5, "L", "d/c.dng", "image", "P", "2015-04-18T09:30:06"),
        (6, "L", "e/c.jpg", "image", "P", "2015-04-18T09:30:06"),
    ]
    assert {tuple(r) for r in duplicates.pair_raw_jpeg(_media(spark, rows)).collect()} == {(1, 2), (3, 4)}


def test_merged_dates(spark):
    columns = "cluster_id long, kind string, trust string, rel_path string, resolved_date string, resolved_precision string, resolved_source string"
    cases = [
        ([("image", "curated", "1998-07-12T14:33:05", "second", "exif"), ("image", "curated", "1998-01-01", "year", "folder")], ("1998-01-01", "folder", False)),
        ([("image", "curated", "1998-07-12T14:33:05", "second", "exif"), ("image", "curated", "1998-07-14", "day", "review")], ("1998-07-14", "review", True)),
        ([("image", "curated", "2020-08-02T10:00:00", "second", "exif"), ("image", "curated", "2020-08-02T10:00:02", "second", "exif")], (None, "exif", False)),
        ([("image", "curated", "2021-10-02", "day", "exif"), ("video", "curated", "2023-06-25", "day", "exif")], ("2021-10-02", "exif", False)),
        ([("image", "curated", "2007-01-01", "year", "folder"), ("image", "takeout", "2023-01-01", "year", "folder")], ("2007-01-01", "folder", False)),
        ([("image", "takeout", "2015-01-01", "year", "folder"), ("image", "takeout", "2015-04-18T12:00:00", "second", "takeout_json")], ("2015-04-18T12:00:00", "takeout_json", False)),
        ([("image", "curated", None, None, None)], (None, None, True)),
    ]
    rows = [(c, k, t, f"p{i}", d, p, s) for c, (members, _) in enumerate(cases) for i, (k, t, d, p, s) in enumerate(members)]
    got = {r.cluster_id: r for r in duplicates.merged_dates(spark.createDataFrame(rows, columns)).collect()}
    for c, (_, (date, source, review_)) in enumerate(cases):
        assert (got[c].source, got[c].disagrees) == (source, review_)
        assert date is None or got[c].date == date


def test_verify_finds_each_fault(spark):
    inventory = spark.createDataFrame([(i, "L", f"p{i}", f"s{i}") for i in range(6)], "id long, source string, rel_path string, sha256 string")
    ledger = spark.createDataFrame([(0, "archive", "a0", "s0"), (1, "archive", "a1", "s1"), (2, "quarantine", "q2", "zz"), (3, "lost", None, None), (4, "archive", None, "s4")], "id long, disposition string, dest_rel_path string, dest_sha256 string")
    disk = spark.createDataFrame([("archive", "a0", "bad"), ("archive", "a0.xmp", "x"), ("archive", "stray", "x"), ("archive", ".dtrash/x", "x"), ("quarantine", "q2", "zz")], "base string, rel string, sha256 string")
    found = sorted(tuple(r) for r in verify.discrepancies(inventory, ledger, disk, ignored_dirs=[".dtrash"]).collect())
    assert found == sorted([("hash_mismatch", "archive/a0"), ("missing_dest_file", "L:p1"), ("quarantine_not_byte_identical", "L:p2"), ("invalid_disposition", "L:p3"), ("missing_dest_record", "L:p4"), ("missing_placement", "L:p5"), ("orphan_in_archive", "stray")])


def test_moves_and_restorations(spark):
    placed = spark.createDataFrame([(1, "2001/a.jpg"), (2, "2001/b.jpg"), (3, "2001/c.jpg")], "id long, rel string")
    disk = spark.createDataFrame([("2001/a.jpg",), ("x/b.jpg",), ("w/b.jpg",), ("n/new.jpg",), ("2001/a.jpg.xmp",)], "rel string")
    moved = reconcile.moves(placed, disk)
    assert [tuple(r) for r in moved.collect()] == [(2, "2001/b.jpg", "w/b.jpg")]
    assert {tuple(r) for r in reconcile.unknown(placed, disk, moved).collect()} == {("x/b.jpg", "media"), ("n/new.jpg", "media")}


def test_split_dissolves_pairs(spark):
    members = spark.createDataFrame([(1, 1, "winner"), (1, 2, "loser"), (2, 3, "winner"), (2, 4, "loser"), (2, 5, "loser")], "cluster_id long, id long, role string")
    gone = spark.createDataFrame([(1, 2), (2, 5)], "cluster_id long, id long")
    got = {r.id: r.role for r in review.split_member(members, gone).collect()}
    assert got == {1: "not_duplicate", 2: "not_duplicate", 3: "winner", 4: "loser", 5: "not_duplicate"}


def test_table_writes_only_changes(spark, tmp_path):
    t = store.Table(spark, f"file://{tmp_path}/t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    assert t.read() is None and t.write(a) and not t.write(a)
    b = store.upsert(a, spark.createDataFrame([(2, "z"), (3, "w")], "k long, v string"), ["k"])
    assert t.write(b) and {tuple(r) for r in t.read().collect()} == {(1, "x"), (2, "z"), (3, "w")}
    t.append(a)
    assert t.read().count() == 5


def test_walk_and_changes(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "é.txt").write_text("abc")
    rows = files.walk(spark, str(tmp_path)).collect()
    assert [(r.rel_path, r.size_bytes) for r in rows] == [("d/é.txt", 3)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 3)), max_size=12))
def test_upsert_is_idempotent(spark, rows):
    new = spark.createDataFrame(list({k: (k, v) for k, v in rows}.values()), "k int, v int")
    old = spark.createDataFrame([(0, 9), (1, 9)], "k int, v int")
    once = store.upsert(old, new, ["k"])
    assert not store.differs(once, store.upsert(once, new, ["k"]))


def test_sample_is_stable(spark):
    df = spark.range(100)
    assert stats.sample(df, "id", 5, 1).collect() == stats.sample(df.repartition(7), "id", 5, 1).collect()
