"""Keyed tables behind one pointer: what a change touches, writers at the same time, schema versions."""

import random

import pytest
from pyspark.sql import functions as F

from dovetail.sources.catalog import Catalog, Conflict, digests, slot_of


def _rows(spark, rows):
    return spark.createDataFrame(rows, "source string, path string, size long, note string")


def _data(df):
    return sorted(tuple(r) for r in df.select("source", "path", "size", "note").collect())


@pytest.fixture
def table(spark, tmp_path):
    return Catalog(spark, str(tmp_path / "c"), {"files": ["source", "path"], "albums": ["album"]}, rows_per_file=50)


def _start(n=600):
    return [("s" if i % 3 else "t", f"d{i // 50}/f{i}", i, None if i % 4 else "x") for i in range(n)]


def test_merge_rewrites_only_what_it_touches(spark, table):
    rows = _start()
    assert table.merge("files", _rows(spark, rows)) and table.number() == 1
    before = set(table.files("files"))
    assert len(before) >= 10
    new = [("s", "d0/f1", 999, "y"), ("s", "new/one", 1, None)]
    assert table.merge("files", _rows(spark, new))
    after = set(table.files("files"))
    assert 1 <= len(before - after) <= 3 and len(after - before) >= 1  # one holds the key; a filter may err
    held = {r[:2]: r for r in rows} | {r[:2]: r for r in new}
    assert _data(table.read("files")) == sorted(held.values(), key=lambda r: r[:2])
    assert not table.merge("files", _rows(spark, new)) and table.number() == 2  # nothing changes, nothing is written
    assert table.merge("files", _rows(spark, [("s", "d0/f1", 5, "z")]), keep=["note"])
    assert next(r for r in _data(table.read("files")) if r[1] == "d0/f1") == ("s", "d0/f1", 5, "y")
    assert _data(table.read("files", 1)) == sorted(rows, key=lambda r: r[:2])  # an earlier state


def test_keys_that_are_new_touch_no_file(spark, table):
    table.merge("files", _rows(spark, _start()))
    before = set(table.files("files"))
    new = [("u", f"n{i}", i, "q") for i in range(5)]
    table.merge("files", _rows(spark, new))
    assert len(before - set(table.files("files"))) <= 2 and table.read("files").count() == 605


def test_write_reads_and_writes_slots_that_differ(spark, table):
    rows = _start()
    table.write("files", _rows(spark, rows))
    before = set(table.files("files"))
    assert not table.write("files", _rows(spark, rows[::-1])) and not table.changed("files", _rows(spark, rows))
    changed = [*rows[1:], ("s", "d1/f50", 7, "twice")]
    changed = [r for r in changed if r != rows[50]]
    assert table.changed("files", _rows(spark, changed))
    assert table.write("files", _rows(spark, changed))
    assert len(before & set(table.files("files"))) >= len(before) - 3
    assert _data(table.read("files")) == sorted(changed, key=lambda r: r[:2])
    assert not table.changed("files", _rows(spark, changed))
    assert table.write("files", _rows(spark, [])) and table.read("files") is None


def test_two_writers(spark, table):
    table.merge("files", _rows(spark, _start()))
    base = table.number()
    one = table._merged("files", _rows(spark, [("s", "d0/f1", 1, "one")]), [], base)
    same = table._merged("files", _rows(spark, [("s", "d0/f1", 2, "two")]), [], base)
    apart = table._merged("files", _rows(spark, [("v", "far", 3, "three")]), [], base)
    assert table._commit([one])
    with pytest.raises(Conflict):
        table._commit([same])
    hit = one["slots"].join(apart["slots"], "slot", "left_semi").count()
    assert hit == 0 and table._commit([apart])  # moved onto the first one's state
    notes = {r.note for r in table.read("files").collect()}
    assert {"one", "three"} <= notes and "two" not in notes and table.number() == base + 2
    now = table._manifest("files", table.number())[1].drop("version")
    fresh = digests(table.read("files").withColumn("slot", slot_of(["source", "path"])), ["slot"])
    assert now.exceptAll(fresh.select(now.columns)).isEmpty() and now.count() == fresh.count()


def test_tables_appear_together(spark, table):
    albums = spark.createDataFrame([("a", 1), ("b", 2)], "album string, n int")
    assert table.publish({"files": _rows(spark, _start(20)), "albums": albums}) and table.number() == 1
    assert not table.publish({"files": _rows(spark, _start(20)), "albums": albums})
    with pytest.raises(ValueError):
        table.publish({"files": _rows(spark, _start(30)), "albums": spark.createDataFrame([(None, 1)], "album string, n int")})
    assert table.number() == 1 and table.read("files").count() == 20


def test_schema_versions(spark, table, tmp_path):
    table.write("files", _rows(spark, _start(100)))
    steps = [lambda d: d.withColumn("kind", F.lit("image")), lambda d: d.withColumnRenamed("size", "bytes").drop("note")]
    newer = Catalog(spark, table.path, table.keys, {"files": steps}, rows_per_file=50)
    assert sorted(newer.read("files").columns) == ["bytes", "kind", "path", "source"]
    old = newer.files("files")
    assert not newer.changed("files", newer.read("files"))
    new = spark.createDataFrame([("s", "d0/f1", 5, "video"), ("z", "z", 6, "video")], "source string, path string, bytes long, kind string")
    assert newer.merge("files", new)
    got = {(r.source, r.path): (r.bytes, r.kind) for r in newer.read("files").collect()}
    assert len(got) == 101 and got["s", "d0/f1"] == (5, "video") and got["t", "d0/f0"] == (0, "image")
    assert set(old) & set(newer.files("files"))  # files of both versions are one table
    assert not newer.changed("files", newer.read("files"))


def test_vacuum(spark, table):
    for n in (100, 101, 102):
        table.write("files", _rows(spark, _start(n)))
    rows = _data(table.read("files"))
    assert table.vacuum(keep=1) and _data(table.read("files")) == rows and table.vacuum(keep=1) == []


def test_maps_and_random_merges(spark, tmp_path):
    rng = random.Random(9)
    c = Catalog(spark, str(tmp_path / "m"), {"t": ["k"]}, rows_per_file=20)
    held = {}
    for _ in range(4):
        new = {rng.randrange(80): rng.randrange(5) for _ in range(40)}
        df = spark.createDataFrame(list(new.items()), "k long, v long").withColumn("m", F.create_map(F.lit("v"), "v"))
        changed = any(held.get(k) != v for k, v in new.items())
        held |= new
        assert c.merge("t", df) == changed
        assert {r.k: r.v for r in c.read("t").collect()} == held


def test_small_files_are_put_together(spark, table):
    table.write("files", _rows(spark, _start(200)))
    for i in range(4):
        table.change({}, {"files": _rows(spark, [("n", f"p{i}", i, None)])})
    rows, before = _data(table.read("files")), len(table.files("files"))
    assert table.compact("files") and len(table.files("files")) <= before - 3
    assert _data(table.read("files")) == rows and not table.changed("files", table.read("files")) and not table.compact("files")


def test_batches_of_a_stream(spark, table, tmp_path):
    from dovetail.streaming import inventory

    table.write("files", _rows(spark, _start(300)))
    before = set(table.files("files"))
    new = _rows(spark, [("s", "d0/f1", 1, "a"), ("s", "d0/f1", 2, "b"), ("n", "n", 3, None)]).coalesce(1)
    new.write.parquet(f"{tmp_path}/in")
    for k in range(2):  # a batch that runs again changes nothing
        inventory.ingest_keyed(spark, f"{tmp_path}/in", "source string, path string, size long, note string", table, "files", f"{tmp_path}/check{k}").awaitTermination()
        assert table.number() == 2 and len(before - set(table.files("files"))) <= 2
    got = {r[1]: r for r in _data(table.read("files"))}
    assert len(got) == 301 and got["d0/f1"] == ("s", "d0/f1", 2, "b")
