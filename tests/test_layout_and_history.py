"""Tables laid out for their joins, logs as of a time, stratified samples, prefixes."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from dovetail.operators import history, linkage, stats, verify
from dovetail.sources import layout


def test_ledger_joins_move_no_rows(spark):
    inv = spark.range(300).select("id", F.lit("s").alias("source"), F.col("id").cast("string").alias("rel_path"), F.col("id").alias("size_bytes"))
    ledger = spark.range(0, 300, 2).select("id", F.lit("archive").alias("disposition"))
    a, b = layout.bucketed(inv, ["id"], 8), layout.bucketed(ledger, ["id"], 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert layout.exchanges(verify.missing_placement(a, b)) == 0 < layout.exchanges(verify.missing_placement(inv, ledger))
        assert layout.exchanges(a.join(b, "id")) == 0 == layout.exchanges(a.groupBy("id").agg(F.sum("size_bytes")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert verify.missing_placement(a, b).count() == 150 and a.count() == 300


def test_states_as_of(spark):
    rng = random.Random(8)
    # one subject has most rows, so it spans tasks
    log = [(rng.choice(["hot"] * 8 + ["b", "c", None]), rng.randrange(400), f"v{i}") for i in range(500)]
    asks = [(rng.choice(["hot"] * 8 + ["b", "c", "never", None]), rng.randrange(-5, 410), i) for i in range(300)]
    got = history.as_of(spark.createDataFrame(log, "s string, at long, v string"), spark.createDataFrame(asks, "s string, at long, n long"), "s", "at").collect()
    for r in got:
        before = [(at, v) for s, at, v in log if s is not None and s == r.s and at <= r.at]
        assert (r.state and r.state.v) == (max(before)[1] if before else None), r
    assert len(got) == len(asks)
    first = {r.s: r.at for r in history.first_of(spark.createDataFrame(log, "s string, at long, v string"), "s", "at").collect()}
    assert first["hot"] == min(at for s, at, _ in log if s == "hot")


@pytest.mark.parametrize("least,share", [(5, 0.01), (0, 0.1), (1000, 0.0)])
def test_stratified_samples_are_the_smallest_hashes(spark, least, share):
    rows = [("big", i) for i in range(3000)] + [("small", i) for i in range(3)] + [(f"s{i % 9}", 5000 + i) for i in range(90)]
    got = {tuple(r) for r in stats.stratified_sample(spark.createDataFrame(rows, "s string, id long"), "s", "id", least, share, seed=7).collect()}
    want = set()
    for s in {s for s, _ in rows}:
        ids = sorted((hashlib.md5(f"7:{i}".encode()).hexdigest(), i) for k, i in rows if k == s)
        want |= {(s, i) for _, i in ids[: max(least, -(-int(len(ids) * share * 1000) // 1000))]}
    assert got == want


def test_prefixes_by_a_join(spark):
    dirs = spark.createDataFrame([("s", d) for d in ("a", "a/b", "a/b/c", "ab", "", "x/a", "p7/q")], "source string, dir string")
    many = [(f"p{i}", "takeout_derived") for i in range(3000)] + [("a", "takeout_derived"), ("a/b/", "curated"), ("x", "takeout_derived")]
    found = linkage.prefix_overrides(dirs, spark.createDataFrame(many, "prefix string, classification string"))
    assert {(r.dir, r.override) for r in found.collect()} == {("a", "takeout_derived"), ("a/b", "curated"), ("a/b/c", "curated"), ("x/a", "takeout_derived"), ("p7/q", "takeout_derived")}
    media = spark.createDataFrame([(1, "s", "a/f.jpg", "curated"), (2, "s", "z/f.jpg", "curated")], "id long, source string, rel_path string, trust string")
    prov = spark.createDataFrame([("s", "a", "takeout_derived")], "source string, dir string, classification string")
    assert {(r.id, r.trust) for r in linkage.trusted(media, prov).collect()} == {(1, "takeout"), (2, "curated")}


def test_the_inventory_neither_sorts_nor_holds_the_longer_tables(spark):
    from dovetail.sources.instances import instances

    plan = instances(spark, "/root/testdata/sf0.001", hashed=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 3 and "BuildRight" not in plan and "SortMergeJoin" not in plan
    assert "text#" not in plan.split("Exchange", 1)[0]  # above the first exchange, texts are hashes
