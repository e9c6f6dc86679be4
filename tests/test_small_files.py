import json
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dovetail.operators import reports
from dovetail.sources import files
from dovetail.streaming import inventory


def test_keyword_map(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text('action,folder_name,proposed_keyword\nkeep,vacations,Travel/Vacations\n Rename ,"a, b","say ""c"""\ndrop,misc,x\n,plain,\nkeep, ,y\nkeep,twice,one\nkeep,twice,two\n')
    got = {r.folder_name: r.keyword for r in files.keyword_map(spark, str(path)).collect()}
    assert got == {"vacations": "Travel/Vacations", "a, b": 'say "c"', "misc": None, "plain": "plain", "twice": "two"}
    path.write_text("folder_name,proposed_keyword,action\na,b,burn\n")
    with pytest.raises(PySparkException, match="unknown action burn for a"):
        files.keyword_map(spark, str(path)).collect()


def test_trash_records(spark):
    said = {"x.dtrashinfo": "/store/arch/2013/x.jpg", "t/y-1.b.dtrashinfo": "/store/arch/y.jpg", "y-0.dtrashinfo": "/store/arch/y.jpg", "z.dtrashinfo": "/store/archive2/z.jpg"}
    rows = [(name, json.dumps({"path": path})) for name, path in said.items()] + [("bad.dtrashinfo", "{"), ("no.dtrashinfo", "{}"), ("null.dtrashinfo", None)]
    got = files.trash_records(spark.createDataFrame(rows, "rel_path string, text string"), "/store/arch/").collect()
    assert {(r.original_rel, r.entry) for r in got} == {("2013/x.jpg", "x"), ("y.jpg", "y-1.b")} and len(got) == 2


def test_tree_leaves_out_what_others_keep(spark):
    rows = [("a/b.jpg",), ("a/.DS_Store",), (".trash/a.jpg",), ("a/.trash/c.jpg",), ("d.jpg",)]
    got = files.tree(spark.createDataFrame(rows, "rel_path string"), [".DS_Store"], [".trash"]).collect()
    assert {r.rel_path for r in got} == {"a/b.jpg", "a/.trash/c.jpg", "d.jpg"}


def test_csv_report_comes_back(spark, tmp_path):
    rows = [(1, 'a "quoted", name'), (2, None), (3, "two\nlines")]
    reports.write_csv(spark.createDataFrame(rows, "id long, name string"), f"{tmp_path}/report")
    back = spark.read.options(header=True, multiLine=True, escape='"').schema("id long, name string").csv(f"{tmp_path}/report")
    assert {(r.id, r.name) for r in back.collect()} == set(rows)


def test_windowed_counts(spark, tmp_path):
    at = lambda h, m: datetime(2020, 1, 1, h, m)
    rows = [(at(1, 5), "a"), (at(1, 55), "a"), (at(2, 0), "a"), (at(1, 30), "b")]
    spark.createDataFrame(rows, "at timestamp, kind string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("at timestamp, kind string").parquet(f"{tmp_path}/in")
    counted = inventory.windowed_counts(stream, "at", "kind").select(F.hour("start").alias("h"), "kind", "n")
    query = counted.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("hours").collect()} == {(1, "a", 2), (2, "a", 1), (1, "b", 1)}
