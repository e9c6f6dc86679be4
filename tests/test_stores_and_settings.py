import pytest
from pyspark.sql import functions as F

from dovetail.plans.stages import Settings
from dovetail.sources import store
from dovetail.streaming import inventory


def test_settings():
    assert Settings.of({"phash_most": 4, "curated": ["a"]}).curated == ("a",)
    with pytest.raises(ValueError, match="unknown settings: colour"):
        Settings.of({"colour": 1})
    with pytest.raises(ValueError, match="both lists"):
        Settings(curated=("a", "b"), derived=("b",))


def test_stored_table_survives_what_was_not_finished(spark, tmp_path):
    table = store.Table(spark, f"{tmp_path}/t")
    assert table.read() is None
    rows = spark.range(5).withColumn("v", F.lit("x"))
    assert table.write(rows) and not table.write(rows)
    table.append(spark.range(5, 7).withColumn("v", F.lit("y")))
    assert sorted(r.id for r in table.read().collect()) == list(range(7))
    # folders that no pointer names, as a crash leaves them, are not read
    spark.range(99).withColumn("v", F.lit("z")).write.parquet(f"{tmp_path}/t/v-left")
    assert table.read().count() == 7
    number, folders = table._state()
    with pytest.raises(OSError):
        table._add(rows, number, folders)
    assert table.read().count() == 7 and table.write(rows) and table.read().count() == 5


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    table = store.Table(spark, f"{tmp_path}/t")
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, v string")
    batch.coalesce(1).write.parquet(f"{tmp_path}/in")
    for k in range(2):
        inventory.ingest(spark, f"{tmp_path}/in", "id long, v string", table, f"{tmp_path}/check{k}", ["id"]).awaitTermination()
        assert {(r.id, r.v) for r in table.read().collect()} == {(1, "b"), (2, "c")}
    assert table._state()[0] == 1
