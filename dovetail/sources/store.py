"""Stored tables: a folder of Parquet versions with a pointer to the current one, keyed merge, and compare before write."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys; columns in ``keep`` hold their old values."""
    if not keep:
        return old.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)
    held = new.drop(*keep).join(old.select(*keys, *keep), keys, "left")
    return old.join(new, keys, "left_anti").unionByName(held, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose keys it does not have."""
    return old.unionByName(new.join(old, keys, "left_anti"), allowMissingColumns=True)


def replace_part(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """``old`` with all rows of the values of ``column`` that ``new`` has replaced by those of ``new``."""
    return old.join(new.select(column).distinct(), column, "left_anti").unionByName(new)


def differs(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold other rows, each row as often as it stands."""
    b = b.select(*a.columns)
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


class Table:
    """A table in ``path`` on any Hadoop file system: folders of Parquet, and numbered pointers that each list the folders of a state.

    Readers see the highest pointer. A write adds a folder and the next pointer; pointers are never changed, so a crash leaves the
    state before, and of two writers at a time the second is refused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> tuple[int, list[str]]:
        found = self._fs.globStatus(self._path(f"{self.path}/pointer-*")) or []
        last = max((int(f.getPath().getName().split("-")[1]) for f in found), default=0)
        if not last:
            return 0, []
        return last, sorted(r[0] for r in self.spark.read.text(f"{self.path}/pointer-{last:012d}").collect())

    def read(self) -> DataFrame | None:
        folders = self._state()[1]
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None

    def _add(self, df: DataFrame, number: int, others: list[str]) -> None:
        folder = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        fresh, pointer = self._path(f"{self.path}/fresh-{folder}"), self._path(f"{self.path}/pointer-{number:012d}")
        self.spark.createDataFrame([(f,) for f in [*others, folder]], "folder string").coalesce(1).write.text(fresh.toString())
        if self._fs.exists(pointer) or not self._fs.rename(fresh, pointer):
            raise OSError(f"{self.path} was written by another at the same time")

    def write(self, df: DataFrame, only_if_changed: bool = True) -> bool:
        """Make ``df`` the state of the table; False if nothing has changed."""
        number, folders = self._state()  # first, so that a state that another writer makes meanwhile is not overwritten
        before = self.spark.read.parquet(*(f"{self.path}/{f}" for f in folders)) if folders else None
        if only_if_changed and before is not None and set(before.columns) == set(df.columns) and not differs(before, df):
            return False
        self._add(df, number + 1, [])
        return True

    def append(self, df: DataFrame) -> None:
        """Add rows; what is there is not written again."""
        number, folders = self._state()
        self._add(df, number + 1, folders)


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """The last row of each ``key``."""
    columns = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(at)).alias("row")).select(key, "row.*")
