"""Keyed tables on any Hadoop file system: several tables behind one pointer, merges that rewrite only the files they touch.

A row's slot is a hash of its key. Files are ranges in the order of (slot, key); a manifest lists for each file its range, its rows, a bitmap
filter of its keys and its schema version, and for each slot a digest of its rows. A digest is a sum of row hashes, so it does not
depend on the order, equal tables have equal digests, and what goes and comes is subtracted and added.

* ``merge`` looks keys up by range and filter, reads the files that may hold them, and writes those and new rows; all other files stay.
* ``write`` compares digests from the root down (all, groups of slots, slots) and reads and writes only files with slots that differ.
* Both write nothing where nothing changes. Changes of several tables become visible together (``publish``), or not at all.
* A commit adds the next numbered pointer, and never changes an old one, so every earlier state can be read. Of two writers at a time the
  second moves its change onto the state of the first, or is refused where both touched the same file or slot.
* Columns added, renamed or dropped since a file was written are applied when it is read (``migrations``), in order.

Keys are not null, and no column is called ``slot``; columns that are maps are compared as their sorted entries. Old files are kept until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dovetail.sources import shared

#: Slots of a table, and slots in a node of the tree of digests; bits of a bitmap and filter bits a row.
SLOTS, FANOUT, BITS, BITS_PER_ROW = 4096, 64, 32_768, 10
ROWS_PER_FILE = 1_000_000


class Conflict(OSError):
    """Another writer changed the same rows."""


def slot_of(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def digests(df: DataFrame, by: list[str | Column]) -> DataFrame:
    """``by`` with n, d1 and d2 of its rows: their number and two sums of row hashes, 128 bits and more in all."""
    plain = []
    for name, kind in sorted(df.dtypes):
        if name != "slot":
            value = F.array_sort(F.map_entries(name)) if kind.startswith("map<") else F.col(name)
            plain += [F.when(value.isNotNull(), name), value]  # a null column hashes as if it were not there
    part = lambda salt: F.sum(F.xxhash64(F.lit(salt), *plain).cast("decimal(38,0)"))
    return df.groupBy(*by).agg(F.count("*").alias("n"), part(1).alias("d1"), part(2).alias("d2"))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """slot of those that differ between two tables of digests (slot, n, d1, d2): down a tree, leaving out nodes that are equal."""
    node = F.floor(F.col("slot") / FANOUT).alias("node")
    columns = ["n", "d1", "d2"]

    def level(key: Column | None, x: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in columns]
        return x.agg(*sums) if key is None else x.groupBy(key).agg(*sums)

    def unlike(x: DataFrame, y: DataFrame, key: str) -> DataFrame:
        # one side negated: equal digests cancel
        both = x.select(key, *columns).unionByName(y.select(key, *((-F.col(c)).alias(c) for c in columns)))
        return both.groupBy(key).agg(*(F.sum(c).alias(c) for c in columns)).where("n <> 0 or d1 <> 0 or d2 <> 0").select(key)

    if level(None, a).first() == level(None, b).first():
        return a.select("slot").limit(0)
    nodes = unlike(level(node, a), level(node, b), "node")
    inside = lambda x: x.withColumn("node", node).join(F.broadcast(nodes), "node", "left_semi")
    return unlike(inside(a), inside(b), "slot")


class Catalog:
    """Tables in ``path``. ``keys``: the key columns of each table; ``by``: the first of them that a slot hashes, all unless given, which ``lookup``
    then asks for. ``migrations``: for each table, functions from a frame of one schema version to the
    next, in order; applied to what was written before them."""

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, list[str]], migrations: dict[str, list[Callable[[DataFrame], DataFrame]]] | None = None, rows_per_file: int = ROWS_PER_FILE, by: dict[str, list[str]] | None = None):
        self.spark, self.path, self.keys, self.migrations, self.rows_per_file = spark, path, keys, migrations or {}, rows_per_file
        self.by = {**keys, **(by or {})}
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._jpath(path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jpath(path).toUri(), conf)

    # states

    def number(self) -> int:
        """Of the current state; 0 before the first."""
        found = self._fs.globStatus(self._jpath(f"{self.path}/pointer-*")) or []
        return max((int(f.getPath().getName().split("-")[1]) for f in found), default=0)

    def _manifests(self, number: int) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.path}/pointer-{number:012d}", wholetext=True).first()[0]) if number else {}

    def _manifest(self, name: str, number: int) -> tuple[DataFrame, DataFrame, DataFrame] | None:
        """Files, slots and filters of a table."""
        at = self._manifests(number).get(name)
        return None if at is None else tuple(self.spark.read.parquet(f"{self.path}/{at}/{part}") for part in ("files", "slots", "filters"))

    def _slots(self, name: str, held: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
        """The digests of a table's slots; counted anew where they are of another schema version."""
        version = len(self.migrations.get(name, []))
        if held[1].where(F.col("version") != version).isEmpty():
            return held[1].drop("version")
        rows = self._rows(name, [(r.file, r.version) for r in held[0].select("file", "version").collect()])
        return shared.stash(digests(rows.withColumn("slot", slot_of(self.by[name])), ["slot"]), "digests")

    def files(self, name: str, number: int | None = None) -> list[str]:
        held = self._manifest(name, self.number() if number is None else number)
        return [] if held is None else sorted(r[0] for r in held[0].select("file").collect())

    def read(self, name: str, number: int | None = None) -> DataFrame | None:
        """A table in its current state, or in an earlier one."""
        held = self._manifest(name, self.number() if number is None else number)
        return None if held is None else self._rows(name, [(r.file, r.version) for r in held[0].select("file", "version").collect()])

    def _rows(self, name: str, files: list[tuple[str, int]]) -> DataFrame | None:
        steps = self.migrations.get(name, [])
        parts = []
        for version in sorted({v for _, v in files}):
            df = self.spark.read.parquet(*(f"{self.path}/{f}" for f, v in sorted(files) if v == version)).drop("slot")
            parts.append(reduce(lambda d, step: step(d), steps[version:], df))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    # changes

    def _written(self, name: str, rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
        """Write ``rows`` as files in ranges; their manifest rows and filters."""
        keys, folder = self.keys[name], f"{name}/v-{uuid.uuid4().hex}"
        if "slot" in rows.columns:
            raise ValueError("a column may not be called slot")
        rows = shared.stash(rows.withColumn("slot", slot_of(self.by[name])), "rows")
        total, bad = rows.agg(F.count("*"), F.count_if(reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys)))).first()
        if bad:
            raise ValueError(f"{bad} rows of {name} have a null key")
        if not total:
            return None
        rows.repartitionByRange(-(-total // self.rows_per_file), "slot", *keys).sortWithinPartitions("slot", *keys).write.parquet(f"{self.path}/{folder}")
        again = self.spark.read.parquet(f"{self.path}/{folder}").withColumn("file", F.concat(F.lit(f"{folder}/"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)))
        at = F.struct("slot", *keys)
        files = again.groupBy("file").agg(F.count("*").alias("rows"), F.min(at).alias("low"), F.max(at).alias("high"))
        files = shared.stash(files.withColumn("bits", (F.ceil(F.col("rows") * BITS_PER_ROW / BITS) * BITS).cast("long")).withColumn("version", F.lit(len(self.migrations.get(name, [])))), "files")
        places = again.join(F.broadcast(files.select("file", "bits")), "file").select("file", F.explode(self._places(keys)).alias("bit"))
        filters = places.groupBy("file", F.floor(F.col("bit") / BITS).alias("chunk")).agg(F.expr(f"bitmap_construct_agg(bit % {BITS})").alias("bitmap"))
        return files, shared.stash(filters, "filters")

    @staticmethod
    def _places(keys: list[str | Column]) -> Column:
        return F.array(*(F.pmod(F.xxhash64(F.lit(salt), *keys), F.col("bits")) for salt in (3, 4)))

    def _touched(self, name: str, held: tuple[DataFrame, DataFrame, DataFrame], new: DataFrame) -> list[tuple[str, int]]:
        """Files that may hold keys of ``new`` (slot and keys), by their ranges and filters."""
        keys, (files, _, filters) = self.keys[name], held
        spread = files.withColumn("slot", F.explode(F.sequence("low.slot", "high.slot"))).select("file", "version", "bits", "low", "high", "slot")
        at = F.struct("slot", *(F.col(f"n.{k}").alias(k) for k in keys))
        near = new.select("slot", *keys).distinct().alias("n").join(spread, "slot").where((at >= F.col("low")) & (at <= F.col("high")))
        key = [F.col(f"n.{k}") for k in keys]
        asked = near.select("file", "version", F.struct(*key).alias("key"), F.explode(self._places(key)).alias("bit"))
        asked = asked.withColumns({"chunk": F.floor(F.col("bit") / BITS), "in_chunk": F.col("bit") % BITS}).join(filters, ["file", "chunk"])
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(F.col("in_chunk") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.floor(byte / F.pow(F.lit(2), F.col("in_chunk") % 8)) % 2 == 1
        there = asked.groupBy("file", "version", "key").agg(F.min(is_set).alias("all"), F.count("*").alias("places")).where("all and places = 2")
        return sorted((r.file, r.version) for r in there.select("file", "version").distinct().collect())

    def _change(self, name: str, number: int, gone: list[tuple[str, int]], rows: DataFrame | None, slots: DataFrame) -> dict:
        """A change against state ``number``: files that go, rows that are written, and what is added to the digests of slots."""
        made = None if rows is None else self._written(name, rows)
        return {"name": name, "base": number, "gone": [f for f, _ in gone], "made": made, "slots": shared.stash(slots, "slots")}

    def _merged(self, name: str, new: DataFrame, keep: list[str], number: int) -> dict | None:
        keys, held = self.keys[name], self._manifest(name, number)
        slot = slot_of(self.by[name])
        new = shared.stash(new.withColumn("slot", slot), "new")
        if held is None:
            return self._change(name, number, [], new.drop("slot"), digests(new, ["slot"])) if not new.isEmpty() else None
        touched = self._touched(name, held, new)
        old = self._rows(name, touched)
        rows = new.drop("slot")
        if old is None:
            return self._change(name, number, [], rows, digests(new, ["slot"])) if not new.isEmpty() else None
        if keep:
            rows = rows.drop(*keep).join(old.select(*keys, *keep), keys, "left")
        for c in old.columns:  # columns that the new rows do not have are null in them
            rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(old.schema[c].dataType))
        rows = shared.stash(rows, "merged")
        replaced = old.join(new.select(*keys), keys, "left_semi").withColumn("slot", slot)
        come, go = digests(rows.withColumn("slot", slot), ["slot"]), digests(replaced, ["slot"])
        delta = come.unionByName(go.select("slot", *((-F.col(c)).alias(c) for c in ("n", "d1", "d2"))))
        delta = shared.stash(delta.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", "d1", "d2"))), "delta")
        if delta.where("n <> 0 or d1 <> 0 or d2 <> 0").isEmpty():
            return None
        stays = old.join(new.select(*keys), keys, "left_anti")
        return self._change(name, number, touched, stays.unionByName(rows, allowMissingColumns=True), delta)

    def _replaced(self, name: str, df: DataFrame, number: int) -> dict | None:
        held, slot = self._manifest(name, number), slot_of(self.by[name])
        df = df.withColumn("slot", slot)
        now = shared.stash(digests(df, ["slot"]), "digests")
        if held is None:
            return self._change(name, number, [], df.drop("slot"), now) if not now.isEmpty() else None
        files, slots = held[0], self._slots(name, held)
        unlike = shared.stash(differing(now, slots), "unlike")
        if unlike.isEmpty():
            return None
        spread = files.select("file", "version", F.explode(F.sequence("low.slot", "high.slot")).alias("slot"))
        hit = sorted((r.file, r.version) for r in spread.join(F.broadcast(unlike), "slot").select("file", "version").distinct().collect())
        rows = df.join(F.broadcast(unlike), "slot", "left_semi").drop("slot")
        old = self._rows(name, hit)
        if old is not None:
            stays = old.withColumn("slot", slot).join(F.broadcast(unlike), "slot", "left_anti").drop("slot")
            rows = rows.unionByName(stays.select(*rows.columns) if set(rows.columns) <= set(stays.columns) else stays, allowMissingColumns=True)
        both = now.join(unlike, "slot", "left_semi").unionByName(slots.join(unlike, "slot", "left_semi").select("slot", *((-F.col(c)).alias(c) for c in ("n", "d1", "d2"))))
        return self._change(name, number, hit, rows, both.groupBy("slot").agg(*(F.sum(c).alias(c) for c in ("n", "d1", "d2"))))

    # commits

    def _commit(self, changes: list[dict]) -> bool:
        changes = [c for c in changes if c]
        if not changes:
            return False
        number = self.number()
        manifests = self._manifests(number)
        for change in changes:
            name = change["name"]
            held, before = self._manifest(name, number), self._manifest(name, change["base"])
            if number != change["base"] and held is not None:
                self._refuse_clashes(change, held, before)
            at = f"{name}/manifest-{uuid.uuid4().hex}"
            made = change["made"]
            gone = F.col("file").isin(change["gone"])
            slots = change["slots"]
            parts: dict[str, DataFrame | None] = {"files": None if made is None else made[0], "filters": None if made is None else made[1]}
            if held is not None:
                slots = slots.select("slot", "n", "d1", "d2").unionByName(self._slots(name, held))
                for part, old in (("files", held[0].where(~gone)), ("filters", held[2].where(~gone))):
                    parts[part] = old if parts[part] is None else old.unionByName(parts[part])
            slots = slots.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(c).cast("decimal(38,0)").alias(c) for c in ("d1", "d2"))).where("n <> 0")
            slots = slots.withColumn("version", F.lit(len(self.migrations.get(name, []))))
            slots.coalesce(1).write.parquet(f"{self.path}/{at}/slots")
            for part, df in parts.items():
                df.write.parquet(f"{self.path}/{at}/{part}")
            manifests[name] = at
        fresh = f"{self.path}/fresh-{uuid.uuid4().hex}"
        out = self._fs.create(self._jpath(fresh), False)
        out.write(bytearray(json.dumps(manifests, sort_keys=True).encode()))
        out.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 0)
        try:  # refuses to replace a pointer that is there
            self._context.rename(self._jpath(fresh), self._jpath(f"{self.path}/pointer-{number + 1:012d}"), none)
        except Exception as e:
            self._fs.delete(self._jpath(fresh), False)
            if self.number() > number:
                return self._commit(changes)
            raise OSError(f"{self.path}: no pointer could be made") from e
        return True

    def _refuse_clashes(self, change: dict, held: tuple, before: tuple | None) -> None:
        """Refuse a change whose files have gone since, or whose slots another writer has added rows to."""
        now, then = held[0].select("file"), None if before is None else before[0].select("file")
        there = now.where(F.col("file").isin(change["gone"])).count()
        if there < len(change["gone"]):
            raise Conflict(f"{change['name']}: a file to be replaced was replaced by another writer")
        other = held[0] if then is None else held[0].join(then, "file", "left_anti")
        theirs = other.select(F.explode(F.sequence("low.slot", "high.slot")).alias("slot")).distinct()
        if not change["slots"].select("slot").join(theirs, "slot", "left_semi").isEmpty():
            raise Conflict(f"{change['name']}: another writer added rows to the same slots")

    def merge(self, name: str, new: DataFrame, keep: list[str] = ()) -> bool:
        """Put the rows of ``new`` in place of those with the same keys; columns in ``keep`` hold their old values. False if nothing changes."""
        return self._commit([self._merged(name, new, list(keep), self.number())])

    def _appended(self, name: str, new: DataFrame, number: int) -> dict | None:
        new = shared.stash(new, "new")
        return None if new.isEmpty() else self._change(name, number, [], new, digests(new.withColumn("slot", slot_of(self.by[name])), ["slot"]))

    def change(self, merged: dict[str, DataFrame], appended: dict[str, DataFrame]) -> bool:
        """Merge into some tables and add rows with new keys to others, all at once. What is appended is not looked up."""
        number = self.number()
        return self._commit([*(self._merged(n, df, [], number) for n, df in merged.items()), *(self._appended(n, df, number) for n, df in appended.items())])

    def hit(self, name: str, asked: DataFrame) -> list[tuple[str, int]]:
        """Files with slots that ``asked`` (the columns that a slot hashes) has."""
        held = self._manifest(name, self.number())
        if held is None:
            return []
        slots = asked.select(slot_of(self.by[name]).alias("slot")).distinct()
        spread = held[0].select("file", "version", F.explode(F.sequence("low.slot", "high.slot")).alias("slot"))
        return sorted((r.file, r.version) for r in spread.join(slots, "slot").select("file", "version").distinct().collect())

    def lookup(self, name: str, asked: DataFrame) -> DataFrame | None:
        """The rows of a table for ``asked`` (the columns that a slot hashes, others ignored), from the files that may hold them; None if none does."""
        by = self.by[name]
        rows = self._rows(name, self.hit(name, asked))
        return None if rows is None else rows.join(asked.select(*by).distinct(), by, "left_semi")

    def write(self, name: str, df: DataFrame) -> bool:
        """Make ``df`` the whole table; False if nothing changes."""
        return self.publish({name: df})

    def publish(self, tables: dict[str, DataFrame], then_append: dict[str, DataFrame] | None = None) -> bool:
        """Make each of ``tables`` the whole of the table of its name, all at once; False if nothing changes. ``then_append``: rows with new keys, added
        to other tables in the same step if anything changes."""
        number = self.number()
        changes = [c for c in (self._replaced(name, df, number) for name, df in tables.items()) if c]
        if changes:
            changes += [self._appended(name, df, number) for name, df in (then_append or {}).items()]
        return self._commit(changes)

    def changed(self, name: str, df: DataFrame) -> bool:
        """Whether ``df`` has other rows than the table, each as often as it stands. Reads digests of the table only."""
        held = self._manifest(name, self.number())
        now = digests(df.withColumn("slot", slot_of(self.by[name])), ["slot"])
        return not now.isEmpty() if held is None else not differing(shared.stash(now, "digests"), self._slots(name, held)).isEmpty()

    def changes(self, name: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows that the table has and ``df`` has not, and the other way, each as often as it stands; only slots that differ are read."""
        slot, held = slot_of(self.by[name]), self._manifest(name, self.number())
        rows = df.withColumn("slot", slot)
        if held is None:
            return df.limit(0), df
        unlike = F.broadcast(shared.stash(differing(shared.stash(digests(rows, ["slot"]), "digests"), self._slots(name, held)), "unlike"))
        spread = held[0].select("file", "version", F.explode(F.sequence("low.slot", "high.slot")).alias("slot"))
        old = self._rows(name, sorted((r.file, r.version) for r in spread.join(unlike, "slot").select("file", "version").distinct().collect()))
        new = rows.join(unlike, "slot", "left_semi").drop("slot")
        if old is None:
            return df.limit(0), new
        old = old.select(*df.columns).withColumn("slot", slot).join(unlike, "slot", "left_semi").drop("slot")
        return old.exceptAll(new), new.exceptAll(old)

    def compact(self, name: str) -> bool:
        """Put files of under half of ``rows_per_file`` together; False if there are fewer than two. The rows stay as they are."""
        number = self.number()
        held = self._manifest(name, number)
        small = [] if held is None else sorted((r.file, r.version) for r in held[0].where(F.col("rows") * 2 < self.rows_per_file).select("file", "version").collect())
        if len(small) < 2:
            return False
        rows = self._rows(name, small)
        return self._commit([self._change(name, number, small, rows, digests(rows.limit(0).withColumn("slot", slot_of(self.by[name])), ["slot"]))])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what the last ``keep`` states do not use: pointers, manifests and files; the paths that went. No other writer may be at work."""
        last = self.number()
        held = range(max(1, last - keep + 1), last + 1)
        used = {f"{self.path}/{f}" for n in held for name in self._manifests(n) for f in self.files(name, n)}
        used_manifests = {at for n in held for at in self._manifests(n).values()}
        gone = []

        def drop(path: str) -> None:
            self._fs.delete(self._jpath(path), True)
            gone.append(path)

        for n in range(1, max(1, last - keep + 1)):
            if self._fs.exists(self._jpath(f"{self.path}/pointer-{n:012d}")):
                drop(f"{self.path}/pointer-{n:012d}")
        for name in self.keys:
            for entry in self._fs.globStatus(self._jpath(f"{self.path}/{name}/*")) or []:
                folder = f"{name}/{entry.getPath().getName()}"
                if "/manifest-" in folder:
                    if folder not in used_manifests:
                        drop(f"{self.path}/{folder}")
                    continue
                for file in self._fs.globStatus(self._jpath(f"{self.path}/{folder}/part-*")) or []:
                    if f"{self.path}/{folder}/{file.getPath().getName()}" not in used:
                        drop(f"{self.path}/{folder}/{file.getPath().getName()}")
        return gone
