"""Versioned tables: bucketed Parquet under a log of manifests, with copy-on-write changes, snapshot reads and transactions over several tables.

A key's hash says which bucket holds its row. A change rewrites the buckets that its keys fall into and leaves the files of all others as they are; a manifest lists, for every table, the folder of each bucket. Version n is
the file ``n.json`` of the log. It is written aside and put in place only if no such file is there, so of two writers one commits and the other tries again on top of it, redoing only the tables whose buckets the
first has changed. Files that no manifest names, as those of a writer that died before its commit, are never read, and ``vacuum`` deletes them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import saved

#: (rows of the touched buckets, changes) to the new rows of those buckets; both have the key.
Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """A transaction found new versions at every try."""


@dataclass(frozen=True)
class Change:
    """``rows``: any columns that hold the table's key; ``merge``: how they change the rows of the buckets they fall into."""

    rows: DataFrame
    merge: Merge


def upsert(key: str) -> Merge:
    """Whole rows of the change take the place of rows with the same key."""
    return lambda old, new: old.join(new.select(key), key, "left_anti").unionByName(new)


def removal(key: str) -> Merge:
    """Rows with the keys of the change go."""
    return lambda old, gone: old.join(gone.select(key), key, "left_anti")


class _Files:
    """What a log needs of a file system, through Hadoop's, so that any store that Spark writes to will do."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getScheme() == "file"

    def _at(self, name: str):
        return self.path(f"{self.root}/{name}")

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(folder))] if self.fs.exists(self._at(folder)) else []

    def create(self, name: str, text: str) -> bool:
        """Puts a whole file in place, unless one is there: by a hard link on a local file system, whose rename would overwrite, elsewhere by rename, which then fails."""
        aside = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(aside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.local:
                plain = lambda n: urlparse(self.root).path + "/" + n
                os.link(plain(aside), plain(name))
                return True
            return not self.fs.exists(self._at(name)) and self.fs.rename(self._at(aside), self._at(name))
        except FileExistsError:
            return False
        finally:
            self.fs.delete(self._at(aside), False)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Snapshot:
    """The tables of one version; later commits don't change what it reads."""

    def __init__(self, store: Store, version: int, tables: dict) -> None:
        self.store, self.version, self.tables = store, version, tables

    def table(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows of a table, or of some of its buckets, which alone are listed and read then."""
        meta, spark = self.tables[name], self.store.spark
        schema = StructType.fromJson(meta["schema"])
        paths = sorted({f"{self.store.root}/data/{p}" for b, p in meta["paths"].items() if buckets is None or int(b) in set(buckets)})
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        """Rows of the keys in ``keys``, from the buckets that can hold them."""
        key = self.tables[name]["key"]
        wanted = keys.select(key).distinct()
        return self.table(name, self.store.touched(wanted, self.tables[name])).join(wanted, key, "left_semi")


class Store:
    """Tables below ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), _Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("log") if n.endswith(".json") and not n.startswith("."))

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The latest version, or any that the log still has; version 0 is without tables."""
        known = self.versions()
        at = version if version is not None else (known[-1] if known else 0)
        if not at:
            return Snapshot(self, 0, {})
        if at not in known:
            raise ValueError(f"no version {at}; there are {known}")
        return Snapshot(self, at, json.loads(self.files.read(f"log/{at}.json")))

    @staticmethod
    def _bucket(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def touched(self, rows: DataFrame, meta: dict) -> list[int]:
        """The buckets that rows fall into: at most as many numbers as the table has buckets."""
        return sorted(r["b"] for r in rows.select(self._bucket(meta["key"], meta["buckets"]).alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, meta: dict, touched: list[int]) -> dict[str, str]:
        """Writes the rows of buckets, one folder each; several tasks share a bucket, as its rows may be many."""
        folder, spread = uuid.uuid4().hex, 4
        key = meta["key"]
        placed = rows.withColumn("__bucket", self._bucket(key, meta["buckets"])).repartition("__bucket", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(spread)))
        placed.write.partitionBy("__bucket").parquet(f"{self.root}/data/{folder}")
        made = {n.split("=")[1] for n in self.files.names(f"data/{folder}") if n.startswith("__bucket=")}
        if strange := made - {str(b) for b in touched}:
            raise ValueError(f"a merge made rows of buckets that its changes don't touch: {sorted(strange)}")
        return {b: f"{folder}/__bucket={b}" for b in made}

    def create(self, name: str, schema: StructType, key: str, buckets: int = 64) -> int:
        """An empty table; its number of buckets is fixed from here on: rows at full size over what one task can rewrite."""
        if key not in schema.fieldNames() or buckets < 1:
            raise ValueError("the key must be a column, and there must be a bucket")
        while True:
            base = self.snapshot()
            if name in base.tables:
                raise ValueError(f"{name} is there already")
            meta = {"schema": json.loads(schema.json()), "key": key, "buckets": buckets, "paths": {}}
            if self._commit(base.version + 1, base.tables | {name: meta}):
                return base.version + 1

    def _commit(self, version: int, tables: dict) -> bool:
        return self.files.create(f"log/{version}.json", json.dumps(tables, sort_keys=True))

    def transact(self, changes: dict[str, Change], tries: int = 20) -> int:
        """Applies changes to several tables as one version, all or none, and returns its number.

        A null key is an error. After a conflict a table is merged again only if one of its touched buckets has changed meanwhile, so writers of different buckets don't redo work.
        """
        staged: dict[str, Change] = {}
        done: dict[str, tuple[dict, dict[str, str]]] = {}
        for _ in range(tries):
            base = self.snapshot()
            tables = dict(base.tables)
            for name, change in changes.items():
                meta = base.tables[name]
                if name not in staged:
                    rows = saved(change.rows)
                    if not rows.filter(F.col(meta["key"]).isNull()).isEmpty():
                        raise ValueError(f"{name}: a key is null")
                    staged[name] = Change(rows, change.merge)
                touched = self.touched(staged[name].rows, meta)
                before = {str(b): meta["paths"].get(str(b)) for b in touched}
                if name not in done or done[name][0] != before:
                    schema = StructType.fromJson(meta["schema"])
                    merged = change.merge(base.table(name, touched), staged[name].rows)
                    done[name] = before, self._write(merged.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in schema)), meta, touched)
                kept = {b: p for b, p in meta["paths"].items() if b not in before}
                tables[name] = meta | {"paths": kept | done[name][1]}
            if self._commit(base.version + 1, tables):
                return base.version + 1
        raise Conflict(f"no commit in {tries} tries")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes manifests but the last ``keep`` and the data that these don't name; no writer may be at work, as its files aren't named yet. Returns the deleted data folders."""
        known = self.versions()
        for version in known[: max(0, len(known) - keep)]:
            self.files.delete(f"log/{version}.json")
        named = {p for v in known[-keep:] for meta in self.snapshot(v).tables.values() for p in meta["paths"].values()}
        gone = []
        for folder in self.files.names("data"):
            for part in self.files.names(f"data/{folder}"):
                if part.startswith("__bucket=") and f"{folder}/{part}" not in named:
                    self.files.delete(f"data/{folder}/{part}")
                    gone.append(f"{folder}/{part}")
            if not any(p.startswith(f"{folder}/") for p in named):
                self.files.delete(f"data/{folder}")
        return gone
