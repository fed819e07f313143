"""Several tables that change together, batch by batch.

Each batch writes folders of its own, and last a manifest that names all folders of all tables. Readers go by the newest manifest,
so they see all of a batch or nothing; a batch that failed half-way writes the same folders anew, and one that has its manifest
is left alone, so a repeated batch changes nothing. Only Spark's readers and writers touch the tables; one writer at a time.

A keyed table holds one row a key: its folders are a base and the changes since, and each ``every``-th batch merges them. A log
only grows; a record whose key it has already is dropped, in the batch and across batches. Both may be empty.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.operators.store import newest

MANIFEST = "batch long, tables map<string, array<string>>"


class Table(NamedTuple):
    schema: str
    key: list[str]
    log: bool = False


class TableSet:
    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], new: bool, every: int = 8):
        self.spark, self.path, self.tables, self.every = spark, path, tables, every
        if new:
            self._write_manifest(-1, {name: [] for name in tables})
        self.refresh()

    def refresh(self) -> None:
        """Goes to the newest manifest."""
        newest_ = self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/*").orderBy(F.desc("batch")).first()
        self.batch, self.folders = newest_.batch, {name: list(newest_.tables[name]) for name in self.tables}

    def _write_manifest(self, batch: int, folders: dict[str, list[str]]) -> None:
        self.spark.createDataFrame([(batch, folders)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{batch}")
        self.batch, self.folders = batch, folders

    def _stored(self, name: str, folders: list[str]) -> DataFrame:
        schema = f"{self.tables[name].schema}, gone boolean, batch long"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _merged(self, name: str, folders: list[str]) -> DataFrame:
        """The rows of a keyed table. The base isn't shuffled, as long as the keys changed since can be sent to it."""
        key = self.tables[name].key
        base, since = [f for f in folders if "/base-" in f], [f for f in folders if "/base-" not in f]
        changed = newest(self._stored(name, since), key, [F.desc("batch")])
        kept = self._stored(name, base).join(changed.select(key), key, "left_anti").select(changed.columns)
        return kept.unionByName(changed).where("NOT gone")

    def read(self, name: str) -> DataFrame:
        """A table as of the last committed batch; logs with the ``batch`` of each record."""
        if self.tables[name].log:
            return self._stored(name, self.folders[name]).drop("gone")
        return self._merged(name, self.folders[name]).drop("gone", "batch")

    def latest(self, name: str, key: list[str], order: list[str]) -> DataFrame:
        """The last record of each key of a log by ``order``; of equals the one that came last."""
        return newest(self.read(name), key, [*[F.desc(c) for c in order], F.desc("batch")])

    def commit(self, batch: int, rows: dict[str, DataFrame], gone: dict[str, DataFrame] | None = None) -> bool:
        """Applies rows (new or changed, or to be appended) and ``gone`` (keys that go) of each table; False if the batch is there already."""
        if batch <= self.batch:
            return False
        folders = {name: list(known) for name, known in self.folders.items()}
        for name in [n for n in self.tables if n in rows or n in (gone or {})]:
            table, columns = self.tables[name], self._stored(name, []).columns[:-2]
            parts = []
            if name in rows:
                own = rows[name].select(columns).dropDuplicates(table.key)
                if table.log and self.folders[name]:
                    own = own.join(self.read(name).select(table.key), table.key, "left_anti").select(columns)
                parts.append(own.withColumn("gone", F.lit(False)))
            if name in (gone or {}):
                parts.append(self._stored(name, []).drop("batch").unionByName(gone[name].select(table.key).distinct().withColumn("gone", F.lit(True)), allowMissingColumns=True))
            made, path = reduce(DataFrame.unionByName, parts), f"{self.path}/{name}/batch-{batch}"
            made.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(path)
            folders[name].append(path)
        for name in [n for n, t in self.tables.items() if not t.log and batch % self.every == self.every - 1 and folders[n]]:
            path = f"{self.path}/{name}/base-{batch}"
            self._merged(name, folders[name]).write.mode("overwrite").parquet(path)
            folders[name] = [path]
        self._write_manifest(batch, folders)
        return True

    def tidy(self) -> None:
        """Removes the folders of keyed tables that the newest manifest doesn't name any more; readers of older ones must be done."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in self.tables:
            place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            files = place.getFileSystem(conf)
            known = {f.rsplit("/", 1)[1] for f in self.folders[name]}
            for status in files.listStatus(place) if files.exists(place) else []:
                if status.getPath().getName() not in known:
                    files.delete(status.getPath(), True)
