"""Versioned Parquet state: each run writes the next version and then swaps a pointer, so readers see whole versions only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import ALIASES, EVENTS

FORMAT = 2
TABLES = {
    "events": EVENTS,
    "aliases": ALIASES,
    "resource_cache": "url string, etag string, last_modified string, content_hash string, fetched_at timestamp",
    "model_cache": "cache_key string, result_json string, created_at timestamp",
    "runs": "run_id string, source_id string, started_at timestamp, finished_at timestamp, coverage string, events_seen long, notes string, created long, updated long, cancelled long",
}


class State:
    """A state folder on any file system that Spark writes to. The pointer is a file named by version number."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that were committed, in order."""
        root = self._path(f"{self.folder}/commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(root) if s.getPath().getName().isdigit()) if self._fs.exists(root) else []

    def read(self, table: str) -> DataFrame:
        """The current rows of a table; migrated to today's columns if an older format wrote them."""
        now = self.versions()
        if not now:
            return self.spark.createDataFrame([], TABLES[table])
        return migrate(self.spark.read.parquet(f"{self.folder}/{self._place(self._info(now[-1]), table)}"), table)

    @staticmethod
    def _place(info: dict, table: str) -> str:
        """Where a version has a table: what it took over stays where an earlier one wrote it."""
        return info.get("tables", {}).get(table, f"{info['data']}/{table}")

    def _info(self, version: int) -> dict:
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/commits/{version}").collect()))

    def commit(self, tables: dict[str, DataFrame], version: int | None = None) -> int:
        """Writes the given tables; the others stay those of the version before, where they lie. A version that is there already stays as it is."""
        done = self.versions()
        version = (done[-1] + 1 if done else 0) if version is None else version
        if version in done:
            return version
        data = f"data/{version}-{uuid.uuid4().hex[:8]}"
        before = self._info(done[-1]) if done else None
        places = {name: f"{data}/{name}" if name in tables or not before else self._place(before, name) for name in TABLES}
        for name, place in places.items():
            if place == f"{data}/{name}":
                (tables[name] if name in tables else self.read(name)).write.parquet(f"{self.folder}/{place}")
        mark = self._path(f"{self.folder}/commits/.{uuid.uuid4().hex}")
        out = self._fs.create(mark)
        out.write(bytearray(json.dumps({"data": data, "format": FORMAT, "tables": places}).encode()))
        out.close()
        if not self._fs.rename(mark, self._path(f"{self.folder}/commits/{version}")):
            raise RuntimeError(f"version {version} was committed by another run")
        return version


def migrate(rows: DataFrame, table: str) -> DataFrame:
    """Format 1 had no event_url: the address of the source stands in. Columns that are missing otherwise are null."""
    if table == "events" and "event_url" not in rows.columns:
        rows = rows.withColumn("event_url", F.col("source_url"))
    elif table == "events":
        rows = rows.withColumn("event_url", F.coalesce("event_url", "source_url"))
    schema = rows.sparkSession.createDataFrame([], TABLES[table]).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
