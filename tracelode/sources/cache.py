"""Incremental builds: raw rows kept by the digest of the unit that they came from.

A plan of units with digests is held against what is stored: units that are there are hits, the rest is
ingested and added under its digest, and digests that no unit of the plan has are pruned. The graph is
then the build over the stored rows of the plan's digests, however they came to be there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import assemble, file_ids, ranked
from ..operators.ingest import raw_tables
from ..schema import COLUMNS, Graph
from .tables import cut, release

#: Raw tables; xrefs carry paths, since file ids are given when a graph is assembled.
RAW = {t: c for t, c in COLUMNS.items() if t not in ("names", "files")} | {
    "aliases": "sym long, alias string",
    "xrefs": "sym long, role int, path string, off long",
    "paths": "path string",
}


class UnitCache:
    """A folder of raw tables, partitioned by digest."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def digests(self) -> DataFrame:
        """digest of every stored unit."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], "digest string")
        return self.spark.read.schema("digest string").parquet(self._path("manifest")).distinct()

    def misses(self, plan: DataFrame) -> DataFrame:
        """The units of a plan (with ``digest``) that aren't stored."""
        return plan.join(self.digests(), "digest", "left_anti")

    def store(self, entries: DataFrame, digests: DataFrame) -> None:
        """Stores units: their entries and their digests (cu_id, digest). The manifest is written last, so a
        unit counts only when all of its tables are there; units without entries aren't stored."""
        own = entries.join(digests, "cu_id").drop("cu_id").withColumnRenamed("digest", "cu_id").select(*entries.columns)
        tables = _by_unit(own)
        conf, old = "spark.sql.sources.partitionOverwriteMode", self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set(conf, "dynamic")
        try:
            for name, df in tables.items():
                df.write.mode("overwrite").partitionBy("digest").parquet(self._path(name))
            own.select(F.col("cu_id").alias("digest")).distinct().write.mode("append").parquet(self._path("manifest"))
        finally:
            self.spark.conf.set(conf, old)

    def graph(self, plan: DataFrame) -> Graph:
        """The graph of the plan's units."""
        wanted = plan.select("digest").distinct().join(self.digests(), "digest", "left_semi")
        raw = {}
        for name, kinds in RAW.items():
            if self._exists(name):
                df = self.spark.read.schema(f"{kinds}, digest string").parquet(self._path(name)).join(wanted, "digest", "left_semi").drop("digest")
            else:
                df = self.spark.createDataFrame([], kinds)
            raw[name] = df
        files = file_ids(raw.pop("paths")).select("file", "path")
        raw["xrefs"] = raw["xrefs"].join(files, "path").select("sym", "role", "file", "off")
        return assemble(files=files, **raw)

    def prune(self, plan: DataFrame) -> int:
        """Removes what no unit of the plan has; gives the number of removed units."""
        gone = [r["digest"] for r in self.digests().join(plan.select("digest"), "digest", "left_anti").collect()]  # names of folders to delete
        keep = self.spark.createDataFrame([(r["digest"],) for r in self.digests().join(plan.select("digest"), "digest", "left_semi").distinct().collect()], "digest string")
        keep.coalesce(1).write.mode("overwrite").parquet(self._path("manifest"))
        jvm = self.spark._jvm
        for digest in gone:
            for name in RAW:
                path = jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/digest={digest}")
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return len(gone)

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def _by_unit(entries: DataFrame) -> dict[str, DataFrame]:
    """Raw tables with the unit (``digest``) of each row."""
    raw = raw_tables(entries, keep_unit=True)
    files = raw.pop("files")
    raw["paths"] = raw.pop("paths")
    raw["xrefs"] = raw["xrefs"].join(files, "file").select("cu_id", "sym", "role", "path", "off")
    return {name: df.withColumnRenamed("cu_id", "digest").distinct() for name, df in raw.items()}


def build(spark: SparkSession, cache: UnitCache, plan: DataFrame, ingest: Callable[[DataFrame], DataFrame], every: int = 0, rows: int = 0, prune: bool = True) -> Graph:
    """An incremental build. ``plan``: cu_id, digest and whatever ``ingest`` needs to make entries of the missing units.
    Missing units are ingested and stored ``every`` so many (0: all at once), in the order of their digests, so that a run that is
    ended early goes on where it was. ``rows``: entries that a batch should have at most, by what units had so far (0: any number);
    a batch has one unit at least. ``ingest`` is asked once for each unit, and what it gives is written before it is read."""
    missing = cut(cache.misses(plan), "missing")
    left, most = missing.count(), every or 1 << 31
    number = ranked(missing.select("digest").distinct(), ["digest"])
    missing = cut(missing.join(number, "digest"), "numbered")
    done = 0
    while left > 0:
        batch = missing.filter((F.col("rank") >= done) & (F.col("rank") < done + most))
        held = batch.count()
        if not held:
            break
        own = cut(ingest(batch.drop("rank")), "entries")
        cache.store(own, batch.select("cu_id", "digest"))
        found = own.count()
        release(own)
        left, done = left - held, done + most
        if rows and found:
            most = max(1, min(every or 1 << 31, rows * held // found))
    if prune:
        cache.prune(plan)
    return cache.graph(plan)
