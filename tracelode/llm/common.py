"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import cut, release, shared_dir

__all__ = ["cut", "free_name", "hot_join", "numbered_copies", "release", "shared_dir", "small_batches", "table"]

HOT_ROWS, HOT_KEYS = 2_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int) -> DataFrame:
    """``left`` joined with ``right`` on ``on``, where ``right`` has one row a key and its column ``n`` says how many rows of
    ``left`` have that key, of ``rows`` in all. Keys of more than ``HOT_ROWS`` rows, and of more than ``rows / HOT_KEYS``, are
    hot; there are ``HOT_KEYS`` of them at most, so they are broadcast and their rows stay where they are. The rest is joined by shuffle.
    Both sides should be written tables, as they are read more than once."""
    limit = max(HOT_ROWS, rows // HOT_KEYS)
    if rows <= limit:
        return left.join(right, on)
    hot = right.filter(F.col(n) > limit)
    if hot.isEmpty():
        return left.join(right, on)
    rest = left.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return left.join(F.broadcast(hot), on).unionByName(rest.join(right.filter(F.col(n) <= limit), on))


def numbered_copies(df: DataFrame, name: str) -> DataFrame:
    """``df`` with equal rows numbered from 0 in the new column ``name``: rows that the input's files and their order don't change."""
    every = [F.col(f"`{c}`") for c in df.columns]
    counts = df.groupBy(*every).agg(F.count(F.lit(1)).alias(name))
    return counts.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1)))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the rows of an Arrow batch, as one row may hold a very long text."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores before it until no column of ``df`` (in any case) is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
