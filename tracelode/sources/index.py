"""A graph on disk: a folder of Parquet tables, each range-partitioned and sorted by its look-up key, so a
look-up reads the row groups that its key falls into. Tables that are looked up by another end too are there twice, and
trigrams narrow down searches for parts of names. A write makes a new folder of all tables inside the index's folder and then
replaces the pointer to the one that holds, in one step, so a reader sees the old index or the new one, never a part."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.resolve import likely, numbered, trigram_dictionary, trigram_postings
from ..schema import COLUMNS, SORTED, VERSION, Graph

#: The other ends of edges and names, as tables of their own: look-ups from either end read few row groups.
REVERSED = {"inhrev": ("inh", "parent", "child"), "crev": ("calls", "callee", "caller"), "nrev": ("names", "sym", "name")}
_POINTER = "current"


class Stored(Graph):
    """The graph of an index, with its tables by their other ends and its trigrams."""

    def __init__(self, spark: SparkSession, folder: str, counts: dict[str, int]) -> None:
        super().__init__(**{name: spark.read.schema(kinds).parquet(f"{folder}/{name}") for name, kinds in COLUMNS.items()})
        made = lambda name, kinds: spark.read.schema(kinds).parquet(f"{folder}/{name}")
        other = {(table, a): made(name, COLUMNS[table]) for name, (table, a, _) in REVERSED.items()}
        object.__setattr__(self, "other", other)
        object.__setattr__(self, "counts", counts)
        kinds = {"name_rows": "name string, sym long, row_id long", "trigram_post": "tri string, row_id long", "trigram_dict": "tri string, cnt long"}
        object.__setattr__(self, "trigrams", {n: made(n, k) for n, k in kinds.items()} if counts.get("trigram_dict") else {})

    def by(self, table: str, column: str) -> DataFrame:
        return self.other.get((table, column), getattr(self, table))

    def likely(self, needle: str) -> DataFrame | None:
        if not self.trigrams:
            return None
        return likely(self.trigrams["name_rows"], self.trigrams["trigram_post"], self.trigrams["trigram_dict"], needle, self.counts["names"])


def _write(df: DataFrame, path: str, order: list[str]) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write(g: Graph, path: str, trigrams: bool = True) -> None:
    """Writes a graph as the new state of the index at ``path``."""
    spark = g.spark
    state = f"state-{uuid.uuid4().hex}"
    work = f"{path.rstrip('/')}/{state}"
    for name, df in g.tables().items():
        _write(df, f"{work}/{name}", SORTED[name])
    for name, (table, a, b) in REVERSED.items():
        _write(spark.read.schema(COLUMNS[table]).parquet(f"{work}/{table}"), f"{work}/{name}", [a, b])
    names = list(COLUMNS)
    if trigrams:
        rows = numbered(spark.read.schema(COLUMNS["names"]).parquet(f"{work}/names"))
        _write(rows, f"{work}/name_rows", ["row_id"])
        postings = trigram_postings(spark.read.parquet(f"{work}/name_rows"))
        _write(postings, f"{work}/trigram_post", ["tri", "row_id"])
        _write(trigram_dictionary(spark.read.parquet(f"{work}/trigram_post")), f"{work}/trigram_dict", ["tri"])
        names += ["name_rows", "trigram_post", "trigram_dict"]
    counts = {name: spark.read.parquet(f"{work}/{name}").count() for name in names}  # of the files' footers
    _point(spark, path.rstrip("/"), json.dumps({"version": VERSION, "state": state, "counts": counts}))


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _point(spark: SparkSession, path: str, text: str) -> None:
    """Makes ``text`` the pointer of the index, in one step, and deletes states that neither it nor the one before names."""
    jvm, root, fs = _files(spark, path)
    old = _pointer(spark, path)
    new = jvm.org.apache.hadoop.fs.Path(root, f"{_POINTER}.{uuid.uuid4().hex}")
    out = fs.create(new)
    out.write(bytearray(text.encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    where.rename(fs.makeQualified(new), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(root, _POINTER)), options)
    kept = {json.loads(text)["state"], old and old["state"]}
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("state-") and name not in kept:
            fs.delete(status.getPath(), True)


def _pointer(spark: SparkSession, path: str) -> dict | None:
    jvm, root, fs = _files(spark, path)
    at = jvm.org.apache.hadoop.fs.Path(root, _POINTER)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def folder(spark: SparkSession, path: str) -> str:
    """Where the tables of the index are that holds now."""
    found = _pointer(spark, path.rstrip("/"))
    if found is None:
        raise FileNotFoundError(f"{path} is no index")
    if found["version"] != VERSION:
        raise ValueError(f"{path} has version {found['version']}, not {VERSION}")
    return f"{path.rstrip('/')}/{found['state']}"


def read(spark: SparkSession, path: str) -> Graph:
    """The graph of an index."""
    # values that verbs put into a plan are pushed to the scan one by one, not as their range
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "1024")
    return Stored(spark, folder(spark, path), _pointer(spark, path.rstrip("/"))["counts"])


def trigram_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """name rows, postings and dictionary of an index."""
    return tuple(spark.read.parquet(f"{folder(spark, path)}/{t}") for t in ("name_rows", "trigram_post", "trigram_dict"))


def missing_from(plan: DataFrame, done: DataFrame, key: str = "sha") -> DataFrame:
    """What of a plan isn't done."""
    return plan.join(done.select(key).distinct(), key, "left_anti")


def shard_numbers(names: list[str], stem: str) -> list[int]:
    """Numbers of the shards ``STEM.N`` among file names; there may be holes."""
    return sorted(int(n[len(stem) + 1 :]) for n in names if n.startswith(f"{stem}.") and n[len(stem) + 1 :].isdigit())


def count_rows(g: Graph) -> DataFrame:
    """table, n."""
    out = None
    for name, df in g.tables().items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out
