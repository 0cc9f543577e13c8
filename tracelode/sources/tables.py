"""Written tables that cut a lineage: computed once, columnar, and they outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where the cluster names one, or else the checkpoint folder
    that the program gave its context. Only where there is neither (tests on one machine) the context gets one of our own; a cluster must name one."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        context = spark.sparkContext
        if not context.getCheckpointDir():
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tracelode-"))
        place = context.getCheckpointDir()
    return place.rstrip("/")


def cut(df: DataFrame, what: str = "cut") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what ``cut`` wrote of ``frames``; for tables whose readers are written themselves."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def local(spark: SparkSession, rows: list[tuple], kinds: StructType | str) -> DataFrame:
    """A few rows as part of a plan: it knows their size, and no job makes them."""
    schema = kinds if isinstance(kinds, StructType) else _parse_datatype_string(kinds)
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    arrow = to_arrow_schema(schema)
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
    return spark.createDataFrame(table, schema)
