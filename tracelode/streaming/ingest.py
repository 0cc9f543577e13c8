"""Incremental ingestion: a stream of entry files, each batch a shard of raw rows, merged when it is asked for.

A batch is written under its number, so a batch that is repeated replaces itself: together with the
stream's checkpoint each file counts once. A unit is a file and its facts and edges may come in any order,
so units are whole within a batch and no state is kept between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import raw_tables
from ..operators.build import assemble
from ..schema import COLUMNS, ENTRY, Graph
from ..sources.entries import _frame, stream

RAW = {t: c for t, c in COLUMNS.items() if t != "names"} | {"aliases": "sym long, alias string"}


def _decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            rows = [(path, *one) for one in stream(bytes(content), tolerant=True)]
            if rows:
                yield _frame(rows)


def entry_stream(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Entries of the files that come into a folder."""
    source = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_a_batch)
    return source.schema("path string, modificationTime timestamp, length long, content binary").load(folder).select("path", "content").mapInPandas(_decoded, ENTRY)


def start(entries: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Ingests what is there and ends. File ids are local to a batch, so rows carry paths."""

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            raw = raw_tables(held)
            raw["xrefs"] = raw["xrefs"].join(raw["files"], "file").select("sym", "role", "path", "off")
            for name, df in raw.items():
                df.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            held.unpersist()

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph(spark: SparkSession, out: str) -> Graph:
    """The graph of all batches so far."""
    from ..operators.build import file_ids

    raw = {name: spark.read.parquet(f"{out}/{name}").drop("batch") for name in RAW}
    files = file_ids(raw["files"].select("path"))
    xrefs = raw["xrefs"].join(files, "path").select("sym", "role", "file", "off")
    return assemble(**(raw | {"files": files.select("file", "path"), "xrefs": xrefs}))
