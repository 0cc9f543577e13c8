"""Entry streams: files of length-delimited protocol-buffer records, one file one compilation unit.

``read`` decodes whole files in executors (``binaryFile`` and an Arrow map), strictly or up to the first
damage. ``EntryDataSource`` is the same reader as a named source: ``spark.read.format("entries")``.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.wire import WireError, field, fields, number, text, varint
from ..schema import ENTRY

#: Fixed value: no record is longer.
LONGEST = 256 << 20
_VNAME = {1: "signature", 2: "corpus", 3: "root", 4: "path", 5: "language"}
_ROWS = 20_000  # of a batch


def vname(data: bytes) -> dict[str, str]:
    out = dict.fromkeys(_VNAME.values(), "")
    for n, _, value in fields(data, only_bytes=True):
        if n in _VNAME:
            out[_VNAME[n]] = text(value)
    return out


def entry(data: bytes) -> tuple[dict, str, dict, str, bytes]:
    """source, edge_kind, target, fact_name, fact_value of a record."""
    source, target, edge, name, value = dict.fromkeys(_VNAME.values(), ""), dict.fromkeys(_VNAME.values(), ""), "", "", b""
    for n, _, own in fields(data, only_bytes=True):
        if n == 1:
            source = vname(own)
        elif n == 2:
            edge = text(own)
        elif n == 3:
            target = vname(own)
        elif n == 4:
            name = text(own)
        elif n == 5:
            value = own
    return source, edge, target, name, value


def stream(data: bytes, tolerant: bool = False) -> Iterator[tuple]:
    """The entries of a file. ``tolerant``: damage ends it; otherwise damage is an error."""
    at = 0
    while at < len(data):
        try:
            n, start = varint(data, at)
            if n > LONGEST or start + n > len(data):
                raise WireError("a record ends early or is too long")
            yield entry(data[start : start + n])
            at = start + n
        except WireError:
            if tolerant:
                return
            raise


def encode(source: dict, edge_kind: str = "", target: dict | None = None, fact_name: str = "", fact_value: bytes = b"") -> bytes:
    """One delimited record."""
    own = lambda v: b"".join(field(n, v[k]) for n, k in _VNAME.items() if v.get(k))
    body = field(1, own(source))
    body += field(2, edge_kind) if edge_kind else b""
    body += field(3, own(target)) if target else b""
    body += field(4, fact_name) if fact_name else b""
    body += field(5, fact_value) if fact_value else b""
    return number(len(body)) + body


def read(spark: SparkSession, *paths: str, tolerant: bool = False) -> DataFrame:
    """The entries of files or folders, with the file as ``cu_id``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for one in stream(bytes(content), tolerant):
                    rows.append((path, *one))
                    if len(rows) >= _ROWS:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInPandas(run, ENTRY)


def decode(spark: SparkSession, data: bytes, name: str = "-", tolerant: bool = False) -> DataFrame:
    """The entries of a stream that is at hand, such as the standard input: one unit, decoded here."""
    rows = [(name, *one) for one in stream(data, tolerant)]
    return spark.createDataFrame(rows, ENTRY)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["cu_id", "source", "edge_kind", "target", "fact_name", "fact_value"])


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class EntryReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options["path"].split(",") if p]
        self.tolerant = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        found = []
        for path in self.paths:
            fs, root = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
            info = fs.get_file_info(root)
            own = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
            scheme = path.split("://")[0] + "://" if "://" in path else ""
            found += [_File(scheme + f.path) for f in own if f.type == pafs.FileType.File]
        return sorted(found, key=lambda f: f.path) or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(partition.path) if "://" in partition.path else (pafs.LocalFileSystem(), partition.path)
        with fs.open_input_stream(root) as f:
            data = f.read()
        order = list(_VNAME.values())
        flat = lambda v: tuple(v[k] for k in order)
        for source, edge, target, name, value in stream(data, self.tolerant):
            yield partition.path, flat(source), edge, flat(target), name, value


class EntryDataSource(DataSource):
    """``spark.dataSource.register(EntryDataSource)``; options: path (several with commas), mode."""

    @classmethod
    def name(cls) -> str:
        return "entries"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return EntryReader(dict(self.options))


def write(path: str, entries: list[bytes]) -> None:
    with io.open(path, "wb") as f:
        f.writelines(entries)
