"""Media columns: content-addressed payloads in tar shards.

A payload is a row of bytes. It is stored as an 8-bit greyscale PNG of ``WIDTH`` samples a row, in a
tar member that is named by the payload's SHA-256. Each task writes shards of about ``SHARD_BYTES``
into the shared folder and holds a digest once a shard; rows carry digest, shard, offset and length
of the stored bytes. Equal payloads of different shards resolve to the least (shard, offset), so all
rows of one digest refer to one place; what no row refers to is waste that a compaction may drop.

Metadata columns come from range reads of the first ``HEADER`` bytes of a member, never of its
samples. Samples are read back by range too, once a digest, shard by shard in order of offset.

A shard's name is unique to the attempt that wrote it, and the index is written before it is used: an
attempt that is repeated leaves an unused file, never a row without one.

Rows of a payload that very many rows have are joined with its place by broadcast, where they are.

Defined results: a null text is empty; an empty text is one row of spaces; equal texts have equal
values; rows that repeat are repeated, and ties of places don't matter, as equal payloads have equal bytes wherever they are; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, hot_join, shared_dir, small_batches, table

WIDTH = 192
SHARD_BYTES = 64 << 20
HEADER = 33  # the signature and the first chunk
LEVEL = 6  # of compression
_SIGN = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> bytes:
    """UTF-8 with spaces up to a positive multiple of ``WIDTH`` bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes) -> bytes:
    """Rows of ``WIDTH`` 8-bit grey samples, each with filter 0."""
    rows = len(samples) // WIDTH
    raw = b"".join(b"\0" + samples[i * WIDTH : (i + 1) * WIDTH] for i in range(rows))
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """The samples of ``to_png``'s form, checksums checked."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, packed, width = 8, [], 0
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, own = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + own) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            width = struct.unpack_from(">I", own)[0]
        elif kind == b"IDAT":
            packed.append(own)
        at += 12 + n
    raw = zlib.decompress(b"".join(packed))
    return b"".join(raw[i + 1 : i + 1 + width] for i in range(0, len(raw), width + 1))


def header(data: bytes) -> str:
    """What the first ``HEADER`` bytes tell: form, width, height, bits a sample."""
    width, height, bits = struct.unpack_from(">IIB", data, 16)
    return f"png:{width}x{height}:{bits}"


class _Writer:
    """Writes shards one after the other. The file system is found by the folder's address."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.folder, self.out = folder, None

    def put(self, digest: bytes, data: bytes) -> tuple[str, int]:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.at, self.held = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0, {}
        if digest in self.held:
            return self.name, self.held[digest]
        info = tarfile.TarInfo(f"{digest.hex()}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE))
        place = self.held[digest] = self.at + len(head)
        self.at += len(head) + len(data) + -len(data) % tarfile.BLOCKSIZE
        name = self.name
        if self.at >= SHARD_BYTES:
            self.close()
        return name, place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Stores the payload of every row of ``docs`` (doc_id, text) in shards below ``folder``: doc_id, digest, n_bytes,
    shard, offset, length. The index is written; it holds however often it is read. Digests are bytes."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = _Writer(folder)
        known: dict[bytes, tuple[str, int, int]] = {}
        for batch in batches:
            out = []
            for text in batch["text"]:
                data = payload(text)
                digest = hashlib.sha256(data).digest()
                if digest not in known:
                    if len(known) > 50_000:
                        known.clear()
                    png = to_png(data)
                    known[digest] = (*writer.put(digest, png), len(png))
                out.append((digest, len((text or "").encode("utf-8", "surrogatepass")), *known[digest]))
            rows = pd.DataFrame(out, columns=["digest", "n_bytes", "shard", "offset", "length"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), rows], axis=1)
        writer.close()

    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    index = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, digest binary, n_bytes long, shard string, offset long, length long")
    return cut(index, "media-index")


def places(index: DataFrame) -> DataFrame:
    """digest, shard, offset, length, rows: the one place of each payload, and how many rows have it."""
    place = F.min(F.struct("shard", "offset", "length"))
    return index.groupBy("digest").agg(place.alias("p"), F.count(F.lit(1)).alias("rows")).select("digest", "p.*", "rows")


def _ranges(fs: pyarrow.fs.FileSystem, root: str, batches: Iterator[pd.DataFrame], most: tuple[int | None, ...]) -> Iterator[tuple[pd.DataFrame, Iterator[tuple[bytes, ...]]]]:
    """For each row one read from its place for each of ``most``, of so many bytes at most; a shard stays open over its
    rows, and rows are read as they are asked for."""
    opened: dict[str, pyarrow.NativeFile] = {}

    def reads(batch: pd.DataFrame) -> Iterator[tuple[bytes, ...]]:
        for shard, offset, length in zip(batch["shard"], batch["offset"], batch["length"], strict=True):
            if shard not in opened:
                for file in opened.values():
                    file.close()
                opened.clear()
                opened[shard] = fs.open_input_file(f"{root}/{shard}")
            yield tuple(opened[shard].read_at(min(length, n or length), offset) for n in most)

    for batch in batches:
        yield batch, reads(batch)


def metadata(where: DataFrame, folder: str) -> DataFrame:
    """``where`` (digest, shard, offset, length) with ``feature``, from the headers alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch, got in _ranges(fs, root, batches, (HEADER,)):
            yield batch.assign(feature=[header(head) for (head,) in got])

    return _by_shard(where).mapInPandas(run, "digest binary, shard string, offset long, length long, feature string")


def read_payloads(where: DataFrame, folder: str) -> DataFrame:
    """digest, feature and what the stored bytes hold: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256.
    The header is a range read of its own, as in ``metadata``; both are done by one worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        for batch, got in _ranges(fs, root, batches, (HEADER, None)):
            out = []
            for digest, (head, png) in zip(batch["digest"], got, strict=True):
                data = from_png(png)
                out.append((digest, header(head), len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-16:]), len(png), hashlib.sha256(png).digest()))
            yield pd.DataFrame(out, columns=["digest", "feature", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])

    kinds = "digest binary, feature string, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary"
    return _by_shard(where).mapInPandas(run, kinds)


def _by_shard(where: DataFrame) -> DataFrame:
    """Neighbours in a shard in one task; a large shard's rows are dealt out in runs of offsets."""
    run = F.floor(F.col("offset") / F.lit(16 << 20))
    return where.select("digest", "shard", "offset", "length").repartition("shard", run).sortWithinPartitions("shard", "offset")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length and the columns of ``read_payloads`` for every row of ``docs`` (doc_id, text)."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    index = store(docs, folder)
    where = cut(places(index), "media-places")
    read = cut(read_payloads(where, folder).join(where, "digest"), "media-read")
    own = index.select("doc_id", "n_bytes", "digest")
    return hot_join(own, read, ["digest"], "rows", own.count()).drop("rows")


def _hex(name: str) -> Column:
    return F.lower(F.hex(name)).alias(name)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, offset, length."""
    out = media_columns(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", _hex("payload_sha256"), "tail_crc32", "media_bytes", _hex("media_sha256"), "feature", "offset", "length")
