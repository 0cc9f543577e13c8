import hashlib
import tarfile
import zlib

import pytest

from tests.llm.helpers import documents, no_documents, odd_documents
from tracelode.llm import media as M


def held(docs, folder):
    rows = M.media_columns(docs, folder).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=str)
    want = []
    for d, t in texts:
        raw = t.encode()
        data = raw + b" " * (-len(raw) % 192 if raw else 192)
        want.append((d, len(raw), len(data), hashlib.sha256(data).digest(), zlib.crc32(data[-16:]), f"png:192x{len(data) // 192}:8"))
    got = [(r["doc_id"], r["n_bytes"], r["payload_bytes"], bytes(r["payload_sha256"]), r["tail_crc32"], r["feature"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    return rows


def test_whole_table(spark, tmp_path):
    rows = held(documents(spark), f"file://{tmp_path}/m")
    of = {}
    for r in rows:
        assert of.setdefault(bytes(r["digest"]), (r["shard"], r["offset"], r["length"], r["media_sha256"])) == (r["shard"], r["offset"], r["length"], r["media_sha256"])


def test_shards_are_tar_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BYTES", 20_000)
    folder = f"file://{tmp_path}/m"
    index = M.store(documents(spark), folder)
    seen = set()
    for path in sorted((tmp_path / "m").glob("*.tar")):
        with tarfile.open(path) as t:
            for member in t.getmembers():
                data = t.extractfile(member).read()
                assert hashlib.sha256(M.from_png(data)).hexdigest() + ".png" == member.name
                seen.add((path.name, member.offset_data, member.size))
    assert {(r["shard"], r["offset"], r["length"]) for r in index.collect()} <= seen


def test_odd_rows(spark, tmp_path):
    held(odd_documents(spark), f"file://{tmp_path}/m")
    assert M.media_columns(no_documents(spark), f"file://{tmp_path}/n").count() == 0


def test_metadata_reads_headers_only(spark, tmp_path):
    """With the samples wiped out the metadata is the same."""
    folder = f"file://{tmp_path}/m"
    where = M.places(M.store(documents(spark), folder))
    rows = lambda: sorted((bytes(r["digest"]), r["feature"]) for r in M.metadata(where, folder).collect())
    before = rows()
    for r in where.collect():
        with open(tmp_path / "m" / r["shard"], "r+b") as f:
            f.seek(r["offset"] + M.HEADER)
            f.write(b"\0" * (r["length"] - M.HEADER))
    assert rows() == before
    with pytest.raises(Exception, match="damaged|Error"):
        M.read_payloads(where, folder).collect()


def test_other_readers_read_it():
    data = bytes(range(192)) * 3
    png = M.to_png(data)
    assert M.from_png(png) == data and M.header(png[: M.HEADER]) == "png:192x3:8"
