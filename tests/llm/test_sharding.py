import zlib
from collections import defaultdict

import pytest

from tests.llm.helpers import documents, no_documents, odd_documents
from tracelode.llm.sharding import SHARDS, shard


def held(docs):
    rows = shard(docs).collect()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(((d, len(t.encode()) + 1, zlib.crc32(t.encode())) for d, t in texts), key=str)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    for k, own in by.items():
        assert 0 <= k < SHARDS and sorted(r["slot"] for r in own) == list(range(len(own)))
    return rows, {k: sum(r["size"] for r in own) for k, own in by.items()}


def test_whole_table(spark):
    rows, size = held(documents(spark))
    assert max(size.values()) - sum(size.values()) / SHARDS <= 2 * max(r["size"] for r in rows)


@pytest.mark.parametrize("share", [0.0, 0.34, 1.0])
def test_hot_group_is_cut_and_others_are_not(spark, share):
    n = 6_000
    rows = [(i, "a hot text of many rows" if i < share * n else f"text {i // 2} and more") for i in range(n)]
    got, size = held(spark.createDataFrame(rows, "doc_id long, text string"))
    mean = sum(size.values()) / SHARDS
    assert len(size) == SHARDS and max(abs(s - mean) for s in size.values()) < 0.02 * mean
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in where.values()) <= 3 + (share > 0)


def test_odd_rows(spark):
    held(odd_documents(spark))
    assert shard(no_documents(spark)).count() == 0
    same = spark.createDataFrame([(1, "x")] * 500, "doc_id long, text string")
    _, size = held(same)
    assert max(size.values()) - min(size.values()) <= 4


def test_reruns_agree(spark):
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(shard(documents(spark)).collect()) == key(shard(documents(spark)).collect())


def test_layout_does_not_matter(spark):
    docs = documents(spark).select("doc_id", "text")
    docs = docs.union(docs.limit(60)).union(docs.limit(60)).union(docs.selectExpr("cast(null as long)", "text").limit(30))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = key(shard(docs))
    for n in (1, 7):
        assert key(shard(docs.repartition(n))) == want


def test_against_plain_placing(spark):
    """Shards and slots of a table without large records or hot texts, placed record by record in one order."""
    from pyspark.sql import functions as F

    from tracelode.llm import sharding as Sh

    docs = spark.createDataFrame([(i, f"text {i // 3} " + "x" * (i * 37 % 90)) for i in range(3_000)], "doc_id long, text string")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), F.xxhash64("doc_id", F.lit(0).cast("long")).alias("tie"), (F.octet_length("text") + 1).alias("size"))
    order = sorted((r["key"], r["tie"], r["doc_id"], r["size"]) for r in keyed.collect())
    total = sum(r[3] for r in order)
    group, at, want, slots = defaultdict(int), 0, {}, defaultdict(int)
    for key, _, _, size in order:
        group[key] += size
    start = {}
    for key, _, doc, size in order:
        assert group[key] <= Sh.WHOLE * total / SHARDS and size <= Sh.LARGE * total / SHARDS
        begin = start.setdefault(key, at)
        k = min(SHARDS - 1, int((begin + group[key] / 2) // (total / SHARDS)))
        want[doc] = (k, slots[k])
        slots[k] += 1
        at += size
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard(docs).collect()}
    assert got == want


def test_size_and_crc_as_in_sql(spark):
    import duckdb

    from tests.llm.helpers import SF
    from tracelode.llm.sharding import op8_sharding

    docs = duckdb.sql(f"select doc_id, octet_length(encode(coalesce(text, ''))) + 1 as size from '{SF}/documents.parquet'").fetchall()
    assert sorted(docs) == sorted((r["doc_id"], r["size"]) for r in op8_sharding(spark, SF).collect())
