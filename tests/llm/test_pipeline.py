from collections import Counter

import corpus_pipeline as P
from tests.llm.helpers import DOC, SF, no_documents, odd_documents
from tracelode.llm.common import table
from tracelode.sources import tables


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    before = {r["doc_id"]: r for r in docs.collect()}
    out, seen = docs, {}
    for name, stage in P.STAGES:
        out = stage(spark, out, SF)
        if name != "packing":
            assert out.columns == docs.columns
            seen[name] = out.collect()
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").collect() if r["toxic"] == 1}
    kept = {r["doc_id"] for r in seen["toxicity"]}
    assert len(kept) > 0.7 * len(before) and len(toxic & kept) <= 0.5 * len(toxic)
    assert {r["doc_id"] for r in seen["near_dedup"]} <= kept and len({r["text"] for r in seen["near_dedup"]}) == len(seen["near_dedup"])
    assert {r["doc_id"] for r in seen["secrets"]} == {r["doc_id"] for r in seen["near_dedup"]}
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secrets"]) and max(Counter(r["doc_id"] for r in seen["mixing"]).values()) <= 3
    words = Counter()
    for r in seen["mixing"]:
        words[r["doc_id"]] += len(r["text"].split())
    packed = Counter()
    for r in out.collect():
        packed[r["doc_id"]] += r["length"]
    assert +packed == +words


def test_odd_input(spark, tmp_path):
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    for i, docs in enumerate((odd_documents(spark).select("doc_id", "text", "lang", "source", "n_chars"), no_documents(spark))):
        docs.write.parquet(f"{tmp_path}/{i}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{i}/labels.parquet")
        rows = P.run(spark, f"{tmp_path}/{i}").collect()
        assert bool(rows) == (i == 0)
    assert spark.createDataFrame([], DOC).columns == table(spark, SF, "documents").columns


def test_stages_read_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = P.run(spark, SF).count()
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert rows > 0 and left & {name for name, _ in P.STAGES} == {"packing"}


def test_registered(spark):
    import __spark_entry__ as entry

    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert entry.queries()["pipeline"](spark, SF).count() > 0
