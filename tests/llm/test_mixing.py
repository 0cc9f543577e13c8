import re
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import documents, no_documents, odd_documents
from tracelode.llm import mixing as M


def targets(sizes):
    """By sharing out again and again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return fixed | share
        fixed |= {s: 3.0 * sizes[s] for s in over}


def held(docs, near):
    rows = M.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((r["doc_id"], size(r["text"])) for r in docs.collect())
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        assert 0 <= r["copies"] <= 3 and r["source_size"] is not None
    want = targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= near(want[s])
    return rows


def test_whole_table(spark):
    docs = documents(spark)
    rows = held(docs, lambda t: 0.05 * t)
    again = M.mix(docs.repartition(3)).collect()
    key = lambda rs: sorted((r["doc_id"], r["copies"]) for r in rs)
    assert key(rows) == key(again)


def test_many_rows_of_one_source(spark):
    rows = [(i, "w " * (1 + i * 7 % 90), "hot" if i % 3 else f"s{i % 5}") for i in range(9_000)]
    held(spark.createDataFrame(rows, "doc_id long, text string, source string"), lambda t: 0.002 * t + 2)


def test_odd_rows(spark):
    held(odd_documents(spark), lambda t: 30_000)
    assert M.mix(no_documents(spark)).count() == 0 and M.mix_documents(no_documents(spark)).count() == 0
    docs = odd_documents(spark)
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    plan, got = defaultdict(int), Counter(r["doc_id"] for r in out.collect())
    for r in M.mix(docs).collect():
        plan[r["doc_id"]] += r["copies"]
    assert {k: v for k, v in plan.items() if v} == dict(got)


def test_chances_follow_the_ranks(spark):
    """Over many ids, large documents are taken more often than small ones when a part of a source is taken."""
    rows = [(i, "w " * (1 if i % 2 else 3), "a" if i < 4000 else "b") for i in range(8_000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 3.0)).filter("source = 'a'").collect()
    share = lambda size: sum(r["copies"] for r in got if r["size"] == size) / sum(r["size"] == size for r in got)
    assert share(3) > 1.5 * share(1)


def test_documents_longer_than_the_rest(spark):
    """A document that doesn't fit leaves its room to all the small ones, wherever they rank."""
    rows = [(i, "w " * (100 + i * 7 % 101), "a") for i in range(4_000)] + [(5_000 + i, "w " * 200_000, "a") for i in range(5)]
    rows += [(6_000 + i, "w " * 150, "b") for i in range(10_000)]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 30.0)).filter("source = 'a'").collect()
    target = got[0]["target"]
    assert 90_000 < target < 110_000 and {r["size"] > target for r in got} == {True, False}
    assert abs(sum(r["size"] * r["copies"] for r in got) - target) <= 100


def test_clashing_names(spark):
    docs = documents(spark)
    for name in ("least", "most", "all", "total", "n", "row", "id", "of", "node", "times", "plan_id", "taken", "copies", "rank", "Size"):
        docs = docs.withColumn(name, docs.doc_id + 1)
    docs = docs.union(docs.limit(20))
    out = M.mix_documents(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r["least"] == r["doc_id"] + 1 for r in rows)
    assert Counter(r["doc_id"] for r in rows) == Counter({k: v for k, v in sum_copies(M.mix(docs).collect()).items() if v})


def test_many_equal_rows(spark):
    """One row that is repeated more often than a key may be joined by shuffle, with rows like it in all but another column."""
    many = [(None, "a b c", "x", 1)] * 5_000 + [(None, "a b c", "x", 2)] * 70
    rows = many + [(7, "d e", None, 1)] * 3 + [(i, f"w{i} " * (i % 9), "xyz"[i % 3], i) for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra long")
    for weights in ((5.0, 2.0, 1.0), (1.0, 1.0, 9.0, 3.0)):
        plan = Counter()
        for r in M.mix(docs, weights).collect():
            plan[r["doc_id"]] += r["copies"]
        out = M.mix_documents(docs, weights).collect()
        assert Counter(r["doc_id"] for r in out) == +plan
        times = Counter(tuple(r) for r in out)
        assert not set(times) - set(rows)
        held = Counter(rows)
        shares = [times[row] / held[row] for row in (many[0], many[-1])]
        # the rows of one document share its copies: each gets the same whole number, some one more
        whole = plan[None] // len(many)
        assert all(whole <= s <= whole + 1 for s in shares) and times[many[0]] + times[many[-1]] == plan[None]


def sum_copies(rows):
    out = Counter()
    for r in rows:
        out[r["doc_id"]] += r["copies"]
    return out


def test_against_plain_pareto_sampling(spark):
    """Documents by the odds of their number over the odds of their chance, taken while they fit; a few exchanges may follow."""
    from pyspark.sql import functions as F

    rows = [(i, "w " * (1 + i * 13 % 70), "a" if i < 3_000 else "b") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    u = {r["doc_id"]: r["u"] for r in docs.select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.xxhash64("text"), F.lit(11)), F.lit(1 << 40)) + 0.5) / float(1 << 40)).alias("u")).collect()}
    got = M.mix(docs, weights=(1.0, 3.0)).collect()
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        whole, part = divmod(own[0]["target"] / own[0]["source_size"], 1)
        rest, squares = part * own[0]["source_size"], sum(r["size"] ** 2 for r in own)
        odds = lambda p: p / (1 - p)
        rank = {r["doc_id"]: odds(u[r["doc_id"]]) / odds(min(0.999, rest * r["size"] / squares)) for r in own}
        left, taken = rest, set()
        for r in sorted(own, key=lambda r: rank[r["doc_id"]]):
            if r["size"] <= left:
                left -= r["size"]
                taken.add(r["doc_id"])
        more = {r["doc_id"] for r in own if r["copies"] > whole}
        assert all(r["copies"] in (whole, whole + 1) for r in own)
        assert len(more ^ taken) <= 2 * M.EXCHANGES
        assert abs(sum(r["size"] for r in own if r["doc_id"] in more) - rest) <= max(1.0, left)


def test_targets_as_in_sql(spark):
    """Sizes and sources' sizes of the query against SQL."""
    import duckdb

    from tests.llm.helpers import SF

    sql = f"with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size from '{SF}/documents.parquet') select doc_id, size, cast(sum(size) over (partition by source) as bigint) from d"
    assert sorted(duckdb.sql(sql).fetchall()) == sorted((r["doc_id"], r["size"], r["source_size"]) for r in M.op6_mixing(spark, SF).collect())
