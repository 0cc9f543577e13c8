import math

import numpy as np
import pytest

from tests.llm.helpers import SF
from tracelode.llm import ann as A
from tracelode.llm.common import table


def exact(ids, x, queries, k):
    """(query, rank, id) by products in double precision."""
    out = {}
    for q, v in queries:
        score = (x * v).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if ids[i] != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[q] = [(ids[i], score[i]) for i in order]
    return out


def recall(rows, want):
    hits = total = 0
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    for q, best in want.items():
        own = [got.get(q, {})[i + 1] for i in range(len(got.get(q, {})))]
        assert len(own) == len(best)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in own} & {v for v, _ in best})
        total += len(best)
    return hits / max(1, total)


def test_recall_on_the_table(spark):
    sf = SF.replace("0.001", "0.1")
    rows = table(spark, sf, "embeddings").collect()
    ids, x = [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)
    asked = [(i, v) for i, v in zip(ids, x, strict=True) if i % 20 == 0]
    got = A.op2_ann(spark, sf).collect()
    want = exact(ids, x, asked, A.K)
    assert recall(got, want) >= 0.98
    of = dict(zip(ids, x, strict=True))
    for r in got[:500]:
        assert r["score"] == pytest.approx(float((of[r["vec_id"]] * of[r["query_id"]]).sum()), rel=1e-12)


def test_several_cells_and_a_hot_vector(spark, monkeypatch):
    monkeypatch.setattr(A, "ENTRIES_A_CELL", 100)
    monkeypatch.setattr(A, "QUERIES", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 15)) + rng.normal(size=(6, 15))[rng.integers(0, 6, 900)] * 2
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = A.search(vectors, vectors.filter("vec_id % 20 = 0"), 10).collect()
    assert recall(got, exact(list(range(900)), x, [(i, x[i]) for i in range(0, 900, 20)], 10)) >= 0.95


def test_many_more_cells_than_a_query_once_visited(spark, monkeypatch):
    """Unit vectors without clusters in 300 blocks: no row is out of a query's reach."""
    monkeypatch.setattr(A, "ENTRIES_A_CELL", 10)
    monkeypatch.setattr(A, "QUERIES", 50)
    x = np.random.default_rng(8).normal(size=(3_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = A.search(vectors, vectors.filter("vec_id % 20 = 0")).collect()
    assert recall(got, exact(list(range(3_000)), x, [(i, x[i]) for i in range(0, 3_000, 20)], A.K)) >= 0.98


def test_odd_vectors(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, []), (None, [1.0, 2.0]), (7, [1.0, 2.0, 3.0])]
    good = [(20, [1.0, 0.0]), (40, [2.0, 0.0]), (40, [2.0, 0.0]), (61, [0.0, 1.0])]
    vectors = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in A.search(vectors, vectors.filter("vec_id % 20 = 0")).collect()}
    assert got == {(20, 1): (40, 2.0), (20, 2): (61, 0.0), (40, 1): (20, 2.0), (40, 2): (61, 0.0)}
    assert A.search(vectors.limit(0), vectors.limit(0)).count() == 0
    assert A.search(vectors.filter("vec_id < 7"), vectors).count() == 0


def test_parallel_error_weighs_more():
    """Quantised with the weight, the error along the vectors is smaller than without."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 16))
    books = A.train(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)

    def along(codes):
        back = np.hstack([books[j][codes[:, j]] for j in range(len(books))])
        return np.abs(((x - back) * unit).sum(axis=1)).mean()

    assert along(A.encode(x, books)) < 0.6 * along(A.encode(x, books, passes=0))


def test_scan_adds_table_values():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(300, 13)), rng.normal(size=(5, 13))
    books = A.train(x, rounds=1)
    codes = A.encode(x, books)
    back = np.hstack([books[j][codes[:, j]] for j in range(len(books))])[:, :13]
    assert np.allclose(A.scan(A.tables(q, books), A.packed(codes)), q @ back.T, atol=1e-4)


def test_clashing_columns_and_many_rows_of_one_id(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 8))
    rows = [(i, x[i].tolist()) for i in range(60)] + [(7, x[7].tolist())] * 3_000 + [(100 + i, x[3].tolist()) for i in range(2_000)] + [(9, x[11].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    wide = df
    for name in ("v", "q", "same", "ids", "codes", "part", "block", "query_id", "rank", "score", "nth", "d"):
        wide = wide.withColumn(name, df.vec_id)
    asked = df.filter("vec_id in (0, 3, 9)")
    got = A.search(wide, wide.filter("vec_id in (0, 3, 9)"), 5).collect()
    want = A.search(df, asked, 5).collect()
    key = lambda rs: sorted(map(tuple, rs))
    assert key(got) == key(want)
    for q in (0, 3, 9):
        vector = min(v for i, v in rows if i == q)
        score = sorted({(-float((np.array(v) * np.array(vector)).sum()), i) for i, v in rows if i != q})[:5]
        own = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [i for _, i in own] == [i for _, i in score]
