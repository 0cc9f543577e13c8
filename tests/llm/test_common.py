import os

import pytest

from tests.llm.helpers import documents
from tracelode.llm import common as C


@pytest.mark.parametrize("hot", [0, 5_000])
def test_hot_join(spark, hot):
    rows = [(7, i) for i in range(hot)] + [(i % 100, i) for i in range(3_000)] + [(1_000, 1)]
    left = C.cut(spark.createDataFrame(rows, "k long, v long"))
    right = C.cut(left.filter("k < 1000").groupBy("k").count().withColumnRenamed("count", "n"))
    got = C.hot_join(left, right, ["k"], "n", left.count())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").collect()))
    assert ("Union" in got._jdf.queryExecution().toString()) == bool(hot)


def test_numbered_copies(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "a"), (None, "a"), (2, None)], "x long, y string")
    got = sorted(map(tuple, C.numbered_copies(rows, "nth").collect()), key=str)
    assert got == sorted([(1, "a", 0), (1, "a", 1), (None, "a", 0), (None, "a", 1), (None, "a", 2), (2, None, 0)], key=str)


def test_release(spark):
    df = C.cut(documents(spark).select("doc_id"))
    path = df.cut_at.removeprefix("file:")
    assert os.path.exists(path)
    C.release(df)
    assert not os.path.exists(path)
