import random

import pytest
from pyspark.sql import functions as F

from tests.graphs import java, make
from tracelode.operators import build
from tracelode.operators.intervals import innermost
from tracelode.schema import FIELD, FUNCTION, TYPE, VARIABLE

BODIES = [
    ([(7, 0, 100, 1), (7, 40, 60, 2)], [((7, 50), 2), ((7, 10), 1), ((7, 70), 1)]),
    ([(3, 0, 10, 1), (3, 20, 30, 2)], [((3, 5), 1), ((3, 25), 2), ((3, 15), None)]),
    ([(4, 0, 100, 10), (5, 0, 100, 20), (5, 30, 70, 21), (6, 0, 100, 30)], [((5, 50), 21), ((5, 10), 20), ((4, 50), 10), ((6, 50), 30)]),
]


def around(spark, bodies, sites):
    b = spark.createDataFrame([(s, f, st, en) for f, st, en, s in bodies], "body long, file long, st long, en long")
    s = spark.createDataFrame([(i, f, o) for i, (f, o) in enumerate(sites)], "site long, file long, off long")
    got = {r["site"]: r["body"] for r in innermost(s, b, outer=True).collect()}
    assert innermost(s, b).count() == sum(v is not None for v in got.values())
    return [got[i] for i in range(len(sites))]


@pytest.mark.parametrize(("bodies", "probes"), BODIES)
def test_innermost(spark, bodies, probes):
    assert around(spark, bodies, [p for p, _ in probes]) == [w for _, w in probes]


def test_innermost_random(spark):
    rng = random.Random(3)
    bodies = [(rng.randint(0, 3), st, st + rng.choice([0, 1, 3, 50, 4000]), i) for i in range(300) for st in [rng.randint(0, 5000)]]
    sites = [(rng.randint(0, 3), rng.randint(-5, 6000)) for _ in range(300)]
    want = [min(((-st, en, s) for f, st, en, s in bodies if f == file and st <= off < en), default=(0, 0, None))[2] for file, off in sites]
    assert around(spark, bodies, sites) == want
    assert around(spark, [], sites[:2]) == [None, None]


def test_preferred_name(spark):
    best = lambda *n: spark.createDataFrame([(x,) for x in n], "name string").agg(build.best_name()).first()[0]
    assert best("kythe:a:b#c#d#e", "a.b.C", "a.b.Longer") == "a.b.C" and best("<>", "kythe:x") == "kythe:x" and best("", "<>") == "<>" and best("bb", "ba", "é") == "ba"


def test_refined_symbols(spark):
    rows = spark.createDataFrame([(1, 0, 0, "kythe:x#y"), (1, VARIABLE, 2, "kythe:x#y"), (1, FIELD, 0, ""), (1, 0, 0, "S.value"), (2, FUNCTION, 1, "f")], "sym long, kind int, lang int, name string")
    for parts in (1, 4):
        got = {r["sym"]: tuple(r)[1:] for r in build.refine(rows.repartition(parts)).collect()}
        assert got == {1: (FIELD, 2, "S.value"), 2: (FUNCTION, 1, "f")}


def test_aliases_of_variables_are_dropped(spark):
    syms = spark.createDataFrame([(1, VARIABLE, 1, "v"), (2, FUNCTION, 1, "f")], "sym long, kind int, lang int, name string")
    aliases = spark.createDataFrame([(1, "alias_v")] + [(2, "alias_f")] * 30 + [(2, "")], "sym long, alias string")
    assert sorted(r["name"] for r in build.name_rows(syms, aliases).collect()) == ["alias_f", "f", "v"]


def rows_of(g):
    return {n: sorted(map(tuple, df.collect())) for n, df in g.tables().items()}


def test_merge_does_not_depend_on_shards(spark):
    from dataclasses import replace

    g = java(spark)
    cut = lambda k: replace(g, **{n: df.filter(F.pmod(F.xxhash64(*df.columns), F.lit(2)) == k) for n, df in g.tables().items() if n not in ("syms", "names", "files")})
    whole = rows_of(g)
    assert rows_of(build.merge([cut(0), cut(1), g])) == whole
    assert rows_of(build.merge([build.merge([cut(1)]), cut(0)])) == whole
    again = replace(g, **{n: df.repartition(3).orderBy(F.rand(1)) for n, df in g.tables().items()})
    assert rows_of(build.merge([again])) == whole


def test_local_files_are_renumbered(spark):
    a = make(spark, syms=[("x", TYPE, 1)], files=[(0, "b"), (1, "z")], xrefs=[("x", 1, 0, 5), ("x", 2, 9, 1)])
    b = make(spark, syms=[("x", TYPE, 1)], files=[(0, "a"), (1, "b")], xrefs=[("x", 1, 1, 5), ("x", 2, 0, 7)])
    g = build.merge([a, b], local_files=True)
    assert sorted(map(tuple, g.files.collect())) == [(0, "a"), (1, "b"), (2, "z")]
    assert sorted((r["role"], r["file"], r["off"]) for r in g.xrefs.collect()) == [(1, 1, 5), (2, 0, 7)]


def test_ranks(spark):
    paths = [f"/p/{i % 7}/{i}" for i in range(500)]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {r["path"]: r["file"] for r in build.file_ids(rows).collect()}
    assert got == {p: i for i, p in enumerate(sorted(paths))}
    known = spark.createDataFrame([("/p/0/0", 41)], "path string, file long")
    more = {r["path"]: r["file"] for r in build.continued_ids(rows.limit(20), known).collect()}
    assert more["/p/0/0"] == 41 and sorted(more.values()) == list(range(41, 61))
