import pytest

from tracelode.functions.scalar import sym_of
from tracelode.functions.wire import WireError
from tracelode.operators import ingest, resolve, verbs
from tracelode.plans.sample import Stream, named, stream, vname
from tracelode.schema import FIELD
from tracelode.sources import entries as E
from tracelode.sources import index
from pyspark.sql import functions as F


def encoded(s: Stream) -> list[bytes]:
    return [E.encode(src, edge, to if edge else None, name if not edge else "", value) for _, src, edge, to, name, value in s.rows]


def test_wire_round_trip():
    s = stream()
    got = list(E.stream(b"".join(encoded(s))))
    assert [(a, b, d if not b else "", e) for a, b, _, d, e in got] == [(src, edge, name if not edge else "", value) for _, src, edge, _, name, value in s.rows]


def test_damage(spark, tmp_path):
    good = encoded(stream())
    data = b"".join(good) + b"\xff\xff\xff\x7f12"
    with pytest.raises(WireError):
        list(E.stream(data))
    assert len(list(E.stream(data, tolerant=True))) == len(good)
    E.write(str(tmp_path / "a.entries"), [data])
    assert E.read(spark, str(tmp_path / "a.entries"), tolerant=True).count() == len(good)
    spark.dataSource.register(E.EntryDataSource)
    assert spark.read.format("entries").option("mode", "PERMISSIVE").load(str(tmp_path / "a.entries")).count() == len(good)


@pytest.fixture(scope="module")
def g(spark):
    return ingest.graph(stream().frame(spark))


def sites(g, name):
    return sorted((r["role"], r["file"], r["off"]) for r in verbs.refs(g, name).collect())


def test_definition_joins_its_declaration(g):
    assert sites(g, "Foo::bar") == [("decl", "foo.cpp", 200), ("decl", "foo.h", 100), ("def", "foo.cpp", 190)]


def test_calls_are_of_the_enclosing_body(g):
    rows = g.calls.join(g.syms.withColumnRenamed("sym", "caller").select("caller", "name"), "caller").collect()
    assert sorted((r["name"], r["role"]) for r in rows) == [("Foo::bar", 2), ("Foo::bar", 3)]
    assert sites(g, "Foo::helper") == [("call", "foo.cpp", 300), ("call", "foo.cpp", 500)]


def test_types_signatures_and_parents(g):
    assert [r["sig"] for r in verbs.signatures(g, "Foo::bar").collect()] == ["int bar(Box * w)"]
    assert {r["typed"] for r in g.typed.collect()} == {"Box *", "int(Box *)"}
    assert [r["name"] for r in verbs.supers(g, "Box").collect()] == ["Base"]
    assert [r["name"] for r in verbs.members(g, "Box").collect()] == ["Foo::helper"]


def test_order_of_entries_does_not_matter(spark, g):
    import random

    s = stream()
    random.Random(1).shuffle(s.rows)
    again = ingest.graph(s.frame(spark).repartition(3))
    for name, df in g.tables().items():
        assert sorted(map(tuple, again.tables()[name].collect())) == sorted(map(tuple, df.collect())), name


def test_fields_and_descriptors(spark):
    s, field = Stream(), vname("value", "S.java", "java")
    s.fact(field, "/kythe/node/kind", "variable").fact(field, "/kythe/subkind", "field").edge(field, "named", vname("S.value", language="jvm", corpus=""))
    method = vname("m", "S.java", "java")
    s.fact(method, "/kythe/node/kind", "function").edge(method, "named", vname("a.S.m(I)J", language="jvm", corpus=""))
    s.anchor("@f", "S.java", 42, 47, ("defines/binding", field))
    g = ingest.graph(s.frame(spark))
    assert g.syms.filter("name = 'S.value'").first()["kind"] == FIELD
    assert resolve.exact(g.names, "a.S.m").count() == 1 and resolve.exact(g.names, "a.S.m(I)J").count() == 1
    assert g.syms.filter("name = 'a.S.m'").count() == 1


def test_units_do_not_mix(spark):
    a, b = Stream("a"), Stream("b")
    decl, body = vname("#d"), vname("#b")
    a.edge(body, "completes", decl).anchor("@", "x.cc", 1, 2, ("defines/binding", body))
    b.anchor("@", "y.cc", 3, 4, ("defines/binding", body))
    raw = ingest.raw_tables(a.frame(spark).union(b.frame(spark)))
    ids = {r[0]: r[1] for r in spark.createDataFrame([("kythe:c++:c####d",), ("kythe:c++:c####b",)], "t string").select("t", sym_of(F.col("t"))).collect()}
    assert sorted((r["sym"], r["off"]) for r in raw["xrefs"].collect()) == sorted([(ids["kythe:c++:c####d"], 1), (ids["kythe:c++:c####b"], 3)])


def test_index_round_trip(spark, g, tmp_path):
    path = str(tmp_path / "x.index")
    index.write(g, path)
    index.write(g, path)
    back = index.read(spark, path)
    for name, df in g.tables().items():
        assert sorted(map(tuple, back.tables()[name].collect())) == sorted(map(tuple, df.collect())), name
    rows, posts, dictionary = index.trigram_tables(spark, path)
    assert rows.count() == g.names.count() and dictionary.agg(F.sum("cnt")).first()[0] == posts.count()
    assert sorted(index.shard_numbers(["o.3", "o.1", "o.x", "p.2"], "o")) == [1, 3]


def test_names_of_marked_source(spark):
    code = spark.createDataFrame([(named("a", "b"),), (None,)], "c binary")
    assert [r[0] for r in code.select(ingest.marked_name("c")).collect()] == ["a::b", None]


def test_streaming_equals_batch(spark, tmp_path):
    from tracelode.streaming import ingest as S

    (tmp_path / "in").mkdir()
    E.write(str(tmp_path / "in" / "a.entries"), encoded(stream()))
    run = lambda: S.start(S.entry_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    run()
    other = Stream().node(vname("#z"), "record", named("Zed")).anchor("@z", "z.cc", 9, 12, ("defines/binding", vname("#z")))
    E.write(str(tmp_path / "in" / "b.entries"), encoded(other))
    run()
    run()
    got = S.graph(spark, str(tmp_path / "out"))
    want = ingest.graph(E.read(spark, str(tmp_path / "in")))
    for name, df in want.tables().items():
        assert sorted(map(tuple, got.tables()[name].collect())) == sorted(map(tuple, df.collect())), name
