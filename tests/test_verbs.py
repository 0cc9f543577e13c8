import pytest

from tests.graphs import hub, java, make, sym
from tracelode.operators import resolve, verbs, walk
from tracelode.schema import CALL, DEF, FIELD, FUNCTION, PACKAGE, TYPE
from tracelode.service import dispatch, repl


@pytest.fixture(scope="module")
def g(spark):
    return java(spark)


def test_stat(g):
    assert verbs.stat(g).first().asDict() == {"xrefs": 11, "syms": 7, "files": 3, "inhs": 2, "calls": 2}


def test_hits_are_capped(g):
    reply = dispatch(g, {"cmd": "ref", "name": "foo.Parent", "max_hits": 1})
    assert reply["total"] == 1 and reply["truncated"]
    assert dispatch(g, {"cmd": "ref", "name": "foo.Parent", "max_hits": 0})["total"] == 1
    assert not dispatch(g, {"cmd": "ref", "name": "foo.Parent"})["truncated"]


def test_definitions(g):
    reply = dispatch(g, {"cmd": "def", "name": "foo.Parent.helper"})
    (group,) = reply["groups"]
    assert group["sig"] == "void helper(int flags)" and group["rows"] == [{"role": "decl", "file": "/aosp/frameworks/base/core/java/foo/Parent.java", "off": 500}] and "typed" not in group
    assert dispatch(g, {"cmd": "def", "name": "foo.Parent", "in": "tests/"})["groups"] == []


def test_callers_are_sites(g):
    rows = verbs.callers(g, "foo.Parent.helper", not_in="tests/").collect()
    assert [(r["file"].rsplit("/", 1)[1], r["off"]) for r in rows] == [("MainChild.java", 600)]
    assert verbs.callers(g, "foo.Parent.helper", def_in="tests/").count() == 0


def test_related(g):
    assert [r["name"] for r in verbs.subs(g, "foo.Parent", in_="tests/").collect()] == ["foo.TestChild"]
    (row,) = verbs.supers(g, "foo.MainChild").collect()
    assert row["def"].endswith("Parent.java@100")


def test_members(g):
    assert verbs.members(g, "foo.Parent").count() == 2 and verbs.members(g, "foo.Parent.helper").count() == 0
    assert dispatch(g, {"cmd": "members", "name": "foo.Parent"})["container"] == "foo.Parent"


def test_walks(g):
    reply = dispatch(g, {"cmd": "callgraph", "name": "run", "substr": True, "direction": "down"})
    assert sum(n["hop"] == 0 for n in reply["nodes"]) >= 2
    names = lambda *a, **k: [r["name"] for r in sorted(walk.forest(g, *a, **k).collect(), key=lambda r: r["id"])]
    assert set(names("foo.Parent", "inh", direction="down")) == {"foo.Parent", "foo.MainChild", "foo.TestChild"}
    assert names("foo.Parent.helper", "calls", direction="up", not_in="tests/") == ["foo.Parent.helper", "foo.MainChild.run"]
    assert names("foo.Parent.helper", "calls", direction="sideways") == ["foo.Parent.helper"]
    assert names("nobody", "calls") == []


def test_stub_copies_are_one_signature(spark):
    t = "kythe:java:corpus#root#path/{}.java#{}"
    a, b, c = t.format("variantA/Bundle", "SIGHASH"), t.format("variantB/Bundle", "SIGHASH"), t.format("Other", "OTHERHASH")
    g = make(spark, syms=[(n, FUNCTION, 2) for n in (a, b, c)], files=[(1, "x")], xrefs=[(a, DEF, 1, 10), (b, DEF, 1, 20), (c, DEF, 1, 30)], sig=[(a, "f(byte[] value)"), (b, "f(byte[] value)"), (c, "f(int[] value)")])
    assert verbs.signatures(g, "corpus#root", substr=True, limit=50).count() == 2


@pytest.mark.parametrize("edges_on", ["least", "largest"])
def test_edges_of_all_copies(spark, edges_on):
    g = hub(spark, edges_on)
    up = {r["name"] for r in walk.inheritance(g, "p.Hub", direction="up").collect()}
    down = {r["name"] for r in walk.inheritance(g, "p.Hub", direction="down").collect()}
    roots = [r for r in walk.inheritance(g, "p.Hub", direction="both").collect() if r["hop"] == 0]
    assert {"p.Base", "p.Iface"} <= up and "p.Child" in down and len(roots) == 1
    calls = {r["name"] for r in walk.callgraph(g, "p.Hub.run", direction="both").collect()}
    assert {"p.App.main", "p.Helper.do"} <= calls


def test_anonymous_names(spark):
    t = "kythe:java:c#r#core/java/p/Anon.java#H"
    g = make(spark, syms=[(t, TYPE, 2), ("p.Base", TYPE, 2)], files=[(1, "core/java/p/Anon.java")], xrefs=[(t, DEF, 1, 4242)], inh=[(t, "p.Base")])
    assert [r["name"] for r in verbs.subs(g, "p.Base").collect()] == ["anon@core/java/p/Anon.java@4242"]


def test_members_of_containers_only(spark):
    g = make(spark, syms=[("C", TYPE, 1), ("C.f", FIELD, 1), ("C.m", FUNCTION, 1), ("C.n", FUNCTION, 1), ("m.p", FIELD, 1), ("pk", PACKAGE, 1)], childof=[("C", "C.f"), ("C", "C.m"), ("C", "C.n"), ("C.m", "m.p"), ("pk", "C")])
    assert verbs.members(g, "C").count() == 3 and verbs.members(g, "C.m").count() == 0 and verbs.members(g, "pk").count() == 1


def test_forest_shape(spark):
    g = make(spark, syms=[(n, FUNCTION, 1) for n in ("foo_a", "foo_b", "helper_a", "helper_b")], calls=[("foo_a", "helper_a", CALL), ("foo_b", "helper_b", CALL)])
    rows = sorted(walk.callgraph(g, "foo_", substr=True, direction="down").collect(), key=lambda r: r["id"])
    assert [r["parent"] for r in rows] == [None, None, 0, 1]


def test_substring_and_prefix(spark):
    g = make(spark, syms=[(n, TYPE, 1) for n in ("module.abcdef", "module.abcZZbcd", "module.zzzzzzz", "ABCD")])
    found = lambda n, **k: {r["sym"] for r in resolve.substring(g.names, n, k.pop("limit", 10), **k).collect()}
    assert found("abcd") == {sym("module.abcdef")} and found("abcd", ignore_case=True) == {sym("module.abcdef"), sym("ABCD")}
    assert found("") == set() and found("a", limit=0) == set()
    rows = resolve.numbered(g.names)
    posts = resolve.trigram_postings(rows)
    for needle in ("abcd", "zz", "module.", "nope", "ZZb"):
        got = resolve.substring(g.names, needle, 10, ignore_case=True, rows=resolve.candidates(rows, posts, needle))
        assert {r["sym"] for r in got.collect()} == found(needle, ignore_case=True)
    assert [r["name"] for r in resolve.prefix(g.names, "module.", 2).collect()] == ["module.abcZZbcd", "module.abcdef"]


def test_two_symbols_of_one_name(spark):
    g = make(spark, syms=[("x1", TYPE, 1), ("x2", TYPE, 1)], aliases=[("x1", "same"), ("x2", "same")])
    got = [r["sym"] % (1 << 64) for r in resolve.exact(g.names, "same").orderBy("seq").collect()]
    assert got == sorted(got) and len(got) == 2


def test_loop_goes_on_after_bad_lines(g):
    got = list(repl(g, ["", "not json", '{"cmd": "stat"}', '{"cmd": "nope", "name": "x"}', "[1]"]))
    assert len(got) == 4 and '"error"' in got[0] and '"xrefs": 11' in got[1] and '"error"' in got[2] and '"error"' in got[3]


def test_many_symbols_stay_a_plan(g, monkeypatch):
    """Looked up now or left in the plan, answers are the same."""
    asked = [
        lambda: verbs.define(g, "foo", substr=True),
        lambda: verbs.refs(g, "foo.Parent", def_in="core/"),
        lambda: verbs.subs(g, "foo.Parent", not_in="zzz"),
        lambda: verbs.members(g, "foo.Parent"),
        lambda: verbs.signatures(g, "helper", substr=True),
        lambda: walk.callgraph(g, "foo.Parent.helper", direction="both", not_in="zzz"),
    ]
    rows = lambda: [sorted(map(str, q().collect())) for q in asked]
    want = rows()
    monkeypatch.setattr(verbs, "PINNED", 0)
    assert rows() == want


def test_socket(g, tmp_path):
    import threading

    from tracelode.service import client_call, serve

    path = str(tmp_path / "s.sock")
    ready = threading.Event()
    threading.Thread(target=serve, args=(g, path), kwargs={"ready": ready, "most": 2}, daemon=True).start()
    assert ready.wait(10)
    assert client_call(path, {"cmd": "stat"})["xrefs"] == 11
    assert client_call(path, {"cmd": "nope"})["kind"] == "error"


def test_stored_index_answers_alike(spark, g, tmp_path, monkeypatch):
    """With its trigrams and its tables by other ends, and whether values go into the plan or not."""
    from tracelode.sources import index

    path = str(tmp_path / "g.index")
    index.write(g, path)
    stored = index.read(spark, path)
    asked = [
        lambda g: verbs.define(g, "foo", substr=True),
        lambda g: verbs.define(g, "PARENT", substr=True, ignore_case=True),
        lambda g: verbs.refs(g, "Paren", substr=True),
        lambda g: verbs.refs(g, "zzz", substr=True),
        lambda g: verbs.refs(g, "r", substr=True),
        lambda g: verbs.subs(g, "foo.Parent"),
        lambda g: verbs.members(g, "foo.Parent"),
        lambda g: walk.callgraph(g, "helper", substr=True, direction="both"),
        lambda g: walk.inheritance(g, "foo.Parent", direction="both"),
        lambda g: verbs.neighbours(g, g.syms, "called_by"),
    ]
    want = [sorted(map(str, q(g).collect())) for q in asked]
    assert [sorted(map(str, q(stored).collect())) for q in asked] == want
    assert stored.by("calls", "callee") is not stored.calls and g.by("calls", "callee") is g.calls
    assert stored.likely("zzz").count() == 0 and stored.likely("ab") is None
    found = stored.likely("Parent.help")
    assert found is None or "foo.Parent.helper" in {r["name"] for r in found.collect()}
    for module in (verbs, walk, resolve):
        monkeypatch.setattr(module, "PINNED", 0)
    assert [sorted(map(str, q(stored).collect())) for q in asked] == want


def test_index_is_replaced_in_one_step(spark, g, tmp_path):
    import os

    from tracelode.sources import index

    path = str(tmp_path / "g.index")
    index.write(g, path, trigrams=False)
    before = index.read(spark, path)
    small = type(g)(**(g.tables() | {"calls": g.calls.limit(0)}))
    index.write(small, path)
    assert index.read(spark, path).calls.count() == 0 and before.calls.count() == 2  # the one before still can be read
    index.write(small, path)
    assert len([n for n in os.listdir(path) if n.startswith("state-")]) == 2
    with pytest.raises(FileNotFoundError):
        index.read(spark, str(tmp_path / "none"))


def test_replies_for_people(g):
    from tracelode.service import shown

    out, notes = shown(dispatch(g, {"cmd": "def", "name": "foo.Parent.helper"}))
    assert out[0] == "# foo.Parent.helper  [fn/java]" and out[1] == "  sig: void helper(int flags)" and out[2].startswith("  decl /aosp/") and notes == ["hits=1"]
    assert shown(dispatch(g, {"cmd": "stat"}))[0][0] == "xrefs:  11"
    out, notes = shown(dispatch(g, {"cmd": "callgraph", "name": "foo.Parent.helper", "direction": "up"}))
    assert out[0].startswith("  id=0   parent=-   hop=0 root fn        foo.Parent.helper  ") and notes[-1].startswith("hits=")
    out, notes = shown(dispatch(g, {"cmd": "ref", "name": "foo.Parent", "max_hits": 1}))
    assert notes == ["(showing 1; --limit cap reached, more exist — raise --limit)", "hits=1"]
    assert shown(dispatch(g, {"cmd": "nope", "name": "x"}))[1][0].startswith("error: ")
    assert shown(dispatch(g, {"cmd": "members", "name": "foo.Parent"}))[1] == ["members=2"]


def test_home_in_paths(monkeypatch):
    from tracelode.service import expanded

    monkeypatch.setenv("HOME", "/h")
    assert (expanded("~"), expanded("~/x"), expanded("a~/x"), expanded("~y")) == ("/h", "/h/x", "a~/x", "~y")
