"""Small graphs by name; a symbol is the seed-0 hash of its name."""

import xxhash

from tracelode.schema import CALL, DECL, DEF, FIELD, FUNCTION, REF, TYPE, Graph


def sym(name: str) -> int:
    h = xxhash.xxh64_intdigest(name, 0)
    return h - (1 << 64) if h >= 1 << 63 else h


def make(spark, syms=(), files=(), xrefs=(), inh=(), calls=(), childof=(), typed=(), sig=(), aliases=()):
    """Tables of names instead of ids."""
    names = [(n, sym(n)) for n, *_ in syms] + [(a, sym(n)) for n, a in aliases]
    return Graph.of_rows(
        spark,
        syms=[(sym(n), k, lang, n) for n, k, lang in syms],
        names=sorted(set(names)),
        files=list(files),
        xrefs=[(sym(n), r, f, o) for n, r, f, o in xrefs],
        inh=[(sym(a), sym(b)) for a, b in inh],
        calls=[(sym(a), sym(b), r) for a, b, r in calls],
        childof=[(sym(a), sym(b)) for a, b in childof],
        typed=[(sym(n), t) for n, t in typed],
        sig=[(sym(n), s) for n, s in sig],
    )


def java(spark):
    """A parent with two children in different trees, methods, a field and calls."""
    t, f, d = TYPE, FUNCTION, FIELD
    base = "/aosp/frameworks/base/core/"
    return make(
        spark,
        syms=[(n, t, 2) for n in ("foo.Parent", "foo.MainChild", "foo.TestChild")] + [(n, f, 2) for n in ("foo.MainChild.run", "foo.Parent.helper", "foo.TestChild.runTest")] + [("foo.Parent.count", d, 2)],
        files=[(1, base + "java/foo/Parent.java"), (2, base + "java/foo/MainChild.java"), (3, base + "tests/foo/TestChild.java")],
        xrefs=[
            ("foo.Parent", DECL, 1, 100), ("foo.Parent", REF, 2, 200), ("foo.Parent", REF, 3, 200), ("foo.MainChild", DECL, 2, 100), ("foo.TestChild", DECL, 3, 100),
            ("foo.MainChild.run", DECL, 2, 500), ("foo.Parent.helper", DECL, 1, 500), ("foo.Parent.helper", CALL, 2, 600), ("foo.Parent.helper", CALL, 3, 600),
            ("foo.TestChild.runTest", DECL, 3, 500), ("foo.Parent.count", DECL, 1, 700),
        ],
        inh=[("foo.MainChild", "foo.Parent"), ("foo.TestChild", "foo.Parent")],
        calls=[("foo.MainChild.run", "foo.Parent.helper", CALL), ("foo.TestChild.runTest", "foo.Parent.helper", CALL)],
        childof=[("foo.Parent", "foo.Parent.helper"), ("foo.Parent", "foo.Parent.count")],
        sig=[("foo.Parent.helper", "void helper(int flags)")],
    )


def hub(spark, edges_on: str):
    """A type and a method of three copies each, with the edges on one copy only."""
    copies = [f"kythe:java:c#r#variant{i}/Hub.java#HUBSIG" for i in (1, 2, 3)]
    runs = [f"kythe:java:c#r#variant{i}/Hub.java#RUNSIG" for i in (1, 2, 3)]
    pick = (max if edges_on == "largest" else min)(range(3), key=lambda i: sym(copies[i]) % (1 << 64))
    h, r = copies[pick], runs[pick]
    return make(
        spark,
        syms=[(c, TYPE, 2) for c in copies] + [(c, FUNCTION, 2) for c in runs] + [(n, TYPE, 2) for n in ("p.Base", "p.Iface", "p.Child")] + [(n, FUNCTION, 2) for n in ("p.App.main", "p.Helper.do")],
        inh=[(h, "p.Base"), (h, "p.Iface"), ("p.Child", h)],
        calls=[("p.App.main", r, CALL), (r, "p.Helper.do", CALL)],
        aliases=[(c, "p.Hub") for c in copies] + [(c, "p.Hub.run") for c in runs],
    )
