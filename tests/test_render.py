import random

import pytest

from tracelode.functions.render import Types, decode, qualified_name, type_name
from tracelode.plans.sample import marked, named

BOX, TYPE, PARAM, IDENT, CONTEXT, INIT, MOD = 0, 1, 2, 3, 4, 5, 12


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (named("android", "Parcel", "write"), "android::Parcel::write"),
        (marked(BOX, kids=[marked(TYPE, "void "), marked(IDENT, "nativeInit")]), "nativeInit"),
        (marked(BOX, kids=[marked(IDENT, "global_var"), marked(INIT, "= 3")]), "global_var"),
        (marked(BOX, kids=[marked(MOD, "static "), marked(IDENT, "helper")]), "helper"),
        (marked(BOX, kids=[marked(CONTEXT, kids=[marked(IDENT, "ns"), marked(IDENT, "C")], joiner="::", final=True), marked(IDENT, "operator()")]), "ns::C::operator()"),
        (marked(IDENT, "__acos", kids=[marked(8, "(", post=")")]), "__acos"),
        (marked(IDENT, "__isinff", kids=[marked(TYPE, "int"), marked(BOX, "x")], post=" __attribute__"), "__isinff"),
        (marked(CONTEXT, kids=[marked(IDENT, "java"), marked(IDENT, "lang")], joiner=".", final=True), "java.lang."),
        (marked(BOX, kids=[marked(CONTEXT, kids=[marked(IDENT, "Foo")], joiner="::", final=True), marked(IDENT, "")]), "Foo"),
        (marked(BOX, " Foo::", kids=[named("Foo", "bar")]), "Foo::bar"),
        (marked(TYPE, "int"), "int"),
        (marked(IDENT, "[]{ return 1; }"), None),
        (b"", None),
        (marked(CONTEXT, kids=[marked(IDENT, "vec", kids=[])], post="<int>"), "vec<int>"),
    ],
)
def test_names(source, want):
    assert qualified_name(source) == want


def _graph():
    g = Types()
    for n in ("int", "ptr", "lvr", "rvr", "const", "volatile", "fn", "carr", "array", "odd"):
        g.kind[n], g.op[n] = "tbuiltin", n
    for n, name in (("Widget", "Widget"), ("Box", "Box<>"), ("String", "java.lang.String"), ("List", "java.util.List<>")):
        g.kind[n], g.code[n] = "record", marked(IDENT, name)
    g.kind["K"], g.code["K"] = "tvar", named("T", "compute", "K")
    return g


def app(g, *parts):
    """An application node of nested tuples."""
    key = repr(parts)
    g.kind[key] = "tapp"
    g.params[key] = {i: app(g, *p) if isinstance(p, tuple) else p for i, p in enumerate(parts)}
    return key


@pytest.mark.parametrize(
    ("node", "want"),
    [
        ("Widget", "Widget"), ("int", "int"), ("K", "K"), ("nowhere", None),
        (("Box", "int"), "Box<int>"), (("Box", ("Box", "int")), "Box<Box<int>>"), (("lvr", ("const", ("Box", "int"))), "const Box<int> &"),
        (("ptr", "int"), "int *"), (("ptr", ("ptr", "int")), "int * *"), (("ptr", "Widget"), "Widget *"), (("volatile", "int"), "volatile int"),
        (("fn", "int", "int", "int"), "int(int, int)"), (("carr", "int"), "int[]"), (("carr", ("carr", "int")), "int[][]"), (("carr", ("ptr", "int")), "int *[]"),
        (("ptr", ("carr", "int")), "int (*)[]"), (("lvr", ("carr", "int")), "int (&)[]"), (("rvr", ("carr", "int")), "int (&&)[]"), (("carr", ("ptr", ("carr", "int"))), "int (*)[][]"),
        (("List", "String"), "java.util.List<java.lang.String>"), (("array", "String"), "java.lang.String[]"), (("Box", "K"), "Box<K>"), (("Box", "nowhere"), "Box<?>"), (("odd", "int"), "odd<int>"),
    ],
)
def test_types(node, want):
    g = _graph()
    assert g.render(app(g, *node) if isinstance(node, tuple) else node) == want


def test_cycle_ends():
    g = _graph()
    g.kind["c"], g.params["c"] = "tapp", {0: "Box", 1: "c"}
    assert g.render("c").startswith("Box<Box<")


def test_signatures():
    g = _graph()
    g.code["f"], g.typed["f"] = named("Gadget", "frob"), app(g, "fn", "int", ("ptr", "Widget"), "int")
    assert g.signature("f") == "int frob()"
    for i, (p, name, kind) in enumerate((("w", "w", ("ptr", "Widget")), ("n", "n", None))):
        g.params.setdefault("f", {})[i] = p
        g.code[p] = named("frob", name)
        g.typed[p] = app(g, *kind) if kind else "int"
    assert g.signature("f") == "int frob(Widget * w, int n)"
    g.code["fill"], g.params["fill"], g.code["xs"], g.typed["xs"] = marked(IDENT, "fill"), {0: "xs"}, named("fill", "xs[4]"), app(g, "carr", "int")
    assert g.signature("fill") == "fill(int[] xs)"
    g.params["anon"] = {0: "p0"}
    assert g.signature("anon") is None and g.signature("none") is None


def test_type_name_without_brackets():
    assert type_name(marked(IDENT, "List<>")) == "List" and type_name(marked(IDENT, "<>")) is None


def _tree(rng, depth=0):
    kids = [_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 4 else []
    word = lambda: rng.choice(["", "a", "::", "<", "x y", "{", "\n", "(", "é"])
    return marked(rng.randint(0, 13), word(), kids, word(), word(), rng.random() < 0.3)


def test_fuzz():
    rng = random.Random(7)
    for _ in range(5_000):
        data = _tree(rng) if rng.random() < 0.5 else rng.randbytes(rng.randint(0, 60))
        name = qualified_name(data)
        decode(data)
        assert name is None or name and not set(name) & set("\n\r{};") and name == name.strip()
