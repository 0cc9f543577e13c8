"""A small entry stream and a few units, built here, for queries and tests without files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.wire import VARINT, field, number
from ..schema import ENTRY
from ..sources.kzip import SCHEMA


def vname(signature: str, path: str = "", language: str = "c++", corpus: str = "c", root: str = "") -> dict:
    return {"signature": signature, "corpus": corpus, "root": root, "path": path, "language": language}


NONE = vname("", language="", corpus="")


def marked(kind: int, pre: str = "", kids: list[bytes] = (), joiner: str = "", post: str = "", final: bool = False) -> bytes:
    """The bytes of a marked source node."""
    out = number(1 << 3 | VARINT) + number(kind) if kind else b""
    out += field(2, pre) if pre else b""
    out += b"".join(field(3, k) for k in kids)
    out += field(4, joiner) if joiner else b""
    out += field(5, post) if post else b""
    return out + (number(10 << 3 | VARINT) + number(1) if final else b"")


def named(*parts: str) -> bytes:
    """Marked source of a qualified name."""
    context = marked(4, kids=[marked(3, p) for p in parts[:-1]], joiner="::", final=True)
    return marked(0, kids=[context, marked(3, parts[-1])])


class Stream:
    """Entries of one unit, in the order in which they are added."""

    def __init__(self, unit: str = "unit") -> None:
        self.unit, self.rows = unit, []

    def fact(self, v: dict, name: str, value: str | bytes) -> Stream:
        self.rows.append((self.unit, v, "", NONE, name, value.encode() if isinstance(value, str) else value))
        return self

    def edge(self, v: dict, kind: str, to: dict) -> Stream:
        self.rows.append((self.unit, v, kind if kind.startswith("/") else f"/kythe/edge/{kind}", to, "/", b""))
        return self

    def node(self, v: dict, kind: str, code: bytes | None = None) -> Stream:
        self.fact(v, "/kythe/node/kind", kind)
        return self.fact(v, "/kythe/code", code) if code is not None else self

    def anchor(self, name: str, path: str, start: int, end: int | None, *edges: tuple[str, dict]) -> Stream:
        v = vname(name, path)
        for kind, to in edges:
            self.edge(v, kind, to)
        self.fact(v, "/kythe/loc/start", str(start))
        if end is not None:
            self.fact(v, "/kythe/loc/end", str(end))
        return self.fact(v, "/kythe/node/kind", "anchor")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, ENTRY)


def stream() -> Stream:
    """A header and a source file: a class, a base, a declared and defined function with a parameter, and calls."""
    s = Stream()
    decl, body, helper, base, box, param = (vname(f"#{n}") for n in ("decl", "def", "helper", "base", "box", "w"))
    integer, pointer, function = vname("int#builtin"), vname("ptr#builtin"), vname("fn#builtin")
    to_box, returns = vname("#ptr(box)"), vname("#fn(int,box*)")
    s.node(decl, "function", named("Foo", "bar")).node(helper, "function", named("Foo", "helper"))
    s.node(box, "record", named("Box")).node(base, "interface", named("Base")).edge(box, "extends/public", base)
    s.node(body, "function", named("Foo", "bar")).edge(body, "completes/uniquely", decl)
    s.node(param, "variable", named("Foo", "bar", "w")).edge(decl, "param.0", param).edge(param, "childof", decl).edge(helper, "childof", box)
    for v, kind in ((integer, "tbuiltin"), (pointer, "tbuiltin"), (function, "tbuiltin"), (to_box, "tapp"), (returns, "tapp")):
        s.node(v, kind)
    s.edge(to_box, "param.0", pointer).edge(to_box, "param.1", box).edge(returns, "param.0", function).edge(returns, "param.1", integer).edge(returns, "param.2", to_box)
    s.edge(param, "typed", to_box).edge(decl, "typed", returns)
    s.anchor("@1", "foo.h", 100, 103, ("defines/binding", decl)).anchor("@2", "foo.cpp", 200, 203, ("defines/binding", body))
    s.anchor("@3", "foo.cpp", 190, 400, ("defines", body)).anchor("@4", "foo.cpp", 300, 310, ("ref/call", helper)).anchor("@5", "foo.cpp", 500, 510, ("ref/call", helper))
    s.anchor("@6", "foo.cpp", 320, 321, ("ref", param))
    return s


def entries(spark: SparkSession) -> DataFrame:
    return stream().frame(spark)


def unit(path: str, argument: list[str], digest: str = "d1") -> dict:
    one = {"v_name": vname("", path), "info": {"path": path, "digest": digest}}
    return {"v_name": vname("", ""), "required_input": [one], "argument": argument, "source_file": [path], "output_key": "o", "working_directory": "/w", "entry_context": ""}


def units(spark: SparkSession) -> DataFrame:
    """Two units with equal content, and others that differ in one thing each."""
    a = unit("a.cc", ["-c", "a.cc"])
    twice = a | {"required_input": a["required_input"] * 2}
    rows = [("same1", a), ("same2", twice), ("argv", unit("a.cc", ["a.cc", "-c"])), ("input", unit("a.cc", ["-c", "a.cc"], "d2"))]
    return spark.createDataFrame([("x.kzip", sha, True, u) for sha, u in rows], SCHEMA)
