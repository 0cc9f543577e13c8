"""Scalar functions of code graphs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KINDS, LANGS, ROLES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TICKET = "kythe:"  # what the names of unnamed symbols begin with
MAX_BYTES = 65_535

#: Languages of a VName and their numbers.
LANGUAGE = {"c++": 1, "java": 2, "jvm": 3, "go": 4, "proto": 5, "rust": 6, "kotlin": 7}
#: Edges that place a symbol, by what stands before the first dot, and their roles.
EDGE_ROLES = {
    "/kythe/edge/defines/binding": 0,
    "/kythe/edge/defines": 1,
    "/kythe/edge/ref": 2,
    "/kythe/edge/ref/writes": 2,
    "/kythe/edge/ref/imports": 2,
    "/kythe/edge/ref/call": 3,
}
#: Edges of inheritance.
INHERITS = (
    "/kythe/edge/extends",
    "/kythe/edge/extends/private",
    "/kythe/edge/extends/protected",
    "/kythe/edge/extends/public",
    "/kythe/edge/overrides",
    "/kythe/edge/satisfies",
)
COMPLETES = ("/kythe/edge/completes", "/kythe/edge/completes/uniquely")
CHILDOF, NAMED, TYPED, PARAM = "/kythe/edge/childof", "/kythe/edge/named", "/kythe/edge/typed", "/kythe/edge/param."
#: Node kinds and the kinds of symbols.
NODE_KINDS = {"function": 1, "record": 2, "interface": 2, "variable": 3, "constant": 4, "field": 4, "package": 5}
TYPE_NODES = ("tapp", "tbuiltin", "tvar", "record", "interface", "sum", "talias")
DESCRIPTOR = r"^(.*)\([A-Za-z0-9;\[/$_]*\)[A-Za-z0-9;\[/$_]+$"


def _choose(value: Column, table: dict, default: object) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(value == k, F.lit(v))
    return out.otherwise(F.lit(default))


def role_label(role: Column) -> Column:
    return _choose(role, ROLES, "?")


def kind_label(kind: Column) -> Column:
    return _choose(kind, KINDS, "?")


def lang_label(lang: Column) -> Column:
    return _choose(lang, LANGS, "?")


def language(name: Column) -> Column:
    """Number of a VName's language; 0 if it isn't known."""
    return _choose(name, LANGUAGE, 0)


def edge_role(edge: Column) -> Column:
    """Role of an anchor's edge; null if the edge places nothing."""
    return _choose(F.substring_index(edge, ".", 1), EDGE_ROLES, None).cast("int")


def node_kind(kind: Column) -> Column:
    return _choose(kind, NODE_KINDS, 0)


def ticket(vname: Column) -> Column:
    """The identity of a VName in one string."""
    part = lambda f: F.coalesce(vname[f], F.lit(""))
    return F.concat(F.lit(TICKET), part("language"), F.lit(":"), part("corpus"), F.lit("#"), part("root"), F.lit("#"), part("path"), F.lit("#"), part("signature"))


def sym_of(text: Column) -> Column:
    """XXH64 with seed 0 of the text's bytes, as a signed BIGINT. The built-in function has seed 42, so the
    same expression is made with another seed; without a JVM of our own (Connect) pandas does it."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    if hasattr(spark, "_jvm"):
        jvm = spark._jvm
        classic = jvm.org.apache.spark.sql.classic
        inner = classic.ExpressionUtils.expression(text._jc)
        one = jvm.java.util.ArrayList()
        one.add(inner)
        seq = jvm.org.apache.spark.api.python.PythonUtils.toSeq(one)
        hashed = jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, 0)
        return Column(classic.ExpressionUtils.column(hashed))
    return _sym_udf()(text)


def _sym_udf():
    import pandas as pd
    import xxhash

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else (xxhash.xxh64_intdigest(t, 0) ^ (1 << 63)) - (1 << 63))

    return hashed


def sym_order(sym: Column) -> Column:
    """Orders signed ids as the unsigned numbers of the same bits."""
    return sym.bitwiseXOR(F.lit(-(1 << 63)))


def sym_hex(sym: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(sym)), 16, "0"))


def is_ticket(name: Column) -> Column:
    return name.startswith(TICKET)


def logical_key(name: Column) -> Column:
    """What copies of one element share: the signature at the end of a ticket, or the whole name."""
    return F.when(is_ticket(name), F.substring_index(name, "#", -1)).otherwise(name)


def display_name(name: Column, path: Column, off: Column) -> Column:
    """A readable name: a ticket gives way to where it is defined, or to its signature."""
    anon = F.when(path.isNotNull(), F.concat(F.lit("anon@"), path, F.lit("@"), off.cast("string")))
    sig = F.substring_index(name, "#", -1)
    return F.when(~is_ticket(name), name).otherwise(F.coalesce(anon, F.when(sig != "", sig), name))


def place(path: Column, off: Column) -> Column:
    """``path@off``; null without a path."""
    return F.when(path.isNotNull(), F.concat(path, F.lit("@"), off.cast("string")))


def fold(text: Column) -> Column:
    """Lower case of ASCII letters, nothing else."""
    return F.translate(text, UPPER, LOWER)


def short_name(name: Column) -> Column:
    return F.substring_index(F.substring_index(name, "::", -1), ".", -1)


def bare_param(name: Column) -> Column:
    """Without what follows the first bracket."""
    return F.rtrim(F.substring_index(name, "[", 1))


def strip_descriptor(name: Column) -> Column:
    """A JVM method's name without its descriptor; null if there is none."""
    found = F.regexp_extract(name, DESCRIPTOR, 1)
    return F.when(name.rlike(DESCRIPTOR) & (found != ""), found)


def builtin_op(signature: Column) -> Column:
    """What stands before ``#builtin``; null if nothing does."""
    head = F.substring_index(signature, "#builtin", 1)
    return F.when(signature.contains("#builtin") & (head != ""), head)


def param_ordinal(edge: Column) -> Column:
    """N of a ``param.N`` edge, a decimal of 32 bits; null for other edges."""
    n = F.regexp_extract(edge, r"^/kythe/edge/param\.([0-9]{1,10})$", 1)
    number = F.when(n != "", n.cast("long"))
    return F.when(number < (1 << 32), number)


def decimal(text: Column) -> Column:
    """A strict decimal of 32 bits, or null."""
    number = F.when(text.rlike("^[0-9]{1,10}$"), text.cast("long"))
    return F.when(number < (1 << 32), number)


def degenerate(name: Column) -> Column:
    """No letter or digit in it."""
    return ~name.rlike(r"[\p{L}\p{N}]")


def name_rank(name: Column) -> Column:
    """Orders candidate names, best first: usable, not a ticket, few bytes, low bytes. Empty ones are last."""
    return F.struct((name == "").alias("empty"), degenerate(name).alias("degenerate"), is_ticket(name).alias("ticket"), F.octet_length(name).alias("bytes"), name.alias("name"))


def clamp(text: Column) -> Column:
    """At most 65 535 bytes, cut between characters."""
    data = F.encode(text, "UTF-8")
    inside = lambda at: F.hex(F.substring(data, at, 1)).between("80", "BF")  # noqa: E731  a character goes on here
    end = F.when(~inside(MAX_BYTES + 1), MAX_BYTES).when(~inside(MAX_BYTES), MAX_BYTES - 1).when(~inside(MAX_BYTES - 1), MAX_BYTES - 2).otherwise(MAX_BYTES - 3)
    return F.when(F.octet_length(text) > MAX_BYTES, F.decode(F.substring(data, F.lit(1), end), "UTF-8")).otherwise(text)


def passes(path: Column, in_: str | None = None, not_in: str | None = None) -> Column | None:
    """Literal path filter; None if there is nothing to filter by."""
    tests = []
    if in_:
        tests.append(path.contains(F.lit(in_)))
    if not_in:
        tests.append(~path.contains(F.lit(not_in)))
    if not tests:
        return None
    return tests[0] if len(tests) == 1 else tests[0] & tests[1]


def primary_path(unit: Column) -> Column:
    """Path of a compilation unit: source file, path of the first input (VName, then file), VName of the unit; or null."""
    full = lambda c: F.when(c != "", c)
    first = F.get(unit["required_input"], F.lit(0))
    return F.coalesce(F.get(unit["source_file"], F.lit(0)), full(first["v_name"]["path"]), full(first["info"]["path"]), full(unit["v_name"]["path"]))
