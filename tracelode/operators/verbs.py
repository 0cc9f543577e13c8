"""The navigation verbs, each a plan over the graph's tables that gives flat rows in order.

Which answer is cut off shows in ``truncated`` of ``service``; here rows carry ``seq`` columns that keep
their order. Limits are those of the requests: they bound what a reply shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import display_name, is_ticket, kind_label, lang_label, logical_key, passes, place, role_label, sym_order
from ..schema import CALL, CONTAINERS, DECL, DEF, Graph
from ..sources.tables import local
from .resolve import PINNED, lookup

LIMIT, MAX_HITS, LEAST_SYMS = 16, 200, 64
EVERY = 255


def stat(g: Graph) -> DataFrame:
    """xrefs, syms, files, inhs, calls."""
    counts = [t.agg(F.count(F.lit(1)).alias(n)) for n, t in (("xrefs", g.xrefs), ("syms", g.syms), ("files", g.files), ("inhs", g.inh), ("calls", g.calls))]
    out = counts[0]
    for c in counts[1:]:
        out = out.join(F.broadcast(c))  # one row each
    return out


def pinned(syms: DataFrame) -> tuple[DataFrame, list[int] | None]:
    """The symbols that a name has led to. If they are few they are looked up now, and the rows and their ids
    become part of the plan; if they are many they stay a plan (None)."""
    rows = syms.limit(PINNED + 1).collect()
    if len(rows) > PINNED:
        return syms, None
    return local(syms.sparkSession, rows, syms.schema), sorted({r["sym"] for r in rows})


def narrowed(table: DataFrame, column: str, ids: list[int] | None) -> DataFrame:
    """The rows of a table with one of the ids: a filter that reaches the scan. None, or too many: all rows."""
    return table if ids is None or len(ids) > PINNED else table.filter(F.col(column).isin(ids)) if ids else table.limit(0)


def described(g: Graph, rows: DataFrame, sym: str = "sym", ids: list[int] | None = None) -> DataFrame:
    """``rows`` with name, kind and lang of the symbol; a symbol that isn't known is ``?``."""
    known = narrowed(g.syms, "sym", ids).select(F.col("sym").alias(sym), F.col("name"), F.col("kind"), F.col("lang"))
    out = rows.join(known, sym, "left")
    return out.withColumns({"name": F.coalesce("name", F.lit("?")), "kind": F.coalesce("kind", F.lit(0)), "lang": F.coalesce("lang", F.lit(0))})


def labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"kind": kind_label(F.col("kind")), "lang": lang_label(F.col("lang"))})


def _placed(g: Graph, syms: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """Places of the given symbols that declare or define them."""
    return narrowed(g.xrefs, "sym", ids).filter(F.col("role").between(DECL, DEF)).join(syms.select("sym").distinct(), "sym", "left_semi")


def first_paths(g: Graph, syms: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """sym, def_path: path of the first declaration, or else definition."""
    first = _placed(g, syms, ids).groupBy("sym").agg(F.min(F.struct("role", "file", "off")).getField("file").alias("file"))
    return first.join(g.files, "file").select("sym", F.col("path").alias("def_path"))


def places(g: Graph, syms: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """sym, path, off: the first definition, or else declaration."""
    order = F.struct((F.col("role") != DEF).alias("later"), "file", "off")
    first = _placed(g, syms, ids).groupBy("sym").agg(F.min(order).alias("at")).select("sym", "at.file", "at.off")
    return first.join(g.files, "file").select("sym", "path", "off")


def _where_defined(g: Graph, syms: DataFrame, def_in: str | None, ids: list[int] | None = None) -> DataFrame:
    if not def_in:
        return syms
    return syms.join(first_paths(g, syms, ids).filter(F.col("def_path").contains(def_in)).select("sym"), "sym", "left_semi")


def sites(
    g: Graph, name: str, roles: tuple[int, int], substr: bool = False, ignore_case: bool = False, limit: int = LIMIT,
    max_hits: int | None = None, in_: str | None = None, not_in: str | None = None, def_in: str | None = None, with_type: bool = False,
) -> DataFrame:
    """group_seq, name, kind, lang, (typed, sig,) role, file, off: places of the symbols of a name, symbol by
    symbol; symbols without a place are not shown. ``max_hits`` counts over all symbols; at least one is shown."""
    syms, ids = pinned(lookup(g, name, substr, limit, ignore_case))
    syms = _where_defined(g, syms, def_in, ids)
    low, high = roles
    rows = narrowed(g.xrefs, "sym", ids).filter(F.col("role").between(low, high)).join(syms, "sym")
    rows = rows.join(g.files.select("file", "path"), "file", "left").withColumn("path", F.coalesce("path", F.lit("?")))
    wanted = passes(F.col("path"), in_, not_in)
    if wanted is not None:
        rows = rows.filter(wanted)
    if max_hits is not None:
        order = ["seq", "role", "file", "off"]
        rows = rows.orderBy(*order).limit(max(1, max_hits))
    rows = described(g, rows, ids=ids)
    extra = []
    if with_type:
        rows = rows.join(narrowed(g.typed, "sym", ids), "sym", "left").join(narrowed(g.sig, "sym", ids), "sym", "left")
        extra = ["typed", "sig"]
    return labelled(rows).select(F.col("seq").alias("group_seq"), "name", "kind", "lang", *extra, role_label(F.col("role")).alias("role"), F.col("path").alias("file"), "off")


def define(g: Graph, name: str, **options) -> DataFrame:
    """Where a name is declared and defined, with type and signature."""
    return sites(g, name, (DECL, DEF), with_type=True, **options)


def refs(g: Graph, name: str, limit: int = LIMIT, max_hits: int | None = MAX_HITS, **options) -> DataFrame:
    return sites(g, name, (0, EVERY), limit=max(limit, LEAST_SYMS), max_hits=max_hits, **options)


def callers(g: Graph, name: str, limit: int = LIMIT, max_hits: int | None = MAX_HITS, **options) -> DataFrame:
    """Call sites."""
    return sites(g, name, (CALL, CALL), limit=max(limit, LEAST_SYMS), max_hits=max_hits, **options)


def sites_many(g: Graph, needles: DataFrame, roles: tuple[int, int] = (0, EVERY)) -> DataFrame:
    """needle, sym, role, path, off for a table of needles in one job: the form for many look-ups at once."""
    from .resolve import exact_many

    found = exact_many(g.names, needles)
    rows = g.xrefs.filter(F.col("role").between(*roles)).join(found, "sym")
    return rows.join(g.files, "file").select("needle", "sym", role_label(F.col("role")).alias("role"), "path", "off")


def related(g: Graph, name: str, sub: bool, substr: bool = False, limit: int = LIMIT, in_: str | None = None, not_in: str | None = None) -> DataFrame:
    """seq, name, def: direct supertypes (or subtypes) and overridden (or overriding) methods. Copies of one
    element are one row: its first place, and its first name that is not a ticket."""
    syms, ids = pinned(lookup(g, name, substr, limit))
    ends = ("parent", "child") if sub else ("child", "parent")
    edges = narrowed(g.by("inh", ends[0]), ends[0], ids).select(F.col(ends[0]).alias("sym"), F.col(ends[1]).alias("other"))
    found, ids = pinned(edges.join(syms, "sym").groupBy(F.col("other").alias("sym")).agg(F.min("seq").alias("seq")))
    wanted = passes(F.coalesce("def_path", F.lit("")), in_, not_in)
    if wanted is not None:
        found = found.join(first_paths(g, found, ids), "sym", "left").filter(wanted)
    known = narrowed(g.syms, "sym", ids).select("sym", "name")
    found = found.join(known, "sym", "left").join(places(g, found, ids), "sym", "left")
    found = found.withColumn("name", F.coalesce("name", F.concat(F.lit("<sym "), F.lpad(F.lower(F.hex("sym")), 16, "0"), F.lit(">"))))
    at = F.struct("seq", sym_order(F.col("sym")).alias("sym"))
    best = lambda cond: F.min(F.when(cond, at))
    rows = found.withColumn("key", logical_key(F.col("name"))).withColumn("at", at)
    rows = rows.groupBy("key").agg(
        F.min("at").alias("at"),
        F.coalesce(best(~is_ticket(F.col("name"))), F.min("at")).alias("rep"),
        best(F.col("path").isNotNull()).alias("located"),
        F.min_by(F.struct("name", "path", "off"), F.struct(is_ticket(F.col("name")).alias("ticket"), "at")).alias("named"),
        F.min_by(F.struct("path", "off"), F.struct(F.col("path").isNull().alias("none"), "at")).alias("place"),
    )
    shown = display_name(F.col("named.name"), F.col("named.path"), F.col("named.off"))
    order = Window.orderBy("at")
    return rows.select(F.row_number().over(order).alias("seq"), shown.alias("name"), place(F.col("place.path"), F.col("place.off")).alias("def"))


def supers(g: Graph, name: str, **options) -> DataFrame:
    return related(g, name, sub=False, **options)


def subs(g: Graph, name: str, **options) -> DataFrame:
    return related(g, name, sub=True, **options)


def _first_of(rows: DataFrame, key: list, order: list, limit: int) -> DataFrame:
    """The first row of each key, and of these the first ``limit``, numbered."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("nth = 1").drop("nth")
    top = first.orderBy(*order).limit(limit)
    return top.withColumn("seq", F.row_number().over(Window.orderBy(*order)))


def _texts(g: Graph, table: DataFrame, column: str, name: str, substr: bool, limit: int) -> DataFrame:
    syms, ids = pinned(lookup(g, name, substr, max(limit, LEAST_SYMS)))
    rows = described(g, narrowed(table, "sym", ids).join(syms, "sym"), ids=ids)
    rows = _first_of(rows, [logical_key(F.col("name")), column], ["seq"], limit)
    return labelled(rows).select("seq", "name", "kind", "lang", column)


def types(g: Graph, name: str, substr: bool = False, limit: int = LIMIT) -> DataFrame:
    """Resolved types of the symbols of a name; those without one are not shown."""
    return _texts(g, g.typed, "typed", name, substr, limit)


def signatures(g: Graph, name: str, substr: bool = False, limit: int = LIMIT) -> DataFrame:
    return _texts(g, g.sig, "sig", name, substr, limit)


def members(g: Graph, name: str, substr: bool = False, limit: int = LIMIT) -> DataFrame:
    """Direct members of the types and packages of a name."""
    syms, ids = pinned(lookup(g, name, substr, max(limit, LEAST_SYMS)))
    holders = syms.join(narrowed(g.syms, "sym", ids).filter(F.col("kind").isin(*CONTAINERS)).select("sym"), "sym", "left_semi")
    rows = narrowed(g.childof, "parent", ids).join(holders.withColumnRenamed("sym", "parent"), "parent").groupBy(F.col("child").alias("sym")).agg(F.min("seq").alias("holder"))
    rows = described(g, rows).join(g.sig, "sym", "left").withColumn("at", sym_order(F.col("sym")))
    rows = _first_of(rows, [logical_key(F.col("name")), "kind", "sig"], ["holder", "at"], limit)
    return labelled(rows).select("seq", "name", "kind", "lang", "sig")


def neighbours(g: Graph, syms: DataFrame, table: str) -> DataFrame:
    """sym, other, role of direct edges: ``calls_from``, ``called_by``, ``inherits_of``, ``inherited_by`` or ``members``."""
    edges, a, b = {"calls_from": ("calls", "caller", "callee"), "called_by": ("calls", "callee", "caller"), "inherits_of": ("inh", "child", "parent"), "inherited_by": ("inh", "parent", "child"), "members": ("childof", "parent", "child")}[table]
    edges = g.by(edges, a)
    role: Column = F.col("role") if "role" in edges.columns else F.lit(None).cast("int")
    return edges.select(F.col(a).alias("sym"), F.col(b).alias("other"), role.alias("role")).distinct().join(syms.select("sym").distinct(), "sym", "left_semi")
