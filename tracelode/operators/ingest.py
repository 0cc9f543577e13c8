"""From entries to the raw rows of a graph, by joins and aggregates over units (``cu_id``).

An anchor is the group of its facts; its edges join it by ticket. All symbol-keyed rows then go through
the unit's bridge from definitions to declarations, except for the symbols' own rows. Types and
signatures are rendered per unit, where the graph of type nodes is whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import scalar as S
from ..functions.render import Types, qualified_name
from ..schema import CALL, DEF, FIELD, REF, UNKNOWN, Graph
from .build import assemble, best_name, file_ids
from .intervals import innermost


@F.pandas_udf(StringType())
def marked_name(code: pd.Series) -> pd.Series:
    return code.map(lambda c: qualified_name(bytes(c)) if c is not None else None)


def _base(edge: str = "edge_kind") -> Column:
    return F.substring_index(edge, ".", 1)


def _filled(vname: str) -> Column:
    return F.array_max(F.array([F.length(F.col(f"{vname}.{f}")) for f in ("signature", "corpus", "root", "path", "language")])) > 0


def keyed(entries: DataFrame) -> DataFrame:
    """Entries with the tickets and symbols of both ends; those without a source are dropped."""
    out = entries.filter(_filled("source")).withColumns({"key": S.ticket(F.col("source")), "to": F.when(_filled("target"), S.ticket(F.col("target")))})
    return out.withColumns({"sym": S.sym_of(F.col("key")), "target_sym": S.sym_of(F.col("to"))})


def anchors(rows: DataFrame) -> DataFrame:
    """cu_id, key, path, start, end of every anchor with a start."""
    value = F.col("fact_value").cast("string")
    fact = lambda name: F.when(F.col("fact_name") == name, value)
    facts = rows.filter("edge_kind = '' and fact_name in ('/kythe/node/kind', '/kythe/loc/start', '/kythe/loc/end')")
    one = facts.groupBy("cu_id", "key").agg(
        F.max(fact("/kythe/node/kind") == "anchor").alias("anchor"),
        F.max(F.col("source.path")).alias("path"),
        F.max(S.decimal(fact("/kythe/loc/start"))).alias("start"),
        F.max(S.decimal(fact("/kythe/loc/end"))).alias("end"),
    )
    return one.filter("anchor and start is not null").drop("anchor")


def edges(rows: DataFrame) -> DataFrame:
    return rows.filter("edge_kind <> '' and to is not null")


def placements(rows: DataFrame) -> DataFrame:
    """cu_id, path, start, end, role, target_sym, to, lang: edges of anchors that place a symbol."""
    own = edges(rows).withColumn("role", S.edge_role(F.col("edge_kind"))).filter("role is not null")
    own = own.select("cu_id", "key", "role", "target_sym", "to", S.language(F.col("target.language")).alias("lang"))
    return own.join(anchors(rows), ["cu_id", "key"])


def bridges(rows: DataFrame) -> DataFrame:
    """cu_id, def_sym, decl_sym: the declaration that a definition completes; of several the least."""
    own = edges(rows).filter(_base().isin(*S.COMPLETES))
    return own.groupBy("cu_id", F.col("sym").alias("def_sym")).agg(F.min("target_sym").alias("decl_sym"))


def _bridged(rows: DataFrame, bridge: DataFrame, *columns: str) -> DataFrame:
    from .build import remapped

    return remapped(rows, bridge, *columns, scope="cu_id")


def sightings(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """cu_id, sym, kind, lang, name of every mention of a symbol."""
    value = F.col("fact_value").cast("string")
    nodes = rows.filter("edge_kind = '' and fact_name = '/kythe/node/kind'").filter(value != "anchor")
    nodes = nodes.select("cu_id", "sym", S.node_kind(value).alias("kind"), S.language(F.col("source.language")).alias("lang"), F.col("key").alias("name"))
    fields = rows.filter("edge_kind = '' and fact_name = '/kythe/subkind'").filter(value.isin("field", "constant"))
    fields = fields.select("cu_id", "sym", F.lit(FIELD).alias("kind"), F.lit(0).alias("lang"), F.lit("").alias("name"))
    targets = placed.select("cu_id", F.col("target_sym").alias("sym"), F.lit(UNKNOWN).alias("kind"), "lang", F.col("to").alias("name"))
    return nodes.union(fields).union(targets)


def aliases(rows: DataFrame) -> DataFrame:
    """cu_id, sym, alias: names of symbols, from named edges (with and without descriptor) and marked source."""
    raw = F.col("target.signature")
    named = rows.filter("edge_kind <> ''").filter(_base() == S.NAMED).filter(raw != "")
    named = named.select("cu_id", "sym", F.explode(F.array_compact(F.array(raw, S.strip_descriptor(raw)))).alias("alias"))
    code = rows.filter("edge_kind = '' and fact_name = '/kythe/code'")
    blobs = code.select("fact_value").distinct().withColumn("alias", marked_name("fact_value"))
    blobs = blobs.filter("alias is not null").filter(~S.degenerate(F.col("alias")))
    return named.union(code.join(blobs, "fact_value").select("cu_id", "sym", "alias")).distinct()


_RENDERED = "cu_id string, what string, key string, value string"


def rendered(rows: DataFrame) -> DataFrame:
    """cu_id, what (``typed``, ``sig`` or ``super``), key, value: types of symbols, signatures of functions and names
    of supertypes, each unit by itself. Only what renderers read is sent to them."""
    base = _base()
    wanted = (
        "edge_kind = '' and fact_name in ('/kythe/code', '/kythe/node/kind')"
    )
    facts = rows.filter(wanted)
    typed = edges(rows).filter((F.col("edge_kind") == S.TYPED) | S.param_ordinal(F.col("edge_kind")).isNotNull() | base.isin(*S.INHERITS))
    slim = facts.union(typed).select("cu_id", "key", "to", "edge_kind", "fact_name", "fact_value", F.col("source.signature").alias("signature"))

    def render(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        g, functions, parents, pairs = Types(), [], set(), []
        for r in own.sort_values(["key", "edge_kind", "fact_name", "to"], na_position="first").itertuples():
            if r.edge_kind:
                if r.edge_kind == S.TYPED:
                    g.typed[r.key] = r.to
                    pairs.append((r.key, r.to))
                elif r.edge_kind.startswith(S.PARAM):
                    g.params.setdefault(r.key, {})[int(r.edge_kind.rsplit(".", 1)[1])] = r.to
                else:
                    parents.add(r.to)
            elif r.fact_name == "/kythe/code":
                g.code.setdefault(r.key, bytes(r.fact_value))
            else:
                kind = bytes(r.fact_value).decode("utf-8", "replace")
                if kind == "function":
                    functions.append(r.key)
                if kind in S.TYPE_NODES:
                    g.kind[r.key] = kind
                    head = r.signature.split("#builtin", 1)[0]
                    if kind == "tbuiltin" and head and "#builtin" in r.signature:
                        g.op[r.key] = head
        out = [("typed", k, g.render(t)) for k, t in pairs] + [("sig", k, g.signature(k)) for k in dict.fromkeys(functions)] + [("super", k, g.render(k)) for k in sorted(parents)]
        out = [(key[0], *x) for x in out if x[2]]
        return pd.DataFrame(out, columns=["cu_id", "what", "key", "value"])

    return slim.groupBy("cu_id").applyInPandas(render, _RENDERED)


def raw_tables(entries: DataFrame, keep_unit: bool = False) -> dict[str, DataFrame]:
    """The raw rows of all tables, bridged; files are numbered by the rank of their path. ``keep_unit``: rows have the
    cu_id that they came from, and ``paths`` has the paths of each unit."""
    rows = keyed(entries)
    unit = ["cu_id"] if keep_unit else []
    placed, bridge = placements(rows), bridges(rows)
    paths = anchors(rows).select("cu_id", "path").distinct()
    files = file_ids(paths)
    placed = placed.join(files, "path")
    xrefs = _bridged(placed.select("cu_id", F.col("target_sym").alias("sym"), "role", "file", F.col("start").alias("off")), bridge, "sym")
    alias = _bridged(aliases(rows), bridge, "sym")
    own = edges(rows)
    inh = _bridged(own.filter(_base().isin(*S.INHERITS)).select("cu_id", F.col("sym").alias("child"), F.col("target_sym").alias("parent")), bridge, "child", "parent")
    childof = _bridged(own.filter(_base() == S.CHILDOF).select("cu_id", F.col("target_sym").alias("parent"), F.col("sym").alias("child")), bridge, "parent", "child")
    calls = _bridged(attributed(placed), bridge, "caller", "callee")
    text = rendered(rows).withColumn("sym", S.sym_of(F.col("key")))
    text = _bridged(text, bridge, "sym")
    best = alias.groupBy("cu_id", "sym").agg(best_name("alias").alias("name"))
    promoted = best.union(text.filter("what = 'super'").select("cu_id", "sym", F.col("value").alias("name")))
    promoted = promoted.select("cu_id", "sym", F.lit(UNKNOWN).alias("kind"), F.lit(0).alias("lang"), "name")
    out = {
        "syms": sightings(rows, placed).union(promoted).select(*unit, "sym", "kind", "lang", "name"),
        "aliases": alias.select(*unit, "sym", "alias"),
        "files": files.select("file", "path"),
        "xrefs": xrefs.select(*unit, "sym", "role", "file", "off"),
        "inh": inh.select(*unit, "child", "parent"),
        "calls": calls.select(*unit, "caller", "callee", "role"),
        "childof": childof.select(*unit, "parent", "child"),
        "typed": text.filter("what = 'typed'").select(*unit, "sym", F.col("value").alias("typed")),
        "sig": text.filter("what = 'sig'").select(*unit, "sym", F.col("value").alias("sig")),
    }
    return out | ({"paths": paths} if keep_unit else {})


def attributed(placed: DataFrame) -> DataFrame:
    """cu_id, caller, callee, role: references and calls, by the innermost body around them."""
    scope = F.struct("cu_id", "file")
    bodies = placed.filter((F.col("role") == DEF) & F.col("end").isNotNull()).select(F.col("target_sym").alias("body"), scope.alias("file"), F.col("start").alias("st"), F.col("end").alias("en")).distinct()
    used = placed.filter(F.col("role").isin(REF, CALL)).select("cu_id", "file", F.col("start").alias("off"), "target_sym", "role").distinct()
    sites = used.select(F.struct("cu_id", "file", "off").alias("site"), scope.alias("file"), "off").distinct()
    around = innermost(sites, bodies).select("site.cu_id", "site.file", "site.off", F.col("body").alias("caller"))
    return used.join(around, ["cu_id", "file", "off"]).select("cu_id", "caller", F.col("target_sym").alias("callee"), "role")


def graph(entries: DataFrame) -> Graph:
    """The graph of entry streams."""
    return assemble(**raw_tables(entries))


def run_stats(units: DataFrame) -> DataFrame:
    """Totals by language of per-unit results (lang, ok, empty, failed, entries, tail): at most eight tails of failures."""
    totals = [F.sum(F.col(c).cast("long")).alias(c) for c in ("ok", "empty", "failed", "entries")]
    tails = F.slice(F.array_sort(F.collect_set(F.when(F.col("failed"), F.col("tail")))), 1, 8)
    return units.groupBy("lang").agg(F.count(F.lit(1)).alias("units"), *totals, tails.alias("tails"))
