"""Breadth-first forests over call and inheritance edges, one bounded job a hop.

What a hop looks at is the frontier, which ``max_syms`` bounds, so the frontier is handed to the next
job as literal rows and joined by broadcast; the edge tables are only filtered. Copies of one element
(symbols that share a name and its logical key) are one node with the edges of all copies. Nodes are
admitted in the order of parent, direction and symbol, so a forest doesn't depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import display_name, kind_label, logical_key, passes, place, sym_order
from ..schema import Graph
from ..sources.tables import cut, local
from .resolve import PINNED, lookup
from .verbs import first_paths, narrowed, pinned, places

DEPTH, MAX_SYMS, ROOTS = 3, 200, 16
_NODE = "id int, parent int, hop int, dir string, sym long, name string"


def _named(g: Graph, rows: DataFrame, ids: list[int] | None = None) -> DataFrame:
    known = narrowed(g.syms, "sym", ids).select("sym", "name")
    missing = F.concat(F.lit("<sym "), F.lpad(F.lower(F.hex("sym")), 16, "0"), F.lit(">"))
    return rows.join(known, "sym", "left").withColumn("name", F.coalesce("name", missing))


def _kept(g: Graph, rows: DataFrame, in_: str | None, not_in: str | None, ids: list[int] | None = None) -> DataFrame:
    wanted = passes(F.coalesce("def_path", F.lit("")), in_, not_in)
    if wanted is None:
        return rows
    return rows.join(first_paths(g, rows, ids), "sym", "left").filter(wanted).drop("def_path")


def _copies(g: Graph, nodes: list[tuple[int, int, str]]) -> tuple[DataFrame, list[int] | None]:
    """sym, id of every copy of the nodes (sym, id, name), and their ids if they are few: symbols that share a name row with the
    node (its name or an alias) and its logical key. Names and symbols are looked up by value while they are few."""
    own = local(g.spark, nodes, "sym long, id int, name string")
    called = narrowed(g.by("names", "sym"), "sym", sorted({n[0] for n in nodes})).select("sym", F.col("name").alias("shared"))
    called = called.join(F.broadcast(own), "sym").select("shared", "id", "name").union(own.select(F.col("name").alias("shared"), "id", "name")).distinct()
    rows = called.limit(PINNED + 1).collect()
    names = g.names
    if len(rows) <= PINNED:
        called = local(g.spark, rows, called.schema)
        names = names.filter(F.col("name").isin(sorted({r["shared"] for r in rows})))
    same = names.select(F.col("name").alias("shared"), "sym").join(F.broadcast(called), "shared").select("sym", "id", "name").distinct()
    same, ids = pinned(same)
    same = same.join(narrowed(g.syms, "sym", ids).select("sym", F.col("name").alias("own")), "sym")
    same = same.filter(logical_key(F.col("own")) == logical_key(F.col("name"))).select("sym", "id")
    every = None if ids is None else sorted({*ids, *[n[0] for n in nodes]})
    return own.select("sym", "id").union(same).distinct(), every if every is None or len(every) <= PINNED else None


def forest(
    g: Graph, name: str, table: str, direction: str = "up", depth: int = DEPTH, max_syms: int = MAX_SYMS, substr: bool = False,
    root_limit: int = ROOTS, in_: str | None = None, not_in: str | None = None, def_in: str | None = None,
) -> DataFrame:
    """id, parent, hop, dir, kind, name, def of a forest from the symbols of a name. ``table``: ``calls`` or ``inh``.
    Roots are never cut off; behind them at most ``max_syms`` nodes in all, and one node at least."""
    spark = g.spark
    frm, to = ("caller", "callee") if table == "calls" else ("child", "parent")
    up, down = ((to, frm), (frm, to)) if table == "calls" else ((frm, to), (to, frm))
    ways = [w for w in (("up", 0, up), ("down", 1, down)) if direction in (w[0], "both")]
    roots, ids = pinned(lookup(g, name, substr, root_limit))
    if def_in:
        roots = roots.join(first_paths(g, roots, ids).filter(F.col("def_path").contains(def_in)).select("sym"), "sym", "left_semi")
    roots = _named(g, _kept(g, roots, in_, not_in, ids), ids).withColumn("key", logical_key(F.col("name")))
    first = roots.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("seq"))).filter("nth = 1").orderBy("seq")
    nodes = [(i, None, 0, "root", r["sym"], r["name"]) for i, r in enumerate(first.select("sym", "name").collect())]  # the roots of one request
    seen, frontier = {_key(n[5]) for n in nodes}, nodes
    room = max(max_syms, len(nodes) + 1)
    for hop in range(1, depth + 1):
        if not frontier or not ways or len(nodes) >= room:
            break
        at, ids = _copies(g, [(n[4], n[0], n[5]) for n in frontier])
        found = None
        for label, rank, (a, b) in ways:
            near = narrowed(g.by(table, a), a, ids).join(F.broadcast(at), F.col(a) == F.col("sym")).select(F.col(b).alias("next"), F.col("id").alias("parent"), F.lit(rank).alias("rank"), F.lit(label).alias("dir"))
            found = near if found is None else found.union(near)
        found, ids = pinned(found.withColumnRenamed("next", "sym"))
        found = _named(g, _kept(g, found, in_, not_in, ids), ids).withColumn("key", logical_key(F.col("name")))
        old = local(spark, [(k,) for k in sorted(seen)], "key string")
        found = found.join(F.broadcast(old), "key", "left_anti")
        at_ = F.struct("parent", "rank", sym_order(F.col("sym")).alias("order"))
        best = found.groupBy("key").agg(F.min_by(F.struct("sym", "name", "dir", "parent"), at_).alias("n"), F.min(at_).alias("at"))
        rows = best.orderBy("at").limit(room - len(nodes)).select("n.*").collect()  # max_syms at most
        frontier = [(len(nodes) + i, r["parent"], hop, r["dir"], r["sym"], r["name"]) for i, r in enumerate(rows)]
        nodes = nodes + frontier
        seen |= {_key(n[5]) for n in frontier}
    out, ids = local(spark, nodes, _NODE), [n[4] for n in nodes]
    out = out.join(narrowed(g.syms, "sym", ids).select("sym", "kind"), "sym", "left").join(places(g, out, ids), "sym", "left")
    shown = F.col("name") if table == "calls" else display_name(F.col("name"), F.col("path"), F.col("off"))
    return out.select("id", "parent", "hop", "dir", kind_label(F.coalesce("kind", F.lit(0))).alias("kind"), shown.alias("name"), place(F.col("path"), F.col("off")).alias("def"))


def _key(name: str) -> str:
    return name.rsplit("#", 1)[-1] if name.startswith("kythe:") else name


def callgraph(g: Graph, name: str, **options) -> DataFrame:
    return forest(g, name, "calls", **options)


def inheritance(g: Graph, name: str, **options) -> DataFrame:
    return forest(g, name, "inh", **options)


def least_hops(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """sym, hop: what can be reached from ``start`` (sym) over ``edges`` (src, dst) in ``depth`` hops, with the least
    hop. Set-wise, for whole graphs: nothing is gathered on the driver, and each hop is written, so plans don't grow."""
    step = cut(edges.select("src", "dst").distinct(), "edges")
    frontier = cut(start.select("sym").distinct(), "hop")
    reached = frontier.withColumn("hop", F.lit(0))
    for hop in range(1, depth + 1):
        near = step.join(frontier, step["src"] == frontier["sym"]).select(F.col("dst").alias("sym")).distinct()
        frontier = cut(near.join(reached.select("sym"), "sym", "left_anti"), "hop")
        reached = reached.unionByName(frontier.withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
    return reached
