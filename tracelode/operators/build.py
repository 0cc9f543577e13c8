"""From raw rows to the tables of a graph: distinct rows, one row a symbol, names, reverse edges.

Every step is a distinct or a commutative and associative aggregate, so the result depends on the set
of rows alone, not on their order or partitions, and merging graphs is the same build over their union.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import clamp, name_rank
from ..schema import FIELD, UNKNOWN, VARIABLE, Graph
from ..sources.tables import cut

#: Of two kinds that differ, the first of these is taken; the same holds for languages by number.
KIND_ORDER = (FIELD, 2, 1, 5, VARIABLE, UNKNOWN)


def best_name(name: str = "name") -> F.Column:
    """The preferred name of a group."""
    return F.min(name_rank(F.col(name))).getField("name")


def refine(syms: DataFrame) -> DataFrame:
    """One row a symbol of sightings (sym, kind, lang, name): a known kind and language, the preferred name."""
    order = F.array_position(F.array([F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    kind = F.min_by("kind", F.when(order == 0, 99).otherwise(order))
    lang = F.coalesce(F.min(F.when(F.col("lang") != 0, F.col("lang"))), F.lit(0))
    return syms.groupBy("sym").agg(F.coalesce(kind, F.lit(UNKNOWN)).alias("kind"), lang.alias("lang"), best_name().alias("name"))


def least_text(rows: DataFrame, column: str) -> DataFrame:
    """One text a symbol: the least that isn't empty."""
    return rows.filter(F.col(column) != "").groupBy("sym").agg(F.min(column).alias(column))


def least_path(files: DataFrame) -> DataFrame:
    return files.groupBy("file").agg(F.min("path").alias("path"))


def name_rows(syms: DataFrame, aliases: DataFrame) -> DataFrame:
    """Names that find a symbol: its own and its aliases, but no aliases of variables."""
    variables = syms.filter(F.col("kind") == VARIABLE).select("sym")
    other = aliases.filter(F.col("alias") != "").join(variables, "sym", "left_anti")
    own = syms.select("name", "sym")
    return own.union(other.select(F.col("alias").alias("name"), "sym")).withColumn("name", clamp(F.col("name"))).distinct()


def assemble(syms, aliases, files, xrefs, inh, calls, childof, typed, sig) -> Graph:
    """A graph of raw rows; ``aliases``: sym, alias."""
    one = refine(syms)
    return Graph(
        syms=one,
        names=name_rows(one, aliases),
        files=least_path(files),
        xrefs=xrefs.distinct(),
        inh=inh.distinct(),
        calls=calls.distinct(),
        childof=childof.distinct(),
        typed=least_text(typed, "typed"),
        sig=least_text(sig, "sig"),
    )


def reverse(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The same edges by their other end first."""
    return edges.select(b, a, *[c for c in edges.columns if c not in (a, b)]).distinct()


def merge(graphs: list[Graph], local_files: bool = False) -> Graph:
    """One graph of many. ``local_files``: file ids are each graph's own, and become ranks of the paths of all."""
    if local_files:
        graphs = _renumbered(graphs)
    both = lambda parts: reduce(DataFrame.unionByName, parts)
    tables = {t: both([g.tables()[t] for g in graphs]) for t in graphs[0].tables() if t != "names"}
    # a graph's aliases are its name rows that aren't a symbol's own there: one join for all graphs
    numbered = lambda t: both([g.tables()[t].select("sym", "name", F.lit(i).alias("of")) for i, g in enumerate(graphs)])
    aliases = numbered("names").join(numbered("syms"), ["of", "sym", "name"], "left_anti").select("sym", F.col("name").alias("alias"))
    return assemble(aliases=aliases, **tables)


def _renumbered(graphs: list[Graph]) -> list[Graph]:
    every = reduce(DataFrame.union, [g.files.select("path") for g in graphs])
    ids = file_ids(every)
    out = []
    for g in graphs:
        to = g.files.join(ids.withColumnRenamed("file", "new"), "path")
        files = to.select(F.col("new").alias("file"), "path")
        xrefs = g.xrefs.join(to.select("file", "new"), "file").select("sym", "role", F.col("new").alias("file"), "off")
        out.append(Graph(**(g.tables() | {"files": files, "xrefs": xrefs})))
    return out


def file_ids(paths: DataFrame, local_to: str | None = None) -> DataFrame:
    """path, file: the rank of a path among all, or within each ``local_to``, from 0."""
    if local_to:
        order = Window.partitionBy(local_to).orderBy("path")
        return paths.select(local_to, "path").distinct().withColumn("file", (F.row_number().over(order) - 1).cast("long"))
    # ranked within ranges of the first bytes, so that no task sorts all paths
    return ranked(paths.select("path").distinct(), ["path"]).select("path", F.col("rank").alias("file"))


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank``, the place in an order without ties, from 0. Rows are dealt out in ranges of the whole
    order, as many as the session has shuffle partitions or fewer, sorted and numbered there, and written; what the ranges before
    hold, a number a range, is added. So no task sees all rows, and a value that many rows have is in many ranges."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    spread = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()  # range and place in it
    held = cut(spread.withColumn("at", place), "ranked")
    part = F.shiftright("at", 33)
    counts = held.groupBy(part.alias("part")).count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row a range
    out = held.withColumns({"part": part, "nth": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    return out.join(F.broadcast(before), "part").withColumn("rank", (F.col("nth") + F.col("before")).cast("long")).drop("part", "nth", "before", "at")


def continued_ids(paths: DataFrame, known: DataFrame) -> DataFrame:
    """path, file: the known ids, and for new paths ranks after the largest of them."""
    top = known.agg((F.coalesce(F.max("file"), F.lit(-1)) + 1).alias("top"))
    new = file_ids(paths.join(known.select("path"), "path", "left_anti"))
    new = new.join(F.broadcast(top)).select("path", (F.col("file") + F.col("top")).alias("file"))  # one row
    return known.select("path", "file").unionByName(new)


def remapped(rows: DataFrame, bridge: DataFrame, *columns: str, scope: str | None = None) -> DataFrame:
    """``rows`` with the symbols of ``columns`` replaced by the declarations that ``bridge`` (def_sym, decl_sym) gives
    for them, one step. ``scope``: column within which the bridge holds."""
    for c in columns:
        keys = [F.col("def_sym").alias(c), F.col("decl_sym").alias("__decl")] + ([F.col(scope)] if scope else [])
        rows = rows.join(bridge.select(*keys), [scope, c] if scope else [c], "left").withColumn(c, F.coalesce("__decl", c)).drop("__decl")
    return rows
