"""Mixing sources to target weights by Pareto order sampling.

The weights share the size of all documents (size: number of words); no target is above
``MAX_REPEATS`` times its source's size, and what is over is shared out again by weight. In closed
form: a target is min(cap, weight times level), and the level makes the targets add up.

A source of target t and size s takes each document floor(t / s) whole times. The rest of t is a
sample of unequal probabilities: a document's inclusion chance is proportional to its size, under 1,
so that the expected words are those wanted, and documents are ranked by the odds of a uniform number
over the odds of that chance (Pareto order sampling); those of lowest rank make the sample. Its fixed
size is in words: documents are taken in order of rank while they fit what is left. A document that doesn't fit is passed over, later ones
fill what is left, and at most ``EXCHANGES`` exchanges come nearer still.

Ranks fall into bins, so only sums per bin are gathered; whole bins are taken up to the bin where the
target falls, and the rows of that bin and of the ``FILL`` bins after it are ranked one by one. What is
left then is filled in the same way from all later bins, by their documents that still fit, until
nothing is left or no document of the source fits it. Bins are even for a document of the source's
geometric mean size, so long documents do not press the others into the last bins. Exchanges are
among the rows that were ranked one by one. The uniform numbers are hashes of doc_id and text, so
reruns agree.

Defined results: a null or empty text has size 0 and is not taken; a null source is a source, the
last in order; equal rows have equal ranks, and one of them may be taken and the other not; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, hot_join, table

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
ROWS_A_BIN, BINS = 200, 1_000_000  # rows of a bin, about, while a source has no more bins than that
FILL = 3
EXCHANGES = 8


def words(text: Column) -> Column:
    """Number of words: runs of characters that are not ASCII white space."""
    bare = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(bare, " +", -1), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes``: source, source_size and others. Adds weight and target. One row a source."""
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array([F.lit(float(w)) for w in weights])
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    out = sizes.withColumn("weight", F.get(cycle, place)).withColumn("cap", F.col("source_size") * float(MAX_REPEATS))
    out = out.withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    under = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0.0))
    level = (F.sum("source_size").over(every) - none(F.sum("cap").over(under))) / (F.sum("weight").over(every) - none(F.sum("weight").over(under)))
    out = out.withColumn("level", level)
    # the level that holds is that of the first source, by ratio, which stays under its cap
    holds = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(every)["level"]
    return out.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(holds, F.lit(float("inf"))))).drop("cap", "ratio", "level")


def _take(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows of one source's open bins, taken by rank while they fit."""
    rows = rows.sort_values(["rank", "row"], kind="stable")
    left, extra = float(rows["left"].iloc[0]), np.zeros(len(rows), np.int32)
    for i, n in enumerate(rows["size"].to_numpy()):
        if n <= left:
            extra[i] = 1
            left -= n
    return rows[["nth", "row", "rank", "size"]].assign(extra=extra)


def _exchange(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one source's rows that were ranked one by one: the one addition or exchange that comes nearest to what is
    left, while there is one that comes nearer."""
    rows = rows.sort_values(["rank", "row"], kind="stable")
    size, left = rows["size"].to_numpy(), float(rows["left"].iloc[0])
    taken = rows["extra"].to_numpy() > 0
    for _ in range(EXCHANGES):
        inside, outside = np.append(np.flatnonzero(taken), -1), np.flatnonzero(~taken)  # -1: nothing is given back
        if not len(outside):
            break
        order = outside[np.argsort(size[outside], kind="stable")]
        back = np.where(inside >= 0, size[inside], 0)
        at = np.searchsorted(size[order], back + left)
        best = min((abs(left + b - size[order[j]]), i, order[j]) for i, b, k in zip(inside.tolist(), back.tolist(), at.tolist(), strict=True) for j in (k - 1, k) if 0 <= j < len(order))
        if best[0] >= abs(left):
            break
        _, i, j = best
        left += (size[i] if i >= 0 else 0) - size[j]
        taken[j] = True
        if i >= 0:
            taken[i] = False
    return pd.DataFrame({"row": rows["row"].to_numpy(), "extra": taken.astype(np.int32)})


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, node (hash of the text), size, source, source_size, target, copies for every row of ``docs`` (doc_id, text, source)."""
    slim = docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    slim = cut(slim.withColumn("row", F.monotonically_increasing_id()), "sizes")  # the row number holds once it is written
    goal = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size")).alias("squares"), F.count(F.when(F.col("size") > 0, 1)).alias("n"), F.avg(F.when(F.col("size") > 0, F.log("size"))).alias("log_size")), weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # a ratio within rounding of a whole number is that number
    near = F.round(ratio)
    ratio = F.when(F.abs(ratio - near) < 1e-9, near).otherwise(ratio)
    goal = goal.withColumn("whole", F.floor(ratio).cast("int")).withColumn("part", ratio - F.floor(ratio))
    goal = cut(goal.withColumn("rest", F.col("part") * F.col("source_size")).withColumn("nth", F.monotonically_increasing_id()), "targets")
    n = goal.count()
    small = lambda df: F.broadcast(df) if n <= 100_000 else df  # a row a source
    rows = slim.join(small(goal), slim["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    u = (F.pmod(F.xxhash64("doc_id", "node", F.lit(11)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    chance = lambda size: F.least(F.lit(0.999), F.col("rest") * size / F.col("squares"))
    odds = lambda p: p / (1 - p)
    rank = odds(u) / odds(chance(F.col("size")))
    rows = rows.withColumn("rank", F.when((F.col("size") > 0) & (F.col("rest") > 0), rank))
    bins = F.greatest(F.lit(1), F.least(F.lit(BINS), F.ceil(F.col("n") / ROWS_A_BIN))).cast("double")
    level = F.col("rank") * odds(chance(F.exp("log_size")))
    rows = rows.withColumn("bin", F.floor(level / (1 + level) * bins).cast("int"))
    rows = cut(rows.select("doc_id", "node", "size", "source", "source_size", "target", "whole", "row", "nth", "rank", "bin"), "ranked")
    placed = rows.filter("rank is not null").select("nth", "row", "rank", "size", "bin")
    state = goal.filter("rest > 0").select("nth", F.col("rest").alias("left"), F.lit(-1).alias("after"), F.lit(float("inf")).alias("most"))
    upto, source = Window.partitionBy("nth").orderBy("bin"), Window.partitionBy("nth")
    spans, opened, ends = [], [], []
    while not state.isEmpty():
        # what is left is filled from the bins after those that are done, by documents of the size ``most`` at most
        free = placed.join(small(state), "nth").filter("bin > after and size <= most")
        sums = free.groupBy("nth", "bin", "left", "after", "most").agg(F.sum("size").alias("bin_size"))
        sums = sums.withColumn("upto", F.sum("bin_size").over(upto)).withColumn("order", F.row_number().over(upto))
        # of each source: the bin where the sum passes what is left; none if all that fits may be taken
        sums = sums.withColumn("edge_order", F.min(F.when(F.col("upto") > F.col("left"), F.col("order"))).over(source))
        span = sums.groupBy("nth", "left", "after", "most").agg(
            F.min(F.when(F.col("order") == F.col("edge_order"), F.col("bin"))).alias("edge"),
            F.max(F.when(F.col("order") <= F.col("edge_order") + FILL, F.col("bin"))).alias("until"),
            F.sum(F.when(F.col("edge_order").isNull() | (F.col("order") < F.col("edge_order")), F.col("bin_size")).otherwise(0)).alias("spent"),
        )
        span = cut(span, "spans")
        some = placed.join(small(span.withColumn("left", F.col("left") - F.col("spent"))), "nth").filter("bin >= edge and bin <= until and size <= most")
        some = cut(some.select("nth", "row", "rank", "size", "left").groupBy("nth").applyInPandas(_take, "nth long, row long, rank double, size long, extra int"), "open")
        more = some.groupBy("nth").agg(F.sum(F.col("size") * F.col("extra")).alias("more"))
        end = span.join(more, "nth", "left").withColumn("left", F.col("left") - F.col("spent") - F.coalesce("more", F.lit(0)))
        end = cut(end.select("nth", "left", F.col("until").alias("after")), "ends")
        spans.append(span.select("nth", "after", "edge", "most"))
        opened.append(some)
        ends.append(end.select("nth", "left"))
        state = end.filter("after is not null and left >= 1").withColumn("most", F.col("left"))
    if spans:
        every = lambda parts: reduce(DataFrame.union, parts)
        least = every(ends).groupBy("nth").agg(F.min("left").alias("left"))
        extra = every(opened).join(small(least), "nth").groupBy("nth").applyInPandas(_exchange, "row long, extra int")
        done = every(spans).groupBy("nth").agg(F.collect_list(F.struct("after", "edge", "most")).alias("spans"))
        rows = rows.join(small(done), "nth", "left").join(extra.filter("extra > 0"), "row", "left")
        bin_taken = F.exists("spans", lambda x: (F.col("bin") > x["after"]) & (x["edge"].isNull() | (F.col("bin") < x["edge"])) & (F.col("size") <= x["most"]))
        more = F.when(F.col("rank").isNull(), 0).when(bin_taken, 1).otherwise(F.coalesce("extra", F.lit(0)))
    else:
        more = F.lit(0)
    copies = F.when(F.col("size") > 0, F.col("whole") + more).otherwise(0).cast("int")
    return rows.select("doc_id", "node", "size", "source", "source_size", "target", copies.alias("copies"), "row")


def mix_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. ``docs`` is read more than once, so a written table is best."""
    key = lambda id_, node, of: F.struct(id_.alias("id"), node.alias("node"), of.alias("of"))  # noqa: E731 (nulls in a struct are equal)
    plan = mix(docs, weights).groupBy("doc_id", "node", "source").agg(F.min("copies").alias("least"), F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n"))
    plan = cut(plan.select(key(F.col("doc_id"), F.col("node"), F.col("source")).alias("key"), "least", "total", "n"), "copies")
    even = F.col("total") == F.col("n") * F.col("least")
    known = plan.agg(F.sum("n").alias("rows"), F.count(F.when(~even, 1)).alias("uneven")).first()
    # the row is one value, so no name of its columns meets one of these
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(row.alias("row"), key(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))), F.col("source")).alias("key"))
    rows_of = lambda some: hot_join(rows, plan.filter(some), ["key"], "n", known["rows"] or 0)
    times = rows_of(even & (F.col("least") > 0)).select("row", F.col("least").cast("long").alias("times"))
    if known["uneven"]:
        # rows that repeat share their copies, and the first get one of what doesn't divide; equal rows are counted before they move
        counts = rows_of(~even).groupBy("key", "total", "n", "row").agg(F.count(F.lit(1)).alias("same"))
        upto = F.sum("same").over(Window.partitionBy("key").orderBy(F.xxhash64("row"), "row").rowsBetween(Window.unboundedPreceding, 0))
        one_more = F.greatest(F.lit(0), F.least(F.col("same"), F.col("total") % F.col("n") - (upto - F.col("same"))))
        times = times.unionByName(counts.select("row", (F.col("same") * F.floor(F.col("total") / F.col("n")) + one_more).cast("long").alias("times")))
    times = times.filter("times > 0")
    return times.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, copies."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "copies")
