"""Sharding by sampled splitters, in DataFrame functions only. Its law is ``bytes``: shards of near equal size.

Records are ordered by the hash of their text, so equal texts stand together, then by a hash of
doc_id and of the number of the record among those equal to it, so the result depends on the records alone, not on
how files or partitions hold them. A sample of keys, drawn with chances in proportion to the records' sizes, is
all that the driver sees of the rest (``SAMPLE`` keys are expected at most, whatever the input); its
quantiles are splitters of ranges. A group that is larger than a range has several splitters among its rows, so
hot groups are cut by the same rule. Each range is subdivided into bins by the hash, more of them the
more rows there are, so what one task sorts is bounded.

Records that are larger than ``LARGE`` of a shard, of which there can't be more than ``SHARDS / LARGE``, are placed
first, the largest into the emptiest shard, equal ones together; the ranges fill what they leave. The
exact bytes of all bins put each record at an offset of the whole order, and its place there gives its
shard. A group of equal texts within a bin moves as one while it is under ``WHOLE`` of a shard; a
larger one is cut between rows.

Defined results: a null text has size 1 (no bytes, plus one) and checksum 0, and is one with the
empty text; null doc_ids are a value like any other; repeated rows are separate records, numbered by their count; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, numbered_copies, table

SHARDS = 16
SAMPLE = 65_536  # keys that the driver gets, expected
RANGES = 2_048  # at most
ROWS_A_BIN = 20_000
WHOLE = 0.04  # of a shard: larger groups are cut
LARGE = 0.01  # of a shard: larger records are placed one by one
WHOLE_LARGE = 0.25  # of a shard: larger groups of large records are cut


def _rank(splitters: list[tuple[int, int]], key: Column, tie: Column) -> Column:
    """How many splitters are not above (key, tie): a binary search in two arrays. len + 1 is a power of two."""
    high, low = (F.array([F.lit(s[i]) for s in splitters]) for i in (0, 1))
    steps, n = [], (len(splitters) + 1) // 2
    while n:
        steps.append(n)
        n //= 2

    def step(at: Column, n: Column) -> Column:
        a, b = F.element_at(high, at + n), F.element_at(low, at + n)
        return F.when((key > a) | ((key == a) & (tie >= b)), at + n).otherwise(at)

    return F.aggregate(F.array([F.lit(s) for s in steps]), F.lit(0), step)


def place_large(rows: list[tuple[int, int, int, int]], shards: int, share: float) -> tuple[list[tuple[int, int, int, int, int]], list[float], list[int]]:
    """(key, tie, nth, shard, slot) of the large records (key, tie, nth, size), and the bytes and records that each shard then has.
    Records of one key are one while they are under ``WHOLE_LARGE`` of a shard's ``share``."""
    units: dict[tuple, list[tuple[int, int, int, int]]] = {}
    total: dict[int, int] = {}
    for key, _, _, size in rows:
        total[key] = total.get(key, 0) + size
    for row in sorted(rows):
        units.setdefault(row[:1] if total[row[0]] <= WHOLE_LARGE * share else row[:3], []).append(row)
    load, count, out = [0.0] * shards, [0] * shards, []
    for _, own in sorted(units.items(), key=lambda u: (-sum(x[3] for x in u[1]), u[0])):
        k = min(range(shards), key=lambda i: (load[i], i))
        for key, tie, nth, size in own:
            out.append((key, tie, nth, k, count[k]))
            load[k] += size
            count[k] += 1
    return out, load, count


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs`` (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    slim = cut(numbered_copies(slim, "nth").withColumn("tie", F.xxhash64("doc_id", "nth")), "slim")
    total = slim.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not total["rows"]:
        return slim.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    share = total["bytes"] / shards
    big = slim.filter(F.col("size") > LARGE * share)  # their number is bounded by their size
    large, load, count = place_large([tuple(r) for r in big.select("key", "tie", "nth", "size").collect()], shards, share)
    if large:
        slim = slim.filter(F.col("size") <= LARGE * share)
    room = [max(0.0, share - x) for x in load]
    rest = sum(room)
    ranges = 64
    while ranges < RANGES and ranges * ROWS_A_BIN / 4 < total["rows"]:
        ranges *= 2
    chance = F.least(F.lit(1.0), F.col("size") * (min(SAMPLE, 32 * ranges) / total["bytes"]))
    drawn = F.pmod(F.xxhash64("tie", F.lit(7)), F.lit(1 << 30)) / float(1 << 30) < chance
    sample = sorted((r["key"], r["tie"]) for r in slim.filter(drawn).select("key", "tie").collect())
    if sample:
        cuts = [sample[i * len(sample) // ranges] for i in range(1, ranges)]
    else:
        cuts = [(0, 0)] * (ranges - 1)
    parts = max(1, -(-total["rows"] // (ranges * ROWS_A_BIN)))
    hot = sorted({a for a, b in zip([c[0] for c in cuts], [c[0] for c in cuts[1:]], strict=False) if a == b})
    # within a range the order is by bin first: by text, but by row for the texts that have a range of their own
    by = F.when(F.col("key").isin(hot), F.col("tie")).otherwise(F.col("key")) if hot else F.col("key")
    bins = slim.withColumn("range", _rank(cuts, F.col("key"), F.col("tie"))).withColumn("bin", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int"))
    size = bins.groupBy("range", "bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    whole = size.groupBy("range").agg(F.sum("bytes").alias("range_bytes"), F.sum("rows").alias("range_rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    whole = whole.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("range_bytes", "range_rows")])
    before = Window.partitionBy("range").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    size = size.join(F.broadcast(whole), "range").select(
        "range",
        "bin",
        (F.col("range_bytes_before") + F.coalesce(F.sum("bytes").over(before), F.lit(0))).alias("bytes_before"),
        (F.col("range_rows_before") + F.coalesce(F.sum("rows").over(before), F.lit(0))).alias("rows_before"),
    )
    order = Window.partitionBy("range", "bin").orderBy("key", "tie", "doc_id", "nth")
    group = Window.partitionBy("range", "bin", "key")
    placed = bins.withColumns(
        {
            "nth": F.row_number().over(order) - 1,
            "upto": F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    placed = placed.withColumns({"group_end": F.max("upto").over(group), "group_bytes": F.sum("size").over(group)})
    placed = placed.join(size, ["range", "bin"])
    middle = F.when(F.col("group_bytes") <= WHOLE * share, F.col("group_end") - F.col("group_bytes") / 2).otherwise(F.col("upto") - F.col("size") / 2)
    # where the room of each shard ends, in the bytes of the small records
    small = total["bytes"] - sum(load)
    ends = [sum(room[: k + 1]) * small / rest for k in range(shards - 1)] if rest else []
    at = sum((F.col("bytes_before") + middle >= F.lit(e)).cast("int") for e in ends) if ends else F.lit(0)
    placed = placed.select("doc_id", "size", "text_crc32", at.alias("shard"), (F.col("rows_before") + F.col("nth")).alias("place"))
    placed = cut(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    before_it = F.element_at(F.array([F.lit(c) for c in count]), F.col("shard") + 1)
    out = placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first") + before_it).cast("long").alias("slot"))
    if not large:
        return out
    where = slim.sparkSession.createDataFrame(large, "key long, tie long, nth long, shard int, slot long")  # a row a large record
    return out.unionByName(big.join(F.broadcast(where), ["key", "tie", "nth"]).select("doc_id", "size", "text_crc32", "shard", "slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
