"""Innermost enclosing interval.

Sites meet intervals by file and by bins of the offset. An interval is put in bins of a width that
fits its own length (a power of two at most as long as it), so it lies in three bins at most however long
it is, and a site looks in one bin of each width that occurs. A hot file is spread over its bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def innermost(sites: DataFrame, bodies: DataFrame, outer: bool = False) -> DataFrame:
    """``sites`` (site, file, off) with ``body`` of the enclosing interval of ``bodies`` (body, file, st, en), that is
    st <= off < en, with the largest start; ties by the least end, then the least body. Offsets are integers.
    Sites without one are left out, or with ``outer`` have a null body."""
    size = F.greatest(F.col("en") - F.col("st"), F.lit(1))
    level = F.floor(F.log2(size.cast("double"))).cast("int")
    width = F.expr("shiftleft(1L, level)")
    whole = bodies.filter("en > st").withColumn("level", level)
    first, last = F.floor(F.col("st") / width), F.floor((F.col("en") - 1) / width)
    binned = whole.withColumn("bin", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    levels = [r["level"] for r in whole.select("level").distinct().collect()]  # 63 at most
    at = F.array([F.struct(F.lit(k).alias("level"), F.floor(F.col("off") / F.lit(1 << k)).cast("long").alias("bin")) for k in sorted(levels)] or [F.struct(F.lit(0).alias("level"), F.lit(0).cast("long").alias("bin"))])
    looked = sites.withColumn("at", F.explode(at)).select("site", "file", "off", "at.level", "at.bin")
    near = looked.join(binned, ["file", "level", "bin"]).filter("st <= off and off < en")
    order = F.struct(F.negative("st").alias("st"), "en", "body")
    best = near.groupBy("site").agg(F.min(order).getField("body").alias("body"))
    return sites.join(best, "site", "left" if outer else "inner")
