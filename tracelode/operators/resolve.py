"""From names to symbols: exact, by prefix, and by substring with and without trigrams.

Every operator takes one needle or, as a column of a table, many; with many, one job answers all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import fold, sym_hex, sym_order
from ..schema import Graph
from .build import ranked

#: Values up to this many go into the plan, so that scans prune row groups by them.
PINNED = 512


def exact(names: DataFrame, name: str) -> DataFrame:
    """sym, seq: all symbols of a name, in order of their unsigned ids."""
    found = names.filter(F.col("name") == name).select("sym").distinct()
    return found.withColumn("seq", F.row_number().over(Window.orderBy(sym_order(F.col("sym")))))


def exact_many(names: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, sym for every needle of a table."""
    return names.join(needles.select(F.col("needle").alias("name")).distinct(), "name").select(F.col("name").alias("needle"), "sym").distinct()


def first(names: DataFrame, name: str) -> DataFrame:
    """The least symbol of a name."""
    return exact(names, name).filter("seq = 1").select("sym")


def prefix(names: DataFrame, start: str, limit: int = 32) -> DataFrame:
    """name, sym (hexadecimal) by name and symbol; each pair once."""
    rows = names.filter(F.col("name").startswith(start)).select("name", "sym").distinct()
    return rows.orderBy("name", sym_order(F.col("sym"))).limit(limit).select("name", sym_hex(F.col("sym")).alias("sym"))


def substring(names: DataFrame, needle: str, limit: int, ignore_case: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """sym, seq: distinct symbols with a name that holds the needle, in order of their first such name. No needle,
    or a limit of 0, finds nothing. ``rows``: name rows that may hold it (from trigrams)."""
    name = fold(F.col("name")) if ignore_case else F.col("name")
    want = fold(F.lit(needle)) if ignore_case else F.lit(needle)
    source = names if rows is None else rows
    found = source.filter(name.contains(want) & F.lit(bool(needle)))
    top = found.groupBy("sym").agg(F.min("name").alias("name")).orderBy("name", sym_order(F.col("sym"))).limit(max(0, limit))
    return top.select("sym", F.row_number().over(Window.orderBy("name", sym_order(F.col("sym")))).alias("seq"))


def lookup(g: Graph, name: str, substr: bool, limit: int, ignore_case: bool = False) -> DataFrame:
    """sym, seq of a name, or of a part of names; trigrams narrow the latter down if the graph has them."""
    return substring(g.names, name, limit, ignore_case, g.likely(name)) if substr else exact(g.names, name)


def trigrams(text: Column) -> Column:
    """Distinct three-byte windows of the text with ASCII letters folded, as hexadecimal."""
    bytes_ = F.hex(fold(text))
    n = F.octet_length(text)
    windows = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(bytes_, 2 * i - 1, F.lit(6)))
    return F.when(n >= 3, F.array_distinct(windows)).otherwise(F.array().cast("array<string>"))


def numbered(names: DataFrame) -> DataFrame:
    """names with row_id, the place in the order by name and symbol."""
    rows = names.select("name", "sym").distinct()
    return ranked(rows, [F.col("name"), sym_order(F.col("sym"))]).select("name", "sym", F.col("rank").alias("row_id"))


def trigram_postings(rows: DataFrame) -> DataFrame:
    """tri, row_id of every name row."""
    return rows.select(F.explode(trigrams(F.col("name"))).alias("tri"), "row_id")


def trigram_dictionary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("tri").agg(F.count(F.lit(1)).alias("cnt"))


def windows(needle: str) -> list[str]:
    """The distinct trigrams of a needle, in order; none if it has less than three bytes."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in needle.encode())
    return sorted({data[i : i + 3].hex().upper() for i in range(len(data) - 2)})


def candidates(rows: DataFrame, postings: DataFrame, needle: str) -> DataFrame:
    """Name rows that have every trigram of the needle: intersection by counting. Needles under three bytes have
    none, and all rows are candidates."""
    wanted = windows(needle)
    if not wanted:
        return rows
    return rows.join(_with_all(postings, wanted), "row_id")


def _with_all(postings: DataFrame, wanted: list[str]) -> DataFrame:
    """row_id of the rows that have all of the trigrams."""
    return postings.filter(F.col("tri").isin(wanted)).groupBy("row_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("row_id")


def likely(rows: DataFrame, postings: DataFrame, dictionary: DataFrame, needle: str, names: int) -> DataFrame | None:
    """Name rows among which are all that hold the needle: those with its rarest trigrams. The dictionary tells their
    numbers, so that a trigram that no name has ends the search, few rows are read by their ids, and a needle whose trigrams are all
    frequent among ``names`` rows is left to a scan (None)."""
    wanted = windows(needle)
    if not wanted:
        return None
    known = {r["tri"]: r["cnt"] for r in dictionary.filter(F.col("tri").isin(wanted)).collect()}  # a row a trigram of the needle
    if len(known) < len(wanted):
        return rows.limit(0)
    rare = sorted(wanted, key=lambda t: (known[t], t))[:3]
    if known[rare[0]] > names / 4:
        return None
    if known[rare[0]] <= PINNED:
        ids = [r["row_id"] for r in _with_all(postings, rare).collect()]  # PINNED at most
        return rows.filter(F.col("row_id").isin(ids)) if ids else rows.limit(0)
    return rows.join(_with_all(postings, rare), "row_id")


def rarest(dictionary: DataFrame, needle: str) -> DataFrame:
    """The needle's trigram with the fewest postings."""
    tri = dictionary.sparkSession.range(1).select(F.explode(trigrams(F.lit(needle))).alias("tri"))
    return dictionary.join(F.broadcast(tri), "tri").orderBy("cnt", "tri").limit(1)
