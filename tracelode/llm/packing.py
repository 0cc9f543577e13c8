"""Best-fit packing into bins of several permitted sequence lengths.

Documents longer than the longest length are cut into pieces of it (the last is shorter); no word is
dropped. Pieces are packed in descending length. A piece goes into the open bin that it leaves the
least room in. If none has room, a bin is opened whose size has the least cost: the room that it
will waste, as expected from the pieces still to come, plus ``OVERHEAD`` words a bin. At the end each
bin is downsized to the smallest permitted length that holds its contents.

Each piece of packing is a bucket of about ``BUCKET`` documents by hash, so a bucket is bounded
whatever the input, and sources or equal texts don't meet in one. Equal lengths are counted, not
compared, so a bucket takes about as many steps as it has pieces.

Defined results: a null or empty text has length 0 and one piece of length 0; documents that repeat
are packed each, and numbered by their count, so files and partitions don't change the result; pieces of equal length go by doc_id, text and number; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, numbered_copies, table
from .mixing import words

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 16
BUCKET = 4_000


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Packs pieces, none longer than the longest length. Gives bin and place in it of each piece, and the
    permitted length of each bin."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[int] = []  # room that was opened
    used: list[int] = []
    of, at = [0] * len(sizes), [0] * len(sizes)
    rooms: list[int] = []  # the rooms that open bins have, ascending
    holders: dict[int, list[int]] = {}  # room -> bins
    tail = sum(sizes)  # words still to come
    for rank, i in enumerate(order):
        size = sizes[i]
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            own = holders[room]
            b = own.pop()
            if not own:
                del holders[room], rooms[k]
        else:
            mean = tail / (len(order) - rank)  # of the pieces to come
            b = len(bins)
            bins.append(min((n for n in lengths if n >= size), key=lambda n: (_cost(n, size, mean, tail), n)))
            used.append(0)
        of[i], at[i] = b, used[b]
        used[b] += size
        tail -= size
        room = bins[b] - used[b]
        if room in holders:
            holders[room].append(b)
        else:
            holders[room] = [b]
            insort(rooms, room)
    fitted = [next(n for n in lengths if n >= u) for u in used]
    return of, at, fitted


def _cost(length: int, size: int, mean: float, tail: float) -> float:
    """Cost a word of a bin of this length with a first piece of this size: what stays empty and the overhead.
    Pieces to come are at most as long as this one and fill the room up to about half of one of them."""
    room = min(length - size, max(0.0, tail - size))
    filled = room - min(room, mean / 2) if mean else 0.0
    return (length - size - filled + OVERHEAD) / (size + filled + 1)


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """doc_id, nth (piece of its document), start and length (words), bin_id, place (in the bin), bin_length for
    every piece of every row of ``docs`` (doc_id, text)."""
    slim = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), words(F.col("text")).alias("words"))
    slim = cut(numbered_copies(slim, "row"), "lengths")
    buckets = max(1, -(-slim.count() // BUCKET))
    top = max(lengths)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("words") - 1, F.lit(0)), F.lit(top).cast("long"))
    pieces = slim.select(
        F.pmod(F.xxhash64("doc_id", "node", "row"), F.lit(buckets)).alias("bucket"), "doc_id", "node", "row", "words", F.posexplode(starts).alias("nth", "start")
    ).withColumn("length", F.least(F.lit(top).cast("long"), F.col("words") - F.col("start")))
    permitted = tuple(sorted(lengths))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "node", "row", "nth"], kind="stable", na_position="first")
        of, at, fitted = pack(rows["length"].tolist(), permitted)
        out = rows[["bucket", "doc_id", "nth", "start", "length"]]
        return out.assign(bin=np.array(of, np.int32), place=np.array(at, np.int32), bin_length=np.array([fitted[b] for b in of], np.int32))

    out = pieces.drop("words").groupBy("bucket").applyInPandas(packed, "bucket long, doc_id long, nth int, start long, length long, bin int, place int, bin_length int")
    return out.select("doc_id", "nth", "start", "length", F.concat_ws("-", "bucket", "bin").alias("bin_id"), "place", "bin_length")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece: doc_id, nth, start, length, bin_id, place, bin_length."""
    return pack_documents(table(spark, sf_dir, "documents"))
