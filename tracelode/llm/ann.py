"""Approximate nearest neighbours for maximum inner product, by score-aware (anisotropic) quantisation.

* Training, on ``TRAIN`` vectors at most (those with the least hashes): codebooks of 16 words for
  every pair of dimensions. The loss of a vector weighs the part of its residual that is parallel to
  it ``ETA`` times the rest, since that part moves the large inner products: assignments are improved
  coordinate by coordinate on that loss, and each codeword is its weighted least-squares solution.
* Index: every distinct vector gets its codes, two to a byte. Equal vectors are one entry with the
  ``k + 1`` least ids, which are all that a result of k can hold of them.
* Search: queries are put in blocks and meet the index in blocks. A scan adds, for every query and
  entry, table values of the entry's bytes (two four-bit codes index a table of 256 sums) and keeps
  the ``KEEP`` best of the block; these are ranked again by exact inner products in double precision,
  so a block gives k rows a query and a second step merges them.

Index blocks are dealt by hash, about ``ENTRIES_A_CELL`` entries each, and every query meets the codes
of every block: no row is out of a query's reach at any size, and a block ranks ``KEEP`` of its own
again, so recall does not fall as blocks are added. The work is queries times entries.

Defined results: vectors that are null, zero, hold a null or non-finite component, or have another
dimension than most, take no part; a null vec_id takes no part; a query is not its own neighbour;
equal rows of one vec_id are one, and different vectors of one vec_id are separate candidates (as a query, the least of them
counts, and none of them is its neighbour); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, table

K, EVERY = 20, 20
TRAIN = 20_000
ETA = 4.0
KEEP = 200  # entries of a block that are ranked again, for each query
QUERIES = 4_096  # of a block, about
ENTRIES_A_CELL = 4_096  # entries of a block, about


def _halves(x: np.ndarray) -> np.ndarray:
    """n x d as m x n x 2, one pair of dimensions after the other; an odd last dimension is paired with zeros."""
    if x.shape[1] % 2:
        x = np.hstack([x, np.zeros((len(x), 1), x.dtype)])
    return np.ascontiguousarray(x.reshape(len(x), -1, 2).transpose(1, 0, 2))


def train(x: np.ndarray, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Codebooks, m x 16 x 2."""
    rng = np.random.default_rng(seed)
    parts = _halves(x)
    books = np.stack([p[rng.choice(len(p), 16, replace=len(p) < 16)] for p in parts]).astype(np.float64)
    books += rng.normal(0, 1e-4, books.shape)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    direction = _halves(unit)
    for _ in range(rounds):
        codes = encode(x, books)
        m, n, _ = parts.shape
        along = sum(np.einsum("ni,ni->n", direction[j], parts[j] - books[j][codes[:, j]]) for j in range(m))
        for j in range(m):
            # least squares of |r|^2 + (eta - 1) (u.r)^2 over the words of this pair, the others held
            own = np.einsum("ni,ni->n", direction[j], parts[j] - books[j][codes[:, j]])
            rest = along - own
            for w in range(16):
                at = codes[:, j] == w
                if not at.any():
                    books[j, w] = parts[j][rng.integers(n)]
                    continue
                u, p = direction[j][at], parts[j][at]
                a = at.sum() * np.eye(2) + (ETA - 1) * (u.T @ u)
                b = p.sum(axis=0) + (ETA - 1) * (u * (np.einsum("ni,ni->n", u, p) + rest[at])[:, None]).sum(axis=0)
                books[j, w] = np.linalg.solve(a, b)
            along = rest + np.einsum("ni,ni->n", direction[j], parts[j] - books[j][codes[:, j]])
    return books


def encode(x: np.ndarray, books: np.ndarray, passes: int = 2) -> np.ndarray:
    """Codes n x m that lower the anisotropic loss, pair by pair."""
    parts = _halves(x)
    direction = _halves(x / np.linalg.norm(x, axis=1, keepdims=True))
    m, n, _ = parts.shape
    codes = np.empty((n, m), np.uint8)
    square, inner = [], []
    for j in range(m):
        r = parts[j][:, None, :] - books[j][None]
        square.append(np.einsum("nwi,nwi->nw", r, r))
        inner.append(np.einsum("ni,nwi->nw", direction[j], r))
        codes[:, j] = np.argmin(square[j], axis=1)
    rows = np.arange(n)
    along = sum(inner[j][rows, codes[:, j]] for j in range(m))
    for _ in range(passes):
        for j in range(m):
            rest = along - inner[j][rows, codes[:, j]]
            codes[:, j] = np.argmin(square[j] + (ETA - 1) * (rest[:, None] + inner[j]) ** 2, axis=1)
            along = rest + inner[j][rows, codes[:, j]]
    return codes


def packed(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
    return codes[:, 0::2] | (codes[:, 1::2] << 4)


def tables(queries: np.ndarray, books: np.ndarray) -> np.ndarray:
    """For each byte of the codes and each query the 256 sums of two words' products: bytes x queries x 256."""
    own = np.einsum("mqi,mwi->mqw", _halves(queries), books).astype(np.float32)
    if len(own) % 2:
        own = np.concatenate([own, np.zeros_like(own[:1])])
    low, high = own[0::2], own[1::2]
    return (high[:, :, :, None] + low[:, :, None, :]).reshape(len(low), len(queries), 256)


def scan(luts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate products, queries x entries."""
    out = np.zeros((luts.shape[1], len(codes)), np.float32)
    for b in range(len(luts)):
        out += np.take(luts[b], codes[:, b], axis=1)
    return out


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vec.isNotNull() & F.forall(vec, fine) & F.exists(vec, lambda x: x != 0)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best found of ``vectors`` (vec_id, embedding) for each of ``queries``
    (the same columns), best first, ties to the lesser vec_id."""
    spark = vectors.sparkSession
    small_batches(spark, 4_000)
    empty = "query_id long, rank int, vec_id long, score double"
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter("vec_id is not null").filter(usable(F.col("v")))
    most = own.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        return spark.createDataFrame([], empty)
    d = most["d"]
    own = own.filter(F.size("v") == d).withColumn("same", F.xxhash64("v"))
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("q")).filter("query_id is not null")
    asked = asked.filter(usable(F.col("q"))).filter(F.size("q") == d).groupBy("query_id").agg(F.min("q").alias("q"))
    # equal vectors are one entry with their least ids
    ids = own.groupBy("vec_id", "same", "v").count().drop("count")
    nth = F.row_number().over(Window.partitionBy("same").orderBy("vec_id"))
    entries = cut(ids.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("same", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    sample = np.array([r["v"] for r in entries.orderBy(F.xxhash64("same", F.lit(3)), "same").limit(TRAIN).select("v").collect()])
    books = train(sample)
    parts = -(-entries.count() // ENTRIES_A_CELL)

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["v"].tolist())
            yield pd.DataFrame({"same": batch["same"], "v": batch["v"], "ids": batch["ids"], "codes": [c.tobytes() for c in packed(encode(x, books))]})

    index = cut(entries.mapInPandas(indexed, "same long, v array<double>, ids array<long>, codes binary"), "index")
    index = index.withColumn("part", F.pmod(F.xxhash64("same"), F.lit(parts)).cast("int"))
    blocks = -(-asked.count() // QUERIES)
    if not blocks:
        return spark.createDataFrame([], empty)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # every block of queries meets every block of entries
    asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", every(parts))
    index = index.withColumn("block", every(blocks))

    def searched(key: tuple, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(wanted):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows = rows.sort_values("same", kind="stable")
        x, codes = np.array(rows["v"].tolist()), np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        ids = [np.array(i, np.int64) for i in rows["ids"]]
        out: list[tuple[int, int, float]] = []
        for begin in range(0, len(wanted), 256):
            part = wanted.iloc[begin : begin + 256]
            q = np.array(part["q"].tolist())
            rough = scan(tables(q, books), codes)
            keep = min(KEEP, len(x))
            best = np.argpartition(-rough, keep - 1, axis=1)[:, :keep]
            for i, query in enumerate(part["query_id"]):
                exact = (x[best[i]] * q[i]).sum(axis=1)
                found = [(-s, v) for s, e in zip(exact, best[i], strict=True) for v in ids[e].tolist() if v != query]
                found.sort()
                out += [(query, v, -s) for s, v in found[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    left, right = index.groupBy("part", "block"), asked.groupBy("part", "block")
    found = left.cogroup(right).applyInPandas(searched, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every row whose vec_id is divisible by 20: query_id, rank, vec_id, score."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
