"""MinHash near-dedup with DartMinHash signatures and banded joining.

A document is the multiset of its word 5-grams (lower-cased, white-space separated; a text of one to
four words is one shingle). Similarity is the weighted Jaccard index of the multisets, and documents
of at least 0.8 are linked; classes are the connected components.

* Darts: the plane of weight by rank of each shingle is cut into cells that are the same in every
  document. A cell of area a gets Poisson(a) darts from its hash; darts under the shingle's weight
  count, and each of the k coordinates keeps the earliest dart hashed to it. Cells are visited in
  ascending rank only until every coordinate of a document is full, so a signature costs about
  k log k darts whatever the length of the text.
* Bands: r coordinates make a bucket key. Equal texts are one node before anything is joined, so a
  group of exact copies costs one row. In a bucket every member is compared with one hub, the member
  that shares most buckets with others, never with all the others; links are verified on whole texts.
* What the hubs leave open, pairs of one bucket that are still in different components, passes an
  exact bound on what the two can share, and is verified: after it no candidate pair is undecided.

Defined results: a null text, or one of white space, counts as empty, all empty texts are copies of each other; a null
``doc_id`` is kept, and is never a class id while the class has another; repeated rows are copies;
other columns are ignored; an empty table gives an empty result. Texts are told apart by a 64-bit hash: of n different texts
about n^2 / 2^65 pairs would be taken for one (less than one below 6 billion texts).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_KEYS, cut, free_name, hot_join, release, small_batches, table

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 25, 5
#: Ids up to this many (8 bytes each) are broadcast; above, the join is shuffled.
BROADCAST_IDS = 500_000
#: Members of a hub that are compared with one copy of its text, and of a class that are compared at once.
CHUNK = 512
#: An element that more members of a hub have counts as the hub's.
COMMON = 32
_CHARS = 1_500_000  # of text handled at once in a worker

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


class _Words(dict):
    """Word to hash; forgets all when it is large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingle occurrences and the text that each is of, by text and hash. The n-th
    occurrence of a shingle in a text has another hash than the first, so sets stand for multisets."""
    parts, lengths = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        if text and (own := text.lower().split()):
            lengths[i] = len(own)
            parts.append(np.fromiter(map(_words.__getitem__, own), np.uint64, len(own)))
            parts.append(np.zeros(words - 1, np.uint64))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    flat = np.concatenate(parts)
    n = len(flat) - words + 1
    h = np.zeros(n, np.uint64)
    for j in range(words):
        h = _mix(h + _GOLD + flat[j : j + n])
    full = np.flatnonzero(lengths)
    starts = np.cumsum(lengths[full] + words - 1) - (lengths[full] + words - 1)
    counts = np.maximum(lengths[full] - words + 1, 1)
    doc = np.repeat(full, counts)
    at = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    h = h[at]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    nth = (np.arange(len(h)) - first).astype(np.uint64)
    return np.where(nth > 0, _mix(h + nth * _GOLD), h), doc


def dart_signatures(element: np.ndarray, doc: np.ndarray, docs: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """DartMinHash: ``docs`` rows of ``k`` dart ids; a row of zeros for a document without elements.
    ``weight``: of each element, 1 if not given."""
    if weight is not None:  # unit strips of weight; darts above the weight are dropped below
        strips = np.ceil(weight).astype(np.int64)
        back = np.repeat(np.arange(len(element)), strips)
        strip = np.arange(len(back)) - np.repeat(np.cumsum(strips) - strips, strips)
        left = weight[back] - strip
        element, doc = _mix(element[back] + strip.astype(np.uint64) * _M1), doc[back]
    sig = np.zeros(docs * k, np.uint64)
    filled = np.zeros(docs * k, bool)
    element = element.copy()
    low, width, region = 0.0, 2.0**-9, 0
    while len(element):
        region += 1
        cells, size = (1, width) if width <= 1 else (int(width), 1.0)
        salt = np.uint64((region * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
        step = max(1, 1_000_000 // cells)
        for begin in range(0, len(element), step):
            e = element[begin : begin + step]
            cell = _mix((e ^ salt)[:, None] + np.arange(1, cells + 1, dtype=np.uint64) * _GOLD).ravel()
            cdf, term = [], np.exp(-size)
            for i in range(1, 25):
                cdf.append((cdf[-1] if cdf else 0.0) + term)
                term *= size / i
            u = _unit(cell)
            some = np.flatnonzero(u >= cdf[0])
            count = np.searchsorted(np.array(cdf), u[some], side="right")
            of = np.repeat(some, count)
            nth = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint64)
            dart = _mix(cell[of] + (nth + np.uint64(1)) * _M2)
            rank = (of % cells) * size + size * _unit(_mix(dart ^ _M1))
            owner = begin + of // cells
            slot = doc[owner] * k + ((dart >> np.uint64(17)) % np.uint64(k)).astype(np.int64)
            keep = ~filled[slot]
            if weight is not None:
                keep &= _unit(_mix(dart ^ _GOLD)) < left[owner]
            dart, rank, slot = dart[keep], rank[keep], slot[keep]
            if begin == 0:
                best = np.full(docs * k, np.inf) if len(element) > step else None
            order = np.argsort(-rank, kind="stable")
            dart, rank, slot = dart[order], rank[order], slot[order]
            if best is None:
                sig[slot] = dart  # of equal slots the last, the earliest dart, stays
            else:
                one = np.full(docs * k, np.inf)
                ids = np.zeros(docs * k, np.uint64)
                one[slot], ids[slot] = rank, dart
                better = one < best
                best[better], sig[better] = one[better], ids[better]
        filled = sig != 0
        done = filled.reshape(docs, k).all(axis=1)
        keep = ~done[doc]
        element, doc = element[keep], doc[keep]
        if weight is not None:
            left = left[keep]
        low += width
        width = low
    return sig.reshape(docs, k)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A bucket key for each band of each signature."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * _GOLD + np.zeros((len(sig), 1), np.uint64)
    for j in range(rows):
        key = _mix(key + sig[:, j : bands * rows : rows])
    return key.view(np.int64)


def _slices(lengths: list[int]) -> Iterator[slice]:
    begin, total = 0, 0
    for i, n in enumerate(lengths):
        total += n
        if total >= _CHARS:
            yield slice(begin, i + 1)
            begin, total = i + 1, 0
    if begin < len(lengths):
        yield slice(begin, len(lengths))


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[int] = set()
    for batch in batches:
        new = []
        for node in batch["node"]:
            new.append(node not in seen)
            seen.add(node)
        if len(seen) > 200_000:
            seen.clear()
        batch = batch[new]
        texts = batch["text"].tolist()
        for part in _slices([len(t) for t in texts]):
            element, doc = shingles(texts[part])
            if len(element):
                here = np.unique(doc)
                sig = dart_signatures(element, doc, len(texts[part]), BANDS * ROWS)[here]
                yield pd.DataFrame({"node": batch["node"].to_numpy()[part][here], "bands": list(band_keys(sig))})


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, hub = None, np.zeros(0, np.uint64)
    for batch in batches:
        good = []
        for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
            if b != at:
                at, hub = b, shingles([text_b])[0]
                hub.sort()
            own = shingles([text_a])[0]
            small, large = min(len(own), len(hub)), max(len(own), len(hub))
            if small < SIMILARITY * large:
                good.append(False)
                continue
            common = len(np.intersect1d(own, hub, assume_unique=True))
            good.append(common >= SIMILARITY * (len(own) + len(hub) - common) - 1e-9)
        yield batch.loc[good, ["a", "b"]]


def _paired(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b and others) with text_a and text_b; rows of one b are together, ``CHUNK`` about, so that a hub of many
    members is dealt to many tasks, with a copy of its text each. ``pairs`` is written; ``texts``: node, text."""
    small_batches(pairs.sparkSession)
    hubs = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("members")), "hubs")
    chunks = F.ceil(F.col("members") / CHUNK)
    pairs = hot_join(pairs, hubs, ["b"], "members", pairs.count()).withColumn("chunk", F.pmod(F.xxhash64("a"), chunks))
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).join(hubs, "b")
    right = right.select("b", "text_b", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    return pairs.drop("members").join(left.hint("shuffle_merge"), "a").join(right.hint("shuffle_merge"), ["b", "chunk"])


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar enough."""
    return _paired(pairs, texts).select("a", "b", "text_a", "text_b").mapInPandas(_verified, "a long, b long")


def _profiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    at, hub = None, np.zeros(0, np.uint64)
    for batch in batches:
        size, common, rest = [], [], []
        for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
            if b != at:
                at, hub = b, shingles([text_b])[0]
            own = shingles([text_a])[0]
            other = np.setdiff1d(own, hub, assume_unique=True)
            size.append(len(own))
            common.append(len(own) - len(other))
            rest.append(other.view(np.int64))
        yield batch[["b", "a", "label", "minor"]].assign(n=size, common=common, rest=rest)


def _open_pairs(star: DataFrame, label: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of different components that may be similar and that no hub has decided. All members of a bucket
    were compared with its hub, so pairs of members of one hub are all there is.

    Two members x and y of hub h, of n shingles each, have at most min(c(x), c(y)) + s in common, where c counts those
    that a set V holds and s those outside V that both have. For a similarity of t that must be t / (1 + t) of n(x) + n(y).
    V is the hub, and whatever else more than ``COMMON`` members have. So a pair passes only if it shares an element
    that few members have, or if it passes with s = 0, which its sizes tell. Both are joins with short lists: copies
    that differ from the hub, and so from each other, are never paired."""
    member = star.join(label.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    parts = member.groupBy("b", "label").agg(F.count(F.lit(1)).alias("k"))
    major = F.max(F.struct("k", "label")).getField("label")
    open_ = parts.groupBy("b").agg(major.alias("major"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("members")).filter("parts > 1").select("b", "major", "members")
    member, open_ = cut(member, "labelled"), cut(open_, "undecided")
    member = cut(hot_join(member, open_, ["b"], "members", member.count()).select("a", "b", "label", (F.col("label") != F.col("major")).alias("minor")), "open")
    kinds = "b long, a long, label long, minor boolean, n long, common long, rest array<long>"
    profile = cut(_paired(member, texts(member)).mapInPandas(_profiled, kinds), "profiles")
    outside = cut(profile.select("b", "a", F.explode("rest").alias("element")), "rest")
    often = cut(outside.groupBy("b", "element").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), "often")
    outside = cut(hot_join(outside, often, ["b", "element"], "k", outside.count()), "outside")
    more = outside.filter(F.col("k") > COMMON).groupBy("b", "a").agg(F.count(F.lit(1)).alias("more"))
    held = (F.col("common") + F.coalesce("more", F.lit(0))).alias("c")
    sizes = cut(profile.join(more, ["b", "a"], "left").select("b", "a", "label", "minor", "n", held), "sizes")
    bound = (1 + SIMILARITY) / SIMILARITY
    differ = (F.col("x.label") != F.col("y.label")) & (~F.col("y.minor") | (F.col("x.a") < F.col("y.a")))

    def enough(shared: Column) -> Column:
        return F.col("x.n") + F.col("y.n") <= bound * (F.least("x.c", "y.c") + shared) + 1e-6

    # pairs whose sizes allow it though they share nothing outside V: sizes in classes of two per cent
    size = lambda n: F.floor(F.log(n.cast("double")) / math.log(1.02)).cast("int")
    low, high = F.col("n") * SIMILARITY, F.least(F.col("n") / SIMILARITY, bound * F.col("c") - F.col("n"))
    reach = sizes.filter("minor").filter(high >= low).withColumn("size", F.explode(F.sequence(size(low), size(high) + 1)))
    # classes of many members are dealt out in blocks; a member that looks at such a class looks at each of them
    sizes = sizes.withColumn("size", size(F.col("n")))
    limit = max(CHUNK, sizes.count() // HOT_KEYS)
    large = cut(sizes.groupBy("b", "size").agg(F.ceil(F.count(F.lit(1)) / limit).alias("blocks")).filter("blocks > 1"), "large")  # HOT_KEYS rows at most
    blocks = F.coalesce("blocks", F.lit(1))
    others = sizes.join(F.broadcast(large), ["b", "size"], "left").withColumn("block", F.pmod(F.xxhash64("a"), blocks)).alias("y")
    reach = reach.join(F.broadcast(large), ["b", "size"], "left").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).alias("x")
    fits = reach.join(others, (F.col("x.b") == F.col("y.b")) & (F.col("x.size") == F.col("y.size")) & (F.col("x.block") == F.col("y.block")) & differ & enough(F.lit(0)))
    # pairs that share what few members have
    few = outside.filter(F.col("k") <= COMMON).select("b", "a", "element")
    rows = few.join(sizes, ["b", "a"])
    x, y = rows.filter("minor").alias("x"), rows.alias("y")
    near = x.join(y, (F.col("x.b") == F.col("y.b")) & (F.col("x.element") == F.col("y.element")) & differ)
    near = near.groupBy("x.b", "x.a", "x.n", "x.c", F.col("y.a").alias("ya"), F.col("y.n").alias("yn"), F.col("y.c").alias("yc")).agg(F.count(F.lit(1)).alias("shared"))
    near = near.filter(F.col("n") + F.col("yn") <= bound * (F.least("c", "yc") + F.col("shared")) + 1e-6)
    pair = lambda p, q: (F.least(p, q).alias("a"), F.greatest(p, q).alias("b"))
    both = fits.select(*pair(F.col("x.a"), F.col("y.a"))).union(near.select(*pair(F.col("a"), F.col("ya")))).distinct()
    return both.join(star.select(*pair(F.col("a"), F.col("b"))), ["a", "b"], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b); the label is the least node of its component.
    Each round takes the least label around and then the label of the label, and is written, so a
    component of n nodes needs about log n rounds. Nodes of very many links, and labels of very many nodes, are joined apart."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label"), F.count(F.lit(1)).alias("links")), "labels")
    links, nodes = both.count(), labels.count()
    while True:
        around = labels.select(F.col("node").alias("b"), "label", "links")
        near = hot_join(both, around, ["b"], "links", links).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "node").select("node", "links", F.col("label").alias("old"), F.least("label", "near").alias("mid")), "steps")
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        up = cut(step.groupBy("mid").agg(F.count(F.lit(1)).alias("nodes")).join(up, "mid"), "tops")
        new = cut(hot_join(step, up, ["mid"], "nodes", nodes).select("node", "links", "old", F.least("mid", "top").alias("label")), "labels")
        release(labels, step, up)
        labels = new
        if new.filter("label <> old").isEmpty():
            release(both)
            return labels.select("node", "label")


def _plain(text: Column) -> Column:
    """The text; empty where it has no words."""
    return F.when(text.rlike("\\S"), text).otherwise("")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, node (hash of the text), class_id (the least doc_id of the class), class_size, stays (the
    node is the least of those with that doc_id) for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select("doc_id", _plain(F.col("text")).alias("text")).withColumn("node", F.xxhash64("text"))
    slim = cut(own.select("doc_id", "node"), "slim")
    nodes = cut(slim.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "nodes")
    signed = cut(own.select("node", "text").filter("text rlike '\\\\S'").mapInPandas(_signed, "node long, bands array<long>"), "signed")
    every = cut(signed.groupBy("node").agg(F.any_value("bands").alias("bands")).select("node", F.explode("bands").alias("key")), "members")
    shared = cut(every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    member = cut(hot_join(every, shared, ["key"], "n", every.count()), "shared")
    release(signed, every, shared)
    # the hub of a bucket: the member that shares most buckets with most others
    score = member.groupBy("node").agg(F.sum("n").alias("score"))
    best = F.max(F.struct("score", F.negative("node").alias("minus"), "node")).getField("node")
    hub = cut(member.join(score, "node").groupBy("key").agg(best.alias("b"), F.count(F.lit(1)).alias("members")), "hubs")
    star = cut(hot_join(member, hub, ["key"], "members", member.count()).filter("node <> b").select(F.col("node").alias("a"), "b").distinct(), "star")
    release(member, hub)
    firsts = nodes.select("node", "first")

    def texts(pairs: DataFrame) -> DataFrame:
        """The texts of the nodes of the pairs, of the first document of each."""
        ends = pairs.select(F.col("a").alias("node")).distinct().union(pairs.select(F.col("b").alias("node")).distinct())
        wanted = cut(ends.distinct().join(firsts, "node"), "wanted")
        if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        here = own.join(wanted, (own.node == wanted.node) & own.doc_id.eqNullSafe(wanted["first"]), "left_semi")
        return here.select("node", "text")

    edges = cut(one_each(_verify(star, texts(star))), "edges")
    label = components(edges)
    pairs = cut(_open_pairs(star, label, texts), "pairs")
    if not pairs.isEmpty():
        more = cut(one_each(_verify(pairs, texts(pairs))), "edges")
        if not more.isEmpty():
            label = components(edges.union(more))
    flat = cut(nodes.join(label, "node", "left").withColumn("label", F.coalesce("label", "node")), "flat")
    # nulls last, as in the least of the doc_ids alone
    one = F.min(F.struct(F.col("first").isNull(), "first", "node")).getField("node")
    whole = flat.groupBy("label").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"), one.alias("one"), F.count(F.lit(1)).alias("texts"))
    whole = cut(whole, "classes")
    flat = hot_join(flat, whole, ["label"], "texts", flat.count()).select("node", "copies", "class_id", "class_size", (F.col("node") == F.col("one")).alias("of_one"))
    flat = cut(flat, "classed")
    stays = F.col("of_one") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return hot_join(slim, flat, ["node"], "copies", slim.count()).select("doc_id", "node", "class_id", "class_size", stays.alias("stays"))


def one_each(edges: DataFrame) -> DataFrame:
    """Links once each; a text that stands in several rows of one first document is read twice."""
    return edges.distinct()


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each class: of its least ``doc_id``, and of the least node where several
    texts of the class have that doc_id or none has any; of rows that repeat text and doc_id, one."""
    found = near_duplicates(docs)
    stay = cut(found.filter("stays").groupBy("doc_id", "node").count(), "stay")
    node = F.xxhash64(_plain(F.col("text")))
    twice = not stay.filter("count > 1").isEmpty()
    name = free_name(docs, "node_of")
    kept = docs.withColumn(name, node)
    stay = stay.select(F.col("doc_id").alias("stay_id"), F.col("node").alias("stay_node"))
    kept = kept.join(stay, kept["doc_id"].eqNullSafe(stay["stay_id"]) & (kept[name] == stay["stay_node"]), "left_semi")
    if twice:
        kept = kept.dropDuplicates(["doc_id", name])
    return kept.drop(name)


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id, class_size."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
