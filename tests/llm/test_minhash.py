import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.helpers import documents, no_documents, odd_documents
from tracelode.llm import minhash_dedup as M


def brute(rows):
    """Least doc_id of the component of each row."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({"": 1}))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for k in s:
            holders[k].add(i)
    for pair in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        a, b = (sets[i] for i in pair)
        if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
            parent[find(pair[0])] = find(pair[1])
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], least[find(i)]) for i in range(len(rows))]


def held(docs):
    key = lambda x: tuple(-1 if v is None else v for v in x)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [(r["doc_id"], r["class_id"]) for r in M.near_duplicates(docs).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_whole_table(spark):
    held(documents(spark))


def test_odd_rows(spark):
    held(odd_documents(spark))
    assert M.near_duplicates(no_documents(spark)).count() == 0
    kept = M.drop_near_duplicates(odd_documents(spark)).select("doc_id", "text").collect()
    assert Counter(r["text"] for r in kept)["the same text here again and again"] == 1
    assert len(kept) == 8 and sum(not (r["text"] or "").strip() for r in kept) == 1


def family(rng, n, size, edits):
    """Copies of one text with some words changed, so that copies are near the text but not always near each other."""
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
    out = [base]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(1, edits)):
            copy[rng.randrange(size)] = f"x{rng.randint(0, 10**6)}"
        out.append(copy)
    rng.shuffle(out)
    return [" ".join(t) for t in out]


@pytest.mark.parametrize("base", [True, False])
def test_large_family(spark, base):
    """With the text that the copies were made of, and without it, when no member is near most others."""
    rng = random.Random(5)
    texts = family(rng, 150, 120, 5)
    if not base:
        texts = [t for t in texts if "x" in t]
    rows = [(i, t) for i, t in enumerate(texts + [texts[0]] * 40)]
    held(spark.createDataFrame(rows, "doc_id long, text string"))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    k, n = 2_000, 60
    element = rng.integers(0, 2**63, n).astype(np.uint64)
    for change in (0.0, 0.3, 0.9):
        w1 = rng.uniform(0.2, 4, n)
        w2 = np.where(rng.random(n) < change, rng.uniform(0.2, 4, n), w1)
        sig = M.dart_signatures(np.concatenate([element, element]), np.repeat([0, 1], n), 2, k, np.concatenate([w1, w2]))
        want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 4 * (0.25 / k) ** 0.5 + 1e-9
    a, b = np.arange(1, 101, dtype=np.uint64), np.arange(21, 121, dtype=np.uint64)
    sig = M.dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], 100), 2, k)
    assert abs((sig[0] == sig[1]).mean() - 80 / 120) < 0.05 and (sig != 0).all()


def test_signature_does_not_depend_on_neighbours():
    texts = ["a b c d e f g", "", "x", " ".join(map(str, range(500)))]
    together = M.dart_signatures(*M.shingles(texts), len(texts), 125)
    for i, t in enumerate(texts):
        if t:
            assert (M.dart_signatures(*M.shingles([t]), 1, 125)[0] == together[i]).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["label"]) for r in M.components(edges).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}


def test_one_document_of_a_class_stays(spark):
    """Different near-duplicate texts without ids, or with one id, are one class, of which one row stays."""
    rng = random.Random(3)
    null, same = family(rng, 3, 120, 2), family(rng, 3, 120, 2)
    rows = [(None, t) for t in null] + [(7, t) for t in same] + [(8, same[0]), (None, same[1]), (7, same[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in M.drop_near_duplicates(docs).collect())
    assert [i for i, _ in kept] == [0, 7] and kept[0][1] in null and kept[1][1] in same
