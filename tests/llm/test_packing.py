import random
from collections import defaultdict

import pytest

from tests.llm.helpers import documents, no_documents, odd_documents
from tracelode.llm import packing as P


def held(docs, lengths=P.LENGTHS):
    rows = P.pack_documents(docs, lengths).collect()
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
        pieces[r["doc_id"]].append(r)
    for own in bins.values():
        own.sort(key=lambda r: (r["place"], r["length"]))
        at = 0
        for r in own:
            assert r["place"] == at
            at += r["length"]
        assert len({r["bin_length"] for r in own}) == 1
        assert own[0]["bin_length"] == min(n for n in lengths if n >= at)
    words = defaultdict(int)
    for r in docs.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert {d: sum(r["length"] for r in own) for d, own in pieces.items()} == dict(words)
    return bins


def test_whole_table(spark):
    bins = held(documents(spark))
    full = sum(r["length"] for own in bins.values() for r in own) / sum(own[0]["bin_length"] for own in bins.values())
    assert full > 0.97


def test_odd_rows(spark):
    held(odd_documents(spark))
    held(odd_documents(spark), (7, 64))
    assert P.pack_documents(no_documents(spark)).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_best_fit(seed):
    """Each piece is in the bin that left it the least room, by a plain search of all open bins."""
    rng = random.Random(seed)
    sizes = [rng.randint(0, 64) for _ in range(rng.randint(1, 200))]
    of, at, fitted = P.pack(sizes, (16, 32, 64))
    load = defaultdict(int)
    for s, b in zip(sizes, of, strict=True):
        load[b] += s
    assert all(load[b] <= n and n == min(x for x in (16, 32, 64) if x >= load[b]) for b, n in enumerate(fitted))
    room: dict[int, int] = {}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    first = {}
    for i in order:
        first.setdefault(of[i], i)
    for i in order:
        if first[of[i]] != i:
            assert room[of[i]] == min(r for r in room.values() if r >= sizes[i])
            room[of[i]] -= sizes[i]
        else:
            assert all(r < sizes[i] for r in room.values())
            opened = max((n for n in (16, 32, 64) if n >= sizes[i]), key=lambda n: (n >= at_most(of, at, sizes, of[i]), -n))
            room[of[i]] = opened - sizes[i]


def at_most(of, at, sizes, b):
    return max(at[i] + sizes[i] for i in range(len(sizes)) if of[i] == b)


def test_nothing_is_wasted_on_small_input():
    assert P.pack([5], (8, 512))[2] == [8] and P.pack([], (8,)) == ([], [], []) and P.pack([0, 0], (8,))[0] == [0, 0]


@pytest.mark.parametrize("seed", range(8))
def test_whole_rule_by_plain_search(seed):
    """Best fit, and the bin size of least cost where a bin is opened, by formulas of its own."""
    rng = random.Random(seed)
    lengths = (16, 32, 64, 128)
    sizes = [min(128, int(rng.paretovariate(0.7))) for _ in range(rng.randint(1, 250))]
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room, since, size_of, where, load = [], [], [], {}, []
    for clock, i in enumerate(order):
        fit = [b for b in range(len(room)) if room[b] >= sizes[i]]
        if fit:
            b = min(fit, key=lambda b: (room[b], -since[b]))  # of equal ones the latest
        else:
            tail = sum(sizes[j] for j in order[clock:])
            mean = tail / (len(order) - clock)
            cost = {}
            for n in (n for n in lengths if n >= sizes[i]):
                to_fill = min(n - sizes[i], max(0, tail - sizes[i]))
                filled = to_fill - min(to_fill, mean / 2)
                cost[n] = (n - sizes[i] - filled + P.OVERHEAD) / (sizes[i] + filled + 1)
            b = len(room)
            size_of.append(min(cost, key=lambda n: (cost[n], n)))
            room.append(size_of[b])
            since.append(0)
            load.append(0)
        where[i] = b
        load[b] += sizes[i]
        room[b] -= sizes[i]
        since[b] = clock
    of, _, fitted = P.pack(sizes, lengths)
    assert of == [where[i] for i in range(len(sizes))]
    assert fitted == [min(n for n in lengths if n >= x) for x in load]


def test_layout_does_not_matter(spark):
    docs = documents(spark)
    docs = docs.union(docs.limit(50)).union(docs.limit(50))
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(P.pack_documents(docs)) == key(P.pack_documents(docs.repartition(7)))
