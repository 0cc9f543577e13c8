"""Forests against the same walk done one node at a time."""

import random

import pytest

from tests.graphs import make, sym
from tracelode.operators import walk
from tracelode.schema import CALL, FUNCTION


def model(names, calls, roots, direction, depth, max_syms):
    key = lambda n: n.rsplit("#", 1)[-1] if n.startswith("kythe:") else n
    order = lambda ns: sorted(set(ns), key=lambda n: sym(n) % (1 << 64))
    nodes, seen, frontier = [], set(), []

    def admit(n, parent, dir_, hop):
        if key(n) in seen:
            return False
        seen.add(key(n))
        nodes.append((len(nodes), parent, hop, dir_, n))
        return True

    for r in order(roots):
        if admit(r, None, "root", 0):
            frontier.append((r, len(nodes) - 1))
    for hop in range(1, depth + 1):
        following = []
        for n, at in frontier:
            for way, edges in (("up", [a for a, b in calls if b == n]), ("down", [b for a, b in calls if a == n])):
                if direction not in (way, "both"):
                    continue
                for m in order(edges):
                    if admit(m, at, way, hop):
                        following.append((m, len(nodes) - 1))
                        if len(nodes) >= max_syms:
                            return nodes
        if not following:
            break
        frontier = following
    return nodes


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(25)] + [f"kythe:java:c#r#v{i}#S{i % 3}" for i in range(6)]
    calls = sorted({(rng.choice(names), rng.choice(names)) for _ in range(50)})
    roots = rng.sample(names, 3)
    g = make(spark, syms=[(n, FUNCTION, 1) for n in names], calls=[(a, b, CALL) for a, b in calls], aliases=[(r, "root") for r in roots])
    direction, most = rng.choice(["up", "down", "both"]), rng.choice([5, 9, 200])
    got = sorted(walk.callgraph(g, "root", direction=direction, depth=3, max_syms=most).collect(), key=lambda r: r["id"])
    want = model(names, calls, roots, direction, 3, most)
    assert [(r["id"], r["parent"], r["hop"], r["dir"], r["name"]) for r in got] == want
