"""Components, cycles, build order and inheritance against plain Python."""

import random

import pytest

from stratalens.operators import cyclic as C


def _edges(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long").repartition(3)


def _reach(edges):
    nodes = {x for e in edges for x in e}
    out = {n: {d for s, d in edges if s == n} for n in nodes}
    grown = True
    while grown:
        grown = False
        for n in nodes:
            more = set().union(*[out[d] for d in out[n]], out[n])
            grown |= more != out[n]
            out[n] = more
    return out


def _random(seed, nodes, edges):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)]


GRAPHS = {
    "ring of twelve with a tail": [(i, (i + 1) % 12) for i in range(12)] + [(40, 3), (7, 41), (41, 42)],
    "two rings joined one way": [(0, 1), (1, 2), (2, 0), (2, 10), (10, 11), (11, 10), (11, 20)],
    "loops and a chain": [(5, 5), (1, 2), (2, 3), (3, 3), (3, 4)],
    "random": _random(1, 30, 40),
    "dense": _random(2, 12, 60),
}


def _shortest(edges, reach):
    """A shortest cycle through the least node of each component, the first in order."""
    want = {}
    for least in {min(m for m in reach if m in reach[n] and n in reach[m]) for n in reach if n in reach[n]}:
        paths = [[least]]
        while least not in want:
            ended = [p for p in paths if (p[-1], least) in edges]
            if ended:
                want[least] = min(ended)
            paths = [[*p, d] for p in paths for s, d in edges if s == p[-1] and d not in p]
            paths = [p for p in paths if not any(q[-1] == p[-1] and q < p for q in paths)]
    return want


@pytest.mark.parametrize("name", GRAPHS)
def test_components_and_cycles(spark, name):
    edges = GRAPHS[name]
    reach = _reach(edges)
    members = {n: {m for m in reach if m in reach[n] and n in reach[m]} | {n} for n in reach}
    components = C.strong_components(_edges(spark, edges + edges))
    assert {r.node: (r.component, r.size) for r in components.collect()} == {n: (min(m), len(m)) for n, m in members.items()}
    assert {r.node for r in C.cyclic_nodes(_edges(spark, edges), components).collect()} == {n for n in reach if n in reach[n]}
    assert {r.component: r.cycle for r in C.shortest_cycles(_edges(spark, edges), components).collect()} == _shortest(set(edges), reach)


def test_no_edges_and_nulls(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert C.strong_components(none).collect() == [] and C.shortest_cycles(none).collect() == [] and C.build_order(none).collect() == []
    some = spark.createDataFrame([(1, None), (None, 2), (3, 4)], "src long, dst long")
    assert sorted(r.node for r in C.strong_components(some).collect()) == [3, 4]


def _levels(edges):
    edges, level = set(edges), {}
    nodes = {x for e in edges for x in e}
    while True:
        ready = [n for n in nodes if n not in level and all(d in level for s, d in edges if s == n)]
        if not ready:
            return {n: level.get(n) for n in nodes}
        for n in ready:
            level[n] = max([level[d] + 1 for s, d in edges if s == n], default=0)


@pytest.mark.parametrize(
    "edges",
    [
        [(i, i + 1) for i in range(200)] + [(300, 301), (301, 302), (302, 300), (303, 300), (304, 303), (304, 150), (305, 150), (305, 190)],
        [(3, 2), (3, 1), (2, 1), (1, 0), (4, 3), (4, 0), (5, 5), (6, 5), (6, 4)],
        [(a, b) for a, b in _random(4, 40, 70) if a > b],
        _random(5, 40, 50),
    ],
    ids=["chain of 200 and a cycle", "diamond and a loop", "acyclic", "random"],
)
def test_build_order(spark, edges):
    assert {r.node: r.level for r in C.build_order(_edges(spark, edges)).collect()} == _levels(edges)


def test_ends_of_chains(spark):
    parents = [(1, 2), (2, 3), (3, None), (4, 99), (5, 6), (6, 7), (7, 5), (8, 7)] + [(i, i + 1) for i in range(100, 150)]
    found = {r.node: (r["last"], r.distance) for r in C.ends_of_chains(spark.createDataFrame(parents, "node long, parent long")).collect()}
    want = {1: (3, 2), 2: (3, 1), 3: (3, 0), 4: (99, 1), 5: (None, None), 6: (None, None), 7: (None, None), 8: (None, None)} | {i: (150, 150 - i) for i in range(100, 150)}
    assert found == want


def test_inheritance_of_twelve_levels_and_a_cycle(spark):
    parents = [(i, i + 1) for i in range(12)] + [(12, None), (20, 21), (21, 22), (22, 20), (30, 20)]
    defined = [(12, "base", "b12"), (12, "title", "t12"), (5, "title", "t5"), (0, "own", "o0"), (9, "base", "b9"), (21, "title", "t21"), (20, "base", "b20"), (30, "title", "t30"), (5, "twice", "y"), (5, "twice", "x")]
    own, up = {}, dict(parents)
    for n, name, value in sorted(defined, reverse=True):
        own.setdefault(n, {})[name] = value
    want = set()
    for n in up:
        seen, at, d, have = set(), n, 0, set()
        while at is not None and at not in seen:
            seen.add(at)
            for name, value in own.get(at, {}).items():
                if name not in have:
                    have.add(name)
                    want.add((n, name, value, at, d))
            at, d = up.get(at), d + 1
    rows = C.resolved(spark.createDataFrame(parents, "node long, parent long"), spark.createDataFrame(defined, "node long, name string, value string")).collect()
    assert {(r.node, r.name, r.value, r.origin, r.distance) for r in rows} == want
