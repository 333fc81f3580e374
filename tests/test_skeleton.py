"""Communities against every partition and planted blocks, bridges against the removal of each edge."""

from __future__ import annotations

import random

import pytest

from lectern.operators import bridges, communities


def partitions(nodes):
    if not nodes:
        yield []
        return
    head, *rest = nodes
    for p in partitions(rest):
        yield [[head], *p]
        for k in range(len(p)):
            yield [*p[:k], [head, *p[k]], *p[k + 1 :]]


def modularity(groups, edges):
    """Newman's modularity, term by term."""
    of = {x: k for k, g in enumerate(groups) for x in g}
    total = sum(w for _, _, w in edges)
    strength = {}
    for a, b, w in edges:
        strength[a] = strength.get(a, 0) + w
        strength[b] = strength.get(b, 0) + w
    inside = sum(w for a, b, w in edges if of[a] == of[b]) / total
    return inside - sum((sum(strength.get(x, 0) for x in g) / (2 * total)) ** 2 for g in groups)


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.community, []).append(r.node)
    assert all(c == min(g) for c, g in out.items())
    return list(out.values())


def planted(rng, blocks, size, inside, between):
    nodes = [f"n{k:03d}" for k in range(blocks * size)]
    edges = [(a, b, rng.choice([1.0, 1.5])) for k, a in enumerate(nodes) for j, b in enumerate(nodes[:k]) if rng.random() < (inside if k // size == j // size else between)]
    return nodes, edges


def frames(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "a string, b string, weight double")


def test_small_graphs_against_every_partition(spark):
    rng = random.Random(8)
    for _ in range(4):
        nodes = list("abcdefgh")
        edges = [(a, b, round(rng.uniform(0.5, 3), 3)) for k, a in enumerate(nodes) for b in nodes[:k] if rng.random() < 0.4]
        got = groups_of(communities.communities(*frames(spark, nodes, edges)).collect())
        best = max(modularity(p, edges) for p in partitions(nodes))
        assert sorted(x for g in got for x in g) == nodes
        assert modularity(got, edges) >= best - 0.01 * abs(best) - 0.02


@pytest.mark.parametrize("task_edges", [1 << 17, 0])
def test_planted_blocks_in_one_task_and_in_rounds(spark, monkeypatch, task_edges):
    monkeypatch.setattr(communities, "TASK_EDGES", task_edges)
    monkeypatch.setattr(communities, "ROUNDS", 8)
    rng = random.Random(2)
    nodes, edges = planted(rng, 4, 12, 0.8, 0.05)
    tables = frames(spark, [*nodes, "alone"], edges + [("n000", "n000", 5.0), (None, "n001", 1.0)])
    got = communities.communities(*tables)
    rows = got.collect()
    groups = groups_of(rows)
    want = modularity([nodes[k : k + 12] for k in range(0, 48, 12)], edges)
    assert modularity(groups, edges) >= 0.99 * want and ["alone"] in groups
    assert abs(communities.modularity(got, tables[1]) - modularity(groups, edges)) < 1e-6
    assert sorted(communities.communities(*tables).collect()) == sorted(rows)


def test_skeleton_numbers_and_labels(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("x", "y", 1.0), ("b", "a", 0.0)]
    members, groups = communities.skeleton(*frames(spark, [*"abcdxyz"], edges))
    assert sorted((r.community, r.label, r["size"]) for r in groups.collect()) == [(0, "c", 4), (1, "y", 2), (2, "z", 1)]
    assert {r.node: (r.degree, r.community) for r in members.collect()} == {"a": (2, 0), "b": (2, 0), "c": (3, 0), "d": (1, 0), "x": (1, 1), "y": (1, 1), "z": (0, 2)}
    members, groups = communities.skeleton(*frames(spark, [], []))
    assert members.count() == groups.count() == 0


def brute_bridges(edges):
    pairs = {tuple(sorted(e)) for e in edges if e[0] != e[1]}

    def reaches(a, b, without):
        seen, queue = {a}, [a]
        while queue:
            x = queue.pop()
            for p in pairs - {without}:
                if x in p:
                    y = p[0] if p[1] == x else p[1]
                    if y not in seen:
                        seen.add(y)
                        queue.append(y)
        return b in seen

    return {p for p in pairs if not reaches(*p, p)}


@pytest.mark.parametrize("task_edges", [1 << 17, 12])
def test_bridges(spark, monkeypatch, task_edges):
    monkeypatch.setattr(bridges, "TASK_EDGES", task_edges)
    rng = random.Random(6)
    for n, m in ((0, 0), (50, 60)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        edges += [(100, 101), (101, 102), (102, 100), (102, 103), (103, 102), (104, 105), (105, 104), (106, 106)] if m else []
        frame = spark.createDataFrame(edges, "a long, b long")
        want = brute_bridges(edges)
        assert {(r.a, r.b) for r in bridges.bridges(frame).collect()} == want
        first = {}
        for p in sorted(want):
            for x in p:
                first.setdefault(x, p)
        assert {r.node: (r.a, r.b) for r in bridges.thin_bridges(frame).collect()} == first
