"""Partitions of graphs against scalar measures on small graphs."""

import collections
import math
import random

import pytest

from tidemark.operators import graph, partition


def planted(seed=1, parts=2, size=7, inside=0.7, across=0.05):
    rng, out = random.Random(seed), []
    n = parts * size
    for a in range(n):
        for b in range(a + 1, n):
            if rng.random() < (inside if a // size == b // size else across):
                out.append((a, b, rng.randint(1, 3)))
    return out


def strengths(edges):
    k = collections.Counter()
    for a, b, w in edges:
        k[a] += w
        k[b] += w
    return k


def modularity(edges, part):
    k, total = strengths(edges), 2 * sum(w for _, _, w in edges)
    inner = sum(2 * w for a, b, w in edges if part[a] == part[b])
    volumes = collections.Counter()
    for node, x in k.items():
        volumes[part[node]] += x
    return inner / total - sum((v / total) ** 2 for v in volumes.values())


def bits(edges, part):
    k, total = strengths(edges), 2 * sum(w for _, _, w in edges)
    h = lambda x: x * math.log2(x) if x > 0 else 0.0
    cut, volume = collections.Counter(), collections.Counter()
    for node, x in k.items():
        volume[part[node]] += x / total
    for a, b, w in edges:
        if part[a] != part[b]:
            cut[part[a]] += w / total
            cut[part[b]] += w / total
    return h(sum(cut.values())) - 2 * sum(map(h, cut.values())) - sum(h(x / total) for x in k.values()) + sum(h(cut[m] + volume[m]) for m in volume)


def connected(edges, part):
    near = collections.defaultdict(set)
    for a, b, _ in edges:
        if part[a] == part[b]:
            near[a].add(b)
            near[b].add(a)
    for p in set(part.values()):
        own = {n for n in part if part[n] == p}
        seen, queue = set(), [min(own)]
        while queue:
            x = queue.pop()
            if x not in seen:
                seen.add(x)
                queue += near[x]
        if seen != own:
            return False
    return True


def found(df):
    return {r.node: r.part for r in df.collect()}


def groups(part):
    out = collections.defaultdict(set)
    for n, p in part.items():
        out[p].add(n)
    return sorted(map(sorted, out.values()))


def table(spark, edges):
    return spark.createDataFrame(edges, "a long, b long, weight long").coalesce(2).cache()


def test_planted_parts(spark):
    edges = planted()
    df, trace = table(spark, edges), []
    want = [list(range(i * 7, i * 7 + 7)) for i in range(2)]
    part = found(partition.leiden(df, trace=trace))
    assert groups(part) == want and connected(edges, part) and trace == sorted(trace)
    steps = []
    assert groups(found(partition.map_equation(df, trace=steps))) == want
    assert steps == sorted(steps)
    merged, name = partition.detected(df, "greedy")
    assert name == "greedy" and modularity(edges, found(merged)) > 0.9 * modularity(edges, part)
    with pytest.warns(UserWarning):
        assert partition.detected(df, "no such")[1] == "leiden"


@pytest.mark.parametrize("seed", [5])
def test_measures_of_random_graphs(spark, seed):
    edges = planted(seed, parts=3, size=7, inside=0.4, across=0.12)
    df = table(spark, edges)
    part = found(partition.leiden(df))
    today = found(graph.label_communities(df))
    assert connected(edges, part) and modularity(edges, part) >= modularity(edges, today) - 1e-9
    trace = []
    merged = found(partition.greedy(df, trace=trace))
    alone = modularity(edges, {n: n for n in merged})
    assert modularity(edges, merged) == pytest.approx(alone + sum(trace)) and all(g > 0 for g in trace)
    modules = merged
    rows = spark.createDataFrame(list(modules.items()), "node long, part long")
    assert partition.codelength(df, rows) == pytest.approx(bits(edges, modules))


def test_parts_that_fall_apart(spark):
    """Of a part that moves left unconnected, the pieces are parts of their own."""
    df = table(spark, [(1, 2, 1), (2, 3, 1), (4, 5, 1), (3, 9, 1)])
    rows = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (5, 7), (9, 8)], "node long, part long")
    assert groups(found(partition.whole(df, rows))) == [[1, 2, 3], [4, 5], [9]]


def test_pagerank(spark):
    edges = planted(3, parts=2, size=6)
    got = {r.node: r["rank"] for r in partition.pagerank(table(spark, edges), tolerance=1e-6).collect()}
    k = strengths(edges)
    ranks = dict.fromkeys(k, 1 / len(k))
    for _ in range(100):
        into = collections.Counter()
        for a, b, w in edges:
            into[b] += ranks[a] * w / k[a]
            into[a] += ranks[b] * w / k[b]
        ranks = {n: 0.15 / len(k) + 0.85 * into[n] for n in k}
    assert got == pytest.approx(ranks, abs=1e-5) and sum(got.values()) == pytest.approx(1)
