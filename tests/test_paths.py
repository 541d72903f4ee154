"""Shortest-path measures against one search per source with dictionaries."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import graph as N


def plain(nodes, edges):
    """Closeness by hops, betweenness by lengths."""
    adj = {v: {} for v in nodes}
    for a, b, w in edges:
        adj[a][b] = adj[b][a] = w
    n, close, passed = len(nodes), {}, dict.fromkeys(nodes, 0.0)
    for s in nodes:
        hops, ring = {s: 0}, [s]
        while ring:
            ring = [u for u in {u for v in ring for u in adj[v]} if u not in hops and hops.setdefault(u, hops[ring[0]] + 1)]
        reach, total = len(hops) - 1, sum(hops.values())
        close[s] = reach / total * (reach / (n - 1)) if total else 0.0
        dist, number, before, order, heap = {}, {s: 1.0}, {s: []}, [], [(0.0, s, s)]
        best = {s: 0.0}
        while heap:
            d, v, _ = heapq.heappop(heap)
            if v in dist:
                continue
            dist[v] = d
            order.append(v)
            for u, w in adj[v].items():
                if u not in dist and d + w < best.get(u, 1e300):
                    best[u] = d + w
                    heapq.heappush(heap, (d + w, u, v))
        for v in order[1:]:
            before[v] = [u for u in adj[v] if dist[u] + adj[v][u] == dist[v]]
            number[v] = sum(number[u] for u in before[v])
        part = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for u in before[v]:
                part[u] += number[u] / number[v] * (1 + part[v])
        for v in order[1:]:
            passed[v] += part[v]
    return {v: (close[v], passed[v] / ((n - 1) * (n - 2)) if n > 2 else passed[v]) for v in nodes}


def some_network(rng, n, links):
    edges = {}
    while len(edges) < links:
        a, b = sorted(rng.sample(range(n), 2))
        edges[a, b] = rng.randint(1, 4)
    return list(range(n)), [(a, b, w) for (a, b), w in edges.items()]


@pytest.mark.parametrize("n,links,block", [(12, 14, 4096), (30, 60, 7), (20, 150, 4096)])
def test_equal_to_plain_search(spark, n, links, block):
    nodes, edges = some_network(random.Random(n), n, links)
    got = N.path_centralities(spark.createDataFrame([(v,) for v in nodes], "node long"), spark.createDataFrame(edges, "src long, dst long, weight long"), block)
    want = plain(nodes, edges)
    rows = {r.node: (r.closeness, r.betweenness) for r in got.collect()}
    assert rows.keys() == want.keys()
    for v in nodes:
        assert rows[v] == pytest.approx(want[v], abs=1e-12)


def test_chain_star_and_loose_nodes(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}", 1.5) for i in range(11)]
    star = [("hub", f"leaf{i}", 2.0) for i in range(6)]
    nodes = sorted({x for a, b, _ in chain + star for x in (a, b)} | {"alone"})
    got = N.path_centralities(spark.createDataFrame([(v,) for v in nodes], "node string"), spark.createDataFrame(chain + star, "src string, dst string, weight double"))
    want = plain(nodes, chain + star)
    for r in got.collect():
        assert (r.closeness, r.betweenness) == pytest.approx(want[r.node], abs=1e-12)


def test_no_nodes_no_edges_and_wrong_lengths(spark):
    none = spark.createDataFrame([], "node long")
    edges = spark.createDataFrame([], "src long, dst long, weight long")
    assert N.path_centralities(none, edges).collect() == []
    one = N.path_centralities(spark.createDataFrame([(1,), (2,)], "node long"), edges).collect()
    assert sorted(tuple(r) for r in one) == [(1, 0.0, 0.0), (2, 0.0, 0.0)]
    with pytest.raises(Exception, match="not above 0"):
        N.path_centralities(spark.range(2).select(F.col("id").alias("node")), spark.createDataFrame([(0, 1, 0)], "src long, dst long, weight long"))
