"""Disruption of links that may go both ways, with one number for the directions of a pair."""

import random

from scriptorium.operators import citation as C


def test_disruption_of_mutual_links_carries_one_direction_column(spark):
    rng = random.Random(3)
    links = {(rng.randrange(14), rng.randrange(14)) for _ in range(70)}
    links = {(a, b) for a, b in links if a != b}
    assert any((b, a) in links for a, b in links)
    got = C.disruption(spark.createDataFrame([(i,) for i in range(14)], "doc_id long"), spark.createDataFrame(sorted(links), "citing long, cited long"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "way_xy" in plan and "down_xy" not in plan
    refs = {f: {b for a, b in links if a == f} for f in range(14)}
    for r in got.collect():
        f = r.doc_id
        citers = {a for a, b in links if b == f}
        j = {c for c in citers if any((c, x) in links for x in refs[f])}
        k = sum((c, x) in links and c != f and c not in citers for x in refs[f] for c in range(14))
        assert (r.n_citing, r.n_i, r.n_j, r.n_k) == (len(citers), len(citers - j), len(j), k)
