"""references are summed per cited work before they meet the collection."""

import re

from scriptorium.operators import citation as C


def test_match_statistics_join_one_row_per_cited_work(spark):
    works = [(f"W{i}", [f"W{i}", "W-1", "W0", "W0", None, "x"][: 6 - i % 3]) for i in range(9)] + [("W3", ["W0"]), (None, ["W1", None]), ("W20", None)]
    df = spark.createDataFrame(works, "doc_id string, references array<string>")
    links = [(d, r) for d, rs in works for r in rs or [] if r is not None]
    inner = [(d, r) for d, r in links if d is not None and d != r and r in {d for d, _ in works}]
    got = C.match_statistics(df)
    row = got.first()
    assert (row.documents, row.internal_references, row.edges) == (len(works), len(inner), len(set(inner)))
    assert C.match_statistics(df.limit(0)).first()[:4] == (0, 0, 0, 0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join LeftOuter")
    assert re.search(r"Aggregate \[cited#\d+\], \[cited#\d+, sum", plan[join:])
