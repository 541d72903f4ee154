"""Benchmarking, flows between fields, attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attention as A
from ..operators import benchmarking as B
from ..operators import flows as K
from .fixtures import WORKS, long_sql, scalars, table, with_sql, works
from .q_groups import GOAL_FLAGS, GOALS
from .registry import query, rounded

OBS = "o AS (SELECT entity AS category, count(*) AS n FROM long JOIN works USING (doc_id) WHERE year BETWEEN 1996 AND 2000 GROUP BY entity)"
REF = "r AS (SELECT n_name AS category, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)"
REP = """p AS (SELECT category, o.n AS observed, o.n / (SELECT sum(n) FROM o) * 100 AS observed_pct, r.n AS reference, r.n / (SELECT sum(n) FROM r) * 100 AS reference_pct FROM o JOIN r USING (category)),
q AS (SELECT *, observed_pct - reference_pct AS difference FROM p),
s AS (SELECT category, observed, round(observed_pct, 6) AS observed_pct, reference, round(reference_pct, 6) AS reference_pct, round(difference, 6) AS difference,
 CASE WHEN difference > 0.3 THEN 'Over-represented' WHEN difference < -0.3 THEN 'Under-represented' ELSE 'Similar' END AS classification FROM q)"""
COMPARE = with_sql(WORKS, long_sql("countries"), OBS, REF, REP)


def reference(spark, d):
    n = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return n.groupBy(F.col("n_name").alias("category")).agg(F.count(F.lit(1)).alias("count"))


def compared(spark, d):
    obs = B.observed_distribution(works(spark, d, "countries"), "countries", "list", 1996, 2000)
    return B.representation(obs, reference(spark, d), threshold=0.3)


@query("J1_observed_distribution", with_sql(WORKS, long_sql("countries"), OBS) + "SELECT category, n AS count FROM o")
def _(spark, d):
    return B.observed_distribution(works(spark, d, "countries"), "countries", "list", 1996, 2000)


@query("J1_flag_distribution", f"WITH f AS (SELECT {GOAL_FLAGS} FROM documents) SELECT 'SDG ' || substr(goal, 4) AS category, CAST(sum(v) AS BIGINT) AS count FROM (UNPIVOT f ON COLUMNS(*) INTO NAME goal VALUE v) GROUP BY goal")
def _(spark, d):
    from ..operators.concepts import tag_goals

    return B.flag_distribution(tag_goals(table(spark, d, "documents"), "text", GOALS))


@query("J2_reference_distribution", "WITH " + REF + " SELECT category, CAST(n AS DOUBLE) AS count FROM r")
def _(spark, d):
    return B.reference_distribution(reference(spark, d).select(F.col("category").alias("Country"), F.col("count").cast("string").alias("N")))


@query("J3_representation", COMPARE + "SELECT * FROM s")
def _(spark, d):
    return rounded(compared(spark, d))


@query(
    "J4_goodness_of_fit",
    COMPARE.rstrip() + """, t AS (SELECT sum(observed) / sum(reference_pct) AS f FROM q)
    SELECT category, observed, round(sum(pow(observed - reference_pct * f, 2) / (reference_pct * f)) OVER (), 6) AS chi2 FROM q, t""",
)
def _(spark, d):
    return rounded(B.goodness_of_fit(compared(spark, d)).select("category", "observed", "chi2"))


@query("J4_goodness_of_fit_p")
def _(spark, d):
    """With the tail probability (no SQL counterpart)."""
    return B.goodness_of_fit(compared(spark, d))


@query("J5_over_represented", COMPARE + "SELECT * FROM s WHERE difference > 0.3")
def _(spark, d):
    return rounded(B.over_represented(compared(spark, d), 0.3))


@query("J5_under_represented", COMPARE + "SELECT * FROM s WHERE difference < -0.3")
def _(spark, d):
    return rounded(B.under_represented(compared(spark, d), 0.3))


FIELDS = [("authors", "list", 15), ("author_keywords", "list", 20), ("source", "single", 25)]
TOPS = [
    f"t{i} AS (SELECT entity FROM {f} GROUP BY entity ORDER BY count(*) DESC, entity LIMIT {n})" for i, (f, _, n) in enumerate(FIELDS)
]
LEVELS = with_sql(
    WORKS, long_sql("authors", "authors"), long_sql("author_keywords", "author_keywords"), "source AS (SELECT doc_id, source AS entity FROM works)", *TOPS,
    *[f"l{i} AS (SELECT doc_id, entity, year, cited_by FROM {f} JOIN works USING (doc_id) WHERE entity IN (FROM t{i}))" for i, (f, _, _) in enumerate(FIELDS)],
)


def flow_sql(value: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS level, '{FIELDS[i][0]}' AS source_field, a.entity AS source, '{FIELDS[i + 1][0]}' AS target_field, b.entity AS target, count(*) AS weight, {value} AS value
        FROM l{i} a JOIN l{i + 1} b USING (doc_id) GROUP BY a.entity, b.entity""" for i in range(2)
    )


@query("J6_field_flows", LEVELS + flow_sql("round(avg(a.year), 6)"))
def _(spark, d):
    return rounded(K.field_flows(works(spark, d, "authors", "author_keywords"), FIELDS, "avg_year"))


@query("J7_flow_table_citations", LEVELS + flow_sql("CAST(sum(a.cited_by) AS DOUBLE)"))
def _(spark, d):
    return K.field_flows(works(spark, d, "authors", "author_keywords"), FIELDS, "citations")


@query(
    "J6_field_nodes",
    LEVELS.rstrip() + f""", fl AS ({flow_sql('0')}), sz AS (SELECT level, source AS name, weight FROM fl UNION ALL SELECT level + 1, target, weight FROM fl),
    fs AS (SELECT level, name, sum(weight) AS w FROM sz GROUP BY ALL), nd AS (""" + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS level, '{f}' AS field, entity AS name, CAST(count(*) AS DOUBLE) AS value FROM l{i} GROUP BY entity" for i, (f, _, _) in enumerate(FIELDS)
    ) + ") SELECT level, field, name, CAST(coalesce(w, 0) AS BIGINT) AS flow, value FROM nd LEFT JOIN fs USING (level, name)",
)
def _(spark, d):
    return K.field_nodes(works(spark, d, "authors", "author_keywords"), FIELDS, "docs")


# counts of events per user and kind stand in for the attention counts of a work
KINDS = {"twitter_count": "click", "news_count": "purchase", "blog_count": "signup", "mendeley_count": "view", "policy_count": "error"}
COUNTED = "a AS (SELECT user_id AS doc_id, CAST(min(year(ts)) AS INTEGER) + CAST(user_id % 3 AS INTEGER) AS year, " + ", ".join(
    f"count(*) FILTER (event_type = '{v}') AS {k}" for k, v in KINDS.items()
) + " FROM events GROUP BY user_id)"
SCORE = "z AS (SELECT *, round(CAST(" + " + ".join(f"{k} * {A.WEIGHTS[k]}" for k in KINDS) + " AS DOUBLE), 2) AS attention_score FROM a)"
SCORED = "WITH " + COUNTED + ", " + SCORE + ", s AS (SELECT *, CAST(attention_score > 0 AS INTEGER) AS has_attention FROM z) "


def scored(spark, d):
    e = table(spark, d, "events")
    per = e.groupBy(F.col("user_id").alias("doc_id")).agg(
        F.min(F.year("ts")).alias("year"), *[F.count_if(F.col("event_type") == v).alias(k) for k, v in KINDS.items()]
    )
    return A.attention_score(per.withColumn("year", F.col("year") + (F.col("doc_id") % 3).cast("int")))


@query("J9_attention_score", SCORED + "SELECT * FROM s")
def _(spark, d):
    return scored(spark, d)


@query(
    "J8_attention_summary",
    SCORED + """SELECT count(*) AS n_papers, CAST(sum(has_attention) AS BIGINT) AS n_with_attention, round(sum(has_attention) / count(*), 6) AS attention_rate, round(avg(attention_score), 6) AS mean_score,
    round(median(attention_score), 6) AS median_score, max(attention_score) AS max_score, """ + ", ".join(f"CAST(sum({k}) AS BIGINT) AS total_{k}" for k in KINDS) + " FROM s",
)
def _(spark, d):
    return rounded(A.attention_summary(scored(spark, d)))


@query("J10_attention_by_year", SCORED + "SELECT year, round(avg(attention_score), 6) AS mean_score, CAST(sum(twitter_count) AS BIGINT) AS twitter_count, CAST(sum(mendeley_count) AS BIGINT) AS mendeley_count FROM s GROUP BY year")
def _(spark, d):
    return rounded(A.attention_by_year(scored(spark, d)))


@query("J10_coverage", SCORED + " UNION ALL ".join(f"SELECT '{k}' AS source, round(count(*) FILTER ({k} > 0) / count(*) * 100, 6) AS coverage_pct FROM s" for k in KINDS))
def _(spark, d):
    return rounded(A.coverage(scored(spark, d)))


@query("J10_top_attention", SCORED + "SELECT doc_id, attention_score FROM s ORDER BY attention_score DESC, doc_id LIMIT 20")
def _(spark, d):
    return A.top_attention(scored(spark, d), 20).select("doc_id", "attention_score")


@query(
    "D15_score_histogram",
    SCORED + """, l AS (SELECT ln(attention_score + 1) AS v FROM s), e AS (SELECT max(v) + 0.5::DOUBLE AS hi FROM l), h AS (SELECT least(CAST(floor(v / (hi / 29)) AS INTEGER), 28) AS bin, count(*) AS n FROM l, e GROUP BY 1)
    SELECT CAST(b AS INTEGER) AS bin, round(b * (hi / 29), 6) AS low, round((b + 1) * (hi / 29), 6) AS high, coalesce(n, 0) AS n FROM e, range(0, 29) g(b) LEFT JOIN h ON bin = b""",
)
def _(spark, d):
    return rounded(A.score_histogram(scored(spark, d)))
