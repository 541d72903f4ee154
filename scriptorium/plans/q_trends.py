"""Time series, trends, life cycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as Y
from ..operators import trends as E
from .fixtures import WORKS, counts_sql, long_sql, scalars, with_sql, works
from .registry import query, rounded


def series_sql(src: str = "works") -> str:
    return f"""y AS (SELECT CAST(y AS INTEGER) AS year, count(doc_id) AS docs, CAST(coalesce(sum(cited_by), 0) AS BIGINT) AS citations
     FROM range((SELECT min(year) FROM {src}), (SELECT max(year) + 1 FROM {src})) g(y) LEFT JOIN {src} ON year = y GROUP BY y)"""


SHARES = """round(docs / sum(docs) OVER (), 6) AS share, round(docs / sum(docs) OVER () * 100, 6) AS percentage,
  CAST(sum(docs) OVER (ORDER BY {o}) AS BIGINT) AS cumulative_docs, CAST(sum(citations) OVER (ORDER BY {o}) AS BIGINT) AS cumulative_citations"""
CHANGE = "round((docs - lag(docs) OVER (ORDER BY year)) / nullif(lag(docs) OVER (ORDER BY year), 0) * 100, 6)"


@query(
    "E1_yearly_production",
    with_sql(WORKS, series_sql()) + f"SELECT year, docs, citations, {SHARES.format(o='year')}, {CHANGE} AS docs_change_pct, {CHANGE.replace('docs', 'citations')} AS citations_change_pct FROM y",
)
def _(spark, d):
    return rounded(E.yearly_production(scalars(spark, d)))


@query(
    "E2_five_year_periods",
    with_sql(WORKS, "p AS (SELECT CAST(floor(year / 5) * 5 AS INTEGER) AS period_start, count(*) AS docs, CAST(sum(cited_by) AS BIGINT) AS citations FROM works GROUP BY 1)")
    + f"SELECT period_start, docs, citations, {SHARES.format(o='period_start')} FROM p",
)
def _(spark, d):
    return rounded(E.by_period(E.yearly_counts(scalars(spark, d)), 5))


@query(
    "E3_merge_before",
    with_sql(WORKS, series_sql(), f"z AS (SELECT year, docs, citations, {SHARES.format(o='year')} FROM y)")
    + """SELECT '<1998' AS period, 1997 AS period_start, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(citations) AS BIGINT) AS citations, round(sum(share), 6) AS share,
      max_by(percentage, year) AS percentage, max(cumulative_docs) AS cumulative_docs, max(cumulative_citations) AS cumulative_citations FROM z WHERE year < 1998
     UNION ALL SELECT CAST(year AS VARCHAR), year, docs, citations, share, percentage, cumulative_docs, cumulative_citations FROM z WHERE year >= 1998""",
)
def _(spark, d):
    return rounded(E.merge_before(E.with_shares(E.yearly_counts(scalars(spark, d))), 1998))


LIN = "f AS (SELECT regr_slope(docs, year) AS b, regr_intercept(docs, year) AS a, regr_r2(docs, year) AS r2 FROM y)"


@query(
    "E4_linear_trend",
    with_sql(WORKS, series_sql(), LIN) + "SELECT year, docs, citations, round(b * year + a, 4) AS trend, round(r2, 6) AS r_squared FROM y, f",
)
def _(spark, d):
    return rounded(E.linear_trend(E.yearly_counts(scalars(spark, d)))).withColumn("trend", F.round("trend", 4))


def ma_sql(k: int) -> str:
    w = f"OVER (ORDER BY year ROWS BETWEEN {k} PRECEDING AND {k} FOLLOWING)"
    return f"SELECT year, docs, citations, round(CASE WHEN count(docs) {w} = {2 * k + 1} THEN avg(docs) {w} END, 6) AS trend FROM y"


@query("E4_moving_average_3", with_sql(WORKS, series_sql()) + ma_sql(1))
def _(spark, d):
    return rounded(E.moving_average(E.yearly_counts(scalars(spark, d)), 3))


@query("E4_moving_average_5", with_sql(WORKS, series_sql()) + ma_sql(2))
def _(spark, d):
    return rounded(E.moving_average(E.yearly_counts(scalars(spark, d)), 5))


# quadratic least squares by Cramer's rule on years counted from the mean
QUAD = """c AS (SELECT year, docs, citations, year - avg(year) OVER () AS x FROM y),
m AS (SELECT count(*) AS n, sum(x) AS s1, sum(x*x) AS s2, sum(pow(x,3)) AS s3, sum(pow(x,4)) AS s4, sum(docs) AS t0, sum(docs*x) AS t1, sum(docs*x*x) AS t2 FROM c),
q AS (SELECT n*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det,
  t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2) AS d0,
  n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2) AS d1,
  n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2) AS d2 FROM m)"""


@query("E4_quadratic_trend", with_sql(WORKS, series_sql(), QUAD) + "SELECT year, docs, citations, round((d0 + d1 * x + d2 * x * x) / det, 4) AS trend FROM c, q")
def _(spark, d):
    return E.polynomial_trend(E.yearly_counts(scalars(spark, d)), 2).withColumn("trend", F.round("trend", 4))


# cubic least squares by polynomials that are orthogonal on the years
CUBE = """c AS (SELECT *, year - avg(year) OVER () AS x FROM y),
q2 AS (SELECT *, x * x - avg(x * x) OVER () - x * (sum(pow(x, 3)) OVER () / sum(x * x) OVER ()) AS b FROM c),
q3 AS (SELECT *, pow(x, 3) - avg(pow(x, 3)) OVER () - x * (sum(pow(x, 4)) OVER () / sum(x * x) OVER ()) - b * (sum(pow(x, 3) * b) OVER () / sum(b * b) OVER ()) AS e FROM q2)"""


@query(
    "E4_cubic_trend",
    with_sql(WORKS, series_sql(), CUBE)
    + "SELECT year, docs, citations, round(avg(docs) OVER () + x * sum(docs * x) OVER () / sum(x * x) OVER () + b * sum(docs * b) OVER () / sum(b * b) OVER () + e * sum(docs * e) OVER () / sum(e * e) OVER (), 4) AS trend FROM q3",
)
def _(spark, d):
    return E.polynomial_trend(E.yearly_counts(scalars(spark, d)), 3).withColumn("trend", F.round("trend", 4))


@query("E4_exponential_trend")
def _(spark, d):
    return E.exponential_trend(E.yearly_counts(scalars(spark, d)))


@query(
    "E5_trend_summary",
    with_sql(WORKS, series_sql(), f"g AS (SELECT *, {CHANGE.replace('round(', '(').replace(', 6)', ')')} AS g FROM y)")
    + """SELECT category, indicator, CAST(value AS DOUBLE) AS value FROM (SELECT min(year) AS a, max(year) AS b, count(*) AS n, sum(docs) AS s, avg(docs) AS m, max(docs) AS x,
     sum(citations) AS c, avg(citations) AS mc, avg(g) AS g, regr_r2(docs, year) AS r2 FROM g), LATERAL (VALUES
     ('Time Span', 'Start Year', CAST(a AS DOUBLE)), ('Time Span', 'End Year', b), ('Time Span', 'Number of Years', n), ('Documents', 'Total', s),
     ('Documents', 'Average per Year', round(m, 1)), ('Documents', 'Maximum', x), ('Citations', 'Total', c), ('Citations', 'Average per Year', round(mc, 1)),
     ('Growth', 'Avg Annual Growth (%)', round(g, 1)), ('Trendline', 'R2', round(r2, 4))) v(category, indicator, value)""",
)
def _(spark, d):
    return E.trend_summary(E.yearly_counts(scalars(spark, d)))


GROWTH = (
    with_sql(WORKS, "y AS (SELECT year, count(*) AS docs, sum(cited_by) AS citations FROM works GROUP BY year)",
      f"g AS (SELECT *, {CHANGE.replace('round(', '(').replace(', 6)', ')')} AS g, row_number() OVER (ORDER BY year DESC) AS r FROM y)")
    + """SELECT category, indicator, CAST(value AS DOUBLE) AS value FROM (SELECT min(year) AS a, max(year) AS b, count(*) AS n, arg_max(year, docs) AS py, max(docs) AS pd,
     (exp(avg(ln(1 + g / 100))) - 1) * 100 AS gm, arg_max(year, g) AS hy, max(g) AS hg, arg_min(year, g) AS ly, min(g) AS lg,
     (exp(avg(ln(1 + g / 100)) FILTER (r <= 3)) - 1) * 100 AS g3, (exp(avg(ln(1 + g / 100)) FILTER (r <= 5)) - 1) * 100 AS g5, count(g) AS k,
     arg_max(year, citations) AS cy, max(citations) AS cc, avg(citations) AS ca FROM g), LATERAL (VALUES
     ('Time Series', 'First year', CAST(a AS DOUBLE)), ('Time Series', 'Last year', b), ('Time Series', 'Number of years', n), ('Time Series', 'Most productive year', py),
     ('Time Series', 'Documents in most productive year', pd), ('Growth', 'Average annual growth (%)', round(gm, 1)), ('Growth', 'Highest growth year', hy),
     ('Growth', 'Highest growth (%)', round(hg, 1)), ('Growth', 'Lowest growth year', ly), ('Growth', 'Lowest growth (%)', round(lg, 1)),
     ('Growth', 'Average growth, last 3 years (%)', round(g3, 1)), ('Growth', 'Average growth, last 5 years (%)', CASE WHEN k >= 5 THEN round(g5, 1) END),
     ('Citations', 'Most cited year', cy), ('Citations', 'Citations in most cited year', cc), ('Citations', 'Average citations per year', round(ca, 0))) v(category, indicator, value)"""
)


@query("E6_growth_statistics", GROWTH)
def _(spark, d):
    return E.growth_statistics(scalars(spark, d))


ENT = "e AS (SELECT entity, year, count(*) AS docs, CAST(sum(cited_by) AS BIGINT) AS citations FROM long JOIN works USING (doc_id) GROUP BY ALL)"
TOP = "k AS (SELECT entity FROM counts ORDER BY docs DESC, entity LIMIT 12)"


@query(
    "E7_entity_over_time",
    with_sql(WORKS, long_sql("author_keywords"), counts_sql(), ENT, TOP) + """SELECT k.entity, CAST(y AS INTEGER) AS year, coalesce(docs, 0) AS count
    FROM k CROSS JOIN range((SELECT min(year) FROM works), (SELECT max(year) + 1 FROM works)) g(y) LEFT JOIN e ON e.entity = k.entity AND e.year = y""",
)
def _(spark, d):
    return E.entity_over_time(works(spark, d, "author_keywords"), "author_keywords", top_n=12, min_docs=5)


@query(
    "E7_entity_over_time_cumulative",
    with_sql(WORKS, "e AS (SELECT doc_type AS entity, year, count(*) AS docs FROM works GROUP BY ALL)", "k AS (SELECT DISTINCT entity FROM e)")
    + """SELECT k.entity, CAST(y AS INTEGER) AS year, CAST(sum(coalesce(docs, 0)) OVER (PARTITION BY k.entity ORDER BY y) AS BIGINT) AS count
    FROM k CROSS JOIN range((SELECT min(year) FROM works), (SELECT max(year) + 1 FROM works)) g(y) LEFT JOIN e ON e.entity = k.entity AND e.year = y""",
)
def _(spark, d):
    return E.entity_over_time(scalars(spark, d), "doc_type", "single", cumulative=True)


@query(
    "E8_items_timeline",
    with_sql(WORKS, long_sql("author_keywords"), counts_sql(), ENT, TOP) + "SELECT entity, year, docs, citations, round(citations / docs, 6) AS value FROM e WHERE entity IN (SELECT entity FROM k)",
)
def _(spark, d):
    return rounded(E.items_timeline(works(spark, d, "author_keywords"), "author_keywords", top_n=12))


@query(
    "E9_trend_topics",
    with_sql(WORKS, "e AS (SELECT source AS entity, year, count(*) AS docs, CAST(sum(cited_by) AS BIGINT) AS citations FROM works WHERE regexp_matches(source, '[1-8]$') GROUP BY ALL)",
      "t AS (SELECT source AS entity, quantile_cont(year, 0.5) AS median_year, max(year) AS last, count(*) AS total FROM works WHERE regexp_matches(source, '[1-8]$') GROUP BY ALL HAVING count(*) >= 5)",
      "k AS (SELECT * FROM t ORDER BY median_year DESC, entity LIMIT 50)")
    + """SELECT entity, year, docs, citations, round(median_year, 6) AS median_year,
    round(sum(CASE WHEN year >= last - 3 THEN docs ELSE 0 END) OVER (PARTITION BY entity) / total, 6) AS growth_rate FROM e JOIN k USING (entity)""",
)
def _(spark, d):
    return rounded(E.trend_topics(scalars(spark, d), "source", "single", min_docs=5, pattern="[1-8]$"))


def _series(spark, d):
    per = E.entity_years(works(spark, d, "subject_areas"), "subject_areas")
    return per.select(F.col("entity").alias("series"), "year", "docs")


@query("E10_life_cycle_fit")
def _(spark, d):
    """One logistic fit per subject area."""
    return Y.life_cycle(_series(spark, d))


@query("E10_life_cycle_parameters")
def _(spark, d):
    return Y.parameters(Y.life_cycle(_series(spark, d)))


@query("E11_milestones")
def _(spark, d):
    return Y.milestones(Y.life_cycle(_series(spark, d)))


@query("E11_forecast")
def _(spark, d):
    return Y.forecast(Y.life_cycle(_series(spark, d)), horizon=5)


def _moments(spark, d):
    """Curves whose parameters are moments of the series, so that SQL can follow the closed forms."""
    per = _series(spark, d).groupBy("series").agg(
        (2 * F.sum("docs")).cast("double").alias("k"), (1 / (1 + F.stddev_pop("year"))).alias("r"), F.avg("year").alias("tm"), F.max("year").alias("last_year"),
    )
    return per.withColumn("success", F.lit(True))


MOMENTS = with_sql(
    WORKS, long_sql("subject_areas"), "s AS (SELECT entity AS series, year, count(*) AS docs FROM long JOIN works USING (doc_id) GROUP BY ALL)",
    "f AS (SELECT series, CAST(2 * sum(docs) AS DOUBLE) AS k, 1 / (1 + stddev_pop(year)) AS r, avg(year) AS tm, max(year) AS last_year FROM s GROUP BY series)",
)


@query("E11_milestones_of_moments", MOMENTS + "SELECT series, p AS percent, round(tm + ln((p / 100) / (1 - p / 100)) / r, 6) AS year FROM f, (SELECT unnest([10, 25, 50, 75, 90, 99])::INTEGER AS p)")
def _(spark, d):
    return rounded(Y.milestones(_moments(spark, d)))


@query(
    "E11_forecast_of_moments",
    MOMENTS + """SELECT series, CAST(y AS INTEGER) AS year, round(k / (1 + e), 4) AS cumulative, round(k * r * e / ((1 + e) * (1 + e)), 4) AS annual
    FROM (SELECT *, exp(-r * (y - tm)) AS e FROM (SELECT *, unnest(range(last_year, last_year + 6)) AS y FROM f))""",
)
def _(spark, d):
    return rounded(Y.forecast(_moments(spark, d), horizon=5), 4)
