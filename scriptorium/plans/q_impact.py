"""Citation indices, descriptive statistics, distributions, top cited."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import descriptive as D
from ..operators import distribution as X
from ..operators import impact as I
from ..operators import top_cited as T
from .fixtures import CITES, WORKS, counts_sql, long_sql, scalars, with_sql, works
from .registry import query, rounded

JOINED = "j AS (SELECT entity, doc_id, year, cited_by AS c FROM long JOIN works USING (doc_id))"


def ranked(keys: str = "entity", src: str = "j") -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""r AS (SELECT *, row_number() OVER ({part} ORDER BY c DESC, doc_id) AS i,
      sum(c) OVER ({part} ORDER BY c DESC, doc_id) AS s FROM {src})"""


H, G, W = (
    "coalesce(max(CASE WHEN c >= i THEN i END), 0)",
    "coalesce(max(CASE WHEN s >= i * i THEN i END), 0)",
    "coalesce(max(CASE WHEN c >= 10 * i THEN i END), 0)",
)
ALL = "a AS (SELECT doc_id, year, cited_by AS c FROM works)"


@query("D1_h_index", with_sql(WORKS, long_sql("countries"), JOINED, ranked()) + f"SELECT entity, count(*) AS docs, {H} AS h_index FROM r GROUP BY entity")
def _(spark, d):
    from ..functions.lists import explode_entities

    long = explode_entities(works(spark, d, "countries"), "countries", "cited_by")
    return I.indices(long, ["entity"]).select("entity", "docs", "h_index")


@query("D2_g_index", with_sql(WORKS, "j AS (SELECT source AS entity, doc_id, cited_by AS c FROM works)", ranked()) + f"SELECT entity, {G} AS g_index FROM r GROUP BY entity")
def _(spark, d):
    return I.indices(scalars(spark, d), ["source"]).select(F.col("source").alias("entity"), "g_index")


@query("D3_w_index", with_sql(WORKS, "j AS (SELECT doc_type AS entity, doc_id, cited_by AS c FROM works)", ranked()) + f"SELECT entity, {W} AS w_index FROM r GROUP BY entity")
def _(spark, d):
    return I.indices(scalars(spark, d), ["doc_type"]).select(F.col("doc_type").alias("entity"), "w_index")


@query("D4_hg_index", with_sql(WORKS, "j AS (SELECT source AS entity, doc_id, cited_by AS c FROM works)", ranked()) + f"SELECT entity, round(sqrt({H} * {G}), 6) AS hg_index FROM r GROUP BY entity")
def _(spark, d):
    return rounded(I.indices(scalars(spark, d), ["source"]).select(F.col("source").alias("entity"), "hg_index"))


@query(
    "D5_a_r_index",
    with_sql(WORKS, "j AS (SELECT source AS entity, doc_id, cited_by AS c FROM works)", ranked(), f"h AS (SELECT entity, {H} AS h_index FROM r GROUP BY entity)")
    + """SELECT entity, h_index, round(CASE WHEN h_index > 0 THEN coalesce(sum(CASE WHEN i <= h_index THEN c END), 0) / h_index ELSE 0 END, 6) AS a_index,
     round(sqrt(coalesce(sum(CASE WHEN i <= h_index THEN c END), 0)), 6) AS r_index FROM r JOIN h USING (entity) GROUP BY entity, h_index""",
)
def _(spark, d):
    return rounded(I.core_indices(scalars(spark, d), ["source"]).withColumnRenamed("source", "entity"))


@query(
    "D6_citation_thresholds",
    with_sql(WORKS, "t AS (SELECT CAST(unnest([1, 5, 10, 25, 50, 100]) AS INTEGER) AS threshold)")
    + "SELECT threshold, count(*) AS docs FROM works JOIN t ON cited_by >= threshold GROUP BY threshold",
)
def _(spark, d):
    return I.thresholds(scalars(spark, d))


@query(
    "D7_gini",
    with_sql(WORKS, "j AS (SELECT doc_type AS entity, doc_id, cited_by AS c FROM works)",
      "r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY c, doc_id) AS i FROM j)",
      "q AS (SELECT entity, count(*) AS n, sum(c) AS s, sum(i * c) AS w FROM r GROUP BY entity)")
    + "SELECT entity, n AS docs, round((2 * w - (n + 1) * s) / (n * s), 6) AS gini, round((2 * w - (n + 1) * s) / (n * s) - 1 / n, 6) AS gini_shifted FROM q",
)
def _(spark, d):
    return rounded(I.gini(scalars(spark, d), ["doc_type"]).withColumnRenamed("doc_type", "entity"))


FULL = f"""SELECT entity, count(*) AS docs, CAST(sum(c) AS BIGINT) AS total_citations, {H} AS h_index, round(avg(year), 6) AS mean_year,
  {G} AS g_index, {W} AS w_index, round(sqrt({H} * {G}), 6) AS hg_index, round(sum(c) / count(*), 6) AS mean_citations FROM r"""


@query(
    "D8_entity_stats_authors",
    with_sql(WORKS, long_sql("authors"), counts_sql(), JOINED, ranked()) + FULL
    + " WHERE entity IN (SELECT entity FROM counts ORDER BY docs DESC, entity LIMIT 50) GROUP BY entity",
)
def _(spark, d):
    return rounded(I.entity_stats(works(spark, d, "authors"), "authors", depth="full", top_n=50))


@query("D8_entity_stats_sources", with_sql(WORKS, "j AS (SELECT source AS entity, doc_id, year, cited_by AS c FROM works)", ranked()) + FULL + " GROUP BY entity")
def _(spark, d):
    """All sources, no top-N."""
    return rounded(I.entity_stats(scalars(spark, d), "source", "single", "full", top_n=None))


ITEMS = [("authors", "authors"), ("countries", "countries"), ("author_keywords", "author keywords"), ("index_keywords", "index keywords")]
SUMMARY = (
    with_sql(WORKS, *[long_sql(f, f) for f, _ in ITEMS], CITES)
    + """, b AS (SELECT count(*) AS n, min(year) AS y0, max(year) AS y1, count(DISTINCT source) AS s, sum(cited_by) AS c, avg(cited_by) AS m,
       quantile_cont(cited_by, 0.5) AS md, max(cited_by) AS mx, count(*) FILTER (cited_by > 0) AS cd FROM works),
    x AS (SELECT (SELECT count(*) FROM cites WHERE citing IN (SELECT doc_id FROM works)) AS refs, """
    + ", ".join(f"(SELECT count(DISTINCT entity) FROM {f}) AS {f}" for f, _ in ITEMS)
    + """)
    SELECT category, indicator, CAST(value AS DOUBLE) AS value FROM b, x, LATERAL (VALUES
    ('Dataset', 'Number of documents', CAST(n AS DOUBLE)), ('Dataset', 'First year', y0), ('Dataset', 'Last year', y1), ('Dataset', 'Number of years', y1 - y0 + 1),
    ('Dataset', 'Number of sources', s), """
    + ", ".join(f"('Dataset', 'Number of {label}', {f})" for f, label in ITEMS)
    + """, ('Dataset', 'Authors per document', round(authors / n, 2)), ('Dataset', 'Total references', refs), ('Dataset', 'References per document', round(refs / n, 2)),
    ('Citations', 'Total citations', c), ('Citations', 'Average citations', round(m, 2)), ('Citations', 'Median citations', floor(md)), ('Citations', 'Max citations', mx),
    ('Citations', 'Cited documents', cd), ('Citations', 'Uncited documents', n - cd), ('Citations', 'Citation rate (%)', round(cd / n * 100, 1))) v(category, indicator, value)"""
)
FIELDS = tuple(f for f, _ in ITEMS)


@query("D9_dataset_summary", SUMMARY)
def _(spark, d):
    return D.dataset_summary(works(spark, d, *FIELDS, "references"))


PERF = (
    with_sql(WORKS, long_sql("authors"), ALL, ranked("", "a"))
    + f""", ix AS (SELECT count(*) AS n, sum(c) AS s, {H} AS h, {G} AS g, sum(i * c) AS dw FROM r),
    co AS (SELECT coalesce(sum(c), 0) AS core FROM r, ix WHERE i <= h),
    b AS (SELECT avg(year) AS my, min(year) AS y0, max(year) AS y1, quantile_cont(year, 0.25) AS q1, quantile_cont(year, 0.5) AS q2,
      quantile_cont(year, 0.75) AS q3, count(*) FILTER (cited_by > 0) AS cd FROM works),
    ca AS (SELECT avg(k) AS ci FROM (SELECT count(*) AS k FROM long GROUP BY doc_id)),
    t AS (SELECT CAST(unnest([1, 5, 10, 25, 50, 100]) AS INTEGER) AS t)
    SELECT category, indicator, CAST(value AS DOUBLE) AS value FROM ix, co, b, ca, LATERAL (VALUES
    ('Core', 'Number of documents', CAST(n AS DOUBLE)), ('Core', 'Total citations', s), ('Core', 'H-index', h), ('Core', 'Average year', round(my, 1)),
    ('Extended', 'G-index', g), ('Extended', 'First year', y0), ('Extended', 'Last year', y1), ('Extended', 'Q1 year', floor(q1)),
    ('Extended', 'Median year', floor(q2)), ('Extended', 'Q3 year', floor(q3)),
    ('Full', 'Cited documents', cd), ('Full', 'A-index', round(core / h, 2)), ('Full', 'R-index', round(sqrt(core), 2)),
    ('Full', 'Gini index', round(((n + 1) * s - 2 * dw) / (n * s), 3)), ('Collaboration', 'Collaboration index', round(ci, 2)),
    ('Activity', 'Documents per year', round(n / (y1 - y0 + 1), 2)), ('Activity', 'Citations per year', round(s / (y1 - y0 + 1), 2))) v(category, indicator, value)
    UNION ALL SELECT 'Extended', 'C' || t, count(*) FROM works JOIN t ON cited_by >= t GROUP BY t"""
)


@query("D10_performance", PERF)
def _(spark, d):
    return D.performance(works(spark, d, "authors"), "full")


VARS = {"year": "numeric", "cited_by": "numeric", "doc_type": "string", "source": "string", "author_keywords": "list"}


def _txt(x: str) -> str:
    return f"regexp_replace(CAST(CAST({x} AS DOUBLE) AS VARCHAR), '\\.0$', '')"


def numeric_sql(c: str) -> str:
    n = "n"
    return f"""SELECT '{c}' AS variable, indicator, {_txt('value')} AS value FROM (
     SELECT count({c}) AS n, avg({c}) AS m, quantile_cont({c}, 0.5) AS md, stddev_samp({c}) AS sd, min({c}) AS mn, max({c}) AS mx, sum({c}) AS s,
     skewness({c}) AS sk, kurtosis({c}) AS ku, quantile_cont({c}, [0.25, 0.75, 0.9, 0.95]) AS p FROM works), LATERAL (VALUES
     ('Count', CAST({n} AS DOUBLE)), ('Mean', round(m, 2)), ('Median', round(md, 2)), ('Std Dev', round(sd, 2)), ('Min', mn), ('Max', mx), ('Sum', s),
     ('Skewness', round(sk, 3)), ('Kurtosis', round(ku, 3)), ('P25', round(p[1], 2)), ('P75', round(p[2], 2)), ('P90', round(p[3], 2)), ('P95', round(p[4], 2))) v(indicator, value)"""


def string_sql(c: str) -> str:
    return f"""SELECT '{c}', indicator, value FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS u, count(*) - count({c}) AS m FROM works),
      LATERAL (VALUES ('Count', CAST(n AS VARCHAR)), ('Unique', CAST(u AS VARCHAR)), ('Missing', CAST(m AS VARCHAR))) v(indicator, value)
     UNION ALL SELECT '{c}', 'Top ' || row_number() OVER (ORDER BY k DESC, e), e || ' (' || k || ', ' || printf('%.1f', k / n * 100) || '%)' FROM
      (SELECT {c} AS e, count(*) AS k, sum(count(*)) OVER () AS n FROM works WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC, e LIMIT 3)"""


def list_sql(c: str) -> str:
    return f"""SELECT '{c}', indicator, value FROM (SELECT count(*) AS n, count(DISTINCT entity) AS u, count(DISTINCT doc_id) AS k FROM long),
      LATERAL (VALUES ('Total occurrences', CAST(n AS VARCHAR)), ('Unique items', CAST(u AS VARCHAR)), ('Items per document', {_txt('round(n / k, 2)')})) v(indicator, value)
     UNION ALL SELECT '{c}', 'Top ' || row_number() OVER (ORDER BY k DESC, e), e || ' (' || k || ')' FROM
      (SELECT entity AS e, count(*) AS k FROM long GROUP BY entity ORDER BY k DESC, e LIMIT 3)"""


@query(
    "D11_descriptive_statistics",
    with_sql(WORKS, long_sql("author_keywords"))
    + "\nUNION ALL ".join([numeric_sql("year"), numeric_sql("cited_by"), string_sql("doc_type"), string_sql("source"), list_sql("author_keywords")]),
)
def _(spark, d):
    return D.descriptive_statistics(works(spark, d, "author_keywords"), VARS, extra=True)


def _section(name: str, sql: str, group: str) -> str:
    text = "regexp_replace(CAST(CAST(value AS DECIMAL(38, 3)) AS VARCHAR), '\\.?0+$', '')" if group == "category" else "value"
    return f"SELECT '{name}' AS section, {group} AS \"group\", indicator, {text} AS value FROM ({sql}) WHERE value IS NOT NULL"


def all_sql() -> str:
    from .q_trends import GROWTH

    words = with_sql(WORKS, long_sql("author_keywords"))
    numbers = [numeric_sql(c).split("('Skewness'")[0].rstrip().rstrip(",") + ") v(indicator, value)" for c in ("year", "cited_by")]
    told = words + "\nUNION ALL ".join([*numbers, string_sql("doc_type"), string_sql("source"), list_sql("author_keywords")])
    return "\nUNION ALL ".join([
        _section("summary", SUMMARY, "category"), _section("performance", PERF, "category"), _section("time series", GROWTH, "category"), _section("descriptive", told, "variable"),
    ])


@query("D12_all_statistics", all_sql())
def _(spark, d):
    """Union of the summary, performance, growth and descriptive tables."""
    return D.all_statistics(works(spark, d, *FIELDS, "references"), VARS)


DIST = (
    with_sql(WORKS, ALL, ranked("", "a"))
    + f""", m AS (SELECT avg(c) AS mu FROM a),
    z AS (SELECT count(*) AS n, sum(c) AS s, avg(c) AS mean, stddev_pop(c) AS sd, min(c) AS mn, max(c) AS mx, count(*) FILTER (c = 0) AS u,
      avg(pow(c - mu, 2)) AS m2, avg(pow(c - mu, 3)) AS m3, avg(pow(c - mu, 4)) AS m4,
      quantile_cont(CAST(c AS DOUBLE), [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]) AS p FROM a, m),
    x AS (SELECT {H} AS h, {G} AS g, sum(i * c) AS dw FROM r)
    SELECT n AS n_papers, CAST(s AS BIGINT) AS total_citations, round(mean, 6) AS mean, round(p[4], 6) AS median, round(sd, 6) AS std,
    CAST(mn AS DOUBLE) AS min, CAST(mx AS DOUBLE) AS max, """
    + ", ".join(f"round(p[{i + 1}], 6) AS p{q}" for i, q in enumerate((5, 10, 25, 50, 75, 90, 95, 99)))
    + """, u AS uncited, round(u / n * 100, 6) AS uncited_pct, h AS h_index, g AS g_index,
    round(((n + 1) * s - 2 * dw) / (n * s) - 1 / n, 6) AS gini, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM z, x"""
)


@query("D13_distribution_metrics", DIST)
def _(spark, d):
    return rounded(X.distribution_metrics(scalars(spark, d)))


PCT = "p AS (SELECT quantile_cont(CAST(cited_by AS DOUBLE), [0.9, 0.75, 0.5]) AS p FROM works)"
CLS = """c AS (SELECT doc_id, cited_by, CASE WHEN cited_by = 0 THEN 'Uncited' WHEN cited_by >= p[1] THEN 'Highly Cited (Top 10%)'
  WHEN cited_by >= p[2] THEN 'Well Cited (Top 25%)' WHEN cited_by >= p[3] THEN 'Average' ELSE 'Low Cited' END AS citation_class FROM works, p)"""


@query("D14_citation_classes", with_sql(WORKS, PCT, CLS) + "SELECT * FROM c")
def _(spark, d):
    return X.classify(scalars(spark, d)).select("doc_id", "cited_by", "citation_class")


@query(
    "B8_class_report",
    with_sql(WORKS, PCT, CLS) + """SELECT citation_class, count(*) AS papers, round(count(*) / (SELECT count(*) FROM c) * 100, 6) AS percentage,
    CAST(sum(cited_by) AS BIGINT) AS total_citations, round(avg(cited_by), 2) AS mean_citations FROM c GROUP BY citation_class""",
)
def _(spark, d):
    return rounded(X.class_report(scalars(spark, d)))


def hist_sql(src: str, bins: int) -> str:
    return f"""e AS (SELECT CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi FROM {src}),
    h AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / {bins})) AS INTEGER), {bins - 1}) AS bin, count(*) AS n FROM {src}, e GROUP BY ALL)
    SELECT CAST(b AS INTEGER) AS bin, round(lo + b * ((hi - lo) / {bins}), 6) AS low, round(lo + (b + 1) * ((hi - lo) / {bins}), 6) AS high, coalesce(n, 0) AS n
    FROM e, range(0, {bins}) g(b) LEFT JOIN h ON bin = b"""


@query(
    "D15_histogram",
    with_sql(WORKS, "q AS (SELECT quantile_cont(CAST(cited_by AS DOUBLE), 0.99) AS q FROM works)",
      "vals AS (SELECT greatest(0, least(cited_by, q)) AS v FROM works, q)").rstrip() + ",\n" + hist_sql("vals", 30),
)
def _(spark, d):
    return rounded(X.histogram(scalars(spark, d), "cited_by", 30, clip_percentile=99))


@query(
    "D15_log_histogram",
    with_sql(WORKS, "vals AS (SELECT log10(cited_by) AS v FROM works WHERE cited_by > 0)", "t AS (SELECT log10(max(cited_by) + 1) AS hi FROM works)",
      "h AS (SELECT least(CAST(floor(v / hi * 29 + 1e-9) AS INTEGER), 28) AS bin, count(*) AS n FROM vals, t GROUP BY ALL)")
    + """SELECT CAST(b AS INTEGER) AS bin, round(pow(10, hi * b / 29), 6) AS low, round(pow(10, hi * (b + 1) / 29), 6) AS high, coalesce(n, 0) AS n
    FROM t, range(0, 29) g(b) LEFT JOIN h ON bin = b""",
)
def _(spark, d):
    return rounded(X.log_histogram(scalars(spark, d), "cited_by", 30))


@query("D16_top_cited", with_sql(WORKS) + "SELECT doc_id, year, cited_by AS global_citations FROM works ORDER BY cited_by DESC, year, title LIMIT 25")
def _(spark, d):
    return T.top_cited(scalars(spark, d), 25).select("doc_id", "year", "global_citations")


@query(
    "D16_top_cited_ties",
    with_sql(WORKS) + "SELECT doc_id, cited_by AS global_citations FROM works QUALIFY rank() OVER (ORDER BY cited_by DESC) <= 25",
)
def _(spark, d):
    return T.top_cited(scalars(spark, d), 25, ties=True).select("doc_id", "global_citations")


@query(
    "D17_top_cited_locally",
    with_sql(WORKS, CITES, "l AS (SELECT cited AS doc_id, count(*) AS local_citations FROM cites GROUP BY cited)")
    + """SELECT doc_id, coalesce(local_citations, 0) AS local_citations, cited_by AS global_citations FROM works LEFT JOIN l USING (doc_id)
    ORDER BY local_citations DESC, global_citations DESC, doc_id LIMIT 25""",
)
def _(spark, d):
    return T.top_cited_locally(works(spark, d, "references"), 25).select("doc_id", "local_citations", "global_citations")


@query(
    "D18_top_cited_per_year",
    with_sql(WORKS) + """SELECT doc_id, round(cited_by / greatest(1, (SELECT max(year) FROM works) - year + 1), 6) AS citations_per_year
    FROM works ORDER BY cited_by / greatest(1, (SELECT max(year) FROM works) - year + 1) DESC, doc_id LIMIT 25""",
)
def _(spark, d):
    return rounded(T.top_cited_per_year(scalars(spark, d), 25).select("doc_id", "citations_per_year"))
