"""Counting, selection and frequency laws."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lists import explode_entities
from ..operators import counts as C
from ..operators import laws as L
from ..operators import selection as S
from .fixtures import WORKS, counts_sql, documents, long_sql, scalars, with_sql, works
from .registry import query, rounded

# A short list keeps the SQL readable; the operator takes any list.
STOP = ["the", "and", "of", "to", "in", "is", "de", "la", "le", "der", "die", "das", "und", "el", "los", "un", "une"]
STOP_SQL = ", ".join(f"'{w}'" for w in STOP)


def ranked_sql(order: str, src: str = "kept", extra: str = "") -> str:
    return f"""SELECT entity, docs, row_number() OVER (ORDER BY {order}) AS rank,
  round(CASE WHEN count(*) OVER () > 1 THEN (count(*) OVER () - row_number() OVER (ORDER BY {order})) / (count(*) OVER () - 1.0)
   ELSE 1.0 END, 6) AS percent_rank{extra} FROM {src}"""


ORDER = "docs DESC, entity"
CUM = f""", round(docs / CAST(sum(docs) OVER () AS DOUBLE), 6) AS share,
  CAST(sum(docs) OVER (ORDER BY {ORDER}) AS BIGINT) AS cumulative,
  round(sum(docs) OVER (ORDER BY {ORDER}) / CAST(sum(docs) OVER () AS DOUBLE) * 100, 6) AS cumulative_pct"""


@query("C1_count_single", with_sql(WORKS) + "SELECT source AS entity, count(*) AS docs FROM works GROUP BY source")
def _(spark, d):
    return C.count_single(scalars(spark, d), "source")


@query("C2_count_list", with_sql(WORKS, long_sql("author_keywords"), counts_sql()) + "SELECT * FROM counts")
def _(spark, d):
    return C.count_list(works(spark, d, "author_keywords"), "author_keywords")


@query(
    "C2_count_list_repeats",
    """SELECT p_brand AS entity, count(*) AS docs, count(DISTINCT l_orderkey) AS distinct_docs
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
)
def _(spark, d):
    """Repeats inside a document: occurrences against distinct documents."""
    from .fixtures import lines

    w = lines(spark, d, ["index_keywords"]).groupBy("doc_id").agg(F.collect_list("index_keywords").alias("k"))
    a, b = C.count_list(w, "k"), C.count_list(w, "k", distinct_docs=True)
    return a.join(b.withColumnRenamed("docs", "distinct_docs"), "entity")


@query(
    "C3_count_ngrams",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
       lambda x: x NOT IN ({STOP_SQL})) AS t FROM documents),
    g AS (SELECT unnest(t) AS entity FROM t
      UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t)
    SELECT entity, count(*) AS docs FROM g GROUP BY entity ORDER BY docs DESC, entity LIMIT 10000""",
)
def _(spark, d):
    return C.count_ngrams(documents(spark, d), "text", 1, 2, stop_words=STOP, max_features=10_000)


@query(
    "C4_auto_count_type",
    with_sql(WORKS, long_sql("authors")) + """, k AS (SELECT doc_id, string_agg(entity, '; ' ORDER BY entity) AS v FROM long GROUP BY doc_id)
    SELECT 'authors' AS field, bool_or(contains(v, '; ')) AS has_separator,
      CASE WHEN bool_or(contains(v, '; ')) THEN 'list' ELSE 'other' END AS count_type FROM k
    UNION ALL SELECT 'doc_type', false, 'single'
    UNION ALL SELECT 'text', false, 'text'""",
)
def _(spark, d):
    w = works(spark, d, "authors").withColumn("authors", F.array_join("authors", "; "))
    rows = [("authors", w), ("doc_type", w), ("text", documents(spark, d).withColumn("text", F.translate("text", "|;", "  ")))]
    out = None
    for name, df in rows:
        one = C.count_type_profile(df, name).select(F.lit(name).alias("field"), "has_separator", "count_type")
        out = one if out is None else out.unionByName(one)
    return out


@query("C5_rank_top", with_sql(WORKS, long_sql("authors"), counts_sql(), f"kept AS (SELECT * FROM counts ORDER BY {ORDER} LIMIT 20)") + ranked_sql(ORDER))
def _(spark, d):
    return rounded(C.rank_counts(C.count_list(works(spark, d, "authors"), "authors"), top_n=20))


@query("C5_rank_all", with_sql(WORKS, "kept AS (SELECT source AS entity, count(*) AS docs FROM works GROUP BY source HAVING count(*) >= 2)") + ranked_sql(ORDER))
def _(spark, d):
    return rounded(C.rank_counts(C.count_single(scalars(spark, d), "source"), min_count=2))


@query("C6_normalised_cumulative", with_sql(WORKS, "kept AS (SELECT source AS entity, count(*) AS docs FROM works GROUP BY source)") + ranked_sql(ORDER, extra=CUM))
def _(spark, d):
    return rounded(C.rank_counts(C.count_single(scalars(spark, d), "source"), normalise=True, cumulative=True))


@query("C6_normalised_top", with_sql(WORKS, long_sql("author_keywords"), counts_sql(), f"kept AS (SELECT * FROM counts ORDER BY {ORDER} LIMIT 10)") + ranked_sql(ORDER, extra=CUM))
def _(spark, d):
    return rounded(C.count_entity(works(spark, d, "author_keywords"), "author_keywords", "list", top_n=10, normalise=True, cumulative=True))


SOURCES = "counts AS (SELECT source AS entity, count(*) AS docs FROM works GROUP BY source)"


@query(
    "C7_lotka",
    with_sql(WORKS, SOURCES, "p AS (SELECT docs AS x, count(*) AS observed FROM counts GROUP BY docs)",
      "f AS (SELECT -regr_slope(ln(observed), ln(x)) AS exponent, exp(regr_intercept(ln(observed), ln(x))) AS constant, "
      "regr_r2(ln(observed), ln(x)) AS r_squared, sum(observed) AS te, sum(x * observed) AS tc FROM p)")
    + """SELECT x, observed, round(observed / te, 6) AS observed_share,
      round(constant / pow(x, exponent) / sum(constant / pow(x, exponent)) OVER (), 6) AS theoretical_share,
      round(exponent, 6) AS exponent, round(constant, 6) AS constant, round(r_squared, 6) AS r_squared,
      CASE WHEN exponent BETWEEN 1.5 AND 2.5 THEN 'classic' ELSE 'deviation' END AS label,
      CAST(te AS BIGINT) AS total_entities, CAST(tc AS BIGINT) AS total_contributions FROM p, f""",
)
def _(spark, d):
    return rounded(L.lotka(L.law_counts(scalars(spark, d), "source", "lotka")))


@query(
    "C8_bradford",
    with_sql(WORKS, SOURCES, f"r AS (SELECT docs, sum(docs) OVER (ORDER BY {ORDER}) AS c, sum(docs) OVER () AS t FROM counts)",
      "z AS (SELECT docs, CASE WHEN 3 * (c - docs) < t THEN 1 WHEN 3 * (c - docs) < 2 * t THEN 2 ELSE 3 END AS zone FROM r)",
      "g AS (SELECT zone, count(*) AS sources, CAST(sum(docs) AS BIGINT) AS articles FROM z GROUP BY zone)",
      "m AS (SELECT max(CASE WHEN zone = 1 THEN sources END) AS a, max(CASE WHEN zone = 2 THEN sources END) AS b, max(CASE WHEN zone = 3 THEN sources END) AS c FROM g)")
    + "SELECT CAST(zone AS INTEGER) AS zone, sources, articles, round((b / a + c / b) / 2, 6) AS multiplier FROM g, m",
)
def _(spark, d):
    return rounded(L.bradford(L.law_counts(scalars(spark, d), "source", "bradford")))


@query(
    "C8_bradford_sources",
    with_sql(WORKS, SOURCES)
    + f"""SELECT entity, docs, row_number() OVER (ORDER BY {ORDER}) AS rank, CAST(sum(docs) OVER (ORDER BY {ORDER}) AS BIGINT) AS cumulative,
    CAST(CASE WHEN 3 * (sum(docs) OVER (ORDER BY {ORDER}) - docs) < sum(docs) OVER () THEN 1
     WHEN 3 * (sum(docs) OVER (ORDER BY {ORDER}) - docs) < 2 * sum(docs) OVER () THEN 2 ELSE 3 END AS INTEGER) AS zone FROM counts""",
)
def _(spark, d):
    return L.bradford_sources(C.count_single(scalars(spark, d), "source"))


@query(
    "C9_zipf",
    """WITH words AS (SELECT unnest(regexp_extract_all(regexp_replace(lower(text), '[\\p{L}\\p{N}_]*[^a-z\\P{L}][\\p{L}\\p{N}_]*|[\\p{L}\\p{N}_]*[\\p{N}_][\\p{L}\\p{N}_]*', ' ', 'g'), '[a-z]{3,}')) AS w FROM documents),
    c AS (SELECT w, count(*) AS docs FROM words GROUP BY w),
    r AS (SELECT docs, row_number() OVER (ORDER BY docs DESC, w) AS rank FROM c)
    SELECT round(-regr_slope(ln(docs), ln(rank)), 6) AS exponent, round(exp(regr_intercept(ln(docs), ln(rank))), 4) AS constant,
      round(regr_r2(ln(docs), ln(rank)), 6) AS r_squared, count(*) AS words, CAST(sum(docs) AS BIGINT) AS occurrences FROM r""",
)
def _(spark, d):
    return rounded(L.zipf(L.word_counts(documents(spark, d), "text"))).withColumn("constant", F.round("constant", 4))


def share_sql(n: str, goal: str) -> str:
    return f"""r AS (SELECT docs, row_number() OVER (ORDER BY {ORDER}) AS i, sum(docs) OVER (ORDER BY {ORDER}) AS c,
      count(*) OVER () AS n, sum(docs) OVER () AS t FROM counts),
    s AS (SELECT max(n) AS n_total, CAST(max({n}) AS BIGINT) AS k, CAST(sum(CASE WHEN i <= {n} THEN docs END) AS BIGINT) AS o,
      CAST(max(t) AS BIGINT) AS total_output, min(CASE WHEN c >= {goal} * t THEN i END) AS need FROM r)"""


@query(
    "C10_price",
    with_sql(WORKS, SOURCES, share_sql("ceil(sqrt(n))", "CAST(0.5 AS DOUBLE)"))
    + """SELECT n_total, k AS n_elite, o AS elite_output, total_output, need AS n_for_50,
     round(o / total_output, 6) AS elite_share, o / total_output >= 0.5 AS holds FROM s""",
)
def _(spark, d):
    return rounded(L.price(C.count_single(scalars(spark, d), "source")))


@query(
    "C11_pareto",
    with_sql(WORKS, SOURCES, share_sql("greatest(1, ceil(n * CAST(0.2 AS DOUBLE)))", "CAST(0.8 AS DOUBLE)"))
    + """SELECT n_total, k AS n_top, o AS top_output, total_output, need AS n_for_80,
     round(o / total_output, 6) AS top_share, round(need / n_total * 100, 6) AS pct_for_80, o / total_output >= 0.8 AS holds FROM s""",
)
def _(spark, d):
    return rounded(L.pareto(C.count_single(scalars(spark, d), "source")))


# --- selection ------------------------------------------------------------------------------


@query(
    "B1_include_exclude",
    with_sql(WORKS, long_sql("author_keywords"), counts_sql()) + """SELECT * FROM counts
    WHERE lower(entity) IN ('red widget', 'small ring', 'blue ring', 'small gear') AND entity NOT IN (SELECT p_name FROM part WHERE p_partkey < 1)""",
)
def _(spark, d):
    from .fixtures import table

    c = C.count_list(works(spark, d, "author_keywords"), "author_keywords")
    c = S.include_items(c, ["Red Widget", "Small Ring", "Blue Ring", "Small Gear"], fold=True)
    return S.exclude_items(c, table(spark, d, "part").filter("p_partkey < 1").select("p_name"))


@query(
    "B2_pattern_filter",
    with_sql(WORKS, long_sql("author_keywords"), counts_sql()) + "SELECT * FROM counts WHERE regexp_matches(entity, '(?i)^(RED|small) ') AND NOT regexp_matches(entity, '(?i)ring$')",
)
def _(spark, d):
    c = C.count_list(works(spark, d, "author_keywords"), "author_keywords")
    return S.filter_by_pattern(c, include="^(RED|small) ", exclude="ring$")


@query(
    "B2_any_pattern",
    with_sql(WORKS, long_sql("author_keywords"), counts_sql()) + "SELECT * FROM counts WHERE regexp_matches(entity, '(?i)^red|wid') OR contains(lower(entity), '(gear')",
)
def _(spark, d):
    """Patterns in a list; the second is not a valid expression and is taken literally."""
    c = C.count_list(works(spark, d, "author_keywords"), "author_keywords")
    return c.filter(S.any_pattern("entity", "^red|wid; (gear"))


@query(
    "B3_frequent_items",
    with_sql(WORKS, "counts AS (SELECT source AS entity, count(*) AS docs FROM works GROUP BY source)")
    + f"SELECT * FROM counts WHERE docs >= 3 AND NOT regexp_matches(entity, '7$') ORDER BY {ORDER} LIMIT 15",
)
def _(spark, d):
    return S.frequent_items(C.count_single(scalars(spark, d), "source"), 3, top_n=100, max_items=15, exclude_pattern="7$")


@query(
    "B4_geographic_filter",
    with_sql(WORKS, long_sql("countries")) + """SELECT doc_id, year FROM works WHERE doc_id IN (SELECT doc_id FROM long WHERE entity IN
    (SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)
     UNION SELECT n_name FROM nation WHERE n_nationkey = 7))""",
)
def _(spark, d):
    from .fixtures import table

    n, r = table(spark, d, "nation"), table(spark, d, "region")
    regions = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("region"), F.col("n_name").alias("country"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("code")
    )
    first = r.agg(F.min("r_name")).first()[0]
    return S.in_places(works(spark, d, "countries"), f"{first}, n7", regions).select("doc_id", "year")


@query(
    "B5_documents_for_entities",
    with_sql(WORKS, long_sql("author_keywords")) + "SELECT doc_id, year FROM works WHERE doc_id IN (SELECT doc_id FROM long WHERE entity IN ('red widget', 'small ring'))",
)
def _(spark, d):
    return S.documents_with(works(spark, d, "author_keywords"), "author_keywords", ["RED widget", "small ring "], fold=True).select("doc_id", "year")


@query("B5_documents_for_terms", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'license') OR contains(lower(text), 'teacher')")
def _(spark, d):
    return S.documents_with(documents(spark, d), "text", ["License", "teacher"], kind="text").select("doc_id", "lang")


@query(
    "B5_documents_for_cells",
    with_sql(WORKS, long_sql("authors", "a"), long_sql("author_keywords", "k"),
      "cells AS (SELECT a.entity AS r, k.entity AS c FROM a JOIN k USING (doc_id) GROUP BY ALL ORDER BY count(*) DESC, r, c LIMIT 5)")
    + "SELECT doc_id, year FROM works WHERE doc_id IN (SELECT a.doc_id FROM a JOIN k USING (doc_id) JOIN cells ON a.entity = r AND k.entity = c)",
)
def _(spark, d):
    from ..operators.contingency import cooccurrence

    w = works(spark, d, "authors", "author_keywords")
    cells = cooccurrence(w, "authors", "author_keywords", top_rows=None, top_cols=None)
    best = cells.orderBy(F.desc("n"), "row", "col").limit(5)
    return S.documents_with_cells(w, "authors", "author_keywords", best).select("doc_id", "year")


@query(
    "B6_annotated_selection",
    with_sql(WORKS) + "SELECT doc_id, CASE WHEN cited_by >= 30 THEN 'Yes' ELSE 'No' END AS selected FROM works",
)
def _(spark, d):
    w = scalars(spark, d)
    return S.annotate_selected(w, w.filter("cited_by >= 30")).select("doc_id", "selected")


RANGES = [(0, 5), (5, 20), (10, 40)]


@query(
    "B7_documents_in_ranges",
    with_sql(WORKS, "r AS (SELECT * FROM (VALUES (0, 5), (5, 20), (10, 40)) v(a, b))")
    + """SELECT a || '-' || b AS bin, count(*) AS papers, CAST(sum(cited_by) AS BIGINT) AS total_citations, round(avg(cited_by), 2) AS mean_citations,
    CAST(floor(quantile_cont(cited_by, 0.5)) AS BIGINT) AS median_citations, max(cited_by) AS max_citations
    FROM works JOIN r ON cited_by >= a AND cited_by < b GROUP BY a, b""",
)
def _(spark, d):
    return S.range_report(scalars(spark, d), RANGES)


@query("B7_range_filter", with_sql(WORKS) + "SELECT doc_id, cited_by FROM works WHERE cited_by < 3 OR (cited_by >= 40 AND cited_by < 45)")
def _(spark, d):
    return S.in_ranges(scalars(spark, d), "cited_by", [(0, 3), (40, 45)]).select("doc_id", "cited_by")


@query("B10_year_range", with_sql(WORKS) + "SELECT doc_id, year FROM works WHERE year BETWEEN 1996 AND 1999")
def _(spark, d):
    return S.year_between(scalars(spark, d), 1996, 1999).select("doc_id", "year")


@query("B11_top_cited_subset", with_sql(WORKS) + "SELECT doc_id, cited_by FROM works WHERE cited_by >= 20 ORDER BY cited_by DESC, doc_id LIMIT 500")
def _(spark, d):
    return S.top_cited_subset(scalars(spark, d), 20, 500).select("doc_id", "cited_by")


@query(
    "B13_picked_results",
    with_sql(WORKS, long_sql("authors"), counts_sql()) + "SELECT entity, docs FROM counts WHERE entity IN (SELECT s_name FROM supplier WHERE s_suppkey IN (3, 5))",
)
def _(spark, d):
    c = C.count_list(works(spark, d, "authors"), "authors")
    return S.pick(c, "entity", ["Supplier#000000003", "Supplier#000000005"], ["entity", "docs"])


# --- list handling ----------------------------------------------------------------------------


@query("A5_explode_entities", with_sql(WORKS, long_sql("author_keywords")) + "SELECT doc_id, entity FROM long")
def _(spark, d):
    from .fixtures import delimited

    w = delimited(spark, d, "|", "author_keywords")
    return explode_entities(w, "author_keywords")


@query(
    "A5_explode_mixed_separators",
    """SELECT doc_id, trim(x) AS entity FROM (SELECT doc_id, unnest(CASE WHEN contains(t, ';') THEN string_split(t, ';')
      WHEN contains(t, '|') THEN string_split(t, '|') WHEN contains(t, ',') THEN string_split(t, ',') ELSE [t] END) AS x
      FROM (SELECT doc_id, regexp_replace(text, '\\s', ' ', 'g') AS t FROM documents)) WHERE trim(x) <> '' AND lower(trim(x)) <> 'nan'""",
)
def _(spark, d):
    w = documents(spark, d).select("doc_id", F.regexp_replace("text", r"\s", " ").alias("t"))
    return explode_entities(w, "t", comma=True)
