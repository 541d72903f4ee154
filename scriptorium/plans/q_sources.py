"""Sources, harmonisation, cleaning and sinks, on data that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as M
from ..functions.lists import explode_entities
from ..functions.numeric import to_number
from ..functions.scratch import scratch_path
from ..sources import cleaning, files, snapshot
from .fixtures import WORKS, delimited, long_sql, scalars, table, with_sql, works
from .registry import query

def export(spark, d):
    """The works as an export with the usual column names."""
    w = delimited(spark, d, "; ", "authors", "author_keywords")
    return w.select(
        F.col("doc_id").alias("EID"), F.col("title").alias("Title"), F.col("year").alias("Year"), F.col("source").alias("Source title"),
        F.col("cited_by").alias("Cited by"), F.col("authors").alias("Authors"), F.col("author_keywords").alias("Author Keywords"),
    )


EXPORT = with_sql(WORKS, long_sql("authors", "la"), long_sql("author_keywords", "lk"),
    "a AS (SELECT doc_id, string_agg(entity, '; ' ORDER BY entity) AS v FROM la GROUP BY doc_id)", "k AS (SELECT doc_id, string_agg(entity, '; ' ORDER BY entity) AS v FROM lk GROUP BY doc_id)")
HARMONISED = EXPORT + """SELECT CAST(doc_id AS VARCHAR) AS doc_id, title, year, source, cited_by, coalesce(replace(a.v, '; ', '|'), '') AS authors, coalesce(replace(k.v, '; ', '|'), '') AS author_keywords
 FROM works LEFT JOIN a USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _flat(df):
    return df.select(
        F.col("doc_id").cast("string").alias("doc_id"), "title", "year", "source", "cited_by",
        F.array_join("authors", "|").alias("authors"), F.array_join("author_keywords", "|").alias("author_keywords"),
    )


@query("A1_read_export_csv", HARMONISED)
def _(spark, d):
    """Written as CSV, read back, harmonised."""
    return _flat(M.harmonize(files.write_and_read(export(spark, d), "csv")))


@query("A13_write_and_read_parquet", HARMONISED)
def _(spark, d):
    return _flat(M.harmonize(files.write_and_read(export(spark, d), "parquet")))


@query("A3_harmonize", HARMONISED)
def _(spark, d):
    return _flat(M.harmonize(export(spark, d)))


def records(spark, d):
    """The works as nested records: authors with a country each, an inverted index of the title."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    per = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.array_sort(F.collect_set(F.struct("s_name", "n_name"))).alias("s"), F.array_sort(F.collect_set("p_name")).alias("k"),
        F.array_sort(F.collect_set("p_brand")).alias("b"), F.array_sort(F.collect_set("p_type")).alias("t"),
    )
    w = scalars(spark, d).join(per, "doc_id", "left")
    shape = spark.createDataFrame([], snapshot.WORK_SCHEMA).schema
    authors = F.transform("s", lambda x: F.struct(
        F.struct(F.concat(F.lit("A"), x["s_name"]).alias("id"), x["s_name"].alias("display_name"), F.lit(None).cast("string").alias("orcid")).alias("author"),
        F.array(F.struct(F.lit(None).cast("string").alias("id"), F.concat(F.lit("Institute "), x["n_name"]).alias("display_name"), F.when(x["n_name"] == "NATION_1", "US").otherwise(x["n_name"]).alias("country_code"))).alias("institutions"),
        F.array().cast("array<string>").alias("countries"),
    ))
    named = lambda c: F.transform(c, lambda x: F.struct(x.alias("display_name")))
    words = F.split("title", " ")
    nested = w.select(
        F.concat(F.lit("W"), "doc_id").alias("id"), F.concat(F.lit("10.1/"), "doc_id").alias("doi"), "title", F.lit(None).cast("string").alias("display_name"),
        F.col("year").alias("publication_year"), F.lit(None).cast("string").alias("publication_date"), F.col("doc_type").alias("type"), F.col("cited_by").alias("cited_by_count"),
        F.lit("en").alias("language"), F.struct(F.col("is_oa").alias("is_oa"), F.when(F.col("is_oa"), "gold").alias("oa_status")).alias("open_access"),
        authors.alias("authorships"), F.struct(F.struct(F.col("source").alias("display_name"), F.lit("1234-5678").alias("issn_l")).alias("source")).alias("primary_location"),
        named("b").alias("concepts"), named("t").alias("topics"), F.transform("k", lambda x: F.struct(x.alias("display_name"), F.lit(None).cast("string").alias("keyword"))).alias("keywords"),
        F.array(F.struct(F.lit("Goal").alias("display_name"))).alias("sustainable_development_goals"), F.lit(None).cast("array<string>").alias("referenced_works"),
        F.map_from_arrays(words, F.transform(words, lambda _, i: F.array(i))).alias("abstract_inverted_index"),
    )
    return nested.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in shape])


@query(
    "A2_flatten_works",
    with_sql(WORKS, long_sql("authors", "la"), long_sql("countries", "lc"), long_sql("author_keywords", "lk"), long_sql("index_keywords", "li"), long_sql("subject_areas", "lt"),
      "b10 AS (SELECT doc_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY entity) AS r FROM li) WHERE r <= 10)",
      "t5 AS (SELECT doc_id, entity FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY entity) AS r FROM lt) WHERE r <= 5)",
      "a AS (SELECT doc_id, string_agg(entity, '|' ORDER BY entity) AS v, count(*) AS n FROM la GROUP BY 1)",
      "c AS (SELECT doc_id, string_agg(e, '|' ORDER BY e) AS v FROM (SELECT doc_id, CASE WHEN entity = 'NATION_1' THEN 'United States' ELSE entity END AS e FROM lc) GROUP BY 1)",
      "k AS (SELECT doc_id, string_agg(DISTINCT entity, '|' ORDER BY entity) AS v FROM (FROM lk UNION FROM b10 UNION FROM t5) GROUP BY 1)", "b AS (SELECT doc_id, string_agg(entity, '|' ORDER BY entity) AS v FROM b10 GROUP BY 1)")
    + """SELECT 'W' || doc_id AS doc_id, title, year, is_oa, cited_by, coalesce(a.v, '') AS authors, CAST(coalesce(n, 0) AS INTEGER) AS authors_count, coalesce(c.v, '') AS countries, coalesce(k.v, '') AS author_keywords, coalesce(b.v, '') AS index_keywords,
    title AS abstract, source FROM works LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN b USING (doc_id)""",
)
def _(spark, d):
    f = snapshot.flatten_works(records(spark, d))
    lists = ("authors", "countries", "author_keywords", "index_keywords")
    return f.withColumns({c: F.array_join(c, "|") for c in lists}).select("doc_id", "title", "year", "is_oa", "cited_by", *lists, "authors_count", "abstract", "source")


@query("A2a_abstract_text", with_sql(WORKS) + "SELECT doc_id, title AS text FROM works")
def _(spark, d):
    """Word to positions and back."""
    w = scalars(spark, d)
    words = F.split("title", " ")
    index = F.map_from_arrays(F.reverse(words), F.transform(F.reverse(words), lambda _, i: F.array(F.size(words) - 1 - i)))
    return w.select("doc_id", snapshot.abstract_text(index).alias("text"))


@query("A2b_country_names", "SELECT n_nationkey AS k, CASE n_nationkey % 3 WHEN 0 THEN 'Germany' WHEN 1 THEN 'Japan' ELSE n_name END AS country FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    code = F.when(F.col("n_nationkey") % 3 == 0, "DE").when(F.col("n_nationkey") % 3 == 1, "JP").otherwise(F.col("n_name"))
    return n.select(F.col("n_nationkey").alias("k"), snapshot.country_name(code).alias("country"))


@query(
    "A2c_select_works",
    with_sql(WORKS, long_sql("authors", "la")) + "SELECT 'W' || doc_id AS id, year AS publication_year FROM works WHERE year BETWEEN 1996 AND 1999 AND doc_type = '1-URGENT' AND is_oa AND contains(lower(source), 'customer#0') AND contains(lower(title), 'order') AND doc_id IN (SELECT doc_id FROM la WHERE contains(lower(entity), 'supplier#00000000'))",
)
def _(spark, d):
    s = snapshot.select_works(
        records(spark, d), 1996, 1999, "1-URGENT", True, author="supplier#00000000", journal="customer#0", keywords="order"
    )
    return s.select("id", "publication_year")


def _marked(spark, d):
    """The records with an ORCID per author and an ISSN per journal, both from the last letters of their names."""
    tail = lambda c: F.right(c, F.lit(4))
    r = records(spark, d)
    r = r.withColumn("authorships", F.transform("authorships", lambda a: a.withField("author.orcid", F.concat(F.lit("0000-0001-0000-"), tail(a["author"]["display_name"])))))
    return r.withColumn("primary_location", F.col("primary_location").withField("source.issn_l", F.concat(F.lit("1234-"), tail(F.col("primary_location.source.display_name")))))


@query("A2c_select_by_orcid", with_sql(WORKS, long_sql("authors")) + "SELECT DISTINCT 'W' || doc_id AS id FROM long WHERE right(entity, 4) = '0003'")
def _(spark, d):
    return snapshot.select_works(_marked(spark, d), author="0000-0001-0000-0003").select("id")


@query("A2c_select_by_issn", with_sql(WORKS) + "SELECT 'W' || doc_id AS id FROM works WHERE right(source, 4) = '0012'")
def _(spark, d):
    return snapshot.select_works(_marked(spark, d), journal="12340012").select("id")


@query("A2c_select_by_dois", with_sql(WORKS) + "SELECT 'W' || doc_id AS id FROM works WHERE doc_id IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 1)")
def _(spark, d):
    """The list of DOIs is a table; repeats do not matter."""
    dois = table(spark, d, "lineitem").filter("l_quantity = 1").select(F.concat(F.lit("10.1/"), "l_orderkey").alias("doi"))
    return snapshot.select_works(records(spark, d), dois=dois).select("id")


@query("A2c_select_by_institution", with_sql(WORKS, long_sql("countries")) + "SELECT DISTINCT 'W' || doc_id AS id FROM long WHERE contains(lower('Institute ' || entity), 'nation_1')")
def _(spark, d):
    return snapshot.select_works(records(spark, d), institution="Nation_1").select("id")


@query(
    "A4_separator_scores",
    with_sql(WORKS, long_sql("authors", "la"), long_sql("countries", "lc"), long_sql("author_keywords", "lk"), """n AS (SELECT avg((a > 1)::INT) > 0.15 AS a, avg((c > 1)::INT) > 0.15 AS c, avg((k > 1)::INT) > 0.15 AS k FROM (SELECT doc_id,
      (SELECT count(*) FROM la WHERE la.doc_id = w.doc_id) AS a, (SELECT count(*) FROM lc WHERE lc.doc_id = w.doc_id) AS c, (SELECT count(*) FROM lk WHERE lk.doc_id = w.doc_id) AS k FROM works w))""")
    + "SELECT a::BIGINT + c::BIGINT AS pipe, k::BIGINT AS semicolon_space, k::BIGINT AS semicolon, CASE WHEN a::INT + c::INT >= k::INT AND (a OR c) THEN '|' ELSE '; ' END AS separator FROM n",
)
def _(spark, d):
    """Two columns with pipes, one with semicolons."""
    w = works(spark, d, "authors", "author_keywords", "countries")
    w = w.select(F.array_join("authors", "|").alias("a"), F.array_join("countries", "|").alias("c"), F.array_join("author_keywords", "; ").alias("k"))
    return M.separator_scores(w, ["a", "c", "k"])


@query("A6_to_numeric", "SELECT c_custkey AS k, coalesce(TRY_CAST(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment ELSE CAST(c_custkey AS VARCHAR) END AS DOUBLE), 0) AS v FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    text = F.when(F.col("c_custkey") % 4 == 0, F.col("c_mktsegment")).otherwise(F.col("c_custkey").cast("string"))
    return c.select(F.col("c_custkey").alias("k"), to_number(text, 0).alias("v"))


@query(
    "A8_countries_from_affiliations",
    with_sql(WORKS, long_sql("authors")) + """, e AS (SELECT doc_id, CASE CAST(right(entity, 1) AS INTEGER) WHEN 0 THEN 'Germany' WHEN 1 THEN 'UK' WHEN 2 THEN 'France' END AS c FROM works LEFT JOIN long USING (doc_id))
    SELECT doc_id, coalesce(string_agg(DISTINCT c, '|' ORDER BY c), '') AS countries FROM e GROUP BY doc_id""",
)
def _(spark, d):
    last = lambda a: F.right(a, F.lit(1))
    place = lambda a: F.when(last(a) == "0", ", Berlin, DE").when(last(a) == "1", ", London, UK.").when(last(a) == "2", ", Lyon, France").otherwise(", Nowhere, Atlantis")
    w = works(spark, d, "authors")
    text = F.array_join(F.transform("authors", lambda a: F.concat(a, place(a))), "; ")
    got = snapshot.countries_from_affiliations(w.withColumn("affiliations", text))
    return got.select("doc_id", F.array_join("countries", "|").alias("countries"))


@query(
    "A9_remove_stopwords",
    with_sql(WORKS, long_sql("author_keywords")) + "SELECT doc_id, entity FROM long WHERE entity NOT IN ('red widget', 'small ring') AND entity NOT IN (SELECT p_name FROM part WHERE p_partkey < 5)",
)
def _(spark, d):
    stop = table(spark, d, "part").filter("p_partkey < 5").select(F.upper("p_name").alias("w"))
    w = cleaning.remove_stopwords(works(spark, d, "author_keywords"), "author_keywords", ["Red Widget", "small ring"], stop)
    return explode_entities(w, "author_keywords")


@query(
    "A10_apply_synonyms",
    with_sql(WORKS, long_sql("author_keywords")) + "SELECT doc_id, CASE WHEN entity IN ('red widget', 'small ring') THEN 'Thing' WHEN entity = 'blue ring' THEN 'ring' ELSE entity END AS entity FROM long",
)
def _(spark, d):
    w = works(spark, d, "author_keywords")
    w = cleaning.apply_synonyms(w, "author_keywords", cleaning.parse_synonyms("Red widget=Thing\nsmall ring=Thing"))
    table_ = spark.createDataFrame([("Blue Ring", "ring")], "variant string, canonical string")
    return explode_entities(cleaning.apply_synonyms(w, "author_keywords", table_), "author_keywords")


@query("A11_read_item_list", "SELECT DISTINCT p_name AS item FROM part")
def _(spark, d):
    """The part names as a text file, one per line with repeats and blanks."""
    path = scratch_path(spark, "items")
    table(spark, d, "part").select(F.concat(F.lit(" "), "p_name")).write.text(path)
    return files.read_item_list(spark, path)


@query("A12_read_concepts", "SELECT DISTINCT p_type AS concept, p_name AS keyword FROM part")
def _(spark, d):
    """Part types with their names as ``name: kw; kw`` lines."""
    path = scratch_path(spark, "concepts")
    rows = table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_name")).alias("k"))
    rows.select(F.concat("p_type", F.lit(": "), F.array_join("k", "; "))).write.text(path)
    return files.read_concepts(spark, path, "txt")


@query("A12_concepts_from_columns", "SELECT DISTINCT 'brand' AS concept, p_brand AS keyword FROM part UNION SELECT 'name', p_name FROM part")
def _(spark, d):
    p = table(spark, d, "part")
    return files.concepts_from_columns(p.select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")))


@query("A12_read_concepts_json", "SELECT DISTINCT p_type AS concept, p_name AS keyword FROM part")
def _(spark, d):
    """A dictionary file: one JSON list of part types with their names."""
    path = scratch_path(spark, "concepts")
    rows = table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.array_sort(F.collect_set("p_name")).alias("keywords"))
    rows.agg(F.to_json(F.collect_list(F.struct("name", "keywords"))).alias("value")).coalesce(1).write.text(path)
    return files.read_concepts(spark, path, "json")


@query("A12_read_concepts_csv", "SELECT DISTINCT 'brand' AS concept, p_brand AS keyword FROM part UNION SELECT 'name', p_name FROM part")
def _(spark, d):
    """One column per concept."""
    path = scratch_path(spark, "concepts")
    table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name")).write.option("header", True).csv(path)
    return files.read_concepts(spark, path, "csv")
