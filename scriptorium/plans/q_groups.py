"""Concept tagging and terms, groups, contingency and factorial analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts as K
from ..operators import contingency as H
from ..operators import factorial as X
from ..operators import groups as G
from .fixtures import WORKS, counts_sql, documents, long_sql, scalars, table, with_sql, works
from .registry import query, rounded

# --- concepts --------------------------------------------------------------------------------------

CONCEPTS = {"legal": ["licen*", "copyright"], "teaching": ["teacher", "the*"], "linking": ["that", "with", "from"]}
PLAIN = {"legal": ["license", "copyright"], "teaching": ["teacher", "than"], "linking": ["that", "with", "from"]}
W = "[\\p{L}\\p{N}_]"


def word_sql(alternatives: str) -> str:
    return f"regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({alternatives})($|[^\\p{{L}}\\p{{N}}_])')"


FLAGS = {"legal": word_sql(f"licen{W}*|copyright"), "teaching": word_sql(f"teacher|the{W}*"), "linking": word_sql("that|with|from")}
PLAIN_FLAGS = {"legal": word_sql("license|copyright"), "teaching": word_sql("teacher|than"), "linking": word_sql("that|with|from")}


def flags_sql(flags: dict, name: str = "f") -> str:
    return f"{name} AS (SELECT doc_id, lang, text, " + ", ".join(f"CAST({v} AS INTEGER) AS {k}" for k, v in flags.items()) + " FROM documents)"


@query("F1_tag_concepts", "WITH " + flags_sql(FLAGS) + " SELECT doc_id, legal, teaching, linking, legal + teaching + linking AS concept_count, CAST(legal + teaching + linking > 0 AS INTEGER) AS has_concept FROM f")
def _(spark, d):
    return K.tag_concepts(documents(spark, d), "text", CONCEPTS).drop("text", "lang", "source", "n_chars")


@query(
    "F1_tag_expressions",
    "SELECT doc_id, CAST(regexp_matches(lower(text), 'licen[sc]e|(19|20)\\d\\d') AS INTEGER) AS dated, CAST(contains(lower(text), '(c') AS INTEGER) AS mark FROM documents",
)
def _(spark, d):
    """Raw expressions; one that does not compile is searched literally."""
    got = K.tag_concepts(documents(spark, d), "text", {"dated": ["licen[sc]e", r"(19|20)\d\d"], "mark": ["(c"]}, regex=True)
    return got.select("doc_id", "dated", "mark")


@query(
    "F1_tag_large_dictionary",
    "WITH " + flags_sql(PLAIN_FLAGS) + " SELECT doc_id, c AS concept FROM (UNPIVOT f ON legal, teaching, linking INTO NAME c VALUE v) WHERE v = 1",
)
def _(spark, d):
    rows = [(c, k) for c, ks in PLAIN.items() for k in ks]
    return K.tag_many_concepts(documents(spark, d), "text", spark.createDataFrame(rows, "concept string, keyword string"))


@query(
    "F2_concept_summary",
    "WITH " + flags_sql(PLAIN_FLAGS) + ", ".join(["", "s AS (SELECT c AS concept, CAST(sum(v) AS BIGINT) AS docs, sum(v) / count(*) * 100 AS p FROM (UNPIVOT f ON legal, teaching, linking INTO NAME c VALUE v) GROUP BY c)"])
    + " SELECT concept, CAST(CASE concept WHEN 'linking' THEN 3 ELSE 2 END AS INTEGER) AS keywords, docs, round(p, 6) AS percentage FROM s",
)
def _(spark, d):
    tagged = K.tag_concepts(documents(spark, d), "text", PLAIN, wildcard=False)
    return rounded(K.concept_summary(tagged, PLAIN))


DOMAIN = {"public_policy": ["that", "policy"], "service_delivery": ["service", "for"], "local_government": ["local", "government", "und"]}


@query(
    "F3_domain_concepts",
    "WITH " + flags_sql({"a": word_sql("that|policy"), "b": word_sql("service|for"), "c": word_sql("local|government|und")})
    + " SELECT doc_id, a AS \"Public Policy\", b AS \"Service Delivery\", c AS \"Local Government\", a + b + c AS concept_count, CAST(a + b + c > 0 AS INTEGER) AS has_concept FROM f",
)
def _(spark, d):
    """A loaded domain dictionary with its names in title case."""
    return K.tag_concepts(documents(spark, d), "text", K.title_case(DOMAIN)).drop("text", "lang", "source", "n_chars")


# Words that occur in the texts stand in for the goal keywords.
GOALS = {g: [w] for g, w in enumerate(
    ["the", "that", "license", "teacher", "with", "les", "der", "los", "and", "for", "from", "than", "une", "das", "por", "que", "und"], start=1
)}
GOAL_FLAGS = ", ".join(f"CAST({word_sql(w[0])} AS INTEGER) AS SDG{g}" for g, w in GOALS.items())


def any_of(members) -> str:
    return "greatest(" + ", ".join(f"SDG{m}" for m in members) + ")" if len(members) > 1 else f"SDG{members[0]}"


GROUPED = ", ".join(
    [f"{any_of(m)} AS P_{n}" for n, m in K.PERSPECTIVES.items()] + [f"{any_of(m)} AS D_{n}" for n, m in K.DIMENSIONS.items()]
)
TOTAL = " + ".join(f"SDG{g}" for g in GOALS)


@query(
    "F4_goals",
    f"WITH f AS (SELECT doc_id, {GOAL_FLAGS} FROM documents) SELECT *, {GROUPED}, {TOTAL} AS SDG_Count, CAST({TOTAL} > 0 AS INTEGER) AS Has_SDG FROM f",
)
def _(spark, d):
    return K.tag_goals(documents(spark, d), "text", GOALS).drop("text", "lang", "source", "n_chars")


@query(
    "F5_goal_keyword_counts",
    f"WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '{W}+') AS w FROM documents) SELECT doc_id, "
    + ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{w[0]}')) AS INTEGER) AS SDG{g}" for g, w in GOALS.items()) + " FROM w",
)
def _(spark, d):
    return K.count_goal_keywords(documents(spark, d), "text", GOALS).drop("text", "lang", "source", "n_chars")


@query(
    "F6_goal_summary",
    f"WITH f AS (SELECT {GOAL_FLAGS} FROM documents) SELECT goal, CAST(sum(v) AS BIGINT) AS docs, round(sum(v) / count(*) * 100, 6) AS percentage FROM (UNPIVOT f ON COLUMNS(*) INTO NAME goal VALUE v) GROUP BY goal",
)
def _(spark, d):
    return rounded(K.goal_summary(K.tag_goals(documents(spark, d), "text", GOALS)))


@query("F7_text_concatenation", "SELECT doc_id, concat_ws(' ', source, lang, text) AS joined FROM documents")
def _(spark, d):
    t = documents(spark, d)
    return t.select("doc_id", K.text_of(t, "source", "lang", "text").alias("joined"))


STOP = ["the", "and", "for", "that", "with"]


@query(
    "F8_term_ngrams",
    f"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{W}+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN ('the', 'and', 'for', 'that', 'with')) AS t FROM documents),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS entity FROM t)
    SELECT entity, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY entity""",
)
def _(spark, d):
    g = K.term_ngrams(documents(spark, d), "text", STOP, 2, 2)
    return g.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"))


TERMS = f"""t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: length(x) > 2) AS t FROM documents),
u AS (SELECT doc_id, unnest(t) AS term FROM t),
k AS (SELECT term, count(DISTINCT doc_id) AS df FROM u GROUP BY term HAVING count(DISTINCT doc_id) >= 5 ORDER BY df DESC, term LIMIT 40),
c AS (SELECT doc_id, term, count(*) AS n FROM u WHERE term IN (SELECT term FROM k) GROUP BY ALL)"""


def _cells(spark, d, method, n=40):
    lists = K.term_lists(documents(spark, d).withColumn("text", F.regexp_replace("text", r"[ \u000b]", " ")), "text", "text")
    return lists, K.document_terms(lists, n, 5, method)


@query("F9_document_terms", f"WITH {TERMS} SELECT doc_id, term, CAST(n AS DOUBLE) AS value FROM c")
def _(spark, d):
    return _cells(spark, d, "count")[1]


@query(
    "F9_document_terms_tfidf",
    f"WITH {TERMS} SELECT doc_id, term, round(n / sum(n) OVER (PARTITION BY doc_id) * (ln((SELECT count(*) FROM t WHERE len(t) > 0) / (df + 1)) + 1), 6) AS value FROM c JOIN k USING (term)",
)
def _(spark, d):
    return rounded(_cells(spark, d, "tfidf")[1])


@query(
    "F10_column_profile",
    with_sql(WORKS, long_sql("authors"), "a AS (SELECT doc_id, string_agg(entity, '; ') AS authors FROM long GROUP BY doc_id)")
    + """SELECT 'authors' AS "column", (SELECT count(*) FILTER (contains(authors, ';')) FROM a) / (SELECT count(*) FROM works) > 0.05 AS multi_item, false AS year, (SELECT sum(length(authors)) FROM a) / (SELECT count(*) FROM works) > 50 AS text
    UNION ALL SELECT 'year', false, avg(CAST(year BETWEEN 1900 AND 2100 AS INTEGER)) > 0.8, false FROM works
    UNION ALL SELECT 'source', avg(CAST(contains(source, ';') AS INTEGER)) > 0.05, false, avg(length(source)) > 50 FROM works""",
)
def _(spark, d):
    w = works(spark, d, "authors").withColumn("authors", F.array_join("authors", "; "))
    return K.column_profile(w, ["authors", "year", "source"])


@query("F11_matching_documents", "WITH " + flags_sql(PLAIN_FLAGS) + " SELECT doc_id, lang FROM f WHERE legal + teaching + linking > 0")
def _(spark, d):
    return K.matching_documents(K.tag_concepts(documents(spark, d), "text", PLAIN, wildcard=False)).select("doc_id", "lang")


# --- groups ---------------------------------------------------------------------------------------------

BY_TYPE = "g AS (SELECT doc_id, doc_type AS grp FROM works)"
# overlapping groups: regions of the suppliers of the lines
BY_REGION = """g AS (SELECT DISTINCT l_orderkey AS doc_id, r_name AS grp FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
 JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_orderkey IN (SELECT doc_id FROM works))"""


def regions(spark, d, *fields):
    """Works with the (overlapping) regions of their suppliers as groups."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    li = li.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("r_name").alias("groups"))
    w = works(spark, d, *fields).join(per, "doc_id", "left")
    return w.withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))


def typed(spark, d, *fields):
    return G.groups_by_column(works(spark, d, *fields), "doc_type")


def members(df):
    return df.select("doc_id", F.explode("groups").alias("grp"))


@query("G1_groups_by_column", with_sql(WORKS, BY_TYPE) + "SELECT * FROM g")
def _(spark, d):
    return members(typed(spark, d))


@query(
    "G2_groups_by_cutpoints",
    with_sql(WORKS) + "SELECT doc_id, CASE WHEN year < 1997 THEN '-inf-1996' WHEN year < 2000 THEN '1997-1999' ELSE '2000-inf' END AS grp FROM works",
)
def _(spark, d):
    return members(G.groups_by_cutpoints(scalars(spark, d), [1997, 2000]))


@query(
    "G2_groups_by_periods",
    with_sql(WORKS, "b AS (SELECT min(year) AS a, max(year) + 1 AS b FROM works)", "e AS (SELECT CAST(floor(a + (b - a) / 3) AS INTEGER) AS e1, CAST(floor(a + (b - a) * 2 / 3) AS INTEGER) AS e2, a, b FROM b)")
    + "SELECT doc_id, CASE WHEN year < e1 THEN a || '-' || (e1 - 1) WHEN year < e2 THEN e1 || '-' || (e2 - 1) ELSE e2 || '-' || (b - 1) END AS grp FROM works, e",
)
def _(spark, d):
    return members(G.groups_by_periods(scalars(spark, d), 3))


@query(
    "G3_groups_by_items",
    with_sql(WORKS, long_sql("author_keywords"), counts_sql()) + "SELECT doc_id, entity AS grp FROM long WHERE entity IN (SELECT entity FROM counts ORDER BY docs DESC, entity LIMIT 6)",
)
def _(spark, d):
    return members(G.groups_by_items(works(spark, d, "author_keywords"), "author_keywords", 6))


@query("G4_groups_by_clusters")
def _(spark, d):
    """k-means on the texts; no SQL counterpart, rows only."""
    return G.group_summary(G.groups_by_clusters(documents(spark, d), "text", k=4))


@query("G5_groups_by_concepts", "WITH " + flags_sql(FLAGS) + " SELECT doc_id, c AS grp FROM (UNPIVOT f ON legal, teaching, linking INTO NAME c VALUE v) WHERE v = 1")
def _(spark, d):
    return members(G.groups_by_concepts(documents(spark, d), "text", CONCEPTS))


@query(
    "G6_groups_by_terms",
    """SELECT doc_id, 'legal' AS grp FROM documents WHERE regexp_matches(text, '(?i)licen.*terms|copyright')
    UNION ALL SELECT doc_id, 'en' FROM documents WHERE regexp_matches(text, '(?i)that')""",
)
def _(spark, d):
    return members(G.groups_by_terms(documents(spark, d), "text", {"legal": ["licen*terms", "copyright"], "en": ["THAT"]}))


@query(
    "G7_random_groups",
    with_sql(WORKS, "g AS (SELECT doc_id, 'Random ' || i AS grp FROM works, range(1, 4) AS r(i) WHERE substr(md5(doc_id || '-42-' || i), 1, 1) < '8')", "s AS (SELECT grp, count(*) AS docs FROM g GROUP BY grp)")
    + 'SELECT row_number() OVER (ORDER BY docs DESC, grp) AS rank, grp AS "group", docs, docs / (SELECT count(*) FROM works) * 100 AS percentage FROM s',
)
def _(spark, d):
    """Sizes of hash-seeded random groups."""
    return G.group_summary(G.random_groups(scalars(spark, d), 3))


@query("G8_selected_groups", with_sql(WORKS, BY_TYPE) + "SELECT * FROM g WHERE grp IN ('1-URGENT', '5-LOW') AND grp <> '5-LOW'")
def _(spark, d):
    return members(G.select_groups(typed(spark, d), include=["1-URGENT", "5-LOW"], exclude=["5-LOW"]))


@query(
    "G9_group_summary",
    with_sql(WORKS, BY_REGION, "s AS (SELECT grp, count(*) AS docs FROM g GROUP BY grp)")
    + 'SELECT row_number() OVER (ORDER BY docs DESC, grp) AS rank, grp AS "group", docs, round(docs / (SELECT count(*) FROM works) * 100, 6) AS percentage FROM s',
)
def _(spark, d):
    return rounded(G.group_summary(regions(spark, d)))


@query("G10_group_columns", with_sql(WORKS, BY_REGION) + "SELECT * FROM g WHERE grp IN ('ASIA', 'EUROPE')")
def _(spark, d):
    """Wide 0/1 columns and back."""
    wide = G.encode_groups(regions(spark, d), ["ASIA", "EUROPE"]).drop("groups")
    return members(G.decode_groups(wide))


GC = """p AS (SELECT grp, entity, count(*) AS docs FROM g JOIN long USING (doc_id) GROUP BY ALL),
z AS (SELECT grp, count(*) AS size FROM g GROUP BY grp),
r AS (SELECT p.grp, entity, docs, docs / size AS proportion, row_number() OVER (PARTITION BY p.grp ORDER BY docs DESC, entity) AS rank, count(*) OVER (PARTITION BY p.grp) AS n FROM p JOIN z USING (grp))"""
GC_COLS = 'grp AS "group", entity, docs, round(proportion, 6) AS proportion, round(proportion * 100, 6) AS percentage, rank, round((n - rank + 1) / greatest(n - 1, 1), 6) AS percent_rank'


@query("G11_counts_across_groups", with_sql(WORKS, BY_REGION, long_sql("author_keywords"), GC) + f"SELECT {GC_COLS} FROM r")
def _(spark, d):
    return rounded(G.counts_across_groups(regions(spark, d, "author_keywords"), "author_keywords"))


@query(
    "G11_counts_shared_items",
    with_sql(WORKS, BY_TYPE, "long AS (SELECT doc_id, source AS entity FROM works)", GC) + f"SELECT {GC_COLS} FROM r WHERE entity IN (SELECT entity FROM p GROUP BY entity HAVING count(*) = (SELECT count(*) FROM z))",
)
def _(spark, d):
    return rounded(G.counts_across_groups(typed(spark, d), "source", "single", shared_only=True))


@query(
    "G11_counts_wide",
    with_sql(WORKS, BY_REGION, long_sql("author_keywords"), GC)
    + "SELECT entity, " + ", ".join(f"""coalesce(max(CASE WHEN grp = '{g}' THEN docs END), 0) AS "docs ({g})" """ for g in ("AFRICA", "ASIA", "EUROPE")) + " FROM r WHERE grp IN ('AFRICA', 'ASIA', 'EUROPE') GROUP BY entity",
)
def _(spark, d):
    names = ["AFRICA", "ASIA", "EUROPE"]
    w = G.select_groups(regions(spark, d, "author_keywords"), include=names)
    return G.wide(G.counts_across_groups(w, "author_keywords"), names, ["docs"])


@query(
    "G12_combined_columns",
    with_sql(WORKS, BY_REGION, long_sql("author_keywords"), "s AS (SELECT entity, count(*) AS docs FROM g JOIN long USING (doc_id) GROUP BY entity)")
    + """SELECT entity, docs, round(docs / sum(docs) OVER (), 6) AS proportion, round(docs / sum(docs) OVER () * 100, 6) AS percentage,
    row_number() OVER (ORDER BY docs DESC, entity) AS rank, round((count(*) OVER () - row_number() OVER (ORDER BY docs DESC, entity) + 1) / count(*) OVER () * 100, 6) AS percent_rank FROM s""",
)
def _(spark, d):
    w = regions(spark, d, "author_keywords")
    per = G.grouped_entities(w, "author_keywords").groupBy("group", "entity").agg(F.count(F.lit(1)).alias("docs"))
    return rounded(G.combined_columns(per))


TYPES = {"author_keywords": "list", "index_keywords": "list", "subject_areas": "list", "source": "single", "year": "single"}
STACK = "long AS (" + " UNION ALL ".join(
    [f"SELECT doc_id, '{f}' AS t, entity FROM {f}" for f in ("author_keywords", "index_keywords", "subject_areas")]
    + ["SELECT doc_id, 'source', source FROM works", "SELECT doc_id, 'year', CAST(year AS VARCHAR) FROM works"]
) + ")"
LISTS = [long_sql(f, f) for f in ("author_keywords", "index_keywords", "subject_areas")]


@query(
    "G13_count_all_types",
    with_sql(WORKS, BY_TYPE, *LISTS, STACK,
      "p AS (SELECT t, grp, entity, count(*) AS docs FROM g JOIN long USING (doc_id) GROUP BY ALL)", "z AS (SELECT grp, count(*) AS size FROM g GROUP BY grp)",
      "r AS (SELECT t, p.grp, entity, docs, docs / size AS proportion, row_number() OVER (PARTITION BY t, p.grp ORDER BY docs DESC, entity) AS rank, count(*) OVER (PARTITION BY t, p.grp) AS n FROM p JOIN z USING (grp))")
    + f"SELECT t AS entity_type, {GC_COLS} FROM r",
)
def _(spark, d):
    return rounded(G.count_all_types(typed(spark, d, "author_keywords", "index_keywords", "subject_areas"), TYPES))


@query("G13_count_all_summary", with_sql(WORKS, *LISTS, STACK) + "SELECT t AS entity_type, count(DISTINCT entity) AS unique_items FROM long GROUP BY t")
def _(spark, d):
    return G.count_all_summary(G.count_all_types(typed(spark, d, "author_keywords", "index_keywords", "subject_areas"), TYPES))


@query(
    "G14_union_of_tops",
    with_sql(WORKS, BY_TYPE, "long AS (SELECT doc_id, source AS entity FROM works)", GC) + 'SELECT grp AS "group", entity, docs FROM p WHERE entity IN (SELECT entity FROM r WHERE rank <= 5)',
)
def _(spark, d):
    per = G.grouped_entities(typed(spark, d), "source", "single").groupBy("group", "entity").agg(F.count(F.lit(1)).alias("docs"))
    return G.union_of_tops(per, 5)


GS = """k AS (SELECT entity FROM long GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 20),
z AS (SELECT grp, count(*) AS size FROM g GROUP BY grp),
q AS (SELECT z.grp, size, k.entity, count(long.doc_id) AS docs FROM z CROSS JOIN k LEFT JOIN g ON g.grp = z.grp LEFT JOIN long ON long.doc_id = g.doc_id AND long.entity = k.entity GROUP BY ALL),
s AS (SELECT grp AS "group", entity, docs, round(docs / size, 6) AS fraction, round(docs / size * 100, 6) AS percentage, rank() OVER (PARTITION BY grp ORDER BY docs DESC) AS rank,
 round((rank() OVER (PARTITION BY grp ORDER BY docs) + (count(*) OVER (PARTITION BY grp, docs) - 1) / 2) / count(*) OVER (PARTITION BY grp), 6) AS percent_rank FROM q)"""


@query("G15_group_statistics", with_sql(WORKS, BY_REGION, long_sql("author_keywords"), GS) + "SELECT * FROM s")
def _(spark, d):
    return rounded(G.group_statistics(regions(spark, d, "author_keywords"), "author_keywords", top_n=20))


@query(
    "G15_group_entity_stats",
    with_sql(WORKS, BY_TYPE, long_sql("author_keywords"), "k AS (SELECT entity FROM long GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 10)",
      "j AS (SELECT grp, entity, doc_id, year, cited_by AS c FROM g JOIN long USING (doc_id) JOIN works USING (doc_id) WHERE entity IN (SELECT entity FROM k))",
      "r AS (SELECT *, row_number() OVER (PARTITION BY grp, entity ORDER BY c DESC, doc_id) AS i FROM j)")
    + 'SELECT grp AS "group", entity, count(*) AS docs, CAST(sum(c) AS BIGINT) AS total_citations, coalesce(max(CASE WHEN c >= i THEN i END), 0) AS h_index, round(avg(year), 6) AS mean_year FROM r GROUP BY ALL',
)
def _(spark, d):
    return rounded(G.group_entity_stats(typed(spark, d, "author_keywords"), "author_keywords", top_n=10))


@query(
    "G16_statistics_all_types",
    with_sql(WORKS, BY_TYPE, long_sql("author_keywords"), GS) + "SELECT *, 'author_keywords' AS entity_type FROM s UNION ALL "
    + "SELECT *, 'subject_areas' FROM (" + with_sql(WORKS, BY_TYPE, long_sql("subject_areas"), GS) + "SELECT * FROM s)",
)
def _(spark, d):
    w = typed(spark, d, "author_keywords", "subject_areas")
    return rounded(G.statistics_all_types(w, {"author_keywords": "list", "subject_areas": "list"}, 20))


@query(
    "G16_statistics_summary",
    with_sql(WORKS, BY_REGION, long_sql("author_keywords"), GS) + 'SELECT "group", count(*) FILTER (docs > 0) AS entities, CAST(sum(docs) AS BIGINT) AS total_docs FROM s GROUP BY "group"',
)
def _(spark, d):
    return G.statistics_summary(G.group_statistics(regions(spark, d, "author_keywords"), "author_keywords", top_n=20))


@query(
    "G16_filtered_statistics",
    with_sql(WORKS, BY_REGION, long_sql("author_keywords"), GS) + "SELECT * FROM s WHERE entity IN (SELECT entity FROM s WHERE \"group\" = 'ASIA' ORDER BY docs DESC, entity LIMIT 5)",
)
def _(spark, d):
    stats = G.group_statistics(regions(spark, d, "author_keywords"), "author_keywords", top_n=20)
    return rounded(G.filtered_statistics(stats, "ASIA", 5))


PAT = "m AS (SELECT doc_id, string_agg(grp, ' & ' ORDER BY grp) AS label, CAST(count(*) AS INTEGER) AS n_groups FROM g GROUP BY doc_id)"


@query("G17_exclusive_intersections", with_sql(WORKS, BY_REGION, PAT) + "SELECT label, n_groups, count(*) AS size FROM m GROUP BY label, n_groups")
def _(spark, d):
    return G.exclusive_intersections(regions(spark, d))


@query("B9_intersection_documents", with_sql(WORKS, BY_REGION, PAT) + "SELECT label, doc_id FROM m WHERE label = 'ASIA & EUROPE'")
def _(spark, d):
    return G.intersection_documents(regions(spark, d), ["EUROPE", "ASIA"])


SIM = """z AS (SELECT grp, count(*) AS size FROM g GROUP BY grp),
o AS (SELECT a.grp AS ga, b.grp AS gb, count(*) AS n FROM g a JOIN g b USING (doc_id) GROUP BY ALL),
s AS (SELECT a.grp AS group_a, b.grp AS group_b, a.size AS size_a, b.size AS size_b, coalesce(n, 0) AS n FROM z a CROSS JOIN z b LEFT JOIN o ON ga = a.grp AND gb = b.grp)"""


@query(
    "G18_group_similarity",
    with_sql(WORKS, BY_REGION, SIM) + "SELECT group_a, group_b, size_a, size_b, n AS overlap_docs, round(n / (size_a + size_b - n), 6) AS jaccard, round(2 * n / (size_a + size_b), 6) AS dice, round(n / least(size_a, size_b), 6) AS overlap FROM s",
)
def _(spark, d):
    return rounded(G.similarity(regions(spark, d)))


@query(
    "G19_similarity_network",
    with_sql(WORKS, BY_REGION, SIM) + "SELECT group_a, group_b, round(n / (size_a + size_b - n), 6) AS weight FROM s WHERE group_a < group_b AND n / (size_a + size_b - n) > 0.4",
)
def _(spark, d):
    return rounded(G.similarity_network(regions(spark, d), "jaccard", 0.4))


@query(
    "G20_region_sizes",
    with_sql(WORKS, "g AS (SELECT doc_id, doc_type AS grp FROM works WHERE doc_type IN ('1-URGENT', '2-HIGH', '5-LOW'))", PAT)
    + """SELECT v.label, coalesce(n, 0) AS size FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW'), ('1-URGENT & 2-HIGH'), ('1-URGENT & 5-LOW'), ('2-HIGH & 5-LOW'), ('1-URGENT & 2-HIGH & 5-LOW')) v(label)
    LEFT JOIN (SELECT label, count(*) AS n FROM m GROUP BY label) x ON x.label = v.label""",
)
def _(spark, d):
    return G.region_sizes(typed(spark, d), ["1-URGENT", "2-HIGH", "5-LOW"])


@query(
    "G21_overlap_report",
    with_sql(WORKS, BY_REGION, SIM) + "SELECT group_a, group_b, size_a, size_b, n AS overlap_docs, round(n / (size_a + size_b - n), 3) AS jaccard FROM s WHERE group_a < group_b",
)
def _(spark, d):
    return G.overlap_report(regions(spark, d))


# --- contingency -------------------------------------------------------------------------------------

PAIRS = with_sql(
    WORKS, long_sql("authors", "a"), long_sql("author_keywords", "k"),
    "ta AS (SELECT entity FROM a GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 30)", "tk AS (SELECT entity FROM k GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 20)",
    "c AS (SELECT a.entity AS row, k.entity AS col, count(*) AS n FROM a JOIN k USING (doc_id) WHERE a.entity IN (FROM ta) AND k.entity IN (FROM tk) GROUP BY ALL)",
)
TOT = """, r AS (SELECT row, sum(n) AS rt FROM c GROUP BY row), s AS (SELECT col, sum(n) AS ct FROM c GROUP BY col), t AS (SELECT sum(n) AS t FROM c),
f AS (SELECT r.row, s.col, coalesce(n, 0) AS n, rt, ct, t, CAST(rt AS DOUBLE) * ct / t AS e FROM r CROSS JOIN s CROSS JOIN t LEFT JOIN c ON c.row = r.row AND c.col = s.col)
"""
PAIR_TABLE = PAIRS.rstrip() + TOT


def _pairs(spark, d):
    return H.cooccurrence(works(spark, d, "authors", "author_keywords"), "authors", "author_keywords", top_rows=30, top_cols=20)


@query("H1_cooccurrence", PAIRS + "SELECT row, col, n FROM c")
def _(spark, d):
    return _pairs(spark, d)


GT = with_sql(
    WORKS, BY_REGION, long_sql("author_keywords"),
    "c0 AS (SELECT entity AS row, grp AS col, count(*) AS n FROM g JOIN long USING (doc_id) GROUP BY ALL)",
    "c AS (SELECT * FROM c0 WHERE row IN (SELECT row FROM c0 GROUP BY row HAVING sum(n) >= 5 ORDER BY sum(n) DESC, row LIMIT 25))",
)
GROUP_TABLE = GT.rstrip() + TOT


def _table(spark, d):
    return H.group_table(regions(spark, d, "author_keywords"), "author_keywords", min_freq=5, top_n=25)


@query("H2_group_contingency", GT + "SELECT row, col, n FROM c")
def _(spark, d):
    return _table(spark, d)


@query(
    "H2_group_contingency_wide",
    GT + "SELECT row, " + ", ".join(f"CAST(coalesce(sum(CASE WHEN col = '{g}' THEN n END), 0) AS BIGINT) AS \"{g}\"" for g in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + ", CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY row",
)
def _(spark, d):
    return H.wide_table(_table(spark, d), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@query(
    "H2_group_terms",
    f"""WITH t AS (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM documents),
    w AS (SELECT doc_id, lang, unnest(list_distinct(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])))) AS row FROM t),
    c0 AS (SELECT row, lang AS col, count(*) AS n FROM w GROUP BY ALL), k AS (SELECT row FROM c0 GROUP BY row ORDER BY sum(n) DESC, row LIMIT 40)
    SELECT row, col, n FROM c0 WHERE row IN (FROM k)""",
)
def _(spark, d):
    return H.group_table(G.groups_by_column(documents(spark, d), "lang"), "text", "text", top_n=40)


@query(
    "H3_chi_square_cells",
    PAIR_TABLE + "SELECT row, col, n AS observed, round(e, 2) AS expected, round((n - e) / sqrt(e), 3) + 0 AS std_residual, round(pow(n - e, 2) / e, 4) AS contribution FROM f",
)
def _(spark, d):
    return H.chi_square_cells(_pairs(spark, d))


@query("H3_chi_square_test")
def _(spark, d):
    """Statistic, degrees of freedom and p (the tail probability has no SQL counterpart)."""
    return H.chi_square_test(_pairs(spark, d))


@query("H3_chi_square_statistic", GROUP_TABLE + "SELECT round(sum(pow(n - e, 2) / e), 6) AS chi2, (count(DISTINCT row) - 1) * (count(DISTINCT col) - 1) AS df FROM f")
def _(spark, d):
    return rounded(H.chi_square_test(_table(spark, d)).drop("p"))


@query(
    "H4_chi_square_entities",
    GROUP_TABLE + "SELECT row, col, round(sum(pow(n - e, 2) / e) OVER (PARTITION BY row), 4) AS contribution, n AS observed, round(e, 2) AS expected, round(n - e, 2) + 0 AS residual, round((n - e) / sqrt(e), 3) + 0 AS std_residual FROM f",
)
def _(spark, d):
    return H.chi_square_entities(_table(spark, d))


@query(
    "H5_associations",
    PAIR_TABLE + """SELECT row, col, n, round(n / (rt + ct - n), 4) AS jaccard, round(2 * n / (rt + ct), 4) AS dice, round(log2((n / t) / ((rt / t) * (ct / t))), 4) + 0 AS pmi,
    round(log2((n / t) / ((rt / t) * (ct / t))) / -log2(n / t), 4) + 0 AS npmi FROM f WHERE n > 0""",
)
def _(spark, d):
    return H.associations(_pairs(spark, d))


@query(
    "H6_diversity",
    GROUP_TABLE + """SELECT col AS "group", count(*) AS entities, CAST(sum(n) AS BIGINT) AS docs, round(-sum(n / ct * ln(n / ct)), 4) AS shannon_h, round(ln(count(*)), 4) AS shannon_max,
    round(-sum(n / ct * ln(n / ct)) / ln(count(*)), 4) AS evenness, round(sum(pow(n / ct, 2)), 6) AS simpson_d, round(1 - sum(pow(n / ct, 2)), 6) AS simpson_1_d FROM f WHERE n > 0 GROUP BY col""",
)
def _(spark, d):
    return H.diversity(_table(spark, d))


@query(
    "H7_log_ratio",
    GROUP_TABLE + """, p AS (SELECT row, col, (n + 0.5) / (ct + 0.5 * (SELECT count(DISTINCT row) FROM c)) AS p FROM f)
    SELECT a.row, a.col AS group_a, b.col AS group_b, round(log2(CAST(a.p AS DOUBLE) / b.p), 4) + 0 AS log_ratio FROM p a JOIN p b ON a.row = b.row AND a.col < b.col""",
)
def _(spark, d):
    return H.log_ratio(_table(spark, d))


@query("H8_correspondence")
def _(spark, d):
    """Coordinates of rows and columns; checked against a dense decomposition in the tests."""
    return H.correspondence(_table(spark, d))


@query("H9_singular_values")
def _(spark, d):
    return H.singular_values(_table(spark, d))


@query("H13_row_shares", PAIR_TABLE + "SELECT row, col, n, round(n / rt, 6) AS share FROM f WHERE n > 0")
def _(spark, d):
    return rounded(H.row_shares(_pairs(spark, d)))


@query(
    "H13_strong_residuals",
    PAIR_TABLE + "SELECT row, col, n AS observed, round(e, 2) AS expected, round((n - e) / sqrt(e), 3) + 0 AS std_residual, round(pow(n - e, 2) / e, 4) AS contribution FROM f WHERE abs(round((n - e) / sqrt(e), 3)) >= 1.5",
)
def _(spark, d):
    return H.strong_residuals(_pairs(spark, d), 1.5)


@query("H14_weighted_edges", PAIRS + "SELECT row, col, n AS weight FROM c WHERE n >= 40")
def _(spark, d):
    return H.edges(_pairs(spark, d), 40)


# --- factorial ---------------------------------------------------------------------------------------


def _space(spark, d, method):
    lists, cells = _cells(spark, d, "count", 60)
    from ..functions.scratch import cut

    cells = cut(cells)
    n = lists.count()
    return cells, n, X.term_space(cells, n, method)


@query("H10_term_space_pca")
def _(spark, d):
    return _space(spark, d, "pca")[2][0]


@query("H10_term_space_svd")
def _(spark, d):
    return _space(spark, d, "svd")[2][0]


@query("H10_term_space_ca")
def _(spark, d):
    return _space(spark, d, "ca")[2][0]


@query("H10_term_space_mca")
def _(spark, d):
    return _space(spark, d, "mca")[2][0]


@query("H11_term_clusters_kmeans")
def _(spark, d):
    return X.cluster_terms(_space(spark, d, "ca")[2][0], "kmeans", 4)


@query("H11_term_clusters_hierarchical")
def _(spark, d):
    return X.cluster_terms(_space(spark, d, "ca")[2][0], "hierarchical", 4)


@query("H11_term_clusters_spectral")
def _(spark, d):
    return X.cluster_terms(_space(spark, d, "ca")[2][0], "spectral", 3)


@query("H11_term_clusters_density")
def _(spark, d):
    return X.cluster_terms(_space(spark, d, "ca")[2][0], "density", 4, eps=0.2)


@query("H12_cluster_terms")
def _(spark, d):
    cells, n, (coords, _) = _space(spark, d, "ca")
    return X.cluster_profiles(cells, X.cluster_terms(coords, "kmeans", 4), n)
