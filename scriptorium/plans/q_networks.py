"""Networks, citation structure and recognition."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from ..operators import citation as C
from ..operators import graph as N
from ..operators import recognition as R
from ..operators import selection as S
from ..operators.distribution import histogram
from .fixtures import CITES, WORKS, YEARLY, citations, documents, long_sql, scalars, table, with_sql, works, yearly_cites
from .registry import query, rounded

NET = with_sql(
    WORKS, long_sql("author_keywords"), "n AS (SELECT entity AS node, count(*) AS occurrences FROM long GROUP BY entity HAVING count(*) >= 2 ORDER BY count(*) DESC, entity LIMIT 40)",
    "e AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM long a JOIN long b ON a.doc_id = b.doc_id AND a.entity < b.entity WHERE a.entity IN (SELECT node FROM n) AND b.entity IN (SELECT node FROM n) GROUP BY ALL)",
    "x AS (FROM e)", "b AS (SELECT src, dst, weight FROM x UNION ALL SELECT dst, src, weight FROM x)",
)


def network(spark, d):
    w = works(spark, d, "author_keywords")
    return N.cooccurrence_network(w, "author_keywords", top_n=40)


def written(spark, d):
    """The network as written tables, for measures that read it many times."""
    nodes, edges = network(spark, d)
    return cut(nodes), cut(edges)


@query("I1_network_edges", NET + "SELECT * FROM e")
def _(spark, d):
    return network(spark, d)[1]


@query("I1_network_nodes", NET + "SELECT * FROM n")
def _(spark, d):
    return network(spark, d)[0]


@query(
    "I1_network_all_keywords",
    with_sql(WORKS, long_sql("author_keywords", "ka"), long_sql("index_keywords", "ki"), "long AS (FROM ka UNION ALL FROM ki)",
      "n AS (SELECT entity FROM long WHERE NOT regexp_matches(entity, '(?i)^brand#1') GROUP BY entity HAVING count(*) >= 2 ORDER BY count(*) DESC, entity LIMIT 30)",
      "e AS (SELECT a.entity AS src, b.entity AS dst, count(*) AS w FROM long a JOIN long b ON a.doc_id = b.doc_id AND a.entity < b.entity WHERE a.entity IN (FROM n) AND b.entity IN (FROM n) GROUP BY ALL HAVING count(*) >= 3)")
    + "SELECT src, dst, round(w / max(w) OVER (), 6) AS weight FROM e",
)
def _(spark, d):
    """Normalised weights, minimum edge weight, a name pattern left out."""
    w = works(spark, d, "author_keywords", "index_keywords")
    return rounded(N.cooccurrence_network(w, "all_keywords", 30, min_edge=3, normalise=True, exclude_pattern="^brand#1")[1])


@query(
    "I1_network_cocitation",
    with_sql(WORKS, CITES, "r AS (SELECT citing AS doc_id, 'Customer, 1999. Order ' || cited || '. Proceedings, 1-2' AS entity FROM cites WHERE citing IN (SELECT doc_id FROM works))",
      "n AS (SELECT entity FROM r GROUP BY entity HAVING count(*) >= 2 ORDER BY count(*) DESC, entity LIMIT 400)")
    + "SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.entity < b.entity WHERE a.entity IN (FROM n) AND b.entity IN (FROM n) GROUP BY ALL",
)
def _(spark, d):
    w = works(spark, d, "references")
    return N.cooccurrence_network(w, "co_citation", 400)[1]


@query(
    "I1_network_ngrams",
    """WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]{3,}') AND x NOT IN ("""
    + ", ".join(f"'{w}'" for w in N.STOP_WORDS) + """)) AS t FROM documents),
    g0 AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS entity FROM t),
    n AS (SELECT entity FROM g0 GROUP BY entity HAVING count(*) >= 2 ORDER BY count(*) DESC, entity LIMIT 60), g AS (SELECT DISTINCT doc_id, entity FROM g0 WHERE entity IN (FROM n))
    SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL""",
)
def _(spark, d):
    w = documents(spark, d).select("doc_id", F.col("text").alias("abstract"))
    return N.cooccurrence_network(w, "abstract_ngrams", 60)[1]


def pairs_sql(long: str, k: int) -> str:
    """Links among the ``k`` commonest of ``long (doc_id, entity)``."""
    return f"""SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM {long} a JOIN {long} b ON a.doc_id = b.doc_id AND a.entity < b.entity
    WHERE a.entity IN (FROM top_n) AND b.entity IN (FROM top_n) GROUP BY ALL""".replace(
        "FROM top_n", f"SELECT entity FROM {long} GROUP BY entity HAVING count(*) >= 2 ORDER BY count(*) DESC, entity LIMIT {k}")


@query("I1_network_coauthorship", with_sql(WORKS, long_sql("authors")) + pairs_sql("long", 30))
def _(spark, d):
    return N.cooccurrence_network(works(spark, d, "authors"), "coauthorship", 30)[1]


@query("I1_network_index_keywords", with_sql(WORKS, long_sql("index_keywords")) + pairs_sql("long", 15))
def _(spark, d):
    return N.cooccurrence_network(works(spark, d, "index_keywords"), "index_keywords", 15)[1]


@query("I1_network_countries", with_sql(WORKS, long_sql("countries")) + pairs_sql("long", 15))
def _(spark, d):
    return N.cooccurrence_network(works(spark, d, "countries"), "country_collab", 15)[1]


@query("I1_network_institutions", with_sql(WORKS, long_sql("countries"), "i AS (SELECT doc_id, 'Institute of ' || entity AS entity FROM long)") + pairs_sql("i", 15))
def _(spark, d):
    w = works(spark, d, "countries").withColumn("affiliations", F.transform("countries", lambda c: F.concat(F.lit("Institute of "), c)))
    return N.cooccurrence_network(w, "institution_collab", 15)[1]


@query(
    "I1_network_source_cocitation",
    with_sql(
        WORKS, CITES, "r AS (SELECT citing AS doc_id, source AS entity FROM cites JOIN works ON cited = doc_id WHERE citing IN (SELECT doc_id FROM works))",
        "n AS (SELECT entity FROM r GROUP BY entity HAVING count(*) >= 2 ORDER BY count(*) DESC, entity LIMIT 100)", "s AS (SELECT DISTINCT doc_id, entity FROM r WHERE entity IN (FROM n))",
    ) + "SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL",
)
def _(spark, d):
    """The third field of a reference names its source."""
    cited = scalars(spark, d).select(F.col("doc_id").alias("cited"), F.concat(F.lit("Doe, T, "), "source", F.lit(", 1999")).alias("ref"))
    refs = citations(spark, d).join(cited, "cited").groupBy(F.col("citing").alias("doc_id")).agg(F.collect_list("ref").alias("references"))
    w = scalars(spark, d).join(refs, "doc_id")
    return N.cooccurrence_network(w, "source_cocitation", 100)[1]


@query("I2_degrees", NET + "SELECT src AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM b GROUP BY src")
def _(spark, d):
    return N.degrees(written(spark, d)[1])


@query(
    "I3_pagerank",
    NET.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM b),
    k AS (SELECT count(*) AS k FROM n), loose AS (SELECT node FROM n WHERE node NOT IN (SELECT src FROM b)),
    r AS (SELECT 0 AS i, node, 1.0::DOUBLE / k AS v FROM n, k
      UNION ALL SELECT r.i + 1, t.node, 0.15 / any_value(k) + 0.85 * any_value(s.spare) / any_value(k) + 0.85 * coalesce(sum(r.v * t.p), 0)
        FROM (SELECT n.node, p.src, coalesce(p.p, 0) AS p FROM n LEFT JOIN p ON p.dst = n.node) t
        CROSS JOIN k JOIN r ON r.node = coalesce(t.src, t.node)
        CROSS JOIN (SELECT coalesce(sum(v), 0) AS spare FROM r WHERE node IN (FROM loose)) s WHERE r.i < 80 GROUP BY r.i, t.node)
    SELECT node, round(v, 6) AS pagerank FROM r WHERE i = 80""",
)
def _(spark, d):
    return rounded(N.pagerank(*written(spark, d)))


@query(
    "I4_eigenvector",
    NET.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, t AS (SELECT n.node, coalesce(b.src, n.node) AS src, coalesce(b.weight, 0) AS w FROM n LEFT JOIN b ON b.dst = n.node),
    r AS (SELECT 0 AS i, node, 1.0::DOUBLE AS v FROM n
      UNION ALL SELECT i, node, v / sqrt(sum(v * v) OVER ()) FROM (SELECT r.i + 1 AS i, t.node, sum(r.v * t.w) + any_value(o.v) AS v FROM t JOIN r ON r.node = t.src JOIN r o ON o.node = t.node WHERE r.i < 150 GROUP BY r.i, t.node))
    SELECT node, round(v, 6) AS eigenvector FROM r WHERE i = 150""",
)
def _(spark, d):
    return rounded(N.eigenvector(*written(spark, d)))


@query(
    "I5_closeness",
    NET.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, r AS (SELECT node AS s, node AS v, 0 AS h FROM n UNION SELECT r.s, b.dst, r.h + 1 FROM r JOIN b ON b.src = r.v WHERE r.h < 8),
    m AS (SELECT s, v, min(h) AS h FROM r GROUP BY ALL), q AS (SELECT s, count(*) - 1 AS k, sum(h) AS t FROM m GROUP BY s)
    SELECT s AS node, round(CASE WHEN t > 0 THEN k / t * (k / ((SELECT count(*) FROM n) - 1)) ELSE 0 END, 6) AS closeness FROM q""",
)
def _(spark, d):
    return rounded(N.path_centralities(*written(spark, d)).select("node", "closeness"))


@query(
    "I5_betweenness",
    # distances by doubling (up to 64 links), shortest paths counted along the links that lie on them
    NET.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", d1 AS (SELECT src, dst, weight::DOUBLE AS d FROM b UNION ALL SELECT node, node, 0 FROM n)"
    + "".join(f", d{2 * i} AS (SELECT x.src, y.dst, min(x.d + y.d) AS d FROM d{i} x JOIN d{i} y ON x.dst = y.src GROUP BY ALL)" for i in (1, 2, 4, 8, 16, 32))
    + """, steps AS (SELECT a.src AS s, b.src AS v, b.dst AS u FROM d64 a JOIN b ON b.src = a.dst JOIN d64 z ON z.src = a.src AND z.dst = b.dst WHERE a.d + b.weight = z.d),
    p AS (SELECT node AS s, node AS v, 0 AS i, 1::DOUBLE AS k FROM n UNION ALL SELECT p.s, t.u, p.i + 1, sum(p.k) FROM p JOIN steps t ON t.s = p.s AND t.v = p.v GROUP BY p.s, t.u, p.i),
    g AS (SELECT s, v, sum(k) AS k, any_value(d) AS d FROM p JOIN d64 ON src = s AND dst = v GROUP BY s, v),
    m AS (SELECT a.v AS node, sum(a.k * z.k / t.k) AS x FROM g a JOIN g z ON z.s = a.v JOIN g t ON t.s = a.s AND t.v = z.v WHERE a.d + z.d = t.d AND a.v <> a.s AND a.v <> z.v GROUP BY a.v)
    SELECT n.node, round(coalesce(x, 0) / (((SELECT count(*) FROM n) - 1) * ((SELECT count(*) FROM n) - 2)), 6) AS betweenness FROM n LEFT JOIN m USING (node)""",
)
def _(spark, d):
    return rounded(N.path_centralities(*written(spark, d)).select("node", "betweenness"))


@query(
    "I6_clustering",
    NET.rstrip() + """, s AS (SELECT src, dst, weight / max(weight) OVER () AS w FROM x), bb AS (SELECT src, dst, w FROM s UNION ALL SELECT dst, src, w FROM s),
    t AS (SELECT a.src AS node, sum(cbrt(a.w * c.w * z.w)) AS t FROM bb a JOIN bb c ON a.src = c.src AND a.dst < c.dst JOIN s z ON z.src = a.dst AND z.dst = c.dst GROUP BY a.src),
    g AS (SELECT src AS node, count(*) AS k FROM b GROUP BY src)
    SELECT n.node, round(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END, 6) AS clustering FROM n LEFT JOIN g USING (node) LEFT JOIN t USING (node)""",
)
def _(spark, d):
    return rounded(N.clustering(*written(spark, d)))


@query(
    "I6_components",
    """SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders
    WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)""",
)
def _(spark, d):
    """Every order is linked to the previous order of its customer: one chain per customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = table(spark, d, "orders").select(F.col("o_orderkey").alias("src"), F.lag("o_orderkey").over(w).alias("dst")).filter("dst is not null")
    return N.components(links)


@query("I7_communities")
def _(spark, d):
    return N.communities(*written(spark, d))


@query("I8_node_table")
def _(spark, d):
    return N.node_table(*written(spark, d))


@query(
    "I9_thematic_network",
    """WITH long AS (SELECT l_orderkey AS doc_id, l_linenumber AS i, p_name AS entity FROM lineitem JOIN part ON l_partkey = p_partkey),
    n AS (SELECT entity FROM long GROUP BY entity HAVING count(*) >= 2 ORDER BY count(*) DESC, entity LIMIT 30),
    c AS (SELECT doc_id, entity, count(*) AS k FROM long WHERE entity IN (FROM n) GROUP BY ALL)
    SELECT a.entity AS src, b.entity AS dst, CAST(sum(a.k * b.k) AS BIGINT) AS weight FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY ALL""",
)
def _(spark, d):
    """Pairs with the repeats inside a document."""
    from .fixtures import lines

    w = lines(spark, d, ["author_keywords"]).groupBy("doc_id").agg(F.collect_list("author_keywords").alias("author_keywords"))
    return N.thematic_network(w, "author_keywords", top_n=30)[1]


MAP = """, m AS (SELECT node, occurrences, split_part(node, ' ', 1) AS g FROM n),
p AS (SELECT g, count(*) AS items, CAST(sum(occurrences) AS BIGINT) AS occurrences, string_agg(node, '; ' ORDER BY occurrences DESC, node) AS keywords, list(node ORDER BY occurrences DESC, node) AS l FROM m GROUP BY g),
l AS (SELECT a.g AS ga, z.g AS gb, weight FROM x JOIN m a ON a.node = src JOIN m z ON z.node = dst),
i AS (SELECT ga AS g, sum(weight) AS w FROM l WHERE ga = gb GROUP BY ga), o AS (SELECT g, sum(weight) AS w FROM (SELECT ga AS g, weight FROM l WHERE ga <> gb UNION ALL SELECT gb, weight FROM l WHERE ga <> gb) GROUP BY g),
z AS (SELECT p.g AS community, array_to_string(l[1:3], '; ') AS label, coalesce(o.w, 0) / (SELECT sum(w) FROM o) AS centrality, coalesce(i.w, 0) / greatest(items * (items - 1) / 2, 1) AS density, occurrences, items,
  CAST(coalesce(i.w, 0) AS BIGINT) AS internal, CAST(coalesce(o.w, 0) AS BIGINT) AS external, keywords, array_to_string(l[1:5], '; ') AS top_keywords FROM p LEFT JOIN i USING (g) LEFT JOIN o USING (g)),
q AS (SELECT *, CASE WHEN centrality >= (SELECT median(centrality) FROM z) THEN CASE WHEN density >= (SELECT median(density) FROM z) THEN 'Motor Themes' ELSE 'Basic Themes' END
  WHEN density >= (SELECT median(density) FROM z) THEN 'Niche Themes' ELSE 'Emerging/Declining' END AS quadrant FROM z)
"""


def _map(spark, d):
    """Clusters given by the first word of the keyword, so that SQL can follow."""
    nodes, edges = written(spark, d)
    return N.thematic_map(nodes, edges, nodes.select("node", F.split("node", " ")[0].alias("community")))


@query("I10_thematic_map", NET.rstrip() + MAP + "SELECT * REPLACE (round(centrality, 6) AS centrality, round(density, 6) AS density) FROM q")
def _(spark, d):
    return rounded(_map(spark, d))


@query("I10_thematic_map_communities")
def _(spark, d):
    nodes, edges = written(spark, d)
    return N.thematic_map(nodes, edges, N.communities(nodes, edges))


@query(
    "I11_quadrant_summary",
    NET.rstrip() + MAP + """SELECT v.quadrant, coalesce(k, 0) AS clusters, coalesce(s, 0) AS items FROM (VALUES ('Motor Themes'), ('Niche Themes'), ('Basic Themes'), ('Emerging/Declining')) v(quadrant)
    LEFT JOIN (SELECT quadrant, count(*) AS k, CAST(sum(items) AS BIGINT) AS s FROM q GROUP BY quadrant) USING (quadrant)""",
)
def _(spark, d):
    return N.quadrant_summary(_map(spark, d))


# --- citation graph ---------------------------------------------------------------------------------------


def snapshot(spark, d):
    """Works with long-form ids; every work also cites itself, a stranger and its first reference twice."""
    url = lambda c: F.concat(F.lit("https://example.org/W"), c.cast("string"))
    refs = citations(spark, d).groupBy(F.col("citing").alias("doc_id")).agg(F.array_sort(F.collect_list("cited")).alias("r"))
    w = scalars(spark, d).join(refs, "doc_id", "left")
    extra = F.concat(F.coalesce("r", F.array().cast("array<bigint>")), F.coalesce(F.slice("r", 1, 1), F.array().cast("array<bigint>")), F.array("doc_id", F.lit(-1).cast("bigint")))
    return w.select(url(F.col("doc_id")).alias("doc_id"), "title", "year", "cited_by", F.array_join(F.transform(extra, url), "|").alias("references"))


@query("I12_citation_graph", with_sql(CITES) + "SELECT 'W' || citing AS citing, 'W' || cited AS cited FROM cites")
def _(spark, d):
    return C.citation_graph(snapshot(spark, d), largest=False)


@query(
    "I12_largest_component",
    # what is reached from the best linked work; it is the largest component if it holds over half of the works, else the query says so by no rows
    with_sql(
        CITES, "ends AS (SELECT citing AS a, cited AS b FROM cites UNION SELECT cited, citing FROM cites)",
        "reach AS (SELECT a AS n FROM (SELECT a, count(*) AS k FROM ends GROUP BY a ORDER BY k DESC, a LIMIT 1) UNION SELECT b FROM reach JOIN ends ON a = n)",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT 'W' || citing AS citing, 'W' || cited AS cited FROM cites WHERE citing IN (FROM reach) AND 2 * (SELECT count(*) FROM reach) > (SELECT count(DISTINCT a) FROM ends)",
)
def _(spark, d):
    """Edges of the largest weak component."""
    return C.citation_graph(snapshot(spark, d))


@query(
    "I12_match_statistics",
    with_sql(WORKS, CITES, "f AS (SELECT count(*) AS e, count(DISTINCT citing) AS c FROM cites)")
    + """SELECT (SELECT count(*) FROM works) AS documents, e + c + 2 * (SELECT count(*) FROM works) AS total_references, e + c AS internal_references, e AS edges,
    round((e + c) / (e + c + 2 * (SELECT count(*) FROM works)), 6) AS match_rate FROM f""",
)
def _(spark, d):
    return rounded(C.match_statistics(snapshot(spark, d)))


@query(
    "I13_fuzzy_citation_graph",
    # codes of 12 letters less one each are equal: 18 of 19 letters in common (95); a code less one is the other: 18 of 18 and 19 (97)
    with_sql(
        CITES, WORKS, "refs AS (SELECT citing, cited, substr(md5(CAST(cited AS VARCHAR)), 1, 12) AS c, md5(citing || '-' || cited) AS h FROM cites)",
        "bad AS (SELECT citing, CASE substr(h, 1, 1) WHEN '0' THEN substr(c, 1, p) || 'x' || substr(c, p + 2) ELSE substr(c, 1, p) || substr(c, p + 2) END AS c FROM (SELECT *, (instr('0123456789abcdef', substr(h, 2, 1)) - 1) % 12 AS p FROM refs WHERE substr(h, 1, 1) IN ('0', '1')))",
        "codes AS (SELECT doc_id, substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS c FROM works)", "less AS (SELECT doc_id, substr(c, 1, i - 1) || substr(c, i + 1) AS x FROM codes, range(1, 13) AS r(i))",
        "near AS (SELECT citing, c, doc_id, 95 AS score FROM (SELECT citing, c, substr(c, 1, i - 1) || substr(c, i + 1) AS x FROM bad, range(1, 13) AS r(i) WHERE length(c) = 12) JOIN less USING (x) UNION SELECT citing, c, doc_id, 97 FROM bad JOIN less ON c = x)",
        "best AS (SELECT citing, arg_min(doc_id, (-score, doc_id)) AS cited, max(score) AS score FROM near WHERE doc_id <> citing GROUP BY citing, c)",
    )
    + "SELECT citing, cited, CAST(max(score) AS INTEGER) AS score FROM (SELECT citing, cited, 100 AS score FROM refs WHERE substr(h, 1, 1) NOT IN ('0', '1') UNION ALL FROM best) GROUP BY citing, cited",
)
def _(spark, d):
    """Titles share a common word; references put other words around a whole title (score 100), or misspell its only other word."""
    cites = citations(spark, d)
    code = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 12)
    h = F.md5(F.concat_ws("-", "citing", "cited"))
    cites = cites.withColumns({"_c": code("cited"), "_h": h}).withColumn("_p", F.expr("(instr('0123456789abcdef', substr(_h, 2, 1)) - 1) % 12"))
    bad = F.concat(F.expr("substr(_c, 1, _p)"), F.when(F.col("_h").startswith("0"), "x").otherwise(""), F.expr("substr(_c, _p + 2)"))
    text = F.when(F.substring("_h", 1, 1).isin("0", "1"), bad).otherwise(F.concat("_c", F.lit(" extended")))
    refs = cites.groupBy(F.col("citing").alias("doc_id")).agg(F.collect_list(F.concat(F.lit("Customer, Report "), text, F.lit(", Proceedings, pp. 1"))).alias("references"))
    w = scalars(spark, d).withColumn("title", F.concat(F.lit("Report: "), code("doc_id"))).join(refs, "doc_id", "left")
    return C.fuzzy_citation_graph(w.withColumn("references", F.coalesce("references", F.array().cast("array<string>"))), threshold=90)


@query(
    "I14_citation_nodes",
    with_sql(WORKS, CITES, "o AS (SELECT citing AS doc_id, count(*) AS k FROM cites GROUP BY 1)", "i AS (SELECT cited AS doc_id, count(*) AS k FROM cites GROUP BY 1)")
    + """SELECT doc_id, title, year, cited_by AS citations, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree FROM works LEFT JOIN i USING (doc_id) LEFT JOIN o USING (doc_id)
    WHERE i.k IS NOT NULL OR o.k IS NOT NULL""",
)
def _(spark, d):
    return C.citation_nodes(scalars(spark, d), citations(spark, d))


def earlier_links(spark, d):
    """Every order cites, for each of its parts, the last order of the part in the year before that had one."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.select("l_partkey", F.col("l_orderkey").alias("citing"), F.year("o_orderdate").alias("y"), "o_orderdate")
    last = li.groupBy("l_partkey", "y").agg(F.max_by("citing", F.struct("o_orderdate", "citing")).alias("last"))
    before = last.select("l_partkey", "y", F.lag("last").over(Window.partitionBy("l_partkey").orderBy("y")).alias("cited"))
    return li.join(before.filter("cited is not null"), ["l_partkey", "y"]).select("citing", "cited").distinct()


EARLIER = with_sql(
    "li AS (SELECT l_partkey AS p, l_orderkey AS citing, year(o_orderdate) AS y, o_orderdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "last AS (SELECT p, y, arg_max(citing, (t, citing)) AS last FROM li GROUP BY p, y)", "before AS (SELECT p, y, lag(last) OVER (PARTITION BY p ORDER BY y) AS cited FROM last)",
    "g AS (SELECT DISTINCT citing, cited FROM li JOIN before USING (p, y) WHERE cited IS NOT NULL)",
    "nodes AS (SELECT citing AS n FROM g UNION SELECT cited FROM g)", "src AS (SELECT n FROM nodes WHERE n NOT IN (SELECT cited FROM g))", "snk AS (SELECT n FROM nodes WHERE n NOT IN (SELECT citing FROM g))",
    # ways from a source and to a sink, by their length
    "f AS (SELECT n, 0 AS i, 1::HUGEINT AS k FROM src UNION ALL SELECT g.cited, f.i + 1, sum(f.k)::HUGEINT FROM f JOIN g ON g.citing = f.n GROUP BY g.cited, f.i)",
    "b AS (SELECT n, 0 AS i, 1::HUGEINT AS k FROM snk UNION ALL SELECT g.citing, b.i + 1, sum(b.k)::HUGEINT FROM b JOIN g ON g.cited = b.n GROUP BY g.citing, b.i)",
    "fc AS (SELECT n, sum(k)::HUGEINT AS k FROM f GROUP BY n)", "bc AS (SELECT n, sum(k)::HUGEINT AS k FROM b GROUP BY n)", "w AS (SELECT citing, cited, fc.k * bc.k AS k FROM g JOIN fc ON fc.n = citing JOIN bc ON bc.n = cited)",
).replace("WITH ", "WITH RECURSIVE ", 1)
# the heaviest way to every node, and back from the best sink by the smallest of the nodes that lead to it
MAIN = EARLIER.rstrip() + """, h AS (SELECT n, 0 AS i, 0::HUGEINT AS k FROM src UNION ALL SELECT w.cited, h.i + 1, max(h.k + w.k) FROM h JOIN w ON w.citing = h.n GROUP BY w.cited, h.i),
hm AS (SELECT n, max(k) AS k FROM h GROUP BY n), prev AS (SELECT w.cited AS n, min(w.citing) AS p FROM w JOIN hm a ON a.n = w.citing JOIN hm z ON z.n = w.cited WHERE a.k + w.k = z.k GROUP BY w.cited),
way AS (SELECT n, 0 AS back FROM (SELECT n FROM hm WHERE n IN (FROM snk) ORDER BY k DESC, n LIMIT 1) UNION ALL SELECT p, back + 1 FROM way JOIN prev USING (n))
"""


@query("I15_path_weights", EARLIER + "SELECT citing, cited, CAST(k AS DOUBLE) AS weight FROM w")
def _(spark, d):
    return C.path_weights(earlier_links(spark, d), "SPC")


@query("I15_path_weights_relative", EARLIER + "SELECT citing, cited, round(k::DOUBLE / (SELECT sum(k) FROM fc WHERE n IN (FROM snk))::DOUBLE, 12) AS weight FROM w")
def _(spark, d):
    return rounded(C.path_weights(earlier_links(spark, d), "SPLC"), 12)


@query("I15_main_path", MAIN + "SELECT CAST(max(back) OVER () - back AS INTEGER) AS position, n AS node FROM way")
def _(spark, d):
    return C.main_path(earlier_links(spark, d))[1]


@query(
    "I14_citation_edges",
    MAIN + """SELECT citing, cited, round(k::DOUBLE / ((SELECT count(*) FROM src) * (SELECT count(*) FROM snk))::DOUBLE, 12) AS weight, CAST(a.n IS NOT NULL AS INTEGER) AS main_path
    FROM w LEFT JOIN (SELECT n, lead(n) OVER (ORDER BY back DESC) AS m FROM way) a ON a.n = citing AND a.m = cited""",
)
def _(spark, d):
    """Edges with their weight and the main-path flag."""
    return rounded(C.main_path(earlier_links(spark, d), "SPNP")[0], 12)


DIS = """t AS (SELECT a.citing AS c, a.cited AS f, b.cited AS r FROM cites a JOIN cites b ON b.citing = a.cited JOIN cites z ON z.citing = a.citing AND z.cited = b.cited),
nj AS (SELECT f AS doc_id, count(DISTINCT c) AS n_j FROM t GROUP BY f), nc AS (SELECT cited AS doc_id, count(*) AS n_citing FROM cites GROUP BY cited),
nk AS (SELECT a.citing AS doc_id, count(*) AS n_k FROM cites a JOIN cites b ON b.cited = a.cited AND b.citing <> a.citing LEFT JOIN cites z ON z.citing = b.citing AND z.cited = a.citing WHERE z.citing IS NULL GROUP BY a.citing),
v AS (SELECT doc_id, coalesce(n_citing, 0) AS n_citing, coalesce(n_citing, 0) - coalesce(n_j, 0) AS n_i, coalesce(n_j, 0) AS n_j, coalesce(n_k, 0) AS n_k FROM works LEFT JOIN nc USING (doc_id) LEFT JOIN nj USING (doc_id) LEFT JOIN nk USING (doc_id)),
w AS (SELECT *, CASE WHEN n_citing > 0 AND n_i + n_j + n_k > 0 THEN (n_i - n_j) / (n_i + n_j + n_k) END AS cd, CASE WHEN n_citing > 0 AND n_i + n_j + n_k > 0 THEN n_i / (n_i + n_j + n_k) END AS di FROM v),
u AS (SELECT *, CASE WHEN n_citing = 0 THEN 'uncited' WHEN cd IS NULL THEN 'no context' WHEN cd > 0.25 THEN 'disruptive' WHEN cd < -0.25 THEN 'consolidating' ELSE 'neutral' END AS class FROM w)"""


def scores(spark, d):
    return C.disruption(scalars(spark, d).select("doc_id"), citations(spark, d))


@query("I16_disruption", with_sql(WORKS, CITES, DIS) + "SELECT doc_id, n_citing, n_i, n_j, n_k, round(cd, 6) AS cd_index, round(di, 6) AS di_index, class FROM u")
def _(spark, d):
    return rounded(scores(spark, d))


def by_entity_sql(long: str) -> str:
    return with_sql(WORKS, CITES, DIS, long) + """SELECT entity, count(*) AS docs, round(avg(cd), 6) AS mean_cd, round(median(cd), 6) AS median_cd, count(*) FILTER (class = 'disruptive') AS disruptive,
    count(*) FILTER (class = 'consolidating') AS consolidating FROM long JOIN u USING (doc_id) WHERE cd IS NOT NULL GROUP BY entity HAVING count(*) >= 5"""


@query("I17_disruption_by_author", by_entity_sql(long_sql("authors")))
def _(spark, d):
    return rounded(C.disruption_by_entity(works(spark, d, "authors"), scores(spark, d), "authors"))


@query("I17_disruption_by_year", by_entity_sql("long AS (SELECT doc_id, CAST(year AS VARCHAR) AS entity FROM works)"))
def _(spark, d):
    return rounded(C.disruption_by_entity(scalars(spark, d), scores(spark, d), "year", "single"))


@query("I17_disruption_by_source", by_entity_sql("long AS (SELECT doc_id, source AS entity FROM works)"))
def _(spark, d):
    return rounded(C.disruption_by_entity(scalars(spark, d), scores(spark, d), "source", "single"))


@query("I17_disruption_by_country", by_entity_sql(long_sql("countries")))
def _(spark, d):
    return rounded(C.disruption_by_entity(works(spark, d, "countries"), scores(spark, d), "countries"))


@query("I17_disruption_by_affiliation", by_entity_sql(long_sql("countries", "c") + ", long AS (SELECT doc_id, 'Institute of ' || entity AS entity FROM c)"))
def _(spark, d):
    w = works(spark, d, "countries").withColumn("affiliations", F.transform("countries", lambda c: F.concat(F.lit("Institute of "), c)))
    return rounded(C.disruption_by_entity(w, scores(spark, d), "affiliations"))


@query("I18_most_disruptive", with_sql(WORKS, CITES, DIS) + "SELECT doc_id, round(cd, 6) AS cd_index, class FROM u WHERE cd IS NOT NULL ORDER BY cd DESC, doc_id LIMIT 20")
def _(spark, d):
    return rounded(C.most_disruptive(scores(spark, d), 20).select("doc_id", "cd_index", "class"))


@query("I18_enhanced_works", with_sql(WORKS, CITES, DIS) + "SELECT doc_id, title, year, n_citing, round(cd, 6) AS cd_index, class FROM works JOIN u USING (doc_id)")
def _(spark, d):
    return rounded(C.with_disruption(scalars(spark, d), scores(spark, d)).select("doc_id", "title", "year", "n_citing", "cd_index", "class"))


@query(
    "I18_disruption_histogram",
    with_sql(WORKS, CITES, DIS, "h AS (SELECT least(CAST(floor((cd + 1) / (2.0::DOUBLE / 30)) AS INTEGER), 29) AS bin, count(*) AS n FROM u WHERE cd IS NOT NULL GROUP BY 1)")
    + "SELECT CAST(b AS INTEGER) AS bin, round(-1 + b * (2.0::DOUBLE / 30), 6) + 0 AS low, round(-1 + (b + 1) * (2.0::DOUBLE / 30), 6) + 0 AS high, coalesce(n, 0) AS n FROM range(0, 30) g(b) LEFT JOIN h ON bin = b",
)
def _(spark, d):
    return rounded(histogram(scores(spark, d), "cd_index", 30, -1.0, 1.0))


# --- recognition --------------------------------------------------------------------------------------------

BEAUTY = with_sql(
    YEARLY, "s AS (SELECT doc_id, min(year) AS y0, (SELECT max(year) FROM hist) AS y1 FROM hist GROUP BY doc_id)",
    "g AS (SELECT doc_id, y0, CAST(y AS INTEGER) AS year, CAST(y - y0 AS INTEGER) AS t FROM s, LATERAL unnest(range(y0, y1 + 1)) u(y))",
    "h AS (SELECT g.doc_id, y0, g.t, coalesce(cites, 0) AS c FROM g LEFT JOIN hist USING (doc_id, year))",
    "m AS (SELECT doc_id, min(y0) AS y0, CAST(max(t) AS INTEGER) AS age, CAST(sum(c) AS BIGINT) AS total, max(c) AS cm, arg_min(t, (-c, t)) AS tm, max(CASE WHEN t = 0 THEN c END) AS c0 FROM h GROUP BY doc_id)",
    "b AS (SELECT doc_id, sum(CASE WHEN tm > 0 AND t <= tm THEN ((cm - c0) / tm * t + c0 - c) / greatest(1, c) ELSE 0 END) AS b, coalesce(arg_min(t, (-abs((cm - c0) * t - tm * c + tm * c0), t)) FILTER (tm > 0 AND t <= tm), 0) AS sl FROM h JOIN m USING (doc_id) GROUP BY doc_id)",
    "r AS (SELECT doc_id, avg(c) FILTER (t >= sl) / nullif(avg(c) FILTER (t < sl), 0) AS inten FROM h JOIN b USING (doc_id) GROUP BY doc_id)",
    "z AS (SELECT doc_id, CAST(y0 AS INTEGER) AS publication_year, total AS total_citations, cm AS max_citations_in_year, b AS beauty_coefficient, CAST(sl AS INTEGER) AS sleep_duration, CAST(y0 + sl AS INTEGER) AS awakening_year, inten AS awakening_intensity FROM m JOIN b USING (doc_id) JOIN r USING (doc_id))",
    "f AS (SELECT * FROM z WHERE beauty_coefficient >= 2 AND sleep_duration >= 2 AND total_citations >= 20 AND (awakening_intensity IS NULL OR awakening_intensity >= 1.2))",
)
ROUND = "* REPLACE (round(beauty_coefficient, 6) + 0 AS beauty_coefficient, round(awakening_intensity, 6) AS awakening_intensity)"


def beauties(spark, d):
    """Thresholds that suit the short histories of the tables."""
    return R.sleeping_beauties(R.histories(yearly_cites(spark, d)), min_beauty=2, min_sleep=2, min_citations=20, min_intensity=1.2)


@query("I19_history_from_columns", with_sql(YEARLY) + "SELECT * FROM hist")
def _(spark, d):
    """Years and counts side by side, divided by bars."""
    per = yearly_cites(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("year", "cites"))).alias("h"))
    text = lambda f: F.array_join(F.transform("h", lambda x: x[f].cast("string")), " | ")
    return R.parse_history(per.select("doc_id", text("year").alias("y"), text("cites").alias("c")), "y", "c")


@query("I19_history_from_json", with_sql(YEARLY) + "SELECT * FROM hist")
def _(spark, d):
    """A dictionary of years as text, in single quotes."""
    per = yearly_cites(spark, d).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("year").cast("string").alias("k"), F.col("cites").alias("v")))).alias("m"))
    return R.parse_history_json(per.select("doc_id", F.translate(F.to_json("m"), '"', "'").alias("h")), "h")


@query("I19_beauty", BEAUTY + f"SELECT {ROUND} FROM z")
def _(spark, d):
    return rounded(R.beauty(R.histories(yearly_cites(spark, d))))


@query("I19_sleeping_beauties", BEAUTY + f"SELECT {ROUND} FROM f")
def _(spark, d):
    return rounded(beauties(spark, d))


@query(
    "I20_beauty_histogram",
    BEAUTY.rstrip() + """, e AS (SELECT min(beauty_coefficient) AS lo, max(beauty_coefficient) AS hi FROM f),
    k AS (SELECT least(CAST(floor((beauty_coefficient - lo) / ((hi - lo) / 20)) AS INTEGER), 19) AS bin, count(*) AS n FROM f, e GROUP BY 1)
    SELECT CAST(x AS INTEGER) AS bin, round(lo + x * ((hi - lo) / 20), 5) AS low, round(lo + (x + 1) * ((hi - lo) / 20), 5) AS high, coalesce(n, 0) AS n FROM e, range(0, 20) q(x) LEFT JOIN k ON bin = x""",
)
def _(spark, d):
    return rounded(histogram(beauties(spark, d), "beauty_coefficient", 20), 5)


@query("I20_beauties_by_year", BEAUTY + "SELECT publication_year, count(*) AS works FROM f GROUP BY publication_year")
def _(spark, d):
    return R.by_publication_year(beauties(spark, d))


@query(
    "I20_trajectories",
    BEAUTY.rstrip() + """, k AS (SELECT doc_id FROM f ORDER BY beauty_coefficient DESC, doc_id LIMIT 8)
    SELECT doc_id, CAST(y0 + t AS INTEGER) AS year, c AS citations, round(c / max(c) OVER (PARTITION BY doc_id), 6) AS value FROM h WHERE doc_id IN (FROM k)""",
)
def _(spark, d):
    return rounded(R.trajectories(R.histories(yearly_cites(spark, d)), beauties(spark, d), 8))


PATTERN = BEAUTY.rstrip() + """, c AS (SELECT doc_id, t, c, sum(c) OVER (PARTITION BY doc_id ORDER BY t) AS run FROM h),
q AS (SELECT m.doc_id, CAST(y0 AS INTEGER) AS publication_year, age, total AS total_citations, cm AS peak_citations, CAST(tm AS INTEGER) AS years_to_peak, CAST(y0 + tm AS INTEGER) AS peak_year,
  CAST(min(t) FILTER (2 * run >= total) AS INTEGER) AS half_life, max(CASE WHEN t = age AND age > tm THEN 1 - pow(c / cm, 1.0::DOUBLE / (age - tm)) END) AS decay_rate,
  sum(c) FILTER (t < 3) / any_value(total) * 100 AS early_pct, sum(c) FILTER (t > age - 3) / any_value(total) * 100 AS late_pct FROM c JOIN m USING (doc_id) GROUP BY m.doc_id, y0, age, total, cm, tm),
p AS (SELECT *, CASE WHEN age < 3 THEN 'Too Recent' WHEN total_citations = 0 THEN 'Uncited' WHEN years_to_peak >= 8 AND early_pct < 10 THEN 'Sleeping Beauty' WHEN years_to_peak >= 5 AND early_pct < 25 THEN 'Delayed Recognition'
  WHEN years_to_peak <= 2 AND early_pct >= 60 THEN 'Flash-in-the-pan' WHEN age >= 6 AND late_pct >= 30 THEN 'Evergreen' ELSE 'Normal' END AS pattern, least(1, total_citations / 20) * least(1, age / 6) AS confidence FROM q)
"""


def patterns(spark, d):
    return R.citation_patterns(R.histories(yearly_cites(spark, d)))


@query(
    "I21_citation_patterns",
    PATTERN + "SELECT * REPLACE (round(decay_rate, 6) + 0 AS decay_rate, round(early_pct, 6) AS early_pct, round(late_pct, 6) AS late_pct, round(confidence, 6) AS confidence) FROM p",
)
def _(spark, d):
    return rounded(patterns(spark, d))


@query("B12_pattern_rows", PATTERN + "SELECT doc_id, pattern, years_to_peak, half_life FROM p WHERE pattern = 'Evergreen'")
def _(spark, d):
    return R.pattern_rows(patterns(spark, d), "Evergreen")


@query("I22_pattern_counts", PATTERN + "SELECT pattern, count(*) AS works FROM p GROUP BY pattern")
def _(spark, d):
    return R.pattern_counts(patterns(spark, d))


@query("I22_patterns_by_year", PATTERN + "SELECT publication_year, pattern, count(*) AS works FROM p GROUP BY ALL")
def _(spark, d):
    return R.patterns_by_year(patterns(spark, d))
