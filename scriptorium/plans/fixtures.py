"""The works view over the given tables (one work per order), in Spark and as SQL.

authors are the suppliers of the lines, countries their nations, keywords the part names, index
keywords the brands, subject areas the part types; a work cites the previous work of each of its parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LISTS = {
    "authors": "s_name", "countries": "n_name", "author_keywords": "p_name",
    "index_keywords": "p_brand", "subject_areas": "p_type",
}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str, fields) -> DataFrame:
    """``(doc_id, <list columns>)`` per line, joined only with the tables the fields need."""
    out = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    if {"authors", "countries"} & set(fields):
        out = out.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "countries" in fields:
        out = out.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    if {"author_keywords", "index_keywords", "subject_areas"} & set(fields):
        out = out.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return out.select("doc_id", *[F.col(LISTS[f]).alias(f) for f in fields])


def scalars(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"),
        F.year("o_orderdate").alias("year"),
        F.floor(F.col("o_totalprice") / 10000).cast("long").alias("cited_by"),
        F.col("c_name").alias("source"),
        F.col("o_orderpriority").alias("doc_type"),
        (F.col("o_orderstatus") == "O").alias("is_oa"),
    )


def works(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """Scalars plus the named list fields; works without lines get empty lists."""
    base = scalars(spark, d)
    lists = [f for f in fields if f in LISTS]
    if lists:
        per = lines(spark, d, lists).groupBy("doc_id").agg(*[F.array_sort(F.collect_set(f)).alias(f) for f in lists])
        base = base.join(per, "doc_id", "left")
    if "references" in fields:
        refs = citations(spark, d).groupBy(F.col("citing").alias("doc_id")).agg(
            F.array_sort(F.collect_list(F.concat(F.lit("Customer, 1999. Order "), F.col("cited"), F.lit(". Proceedings, 1-2")))).alias("references")
        )
        base = base.join(refs, "doc_id", "left")
    fill = lists + (["references"] if "references" in fields else [])
    return base.withColumns({f: F.coalesce(f, F.array().cast("array<string>")) for f in fill})


def delimited(spark: SparkSession, d: str, sep: str, *fields: str) -> DataFrame:
    """The same works with their lists as delimited text."""
    w = works(spark, d, *fields)
    return w.withColumns({f: F.array_join(f, sep) for f in fields})


def citations(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ``(citing, cited)``: every order cites the previous order of each of its parts."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    w = Window.partitionBy("l_partkey").orderBy("o_orderdate", "l_orderkey")
    pairs = li.select(F.col("l_orderkey").alias("citing"), F.lag("l_orderkey").over(w).alias("cited"))
    return pairs.filter("cited is not null and cited <> citing").dropDuplicates()


def yearly_cites(spark: SparkSession, d: str) -> DataFrame:
    """``(doc_id, year, cites)``: papers are parts, a line is a citation in its shipping year."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("doc_id"), F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).alias("cites"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The texts, spread out where the file does not let the cores share them.

    A split of a file may hold no row group: large files of few row groups have many splits and one that is
    full.  So rows are counted (from the footers), not splits.
    """
    df = table(spark, d, "documents")
    n = spark.sparkContext.defaultParallelism
    held = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    uneven = (held["most"] or 0) * n > 2 * (held["all"] or 0)
    return df.repartition(max(n, df.rdd.getNumPartitions()), "doc_id") if uneven else df


# --- the same views as SQL -------------------------------------------------------------------

WORKS = """works AS (SELECT o_orderkey AS doc_id, 'Order ' || o_orderkey AS title,
  CAST(year(o_orderdate) AS INTEGER) AS year, CAST(floor(o_totalprice / 10000) AS BIGINT) AS cited_by,
  c_name AS source, o_orderpriority AS doc_type, o_orderstatus = 'O' AS is_oa
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def long_sql(field: str, name: str = "long") -> str:
    """``name (doc_id, entity)`` with the distinct items of every work."""
    src = {
        "authors": "lineitem JOIN supplier ON l_suppkey = s_suppkey",
        "countries": "lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey",
    }.get(field, "lineitem JOIN part ON l_partkey = p_partkey")
    return f"""{name} AS (SELECT DISTINCT l_orderkey AS doc_id, {LISTS[field]} AS entity
  FROM {src} WHERE l_orderkey IN (SELECT doc_id FROM works))"""


CITES = """cites AS (SELECT DISTINCT citing, cited FROM (SELECT l_orderkey AS citing,
  lag(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey) AS cited
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE cited IS NOT NULL AND cited <> citing)"""

YEARLY = """hist AS (SELECT l_partkey AS doc_id, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS cites
  FROM lineitem GROUP BY ALL)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def counts_sql(field: str | None = None) -> str:
    return "counts AS (SELECT entity, count(*) AS docs FROM long GROUP BY entity)"
