"""Exports, item lists, dictionaries in; result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import scratch_path


def read_export(spark: SparkSession, path: str, fmt: str | None = None, schema: str | None = None) -> DataFrame:
    """A delimited export (``csv`` or tab-separated ``txt``/``tsv``), JSON lines or parquet.

    Malformed lines are skipped.  Quoted line breaks are allowed, so give many files, not one big one.
    """
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt in ("json", "jsonl"):
        return reader.option("mode", "DROPMALFORMED").json(path)
    sep = "," if fmt == "csv" else "\t"
    return (
        reader.option("header", True).option("sep", sep).option("multiLine", True)
        .option("escape", '"').option("mode", "DROPMALFORMED").csv(path)
    )


def write_result(df: DataFrame | dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Write one table, or several as one directory each."""
    tables = df if isinstance(df, dict) else {"": df}
    for name, table in tables.items():
        target = f"{path}/{name}" if name else path
        out = table
        if fmt == "csv":
            lists = [f.name for f in table.schema if isinstance(f.dataType, T.ArrayType)]
            out = table.withColumns({c: F.array_join(F.col(c).cast("array<string>"), "; ") for c in lists})
            out.write.mode("error").option("header", True).option("escape", '"').csv(target)
        else:
            out.write.mode("error").format(fmt).save(target)


def write_and_read(df: DataFrame, fmt: str) -> DataFrame:
    """Round trip through a written table in the scratch folder (also a reliable lineage cut)."""
    path = scratch_path(df.sparkSession, "table")
    write_result(df, path, fmt)
    return read_export(df.sparkSession, path, fmt)


def read_item_list(spark: SparkSession, path: str) -> DataFrame:
    """``item``: one per line, or the first column of a CSV; blanks dropped, repeats removed."""
    if path.lower().endswith(".csv"):
        rows = spark.read.option("header", True).csv(path)
        items = rows.select(F.trim(F.col(f"`{rows.columns[0]}`")).alias("item"))
    else:
        items = spark.read.text(path).select(F.trim("value").alias("item"))
    return items.filter("item is not null and item <> ''").dropDuplicates(["item"])


def concept_rows(df: DataFrame) -> DataFrame:
    """Clean ``(concept, keyword)``; of names that differ only in case the first spelling stays."""
    rows = df.select(F.trim("concept").alias("concept"), F.trim("keyword").alias("keyword"))
    rows = rows.filter("concept <> '' and keyword <> '' and lower(keyword) <> 'nan'").dropDuplicates()
    kept = rows.groupBy(F.lower("concept").alias("_k")).agg(F.min("concept").alias("concept"))
    return rows.join(kept, "concept", "left_semi")


def read_concepts(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """``(concept, keyword)`` from a JSON list or object, ``name: kw; kw`` lines, or one CSV column per concept."""
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt == "csv":
        return concepts_from_columns(spark.read.option("header", True).csv(path))
    if fmt == "json":
        whole = spark.read.text(path, wholetext=True)  # a dictionary file, small by nature
        listed = F.from_json("value", "array<struct<name:string,keywords:array<string>>>")
        keyed = F.from_json("value", "map<string,array<string>>")
        is_list = F.trim("value").startswith("[")
        a = whole.filter(is_list).select(F.explode(listed).alias("c")).select("c.name", "c.keywords")
        b = whole.filter(~is_list).select(F.explode(keyed).alias("name", "keywords"))
        rows = a.unionByName(b).select(F.col("name").alias("concept"), F.explode("keywords").alias("keyword"))
        return concept_rows(rows)
    lines = spark.read.text(path).filter(F.col("value").contains(":"))
    rows = lines.select(
        F.element_at(F.split("value", ":", 2), 1).alias("concept"),
        F.explode(F.split(F.element_at(F.split("value", ":", 2), 2), ";")).alias("keyword"),
    )
    return concept_rows(rows)


def concepts_from_columns(df: DataFrame) -> DataFrame:
    """One column per concept, keywords down the rows (a file or any connected table)."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("concept"), F.col(f"`{c}`").cast("string").alias("keyword")) for c in df.columns
    ])
    return concept_rows(df.select(F.explode(pairs).alias("p")).select("p.*").filter("keyword is not null"))


def write_concepts(concepts: DataFrame, path: str) -> None:
    """Concept dictionary as JSON lines ``{name, keywords}``."""
    rows = concepts.groupBy(F.col("concept").alias("name")).agg(
        F.array_sort(F.collect_set("keyword")).alias("keywords")
    )
    rows.write.mode("error").json(path)
