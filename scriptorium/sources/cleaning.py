"""Stop lists and synonyms for keyword lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove_stopwords(df: DataFrame, col: str, *lists: DataFrame | list[str]) -> DataFrame:
    """Drop whole keywords found (ignoring case) in any of the lists.

    Python lists stay literals inside the scan stage; DataFrames of any size are anti-joined on the
    exploded items and the lists are rebuilt in their order.
    """
    fixed = sorted({w.strip().lower() for x in lists if isinstance(x, list) for w in x if w.strip()})
    out = df.withColumn(col, F.filter(col, lambda k: ~F.lower(F.trim(k)).isin(*fixed))) if fixed else df
    for table in (x for x in lists if not isinstance(x, list)):
        words = table.select(F.lower(F.trim(F.col(table.columns[0]))).alias("_w"))
        long = out.select("doc_id", F.posexplode(col).alias("_pos", "_item"))
        kept = long.join(words, F.lower(F.trim("_item")) == F.col("_w"), "left_anti")
        out = _rebuilt(out, col, kept)
    return out


def _rebuilt(df: DataFrame, col: str, long: DataFrame) -> DataFrame:
    """Put the items of ``(doc_id, _pos, _item)`` back into the list column, in order."""
    lists = long.groupBy("doc_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_item"))), lambda s: s["_item"]).alias("_new")
    )
    return (
        df.join(lists, "doc_id", "left")
        .withColumn(col, F.coalesce("_new", F.array().cast("array<string>")))
        .drop("_new")
    )


def parse_synonyms(text: str) -> dict[str, str]:
    """``old=new`` lines, or ``canonical;variant;variant`` lines."""
    table: dict[str, str] = {}
    for line in text.strip().splitlines():
        if "=" in line:
            old, new = (p.strip() for p in line.split("=", 1))
            if old and new:
                table[old.lower()] = new
        elif ";" in line:
            canon, *variants = [p.strip().lower() for p in line.split(";") if p.strip()] or [""]
            table.update({v: canon for v in variants})
    return table


def apply_synonyms(df: DataFrame, col: str, synonyms: dict[str, str] | DataFrame) -> DataFrame:
    """Replace whole items, ignoring case, by their preferred form.

    A dict stays a literal map inside the scan stage; a ``(variant, canonical)`` DataFrame of any
    size is joined on the exploded items and the lists are rebuilt in their order.
    """
    if isinstance(synonyms, dict):
        if not synonyms:
            return df
        lookup = F.create_map(*[F.lit(v) for kv in synonyms.items() for v in kv])
        return df.withColumn(
            col, F.transform(col, lambda x: F.coalesce(F.try_element_at(lookup, F.lower(F.trim(x))), x))
        )
    table = synonyms.select(F.lower(F.trim("variant")).alias("_v"), F.col("canonical").alias("_c")).dropDuplicates(["_v"])
    long = df.select("doc_id", F.posexplode(col).alias("_pos", "_item"))
    fixed = long.join(table, F.lower(F.trim("_item")) == F.col("_v"), "left").select(
        "doc_id", "_pos", F.coalesce("_c", "_item").alias("_item")
    )
    return _rebuilt(df, col, fixed)
