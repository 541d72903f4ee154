"""Flows between two to six fields of the works (k-field plot data)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lists import array_value, clean_items, ordered_pairs
from .counts import count_list, count_single
from .selection import frequent_items

Field = tuple[str, str, int]  # column, kind (list or single), top-N


def _kept_items(works: DataFrame, fields: list[Field]) -> DataFrame:
    """``(_l0, _l1, …, year, cited_by)``: the kept items of each field, filtered inside the row."""
    out = works
    for i, (col, kind, n) in enumerate(fields):
        items = clean_items(F.col(col) if kind == "list" else F.array(F.col(col).cast("string")))
        counts = count_list(works, col) if kind == "list" else count_single(works, col)
        best = array_value(frequent_items(counts, 1, n))
        out = out.withColumn(f"_l{i}", F.coalesce(items, F.array().cast("array<string>"))).withColumn(f"_a{i}", best)
    keep = [F.filter(f"_l{i}", _member(i)).alias(f"_l{i}") for i in range(len(fields))]
    return out.select(*keep, "year", F.coalesce("cited_by", F.lit(0)).alias("cited_by"))


def _member(i: int):
    return lambda x: F.array_contains(F.col(f"_a{i}"), x)


def _color(by: str) -> Column:
    return {
        "avg_year": F.avg("year"), "citations": F.sum("cited_by").cast("double"), "docs": F.count(F.lit(1)).cast("double"),
    }[by]


def field_flows(works: DataFrame, fields: list[Field], value: str = "docs") -> DataFrame:
    """``(level, source_field, source, target_field, target, weight, value)``.

    A pair of kept items of neighbouring fields adds one per document.  All levels come from one
    pass: the pairs of every level are stacked inside the row.
    """
    if not 2 <= len(fields) <= 6:
        raise ValueError("two to six fields")
    kept = _kept_items(works, fields)
    stacked = F.concat(*[
        _level_pairs(i, fields[i][0], fields[i + 1][0]) for i in range(len(fields) - 1)
    ])
    long = kept.select(F.explode(stacked).alias("p"), "year", "cited_by").select("p.*", "year", "cited_by")
    return long.groupBy("level", "source_field", "source", "target_field", "target").agg(
        F.count(F.lit(1)).alias("weight"), _color(value).alias("value")
    )


def _level_pairs(i: int, source: str, target: str) -> Column:
    return F.transform(
        ordered_pairs(F.col(f"_l{i}"), F.col(f"_l{i + 1}")),
        lambda p: F.struct(
            F.lit(i).alias("level"), F.lit(source).alias("source_field"), p["a"].alias("source"),
            F.lit(target).alias("target_field"), p["b"].alias("target"),
        ),
    )


def field_nodes(works: DataFrame, fields: list[Field], value: str = "docs") -> DataFrame:
    """``(level, field, name, flow, value)``: flow in plus out, value over the documents of the node.

    A document counts once per node.
    """
    flows = field_flows(works, fields)
    ends = F.array(
        F.struct(F.col("level").alias("level"), F.col("source").alias("name")),
        F.struct((F.col("level") + 1).alias("level"), F.col("target").alias("name")),
    )
    size = flows.select(F.explode(ends).alias("e"), "weight").groupBy("e.level", "e.name").agg(F.sum("weight").alias("flow"))
    kept = _kept_items(works, fields)
    stacked = F.concat(*[_level_items(i, fields[i][0]) for i in range(len(fields))])
    long = kept.select(F.explode(stacked).alias("p"), "year", "cited_by").select("p.*", "year", "cited_by")
    per = long.groupBy("level", "field", "name").agg(_color(value).alias("value"))
    return per.join(size, ["level", "name"], "left").select("level", "field", "name", F.coalesce("flow", F.lit(0)).alias("flow"), "value")


def _level_items(i: int, field: str) -> Column:
    return F.transform(
        F.array_distinct(f"_l{i}"), lambda x: F.struct(F.lit(i).alias("level"), F.lit(field).alias("field"), x.alias("name"))
    )
