"""Decompositions through the Gram matrix of a long table with few columns.

The rows (documents, entities) stay distributed; only the item x item Gram matrix, whose side is
the top-N parameter of the analysis, reaches the driver for its eigenvectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lists import ordered_pairs

LIMIT = 2000


def gram(rows: DataFrame, items: Column) -> DataFrame:
    """``(a, b, g)``: sums of products over rows that hold an array of ``(item, value)``."""
    pairs = rows.select(F.explode(ordered_pairs(items, items)).alias("p"))
    return pairs.groupBy(F.col("p.a.item").alias("a"), F.col("p.b.item").alias("b")).agg(
        F.sum(F.col("p.a.value") * F.col("p.b.value")).alias("g")
    )


def dense(g: DataFrame) -> tuple[list[str], np.ndarray]:
    """The Gram matrix on the driver; its side is checked first."""
    rows = g.limit(LIMIT * LIMIT + 1).toPandas()
    names = sorted(set(rows["a"]) | set(rows["b"]))
    if len(names) > LIMIT:
        raise ValueError(f"at most {LIMIT} columns can be decomposed, got {len(names)}; lower top_n")
    at = {n: i for i, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    m[rows["a"].map(at).to_numpy(), rows["b"].map(at).to_numpy()] = rows["g"].to_numpy(float)
    return names, m


def eigen(m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Largest ``k`` eigenvalues, their vectors (largest entry positive) and the trace."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    k = min(k, len(values))
    vectors = vectors[:, :k]
    lead = np.abs(vectors).round(9).argmax(axis=0)
    signs = np.sign(vectors[lead, range(k)])
    return values[:k], vectors * np.where(signs == 0, 1, signs), float(values.sum())


def frame(spark, names: list[str], columns: dict[str, np.ndarray], key: str = "item") -> DataFrame:
    """A small driver matrix as a DataFrame."""
    schema = f"`{key}` string, " + ", ".join(f"`{c}` double" for c in columns)
    data = [(n, *[float(v[i]) for v in columns.values()]) for i, n in enumerate(names)]
    return spark.createDataFrame(data, schema)
