"""Factorial analysis of a document-term table, term clusters and their leading terms."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, KMeans, PowerIterationClustering
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linear
from . import contingency
from .graph import components


def _lists(cells: DataFrame) -> DataFrame:
    """Per document the ``(item, value)`` array; as long as the number of kept terms at most."""
    return cells.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("term").alias("item"), "value")).alias("v"))


def term_space(cells: DataFrame, n_docs: int, method: str = "pca", dims: int = 2) -> tuple[DataFrame, DataFrame]:
    """Term coordinates ``(term, dim_1 …)`` and explained shares ``(dim, share)``.

    ``cells`` is long ``(doc_id, term, value)``, ``n_docs`` the number of documents behind it
    (documents without a kept term are zero rows).  Methods: pca, svd, ca, mca.
    """
    spark = cells.sparkSession
    if method in ("ca", "mca"):
        n = F.lit(1) if method == "mca" else F.col("value")
        table = cells.select(F.col("doc_id").cast("string").alias("row"), F.col("term").alias("col"), n.alias("n"))
        d = contingency.with_totals(table)
        x = F.col("n") / F.sqrt(F.col("row_total").cast("double")) / F.sqrt(F.col("col_total").cast("double"))
        names, g = linear.dense(linear.gram(contingency._row_lists(d, x), F.col("v")))
        mass = {r["col"]: float(r["m"]) for r in d.groupBy("col").agg(F.max(F.col("col_total") / F.col("total")).alias("m")).limit(linear.LIMIT).collect()}
        root = np.sqrt(np.array([mass[n] for n in names]))
        values, vectors, trace = linear.eigen(g - np.outer(root, root), dims)
        coords = vectors * np.sqrt(values) / root[:, None]
    else:
        names, g = linear.dense(linear.gram(_lists(cells), F.col("v")))
        if method == "pca":
            sums = {r["term"]: float(r["s"]) for r in cells.groupBy("term").agg(F.sum("value").alias("s")).limit(linear.LIMIT).collect()}
            mean = np.array([sums[n] for n in names]) / n_docs
            g = g - n_docs * np.outer(mean, mean)
        values, vectors, trace = linear.eigen(g, dims)
        coords = vectors * np.sqrt(values) if method == "pca" else vectors
    out = linear.frame(spark, names, {f"dim_{i + 1}": coords[:, i] for i in range(coords.shape[1])}, key="term")
    share = values / trace if trace > 0 else values
    shares = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(share)], "dim int, share double")
    return out, shares


def cluster_terms(coords: DataFrame, method: str = "kmeans", k: int = 5, eps: float = 0.5, seed: int = 42) -> DataFrame:
    """Adds ``cluster`` (0-based) to term coordinates; fewer than ``k`` terms all get cluster 0.

    kmeans, hierarchical (bisecting), spectral (power iteration on near terms) or density (chains of
    terms within ``eps``; terms without a neighbour share one further cluster).
    """
    dims = [c for c in coords.columns if c.startswith("dim_")]
    n = coords.limit(k).count()
    if n < k:
        return coords.withColumn("cluster", F.lit(0))
    if method == "density":
        return _density(coords, dims, eps)
    vec = VectorAssembler(inputCols=dims, outputCol="_v").transform(coords)
    if method == "spectral":
        return _spectral(coords, dims, k)
    algo = KMeans if method == "kmeans" else BisectingKMeans
    model = algo(featuresCol="_v", predictionCol="cluster", k=k, seed=seed).fit(vec)
    return model.transform(vec).drop("_v")


def near_pairs(coords: DataFrame, dims: list[str], eps: float) -> DataFrame:
    """``(a, b, dist)`` of terms within ``eps``: a grid of side ``eps`` turns the search into an equi join."""
    cell = [F.floor(F.col(d) / eps).cast("long") for d in dims]
    pts = coords.select("term", *dims, F.array(*cell).alias("_c"))
    moves = [[]]
    for _ in dims:
        moves = [m + [s] for m in moves for s in (-1, 0, 1)]
    spread = F.array(*[F.array(*[F.col("_c")[i] + s for i, s in enumerate(m)]) for m in moves])
    a = pts.select(F.col("term").alias("a"), *[F.col(d).alias(f"a_{d}") for d in dims], F.explode(spread).alias("_c"))
    b = pts.select(F.col("term").alias("b"), *[F.col(d).alias(f"b_{d}") for d in dims], "_c")
    dist = F.sqrt(sum(((F.col(f"a_{d}") - F.col(f"b_{d}")) ** 2 for d in dims), F.lit(0.0)))
    return a.join(b, "_c").filter(F.col("a") < F.col("b")).withColumn("dist", dist).filter(F.col("dist") <= eps).select("a", "b", "dist")


def _density(coords: DataFrame, dims: list[str], eps: float) -> DataFrame:
    links = near_pairs(coords, dims, eps).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = components(links).withColumnRenamed("node", "term")
    ids = comp.select("component").distinct().withColumn("_id", F.row_number().over(Window.orderBy("component")) - 1)
    noise = ids.agg(F.count(F.lit(1))).scalar()
    got = comp.join(ids, "component").select("term", "_id")
    return coords.join(got, "term", "left").withColumn("cluster", F.coalesce("_id", noise).cast("int")).drop("_id")


def _spectral(coords: DataFrame, dims: list[str], k: int) -> DataFrame:
    spread = coords.agg(*[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    eps = max(max(spread) / 2, 1e-9)  # neighbours within half of the extent
    ids = coords.select("term").withColumn("id", F.row_number().over(Window.orderBy("term")).cast("long"))
    pairs = near_pairs(coords, dims, eps)
    sim = pairs.join(ids.select(F.col("term").alias("a"), F.col("id").alias("src")), "a").join(
        ids.select(F.col("term").alias("b"), F.col("id").alias("dst")), "b"
    ).select("src", "dst", F.exp(-F.col("dist") / eps * 2).alias("w"))
    pic = PowerIterationClustering(k=k, maxIter=20, initMode="degree", weightCol="w", srcCol="src", dstCol="dst")
    got = pic.assignClusters(sim).join(ids, "id").select("term", "cluster")
    return coords.join(got, "term", "left").withColumn("cluster", F.coalesce("cluster", F.lit(0)))


def cluster_profiles(cells: DataFrame, clusters: DataFrame, n_docs: int, top_n: int = 10) -> DataFrame:
    """``(cluster, rank, term, mean_value)``: mean frequency of each term, ranked inside its cluster."""
    means = cells.groupBy("term").agg((F.sum("value") / n_docs).alias("mean_value"))
    w = Window.partitionBy("cluster").orderBy(F.desc("mean_value"), F.asc("term"))  # at most all kept terms
    ranked = means.join(clusters.select("term", "cluster"), "term").withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("rank") <= top_n).select("cluster", "rank", "term", "mean_value")
