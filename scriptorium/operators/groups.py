"""Groups of works: definition, counts and statistics across groups, intersections, similarity.

Membership is one ``groups array<string>`` column beside the work, so defining groups never moves
a row, and counting across groups explodes inside the row and shuffles once.
"""

from __future__ import annotations

import re

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import (
    WORD2, array_value, clean_items, explode_entities, ngrams, ordered_pairs, tokens,
)
from ..functions.ordering import prefix_sums, ranks_within, top
from ..model import flag
from .concepts import concept_condition

NONE = "array<string>"


def _empty() -> Column:
    return F.array().cast(NONE)


def _each() -> Column:
    """One row per group.  Not a bare column, on which the optimizer would test the size once more
    below the expressions that define the groups."""
    return F.explode(F.array_compact("groups"))


# --- definition -------------------------------------------------------------------------------


def groups_by_column(works: DataFrame, col: str) -> DataFrame:
    """One group per value."""
    v = F.col(col).cast("string")
    return works.withColumn("groups", F.when(v.isNotNull(), F.array(v)).otherwise(_empty()))


def groups_by_cutpoints(works: DataFrame, cutpoints: list[int], col: str = "year", right_closed: bool = False) -> DataFrame:
    """Year periods between cut points, labelled ``a-b``; a cut point starts the next period.

    ``right_closed`` puts a year that equals a cut point into the earlier period.
    """
    edges = [None, *sorted(cutpoints), None]
    label = None
    for low, high in zip(edges, edges[1:]):
        name = f"{'-inf' if low is None else low}-{'inf' if high is None else high - 1}"
        if high is None:
            cond = F.lit(True)
        else:
            cond = F.col(col) <= high if right_closed else F.col(col) < high
        label = F.when(cond, name) if label is None else label.when(cond, name)
    known = F.col(col).isNotNull()
    return works.withColumn("groups", F.when(known, F.array(label)).otherwise(_empty()))


def groups_by_periods(works: DataFrame, n: int, col: str = "year") -> DataFrame:
    """``n`` periods of (nearly) equal length between the first and the last year."""
    span = works.agg(F.struct(F.min(col).alias("a"), (F.max(col) + 1).alias("b"))).scalar()
    w = works.withColumn("_s", span)

    def edge(i: int) -> Column:
        return F.floor(F.col("_s.a") + (F.col("_s.b") - F.col("_s.a")) * i / n).cast("int")

    names = [F.concat_ws("-", edge(i).cast("string"), (edge(i + 1) - 1).cast("string")) for i in range(n)]
    label = F.when(F.col(col) < edge(1), names[0])
    for i in range(1, n):
        label = label.when(F.col(col) < edge(i + 1), names[i])
    return w.withColumn("groups", F.when(F.col(col).isNotNull(), F.array(label)).otherwise(_empty())).drop("_s")


def groups_by_items(works: DataFrame, col: str, top_n: int = 10) -> DataFrame:
    """Membership per item of a list field, for the ``top_n`` items with most documents."""
    from .counts import count_list

    best = top(count_list(works, col, distinct_docs=True), top_n, F.desc("docs"), F.asc("entity"))
    hit = F.array_intersect(clean_items(F.col(col)), F.col("_best"))
    return works.withColumn("_best", array_value(best)).withColumn("groups", F.array_sort(hit)).drop("_best")


def groups_by_clusters(
    works: DataFrame, text: str, k: int | None = None, candidates: range = range(2, 11), features: int = 1 << 14, seed: int = 42
) -> DataFrame:
    """k-means on TF-IDF of a text; without ``k`` the one with the best silhouette is taken."""
    words = works.withColumn("_w", F.coalesce(tokens(F.col(text), WORD2), F.array().cast(NONE)))
    stages = [HashingTF(inputCol="_w", outputCol="_tf", numFeatures=features), IDF(inputCol="_tf", outputCol="_raw"), Normalizer(inputCol="_raw", outputCol="_v")]
    vectors = Pipeline(stages=stages).fit(words).transform(words)
    fits = {}
    for n in [k] if k else candidates:
        model = KMeans(featuresCol="_v", predictionCol="_c", k=n, seed=seed, maxIter=10).fit(vectors)
        fits[n] = model
    if len(fits) > 1:
        judge = ClusteringEvaluator(featuresCol="_v", predictionCol="_c")
        k = max(fits, key=lambda n: (judge.evaluate(fits[n].transform(vectors)), -n))
    out = fits[k].transform(vectors)
    return out.withColumn("groups", F.array(F.concat(F.lit("Cluster "), F.col("_c") + 1))).drop("_w", "_tf", "_raw", "_v", "_c")


def groups_by_concepts(works: DataFrame, text: str, concepts: dict[str, list[str]], whole_word: bool = True) -> DataFrame:
    """A group per concept of a dictionary, any keyword."""
    if not whole_word:
        return groups_by_terms(works, text, concepts)
    flags = [F.when(concept_condition(F.col(text), kws), F.lit(name)) for name, kws in concepts.items()]
    return works.withColumn("groups", F.array_compact(F.array(*flags)))


def groups_by_terms(works: DataFrame, text: str, terms: dict[str, list[str]]) -> DataFrame:
    """A group per entry: any term anywhere in the text, ``*`` for anything, case ignored."""
    flags = []
    for name, words in terms.items():
        words = [w for w in words if w.strip()]
        if not words:  # nothing to look for: nobody is in the group
            continue
        pattern = "|".join(".*".join(re.escape(part) for part in w.split("*")) for w in words)
        flags.append(F.when(F.col(text).rlike("(?iu)" + pattern), F.lit(name)))
    return works.withColumn("groups", F.array_compact(F.array(*flags)))


def random_groups(works: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` independent half-size groups from a hash of the id (repeatable in any engine, may overlap)."""
    hit = lambda g: F.substring(F.md5(F.concat_ws("-", F.col("doc_id").cast("string"), F.lit(str(seed)), g.cast("string")).cast("binary")), 1, 1) < "8"
    members = F.filter(F.sequence(F.lit(1), F.lit(n)), hit)
    return works.withColumn("groups", F.transform(members, lambda g: F.concat(F.lit("Random "), g)))


def select_groups(works: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Keep or drop groups by name; documents left without a group stay."""
    g = F.col("groups")
    if include:
        g = F.filter(g, lambda x: x.isin(*include))
    if exclude:
        g = F.filter(g, lambda x: ~x.isin(*exclude))
    return works.withColumn("groups", g)


def decode_groups(df: DataFrame, prefix: str = "Group: ") -> DataFrame:
    """``groups`` from 0/1, yes/no or true/false columns named ``Group: x``."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    flags = [F.when(flag(F.col(f"`{c}`")), F.lit(c[len(prefix):])) for c in cols]
    return df.withColumn("groups", F.array_compact(F.array(*flags))).drop(*cols)


def encode_groups(works: DataFrame, names: list[str], prefix: str = "Group: ") -> DataFrame:
    """The wide 0/1 form."""
    return works.withColumns({f"{prefix}{n}": F.array_contains("groups", n).cast("int") for n in names})


def group_summary(works: DataFrame) -> DataFrame:
    """``(rank, group, docs, percentage)``; documents in no group count in the base."""
    n = works.agg(F.count(F.lit(1))).scalar()
    per = works.select(_each().alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("docs"))
    ranked = prefix_sums(per, [F.desc("docs"), F.asc("group")])
    return ranked.select(F.col("rank").cast("long").alias("rank"), "group", "docs", (F.col("docs") / n * 100).alias("percentage"))


# --- counts across groups -----------------------------------------------------------------------


def group_sizes(works: DataFrame) -> DataFrame:
    return works.select(_each().alias("group")).groupBy("group").agg(F.count(F.lit(1)).alias("size"))


def grouped_entities(works: DataFrame, col: str, kind: str = "list", distinct: bool = False) -> DataFrame:
    """``(group, entity)`` occurrences; for ``text`` the words and word pairs, once per document."""
    if kind == "text":
        items = F.array_distinct(ngrams(F.col("_t"), 1, 2))
        long = works.withColumn("_t", tokens(F.col(col), WORD2)).select("groups", F.explode(items).alias("entity"))
    else:
        long = explode_entities(works, col, "groups", kind=kind, distinct=distinct)
    return long.select(_each().alias("group"), "entity")


def counts_across_groups(works: DataFrame, col: str, kind: str = "list", shared_only: bool = False) -> DataFrame:
    """Long ``(group, entity, docs, proportion, percentage, rank, percent_rank)``.

    ``shared_only`` keeps the items that occur in every group.  Ranks are within the group.
    """
    per = grouped_entities(works, col, kind).groupBy("group", "entity").agg(F.count(F.lit(1)).alias("docs"))
    return _group_ranks(per, works, ["group"], shared_only)


def _group_ranks(per: DataFrame, works: DataFrame, keys: list[str], shared_only: bool) -> DataFrame:
    sizes = group_sizes(works)
    out = ranks_within(per, keys, [F.desc("docs"), F.asc("entity")])
    if shared_only:
        ent = [k for k in keys if k != "group"] + ["entity"]
        spread = per.groupBy(*ent).agg(F.count(F.lit(1)).alias("_g"))
        out = out.join(spread.filter(F.col("_g") == sizes.agg(F.count(F.lit(1))).scalar()), ent, "left_semi")
    out = out.join(sizes, "group")
    return out.select(
        *keys, "entity", "docs", (F.col("docs") / F.col("size")).alias("proportion"),
        (F.col("docs") / F.col("size") * 100).alias("percentage"), "rank",
        ((F.col("_size") - F.col("rank") + 1) / F.greatest(F.col("_size") - 1, F.lit(1))).alias("percent_rank"),
    )


def combined_columns(counts: DataFrame) -> DataFrame:
    """Per entity over all groups: docs, proportion, percentage, rank, percent_rank."""
    per = counts.groupBy("entity").agg(F.sum("docs").alias("docs"))
    ranked = prefix_sums(per, [F.desc("docs"), F.asc("entity")], {"_cum": "docs"})
    t = ranked.agg(F.struct(F.max("rank").alias("n"), F.max("_cum").alias("t"))).scalar()
    out = ranked.withColumn("_t", t)
    return out.select(
        "entity", "docs", (F.col("docs") / F.col("_t.t")).alias("proportion"),
        (F.col("docs") / F.col("_t.t") * 100).alias("percentage"), F.col("rank").cast("long").alias("rank"),
        ((F.col("_t.n") - F.col("rank") + 1) / F.col("_t.n") * 100).alias("percent_rank"),
    )


def wide(long: DataFrame, names: list[str], values: list[str], key: str = "entity") -> DataFrame:
    """One row per entity, one column ``<value> (<group>)`` per group and value; missing counts are 0."""
    aggs = [
        F.max(F.when(F.col("group") == g, F.col(v))).alias(f"{v} ({g})") for v in values for g in names
    ]
    out = long.groupBy(key).agg(*aggs)
    counts = [f"{v} ({g})" for v in values for g in names if "rank" not in v]
    return out.fillna(0, counts)


def count_all_types(works: DataFrame, fields: dict[str, str], shared_only: bool = False) -> DataFrame:
    """Counts across groups for several fields in one pass: ``(entity_type, group, entity, …)``.

    ``fields`` maps column to kind; all items of a work are stacked and exploded together.
    """
    stacked = []
    for col, kind in fields.items():
        items = clean_items(F.col(col)) if kind == "list" else clean_items(F.array(F.col(col).cast("string")))
        stacked.append(_tagged(items, col))
    long = works.select("groups", F.explode(F.concat(*stacked)).alias("p")).select(
        _each().alias("group"), F.col("p.entity_type").alias("entity_type"), F.col("p.entity").alias("entity")
    )
    per = long.groupBy("entity_type", "group", "entity").agg(F.count(F.lit(1)).alias("docs"))
    return _group_ranks(per, works, ["entity_type", "group"], shared_only)


def _tagged(items: Column, name: str) -> Column:
    known = F.coalesce(items, _empty())
    return F.transform(known, lambda x: F.struct(F.lit(name).alias("entity_type"), x.alias("entity")))


def count_all_summary(counts: DataFrame) -> DataFrame:
    """``(entity_type, unique_items)``."""
    return counts.select("entity_type", "entity").distinct().groupBy("entity_type").agg(F.count(F.lit(1)).alias("unique_items"))


def union_of_tops(counts: DataFrame, n: int = 10) -> DataFrame:
    """All rows of the items that are among the top ``n`` of any group."""
    w = Window.partitionBy("group").orderBy(F.desc("docs"), F.asc("entity"))
    # a rank limit, which Spark applies before the shuffle (at most n rows per group and task move)
    best = counts.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select("entity").distinct()
    return counts.join(best, "entity", "left_semi")


# --- statistics per group -----------------------------------------------------------------------


def group_statistics(
    works: DataFrame, col: str, kind: str = "list", top_n: int = 50, include: list[str] | None = None, exclude: list[str] | None = None,
    max_features: int | None = None,
) -> DataFrame:
    """For the top items overall, per group: docs, fraction, percentage, rank (ties lowest), percent_rank.

    ``percent_rank`` is the average ascending rank over the number of items.  Items without
    documents in a group are listed with zero.
    """
    from .counts import count_list, count_ngrams, count_single

    count = {"single": count_single, "list": count_list}
    total = count_ngrams(works, col, 1, 2, [], max_features, per_document=True) if kind == "text" else count[kind](works, col)
    if include:
        total = total.filter(F.col("entity").isin(*include))
    if exclude:
        total = total.filter(~F.col("entity").isin(*exclude))
    best = top(total, top_n, F.desc("docs"), F.asc("entity"))
    sizes = group_sizes(works)
    grid = sizes.select("group", "size", F.explode(array_value(best)).alias("entity"))  # groups times top_n
    per = grouped_entities(works, col, kind).filter(F.array_contains(array_value(best), F.col("entity")))
    per = per.groupBy("group", "entity").agg(F.count(F.lit(1)).alias("docs"))
    d = grid.join(per, ["group", "entity"], "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    # windows over at most top_n rows per group
    w = Window.partitionBy("group")
    asc, ties = F.rank().over(w.orderBy("docs")), F.count(F.lit(1)).over(Window.partitionBy("group", "docs"))
    return d.withColumns({"_asc": asc, "_ties": ties}).select(
        "group", "entity", "docs", (F.col("docs") / F.col("size")).alias("fraction"),
        (F.col("docs") / F.col("size") * 100).alias("percentage"),
        F.rank().over(w.orderBy(F.desc("docs"))).cast("long").alias("rank"),
        ((F.col("_asc") + (F.col("_ties") - 1) / 2) / F.count(F.lit(1)).over(w)).alias("percent_rank"),
    )


def group_entity_stats(works: DataFrame, col: str, kind: str = "list", top_n: int = 50) -> DataFrame:
    """Core citation indicators of the top items inside every group."""
    from .counts import count_list, count_single
    from .impact import indices

    best = top((count_single if kind == "single" else count_list)(works, col), top_n, F.desc("docs"), F.asc("entity"))
    long = explode_entities(works, col, "groups", "cited_by", "year", kind=kind, distinct=True)
    long = long.filter(F.array_contains(array_value(best), F.col("entity")))
    long = long.select(_each().alias("group"), "entity", "cited_by", "year")
    return indices(long, ["group", "entity"]).select("group", "entity", "docs", "total_citations", "h_index", "mean_year")


def statistics_all_types(works: DataFrame, fields: dict[str, str], top_n: int = 50) -> DataFrame:
    """``group_statistics`` of several fields with an ``entity_type`` column."""
    out = None
    for col, kind in fields.items():
        one = group_statistics(works, col, kind, top_n).withColumn("entity_type", F.lit(col))
        out = one if out is None else out.unionByName(one)
    return out


def statistics_summary(stats: DataFrame) -> DataFrame:
    """``(group, entities, total_docs)``."""
    return stats.groupBy("group").agg(F.count_if(F.col("docs") > 0).alias("entities"), F.sum("docs").alias("total_docs"))


def filtered_statistics(stats: DataFrame, group: str, top_n: int) -> DataFrame:
    """The rows of the top items by the counts of one group."""
    best = top(stats.filter(F.col("group") == group), top_n, F.desc("docs"), F.asc("entity")).select("entity")
    return stats.join(best, "entity", "left_semi")


# --- intersections and similarity ------------------------------------------------------------


def patterns(works: DataFrame) -> DataFrame:
    """``(groups, size)`` per exact membership pattern, documents in no group left out.

    The pattern is the sorted list in the row, so this is one aggregation; everything below works
    on these few rows.
    """
    p = F.array_sort(F.array_distinct("groups")).alias("groups")
    return works.select(p).filter(F.size("groups") > 0).groupBy("groups").agg(F.count(F.lit(1)).alias("size"))


def exclusive_intersections(works: DataFrame) -> DataFrame:
    """``(label, n_groups, size)`` per exact pattern."""
    return patterns(works).select(F.array_join("groups", " & ").alias("label"), F.size("groups").alias("n_groups"), "size")


def intersection_documents(works: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``(label, doc_id)``: documents by exact pattern, or those in all named groups and no other."""
    p = F.array_sort(F.array_distinct("groups"))
    rows = works.filter(F.size("groups") > 0)
    if names:
        rows = rows.filter(p == F.array(*[F.lit(n) for n in sorted(names)]))
    return rows.select(F.array_join(p, " & ").alias("label"), "doc_id")


def similarity(works: DataFrame) -> DataFrame:
    """Every ordered pair of groups: ``overlap_docs, jaccard, dice, overlap``; the diagonal too."""
    pats = patterns(works)
    pairs = pats.select(F.explode(ordered_pairs(F.col("groups"), F.col("groups"))).alias("p"), "size")
    both = pairs.groupBy(F.col("p.a").alias("group_a"), F.col("p.b").alias("group_b")).agg(F.sum("size").alias("n"))
    sizes = pats.select(_each().alias("g"), "size").groupBy("g").agg(F.sum("size").alias("s"))
    names = array_value(sizes, "g")
    # group list times group list: both as short as the number of groups
    grid = sizes.select(F.col("g").alias("group_a"), F.col("s").alias("size_a"), F.explode(names).alias("group_b"))
    d = grid.join(sizes.select(F.col("g").alias("group_b"), F.col("s").alias("size_b")), "group_b")
    d = d.join(both, ["group_a", "group_b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    a, b, n = F.col("size_a"), F.col("size_b"), F.col("n")
    return d.select(
        "group_a", "group_b", "size_a", "size_b", n.alias("overlap_docs"), (n / (a + b - n)).alias("jaccard"),
        (2 * n / (a + b)).alias("dice"), (n / F.least(a, b)).alias("overlap"),
    )


def similarity_network(works: DataFrame, method: str = "jaccard", threshold: float = 0.0) -> DataFrame:
    """Edges ``(group_a, group_b, weight)`` above the threshold."""
    col = {"count": "overlap_docs"}.get(method, method)
    edges = similarity(works).filter(F.col("group_a") < F.col("group_b"))
    keep = (F.col(col) > threshold) | ((F.lit(method) == "count") & (F.col(col) > 0))
    return edges.filter(keep).select("group_a", "group_b", F.col(col).cast("double").alias("weight"))


def region_sizes(works: DataFrame, names: list[str]) -> DataFrame:
    """Exclusive size of every region of 2 to 5 sets, empty regions included.

    For more groups only sizes, pair overlaps and the common part are given.
    """
    spark = works.sparkSession
    sel = select_groups(works, include=names)
    if len(names) > 5:
        sim = similarity(sel).filter(F.col("group_a") <= F.col("group_b"))
        label = F.when(F.col("group_a") == F.col("group_b"), F.col("group_a")).otherwise(F.concat_ws(" & ", "group_a", "group_b"))
        every = sel.agg(F.count_if(F.size(F.array_distinct("groups")) == len(names)).alias("size")).select(F.lit("all").alias("label"), "size")
        return sim.select(label.alias("label"), F.col("overlap_docs").alias("size")).unionByName(every)
    ordered = F.array(*[F.lit(n) for n in sorted(names)])
    grid = spark.range(1, 1 << len(names)).select(
        F.array_join(F.filter(ordered, lambda x, i: F.col("id").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0), " & ").alias("label")
    )
    got = exclusive_intersections(sel).select("label", "size")
    return grid.join(got, "label", "left").withColumn("size", F.coalesce("size", F.lit(0)))


def overlap_report(works: DataFrame) -> DataFrame:
    """Pairs of groups: sizes, common documents, Jaccard (3 digits)."""
    return similarity(works).filter(F.col("group_a") < F.col("group_b")).select(
        "group_a", "group_b", "size_a", "size_b", "overlap_docs", F.round("jaccard", 3).alias("jaccard")
    )
