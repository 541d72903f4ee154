"""Networks as two tables: ``nodes (node, …)`` and undirected ``edges (src, dst, weight)`` with src < dst.

Iterative measures are driver loops of joins; the lineage is cut with a reliable checkpoint every
few rounds and convergence is one aggregated number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lists import (
    ENGLISH_WORD, array_value, as_items, clean_items, keep_only, ngrams, tokens, unordered_pairs,
)
from ..functions.scratch import cut, discard, placed
from .selection import frequent_items

# Words that carry no topic.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as",
    "is", "was", "are", "were", "been", "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "shall", "can", "this", "that", "these", "those", "it", "its",
    "we", "our", "their", "there",
)


# --- building -------------------------------------------------------------------------------------


def network_items(
    works: DataFrame, kind: str, ngram: int = 2, stop_words: tuple[str, ...] = STOP_WORDS
) -> tuple[DataFrame, Column]:
    """A table and its items column for one of the ten kinds of network (or any list column).

    The items stay an expression: exploding a named column would let the optimizer push a size test
    below the step that builds it, and so build it twice.
    """
    fields = {"coauthorship": "authors", "co_citation": "references", "country_collab": "countries", "institution_collab": "affiliations"}
    empty = F.array().cast("array<string>")
    if kind == "all_keywords":
        return works, F.concat(*[F.coalesce(as_items(works, c), empty) for c in ("author_keywords", "index_keywords")])
    if kind == "source_cocitation":
        third = F.transform(as_items(works, "references"), lambda r: F.trim(F.get(F.split(r, ","), F.lit(2))))
        return works, clean_items(F.filter(third, lambda x: x.isNotNull()))
    if kind in ("title_ngrams", "abstract_ngrams"):
        words = works.select(tokens(F.col(kind.split("_")[0]), ENGLISH_WORD, list(stop_words)).alias("_t"))
        return words, ngrams(F.col("_t"), ngram, ngram)
    return works, as_items(works, fields.get(kind, kind))


def item_counts(table: DataFrame, items: Column) -> DataFrame:
    return table.select(F.explode(items).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("docs"))


def cooccurrence_network(
    works: DataFrame, kind: str, top_n: int = 50, min_docs: int = 2, min_edge: int = 1, normalise: bool = False,
    repeats: bool = False, **filters,
) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)``: nodes are the ``top_n`` items, an edge counts the documents with both.

    The items of a work are cut to the kept ones and paired inside the row, so the only shuffle of
    the build carries at most ``top_n**2 / 2`` pre-aggregated pairs per task.  ``repeats`` counts
    pairs with the repeats inside a document.
    """
    table, items = network_items(works, kind)
    if not kind.endswith("_ngrams"):  # lists are short: written once, read for the counts, the choice and the pairs
        table, items = cut(table.select(items.alias("_all"))), F.col("_all")
    counts = item_counts(table, items)
    nodes = frequent_items(counts, min_docs, top_n, **filters).select(F.col("entity").alias("node"), F.col("docs").alias("occurrences"))
    inside = keep_only(table, "_i", items, array_value(nodes, "node"))
    listed = inside.select(F.array_sort("_i" if repeats else F.array_distinct("_i")).alias("_i"))
    pairs = listed.select(F.explode(unordered_pairs(F.col("_i"))).alias("p"))
    pairs = pairs.select(F.col("p.a").alias("src"), F.col("p.b").alias("dst")).filter("src <> dst")
    edges = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= min_edge)
    if normalise:
        edges = edges.withColumn("weight", F.col("weight") / edges.agg(F.max("weight")).scalar())
    return nodes, edges


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1)
    ends = F.array(F.struct(F.col("src").alias("src"), F.col("dst").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ends).alias("e"), w.alias("weight")).select("e.src", "e.dst", "weight")


# --- local measures ---------------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree, weighted_degree)``."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("weighted_degree")
    )


def triangles(edges: DataFrame, *carry: str) -> DataFrame:
    """``(x, y, z)`` once per triangle with the carried edge columns as ``<c>_xy``, ``<c>_xz``, ``<c>_yz``.

    Every edge points from the end of lower degree to the other (ties by id), so no node has more
    than sqrt(2 * edges) outgoing edges however popular it is, and wedges are only formed there.
    """
    deg = both_ways(edges.select("src", "dst")).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    e = edges.join(deg.select("src", F.col("d").alias("ds")), "src").join(deg.select(F.col("src").alias("dst"), F.col("d").alias("dd")), "dst")
    first = F.struct("ds", "src") < F.struct(F.col("dd").alias("ds"), F.col("dst").alias("src"))
    lo, hi = F.when(first, F.col("src")).otherwise(F.col("dst")), F.when(first, F.col("dst")).otherwise(F.col("src"))
    # the order of the far ends decides which side of a wedge comes first
    key = F.when(first, F.struct(F.col("dd").alias("d"), F.col("dst").alias("i"))).otherwise(F.struct(F.col("ds").alias("d"), F.col("src").alias("i")))
    o = e.select(lo.alias("x"), hi.alias("y"), key.alias("k"), *carry)
    a = o.select("x", "y", F.col("k").alias("ky"), *[F.col(c).alias(f"{c}_xy") for c in carry])
    b = o.select("x", F.col("y").alias("z"), F.col("k").alias("kz"), *[F.col(c).alias(f"{c}_xz") for c in carry])
    wedges = a.join(b, "x").filter(F.col("ky") < F.col("kz")).drop("ky", "kz")
    far = o.select(F.col("x").alias("y"), F.col("y").alias("z"), *[F.col(c).alias(f"{c}_yz") for c in carry])
    return wedges.join(far, ["y", "z"])


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, clustering)``: weighted by the cube root of the weights over the largest one."""
    top_w = edges.agg(F.max("weight")).scalar()
    scaled = edges.withColumn("w", F.col("weight") / top_w)
    t = triangles(scaled.select("src", "dst", "w"), "w")
    size = F.cbrt(F.col("w_xy") * F.col("w_xz") * F.col("w_yz"))
    per = t.select(F.explode(F.array("x", "y", "z")).alias("node"), size.alias("s")).groupBy("node").agg(F.sum("s").alias("s"))
    d = degrees(edges).select("node", "degree")
    out = nodes.select("node").join(d, "node", "left").join(per, "node", "left")
    value = F.when(F.col("degree") > 1, 2 * F.coalesce("s", F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return out.select("node", value.alias("clustering"))


# --- iterations --------------------------------------------------------------------------------------


def _iterate(links: DataFrame, start: DataFrame, value: str, base: float, tol: float, max_rounds: int, unit: bool = False) -> DataFrame:
    """``value <- base + sum of value * p over the incoming links`` until it stands still.

    Every node needs a link to itself (of weight zero if need be): then a round is one join and one
    aggregation that read the state once, so five rounds form one plan of five times the size.
    """
    def scaled(df: DataFrame) -> DataFrame:
        if not unit:
            return df
        norm = df.agg(F.sqrt(F.sum(F.col(value) * F.col(value)))).first()[0] or 1.0
        return df.withColumn(value, F.col(value) / norm)

    state = scaled(cut(start))
    for _ in range(0, max_rounds, 5):
        new = state
        for _ in range(5):
            new = links.join(new, links["src"] == new["node"]).groupBy(F.col("dst").alias("node")).agg((F.lit(base) + F.sum(F.col(value) * F.col("p"))).alias(value))
        new = scaled(cut(new))
        gap = new.join(state.withColumnRenamed(value, "_o"), "node").agg(F.max(F.abs(F.col(value) - F.col("_o")))).first()[0] or 0.0
        state = new
        if gap < tol:
            return state
    raise RuntimeError(f"no standstill after {max_rounds} rounds (last change {gap:.3g}, wanted {tol:.3g}); raise max_rounds or tol")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tol: float = 1e-9, max_rounds: int = 300) -> DataFrame:
    """``(node, pagerank)``, weighted; the rank of nodes without edges is spread evenly."""
    names = cut(nodes.select("node").distinct())
    n = names.count()
    e = both_ways(edges)
    out = e.groupBy("src").agg(F.sum("weight").alias("_t"))
    share = e.join(out, "src").select("src", "dst", (damping * F.col("weight") / F.col("_t")).alias("p"))
    own = names.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.0).alias("p"))
    links = placed(share.unionByName(own), "src")
    # nodes without edges get nothing from neighbours, so what they spread is the same in every round
    loose = names.join(e.select(F.col("src").alias("node")).distinct(), "node", "left_anti").count()
    base = (1 - damping) / n / (1 - damping * loose / n) if n else 0.0
    return _iterate(links, names.withColumn("pagerank", F.lit(1.0 / max(n, 1))), "pagerank", base, tol, max_rounds)


def eigenvector(nodes: DataFrame, edges: DataFrame, tol: float = 1e-9, max_rounds: int = 2000) -> DataFrame:
    """``(node, eigenvector)``: principal eigenvector of the weighted table, length one.

    A small multiple of the identity is added, which keeps two-sided graphs from swinging.
    """
    names = cut(nodes.select("node").distinct())
    top_degree = degrees(edges).agg(F.max("weighted_degree")).first()[0] or 1
    own = names.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0.25).alias("p"))
    links = placed(both_ways(edges).select("src", "dst", (F.col("weight") / top_degree).alias("p")).unionByName(own), "src")
    return _iterate(links, names.withColumn("eigenvector", F.lit(1.0)), "eigenvector", 0.0, tol, max_rounds, unit=True)


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """``(node, component)`` with the smallest node id of the component as its name.

    Two alternating steps per round (hook every node to the smallest label around it, then jump to
    the label's label) settle long chains in logarithmic time.
    """
    e = cut(both_ways(edges.select("src", "dst")).select("src", "dst"))
    state = cut(e.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    for _ in range(max_rounds):
        near = e.join(state.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("_c"))
        # written, as three later steps read it: else the links would be joined once for each of them
        hooked = cut(state.join(near, "node").select("node", F.col("component").alias("_old"), F.least("component", "_c").alias("component")))
        # the label a node leaves must learn of the smaller one too
        told = hooked.filter("_old <> component").groupBy(F.col("_old").alias("node")).agg(F.min("component").alias("_t"))
        merged = hooked.join(told, "node", "left").select("node", "_old", F.coalesce(F.least("component", "_t"), "component").alias("component"))
        jump = merged.select(F.col("node").alias("component"), F.col("component").alias("_up"))
        after = cut(merged.join(jump, "component", "left").select("node", "_old", F.coalesce(F.least("component", "_up"), "component").alias("component")))
        moved = after.filter("_old <> component").limit(1).count()
        discard(state, hooked)
        state = after
        if not moved:
            discard(e)
            return state.drop("_old")
    raise RuntimeError(f"components are not settled after {max_rounds} rounds")


def largest_component(edges: DataFrame) -> DataFrame:
    """The edges inside the component with most nodes (ties: smallest name)."""
    comp = cut(components(edges))
    best = comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)
    inside = comp.join(best, "component", "left_semi").select(F.col("node").alias("src"))
    return edges.join(inside, "src", "left_semi")


# --- shortest paths --------------------------------------------------------------------------------


def _hops(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, node, hops)`` of all nodes that a source reaches, ring by ring."""
    ring = cut(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")))
    seen = ring
    while True:
        step = ring.join(links, ring["node"] == links["src"]).select("source", F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        ring = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti"))
        if ring.isEmpty():
            return seen
        seen = seen.unionByName(ring)


def _distances(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``(source, node, dist)`` by rounds of joins; in a round only distances that fell are carried on."""
    state = cut(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("dist"), F.lit(True).alias("new")))
    while True:
        live = state.filter("new")
        if live.isEmpty():
            return state.drop("new")
        step = live.join(links, live["node"] == links["src"]).select("source", F.col("dst").alias("node"), (F.col("dist") + F.col("w")).alias("dist"), F.lit(True).alias("new"))
        # the old distance wins a tie, so a node is new only if its distance fell
        best = F.min(F.struct("dist", "new")).alias("b")
        after = cut(state.withColumn("new", F.lit(False)).unionByName(step).groupBy("source", "node").agg(best).select("source", "node", "b.dist", "b.new"))
        discard(state)
        state = after


def _ranked_steps(links: DataFrame, dist: DataFrame, every: int = 3) -> tuple[DataFrame, int]:
    """``(source, a, b, rank_a, rank_b)``: the links on shortest paths, with ranks that grow along every path.

    The rank of a node is the number of links of the longest of its shortest paths, the same for every source
    in a few rounds, so all that follows can go rank by rank.
    """
    a, b = dist.toDF("source", "a", "_da"), dist.toDF("source", "b", "_db")
    steps = cut(a.join(links, a["a"] == links["src"]).select("source", "a", F.col("dst").alias("b"), (F.col("_da") + F.col("w")).alias("_db")).join(b, ["source", "b", "_db"]).select("source", "a", "b"))
    start = cut(dist.select("source", "node", F.lit(0).alias("rank")))
    state = start
    while True:
        new = state
        for _ in range(every):
            far = steps.join(new.withColumnRenamed("node", "a"), ["source", "a"]).groupBy("source", F.col("b").alias("node")).agg((F.max("rank") + 1).alias("_r"))
            new = start.join(far, ["source", "node"], "left").select("source", "node", F.coalesce("_r", F.lit(0)).alias("rank"))
        new = cut(new)
        moved = new.join(state.withColumnRenamed("rank", "_old"), ["source", "node"]).filter("rank <> _old").limit(1).count()
        if state is not start:
            discard(state)
        state = new
        if not moved:
            break
    ranked = steps.join(state.toDF("source", "a", "rank_a"), ["source", "a"]).join(state.toDF("source", "b", "rank_b"), ["source", "b"])
    ranked = cut(ranked.select("source", "a", "b", "rank_a", "rank_b"))
    top = ranked.agg(F.max("rank_b")).first()[0] or 0
    discard(steps, start, state)
    return ranked, top


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """``(node, dependency)`` summed over the sources: shares of the shortest paths that pass a node on their way.

    Numbers of paths go forward rank by rank, dependencies go back the same way; every link of a shortest
    path is joined once each way.
    """
    dist = _distances(links, sources)
    steps, top = _ranked_steps(links, dist)
    paths = [cut(sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("paths")))]
    for r in range(1, top + 1):
        into = steps.filter(F.col("rank_b") == r)
        paths.append(cut(into.join(_union(paths).withColumnRenamed("node", "a"), ["source", "a"]).groupBy("source", F.col("b").alias("node")).agg(F.sum("paths").alias("paths"))))
    number = cut(_union(paths))
    shares = steps.join(number.toDF("source", "a", "_pa"), ["source", "a"]).join(number.toDF("source", "b", "_pb"), ["source", "b"])
    shares = cut(shares.select("source", "a", "b", "rank_a", (F.col("_pa") / F.col("_pb")).alias("share")))
    back: list[DataFrame] = []
    for r in range(top - 1, 0, -1):  # the source itself (rank 0) is at the end of its paths, not on their way
        out = shares.filter(F.col("rank_a") == r)
        later = F.lit(0.0)
        if back:
            out = out.join(_union(back).toDF("source", "b", "_d"), ["source", "b"], "left")
            later = F.coalesce("_d", F.lit(0.0))
        back.append(cut(out.groupBy("source", F.col("a").alias("node")).agg(F.sum(F.col("share") * (1 + later)).alias("dependency"))))
    if not back:
        empty = number.limit(0).select("node", F.col("paths").alias("dependency"))
        return empty
    total = cut(_union(back).groupBy("node").agg(F.sum("dependency").alias("dependency")))
    discard(dist, steps, shares, number, *paths, *back)
    return total


def path_centralities(nodes: DataFrame, edges: DataFrame, block: int = 4096) -> DataFrame:
    """``(node, closeness, betweenness)``.

    Closeness counts hops and is scaled by the reachable share; betweenness takes the weight (above 0) as a
    length and is divided by the number of other pairs.  All of it is joins over ``(source, node, ...)``, for
    ``block`` sources at a time, which bounds the rows of a round to ``block`` times the nodes.
    """
    names = cut(nodes.select("node").distinct())
    n = names.count()
    length = F.when(F.col("weight") > 0, F.col("weight").cast("double")).otherwise(F.raise_error("a length is not above 0"))
    links = both_ways(edges).filter("src <> dst").groupBy("src", "dst").agg(F.min(length).alias("w"))
    links = cut(links)
    blocks = max(-(-n // block), 1)
    close, passed = [], []
    for i in range(blocks):
        sources = cut(names.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == i).select(F.col("node").alias("source")))
        hops = _hops(links.select("src", "dst"), sources)
        close.append(cut(hops.groupBy(F.col("source").alias("node")).agg(F.sum("hops").alias("t"), (F.count(F.lit(1)) - 1).alias("k"))))
        passed.append(_dependencies(links, sources))
    near = _union(close).select("node", F.when(F.col("t") > 0, F.col("k") / F.col("t") * (F.col("k") / (n - 1))).otherwise(0.0).alias("closeness"))
    # each unordered pair is seen from both ends
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    between = _union(passed).groupBy("node").agg((F.sum("dependency") * scale).alias("betweenness"))
    out = names.join(near, "node", "left").join(between, "node", "left")
    return out.select("node", F.coalesce("closeness", F.lit(0.0)).alias("closeness"), F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


# --- communities ------------------------------------------------------------------------------------


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row ``(modularity)`` of ``(node, community)`` on weighted edges."""
    m = edges.agg(F.sum("weight")).scalar()
    a = membership.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    inside = edges.join(a, "src").join(b, "dst").filter("ca = cb").agg(F.coalesce(F.sum("weight"), F.lit(0)).cast("double")).scalar()
    deg = degrees(edges).join(membership, "node").groupBy("community").agg(F.sum("weighted_degree").alias("d"))
    return deg.withColumn("_m", m).agg((inside / F.max("_m") - F.sum(F.pow(F.col("d") / (2 * F.col("_m")), 2))).alias("modularity"))


def communities(nodes: DataFrame, edges: DataFrame, max_rounds: int = 200, max_levels: int = 50) -> DataFrame:
    """``(node, community)`` by repeated local moving and merging (Louvain), repeatable.

    All nodes choose at once, half of them (by a hash that changes every round) may move, ties go to
    the smallest name; a round that does not raise the modularity ends a level.  Communities are
    numbered by size, then name; nodes without edges stand alone.
    """
    level = cut(both_ways(edges).withColumn("weight", F.col("weight").cast("double")))
    two_m = level.agg(F.sum("weight")).first()[0]
    names = nodes.select("node").distinct()
    final = cut(names.withColumn("community", F.col("node").cast("string")))
    if two_m:
        level = level.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
        for _ in range(max_levels):
            member, improved = _local_moving(level, two_m, max_rounds)
            if not improved:
                break
            final = cut(final.join(member.withColumnRenamed("node", "community").withColumnRenamed("c", "_new"), "community", "left").select(
                "node", F.coalesce("_new", "community").alias("community")
            ))
            a = member.select(F.col("node").alias("src"), F.col("c").alias("_a"))
            b = member.select(F.col("node").alias("dst"), F.col("c").alias("_b"))
            level = cut(level.join(a, "src").join(b, "dst").groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").alias("weight")))
        else:
            raise RuntimeError(f"communities still merge after {max_levels} levels")
    sizes = final.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    from ..functions.ordering import prefix_sums

    ids = prefix_sums(sizes, [F.desc("n"), F.asc("community")]).select("community", (F.col("rank") - 1).cast("int").alias("_id"))
    return final.join(ids, "community").select("node", F.col("_id").alias("community"))


def _local_moving(edges: DataFrame, two_m: float, max_rounds: int) -> tuple[DataFrame, bool]:
    """``(node, c)`` after moving nodes of a (both-way) level while the modularity rises.

    The step that picks the next community of a node also sees what its present one is worth, so the
    modularity of the present state costs only one sum over the written table.
    """
    k = placed(edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0.0)).alias("loop")), "node")
    links = placed(edges.filter("src <> dst"), "dst")
    state = k.select("node", F.col("node").alias("c"), "k", "loop")
    best_q, best, last = None, state, []
    for i in range(max_rounds):
        tot = state.groupBy("c").agg(F.sum("k").alias("tot"))
        to = links.join(state.select(F.col("node").alias("dst"), F.col("c").alias("to")), "dst").groupBy(F.col("src").alias("node"), "to").agg(F.sum("weight").alias("w"))
        own = state.select("node", F.col("c").alias("to"), F.lit(0.0).alias("w"))  # staying is always an option
        opts = to.unionByName(own).groupBy("node", "to").agg(F.sum("w").alias("w"))
        opts = opts.join(state, "node").join(tot.withColumnRenamed("c", "to"), "to")
        here = F.col("to") == F.col("c")
        gain = F.round(F.col("w") - F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)) / two_m, 9)
        pick = opts.withColumn("g", gain).groupBy("node", "c", "k", "loop").agg(
            F.max("g").alias("gmax"), F.max(F.when(here, F.col("g"))).alias("gown"), F.max(F.when(here, F.col("w"))).alias("w_own"),
            F.max(F.when(here, F.col("tot"))).alias("tot_own"), F.min(F.struct((-F.col("g")).alias("n"), F.col("to").alias("t"))).alias("b"),
        )
        wants = F.col("gmax") > F.col("gown")
        turn = F.pmod(F.xxhash64("node", F.lit(i)), F.lit(2)) == 0
        new = cut(pick.select(
            "node", F.when(wants & turn, F.col("b.t")).otherwise(F.col("c")).alias("c"), "k", "loop", F.col("c").alias("_c"), wants.cast("int").alias("wants"), "w_own", "tot_own"
        ))
        row = new.agg(F.sum(F.col("w_own") + F.col("loop")).alias("i"), F.sum(F.col("k") * F.col("tot_own")).alias("s"), F.max("wants").alias("w")).first()
        q = row["i"] / two_m - row["s"] / two_m**2
        if best_q is None or q > best_q + 1e-9:
            best_q, best = q, new.select("node", F.col("_c").alias("c"))
        last.append(q)
        if not row["w"] or (i >= 3 and q <= last[-3] + 1e-9):
            break
        state = new.select("node", "c", "k", "loop")
    else:
        raise RuntimeError(f"communities still move after {max_rounds} rounds")
    moved = best.filter("node <> c").limit(1).count() > 0
    return best.select("node", "c"), moved


# --- tables -------------------------------------------------------------------------------------------


def node_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per node with all measures."""
    nodes, edges = cut(nodes), cut(edges)
    out = nodes.join(degrees(edges), "node", "left").fillna(0, ["degree", "weighted_degree"])
    for part in (
        path_centralities(nodes, edges), eigenvector(nodes, edges), pagerank(nodes, edges),
        clustering(nodes, edges), communities(nodes, edges),
    ):
        out = out.join(part, "node", "left")
    return out


# --- thematic map --------------------------------------------------------------------------------------

# The names of the quadrants.
QUADRANTS = ("Motor Themes", "Niche Themes", "Basic Themes", "Emerging/Declining")


def thematic_network(works: DataFrame, kind: str, min_docs: int = 2, top_n: int = 100) -> tuple[DataFrame, DataFrame]:
    """Co-occurrence with the repeats inside a document."""
    return cooccurrence_network(works, kind, top_n, min_docs, repeats=True)


def thematic_map(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per cluster: items, occurrences, links, density, centrality, label and quadrant."""
    n = nodes.join(membership, "node")
    # cluster lists are no longer than the node list, which top_n bounds
    per = n.groupBy("community").agg(
        F.count(F.lit(1)).alias("items"), F.sum("occurrences").alias("occurrences"),
        F.array_sort(F.collect_list(F.struct((-F.col("occurrences")).alias("o"), F.col("node").cast("string").alias("n")))).alias("_k"),
    )
    names = F.transform("_k", lambda x: x["n"])
    a = membership.select(F.col("node").alias("src"), F.col("community").alias("ca"))
    b = membership.select(F.col("node").alias("dst"), F.col("community").alias("cb"))
    ends = edges.join(a, "src").join(b, "dst")
    sides = F.when(F.col("ca") == F.col("cb"), F.array("ca")).otherwise(F.array("ca", "cb"))
    links = ends.select(F.explode(sides).alias("community"), (F.col("ca") == F.col("cb")).alias("_in"), "weight").groupBy("community").agg(
        F.sum(F.when(F.col("_in"), F.col("weight")).otherwise(0)).alias("internal"), F.sum(F.when(~F.col("_in"), F.col("weight")).otherwise(0)).alias("external")
    )
    d = per.join(links, "community", "left").fillna(0, ["internal", "external"])
    total = d.agg(F.sum("external")).scalar()
    most = F.greatest(F.col("items") * (F.col("items") - 1) / 2, F.lit(1))
    d = d.withColumn("_t", total).select(
        "community", F.array_join(F.slice(names, 1, 3), "; ").alias("label"),
        F.when(F.col("_t") > 0, F.col("external") / F.col("_t")).otherwise(0.0).alias("centrality"),
        (F.col("internal") / most).alias("density"), "occurrences", "items", "internal", "external",
        F.array_join(names, "; ").alias("keywords"), F.array_join(F.slice(names, 1, 5), "; ").alias("top_keywords"),
    )
    mid = d.agg(F.struct(F.percentile("centrality", F.lit(0.5)).alias("c"), F.percentile("density", F.lit(0.5)).alias("d"))).scalar()
    d = d.withColumn("_m", mid)
    high_c, high_d = F.col("centrality") >= F.col("_m.c"), F.col("density") >= F.col("_m.d")
    quadrant = F.when(high_c & high_d, QUADRANTS[0]).when(high_d, QUADRANTS[1]).when(high_c, QUADRANTS[2]).otherwise(QUADRANTS[3])
    return d.withColumn("quadrant", quadrant).drop("_m")


def quadrant_summary(themes: DataFrame) -> DataFrame:
    """``(quadrant, clusters, items)``, always four rows."""
    spark = themes.sparkSession
    names = spark.range(1).select(F.explode(F.array(*[F.lit(q) for q in QUADRANTS])).alias("quadrant"))
    per = themes.groupBy("quadrant").agg(F.count(F.lit(1)).alias("clusters"), F.sum("items").alias("items"))
    return names.join(per, "quadrant", "left").fillna(0, ["clusters", "items"])
