"""Faults that were found once: each has a test here."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import bigcount as B
from scriptorium.functions import scratch
from scriptorium.functions.patterns import valid_pattern
from scriptorium.functions.scratch import cut
from scriptorium.operators import citation as C
from scriptorium.operators import graph as N
from scriptorium.operators import groups as G
from scriptorium.operators.selection import pattern_matches
from scriptorium.sources import snapshot

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def chain(spark, n):
    return spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("weight"))


def test_loops_raise_when_unsettled(spark):
    edges = chain(spark, 40)
    nodes = spark.range(40).select(F.col("id").alias("node"))
    for call in (
        lambda: N.components(edges, max_rounds=1), lambda: N.pagerank(nodes, edges, max_rounds=5), lambda: N.eigenvector(nodes, edges, max_rounds=5),
        lambda: N.communities(nodes, edges, max_rounds=1),
    ):
        with pytest.raises(RuntimeError):
            call()


def test_long_chain_is_one_component(spark):
    got = N.components(chain(spark, 5000))
    assert got.count() == 5000 and got.filter("component <> 0").count() == 0


def test_path_counts_stay_exact(spark):
    """18 layers of 150 nodes below 3 of two: more than 10^38 paths; one more link makes one way heavier by a single path."""
    layers = [2] * 3 + [150] * 18
    ends = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(layers, layers[1:]))], "i int, a int, b int")
    name = lambda i, x: F.format_string("n%02d-%04d", i, x)
    df = ends.select("i", "a", "b", F.explode(F.sequence(F.lit(0), F.col("a") - 1)).alias("x")).select("i", "x", F.explode(F.sequence(F.lit(0), F.col("b") - 1)).alias("y"))
    df = df.select(name(F.col("i"), F.col("x")).alias("citing"), name(F.col("i") + 1, F.col("y")).alias("cited"))
    df = cut(df.unionByName(spark.createDataFrame([("n00-0001", "n20-0149")], "citing string, cited string")))
    total = 2**3 * 150**18
    got = C._path_counts(df, "SPC").select("citing", "cited", "weight", B.text(F.col("limbs")).alias("paths"))
    few = {(r.citing, r.cited): r for r in got.filter("citing like '%-0001' and (cited like '%-0000' or cited like 'n20%')").collect()}
    assert total > 10**38 and int(few["n00-0001", "n01-0000"].paths) == total // 4 and int(few["n00-0001", "n20-0149"].paths) == 1
    assert few["n00-0001", "n01-0000"].weight == pytest.approx(total // 4, rel=1e-15)
    edges, path = C.main_path(df)
    rows = sorted((r.position, r.node) for r in path.collect())
    assert rows == [(i, f"n{i:02}-0000") for i in range(21)] and edges.filter("main_path = 1").count() == 20


def test_cycles_are_condensed(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "d"), ("d", "d")], "citing string, cited string")
    with pytest.raises(C.Cyclic):
        C.path_weights(df.filter("citing <> cited"))
    edges, path = C.main_path(df)
    assert [r.node for r in path.orderBy("position").collect()] == ["a", "b", "d"] and edges.count() == 3


def test_whole_numbers_of_any_size(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(10 ** rng.choice([1, 6, 7, 18])), rng.randrange(10 ** rng.choice([1, 3, 12, 18]))) for _ in range(300)] + [(0, 0), (0, 5), (10**6, 10**6), (999_999, 1), (10**18 - 1, 10**18 - 1)]
    df = spark.createDataFrame(rows, "x long, y long").select("x", "y", B.number(F.col("x")).alias("a"), B.number(F.col("y")).alias("b"))
    square = B.multiplied(B.multiplied(F.col("a"), F.col("b")), F.col("a"))
    out = df.select("x", "y", B.text(B.added(F.col("a"), F.col("b"))).alias("s"), B.text(square).alias("m"), B.as_double(square).alias("d"), B.ratio(square, F.col("b")).alias("r"), B.largest_first(F.col("a")).alias("k"))
    for r in out.collect():
        m = r.x * r.x * r.y
        assert int(r.s) == r.x + r.y and int(r.m) == m and r.d == pytest.approx(m, rel=1e-15) and r.r == pytest.approx(m / r.y if r.y else 0.0, rel=1e-14)
    assert [r.x for r in out.orderBy("k").collect()] == sorted((x for x, _ in rows), reverse=True)
    total = df.agg(B.summed("a", 3).alias("t")).select(B.text(B.settled(F.col("t"))).alias("t")).first().t
    assert int(total) == sum(x for x, _ in rows)


def test_duplicate_titles_keep_their_links(spark):
    works = spark.createDataFrame([(1, "one same title here", ["one same title here"]), (2, "one same title here", []), (3, "other work", ["one same title here"])], "doc_id long, title string, references array<string>")
    got = {(r.citing, r.cited) for r in C.fuzzy_citation_graph(works).collect()}
    assert got == {(1, 2), (3, 1)}


def test_issn_with_check_letter():
    assert snapshot.ISSN.fullmatch("0893-133X") and snapshot.ISSN.fullmatch("08931334") and not snapshot.ISSN.fullmatch("Nature")


def test_blank_terms_tag_nobody(spark):
    works = spark.createDataFrame([("some text",)], "text string")
    assert G.groups_by_terms(works, "text", {"none": [], "blank": [" "], "hit": ["some", ""]}).first().groups == ["hit"]


def test_patterns_of_another_dialect(spark):
    assert valid_pattern("a(b)?") and not valid_pattern("(?P<x>a)") and not valid_pattern("(")
    df = spark.createDataFrame([("x (?P<x>a) y",), ("a",)], "t string")
    assert df.filter(pattern_matches("t", "(?P<x>a)")).count() == 1


def test_no_scratch_folder_on_a_cluster(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Undefined:
        def isDefined(self):
            return False

    class Sc:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

        class _jsc:
            class _S:
                def getCheckpointDir(self):
                    return Undefined()

            sc = staticmethod(_S)

    class Session:
        conf, sparkContext = Conf(), Sc()

    with pytest.raises(RuntimeError):
        scratch.scratch_root(Session())


def test_package_reaches_workers_from_another_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("ROWS", len(e.queries()["I13_fuzzy_citation_graph"](spark, "/root/testdata/sf0.001").collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "ROWS" in out.stdout, out.stderr[-2000:]
