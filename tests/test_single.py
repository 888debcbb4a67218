"""Single-linkage trees from rows of scores, against heaps of all pairs' merges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.functions import scalar as S
from cladeframe.operators import entities, hac, pairs, single, training, trees_sql
from cladeframe.operators.linkage import PairScores
from cladeframe.plans import catalogue, known_trees, run
from cladeframe.plans import mentions as M
from cladeframe.plans.config import Config

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def no_pairs(monkeypatch):
    """From now on nobody forms all pairs of a canopy."""

    def refuse(*a, **k):
        raise AssertionError("all pairs are formed")

    return lambda: monkeypatch.setattr(pairs, "canopy_pairs", refuse)


def test_merges_of_rows_are_those_of_a_heap_with_ties_and_missing_pairs():
    rng = np.random.default_rng(0)
    for trial in range(300):
        n = int(rng.integers(1, 25))
        s = rng.integers(0, int(rng.choice([1, 2, 3, 5, 1000])), size=(n, n)).astype(float)
        s = np.maximum(s, s.T)
        if trial % 3 == 0:
            gone = np.triu(rng.random((n, n)) < 0.5, 1)
            s[gone | gone.T] = -np.inf
        points = [(np.zeros(1), str(i), None) for i in range(n)]
        want, got = hac.mini_batch(points, PairScores(s), n), single.tree_of([p[1:] for p in points], lambda i: s[i])
        assert want.child == got.child and want.score == got.score


def test_partitions_of_a_chain_are_the_closure_cuts(spark):
    rng = np.random.default_rng(5)
    n = 40
    s = -np.abs(rng.integers(0, 9, n)[:, None] - np.arange(n)[None] / 3.0)
    s = np.maximum(s, s.T)
    rows = single.tree_of([(str(i), str(i % 3)) for i in range(n)], lambda i: s[i]).rows().assign(canopy="x")
    tree = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "node long, parent long, left long, right long, score double, n_leaves long, is_leaf boolean, pid string, label string, depth int, canopy string")
    for t in (-9.0, -0.5, 0.0, 1.0):
        want = {r.leaf: r.cluster for r in trees_sql.threshold_cut(trees_sql.closure(tree), tree, t).collect()}
        assert {r.leaf: r.threshold_cluster for r in trees_sql.partitions(tree, t).collect()} == want


def test_partitions_of_a_deep_chain_take_linear_time():
    import tracemalloc

    import pandas as pd

    n = 3000  # ((0 1) 2) 3 ...: choices kept as lists of clusters would hold half of n squared
    inner = [n + max(0, i - 1) for i in range(n)]
    df = pd.DataFrame({"node": range(2 * n - 1), "parent": [*inner, *range(n + 1, 2 * n - 1), None], "label": [str(i) for i in range(n)] + [None] * (n - 1), "score": [None] * n + [1.0] * (n - 1)})
    tracemalloc.start()
    got, f1 = trees_sql.best_partition(df)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {i: i for i in range(n)} and f1 == 0 and peak < 20_000_000
    assert set(trees_sql.threshold_partition(df, 0.5).values()) == {2 * n - 2}


def test_configured_runs_of_the_untrained_merge_model_form_no_pairs(spark, no_pairs):
    """the trees, scores and counts are those of exact clustering over all pairs."""
    m = M.mentions(spark, SMALL).select(F.col("mid").cast("string").alias("mid"), (F.col("mid") % 3).cast("string").alias("canopy"), F.lit("x").alias("gt"), "attrs").cache()
    fitted = {"pair": {"model": "base", "weights": M.WEIGHTS, "bias": M.BIAS}}
    scored = training.score_pairs(pairs.canopy_pairs(m), fitted["pair"]).select(F.col("a_canopy").alias("canopy"), F.col("a_mid").alias("a"), F.col("b_mid").alias("b"), "score")
    want = entities.agglomerate_entities(scored, m.select("canopy", F.col("mid").alias("pid"), F.col("gt").alias("label"), "attrs"))
    want = want.toPandas().sort_values(["canopy", "node"], ignore_index=True)
    no_pairs()
    got = run.mention_tree(m, Config.of({"model": "base_sub_ent"}), fitted).toPandas().sort_values(["canopy", "node"], ignore_index=True)
    assert len(want) == 297 and got[want.columns].equals(want)


def _all_pairs_tree(spark):
    p = catalogue._points(spark, SMALL).withColumn("canopy", F.col("label").cast("string"))
    both = pairs.canopy_pairs(p.select("canopy", F.col("pid").alias("mid"), "vec"))
    near = both.select(F.col("a_canopy").alias("canopy"), F.col("a_mid").alias("a"), F.col("b_mid").alias("b"), S.cosine("a_vec", "b_vec").alias("score"))
    return hac.agglomerate_scores(near, p.select("canopy", "pid", F.col("canopy").alias("label"))).toPandas().sort_values(["canopy", "node"], ignore_index=True)


def test_learned_tree_query_forms_no_pairs(spark, no_pairs):
    """row for row the tree of all pairs' cosines."""
    want = _all_pairs_tree(spark)
    no_pairs()
    got = catalogue.ehac_learned_tree(spark, SMALL).toPandas().sort_values(["canopy", "node"], ignore_index=True)
    assert len(got) and got[want.columns].equals(want)


def test_learned_tree_cut_forms_no_pairs(spark, no_pairs):
    """the components of the pairs at 0.3, by brute force."""
    x = {r.pid: (r.label, np.array(r.vec)) for r in catalogue._points(spark, SMALL).collect()}
    part = {p: p for p in x}
    for a, (la, u) in x.items():
        for b, (lb, v) in x.items():
            if a < b and la == lb and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.3:
                low, high = sorted((part[a], part[b]))
                part = {p: low if c == high else c for p, c in part.items()}
    no_pairs()
    assert {r.pid: r.cluster for r in known_trees.learned_tree_cut(spark, SMALL).collect()} == part


def test_cosine_rows_miss_pairs_of_other_lengths_and_nulls():
    row = single.cosine_rows([[1.0, 0.0], [2.0, 0.0], None, [1.0], [0.0, 0.0], [float("nan"), 1.0]])
    got = row(0)
    assert got[:2].tolist() == [1.0, 1.0] and got[2] == got[3] == -np.inf and got[4] == 0 and np.isnan(got[5])
