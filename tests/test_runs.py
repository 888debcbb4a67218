"""Whole runs: canopies through Spark, training, streaming, and the entry module."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import hac, online, training
from cladeframe.operators.pairs import canopy_pairs
from cladeframe.sources.sinks import dot_tree, tree_lines
from cladeframe.streaming.online import _cluster_of, cluster_stream, mini_batch_stream, open_roots


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(c, f"{c}{i:03d}", str(i % 3), rng.normal(5 * (i % 3), 0.1, 2).tolist(), i) for c in "ab" for i in range(30)]
    return spark.createDataFrame(rows, "canopy string, pid string, label string, vec array<double>, pos int")


def test_canopies_do_not_mix(spark, blobs):
    t = hac.agglomerate(blobs, linkage="average")
    assert t.count() == 2 * 59
    assert t.where("is_leaf").where("substr(pid, 1, 1) <> canopy").count() == 0
    one = t.where("canopy = 'a'")
    assert dot_tree(one).count("->") == 58 and dot_tree(one, limit=5) is None
    assert tree_lines(one).count() == 59


def test_batch_and_stream_build_the_same_tree(spark, blobs, tmp_path):
    blobs.repartition(1).sortWithinPartitions("pos").write.parquet(f"file://{tmp_path}/in")
    stream = cluster_stream(spark.readStream.schema(blobs.schema).parquet(f"file://{tmp_path}/in"), scheme="graft", threshold=-1.0)
    q = stream.writeStream.format("memory").queryName("grown").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.table("grown").toPandas()
    assert len(got) == 60 and got.groupby("canopy")["n_leaves"].max().tolist() == [30, 30]
    rows = [r for r in blobs.where("canopy = 'a'").orderBy("pos").collect()]
    made, then = online.OnlineTree(online.LINKAGES["centroid"]()), {}
    for r in rows:
        then[r.pid] = _cluster_of(made, made.insert(np.array(r.vec), r.pid, r.label), -1.0)
    batch = online.cluster(blobs, scheme="graft", order="pos").where("canopy = 'a'").toPandas()
    clean = lambda df: df.sort_values("node")["parent"].astype(float).fillna(-1).tolist()
    assert clean(made.tree.rows()) == clean(batch)
    # What the stream said of each point is what its tree says when the point comes.
    assert dict(got[got["canopy"] == "a"].set_index("pid")["cluster"]) == then


def test_streamed_mini_batches_keep_a_bounded_number_of_roots(spark, blobs, tmp_path):
    blobs.repartition(1).sortWithinPartitions("pos").write.parquet(f"file://{tmp_path}/in")
    stream = mini_batch_stream(spark.readStream.schema(blobs.schema).parquet(f"file://{tmp_path}/in"), size=6)
    q = stream.writeStream.format("memory").queryName("nodes").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    nodes = spark.table("nodes")
    assert nodes.where("left is null").count() == 60 and nodes.count() == 60 + 2 * 24
    left = {(r.canopy, r.node): r.n_leaves for r in open_roots(nodes).collect()}
    assert sum(c == "a" for c, _ in left) == 6 and sum(left.values()) == 60
    # The same merges as in one process, until no more points come.
    rows = blobs.where("canopy = 'a'").orderBy("pos").collect()
    tree = hac.Tree(online.LINKAGES["centroid"]())
    roots, want = hac._Roots(tree), []
    for r in rows:
        roots.add(tree.leaf(np.array(r.vec), r.pid, r.label))
        if len(roots.open) > 6:
            k = roots.merge_best()
            want.append((k, *tree.child[k], round(tree.score[k], 9)))
    got = [(r.node, r.left, r.right, round(r.score, 9)) for r in nodes.where("canopy = 'a' and left is not null").orderBy("node").collect()]
    assert got == want
    with pytest.raises(ValueError):
        mini_batch_stream(blobs, linkage="average")


def test_alternating_training_picks_by_development_canopies(spark):
    rng = np.random.default_rng(4)
    rows = [(c, f"{c}{i:02d}", f"{c}{i % 4}", {"fn": [f"name{i % 4}"], "ca": [f"co{i % 4}", f"x{rng.integers(9)}"]}) for c in "abcd" for i in range(14)]
    m = spark.createDataFrame(rows, "canopy string, mid string, gt string, attrs map<string,array<string>>")
    train, dev = m.where("canopy in ('a', 'b')"), m.where("canopy in ('c', 'd')")
    p = canopy_pairs(train).withColumn("label", (F.col("a_gt") == F.col("b_gt")).cast("double"))
    fit = training.train_alternating(p, train, dev, merge_model="base_plus_name", regs=(0.1, 0.01), rounds=1, size=10)
    assert [h[0] for h in fit["history"]] == ["pair 0 0.1", "pair 0 0.01", "merge 0"]
    assert fit["f1"] == max(h[1] for h in fit["history"]) == pytest.approx(1.0)
    t, f1 = training.evaluate(dev, fit, merge_model="base_plus_name")
    assert (t, f1) == (fit["threshold"], fit["f1"])
    assert training.of_size(m, 3).count() == 12


def test_training_learns_pairs_and_merges(spark):
    rng = np.random.default_rng(3)
    rows = [(c, f"{c}{i:02d}", f"{c}{i % 4}", {"fn": [f"name{i % 4}"], "ca": [f"co{i % 4}", f"x{rng.integers(9)}"]}) for c in "ab" for i in range(16)]
    m = spark.createDataFrame(rows, "canopy string, mid string, gt string, attrs map<string,array<string>>")
    p = canopy_pairs(m).withColumn("label", (F.col("a_gt") == F.col("b_gt")).cast("double"))
    fit = training.train(p, m)
    assert fit["pair"]["weights"]["fn_match"] > 0 > fit["pair"]["weights"]["fn_incompatible"]
    scored = training.score_pairs(p, fit["pair"]).select("a_canopy", "a_mid", "b_mid", "score", "label").toPandas()
    assert ((scored["score"] > 0) == (scored["label"] == 1)).mean() > 0.95
    values = spark.createDataFrame(scored.assign(tp=scored["label"].astype(int), fp=1 - scored["label"].astype(int))[["score", "tp", "fp"]])
    t, f1 = training.best_threshold(values, float(scored["label"].sum()))
    assert f1 == pytest.approx(1.0) and np.isfinite(t)
    pairs = training.score_pairs(p, fit["pair"]).select(F.col("a_canopy").alias("canopy"), F.col("a_mid").alias("a"), F.col("b_mid").alias("b"), "score")
    trees = hac.agglomerate_scores(pairs, m.select("canopy", F.col("mid").alias("pid"), F.col("gt").alias("label")), merge_score=training.merge_scorer(fit["merge"]))
    assert trees.count() == 2 * 31


def test_network_training(spark):
    rows = [({"em": ["a"]}, {"em": ["a"]}, 1.0), ({"em": ["a"]}, {"em": ["b"]}, 0.0)] * 10
    p = spark.createDataFrame(rows, "a_attrs map<string,array<string>>, b_attrs map<string,array<string>>, label double")
    model = training.fit_pair_network(training.pair_table(p, "email"), "email", max_iter=60)
    assert model.layers is not None


def test_entry_has_sql_only_for_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "document_clusters" in e.oracle_sql()


def test_flagship(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).toPandas()
    assert len(rows) == 200 and list(rows.columns) == ["doc_id", "cluster_id", "cluster_size"]
