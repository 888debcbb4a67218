"""A run from settings: mentions or vectors in, trees, partitions, metrics and files out."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import COMPOSITES
from ..operators import entities, hac, metrics, online, pairs, single, training, trees_sql
from ..session import cut
from ..sources import sinks
from ..sources.tables import read_canopies, read_mentions, read_neighbours, read_vectors
from .config import Config

#: Scheme -> tree builder over vector points.
SCHEMES = {"ehac", "mini_batch", *online.SCHEMES, "box", "facility"}


def clusters_of(tree: DataFrame, threshold: float) -> DataFrame:
    """(canopy, leaf, pid, label, threshold_cluster, best_cluster) of the trees of all canopies."""
    name = lambda c: F.concat_ws("/", "canopy", c).alias(c)
    return trees_sql.partitions(tree, threshold).select("canopy", name("leaf"), "pid", "label", name("threshold_cluster"), name("best_cluster"), "best_f1")


def mention_tree(mentions: DataFrame, config: Config, fitted: dict) -> DataFrame:
    """The trees of mentions (mid, gt, canopy, attrs[, tes]) under a pair model and a merge model."""
    merge = fitted.get("merge") or {}
    _, kind = COMPOSITES.get(config.model, (None, config.merge_model))
    batch = config.mini_batch if config.clustering_scheme == "mini_batch" else None
    budget = config.best_pair_budget if config.sample_pairs else None
    if merge.get("weights") is None and not merge.get("bias") and batch is None and not budget:
        return single.model_trees(mentions, fitted["pair"])  # the best cross pair decides
    both = pairs.canopy_pairs(mentions)
    scored = training.score_pairs(both, fitted["pair"]).select(F.col("a_canopy").alias("canopy"), F.col("a_mid").alias("a"), F.col("b_mid").alias("b"), "score")
    members = mentions.select("canopy", F.col("mid").alias("pid"), F.col("gt").alias("label"), *[c for c in ("attrs", "tes") if c in mentions.columns])
    return entities.agglomerate_entities(
        scored, members, model=kind, weights=merge.get("weights"), bias=merge.get("bias", 0.0), squash=config.expit_e_score,
        budget=budget, mini_batch_size=batch,
    )


def vector_tree(points: DataFrame, config: Config, preset: DataFrame | None = None) -> DataFrame:
    """The trees of points (canopy, pid, label, vec) by the settings' scheme and linkage."""
    if config.clustering_scheme not in SCHEMES:
        raise ValueError(f"no such scheme: {config.clustering_scheme}")
    order = "pid"
    if config.random_order:
        points, order = points.withColumn("pos", F.xxhash64("pid", F.lit(config.seed))), "pos"
    if config.clustering_scheme in ("ehac", "mini_batch"):
        batch = config.mini_batch if config.clustering_scheme == "mini_batch" else None
        return hac.agglomerate(points, linkage=config.linkage, order=order, mini_batch_size=batch)
    options: dict = {}
    if config.clustering_scheme in online.SCHEMES:
        options = {"k": config.nn_k, "roots": config.nsw_r, "exact_nn": config.exact_nn, "max_rotate": config.max_node_rotate_size, "max_graft": config.max_node_graft_size}
        if preset is not None:
            points = pairs.preset_neighbours(points, preset)
    return online.cluster(points, scheme=config.clustering_scheme, linkage=config.linkage, order=order, **options)


def run(spark: SparkSession, config: Config, out: str | None = None) -> DataFrame:
    """One row a canopy: pair counts and F1 of the threshold partition, the best F1 of the tree, and the
    number of merges scored (null for vectors).  With ``out`` all files are written there: the trees,
    partitions, gold labels, metrics, micro scores, seconds and the settings themselves.

    The settings name ``mentions`` (JSON lines) or ``points`` (tab-separated vectors), a ``model_file``
    of ``training.save``, and as they like ``canopies`` and ``ordering`` (preset neighbours).
    """
    began = time.time()
    get = config.other.get
    if get("mentions"):
        data = read_mentions(spark, get("mentions"), skip_unlabeled=config.skip_unlabeled)
        data = data.withColumn("canopy", F.coalesce("canopy", F.lit("all")))
    else:
        data = read_vectors(spark, get("points")).withColumn("canopy", F.lit("all"))
    if get("canopies"):
        data = data.join(read_canopies(spark, get("canopies")), "canopy", "left_semi")
    if get("mentions"):
        fitted = training.load(spark, get("model_file")) if get("model_file") else {"pair": {"model": config.pair_model, "weights": get("weights", {}), "bias": get("bias", 0.0)}}
        tree = cut(mention_tree(cut(data), config, fitted))
    else:
        tree = cut(vector_tree(data, config, read_neighbours(spark, get("ordering")) if get("ordering") else None))
    found = cut(clusters_of(tree, config.partition_threshold))
    cells = metrics.contingency(found, "threshold_cluster", "label", "canopy")
    best = found.groupBy("canopy").agg(F.max("best_f1").alias("best_f1"), F.count("*").alias("n_mentions"))
    scored = tree.groupBy("canopy").agg(F.max("computations").alias("computations")) if "computations" in tree.columns else best.select("canopy", F.lit(None).cast("long").alias("computations"))
    rows = best.join(metrics.pairwise_f1(metrics.pair_counts(cells, "canopy")), "canopy", "left").join(scored, "canopy")
    if out:
        sinks.write_tree(tree, f"{out}/tree")
        for name, col in (("threshold", "threshold_cluster"), ("best", "best_cluster"), ("gold", "label")):
            sinks.write_clusters(found.select("pid", F.coalesce(col, F.lit("None")).alias("cluster")), f"{out}/{name}", "pid")
        sinks.write_metrics(rows, f"{out}/metrics")
        sinks.write_metrics(metrics.micro_f1(rows.select("tp", "fp", "gt")), f"{out}/micro")
        sinks.write_metrics(spark.createDataFrame([(time.time() - began,)], "seconds double"), f"{out}/time")
        settings = [(line,) for line in config.json().splitlines()]
        spark.createDataFrame(settings, "value string").coalesce(1).write.mode("overwrite").text(f"{out}/config")
    return rows
