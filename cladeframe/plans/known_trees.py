"""Queries of trees whose clusters another way of computing knows: components, separated lines, heaps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import hac, online, single, training, trees_sql
from ..session import cut, shared_dir
from ..sources.tables import separated_line
from . import mentions as M
from . import run as R
from .config import Config
from .registry import query

#: The schemes that must recover a line of separated halves, and how each is called.
LINE = {
    "ehac_average": ("ehac", "average"), "ehac_single": ("ehac", "single"), "ehac_complete": ("ehac", "complete"), "ehac_centroid": ("ehac", "centroid"),
    "mini_batch": ("mini_batch", "centroid"), "box": ("box", "centroid"),
}


@query("SELECT scheme, 1e0 AS purity, 64 AS n_leaves, 127 AS n_nodes, 1 AS n_roots, 63 AS n_pairs_of_children FROM (VALUES " + ", ".join(f"('{k}')" for k in LINE) + ") t(scheme)")
def separated_line_trees(spark, d):
    """Every scheme builds, on a line of 64 points whose halves lie apart, a binary tree in which each
    half is one subtree: purity one."""
    points = separated_line(spark, 7).withColumn("pid", F.lpad("pid", 4, "0"))
    made = None
    for name, (scheme, linkage) in LINE.items():
        p = points.withColumn("canopy", F.lit(name))
        if scheme in ("ehac", "mini_batch"):
            t = hac.agglomerate(p, linkage=linkage, mini_batch_size=12 if scheme == "mini_batch" else None)
        else:
            t = online.cluster(p, scheme=scheme, linkage=linkage)
        made = t if made is None else made.union(t)
    t = cut(made.select(F.col("canopy").alias("scheme"), F.concat_ws("/", "canopy", "node").alias("node"), F.when(F.col("parent").isNotNull(), F.concat_ws("/", "canopy", "parent")).alias("parent"), "is_leaf", "label"))
    shape = t.groupBy("scheme").agg(F.count(F.when(F.col("is_leaf"), 1)).alias("n_leaves"), F.count("*").alias("n_nodes"), F.count(F.when(F.col("parent").isNull(), 1)).alias("n_roots"))
    twos = t.where("parent is not null").groupBy("scheme", "parent").agg(F.count("*").alias("n")).where("n = 2").groupBy("scheme").agg(F.count("*").alias("n_pairs_of_children"))
    up = cut(trees_sql.closure(t))
    pure = trees_sql.dendrogram_purity(up, t, trees_sql.class_counts(up, t), "scheme").select("scheme", F.round("purity", 9).alias("purity"))
    return pure.join(shape, "scheme").join(twos, "scheme")


_SQL_LABEL_NEAR = """
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3),
sym AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, e.b FROM reach r JOIN sym e ON r.y = e.a)"""


@query("WITH RECURSIVE" + _SQL_LABEL_NEAR + " SELECT x AS pid, min(y) AS cluster FROM reach GROUP BY x")
def learned_tree_cut(spark, d):
    """Exact clustering under the untrained merge model (the best cross pair) of each label's points, cut
    at 0.3: the components of the pairs that score at least that, label by label."""
    from .catalogue import _points

    p = _points(spark, d).withColumn("canopy", F.col("label").cast("string"))
    t = single.cosine_trees(p.select("canopy", "pid", F.col("canopy").alias("label"), "vec"))
    return _least_members(t, 0.3)


def _least_members(tree: DataFrame, t: float) -> DataFrame:
    """(pid, cluster): threshold clusters of the trees of all canopies, named by their least member."""
    found = cut(R.clusters_of(tree, t).select(F.col("pid").cast("long").alias("pid"), "threshold_cluster"))
    least = found.groupBy("threshold_cluster").agg(F.min("pid").alias("cluster"))
    return found.join(least, "threshold_cluster").select("pid", "cluster")


#: A heap over all vectors, its class counts, and choices from the last inner node up as lists.
_HEAP = """
sz AS (SELECT CAST(count(*) AS INTEGER) AS n FROM embeddings),
leaf AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 + n AS INTEGER) AS node, label FROM embeddings, sz),
up AS (SELECT node AS leaf, node, label, 0 AS dist FROM leaf UNION ALL SELECT leaf, CAST(node // 2 AS INTEGER), label, dist + 1 FROM up WHERE node > 1),
cc AS (SELECT node, label, count(*) AS c FROM up GROUP BY 1, 2),
wh AS (SELECT node, sum(c * (c - 1) / 2) AS tp, sum(c) * (sum(c) - 1) / 2 - sum(c * (c - 1) / 2) AS fp FROM cc GROUP BY 1),
gt AS (SELECT sum(c * (c - 1) / 2) AS gt FROM cc WHERE node = 1)"""
_CHOSEN = """,
top AS (SELECT up.leaf, arg_max(up.node, up.dist) AS cluster FROM up LEFT JOIN took ON took.k = up.node WHERE up.dist = 0 OR took.k IS NOT NULL GROUP BY 1),
pc AS (SELECT t.cluster, l.label, count(*) AS c FROM top t JOIN leaf l ON l.node = t.leaf GROUP BY 1, 2),
sc AS (SELECT (SELECT sum(c * (c - 1) / 2) FROM pc) AS tp, (SELECT sum(c * (c - 1) / 2) FROM (SELECT sum(c) AS c FROM pc GROUP BY cluster)) AS pp)
SELECT 'heap' AS tree, CAST(leaf AS BIGINT) AS leaf, CAST(cluster AS BIGINT) AS cluster, round(2 * tp / CAST(gt + pp AS DOUBLE), 6) AS best_f1 FROM top, sc, gt"""


def _cut_of(cut_by, spark, d) -> DataFrame:
    from .catalogue import _heap

    return cut_by(_heap(spark, d).withColumn("canopy", F.lit("heap"))).withColumn("best_f1", F.round("best_f1", 6))


@query("WITH RECURSIVE" + _HEAP + """,
r AS (
  SELECT n - 1 AS k, list_transform(range(0, 2 * n), lambda i: 0e0) AS best FROM sz
  UNION ALL SELECT k - 1, list_transform(range(1, len(best) + 1), lambda i: CASE WHEN i = k THEN greatest((k * 37) % 101 / 100e0, best[2 * k] + best[2 * k + 1]) ELSE best[i] END) FROM r WHERE k > 0),
took AS (SELECT x.k FROM (SELECT best FROM r WHERE k = 0) f, sz, LATERAL (SELECT unnest(range(1, n)) AS k) x WHERE (x.k * 37) % 101 / 100e0 > best[2 * x.k] + best[2 * x.k + 1])""" + _CHOSEN)
def heap_of_scores_cut(spark, d):
    """The partition that the scores of a heap prefer: a node is whole where its score exceeds the sum of
    the best of its children."""
    return _cut_of(trees_sql.predicted_cut, spark, d)


@query("WITH RECURSIVE" + _HEAP + """,
w AS (SELECT list(tp ORDER BY node) AS wtp, list(fp ORDER BY node) AS wfp FROM wh),
r AS (
  SELECT n - 1 AS k, list_transform(range(0, 2 * n), lambda i: 0e0) AS tp, list_transform(range(0, 2 * n), lambda i: 0e0) AS fp, FALSE AS whole FROM sz
  UNION ALL SELECT k - 1, list_transform(range(1, len(tp) + 1), lambda i: CASE WHEN i <> k THEN tp[i] WHEN taken THEN wtp[k] ELSE tp[2 * k] + tp[2 * k + 1] END),
    list_transform(range(1, len(fp) + 1), lambda i: CASE WHEN i <> k THEN fp[i] WHEN taken THEN wfp[k] ELSE fp[2 * k] + fp[2 * k + 1] END), taken
  FROM (SELECT r.k, r.tp, r.fp, w.wtp, w.wfp, CASE WHEN gt + wtp[k] + wfp[k] > 0 THEN 2 * wtp[k] / CAST(gt + wtp[k] + wfp[k] AS DOUBLE) ELSE 0 END
      > CASE WHEN gt + tp[2 * k] + tp[2 * k + 1] + fp[2 * k] + fp[2 * k + 1] > 0 THEN 2 * (tp[2 * k] + tp[2 * k + 1]) / CAST(gt + tp[2 * k] + tp[2 * k + 1] + fp[2 * k] + fp[2 * k + 1] AS DOUBLE) ELSE 0 END AS taken
    FROM r, w, gt WHERE r.k > 0) s),
took AS (SELECT k + 1 AS k FROM r WHERE whole)""" + _CHOSEN)
def heap_best_f1_cut(spark, d):
    """The flat clusters of a heap with the best pairwise F1 that bottom-up choices reach."""
    return _cut_of(trees_sql.best_f1_cut, spark, d)


_RUN_T = 1.23456


@query("WITH RECURSIVE " + M._SQL + ",\nf AS (" + M._sql_of(M.WEIGHTS).removeprefix("WITH " + M._SQL + "\n") + f"""),
p AS (SELECT f.a, f.b FROM f WHERE {M._LINEAR} >= {_RUN_T}),
sym AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT mid AS x, mid AS y FROM m UNION SELECT r.x, e.b FROM reach r JOIN sym e ON r.y = e.a),
c AS (SELECT x AS mid, min(y) AS cluster FROM reach GROUP BY x),
cells AS (SELECT m.canopy, c.cluster, m.em[1] AS label, count(*) AS n FROM m JOIN c ON c.mid = m.mid WHERE m.mid % 6 > 0 GROUP BY 1, 2, 3),
k AS (SELECT canopy, count(*) AS n_mentions FROM m GROUP BY 1),
t AS (SELECT canopy, sum(n * (n - 1) / 2) AS tp FROM cells GROUP BY 1),
u AS (SELECT canopy, sum(n * (n - 1) / 2) AS pp FROM (SELECT canopy, sum(n) AS n FROM cells GROUP BY canopy, cluster) GROUP BY 1),
v AS (SELECT canopy, sum(n * (n - 1) / 2) AS gt FROM (SELECT canopy, sum(n) AS n FROM cells GROUP BY canopy, label) GROUP BY 1)
SELECT k.canopy, n_mentions, CAST(tp AS BIGINT) AS tp, CAST(pp - tp AS BIGINT) AS fp, CAST(gt AS BIGINT) AS gt,
  CASE WHEN pp > 0 THEN round(tp / CAST(pp AS DOUBLE), 6) ELSE 0e0 END AS precision, CASE WHEN gt > 0 THEN round(tp / CAST(gt AS DOUBLE), 6) ELSE 0e0 END AS recall,
  CASE WHEN gt + pp > 0 THEN round(2 * tp / CAST(gt + pp AS DOUBLE), 6) ELSE 0e0 END AS f1, TRUE AS best_is_no_worse FROM k JOIN t USING (canopy) JOIN u USING (canopy) JOIN v USING (canopy)""")
def configured_run(spark, d):
    """A whole run from settings: mentions and a model are written, read, scored, clustered, cut and
    measured, and every file is written.  Under the untrained merge model the threshold partition is the
    components of the pairs that score at least the threshold."""
    place = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    m = M.mentions(spark, d)
    lines = m.select(F.to_json(F.struct(
        F.col("mid").cast("string").alias("id"), "canopy", F.when(F.col("mid") % 6 == 0, "None").otherwise(F.element_at(F.element_at("attrs", "em"), 1)).alias("gt"),
        F.flatten(F.transform(F.map_entries("attrs"), lambda e: F.transform(e.value, lambda v: F.concat(e.key, F.lit(":"), v)))).alias("attrs"))).alias("value"))
    lines.write.text(f"{place}/mentions")
    training.save(spark, {"pair": {"model": "base", "weights": M.WEIGHTS, "bias": M.BIAS}}, f"{place}/model")
    config = Config.of({"mentions": f"{place}/mentions", "model_file": f"{place}/model", "partition_threshold": _RUN_T, "model": "base_sub_ent"})
    rows = R.run(spark, config, f"{place}/out")
    return rows.select(
        "canopy", "n_mentions", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "gt")],
        *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("precision", "recall", "f1")], (F.col("best_f1") >= F.col("f1") - 1e-9).alias("best_is_no_worse"))


@query("""
SELECT CAST(label AS VARCHAR) AS canopy, count(*) AS n_leaves, 2 * count(*) - 1 AS n_nodes, TRUE AS climbed FROM embeddings GROUP BY label""")
def preset_tree_shapes(spark, d):
    """Online trees with preset neighbours in a seeded order, and with counters: one binary tree a canopy."""
    from .catalogue import _canopied

    p = _canopied(spark, d).withColumn("pos", F.xxhash64("pid", F.lit(33)))
    first = Window.partitionBy("canopy").orderBy("pos", "pid")
    p = p.withColumn("nn", F.lag("pid").over(first))
    t = online.cluster(p, scheme="graft", order="pos", counts=True)
    return t.groupBy("canopy").agg(F.count(F.when(F.col("is_leaf"), 1)).alias("n_leaves"), F.count("*").alias("n_nodes"), (F.max(F.col("counts")["rotations"]) > 0).alias("climbed"))
