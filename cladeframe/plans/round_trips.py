"""Queries that write a format and read it again: readers, writers, run files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import metrics, pairs, trees_sql
from ..session import cut, shared_dir
from ..sources import sinks, tables
from ..sources.tables import table
from .config import Config
from .registry import query


def _file(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _written(spark, lines: DataFrame, tag: str) -> str:
    """The place of the text lines (column ``value``)."""
    path = _file(spark, tag)
    lines.write.text(path)
    return path


@query("""
SELECT CAST(vec_id AS VARCHAR) AS pid, CAST(label AS VARCHAR) AS label, len(embedding) AS n, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings""")
def vector_file(spark, d):
    """Vectors as tab-separated lines, read as points."""
    e = table(spark, d, "embeddings")
    cells = F.concat(F.array(F.col("vec_id").cast("string"), F.col("label").cast("string")), F.transform("embedding", lambda x: x.cast("double").cast("string")))
    p = tables.read_vectors(spark, _written(spark, e.select(F.concat_ws("\t", cells).alias("value")), "vectors"))
    return p.select("pid", "label", F.size("vec").cast("long").alias("n"), F.round(S.total("vec"), 4).alias("total"))


@query("SELECT CAST(vec_id AS VARCHAR) AS pid, 100000 - vec_id AS pos, label FROM embeddings WHERE vec_id % 2 = 0")
def replay_order(spark, d):
    """Points that an order names, with their positions in it."""
    e = table(spark, d, "embeddings")
    order = _written(spark, e.where("vec_id % 2 = 0").select(F.concat_ws("\t", F.col("vec_id").cast("string"), (100000 - F.col("vec_id")).cast("string")).alias("value")), "order")
    c = F.split("value", "\t")
    order = spark.read.text(order).select(c[0].alias("pid"), c[1].cast("long").alias("pos"))
    return tables.in_order(e.select(F.col("vec_id").cast("string").alias("pid"), "label"), order).select("pid", "pos", "label")


def _mention_lines(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    attrs = F.array(F.concat(F.lit("em:"), "c_name"), F.concat(F.lit("i:a:"), F.col("c_nationkey").cast("string")), F.lit("i:"), F.lit(":x"), F.lit("none"), F.lit("k:a"), F.lit("k:a"))
    gt = F.when(F.col("c_custkey") % 4 == 0, "None").when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment"))
    m = c.select(F.struct(F.concat(F.lit("c"), "c_custkey").alias("id"), attrs.alias("attrs"), F.array().cast("array<string>").alias("pack"), gt.alias("gt"), F.when(F.col("c_custkey") % 10 == 0, "ten").alias("gt-dblp")).alias("m"))
    return m.select(F.to_json("m").alias("value"))


_SQL_MENTIONS = """SELECT 'c' || c_custkey AS mid, CASE WHEN c_custkey % 4 > 0 AND c_custkey % 5 > 0 THEN c_mktsegment WHEN c_custkey % 10 = 0 THEN 'ten' END AS gt,
  3 AS n_keys, c_name AS email, 'a:' || c_nationkey AS institution, 1 AS n_k FROM customer"""


def _seen(m: DataFrame) -> DataFrame:
    at = lambda k: F.get(S.items("attrs", k), F.lit(0))
    return m.select("mid", "gt", F.size("attrs").alias("n_keys"), at("em").alias("email"), at("i").alias("institution"), F.size(S.items("attrs", "k")).alias("n_k"))


@query(_SQL_MENTIONS)
def mention_file(spark, d):
    """Mentions as JSON lines, with both kinds of label, entries to skip and repeated ones."""
    return _seen(tables.read_mentions(spark, _written(spark, _mention_lines(spark, d), "mentions")))


@query(f"SELECT * FROM ({_SQL_MENTIONS}) WHERE gt IS NOT NULL")
def labelled_mention_lines(spark, d):
    """Single mention lines, those without a label skipped."""
    return _seen(tables.mentions(_mention_lines(spark, d), skip_unlabeled=True))


@query("""
SELECT '{"id":' || c_custkey || '}' AS m1, CASE WHEN c_custkey % 7 > 0 THEN '{"id":"x"}' END AS m2, CASE WHEN c_custkey % 7 > 0 THEN CAST(c_custkey % 2 AS DOUBLE) END AS label, c_custkey % 7 = 0 OR c_custkey % 11 = 0 AS bad FROM customer""")
def labelled_pair_file(spark, d):
    """Labelled pairs as lines; those of one column or four are marked."""
    k = F.col("c_custkey")
    line = F.concat(F.lit('{"id":'), k.cast("string"), F.lit("}"))
    full = F.concat_ws("\t", line, F.lit('{"id":"x"}'), (k % 2).cast("string"))
    line = F.when(k % 7 == 0, line).when(k % 11 == 0, F.concat_ws("\t", full, F.lit("more"))).otherwise(full)
    return tables.read_labelled_pairs(spark, _written(spark, table(spark, d, "customer").select(line.alias("value")), "pairs"))


@query("""
SELECT 'stop' AS kind, w, CAST(NULL AS DOUBLE) AS idf FROM (SELECT DISTINCT lower(n_name) AS w FROM nation)
UNION ALL SELECT 'idf', lower(n_name), n_nationkey / 4e0 FROM nation
UNION ALL SELECT 'canopy', n_name, NULL FROM nation WHERE n_regionkey = 1""")
def word_files(spark, d):
    """Stop words, word weights and canopy names, one a line; the canopies select nations."""
    n = table(spark, d, "nation")
    stop = tables.read_stop_words(spark, _written(spark, n.select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("value")).union(n.select(F.lit("").alias("value"))), "stop"))
    idf = tables.read_idf(spark, _written(spark, n.select(F.concat_ws("\t", F.lower("n_name"), (F.col("n_nationkey") / 4).cast("string")).alias("value")), "idf"))
    some = tables.read_canopies(spark, _written(spark, n.where("n_regionkey = 1").select(F.col("n_name").alias("value")), "canopies"))
    chosen = tables.of_canopies(n.select(F.col("n_name").alias("canopy")), some)
    none = F.lit(None).cast("double")
    return stop.select(F.lit("stop").alias("kind"), "w", none.alias("idf")).union(idf.select(F.lit("idf"), "w", "idf")).union(chosen.select(F.lit("canopy"), "canopy", none))


@query("SELECT CAST(vec_id AS VARCHAR) AS pid, CASE WHEN vec_id > 0 THEN CAST(vec_id // 2 AS VARCHAR) END AS nn FROM embeddings")
def neighbour_file(spark, d):
    """Preset neighbours as lines; the first point has none."""
    i = F.col("vec_id")
    return tables.read_neighbours(spark, _written(spark, table(spark, d, "embeddings").select(F.concat_ws("\t", i.cast("string"), F.when(i > 0, F.floor(i / 2).cast("string")).otherwise("none")).alias("value")), "neighbours"))


_HEAP = """
sz AS (SELECT count(*) AS n FROM embeddings),
leaf AS (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 + n AS INTEGER) AS node, label, vec_id FROM embeddings, sz)"""


@query("WITH" + _HEAP + """
SELECT 'p' || vec_id || chr(9) || CASE WHEN node > 1 THEN CAST(node // 2 AS VARCHAR) ELSE 'None' END || chr(9) || coalesce(CAST(label AS VARCHAR), 'None') AS value FROM leaf
UNION ALL SELECT CAST(i AS VARCHAR) || chr(9) || CASE WHEN i > 1 THEN CAST(i // 2 AS VARCHAR) ELSE 'None' END || chr(9) || 'None' FROM sz, range(1, n) t(i)""")
def tree_file(spark, d):
    """The lines of a tree's file: node, parent and label, breadth first."""
    from .catalogue import _heap

    t = cut(_heap(spark, d))
    n = t.where("is_leaf").agg(F.min("node")).first()[0]
    ids = table(spark, d, "embeddings").select(F.concat(F.lit("p"), "vec_id").alias("pid"), F.row_number().over(_by_id()).alias("r"))  # a fixture of one task
    t = t.withColumn("depth", F.floor(F.log2("node"))).join(ids.withColumn("node", F.col("r") - 1 + F.lit(n)).select("node", "pid"), "node", "left")
    path = _file(spark, "tree")
    sinks.write_tree(t, path)
    return spark.read.text(path)


def _by_id():
    from pyspark.sql import Window

    return Window.orderBy("vec_id")


def _partition_files(spark, d, k: int) -> tuple[str, str]:
    """Files of a partition of the k-th third of the vectors, and of their gold labels."""
    e = table(spark, d, "embeddings").where(F.col("vec_id") % 3 == k)
    predicted, gold = _file(spark, "predicted"), _file(spark, "gold")
    sinks.write_clusters(e.select(F.col("vec_id").alias("mid"), (F.col("vec_id") % 7).alias("cluster")), predicted)
    sinks.write_clusters(e.select(F.col("vec_id").alias("mid"), F.when(F.col("vec_id") % 5 == 0, "None").otherwise(F.col("label").cast("string")).alias("cluster")), gold)
    return predicted, gold


@query("""
WITH e AS (SELECT vec_id % 3 AS run, vec_id % 7 AS cluster, label FROM embeddings WHERE vec_id % 5 > 0),
c AS (SELECT run, cluster, label, count(*) AS n FROM e GROUP BY 1, 2, 3),
s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS tp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY run, cluster)) AS pp,
  (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY run, label)) AS gt)
SELECT CAST(tp AS BIGINT) AS tp, CAST(pp - tp AS BIGINT) AS fp, CAST(gt AS BIGINT) AS gt, round(tp / pp, 6) AS precision, round(tp / gt, 6) AS recall, round(2 * tp / (gt + pp), 6) AS f1 FROM s""")
def micro_f1_over_files(spark, d):
    """Micro scores over the files of three runs; mentions without a gold label are dropped."""
    m = metrics.micro_over_files(spark, [_partition_files(spark, d, k) for k in range(3)])
    return m.select(*[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "gt")], *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("""
SELECT CAST(vec_id AS VARCHAR) AS mid, CAST(vec_id % 7 AS VARCHAR) AS cluster, CASE WHEN vec_id % 5 > 0 THEN CAST(label AS VARCHAR) END AS label FROM embeddings WHERE vec_id % 3 = 1""")
def partition_files(spark, d):
    """Predicted clusters as lines, restricted to what the gold file names."""
    predicted, gold = _partition_files(spark, d, 1)
    return metrics.restrict_to_gold(tables.read_clusters(spark, predicted), tables.read_clusters(spark, gold).select("mid", F.col("cluster").alias("label")))


@query("""
SELECT label, count(*) AS n, count(*) FILTER (vec_id % 7 = 0) AS zero FROM embeddings GROUP BY label""")
def metric_file(spark, d):
    """A table of figures as a headed file, read again."""
    path = _file(spark, "metrics")
    e = table(spark, d, "embeddings")
    sinks.write_metrics(e.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(F.col("vec_id") % 7 == 0, 1)).alias("zero")), path)
    return spark.read.csv(path, sep="\t", header=True, schema="label int, n long, zero long")


@query("SELECT CAST(least(greatest(floor((l_quantity - 5) / 40 * 8), 0), 7) AS INTEGER) AS bin, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY 1")
def quantity_histogram(spark, d):
    """Counts for a plot, values beyond the ends in the last bins."""
    return sinks.histogram(table(spark, d, "lineitem"), "l_quantity", 8, 5, 45)


@query("""
SELECT 'graph nn {' || chr(10) || string_agg('  "' || a || '" -- "' || b || '";', chr(10) ORDER BY a, b) || chr(10) || '}' AS drawing FROM (
  SELECT DISTINCT least(n_name, r_name) AS a, greatest(n_name, r_name) AS b FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def drawn_graph(spark, d):
    """A drawing of the graph of nations and regions, each pair once."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    e = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return spark.createDataFrame([(sinks.dot_graph(e.union(e.select("dst", "src"))),)], "drawing string")


@query("""
WITH t AS (SELECT n_nationkey + 1 AS node, CASE WHEN n_nationkey > 0 THEN (n_nationkey + 1) // 2 END AS parent, n_name AS label FROM nation)
SELECT 'digraph tree {' || chr(10) || (SELECT string_agg('  n' || node || ' [label="' || node || '\\n' || label || '"];', chr(10) ORDER BY node) FROM t) || chr(10)
  || (SELECT string_agg('  n' || parent || ' -> n' || node || ';', chr(10) ORDER BY node) FROM t WHERE parent IS NOT NULL) || chr(10) || '}' AS drawing""".replace("\\\\", "\\"))
def drawn_tree(spark, d):
    """A drawing of a heap of nations."""
    i = F.col("n_nationkey") + 1
    t = table(spark, d, "nation").select(i.alias("node"), F.when(i > 1, F.floor(i / 2)).alias("parent"), F.col("n_name").alias("label"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("is_leaf"))
    return spark.createDataFrame([(sinks.dot_tree(t),)], "drawing string")


@query("""
SELECT scheme, k, 1451 AS seed, 'kept' AS note FROM (VALUES ('greedy'), ('rotate'), ('graft')) a(scheme), (VALUES (5), (10)) b(k)""")
def settings_grid(spark, d):
    """One setting for each combination of choices, as written and read again; unknown keys are kept."""
    grid = Config.of({"nn_k": 3, "note": "kept"}).grid(clustering_scheme=["greedy", "rotate", "graft"], nn_k=[5, 10])
    rows = [json.loads(c.json()) for c in grid]
    return spark.createDataFrame([(r["clustering_scheme"], r["nn_k"], r["seed"], r["note"]) for r in rows], "scheme string, k int, seed int, note string")


@query("""
WITH d AS (
  SELECT a.vec_id AS pid, b.vec_id AS nbr, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY distance, nbr) AS rank FROM d)
SELECT pid, nbr, round(distance, 4) AS distance, rank FROM r WHERE rank <= 4""")
def best_of_two_searches(spark, d):
    """The best four neighbours from searches among the even and among the odd points."""
    from .catalogue import _points

    p = cut(_points(spark, d))
    even, odd = (pairs.knn(p, p.where(F.col("pid") % 2 == k), 4) for k in (0, 1))
    return pairs.keep_best(even, odd, 4).select("pid", "nbr", F.round("distance", 4).alias("distance"), "rank")


@query("""
SELECT o_custkey AS a, o_orderkey AS b, CASE WHEN o_orderkey % 4 = 0 THEN 1e0 ELSE 0e0 END AS overlap,
  CASE WHEN o_orderkey % 4 = 0 THEN 0.5e0 ELSE 0e0 END AS set_cosine, CASE WHEN o_orderkey % 4 = 0 THEN 0.5e0 ELSE 0e0 END AS jaccard FROM orders""")
def set_pair_features(spark, d):
    """Overlap, set cosine and Jaccard of two sets a row."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b"), F.array(F.lit("x"), F.lit("y")).alias("p"), F.array(F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise("z")).alias("q"))
    return pairs.set_features(o, "p", "q").drop("p", "q")


@query("WITH RECURSIVE" + _HEAP + """,
up AS (SELECT node AS leaf, node AS node FROM leaf UNION ALL SELECT leaf, CAST(node // 2 AS INTEGER) FROM up WHERE node > 1)
SELECT node, leaf FROM up WHERE leaf % 3 > 0""")
def leaves_without(spark, d):
    """The leaves under each node, but for every third leaf."""
    from .catalogue import _heap

    t = cut(_heap(spark, d))
    barred = t.where("is_leaf and node % 3 = 0").select(F.col("node").alias("leaf"))
    return trees_sql.leaves_excluding(trees_sql.leaves(trees_sql.closure(t), t), barred)


@query("WITH RECURSIVE" + _HEAP + """,
up AS (SELECT node AS top, CAST(label AS BIGINT) AS v FROM leaf UNION ALL SELECT CAST(top // 2 AS INTEGER), v FROM up WHERE top > 1)
SELECT top AS node, CAST(sum(v) AS BIGINT) AS labels, count(*) AS n FROM up GROUP BY top""")
def subtree_sums(spark, d):
    """Sums of a leaf column over each node's subtree."""
    from .catalogue import _heap

    t = cut(_heap(spark, d))
    v = t.where("is_leaf").select("node", F.col("label").cast("long").alias("labels"), F.lit(1).alias("n"))
    return trees_sql.subtree_totals(trees_sql.closure(t), v, "labels", "n")
