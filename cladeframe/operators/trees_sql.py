"""Queries over tree tables (node, parent, score, is_leaf, label[, tree]) as DataFrame plans.

``up`` is the ancestor closure by pointer doubling: rounds grow with the logarithm of the depth, its
rows with the sum of depths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop, ship, spread_groups


def closure(tree: DataFrame) -> DataFrame:
    """(descendant, ancestor, dist), each node with itself at 0."""
    one = tree.where(F.col("parent").isNotNull()).select(F.col("node").alias("descendant"), F.col("parent").alias("ancestor"), F.lit(1).alias("dist"))
    have, reach = cut(tree.select(F.col("node").alias("descendant"), F.col("node").alias("ancestor"), F.lit(0).alias("dist")).union(one)), 1
    while True:
        edge = have.where(F.col("dist") == reach).select("descendant", F.col("ancestor").alias("mid"))
        further = have.where("dist > 0").select(F.col("descendant").alias("mid"), "ancestor", F.col("dist").alias("more"))
        new = cut(edge.join(further, "mid").select("descendant", "ancestor", (F.col("more") + reach).alias("dist")))
        if not new.limit(1).count():
            drop(new)
            return have
        both = cut(have.union(new))
        drop(have, new)
        have, reach = both, reach * 2


def depth(up: DataFrame) -> DataFrame:
    return up.groupBy(F.col("descendant").alias("node")).agg(F.max("dist").alias("depth"))


def height(up: DataFrame) -> DataFrame:
    return up.groupBy(F.col("ancestor").alias("node")).agg(F.max("dist").alias("height"))


def siblings(tree: DataFrame) -> DataFrame:
    """(node, sibling)."""
    a, b = tree.select("node", "parent"), tree.select(F.col("node").alias("sibling"), "parent")
    return a.join(b, "parent").where("node <> sibling").select("node", "sibling")


def aunts(tree: DataFrame) -> DataFrame:
    """(node, aunt): siblings of the parent."""
    s = siblings(tree).select(F.col("node").alias("parent"), F.col("sibling").alias("aunt"))
    return tree.select("node", "parent").join(s, "parent").select("node", "aunt")


def root(up: DataFrame, tree: DataFrame) -> DataFrame:
    tops = tree.where(F.col("parent").isNull()).select(F.col("node").alias("ancestor"))
    return up.join(tops, "ancestor").select(F.col("descendant").alias("node"), F.col("ancestor").alias("root"))


def leaves(up: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, leaf): the leaves under each node."""
    ends = tree.where("is_leaf").select(F.col("node").alias("descendant"))
    return up.join(ends, "descendant").select(F.col("ancestor").alias("node"), F.col("descendant").alias("leaf"))


def leaves_excluding(under: DataFrame, barred: DataFrame) -> DataFrame:
    return under.join(barred, "leaf", "left_anti")


def lca(up: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, lca) of pairs of nodes: their common ancestor of least distance."""
    x = up.select(F.col("descendant").alias("a"), "ancestor", F.col("dist").alias("da"))
    y = up.select(F.col("descendant").alias("b"), "ancestor")
    both = pairs.select("a", "b").join(x, "a").join(y, ["b", "ancestor"])
    return both.groupBy("a", "b").agg(F.min(F.struct("da", "ancestor")).alias("m")).select("a", "b", F.col("m.ancestor").alias("lca"))


def class_counts(up: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, label, n): labelled leaves under each node, by label."""
    ends = tree.where("is_leaf and label is not null").select(F.col("node").alias("descendant"), "label")
    return up.join(ends, "descendant").groupBy(F.col("ancestor").alias("node"), "label").agg(F.count("*").alias("n"))


def purity(counts: DataFrame) -> DataFrame:
    """(node, purity, pure_label): share of the largest class; the label where there is one only."""
    g = counts.groupBy("node").agg(F.sum("n").alias("t"), F.max("n").alias("m"), F.count("*").alias("k"), F.min("label").alias("l"))
    return g.select("node", (F.col("m") / F.col("t")).alias("purity"), F.when(F.col("k") == 1, F.col("l")).alias("pure_label"))


def split_counts(counts: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, tp, fp): same- and other-label pairs between the children of each inner node."""
    kids = tree.where(F.col("parent").isNotNull()).select("node", "parent")
    c = counts.join(kids, "node")
    by = c.groupBy("parent", "label").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    same = by.groupBy("parent").agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("tp"))
    tot = c.groupBy("parent", "node").agg(F.sum("n").alias("n")).groupBy("parent").agg(((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))) / 2).alias("all"))
    inner = tree.where("not is_leaf").select("node")
    out = inner.join(same.join(tot, "parent"), F.col("node") == F.col("parent"), "left")
    tp = F.coalesce(F.col("tp"), F.lit(0.0)).cast("long")
    return out.select("node", tp.alias("tp"), (F.coalesce(F.col("all"), F.lit(0.0)).cast("long") - tp).alias("fp"))


def subtree_totals(up: DataFrame, values: DataFrame, *cols: str) -> DataFrame:
    """Sums of per-node columns over each node's subtree."""
    v = values.select(F.col("node").alias("descendant"), *cols)
    return up.join(v, "descendant").groupBy(F.col("ancestor").alias("node")).agg(*[F.sum(c).alias(c) for c in cols])


def subtree_minima(up: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, low): the least score among a node's inner descendants, itself included (null counts as
    the least of all); of inner nodes."""
    inner = tree.where("not is_leaf").select(F.col("node").alias("descendant"), "score")
    return up.join(inner, "descendant").groupBy(F.col("ancestor").alias("node")).agg(F.min(F.coalesce("score", F.lit(float("-inf")))).alias("low"))


def threshold_cut(up: DataFrame, tree: DataFrame, t: float) -> DataFrame:
    """(leaf, cluster): the highest node above each leaf all of whose inner descendants, itself
    included, score at least ``t``; a leaf is always admissible."""
    low = subtree_minima(up, tree)
    good = tree.join(low, "node", "left").where(F.col("is_leaf") | (F.col("low") >= t)).select(F.col("node").alias("ancestor"))
    return _highest(up, tree, good)


def marker_cut(up: DataFrame, tree: DataFrame, marked: DataFrame) -> DataFrame:
    """(leaf, cluster): the last node of the unbroken chain of marked nodes above each leaf, else the
    leaf.  Marks above an unmarked node are no cluster: ``broken_marks`` lists them."""
    ends = tree.where("is_leaf").select(F.col("node").alias("descendant"))
    inner = up.join(ends, "descendant").join(marked.select(F.col("node").alias("ancestor"), F.lit(1).alias("m")).distinct(), "ancestor", "left").where("dist > 0")
    # Of a leaf's ancestors only the root may be unmarked for the chain to reach the top.
    stop = inner.groupBy("descendant").agg(F.min(F.when(F.col("m").isNull(), F.col("dist"))).alias("stop"), F.max("dist").alias("top"))
    at = stop.select("descendant", F.coalesce(F.col("stop") - 1, F.col("top")).alias("dist"))
    chosen = up.join(at, ["descendant", "dist"]).select(F.col("descendant").alias("leaf"), F.col("ancestor").alias("cluster"))
    alone = ends.join(at, "descendant", "left_anti").select(F.col("descendant").alias("leaf"), F.col("descendant").alias("cluster"))
    return chosen.union(alone)


def broken_marks(up: DataFrame, marked: DataFrame, tree: DataFrame) -> DataFrame:
    """(node, above): inner nodes without a mark, and the marked nodes above them."""
    bare = tree.where("not is_leaf").select("node").join(marked.select("node"), "node", "left_anti")
    over = up.where("dist > 0").join(marked.select(F.col("node").alias("ancestor")), "ancestor")
    return over.join(bare, over.descendant == bare.node).select("node", F.col("ancestor").alias("above"))


def _highest(up: DataFrame, tree: DataFrame, good: DataFrame) -> DataFrame:
    ends = tree.where("is_leaf").select(F.col("node").alias("descendant"))
    top = up.join(ends, "descendant").join(good, "ancestor")
    return top.groupBy(F.col("descendant").alias("leaf")).agg(F.max(F.struct("dist", "ancestor")).alias("m")).select("leaf", F.col("m.ancestor").alias("cluster"))


def dendrogram_purity(up: DataFrame, tree: DataFrame, counts: DataFrame, *by: str) -> DataFrame:
    """([by,] purity): mean, over pairs of leaves of a class, of the class's share under their LCA; one
    for each value of columns that ``tree`` has, whose trees share no node."""
    split = counts.join(tree.where(F.col("parent").isNotNull()).select("node", "parent"), "node")
    between = split.groupBy("parent", "label").agg(((F.pow(F.sum("n"), F.lit(2)) - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"))
    total = leaves(up, tree).groupBy("node").agg(F.count("*").alias("n_all"))
    share = counts.join(total, "node").select(F.col("node").alias("parent"), "label", (F.col("n") / F.col("n_all")).alias("share"))
    got = between.join(share, ["parent", "label"])
    mean = (F.sum(F.col("pairs") * F.col("share")) / F.sum("pairs")).alias("purity")
    return got.join(tree.select(F.col("node").alias("parent"), *by), "parent").groupBy(*by).agg(mean) if by else got.agg(mean)


def cut_values(up: DataFrame, tree: DataFrame, splits: DataFrame) -> DataFrame:
    """(score, tp, fp) for ``threshold_sweep``: the pairs that join when a node is in a cluster, which a
    threshold cut allows up to the least score of its subtree."""
    return subtree_minima(up, tree).withColumnRenamed("low", "score").join(splits, "node").select("score", "tp", "fp")


def threshold_sweep(values: DataFrame, gt_pairs: Column | float) -> DataFrame:
    """(t, tp, fp, f1) for every distinct score t of (score, tp, fp): all rows that score at least t
    are taken.  For the cuts of a tree, score must be the least of a node's subtree (``cut_values``).

    Scores are summed up and dealt out by ranges; the running sums of a range start from the totals
    of the higher ones, one row a range, so no task sees all scores."""
    from pyspark.sql import Window

    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = values.groupBy("score").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))
    by = cut(by.repartitionByRange(n, F.desc("score")).withColumn("part", F.spark_partition_id()))
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = by.groupBy("part").agg(F.sum("tp").alias("tps"), F.sum("fp").alias("fps"))
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(c) for c in ("tps", "fps")])
    w = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = by.join(F.broadcast(sums), "part").select(F.col("score").alias("t"), (F.col("tps") + F.sum("tp").over(w)).alias("tp"), (F.col("fps") + F.sum("fp").over(w)).alias("fp"))
    gt = gt_pairs if isinstance(gt_pairs, Column) else F.lit(gt_pairs)
    d = gt + F.col("tp") + F.col("fp")
    return run.withColumn("f1", F.when(d > 0, 2 * F.col("tp") / d).otherwise(F.lit(0.0)))


BEST = "tree string, leaf long, cluster long, best_f1 double"


def _below(pdf: pd.DataFrame) -> tuple[list[int], dict[int, list[int]]]:
    """Nodes with children first, and the children of each node."""
    kids: dict[int, list[int]] = {}
    for n, p in zip(pdf["node"], pdf["parent"]):
        if not pd.isna(p):
            kids.setdefault(int(p), []).append(int(n))
    order, todo = [], [int(n) for n, p in zip(pdf["node"], pdf["parent"]) if pd.isna(p)]
    while todo:
        k = todo.pop()
        order.append(k)
        todo.extend(kids.get(k, ()))
    return order[::-1], kids


def best_partition(pdf: pd.DataFrame, worth=None) -> tuple[dict[int, int], float]:
    """(leaf -> cluster node, F1) of the flat clustering of a tree with the best pairwise F1 among
    those that bottom-up choices reach: a node is taken whole if that beats its children's best
    choice strictly.  With ``worth`` (node -> value) the sum of values is compared instead."""
    order, kids = _below(pdf)
    label = {int(n): (None if pd.isna(v) else v) for n, v in zip(pdf["node"], pdf["label"])}
    # Of a subtree: labelled leaves by label and in all, same- and other-label pairs, and the best choice.
    count: dict[int, tuple[dict, int]] = {}
    whole: dict[int, tuple[int, int]] = {}
    best: dict[int, tuple[int, int, float]] = {}
    taken: set[int] = set()
    every: dict = {}
    for k in order:
        if k not in kids and label[k] is not None:
            every[label[k]] = every.get(label[k], 0) + 1
    gt = sum(v * (v - 1) // 2 for v in every.values())
    f1 = lambda tp, fp: 2 * tp / (gt + tp + fp) if gt + tp + fp else 0.0
    for k in order:
        if k not in kids:
            count[k] = ({label[k]: 1}, 1) if label[k] is not None else ({}, 0)
            whole[k], best[k] = (0, 0), (0, 0, worth(k) if worth else 0.0)
            taken.add(k)
            continue
        mine, n, tp, fp = {}, 0, 0, 0
        for c in kids[k]:
            (other, m), (t, f) = count.pop(c), whole.pop(c)
            if len(other) > len(mine):
                mine, other = other, mine
            same = sum(v * mine.get(x, 0) for x, v in other.items())
            for x, v in other.items():
                mine[x] = mine.get(x, 0) + v
            tp, fp, n = tp + t + same, fp + f + n * m - same, n + m
        count[k], whole[k] = (mine, n), (tp, fp)
        ctp, cfp, cw = (sum(best[c][i] for c in kids[k]) for i in range(3))
        take = worth(k) > cw if worth else f1(tp, fp) > f1(ctp, cfp)
        best[k] = (tp, fp, worth(k) if worth else 0.0) if take else (ctp, cfp, cw)
        if take:
            taken.add(k)
    tops = [int(n) for n, p in zip(pdf["node"], pdf["parent"]) if pd.isna(p)]
    out: dict[int, int] = {}
    tp, fp = sum(best[r][0] for r in tops), sum(best[r][1] for r in tops)
    todo = [(r, None) for r in tops]
    while todo:
        k, at = todo.pop()
        at = k if at is None and k in taken else at
        if k in kids:
            todo.extend((c, at) for c in kids[k])
        else:
            out[k] = at
    return out, f1(tp, fp)


def threshold_partition(pdf: pd.DataFrame, t: float) -> dict[int, int]:
    """Leaf -> cluster node of one tree: ``threshold_cut`` in one pass up and one down."""
    order, kids = _below(pdf)
    score = {int(n): (float("-inf") if pd.isna(s) else float(s)) for n, s in zip(pdf["node"], pdf["score"])}
    low: dict[int, float] = {}
    for k in order:
        low[k] = min(score[k], *(low[c] for c in kids[k])) if k in kids else float("inf")
    at: dict[int, int | None] = {}
    for k in reversed(order):
        top = at.get(k)
        top = k if top is None and (k not in kids or low[k] >= t) else top
        at[k] = top
        for c in kids.get(k, ()):
            at[c] = top
    return {k: at[k] for k in order if k not in kids}


def best_f1_cut(tree: DataFrame, by: str = "canopy") -> DataFrame:
    """(tree, leaf, cluster, best_f1) for each tree of a table."""
    ship(tree.sparkSession)

    def run(key, pdf):
        got, f1 = best_partition(pdf)
        return pd.DataFrame([(key[0], a, b, f1) for a, b in sorted(got.items())], columns=["tree", "leaf", "cluster", "best_f1"])

    return tree.select(F.col(by).cast("string").alias("tree"), "node", "parent", "label").groupBy("tree").applyInPandas(run, BEST)


BOTH = "canopy string, leaf long, pid string, label string, threshold_cluster long, best_cluster long, best_f1 double"


def partitions(tree: DataFrame, t: float) -> DataFrame:
    """BOTH rows of the trees of all canopies: the clusters of ``threshold_cut`` and of ``best_f1_cut``, one tree
    a task and in time that does not grow with its depth."""
    ship(tree.sparkSession)

    def run(key, pdf):
        flat, (best, f1) = threshold_partition(pdf, t), best_partition(pdf)
        ends = pdf[pdf["is_leaf"]]
        ids = [int(n) for n in ends["node"]]
        return pd.DataFrame({"canopy": key[0], "leaf": ids, "pid": ends["pid"].to_numpy(), "label": ends["label"].to_numpy(), "threshold_cluster": [flat[k] for k in ids], "best_cluster": [best[k] for k in ids], "best_f1": f1})

    rows = tree.select(F.col("canopy").cast("string").alias("canopy"), "node", "parent", "score", "is_leaf", "pid", "label")
    return spread_groups(rows, "canopy").groupBy("canopy").applyInPandas(run, BOTH)


def predicted_cut(tree: DataFrame, by: str = "canopy") -> DataFrame:
    """The partition that the scores themselves prefer: a node is whole where its score exceeds the
    sum of its children's."""
    ship(tree.sparkSession)

    def run(key, pdf):
        score = {int(n): (0.0 if pd.isna(s) else float(s)) for n, s in zip(pdf["node"], pdf["score"])}
        got, f1 = best_partition(pdf, score.get)
        return pd.DataFrame([(key[0], a, b, f1) for a, b in sorted(got.items())], columns=["tree", "leaf", "cluster", "best_f1"])

    return tree.select(F.col(by).cast("string").alias("tree"), "node", "parent", "label", "score").groupBy("tree").applyInPandas(run, BEST)
