"""Writers: trees, clusters, metrics and drawings."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DRAWN = 499


def tree_lines(tree: DataFrame) -> DataFrame:
    """``node, parent, label`` lines of a tree table, in breadth-first order; a root's parent is None."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    name = F.coalesce(F.col("pid").cast("string"), F.col("node").cast("string")) if "pid" in tree.columns else F.col("node").cast("string")
    return tree.orderBy("depth", "node").select(F.concat_ws("\t", name, cell("parent"), cell("label")).alias("value"))


def write_tree(tree: DataFrame, path: str) -> None:
    tree_lines(tree).write.mode("overwrite").text(path)


def write_clusters(clusters: DataFrame, path: str, mid: str = "mid", cluster: str = "cluster") -> None:
    clusters.select(F.concat_ws("\t", F.col(mid).cast("string"), F.col(cluster).cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def dot_tree(tree: DataFrame, limit: int = DRAWN) -> str | None:
    """A DOT drawing of a tree of at most ``limit`` leaves, else None; the size is checked first."""
    if tree.where("is_leaf").limit(limit + 1).count() > limit:
        return None
    rows = sorted(tree.select("node", "parent", "label", "score").collect(), key=lambda r: r["node"])
    shown = lambda r: f"{r['node']}\\n{r['label'] if r['label'] is not None else ''}" + (f"\\n{r['score']:.3g}" if r["score"] is not None else "")
    lines = [f'  n{r["node"]} [label="{shown(r)}"];' for r in rows] + [f"  n{r['parent']} -> n{r['node']};" for r in rows if r["parent"] is not None]
    return "digraph tree {\n" + "\n".join(lines) + "\n}"


def dot_graph(edges: DataFrame, limit: int = 2000) -> str | None:
    """A DOT drawing of an undirected graph (src, dst), each pair once; None above ``limit`` pairs."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a <> b").distinct()
    if pairs.limit(limit + 1).count() > limit:
        return None
    rows = sorted(map(tuple, pairs.collect()), key=str)
    return "graph nn {\n" + "\n".join(f'  "{a}" -- "{b}";' for a, b in rows) + "\n}"


def plain_json(value: dict) -> dict:
    """The entries of a mapping that JSON can hold."""
    def ok(v):
        try:
            json.dumps(v)
            return True
        except (TypeError, ValueError):
            return False

    return {k: v for k, v in value.items() if ok(v)}


def histogram(df: DataFrame, column: str, bins: int, low: float, high: float) -> DataFrame:
    """(bin, n) of a column, for a plot: the counts are made in Spark and no drawing is kept here."""
    b = F.least(F.greatest(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin")).count().withColumnRenamed("count", "n")
