"""Connected components and single linkage on graphs, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, drop


#: Labels that Spark may send to all tasks by way of the driver, at most.
LABELS = 300_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable from each end of an edge.

    A round takes the least label of the neighbours, then that label's own label; labels are written
    out each round, so the plan stays short and no round is computed twice.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    # Both ways in one pass: a union of the two would compute the edges twice.
    ways = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    e = cut(e.select(ways.alias("e")).select("e.a", "e.b").distinct())
    label = cut(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("c")))
    many = label.count() > LABELS
    while True:
        # Without the hint Spark goes by the size of the compressed files.
        label = label.hint("merge") if many else label
        near = e.join(label, e.b == label.id).groupBy("a").agg(F.min("c").alias("m"))
        step = label.join(near, label.id == near.a).select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        far = label.select(F.col("id").alias("at"), F.col("c").alias("far"))
        new = cut(step.join(far, step.c == far["at"], "left").select("id", "old", F.least("c", F.coalesce("far", "c")).alias("c")))
        drop(label)
        label = new.select("id", "c")
        if not new.where("c <> old").limit(1).count():
            drop(e)
            return label.select("id", F.col("c").alias("component"))


def with_singletons(nodes: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """Every node with its component; a node without edges is its own."""
    c = components.select(F.col("id").alias("_id"), "component")
    return nodes.select(key).join(c, F.col(key) == F.col("_id"), "left").select(key, F.coalesce("component", key).alias("component"))


def threshold_components(pairs: DataFrame, t: float, *, score: str = "score") -> DataFrame:
    """Single-link clusters at ``t``: the components of the pairs that score at least ``t``."""
    return connected_components(pairs.where(F.col(score) >= t))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """(a, b, score): a maximum spanning forest of undirected edges, by Boruvka rounds.

    In a round each component takes its best outgoing edge (ties by the lesser ends), the chosen
    edges are kept, and components are merged; the number of rounds is logarithmic.
    """
    e = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a <> b").groupBy("a", "b").agg(F.max("score").alias("score")))
    left = e.select("a", "b", "score", F.col("a").alias("ca"), F.col("b").alias("cb"))
    kept = None
    while True:
        ends = left.select(F.col("ca").alias("c"), "a", "b", "score").union(left.select(F.col("cb").alias("c"), "a", "b", "score"))
        best = ends.groupBy("c").agg(F.min(F.struct((-F.col("score")).alias("s"), "a", "b")).alias("m")).select("m.a", "m.b", (-F.col("m.s")).alias("score")).distinct()
        best = cut(best)
        if not best.limit(1).count():
            return kept if kept is not None else best
        kept = cut(kept.union(best)) if kept is not None else best
        comp = connected_components(kept)
        ca, cb = comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), comp.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        joined = e.join(ca, "a", "left").join(cb, "b", "left").select("a", "b", "score", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        left = cut(joined.where("ca <> cb"))
