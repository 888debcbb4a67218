"""Online clustering as keyed state of Structured Streaming: one tree per canopy.

``cluster_stream`` keeps the whole tree; ``mini_batch_stream`` keeps only the open roots, a bounded
number, and sends the tree's nodes out as they are made.

State is the canopy's tree as bytes.  It grows with the canopy's points, as insertion needs them all;
``max_leaves`` of the box scheme bounds the part that searches open.  Late points need no special
care: insertion in any order is legal.  Points of a micro-batch are inserted by their order column.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.linkage import LINKAGES, _NoPoints
from ..operators.online import SCHEMES, BoxTree, OnlineTree
from ..session import ship

OUT = "canopy string, pid string, cluster long, n_leaves long"


def _new(scheme: str, linkage: str, options: dict):
    if scheme == "box":
        return BoxTree(LINKAGES[linkage](), **options)
    rotate, graft = SCHEMES[scheme]
    return OnlineTree(LINKAGES[linkage](), rotate=rotate, graft=graft, **options)


def _cluster_of(made, leaf: int, threshold: float) -> int:
    """The highest ancestor whose path up to it scores at least the threshold."""
    t, at = made.tree, leaf
    while t.parent[at] >= 0 and (t.score[t.parent[at]] or 0.0) >= threshold:
        at = t.parent[at]
    return at


def cluster_stream(points: DataFrame, *, scheme: str = "graft", linkage: str = "centroid", threshold: float = -1.0, order: str = "pos", **options) -> DataFrame:
    """A stream of (canopy, pid, label, vec, order) becomes a stream of (canopy, pid, cluster,
    n_leaves): each new point's cluster node at the time of its insertion."""
    ship(points.sparkSession)

    def insert(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        made = pickle.loads(state.get[0]) if state.exists else _new(scheme, linkage, options)
        rows = pd.concat(list(batches)).sort_values([order, "pid"], kind="stable")
        out = []
        for pid, label, vec in zip(rows["pid"], rows["label"], rows["vec"]):
            leaf = made.insert(np.asarray(vec, float), pid, label)
            out.append((key[0], pid, _cluster_of(made, leaf, threshold), made.tree.group[made.root]["n"]))
        state.update((pickle.dumps(made),))
        yield pd.DataFrame(out, columns=["canopy", "pid", "cluster", "n_leaves"])

    rows = points.select(F.col("canopy").cast("string").alias("canopy"), F.col("pid").cast("string").alias("pid"), F.col("label").cast("string").alias("label"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), order)
    return rows.groupBy("canopy").applyInPandasWithState(insert, OUT, "tree binary", "append", "NoTimeout")


NODES = "canopy string, node long, left long, right long, score double, n_leaves long, pid string, label string"


def mini_batch_stream(points: DataFrame, *, size: int = 100, linkage: str = "centroid", order: str = "pos") -> DataFrame:
    """A stream of (canopy, pid, label, vec, order) becomes a stream of tree nodes: a leaf for each point,
    and a node for each merge of the best two roots, one whenever more than ``size`` roots are open.

    State is the open roots' sums and boxes, ``size`` at most, so it does not grow with the canopy;
    linkages that need single points are refused.  ``open_roots`` tells what is still open.
    """
    ship(points.sparkSession)
    if not issubclass(LINKAGES[linkage], _NoPoints):
        raise ValueError(f"{linkage} needs all points of a group")

    def insert(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        link = LINKAGES[linkage]()
        made, groups = pickle.loads(state.get[0]) if state.exists else (0, {})
        rows = pd.concat(list(batches)).sort_values([order, "pid"], kind="stable")
        scores = {(a, b): link.score(groups[a], groups[b]) for a in groups for b in groups if a < b}
        out = []

        def add(node: int, group: dict) -> None:
            scores.update({(o, node): link.score(g, group) for o, g in groups.items()})
            groups[node] = group

        for pid, label, vec in zip(rows["pid"], rows["label"], rows["vec"]):
            out.append((key[0], made, None, None, None, 1, pid, label))
            add(made, link.leaf(np.asarray(vec, float), made))
            made += 1
            if len(groups) > size:
                a, b = min(scores, key=lambda p: (-scores[p], p))
                s = scores[a, b]
                group = link.merge(groups[a], groups[b])
                for o in [p for p in scores if a in p or b in p]:
                    del scores[o]
                del groups[a], groups[b]
                out.append((key[0], made, a, b, s, group["n"], None, None))
                add(made, group)
                made += 1
        state.update((pickle.dumps((made, groups)),))
        df = pd.DataFrame(out, columns=["canopy", "node", "left", "right", "score", "n_leaves", "pid", "label"])
        yield df.astype({"left": "Int64", "right": "Int64", "score": "Float64"})

    rows = points.select(F.col("canopy").cast("string").alias("canopy"), F.col("pid").cast("string").alias("pid"), F.col("label").cast("string").alias("label"), F.transform("vec", lambda x: x.cast("double")).alias("vec"), order)
    return rows.groupBy("canopy").applyInPandasWithState(insert, NODES, "roots binary", "append", "NoTimeout")


def open_roots(nodes: DataFrame) -> DataFrame:
    """The nodes of ``mini_batch_stream`` that no merge has taken yet."""
    row = F.struct(*nodes.columns)
    kind = nodes.select(row.alias("row")).schema["row"].dataType
    taken = nodes.where("left is not null").select("canopy", F.explode(F.array("left", "right")).alias("node"), F.lit(1).alias("taken"), F.lit(None).cast(kind).alias("row"))
    both = nodes.select("canopy", "node", F.lit(0).alias("taken"), row.alias("row")).union(taken)
    return both.groupBy("canopy", "node").agg(F.max("taken").alias("taken"), F.first("row", ignorenulls=True).alias("row")).where("taken = 0").select("row.*")


def windowed_counts(events: DataFrame, *, ts: str = "ts", key: str = "event_type", late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and key, with a watermark; the same plan on a table."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"), F.sum("value").alias("v")).select(F.col("window.start").alias("start"), key, "n", "v")
