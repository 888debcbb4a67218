"""Exact single-linkage trees from rows of scores, without a matrix of them.

Points are visited as Prim's algorithm takes them, so that a cluster of any threshold is a stretch of
the visits, and the level at which two points meet is the least weight between them.  A row is computed
once, when its point is taken; of it the pairs stay, one bit each, that score as much as the level at which
they meet.  No other pair decides a merge, so these say which merge of equals comes first: the one of
lesser numbers, as a heap of all merges has it.

A row must score (i, j) as that of j does, bit for bit.  Scores that are missing (NaN) count as minus infinity.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, spread_groups
from .linkage import PairScores
from .pair_blocks import Rows, needed
from .trees import ROWS, Tree


def _visits(n: int, row) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(points as they are taken, the best score of each to those before it, and as the bits of a number
    the earlier visits whose pair with it scores as much as the level at which both meet)."""
    order, weight, bits = np.empty(n, np.int64), np.full(n, np.inf), []
    key, shut, meet = np.full(n, -np.inf), np.zeros(n), np.full(n, np.inf)
    for t in range(n):
        v = int(np.argmax(key + shut))
        if shut[v]:  # all that is left scores minus infinity
            v = int(np.argmax(shut == 0))
        order[t], shut[v] = v, -np.inf
        s = row(v)
        s = np.where(np.isnan(s), -np.inf, s)
        if t:
            weight[t] = key[v]
            np.minimum(meet[:t], weight[t], out=meet[:t])
        bits.append(int.from_bytes(np.packbits(s[order[:t]] == meet[:t], bitorder="little").tobytes(), "little"))
        np.maximum(key, s, out=key)
    return order, weight, bits


class _Equals:
    """The clusters of one component of a level, which its pairs of that score join; slots are in the
    order of the clusters' nodes."""

    def __init__(self, starts: list[int], nodes: list[int], near: list[int]):
        m, lo = len(starts), starts[0]
        joined = np.zeros((m, m), bool)
        for j in range(1, m):
            size = starts[j] - lo
            raw = ((near[j] >> lo) & ((1 << size) - 1)).to_bytes(-(-size // 8), "little")
            on = np.unpackbits(np.frombuffer(raw, np.uint8), count=size, bitorder="little")
            joined[j, :j] = np.logical_or.reduceat(on, np.array(starts[:j]) - lo)
        by = np.argsort(nodes)
        joined = (joined | joined.T)[np.ix_(by, by)]
        self.nodes = np.array(nodes)[by].tolist()
        # Slot -> (its clusters' slots, the slots that they have pairs with); the ones made here come after.
        self.parts = [(1 << k, int.from_bytes(np.packbits(x, bitorder="little").tobytes(), "little")) for k, x in enumerate(joined)]
        self.m, self.left, self.made = m, m, []
        self.open = self.first = (1 << m) - 1

    def merge(self, a: int, new: int) -> tuple[int, int]:
        """(nodes) of the merge of the least open slot ``a``, which becomes the node ``new``."""
        mine, near = self.parts[a]
        ones = near & self.open & self.first & ~mine
        if ones:
            b = (ones & -ones).bit_length() - 1
        else:
            b = next(k for k in self.made if k != a and near & self.parts[k][0])
        pair = self.nodes[a], self.nodes[b]
        for k in (a, b):
            self.open &= ~(1 << k)
            if k >= self.m:
                self.made.remove(k)
        k = len(self.parts)
        self.parts.append((mine | self.parts[b][0], near | self.parts[b][1]))
        self.nodes.append(new)
        self.made.append(k)
        self.open |= 1 << k
        self.left -= 1
        return pair


def merges(n: int, row) -> list[tuple[int, int, float]]:
    """(lesser node, greater node, score) of each merge in turn; they make the nodes n, n + 1, ...
    ``row(i)`` scores the point i with each of the n points."""
    order, weight, near = _visits(n, row)
    # A cluster is a stretch of visits: its end and its node by its start, its start by its end.
    end, node, start, out = list(range(1, n + 1)), order.tolist(), list(range(-1, n)), []
    by = np.argsort(-weight[1:], kind="stable") + 1
    runs = np.split(by, np.flatnonzero(weight[by[1:]] != weight[by[:-1]]) + 1) if n > 1 else []
    for run in runs:
        level, groups = float(weight[run[0]]), []
        for t in run.tolist():
            if groups and groups[-1][-1] == start[t]:
                groups[-1].append(t)
            else:
                groups.append([start[t], t])
        if len(groups) == 1 and len(groups[0]) == 2:
            a, b = sorted(node[x] for x in groups[0])
            out.append((a, b, level))
            tops = [n + len(out) - 1]
        else:
            sides = [_Equals(g, [node[x] for x in g], [near[x] for x in g]) for g in groups]
            heap = [(v, k, slot) for k, e in enumerate(sides) for slot, v in enumerate(e.nodes)]
            heapq.heapify(heap)
            while heap:
                _, k, slot = heapq.heappop(heap)
                e = sides[k]
                if e.left > 1 and e.open >> slot & 1:
                    new = n + len(out)
                    out.append((*e.merge(slot, new), level))
                    heapq.heappush(heap, (new, k, len(e.parts) - 1))
            tops = [e.nodes[-1] for e in sides]
        for g, top in zip(groups, tops):
            lo, hi = g[0], end[g[-1]]
            end[lo], start[hi], node[lo] = hi, lo, top
            for x in g[1:]:
                near[lo] |= near[x]
                near[x] = 0
    return out


def tree_of(members: list[tuple], row) -> Tree:
    """The tree of members (pid, label) whose scores ``row`` gives; its inner nodes keep no groups."""
    tree = Tree(PairScores(np.empty((0, 0))))
    for p, label in members:
        tree.leaf(np.zeros(1), p, label)
    for a, b, s in merges(len(members), row):
        tree.over(a, b, s)
    return tree


def cosine_rows(vectors: list):
    """The row function of cosines, summed up in the order of the coordinates as ``scalar.cosine`` does; a
    pair of which one is null, has a null coordinate or another length has no score."""
    size = np.array([-1 if v is None else len(v) for v in vectors])
    x = np.zeros((max(0, size.max(initial=0)), len(vectors)))
    for i, v in enumerate(vectors):
        if v is not None:
            x[: len(v), i] = np.asarray(v, float)

    def dots(v):
        out = np.zeros(x.shape[1])
        for c, w in zip(x, v):
            out += c * w
        return out

    norm = np.zeros(x.shape[1])
    for c in x:
        norm += c * c
    norm = np.sqrt(norm)

    def row(i):
        d = norm * norm[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            got = np.where(d <= 0, 0.0, dots(x[:, i]) / d)
        return np.where((size == size[i]) & (size >= 0), got, -np.inf)

    return row


def cosine_trees(points: DataFrame, *, canopy: str = "canopy") -> DataFrame:
    """The tree rows of each canopy of (canopy, pid, label, vec), points in the order of their ids as text,
    under the cosines of their pairs: the trees of ``hac.agglomerate_scores`` on all pairs' cosines."""
    ship(points.sparkSession)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid", kind="stable")
        row = cosine_rows(list(pdf["vec"])) if key[0] is not None else lambda i: np.full(len(pdf), -np.inf)
        return tree_of(list(zip(pdf["pid"], pdf["label"])), row).rows().assign(canopy=key[0])

    p = points.select(F.col(canopy).cast("string").alias("canopy"), F.col("pid").cast("string").alias("pid"), F.col("label").cast("string").alias("label"), "vec")
    return spread_groups(p, "canopy").groupBy("canopy").applyInPandas(run, ROWS + ", canopy string")


def model_trees(mentions: DataFrame, fitted: dict) -> DataFrame:
    """The trees of mentions (mid, gt, canopy, attrs) under a linear pair model and the untrained merge model,
    with ``computations``, the merges that exact clustering scores: those of
    ``entities.agglomerate_entities`` on all pairs' scores."""
    ship(mentions.sparkSession)
    model, weights, bias = fitted["model"], fitted["weights"], float(fitted["bias"])
    columns = needed([model], weights)

    def run(key, t):
        t = t.take(pc.sort_indices(t["pid"]))
        rows, n = Rows(t), t.num_rows

        def row(i):
            s = np.full(n, bias)
            for name, x in rows.features(i, model, weights):
                s += x * float(weights[name])
            return s

        made = tree_of(list(zip(t["pid"].to_pylist(), t["label"].to_pylist())), row).rows()
        return pa.Table.from_pandas(made.assign(canopy=key[0].as_py(), computations=(n - 1) ** 2), schema=_COUNTED, preserve_index=False)

    m = mentions.where(F.col("mid").isNotNull() & F.col("canopy").isNotNull())
    m = m.select(F.col("canopy").cast("string").alias("canopy"), F.col("mid").cast("string").alias("pid"), F.col("gt").cast("string").alias("label"), *columns)
    return spread_groups(m, "canopy").groupBy("canopy").applyInArrow(run, ROWS + ", canopy string, computations long")


_COUNTED = pa.schema([
    ("node", pa.int64()), ("parent", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("score", pa.float64()), ("n_leaves", pa.int64()), ("is_leaf", pa.bool_()),
    ("pid", pa.string()), ("label", pa.string()), ("depth", pa.int32()), ("canopy", pa.string()), ("computations", pa.int64()),
])
