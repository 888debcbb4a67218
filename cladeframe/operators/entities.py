"""Merges scored on the merged entity: attribute unions, vector sums, boxes and score statistics.

A group carries what its mentions carry together, so a hypothetical merge is the merge of two groups.
``EntityScores`` is a linkage: exact and mini-batch clustering take it as they take any other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.features import MERGE_MODELS
from ..session import ship
from .hac import exact, mini_batch
from .linkage import PairScores
from .trees import ROWS

#: The features of each part of a merge model, in order (the names of ``functions.features``).
PARTS = {
    "sub": ["my_pw", "new_edges", "child_e_min", "child_e_max"],
    "sub_avg": ["my_pw", "child_e_mean"],
    "name": ["one_fn", "gt1_fn", "gt1_mn", "gt1_mi"],
    "title": ["title_diameter"],
    "coauthor": ["ca_ratio"],
    "line": ["my_pw", "size_difference"],
    "history": ["pw_mean", "pw_min", "pw_max", "my_pw", "es_min", "es_max", "es_mean"],
}


def feature_names(model: str) -> list[str]:
    """The features of a merge model, each once, in order."""
    return list(dict.fromkeys(k for p in MERGE_MODELS[model] for k in PARTS[p]))


def _expit(x: float) -> float:
    return float(1 / (1 + np.exp(-x)))


class EntityScores(PairScores):
    """Scores merges by a linear model over the merged entity.

    ``scores`` are the pair logits of the mentions, ``attrs`` their attribute maps and ``titles`` their
    title vectors (None where there is none).  A child that is a mention counts as score 1; with
    ``squash`` other children's scores pass the logistic function first.  Without ``weights`` the score
    is the best cross pair.
    """

    def __init__(self, scores, attrs, titles=None, *, model="base_sub_ent", weights=None, bias=0.0, squash=False, budget=None):
        super().__init__(scores, None, budget)
        self.attrs, self.titles, self.squash, self.computations = attrs, titles, squash, 0
        self.names = feature_names(model)
        w = {"my_pw": 1.0} if weights is None else weights
        self.w, self.bias = np.array([w.get(k, 0.0) for k in self.names]), bias

    def leaf(self, vec, key=0):
        g = super().leaf(vec, key)
        t = None if self.titles is None else self.titles[key]
        t = None if t is None else np.asarray(t, float)
        none = np.empty(0)
        return g | {"attrs": {k: frozenset(v) for k, v in self.attrs[key].items()}, "t_low": t, "t_high": t, "pw": none, "es": none}

    def points(self, a, b):
        out = super().points(a, b)
        keys = a["attrs"].keys() | b["attrs"].keys()
        none = frozenset()
        out["attrs"] = {k: a["attrs"].get(k, none) | b["attrs"].get(k, none) for k in keys}
        for name, pick in (("t_low", np.minimum), ("t_high", np.maximum)):
            x, y = a[name], b[name]
            out[name] = y if x is None else x if y is None else pick(x, y)
        # What the entity's merges scored so far: best pairs, and scores of merged children.
        best = PairScores.score(self, a, b)
        out["pw"] = np.concatenate([a["pw"], b["pw"], [best]])
        out["es"] = np.concatenate([a["es"], b["es"], [g["score"] for g in (a, b) if g.get("score") is not None]])
        return out

    def features(self, a: dict, b: dict) -> dict[str, float]:
        """All features of the merge of two groups."""
        g = self.merge(a, b)
        child = sorted(1.0 if s is None else _expit(s) if self.squash else float(s) for s in (a.get("score"), b.get("score")))
        fn, mn = g["attrs"].get("fn", frozenset()), g["attrs"].get("mn", frozenset())
        long = lambda x: len([v for v in x if len(v) > 1])
        of = lambda x, f: float(f(x)) if len(x) else 0.0
        es = g["es"]
        return {
            "my_pw": float(g["pw"][-1]), "new_edges": 0.0, "child_e_min": child[0], "child_e_max": child[1], "child_e_mean": sum(child) / 2,
            "one_fn": float(len(fn) == 1), "gt1_fn": float(long(fn) > 1), "gt1_mn": float(long(mn) > 1), "gt1_mi": float(len({v[:1] for v in mn}) > 1),
            "title_diameter": 0.0 if g["t_low"] is None else float(np.linalg.norm(g["t_high"] - g["t_low"])),
            "ca_ratio": len(g["attrs"].get("ca", ())) / g["n"], "size_difference": -float(abs(a["n"] - b["n"])),
            "pw_mean": float(g["pw"].sum()) / g["n"], "pw_min": float(g["pw"].min()), "pw_max": float(g["pw"].max()),
            "es_min": of(es, np.min), "es_max": of(es, np.max), "es_mean": float(es.sum()) / g["n"],
        }

    def score(self, a, b):
        self.computations += 1
        f = self.features(a, b)
        return float(self.w @ [f[k] for k in self.names]) + self.bias


def agglomerate_entities(
    pairs: DataFrame, members: DataFrame, *, model: str = "base_sub_ent", weights: dict | None = None, bias: float = 0.0, squash: bool = False,
    budget: int | None = None, mini_batch_size: int | None = None, canopy: str = "canopy",
) -> DataFrame:
    """The trees of a learned merge model, and for each canopy the number of merges scored.

    ``pairs`` (canopy, a, b, score) are pair logits, ``members`` (canopy, pid, label, attrs[, tes]).
    Returns tree rows with ``canopy`` and ``computations``.  Pairs that are missing never join."""
    ship(pairs.sparkSession)
    titled = "tes" in members.columns

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("pid", kind="stable")
        at = {p: i for i, p in enumerate(right["pid"])}
        m = np.full((len(at), len(at)), -np.inf)
        i, j = left["a"].map(at).to_numpy(int), left["b"].map(at).to_numpy(int)
        m[i, j] = m[j, i] = left["score"].to_numpy(float)
        attrs = [dict(x) if x is not None else {} for x in right["attrs"]]
        linkage = EntityScores(m, attrs, list(right["tes"]) if titled else None, model=model, weights=weights, bias=bias, squash=squash, budget=budget)
        points = [(np.zeros(1), p, l) for p, l in zip(right["pid"], right["label"])]
        tree = exact(points, linkage) if mini_batch_size is None else mini_batch(points, linkage, mini_batch_size)
        return tree.rows().assign(canopy=key[0], computations=linkage.computations)

    text = lambda *c: [F.col(x).cast("string").alias(x) for x in c]
    pairs = pairs.select(F.col(canopy).cast("string").alias("canopy"), *text("a", "b"), "score")
    members = members.select(F.col(canopy).cast("string").alias("canopy"), *text("pid", "label"), "attrs", *(["tes"] if titled else []))
    return pairs.groupBy("canopy").cogroup(members.groupBy("canopy")).applyInPandas(run, ROWS + ", canopy string, computations long")


EPISODES = "canopy string, features array<double>, precision double"


def merge_episodes(
    pairs: DataFrame, members: DataFrame, *, model: str = "base_sub_ent", weights: dict | None = None, bias: float = 0.0, squash: bool = False, size: int = 20, seed: int = 7, canopy: str = "canopy",
) -> DataFrame:
    """(canopy, features, precision): every merge that exact clustering of ``size`` mentions a canopy (of
    least seeded hash) looks at, under the given merge model, with the share of same-label pairs among
    the labelled mentions of the merge (0 where there is no such pair)."""
    ship(pairs.sparkSession)
    titled = "tes" in members.columns

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["h", "pid"], kind="stable").head(size).sort_values("pid", kind="stable")
        at = {p: i for i, p in enumerate(right["pid"])}
        left = left[left["a"].isin(at) & left["b"].isin(at)]
        m = np.full((len(at), len(at)), -np.inf)
        i, j = left["a"].map(at).to_numpy(int), left["b"].map(at).to_numpy(int)
        m[i, j] = m[j, i] = left["score"].to_numpy(float)
        labels, out = right["label"].tolist(), []

        class Watched(EntityScores):
            def score(self, a, b):
                f = self.features(a, b)
                known = [labels[k] for k in [*a["keys"], *b["keys"]] if labels[k] is not None]
                n = len(known) * (len(known) - 1) // 2
                tp = sum(v * (v - 1) // 2 for v in pd.Series(known, dtype=object).value_counts()) if known else 0
                x = [f[k] for k in self.names]
                if np.isfinite(x).all():
                    out.append((key[0], x, tp / n if n else 0.0))
                return float(self.w @ x) + self.bias if np.isfinite(x).all() else -np.inf

        attrs = [dict(x) if x is not None else {} for x in right["attrs"]]
        linkage = Watched(m, attrs, list(right["tes"]) if titled else None, model=model, weights=weights, bias=bias, squash=squash)
        exact([(np.zeros(1), p, l) for p, l in zip(right["pid"], labels)], linkage)
        return pd.DataFrame(out, columns=["canopy", "features", "precision"])

    text = lambda *c: [F.col(x).cast("string").alias(x) for x in c]
    pairs = pairs.select(F.col(canopy).cast("string").alias("canopy"), *text("a", "b"), "score")
    members = members.select(F.col(canopy).cast("string").alias("canopy"), *text("pid", "label"), "attrs", *(["tes"] if titled else []), F.xxhash64(F.col("pid").cast("string"), F.lit(seed)).alias("h"))
    return pairs.groupBy("canopy").cogroup(members.groupBy("canopy")).applyInPandas(run, EPISODES)


def fit_merge_model(episodes: DataFrame, model: str, *, reg: float = 0.01) -> dict:
    """Least squares of merge precision on a merge model's features: {model, weights, bias}."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import LinearRegression

    rows = episodes.select(array_to_vector("features").alias("features"), "precision")
    fit = LinearRegression(featuresCol="features", labelCol="precision", regParam=reg, standardization=False).fit(rows)
    return {"model": model, "weights": dict(zip(feature_names(model), map(float, fit.coefficients))), "bias": float(fit.intercept)}
