"""Training of pair models and of merge models, and choice of thresholds."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.features import PAIR_MODELS, linear_score, pair_features
from ..session import cut, drop, ship
from .hac import _Roots
from .linkage import PairScores
from .trees import Tree
from .trees_sql import class_counts, closure, cut_values, split_counts, threshold_sweep


def pair_table(pairs: DataFrame, model: str, a: str = "a_attrs", b: str = "b_attrs", label: str = "label") -> DataFrame:
    """Pairs with the model's features as columns, and the label."""
    f = pair_features(model, a, b)
    return pairs.select(*[c for c in pairs.columns if c not in f], *[c.alias(k) for k, c in f.items()]) if label in pairs.columns else pairs.select("*", *[c.alias(k) for k, c in f.items()])


def fit_pair_model(table: DataFrame, model: str, *, label: str = "label", reg: float = 0.001, max_iter: int = 50, weight: str | None = None) -> dict:
    """Logistic regression over a model's features: {features, weights, bias}, plain enough for JSON.  A row
    counts as ``weight`` rows where that column is named."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    names = list(pair_features(model, "x", "y")) if model in PAIR_MODELS else [model]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(table.where(F.col(label).isNotNull()))
    fit = LogisticRegression(featuresCol="features", labelCol=label, regParam=reg, maxIter=max_iter, standardization=False, **({"weightCol": weight} if weight else {})).fit(rows)
    return {"model": model, "weights": dict(zip(names, map(float, fit.coefficients))), "bias": float(fit.intercept)}


def fit_pair_network(table: DataFrame, model: str, *, label: str = "label", seed: int = 5, max_iter: int = 100):
    """The two-layer form, by pyspark.ml (its hidden layer is a sigmoid)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler

    names = list(pair_features(model, "x", "y"))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(table.where(F.col(label).isNotNull()))
    return MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[len(names), len(names), 2], seed=seed, maxIter=max_iter).fit(rows)


def score_pairs(pairs: DataFrame, fitted: dict, a: str = "a_attrs", b: str = "b_attrs") -> DataFrame:
    """Pairs with their logit as ``score``: one expression, no Python."""
    return pairs.withColumn("score", linear_score(pair_features(fitted["model"], a, b), fitted["weights"], fitted["bias"]))


def save(spark: SparkSession, fitted: dict, path: str) -> None:
    """Write a fitted model as one JSON document, to any file system that Spark writes."""
    spark.createDataFrame([(json.dumps(fitted, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def merge_episodes(pairs: DataFrame, members: DataFrame, *, canopy: str = "canopy", size: int = 20, seed: int = 7) -> DataFrame:
    """(canopy, my_pw, child_min, child_max, precision): every candidate merge that exact clustering of
    ``size`` mentions a canopy (least seeded hash) looks at, with its precision."""
    schema = "canopy string, my_pw double, child_min double, child_max double, precision double"
    ship(pairs.sparkSession)

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("h", kind="stable").head(size).sort_values("pid", kind="stable")
        at = {p: i for i, p in enumerate(right["pid"])}
        left = left[left["a"].isin(at) & left["b"].isin(at)]
        m = np.full((len(at), len(at)), -np.inf)
        i, j = left["a"].map(at).to_numpy(int), left["b"].map(at).to_numpy(int)
        m[i, j] = m[j, i] = left["score"].to_numpy(float)
        labels, out = right["label"].tolist(), []

        class Watched(PairScores):
            def score(self, a, b):
                best = super().score(a, b)
                e = sorted(1.0 if g.get("score") is None else g["score"] for g in (a, b))
                known = [labels[k] for k in [*a["keys"], *b["keys"]] if labels[k] is not None]
                n = len(known) * (len(known) - 1) // 2
                tp = sum(v * (v - 1) // 2 for v in pd.Series(known, dtype=object).value_counts()) if known else 0
                if np.isfinite(best):
                    out.append((key[0], best, e[0], e[1], tp / n if n else 0.0))
                return best

        tree = Tree(Watched(m))
        roots = _Roots(tree)
        for p, l in zip(right["pid"], labels):
            roots.add(tree.leaf(np.zeros(1), p, l))
        while len(roots.open) > 1:
            roots.merge_best()
        return pd.DataFrame(out, columns=["canopy", "my_pw", "child_min", "child_max", "precision"])

    p = pairs.select(F.col(canopy).cast("string").alias("canopy"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "score")
    m = members.select(F.col(canopy).cast("string").alias("canopy"), F.col("pid").cast("string").alias("pid"), F.col("label").cast("string").alias("label"), F.xxhash64(F.col("pid").cast("string"), F.lit(seed)).alias("h"))
    return p.groupBy("canopy").cogroup(m.groupBy("canopy")).applyInPandas(run, schema)


def fit_merge_model(episodes: DataFrame, *, reg: float = 0.01) -> dict:
    """Least squares of merge precision on the merge features."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    names = ["my_pw", "child_min", "child_max"]
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(episodes)
    fit = LinearRegression(featuresCol="features", labelCol="precision", regParam=reg, standardization=False).fit(rows)
    return {"weights": dict(zip(names, map(float, fit.coefficients))), "bias": float(fit.intercept)}


def merge_scorer(fitted: dict):
    """The function that ``agglomerate_scores`` takes."""
    w, b = [fitted["weights"][k] for k in ("my_pw", "child_min", "child_max")], fitted["bias"]

    def score(my_pw, child1, child2):
        lo, hi = sorted(1.0 if c is None else c for c in (child1, child2))
        return w[0] * my_pw + w[1] * lo + w[2] * hi + b

    return score


def best_threshold(values: DataFrame, gt_pairs: float) -> tuple[float, float]:
    """(threshold, F1) of the best point of the exact sweep; the lowest threshold among equals."""
    row = threshold_sweep(values, gt_pairs).orderBy(F.desc("f1"), "t").first()
    return (float("inf"), 0.0) if row is None else (float(row["t"]), float(row["f1"]))


def train(labelled: DataFrame, mentions: DataFrame, *, model: str = "base", canopy: str = "canopy", with_merges: bool = True) -> dict:
    """Pair model, then merge model on clustering episodes of its scores: {pair, merge}."""
    from .pairs import canopy_pairs

    pair = fit_pair_model(pair_table(labelled, model), model)
    if not with_merges:
        return {"pair": pair, "merge": None}
    scored = score_pairs(canopy_pairs(mentions, canopy=canopy), pair).select(F.col("a_" + canopy).alias("canopy"), F.col("a_mid").alias("a"), F.col("b_mid").alias("b"), "score")
    members = mentions.select(F.col(canopy).alias("canopy"), F.col("mid").alias("pid"), F.col("gt").alias("label"))
    return {"pair": pair, "merge": fit_merge_model(merge_episodes(scored, members))}


def _scored(mentions: DataFrame, pair: dict) -> tuple[DataFrame, DataFrame]:
    """The pair scores of mentions, and the mentions as members."""
    from .pairs import canopy_pairs

    scored = score_pairs(canopy_pairs(mentions), pair).select(F.col("a_canopy").alias("canopy"), F.col("a_mid").alias("a"), F.col("b_mid").alias("b"), "score")
    return scored, mentions.select("canopy", F.col("mid").alias("pid"), F.col("gt").alias("label"), "attrs", *[c for c in ("tes",) if c in mentions.columns])


def of_size(mentions: DataFrame, most: int | None) -> DataFrame:
    """The first ``most`` mentions of each canopy by id (development canopies may be cut)."""
    if most is None:
        return mentions
    w = Window.partitionBy("canopy").orderBy("mid")
    return mentions.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def evaluate(dev: DataFrame, fitted: dict, *, merge_model: str = "base_sub_ent", most: int | None = 100, squash: bool = False) -> tuple[float, float]:
    """(threshold, micro F1) of the best threshold over all development canopies together: trees under
    the model, then the exact sweep over the least scores of their subtrees."""
    from .entities import agglomerate_entities

    scored, members = _scored(of_size(dev, most), fitted["pair"])
    merge = fitted.get("merge") or {}
    tree = agglomerate_entities(scored, members, model=merge.get("model", merge_model), weights=merge.get("weights"), bias=merge.get("bias", 0.0), squash=squash)
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("/", "canopy", c))
    nodes = cut(tree.select("canopy", name("node").alias("node"), name("parent").alias("parent"), "score", "is_leaf", "label"))
    up = closure(nodes)
    counts = class_counts(up, nodes)
    gold = nodes.where("is_leaf and label is not null").groupBy("canopy", "label").agg(F.count("*").alias("n"))
    gt = float(gold.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0)
    best = best_threshold(cut_values(up, nodes, split_counts(counts, nodes)), gt)
    drop(nodes, up)
    return best


def train_alternating(
    labelled: DataFrame, mentions: DataFrame, dev: DataFrame, *, model: str = "base", merge_model: str = "base_sub_ent", regs: tuple = (0.1, 0.01, 0.001),
    rounds: int = 2, refine: int = 4, size: int = 20, most: int | None = 100, squash: bool = False, seed: int = 7,
) -> dict:
    """Train the pair model with the merge model frozen, then the merge model with the pair model frozen,
    ``rounds`` times; after each step the best on the development canopies is kept and gone on from.

    Pair models differ in their regularisation.  A merge step gathers episodes, under the merge model so
    far, from ``max(1, refine / canopies)`` samples of each canopy, beside all earlier episodes.
    Returns {pair, merge, threshold, f1, history}; the history has one (step, f1, threshold) each.
    """
    from . import entities

    table = cut(pair_table(labelled, model))
    samples = max(1, refine // max(1, mentions.select("canopy").distinct().count()))
    best: dict = {"pair": None, "merge": None, "f1": -1.0, "threshold": 0.0}
    history, episodes = [], None

    def look(step: str, pair: dict, merge: dict | None) -> None:
        threshold, f1 = evaluate(dev, {"pair": pair, "merge": merge}, merge_model=merge_model, most=most, squash=squash)
        history.append((step, f1, threshold))
        if f1 > best["f1"]:
            best.update(pair=pair, merge=merge, f1=f1, threshold=threshold)

    for turn in range(rounds):
        for reg in regs:
            look(f"pair {turn} {reg}", fit_pair_model(table, model, reg=reg), best["merge"])
        scored, members = _scored(mentions, best["pair"])
        scored = cut(scored)
        merge = best["merge"] or {}
        for k in range(samples):
            new = entities.merge_episodes(scored, members, model=merge_model, weights=merge.get("weights"), bias=merge.get("bias", 0.0), squash=squash, size=size, seed=seed + turn * samples + k)
            episodes = cut(new if episodes is None else episodes.union(new))
        look(f"merge {turn}", best["pair"], entities.fit_merge_model(episodes, merge_model))
        drop(scored)
    return best | {"history": history}
