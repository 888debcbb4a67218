"""Cluster metrics from contingency counts: no pair is ever formed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_pairs = lambda n: n * (n - 1) / 2
_ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))


def contingency(df: DataFrame, cluster: str, label: str, *by: str) -> DataFrame:
    """(by, cluster, label, n) over labelled rows."""
    return df.where(F.col(label).isNotNull()).groupBy(*by, F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count("*").alias("n"))


def pair_counts(cells: DataFrame, *by: str) -> DataFrame:
    """(by, tp, fp, gt): pairs that share cluster and label, cluster only, and label."""
    n, none = F.col("n"), F.lit(0.0)
    sizes = lambda c: cells.groupBy(*by, c).agg(F.sum("n").alias("n"))
    rows = cells.select(*by, _pairs(n).alias("tp"), none.alias("pp"), none.alias("gt"))
    rows = rows.union(sizes("cluster").select(*by, none, _pairs(n), none)).union(sizes("label").select(*by, none, none, _pairs(n)))
    long = lambda c: F.coalesce(F.sum(c), none).cast("long")
    return rows.groupBy(*by).agg(long(F.col("tp")).alias("tp"), long(F.col("pp") - F.col("tp")).alias("fp"), long(F.col("gt")).alias("gt"))


def pairwise_f1(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of (tp, fp, gt); 0 where undefined."""
    tp, fp, gt = (F.col(c) for c in ("tp", "fp", "gt"))
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, gt), "f1": _ratio(2 * tp, gt + tp + fp)})


def micro_f1(counts: DataFrame) -> DataFrame:
    """Pairwise scores after summing the counts of all canopies."""
    return pairwise_f1(counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "gt")]))


def micro_over_files(spark, folders: list[tuple[str, str]]) -> DataFrame:
    """Micro scores over several runs' files: (predicted, gold) folders of ``mid, cluster`` lines each;
    mentions whose gold label is "None" are dropped."""
    from ..sources.tables import read_clusters

    every = None
    for k, (predicted, gold) in enumerate(folders):
        rows = restrict_to_gold(read_clusters(spark, predicted), read_clusters(spark, gold).select("mid", F.col("cluster").alias("label"))).withColumn("run", F.lit(k))
        every = rows if every is None else every.union(rows)
    return micro_f1(pair_counts(contingency(every, "cluster", "label", "run"), "run"))


def b_cubed(cells: DataFrame, *by: str) -> DataFrame:
    """(by, precision, recall, f1): means over mentions of their cluster's and class's agreement."""
    c = cells.groupBy(*by, "cluster").agg(F.sum("n").alias("nc"))
    l = cells.groupBy(*by, "label").agg(F.sum("n").alias("nl"))
    j = cells.join(c, [*by, "cluster"]).join(l, [*by, "label"])
    n2 = F.col("n") * F.col("n")
    g = j.groupBy(*by).agg((F.sum(n2 / F.col("nc")) / F.sum("n")).alias("precision"), (F.sum(n2 / F.col("nl")) / F.sum("n")).alias("recall"))
    p, r = F.col("precision"), F.col("recall")
    return g.withColumn("f1", _ratio(2 * p * r, p + r))


def blanc(cells: DataFrame, *by: str) -> DataFrame:
    """BLANC: means of the precision, recall and F1 of links and of non-links; where one
    kind is in neither side the other alone counts."""
    counts = pair_counts(cells, *by).withColumn("n", F.lit(0).cast("long"))
    sizes = cells.groupBy(*by).agg(F.sum("n").alias("n")).select(*by, *[F.lit(0).cast("long").alias(c) for c in ("tp", "fp", "gt")], "n")
    both = counts.union(sizes).groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "gt", "n")]).withColumn("all", _pairs(F.col("n")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("gt") - F.col("tp")
    tn = F.col("all") - tp - fp - fn
    pc, rc, pn, rn = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    fc, f_n = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    no_c, no_n = tp + fp + fn == 0, tn + fp + fn == 0
    mean = lambda a, b: F.when(no_c, b).when(no_n, a).otherwise((a + b) / 2)
    return both.select(*by, mean(pc, pn).alias("precision"), mean(rc, rn).alias("recall"), mean(fc, f_n).alias("f1"))


def merge_precision(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, tp, fp, precision): the share of same-label pairs among labelled pairs of a merge."""
    cells = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    g = cells.groupBy(group).agg(F.sum(_pairs(F.col("n"))).cast("long").alias("tp"), _pairs(F.sum("n")).cast("long").alias("all"))
    return g.select(group, "tp", (F.col("all") - F.col("tp")).alias("fp"), _ratio(F.col("tp"), F.col("all")).alias("precision"))


def run_summary(runs: DataFrame, *columns: str) -> DataFrame:
    """(metric, mean, std, min, max) over runs; the deviation is of the population."""
    out = None
    for c in columns:
        row = runs.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).select(F.lit(c).alias("metric"), "mean", "std", "min", "max")
        out = row if out is None else out.union(row)
    return out


def restrict_to_gold(predicted: DataFrame, gold: DataFrame, mid: str = "mid") -> DataFrame:
    """Predicted clusters of mentions that have a gold label."""
    return predicted.join(gold, mid)
