"""Readers: vector points, mentions, labelled pairs, word lists and tables of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MENTION = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("attrs", T.ArrayType(T.StringType())),
        T.StructField("pack", T.ArrayType(T.StringType())),
        T.StructField("gt", T.StringType()),
        T.StructField("gt-dblp", T.StringType()),
        T.StructField("canopy", T.StringType()),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Points (pid, label, vec) of tab-separated lines ``pid, label, x1, x2, ...``."""
    cells = F.split("value", "\t")
    return spark.read.text(path).select(
        cells[0].alias("pid"), cells[1].alias("label"),
        F.transform(F.slice(cells, 3, F.greatest(F.size(cells) - 2, F.lit(0))), lambda x: x.cast("double")).alias("vec"),
    )


def in_order(points: DataFrame, order: DataFrame, key: str = "pid") -> DataFrame:
    """Points that ``order`` (pid, pos) names, with their position; sort on ``pos`` to replay."""
    return points.join(order.select(key, "pos"), key)


def attributes(pairs: Column) -> Column:
    """``key:value`` strings as a map from key to its sorted distinct values; entries without a key,
    a colon or a value are skipped."""
    split = F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.expr("''").alias("e"), x.alias("x")))
    good = F.filter(split, lambda s: s.x.isNotNull() & F.contains(s.x, F.lit(":")) & (s.k != "") & (F.length(s.x) > F.length(s.k) + 1))
    value = lambda s: s.x.substr(F.length(s.k) + 2, F.length(s.x))
    keys = F.array_distinct(F.transform(good, lambda s: s.k))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_sort(F.array_distinct(F.transform(F.filter(good, lambda s: s.k == k), value)))))


def mentions(lines: DataFrame, *, skip_unlabeled: bool = False) -> DataFrame:
    """(mid, gt, canopy, attrs) from a frame of JSON lines (column ``value``).  The label "None" is null."""
    m = lines.select(F.from_json("value", MENTION).alias("m")).select("m.*").where(F.col("id").isNotNull())
    gt = F.coalesce(F.nullif(F.col("gt"), F.lit("None")), F.nullif(F.col("gt-dblp"), F.lit("None")))
    out = m.select(F.col("id").alias("mid"), gt.alias("gt"), "canopy", attributes(F.coalesce("attrs", F.array().cast("array<string>"))).alias("attrs"))
    return out.where(F.col("gt").isNotNull()) if skip_unlabeled else out


def read_mentions(spark: SparkSession, path: str, *, skip_unlabeled: bool = False) -> DataFrame:
    return mentions(spark.read.text(path), skip_unlabeled=skip_unlabeled)


def read_labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(m1, m2, label, bad): two mentions in JSON and a label; ``bad`` marks lines without three columns."""
    c = F.split("value", "\t")
    return spark.read.text(path).select(c[0].alias("m1"), F.get(c, F.lit(1)).alias("m2"), F.get(c, F.lit(2)).cast("double").alias("label"), (F.size(c) != 3).alias("bad"))


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> ''").distinct()


def read_idf(spark: SparkSession, path: str) -> DataFrame:
    c = F.split("value", "\t")
    return spark.read.text(path).select(c[0].alias("w"), c[1].cast("double").alias("idf"))


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(pid, nn) of a preset neighbour file; ``none`` is null."""
    c = F.split("value", "\t")
    return spark.read.text(path).select(c[0].alias("pid"), F.nullif(c[1], F.lit("none")).alias("nn"))


def read_canopies(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("canopy")).where("canopy <> ''").distinct()


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(mid, cluster) of tab-separated lines; the cluster "None" is null."""
    c = F.split("value", "\t")
    return spark.read.text(path).select(c[0].alias("mid"), F.nullif(c[1], F.lit("None")).alias("cluster"))


def of_canopies(points: DataFrame, canopies: DataFrame) -> DataFrame:
    return points.join(canopies, "canopy", "left_semi")


def separated_line(spark: SparkSession, levels: int) -> DataFrame:
    """2**(levels-1) points on a line in a hierarchy of gaps: halves of a block of level k lie k-1
    apart (pid, label, vec); the label is the half of the whole that a point is in."""
    n = 1 << max(0, levels - 1)
    i = F.col("i")
    # Position: the pairs below it take one step each, and every level above adds its wider gap.
    at = sum((F.shiftright(i, k).cast("long") * F.lit(1) for k in range(levels - 1)), F.lit(0))
    return spark.range(n).select(F.col("id").alias("i")).select(
        at.cast("string").alias("pid"), F.when(i < n // 2, "1").otherwise("2").alias("label"), F.array(at.cast("double")).alias("vec"))


def shuffled(df: DataFrame, seed: int, *key: str) -> DataFrame:
    """``df`` in an order that depends on the seed and the key alone."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key)
