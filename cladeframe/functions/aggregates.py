"""Group aggregates: sums, boxes and unions of attribute maps, weights of words, title vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scalar as S


def vector_groups(df: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """(by, n, vsum, centroid, low, high): sums and boxes of vectors, by position, with map-side sums."""
    flat = df.select(*by, F.posexplode(vec).alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    cells = flat.groupBy(*by, "pos").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "s", "lo", "hi", "n")))
    out = cells.groupBy(*by).agg(F.max("n").alias("n"), rows.alias("c"))
    part = lambda name: F.transform("c", lambda c: c[name])
    return out.select(*by, "n", part("s").alias("vsum"), F.transform("c", lambda c: c["s"] / c["n"]).alias("centroid"), part("lo").alias("low"), part("hi").alias("high"))


def merge_attributes(df: DataFrame, by: list[str], attrs: str = "attrs") -> DataFrame:
    """The union of attribute maps by group; values are sorted and distinct.  Copies of a value are
    removed before they are gathered, so a group holds its distinct values and no more."""
    flat = df.select(*by, F.explode(attrs).alias("k", "vs")).select(*by, "k", F.explode("vs").alias("v")).distinct()
    sets = flat.groupBy(*by, "k").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    return sets.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "vs")))).alias(attrs))


def idf(df: DataFrame, text: str) -> DataFrame:
    """(w, df, idf): ln(documents / documents with the word)."""
    n = df.count()
    words = df.select(F.explode(F.array_distinct(S.tokens(text))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    return words.select("w", "df", F.log(F.lit(float(n)) / F.col("df")).alias("idf"))


def without_stop_words(words, stop: list[str]):
    return F.array_except(words, F.array(*map(F.lit, stop)))


def title_vectors(titles: DataFrame, vectors: DataFrame, weights: DataFrame | None, stop: list[str], *, mid: str = "mid", title: str = "title") -> DataFrame:
    """(mid, tes, tea): per mention the unit sum of word vectors, each divided by its word's idf (1
    where it has none), and the same divided by the number of titles; zeros give null."""
    n = titles.groupBy(mid).agg(F.countDistinct(title).alias("n_titles"))
    words = titles.select(mid, F.explode(F.filter(S.tokens(title), lambda w: ~w.isin(stop) if stop else F.lit(True))).alias("w"))
    got = words.join(vectors.select("w", "vec"), "w")
    got = got.join(weights.select("w", "idf"), "w", "left") if weights is not None else got.withColumn("idf", F.lit(1.0))
    scaled = got.select(mid, S.scale("vec", F.coalesce("idf", F.lit(1.0))).alias("vec"))
    sums = vector_groups(scaled, [mid]).select(mid, "vsum").join(n, mid)
    return sums.select(mid, S.unit("vsum").alias("tes"), S.unit(S.scale("vsum", F.col("n_titles"))).alias("tea"))
