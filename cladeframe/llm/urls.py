"""URL filters by a temporal list join, with DataFrame operations only.

Dated list entries (key, category, action, effective time) become validity intervals: an ``add``
opens one and the next entry of the same key and category closes it, so the intervals of a key and
category never overlap.  A capture is matched on its host, the host's parent domains, and its host
with the first path segment; an as-of join finds the entries active at its fetch time.  Captures
are first reduced to distinct (host, segment, time), so a hot host meets the list once per time
and not once per page; verdicts go back to the pages in ``SALTS`` copies, so that a hot host's pages
are dealt out to as many tasks.

Defined results: a null URL, or one without a host, is not blocked and has no active entries; a
null fetch time matches nothing; of entries with one key, category and time the removal wins;
repeated pages come back once each; a capture at an interval's very start is in it, at its end not;
a very long URL is matched whole; an empty list blocks nothing and an empty table of pages gives no
rows; other columns of the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Copies of a verdict, for pages of as many groups of input partitions.
SALTS = 8


def intervals(entries: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) of entries (key, category, action, effective); an open
    interval ends at null.  Repeated adds extend nothing: the first of a run opens the interval."""
    one = entries.where(F.col("key").isNotNull() & F.col("effective").isNotNull()).groupBy("key", "category", "effective").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("off"))
    w = Window.partitionBy("key", "category").orderBy("effective")
    turns = one.withColumn("before", F.lag("off", 1, 1).over(w)).where("off <> before")
    return turns.withColumn("valid_to", F.lead("effective").over(w)).where("off = 0").select("key", "category", F.col("effective").alias("valid_from"), "valid_to")


def host(url) -> F.Column:
    """Lower-case host of a URL, empty where there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


def segment(url) -> F.Column:
    """The first path segment of a URL, empty where there is none."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)


def keys(host_col, segment_col) -> F.Column:
    """All list keys that cover a page: host, parent domains of two labels or more, host/segment."""
    labels = F.split(host_col, r"\.")
    starts = F.when(F.size(labels) > 2, F.sequence(F.lit(1), F.size(labels) - 1)).otherwise(F.array(F.lit(1)))
    domains = F.transform(starts, lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    path = F.when(segment_col != "", F.array(F.concat(host_col, F.lit("/"), segment_col))).otherwise(F.array().cast("array<string>"))
    return F.when(host_col == "", F.array().cast("array<string>")).otherwise(F.concat(domains, path))


def filter_urls(pages: DataFrame, entries: DataFrame, *, page_id: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row per page: page_id, fetched, blocked, n_active (active entries), and the most specific
    active entry (longest key, then the first category): list_key, category, listed_since."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(fetched).alias("fetched"), F.coalesce(host(F.col(url)), F.lit("")).alias("h"), F.coalesce(segment(F.col(url)), F.lit("")).alias("s"))
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    asked = rows.where("h <> '' and fetched is not null").select("h", "s", "fetched").distinct()
    asked = asked.select("h", "s", "fetched", F.explode(keys(F.col("h"), F.col("s"))).alias("key"))
    spans = intervals(entries)
    active = asked.join(spans, "key").where((F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    best = F.min(F.struct((-F.length("key")).alias("l"), "key", "category", "valid_from")).alias("best")
    verdicts = active.groupBy("h", "s", "fetched").agg(F.count("*").alias("n_active"), best)
    verdicts = verdicts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("salt", salt).join(verdicts, ["h", "s", "fetched", "salt"], "left")
    return out.select(
        "page_id", "fetched", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.key").alias("list_key"), F.col("best.category").alias("category"), F.col("best.valid_from").alias("listed_since"),
    )
