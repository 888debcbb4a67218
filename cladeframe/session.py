"""Shared folders of a session, and the code that its workers need."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local runs and tests one of our own where it is unset.  A
    cluster must name one, as its machines share no temporary folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(sc, "_cladeframe_folder"):
        sc._cladeframe_folder = "file://" + tempfile.mkdtemp(prefix="cladeframe-")
    return sc._cladeframe_folder


#: With this set, a query's shuffle files go when the query ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def unshuffled(spark: SparkSession):
    """Of queries that run inside, what was shuffled is deleted once they end."""
    had = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if had is None else spark.conf.set(_CLEANUP, had)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that iterations keep short plans and a
    lost executor costs no more than its tasks.  What was shuffled for it is deleted once it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with unshuffled(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df`` dealt out by a key where it comes in fewer partitions than there are cores (a small table in
    one file); a table of many splits is left as it is, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *key) if df.rdd.getNumPartitions() < n else df


def spread_groups(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by the key of costly groups.  Of few groups the sizes are counted, and the number of
    partitions is one by which the fullest task has least to do, in squares of group sizes."""
    n = 8 * df.sparkSession.sparkContext.defaultParallelism
    few = df.groupBy(key).agg(F.count("*").alias("n")).select(F.hash(key).alias("h"), "n").limit(1001).collect()
    if len(few) <= 1000:

        def most(parts: int) -> int:
            load: dict[int, int] = {}
            for r in few:
                load[r.h % parts] = load.get(r.h % parts, 0) + r.n**2
            return max(load.values(), default=0)

        n = min(range(n, 2 * n), key=most)
    return df.repartition(n, key)


def drop(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``cut`` returned, once nothing reads them any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that they need no copy of it."""
    sc = spark.sparkContext
    if getattr(sc, "_cladeframe_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="cladeframe-"), "cladeframe_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._cladeframe_shipped = True
