"""Helpers shared by the corpus operators: table access, shared folders, folds and code shipping."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship  # noqa: F401  (ship is for the operators)

#: Bytes that a worker's memo may hold, about, before it is emptied; an entry counts ``ENTRY`` for
#: what Python keeps beside its key and value.
MEMO_BYTES, ENTRY = 64 << 20, 150
#: Rows up to which a side of a join is broadcast; beyond, both sides are shuffled.
SMALL = 300_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``, through Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str, **options) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame that ``written`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def by_size(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``big`` joined with ``small`` (a written table), which is broadcast if it has ``SMALL`` rows at most."""
    n = small.limit(SMALL + 1).count()
    return big.join(F.broadcast(small) if n <= SMALL else small.hint("merge"), on, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def opened(sent):
    """A broadcast's value, which the worker does not keep."""
    value = sent.value
    if getattr(sent, "_path", None):
        vars(sent).pop("_value", None)
    return value


def fold(doc_id: str | Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m`` (null for a null id)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(m)


def sampled(df: DataFrame, n: int, bound: int, *key: str) -> DataFrame:
    """A sample of about ``bound`` of the ``n`` rows, by a hash of ``key``: the same rows on every run."""
    if n <= bound:
        return df
    h = F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(1 << 30))
    return df.where(h < F.lit(int(bound / n * (1 << 30))))
