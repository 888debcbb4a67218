"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``docs`` may be
read more than once.  All stages but the last return the columns of documents.  A caller writes each
stage's rows as Parquet and reads them again as the next stage's ``docs``; ``run`` does so in the
shared folder and deletes what no later stage reads.

Only the text column goes to Python, for its verdict; no stage shuffles the text, but the third where
the rows that go, or the candidates, are many.

Defined results: null and empty texts are not toxic, fail the quality base rule and so go at the
second stage; without labels nothing is rejected as toxic and only the base rule rejects; each row is
judged by its own text, whatever its id; equal documents are one group, of which the first row by id
and text digest stays, and of rows that repeat one id and text one; very long texts are judged whole;
columns of any other name are kept as they are; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeframe.llm import bpe, decontam, minhash, rules, toxicity
from cladeframe.llm.common import drop_written, table, written
from cladeframe.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    found = rules.fit(rules.statistics(rules.labelled(docs, labels)), labels)
    return rules.keep_good(docs, found)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]

#: Trained verdicts and BPE have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, before, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            drop_written(before)
        before = docs
    return docs
