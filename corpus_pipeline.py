"""A training corpus from ``documents``: five stages, each one operator.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, written as Parquet and read again as the next one's
``docs``.  All but the last return the columns of ``documents``; the last adds
``shard`` and ``slot``.

1. ``language``: documents whose language is not recognised go.
2. ``near_duplicates``: one document of each SimHash component stays.
3. ``decontaminate``: documents that hold a window of a benchmark item go.
4. ``mix``: documents are repeated or left out until sources meet their
   target weights.
5. ``shard``: a uniform shuffle into shards of equal row counts.

Every stage takes an empty table, nulls in any column, repeated rows and
extra columns (see the operators' docstrings).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cabgrid.llm import decontaminate, langid, mixing, sharding, simhash
from cabgrid.llm.common import table, written

SHARDS = 24

#: Language learning, component search and entropy balancing have no SQL form.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("mix", mix),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
