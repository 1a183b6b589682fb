"""Registered queries of the training-data operators and their DuckDB SQL.

Each query applies its operator, with production parameters, to its whole
table and derives the contract's columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    chat,
    decontaminate,
    langid,
    linechunks,
    mixing,
    pii,
    quality,
    search,
    sharding,
    simhash,
    substring,
    tokens,
    whitening,
)
from .common import table


def op1_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op2_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op3_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op6_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op8_hypergeometric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.whole_digest(table(spark, sf_dir, "documents"))


def op11_overlap_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(table(spark, sf_dir, "documents"))


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bidiagonal_qd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_relative_lz": op1_relative_lz,
    "op2_bitmask": op2_bitmask,
    "op3_entropy_balancing": op3_entropy_balancing,
    "op4_winnowing": op4_winnowing,
    "op5_weak_supervision": op5_weak_supervision,
    "op6_prefix_tree": op6_prefix_tree,
    "op7_host_rules": op7_host_rules,
    "op8_hypergeometric": op8_hypergeometric,
    "op9_simhash": op9_simhash,
    "op10_line_chunks": op10_line_chunks,
    "op11_overlap_resync": op11_overlap_resync,
    "op12_dual_tree": op12_dual_tree,
    "op13_bidiagonal_qd": op13_bidiagonal_qd,
}

SQL: dict[str, str] = {
    "op1_relative_lz": substring.ORACLE,
    "op4_winnowing": decontaminate.ORACLE,
    "op6_prefix_tree": chat.ORACLE,
    "op7_host_rules": quality.ORACLE,
    "op10_line_chunks": linechunks.ORACLE,
    "op12_dual_tree": search.ORACLE,
}
