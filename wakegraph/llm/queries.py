"""Queries of the operators of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakegraph.llm import matching, mixing, parsing, spans, tokens
from wakegraph.session import table


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return p2_matches(spark, base).where("method_fqn is not null").select("symbol_id", "method_fqn")


def p2_matches(spark: SparkSession, base: str) -> DataFrame:
    return matching.match_symbols(table(spark, base, "changed_symbols"), table(spark, base, "method_nodes"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return parsing.judge_files(table(spark, base, "repo_files")).where("status <> 'valid'").select("repo_id", "path").distinct()


def p5_files(spark: SparkSession, base: str) -> DataFrame:
    return parsing.judge_files(table(spark, base, "repo_files"))


def p5_rates(spark: SparkSession, base: str) -> DataFrame:
    return parsing.parse_rates(parsing.judge_files(table(spark, base, "repo_files")))


def p7_ids(spark: SparkSession, base: str) -> DataFrame:
    return tokens.encode_documents(table(spark, base, "documents"))


def _counted(spark: SparkSession, base: str) -> DataFrame:
    return tokens.token_counts(table(spark, base, "documents"))


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    plan = mixing.mixture_plan(_counted(spark, base), table(spark, base, "mix_targets"))
    return plan.where("short").select("mix_id", "source")


def p8_mixture(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mixture(_counted(spark, base), table(spark, base, "mix_targets"))[0]


def p8_shares(spark: SparkSession, base: str) -> DataFrame:
    return mixing.mixture(_counted(spark, base), table(spark, base, "mix_targets"))[1]


def p9_found(spark: SparkSession, base: str) -> DataFrame:
    return spans.SharedSpans(table(spark, base, "documents")).found()


def p9_shared(spark: SparkSession, base: str) -> DataFrame:
    return spans.SharedSpans(table(spark, base, "documents")).coverage()


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_matches, p5_found, p5_files, p5_rates, p7_ids, p8_found, p8_mixture, p8_shares, p9_found, p9_shared)
}

SQL: dict[str, str] = {}
