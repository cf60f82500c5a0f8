"""All registered queries of the library proper, by topic module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspan.plans import models, relational, spans

_TOPICS = (relational, spans, models)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for t in _TOPICS for k, v in t.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for t in _TOPICS for k, v in t.ORACLES.items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.slice_(spark, sf_dir)
