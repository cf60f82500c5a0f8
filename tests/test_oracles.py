"""Every query that SQL can express, against DuckDB on the smallest tables; the others run and keep their schema."""

from __future__ import annotations

import pytest

from quillspan.plans import registry
from tests.conftest import DATA

SQL = registry.oracle_sql()
#: Models that take long; those of chains, heads, probes and boosting have their own files.
SLOW = {"crf_training", "crf_exact_k", "transition_fit", "span_head", "global_ranking", "newton_probe", "candidate_boosting", "candidate_logistic", "candidate_trees", "style_classifier", "linear_probe_oof", "calibrate_beta"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, same_as_sql):
    same_as_sql(registry.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - SLOW))
def test_runs(name, spark):
    df = registry.queries()[name](spark, DATA)
    assert df.columns and df.limit(5).collect() is not None


def test_entry_rebuilds_every_document(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all(r["contiguous"] and r["same_length"] and r["same_text"] for r in rows)


def test_linear_probe_separates(spark):
    from pyspark.sql import functions as F

    from quillspan.operators import scoring

    df = spark.range(200).select((F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) > 9).cast("int").alias("y"))
    out = scoring.probability(scoring.linear_probe(df, ["x"]), df)
    assert out.where("(score > 0.5) <> (y = 1)").count() == 0
