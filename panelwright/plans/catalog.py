"""All registered queries of the panel operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.plans import q_aggregates, q_functions, q_models, q_relational, q_sources, q_streams, q_text, q_windows  # noqa: F401
from panelwright.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature matrix: price, macro and filing features aligned on month ends."""
    return QUERIES["ml7_feature_matrix"](spark, sf_dir)
