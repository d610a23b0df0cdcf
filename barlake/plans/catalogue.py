"""All registered queries and their SQL, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.config import Feature, compute
from ..functions.core import rounded
from ..operators.finite import with_returns
from ..operators.joins import asof_join
from ..operators.labels import fixed_percent
from . import analysis, bars, candles, indicators, streams, tables  # noqa: F401  modules register their queries
from .base import QUERIES, SQL, W, hourly


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with features, aligned with the last known four-hour bar, and the label of each."""
    fine = compute(with_returns(hourly(spark, sf_dir), W()), [Feature("sma", {"n": 10}), Feature("stddev", {"n": 10}), Feature("price_ratios")])
    coarse = analysis._coarse(spark, sf_dir)
    return rounded(fixed_percent(asof_join(fine, coarse, "ts", right_on="known"), 0.5, 0.25))
