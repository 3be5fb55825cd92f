"""Outputs: daily CSV rows, per-day JSON, one document of all views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.config import TOOLS

COUNTS = ("input", "output", "cache_write", "cache_read")


def csv_rows(streaks: DataFrame) -> DataFrame:
    """The rows of the daily export: numbers only, no project, path or text."""
    return streaks.select(
        F.col("date").cast("string").alias("date"), F.col("total").alias("total_tokens"), *COUNTS, *TOOLS,
        F.format_string("%.4f", F.round("cost", 6) + 1e-9).alias("cost_usd_estimate"), "goal", F.col("met").cast("string").alias("goal_met"), "streak",
    )


def write_csv(streaks: DataFrame, path: str) -> None:
    csv_rows(streaks).orderBy("date").write.mode("overwrite").option("header", True).csv(path)


def daily_json(days: DataFrame) -> DataFrame:
    """Per day: a JSON document of its sums."""
    return days.select("date", F.to_json(F.struct(F.col("date").cast("string").alias("date"), *COUNTS, "total", F.round("cost", 6).alias("cost"))).alias("document"))


def as_document(views: dict[str, DataFrame]) -> DataFrame:
    """One row: a JSON object with a key for each view. Views are results of a few rows (a row a day at most)."""
    parts = None
    for name, view in views.items():
        own = view.agg(F.to_json(F.collect_list(F.struct(*view.columns))).alias(name))
        parts = own if parts is None else parts.crossJoin(own)
    return parts.select(F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in views]), F.lit("}")).alias("document"))
