"""Usage events from other tables, in the shape of the ledger.

Columns of a ledger: ts (UTC wall time), date, hour, weekday (0 is Monday), tool, model, project, session,
input, output, cache_write, cache_read, reasoning, other, total, cost, cache_savings, seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.functions import times


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_of() -> Column:
    """All tokens of an event; reasoning is part of output or other."""
    return F.col("input") + F.col("output") + F.col("cache_write") + F.col("cache_read") + F.col("other")


def with_local_time(events: DataFrame, timezone: str) -> DataFrame:
    """``events`` with date, hour and weekday of ts in ``timezone``."""
    local = times.local_time(F.col("ts"), timezone)
    return events.withColumns({"date": local.cast("date"), "hour": F.hour(local), "weekday": F.weekday(local)})


def raw_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as unpriced usage: tool by user, model by event type, a session a user and day."""
    user = F.col("user_id")
    return _table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when(user % 3 == 0, "claude").when(user % 3 == 1, "codex").otherwise("gemini").alias("tool"),
        F.col("event_type").alias("model"),
        F.concat(F.lit("p"), user % 7).alias("project"),
        F.concat_ws(":", user, F.col("ts").cast("date")).alias("session"),
        F.floor(F.col("value") * 100).cast("bigint").alias("input"),
        (F.col("event_id") % 500).alias("output"),
        (F.col("event_id") * 7 % 300).alias("cache_write"),
        (100 * F.get_json_object("props", "$.k").cast("bigint")).alias("cache_read"),
        F.lit(0).cast("bigint").alias("reasoning"),
        F.lit(0).cast("bigint").alias("other"),
        F.col("event_id").alias("seq"),
    )


def usage_from_events(spark: SparkSession, sf_dir: str, timezone: str = "UTC") -> DataFrame:
    """Ledger of the ``events`` table, priced by its first whole number of cents: cost is tokens over a million."""
    raw = with_local_time(raw_from_events(spark, sf_dir), timezone).withColumn("total", total_of())
    return raw.withColumns({"cost": F.col("total") / 1e6, "cache_savings": F.col("cache_read") / 2e6})


def usage_from_lineitem(spark: SparkSession, sf_dir: str, with_project: bool = False) -> DataFrame:
    """Ledger of several years from ``lineitem``, a session an order; projects (market segments) join in only on demand."""
    tool = F.when(F.col("l_returnflag") == "A", "claude").when(F.col("l_returnflag") == "N", "codex").otherwise("gemini")
    lines = _table(spark, sf_dir, "lineitem")
    lines = lines.join(_table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")) if with_project else lines.withColumn("p_brand", F.concat(F.lit("m"), F.col("l_suppkey") % 5))
    if with_project:
        orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    else:
        lines = lines.withColumn("c_mktsegment", F.lit("all"))
    out = lines.select(
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.col("l_shipdate").cast("date").alias("date"),
        tool.alias("tool"),
        F.col("p_brand").alias("model"),
        F.col("c_mktsegment").alias("project"),
        F.col("l_orderkey").cast("string").alias("session"),
        (F.col("l_quantity").cast("bigint") * 1000).alias("input"),
        (F.col("l_linenumber") * 100).cast("bigint").alias("output"),
        F.floor(F.col("l_discount") * 10000 + 0.5).cast("bigint").alias("cache_write"),
        F.floor("l_extendedprice").cast("bigint").alias("cache_read"),
        F.lit(0).cast("bigint").alias("reasoning"),
        F.lit(0).cast("bigint").alias("other"),
        (F.floor("l_extendedprice") * F.floor(F.col("l_tax") * 100 + 0.5) / 1e5).alias("cost"),
        (F.floor("l_extendedprice") / 1e6).alias("cache_savings"),
    )
    return out.withColumns({"hour": F.lit(0), "weekday": F.weekday("date"), "total": total_of()})
