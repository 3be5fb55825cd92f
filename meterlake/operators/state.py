"""Small state between runs: settings, unlocked achievements, what was sent; kept as JSON or tables."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEEP_ACKNOWLEDGED = 120


def merge(base: dict, patch: dict) -> dict:
    """``base`` with ``patch``: objects merge, any other value replaces."""
    out = dict(base)
    for k, v in patch.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """The JSON object at ``path`` over ``defaults``; the defaults if there is none or it is unreadable."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return dict(defaults)
    return merge(defaults, found) if isinstance(found, dict) else dict(defaults)


def save(path: str, value: dict[str, Any]) -> None:
    """Write as JSON; a reader sees the old file or the new one, never a part."""
    part = f"{path}.new"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=1, sort_keys=True)
    os.replace(part, path)


def read_json(spark: SparkSession, path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """``load`` from any file system of Spark's. A document that is there but can't be read is an error, not the defaults."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException:  # no such file
        return merge(defaults, {})
    try:
        found = json.loads(row[0]) if row else None
    except ValueError:
        found = None
    return merge(defaults, found if isinstance(found, dict) else {})


def write_json(spark: SparkSession, path: str, value: dict[str, Any]) -> None:
    """``save`` to any file system of Spark's."""
    fs, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at, part = fs.Path(path), fs.Path(f"{path}.new")
    stream = at.getFileSystem(conf).create(part, True)
    stream.write(bytearray(json.dumps(value, indent=1, sort_keys=True).encode()))
    stream.close()
    over = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    over[0] = getattr(fs, "Options$Rename").OVERWRITE
    fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf).rename(part, at, over)


def acknowledge(dates: list[str], day: str) -> list[str]:
    """Acknowledged dates with one more; the last ``KEEP_ACKNOWLEDGED`` stay."""
    return [*[d for d in dates if d != day], day][-KEEP_ACKNOWLEDGED:]


def merge_unlocks(stored: DataFrame, current: DataFrame) -> DataFrame:
    """Sticky unlock dates (id, unlocked_at): the earlier of stored and current ones."""
    rows = stored.select("id", "unlocked_at").unionByName(current.filter("unlocked_at is not null").select("id", "unlocked_at"))
    return rows.groupBy("id").agg(F.min("unlocked_at").alias("unlocked_at"))


def compare_days(ours: DataFrame, theirs: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Per date of either side (date, total, cost): whether totals are equal and costs within ``tolerance`` of theirs."""
    a, b = (d.select("date", F.col("total").alias(f"total_{n}"), F.col("cost").alias(f"cost_{n}")) for d, n in ((ours, "ours"), (theirs, "theirs")))
    both = a.join(b, "date", "full")
    near = F.abs(F.col("cost_ours") - F.col("cost_theirs")) <= F.greatest(F.abs("cost_theirs") * tolerance, F.lit(1e-6))
    return both.withColumns({"tokens_equal": F.coalesce(F.col("total_ours") == F.col("total_theirs"), F.lit(False)), "cost_near": F.coalesce(near, F.lit(False))})


def celebration(today: DataFrame, streak: DataFrame, celebrated: tuple[str, ...] = (), onboarded: bool = True) -> DataFrame:
    """One row if today's goal is met and wasn't celebrated: date, tokens, streak, new_record."""
    both = today.select(F.col("today").alias("date"), F.col("total").alias("tokens"), "met").crossJoin(F.broadcast(streak.select("current", "longest")))  # one row each
    due = F.col("met") & F.lit(onboarded) & ~F.col("date").cast("string").isin(*celebrated) if celebrated else F.col("met") & F.lit(onboarded)
    return both.filter(due).select("date", "tokens", F.col("current").alias("streak"), ((F.col("current") >= F.col("longest")) & (F.col("current") > 1)).alias("new_record"))
