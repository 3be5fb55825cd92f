"""Daily, weekly and monthly rollups of a ledger.

The ledger is aggregated to days once, with partial sums before the shuffle; everything after works on
days, of which there are a few thousand, so windows over all of them are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.config import TOOLS
from meterlake.functions import times
from meterlake.functions.numbers import ratio

COUNTS = ("input", "output", "cache_write", "cache_read", "reasoning", "other", "total")
#: Measures of a day that are 0 where nothing was used.
MEASURES = (*COUNTS, "cost", *TOOLS, *(f"{t}_cost" for t in TOOLS), "messages", "sessions")


def daily(ledger: DataFrame) -> DataFrame:
    """Per local date: token sums, cost, both by tool, messages, distinct sessions, last instant."""
    by_tool = [F.sum(F.when(F.col("tool") == t, F.col("total")).otherwise(0)).alias(t) for t in TOOLS]
    cost_by_tool = [F.sum(F.when(F.col("tool") == t, F.col("cost")).otherwise(0.0)).alias(f"{t}_cost") for t in TOOLS]
    sums = [F.sum(c).alias(c) for c in (*COUNTS, "cost")]
    # one row a day, tool and session first: distinct sessions are then counted from partial sums
    by_session = ledger.groupBy("date", "tool", "session").agg(*[F.sum(c).alias(c) for c in (*COUNTS, "cost")], F.count("*").alias("messages"), F.max("ts").alias("last_ts"))
    return by_session.groupBy("date").agg(*sums, *by_tool, *cost_by_tool, F.sum("messages").alias("messages"), F.count("*").alias("sessions"), F.max("last_ts").alias("last_ts"))


def hourly(ledger: DataFrame) -> DataFrame:
    """Per date: an array of 24 sums."""
    sums = ledger.groupBy("date").agg(*[F.sum(F.when(F.col("hour") == h, F.col("total")).otherwise(0)).alias(f"h{h}") for h in range(24)])
    return sums.select("date", F.array(*[F.col(f"h{h}") for h in range(24)]).alias("hourly"))


def with_today(days: DataFrame, today: Column | None = None) -> DataFrame:
    """``days`` with the column today: the given date, or the last day with usage."""
    return days.withColumn("today", today if today is not None else F.max("date").over(Window.partitionBy()))


def dense(days: DataFrame, today: Column | None = None) -> DataFrame:
    """A row for each date from the first with usage (or today) to today, zeros where nothing was used; with today."""
    bounds = days.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    end = today if today is not None else F.col("last")
    calendar = bounds.filter("first is not null").select(F.explode(F.sequence(F.least("first", end), end)).alias("date"), end.alias("today"))
    have = [c for c in MEASURES if c in days.columns]
    return calendar.join(days, "date", "left").select("date", "today", *[F.coalesce(c, F.lit(0)).alias(c) for c in have], *[c for c in days.columns if c not in have and c not in ("date", "today")])


def periods(days: DataFrame, start: Column, last: Column, step: str, key: Column) -> DataFrame:
    """Per period from the first day's to today's, empty ones included: key, start, end, sums, active days.

    ``days`` are dense. ``start`` is a day's period start, ``last`` the end of the period that begins at
    ``start``, ``step`` the SQL interval between periods.
    """
    sums = days.withColumn("start", start).groupBy("start").agg(*[F.sum(c).alias(c) for c in ("total", "cost", *TOOLS)], F.count_if(F.col("total") > 0).alias("active_days"))
    return sums.select(key.alias("key"), "start", last.alias("end"), "total", "cost", *TOOLS, "active_days")


def weekly(days: DataFrame, starts_on: str = "monday") -> DataFrame:
    """Weeks of dense ``days``."""
    return periods(days, times.week_start(F.col("date"), starts_on), F.date_add("start", 6), "7 days", F.col("start").cast("string"))


def monthly(days: DataFrame) -> DataFrame:
    """Months of dense ``days``."""
    return periods(days, times.month_start(F.col("date")), F.last_day("start"), "1 month", F.date_format("start", "yyyy-MM"))


def period_bars(rows: DataFrame, n: int) -> DataFrame:
    """The last ``n`` periods."""
    return rows.orderBy(F.desc("start")).limit(n)


def today_view(days: DataFrame, goal: Column) -> DataFrame:
    """One row about today: sums, progress to ``goal``, rest, ratio to the mean of active days in the 30 days before."""
    today, past = F.col("date") == F.col("today"), (F.col("date") < F.col("today")) & (F.col("date") >= F.date_sub("today", 30)) & (F.col("total") > 0)
    of = lambda c: F.coalesce(F.sum(F.when(today, F.col(c))), F.lit(0)).alias(c)
    row = days.groupBy("today").agg(*[of(c) for c in (*COUNTS, "cost", *TOOLS, "messages", "sessions")], F.avg(F.when(past, F.col("total"))).alias("usual"))
    total = F.col("total")
    shares = {f"{t}_share": ratio(F.col(t), F.col("claude") + F.col("codex") + F.col("gemini")) for t in TOOLS}
    return row.withColumns({"goal": goal, **shares}).withColumns(
        {
            "progress": ratio(total, F.col("goal")),
            "met": (F.col("goal") > 0) & (total >= F.col("goal")),
            "remaining": F.greatest(F.col("goal") - total, F.lit(0)),
            "vs_usual": F.when(F.col("usual") > 0, total / F.col("usual")),
        }
    )


def this_week(days: DataFrame, starts_on: str, goal: Column) -> DataFrame:
    """One row: the current week's start, end, tokens, goal, progress, days left. Days after today in it count."""
    start = times.week_start(F.col("today"), starts_on)
    inside = (F.col("date") >= start) & (F.col("date") <= F.date_add(start, 6))
    row = days.groupBy("today").agg(F.coalesce(F.sum(F.when(inside, F.col("total"))), F.lit(0)).alias("tokens"))
    row = row.withColumns({"start": start, "end": F.date_add(start, 6), "goal": goal})
    return row.withColumns({"progress": ratio(F.col("tokens"), F.col("goal")), "met": (F.col("goal") > 0) & (F.col("tokens") >= F.col("goal")), "days_left": F.greatest(F.datediff("end", "today"), F.lit(0))})


def window_sums(days: DataFrame, size: int, value: str = "total") -> DataFrame:
    """Sums of consecutive windows of ``size`` rows from the first; an incomplete last one is left out."""
    numbered = days.withColumn("window", F.floor((F.row_number().over(Window.partitionBy().orderBy("date")) - 1) / size))
    return numbered.groupBy("window").agg(F.sum(value).alias("tokens"), F.count("*").alias("n")).filter(F.col("n") == size).drop("n")
