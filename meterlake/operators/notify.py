"""Which notices are due, from a day's figures, the minute of the day and what was already sent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.config import Config
from meterlake.functions import times
from meterlake.functions.numbers import format_tokens

RECAP_MINUTE = 9 * 60
DEFAULT_REMINDER = 20 * 60


def _quiet(config: Config, minute: Column) -> Column:
    q = config.notifications.quiet_hours
    return times.in_quiet_hours(minute, F.lit(q.enabled), F.lit(q.start), F.lit(q.end))


def _reminder(config: Config) -> Column:
    return F.coalesce(times.minutes_of(F.lit(config.notifications.reminder_time)), F.lit(DEFAULT_REMINDER))


def day_context(streaks: DataFrame, starts_on: str = "monday") -> DataFrame:
    """Dense days with what notices look at: tokens, goal, run alive, and the figures of the week that ended before."""
    start = times.week_start(F.col("date"), starts_on)
    rows = streaks.withColumn("week", start)
    weeks = rows.groupBy("week").agg(F.sum("total").alias("week_tokens"), F.count_if("met").alias("week_met_days"), F.count_if(F.col("total") > 0).alias("week_active_days"))
    last = weeks.select(F.date_add("week", 7).alias("week"), F.col("week_tokens").alias("last_tokens"), F.col("week_met_days").alias("last_met_days"), F.col("week_active_days").alias("last_active_days"))
    return rows.join(F.broadcast(last), "week", "left").withColumns({"remaining": F.greatest(F.col("goal") - F.col("total"), F.lit(0)), "alive": F.coalesce(F.lag("run").over(Window.partitionBy().orderBy("date")), F.lit(0))})


def due(context: DataFrame, config: Config, sent: dict[str, Column] | None = None, onboarded: bool = True) -> DataFrame:
    """``context`` (with minute) and goal_due, at_risk_due, recap_due.

    ``sent`` has the dates of the last goal and at_risk notice and the week of the last recap. A goal notice
    waits through quiet hours; a warning goes out from the reminder minute on, not on rest days; a
    recap on the first day of a week from nine on, if the week before had usage.
    """
    n, c = config.notifications, F.col
    sent = sent or {}
    new = lambda kind, day: ~F.coalesce(sent[kind] == day, F.lit(False)) if kind in sent else F.lit(True)
    loud = ~_quiet(config, c("minute")) & F.lit(onboarded)
    goal = F.lit(n.goal_reached) & c("met") & loud & new("goal", c("date"))
    risk = F.lit(n.streak_at_risk) & (c("goal") > 0) & ~c("met") & (c("run") > 0) & ~c("rest") & (c("minute") >= _reminder(config)) & loud & new("at_risk", c("date"))
    first = c("date") == times.week_start(c("date"), config.week_starts_on)
    recap = F.lit(n.weekly_recap) & first & (c("minute") >= RECAP_MINUTE) & (F.coalesce("last_tokens", F.lit(0)) > 0) & loud & new("recap", F.date_sub("date", 7))
    return context.withColumns({"goal_due": goal, "at_risk_due": risk, "recap_due": recap})


def next_reminder(config: Config, now_minute: Column, sent_today: Column) -> Column:
    """The minute of today at which the warning should next be looked at: the reminder, or the end of quiet hours after it.

    Null if it is off, was sent, has passed, or quiet hours last over midnight.
    """
    q = config.notifications.quiet_hours
    at, end = _reminder(config), times.minutes_of(F.lit(q.end))
    target = F.when(~_quiet(config, at), at).when(end > at, end)
    return F.when(F.lit(config.notifications.streak_at_risk) & ~sent_today & (target > now_minute), target)


def ms_until_reminder(config: Config, now_utc: Column, sent_today: Column) -> Column:
    """Milliseconds from a UTC wall time to ``next_reminder``'s minute; null if there is none today."""
    now = times.minute_of_day(times.local_time(now_utc, config.timezone))
    return times.ms_until_minute(now_utc, next_reminder(config, now, sent_today), config.timezone)


def texts(due_rows: DataFrame) -> DataFrame:
    """Notices as rows: date, kind, text."""
    days = lambda n: F.concat(n.cast("string"), F.when(n == 1, F.lit(" day")).otherwise(F.lit(" days")))
    each = {
        "goal": F.concat(F.lit("Goal reached: "), format_tokens(F.col("total")), F.lit(" tokens, streak of "), days(F.col("run"))),
        "at_risk": F.concat(format_tokens(F.col("remaining")), F.lit(" tokens left to keep a streak of "), days(F.col("run"))),
        "recap": F.concat(F.lit("Last week: "), format_tokens(F.col("last_tokens")), F.lit(" tokens, goal met on "), days(F.col("last_met_days"))),
    }
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_due").alias("is_due"), t.alias("text")) for k, t in each.items()])
    return due_rows.withColumn("x", F.explode(kinds)).filter("x.is_due").select("date", "x.kind", "x.text")


def goal_crossings(before: DataFrame, now: DataFrame) -> DataFrame:
    """Dates that are met in the new figures and weren't in the earlier ones of the same date."""
    old = before.select("date", F.col("met").alias("was"))
    return now.join(old, "date").filter("met and not was").select("date", "total", "goal")
