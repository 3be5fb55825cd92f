"""Goals in effect, streaks, streak freezes and goal suggestions."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.config import Goal
from meterlake.functions import times
from meterlake.functions.numbers import friendly_down, ratio

#: Met days in a row that earn a freeze, and how many can be held.
FREEZE_EVERY, FREEZE_CAP = 7, 2
SUGGEST_DAYS, LEAST_GOAL = 30, 10_000
NO_HISTORY_GOALS = (1_000_000, 5_000_000)


def goal_table(spark: SparkSession, goals: Iterable[Goal]) -> DataFrame:
    return spark.createDataFrame([(g.effective_from, g.daily, g.weekly) for g in goals], "effective_from date, daily bigint, weekly bigint")


def set_goal(goals: Iterable[Goal], effective_from: date, daily: int, weekly: int = 0) -> tuple[Goal, ...]:
    """Goals with a change: it replaces those from its date on, and an unchanged goal adds nothing.

    A weekly goal of 0 stands for five times the daily one; a daily goal of 0 is an error.
    """
    if daily <= 0:
        raise ValueError("a daily goal is above 0")
    weekly = weekly or 5 * daily
    kept = sorted((g for g in goals if g.effective_from < effective_from), key=lambda g: g.effective_from)
    if kept and (kept[-1].daily, kept[-1].weekly) == (daily, weekly):
        return tuple(kept)
    return (*kept, Goal(effective_from, daily, weekly))


def goal_ranges(goals: DataFrame) -> DataFrame:
    """Goals with the dates [since, until) that each holds for; the first reaches back without end."""
    order = Window.partitionBy().orderBy("effective_from")
    since = F.when(F.row_number().over(order) == 1, F.lit("0001-01-01").cast("date")).otherwise(F.col("effective_from"))
    until = F.coalesce(F.lead("effective_from").over(order), F.lit("9999-12-31").cast("date"))
    return goals.select("daily", "weekly", since.alias("since"), until.alias("until"))


def with_goal(rows: DataFrame, goals: DataFrame, day: Column, names: dict[str, str]) -> DataFrame:
    """``rows`` with the goal in effect on ``day``; ``names`` maps daily and weekly to columns. 0 without goals.

    Goal versions are set by hand, a few at most: they are broadcast.
    """
    ranges = F.broadcast(goal_ranges(goals))
    out = rows.join(ranges, (day >= F.col("since")) & (day < F.col("until")), "left")
    return out.select(*rows.columns, *[F.coalesce(k, F.lit(0)).alias(v) for k, v in names.items()])


def judged_days(days: DataFrame, goals: DataFrame, rest_days: tuple[int, ...] = ()) -> DataFrame:
    """Dense ``days`` with goal, met, rest."""
    out = with_goal(days, goals, F.col("date"), {"daily": "goal"})
    return out.withColumns({"met": (F.col("goal") > 0) & (F.col("total") >= F.col("goal")), "rest": F.weekday("date").isin(*rest_days) if rest_days else F.lit(False)})


def frozen_days(judged: DataFrame) -> DataFrame:
    """One row: frozen (dates that a freeze bridged), held, earned, used, progress.

    What a day does depends on the freezes held after all days before, so the days (few thousand) are
    folded in order: seven met days in a row earn a freeze, held up to a cap; a miss that is no rest
    day and not today spends one if a run is alive; rest days pause the count.
    """
    day = F.struct("date", "met", F.col("rest").alias("rest"), (F.col("date") == F.col("today")).alias("is_today"))
    start = F.expr("named_struct('run', 0, 'since', 0, 'held', 0, 'earned', 0, 'used', 0, 'frozen', cast(array() as array<date>))")

    def step(s: Column, d: Column) -> Column:
        full = s.since + 1 == FREEZE_EVERY
        gains = full & (s.held < FREEZE_CAP)
        met = F.struct(
            (s.run + 1).alias("run"), F.when(full, 0).otherwise(s.since + 1).alias("since"), (s.held + gains.cast("int")).alias("held"),
            (s.earned + gains.cast("int")).alias("earned"), s.used.alias("used"), s.frozen.alias("frozen"),
        )
        spent = F.struct(s.run.alias("run"), F.lit(0).alias("since"), (s.held - 1).alias("held"), s.earned.alias("earned"), (s.used + 1).alias("used"), F.array_append(s.frozen, d.date).alias("frozen"))
        broken = F.struct(F.lit(0).alias("run"), F.lit(0).alias("since"), s.held.alias("held"), s.earned.alias("earned"), s.used.alias("used"), s.frozen.alias("frozen"))
        miss = F.when((s.run > 0) & (s.held > 0), spent).otherwise(broken)
        return F.when(d.met, met).when(d.rest | d.is_today, s).otherwise(miss)

    folded = judged.agg(F.aggregate(F.array_sort(F.collect_list(day)), start, step).alias("s"))
    return folded.select("s.frozen", "s.held", "s.earned", "s.used", F.col("s.since").alias("progress"))


def with_streaks(judged: DataFrame, freezes: bool = False) -> DataFrame:
    """Judged days with frozen, run (streak alive after the day), streak (run on met days, else 0), island.

    Days that break a run part the calendar into islands; a run is the number of met days so far in one.
    """
    if freezes:
        bridged = F.broadcast(frozen_days(judged).select(F.explode("frozen").alias("date"), F.lit(True).alias("frozen")))
        judged = judged.join(bridged, "date", "left").withColumn("frozen", F.coalesce("frozen", F.lit(False)))
    else:
        judged = judged.withColumn("frozen", F.lit(False))
    breaks = ~F.col("met") & ~F.col("rest") & ~F.col("frozen") & (F.col("date") != F.col("today"))
    order = Window.partitionBy().orderBy("date")
    out = judged.withColumn("island", F.sum(breaks.cast("int")).over(order))
    out = out.withColumn("run", F.sum(F.col("met").cast("int")).over(Window.partitionBy("island").orderBy("date")))
    return out.withColumn("streak", F.when(F.col("met"), F.col("run")).otherwise(0))


def streak_summary(streaks: DataFrame, freezes: bool = False) -> DataFrame:
    """One row: current run and its start, the longest (of equals the earliest) with start and end, flags, freezes."""
    starts = streaks.withColumn("run_start", F.min(F.when(F.col("met"), F.col("date"))).over(Window.partitionBy("island")))
    today = F.col("date") == F.col("today")
    best = F.max(F.when(F.col("met"), F.struct("run", (-F.unix_date("date")).alias("order"), F.col("date").alias("end"), F.col("run_start").alias("start"))))
    row = starts.agg(
        F.max(F.when(today, F.col("run"))).alias("current"),
        F.max(F.when(today & (F.col("run") > 0), F.col("run_start"))).alias("current_start"),
        best.alias("best"),
        F.bool_or(today & F.col("met")).alias("today_met"),
    )
    row = row.select(F.coalesce("current", F.lit(0)).alias("current"), "current_start", F.coalesce("best.run", F.lit(0)).alias("longest"), F.col("best.start").alias("longest_start"), F.col("best.end").alias("longest_end"), F.coalesce("today_met", F.lit(False)).alias("today_met"))
    row = row.withColumn("at_risk", ~F.col("today_met") & (F.col("current") > 0))
    if not freezes:
        return row.withColumns({"freezes_held": F.lit(0), "freezes_earned": F.lit(0), "freezes_used": F.lit(0), "next_freeze_in": F.lit(0)})
    facts = frozen_days(streaks.drop("frozen", "island", "run", "streak"))
    both = row.crossJoin(F.broadcast(facts))  # one row each
    return both.select(*row.columns, F.col("held").alias("freezes_held"), F.col("earned").alias("freezes_earned"), F.col("used").alias("freezes_used"), F.when(F.col("held") >= FREEZE_CAP, 0).otherwise(FREEZE_EVERY - F.col("progress")).alias("next_freeze_in"))


def judged_weeks(days: DataFrame, goals: DataFrame, starts_on: str = "monday") -> DataFrame:
    """Weeks of dense days with tokens, goal (in effect at the week's end or today), met, run of met weeks.

    The current week, while unmet, doesn't break a run.
    """
    weeks = days.groupBy(times.week_start(F.col("date"), starts_on).alias("start")).agg(F.sum("total").alias("tokens"), F.max("today").alias("today"))
    weeks = weeks.withColumns({"end": F.date_add("start", 6)}).withColumn("at", F.least("end", "today"))
    out = with_goal(weeks, goals, F.col("at"), {"weekly": "goal"})
    out = out.withColumn("met", (F.col("goal") > 0) & (F.col("tokens") >= F.col("goal")))
    current = F.col("start") == times.week_start(F.col("today"), starts_on)
    out = out.withColumn("island", F.sum((~F.col("met") & ~current).cast("int")).over(Window.partitionBy().orderBy("start")))
    return out.withColumn("run", F.sum(F.col("met").cast("int")).over(Window.partitionBy("island").orderBy("start"))).select("start", "end", "tokens", "goal", "met", "run")


def suggest(days: DataFrame) -> DataFrame:
    """One row, daily and weekly: 0.9 times the upper median of active days in the last 30, rounded down to a friendly step.

    ``days`` carry today. Without active days the fixed starting goals.
    """
    recent = F.when((F.col("date") >= F.date_sub("today", SUGGEST_DAYS)) & (F.col("date") <= F.col("today")) & (F.col("total") > 0), F.col("total"))
    row = days.agg(F.array_sort(F.collect_list(recent)).alias("v"))
    median = F.element_at("v", (F.floor(F.size("v") / 2) + 1).cast("int"))
    day = F.greatest(friendly_down(F.floor(median * 0.9).cast("bigint")), F.lit(LEAST_GOAL))
    row = row.select(F.size("v").alias("n"), F.when(F.size("v") > 0, day).alias("daily"))
    return row.select(F.when(F.col("n") > 0, F.col("daily")).otherwise(NO_HISTORY_GOALS[0]).alias("daily"), F.when(F.col("n") > 0, friendly_down(F.col("daily") * 6)).otherwise(NO_HISTORY_GOALS[1]).alias("weekly"))


def effective_goals(goals: DataFrame, days: DataFrame) -> DataFrame:
    """The goals, or if there are none the suggestion, in effect from the first day on."""
    first = days.agg(F.min("date").alias("effective_from")).crossJoin(F.broadcast(suggest(days)))  # one row each
    none = goals.agg(F.count("*").alias("n")).filter("n = 0")
    return goals.unionByName(first.crossJoin(F.broadcast(none)).select("effective_from", "daily", "weekly"))


def best_run_within(streaks: DataFrame, start: Column, end: Column) -> DataFrame:
    """One row, best: the longest run of met days within [start, end]; frozen and rest days and the last bridge it."""
    inside = streaks.filter((F.col("date") >= start) & (F.col("date") <= end))
    breaks = ~F.col("met") & ~F.col("frozen") & ~F.col("rest") & (F.col("date") != end)
    parted = inside.withColumn("part", F.sum(breaks.cast("int")).over(Window.partitionBy().orderBy("date")))
    return parted.groupBy("part").agg(F.sum(F.col("met").cast("int")).alias("run")).agg(F.coalesce(F.max("run"), F.lit(0)).alias("best"))


def simulate(days: DataFrame, goal: int, rest_days: tuple[int, ...] = (), freezes: bool = False) -> DataFrame:
    """One row, lit, current, best: what history would be with ``goal`` on every day."""
    rest = F.weekday("date").isin(*rest_days) if rest_days else F.lit(False)
    judged = days.withColumns({"goal": F.lit(goal), "met": (F.col("total") >= goal) & F.lit(goal > 0), "rest": rest})
    runs = with_streaks(judged, freezes)
    return runs.agg(F.count_if("met").alias("lit"), F.coalesce(F.max(F.when(F.col("date") == F.col("today"), F.col("run"))), F.lit(0)).alias("current"), F.coalesce(F.max("run"), F.lit(0)).alias("best"))


def weekly_progress(weeks: DataFrame) -> DataFrame:
    """One row: the current run of met weeks and the longest."""
    last = F.max_by("run", "start")
    return weeks.agg(F.coalesce(last, F.lit(0)).alias("weekly_current"), F.coalesce(F.max("run"), F.lit(0)).alias("weekly_longest"), ratio(F.sum(F.col("met").cast("int")), F.count("*")).alias("met_share"))
