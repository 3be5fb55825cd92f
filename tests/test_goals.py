from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from meterlake.config import Goal
from meterlake.functions.numbers import friendly_down
from meterlake.operators import daily, goals

START = date(2026, 3, 2)  # a Monday


def days_of(spark, totals, today=None):
    rows = [(START + timedelta(i), t) for i, t in enumerate(totals) if t is not None]
    df = spark.createDataFrame(rows, "date date, total bigint")
    return daily.dense(df, F.lit(today) if today else None)


def summary(spark, totals, freezes=False, rest=(), goal=100):
    table = goals.goal_table(spark, [Goal(START, goal, 5 * goal)])
    runs = goals.with_streaks(goals.judged_days(days_of(spark, totals), table, rest), freezes)
    return goals.streak_summary(runs, freezes).first()


LIT, OUT = 100, 10


@pytest.mark.parametrize(
    ("totals", "held", "earned", "used"),
    [
        ([LIT] * 6, 0, 0, 0),
        ([LIT] * 7, 1, 1, 0),
        ([LIT] * 14 + [OUT] + [LIT] * 6, 1, 2, 1),
        ([LIT] * 14 + [OUT] + [LIT] * 7, 2, 3, 1),
        ([LIT] * 30, 2, 2, 0),
    ],
)
def test_freezes_earned_and_spent(spark, totals, held, earned, used):
    s = summary(spark, totals, freezes=True)
    assert (s.freezes_held, s.freezes_earned, s.freezes_used) == (held, earned, used)


def test_a_freeze_bridges_a_miss(spark):
    s = summary(spark, [LIT] * 7 + [OUT] + [LIT] * 2, freezes=True)
    assert (s.current, s.freezes_used, s.current_start) == (9, 1, START)
    assert summary(spark, [LIT] * 7 + [OUT] + [LIT] * 2).current == 2


def test_rest_days_bridge_and_today_does_not_break(spark):
    week = [LIT] * 5 + [0, 0]
    assert summary(spark, [*week, LIT, LIT], rest=(5, 6)).current == 7
    assert summary(spark, [LIT, LIT, OUT]).current == 2
    assert summary(spark, [LIT, OUT, OUT]).current == 0


def test_the_longest_is_the_earliest_of_equals(spark):
    s = summary(spark, [LIT, LIT, OUT, LIT, LIT, OUT, OUT])
    assert (s.longest, s.longest_start, s.longest_end) == (2, START, START + timedelta(1))


def test_goals_change_and_hold_back_in_time(spark):
    g = goals.set_goal((), date(2026, 3, 5), 100)
    g = goals.set_goal(g, date(2026, 3, 8), 200, 900)
    assert [x.weekly for x in g] == [500, 900]
    assert goals.set_goal(g, date(2026, 3, 9), 200, 900) == g
    assert goals.set_goal(g, date(2026, 3, 5), 50) == (Goal(date(2026, 3, 5), 50, 250),)
    with pytest.raises(ValueError, match="above 0"):
        goals.set_goal(g, date(2026, 3, 9), 0)
    got = goals.judged_days(days_of(spark, [10] * 8), goals.goal_table(spark, g)).orderBy("date").collect()
    assert [r.goal for r in got] == [100] * 6 + [200] * 2


def test_friendly_steps(spark):
    given = {4_321_000: 4_000_000, 7_900_000: 6_000_000, 1_500: 1_500, 32_040_000: 30_000_000, 2_880_000: 2_500_000, 10**15: 10**15, 5: 5, 0: 1}
    df = spark.createDataFrame([(k,) for k in given], "v bigint").select("v", friendly_down(F.col("v")).alias("f"))
    assert {r.v: r.f for r in df.collect()} == given


def test_suggestion_without_history(spark):
    none = spark.createDataFrame([(START, 0)], "date date, total bigint").withColumn("today", F.lit(START))
    assert tuple(goals.suggest(none).first()) == (1_000_000, 5_000_000)


def test_no_goals_take_the_suggestion_from_the_first_day(spark):
    days = days_of(spark, [2_000_000] * 5)
    row = goals.effective_goals(goals.goal_table(spark, []), days).collect()
    assert [(r.effective_from, r.daily, r.weekly) for r in row] == [(START, 1_500_000, 8_000_000)]


def test_no_usage_gives_no_rows(spark):
    empty = spark.createDataFrame([], "date date, total bigint")
    days = daily.dense(empty)
    assert days.count() == 0
    judged = goals.with_streaks(goals.judged_days(days, goals.goal_table(spark, [Goal(START, 1, 5)])), True)
    assert judged.count() == 0
    assert goals.streak_summary(judged).first().current == 0
