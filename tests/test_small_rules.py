"""Small rules that no query shows: counters, stored unlocks, reminders, crossings, spans, price facts, tiers."""

from datetime import date, datetime

from pyspark.sql import functions as F

from meterlake.config import Config, Notifications, QuietHours
from meterlake.functions import times
from meterlake.operators import dedup, insights, notify, pricing
from meterlake.sources import codex


def test_removed_events_by_tool(spark):
    before = spark.createDataFrame([("claude",)] * 4 + [("codex",)], "tool string")
    after = spark.createDataFrame([("claude",)] * 3, "tool string")
    assert {(r.tool, r.removed) for r in dedup.message_duplicates(before, after).collect()} == {("claude", 1), ("codex", 1)}


def test_new_unlocks(spark):
    now = spark.createDataFrame([("a", date(2026, 1, 2)), ("b", None), ("c", date(2026, 1, 3))], "id string, unlocked_at date")
    stored = spark.createDataFrame([("a",)], "id string")
    assert [tuple(r) for r in insights.newly_unlocked(now, stored).collect()] == [("c", date(2026, 1, 3))]


def reminder(spark, at, quiet=None, on=True, now=600, sent=False):
    config = Config(notifications=Notifications(streak_at_risk=on, reminder_time=at, quiet_hours=quiet or QuietHours()))
    return spark.range(1).select(notify.next_reminder(config, F.lit(now), F.lit(sent))).first()[0]


def test_the_next_reminder(spark):
    assert reminder(spark, "20:30") == 1230 and reminder(spark, "20:30", now=1230) is None
    assert reminder(spark, "20:30", sent=True) is None and reminder(spark, "20:30", on=False) is None
    assert reminder(spark, "13:00", QuietHours(True, "12:00", "14:15")) == 855  # the end of quiet hours
    assert reminder(spark, "23:00", QuietHours(True, "22:00", "08:00")) is None  # quiet over midnight


def test_goals_reached_since(spark):
    kinds = "date date, total bigint, goal bigint, met boolean"
    d = [date(2026, 1, n) for n in (1, 2, 3)]
    before = spark.createDataFrame([(d[0], 5, 10, False), (d[1], 10, 10, True)], kinds)
    now = spark.createDataFrame([(d[0], 12, 10, True), (d[1], 13, 10, True), (d[2], 11, 10, True)], kinds)
    assert [tuple(r) for r in notify.goal_crossings(before, now).collect()] == [(d[0], 12, 10)]


def test_the_span_of_a_streak(spark):
    kinds = "current int, current_start date, longest int, longest_start date, longest_end date"
    days = spark.createDataFrame([(date(2026, 1, 9),)], "today date")
    span = lambda *row: [tuple(r) for r in insights.streak_span(spark.createDataFrame([row], kinds), days).collect()]
    a, b, c = date(2026, 1, 1), date(2026, 1, 4), date(2026, 1, 8)
    assert span(2, c, 4, a, b) == [(c, date(2026, 1, 9), 2, True)]
    assert span(0, None, 4, a, b) == [(a, b, 4, False)] and span(0, None, 0, None, None) == []


def test_price_facts(spark):
    rows = spark.createDataFrame([("m", True, 30), ("x", False, 10), ("x", False, 0), ("y", False, 0)], "model string, priced boolean, total bigint")
    row = pricing.pricing_info(spark.createDataFrame([], pricing.PRICE_COLUMNS), rows).first()
    assert (row.models, row.unpriced, row.unpriced_share) == (len(pricing.BUILT_IN), 1, 0.25)


def test_the_tier_of_a_settings_file():
    assert codex.default_tier('model = "x"\n service_tier = "priority"\n') and codex.default_tier("service_tier='fast'")
    assert not codex.default_tier('service_tier = "flex"') and not codex.default_tier("")


def test_instants_as_text(spark):
    row = spark.createDataFrame([(1_767_225_600_042, datetime(2026, 1, 1, 23, 59))], "ms bigint, t timestamp_ntz").select(times.format_rfc3339_ms(F.col("ms")), times.minute_of_day(F.col("t"))).first()
    assert tuple(row) == ("2026-01-01T00:00:00.042Z", 1439)
