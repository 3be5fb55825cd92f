from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from compare import duck, duck_rows, spark_rows
from meterlake.functions import numbers, times
from meterlake.operators import cards, goals, trail
from meterlake.plans import catalog

COLUMNS = "date date, today date, total bigint, goal bigint, met boolean, rest boolean, frozen boolean, input bigint, cache_read bigint, cache_write bigint, claude bigint, codex bigint, gemini bigint, cost double"
TODAY = date(2026, 3, 4)


def streaks_of(spark, totals, goal=1000, cost=0.5):
    """Dense days up to TODAY with these totals; half of the context is from the cache, a fifth of the tokens Codex's."""
    rows = []
    for back, n in enumerate(reversed(totals)):
        spent = cost[len(totals) - 1 - back] if isinstance(cost, list) else cost if n else 0.0
        rows.append((TODAY - timedelta(back), TODAY, n, goal, n >= goal, False, False, n // 2, n // 2, 0, n - n // 5, n // 5, 0, spent))
    return goals.with_streaks(spark.createDataFrame(rows, COLUMNS))


def card_of(spark, totals, template="streak", cost=0.5, **options):
    days = streaks_of(spark, totals, cost=cost)
    return cards.card(days, goals.streak_summary(days), template, **options).first()


def stats_of(card):
    return [(s.label, s.value) for s in card.stats]


def test_streak_cards(spark):
    live = card_of(spark, [0, 1500, 2000, 1200])
    assert (live.headline, live.subline, live.range_label) == ("3 days", "of unbroken light", "Mar 2 – 4, 2026")
    assert stats_of(live) == [("Tokens", "4.7K"), ("Best day", "2K"), ("From cache", "50%")]
    assert (live.since, live.trail_since, live.max_days) == (date(2026, 3, 2), date(2026, 2, 20), 13)
    assert [m.tool for m in live.mix] == ["claude", "codex"] and live.top_projects is None and live.chip is None
    spark_card = card_of(spark, [0, 0, 1500])
    assert (spark_card.headline, spark_card.subline, spark_card.range_label) == ("1 day", "the first spark of a streak", "Mar 4, 2026")
    past = card_of(spark, [1500, 1500, 10, 10], story=True, show_cost=True, show_mix=False)
    assert (past.headline, past.subline) == ("2 days", "my longest run of light") and past.mix == []
    assert stats_of(past) == [("Tokens", "3K"), ("Days lit", "2"), ("Est. cost", "$1"), ("From cache", "50%")]
    first = card_of(spark, [10, 0, 20])
    assert (first.headline, first.subline, first.max_days) == ("Day one", "and the trail begins", 14)
    assert stats_of(first) == [("Tokens", "30"), ("Active days", "2"), ("From cache", "50%")]


def test_long_streaks(spark):
    long = [1500] * 1001
    card, plain = card_of(spark, long, story=True), card_of(spark, long, story=True, grouped=False)
    assert card.headline == "1,001 days" and ("Days lit", "1,001") in stats_of(card)
    assert plain.headline == "1001 days" and ("Days lit", "1001") in stats_of(plain)


def test_long_streaks_as_their_sql(spark, tmp_path):
    """Ten copies of every order's lines: every day meets its goal."""
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.01/{name}.parquet")
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    copies = lines.crossJoin(spark.range(10).withColumnRenamed("id", "k")).withColumn("l_orderkey", F.col("l_orderkey") + F.col("k") * 1_000_000).drop("k")
    copies.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = spark_rows(catalog.QUERIES["streak_card"](spark, str(tmp_path)))
    assert found == duck_rows(duck(str(tmp_path)), catalog.ORACLES["streak_card"]) and any("2499 days" in r for r in found[1])


def test_year_cards(spark):
    names = spark.createDataFrame([(["a", "b", "c", "d"],)], "top_projects array<string>")
    year = card_of(spark, [1500] * 3 + [0] + [1500] * 396, "year", story=True, top_projects=names)
    assert (year.headline, year.subline, year.range_label) == ("My year", "in light · 548K tokens", "Last 365 days")
    assert stats_of(year) == [("Days lit", "365"), ("Best streak", "365"), ("Busiest day", "1.5K"), ("From cache", "50%")]
    assert year.top_projects == ["a", "b", "c"] and (year.since, year.max_days) == (date(2025, 3, 5), 365)
    priced = card_of(spark, [1500] * 2, "year", show_cost=True)
    assert stats_of(priced) == [("Days lit", "2"), ("Best streak", "2"), ("Est. cost", "$1")]
    assert stats_of(card_of(spark, [0, 0], "year"))[2] == ("Busiest day", "—")


def test_lean_cards(spark):
    costs = [1.0] * 30 + [0.25] * 7
    lean = card_of(spark, [1000] * 37, "lean", cost=costs)
    assert (lean.headline, lean.subline, lean.chip) == ("71% leaner", "per token than usual, my leanest week yet", "Personal best · leanest week")
    assert (lean.since, lean.until, lean.max_days, lean.range_label) == (date(2026, 2, 26), TODAY, 7, "Feb 26 – Mar 4, 2026")
    assert stats_of(lean) == [("From cache", "50%"), ("Tokens", "7K"), ("Per token vs usual", "−71%")]
    priced = card_of(spark, [1000] * 37, "lean", cost=costs, show_cost=True, story=True)
    assert (priced.headline, priced.subline) == ("$250.00", "per million tokens, my leanest week yet")
    assert stats_of(priced) == [("From cache", "50%"), ("Tokens", "7K"), ("Est. cost", "$1.75"), ("Per 1M vs usual", "−71%")]
    short = card_of(spark, [1000] * 27, "lean")  # a day short of what a personal best needs
    assert (short.headline, short.subline, short.chip) == ("My week", "in light · 50% from cache", None)
    same = card_of(spark, [1000] * 28, "lean")
    assert (same.headline, stats_of(same)[2]) == ("50%", ("Active days", "7 of 7"))
    none = card_of(spark, [0, 0, 5], "lean")
    assert (none.since, none.until, none.headline) == (date(2026, 2, 26), TODAY, "My week")


def test_no_days_no_card(spark):
    days = streaks_of(spark, [1000]).limit(0)
    for template in cards.TEMPLATES:
        assert cards.card(days, goals.streak_summary(streaks_of(spark, [1000])), template).count() == 0


def test_buckets_end_with_the_newest(spark):
    totals = [0, 0, 0, 1000, 1200, 10, 3000, 20, 500]
    history, head = trail.trail_range(streaks_of(spark, totals), F.lit(date(2026, 1, 1)), F.lit(TODAY))
    got = [(r.days, r.tokens, r.lit_days, r.kind) for r in trail.trail_buckets(history, head, 3).orderBy("pos").collect()]
    assert got == [(2, 0.0, 0, "dark"), (3, 2200 / 3, 2, "lit"), (3, 1010.0, 1, "wisp"), (1, 500.0, 0, "today")]
    split = trail.trail_buckets(history, head, 3, F.lit(TODAY - timedelta(2))).orderBy("pos").collect()
    assert [(r.days, r.kind) for r in split] == [(3, "dark"), (3, "lit"), (1, "lit"), (1, "wisp"), (1, "today")]
    assert [round(r.reach, 3) for r in split[2:]] == [2.5, 0.02, 0.5] and [r.codex_share for r in split[2:]] == pytest.approx([0.2, 0.2, 0.2])
    assert [r.kind for r in trail.trail_buckets(history.limit(0), head, 7).collect()] == ["today"]


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_spans_of_dates(spark):
    day = lambda text: F.lit(text).cast("date")
    given = [("2026-09-26", "2026-09-26"), ("2026-09-17", "2026-09-26"), ("2026-08-17", "2026-09-26"), ("2025-12-28", "2026-01-03")]
    assert one(spark, *[times.day_span(day(a), day(b)) for a, b in given]) == ("Sep 26, 2026", "Sep 17 – 26, 2026", "Aug 17 – Sep 26, 2026", "Dec 28, 2025 – Jan 3, 2026")
    assert one(spark, *[times.month_span(day(a), day(b)) for a, b in given[1:]]) == ("Sep 2026", "Aug – Sep 2026", "Dec 2025 – Jan 2026")
    assert one(spark, times.long_date(day("2026-09-26"), day("2026-01-01")), times.long_date(day("2025-09-26"), day("2026-01-01"))) == ("Saturday, September 26", "Friday, September 26, 2025")


def test_sentences(spark):
    lit = F.lit
    copy = lambda total, goal: tuple(one(spark, numbers.progress_copy(lit(total), lit(goal)))[0])
    assert copy(5, 0) == ("", "No daily goal yet")
    assert copy(2_500_000, 2_000_000) == ("+500K", "past your goal · nicely done") and copy(2_000_100, 2_000_000) == ("Goal lit", "right on the mark · nicely done")
    assert copy(0, 2_000_000) == ("2M", "to light today’s trail") and copy(1_999_400, 2_000_000)[0] == "Under 1K" and copy(1_500_000, 2_000_000)[0] == "500K"
    moods = [(True, False, 3, 3), (False, True, 3, 3), (False, False, 2, 3), (False, False, 0, 3), (False, False, 0, 0)]
    assert one(spark, *[numbers.streak_mood(*map(lit, m)) for m in moods]) == ("lit", "risk", "idle", "broken", "none")
    lines = [(5, True), (1, True), (5, False)]
    assert one(spark, *[numbers.celebration_line(lit(n), lit(new)) for n, new in lines]) == ("Goal lit. A new record: 5 days.", "Goal lit. Your trail begins.", "Goal lit. 5 days and counting.")
    assert one(spark, *[numbers.cache_delta_copy(lit(n)) for n in (1, 4, -3)]) == (None, "4 pts above usual", "3 pts under usual")
    assert one(spark, *[numbers.lean_copy(lit(r)) for r in (0.01, 0.12, -0.17)]) == (None, "12% leaner than usual", "17% pricier than usual")
    assert one(spark, *[numbers.trail_summary(lit(a), lit(b), lit(0.5)) for a, b in ((3, 9), (0, 9), (0, 0))]) == ("3-day streak, today 50% of goal, best 9 days", "No current streak, best run 9 days, today 50% of goal", "Your trail starts today, today 50% of goal")
    said = one(spark, *[numbers.efficiency_line(lit(s), lit(t), lit(0.9)) for s, t in ((0, 0), (85, 1), (65, 1), (45, 1), (5, 1))])
    assert [x.split(".")[0] for x in said] == ["No tokens yet today", "Lean and warm", "A smooth day", "Steady", "Warming up"] and "90% of context" in said[1]
    assert one(spark, *[numbers.goal_presets(lit(n)) for n in (0, 2_000_000)]) == ((250_000, 500_000, 1_000_000), (1_000_000, 2_000_000, 4_000_000))


@pytest.mark.parametrize("name", ["streak_card", "lean_card", "year_card"])
def test_cards_of_more_days(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    assert spark_rows(catalog.QUERIES[name](spark, sf_dir)) == duck_rows(duck(sf_dir), catalog.ORACLES[name])
