"""Rollups, goals and streaks over the adapters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.config import Goal
from meterlake.functions import numbers, times
from meterlake.operators import daily as D
from meterlake.operators import goals as G
from meterlake.plans.registry import query
from meterlake.sources.adapters import usage_from_events, usage_from_lineitem, with_local_time

GOALS = (Goal(date(1995, 2, 1), 1_000_000, 8_000_000), Goal(date(1997, 6, 1), 1_300_000, 9_500_000), Goal(date(2000, 1, 1), 1_100_000, 9_000_000))
REST = (5, 6)

E_SQL = """
e AS (
  SELECT event_id AS seq, ts, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday,
    CASE user_id % 3 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' ELSE 'gemini' END AS tool, event_type AS model,
    'p' || (user_id % 7) AS project, user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session,
    CAST(floor(value * 100) AS BIGINT) AS input, event_id % 500 AS output, (event_id * 7) % 300 AS cache_write,
    100 * CAST(json_extract_string(props, '$.k') AS BIGINT) AS cache_read
  FROM events),
ev AS (SELECT *, input + output + cache_write + cache_read AS total, (input + output + cache_write + cache_read) / 1e6 AS cost,
  cache_read / 2e6 AS cache_savings FROM e)
"""
L_SQL = """
li AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_shipdate AS ts,
    CASE l_returnflag WHEN 'A' THEN 'claude' WHEN 'N' THEN 'codex' ELSE 'gemini' END AS tool,
    CAST(l_orderkey AS VARCHAR) AS session, l_orderkey, l_partkey, l_suppkey,
    CAST(l_quantity AS BIGINT) * 1000 AS input, l_linenumber * 100 AS output,
    CAST(floor(l_discount * 10000 + 0.5) AS BIGINT) AS cache_write, CAST(floor(l_extendedprice) AS BIGINT) AS cache_read,
    floor(l_extendedprice) * floor(l_tax * 100 + 0.5) / 1e5 AS cost, floor(l_extendedprice) / 1e6 AS cache_savings, 'm' || (l_suppkey % 5) AS model
  FROM lineitem),
l AS (SELECT *, input + output + cache_write + cache_read AS total FROM li)
"""
DAY_SQL = (
    L_SQL
    + """,
dd AS (
  SELECT date, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_write) AS BIGINT) AS cache_write,
    CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(total) AS BIGINT) AS total, sum(cost) AS cost,
    CAST(coalesce(sum(total) FILTER (WHERE tool = 'claude'), 0) AS BIGINT) AS claude,
    CAST(coalesce(sum(total) FILTER (WHERE tool = 'codex'), 0) AS BIGINT) AS codex,
    CAST(coalesce(sum(total) FILTER (WHERE tool = 'gemini'), 0) AS BIGINT) AS gemini,
    count(*) AS messages, count(DISTINCT tool || session) AS sessions
  FROM l GROUP BY date),
bounds AS (SELECT min(date) AS first, max(date) AS today FROM dd),
d AS (
  SELECT c.date, today, coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(cache_write, 0) AS cache_write,
    coalesce(cache_read, 0) AS cache_read, coalesce(total, 0) AS total, coalesce(cost, 0) AS cost, coalesce(claude, 0) AS claude,
    coalesce(codex, 0) AS codex, coalesce(gemini, 0) AS gemini, coalesce(messages, 0) AS messages, coalesce(sessions, 0) AS sessions
  FROM (SELECT CAST(unnest(generate_series(CAST(first AS TIMESTAMP), CAST(today AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date, today FROM bounds) c
  LEFT JOIN dd USING (date))
"""
)
GOAL_SQL = """
goals(since, until, daily, weekly) AS (VALUES
  (DATE '0001-01-01', DATE '1997-06-01', 1000000, 8000000), (DATE '1997-06-01', DATE '2000-01-01', 1300000, 9500000),
  (DATE '2000-01-01', DATE '9999-12-31', 1100000, 9000000)),
j AS (
  SELECT d.*, goals.daily AS goal, total >= goals.daily AS met, isodow(date) IN (6, 7) AS rest
  FROM d JOIN goals ON date >= since AND date < until)
"""
ISLAND_SQL = """
i AS (SELECT *, sum(CAST(NOT met AND NOT rest AND NOT frozen AND date <> today AS INT)) OVER (ORDER BY date) AS island FROM f),
r AS (SELECT *, CAST(sum(CAST(met AS INT)) OVER (PARTITION BY island ORDER BY date) AS BIGINT) AS run FROM i)
"""
PLAIN_SQL = "f AS (SELECT *, false AS frozen FROM j)," + ISLAND_SQL
FREEZE_SQL = (
    """
n AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM j),
w AS (
  SELECT k, date, met, CAST(CASE WHEN met THEN 1 ELSE 0 END AS INT) AS live, CAST(CASE WHEN met THEN 1 ELSE 0 END AS INT) AS since,
    0 AS held, 0 AS earned, 0 AS used, false AS frozen FROM n WHERE k = 1
  UNION ALL
  SELECT n.k, n.date, n.met,
    CASE WHEN n.met THEN live + 1 WHEN n.rest OR n.date = n.today THEN live WHEN live > 0 AND held > 0 THEN live ELSE 0 END,
    CASE WHEN n.met THEN CASE WHEN since = 6 THEN 0 ELSE since + 1 END WHEN n.rest OR n.date = n.today THEN since ELSE 0 END,
    CASE WHEN n.met THEN CASE WHEN since = 6 AND held < 2 THEN held + 1 ELSE held END WHEN n.rest OR n.date = n.today THEN held WHEN live > 0 AND held > 0 THEN held - 1 ELSE held END,
    CASE WHEN n.met AND since = 6 AND held < 2 THEN earned + 1 ELSE earned END,
    CASE WHEN NOT n.met AND NOT n.rest AND n.date <> n.today AND live > 0 AND held > 0 THEN used + 1 ELSE used END,
    NOT n.met AND NOT n.rest AND n.date <> n.today AND live > 0 AND held > 0
  FROM w JOIN n ON n.k = w.k + 1),
f AS (SELECT j.*, w.frozen FROM j JOIN w USING (date)),
"""
    + ISLAND_SQL
)


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_from_lineitem(spark, sf_dir)


def dense_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.dense(D.daily(ledger(spark, sf_dir)))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.judged_days(dense_days(spark, sf_dir), G.goal_table(spark, GOALS), REST)


def streak_rows(spark: SparkSession, sf_dir: str, freezes: bool = False) -> DataFrame:
    return G.with_streaks(judged(spark, sf_dir), freezes)


@query("daily_usage", f"WITH {DAY_SQL} SELECT date, input, output, cache_write, cache_read, total, round(cost, 6) AS cost, claude, codex, gemini, messages, sessions FROM dd")
def daily_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["date", "input", "output", "cache_write", "cache_read", "total", "claude", "codex", "gemini", "messages", "sessions"]
    return D.daily(ledger(spark, sf_dir)).select(*cols, F.round("cost", 6).alias("cost"))


@query(
    "daily_usage_intraday",
    f"""WITH {E_SQL} SELECT date, CAST(sum(total) AS BIGINT) AS total, count(*) AS messages, count(DISTINCT tool || session) AS sessions,
    max(ts) AS last_ts FROM ev GROUP BY date""",
)
def daily_usage_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.daily(usage_from_events(spark, sf_dir)).select("date", "total", "messages", "sessions", "last_ts")


@query(
    "local_day_buckets",
    f"""WITH {E_SQL}, zones(zone) AS (VALUES ('UTC'), ('America/Los_Angeles'), ('Asia/Kolkata')),
    z AS (SELECT zone, timezone(zone, timezone('UTC', ts)) AS local, total FROM ev, zones)
    SELECT zone, CAST(local AS DATE) AS date, CAST(hour(local) AS INT) AS hour, CAST(isodow(local) - 1 AS INT) AS weekday, CAST(sum(total) AS BIGINT) AS total FROM z GROUP BY ALL""",
)
def local_day_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sums by local day and hour in three zones; the totals of all zones agree."""
    events = usage_from_events(spark, sf_dir).select("ts", "total")
    parts = [with_local_time(events, z).groupBy("date", "hour", "weekday").agg(F.sum("total").alias("total")).withColumn("zone", F.lit(z)) for z in ("UTC", "America/Los_Angeles", "Asia/Kolkata")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("dense_days", f"WITH {DAY_SQL} SELECT date, total, sessions, round(cost, 6) AS cost FROM d")
def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_days(spark, sf_dir).select("date", "total", "sessions", F.round("cost", 6).alias("cost"))


@query(
    "weekly_rollup",
    f"""WITH {DAY_SQL} SELECT CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS key, CAST(date_trunc('week', date) AS DATE) AS start,
    CAST(date_trunc('week', date) AS DATE) + 6 AS "end", CAST(sum(total) AS BIGINT) AS total, round(sum(cost), 6) AS cost, CAST(sum(claude) AS BIGINT) AS claude,
    CAST(sum(codex) AS BIGINT) AS codex, CAST(sum(gemini) AS BIGINT) AS gemini, count(*) FILTER (WHERE total > 0) AS active_days FROM d GROUP BY ALL""",
)
def weekly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.weekly(dense_days(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query(
    "monthly_rollup",
    f"""WITH {DAY_SQL} SELECT strftime(date, '%Y-%m') AS key, CAST(date_trunc('month', date) AS DATE) AS start, last_day(date) AS "end",
    CAST(sum(total) AS BIGINT) AS total, round(sum(cost), 6) AS cost, CAST(sum(claude) AS BIGINT) AS claude, CAST(sum(codex) AS BIGINT) AS codex,
    CAST(sum(gemini) AS BIGINT) AS gemini, count(*) FILTER (WHERE total > 0) AS active_days FROM d GROUP BY ALL""",
)
def monthly_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.monthly(dense_days(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query(
    "period_bars",
    f"""WITH {DAY_SQL}, w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS start, sum(total) AS total FROM d GROUP BY ALL),
    m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS start, sum(total) AS total FROM d GROUP BY ALL)
    (SELECT 'week' AS kind, start, CAST(total AS BIGINT) AS total FROM w ORDER BY start DESC LIMIT 16) UNION ALL
    (SELECT 'month', start, CAST(total AS BIGINT) FROM m ORDER BY start DESC LIMIT 12)""",
)
def period_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dense_days(spark, sf_dir)
    week = D.period_bars(D.weekly(days), 16).select(F.lit("week").alias("kind"), "start", "total")
    return week.union(D.period_bars(D.monthly(days), 12).select(F.lit("month"), "start", "total"))


@query(
    "today_view",
    f"""WITH {DAY_SQL}, t AS (SELECT * FROM d WHERE date = today), u AS (SELECT avg(total) AS usual FROM d WHERE date < today AND date >= today - 30 AND total > 0)
    SELECT date AS today, input, output, cache_write, cache_read, total, round(cost, 6) AS cost, claude, codex, gemini, messages, sessions, round(usual, 4) AS usual,
    CAST(1100000 AS BIGINT) AS goal, round(total / 1100000.0, 6) AS progress, total >= 1100000 AS met, greatest(1100000 - total, 0) AS remaining,
    round(total / usual, 6) AS vs_usual, round(CASE WHEN total = 0 THEN 0 ELSE claude / total END, 6) AS claude_share FROM t, u""",
)
def today_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = D.today_view(dense_days(spark, sf_dir), F.lit(GOALS[-1].daily).cast("bigint"))
    cols = ["today", "input", "output", "cache_write", "cache_read", "total", "claude", "codex", "gemini", "messages", "sessions", "goal", "met", "remaining"]
    return row.select(*cols, F.round("cost", 6).alias("cost"), F.round("usual", 4).alias("usual"), *[F.round(c, 6).alias(c) for c in ("progress", "vs_usual", "claude_share")])


@query(
    "this_week",
    f"""WITH {DAY_SQL}, t AS (SELECT any_value(today) AS today, CAST(sum(total) FILTER (WHERE date >= CAST(date_trunc('week', today) AS DATE)) AS BIGINT) AS tokens FROM d)
    SELECT today, tokens, CAST(date_trunc('week', today) AS DATE) AS start, CAST(date_trunc('week', today) AS DATE) + 6 AS "end", CAST(9000000 AS BIGINT) AS goal,
    round(tokens / 9000000.0, 6) AS progress, tokens >= 9000000 AS met, CAST(7 - isodow(today) AS INT) AS days_left FROM t""",
)
def this_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.this_week(dense_days(spark, sf_dir), "monday", F.lit(GOALS[-1].weekly).cast("bigint")).withColumn("progress", F.round("progress", 6))


@query("window_sums", f"WITH {DAY_SQL}, n AS (SELECT (row_number() OVER (ORDER BY date) - 1) // 7 AS win, total FROM d) SELECT win AS \"window\", CAST(sum(total) AS BIGINT) AS tokens FROM n GROUP BY win HAVING count(*) = 7")
def window_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.window_sums(dense_days(spark, sf_dir), 7)


@query("goal_asof", f"WITH {DAY_SQL}, {GOAL_SQL} SELECT date, total, CAST(goal AS BIGINT) AS goal, met, rest FROM j")
def goal_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("date", "total", "goal", "met", "rest")


STREAK_COLUMNS = ("date", "goal", "met", "frozen", "run", "streak")
_STREAK_SELECT = "SELECT date, CAST(goal AS BIGINT) AS goal, met, frozen, run, CASE WHEN met THEN run ELSE 0 END AS streak FROM r"


@query("streak_days", f"WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL} {_STREAK_SELECT}")
def streak_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streak_rows(spark, sf_dir).select(*STREAK_COLUMNS)


@query("streak_freezes", f"WITH RECURSIVE {DAY_SQL}, {GOAL_SQL}, {FREEZE_SQL} {_STREAK_SELECT}")
def streak_freezes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streak_rows(spark, sf_dir, freezes=True).select(*STREAK_COLUMNS)


_SUMMARY_SQL = """
s AS (SELECT *, min(date) FILTER (WHERE met) OVER (PARTITION BY island) AS run_start FROM r),
best AS (SELECT run, date, run_start FROM s WHERE met ORDER BY run DESC, date LIMIT 1),
sum1 AS (
  SELECT (SELECT run FROM s WHERE date = today) AS current, (SELECT run_start FROM s WHERE date = today AND run > 0) AS current_start,
    coalesce((SELECT run FROM best), 0) AS longest, (SELECT run_start FROM best) AS longest_start, (SELECT date FROM best) AS longest_end,
    (SELECT met FROM s WHERE date = today) AS today_met)
"""


@query("streak_summary", f"WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL}, {_SUMMARY_SQL} SELECT *, NOT today_met AND current > 0 AS at_risk, 0 AS freezes_held, 0 AS freezes_earned, 0 AS freezes_used, 0 AS next_freeze_in FROM sum1")
def streak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.streak_summary(streak_rows(spark, sf_dir))


@query(
    "streak_summary_freezes",
    f"""WITH RECURSIVE {DAY_SQL}, {GOAL_SQL}, {FREEZE_SQL}, {_SUMMARY_SQL}, z AS (SELECT * FROM w ORDER BY k DESC LIMIT 1)
    SELECT sum1.*, NOT today_met AND current > 0 AS at_risk, held AS freezes_held, earned AS freezes_earned, used AS freezes_used,
    CASE WHEN held >= 2 THEN 0 ELSE 7 - since END AS next_freeze_in FROM sum1, z""",
)
def streak_summary_freezes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.streak_summary(streak_rows(spark, sf_dir, freezes=True), freezes=True)


_WEEK_SQL = """
wk AS (SELECT CAST(date_trunc('week', date) AS DATE) AS start, CAST(sum(total) AS BIGINT) AS tokens, max(today) AS today FROM d GROUP BY 1),
wg AS (SELECT wk.*, CAST(weekly AS BIGINT) AS goal, tokens >= weekly AS met FROM wk JOIN goals ON least(start + 6, today) >= since AND least(start + 6, today) < until),
wi AS (SELECT *, sum(CAST(NOT met AND start <> CAST(date_trunc('week', today) AS DATE) AS INT)) OVER (ORDER BY start) AS island FROM wg),
weeks AS (SELECT start, start + 6 AS "end", tokens, goal, met, CAST(sum(CAST(met AS INT)) OVER (PARTITION BY island ORDER BY start) AS BIGINT) AS run FROM wi)
"""


@query("weekly_streak", f"WITH {DAY_SQL}, {GOAL_SQL}, {_WEEK_SQL} SELECT * FROM weeks")
def weekly_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.judged_weeks(dense_days(spark, sf_dir), G.goal_table(spark, GOALS))


@query(
    "weekly_progress",
    f"WITH {DAY_SQL}, {GOAL_SQL}, {_WEEK_SQL} SELECT arg_max(run, start) AS weekly_current, max(run) AS weekly_longest, round(avg(CAST(met AS INT)), 6) AS met_share FROM weeks",
)
def weekly_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.weekly_progress(weekly_streak(spark, sf_dir)).withColumn("met_share", F.round("met_share", 6))


FRIENDLY_SQL = """CASE WHEN {v} < 10 THEN greatest({v}, 1) ELSE
  (SELECT max(s * CAST(pow(10, length(CAST({v} AS VARCHAR)) - 1) AS BIGINT) // 10) FROM (VALUES (10),(12),(15),(20),(25),(30),(40),(50),(60),(80)) st(s)
   WHERE s <= {v} * 10 // CAST(pow(10, length(CAST({v} AS VARCHAR)) - 1) AS BIGINT)) END"""


@query(
    "goal_suggestion",
    f"""WITH {DAY_SQL}, v AS (SELECT list_sort(list(total)) AS v FROM d WHERE date >= today - 30 AND total > 0),
    m AS (SELECT CAST(floor(v[len(v) // 2 + 1] * 0.9) AS BIGINT) AS x FROM v), a AS (SELECT greatest({FRIENDLY_SQL.format(v="x")}, 10000) AS daily FROM m),
    b AS (SELECT daily, daily * 6 AS y FROM a) SELECT CAST(daily AS BIGINT) AS daily, CAST({FRIENDLY_SQL.format(v="y")} AS BIGINT) AS weekly FROM b""",
)
def goal_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.suggest(dense_days(spark, sf_dir)).select(F.col("daily").cast("bigint"), F.col("weekly").cast("bigint"))


@query("friendly_round", f"WITH {DAY_SQL} SELECT DISTINCT total AS v, CAST({FRIENDLY_SQL.format(v='total')} AS BIGINT) AS friendly FROM d WHERE total > 0")
def friendly_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_days(spark, sf_dir).filter("total > 0").select(F.col("total").alias("v")).distinct().withColumn("friendly", numbers.friendly_down(F.col("v")))


@query(
    "rest_day_streak",
    f"""WITH RECURSIVE {DAY_SQL}, {GOAL_SQL}, {FREEZE_SQL}, x AS (SELECT * FROM f WHERE date >= today - 364),
    p AS (SELECT met, sum(CAST(NOT met AND NOT frozen AND NOT rest AND date <> today AS INT)) OVER (ORDER BY date) AS part FROM x)
    SELECT max(run) AS best FROM (SELECT CAST(sum(CAST(met AS INT)) AS BIGINT) AS run FROM p GROUP BY part)""",
)
def rest_day_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run inside the last 365 days."""
    return G.best_run_within(streak_rows(spark, sf_dir, freezes=True), F.date_sub("today", 364), F.col("today"))


@query(
    "simulate_goal",
    f"""WITH {DAY_SQL}, f AS (SELECT *, total >= 1200000 AS met, isodow(date) IN (6, 7) AS rest, false AS frozen FROM d), {ISLAND_SQL}
    SELECT count(*) FILTER (WHERE met) AS lit, max(run) FILTER (WHERE date = today) AS current, max(run) AS best FROM r""",
)
def simulate_goal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.simulate(dense_days(spark, sf_dir), 1_200_000, REST)


@query(
    "daily_csv_rows",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL} SELECT CAST(date AS VARCHAR) AS date, total AS total_tokens, input, output, cache_write, cache_read, claude, codex, gemini,
    printf('%.4f', round(cost, 6) + 1e-9) AS cost_usd_estimate, CAST(goal AS BIGINT) AS goal, CAST(met AS VARCHAR) AS goal_met, CASE WHEN met THEN run ELSE 0 END AS streak FROM r""",
)
def daily_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from meterlake.sources.sinks import csv_rows

    return csv_rows(streak_rows(spark, sf_dir))


@query(
    "day_text",
    f"""WITH {DAY_SQL} SELECT date, CAST(date_trunc('week', date) AS DATE) AS monday, CAST(date - CAST(dayofweek(date) AS INT) AS DATE) AS sunday,
    CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN year(date) = year(today) THEN strftime(date, '%b %-d') ELSE strftime(date, '%b %-d, %Y') END AS short FROM d""",
)
def day_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("date")
    return dense_days(spark, sf_dir).select("date", times.week_start(day).alias("monday"), times.week_start(day, "sunday").alias("sunday"), times.month_start(day).alias("month"), times.short_date(day, F.col("today")).alias("short"))
