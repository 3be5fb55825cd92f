"""Breakdowns, achievements, baselines and other views over the adapters."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import breakdown as B
from meterlake.operators import daily as D
from meterlake.operators import goals as G
from meterlake.operators import insights as I
from meterlake.plans.registry import query
from meterlake.plans.usage_queries import _WEEK_SQL, DAY_SQL, E_SQL, FREEZE_SQL, GOAL_SQL, GOALS, L_SQL, PLAIN_SQL, REST, dense_days, ledger, streak_rows
from meterlake.sources.adapters import usage_from_events, usage_from_lineitem
from meterlake.sources.bronze import keep

COUNTS = "CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, CAST(sum(cache_write) AS BIGINT) AS cache_write, CAST(sum(cache_read) AS BIGINT) AS cache_read, CAST(sum(total) AS BIGINT) AS total"
RANGE = (date(1998, 1, 1), date(1998, 12, 31))


def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.in_range(usage_from_lineitem(spark, sf_dir, with_project=True), *RANGE)


_PROJECT_SQL = (
    L_SQL
    + """,
x AS (
  SELECT l.* EXCLUDE (model), p_brand AS model, c_mktsegment AS project FROM l JOIN part ON l_partkey = p_partkey JOIN orders USING (l_orderkey)
  JOIN customer ON o_custkey = c_custkey WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31')
"""
).replace("JOIN orders USING (l_orderkey)", "JOIN orders ON l.l_orderkey = o_orderkey")


def _slice_sql(kind: str, key: str, label: str, tool: str, group: str) -> str:
    return (
        f"WITH {_PROJECT_SQL}, t AS (SELECT sum(total) AS whole FROM x) SELECT '{kind}' AS kind, {key} AS key, {label} AS label, {tool} AS tool, {COUNTS}, "
        f"round(sum(cost), 6) AS cost, count(*) AS messages, count(DISTINCT tool || session) AS sessions, round(sum(total) / any_value(whole), 9) AS share FROM x, t GROUP BY {group}"
    )


def _slices(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = B.slices(_range(spark, sf_dir)).filter(F.col("kind") == kind)
    return rows.select("kind", "key", "label", "tool", "input", "output", "cache_write", "cache_read", "total", F.round("cost", 6).alias("cost"), "messages", "sessions", F.round("share", 9).alias("share"))


@query("breakdown_tool", _slice_sql("tool", "tool", "tool", "tool", "tool"))
def breakdown_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir, "tool")


@query("breakdown_model", _slice_sql("model", "tool || ':' || model", "model", "tool", "tool, model"))
def breakdown_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir, "model")


@query("breakdown_project", _slice_sql("project", "project", "project", "CAST(NULL AS VARCHAR)", "project"))
def breakdown_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir, "project")


@query(
    "top_sessions",
    f"""WITH {E_SQL} SELECT tool, session, arg_min(project, (ts, seq)) AS project, min(ts) AS started_at, max(ts) AS ended_at, CAST(sum(total) AS BIGINT) AS tokens,
    round(sum(cost), 6) AS cost, count(*) AS messages, array_to_string(list_sort(list(DISTINCT model)), ',') AS models FROM ev GROUP BY tool, session ORDER BY tokens DESC, tool, session LIMIT 20""",
)
def top_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.top_sessions(usage_from_events(spark, sf_dir)).withColumns({"cost": F.round("cost", 6), "models": F.array_join("models", ",")})


@query("hour_histogram", f"WITH {E_SQL} SELECT CAST(h AS INT) AS hour, CAST(coalesce(sum(total), 0) AS BIGINT) AS total FROM range(24) r(h) LEFT JOIN ev ON hour = h GROUP BY h")
def hour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.histogram(usage_from_events(spark, sf_dir), "hour", 24)


@query("weekday_histogram", f"WITH {E_SQL} SELECT CAST(h AS INT) AS weekday, CAST(coalesce(sum(total), 0) AS BIGINT) AS total FROM range(7) r(h) LEFT JOIN ev ON weekday = h GROUP BY h")
def weekday_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.histogram(usage_from_events(spark, sf_dir), "weekday", 7)


@query("peak_hour", f"WITH {E_SQL}, h AS (SELECT hour, sum(total) AS t FROM ev GROUP BY hour) SELECT hour AS peak FROM h ORDER BY t DESC, hour LIMIT 1")
def peak_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.peak(hour_histogram(spark, sf_dir), "hour")


@query(
    "hourly_by_day",
    f"WITH {E_SQL}, g AS (SELECT DISTINCT date FROM ev), h AS (SELECT date, r.h, coalesce((SELECT sum(total) FROM ev WHERE ev.date = g.date AND hour = r.h), 0) AS t FROM g, range(24) r(h)) SELECT date, string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR), ',' ORDER BY h) AS hourly FROM h GROUP BY date",
)
def hourly_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.hourly(usage_from_events(spark, sf_dir)).select("date", F.array_join("hourly", ",").alias("hourly"))


@query(
    "efficiency_ratios",
    f"""WITH {_PROJECT_SQL}, s AS (SELECT sum(input) i, sum(output) o, sum(cache_write) w, sum(cache_read) r, sum(total) t, sum(cost) c, sum(cache_savings) v, count(*) AS m,
    count(DISTINCT date) AS a, count(DISTINCT tool || session) AS n FROM x)
    SELECT round(r / (i + r + w), 9) AS cache_read_share, round(w / (i + r + w), 9) AS cache_write_share, round(o / t, 9) AS output_share, round(c / a, 6) AS cost_per_active_day,
    round(c / (t / 1e6), 6) AS cost_per_million, round(t / n, 6) AS tokens_per_session, round(t / m, 6) AS tokens_per_message, round(v, 6) AS cache_savings, a AS active_days, n AS sessions, m AS messages FROM s""",
)
def efficiency_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = B.efficiency(_range(spark, sf_dir))
    places = {"cache_read_share": 9, "cache_write_share": 9, "output_share": 9}
    return row.select(*[F.round(c, places.get(c, 6)).alias(c) if t == "double" else F.col(c).cast("bigint").alias(c) for c, t in row.dtypes])


@query(
    "lifetime_stats",
    f"""WITH {DAY_SQL}, s AS (SELECT {COUNTS}, round(sum(cost), 6) AS cost, round(sum(cache_savings), 6) AS cache_savings, count(*) AS messages, count(DISTINCT tool || session) AS sessions,
    count(DISTINCT model) AS models_used FROM l),
    t AS (SELECT tool FROM l GROUP BY tool ORDER BY sum(total) DESC, CASE tool WHEN 'claude' THEN 0 WHEN 'codex' THEN 1 ELSE 2 END DESC LIMIT 1),
    m AS (SELECT model FROM l GROUP BY model ORDER BY sum(total) DESC, model LIMIT 1), b AS (SELECT date, total FROM dd ORDER BY total DESC, date DESC LIMIT 1)
    SELECT s.*, t.tool AS favorite_tool, m.model AS favorite_model, CAST(1 AS BIGINT) AS projects, (SELECT count(*) FROM dd WHERE total > 0) AS active_days, (SELECT min(date) FROM dd) AS first_date,
    b.date AS best_day, b.total AS best_day_tokens FROM s, t, m, b""",
)
def lifetime_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = ledger(spark, sf_dir)
    row = B.lifetime(events, D.daily(events)).drop("reasoning", "other")
    return row.withColumns({"cost": F.round("cost", 6), "cache_savings": F.round("cache_savings", 6)})


@query(
    "source_status",
    f"WITH {E_SQL} SELECT tool, count(*) AS events, min(date) AS first_date, max(date) AS last_date, CAST(sum(total) AS BIGINT) AS total FROM ev GROUP BY tool",
)
def source_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.source_status(usage_from_events(spark, sf_dir))


@query(
    "share_card",
    f"""WITH {_PROJECT_SQL}, t AS (SELECT CAST(sum(total) AS BIGINT) AS total_tokens, count(DISTINCT date) AS active_days FROM x),
    m AS (SELECT model, sum(total) AS s, tool || ':' || model AS k FROM x GROUP BY tool, model), mm AS (SELECT model, max(s) AS s, arg_max(k, s) AS k FROM m GROUP BY model ORDER BY s DESC, k LIMIT 3)
    SELECT total_tokens, active_days, (SELECT string_agg(model, ',' ORDER BY s DESC) FROM mm) AS top_models,
    (SELECT round(sum(total) FILTER (WHERE tool = 'codex') / sum(total), 9) FROM x) AS codex_share, CAST(NULL AS DOUBLE) AS cost FROM t""",
)
def share_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card without cost and project names, as by default."""
    row = B.share_card(_range(spark, sf_dir), B.in_range(streak_rows(spark, sf_dir), *RANGE))
    return row.select("total_tokens", "active_days", F.array_join("top_models", ",").alias("top_models"), F.round("codex_share", 9).alias("codex_share"), "cost")


_ACH_SQL = """
run AS (SELECT *, sum(total) OVER (ORDER BY date) AS sofar FROM dd),
st AS (SELECT r.*, CASE WHEN met THEN run ELSE 0 END AS streak FROM r),
lit AS (SELECT date, streak, lag(date) OVER (ORDER BY date) AS before FROM st WHERE met),
gap AS (SELECT *, max(CASE WHEN streak = 1 THEN date END) OVER (ORDER BY date) AS started FROM lit),
gapped AS (SELECT g.*, coalesce(s.date - s.before > 7, false) AS after_gap FROM gap g LEFT JOIN lit s ON s.date = g.started),
wd AS (SELECT st.*, weeks.start, weeks.goal AS wgoal, weeks.met AS wmet, sum(total) OVER (PARTITION BY weeks.start ORDER BY date) AS wsum,
  sum(CAST(st.met AS INT)) OVER (PARTITION BY weeks.start ORDER BY date) AS nth FROM st JOIN weeks ON CAST(date_trunc('week', date) AS DATE) = weeks.start),
pw AS (SELECT start, max(nth) AS lit, min(date) FILTER (WHERE nth = 5) AS fifth, max(today) AS today FROM wd GROUP BY start),
pr AS (SELECT *, sum(CAST(lit < 5 AND start + 6 < today AS INT)) OVER (ORDER BY start) AS part FROM pw),
ps AS (SELECT *, sum(CAST(lit >= 5 AS INT)) OVER (PARTITION BY part ORDER BY start) AS steady FROM pr),
big AS (SELECT date, cache_read / (input + cache_read + cache_write) AS share, CASE WHEN cache_write > 0 THEN cache_read / cache_write WHEN cache_read > 0 THEN 1e300 ELSE 0 END AS payoff FROM dd WHERE total >= 1000000),
fw AS (SELECT d.date, sum(total) OVER w7 AS wt, sum(cost) OVER w7 AS wc, sum(CAST(total > 0 AS INT)) OVER w7 AS wa, sum(total) OVER w30 AS tt, sum(cost) OVER w30 AS tc, sum(CAST(total > 0 AS INT)) OVER w30 AS ta,
  (SELECT first FROM bounds) AS first FROM d WINDOW w7 AS (ORDER BY d.date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW), w30 AS (ORDER BY d.date RANGE BETWEEN INTERVAL 36 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING)),
fl AS (SELECT date, 1 - (wc / wt) / (tc / tt) AS lean FROM fw WHERE date >= first + 36 AND wa >= 3 AND ta >= 10 AND wt > 0 AND tt > 0 AND tc > 0 AND wc > 0),
fh AS (SELECT min(date) AS hit FROM fl WHERE lean >= 0.2),
facts(id, won, progress, target) AS (
  SELECT 'megawatt', (SELECT min(date) FROM run WHERE total >= 10000000), (SELECT max(total) FROM run), 1e7
  UNION ALL SELECT 'constellation', (SELECT min(date) FROM run WHERE sofar >= 100000000), (SELECT max(sofar) FROM run), 1e8
  UNION ALL SELECT 'galaxy', (SELECT min(date) FROM run WHERE sofar >= 1000000000), (SELECT max(sofar) FROM run), 1e9
  UNION ALL SELECT 'first-light', (SELECT min(date) FROM lit), (SELECT max(CAST(met AS INT)) FROM st), 1
  UNION ALL SELECT 'seven-sparks', (SELECT min(date) FROM st WHERE streak >= 7), (SELECT max(streak) FROM st), 7
  UNION ALL SELECT 'full-moon', (SELECT min(date) FROM st WHERE streak >= 30), (SELECT max(streak) FROM st), 30
  UNION ALL SELECT 'aurora', (SELECT min(date) FROM st WHERE streak >= 100), (SELECT max(streak) FROM st), 100
  UNION ALL SELECT 'halo', (SELECT min(date) FROM st WHERE streak >= 365), (SELECT max(streak) FROM st), 365
  UNION ALL SELECT 'rekindled', (SELECT min(date) FROM gapped WHERE streak = 3 AND after_gap), 0, 1
  UNION ALL SELECT 'safety-net', (SELECT min(date) FROM st WHERE frozen), 0, 1
  UNION ALL SELECT 'high-tide', (SELECT min(date) FROM wd WHERE wmet AND wsum >= wgoal), (SELECT count(*) FROM wd WHERE wmet AND wsum >= wgoal), 1
  UNION ALL SELECT 'steady-hand', (SELECT min(fifth) FROM ps WHERE steady >= 4 AND lit >= 5), (SELECT max(steady) FROM ps), 4
  UNION ALL SELECT 'deep-memory', (SELECT min(date) FROM big WHERE share >= 0.8), (SELECT max(share) FROM big), 0.8
  UNION ALL SELECT 'echo', (SELECT min(date) FROM big WHERE payoff >= 10), (SELECT max(least(payoff, 10)) FROM big), 10
  UNION ALL SELECT 'trio', (SELECT min(date) FROM dd WHERE claude > 0 AND codex > 0 AND gemini > 0), (SELECT max(CAST(claude > 0 AS INT) + CAST(codex > 0 AS INT) + CAST(gemini > 0 AS INT)) FROM dd), 3
  UNION ALL SELECT 'featherweight', (SELECT hit FROM fh), (SELECT greatest(max(lean), 0) FROM fl WHERE date <= coalesce((SELECT hit FROM fh), DATE '9999-01-01')), 0.2)
SELECT id, won AS unlocked_at, round(CASE WHEN won IS NOT NULL THEN target ELSE least(coalesce(progress, 0), target) END, 6) AS progress FROM facts
"""


@query("achievements", f"WITH RECURSIVE {DAY_SQL}, {GOAL_SQL}, {FREEZE_SQL}, {_WEEK_SQL}, {_ACH_SQL}")
def achievements(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = keep(D.daily(ledger(spark, sf_dir)))  # a row a day, read by all that follows
    dense, table = D.dense(days), G.goal_table(spark, GOALS)
    streaks = keep(G.with_streaks(G.judged_days(dense, table, REST), True))
    rows = I.achievements(days, streaks, G.judged_weeks(streaks.select(*dense.columns), table))
    return rows.select("id", "unlocked_at", F.round("progress", 6).alias("progress"))


_BASE_SQL = """
act AS (SELECT * FROM d WHERE date < today AND total > 0 ORDER BY date DESC LIMIT 30),
base AS (SELECT count(*) AS active_days, sum(cache_read) / sum(input + cache_read + cache_write) AS cache_share, sum(cost) / (sum(total) / 1e6) AS cost_per_million, avg(cost) AS cost_per_day,
  quantile_cont(total, 0.5) AS median_tokens, quantile_cont(total / sessions, 0.25) AS session_low, quantile_cont(total / sessions, 0.5) AS session_median, quantile_cont(total / sessions, 0.75) AS session_high FROM act)
"""


@query(
    "baseline",
    f"WITH {DAY_SQL}, {_BASE_SQL} SELECT active_days, round(cache_share, 6) AS cache_share, round(cost_per_million, 6) AS cost_per_million, round(cost_per_day, 6) AS cost_per_day, round(median_tokens, 3) AS median_tokens, round(session_low, 3) AS session_low, round(session_median, 3) AS session_median, round(session_high, 3) AS session_high FROM base",
)
def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = I.baseline(dense_days(spark, sf_dir))
    return row.select("active_days", *[F.round(c, 6).alias(c) for c in ("cache_share", "cost_per_million", "cost_per_day")], *[F.round(c, 3).alias(c) for c in ("median_tokens", "session_low", "session_median", "session_high")])


@query(
    "efficiency_score",
    f"""WITH {DAY_SQL}, {_BASE_SQL}, p AS (SELECT total AS t, input AS i, cache_read AS r, cache_write AS w, cost AS c, sessions AS s FROM d WHERE date = today),
    q AS (SELECT r / (i + r + w) AS share, c / (t / 1e6) AS pm, r / w AS payoff, t / s AS own, base.* FROM p, base),
    z AS (SELECT (share + greatest(0, least(1, 0.6 + (share - cache_share) * 4))) / 2 AS cache,
      (greatest(0, least(1, 1 - log10(greatest(pm, 0.05) / 0.25) / log10(40))) + greatest(0, least(1, 0.6 + (cost_per_million - pm) / cost_per_million * 1.5))) / 2 AS cost_part,
      greatest(0, least(1, log10(greatest(payoff, 1)) / log10(30))) AS payoff,
      CASE WHEN own BETWEEN session_low AND session_high THEN 1 ELSE greatest(0, 1 - 0.8 * CASE WHEN own < session_low THEN (session_low - own) / greatest(session_low, 1) ELSE (own - session_high) / session_high END) END AS focus FROM q)
    SELECT round(cache, 6) AS cache, round(cost_part, 6) AS cost_part, round(payoff, 6) AS payoff, round(focus, 6) AS focus, CAST(floor((cache * 0.34 + cost_part * 0.26 + payoff * 0.2 + focus * 0.2) * 100 + 0.5) AS INT) AS score FROM z""",
)
def efficiency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dense_days(spark, sf_dir)
    row = I.efficiency_score(days.filter("date = today"), I.baseline(days))
    return row.select(*[F.round(c, 6).alias(c) for c in ("cache", "cost_part", "payoff", "focus")], "score")


@query(
    "today_tiles",
    f"""WITH {DAY_SQL}, {_BASE_SQL}, p AS (SELECT *, cost / (total / 1e6) AS pm, cache_read / (input + cache_read + cache_write) AS share FROM d WHERE date = today)
    SELECT round(p.cost, 6) AS cost, round(share, 6) AS cache_share, CAST(floor((share - base.cache_share) * 100 + 0.5) AS BIGINT) AS cache_delta, round(pm, 6) AS per_million,
    round((cost_per_million - pm) / cost_per_million, 6) AS leaner, round(cost_per_day, 6) AS usual_cost FROM p, base""",
)
def today_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = dense_days(spark, sf_dir)
    row = I.today_tiles(days.filter("date = today"), I.baseline(days))
    return row.select(*[F.round(c, 6).alias(c) if c != "cache_delta" else F.col(c).cast("bigint") for c in row.columns])


@query(
    "leanest_week",
    f"""WITH {DAY_SQL}, o AS (SELECT * FROM d WHERE date > today - 180),
    w AS (SELECT date, sum(total) OVER k AS tokens, sum(cost) OVER k AS spent, sum(CAST(total > 0 AS INT)) OVER k AS n, count(*) OVER k AS c FROM o WINDOW k AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
    f AS (SELECT *, spent / (tokens / 1e6) AS pm FROM w WHERE c = 7 AND n >= 3 AND tokens > 0 AND spent > 0 ORDER BY n >= 5 DESC, pm, date LIMIT 1), u AS (SELECT sum(cost) / (sum(total) / 1e6) AS usual FROM o)
    SELECT date - 6 AS since, date AS until, round(pm, 6) AS per_million, CAST(tokens AS BIGINT) AS tokens, round((pm - usual) / usual, 6) AS vs_usual FROM f, u""",
)
def leanest_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.leanest_week(dense_days(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("per_million", "vs_usual")})


@query(
    "heatmap_grid",
    f"""WITH RECURSIVE {DAY_SQL}, {GOAL_SQL}, {FREEZE_SQL}, s AS (SELECT today AS now, first, CAST(date_trunc('week', today) AS DATE) - 364 AS start FROM bounds),
    c AS (SELECT i, CAST(start + CAST(i AS INT) AS DATE) AS date, now, first FROM s, range(371) g(i))
    SELECT CAST(i // 7 AS INT) AS week, CAST(i % 7 AS INT) AS row, c.date, coalesce(total, 0) AS total,
    CASE WHEN coalesce(total, 0) <= 0 THEN 0 WHEN total / goal < 0.5 THEN 1 WHEN total / goal < 1 THEN 2 WHEN total / goal < 1.8 THEN 3 ELSE 4 END AS level, coalesce(met, false) AS met,
    coalesce(frozen, false) OR (NOT coalesce(met, false) AND coalesce(rest, false) AND c.date <= now) AS frozen, coalesce(frozen, false) AS freeze, c.date = now AS is_today, c.date > now AS future, c.date < first AS pad
    FROM c LEFT JOIN f ON f.date = c.date""",
)
def heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.heatmap(streak_rows(spark, sf_dir, freezes=True))


@query(
    "week_orbs",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL}, c AS (SELECT CAST(i AS INT) AS row, CAST(CAST(date_trunc('week', today) AS DATE) + CAST(i AS INT) AS DATE) AS date, today AS now FROM bounds, range(7) g(i))
    SELECT row, c.date, CASE WHEN c.date > now THEN CASE WHEN row >= 5 THEN 'rest' ELSE 'future' END WHEN met THEN 'lit' WHEN c.date = now THEN 'today' WHEN row >= 5 THEN 'frozen' ELSE 'missed' END AS state
    FROM c LEFT JOIN r ON r.date = c.date""",
)
def week_orbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.week_orbs(streak_rows(spark, sf_dir))


@query(
    "span_summary",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, y AS (SELECT * FROM j WHERE date >= today - 364), b AS (SELECT date, total FROM y WHERE total > 0 ORDER BY total DESC, date LIMIT 1)
    SELECT CAST(sum(y.total) AS BIGINT) AS tokens, count(*) FILTER (WHERE met) AS days_lit, count(*) FILTER (WHERE y.total > 0) AS active_days, round(sum(cache_read) / sum(input + cache_read + cache_write), 9) AS cache_share,
    round(sum(cost), 6) AS cost, any_value(b.date) AS busiest, any_value(b.total) AS busiest_total FROM y, b""",
)
def span_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = I.span_summary(streak_rows(spark, sf_dir), F.date_sub("today", 364), F.col("today"))
    return row.withColumns({"cache_share": F.round("cache_share", 9), "cost": F.round("cost", 6)})


@query(
    "token_anatomy",
    f"WITH {_PROJECT_SQL}, s AS (SELECT sum(input) i, sum(output) o, sum(cache_write) w, sum(cache_read) r, sum(total) t FROM x), u(kind, tokens, t) AS (SELECT 'input', i, t FROM s UNION ALL SELECT 'output', o, t FROM s UNION ALL SELECT 'cache_write', w, t FROM s UNION ALL SELECT 'cache_read', r, t FROM s) SELECT kind, CAST(tokens AS BIGINT) AS tokens, round(tokens / t, 9) AS share FROM u WHERE tokens > 0",
)
def token_anatomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _range(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in D.COUNTS])
    return I.token_anatomy(sums).withColumn("share", F.round("share", 9))


@query("tool_mix", f"WITH {DAY_SQL}, s AS (SELECT tool, sum(total) AS t FROM l GROUP BY tool), w AS (SELECT sum(t) AS w FROM s) SELECT tool, round(t / w, 9) AS share FROM s, w WHERE t / w >= 0.005")
def tool_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.tool_mix(dense_days(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(
    "day_shares",
    f"WITH {DAY_SQL} SELECT date, round(CASE WHEN total = 0 THEN 0 ELSE cache_read / (input + cache_read + cache_write) END, 9) AS cache_share, round(CASE WHEN total = 0 THEN 0 ELSE claude / total END, 9) AS claude_share, round(CASE WHEN total = 0 THEN 0 ELSE codex / total END, 9) AS codex_share, round(CASE WHEN total = 0 THEN 0 ELSE gemini / total END, 9) AS gemini_share FROM d",
)
def day_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.day_shares(dense_days(spark, sf_dir))
    return rows.select("date", *[F.round(c, 9).alias(c) for c in rows.columns[1:]])


@query(
    "detail_levels",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, b AS (SELECT *, row_number() OVER (ORDER BY date DESC) - 2 AS back FROM j), c AS (SELECT *, CASE WHEN back < 0 THEN -1 ELSE back // 7 END AS bucket FROM b)
    SELECT CAST(bucket AS INT) AS bucket, min(date) AS since, max(date) AS until, count(*) AS days, round(avg(total), 4) AS tokens, round(avg(least(2.5, total / goal)), 9) AS reach,
    CASE WHEN count(*) FILTER (WHERE met) >= greatest(count(*) FILTER (WHERE NOT met AND rest), count(*) FILTER (WHERE NOT met AND NOT rest)) THEN 'lit'
    WHEN count(*) FILTER (WHERE NOT met AND rest) >= count(*) FILTER (WHERE NOT met AND NOT rest) THEN 'bridge' ELSE 'dark' END AS kind FROM c GROUP BY bucket""",
)
def detail_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.detail_levels(streak_rows(spark, sf_dir), 7).withColumns({"tokens": F.round("tokens", 4), "reach": F.round("reach", 9)})


@query(
    "cost_trend",
    f"""WITH {DAY_SQL}, s AS (SELECT sum(cost) FILTER (WHERE today - date < 30) / count(*) FILTER (WHERE today - date < 30 AND total > 0) AS a,
    sum(cost) FILTER (WHERE today - date BETWEEN 30 AND 59) / count(*) FILTER (WHERE today - date BETWEEN 30 AND 59 AND total > 0) AS b FROM d)
    SELECT round(a, 6) AS now_per_day, round(b, 6) AS prior_per_day, round((a - b) / b, 6) AS change FROM s""",
)
def cost_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = I.cost_trend(dense_days(spark, sf_dir))
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query(
    "streak_tiers",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL} SELECT date, CASE WHEN run >= 365 THEN 365 WHEN run >= 100 THEN 100 WHEN run >= 30 THEN 30 WHEN run >= 7 THEN 7 WHEN run >= 1 THEN 1 ELSE 0 END AS tier,
    CASE WHEN run < 1 THEN 1 WHEN run < 7 THEN 7 WHEN run < 30 THEN 30 WHEN run < 100 THEN 100 WHEN run < 365 THEN 365 END AS next FROM r""",
)
def streak_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streak_rows(spark, sf_dir).select("date", I.tier(F.col("run")).alias("tier"), I.next_tier(F.col("run")).alias("next"))
