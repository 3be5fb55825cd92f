"""The trail, its runs and smoothed heights, the first look back, the order of achievements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.operators import daily as D
from meterlake.operators import goals as G
from meterlake.operators import insights as I
from meterlake.operators import trail as T
from meterlake.plans.registry import query
from meterlake.plans.usage_queries import _WEEK_SQL, DAY_SQL, FREEZE_SQL, GOAL_SQL, GOALS, ISLAND_SQL, PLAIN_SQL, REST, dense_days, ledger, streak_rows
from meterlake.plans.view_queries import _ACH_SQL
from meterlake.sources.bronze import keep

_SHARES = ", ".join(f"round(CASE WHEN total = 0 THEN 0 ELSE {t} / total END, 9) AS {t}_share" for t in ("claude", "codex", "gemini"))


@query(
    "trail_data",
    f"""WITH RECURSIVE {DAY_SQL}, {GOAL_SQL}, {FREEZE_SQL}, u AS (SELECT max(goal) FILTER (WHERE date = today) AS usual FROM f),
    k AS (SELECT f.* EXCLUDE (met), CASE WHEN date < DATE '1995-02-01' THEN usual ELSE goal END AS g, CASE WHEN date < DATE '1995-02-01' THEN total >= usual ELSE met END AS met FROM f, u WHERE date < today)
    SELECT date, total AS tokens, CAST(g AS BIGINT) AS goal, met AS goal_met, frozen OR (NOT met AND rest) AS frozen, frozen AS freeze,
    round(CASE WHEN total = 0 THEN 0 ELSE cache_read / (input + cache_read + cache_write) END, 9) AS cache_share, {_SHARES} FROM k""",
)
def trail_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days before the first goal was set have none, so today's judges them."""
    rows = streak_rows(spark, sf_dir, freezes=True)
    rows = rows.withColumn("goal", F.when(F.col("date") < F.lit(GOALS[0].effective_from), 0).otherwise(F.col("goal")))
    return T.trail_days(rows).withColumns({c: F.round(c, 9) for c in ("cache_share", "claude_share", "codex_share", "gemini_share")})


_POINTS_SQL = f"""{DAY_SQL}, {GOAL_SQL},
p AS (SELECT CAST(row_number() OVER (ORDER BY date) - 1 AS INT) AS pos, date, CASE WHEN date = today THEN 'today' WHEN met THEN 'lit' WHEN rest THEN 'bridge' ELSE 'dark' END AS kind, least(2.5, total / goal) AS reach FROM j)
"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.trail_points(I.detail_levels(streak_rows(spark, sf_dir), 1, lit_days=True))


@query(
    "run_roles",
    f"""WITH {_POINTS_SQL}, z AS (SELECT max(pos) AS last FROM p),
    q AS (SELECT *, sum(CAST(kind IN ('dark', 'today') AS INT)) OVER (ORDER BY pos) AS part, sum(CAST(kind <> 'dark' AS INT)) OVER (ORDER BY pos) AS gap_part FROM p),
    isl AS (SELECT part, min(pos) FILTER (WHERE kind = 'lit') AS a, max(pos) FILTER (WHERE kind = 'lit') AS b, max(pos) = any_value(last) - 1 AS open FROM q, z WHERE kind IN ('lit', 'bridge') GROUP BY part),
    gaps AS (SELECT gap_part, count(*) AS width, min(pos) AS since FROM q WHERE kind = 'dark' GROUP BY gap_part),
    x AS (SELECT q.*, CASE WHEN kind NOT IN ('lit', 'bridge') THEN NULL WHEN pos >= a AND (open OR pos <= b) THEN a WHEN NOT open AND pos = b + 1 THEN pos END AS run,
      kind IN ('lit', 'bridge') AND coalesce(open AND pos >= a, false) AS live FROM q LEFT JOIN isl USING (part)),
    y AS (SELECT x.* REPLACE (CASE WHEN kind = 'today' AND reach >= 1 AND NOT (SELECT bool_or(live) FROM x) THEN pos ELSE run END AS run,
      live OR (kind = 'today' AND reach >= 1 AND NOT (SELECT bool_or(live) FROM x)) AS live) FROM x),
    w AS (SELECT *, CASE WHEN run IS NOT NULL THEN count(*) OVER (PARTITION BY run) END AS run_days FROM y)
    SELECT w.pos, date AS since, CASE WHEN kind = 'today' THEN 'today' WHEN kind = 'bridge' THEN 'bridge' WHEN kind = 'dark' THEN CASE WHEN width <= 1 AND gaps.since > 0 THEN 'filament' ELSE 'gap' END
      WHEN live THEN 'current' WHEN run_days >= 3 THEN 'past' ELSE 'filament' END AS role, CAST(run AS INT) AS run, CAST(run_days AS BIGINT) AS run_days, live AS current
    FROM w LEFT JOIN gaps ON kind = 'dark' AND gaps.gap_part = w.gap_part""",
)
def run_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.run_roles(_points(spark, sf_dir), bridge_gaps=1).select("pos", "since", "role", "run", F.col("run_days").cast("bigint").alias("run_days"), "current")


@query(
    "smoothed_trail",
    f"""WITH {_POINTS_SQL}, q AS (SELECT *, kind <> 'dark' AS mask, sum(CAST(kind = 'dark' AS INT)) OVER (ORDER BY pos) AS part FROM p),
    s AS (SELECT a.pos, sum(b.reach * exp(-power(a.pos - b.pos, 2) / 8.0)) / sum(exp(-power(a.pos - b.pos, 2) / 8.0)) AS v FROM q a JOIN q b ON a.mask AND b.mask AND a.part = b.part AND abs(a.pos - b.pos) <= 5 GROUP BY a.pos)
    SELECT q.pos, round(reach, 6) AS reach, round(coalesce(v, reach), 6) AS smooth FROM q LEFT JOIN s USING (pos)""",
)
def smoothed_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.smoothed(_points(spark, sf_dir), 2.0, "reach", F.col("kind") != "dark")
    return rows.select("pos", F.round("reach", 6).alias("reach"), F.round("smooth", 6).alias("smooth"))


@query(
    "reveal_facts",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL}, f2 AS (SELECT *, total >= 1200000 AS met, isodow(date) IN (6, 7) AS rest, false AS frozen FROM d),
    {ISLAND_SQL.replace("i AS", "i2 AS").replace("r AS", "r2 AS").replace("FROM f)", "FROM f2)").replace("FROM i)", "FROM i2)")}, b AS (SELECT date, total FROM dd ORDER BY total DESC, date LIMIT 1)
    SELECT min(dd.date) FILTER (WHERE dd.total > 0) AS since, CAST(sum(dd.total) AS BIGINT) AS total, count(*) FILTER (WHERE dd.total > 0) AS days_showed_up, CAST((SELECT greatest((SELECT max(run) FROM r), (SELECT max(run) FROM r2))) AS BIGINT) AS longest_run,
    any_value(b.date) AS busiest, any_value(b.total) AS busiest_total, round(sum(cache_read) / sum(input + cache_read + cache_write), 9) AS cache_share FROM dd, b""",
)
def reveal_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = keep(dense_days(spark, sf_dir))  # a row a day, read three times
    streaks = G.with_streaks(G.judged_days(days, G.goal_table(spark, GOALS), REST))
    row = T.reveal_facts(days, G.streak_summary(streaks), G.simulate(days, 1_200_000, REST))
    return row.withColumns({"longest_run": F.col("longest_run").cast("bigint"), "cache_share": F.round("cache_share", 9)})


_ORDER_SQL = "[" + ", ".join(f"'{a[0]}'" for a in I.ACHIEVEMENTS) + "]"


@query(
    "achievement_order",
    f"""WITH RECURSIVE {DAY_SQL}, {GOAL_SQL}, {FREEZE_SQL}, {_WEEK_SQL}, {_ACH_SQL.replace("SELECT id, won AS unlocked_at", ", ach AS (SELECT id, target, won AS unlocked_at").rstrip()}),
    nearest AS (SELECT id, progress / target AS share FROM ach WHERE unlocked_at IS NULL AND progress > 0 ORDER BY share DESC, list_position({_ORDER_SQL}, id) LIMIT 1),
    ordered AS (SELECT CAST(row_number() OVER (ORDER BY unlocked_at DESC, id) AS INT) AS place, id, unlocked_at, unlocked_at < (SELECT today FROM bounds) - 90 AS earlier FROM ach WHERE unlocked_at IS NOT NULL)
    SELECT place, id, unlocked_at, earlier, CAST(NULL AS DOUBLE) AS share FROM ordered WHERE place <= 6 UNION ALL SELECT CAST(0 AS INT), id, NULL, NULL, round(share, 6) FROM nearest""",
)
def achievement_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest six unlocked achievements by place, and as place 0 the locked one nearest to its target."""
    days = keep(D.daily(ledger(spark, sf_dir)))
    dense, table = D.dense(days), G.goal_table(spark, GOALS)
    streaks = keep(G.with_streaks(G.judged_days(dense, table, REST), True))
    rows = keep(I.achievements(days, streaks, G.judged_weeks(streaks.select(*dense.columns), table)))
    today = streaks.agg(F.max("today").alias("today")).first().today
    recent = T.recent_achievements(rows, F.lit(today)).withColumn("share", F.lit(None).cast("double"))
    nearest = T.closest_achievement(rows).select(F.lit(0).alias("place"), "id", F.lit(None).cast("date").alias("unlocked_at"), F.lit(None).cast("boolean").alias("earlier"), F.round("share", 6).alias("share"))
    return recent.unionByName(nearest)
