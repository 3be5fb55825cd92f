"""Share cards, the trail in buckets, and the sentences beside a day, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterlake.functions import numbers, times
from meterlake.operators import cards
from meterlake.operators import goals as G
from meterlake.operators import trail as T
from meterlake.plans.registry import query
from meterlake.plans.usage_queries import _SUMMARY_SQL, DAY_SQL, FREEZE_SQL, GOAL_SQL, PLAIN_SQL, streak_rows
from meterlake.sources.bronze import keep

_TOOLS = ("claude", "codex", "gemini")


def _tokens_sql(x: str) -> str:
    """Compact count of a whole number from 0 to below 10^15."""
    text = f"{x}::BIGINT::VARCHAR"
    for low, k, unit, whole in ((999.5, 1e3, "K", 10), (999.5e3, 1e6, "M", 100), (999.5e6, 1e9, "B", 100), (999.5e9, 1e12, "T", 100)):
        v = f"({x} / {k:.1f})"
        own = f"CASE WHEN {v} >= {whole} THEN printf('%.0f', floor({v} + 0.5)) ELSE regexp_replace(printf('%.1f', floor({v} * 10 + 0.5) / 10), '[.]0$', '') END || '{unit}'"
        text = f"CASE WHEN {x} >= {low:.1f} THEN {own} ELSE {text} END"
    return text


def _percent_sql(r: str) -> str:
    return f"CASE WHEN {r} < 1 AND {r} >= 0.995 THEN '>99%' WHEN {r} > 0 AND {r} < 0.005 THEN '<1%' ELSE printf('%.0f%%', floor({r} * 100 + 0.5)) END"


def _spent_sql(days: str) -> str:
    """``spent`` over the days of ``span`` (since, until), and ``mixed``."""
    mix = " || ".join(f"CASE WHEN sum({t}) / sum(total) >= 0.005 THEN '{t} ' || printf('%.4f', sum({t}) / sum(total)) || ';' ELSE '' END" for t in _TOOLS)
    return f"""own AS (SELECT o.* FROM {days} o, span WHERE date BETWEEN since AND until),
    spent AS (SELECT CAST(sum(total) AS BIGINT) AS tokens, count(*) FILTER (WHERE met) AS lit, count(*) FILTER (WHERE total > 0) AS active, sum(cache_read) / sum(input + cache_read + cache_write) AS share,
      sum(cost) AS cost, max(total) AS top, {mix} AS mix FROM own)"""


def _date_sql(day: str, condition: str, yes: str, no: str) -> str:
    return f"CASE WHEN {condition} THEN strftime({day}, '{yes}') ELSE strftime({day}, '{no}') END"


_SPAN_TEXT_SQL = f"""{_date_sql("since", "year(since) = year(until)", "%b %-d", "%b %-d, %Y")} || ' – ' ||
    {_date_sql("until", "date_trunc('month', since) = date_trunc('month', until)", "%-d, %Y", "%b %-d, %Y")}"""


def _card(spark: SparkSession, sf_dir: str, template: str, **options) -> DataFrame:
    streaks = keep(streak_rows(spark, sf_dir))  # a row a day, read several times
    row = cards.card(streaks, G.streak_summary(streaks), template, **options)
    joined = lambda col, f: F.array_join(F.transform(col, f), "")
    stats = joined("stats", lambda x: F.concat(x["label"], F.lit(" "), x["value"], F.lit(";")))
    mix = joined("mix", lambda x: F.concat(x["tool"], F.lit(" "), F.format_string("%.4f", x["share"]), F.lit(";")))
    return row.select("headline", "subline", "range_label", stats.alias("stats"), mix.alias("mix"), "chip", "since", "until", "trail_since", "max_days")


@query(
    "year_card",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL}, span AS (SELECT today - 364 AS since, today AS until FROM bounds), {_spent_sql("r")},
    part AS (SELECT met, sum(CAST(NOT met AND NOT rest AND date <> today AS INT)) OVER (ORDER BY date) AS k FROM own), best AS (SELECT max(n) AS best FROM (SELECT count(*) FILTER (WHERE met) AS n FROM part GROUP BY k))
    SELECT 'My year' AS headline, 'in light · ' || {_tokens_sql("tokens")} || ' tokens' AS subline, 'Last 365 days' AS range_label,
    'Days lit ' || lit || ';Best streak ' || best || ';Busiest day ' || {_tokens_sql("top")} || ';From cache ' || {_percent_sql("share")} || ';' AS stats, mix, CAST(NULL AS VARCHAR) AS chip,
    since, until, since AS trail_since, CAST(365 AS INT) AS max_days FROM span, spent, best""",
)
def year_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _card(spark, sf_dir, "year", story=True)


@query(
    "lean_card",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, lk AS (SELECT * FROM d WHERE date > today - 180),
    lw AS (SELECT date, sum(total) OVER k AS t, sum(cost) OVER k AS c, sum(CAST(total > 0 AS INT)) OVER k AS n, count(*) OVER k AS m FROM lk WINDOW k AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
    lb AS (SELECT date, c / (t / 1e6) AS pm FROM lw WHERE m = 7 AND n >= 3 AND t > 0 AND c > 0 ORDER BY n >= 5 DESC, pm, date LIMIT 1),
    lu AS (SELECT sum(cost) / (sum(total) / 1e6) AS usual FROM lk), off AS (SELECT greatest(0, (usual - pm) / usual) AS leaner FROM lb, lu),
    span AS (SELECT date - 6 AS since, date AS until FROM lb), {_spent_sql("j")}
    SELECT CASE WHEN leaner >= 0.01 THEN printf('%.0f%% leaner', floor(leaner * 100 + 0.5)) ELSE {_percent_sql("share")} END AS headline,
    CASE WHEN leaner >= 0.01 THEN 'per token than usual, my leanest week yet' ELSE 'from cache, my leanest week yet' END AS subline, {_SPAN_TEXT_SQL} AS range_label,
    'From cache ' || {_percent_sql("share")} || ';Tokens ' || {_tokens_sql("tokens")} || ';' || CASE WHEN leaner >= 0.01 THEN printf('Per token vs usual −%.0f%%', floor(leaner * 100 + 0.5)) ELSE 'Active days ' || active || ' of 7' END || ';' AS stats,
    mix, 'Personal best · leanest week' AS chip, since, until, since AS trail_since, CAST(7 AS INT) AS max_days FROM span, spent, off""",
)
def lean_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _card(spark, sf_dir, "lean")


@query(
    "streak_card",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL}, {_SUMMARY_SQL},
    span AS (SELECT CASE WHEN current > 0 THEN current_start WHEN longest > 0 THEN longest_start ELSE today - 13 END AS since, CASE WHEN current = 0 AND longest > 0 THEN longest_end ELSE today END AS until,
      CASE WHEN current > 0 THEN current ELSE longest END AS n, current > 0 AS live FROM sum1, bounds), {_spent_sql("r")}
    SELECT CASE WHEN n = 0 THEN 'Day one' ELSE n || CASE WHEN n = 1 THEN ' day' ELSE ' days' END END AS headline, CASE WHEN n = 0 THEN 'and the trail begins' WHEN NOT live THEN 'my longest run of light' WHEN n > 1 THEN 'of unbroken light' ELSE 'the first spark of a streak' END AS subline,
    CASE WHEN since = until THEN strftime(until, '%b %-d, %Y') ELSE {_SPAN_TEXT_SQL} END AS range_label,
    'Tokens ' || {_tokens_sql("tokens")} || CASE WHEN n = 0 THEN ';Active days ' || active ELSE ';Days lit ' || lit || ';Best day ' || {_tokens_sql("top")} END || ';From cache ' || {_percent_sql("share")} || ';' AS stats, mix, CAST(NULL AS VARCHAR) AS chip,
    since, until, CASE WHEN n = 0 THEN since ELSE since - 10 END AS trail_since, CAST(until - since + 1 + CASE WHEN n = 0 THEN 0 ELSE 10 END AS INT) AS max_days FROM span, spent""",
)
def streak_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of days stand as plain digits, as the SQL has them."""
    return _card(spark, sf_dir, "streak", story=True, grouped=False)


_WEIGHTED = ", ".join(f"sum({t} / greatest(total, 1) * greatest(total, 1)) AS w_{t}" for t in _TOOLS)
_SHARES = ", ".join(f"round(coalesce(w_{t} / nullif(w_claude + w_codex + w_gemini, 0), 0), 9) AS {t}_share" for t in _TOOLS)


@query(
    "trail_buckets",
    f"""WITH RECURSIVE {DAY_SQL}, {GOAL_SQL}, {FREEZE_SQL}, x AS (SELECT f.*, met AND date <> today AS lit, NOT met AND (frozen OR rest) AND date <> today AS ice,
      CASE WHEN date = today THEN 2 WHEN date >= today - 40 THEN 1 ELSE 0 END AS part FROM f),
    y AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY date DESC) - 1 AS back FROM x),
    z AS (SELECT part, back // CASE WHEN part = 1 THEN 2 ELSE 7 END AS bucket, min(date) AS since, max(date) AS until, count(*) AS days, avg(total) AS tokens, avg(least(2.5, total / goal)) AS reach,
      sum(total * cache_read / nullif(input + cache_read + cache_write, 0)) / nullif(sum(total), 0) AS cache, {_WEIGHTED}, count(*) FILTER (WHERE lit) AS lit_days, count(*) FILTER (WHERE ice) AS ice,
      count(*) FILTER (WHERE total <= 0) AS empty FROM y GROUP BY part, bucket)
    SELECT CAST(row_number() OVER (ORDER BY since) - 1 AS INT) AS pos, since, until, days, round(tokens, 4) AS tokens, round(reach, 9) AS reach, round(coalesce(cache, 0), 9) AS cache_share, {_SHARES}, lit_days,
    CASE WHEN part = 2 THEN 'today' WHEN days = 1 AND lit_days = 1 THEN 'lit' WHEN days = 1 AND ice = 1 THEN 'frozen' WHEN empty = days THEN 'dark' WHEN days = 1 THEN 'wisp'
      WHEN lit_days > 0 AND lit_days + ice >= ceil(0.6 * days) THEN 'lit' WHEN ice > days / 2 THEN 'frozen' ELSE 'wisp' END AS kind FROM z""",
)
def trail_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weeks, and pairs of days in the last forty."""
    streaks = keep(streak_rows(spark, sf_dir, freezes=True))
    facts = streaks.agg(F.max("today").alias("today"), F.min("date").alias("first")).first()
    history, head = T.trail_range(streaks, F.lit(facts.first), F.lit(facts.today))
    rows = T.trail_buckets(history, head, 7, F.date_sub(F.lit(facts.today), 40), 2)
    return rows.withColumns({"tokens": F.round("tokens", 4)} | {c: F.round(c, 9) for c in ("reach", "cache_share", *[f"{t}_share" for t in _TOOLS])})


_LEFT = "(goal - total)"


@query(
    "day_copy",
    f"""WITH {DAY_SQL}, {GOAL_SQL}, {PLAIN_SQL}, g AS (SELECT *, max(run) OVER (ORDER BY date) AS best, first_value(date) OVER (ORDER BY date) AS begun FROM r)
    SELECT date, CASE WHEN total >= goal AND (total - goal) * 100 >= goal THEN '+' || {_tokens_sql("(total - goal)")} WHEN total >= goal THEN 'Goal lit' WHEN total = 0 THEN {_tokens_sql("goal")} WHEN {_LEFT} < 1000 THEN 'Under 1K' ELSE {_tokens_sql(_LEFT)} END AS lead,
    CASE WHEN total >= goal AND (total - goal) * 100 >= goal THEN 'past your goal · nicely done' WHEN total >= goal THEN 'right on the mark · nicely done' ELSE 'to light today’s trail' END AS rest,
    CASE WHEN met THEN 'lit' WHEN run > 0 THEN 'risk' WHEN best > 0 THEN 'broken' ELSE 'none' END AS mood, CASE WHEN NOT met THEN NULL WHEN run > 1 AND run = best THEN 'Goal lit. A new record: ' || run || ' days.' WHEN run <= 1 THEN 'Goal lit. Your trail begins.' ELSE 'Goal lit. ' || run || ' days and counting.' END AS celebration,
    CASE WHEN run > 0 THEN run || '-day streak' WHEN best > 0 THEN 'No current streak, best run ' || best || ' days' ELSE 'Your trail starts today' END || ', today ' || CAST(floor(total / goal * 100 + 0.5) AS BIGINT) || '% of goal' || CASE WHEN run > 0 THEN ', best ' || best || ' days' ELSE '' END AS summary,
    {_date_sql("date", "year(date) = year(today)", "%A, %B %-d", "%A, %B %-d, %Y")} AS long,
    CASE WHEN date_trunc('month', begun) = date_trunc('month', date) THEN strftime(date, '%b %Y') ELSE {_date_sql("begun", "year(begun) = year(date)", "%b", "%b %Y")} || ' – ' || strftime(date, '%b %Y') END AS months
    FROM g""",
)
def day_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that stood beside each day: what was left, the mood, and the streak so far."""
    c, sofar = F.col, Window.partitionBy().orderBy("date")
    rows = streak_rows(spark, sf_dir).withColumns({"best": F.max("run").over(sofar), "begun": F.min("date").over(sofar)})
    copy = numbers.progress_copy(c("total"), c("goal"))
    return rows.select(
        "date", copy["lead"].alias("lead"), copy["rest"].alias("rest"), numbers.streak_mood(c("met"), ~c("met") & (c("run") > 0), c("run"), c("best")).alias("mood"),
        F.when(c("met"), numbers.celebration_line(c("run"), c("run") == c("best"))).alias("celebration"), numbers.trail_summary(c("run"), c("best"), c("total") / c("goal")).alias("summary"),
        times.long_date(c("date"), c("today")).alias("long"), times.month_span(c("begun"), c("date")).alias("months"),
    )
