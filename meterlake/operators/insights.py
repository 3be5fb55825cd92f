"""Second-level queries over days: achievements, baselines, efficiency, leanest week, heatmap, trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.config import TOOLS
from meterlake.functions import times
from meterlake.functions.numbers import clamp01, half_up, heat_level, ratio

# Id, category, tier, target.
ACHIEVEMENTS = (
    ("first-light", "consistency", "bronze", 1.0),
    ("seven-sparks", "consistency", "bronze", 7.0),
    ("full-moon", "consistency", "silver", 30.0),
    ("aurora", "consistency", "gold", 100.0),
    ("halo", "consistency", "legendary", 365.0),
    ("steady-hand", "consistency", "gold", 4.0),
    ("high-tide", "consistency", "bronze", 1.0),
    ("rekindled", "care", "silver", 1.0),
    ("safety-net", "care", "bronze", 1.0),
    ("deep-memory", "craft", "silver", 0.8),
    ("echo", "craft", "bronze", 10.0),
    ("featherweight", "craft", "gold", 0.2),
    ("trio", "explorer", "silver", 3.0),
    ("megawatt", "scale", "bronze", 1e7),
    ("constellation", "scale", "silver", 1e8),
    ("galaxy", "scale", "gold", 1e9),
)
RUN_TARGETS = {"seven-sparks": 7, "full-moon": 30, "aurora": 100, "halo": 365}
SCALE_DAY, SCALE_ALL = 10_000_000, {"constellation": 100_000_000, "galaxy": 1_000_000_000}
BIG_DAY = 1_000_000


def _ordered(*by: str) -> Window:
    return Window.partitionBy().orderBy(*by)  # over days or weeks: a few thousand rows


def _found(rows: DataFrame, facts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """id, at, progress for each of ``facts``: aggregates of the date and of the progress."""
    one = rows.agg(*[c.alias(f"{i}_{k}") for i, pair in enumerate(facts.values()) for k, c in enumerate(pair)])
    each = F.array(*[F.struct(F.lit(n).alias("id"), F.col(f"{i}_0").cast("date").alias("at"), F.coalesce(F.col(f"{i}_1"), F.lit(0)).cast("double").alias("progress")) for i, n in enumerate(facts)])
    return one.select(F.explode(each).alias("x")).select("x.*")


def scale_facts(days: DataFrame) -> DataFrame:
    """Volume of a day, and of all days so far."""
    run = days.withColumn("sofar", F.sum("total").over(_ordered("date")))
    reach = {n: (F.min(F.when(F.col("sofar") >= t, F.col("date"))), F.max("sofar")) for n, t in SCALE_ALL.items()}
    return _found(run, {"megawatt": (F.min(F.when(F.col("total") >= SCALE_DAY, F.col("date"))), F.max("total"))} | reach)


def streak_facts(streaks: DataFrame) -> DataFrame:
    """Met days, runs, bridged days, and a run of three after more than a week without a met day."""
    met = F.when(F.col("met"), F.col("date"))
    w = _ordered("date")
    before = F.last(met, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.when(F.col("streak") == 1, F.coalesce(F.datediff("date", before) > 7, F.lit(False)))
    rows = streaks.withColumn("after_gap", gap).withColumn("after_gap", F.last("after_gap", True).over(w))
    longest = F.max("streak")
    facts = {
        "first-light": (F.min(met), F.max(F.col("met").cast("int"))),
        "rekindled": (F.min(F.when((F.col("streak") == 3) & F.col("after_gap"), F.col("date"))), F.lit(0)),
        "safety-net": (F.min(F.when(F.col("frozen"), F.col("date"))), F.lit(0)),
    }
    return _found(rows, facts | {n: (F.min(F.when(F.col("streak") >= t, F.col("date"))), longest) for n, t in RUN_TARGETS.items()})


def week_facts(streaks: DataFrame, weeks: DataFrame, starts_on: str = "monday") -> DataFrame:
    """The day on which a met week's sum crossed its goal; the fifth met day of the fourth week in a row with five."""
    start = times.week_start(F.col("date"), starts_on)
    days = streaks.withColumn("start", start).join(weeks.select("start", F.col("goal").alias("week_goal"), F.col("met").alias("week_met")), "start")
    in_week = Window.partitionBy("start").orderBy("date")
    days = days.withColumns({"sofar": F.sum("total").over(in_week), "nth": F.sum(F.col("met").cast("int")).over(in_week)})
    crossed = F.min(F.when(F.col("week_met") & (F.col("sofar") >= F.col("week_goal")), F.col("date")))
    tide = _found(days, {"high-tide": (crossed, F.max(F.when(F.col("week_met") & (F.col("sofar") >= F.col("week_goal")), 1)))})
    per_week = days.groupBy("start").agg(F.max("nth").alias("lit"), F.min(F.when(F.col("nth") == 5, F.col("date"))).alias("fifth"), F.max("today").alias("today"))
    short = (F.col("lit") < 5) & (F.date_add("start", 6) < F.col("today"))
    runs = per_week.withColumn("part", F.sum(short.cast("int")).over(_ordered("start")))
    runs = runs.withColumn("run", F.sum((F.col("lit") >= 5).cast("int")).over(Window.partitionBy("part").orderBy("start")))
    steady = _found(runs, {"steady-hand": (F.min(F.when((F.col("run") >= 4) & (F.col("lit") >= 5), F.col("fifth"))), F.max("run"))})
    return tide.unionByName(steady)


def craft_facts(days: DataFrame) -> DataFrame:
    """Days of a million tokens: share of context from the cache, reads for each write; all tools on one day."""
    prompt = F.col("input") + F.col("cache_read") + F.col("cache_write")
    big = (F.col("total") >= BIG_DAY) & (prompt > 0)
    share = F.when(big, F.col("cache_read") / F.nullif(prompt, F.lit(0)))
    payoff = F.when(big, F.when(F.col("cache_write") > 0, F.col("cache_read") / F.nullif("cache_write", F.lit(0))).when(F.col("cache_read") > 0, F.lit(float("inf"))).otherwise(0.0))
    tools = sum(((F.col(t) > 0).cast("int") for t in TOOLS), F.lit(0))
    return _found(
        days,
        {
            "deep-memory": (F.min(F.when(share >= 0.8, F.col("date"))), F.max(share)),
            "echo": (F.min(F.when(payoff >= 10, F.col("date"))), F.max(F.when(payoff.isNotNull(), F.least(payoff, F.lit(10.0))))),
            "trio": (F.min(F.when(tools >= 3, F.col("date"))), F.max(tools)),
        },
    )


def featherweight(days: DataFrame) -> DataFrame:
    """A week at least a fifth cheaper per token than the 30 days before it: the first such day, the best saving up to it.

    ``days`` are dense. The week needs 3 active days, the days before 10.
    """
    order = F.unix_date("date")
    week, prior = Window.partitionBy().orderBy("n").rangeBetween(-6, 0), Window.partitionBy().orderBy("n").rangeBetween(-36, -7)
    rows = days.withColumns({"n": order, "active": (F.col("total") > 0).cast("int")})
    sums = {f"{p}{k}": F.sum(c).over(w) for p, w in (("w", week), ("t", prior)) for k, c in (("t", "total"), ("c", "cost"), ("a", "active"))}
    rows = rows.withColumns(sums | {"first": F.min("n").over(Window.partitionBy())})
    fit = (F.col("n") >= F.col("first") + 36) & (F.col("wa") >= 3) & (F.col("ta") >= 10) & (F.col("wt") > 0) & (F.col("tt") > 0) & (F.col("tc") > 0) & (F.col("wc") > 0)
    rows = rows.withColumn("lean", F.when(fit, 1 - (F.col("wc") / F.col("wt")) / (F.col("tc") / F.col("tt"))))
    rows = rows.withColumn("hit", F.min(F.when(F.col("lean") >= 0.2, F.col("date"))).over(Window.partitionBy()))
    upto = F.when(F.col("hit").isNull() | (F.col("date") <= F.col("hit")), F.col("lean"))
    return _found(rows, {"featherweight": (F.min("hit"), F.greatest(F.max(upto), F.lit(0.0)))})


def achievements(days: DataFrame, streaks: DataFrame, weeks: DataFrame, starts_on: str = "monday", stored: DataFrame | None = None, seen: tuple[str, ...] = ()) -> DataFrame:
    """All achievements: id, category, tier, unlocked_at, progress, target, is_new.

    ``stored`` (id, unlocked_at) keeps earlier unlock dates; the earlier date counts. ``days`` have usage, ``streaks``
    are dense.
    """
    spark = days.sparkSession
    facts = scale_facts(days).unionByName(streak_facts(streaks)).unionByName(week_facts(streaks, weeks, starts_on)).unionByName(craft_facts(days)).unionByName(featherweight(streaks))
    known = spark.createDataFrame(list(ACHIEVEMENTS), "id string, category string, tier string, target double")
    out = known.join(F.broadcast(facts), "id", "left")  # 16 rows
    if stored is not None:
        out = out.join(F.broadcast(stored.select("id", F.col("unlocked_at").alias("stored_at"))), "id", "left").withColumn("at", F.least("at", "stored_at"))
    progress = F.when(F.col("at").isNotNull(), F.col("target")).otherwise(F.least(F.coalesce("progress", F.lit(0.0)), F.col("target")))
    return out.select("id", "category", "tier", F.col("at").alias("unlocked_at"), progress.alias("progress"), "target", (F.col("at").isNotNull() & (~F.col("id").isin(*seen) if seen else F.lit(True))).alias("is_new"))


def newly_unlocked(current: DataFrame, stored: DataFrame) -> DataFrame:
    """Unlocked achievements that ``stored`` (id) doesn't have."""
    return current.filter("unlocked_at is not null").select("id", "unlocked_at").join(F.broadcast(stored.select("id")), "id", "left_anti")


def span_summary(days: DataFrame, since: Column, until: Column) -> DataFrame:
    """One row over [since, until]: tokens, met and active days, cache share, cost, busiest day (of equals the earliest)."""
    own = days.filter((F.col("date") >= since) & (F.col("date") <= until))
    prompt = F.sum(F.col("input") + F.col("cache_read") + F.col("cache_write"))
    busiest = F.max(F.when(F.col("total") > 0, F.struct("total", (-F.unix_date("date")).alias("o"), "date")))
    row = own.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("tokens"), F.count_if("met").alias("days_lit"), F.count_if(F.col("total") > 0).alias("active_days"),
        F.coalesce(ratio(F.sum("cache_read"), prompt), F.lit(0.0)).alias("cache_share"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), busiest.alias("b"),
    )
    return row.withColumns({"busiest": F.col("b.date"), "busiest_total": F.col("b.total")}).drop("b")


def baseline(days: DataFrame, n: int = 30) -> DataFrame:
    """One row over the last ``n`` active days before today: cache share, costs, median day, session quartiles."""
    active = days.filter((F.col("date") < F.col("today")) & (F.col("total") > 0)).orderBy(F.desc("date")).limit(n)
    per_session = F.when(F.col("sessions") > 0, F.col("total") / F.nullif("sessions", F.lit(0)))
    prompt = F.sum(F.col("input") + F.col("cache_read") + F.col("cache_write"))
    row = active.agg(
        F.count("*").alias("active_days"), F.coalesce(ratio(F.sum("cache_read"), prompt), F.lit(0.0)).alias("cache_share"), F.coalesce(ratio(F.sum("cost"), F.sum("total") / 1e6), F.lit(0.0)).alias("cost_per_million"),
        F.coalesce(F.avg("cost"), F.lit(0.0)).alias("cost_per_day"), F.coalesce(F.percentile("total", 0.5), F.lit(0.0)).alias("median_tokens"), F.percentile(per_session, [0.25, 0.5, 0.75]).alias("q"),
    )
    return row.withColumns({n: F.coalesce(F.col("q")[i], F.lit(0.0)) for i, n in enumerate(("session_low", "session_median", "session_high"))}).drop("q")


def efficiency_score(period: DataFrame, base: DataFrame) -> DataFrame:
    """Score of 0 to 100 of a period (one row: counts, cost, sessions) against a baseline (one row), with its four parts.

    Each part blends what is good for anyone with the own usual.
    """
    p = period.select("total", "input", "cache_read", "cache_write", "cost", "sessions").crossJoin(F.broadcast(base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns])))  # one row each
    c = F.col
    has = c("b_active_days") >= 3
    share = ratio(c("cache_read"), c("input") + c("cache_read") + c("cache_write"))
    per_million = ratio(c("cost"), c("total") / 1e6)
    payoff = F.when(c("cache_write") > 0, c("cache_read") / F.nullif("cache_write", F.lit(0))).when(c("cache_read") > 0, 50.0).otherwise(0.0)
    own_session = ratio(c("total"), c("sessions"))
    cost_abs = clamp01(1 - F.log10(F.greatest(per_million, F.lit(0.05)) / 0.25) / F.log10(F.lit(40.0)))
    cost_rel = F.when(has & (c("b_cost_per_million") > 0), clamp01(0.6 + (c("b_cost_per_million") - per_million) / F.nullif("b_cost_per_million", F.lit(0.0)) * 1.5)).otherwise(cost_abs)
    cache_rel = F.when(has, clamp01(0.6 + (share - c("b_cache_share")) * 4)).otherwise(clamp01(share))
    low, high = c("b_session_low"), c("b_session_high")
    off = F.when(own_session < low, (low - own_session) / F.greatest(low, F.lit(1.0))).otherwise((own_session - high) / F.nullif(high, F.lit(0.0)))
    focus = F.when(~(has & (own_session > 0) & (high > 0)), 0.7).when((own_session >= low) & (own_session <= high), 1.0).otherwise(clamp01(1 - off * 0.8))
    some = c("total") > 0
    parts = {"cache": (clamp01(share) + cache_rel) / 2, "cost_part": (cost_abs + cost_rel) / 2, "payoff": clamp01(F.log10(F.greatest(payoff, F.lit(1.0))) / F.log10(F.lit(30.0))), "focus": focus}
    out = p.select(*[F.when(some, v).otherwise(0.0).alias(k) for k, v in parts.items()])
    return out.withColumn("score", half_up((c("cache") * 0.34 + c("cost_part") * 0.26 + c("payoff") * 0.2 + c("focus") * 0.2) * 100).cast("int"))


def today_tiles(today: DataFrame, base: DataFrame) -> DataFrame:
    """One row: today's cost, cache share and cost per million against the baseline; null without three usual days."""
    t = today.select("total", "input", "cache_read", "cache_write", "cost").crossJoin(F.broadcast(base.select(*[F.col(c).alias(f"b_{c}") for c in base.columns])))  # one row each
    share = ratio(F.col("cache_read"), F.col("input") + F.col("cache_read") + F.col("cache_write"))
    per_million = ratio(F.col("cost"), F.col("total") / 1e6)
    has = (F.col("b_active_days") >= 3) & (F.col("total") > 0)
    leaner = (F.col("b_cost_per_million") - per_million) / F.nullif("b_cost_per_million", F.lit(0.0))
    return t.select("cost", share.alias("cache_share"), F.when(has, half_up((share - F.col("b_cache_share")) * 100)).alias("cache_delta"), per_million.alias("per_million"), F.when(has & (F.col("b_cost_per_million") > 0), leaner).alias("leaner"), F.when(F.col("b_active_days") >= 3, F.col("b_cost_per_day")).alias("usual_cost"))


def leanest_week(days: DataFrame, lookback: int = 180) -> DataFrame:
    """The cheapest seven dense days per token within ``lookback``: with five active days if there are such, else three.

    One row or none: since, until, per_million, tokens, vs_usual (relative to all active days).
    """
    own = days.filter(F.col("date") > F.date_sub("today", lookback)).withColumn("active", (F.col("total") > 0).cast("int"))
    w = _ordered("date").rowsBetween(-6, 0)
    rows = own.withColumns({"tokens": F.sum("total").over(w), "spent": F.sum("cost").over(w), "n": F.sum("active").over(w), "k": F.count("*").over(w), "since": F.min("date").over(w)})
    usual = rows.agg(ratio(F.sum("cost"), F.sum("total") / 1e6).alias("usual"))
    per = F.col("spent") / (F.col("tokens") / 1e6)
    fit = rows.filter("k = 7 and n >= 3 and tokens > 0 and spent > 0").withColumn("per_million", per).withColumn("full", (F.col("n") >= 5).cast("int"))
    best = fit.orderBy(F.desc("full"), "per_million", "date").limit(1)
    return best.crossJoin(F.broadcast(usual)).select("since", F.col("date").alias("until"), "per_million", "tokens", F.when(F.col("usual") > 0, (F.col("per_million") - F.col("usual")) / F.nullif("usual", F.lit(0.0))).otherwise(0.0).alias("vs_usual"))


def heatmap(streaks: DataFrame, weeks: int = 53, starts_on: str = "monday") -> DataFrame:
    """A cell for each day of ``weeks`` weeks up to today's: week (from 0), row, total, level, met, frozen, flags."""
    facts = streaks.agg(F.max("today").alias("now"), F.min("date").alias("first"))
    last = times.week_start(F.col("now"), starts_on)
    start = F.date_sub(last, 7 * (weeks - 1))
    cells = facts.filter("now is not null").select("now", "first", F.posexplode(F.sequence(start, F.date_add(last, 6))).alias("i", "date"))
    out = cells.join(streaks.select("date", "total", "goal", "met", "rest", "frozen"), "date", "left")
    z = lambda c, d: F.coalesce(c, F.lit(d))
    return out.select(
        F.floor(F.col("i") / 7).cast("int").alias("week"), (F.col("i") % 7).alias("row"), "date", z("total", 0).alias("total"), heat_level(z("total", 0), z("goal", 0)).alias("level"), z("met", False).alias("met"),
        (z("frozen", False) | (~z("met", False) & z("rest", False) & (F.col("date") <= F.col("now")))).alias("frozen"), z("frozen", False).alias("freeze"),
        (F.col("date") == F.col("now")).alias("is_today"), (F.col("date") > F.col("now")).alias("future"), (F.col("date") < F.col("first")).alias("pad"),
    )


def week_orbs(streaks: DataFrame, starts_on: str = "monday") -> DataFrame:
    """State of each day of today's week: lit, frozen, today, missed, future or rest."""
    grid = heatmap(streaks, 1, starts_on)
    rest = streaks.filter("rest").select(F.weekday("date").alias("row_rest")).distinct()
    marked = grid.withColumn("wd", F.weekday("date")).join(F.broadcast(rest), F.col("wd") == F.col("row_rest"), "left")
    is_rest = F.col("row_rest").isNotNull()
    state = F.when(F.col("future"), F.when(is_rest, "rest").otherwise("future")).when(F.col("met"), "lit").when(F.col("is_today"), "today").when(F.col("freeze") | is_rest, "frozen").otherwise("missed")
    return marked.select("date", "row", state.alias("state"))


def token_anatomy(row: DataFrame) -> DataFrame:
    """Shares of input, output, cache writes and reads, other in one row's total; zeros are left out."""
    kinds = ("input", "output", "cache_write", "cache_read", "other")
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("tokens"), ratio(F.col(k), F.col("total")).alias("share")) for k in kinds])).alias("x")).select("x.*").filter("tokens > 0")


def tool_mix(days: DataFrame) -> DataFrame:
    """Shares of the tools over days; those below half a percent are left out."""
    sums = days.agg(*[F.sum(t).alias(t) for t in TOOLS])
    whole = sum((F.col(t) for t in TOOLS), F.lit(0))
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("tool"), ratio(F.col(t), whole).alias("share")) for t in TOOLS])).alias("x")).select("x.*").filter("share >= 0.005")


def day_shares(days: DataFrame) -> DataFrame:
    """Per day: share of context from the cache (at most 1) and of each tool."""
    whole = sum((F.col(t) for t in TOOLS), F.lit(0))
    cache = F.least(F.lit(1.0), ratio(F.col("cache_read"), F.col("input") + F.col("cache_read") + F.col("cache_write")))
    return days.select("date", cache.alias("cache_share"), *[ratio(F.col(t), whole).alias(f"{t}_share") for t in TOOLS])


def detail_levels(streaks: DataFrame, size: int, lit_days: bool = False) -> DataFrame:
    """Dense days before today in buckets of ``size`` aligned to the newest: days, mean tokens, mean share of the goal (at most 2.5), the majority state.

    Today stands alone as bucket -1. ``lit_days`` adds the number of met days.
    """
    w = Window.partitionBy().orderBy(F.desc("date"))
    rows = streaks.withColumn("back", F.row_number().over(w) - 2)
    rows = rows.withColumn("bucket", F.when(F.col("back") < 0, -1).otherwise(F.floor(F.col("back") / size)).cast("int"))
    state = F.when(F.col("met"), 2).when(F.col("frozen") | F.col("rest"), 1).otherwise(0)
    reach = F.least(F.lit(2.5), F.greatest(F.lit(0.0), ratio(F.col("total"), F.col("goal"))))
    out = rows.groupBy("bucket").agg(F.min("date").alias("since"), F.max("date").alias("until"), F.count("*").alias("days"), F.avg("total").alias("tokens"), F.avg(reach).alias("reach"), *[F.count_if(state == k).alias(f"n{k}") for k in range(3)])
    kind = F.when((F.col("n2") >= F.col("n1")) & (F.col("n2") >= F.col("n0")), "lit").when(F.col("n1") >= F.col("n0"), "bridge").otherwise("dark")
    return out.select("bucket", "since", "until", "days", "tokens", "reach", kind.alias("kind"), *([F.col("n2").alias("lit_days")] if lit_days else []))


def tier(streak: Column) -> Column:
    """The highest of 0, 1, 7, 30, 100 and 365 days that a streak reaches."""
    return F.coalesce(*[F.when(streak >= n, F.lit(n)) for n in (365, 100, 30, 7, 1)], F.lit(0))


def next_tier(streak: Column) -> Column:
    return F.coalesce(*[F.when(streak < n, F.lit(n)) for n in (1, 7, 30, 100, 365)])


def streak_span(summary: DataFrame, streaks: DataFrame) -> DataFrame:
    """One row or none: the current run's dates, or if there is none the longest's."""
    now = streaks.agg(F.max("today").alias("today"))
    both = summary.crossJoin(F.broadcast(now))  # one row each
    live = F.col("current") > 0
    return both.filter("current > 0 or longest > 0").select(F.when(live, F.col("current_start")).otherwise(F.col("longest_start")).alias("since"), F.when(live, F.col("today")).otherwise(F.col("longest_end")).alias("until"), F.when(live, F.col("current")).otherwise(F.col("longest")).alias("days"), live.alias("is_current"))


def cost_trend(days: DataFrame, size: int = 30) -> DataFrame:
    """One row: cost per active day in the last ``size`` days and in those before; null with fewer than 3 active days before."""
    back = F.datediff("today", "date")
    now, prior = back < size, (back >= size) & (back < 2 * size)
    active = F.col("total") > 0
    row = days.agg(*[F.sum(F.when(w, F.col("cost"))).alias(f"{n}_cost") for n, w in (("now", now), ("prior", prior))], *[F.count_if(w & active).alias(f"{n}_days") for n, w in (("now", now), ("prior", prior))])
    a, b = ratio(F.col("now_cost"), F.col("now_days")), ratio(F.col("prior_cost"), F.col("prior_days"))
    return row.select(a.alias("now_per_day"), F.when(F.col("prior_days") >= 3, b).alias("prior_per_day"), F.when((F.col("prior_days") >= 3) & (b > 0), (a - b) / F.nullif(b, F.lit(0.0))).alias("change"))
