"""Share cards as rows: the last year, the leanest week, the streak, or a first fortnight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.config import TOOLS
from meterlake.functions import numbers, times
from meterlake.functions.numbers import half_up, ratio
from meterlake.operators import goals, insights

TEMPLATES = ("streak", "year", "lean")
#: Days that the trail shows before a streak; days without a streak; history that a personal best needs.
LEAD_IN, FIRST_DAYS, ENOUGH_DAYS = 10, 14, 28
LEAST_LEANER, LEAST_SHARE = 0.01, 0.005
_NONE = "—"


def card(streaks: DataFrame, summary: DataFrame, template: str = "streak", story: bool = False, show_mix: bool = True, show_cost: bool = False, top_projects: DataFrame | None = None, grouped: bool = True) -> DataFrame:
    """One row: headline, subline, range_label, stats (label, value), mix (tool, share), chip, top_projects, since, until, trail_since, max_days.

    ``streaks`` are dense days with streaks and ``summary`` their ``streak_summary``; ``top_projects`` is a row of ``share_card`` with
    the names that may be shown. Costs stand on a card only if asked for; a card that isn't a ``story`` has three stats. Counts of
    days have commas (2,499) unless they aren't to be ``grouped``. Without days there is no card.
    """
    c = F.col
    active = F.col("total") > 0
    facts = streaks.agg(F.max("today").alias("today"), F.min(F.when(active, F.col("date"))).alias("first_active")).filter("today is not null")
    row = _SPANS[template](facts, streaks, summary)
    own = streaks.crossJoin(F.broadcast(row.select(c("since").alias("_since"), c("until").alias("_until"))))  # one row
    spent = insights.span_summary(own, c("_since"), c("_until"))
    row = row.crossJoin(F.broadcast(spent)).crossJoin(F.broadcast(_mix(own if show_mix else own.limit(0))))  # one row each
    if template == "year":
        row = row.crossJoin(F.broadcast(goals.best_run_within(own, c("_since"), c("_until"))))
    headline, subline, chip, stats = _TEXTS[template](show_cost, story, grouped)
    row = row.crossJoin(F.broadcast(top_projects.select("top_projects"))) if top_projects is not None else row.withColumn("top_projects", F.lit(None).cast("array<string>"))
    label = F.lit("Last 365 days") if template == "year" else times.day_span(c("since"), c("until"))
    return row.select(
        headline.alias("headline"), subline.alias("subline"), label.alias("range_label"), (stats if story else F.slice(stats, 1, 3)).alias("stats"), "mix", chip.alias("chip"),
        F.when(F.size("top_projects") > 0, F.slice("top_projects", 1, 3)).alias("top_projects"), "since", "until", "trail_since", (F.datediff("until", "trail_since") + 1).alias("max_days"),
    )


def _mix(days: DataFrame) -> DataFrame:
    """One row: the tools with at least half a percent, in their order."""
    sums = days.filter((F.col("date") >= F.col("_since")) & (F.col("date") <= F.col("_until"))).agg(*[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TOOLS])
    whole = sum((F.col(t) for t in TOOLS), F.lit(0))
    every = F.array(*[F.struct(F.lit(t).alias("tool"), ratio(F.col(t), whole).alias("share")) for t in TOOLS])
    return sums.select(F.filter(every, lambda m: m["share"] >= LEAST_SHARE).alias("mix"))


def _year_span(facts: DataFrame, streaks: DataFrame, summary: DataFrame) -> DataFrame:
    since = F.date_sub("today", 364)
    return facts.select("*", since.alias("since"), F.col("today").alias("until"), since.alias("trail_since"))


def _lean_span(facts: DataFrame, streaks: DataFrame, summary: DataFrame) -> DataFrame:
    """The leanest week, or the last one where there is none."""
    found = insights.leanest_week(streaks).select(F.col("since").alias("_a"), F.col("until").alias("_b"), "per_million", F.greatest(F.lit(0.0), -F.col("vs_usual")).alias("leaner"))
    row = facts.join(F.broadcast(found), F.lit(True), "left")  # one row, and one or none
    row = row.withColumns({"since": F.coalesce("_a", F.date_sub("today", 6)), "until": F.coalesce("_b", "today")})
    return row.withColumns({"trail_since": F.col("since"), "enough": F.datediff("today", F.coalesce("first_active", "today")) + 1 >= ENOUGH_DAYS})


def _streak_span(facts: DataFrame, streaks: DataFrame, summary: DataFrame) -> DataFrame:
    """The current run or else the longest; without a run the last days."""
    found = insights.streak_span(summary, streaks).select(F.col("since").alias("_a"), F.col("until").alias("_b"), F.col("days").alias("run"), "is_current")
    row = facts.join(F.broadcast(found), F.lit(True), "left")  # one row, and one or none
    row = row.withColumns({"since": F.coalesce("_a", F.date_sub("today", FIRST_DAYS - 1)), "until": F.coalesce("_b", "today")})
    return row.withColumn("trail_since", F.when(F.col("run").isNull(), F.col("since")).otherwise(F.date_sub("since", LEAD_IN)))


def _stat(label: str | Column, value: Column) -> Column:
    return F.struct((F.lit(label) if isinstance(label, str) else label).alias("label"), value.alias("value"))


def _count(n: str, grouped: bool) -> Column:
    return F.format_number(F.col(n), 0) if grouped else F.col(n).cast("string")


def _shown(grouped: bool) -> dict[str, Column]:
    """The stats that several cards share."""
    c = F.col
    busiest = F.when(c("busiest").isNotNull(), numbers.format_tokens(c("busiest_total"))).otherwise(_NONE)
    return {
        "tokens": _stat("Tokens", numbers.format_tokens(c("tokens"))), "cache": _stat("From cache", numbers.format_percent(c("cache_share"))), "lit": _stat("Days lit", _count("days_lit", grouped)),
        "active": _stat("Active days", _count("active_days", grouped)), "best": _stat("Best day", busiest), "busiest": _stat("Busiest day", busiest), "cost": _stat("Est. cost", numbers.format_usd(c("cost"), cents=False)),
    }


def _year_texts(show_cost: bool, story: bool, grouped: bool) -> tuple[Column, Column, Column, Column]:
    s = _shown(grouped)
    stats = F.array(s["lit"], _stat("Best streak", _count("best", grouped)), s["cost" if show_cost else "busiest"], s["cache"])
    return F.lit("My year"), F.concat(F.lit("in light · "), numbers.format_tokens(F.col("tokens")), F.lit(" tokens")), F.lit(None).cast("string"), stats


def _lean_texts(show_cost: bool, story: bool, grouped: bool) -> tuple[Column, Column, Column, Column]:
    c, s = F.col, _shown(grouped)
    known = c("per_million").isNotNull()
    leaner, money = known & (c("leaner") >= LEAST_LEANER), known & F.lit(show_cost)
    off = half_up(c("leaner") * 100).cast("string")
    minus = F.concat(F.lit("−"), off, F.lit("%"))
    cached = F.concat(numbers.percent_value(c("cache_share")).cast("string"), F.lit("%"))
    third = F.when(leaner, _stat("Per token vs usual", minus)).otherwise(_stat("Active days", F.concat(_count("active_days", grouped), F.lit(" of 7"))))
    priced = F.array(s["cache"], s["tokens"], _stat("Est. cost", numbers.format_usd(c("cost"))), _stat("Per 1M vs usual", minus))
    stats = F.when(money, priced).otherwise(F.array(s["cache"], s["tokens"], third, s["busiest"]))
    best = F.lit(", my leanest week yet")
    headline = F.when(~c("enough"), F.lit("My week")).when(money, numbers.format_usd(c("per_million"))).when(leaner, F.concat(off, F.lit("% leaner"))).otherwise(cached)
    subline = (
        F.when(~c("enough"), F.concat(F.lit("in light · "), cached, F.lit(" from cache"))).when(money, F.concat(F.lit("per million tokens"), best))
        .when(leaner, F.concat(F.lit("per token than usual"), best)).otherwise(F.concat(F.lit("from cache"), best))
    )
    return headline, subline, F.when(c("enough"), "Personal best · leanest week"), stats


def _streak_texts(show_cost: bool, story: bool, grouped: bool) -> tuple[Column, Column, Column, Column]:
    c, s = F.col, _shown(grouped)
    names = [n for n in ("tokens", "lit", "best", "cache") if story or n != "lit"]
    stats = F.array(*[s["cost" if show_cost and n == "best" else n] for n in names])
    first = c("run").isNull()
    headline = F.when(first, "Day one").otherwise(F.concat(_count("run", grouped), F.when(c("run") == 1, " day").otherwise(" days")))
    subline = F.when(first, "and the trail begins").when(~c("is_current"), "my longest run of light").when(c("run") > 1, "of unbroken light").otherwise("the first spark of a streak")
    return headline, subline, F.lit(None).cast("string"), F.when(first, F.array(s["tokens"], s["active"], s["cache"])).otherwise(stats)


_SPANS = {"year": _year_span, "lean": _lean_span, "streak": _streak_span}
_TEXTS = {"year": _year_texts, "lean": _lean_texts, "streak": _streak_texts}
