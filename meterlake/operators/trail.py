"""Days as a trail: what a day looks like, runs of lit days and their roles, smoothed heights; facts of a first look back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.config import TOOLS
from meterlake.functions.numbers import ratio
from meterlake.operators.insights import ACHIEVEMENTS

MIN_PAST_RUN = 3
RECENT, RECENT_DAYS = 6, 90


def trail_days(streaks: DataFrame, fallback: int = 0, with_today: bool = False) -> DataFrame:
    """Dense days before today (or up to it): date, tokens, goal, goal_met, frozen, freeze, cache_share and each tool's share.

    A day without a goal is judged by today's goal, or if there is none by ``fallback``. A rest day that isn't met counts as frozen.
    """
    c = F.col
    today = F.max(F.when((c("date") == c("today")) & (c("goal") > 0), c("goal"))).over(Window.partitionBy())
    rows = streaks.withColumn("usual", F.coalesce(today, F.lit(fallback))).filter("date <= today" if with_today else "date < today")
    goal = F.when(c("goal") > 0, c("goal")).otherwise(c("usual")).cast("bigint")
    met = F.when(c("goal") > 0, c("met")).otherwise((c("usual") > 0) & (c("total") >= c("usual")))
    whole = sum((c(t) for t in TOOLS), F.lit(0))
    cache = F.least(F.lit(1.0), ratio(c("cache_read"), c("input") + c("cache_read") + c("cache_write")))
    return rows.select("date", c("total").alias("tokens"), goal.alias("goal"), met.alias("goal_met"), (c("frozen") | (~met & c("rest"))).alias("frozen"), c("frozen").alias("freeze"), cache.alias("cache_share"), *[ratio(c(t), whole).alias(f"{t}_share") for t in TOOLS])


def trail_range(streaks: DataFrame, since: Column, until: Column, fallback: int = 0) -> tuple[DataFrame, DataFrame]:
    """(history, head): the trail's days from ``since`` on before ``until``, and one row of the day ``until`` (0 without usage)."""
    days = trail_days(streaks, fallback, with_today=True)  # the head too, for its shares
    limit = streaks.agg(F.max("today").alias("_last"), F.least(F.max("today"), until).alias("_until"))
    both = days.crossJoin(F.broadcast(limit))  # one row
    history = both.filter((F.col("date") >= since) & (F.col("date") < F.col("_until"))).select(days.columns)
    head = limit.join(days, F.col("date") == F.col("_until"), "left").select(F.col("_until").alias("date"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "goal", "cache_share", *[f"{t}_share" for t in TOOLS])])
    return history, head


def trail_buckets(history: DataFrame, head: DataFrame, size: int, recent_from: Column | None = None, recent_size: int = 1) -> DataFrame:
    """The trail in buckets of ``size`` days that end with the newest; the head is one of its own.

    ``history`` and ``head`` are ``trail_range``'s. Days from ``recent_from`` on are in buckets of ``recent_size``; no bucket goes over that border.
    Columns: pos (from the oldest), since, until, days, tokens and reach (means; a day reaches at most 2.5 times its goal, without a goal its
    tokens), cache_share weighted by tokens, each tool's share weighted by tokens (at least one a day), lit_days, kind.

    A bucket is dark without any tokens, lit where lit and frozen days are at least 60 % and one is lit, frozen where over half are, else a wisp.
    A single day is lit, frozen, a wisp (of some tokens) or dark, in this order.
    """
    c = F.col
    share = [f"{t}_share" for t in TOOLS]
    past = history.select("date", "tokens", "goal", c("goal_met").alias("lit"), (c("frozen") & ~c("goal_met")).alias("ice"), "cache_share", *share, F.lit(False).alias("is_head"))
    tip = head.select("date", "tokens", "goal", F.lit(False).alias("lit"), F.lit(False).alias("ice"), "cache_share", *share, F.lit(True).alias("is_head"))
    recent = F.lit(False) if recent_from is None else (c("date") >= recent_from) & ~c("is_head")
    rows = past.unionByName(tip).withColumn("part", F.when(c("is_head"), 2).when(recent, 1).otherwise(0))
    back = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("date"))) - 1
    rows = rows.withColumn("bucket", F.floor(back / F.when(c("part") == 1, recent_size).otherwise(size)))
    reach = F.least(F.lit(2.5), F.greatest(F.lit(0.0), c("tokens") / F.when(c("goal") > 0, c("goal")).otherwise(1)))
    weighted = {t: F.sum(c(t) * F.greatest("tokens", F.lit(1))) for t in share}
    whole = sum(weighted.values(), F.lit(0.0))
    out = rows.groupBy("part", "bucket").agg(
        F.min("date").alias("since"), F.max("date").alias("until"), F.count("*").alias("days"), F.avg("tokens").alias("tokens"), F.avg(reach).alias("reach"),
        ratio(F.sum(c("cache_share") * c("tokens")), F.sum("tokens")).alias("cache_share"), *[ratio(w, whole).alias(t) for t, w in weighted.items()],
        F.count_if("lit").alias("lit_days"), F.count_if("ice").alias("ice"), F.count_if((c("tokens") <= 0) & ~c("is_head")).alias("none"),
    )
    one = F.when(c("lit_days") > 0, "lit").when(c("ice") > 0, "frozen").when(c("none") == 0, "wisp").otherwise("dark")
    many = F.when(c("none") == c("days"), "dark").when((c("lit_days") > 0) & (c("lit_days") + c("ice") >= F.ceil(c("days") * 6 / 10)), "lit").when(c("ice") * 2 > c("days"), "frozen").otherwise("wisp")
    kind = F.when(c("part") == 2, "today").when(c("days") == 1, one).otherwise(many)
    pos = F.row_number().over(Window.partitionBy().orderBy("since", "part")) - 1  # a row a bucket
    return out.select(pos.alias("pos"), "since", "until", "days", "tokens", "reach", "cache_share", *share, "lit_days", kind.alias("kind"))


def trail_points(levels: DataFrame) -> DataFrame:
    """``detail_levels`` (with lit_days) in order of time: pos from 0; the newest is today's."""
    order = Window.partitionBy().orderBy(F.desc("bucket"))
    return levels.withColumns({"pos": F.row_number().over(order) - 1, "kind": F.when(F.col("bucket") == -1, "today").otherwise(F.col("kind"))})


def run_roles(points: DataFrame, min_past: int = MIN_PAST_RUN, bridge_gaps: int = 0) -> DataFrame:
    """``points`` (pos, kind, days, lit_days, reach) with role, run (its first pos), run_days and current.

    A run begins at a lit point and goes over lit and bridge points. It ends at its last lit point, unless its bridges reach the point before today's,
    whence today can still extend it: that run is current. Without one, a lit today is a current run of its own. The bridge right behind a run is a run
    by itself. Lit points of past runs of ``min_past`` days, or of several days each, are ``past``; others ``filament``. Gaps of up to
    ``bridge_gaps`` points between others are filaments too.
    """
    c = F.col
    every, order = Window.partitionBy(), Window.partitionBy().orderBy("pos")
    usable, lit = c("kind").isin("lit", "bridge"), c("kind") == "lit"
    rows = points.withColumns({"usable": usable, "n": F.count("*").over(every), "part": F.sum((~usable).cast("int")).over(order), "gap_part": F.sum((c("kind") != "dark").cast("int")).over(order)})
    island = Window.partitionBy("part", "usable")
    rows = rows.withColumns({"first_lit": F.min(F.when(lit, c("pos"))).over(island), "last_lit": F.max(F.when(lit, c("pos"))).over(island), "open": F.max("pos").over(island) == c("n") - 2})
    inside = c("usable") & (c("pos") >= c("first_lit")) & (c("open") | (c("pos") <= c("last_lit")))
    behind = c("usable") & ~c("open") & (c("pos") == c("last_lit") + 1)
    rows = rows.withColumns({"run": F.when(inside, c("first_lit")).when(behind, c("pos")), "current": F.coalesce(inside & c("open"), F.lit(False))})
    alone = (c("kind") == "today") & (c("reach") >= 1) & ~F.max("current").over(every)
    rows = rows.withColumns({"current": c("current") | alone, "run": F.when(alone, c("pos")).otherwise(c("run"))})
    length = F.when(c("kind") == "bridge", c("days")).when(lit, F.greatest(c("lit_days"), F.lit(1))).otherwise(1)
    rows = rows.withColumn("run_days", F.when(c("run").isNotNull(), F.sum(length).over(Window.partitionBy("run"))))
    gap = Window.partitionBy("gap_part", c("kind") == "dark")
    narrow = (F.count("*").over(gap) <= bridge_gaps) & (F.min("pos").over(gap) > 0) & (F.max("pos").over(gap) < c("n") - 1)
    role = (
        F.when(c("kind") == "today", "today").when(c("kind") == "bridge", "bridge").when(c("kind") == "dark", F.when(narrow, "filament").otherwise("gap"))
        .when(c("current"), "current").when((c("run_days") >= min_past) | (c("days") > 1), "past").otherwise("filament")
    )
    return rows.withColumn("role", role).select(*points.columns, "role", "run", "run_days", "current")


def smoothed(points: DataFrame, sigma: float, value: str, mask: Column | None = None, order: str = "pos", name: str = "smooth") -> DataFrame:
    """``points`` with ``value`` averaged by Gaussian weights over ceil(2.5 sigma) points to each side.

    Only neighbours up to the first point outside ``mask`` count; such points, and all with a sigma below 0.3 or fewer than three points, keep their value.
    """
    if sigma < 0.3:
        return points.withColumn(name, F.col(value))
    mask = F.lit(True) if mask is None else F.coalesce(mask, F.lit(False))
    rows = points.withColumns({"_mask": mask, "_n": F.count("*").over(Window.partitionBy())})
    rows = rows.withColumn("_part", F.sum((~F.col("_mask")).cast("int")).over(Window.partitionBy().orderBy(order)))
    near = Window.partitionBy("_part", "_mask").orderBy(order)
    reach = math.ceil(sigma * 2.5)
    each = [(math.exp(-(j * j) / (2 * sigma * sigma)), F.lag(value, j).over(near)) for j in range(-reach, reach + 1)]
    total = sum((F.coalesce(v * w, F.lit(0.0)) for w, v in each), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in each), F.lit(0.0))
    out = F.when(F.col("_mask") & (F.col("_n") >= 3) & (weight > 0), total / F.nullif(weight, F.lit(0.0))).otherwise(F.col(value))
    return rows.withColumn(name, out).drop("_mask", "_n", "_part")


def reveal_facts(days: DataFrame, summary: DataFrame, simulated: DataFrame) -> DataFrame:
    """One row: since, total, days_showed_up, longest_run, busiest, busiest_total (of equals the earliest), cache_share.

    ``days`` are dense, ``summary`` is ``streak_summary``'s row and ``simulated`` that of ``simulate``: the longer run of both counts.
    """
    active = F.col("total") > 0
    busiest = F.max(F.when(active, F.struct("total", (-F.unix_date("date")).alias("o"), "date")))
    row = days.agg(
        F.min(F.when(active, F.col("date"))).alias("since"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.count_if(active).alias("days_showed_up"), busiest.alias("b"),
        F.coalesce(ratio(F.sum("cache_read"), F.sum(F.col("input") + F.col("cache_read") + F.col("cache_write"))), F.lit(0.0)).alias("cache_share"),
    )
    row = row.crossJoin(F.broadcast(summary.select("longest"))).crossJoin(F.broadcast(simulated.select("best")))  # one row each
    return row.select("since", "total", "days_showed_up", F.greatest("longest", "best").alias("longest_run"), F.col("b.date").alias("busiest"), F.col("b.total").alias("busiest_total"), "cache_share")


def recent_achievements(rows: DataFrame, today: Column, most: int = RECENT) -> DataFrame:
    """The latest unlocked achievements (of one day by id): place from 1, id, unlocked_at, earlier (more than 90 days ago)."""
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc("unlocked_at"), "id"))  # 16 rows
    own = rows.filter("unlocked_at is not null").withColumn("place", rank).filter(F.col("place") <= most)
    return own.select("place", "id", "unlocked_at", (F.col("unlocked_at") < F.date_sub(today, RECENT_DAYS)).alias("earlier"))


def closest_achievement(rows: DataFrame) -> DataFrame:
    """The locked achievement nearest to its target, of equals the first of the list: id, share. None without progress."""
    place = F.array_position(F.array(*[F.lit(a[0]) for a in ACHIEVEMENTS]), F.col("id"))
    share = F.col("progress") / F.when(F.col("target") == 0, 1.0).otherwise(F.col("target"))
    return rows.filter("unlocked_at is null and progress > 0").orderBy(F.desc(share), place).limit(1).select("id", share.alias("share"))
