"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents are aggregated by the set of sources that they belong to. On the driver, a flow over these
patterns routes token capacity to source quotas: a pattern's first pass is free, each further pass over it
costs more, so words repeat only where quotas need them. The flow into a pattern is so many whole passes
and a rest; the rest is taken from documents in the order of a seeded hash. Which ones follows from sums over
hash buckets, found in two steps, so that no source is ever sorted or gathered.

What a bucket's border leaves open is filled in the same way from ever smaller documents. At last up to two
documents are exchanged for up to two others as long as that brings a pattern nearer to its rest: candidates are two
of each size class and the nearest in size, so a pattern's choice is made from a bounded number of rows.

Rows that repeat an id and a size are one unit of the sum of their sizes: taken or left together, and counted so.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.common import cut, small

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Tables with a row a pattern or a source are broadcast up to so many rows.
BROADCAST_PATTERNS = 50_000
BUCKETS = 4096
#: A rest is filled from documents of at most this share of it, until less than ``NEAR`` of the pattern's words is open.
SMALLER, NEAR = 1 / 8, 1e-4
#: Where more than this share is open then, single documents may also have a pass more than the others, or fewer.
WIDE = 2e-3
#: Size classes to a doubling; candidates for single documents come from each.
CLASSES = 8


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    col = F.btrim(F.col(text) if isinstance(text, str) else text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(col) > 0, F.size(F.split(col, r"\s+"))).otherwise(0).cast("long")


def targets_by_weight(sizes: dict, order: Sequence, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> dict:
    """Each source's share of all sizes by its weight, at most ``max_repeats`` times its size; excess is shared anew."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    left = list(order)
    while left:
        rest, all_weight = total - sum(done.values()), sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] > max_repeats * sizes[s] * all_weight]
        if not over:
            return done | {s: rest * weight[s] / all_weight for s in left}
        done |= {s: float(max_repeats * sizes[s]) for s in over}
        left = [s for s in left if s not in done]
    return done


def min_cost_flow(capacity: dict, quota: dict, members: dict, max_repeats: int = MAX_REPEATS) -> dict:
    """Words that each pattern gives each source: {(pattern, source): words}, most words first, then least cost.

    ``capacity`` is a pattern's size, ``members`` its sources. Pass k over a pattern costs (k - 1)². A
    shortest augmenting path pays for its first arc only, as routing words anew between sources is free; so the
    passes are a series of largest flows, each in paths over the few sources: from a to b by a pattern that
    gives to a and belongs to b.
    """
    given = {(p, s): 0 for p in capacity for s in members[p] if s in quota}
    open_quota = dict(quota)
    own: dict = {p: [s for s in members[p] if s in quota] for p in capacity}
    moves: dict = {s: {} for s in quota}  # from a source to another: patterns that give to the one and belong to the other, as an ordered set

    def give(p, s, n: int) -> None:
        before = given[p, s]
        given[p, s] += n
        if not before and n:
            for b in own[p]:
                if b != s:
                    moves[s].setdefault(b, {})[p] = None
        elif before and not given[p, s]:
            for b in own[p]:
                if b != s:
                    del moves[s][b][p]

    def path(p, stuck: set) -> list | None:
        """Sources and the patterns between them, from one of p's sources to one with open quota; without one, all that were reached are stuck."""
        came: dict = {s: None for s in own[p] if s not in stuck}
        waiting = deque(came)
        while waiting:
            a = waiting.popleft()
            if open_quota[a] > 0:
                steps = [a]
                while came[steps[-1]] is not None:
                    steps += came[steps[-1]]
                return steps[::-1]
            for b, by in moves[a].items():
                if by and b not in came and b not in stuck:
                    came[b] = (next(iter(by)), a)
                    waiting.append(b)
        stuck.update(came)
        return None

    for _ in range(max_repeats):
        stuck: set = set()  # once no path leads on from a source, none does later in the pass
        for p in sorted(capacity, key=lambda x: len(own[x])):
            left = capacity[p]
            while left > 0:
                steps = path(p, stuck)
                if steps is None:
                    break
                sources, between = steps[::2], steps[1::2]
                push = min(left, open_quota[sources[-1]], *(given[q, a] for q, a in zip(between, sources[:-1], strict=True)))
                give(p, sources[0], push)
                for q, a, b in zip(between, sources[:-1], sources[1:], strict=True):
                    give(q, a, -push)
                    give(q, b, push)
                open_quota[sources[-1]] -= push
                left -= push
    return given


@dataclass
class Rest:
    """How a pattern's rest is taken: hash buckets below ``cut``; of documents up to a level's size those below its cut; single ones."""

    words: int
    passes: int
    left: int
    cut: int = 0
    levels: list[tuple[int, int]] = field(default_factory=list)  # size, cut; sizes fall, cuts rise
    extra: dict[int, int] = field(default_factory=dict)  # passes over single documents, more or fewer


@dataclass
class Mix:
    """What a mix takes of each pattern, and the sources' sizes and targets."""

    seed: int
    rests: dict[tuple, Rest] = field(default_factory=dict)
    source_size: dict = field(default_factory=dict)
    target: dict = field(default_factory=dict)
    flow: dict = field(default_factory=dict)


def pattern_of(members: Column) -> Column:
    """A document's sources as a sorted set; the null source comes last as itself, a null array has none."""
    named = F.transform(F.coalesce(members, F.expr("cast(array() as array<string>)")), lambda s: F.struct(s.isNull().alias("is_null"), s.alias("name")))
    return F.array_sort(F.array_distinct(named))


_KEY = T.StructType([T.StructField("is_null", T.BooleanType()), T.StructField("name", T.StringType())])


def _hash(seed: int, doc_id: Column, size: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), doc_id, size), F.lit(1 << 48))


def _bucket(h: Column) -> Column:
    return F.shiftright(h, 24).cast("int")


def _units(docs: DataFrame, id_col: str, size_col: str, members: Column, seed: int) -> DataFrame:
    """pattern, h, one (a row's size), size (of all rows of h), written once."""
    rows = docs.select(pattern_of(members).alias("pattern"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("one"), _hash(seed, F.col(id_col), F.col(size_col)).alias("h"))
    return cut(rows.groupBy("pattern", "h").agg(F.max("one").alias("one"), F.sum("one").alias("size")))


def plan_mix(docs: DataFrame, id_col: str, size_col: str, members: Column, weights=WEIGHTS, seed: int = 17, max_repeats: int = MAX_REPEATS) -> Mix:
    """Route all of ``docs`` to the sources' targets; the driver sees a few numbers for each distinct set of sources only.

    ``members`` is an array of a document's sources; a null one is a source, a null array has none, so its documents
    are never taken. Every pattern has its own node in the flow, however many there are. Empty documents and null sizes
    take nothing, an empty table gives an empty mix. Documents of one size are chosen by their hash.
    """
    units = _units(docs, id_col, size_col, members, seed)
    sums = units.groupBy("pattern").agg(F.sum("size").alias("size"))
    mix = Mix(seed)
    members_of = {_key(r.pattern): r["size"] for r in sums.collect()}
    sizes: dict = {}
    for p, n in members_of.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + n
    sources = sorted(sizes, key=lambda s: (s[0], (s[1] or "").encode()))
    mix.source_size, mix.target = sizes, targets_by_weight(sizes, sources, weights, max_repeats)
    mix.flow = min_cost_flow(members_of, {s: round(mix.target[s]) for s in sources}, {p: p for p in members_of}, max_repeats)
    for p, n in members_of.items():
        words = sum(mix.flow.get((p, s), 0) for s in p)
        passes = min(max_repeats, words // n) if n else 0
        mix.rests[p] = Rest(words, passes, words - passes * n)
    _cut_in_order(units, mix, first=True)
    while any(map(_is_open, mix.rests.values())) and _cut_in_order(units, mix, first=False):
        pass
    for wide, share in ((False, NEAR), (True, WIDE)):
        live = {p for p, r in mix.rests.items() if abs(r.left) > share * r.words}
        while live:
            live = {p for p in _choose_single(units, mix, live, max_repeats, wide) if abs(mix.rests[p].left) > share * mix.rests[p].words}
    return mix


def _is_open(r: Rest) -> bool:
    return r.left > NEAR * r.words and r.left * SMALLER >= 1


def _key(pattern) -> tuple:
    return tuple((m.is_null, m.name) for m in pattern)


def _frame(spark, rows: list, columns: str) -> DataFrame:
    """Rows whose first value is a pattern's key; broadcast if they are few."""
    named = [([{"is_null": a, "name": b} for a, b in p], *rest) for p, *rest in rows]
    return small(spark.createDataFrame(named, f"pattern array<struct<is_null boolean, name string>>, {columns}"), BROADCAST_PATTERNS)


_TAKEN_COLUMNS = "passes bigint, cut int, levels array<struct<size bigint, cut int>>, extra map<bigint,int>"


def _taken_values(r: Rest) -> tuple:
    return (r.passes, r.cut, [{"size": n, "cut": c} for n, c in r.levels], r.extra)


def _times(one: str) -> Column:
    """How often a document of hash h is taken, its size being ``one``."""
    in_order = (_bucket(F.col("h")) < F.col("cut")) | F.exists("levels", lambda x: (F.col(one) <= x["size"]) & (_bucket(F.col("h")) < x["cut"]))
    return F.when(F.col(one) > 0, F.col("passes") + in_order.cast("long") + F.coalesce(F.col("extra")[F.col("h")], F.lit(0))).otherwise(F.col("passes"))


def _cut_in_order(units: DataFrame, mix: Mix, first: bool) -> bool:
    """Take documents in hash order until one doesn't fit: of all sizes ``first``, else of small ones only. Whether any rest shrank."""
    spark = units.sparkSession
    live = {p: r for p, r in mix.rests.items() if r.left > 0 and (first or _is_open(r))}
    size = {p: (1 << 62) if first else int(r.left * SMALLER) for p, r in live.items()}
    begin = {p: r.levels[-1][1] if r.levels else r.cut for p, r in live.items()}
    before, end = {p: r.left for p, r in live.items()}, dict(begin)
    for width in (BUCKETS, 1):
        rows = [(p, begin[p], end[p], size[p], r.left) for p, r in live.items() if end[p] < BUCKETS * BUCKETS and r.left > 0]
        if not rows:
            break
        side = _frame(spark, rows, "begin int, at int, most bigint, left bigint")
        bucket = _bucket(F.col("h"))
        # the first step looks at all buckets from the last cut on, the second inside the wide one that didn't fit
        inside = units.join(side, "pattern").filter((F.col("one") <= F.col("most")) & (bucket >= F.col("at")) & (F.lit(width > 1) | (bucket < F.shiftleft(F.shiftright("at", 12) + 1, 12))))
        by_bucket = inside.groupBy("pattern", F.floor(bucket / width).cast("int").alias("b")).agg(F.sum("size").alias("size"), F.max("left").alias("left"))
        run = by_bucket.withColumn("upto", F.sum("size").over(Window.partitionBy("pattern").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)))  # BUCKETS rows a pattern at most
        beyond = F.col("upto") > F.col("left")
        found = {_key(r.pattern): r for r in run.groupBy("pattern").agg(F.min(F.when(beyond, F.col("b"))).alias("b"), F.max(F.when(~beyond, F.col("upto"))).alias("upto")).collect()}
        for p, *_ in rows:
            r = found.get(p)
            upto, stop = (int(r.upto or 0), r.b) if r else (0, None)
            live[p].left -= upto
            top = BUCKETS * BUCKETS if width > 1 else ((end[p] >> 12) + 1) << 12
            end[p] = top if stop is None else max(end[p], int(stop) * width)
    for p, r in live.items():
        if first:
            r.cut = end[p]
        elif end[p] > begin[p]:
            r.levels.append((size[p], end[p]))
    return any(r.left < before[p] for p, r in live.items())


def _choose_single(units: DataFrame, mix: Mix, live: set, max_repeats: int, wide: bool) -> set:
    """Exchange passes over single documents where that brings a rest nearer; the patterns that changed.

    Without ``wide`` a document has the pattern's whole passes or one more.
    """
    names = sorted(live, key=repr)
    side = _frame(units.sparkSession, [(p, i, mix.rests[p].left, *_taken_values(mix.rests[p])) for i, p in enumerate(names)], f"pid int, left bigint, {_TAKEN_COLUMNS}")
    rows = units.filter("size > 0").join(side, "pattern").select("pid", "left", "passes", _times("one").alias("n"), "h", "size")
    low, high = (F.lit(0), F.lit(max_repeats)) if wide else (F.col("passes"), F.least(F.col("passes") + 1, F.lit(max_repeats)))
    sides = F.filter(F.array(F.when(F.col("n") > low, True), F.when(F.col("n") < high, False)), lambda x: x.isNotNull())
    doc = lambda order: F.struct(order.alias("o"), F.col("h").alias("h"), F.col("size").alias("size"))
    by_class = rows.withColumn("taken", F.explode(sides)).groupBy("pid", "left", "taken", F.floor(F.log2("size") * CLASSES).cast("int").alias("class")).agg(
        F.min(doc(F.col("h"))).alias("a"), F.max(doc(F.col("h"))).alias("b"), F.min(doc(F.abs(F.col("size") - F.col("left")))).alias("c"))
    candidates = by_class.select("pid", "left", "taken", F.explode(F.array_distinct(F.transform(F.array("a", "b", "c"), lambda x: F.struct(x["h"].alias("h"), x["size"].alias("size"))))).alias("x")).select("pid", "left", "taken", "x.h", "x.size")
    moves = candidates.groupBy("pid").applyInPandas(_moves, "pid int, h long, size long, taken boolean").collect()
    for m in moves:
        rest, step = mix.rests[names[m.pid]], -1 if m.taken else 1
        rest.left -= step * m["size"]
        rest.extra[m.h] = rest.extra.get(m.h, 0) + step
    return {names[m.pid] for m in moves}


def _sums(docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the sizes of no, one and two documents, ascending, and which ones they are (0 for none)."""
    sizes = np.concatenate([[0], docs[:, 1]])
    i, j = np.triu_indices(len(sizes))
    real = (i < j) | (j == 0)
    i, j = i[real], j[real]
    total = sizes[i] + sizes[j]
    order = np.lexsort((j, i, total))
    return total[order], np.stack([i, j], axis=1)[order]


def _moves(rows: pd.DataFrame) -> pd.DataFrame:
    """Documents of one pattern to take (or, taken ones, to leave): the best exchange of up to two for up to two, again and again while it brings the rest nearer."""
    rows = rows.sort_values(["size", "h"]).drop_duplicates(["h", "taken"])
    left = int(rows["left"].iloc[0])
    own, free = (rows[side][["h", "size"]].to_numpy(np.int64) for side in (rows.taken, ~rows.taken))
    out = []
    while True:
        (back, back_of), (more, more_of) = _sums(own), _sums(free)
        at = np.searchsorted(more, left + back)
        far = np.stack([np.abs(left + back - more[np.clip(at + k, 0, len(more) - 1)]) for k in (-1, 0)])
        k, i = np.unravel_index(far.argmin(), far.shape)
        if far[k, i] >= abs(left):
            break
        j = int(np.clip(at[i] + k - 1, 0, len(more) - 1))
        left += int(back[i] - more[j])
        gone, new = [x - 1 for x in back_of[i] if x], [x - 1 for x in more_of[j] if x]
        out += [(*own[x].tolist(), True) for x in gone] + [(*free[x].tolist(), False) for x in new]
        own, free = np.delete(own, gone, axis=0), np.delete(free, new, axis=0)
    return pd.DataFrame([(int(rows["pid"].iloc[0]), *m) for m in out], columns=["pid", "h", "size", "taken"])


def with_taken(docs: DataFrame, mix: Mix, id_col: str, size_col: str, members: Column, name: str = "taken") -> DataFrame:
    """``docs`` with the number of passes that the mix takes over each document, as ``name``; all rows and columns stay.

    ``docs`` are those of ``plan_mix``. Rows that repeat an id and a size have the same number; null ids are ids of
    their own, null and empty sizes aren't taken. The side by pattern is broadcast if it is small.
    """
    side = _frame(docs.sparkSession, [(p, *_taken_values(r)) for p, r in mix.rests.items()], _TAKEN_COLUMNS)
    boxes = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), pattern_of(members).alias("pattern"), _hash(mix.seed, F.col(id_col), F.col(size_col)).alias("h"), F.coalesce(F.col(size_col), F.lit(0)).alias("one"))
    return boxes.join(side, "pattern", "left").select("doc.*", F.coalesce(_times("one"), F.lit(0)).cast("long").alias(name))


def source_facts(spark, mix: Mix) -> DataFrame:
    """Per source: is_null, name, source_size, target."""
    return small(spark.createDataFrame([(a, b, int(n), float(mix.target[a, b])) for (a, b), n in mix.source_size.items()], "is_null boolean, name string, source_size long, target double"), BROADCAST_PATTERNS)
