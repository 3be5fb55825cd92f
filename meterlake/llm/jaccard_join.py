"""Jaccard join of word shingle sets as a join in a metric space.

1 minus the Jaccard similarity is a metric, in which two texts link if they are at most ``reach`` (0.15) apart.

1. Texts become shingle sets; equal sets are one class, and one row stands for it.
2. Most classes are at distance 1 from nearly all others, where no pivot tells them apart. So the first pivots are found through
   samples: a class is taken to the pivots with which it shares three minima of one band, the pivot of a band's bucket being its
   class of least hash. With 32 bands a linked pair misses every common pivot with a probability below 1e-13.
3. A region too large for a task gets further pivots of its own, and each of its members exact distances to all of them. A member
   belongs to its nearest pivot's Voronoi cell. Two linked members' distances to a pivot differ by at most the reach, so whoever is at most
   twice the reach farther from another cell's pivot than from its own goes to that cell too: each linked pair meets in
   the cell of one of the two. Members at most the reach from a pivot are linked by that, and need no more looking at among themselves;
   of these, only those whose distance to the cell's pivot is within the reach of that of some other member stay.
   Cells that are still too large are cut again, with pivots from the members that aren't linked yet.
4. Inside a region sets are compared exactly, where sizes and distances to a few pivots leave it open. Regions that pivots can't cut,
   as all is equally far from all, are joined in blocks, exactly as well.
5. Components of the links are the classes' groups. No pairs of copies, or inside a part already linked, are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut, runs, small, tidy
from meterlake.llm.components import components
from meterlake.llm.near_dedup import BROADCAST_ROWS, CHUNK_CHARS, REGISTERS, Alike, _groups, _streamed, exact_alike, shingle_sets, sketch, spanning_links

PERCENT = 85
#: Register triples of the 96 registers.
BANDS, ROWS = REGISTERS // 3, 3
#: A region of more shingles is cut into cells by so many pivots, at most so many times over.
REGION, PIVOTS, LEVELS = 1 << 20, 16, 4
#: Cells of a region may hold so many times its members in all; where they would hold more, its members are too much alike in distance.
SPREAD = 3
#: Pivots inside a task, for groups of more than so many sets.
TASK_PIVOTS, TASK_SETS = 6, 48
#: Rounding of distances.
SLACK = 1e-9


def overlaps(sets: list[np.ndarray], pivots: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set with each pivot (at most 63), by one search of the sets' elements in all pivots' together."""
    every, place = np.unique(np.concatenate(pivots), return_inverse=True)
    masks = np.zeros(len(every) + 1, np.uint64)
    start = 0
    for j, p in enumerate(pivots):
        masks[place[start : start + len(p)]] |= np.uint64(1 << j)
        start += len(p)
    flat = np.concatenate(sets)
    at = np.searchsorted(every, flat)
    at[at < len(every)] = np.where(every[at[at < len(every)]] == flat[at < len(every)], at[at < len(every)], len(every))
    found = masks[at]
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    return np.stack([np.add.reduceat((found >> np.uint64(j) & np.uint64(1)).astype(np.int64), starts) for j in range(len(pivots))], axis=1)


def distances(sets: list[np.ndarray], pivots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intersections, unions and Jaccard distances of each set (not empty) to each pivot."""
    common = overlaps(sets, pivots)
    union = np.array([len(s) for s in sets])[:, None] + np.array([len(p) for p in pivots]) - common
    return common, union, 1 - common / union


def metric_alike(percent: int) -> Callable[[pa.Table], Alike]:
    """``exact_alike`` behind windows of the distances to a few pivots, each the set farthest from those before; column set."""
    exact, reach = exact_alike(percent), 1 - percent / 100 + SLACK

    def alike_in(group: pa.Table) -> Alike:
        if group.num_rows <= TASK_SETS:
            return exact(group)
        sets = [np.frombuffer(s, "<u8") for s in group.column(0).to_pylist()]
        away, at = [], 0
        for _ in range(TASK_PIVOTS):
            away.append(distances(sets, [sets[at]])[2][:, 0])
            at = int(np.min(away, axis=0).argmax())
        away = np.stack(away, axis=1)

        def alike(i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
            near = lo + np.flatnonzero((np.abs(away[lo:hi] - away[i]) <= reach).all(axis=1))
            out = np.zeros(len(away[lo:hi]), bool)
            if len(near) >= len(sets) // 4:
                return whole()(i, lo, hi)
            if (near != i).any():
                out[near - lo] = exact(group.take(pa.array(np.append(near, i))))(len(near))[:-1]
            else:
                out[near - lo] = True
            return out

        kept: list = []

        def whole() -> Alike:
            kept.extend([] if kept else [exact(group)])
            return kept[0]

        return alike

    return alike_in


def first_regions(classes: DataFrame) -> DataFrame:
    """(key, fp): the classes (fp, regs) that share a band with each pivot, the pivot itself among them."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * width + 1, F.lit(width))))
    bands = classes.select("fp", F.explode(keys).alias("band"))
    pivots = bands.groupBy("band").agg(F.min(F.struct(F.xxhash64("fp").alias("h"), "fp")).alias("pivot"), F.count("*").alias("size")).filter("size > 1")
    met = bands.join(pivots.select("band", F.col("pivot.fp").alias("pivot")), "band").select(F.xxhash64("pivot").alias("key"), "fp")
    return met.distinct()


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(fp, n, set) of the classes in ``wanted`` (fp, id, row), from the texts of the rows that stand for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in runs(np.array([len(t or "") for t in texts], np.int64), CHUNK_CHARS):
                sets = shingle_sets(texts[lo:hi], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "n", "set"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    found = rows.join(small(wanted, BROADCAST_ROWS), rows.id.eqNullSafe(wanted.id) & (rows.row == wanted.row)).select("fp", "text")
    return found.mapInArrow(tidy(run), "fp binary, n long, set binary")


def measured(rows: DataFrame, percent: int) -> DataFrame:
    """(key, fp, label, away, u, v): of rows (key, b, own, pivots, fp, set), where pivots stand first in each block of a region.

    Per member, in its own block: the part of the pivots that it is linked to (null: none) and its distances to all; and a row (u, v) for each link to a pivot.
    """
    schema = "key long, fp binary, label int, away array<double>, u binary, v binary"

    def handle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        bounds = _groups(table, 2)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            part = table.slice(lo, hi - lo)
            fps, own = part.column(4).to_pylist(), np.array(part.column(2).to_pylist(), bool)
            names = part.column(3)[0].as_py()
            sets = [np.frombuffer(s, "<u8") for s in part.column(5).to_pylist()]
            pivots = [sets[fps.index(fp)] for fp in names]
            between = distances(pivots, pivots)
            linked = 100 * between[0] >= percent * between[1]
            parts = np.arange(len(pivots))
            for _ in pivots:  # pivots linked over others, at most as many steps as pivots
                parts = np.where(linked, parts, len(parts)).min(axis=1)
            common, union, away = distances(sets, pivots)
            hit = 100 * common >= percent * union
            label = np.where(hit, parts, len(pivots)).min(axis=1)
            at = np.flatnonzero(own)
            labels = [None if x == len(pivots) else x for x in label[at].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.column(0)[0].as_py()] * len(at), pa.int64()), pa.array([fps[i] for i in at], pa.binary()), pa.array(labels, pa.int32()), pa.array(away[at].tolist(), pa.list_(pa.float64())), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary())],
                names=["key", "fp", "label", "away", "u", "v"],
            )
            rows_of, pivots_of = np.nonzero(hit & own[:, None])
            u, v = [fps[i] for i in rows_of], [names[j] for j in pivots_of]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.binary()), pa.nulls(len(u), pa.int32()), pa.nulls(len(u), pa.list_(pa.float64())), pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["key", "fp", "label", "away", "u", "v"])

    return rows.mapInArrow(tidy(_streamed(2, handle)), schema)


def cells(regions: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(regions, links): ``regions`` (key, fp) with those of more than ``REGION`` shingles cut into Voronoi cells, and links (u, v) met on the way."""
    spark = sets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    reach = 1 - percent / 100
    sizes = sets.select("fp", "n")
    now, done, links = cut(regions.join(sizes, "fp").select("key", "fp", "n", F.lit(True).alias("free"))), [], []
    for level in range(LEVELS):
        lead = [F.min(F.when(F.col("free"), F.struct(F.xxhash64(F.lit(level * PIVOTS + j), "fp").alias("h"), "fp"))).alias(f"p{j}") for j in range(PIVOTS)]
        facts = now.groupBy("key").agg(F.sum("n").alias("weight"), *lead).filter(F.col("weight") > REGION)
        named = F.array_distinct(F.array_compact(F.array(*[F.col(f"p{j}.fp") for j in range(PIVOTS)])))
        large = cut(facts.select("key", F.ceil(F.col("weight") / REGION).alias("blocks"), named.alias("pivots")).filter(F.size("pivots") > 0))
        if large.isEmpty():
            break
        large = small(large, BROADCAST_ROWS // PIVOTS)
        block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        places = F.when(F.array_contains("pivots", F.col("fp")), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(block))
        held = now.join(large, "key").withColumn("b", F.explode(places)).withColumn("own", F.col("b") == block)
        dealt = held.join(sets.select("fp", "set"), "fp").repartition(n, "key", "b").sortWithinPartitions("key", "b", ~F.array_contains("pivots", F.col("fp")), "fp")
        found = cut(measured(dealt.select("key", "b", "own", "pivots", "fp", "set"), percent))
        links.append(found.filter("u is not null").select("u", "v"))
        members = found.filter("key is not null").select("key", "fp", "label", "away")

        nearest = F.array_min("away")
        into = F.filter(F.sequence(F.lit(0), F.size("away") - 1), lambda j: (F.get("away", j) <= nearest + 2 * reach + SLACK) & (j <= F.array_position("away", nearest).cast("int") - 1))
        members = members.withColumn("cells", into)
        counted = members.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum(F.size("cells")).alias("copies"))
        totals = counted.groupBy("key").agg(F.max_by("label", F.when(F.col("label").isNotNull(), F.col("c"))).alias("main"), F.sum("copies").alias("copies"), F.sum("c").alias("c"))
        totals = small(cut(totals), BROADCAST_ROWS)
        judged = members.join(totals, "key").withColumn("free", F.col("main").isNull() | F.coalesce(F.col("label") != F.col("main"), F.lit(True)))
        uncut = judged.filter(F.col("copies") > SPREAD * F.col("c")).groupBy("key").agg(F.max("free").alias("open")).filter("open").select("key")
        cut_up = judged.filter(F.col("copies") <= SPREAD * F.col("c")).select("key", "fp", "free", "away", F.explode("cells").alias("cell"))
        cut_up = cut_up.select(F.xxhash64("key", "cell", F.lit(level)).alias("key"), "fp", "free", F.get("away", F.col("cell")).alias("near"))
        ring = cut_up.filter("free").groupBy("key").agg(F.min("near").alias("low"), F.max("near").alias("high"))
        kept = cut_up.join(small(cut(ring), BROADCAST_ROWS), "key").filter(F.col("free") | F.col("near").between(F.col("low") - reach - SLACK, F.col("high") + reach + SLACK))
        done.append(now.join(large.select("key"), "key", "left_anti").select("key", "fp"))
        done.append(now.join(small(cut(uncut), BROADCAST_ROWS), "key", "left_semi").select("key", "fp"))
        now = cut(kept.join(sizes, "fp").select("key", "fp", "n", "free"))
    done.append(now.select("key", "fp"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    if not links:
        return out, spark.createDataFrame([], "u binary, v binary")
    every = links[0]
    for more in links[1:]:
        every = every.unionByName(more)
    return out, every


def join_groups(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable by links).

    Two texts link if 100 times their shingle sets' intersection is at least ``percent`` (85 or more) times their union. A text of fewer than
    k words is one shingle; null texts and texts without words have none and link with nothing. Rows that repeat an id are compared by
    their own texts. A null id never names a group that has another. Other columns aren't read; an empty table gives no rows.
    """
    rows = cut(sketch(docs, k, id_col, text_col))
    classes = cut(rows.filter("fp is not null").groupBy("fp").agg(F.min(F.struct("id", "row")).alias("one"), F.max("regs").alias("regs")))
    regions = cut(first_regions(classes))
    wanted = cut(classes.join(regions.select("fp").distinct(), "fp", "left_semi").select("fp", "one.id", "one.row"))
    sets = cut(full_sets(docs, wanted, k, id_col, text_col))
    regions, links = cells(regions, sets, percent)
    held = regions.join(sets, "fp").select("key", "fp", "set")
    links = links.unionByName(spanning_links(held, F.length("set") / 8, REGION, metric_alike(percent)))
    linked = components(links)
    whole = rows.drop("regs").join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    whole = cut(whole.select("id", "n", "label"))
    least = whole.filter("label is not null").groupBy("label").agg(F.min("id").alias("least"), F.count("*").alias("size")).filter("size > 1").drop("size")
    out = whole.join(small(cut(least), BROADCAST_ROWS), "label", "left")
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.coalesce("least", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))

