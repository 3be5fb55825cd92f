"""MinHash near-dedup with SetSketch registers, and exact verification on full shingle sets.

1. Each text becomes a set of word shingles, and this a SetSketch: register i is the smallest of the
   set's exponential values under hash i, on a logarithmic scale (base 1.001), truncated to 16 bits.
   Sketches of parts of a set merge by maxima.
2. Texts of equal sets are one class; from here on one row stands for each class.
3. Bands of register values are hashed to buckets. Inside a bucket pairs are estimated by joint
   likelihood: the counts of larger, smaller and equal registers and the two known set sizes say on
   which side of a threshold well below 0.8 the likeliest similarity lies. The bucket's result are
   links that span its loosely similar parts, never its pairs.
4. Loose links join into clusters, which hold every pair of similar classes. Each cluster's sets are
   compared exactly, again giving links that span its parts.
5. Components of the exact links are the groups.

Large buckets and clusters are cut into blocks of bounded size (``spanning_links``). First each block is compared
with the group's leader, whose row goes to all of them. What is like the leader needs no more looking at among
itself; only what isn't goes to further tasks, each with a block of the rest and a block of the group. So a group
of copies of one text costs as much as its size, no task holds a whole large group, and no pair is lost. Two blocks
meet once, and then only pairs of a row of one with a row of the other are looked at.

With 24 bands of 4 registers, a pair of similarity 0.8 shares a bucket with probability over
0.999996, and loose links lose one with a probability below 1e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meterlake.llm.common import LOWER, UPPER, cut, mix64, runs, small, tidy
from meterlake.llm.components import components

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Registers start at this power of the base, so that sets of any size up to about 10^12 stay inside 16 bits.
SHIFT = 12_000
#: Pairs whose likeliest similarity is below this are no candidates (5 standard deviations below 0.8).
LOOSE = 0.6
PERCENT = 80
#: A bucket is cut into blocks of about so many classes, a cluster into blocks of so many shingles.
BUCKET_BLOCK, CLUSTER_BLOCK = 2048, 1 << 20
#: Where sets are compared by bitmaps first, these have 2 to these powers bits for each element, and up to twice as many.
MAP_BITS = (2, 5)
#: So few sets are compared without bitmaps.
MAP_SETS = 8
#: Bitmaps are filled for about so many elements at a time.
MAP_CHUNK = 1 << 18
#: Where blocks may be wider, a large group has about so many at least.
FEWEST_BLOCKS = 8
BROADCAST_ROWS = 500_000
CHUNK_CHARS = 500_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_WORDS: dict[bytes, int] = {}
_MAX_WORDS = 150_000


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes; those of words seen in this task are kept, up to a bound."""
    if len(_WORDS) > _MAX_WORDS:
        _WORDS.clear()
    get = _WORDS.get
    out = []
    for w in words:
        h = get(w)
        if h is None:
            h = _WORDS[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, np.uint64)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct k-word shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words is one
    shingle, a text without words has none.
    """
    words = [(t or "").encode("utf-8", "surrogatepass").translate(_LOWER).split() for t in texts]
    flat = _word_hashes([w for ws in words for w in ws])
    ends = np.cumsum([len(ws) for ws in words]) if words else np.zeros(0, np.int64)
    n = len(flat) - k + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(k):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + flat[j : j + n] if n > 0 else rolled
    rolled = mix64(rolled)
    out, start = [], 0
    for ws, end in zip(words, ends.tolist(), strict=True):
        if len(ws) >= k:
            out.append(np.unique(rolled[start : end - k + 1]))
        elif ws:
            whole = hashlib.blake2b(b" ".join(ws), digest_size=8, salt=b"short").digest()
            out.append(np.frombuffer(whole, "<u8").astype(np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def _hash_family() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:REGISTERS], seeds[REGISTERS:] | np.uint64(1)


def set_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16), a row for each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    least = np.empty((len(sets), REGISTERS), np.uint64)
    for i, (flip, times) in enumerate(zip(*_hash_family(), strict=True)):
        least[:, i] = np.minimum.reduceat((flat ^ flip) * times, starts)
    value = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(value) / np.log(BASE)) + SHIFT, 0, TOP).astype(np.uint16)


def loosely_similar(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float = LOOSE) -> np.ndarray:
    """Whether the likeliest similarity of sketches a and b (rows; sizes known) is at least ``least``.

    The likelihood of the numbers of larger, smaller and equal registers is concave in the
    similarity, so the sign of its slope at ``least`` tells.
    """
    larger, smaller = (a > b).sum(axis=-1), (a < b).sum(axis=-1)
    equal = REGISTERS - larger - smaller
    u = n_a / (n_a + n_b)
    v = 1 - u
    c = (BASE - 1) / BASE
    reach = np.minimum(u, v) / np.maximum(u, v) >= least
    x, y = np.maximum(u - v * least, 1e-12), np.maximum(v - u * least, 1e-12)
    p = lambda z: -np.log1p(-c * z) / np.log(BASE)
    slope_of = lambda z: c / (1 - c * z) / np.log(BASE)
    gain = equal * (v * slope_of(x) + u * slope_of(y)) / np.maximum(1 - p(x) - p(y), 1e-12)
    return reach & (gain - larger * v * slope_of(x) / p(x) - smaller * u * slope_of(y) / p(y) >= 0)


#: ``alike(i, lo, hi)``: which of the items from lo to hi (all, if not given) are like item i.
Alike = Callable[..., np.ndarray]


def _spanning(n: int, alike: Alike, label: np.ndarray | None = None, split: int | None = None) -> list[tuple[int, int]]:
    """Links (member, first member) that span the parts of n items.

    Items of one ``label`` (from 0 to n - 1) are linked already. Pairs inside a part already found needn't be looked at; so items of
    the largest part are skipped, and the rest is held against all. With ``split`` only pairs of an item before it with one from
    it on count; where some are found, the item's own side is looked at too, as what is like it there needn't be held against the other side.
    """
    label = np.arange(n) if label is None else label.copy()
    before = label.copy()
    counts = np.bincount(label, minlength=n)
    parts = np.count_nonzero(counts)
    todo = np.ones(n, bool)
    while parts > 1:
        largest = counts.argmax()
        queue = np.flatnonzero(todo & (label != largest) if counts[largest] > 1 else todo)
        if not len(queue):
            break
        if split is not None:
            left = np.flatnonzero(todo[:split])
            if not len(left):
                break
            # the other side's turn, unless those left on this one are fewer
            queue = queue[queue < split] if queue[0] < split else min(queue, left, key=len)
        for i in queue.tolist():
            todo[i] = False
            lo, hi = (0, n) if split is None else (split, n) if i < split else (0, split)
            hit = label[lo:hi][alike(i, lo, hi)]
            if (hit == label[i]).all():
                continue
            found = np.unique(np.append(hit, label[i]))
            if split is not None:
                lo, hi = (0, split) if i < split else (split, n)
                found = np.unique(np.append(found, label[lo:hi][alike(i, lo, hi)]))
            now = np.arange(n)
            now[found] = found[0]
            label = now[label]
            counts[found[0]] = counts[found].sum()
            counts[found[1:]] = 0
            parts -= len(found) - 1
            break
    changed = np.flatnonzero(label != before)
    first = changed[np.unique(before[changed], return_index=True)[1]]  # one member of each part that was linked on
    return [(int(i), int(label[i])) for i in first]


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, row (hash of the text), n (set size), fp (128 bits of the set; null if empty), regs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, prints, regs = [], [], []
            for lo, hi in runs(np.array([len(t or "") for t in texts], np.int64), CHUNK_CHARS):
                sets = shingle_sets(texts[lo:hi], k)
                full = [s for s in sets if len(s)]
                rows = iter(set_sketches(full)) if full else iter(())
                for s in sets:
                    sizes.append(len(s))
                    prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    regs.append(next(rows).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(regs, pa.binary())], names=["id", "row", "n", "fp", "regs"])
        _WORDS.clear()

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    return named.mapInArrow(tidy(run), "id long, row long, n long, fp binary, regs binary")


def _streamed(key_columns: int, handle: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A mapInArrow function over sorted rows: ``handle`` gets tables of whole groups of the leading columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(key_columns)], axis=1)
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if last is not None and (keys[0] != last).any():
                yield from handle(pa.Table.from_batches(held))
                held = []
            if len(change):
                at = int(change[-1])
                yield from handle(pa.Table.from_batches([*held, batch.slice(0, at)]))
                held = [batch.slice(at)]
            else:
                held.append(batch)
            last = keys[-1]
        if held:
            yield from handle(pa.Table.from_batches(held))

    return run


def _groups(table: pa.Table, key_columns: int) -> np.ndarray:
    """Where groups of the leading columns begin, and the end."""
    keys = np.stack([table.column(i).to_numpy() for i in range(key_columns)], axis=1)
    return np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])


def _bucket_alike(group: pa.Table) -> Alike:
    """Loose likeness of sketches; columns n, regs."""
    n = group.column(0).to_numpy().astype(np.float64)
    regs = np.frombuffer(b"".join(group.column(1).to_pylist()), "<u2").reshape(-1, REGISTERS)
    return lambda i, lo=0, hi=None: loosely_similar(regs[lo:hi], regs[i], n[lo:hi], n[i])


class _Bitmaps:
    """Sets (sorted hashes, none empty) as bitmaps: an element sets the bit that its leading bits name."""

    def __init__(self, sets: list[np.ndarray], bits: int) -> None:
        self.sets, self.sizes, self.bits = sets, np.array([len(s) for s in sets]), bits
        self.power = np.ceil(np.log2(self.sizes)).astype(np.int64)
        self.place = np.empty(len(sets), np.int64)  # among the sets of one power
        for p in np.unique(self.power).tolist():
            self.place[self.power == p] = np.arange(np.count_nonzero(self.power == p))
        self.made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def of(self, power: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of 2 ** width bits of all sets of a power, and their numbers of bits that are set."""
        if (power, width) not in self.made:
            rows = np.flatnonzero(self.power == power)
            maps = np.zeros((len(rows), 1 << width - 6), np.uint64)
            for lo, hi in runs(self.sizes[rows], MAP_CHUNK):
                elements = np.concatenate([self.sets[r] for r in rows[lo:hi].tolist()])
                bit = elements >> np.uint64(64 - width)
                word = np.repeat(np.arange(hi - lo) << width - 6, self.sizes[rows[lo:hi]]) + (bit >> np.uint64(6)).astype(np.int64)
                heads = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
                maps[lo:hi].reshape(-1)[word[heads]] = np.bitwise_or.reduceat(np.uint64(1) << (bit & np.uint64(63)), heads)
            self.made[power, width] = maps, np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        return self.made[power, width]

    def most_common(self, at: np.ndarray, i: int) -> np.ndarray:
        """The most elements that set i can have in common with each set of ``at``: a bit that only one of them has is an element that the other lacks."""
        out = np.zeros(len(at), np.int64)
        for p in np.unique(self.power[at]).tolist():
            here = np.flatnonzero(self.power[at] == p)
            own_power = int(self.power[i])
            width = max(min(p, own_power) + self.bits, 6)
            (maps, bits), (own_maps, own_bits) = self.of(p, width), self.of(own_power, width)
            rows, own = self.place[at[here]], self.place[i]
            both = np.bitwise_count((maps if len(rows) == len(maps) else maps[rows]) & own_maps[own]).sum(axis=1, dtype=np.int64)
            out[here] = np.minimum(self.sizes[i] - own_bits[own], self.sizes[at[here]] - bits[rows]) + both
        return out


def exact_alike(percent: int) -> Callable[[pa.Table], Alike]:
    """Exact likeness of sets: 100 * intersection >= percent * union; column set, none of them empty.

    A pair whose sizes or bitmaps can't reach ``percent`` is settled; only the others' elements are compared.
    """

    def alike_in(group: pa.Table) -> Alike:
        sets = [np.frombuffer(s, "<u8") for s in group.column(0).to_pylist()]
        sizes = np.array([len(s) for s in sets])
        maps = [_Bitmaps(sets, bits) for bits in MAP_BITS] if len(sets) > MAP_SETS else []

        def enough(at: np.ndarray, i: int, common: np.ndarray) -> np.ndarray:
            return 100 * common >= percent * (sizes[at] + sizes[i] - common)

        def alike(i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
            near, own = sizes[lo:hi], sets[i]
            at = lo + np.flatnonzero(100 * np.minimum(near, sizes[i]) >= percent * np.maximum(near, sizes[i]))
            for level in maps:
                at = at[enough(at, i, level.most_common(at, i))]
            out = np.zeros(len(near), bool)
            for first, last in runs(sizes[at], MAP_CHUNK):
                some = at[first:last]
                elements = np.concatenate([sets[k] for k in some.tolist()])
                found = own[np.minimum(np.searchsorted(own, elements), len(own) - 1)] == elements
                common = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
                out[some - lo] = enough(some, i, common)
            return out

        return alike

    return alike_in


def spanning_links(rows: DataFrame, weight: Column, block: int, alike_in: Callable[[pa.Table], Alike], wider: int = 1) -> DataFrame:
    """Links (u, v) that span the alike parts of each group of ``rows`` (key long, fp, what ``alike_in`` needs); ``fp`` is unique in a group.

    A block has rows of about ``block`` in the sum of ``weight``, of up to ``wider`` times as much where a large group's rest is compared.
    ``alike_in`` gets the last columns of a group's rows and says which are like its i-th. Groups of one row give no link, no rows give none.
    """
    payload = rows.columns[2:]
    kind = rows.schema["fp"].dataType
    arrow_kind, spark = to_arrow_type(kind), rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = rows.groupBy("key").agg(F.ceil(F.sum(weight) / block).alias("blocks"), F.min("fp").alias("lead"), F.count("*").alias("members")).filter("members > 1").drop("members")
    known = rows.join(small(cut(groups), BROADCAST_ROWS), "key")
    own = lambda blocks: F.pmod(F.xxhash64("fp"), F.col(blocks))
    every = lambda blocks: F.sequence(F.lit(0).cast("long"), (F.col(blocks) if isinstance(blocks, str) else blocks) - 1)

    def batch(us: list, vs: list, keys: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(us, arrow_kind), pa.array(vs, arrow_kind), pa.array(keys, pa.int64())], names=["u", "v", "key"])

    def by_leader(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Columns key, b, blocks, fp, payload; the leader comes first. Rows unlike it are given back with their group's key."""
        bounds, fps, us, vs, keys = _groups(table, 2), table.column(3).to_pylist(), [], [], []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            alike = alike_in(table.slice(lo, hi - lo).select(range(4, table.num_columns)))
            if table.column(2)[lo].as_py() == 1:
                links = _spanning(hi - lo, alike)
                us += [fps[lo + i] for i, _ in links]
                vs += [fps[lo + j] for _, j in links]
                keys += [None] * len(links)
            else:
                near = alike(0)
                us += fps[lo + 1 : hi]
                vs += [fps[lo] if x else None for x in near[1:]]
                keys += [None if x else table.column(0)[lo].as_py() for x in near[1:]]
        yield batch(us, vs, keys)

    places = F.when(F.col("fp") == F.col("lead"), every("blocks")).otherwise(F.array(own("blocks")))
    dealt = known.withColumn("b", F.explode(places)).repartition(n, "key", "b").sortWithinPartitions("key", "b", F.col("fp") != F.col("lead"), "fp")
    schema = f"u {kind.simpleString()}, v {kind.simpleString()}, key long"
    found = cut(dealt.select("key", "b", "blocks", "fp", *payload).mapInArrow(tidy(_streamed(2, by_leader)), schema))
    links, rest = found.filter("v is not null").select("u", "v"), found.filter("v is null").select("key", F.col("u").alias("fp"), F.lit(True).alias("free"))
    if rest.isEmpty():
        return links

    def by_rest(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Columns key, bi, bj, second, fp, free, payload: two blocks of a group, or one with itself; rows that aren't free are linked already."""
        bounds, fps, us, vs = _groups(table, 3), table.column(4).to_pylist(), [], []
        bi, bj, second, free = (table.column(i).to_numpy() for i in (1, 2, 3, 5))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n, split = hi - lo, None if bi[lo] == bj[lo] else int(np.count_nonzero(~second[lo:hi]))
            if split in (0, n):
                continue
            linked = np.flatnonzero(~free[lo:hi])
            label = np.arange(n)
            label[linked] = linked[:1]
            links = _spanning(n, alike_in(table.slice(lo, n).select(range(6, table.num_columns))), label, split)
            us += [fps[lo + i] for i, _ in links]
            vs += [fps[lo + j] for _, j in links]
        yield batch(us, vs, [None] * len(us))

    rest = small(rest, BROADCAST_ROWS)
    marked = known.join(small(rest.select("key").distinct(), BROADCAST_ROWS), "key", "left_semi").join(rest, ["key", "fp"], "left").withColumn("free", F.coalesce("free", F.lit(False)))
    wide = F.greatest(F.lit(block), F.least(F.lit(block * wider), F.sum(weight) / FEWEST_BLOCKS))
    counts = marked.groupBy("key").agg(*[F.ceil(F.sum(F.when(which, weight)) / wide).alias(name) for name, which in (("rests", F.col("free")), ("others", ~F.col("free")))])
    # blocks of the rest come first; each of them meets itself, the others of the rest and those of the other rows
    placed = marked.join(small(counts, BROADCAST_ROWS), "key").withColumn("mine", F.when(F.col("free"), own("rests")).otherwise(F.col("rests") + own("others")))
    met = placed.withColumn("other", F.explode(F.when(F.col("free"), every(F.col("rests") + F.col("others"))).otherwise(every("rests"))))
    pairs = met.select("key", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), (F.col("mine") > F.col("other")).alias("second"), "fp", "free", *payload)
    dealt = pairs.repartition(n, "key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "second", "fp")
    return links.unionByName(dealt.mapInArrow(tidy(_streamed(3, by_rest)), schema).select("u", "v"))


def loose_clusters(classes: DataFrame) -> DataFrame:
    """(node, component) of classes (fp, n, regs) under loose links between those that share a bucket."""
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * width + 1, F.lit(width))))
    bands = classes.select("fp", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").drop("size")
    rows = bands.join(shared, "key").join(classes, "fp").select("key", "fp", "n", "regs")
    return components(spanning_links(rows, F.lit(1), BUCKET_BLOCK, _bucket_alike))


def exact_components(docs: DataFrame, reps: DataFrame, k: int, id_col: str, text_col: str, percent: int) -> DataFrame:
    """(node, component) under exact links; ``reps`` (fp, id, row, cluster) says which rows have the clusters' sets."""
    wanted = cut(reps)
    if wanted.count() <= BROADCAST_ROWS:  # 16-byte keys
        wanted = F.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in runs(np.array([len(t or "") for t in texts], np.int64), CHUNK_CHARS):
                sets = shingle_sets(texts[lo:hi], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cluster", "fp", "n", "set"])
        _WORDS.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"))
    found = rows.join(wanted, rows.id.eqNullSafe(wanted.id) & (rows.row == wanted.row)).select(F.xxhash64("cluster").alias("cluster"), "fp", "text")
    sets = cut(found.mapInArrow(tidy(run), "cluster long, fp binary, n long, set binary"))
    rows = sets.select(F.col("cluster").alias("key"), "fp", "set")
    return components(spanning_links(rows, F.length("set") / 8, CLUSTER_BLOCK, exact_alike(percent)))


def group_rows(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``near_groups`` with the columns id, row (hash of the text), n, component_id, kept."""
    rows = cut(sketch(docs, k, id_col, text_col))
    classes = cut(rows.filter("fp is not null").groupBy("fp").agg(F.min(F.struct("id", "row")).alias("one"), F.max("n").alias("n"), F.max("regs").alias("regs")))
    clusters = loose_clusters(classes.select("fp", "n", "regs"))
    reps = classes.select("fp", "one.id", "one.row").join(clusters.select(F.col("node").alias("fp"), F.col("component").alias("cluster")), "fp")
    linked = exact_components(docs, reps, k, id_col, text_col, percent).select(F.col("node").alias("fp"), "component")
    label = F.coalesce("component", "fp")
    whole = cut(rows.drop("regs").join(linked, "fp", "left").withColumn("label", label).drop("component", "fp"))
    least = cut(whole.filter("label is not null").groupBy("label").agg(F.min("id").alias("least"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    least = F.broadcast(least) if least.count() <= BROADCAST_ROWS else least
    out = whole.join(least, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("id")).otherwise(F.coalesce("least", "id"))
    out = out.withColumn("component_id", component)
    return out.select("id", "row", "n", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_groups(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id of its group), kept (id = component_id).

    Two texts are linked if 100 times their shingle sets' intersection is at least ``percent`` times their
    union; groups are the components. Texts without words have no shingles and are linked with
    nothing. Rows that repeat an id are compared by their own texts; those that have the kept id all
    stay. A null id never names a group that has another; a group of null ids alone has a null
    component_id and is kept. Other columns aren't read; an empty table gives no rows.
    """
    return group_rows(docs, k, id_col, text_col, percent).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "kept")
