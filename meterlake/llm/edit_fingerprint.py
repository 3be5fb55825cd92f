"""Document fingerprints: a randomised edit embedding, bit-sampled; banding and verification find near pairs.

All texts are walked by one shared random walk. At step j the walk stands at some character, emits
a hash of the window of Q characters there, and moves on by 1 to Q characters as a shared random
function of j and the window says; so every character lies in some emitted window's reach. After
an edit two walks soon meet again at the same place at the same step, and from then on emit the
same: texts at a small edit distance have embeddings at a small Hamming distance.

A walk from a text's beginning may stay apart for long after words or lines were put in or left out. So near texts
are found by short walks from many places that both texts know: windows are dealt to ``BINS`` bins by their hash, and the window of
least hash in a bin is an anchor, from which the shared walk emits the samples of one band. Near texts have most anchors in
common, and from each the same samples up to the next edit. Bands are hashed to buckets, and inside a bucket links
span the parts of texts that have ``LOOSE_ANCHORS`` of their anchors in common, never their pairs; large buckets are cut into blocks. The links join
into clusters. In a cluster the texts themselves decide: two are near if their sets of Q-character windows have ``PERCENT`` of their union in
common, which each edit changes by at most Q windows. Groups are the components of near texts.

The fingerprint samples the embedding's coordinates: sample k reads step jump(k, number of steps),
a consistent hash, so texts of nearly the same number of steps read the same steps. The share of
equal samples estimates the share of equal coordinates.

numpy takes a step of all texts of a group at once, longest first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from meterlake.llm import near_dedup
from meterlake.llm.common import codes, cut, mix64, runs, small, tidy
from meterlake.llm.components import components

Q = 8
SAMPLES = 128
SEED = 0x5851F42D4C957F2D
#: Texts are held until they have so many characters, and then walked in chunks of like lengths: a chunk takes as many steps as its longest text.
HELD_CHARS, CHUNK_CHARS = 9_000_000, 3_000_000
#: Samples a band. One edit at random leaves a text of 300, 1,000, 4,000 characters a shared band in 84, 95, 99 of 100 cases; with bands of 4 in 82, 90, 99.
BAND = 3
#: Fingerprints of a smaller likeness are no candidates; of 1,000 pairs of other texts 999 are below 0.04.
LOOSE = 0.1
#: Bins of windows, each with an anchor; and the steps behind an anchor that a band samples, two bytes each.
BINS, STEPS = 32, (0, 1, 3, 6)
#: Texts that have a smaller share of anchors in common are no candidates; at 80 % of common windows it is 0.8, with a deviation of 0.07.
LOOSE_ANCHORS = 0.5
#: So few texts are held against each other by their anchors at once.
FEW = 64
#: Texts are near from this share of common windows on.
PERCENT = 80
#: A cluster is cut into blocks of about so many characters.
CLUSTER_BLOCK = 1 << 20
_NULL = -(1 << 63)


def window_hashes(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of the Q characters from each place on; characters beyond a text's end count as none."""
    size = len(flat)
    end = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(size)
    h = flat.astype(np.uint64) + np.uint64(1)
    width = 1
    while width < Q:
        later = np.zeros(size, np.uint64)
        later[:-width or None] = h[width:]
        later[end <= width] = 0
        h = h * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + (later ^ (later >> np.uint64(31)))
        width *= 2
    return mix64(h)


def stride(here: np.ndarray, j: int) -> np.ndarray:
    """How far the shared walk moves at step j from windows of the hashes ``here``: 1 to Q characters."""
    key = (here ^ np.uint64((SEED * (2 * j + 1)) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
    return 1 + (key >> np.uint64(61)).astype(np.int64)


def anchored(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the bands of its anchors (BINS x STEPS, 16 bits; 0 without one), and a byte for each anchor's window (0 without one)."""
    n, size = len(offsets) - 1, len(hashes)
    text = np.repeat(np.arange(n), np.diff(offsets))
    left = offsets[1:][text] - np.arange(size)
    whole = np.flatnonzero((left >= Q) | (np.arange(size) == offsets[:-1][text]))  # a text shorter than a window is one
    place = text[whole] * BINS + (hashes[whole] >> np.uint64(59)).astype(np.int64)
    least = np.full(n * BINS, 2**64 - 1, np.uint64)
    np.minimum.at(least, place, hashes[whole])
    first = np.flatnonzero(hashes[whole] == least[place])[::-1]
    at = np.full(n * BINS, -1, np.int64)
    at[place[first]] = whole[first]  # of a window that comes again the first place
    bands, live = np.zeros((n * BINS, len(STEPS)), np.uint16), np.flatnonzero(at >= 0)
    end = np.repeat(offsets[1:], BINS)
    tags = np.zeros(n * BINS, np.uint8)
    tags[live] = 1 + (hashes[at[live]] >> np.uint64(16)).astype(np.int64) % 255
    for j in range(STEPS[-1] + 1):
        here = hashes[at[live]]
        if j in STEPS:
            bands[live, STEPS.index(j)] = (here >> np.uint64(32)).astype(np.uint16) | np.uint16(1)
        at[live] += stride(here, j)
        live = live[at[live] < end[live]]
    return bands.reshape(n, BINS * len(STEPS)), tags.reshape(n, BINS)


def walk(flat: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emitted bytes, each text's from its offset on, and (offset, number of steps) of each text; ``hashes`` are its windows'."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    alive, out, steps, j = order[lengths[order] > 0], np.zeros(len(flat), np.uint8), np.zeros(n, np.int64), 0
    at, end = offsets[alive], offsets[alive + 1]
    slot = at.copy()
    while len(alive):
        here = hashes[at]
        out[slot + j] = (here >> np.uint64(24)).astype(np.uint8)
        at = at + stride(here, j)
        j += 1
        inside = at < end
        if not inside.all():
            steps[alive[~inside]] = j
            alive, at, end, slot = alive[inside], at[inside], end[inside], slot[inside]
    return out, np.stack([offsets[:-1], steps], axis=1)


def jump(buckets: np.ndarray) -> np.ndarray:
    """Jump consistent hash: for each number of buckets, SAMPLES bucket numbers."""
    key = mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(SEED))
    key = np.broadcast_to(key, (len(buckets), SAMPLES)).copy()
    most = np.broadcast_to(buckets[:, None], key.shape).astype(np.float64)
    b, j = np.full(key.shape, -1.0), np.zeros(key.shape)
    live = j < most
    while live.any():
        b[live] = j[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = np.floor((b[live] + 1) * (2.0**31 / ((key[live] >> np.uint64(33)).astype(np.float64) + 1)))
        live = j < most
    return b.astype(np.int64)


def fingerprints(texts: list[str], bands: np.ndarray | None = None, tags: np.ndarray | None = None) -> np.ndarray:
    """SAMPLES bytes for each text; all 0 for an empty one. ``bands`` and ``tags`` are filled with what ``anchored`` gives."""
    out = np.zeros((len(texts), SAMPLES), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(lengths, kind="stable")
    for lo, hi in runs(lengths[order], CHUNK_CHARS):
        at = order[lo:hi]
        flat, offsets = codes([texts[i] for i in at.tolist()])
        hashes = window_hashes(flat, offsets)
        if bands is not None:
            bands[at], tags[at] = anchored(offsets, hashes)
        emitted, place = walk(flat, offsets, hashes)
        full = np.flatnonzero(place[:, 1])
        if len(full):
            picks = jump(place[full, 1])
            out[at[full]] = emitted[place[full, :1] + picks]
    return out


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray) -> np.ndarray:
    """Share of equal samples, less what chance gives; two empty texts are alike, an empty one and another not."""
    share = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
    share = np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), share)
    return np.clip(share, 0, 1)


def edited(text: str, after: str) -> str:
    """The text with its last half's code points replaced by as many of the next one's first (or all)."""
    n = len(text) // 2
    return text[: len(text) - n] + after[:n]


def beside_next(docs: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    """part, id, text, extra: documents dealt out by ranges of ids; ``extra`` marks the next range's first document, sent along.

    Range bounds are quantiles of the ids, the first documents of the ranges their largest ids: a few
    numbers for each of the ``parts`` ranges go through the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("k", F.coalesce(F.col("id").cast("long"), F.lit(_NULL)))
    marks = rows.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000).alias("q")).first()["q"] if parts > 1 else []
    bounds = sorted({int(x) for x in marks or []}, reverse=True)
    # ranges go downwards: range 0 has the largest ids, each bound belongs to the range above it
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("k") < b)) if bounds else F.lit(0)
    firsts = {r["part"]: r["first"] for r in rows.select("k", part.alias("part")).groupBy("part").agg(F.max("k").alias("first")).collect()}
    live = sorted(firsts)
    follows = {live[i]: live[i - 1] for i in range(len(live))}  # whose next is range i's first document: the range before, the last one's is range 0's
    lookup = spark.createDataFrame([(int(firsts[p]), int(p), int(follows[p])) for p in live] or [(0, -1, -1)], "first bigint, own int, to int")
    numbered = rows.withColumn("part", part.cast("int"))
    sent = numbered.join(F.broadcast(lookup), (F.col("part") == F.col("own")) & (F.col("k") == F.col("first")), "left")
    spread = sent.withColumn("send", F.when(F.col("to").isNull(), F.array(F.struct(F.col("part"), F.lit(False).alias("extra")))).otherwise(F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.struct(F.col("to").alias("part"), F.lit(True).alias("extra")))))
    return spread.select(F.explode("send").alias("s"), "id", "k", "text").select("s.part", "s.extra", "id", "k", "text")


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id.

    The next document is the one of the next smaller id; the last one's next is the first. Of rows with
    one id the text decides (null first). A null id comes last, a null text is empty. A document alone
    is its own next. ``group_id`` is the smallest id of the texts that are near, also by way of others; an
    empty text is near none. Other columns aren't read; an empty table gives no rows.
    """
    rows = cut(_edit_rows(docs, id_col, text_col, parts))
    least = small(cut(_group_ids(rows, docs, id_col, text_col)), near_dedup.BROADCAST_ROWS)
    out = rows.join(least, "text_md5", "left").withColumn("group_id", F.coalesce("least", F.col(f"`{id_col}`")))
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return out.select(f"`{id_col}`", "n_chars", hexed("edited_sha256"), hexed("fingerprint"), hexed("edited_fingerprint"), "near_edited", "near_next", "group_id")


def _edit_rows(docs: DataFrame, id_col: str, text_col: str, parts: int | None) -> DataFrame:
    """The columns of ``fingerprint_edits`` but the group, hashes as bytes; text_md5 beside them."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = beside_next(docs, id_col, text_col, parts).withColumn("order", -F.greatest(F.col("k"), F.lit(_NULL + 1)))
    dealt = spread.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "extra", "order", "k", "text")
    kind = docs.schema[id_col].dataType
    arrow_id = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        chars = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                waiting.append(row)
                chars += len(row[3] or "")
                if chars > HELD_CHARS and len(waiting) > 1:
                    yield from _compare(waiting, id_col, arrow_id)
                    waiting, chars = waiting[-1:], len(row[3] or "")
        if len(waiting) > 1:
            yield from _compare(waiting, id_col, arrow_id)

    return dealt.select("part", "extra", "id", "text").mapInArrow(tidy(run), f"`{id_col}` {kind.simpleString()}, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text_md5 binary, bands binary, tags binary")


def _compare(rows: list[tuple], id_col: str, arrow_id: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Each row but the last against the one after it, if that is of the same part; rows sent along only serve as next."""
    texts = [r[3] or "" for r in rows]
    own = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
    if not own:
        return
    changed = [edited(texts[i], texts[i + 1]) for i in own]
    bands, tags = np.zeros((len(texts), BINS * len(STEPS)), np.uint16), np.zeros((len(texts), BINS), np.uint8)
    plain, other = fingerprints(texts, bands, tags), fingerprints(changed)
    empty = np.array([not t for t in texts])
    own = np.array(own)
    near_edited = likeness(plain[own], other, empty[own], np.array([not t for t in changed]))
    near_next = likeness(plain[own], plain[own + 1], empty[own], empty[own + 1])
    columns = [
        pa.array([rows[i][2] for i in own], arrow_id),
        pa.array([len(texts[i]) for i in own], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest() for t in changed], pa.binary()),
        pa.array([plain[i].tobytes() for i in own], pa.binary()),
        pa.array([x.tobytes() for x in other], pa.binary()),
        pa.array(near_edited),
        pa.array(near_next),
        pa.array([hashlib.md5(texts[i].encode("utf-8", "surrogatepass")).digest() for i in own], pa.binary()),
        pa.array([bands[i].tobytes() for i in own], pa.binary()),
        pa.array([tags[i].tobytes() for i in own], pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "text_md5", "bands", "tags"])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, fingerprint (hex)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            prints = [x.tobytes().hex() for x in fingerprints(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], names=[id_col, "n_chars", "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_chars long, fingerprint string")


def _prints_alike(least: float):
    def alike_in(group: pa.Table):
        """Likeness of fingerprints of at least ``least``; column regs."""
        regs = np.frombuffer(b"".join(group.column(0).to_pylist()), np.uint8).reshape(-1, SAMPLES)
        full = np.zeros(1, bool)
        return lambda i, lo=0, hi=None: likeness(regs[lo:hi], regs[i], full, full) >= least

    return alike_in


def loose_links(classes: DataFrame, least: float = LOOSE) -> DataFrame:
    """(u, v) of classes (fp long, regs binary) that share a band, spanning the buckets' parts of likeness ``least``."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES // BAND - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * BAND + 1, F.lit(BAND))))
    bands = classes.select("fp", F.explode(keys).alias("key"))
    shared = small(cut(bands.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").drop("size")), near_dedup.BROADCAST_ROWS)
    rows = bands.join(shared, "key").join(classes, "fp").select("key", "fp", "regs")
    return near_dedup.spanning_links(rows, F.lit(1), near_dedup.BUCKET_BLOCK, _prints_alike(least))


def _anchors_alike(group: pa.Table):
    """Whether enough anchors are in common; column tags. Bins lie along the first axis, so that sums over them go row by row."""
    rows = np.frombuffer(b"".join(group.column(0).to_pylist()), np.uint8).reshape(-1, BINS)
    tags, some = np.ascontiguousarray(rows.T), np.packbits(rows > 0, axis=1).view(np.uint32)[:, 0]
    if len(rows) <= FEW:
        common = ((rows[:, None] == rows) & (rows > 0)).sum(axis=2, dtype=np.uint8)
        known = common >= LOOSE_ANCHORS * np.bitwise_count(some[:, None] | some)
        return lambda i, lo=0, hi=None: known[i, lo:hi]

    def alike(i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        own = tags[:, i]
        bins = tags[:, lo:hi] if own.all() else tags[own > 0, lo:hi]
        common = (bins == own[own > 0][:, None]).sum(axis=0, dtype=np.uint8)
        return common >= LOOSE_ANCHORS * np.bitwise_count(some[lo:hi] | some[i])

    return alike


def anchored_links(classes: DataFrame) -> DataFrame:
    """(u, v) of classes (fp long, bands, tags) that share an anchor's band, spanning the buckets' parts of texts with enough common anchors.

    Copies meet in many buckets. Of buckets that hold the same classes one is looked at: they are told by their size and two hashes of all members.
    """
    width = 2 * len(STEPS)
    each = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.struct(i.alias("i"), F.substring("bands", i * width + 1, F.lit(width)).alias("x")))
    full = F.filter(each, lambda e: e["x"] != F.lit(bytes(width)))
    keys = classes.select("fp", F.explode(F.transform(full, lambda e: F.xxhash64(e["i"], e["x"]))).alias("key"))
    members = [F.bit_xor(F.xxhash64(F.lit(i), "fp")).alias(f"m{i}") for i in range(2)]
    buckets = keys.groupBy("key").agg(F.count("*").alias("size"), *members).filter("size > 1")
    shared = small(cut(buckets.groupBy("size", "m0", "m1").agg(F.min("key").alias("key")).select("key")), near_dedup.BROADCAST_ROWS)
    rows = keys.join(shared, "key").join(classes.select("fp", "tags"), "fp").select("key", "fp", "tags")
    return near_dedup.spanning_links(rows, F.lit(1), near_dedup.BUCKET_BLOCK, _anchors_alike, wider=8)


def window_set(text: str) -> np.ndarray:
    """Sorted hashes of the text's distinct windows of Q characters; a shorter text is one window."""
    flat, offsets = codes([text])
    own = np.sort(window_hashes(flat, offsets)[: max(len(text) - Q + 1, 1)])
    return own[np.concatenate([[True], own[1:] != own[:-1]])]


def _texts_alike(percent: int):
    exact = near_dedup.exact_alike(percent)

    def alike_in(group: pa.Table):
        """Likeness of texts by their windows; column text."""
        return exact(pa.table({"set": pa.array([window_set(t).tobytes() for t in group.column(0).to_pylist()], pa.large_binary())}))

    return alike_in


def _group_ids(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """(text_md5, least) of texts that others are near or equal to; ``rows`` are of ``_edit_rows``."""
    own = rows.filter("n_chars > 0").select(F.col(id_col).alias("id"), "text_md5", "n_chars", "bands", "tags", F.xxhash64("bands", "tags").alias("node"))
    texts = cut(own.groupBy("text_md5").agg(F.min("id").alias("id"), F.count("*").alias("docs"), F.max("n_chars").alias("n"), F.max("node").alias("node")))
    classes = cut(own.groupBy("node").agg(F.max("bands").alias("bands"), F.max("tags").alias("tags")).withColumnRenamed("node", "fp"))
    loose = components(anchored_links(classes).select("u", "v"))
    labelled = texts.join(loose, "node", "left").withColumn("cluster", F.xxhash64(F.coalesce("component", "node"))).drop("component", "node")
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("members")).filter("members > 1").drop("members")
    wanted = small(cut(labelled.join(sizes, "cluster").select("cluster", F.col("text_md5").alias("fp"), F.col("id").alias("one"))), near_dedup.BROADCAST_ROWS)
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("md5"))
    found = named.join(wanted, F.col("id").eqNullSafe(F.col("one")) & (F.col("md5") == F.col("fp"))).select(F.col("cluster").alias("key"), "fp", "text").dropDuplicates(["key", "fp"])
    linked = components(near_dedup.spanning_links(cut(found), F.length("text"), CLUSTER_BLOCK, _texts_alike(percent), wider=2))
    whole = cut(texts.join(linked.select(F.col("node").alias("text_md5"), "component"), "text_md5", "left").withColumn("label", F.coalesce("component", "text_md5")))
    least = whole.groupBy("label").agg(F.min("id").alias("least"), F.sum("docs").alias("size")).filter("size > 1").drop("size")
    return whole.join(least, "label").select("text_md5", "least")


def near_representatives(prints: DataFrame, id_col: str = "doc_id", least: float = LOOSE) -> DataFrame:
    """Links (id, representative, likeness) that span the parts of like fingerprints; texts aren't read.

    Equal fingerprints are one class with its smallest id as member of the search. A class is linked with
    one or more others, found in its bands' buckets. A part is held together by links of ``least`` or more; the
    likeness of a given link may be less where others lie between. Empty texts aren't linked, nor are null ids.
    """
    named = prints.filter(f"n_chars > 0 and `{id_col}` is not null").select(F.col(id_col).alias("id"), "fingerprint")
    classes = cut(named.groupBy("fingerprint").agg(F.min("id").alias("rep")).withColumn("fp", F.xxhash64("fingerprint")))
    found = loose_links(classes.select("fp", F.unhex("fingerprint").alias("regs")), least).distinct()
    side = lambda s: classes.select(F.col("fp").alias(s), F.col("rep").alias(f"{s}_rep"), F.unhex("fingerprint").alias(f"{s}_regs"))
    pairs = found.join(side("u"), "u").join(side("v"), "v").select(F.greatest("u_rep", "v_rep").alias("id"), F.least("u_rep", "v_rep").alias("representative"), "u_regs", "v_regs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SAMPLES) for i in (2, 3))
            full = np.zeros(1, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(likeness(a, b, full, full))], names=["id", "representative", "likeness"])

    kind = prints.schema[id_col].dataType.simpleString()
    members = named.join(classes, "fingerprint").filter("id <> rep").select("id", F.col("rep").alias("representative"), F.lit(1.0).alias("likeness"))
    return members.union(pairs.mapInArrow(tidy(compare), f"id {kind}, representative {kind}, likeness double"))
