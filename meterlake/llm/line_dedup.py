"""Line dedup: range-partitioned line hashes, streamed in order; the result is a keep bitmap for each document.

A line's key is hashed to 128 bits. The hashes are dealt out by ranges of (hash, document, position),
so that even a line of a third of all documents spreads over many tasks, and each task streams its
sorted range, keeping only the current key's first document. Only the first key of a range can have
begun in an earlier one: for those, and for each range's last key, a summary row goes into a small
table (two rows a partition at most) that settles the few lines left open.

No text is shuffled to find the lines. Documents that lose lines get a compressed bitmap.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType

from meterlake.llm.common import LOWER, NULL_ID, SPACES, UPPER, boxed, cut, tidy, unboxed

MIN_CODE_POINTS = 10
#: Bitmaps of up to so many bytes together are broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_SPACES = SPACES.encode()


def _line_keys(text: str | None, least: int) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the positions of each key of at least ``least`` code points, by 128-bit hash."""
    lines = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split(b"\n")
    found: dict[bytes, list[int]] = {}
    for at, line in enumerate(lines):
        key = line.strip(_SPACES)
        if len(key) >= 4 * least or (len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least):
            found.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(at)
    return len(lines), found


def _hashed_lines(least: int):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, doc, row, count, at = bytearray(), [], [], [], []
            for d, r, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, keys = _line_keys(text.as_py(), least)
                for digest, places in keys.items():
                    digests += digest
                    doc.append(d)
                    row.append(r)
                    count.append(n)
                    at.append(places)
            halves = np.frombuffer(bytes(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(count, pa.int32()), pa.array(at, pa.list_(pa.int32()))], names=["hi", "lo", "doc", "row", "n", "at"])

    return hashed


#: What a row of the streamed result means.
DROPPED, OPEN, SUMMARY = 0, 1, 2


def _first_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one sorted range: lines surely dropped, lines left open (of the range's first key), summaries."""
    leading = current = None  # (hi, lo); current also has its first document here
    first = 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        hi, lo, doc = (batch.column(i).to_numpy() for i in range(3))
        new = np.ones(n, bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        if current == (hi[0], lo[0]):
            new[0] = False
        begins = np.flatnonzero(new)
        firsts = np.concatenate([[first], doc[begins]])[np.cumsum(new)]
        if leading is None:
            leading = (hi[0], lo[0])
            yield _row(batch, np.array([0]), SUMMARY)
        lost = np.flatnonzero(doc != firsts)
        if len(lost):
            yield _row(batch, lost, DROPPED)
        unsure = np.flatnonzero((doc == firsts) & (hi == leading[0]) & (lo == leading[1]))
        if len(unsure):
            yield _row(batch, unsure, OPEN)
        current, first = (hi[-1], lo[-1]), firsts[-1]
    if current is not None and current != leading:
        none = pa.array([0], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([SUMMARY], pa.int32()), *(pa.array([x], pa.int64()) for x in (*current, first)), none, pa.array([0], pa.int32()), pa.array([None], pa.list_(pa.int32()))], names=["kind", "hi", "lo", "doc", "row", "n", "at"])


def _row(batch: pa.RecordBatch, at: np.ndarray, kind: int) -> pa.RecordBatch:
    part = batch.take(pa.array(at))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *part.columns], names=["kind", *part.schema.names])


@arrow_udf(BinaryType())
def pack_bitmap(dropped: pa.Array, n_lines: pa.Array) -> pa.Array:
    """zlib of the packed bits, one a line, 1: keep."""

    def pack(places: pa.ListScalar, n: int) -> bytes:
        keep = np.ones(n, bool)
        keep[places.values.flatten().to_numpy()] = False
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return pa.array([pack(p, n) for p, n in zip(dropped, n_lines.to_pylist(), strict=True)], pa.binary())


def unpack_bitmap(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n).astype(bool)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc and row: the id (a null one after all others) and a hash of the text, which tells rows of one id apart."""
    return docs.withColumns({"_ld_doc": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_ld_row": F.xxhash64(F.col(text_col))})


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """Per document that loses lines: doc, row (see ``keyed``), n_lines, bitmap of the lines to keep.

    A text is split at newlines (a null or empty one has one empty line). A line's key is the line
    without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_code_points``
    keep their lines in the smallest id that holds them, all of them there, and lose them in others.
    Documents without a row in the result keep all lines. A null id comes after all other ids; rows
    that repeat an id are one document. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    lines = cut(rows.select("_ld_doc", "_ld_row", "text").mapInArrow(tidy(_hashed_lines(min_code_points)), "hi long, lo long, doc long, row long, n int, at array<int>"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = lines.repartitionByRange(n, "hi", "lo", "doc", "row", "at").sortWithinPartitions("hi", "lo", "doc", "row", "at")
    found = cut(ranged.mapInArrow(tidy(_first_documents), "kind int, hi long, lo long, doc long, row long, n int, at array<int>"))
    firsts = found.filter(F.col("kind") == SUMMARY).groupBy("hi", "lo").agg(F.min("doc").alias("first"))  # two rows a partition at most
    opened = found.filter(F.col("kind") == OPEN).join(F.broadcast(firsts), ["hi", "lo"]).filter("doc > first")
    lost = found.filter(F.col("kind") == DROPPED).select("doc", "row", "n", "at").union(opened.select("doc", "row", "n", "at"))
    grouped = lost.groupBy("doc", "row").agg(F.collect_set("at").alias("lost"), F.max("n").alias("n_lines"))  # bounded by the document's lines
    return grouped.select("doc", "row", "n_lines", pack_bitmap("lost", "n_lines").alias("bitmap"))


def _kept_text(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """The kept lines, joined; numbers of lines and of dropped ones."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines), 0
    keep = unpack_bitmap(bitmap, len(lines))
    return "\n".join([x for x, k in zip(lines, keep, strict=True) if k]), len(lines), int(len(lines) - keep.sum())


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its bitmap or null as ``_ld_bitmap``; bitmaps are broadcast if their bytes are few, else both sides shuffle."""
    bitmaps = cut(bitmaps)
    n_bytes = bitmaps.agg(F.sum(F.length("bitmap") + 24)).first()[0] or 0
    side = bitmaps.select(F.col("doc").alias("_ld_doc"), F.col("row").alias("_ld_row"), F.col("bitmap").alias("_ld_bitmap"))
    side = F.broadcast(side) if n_bytes <= BROADCAST_BYTES else side
    return keyed(docs, id_col, text_col).join(side, ["_ld_doc", "_ld_row"], "left").drop("_ld_doc", "_ld_row")


def digest_kept(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_lines, n_dropped, kept_sha256 of the kept lines joined by newlines."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, sha = [], [], []
            for text, bitmap in zip(batch.column(1), batch.column(2), strict=True):
                kept, n, dropped = _kept_text(text.as_py(), bitmap.as_py())
                n_lines.append(n)
                n_dropped.append(dropped)
                sha.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], names=[id_col, "n_lines", "n_dropped", "kept_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = with_bitmaps(docs.select(id_col, text_col), bitmaps, id_col, text_col).select(id_col, text_col, "_ld_bitmap")
    return rows.mapInArrow(tidy(digest), f"`{id_col}` {kind}, n_lines long, n_dropped long, kept_sha256 string")


@arrow_udf(StringType())
def _apply_bitmap(text: pa.Array, bitmap: pa.Array) -> pa.Array:
    """The kept lines of texts that have a bitmap, else null."""
    return pa.array([_kept_text(t.as_py(), b.as_py())[0] if b.is_valid else None for t, b in zip(text, bitmap, strict=True)], pa.string())


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text without the lines that its bitmap drops (a null text stays null)."""
    out = with_bitmaps(boxed(docs, id_col, text_col), bitmaps, id_col, text_col)
    cut_text = _apply_bitmap(F.when(F.col("_ld_bitmap").isNotNull(), F.col(text_col)), "_ld_bitmap")  # only texts that lose lines go to Python
    return unboxed(out.withColumn(text_col, F.coalesce(cut_text, F.col(text_col))), docs.columns, id_col, text_col)
