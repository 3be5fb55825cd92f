"""Helpers that the operators share: lineage cuts, size-checked broadcasts, bounded text chunks."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.sources.bronze import keep as cut, remove, shared_dir  # noqa: F401

#: What stands for a null id where rows are ordered or joined by id: it sorts after every other id.
NULL_ID = (1 << 63) - 1
#: ASCII white space, as the contracts' word pattern ``[^\x20\x09-\x0D]+`` has it; Java's ``\s`` is the same class.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_TABLE = str.maketrans(UPPER, LOWER)


def tidy(handle: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that returns freed memory to the system at its end: idle workers share their executor's memory."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from handle(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return run


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``max_rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def boxed(docs: DataFrame, *bare: str) -> DataFrame:
    """The columns ``bare``, and all others inside one struct ``doc``, so that no name of theirs clashes with a working column."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in bare]
    return docs.select(F.struct(*(rest or [F.lit(True).alias("none")])).alias("doc"), *[F.col(f"`{c}`") for c in bare])


def unboxed(rows: DataFrame, columns: list[str], *bare: str) -> DataFrame:
    """``columns`` in their order: those in ``bare`` as they stand in ``rows``, the others from ``doc``."""
    return rows.select(*[F.col(f"`{c}`") if c in bare else F.col(f"doc.`{c}`").alias(c) for c in columns])


def held_out(doc_id: str | Column) -> Column:
    """Whether crc32(id as text) mod 5 is 0; a null id is never held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def uniform(*cols: Column) -> Column:
    """A repeatable number from 0 to 1 (1 excluded) for the values of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def lower_ascii(text: str) -> str:
    return text.translate(LOWER_TABLE) if not text.isascii() else text.lower()


def runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose lengths sum to about ``most``; an item is never split."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def text_runs(texts: pa.Array, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """A batch's texts in groups of about ``most`` bytes, with each group's first row: only one group is held as Python texts."""
    for lo, hi in runs(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), most):
        yield lo, texts.slice(lo, hi - lo).to_pylist()


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and the offset of each text (one more than texts)."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums along axis 0 of ``values`` between neighbouring offsets; an empty segment sums to 0."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble (uint64)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))
