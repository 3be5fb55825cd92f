"""Token counts: a separator scan over flat token files that have no index.

A token file is a run of 16-bit ids cut into blocks of fixed size; each document ends with the
end-of-document id, and nothing says where. Each block is searched by numpy on its own: where the
separators stand, and so how many tokens lie before the first, between two, and after the last. A
prefix scan over the blocks of a file (a few numbers a block) then says how many documents ended
before a block and how many tokens the document that crosses its start has had so far; this
stitches the counts. Files of any size are scanned by as many tasks as they have blocks.

Blocks are rows (file, block, tokens), written by Spark to wherever the caller says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import runs, tidy
from meterlake.llm.bpe import encoder, pack_tokenizer

BLOCK_TOKENS = 1 << 16
BLOCK_KIND = np.dtype("<u2")
#: Texts are encoded in groups of about so many characters.
GROUP_CHARS = 1 << 20
#: The separator; texts are encoded without it, as the vocabulary's added token stands for it alone.
END_OF_DOCUMENT = 50256


def write_blocks(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, separator: int = END_OF_DOCUMENT) -> None:
    """Encode ``docs`` into token files at ``path``: one file for each task, its blocks as rows of kind ``block``.

    A separator's name inside a text is written as ordinary bytes, so that each document gives exactly one
    separator and keeps all its tokens. Rows of kind ``order`` say which document is the n-th of a file; the scan
    doesn't read them. A null or empty text is a separator alone, null and repeated ids are documents of their
    own, an empty table gives no blocks; other columns aren't read. A vocabulary that needs over 16 bits
    is an error.
    """
    packed = pack_tokenizer(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, file = encoder(packed), TaskContext.get().partitionId()
        if bpe.kind != BLOCK_KIND:
            raise ValueError("the vocabulary's ids need over 16 bits")
        mark = np.array([separator], BLOCK_KIND)
        held, size, block, ordinal = [], 0, 0, 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield _rows("order", file, [ordinal + i for i in range(len(ids))], ids, [None] * len(ids))
            ordinal += len(ids)
            for lo, hi in runs(np.array([len(t) for t in texts], np.int64), GROUP_CHARS):
                for tokens in bpe.encode(texts[lo:hi], added=False):
                    held += [tokens, mark]
                    size += len(tokens) + 1
                if size >= block_tokens:
                    flat = np.concatenate(held)
                    full = len(flat) // block_tokens
                    yield _rows("block", file, list(range(block, block + full)), [None] * full, [flat[k * block_tokens : (k + 1) * block_tokens].tobytes() for k in range(full)])
                    block += full
                    held = [flat[full * block_tokens :]]
                    size = len(held[0])
        bpe.forget()
        if size:
            yield _rows("block", file, [block], [None], [np.concatenate(held).tobytes()])

    docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(tidy(write), "kind string, file int, n long, id long, tokens binary").write.partitionBy("kind").parquet(path)


def _rows(kind: str, file: int, n: list, ids: list, tokens: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.string()), pa.array([file] * len(n), pa.int32()), pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(tokens, pa.binary())], names=["kind", "file", "n", "id", "tokens"])


def scan_block(tokens: bytes, separator: int) -> tuple[int, int, int, list[int]]:
    """Tokens before the first separator (all, without one), tokens after the last, separators, and the counts between."""
    flat = np.frombuffer(tokens, BLOCK_KIND)
    at = np.flatnonzero(flat == separator)
    if not len(at):
        return len(flat), 0, 0, []
    return int(at[0]), len(flat) - 1 - int(at[-1]), len(at), (np.diff(at) - 1).tolist()


def count_tokens(blocks: DataFrame, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """Per document of ``blocks`` (file, n, tokens): file, ordinal in the file, n_tokens without the separator.

    Blocks of a file follow each other by n. Tokens after a file's last separator are a document
    without an end and aren't counted; an empty block adds nothing; no blocks give no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_block(t or b"", separator) for t in batch.column(2).to_pylist()]
            head, tail, ends, inner = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(head, pa.int64()), pa.array(tail, pa.int64()), pa.array(ends, pa.int64()), pa.array(inner, pa.list_(pa.int32()))], names=["file", "n", "head", "tail", "ends", "inner"])

    parts = blocks.select("file", "n", "tokens").mapInArrow(tidy(scan), "file int, n long, head long, tail long, ends long, inner array<int>")
    order = Window.partitionBy("file").orderBy("n")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # tokens so far without regard to separators, and the sum at the last separator: their difference is carried over
    sums = parts.withColumns({"ended": F.coalesce(F.sum("ends").over(before), F.lit(0)), "open": F.coalesce(F.sum(F.when(F.col("ends") == 0, F.col("head")).otherwise(0)).over(before), F.lit(0))})
    last = F.max(F.when(F.col("ends") > 0, F.struct("n", "tail", "open"))).over(before)
    carried = sums.withColumn("last", last).withColumn("carry", F.col("open") - F.coalesce("last.open", F.lit(0)) + F.coalesce("last.tail", F.lit(0)))
    whole = F.concat(F.array((F.col("carry") + F.col("head")).cast("long")), F.col("inner").cast("array<bigint>"))
    out = carried.filter("ends > 0").select("file", "ended", F.posexplode(whole).alias("at", "n_tokens"))
    return out.select("file", (F.col("ended") + F.col("at")).alias("ordinal"), "n_tokens")


def count_documents(blocks_path: str, spark) -> DataFrame:
    """id and n_tokens of each document of files that ``write_blocks`` wrote: a row for each row written, so repeated and null ids have theirs; none without files."""
    files = spark.read.schema("file int, n long, id long, tokens binary, kind string").parquet(blocks_path)
    counts = count_tokens(files.filter("kind = 'block'"))
    order = files.filter("kind = 'order'").select("file", F.col("n").alias("ordinal"), "id")
    return order.join(counts, ["file", "ordinal"]).select("id", "n_tokens")
