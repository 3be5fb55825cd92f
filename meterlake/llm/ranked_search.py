"""Ranked lexical search: compressed postings by shard, merged document at a time.

1. ``build_index``: each task cuts its rows into shards of bounded size, sorts a shard's documents by id and writes
   a row for each term: the gaps and counts of its postings as variable-length integers. Nothing is
   shuffled: a shard belongs to the task that read it.
2. ``search``: postings of the queries' terms are picked by a join, corpus-wide counts are summed from them,
   and each pair of a shard and a block of queries is one small task. A heap holds the next document of each list; documents
   are finished in order of their ids, and a bounded heap keeps a query's best by score, then id.
   Lists whose largest scores together can't reach the worst of a full heap leave the merge and are only looked up (MaxScore),
   which loses nothing.
3. The shards' best are merged by a window whose limit Spark applies in each task before the shuffle.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from meterlake.llm.common import LOWER, NULL_ID, UPPER, cut, small, tidy
from meterlake.llm.near_dedup import _groups, _streamed

#: A shard ends at so many characters or documents, whichever comes first; a longer text is a shard of its own.
SHARD_CHARS, SHARD_DOCS = 8_000_000, 60_000
#: Queries whose merges run in one task over a shard.
QUERY_BLOCK = 256
#: Terms or blocks up to so many rows are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 500_000
#: Every ASCII character but letters and digits becomes a space, A-Z becomes a-z; other bytes belong to terms.
_TERMS = bytes(ord(" ") if c < 128 and not chr(c).isalnum() else c for c in range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all other characters above ASCII, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def pack(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Non-negative integers as little-endian base-128 bytes, cut behind the positions ``ends``."""
    widths = np.ones(len(values), np.int64)
    rest = values >> 7
    while rest.any():
        widths += rest > 0
        rest >>= 7
    stops = np.cumsum(widths)
    out = np.zeros(int(stops[-1]) if len(stops) else 0, np.uint8)
    for j in range(int(widths.max(initial=0))):
        at = np.flatnonzero(widths > j)
        out[stops[at] - widths[at] + j] = ((values[at] >> (7 * j)) & 127) | np.where(widths[at] > j + 1, 128, 0)
    flat, bounds = out.tobytes(), [0, *stops[ends - 1].tolist()]
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def unpack(data: bytes) -> np.ndarray:
    """The integers of ``pack``."""
    raw = np.frombuffer(data, np.uint8)
    if (raw < 128).all():
        return raw.astype(np.int64)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    power = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * power), starts)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (shard, term, df, total, data): a term's postings in a shard; one row of a null term has the shard's ids and lengths.

    A shard's documents are those with a term, in order of their ids. A null text has no term and isn't indexed; rows that repeat an
    id are documents of their own; a null id sorts last. Other columns aren't read; an empty table gives no rows.
    """
    schema = "shard long, term binary, df long, total long, data binary"

    def shard_rows(number: int, ids: list[int], counts: list[int], terms: dict[bytes, int], found: list[int], uses: list[int], kinds: list[int]) -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        docs_of = np.repeat(place, kinds)
        by_term = np.lexsort((docs_of, found))
        term, doc, use = np.array(found, np.int64)[by_term], docs_of[by_term], np.array(uses, np.int64)[by_term]
        first = np.concatenate([[True], term[1:] != term[:-1]])
        gaps = np.where(first, doc, doc - np.concatenate([[0], doc[:-1]]))
        ends = np.append(np.flatnonzero(first)[1:], len(term))
        data = pack(np.stack([gaps, use], axis=1).ravel(), 2 * ends)
        lengths = np.array(counts, np.int64)[order]
        facts = np.array(ids, np.int64)[order].astype("<i8").tobytes() + lengths.astype("<i8").tobytes()
        df = np.diff(np.concatenate([[0], ends]))
        columns = [[None, *terms], [len(ids), *df.tolist()], [int(lengths.sum()), *[0] * len(df)], [facts, *data]]
        for lo in range(0, len(columns[0]), 10_000):
            part = [c[lo : lo + 10_000] for c in columns]
            kinds_of = (pa.binary(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array([number] * len(part[0]), pa.int64()), *[pa.array(c, k) for c, k in zip(part, kinds_of, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "term", "df", "total", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32

        def fresh() -> tuple:
            terms: defaultdict[bytes, int] = defaultdict()
            terms.default_factory = terms.__len__
            return [], [], terms, [], [], []

        held, chars = fresh(), 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                words = terms_of(text)
                if not words:
                    continue
                if held[0] and (chars + len(text) > SHARD_CHARS or len(held[0]) >= SHARD_DOCS):
                    yield from shard_rows(number, *held)
                    held, chars, number = fresh(), 0, number + 1
                ids, counts, terms, found, uses, kinds = held
                uses_of = Counter(words)
                ids.append(NULL_ID if i is None else i)
                counts.append(len(words))
                found.extend(map(terms.__getitem__, uses_of))
                uses.extend(uses_of.values())
                kinds.append(len(uses_of))
                chars += len(text)
        if held[0]:
            yield from shard_rows(number, *held)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")).mapInArrow(tidy(run), schema)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (item, row, term): each query's distinct terms; ``row`` is a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms_of(t))) for t in batch.column(2).to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array([t for x in own for t in x], pa.binary())], names=["item", "row", "term"])

    named = queries.select(F.col(f"`{id_col}`").cast("long").alias("item"), F.xxhash64(F.col(f"`{text_col}`")).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return named.distinct().mapInArrow(tidy(run), "item long, row long, term binary")


def best_of(lists: list[tuple[list[int], list[int], int]], k: int) -> list[tuple[int, int]]:
    """The k best (score, document) of posting lists (documents ascending, their scores, the largest score); ties to smaller documents.

    Lists are merged by a heap of their next documents. Once k documents are held, lists whose largest scores sum to no
    more than the worst held score can't bring in a document alone: they leave the merge and are looked up.
    """
    lists = sorted((x for x in lists if x[2] > 0), key=lambda x: x[2])
    reach, total = [], 0
    for x in lists:
        total += x[2]
        reach.append(total)  # of this list and all below it
    n, looked = len(lists), 0
    heap = [(x[0][0] * n + j) for j, x in enumerate(lists)]
    heapq.heapify(heap)
    at = [0] * n
    best: list[tuple[int, int]] = []
    worst = 0
    while heap:
        doc = heap[0] // n
        score, alone = 0, False
        while heap and heap[0] // n == doc:
            j = heap[0] - doc * n
            docs, scores, _ = lists[j]
            p = at[j]
            if j >= looked:
                score, alone = score + scores[p], True
                at[j] = p = p + 1
                if p < len(docs):
                    heapq.heapreplace(heap, docs[p] * n + j)
                    continue
            heapq.heappop(heap)  # a list at its end, or one that is only looked up by now
        if not alone:
            continue
        for j in range(looked - 1, -1, -1):
            if score + reach[j] <= worst:
                break
            docs, scores, _ = lists[j]
            p = at[j] = bisect_left(docs, doc, at[j])
            if p < len(docs) and docs[p] == doc:
                score += scores[p]
        if score > worst:
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            else:
                heapq.heapreplace(best, (score, -doc))
            if len(best) == k:
                worst = best[0][0]
                while looked < n and reach[looked] <= worst:
                    looked += 1
    return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def search(index: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Rows (item, row, rank, doc, score): each query's k best documents by score, equal scores by ascending id.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document of n terms has m = 10 + 90nN div L and scores the sum of
    weight * (10^9 tf div (1000 tf + 8m)) over the query's distinct terms. Queries of equal id and text are one; queries that share an
    id with other texts are ranked apart by ``row``. Queries without terms, and documents with a score of 0, give no rows;
    so do empty tables. Ranks run from 1; rows of one document id and equal score rank in no stated order.
    """
    spark = index.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = cut(query_terms(queries, id_col, text_col))
    blocks = max(1, -(-asked.select("item", "row").distinct().count() // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("item", "row"), F.lit(blocks))
    by_block = asked.groupBy(block.alias("block"), "term").agg(F.sort_array(F.collect_set(F.struct("item", "row"))).alias("items"))
    hits = cut(index.filter("term is not null").join(small(asked.select("term").distinct(), BROADCAST_ROWS), "term").select("shard", "term", "df", "data"))
    facts = index.filter("term is null")
    documents, length = facts.agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()

    weight = F.floor(1000 * F.log(F.lit(2 * documents + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = hits.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight")).filter("weight > 0")
    wanted = small(cut(by_block.join(weights, "term")), BROADCAST_ROWS)
    each_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    rows = facts.select("shard", each_block.alias("block"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast(wanted.schema["items"].dataType).alias("items"), "data")
    rows = rows.unionByName(hits.join(wanted, "term").select("shard", "block", "weight", "items", "data"))

    def merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole pairs of shard and block; the first row of each has the shard's ids and lengths."""
        bounds, out = _groups(table, 2), []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            facts_of = np.frombuffer(table.column(4)[lo].as_py(), "<i8")
            ids, counts = facts_of[: len(facts_of) // 2], facts_of[len(facts_of) // 2 :]
            shift = 8 * np.array([10 + 90 * c * documents // length for c in counts.tolist()], np.int64)
            lists = defaultdict(list)
            weights_of, items_of, data_of = (table.column(j).slice(lo + 1, hi - lo - 1).to_pylist() for j in (2, 3, 4))
            for w, items, data in zip(weights_of, items_of, data_of, strict=True):
                gaps, uses = unpack(data).reshape(-1, 2).T
                docs = np.cumsum(gaps)
                scores = w * (1_000_000_000 * uses // (1000 * uses + shift[docs]))
                entry = (docs.tolist(), scores.tolist(), int(scores.max()))
                for x in items:
                    lists[x["item"], x["row"]].append(entry)
            for (item, row), own in lists.items():
                out += [(item, row, int(ids[d]), s) for s, d in best_of(own, k)]
        columns = [list(c) for c in zip(*out, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "row", "doc", "score"])

    dealt = rows.repartition(n, "shard", "block").sortWithinPartitions("shard", "block", F.col("weight").isNotNull(), F.desc("weight"))
    found = dealt.select("shard", "block", "weight", "items", "data").mapInArrow(tidy(_streamed(2, merged)), "item long, row long, doc long, score long")
    rank = F.row_number().over(Window.partitionBy("item", "row").orderBy(F.desc("score"), "doc"))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select("item", "row", "rank", F.nullif("doc", F.lit(NULL_ID).cast(LongType())).alias("doc"), "score")
