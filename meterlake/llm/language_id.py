"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed by Spark over a bounded sample of labelled documents; the
log-probability matrix (buckets x languages) is broadcast. It holds only cells whose count isn't 0, as what they are above
the language's value for all others, so it grows with what was counted and not with languages times buckets. Numpy
scores whole texts: a text is a sparse vector of its buckets' counts, which is multiplied by the sparse matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlake.llm.common import codes, held_out, runs, small, text_runs, tidy, uniform

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
#: Fit on about so many documents of each language at most, by a hash of their ids.
FIT_PER_LANGUAGE = 800
SMOOTHING = 0.5
UNKNOWN = "und"
#: Texts are scored in groups of about so many characters.
CHUNK_CHARS = 300_000
#: A task of the fit hands on its counts when it has so many cells.
HELD_CELLS = 1 << 22
#: Up to so many languages their rates are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1 << 13


@dataclass
class LanguageModel:
    languages: list[str]
    base: np.ndarray  # for each language the log-probability of a bucket that it was never seen with
    starts: np.ndarray  # for each bucket where its cells begin, and the end of all
    language: np.ndarray  # of each cell
    gain: np.ndarray  # of each cell: its log-probability above the base

    @classmethod
    def from_counts(cls, languages: list[str], cells: np.ndarray, counts: np.ndarray) -> LanguageModel:
        """``cells`` are bucket times languages plus language, each once, with their ``counts`` above 0."""
        order = np.argsort(cells)
        bucket, language = np.divmod(cells[order], max(1, len(languages)))
        n = counts[order].astype(np.float64)
        total = np.bincount(language, n, len(languages)) + SMOOTHING * (1 << BUCKET_BITS)
        starts = np.searchsorted(bucket, np.arange((1 << BUCKET_BITS) + 1))
        return cls(languages, np.log(SMOOTHING / total), starts, language.astype(np.int32), np.log1p(n / SMOOTHING).astype(np.float32))

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Log-likelihoods of a text with these counts of all buckets."""
        at = np.flatnonzero(counts)
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        cells = np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(lengths.sum())
        return self.base * counts.sum() + np.bincount(self.language[cells], self.gain[cells] * np.repeat(counts[at], lengths), len(self.languages))


def ngram_buckets(flat: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that begins at each character (those that cross a text's end included)."""
    n = len(flat) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[k : k + n].astype(np.uint64)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _lowered(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, a space before and after each, and their offsets."""
    return codes([f" {t.lower()} " for t in texts])


def text_buckets(texts: list[str]) -> Iterator[np.ndarray]:
    """For each text, the bucket of each of its n-grams; n-grams across two texts don't count."""
    flat, offsets = _lowered(texts)
    buckets = [ngram_buckets(flat, order) for order in ORDERS]
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield np.concatenate([b[lo : max(hi - order + 1, lo)] for order, b in zip(ORDERS, buckets, strict=True)])


def score_texts(texts: list[str], model: LanguageModel) -> Iterator[np.ndarray]:
    """Log-likelihoods of each text."""
    for own in text_buckets(texts):
        yield model.score(np.bincount(own, minlength=1 << BUCKET_BITS))


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:200])) or any(map(str.isalpha, text[200:]))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = FIT_PER_LANGUAGE) -> LanguageModel:
    """A model of the languages of ``docs``: rows with a text and a language.

    The sample takes each row by a hash of its id, at a rate that leaves about ``per_language`` rows of
    each language; a language of fewer rows gives all. Whole texts count, repeated rows as often as they stand;
    how rows lie makes no difference. Any number of languages is learned; the driver sees a row for each and the cells
    of the matrix. No rows give a model without languages.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang is not null and text is not null")
    sizes = sorted(map(tuple, known.groupBy("lang").count().collect()))
    languages = [lang for lang, _ in sizes]
    n = len(languages)
    if not languages:
        return LanguageModel.from_counts([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    rates = docs.sparkSession.createDataFrame([(lang, i, min(1.0, per_language / count)) for i, (lang, count) in enumerate(sizes)], "lang string, label int, rate double")
    sample = known.join(small(rates, BROADCAST_ROWS), "lang").filter(uniform(F.lit(7), F.col("id")) < F.col("rate")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            labels, texts = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_pylist()
            for lo, hi in runs(np.array([len(t) for t in texts]), CHUNK_CHARS):
                own = np.concatenate([held, *[b * n + label for label, b in zip(labels[lo:hi], text_buckets(texts[lo:hi]), strict=True)]])
                held, which = np.unique(own, return_inverse=True)
                weights = np.ones(len(own), np.int64)
                weights[: len(sums)] = sums
                sums = np.bincount(which, weights, len(held)).astype(np.int64)
                if len(held) >= HELD_CELLS:
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], names=["cell", "n"])
                    held, sums = held[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums)], names=["cell", "n"])

    cells = sample.mapInArrow(tidy(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    return LanguageModel.from_counts(languages, cells["cell"].to_numpy(), cells["n"].to_numpy())


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id (or the columns ``keep``), then lang_pred and score.

    ``lang_pred`` is the likeliest of the model's languages (of equals the first by name), ``score`` its
    posterior with equal priors. A null text, or one without a letter, is ``und`` with score 0; so is
    any text if the model knows no language. Null ids, repeated rows and empty tables pass through.
    """
    named = keep or [id_col]
    sent = named if text_col in named else [*named, text_col]  # a text goes to Python once
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for lo, texts in text_runs(batch.column(sent.index(text_col)), CHUNK_CHARS):
                sure = [i for i, t in enumerate(texts) if t and known.languages and has_letter(t)]
                for i, logs in zip(sure, score_texts([texts[i] for i in sure], known), strict=True):
                    lang[lo + i], score[lo + i] = known.languages[logs.argmax()], 1 / np.exp(logs - logs.max()).sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(named)], pa.array(lang, pa.string()), pa.array(score)], names=[*named, "lang_pred", "score"])

    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in named]).add("lang_pred", "string").add("score", "double")
    return docs.select(*sent).mapInArrow(tidy(run), schema)


def fit_unheld(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """``fit`` on the rows that aren't held out; a null id never is."""
    return fit(docs.filter(~held_out(id_col)), text_col, lang_col, id_col)
