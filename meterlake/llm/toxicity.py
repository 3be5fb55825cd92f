"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first 4, 5 and 6 letters. Filters of several
widths run over the words, each keeps its largest response, and a logistic layer reads these.
Convolution is linear in the embeddings, so scoring folds filters and embeddings into one table over a
group's distinct words and only gathers and adds. The threshold is calibrated for each language as
the text itself shows it (naive Bayes over the same word hashes), on scores by models that did not see
the document, and moved to 0.5.

The labelled sample for the fit is bounded; every whole text is scored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import held_out, runs, segment_sums, tidy, uniform

BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS = 12, 10, (1, 2, 3)
#: Fit on about so many labelled documents of each label at most, by a hash of their ids.
FIT_PER_LABEL = 3000
#: A labelled document counts in the fit with its whole text, in windows of so many words.
WINDOW = 2000
EPOCHS, STEP, BATCH, PENALTY = 4, 0.02, 16, 1e-5
#: Thresholds come from scores by models that were fitted on the other folds.
FOLDS = 3
#: Languages with fewer documents of a label use the threshold over all languages, so at most ``FIT_PER_LABEL / LEAST_EACH`` have their own.
LEAST_EACH = 10
CHUNK_CHARS = 2_000_000
_WORD = re.compile(r"[^\W_]+")


@dataclass
class ToxicityModel:
    embed: np.ndarray  # buckets x DIM
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    lang_log: np.ndarray  # buckets x languages, of words
    thresholds: np.ndarray  # logit for each language


def word_buckets(word: str) -> tuple[int, int, int, int]:
    raw = word.encode("utf-8", "surrogatepass")
    return (
        zlib.crc32(raw) & (BUCKETS - 1),
        *(zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), k) & (BUCKETS - 1) for k in (4, 5, 6)),
    )


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class _Vocabulary:
    """Numbers for the distinct words of a group of texts, and their four buckets."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def ids(self, words: list[str]) -> list[int]:
        put = self.number.setdefault
        size = self.number.__len__
        return [put(w, size()) for w in words]

    def buckets(self) -> np.ndarray:
        return np.array([word_buckets(w) for w in self.number], np.int64).reshape(-1, 4)


def responses(model: ToxicityModel, buckets: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The largest response of each filter over each text, ReLU applied; 0 for a text shorter than the filter."""
    vectors = model.embed[buckets].sum(axis=1)
    out = np.zeros((len(offsets) - 1, len(WIDTHS) * FILTERS), np.float32)
    lengths = np.diff(offsets)
    for k, width in enumerate(WIDTHS):
        n = len(ids) - width + 1
        if n <= 0:
            continue
        folded = [(vectors @ model.filters[k][j]).astype(np.float32) for j in range(width)]
        total = folded[0][ids[:n]]
        for j in range(1, width):
            total += folded[j][ids[j : j + n]]
        if width > 1:  # filters that reach into the next text don't count
            cross = (offsets[1:-1, None] - np.arange(1, width)).ravel()
            total[cross[(cross >= 0) & (cross < n)]] = -np.inf
        full = np.flatnonzero(lengths >= width)
        if len(full):
            starts = offsets[:-1][full]
            out[full, k * FILTERS : (k + 1) * FILTERS] = _segment_max(total, starts, offsets[1:][full] - width + 1)
    return np.maximum(out + model.bias, 0)


def _segment_max(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Largest values over [start, end) of growing, non-empty ranges."""
    marks = np.minimum(np.stack([starts, ends], axis=1).ravel(), len(values))
    if marks[-1] == len(values):
        marks = marks[:-1]
    return np.maximum.reduceat(values, marks, axis=0)[::2]


def logits(model: ToxicityModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A logit and the likeliest language's number for each text."""
    vocabulary, ids, offsets = _Vocabulary(), [], [0]
    for text in texts:
        ids += vocabulary.ids(words_of(text))
        offsets.append(len(ids))
    ids, offsets, buckets = np.array(ids, np.int64), np.array(offsets, np.int64), vocabulary.buckets()
    raw = responses(model, buckets, ids, offsets) @ model.weight + model.offset
    lang = segment_sums(model.lang_log[buckets[:, 0]][ids], offsets)
    return raw, lang.argmax(axis=1) if lang.shape[1] else np.zeros(len(texts), np.int64)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, lang_col: str, per_label: int) -> DataFrame:
    """id, label, lang and the four buckets of each word, of about ``per_label`` rows of each label."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").filter(~held_out("id"))
    marked = marked.groupBy("id").agg(F.max("label").alias("label"))  # of labels that disagree the worse holds
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    rate = F.when(F.col("label") == 1, min(1.0, per_label / max(1, sizes.get(1, 0)))).otherwise(min(1.0, per_label / max(1, sizes.get(0, 0))))
    chosen = F.broadcast(marked.filter(uniform(F.lit(3), F.col("id")) < rate))  # 2 x per_label rows, by the rates
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, label, lang, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = words_of(text)
                for start in range(0, max(1, len(words)), WINDOW):
                    flat = np.array([b for w in words[start : start + WINDOW] for b in word_buckets(w)], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([start], pa.int64()), pa.array([label], pa.int32()), pa.array([lang], pa.string()), pa.array([flat.tobytes()], pa.binary())], names=["id", "at", "label", "lang", "words"])

    return texts.join(chosen, "id").select("id", "label", "lang", "text").mapInArrow(tidy(hashed), "id long, at long, label int, lang string, words binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", per_label: int = FIT_PER_LABEL) -> ToxicityModel:
    """Train on labelled rows that aren't held out; about ``per_label`` of each label, whole texts in windows.

    ``lang_col`` only teaches which words belong to which language, for the thresholds; it is no input
    of a score. Without labelled rows of both labels every score is that of the base rate.
    """
    rows = _sample(docs, labels, id_col, text_col, label_col, lang_col, per_label).toArrow().sort_by([("id", "ascending"), ("at", "ascending")])
    ids, label, langs = rows["id"].to_pylist(), np.array(rows["label"].to_pylist(), np.int64), rows["lang"].to_pylist()
    words = [np.frombuffer(w, np.int32).reshape(-1, 4).astype(np.int64) for w in rows["words"].to_pylist()]
    lang_log = _language_words(ids, label, langs, words)
    if len(set(label.tolist())) < 2:
        model = ToxicityModel(*_start(words, label), lang_log, np.zeros(lang_log.shape[1]))
        model.weight[:] = 0
        model.offset = 2.0 if label.any() else -2.0
        return model
    model = _fitted(words, label, lang_log)
    fold = np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids])
    worst: dict[int, tuple[float, int, int]] = {}  # a document is as toxic as its worst window
    for k in range(FOLDS):
        rest = np.flatnonzero(fold != k)
        other = _fitted([words[i] for i in rest], label[rest], lang_log) if len(set(label[rest].tolist())) == 2 else model
        for i in np.flatnonzero(fold == k):
            w = words[i]
            z = float((responses(other, w, np.arange(len(w)), np.array([0, len(w)])) @ other.weight + other.offset)[0])
            if ids[i] not in worst or worst[ids[i]][0] < z:
                worst[ids[i]] = (z, int(lang_log[w[:, 0]].sum(axis=0).argmax()), int(label[i]))
    scores, lang, truth = (np.array(x) for x in zip(*worst.values(), strict=True))
    overall = _threshold(scores, truth)
    for k in range(len(model.thresholds)):
        own = lang == k
        enough = truth[own].sum() >= LEAST_EACH and (1 - truth[own]).sum() >= LEAST_EACH
        model.thresholds[k] = _threshold(scores[own], truth[own]) if enough else overall
    return model


def _language_words(ids: list[int], label: np.ndarray, langs: list[str | None], words: list[np.ndarray]) -> np.ndarray:
    """Log-probabilities, buckets x languages, of words in languages with ``LEAST_EACH`` documents of each label; all others share the last column."""
    each = Counter((lang, y) for _, y, lang in {(i, y, lang) for i, y, lang in zip(ids, label.tolist(), langs, strict=True) if lang is not None})
    known = sorted(lang for lang, y in each if y == 1 and min(each[lang, 0], each[lang, 1]) >= LEAST_EACH)
    column = {lang: k for k, lang in enumerate(known)}
    others = any(lang not in column for lang, _ in each)
    counts = np.full((max(1, len(known) + others), BUCKETS), 0.5)
    for lang, w in zip(langs, words, strict=True):
        if lang is not None:
            counts[column.get(lang, len(known))] += np.bincount(w[:, 0], minlength=BUCKETS)
    return np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()


def _fitted(words: list[np.ndarray], label: np.ndarray, lang_log: np.ndarray) -> ToxicityModel:
    model = ToxicityModel(*_start(words, label), lang_log, np.zeros(lang_log.shape[1]))
    _train(model, words, label)
    return model


def _threshold(scores: np.ndarray, truth: np.ndarray) -> float:
    """The middle of the gap with the fewest errors."""
    order = np.argsort(scores, kind="stable")
    s, t = scores[order], truth[order]
    missed = np.concatenate([[0], np.cumsum(t)])
    flagged = (1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)])
    loss = missed + flagged
    at = np.flatnonzero(loss == loss.min())
    at = int(at[len(at) // 2])
    low, high = s[max(at - 1, 0)], s[min(at, len(s) - 1)]
    return float((low + high) / 2)


def _start(words: list[np.ndarray], label: np.ndarray):
    """Random embeddings whose first part is each bucket's log-odds over documents, and filters that read it."""
    rng = np.random.default_rng(11)
    seen = np.full((2, BUCKETS), 0.3)
    for w, y in zip(words, label, strict=True):
        np.add.at(seen[y], np.unique(w), 1)
    odds = np.log(seen[1] / max(1, (label == 1).sum())) - np.log(seen[0] / max(1, (label == 0).sum()))
    embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
    embed[:, 0] = np.clip(odds, -1, 4) / 4
    embed[seen.sum(axis=0) < 2] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] += 0.5
    n = len(WIDTHS) * FILTERS
    return embed, filters, np.zeros(n, np.float32), rng.normal(0, 0.1, n).astype(np.float32), 0.0


def _train(model: ToxicityModel, words: list[np.ndarray], label: np.ndarray) -> None:
    """Adagrad over documents; the gradient of a filter flows to the words of its largest response."""
    rng = np.random.default_rng(5)
    params = [model.embed, *model.filters, model.bias, model.weight]
    power = [np.full_like(p, 1e-3) for p in params]
    balance = np.array([1.0, (label == 0).sum() / max(1, (label == 1).sum())])
    balance /= balance.mean()
    bias_power = 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(words))
        for start in range(0, len(words), BATCH):
            grads = [np.zeros_like(p) for p in params[1:]]
            touched: list[np.ndarray] = []
            embed_grads: list[np.ndarray] = []
            offset_grad = 0.0
            for i in order[start : start + BATCH]:
                w = words[i]
                vectors = model.embed[w].sum(axis=1)
                tops, hidden = [], np.zeros(len(WIDTHS) * FILTERS, np.float32)
                for k, width in enumerate(WIDTHS):
                    n = len(w) - width + 1
                    if n <= 0:
                        tops.append(None)
                        continue
                    total = vectors[:n] @ model.filters[k][0]
                    for j in range(1, width):
                        total += vectors[j : j + n] @ model.filters[k][j]
                    top = total.argmax(axis=0)
                    tops.append(top)
                    hidden[k * FILTERS : (k + 1) * FILTERS] = total[top, np.arange(FILTERS)]
                hidden += model.bias
                live = np.maximum(hidden, 0)
                z = float(live @ model.weight + model.offset)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[i]) * balance[label[i]]
                offset_grad += error
                grads[-1] += error * live
                back = error * model.weight * (hidden > 0)
                grads[-2] += back
                for k, width in enumerate(WIDTHS):
                    if tops[k] is None:
                        continue
                    part = back[k * FILTERS : (k + 1) * FILTERS]
                    for j in range(width):
                        at = tops[k] + j
                        grads[k][j] += vectors[at].T * part
                        touched.append(w[at])
                        embed_grads.append(model.filters[k][j].T * part[:, None])
            for p, g, q in zip(params[1:], grads, power[1:], strict=True):
                g += PENALTY * p
                q += g * g
                p -= STEP * g / np.sqrt(q)
            bias_power += offset_grad**2
            model.offset -= STEP * offset_grad / np.sqrt(bias_power)
            if touched:
                rows = np.concatenate(touched)
                values = np.concatenate(embed_grads)
                unique, inverse = np.unique(rows, return_inverse=True)
                total = np.zeros((len(unique), DIM), np.float32)
                np.add.at(total, inverse.ravel(), np.repeat(values, rows.shape[1], axis=0))
                power[0][unique] += total * total
                model.embed[unique] -= STEP * total / np.sqrt(power[0][unique])


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score (0 to 1; the text's calibrated threshold is at 0.5), predicted.

    Null and empty texts have no words and get the score of a text without any response. Null ids
    and repeated rows pass through; no other column is read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = np.zeros(len(texts))
            for lo, hi in runs(np.array([len(t or "") for t in texts], np.int64), CHUNK_CHARS):
                raw, lang = logits(known, texts[lo:hi])
                out[lo:hi] = 1 / (1 + np.exp(-np.clip(raw - known.thresholds[lang], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(tidy(run), f"`{id_col}` {kind}, score double, predicted int")
