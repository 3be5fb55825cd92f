"""Held-out accuracy of the trained operators, and the quality rules against a plain version."""

import pytest
from brute import ODD, documents, quality, quality_verdicts, rows_of, table
from pyspark.sql import functions as F

from meterlake.llm import language_id, quality_rules, queries, toxicity
from meterlake.llm.common import held_out

SF = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op1_toxicity(spark, SF).join(labels, "doc_id").filter("held_out and toxic is not null").collect()
    right = sum(r.predicted == r.toxic for r in rows) / len(rows)
    found = [r.predicted for r in rows if r.toxic == 1]
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert right >= 0.97 and sum(found) / len(found) >= 0.9 and sum(clean) / len(clean) <= 0.03
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_language_on_held_out_documents(spark):
    truth = documents(spark, "sf0.1").select("doc_id", "lang", F.col("text").rlike(r"\p{L}").alias("letters"))
    rows = queries.op4_language_id(spark, SF).join(truth, "doc_id").filter("held_out and lang is not null and letters").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) >= 0.98


def test_unknown_languages(spark):
    docs = table(spark, ODD)
    got = {r.doc_id: r for r in language_id.predict(docs, language_id.fit_unheld(docs)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 6)] == ["und"] * 4 and got[6].score == 0
    assert got[7].lang_pred in ("de", "en", "fr")
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.predict(none, language_id.fit_unheld(none)).collect()} == {"und"}


@pytest.mark.parametrize("sf", ["odd", "sf0.01"])
def test_statistics(spark, sf):
    docs = table(spark, ODD) if sf == "odd" else documents(spark, sf)
    got = rows_of(quality_rules.judge(docs), "doc_id", *quality_rules.STATS, "base_failed", "kept")
    want = [(i, *quality(t)) for i, t in rows_of(docs, "doc_id", "text")]
    assert sorted(map(repr, (r[:6] for r in got))) == sorted(map(repr, want))
    for _, n_words, *_, repeat, failed, kept in got:
        assert failed == (n_words < 10 or 100 * repeat > 20 * n_words)
        assert not (failed and kept)


def test_outliers_are_far_and_few(spark):
    plain = [(i, " ".join(f"word{(i * 7 + j * j) % 999}" for j in range(60 + i % 9)), "en", "web") for i in range(300)]
    odd = [(1000 + i, " ".join(f"{j}<|>#$%&*" * 3 for j in range(40 + i)), "en", "web") for i in range(20)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(table(spark, plain + odd)).collect()}
    assert not any(got[i] for i in got if i >= 1000)
    assert all(got[i] for i in got if i < 1000)


def test_the_cut_is_a_quantile_of_chi_squared(spark):
    from math import exp

    assert abs(exp(-quality_rules.MAX_DISTANCE / 2) * (1 + quality_rules.MAX_DISTANCE / 2) - 0.001) < 1e-6
    plain = [(i, " ".join(f"word{(i * 7 + j * j) % 999}" for j in range(60 + i % 9)), "en", "web") for i in range(300)]
    fragments = [(1000 + i, " | ".join(f"word{(i * 7 + j * j) % 999} word{(i + j * j) % 997}" for j in range(30)), "en", "web") for i in range(10)]
    repeats = [(2000 + i, " ".join([*(f"word{(i * 7 + j * j) % 999}" for j in range(60)), *["one two three four five"] * 2]), "en", "web") for i in range(10)]
    got = {r.doc_id: r for r in quality_rules.judge(table(spark, plain + fragments + repeats)).collect()}
    assert all(got[i].kept for i in range(300))
    assert not any(got[i].base_failed or got[i].kept for i in got if i >= 1000)


def test_who_is_held_out(spark):
    import zlib

    docs = spark.createDataFrame([(i,) for i in (*range(50), None)], "doc_id bigint")
    got = {r.doc_id: r.h for r in docs.select("doc_id", held_out("doc_id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)} | {None: False}


def test_verdicts_are_those_of_a_plain_estimate(spark):
    docs = documents(spark, "sf0.01")
    want = quality_verdicts(rows_of(docs, "doc_id", "text", "lang", "source"))
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert got.keys() == want.keys()
    assert all(got[i].distance is None if ratio is None else abs(got[i].distance / quality_rules.MAX_DISTANCE - ratio) < 1e-6 * (1 + ratio) for i, (_, ratio) in want.items())
    assert {i: r.kept for i, r in got.items()} == {i: kept for i, (kept, _) in want.items()}
    assert len({(r.lang, r.source) for r in docs.select("lang", "source").collect()}) > 50  # most groups are small here


def test_verdicts_do_not_depend_on_the_layout(spark):
    docs = documents(spark, "sf0.001")
    one = sorted(map(tuple, quality_rules.judge(docs).collect()))
    assert one == sorted(map(tuple, quality_rules.judge(docs.repartition(7, "text")).collect()))


def test_the_language_model_does_not_depend_on_the_layout(spark):
    docs = documents(spark, "sf0.001")
    one, other = language_id.fit(docs), language_id.fit(docs.repartition(5, "text"))
    assert one.languages == other.languages and (one.base == other.base).all() and (one.gain == other.gain).all() and (one.starts == other.starts).all()


def test_scores_are_those_of_each_text_alone():
    import numpy as np

    rng, buckets = np.random.default_rng(1), 1 << language_id.BUCKET_BITS
    dense = rng.integers(0, 4, (buckets, 3))
    model = language_id.LanguageModel.from_counts(["a", "b", "c"], np.flatnonzero(dense)[::-1], dense.ravel()[np.flatnonzero(dense)][::-1])
    log_prob = np.log((dense + language_id.SMOOTHING) / (dense + language_id.SMOOTHING).sum(axis=0))
    texts = ["", "x", "Äbc déf", "the cat sat", "\U0001f600 ok"]
    for t, row in zip(texts, language_id.score_texts(texts, model), strict=True):
        padded, want = [ord(c) for c in f" {t.lower()} "], np.zeros(3)
        for order in language_id.ORDERS:
            for i in range(len(padded) - order + 1):
                want += log_prob[language_id.ngram_buckets(np.array(padded[i : i + order], np.uint32), order)[0]]
        assert np.allclose(row, want)


def test_the_fit_counts_each_ngram(spark, monkeypatch):
    """Against counts of a plain loop, with tasks that hand on their counts early."""
    import numpy as np

    monkeypatch.setattr(language_id, "HELD_CELLS", 10)
    rows = [(1, "Ab ab", "x", "web"), (2, "ab", "x", "web"), (3, "ba b", "y", "web"), (4, None, "y", "web"), (5, "no", None, "web")]
    model = language_id.fit(table(spark, rows))
    want = np.zeros((1 << language_id.BUCKET_BITS, 2))
    for _, text, lang, _ in rows[:3]:
        padded = [ord(c) for c in f" {text.lower()} "]
        for order in language_id.ORDERS:
            for i in range(len(padded) - order + 1):
                want[language_id.ngram_buckets(np.array(padded[i : i + order], np.uint32), order)[0], "xy".index(lang)] += 1
    got = np.tile(model.base, (len(want), 1))
    for bucket in range(len(want)):
        for cell in range(model.starts[bucket], model.starts[bucket + 1]):
            got[bucket, model.language[cell]] += model.gain[cell]
    assert model.languages == ["x", "y"] and np.allclose(got, np.log((want + language_id.SMOOTHING) / (want + language_id.SMOOTHING).sum(axis=0)), atol=1e-5)


def test_many_languages_and_ties(spark):
    rows = [(i, f"w{i % 9000} w{i % 9000} q{i % 9000}", f"l{i % 9000:04d}", "web") for i in range(9000)]
    docs = table(spark, rows)
    model = language_id.fit(docs)
    assert len(model.languages) == 9000
    some = docs.filter("doc_id % 90 = 7")
    got = language_id.predict(some, model, keep=["doc_id", "lang"]).collect()
    assert len(got) == 100 and sum(r.lang_pred == r.lang for r in got) >= 95
    twins = language_id.fit(table(spark, [(1, "same words here", "b", "web"), (2, "same words here", "a", "web")]))
    got = language_id.predict(table(spark, [(3, "same words here", None, "web")]), twins).first()
    assert (got.lang_pred, got.score) == ("a", 0.5)  # of equals the first by name


def test_thresholds_of_many_languages():
    """Languages with enough documents of both labels have a column each, any number of others share one."""
    import numpy as np

    ids, label, langs, words = [], [], [], []
    for k in range(400):
        for i in range(24 if k < 3 else 4):
            ids.append(k * 100 + i)
            label.append(i % 2)
            langs.append(f"l{k:03d}")
            words.append(np.full((5, 4), k, np.int64))
    table_ = toxicity._language_words([*ids, -1], np.array([*label, 1]), [*langs, None], [*words, np.full((5, 4), 999)])
    assert table_.shape == (toxicity.BUCKETS, 4)
    assert [int(table_[k].argmax()) for k in (0, 1, 2, 3, 200, 399)] == [0, 1, 2, 3, 3, 3]
    assert np.allclose(np.exp(table_.astype(np.float64)).sum(axis=0), 1, atol=1e-3) and table_[999, 3] == table_[1000, 3]  # a null language teaches nothing
