"""Nulls in any column, empty and very long texts, repeated rows, empty tables, clashing names: for each operator and stage."""

import uuid

import pytest
from brute import ODD, table, with_clashes
from pyspark.sql import functions as F

import corpus_pipeline
from meterlake.llm import bpe, edit_fingerprint, language_id, line_dedup, mixing, near_dedup, quality_rules, token_counts, toxicity, url_filter
from meterlake.llm.queries import tokenizer_path


def labels_of(docs):
    return docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), F.lit("x").alias("text"))


def tokens(docs):
    path = f"/tmp/checkpoints/{uuid.uuid4().hex}"
    token_counts.write_blocks(docs, tokenizer_path(), path)
    return token_counts.count_documents(path, docs.sparkSession)


def mixed(docs):
    sized = docs.select("*", mixing.word_count("text").alias("_words"))
    mix = mixing.plan_mix(sized, "doc_id", "_words", F.array("source"))
    return mixing.with_taken(sized, mix, "doc_id", "_words", F.array("source"), "_passes")


OPERATORS = {
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels_of(d))),
    "line_digests": lambda d: line_dedup.digest_kept(d, line_dedup.keep_bitmaps(d)),
    "line_texts": lambda d: line_dedup.drop_lines(d, line_dedup.keep_bitmaps(d)),
    "quality": quality_rules.judge,
    "language": lambda d: language_id.predict(d, language_id.fit_unheld(d)),
    "near": near_dedup.near_groups,
    "tokens": tokens,
    "bpe": lambda d: bpe.encode_decode(d, tokenizer_path()),
    "bpe_ids": lambda d: bpe.decode_ids(bpe.encode_ids(d, tokenizer_path()), tokenizer_path()),
    "mixing": mixed,
    "edits": edit_fingerprint.fingerprint_edits,
    "prints": edit_fingerprint.fingerprint,
    "urls": lambda d: url_filter.judge_urls(d, "doc_id", "text"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_each_odd_row_comes_back_once(spark, name):
    docs = table(spark, ODD)
    assert OPERATORS[name](docs).count() == len(ODD)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_names(spark, name):
    assert len(OPERATORS[name](with_clashes(table(spark, ODD))).collect()) == len(ODD)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_an_empty_table(spark, name):
    assert OPERATORS[name](table(spark, []).limit(0)).collect() == []


def test_links_of_odd_rows(spark):
    prints = edit_fingerprint.fingerprint(table(spark, ODD))
    found = {(r.id, r.representative): r.likeness for r in edit_fingerprint.near_representatives(prints).collect()}
    assert found[5, 4] == 1.0
    assert edit_fingerprint.near_representatives(prints.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, stage):
    f = dict(corpus_pipeline.STAGES)[stage]
    for docs in (table(spark, ODD), with_clashes(table(spark, ODD)), table(spark, []).limit(0)):
        out = f(spark, docs, "")
        rows = out.collect()
        assert stage == "bpe" or out.columns == docs.columns
        assert len(rows) <= 3 * docs.count()
        if "k" in docs.columns and stage != "bpe":
            assert all(r["_size"] == "extra _size" and r["score"] == "extra score" for r in rows)
