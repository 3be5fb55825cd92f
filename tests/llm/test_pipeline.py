"""The pipeline's stages against plain versions, each on its own input."""

import hashlib

import pyarrow as pa
from brute import WORD, documents, line_dedup, near_groups, rows_of
from pyspark.util import PythonEvalType
from tokenizers import Tokenizer

import corpus_pipeline
from meterlake.llm import language_id, line_dedup, mixing
from meterlake.llm.common import boxed, cut, text_runs
from meterlake.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = documents(spark, "sf0.001")
    told = cut(stages["language_id"](spark, docs, SF))
    before, after = set(rows_of(docs, *docs.columns)), set(rows_of(told, *docs.columns))
    assert after <= before and len(after) > 0.9 * len(before)
    assert all(r.text is None or not any(c.isalpha() for c in r.text) or r.lang is None for r in docs.join(told, "doc_id", "left_anti").collect())

    lined = cut(stages["line_dedup"](spark, told, SF))
    want = line_dedup(rows_of(told, "doc_id", "text"))
    assert sorted(rows_of(lined, "doc_id", "text", "n_chars")) == sorted((i, kept, len(kept)) for (i, _), (_, _, kept) in want.items())

    single = cut(stages["near_dedup"](spark, lined, SF))
    groups = near_groups(rows_of(lined, "doc_id", "text"), 5)
    assert sorted(i for (i,) in rows_of(single, "doc_id")) == sorted(i for i, (_, least) in groups.items() if i == least)

    mixed = cut(stages["mixing"](spark, single, SF))
    sizes, source = {}, dict(rows_of(single, "doc_id", "source"))
    for i, text in rows_of(single, "doc_id", "text"):
        sizes[i] = len(WORD.findall(text))
    order = sorted(set(source.values()))
    targets = mixing.targets_by_weight({s: sum(n for i, n in sizes.items() if source[i] == s) for s in order}, order)
    taken = [i for (i,) in rows_of(mixed, "doc_id")]
    assert max(map(taken.count, taken)) <= 3
    for s in order:
        assert abs(sum(sizes[i] for i in taken if source[i] == s) - targets[s]) <= max(60, 0.02 * targets[s])

    truth = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, text in rows_of(mixed, "doc_id", "text"):
        ids = truth.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    assert sorted(rows_of(stages["bpe"](spark, mixed, SF), "doc_id", "n_tokens", "ids_sha256")) == sorted(want)
    assert sorted(rows_of(corpus_pipeline.run(spark, SF), "doc_id", "n_tokens", "ids_sha256")) == sorted(want)


def test_a_text_goes_to_python_once_and_only_if_it_loses_lines(spark):
    docs = documents(spark, "sf0.001")
    told = language_id.predict(boxed(docs, "text"), language_id.fit_unheld(docs), keep=["doc", "text"])
    sent = told._jdf.queryExecution().optimizedPlan().children().head().output()
    assert sent.mkString(",").count("text#") == 1 and sent.size() == 2
    rows = [(1, "a line of some length\nx"), (2, "a line of some length\ny"), (3, None), (4, "another line of its own")]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    lined = line_dedup.drop_lines(some, line_dedup.keep_bitmaps(some))
    assert sorted(rows_of(lined, "doc_id", "text")) == [(1, rows[0][1]), (2, "y"), (3, None), (4, rows[3][1])]
    plan = lined._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN isnotnull(_ld_bitmap" in plan and line_dedup._apply_bitmap.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF  # no pandas on workers


def test_texts_are_taken_from_a_batch_in_groups():
    texts = pa.array(["ab", None, "", "x" * 9, "y", "zz"])
    assert list(text_runs(texts, 4)) == [(0, ["ab", None, ""]), (3, ["x" * 9]), (4, ["y", "zz"])]
    assert list(text_runs(texts[:0], 4)) == []
