"""Encoding against the tokenizers library, decoding, and token counts from flat files."""

import hashlib

import numpy as np
import pytest
from brute import ODD, documents, rows_of, table
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterlake.llm import bpe, token_counts
from meterlake.llm.queries import tokenizer_path

TRUTH = Tokenizer.from_file(tokenizer_path())
TRUTH.no_truncation()
TRUTH.no_padding()
BYTES_ONLY = Tokenizer.from_file(tokenizer_path())
BYTES_ONLY.no_truncation()
BYTES_ONLY.no_padding()
BYTES_ONLY.encode_special_tokens = True  # a separator's name in a text is text
OWN = bpe.encoder(bpe.pack_tokenizer(tokenizer_path()))


def ids_of(text):
    return TRUTH.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n\t'sdltrevm0123456789 ab\u3000\x85")), max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    assert OWN.encode([text])[0].tolist() == ids_of(text)


@pytest.mark.parametrize("text", ["", " ", "  a", "a  ", "it's we'LL", "x" * 3000, " " * 4000 + "a", "<|endoftext|>", "a<|endoftext|> b", "\r\n\r\n a", "é" * 500, "漢字 😀\U0010ffff"])
def test_chosen_texts(text):
    assert OWN.encode([text])[0].tolist() == ids_of(text)


def test_the_two_trees_agree():
    pieces = [b"internationalization", b" the", b"zzzzzzzzzz", b"aaaaaaaaaaaaaaaaaaaaaaaa", "straße".encode(), b"x"]
    assert [np.frombuffer(ids, OWN.kind).tolist() for ids in OWN.merge_many(pieces)] == [OWN.merge([OWN.byte_ids[b] for b in p]) for p in pieces]


@pytest.mark.parametrize("sf", ["odd", "sf0.01"])
def test_digests(spark, sf):
    docs = table(spark, ODD) if sf == "odd" else documents(spark, sf)
    got = rows_of(bpe.encode_decode(docs, tokenizer_path()), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, text in rows_of(docs, "doc_id", "text"):
        ids = ids_of(text or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(TRUTH.decode(ids, skip_special_tokens=False))))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_round_trip(spark):
    docs = table(spark, ODD)
    back = rows_of(bpe.decode_ids(bpe.encode_ids(docs, tokenizer_path()), tokenizer_path()), "doc_id", "text")
    assert sorted(map(repr, back)) == sorted(repr((i, t or "")) for i, t, *_ in ODD)


@pytest.mark.parametrize("block", [1, 7, 1000, 1 << 16])
def test_counts_from_blocks_of_any_size(spark, tmp_path, block):
    rows = [r for r in ODD if block > 10 or len(r[1] or "") < 1000]
    path = str(tmp_path / "blocks")
    token_counts.write_blocks(table(spark, rows).repartition(3), tokenizer_path(), path, block_tokens=block)
    got = rows_of(token_counts.count_documents(path, spark), "id", "n_tokens")
    want = [(i, len(BYTES_ONLY.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_counts_of_documents(spark):
    from meterlake.llm import queries

    docs = documents(spark, "sf0.01")
    got = rows_of(queries.op6_token_counts(spark, "/root/testdata/sf0.01"), "doc_id", "n_tokens")
    assert sorted(got) == sorted((i, len(ids_of(t or ""))) for i, t in rows_of(docs, "doc_id", "text"))


def test_a_scan_alone(spark):
    rows = [(0, 0, [5, 5, 9, 9]), (0, 1, [5]), (0, 2, []), (0, 3, [5, 9, 5]), (1, 0, [9])]
    blocks = spark.createDataFrame([(f, n, bytearray(np.array(t, "<u2").tobytes())) for f, n, t in rows], "file int, n bigint, tokens binary")
    assert sorted(rows_of(token_counts.count_tokens(blocks, 9), "file", "ordinal", "n_tokens")) == [(0, 0, 2), (0, 1, 0), (0, 2, 2), (1, 0, 0)]
