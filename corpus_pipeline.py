"""A corpus pipeline of five stages: language ID, line dedup, near-dedup, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of ``documents``. Nulls, empty tables and repeated rows are treated as the operators
say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import bpe, language_id, line_dedup, mixing, near_dedup
from meterlake.llm.common import boxed, cut, small, unboxed
from meterlake.llm.queries import tokenizer_path

#: A document stays if its language's posterior is at least this.
LEAST_SCORE = 0.5
#: Lists of dropped documents up to so many rows are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found: not ``und``, and with a score of at least ``LEAST_SCORE``."""
    model = language_id.fit_unheld(docs)
    judged = language_id.predict(boxed(docs, "text"), model, keep=["doc", "text"])
    return unboxed(judged.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)), docs.columns, "text")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document of a smaller id has; ``n_chars`` follows the text, emptied documents stay."""
    out = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the one of the smallest id."""
    groups = near_dedup.group_rows(docs.select("doc_id", "text"), k=5)
    dropped = small(cut(groups.filter("not kept").select(F.col("id").alias("_id"), F.col("row").alias("_row")).distinct()), BROADCAST_ROWS)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row"))
    return unboxed(boxed(docs, "doc_id", "text").join(dropped, same, "left_anti"), docs.columns, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, or up to three times."""
    bare = ("doc_id", "source", "text")
    sized = boxed(docs, *bare).withColumn("size", mixing.word_count("text"))
    members = F.array("source")
    mix = mixing.plan_mix(cut(sized.select("doc_id", "source", "size")), "doc_id", "size", members)
    taken = mixing.with_taken(sized, mix, "doc_id", "size", members, "taken").filter("taken > 0")
    return unboxed(taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken")))), docs.columns, *bare)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row."""
    return bpe.encode_decode(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]
#: SQL can't express the trained language model, the flow or the encoder; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = cut(docs) if name != STAGES[-1][0] else docs
    return docs
