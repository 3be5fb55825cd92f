"""The operators' queries over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import bpe, centroids, edit_fingerprint, jaccard_join, language_id, line_dedup, mixing, near_dedup, quality_rules, ranked_search, token_counts, toxicity, url_filter
from meterlake.llm.common import cut, held_out, remove, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The byte-level vocabulary that the queries encode with."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digest_kept(docs, line_dedup.keep_bitmaps(docs))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents")).drop("distance")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit_unheld(docs))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are written as flat token files to the shared folder, then counted from these alone; the files go at once."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    token_counts.write_blocks(_table(spark, sf_dir, "documents"), tokenizer_path(), path)
    counts = cut(token_counts.count_documents(path, spark).select(F.col("id").alias("doc_id"), "n_tokens"))
    remove(spark, path)
    return counts


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sized = cut(docs.select("doc_id", "source", mixing.word_count("text").alias("size")))
    members = F.array("source")
    mix = mixing.plan_mix(sized, "doc_id", "size", members)
    facts = mixing.source_facts(spark, mix).select("is_null", "name", "source_size", "target")
    taken = mixing.with_taken(sized, mix, "doc_id", "size", members, "passes")
    out = taken.join(facts, taken.source.eqNullSafe(facts.name))
    return out.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size")).alias("taken"))


def op9_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cut(ranked_search.build_index(_table(spark, sf_dir, "documents")))
    best = ranked_search.search(index, _table(spark, sf_dir, "benchmark"), k=10)
    return best.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed="2:", size=64)


OP2_SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT doc_id, line, pos, coalesce(doc_id <> first, false) AS lost FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingled AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP10_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM split),
rules(action, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parts JOIN rules ON ('.' || host) LIKE ('%.' || h) AND starts_with(path, p) GROUP BY page_id)
SELECT parts.page_id, host, coalesce(path, '') AS path, rule,
  coalesce(action, CASE WHEN regexp_full_match('.' || rtrim(regexp_replace(regexp_replace(host, '^.*@', '', 's'), ':[0-9]*$', ''), '.')
    || translate(regexp_replace(coalesce(path, ''), '/+', '/', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{globs}', 's') THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN best USING (page_id)
"""


OP9_CHECK_SQL = r"""
WITH nexts AS (
  SELECT doc_id, coalesce(text, '') AS text,
    coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS after
  FROM documents)
SELECT doc_id, length(text) AS n_chars,
  sha256(substr(text, 1, length(text) - length(text) // 2) || substr(after, 1, length(text) // 2)) AS edited_sha256
FROM nexts
"""


#: The same links at 0.85, without the column kept.
OP12_SQL = OP5_SQL.replace("100 * c >= 80 *", "100 * c >= 85 *").replace(", d.doc_id <= coalesce(m, d.doc_id) AS kept", "")

OP11_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs WHERE len(ts) > 0),
lengths AS (SELECT doc_id, (10 + (90 * len(ts)::BIGINT * n_docs) // n_terms)::BIGINT AS m FROM docs, totals WHERE len(ts) > 0),
postings AS (SELECT t, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY t, n_docs),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN postings USING (t) JOIN weights USING (t) JOIN lengths USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


def _op13_sql(k: int = 40, rounds: int = 5, size: int = 64) -> str:
    """Rounds as a chain of tables: assigned (nearest centroid, smaller numbers first), then means by cluster."""
    nearest = (
        "a{r} AS (SELECT vec_id, v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM "
        "(SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM whole, c{r}) GROUP BY vec_id, v)"
    )
    means = (
        "s{r} AS (SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, {size} + 1)) AS pos FROM a{r}) GROUP BY c, pos), "
        "m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS m FROM s{r} GROUP BY c), "
        "c{next} AS (SELECT c, coalesce(m{r}.m, c{r}.m) AS m FROM c{r} LEFT JOIN m{r} USING (c))"
    )
    parts = [
        f"kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        "whole AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM kept)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('2:' || vec_id) AS h, v FROM whole ORDER BY h LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [nearest.format(r=r, k=k).replace(" AS (", " AS MATERIALIZED (", 1), means.format(r=r, next=r + 1, size=size)]
    parts.append(nearest.format(r=rounds, k=k))
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, "
        f"sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (c)"
    )


def _glob_pattern(globs) -> str:
    """The globs as one regular expression."""
    parts = {"**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "|".join("".join(parts.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", g)) for g in globs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_line_dedup": op2_line_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_language_id": op4_language_id,
        "op5_near_dedup": op5_near_dedup,
        "op6_token_counts": op6_token_counts,
        "op7_bpe": op7_bpe,
        "op8_mixing": op8_mixing,
        "op9_edit_fingerprint": op9_edit_fingerprint,
        "op10_url_filter": op10_url_filter,
        "op11_ranked_search": op11_ranked_search,
        "op12_jaccard_join": op12_jaccard_join,
        "op13_centroids": op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op5_near_dedup": OP5_SQL, "op10_url_filter": OP10_SQL.replace("{globs}", _glob_pattern(url_filter.GLOBS)), "op11_ranked_search": OP11_SQL, "op12_jaccard_join": OP12_SQL, "op13_centroids": _op13_sql()}
