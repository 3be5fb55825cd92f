"""The ranked search, the Jaccard join and the clustering against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import LONG, LOWER, ODD, PASSAGE, documents, near_groups, rows_of, table, with_clashes
from pyspark.sql import functions as F
from test_dedup import chained

from meterlake.llm import centroids, jaccard_join, ranked_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def searched(docs, queries, k=10):
    """{(item, text): [(document, score)]}"""
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in queries:
        scored = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            scored += [(-score, i is None, i or 0)] if score else []
        if scored:
            out[item, text] = [(None if null else i, -s) for s, null, i in sorted(scored)[:k]]
    return out


def held_search(spark, docs, queries, k=10):
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    index = ranked_search.build_index(docs)
    got = {}
    texts = {r.row: r.text for r in asked.select(F.xxhash64("text").alias("row"), "text").collect()}
    for r in ranked_search.search(index, asked, k).orderBy("item", "row", "rank").collect():
        own = got.setdefault((r.item, texts[r.row]), [])
        own.append((r.doc, r.score))
        assert r["rank"] == len(own)
    assert got == searched(rows_of(docs, "doc_id", "text"), queries, k)
    return got


def test_search(spark, monkeypatch):
    docs = documents(spark, "sf0.001")
    items = rows_of(spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"), "item_id", "text")[:12]
    got = held_search(spark, docs, items)
    assert len(got) == 12
    monkeypatch.setattr(ranked_search, "SHARD_CHARS", 20_000)
    monkeypatch.setattr(ranked_search, "QUERY_BLOCK", 3)
    assert held_search(spark, docs, items) == got
    held_search(spark, docs, items, k=3)


def test_search_of_odd_rows(spark):
    queries = [(1, PASSAGE), (1, PASSAGE), (1, "word3 AND1 and2"), (2, None), (3, ""), (None, "Fox über"), (4, "é漢字 é 漢字 😀"), (5, "nowhere"), (6, "y" * 5000)]
    docs = table(spark, [r for r in ODD if r[0] != 8])  # rows of one id and one score have no order
    held_search(spark, docs, queries)
    held_search(spark, with_clashes(docs), queries)
    index = ranked_search.build_index(docs.limit(0))
    asked = spark.createDataFrame(queries, "item_id bigint, text string")
    assert index.collect() == [] and ranked_search.search(index, asked).collect() == []
    assert ranked_search.search(ranked_search.build_index(docs), asked.limit(0)).collect() == []
    assert ranked_search.search(ranked_search.build_index(table(spark, ODD)), asked).count() > 0


def test_equal_scores_go_to_smaller_ids(spark):
    docs = table(spark, [(i, "same text here" if i % 2 else "other words there", "en", "web") for i in range(60)])
    got = held_search(spark, docs, [(1, "text"), (2, "there here")])
    assert [i for i, _ in got[1, "text"]] == list(range(1, 21, 2))
    assert [i for i, _ in got[2, "there here"]] == list(range(10))


def test_the_merge_of_lists():
    random = np.random.default_rng(5)
    for _ in range(300):
        lists = []
        for _ in range(random.integers(0, 9)):
            docs = np.flatnonzero(random.random(40) < random.random())
            scores = random.integers(0, random.integers(2, 60), len(docs))
            if len(docs):
                lists.append((docs.tolist(), scores.tolist(), int(scores.max())))
        total = Counter()
        for docs, scores, _ in lists:
            for d, s in zip(docs, scores, strict=True):
                total[d] += s
        want = sorted(((s, d) for d, s in total.items() if s), key=lambda x: (-x[0], x[1]))[:4]
        assert ranked_search.best_of(lists, 4) == want


def test_packed_integers():
    values = np.array([0, 1, 127, 128, 300, 2**31, 2**62, 5, 0], np.int64)
    parts = ranked_search.pack(values, np.array([3, 4, 9]))
    assert [ranked_search.unpack(p).tolist() for p in parts] == [values[:3].tolist(), values[3:4].tolist(), values[4:].tolist()]


def held_join(docs, percent=85):
    want = near_groups(rows_of(docs, "doc_id", "text"), 4, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_groups(docs, percent=percent).collect()}
    assert got == want
    return want


def test_join(spark):
    want = held_join(documents(spark, "sf0.01"))
    assert len({least for _, least in want.values()}) < len(want)


@pytest.mark.parametrize("spread", [0.5, 1000])
def test_join_by_cells(spark, monkeypatch, spread):
    """Regions of a few sets are cut again and again, or not at all where the cells would hold too much."""
    docs = table(spark, chained(3, 40))
    for name, value in (("REGION", 500), ("PIVOTS", 4), ("SPREAD", spread)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(jaccard_join, "TASK_SETS", 4)
    assert len({least for _, least in held_join(docs).values()}) < 40
    if spread < 1:
        return
    edits = []
    random = np.random.default_rng(3)
    for i in range(150):  # copies of one text with edits: some near each other, all near the text
        words = [f"u{j}" for j in range(130)]
        for at in random.integers(0, 130, random.integers(0, 5)):
            words[at] = f"x{i}x{at}"
        edits.append((i, " ".join(words), "en", "web"))
    held_join(table(spark, edits))


def test_the_join_threshold(spark):
    base = [f"a{i}" for i in range(88)]  # 85 shingles of 4 words
    rows = [(0, base), (1, base + [f"b{i}" for i in range(15)]), (2, [f"z{i}" for i in range(88)]), (3, [f"z{i}" for i in range(88)] + [f"c{i}" for i in range(16)])]
    want = held_join(table(spark, [(i, " ".join(w), "en", "web") for i, w in rows]))
    assert [want[i][1] for i in range(4)] == [0, 0, 2, 3]


def test_join_of_odd_rows(spark):
    rows = [(1, "One two"), (2, "one  TWO\n"), (3, "one two three"), (4, ""), (5, None), (6, " "), (7, PASSAGE), (8, PASSAGE.upper()), (9, LONG), (10, LONG + " end")]
    want = held_join(table(spark, [(*r, "en", "web") for r in rows]))
    assert [want[i][1] for i in (2, 3, 5, 8, 10)] == [1, 3, 5, 7, 9]
    for docs in (table(spark, ODD), with_clashes(table(spark, ODD))):
        got = jaccard_join.join_groups(docs)
        assert got.count() == len(ODD) and {tuple(r) for r in got.filter("doc_id = 5").collect()} == {(5, jaccard_join.shingle_sets([LONG], 4)[0].size, 4)}
        assert {r.component_id for r in got.filter("doc_id is null").collect()} == {None, 8}
    assert jaccard_join.join_groups(table(spark, []).limit(0)).collect() == []


def test_windows_lose_no_pair(monkeypatch):
    monkeypatch.setattr(jaccard_join, "TASK_SETS", 4)
    random = np.random.default_rng(1)
    bases = [np.unique(random.integers(0, 2**64, 200, dtype=np.uint64)) for _ in range(8)]
    sets = [np.unique(np.concatenate([b[random.random(len(b)) < random.uniform(0.8, 1)], random.integers(0, 2**64, 9, dtype=np.uint64)])) for b in bases for _ in range(12)]
    common, union, away = jaccard_join.distances(sets, sets[:20])
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) and union[i, j] == len(np.union1d(sets[i], sets[j])) for i in range(96) for j in range(20))
    alike = jaccard_join.metric_alike(85)(pa.table({"set": pa.array([s.tobytes() for s in sets], pa.large_binary())}))
    for i in range(96):
        assert alike(i).tolist() == [100 * len(np.intersect1d(s, sets[i])) >= 85 * len(np.union1d(s, sets[i])) for s in sets]


def clustered(vectors, k, rounds, seed="2:"):
    """{id: (cluster, distance)} and the centroids; vectors: (id, integers) with ids that differ."""
    order = sorted(vectors, key=lambda r: hashlib.sha256(f"{seed}{r[0]}".encode()).hexdigest())
    means = [list(x) for _, x in order[:k]]
    for r in range(rounds + 1):
        found = {i: min((sum((a - b) ** 2 for a, b in zip(x, m, strict=True)), c) for c, m in enumerate(means)) for i, x in vectors}
        for c in range(len(means)) if r < rounds else ():
            own = [x for i, x in vectors if found[i][1] == c]
            means[c] = [sum(col) // len(own) for col in zip(*own, strict=True)] if own else means[c]
    return {i: (c, d) for i, (d, c) in found.items()}, means


def held_clusters(spark, rows, k=5, rounds=3, size=4):
    kept = [(i, [math.floor(256 * v) for v in x]) for i, x in rows if x is not None and len(x) == size and all(v is not None and math.isfinite(v) for v in x)]
    want, means = clustered(kept, k, rounds)
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = centroids.cluster_report(vectors.withColumn("cluster", F.lit("extra")), k=k, rounds=rounds, size=size).collect()
    assert {r.vec_id: (r.cluster, r.distance) for r in got} == want and len(got) == len(kept)
    for r in got:
        assert r.cluster_inertia == sum(d for c, d in want.values() if c == r.cluster) and r.inertia == sum(d for _, d in want.values())
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster])).encode()).hexdigest()


def test_clusters(spark):
    random = np.random.default_rng(2)
    held_clusters(spark, [(i, random.normal(0, 1, 4).tolist()) for i in range(300)], k=12)
    held_clusters(spark, [(i, [float(v) for v in random.integers(-2, 3, 4) / 256]) for i in range(200)], k=9)  # many ties and equal vectors
    held_clusters(spark, [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)])  # all equal: empty clusters stay
    held_clusters(spark, [(i, (1e5 * random.normal(0, 1, 4)).tolist()) for i in range(60)])


def test_clusters_of_odd_rows(spark):
    good = [(i, [0.5 * i, -1.25, 0.0, 1e-9 * i]) for i in range(7)]
    odd = [(20, None), (21, []), (22, [1.0, 2.0, 3.0]), (23, [1.0, None, 2.0, 3.0]), (24, [1.0, float("nan"), 2.0, 3.0]), (25, [float("inf"), 0.0, 0.0, 0.0]), (26, [1.0] * 5)]
    held_clusters(spark, good + odd)
    held_clusters(spark, good[:3], k=5)
    held_clusters(spark, good[:1], k=1)
    held_clusters(spark, odd)
    rows = spark.createDataFrame(good + [(None, [1.0, 1.0, 1.0, 1.0]), (0, good[0][1])], "vec_id bigint, embedding array<double>")
    assert centroids.cluster_report(rows, k=20, size=4).count() == 9
    assert centroids.cluster_report(rows.limit(0), k=20, size=4).collect() == []
    with pytest.raises(Exception, match="a component beyond"):
        centroids.cluster_report(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0])], "vec_id bigint, embedding array<double>"), k=2, size=4).collect()


def test_balls_spare_distances():
    random = np.random.default_rng(3)
    middles = random.integers(-4000, 4000, (40, 8))
    x = (middles[random.integers(0, 40, 5000)] + random.integers(-60, 60, (5000, 8))).astype(np.int64)
    ball = centroids.Ball(middles.astype(np.int64), None)
    a, upper, lower = np.zeros(5000, np.int32), np.full(5000, np.inf), np.zeros(5000)
    ball.search(x, a, upper, lower)
    assert (a == ((x[:, None, :] - middles) ** 2).sum(axis=2).argmin(axis=1)).all()
    again = centroids.Ball(middles + 1, middles)
    assert again.search(x, a, upper, lower) < 5000
    assert (a == ((x[:, None, :] - middles - 1) ** 2).sum(axis=2).argmin(axis=1)).all()
