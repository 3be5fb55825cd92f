import pytest
from brute import LOWER, ODD, PASSAGE, documents, line_dedup, near_groups, rows_of, sha, table
from compare import duck, duck_rows, spark_rows

from meterlake.llm import line_dedup as lines
from meterlake.llm import near_dedup as near
from meterlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(duck(SF), queries.oracle_sql()[name])


def test_lines_of_odd_rows(spark):
    docs = table(spark, ODD)
    want = line_dedup([r[:2] for r in ODD])
    bitmaps = lines.keep_bitmaps(docs)
    got = {(r.doc_id, r.kept_sha256, r.n_lines, r.n_dropped) for r in lines.digest_kept(docs, bitmaps).collect()}
    assert got == {(i, sha(kept), n, lost) for (i, _), (n, lost, kept) in want.items()}
    texts = rows_of(lines.drop_lines(docs, bitmaps), "doc_id", "text")
    assert sorted(map(repr, texts)) == sorted(repr((i, t if t is None else want[i, t][2])) for i, t, *_ in ODD)


def test_a_line_of_all_documents_over_many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    rows = [(i, f"a line that all have\nown line number {i % 40}\n A LINE that all have ", "en", "web") for i in range(400)]
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.digest_kept(table(spark, rows), lines.keep_bitmaps(table(spark, rows))).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: (n, lost) for (i, _), (n, lost, _) in line_dedup([r[:2] for r in rows]).items()}
    assert got[0] == (3, 0) and got[1] == (3, 2) and got[41] == (3, 3)


def held(spark, docs, k):
    rows = rows_of(docs, "doc_id", "text")
    want = near_groups(rows, k)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_groups(docs, k=k).collect()}
    assert got == {i: (n, least, i == least) for i, (n, least) in want.items()}
    return want


def chained(groups, steps):
    """Texts of which each is similar to the next, but the first not to the last; and copies."""
    rows, i = [], 0
    for g in range(groups):
        words = [f"w{g}x{j}" for j in range(120)]
        for s in range(steps):
            words = words[3:] + [f"v{g}x{s}x{j}" for j in range(3)]
            for _ in range(1 + s % 3):
                rows.append((i, " ".join(words).upper() if s % 2 else " ".join(words), "en", "web"))
                i += 1
    return rows


def test_groups_of_documents(spark):
    want = held(spark, documents(spark, "sf0.01"), 4)
    assert len({least for _, least in want.values()}) < len(want)
    held(spark, documents(spark, "sf0.01"), 5)


def test_chains_and_blocks(spark, monkeypatch):
    docs = table(spark, chained(6, 25))
    want = held(spark, docs, 4)
    assert len({least for _, least in want.values()}) < 40
    monkeypatch.setattr(near, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(near, "CLUSTER_BLOCK", 500)
    assert held(spark, docs, 4) == want


def test_the_threshold_is_exact(spark):
    base = [f"a{i}" for i in range(93)]  # 90 shingles of 4 words
    rows = [(0, base), (1, base + [f"b{i}" for i in range(22)]), (2, [f"z{i}" for i in range(93)]), (3, [f"z{i}" for i in range(93)] + [f"c{i}" for i in range(23)])]
    docs = table(spark, [(i, " ".join(w), "en", "web") for i, w in rows])
    want = held(spark, docs, 4)  # 90 of 112 and of 113: above and below 0.8
    assert [want[i][1] for i in range(4)] == [0, 0, 2, 3]


def test_short_and_odd_texts(spark):
    rows = [(1, "One two"), (2, "one  TWO\n"), (3, "one two three"), (4, ""), (5, None), (6, " "), (7, PASSAGE), (8, PASSAGE.upper()), (9, "é É"), (10, "É é")]
    want = held(spark, table(spark, [(*r, "en", "web") for r in rows]), 4)
    assert [want[i][1] for i in (1, 2, 3, 4, 5, 6, 8)] == [1, 1, 3, 4, 5, 6, 7]
    assert "É".translate(LOWER) == "É" and want[10][1] == 10


def test_estimates_are_close():
    import numpy as np

    rng = np.random.default_rng(1)
    for similarity in (0.2, 0.4, 0.8, 0.95):
        common = int(2000 * similarity / (1 + similarity))
        hits = 0
        for _ in range(20):
            flat = rng.integers(0, 2**63, 2000, dtype=np.uint64)
            a, b = flat[:1000], np.concatenate([flat[1000 - common : 1000], flat[1000 : 2000 - common]])
            regs = near.set_sketches([a, b])
            hits += bool(near.loosely_similar(regs[:1], regs[1:], np.array([1000.0]), np.array([1000.0]))[0])
        assert hits == (20 if similarity > 0.6 else 0)


def test_sketches_merge_by_maxima():
    import numpy as np

    values = np.arange(1, 5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b, both = near.set_sketches([values[:3000], values[2000:], values])
    assert (np.maximum(a, b) == both).all()


def test_exact_likeness_loses_no_pair():
    import numpy as np
    import pyarrow as pa

    from meterlake.llm.near_dedup import exact_alike

    random = np.random.default_rng(1)
    draw = lambda n: random.integers(0, 2**64, n, dtype=np.uint64)
    for _ in range(10):
        bases = [np.unique(draw(random.integers(1, 300))) for _ in range(6)]
        sets = []
        for k in range(60):
            base = bases[k % 6]
            kept = base[random.random(len(base)) < random.uniform(0.75, 1)]
            sets.append(np.unique(np.concatenate([kept if len(kept) else base, draw(random.integers(0, 1 + len(base) // 8))])))
        alike = exact_alike(80)(pa.table({"set": pa.array([s.tobytes() for s in sets], pa.large_binary())}))
        for i, own in enumerate(sets):
            assert alike(i).tolist() == [100 * len(np.intersect1d(s, own)) >= 80 * len(np.union1d(s, own)) for s in sets]
