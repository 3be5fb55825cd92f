"""Plain, slow versions of what the operators compute, and tables of odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or return.
CLASHING = (
    "id row n fp size kept score lang_pred component_id n_lines bitmap taken target source_size pattern h label words file kind part extra k order doc lo hi at "
    "_ld_doc _ld_row _ld_bitmap _mx_pattern _size _copy _id _row n_tokens n_words g_lang g_source x0 held_out predicted _li_text block page cluster bucket"
).split()
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while the small grey cat sleeps near the old warm stove in the kitchen"
ODD = [
    (1, None, None, None), (2, "", "en", "web"), (3, " \n\t \x0b", "en", "web"), (None, PASSAGE, None, "web"), (None, None, "de", None),
    (4, LONG, "en", "books"), (5, LONG, "en", "books"), (6, "!!! 123 ...", "fr", ""), (7, "é ü ß 漢字 😀 \U0010ffff\x00 z", "de", "web"),
    (8, PASSAGE, "en", "web"), (8, PASSAGE, "en", "web"), (9, PASSAGE + " tonight", "en", None), (8, "another text under the same id", "en", "web"),
    (-3, "x", "en", "web"), (10, "A B\nA B c d e f\n\n" * 30, "fr", "web"), (11, "<|endoftext|> a <|endoftext|>", "en", "code"), (2**62, "y" * 5000, "en", "web"),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], SCHEMA)


def with_clashes(docs):
    return docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])


def documents(spark, sf):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def line_dedup(rows, least=10):
    """{(id, text): (n_lines, n_dropped, kept text)}; rows: (id, text), a null id after all others."""
    key = lambda line: line.strip(SPACES).translate(LOWER)
    rank = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(rank(i))
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == rank(i)]
        out[i, text] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def shingles(text, k):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def near_groups(rows, k, percent=80):
    """{id: (n_shingles, smallest id of its group)}; rows: (id, text) with ids that differ."""
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    classes = defaultdict(list)
    for i, s in sets.items():
        if s:
            classes[frozenset(s)].append(i)
    for own in classes.values():
        for i in own:
            a, b = find(i), find(own[0])
            root[max(a, b)] = min(a, b)
    found = list(classes)
    holders = defaultdict(list)
    for at, s in enumerate(found):
        for x in s:
            holders[x].append(at)
    common = Counter((a, b) for own in holders.values() for n, a in enumerate(own) for b in own[n + 1 :])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(found[a]) + len(found[b]) - c):
            x, y = find(classes[found[a]][0]), find(classes[found[b]][0])
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(words) - 4):
        windows[tuple(words[i : i + 5])].append(i)
    covered = {i + j for places in windows.values() if len(places) > 1 for i in places for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


FLOORS = np.array([0.08, 0.4, 0.4, 0.5])


def _estimate(x, prior, k=20):
    """Mean, covariance and median squared distance of a group's MCD; ``prior`` (mean, moments) adds k documents to each half."""

    def moments(half):
        n = max(len(half) + (k if prior else 0), 1)
        total, square = half.sum(axis=0) / 1024, (half.T @ half) / 1024**2
        if prior:
            total, square = total + k * prior[0], square + k * prior[1]
        mean = total / n
        return mean, square / n - np.outer(mean, mean) + np.diag(FLOORS**2)

    def classes(mean, cov):
        z = np.linalg.solve(np.linalg.cholesky(cov), (x / 1024 - mean).T)
        return np.floor(np.log(np.maximum((z**2).sum(axis=0), 1e-12)) * 256)

    middle = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - middle), axis=0) / 1024, FLOORS)
    found = []
    for mean, cov in ((middle / 1024, np.diag(spread**2)), moments(x)):
        least = math.inf
        while True:
            c = classes(mean, cov)
            new = moments(x[c <= np.floor(np.median(c))])
            root = math.sqrt(np.linalg.det(new[1]))
            if not root < least * (1 - 1e-4):
                break
            least, (mean, cov) = root, new
        found.append((least, mean, cov))
    _, mean, cov = min(found, key=lambda f: f[0])
    return mean, cov, math.exp(np.median(classes(mean, cov)) / 256)


def quality_verdicts(rows):
    """{id: (kept, squared distance over its cut)}; rows: (id, text, lang, source) with ids that differ."""
    groups, out = defaultdict(list), {}
    for i, text, lang, source in rows:
        n, chars, symbols, lines, repeats = quality(text)
        out[i] = (False, None)
        if n >= 10 and 100 * repeats <= 20 * n:
            c = max(chars, 1)
            x = [math.log(c / n), math.log1p(100 * symbols / c), math.log1p(100 * lines / n), math.log1p(100 * repeats / n)]
            groups[lang, source].append((i, [math.floor(v * 1024 + 0.5) for v in x]))
    every = np.array([x for own in groups.values() for _, x in own], np.int64)
    mean, cov, common = _estimate(every, None)
    prior = (mean, cov - np.diag(FLOORS**2) + np.outer(mean, mean))
    for own in groups.values():
        x = np.array([v for _, v in own], np.int64)
        mean, cov, middle = _estimate(x, prior)
        scale = max((len(own) * middle + 20 * common) / (len(own) + 20) / 3.3567, 1.0)
        z = np.linalg.solve(np.linalg.cholesky(cov), (x / 1024 - mean).T)
        for (i, _), d in zip(own, (z**2).sum(axis=0) / scale, strict=True):
            out[i] = (bool(d <= 18.467), d / 18.467)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
