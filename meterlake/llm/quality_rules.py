"""Quality rules: robust multivariate outliers, with DataFrame functions only.

Statistics of each text become a vector of transformed rates. For each language and source, a
minimum-covariance-determinant estimate is found by concentration steps from two starts: distances
under the current estimate, the half of the group with the smallest distances, their mean and
covariance, again until no determinant falls any more; the start that ends with the smaller determinant stays.
Documents far out by Mahalanobis distance are rejected.

To each half belong ``PRIOR`` documents made up after the estimate over all documents: their moments are added
to the half's. So a group of any size has an estimate of its own that differs from the common one as far as its
documents say, and a step still never raises the determinant.

Texts are read once; the vectors (a few numbers a document) are written to the shared folder, and all
later steps aggregate them. Groups are only ever summed (partial sums before the shuffle), never gathered.
Vectors are whole numbers of a 1,024th and half-sets are cut between classes of distances, so sums and
medians are exact, of bounded size, and the same however rows lie. A group's estimate is a handful of
numbers, joined back by broadcast if the groups are counted to be few. The Cholesky factor of the covariance
is written out as column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import cut, small

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Concentration steps end when no group's determinant falls by more than this share.
SETTLED = 1e-4
#: Documents like all others that are added to a group's half.
PRIOR = 20
#: Squared distances are divided by the group's median one over this, the median of chi-squared with 4 degrees.
CHI2_MEDIAN = 3.3567
#: A document is rejected beyond this scaled squared distance, the 0.999 quantile of chi-squared with 4 degrees.
MAX_DISTANCE = 18.467
MAX_GROUPS = 20_000
#: Vectors count in parts of one; classes of distances are so many to a factor of e.
PARTS, CLASSES = 1024, 256
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
DIMS = ("x0", "x1", "x2", "x3")


def word_array(text: Column) -> Column:
    """The runs of characters other than ASCII white space; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(bare) > 0, F.split(bare, r"\s+")).otherwise(F.expr("cast(array() as array<string>)"))


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _covered() -> str:
    """SQL for the number of words inside windows whose hash occurs twice or more; n log n in the text's words."""
    twins = "flatten(zip_with(s, slice(s, 2, size(s)), (a, b) -> if(b is not null and a.h = b.h, array(a.i, b.i), cast(array() as array<int>))))"
    spread = f"aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (x, y) -> x + y)"
    ordered = "array_sort(transform(_qr_windows, (h, i) -> named_struct('h', h, 'i', i)))"
    return _let(_let(ordered, "s", f"array_sort(array_distinct({twins}))"), "p", spread)


def with_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the five statistics of its text.

    Repeated windows are found inside the row: window hashes (64 bits) are compared as a set first,
    and only a text with repeats sorts them with their places.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    out = docs.withColumn("_qr_words", word_array(F.col(text_col)))
    out = out.withColumn(
        "_qr_windows",
        F.expr(f"if(size(_qr_words) > {WINDOW}, transform(sequence(1, size(_qr_words) - {WINDOW - 1}), i -> xxhash64(slice(_qr_words, i, {WINDOW}))), cast(array() as array<bigint>))"),
    )
    repeated = f"""if(size(_qr_windows) = size(array_distinct(_qr_windows)), 0L, {_covered()})"""
    return out.withColumns(
        {
            "n_words": F.size("_qr_words").cast("long"),
            "word_chars": F.coalesce(F.length(F.array_join("_qr_words", "")), F.lit(0)).cast("long"),
            "n_symbols": F.length(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.expr(repeated),
        }
    ).drop("_qr_words", "_qr_windows")


def _vector() -> dict[str, Column]:
    """Log mean word length; logs of symbols per 100 characters, and of repeated lines and words per 100 words."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "x0": F.log(chars / words),
        "x1": F.log1p(100 * F.col("n_symbols") / chars),
        "x2": F.log1p(100 * F.col("n_dup_lines") / words),
        "x3": F.log1p(100 * F.col("n_repeat_words") / words),
    }


#: Spreads whose squares are added to an estimate's variances, so that a group in which most texts have a rate of 0 doesn't reject the others.
FLOORS = (0.08, 0.4, 0.4, 0.5)
_PAIRS = [(i, j) for i in range(4) for j in range(i + 1)]
_PARAMS = [*(f"m{i}" for i in range(4)), *(f"l{i}{j}" for i, j in _PAIRS)]


def _distance(s: str) -> str:
    """SQL for the squared Mahalanobis distance under start ``s``: forward substitution by the Cholesky factor."""
    z: list[str] = []
    for i, x in enumerate(DIMS):
        known = "".join(f" - {s}l{i}{j} * {z[j]}" for j in range(i))
        z.append(f"(({x} / {PARTS} - {s}m{i}{known}) / {s}l{i}{i})")
    return " + ".join(f"{x} * {x}" for x in z)


def _class(s: str) -> str:
    """SQL for the class of a distance under start ``s``."""
    return f"cast(floor(ln(greatest({_distance(s)}, 1e-12D)) * {CLASSES}) as int)"


def _factored(sums: DataFrame, starts: str, prior: dict | None) -> DataFrame:
    """Means, Cholesky factor of the ridged covariance and its determinant's root, from each start's sums and the prior's moments; a column of the factor at a time."""
    k = PRIOR if prior else 0
    size = lambda s: f"greatest({s}n + {k}, 1)"
    mean = lambda s, i: f"(coalesce({s}s{i}, 0) / {PARTS} + {k * prior[f'm{i}'] if prior else 0.0!r}D) / {size(s)} as {s}m{i}"
    out = sums.selectExpr("*", *(mean(s, i) for s in starts for i in range(4)))

    def entry(s: str, i: int, j: int) -> str:
        value = f"(coalesce({s}s{i}{j}, 0) / {PARTS * PARTS} + {k * prior[f'c{i}{j}'] if prior else 0.0!r}D) / {size(s)} - {s}m{i} * {s}m{j}"
        known = "".join(f" - {s}l{i}{x} * {s}l{j}{x}" for x in range(j))
        if i != j:
            return f"({value}{known}) / {s}l{j}{j} as {s}l{i}{j}"
        return f"sqrt(greatest(greatest({value}, 0D) + {FLOORS[i] ** 2!r}D{known}, {(0.1 * FLOORS[i]) ** 2!r}D)) as {s}l{i}{j}"

    for j in range(4):
        out = out.selectExpr("*", *(entry(s, j, j) for s in starts))
        if j < 3:
            out = out.selectExpr("*", *(entry(s, i, j) for s in starts for i in range(j + 1, 4)))
    return out.selectExpr("*", *(f"{s}l00 * {s}l11 * {s}l22 * {s}l33 as {s}det" for s in starts))


def _sums(s: str) -> list[Column]:
    """Aggregates of start ``s`` over the rows marked ``{s}in``; whole numbers, so exact for up to 2 * 10^10 documents."""
    only = lambda c, name: F.expr(f"sum(if({s}in, {c}, 0L)) as {name}")
    return [
        F.expr(f"count_if({s}in) as {s}n"),
        *(only(DIMS[i], f"{s}s{i}") for i in range(4)),
        *(only(f"{DIMS[i]} * {DIMS[j]}", f"{s}s{i}{j}") for i, j in _PAIRS),
    ]


_GROUP = ["g_lang", "g_source"]
_STATE = [f"{s}{c}" for s in "ab" for c in (*_PARAMS, "det")]


def estimates(vectors: DataFrame, prior: dict | None = None) -> DataFrame:
    """Per group (g_lang, g_source): the estimate m0.., l00.., the number n of its rows and the median q of their distances, from rows with x0..x3.

    ``prior`` has the means m0.. and second moments c00.. of what is added to each half.
    """
    median = lambda c, name: F.expr(f"percentile({c}, 0.5) as {name}")  # noqa: E731 - exact; a group has as many distinct values as there are classes
    few = vectors.select(*_GROUP).distinct().limit(MAX_GROUPS + 1).count() <= MAX_GROUPS

    def joined(params: DataFrame, *columns: str) -> DataFrame:
        return vectors.join(F.broadcast(params) if few else params, _GROUP).selectExpr(*_GROUP, *columns)

    whole = vectors.selectExpr(*_GROUP, *DIMS, "true as bin")
    first = cut(_factored(whole.groupBy(*_GROUP).agg(*_sums("b"), *(median(x, f"med{i}") for i, x in enumerate(DIMS))), "b", prior))
    spread = joined(first, *(f"abs({x} - med{i}) as far{i}" for i, x in enumerate(DIMS))).groupBy(*_GROUP).agg(*(median(f"far{i}", f"mad{i}") for i in range(4)))
    begin = [f"med{i} / {PARTS} as am{i}" for i in range(4)] + [f"greatest(1.4826D * mad{i} / {PARTS}, {FLOORS[i]!r}D) as al{i}{i}" for i in range(4)] + [f"0D as al{i}{j}" for i, j in _PAIRS if i != j]
    params = cut(first.drop("bdet").join(spread, _GROUP).selectExpr("*", *begin, "double('inf') as adet", "double('inf') as bdet", "true as moved").select(*_GROUP, *_STATE, "moved"))
    # a group moves only while its determinant falls by a fixed share, and floors keep that above 0, so all settle
    while True:
        # groups that have settled keep their estimate and are left out of the sums
        live = params.filter("moved").drop("moved")
        radius = joined(live, *(f"{_class(s)} as {s}c" for s in "ab")).groupBy(*_GROUP).agg(*(F.expr(f"floor(percentile({s}c, 0.5)) as {s}q") for s in "ab"))
        near = joined(live.join(radius, _GROUP), *DIMS, *(f"{_class(s)} <= {s}q as {s}in" for s in "ab"))
        new = _factored(near.groupBy(*_GROUP).agg(*(c for s in "ab" for c in _sums(s))), "ab", prior).selectExpr(*_GROUP, *(f"{c} as new_{c}" for c in _STATE))
        both = params.join(new, _GROUP, "left").selectExpr("*", *(f"coalesce(new_{s}det < {s}det * {1 - SETTLED!r}D, false) as fell_{s}" for s in "ab"))
        params = cut(both.selectExpr(*_GROUP, *(f"if(fell_{c[0]}, new_{c}, {c}) as {c}" for c in _STATE), "fell_a or fell_b as moved"))
        if params.filter("moved").isEmpty():
            break
    best = params.selectExpr(*_GROUP, *(f"if(adet <= bdet, a{c}, b{c}) as {c}" for c in _PARAMS))
    middle = joined(best, f"{_class('')} as c").groupBy(*_GROUP).agg(F.expr(f"exp(percentile(c, 0.5) / {CLASSES}) as q"), F.count("*").alias("n"))
    return cut(best.join(middle, _GROUP))


def _moments(estimate: dict) -> dict:
    """Means and second moments of an estimate, without the ridge's part."""
    low = [[estimate.get(f"l{i}{j}", 0.0) if j <= i else 0.0 for j in range(4)] for i in range(4)]
    out = {f"m{i}": estimate[f"m{i}"] for i in range(4)}
    for i, j in _PAIRS:
        spread = sum(low[i][k] * low[j][k] for k in range(4))
        out[f"c{i}{j}"] = (max(spread - FLOORS[i] ** 2, 0.0) if i == j else spread) + out[f"m{i}"] * out[f"m{j}"]
    return out


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", max_distance: float = MAX_DISTANCE) -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    A null or empty text has no words and fails the base rules. A null language or source is a group
    of its own. Estimates are over all documents that pass the base rules; ``distance`` is null for the others.
    Null ids and repeated rows pass through (each row counts), other columns aren't read, an empty table
    gives no rows.
    """
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    stats = with_stats(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), named(lang_col).alias("g_lang"), named(source_col).alias("g_source")), "text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    whole = {x: F.floor(c * PARTS + 0.5).cast("bigint") for x, c in _vector().items()}
    rows = cut(stats.select("id", "g_lang", "g_source", *STATS).withColumns({"base_failed": failed, **whole}))
    vectors = rows.filter("not base_failed").select(*_GROUP, *DIMS)
    common = estimates(vectors.withColumns({g: F.lit("all") for g in _GROUP})).first()
    own = estimates(vectors, _moments(common.asDict())) if common else vectors.limit(0).select(*_GROUP, *(F.lit(0.0).alias(c) for c in (*_PARAMS, "q", "n")))
    middle = common.q if common else CHI2_MEDIAN
    params = own.withColumn("scale", F.greatest((F.col("n") * F.col("q") + PRIOR * middle) / (F.col("n") + PRIOR) / CHI2_MEDIAN, F.lit(1.0)))
    out = rows.join(small(params, MAX_GROUPS), _GROUP, "left").withColumn("distance", F.when(~F.col("base_failed"), F.expr(f"({_distance('')}) / scale")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= max_distance, F.lit(True))
    return out.select(F.col("id").alias(id_col), *STATS, "base_failed", kept.alias("kept"), "distance")
