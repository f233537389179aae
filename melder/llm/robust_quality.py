"""Quality rules by robust multivariate outliers (operator 7), in DataFrame functions alone.

Fixed rules come first; on what passes them, each (lang, source) gets a minimum-covariance-
determinant estimate of a vector of transformed text statistics, and rows far from it by
Mahalanobis distance are rejected.

The estimate runs concentration steps from two starts (medians with quartile scales, and plain
moments) and keeps the one with the smaller determinant. A step needs no sort and no gathered
group: rows are summed per (group, start, bin of distance), and the bins nearest the centre,
the last of them in part, make up the share H of the group. Rows within a quantile of it then
make the final estimate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from melder.llm.common import written

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
H = 0.75
STEPS = 3
MIN_GROUP = 60  # smaller groups are estimated together: by language, then all of them
#: The vector, with the spread that is always allowed (added to the covariance's diagonal).
STATS = ("length", "word_length", "punctuation", "symbols", "dup_lines", "repeats")
ALLOWED = (0.5, 0.06, 0.12, 0.3, 0.7, 0.7)
D = len(STATS)


def _chi2_cdf(x: float, d: int) -> float:
    """Of an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2))


def _chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, d) < p else (low, mid)
    return low


def _consistency(h: float, d: int) -> float:
    """What the covariance of the central share h must be multiplied by under normality."""
    return h / _chi2_cdf(_chi2_quantile(h, d), d + 2)


#: Rows within this quantile of the squared distance make the final estimate, and those beyond
#: the cutoff's are rejected, for normal statistics.
REWEIGHTED = 0.975
CUTOFF = _chi2_quantile(0.999, D)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_punct."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    has_word = r"[^\x20\x09-\x0D]"
    docs = docs.withColumn("__t", t).withColumn("__w", F.filter(F.split("__t", SPACE + "+"), lambda w: w != ""))
    docs = docs.withColumn("__lines", F.filter(F.split("__t", "\n"), lambda x: x.rlike(has_word)))
    docs = docs.withColumn("n_words", F.size("__w").cast("long")).withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w))).drop("__w")
    docs = docs.withColumn("__tri", F.expr("case when n_words < 3 then cast(array() as array<bigint>) else transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(get(__h, i), get(__h, i + 1), get(__h, i + 2))) end")).drop("__h")
    docs = docs.withColumn("__s", F.sort_array("__tri"))
    docs = docs.withColumn("__again", F.expr("exists(sequence(1, greatest(size(__s) - 1, 1)), i -> get(__s, i) = get(__s, i - 1))")).drop("__s")
    # only texts in which some window comes again pay for positions
    docs = docs.withColumn("__p", F.expr("case when __again then array_sort(transform(__tri, (x, i) -> struct(x, i))) end")).drop("__tri", "__again")
    docs = docs.withColumn("__at", F.expr("sort_array(transform(filter(sequence(0, size(__p) - 1), k -> get(__p, k).x <=> get(__p, k - 1).x or get(__p, k).x <=> get(__p, k + 1).x), k -> get(__p, k).i))")).drop("__p")
    covered = "aggregate(sequence(0, size(__at) - 1), 0L, (n, k) -> n + least(3, coalesce(get(__at, k + 1) - get(__at, k), 3)))"
    return docs.select(
        *[c for c in docs.columns if not c.startswith("__") and c != "n_words"],
        "n_words",
        F.length(F.regexp_replace("__t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"case when __at is null then 0L else {covered} end").alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.length("__t") - F.length(F.regexp_replace("__t", r"[!-/:-@\[-`{-~]", ""))).cast("long").alias("n_punct"),
    )


def _vector() -> list[Column]:
    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return [
        F.log(F.greatest(F.col("n_words"), F.lit(1)).cast("double")),
        F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.5))),
        F.log1p(100 * share("n_punct", "word_chars")),
        F.log1p(1000 * share("n_symbols", "word_chars")),
        F.log1p(100 * share("n_dup_lines", "n_lines")),
        F.log1p(100 * share("n_repeat_words", "n_words")),
    ]


def _ij() -> list[tuple[int, int]]:
    return [(i, j) for i in range(D) for j in range(i + 1)]


def _whitened(est: DataFrame) -> DataFrame:
    """group, start, m0.., w{i}_{j} (the inverse of the covariance's Cholesky factor) and logdet."""
    for i in range(D):
        for j in range(i + 1):
            rest = F.col(f"s{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            est = est.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(ALLOWED[i] ** 2 * 1e-6))) if i == j else rest / F.col(f"l{j}_{j}"))
    for i in range(D):
        est = est.withColumn(f"w{i}_{i}", 1 / F.col(f"l{i}_{i}"))
        for j in range(i):
            s = sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)), F.lit(0.0))
            est = est.withColumn(f"w{i}_{j}", -s / F.col(f"l{i}_{i}"))
    logdet = sum((2 * F.log(F.col(f"l{i}_{i}")) for i in range(D)), F.lit(0.0))
    return est.select("g_lang", "g_source", "start", logdet.alias("logdet"), *[f"m{i}" for i in range(D)], *[f"w{i}_{j}" for i, j in _ij()])


def _moments(weight: Column, scale: float) -> list[Column]:
    """Mean and covariance from sums n, a{i}, b{i}_{j} taken with `weight`."""
    n = F.sum(weight * F.col("n"))
    mean = [F.sum(weight * F.col(f"a{i}")) / n for i in range(D)]
    cov = [((F.sum(weight * F.col(f"b{i}_{j}")) / n - mean[i] * mean[j]) * scale + (ALLOWED[i] ** 2 if i == j else 0.0)).alias(f"s{i}_{j}") for i, j in _ij()]
    return [*[m.alias(f"m{i}") for i, m in enumerate(mean)], *cov]


def _sums() -> list[Column]:
    return [F.count("*").cast("double").alias("n"), *[F.sum(f"x{i}").alias(f"a{i}") for i in range(D)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"b{i}_{j}") for i, j in _ij()]]


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(D):
        y = sum((F.col(f"w{i}_{j}") * (F.col(f"x{j}") - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    return total


def _starts(rows: DataFrame) -> DataFrame:
    """Both starts of each group in one pass."""
    key = ["g_lang", "g_source"]
    quart = [F.percentile_approx(f"x{i}", [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(D)]
    base = rows.groupBy(*key).agg(*_sums(), *quart)
    one = F.lit(1.0)
    plain = base.groupBy(*key).agg(*_moments(one, 1.0)).withColumn("start", F.lit(0))
    robust = base.select(
        *key,
        *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(D)],
        *[(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) + ALLOWED[i] ** 2 if i == j else F.lit(0.0)).alias(f"s{i}_{j}") for i, j in _ij()],
    ).withColumn("start", F.lit(1))
    return plain.unionByName(robust)


def _join(rows: DataFrame, est: DataFrame) -> DataFrame:
    return rows.join(est, ["g_lang", "g_source"])


def estimates(rows: DataFrame) -> DataFrame:
    """One estimate for each (g_lang, g_source) of rows(g_lang, g_source, x0..)."""
    from pyspark.sql import Window

    est = written(_whitened(_starts(rows)), "estimates")
    key = ["g_lang", "g_source", "start"]
    ahead = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(STEPS):
        binned = _join(rows, est).withColumn("bin", F.floor(16 * F.log2(1 + _distance())).cast("int"))
        sums = binned.groupBy(*key, "bin").agg(*_sums())
        # a few hundred bins a group, however many rows it has
        sums = sums.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0.0))).withColumn("all", F.sum("n").over(Window.partitionBy(*key)))
        weight = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.ceil(H * F.col("all")) - F.col("before")) / F.col("n")))
        est = written(_whitened(sums.groupBy(*key).agg(*_moments(weight, _consistency(H, D)))), "estimates")
    best = est.groupBy("g_lang", "g_source").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    near = _join(rows, est.join(best, key, "left_semi")).where(_distance() <= _chi2_quantile(REWEIGHTED, D))
    return written(_whitened(near.groupBy(*key).agg(*_sums()).groupBy(*key).agg(*_moments(F.lit(1.0), _consistency(REWEIGHTED, D)))), "estimates")


def _groups(base: DataFrame) -> DataFrame:
    """(k_lang, k_source, g_lang, g_source): where the rows of a language and source are estimated."""
    n = base.where("not base_failed").groupBy("k_lang", "k_source").agg(F.count("*").alias("n"))
    by_lang = n.where(F.col("n") < MIN_GROUP).groupBy("k_lang").agg(F.sum("n").alias("m"))
    own, together = F.col("n") >= MIN_GROUP, F.coalesce(F.col("m"), F.lit(0)) >= MIN_GROUP
    any_ = F.lit("any")
    return n.join(by_lang, "k_lang", "left").select(
        "k_lang", "k_source", F.when(own | together, F.col("k_lang")).otherwise(any_).alias("g_lang"), F.when(own, F.col("k_source")).otherwise(any_).alias("g_source")
    )


def judge(docs: DataFrame) -> DataFrame:
    """The columns of docs but for text, then the statistics, base_failed, distance and kept.

    docs has text, lang and source. base_failed: fewer than 50 words, or more than half of the
    words in repeated windows. The others are kept if their squared distance from the estimate of
    their language and source is at most CUTOFF. A null lang or source is a value of its own.
    Null and empty texts have no words and fail. Languages and sources with fewer than MIN_GROUP
    rows are estimated together. Repeated rows count as often as they occur. Columns of docs
    that carry a name of the result give way to it.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_punct", "base_failed", "distance", "kept")
    own = [c for c in docs.columns if c not in made and c != "text"]
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    named = docs.select(*[F.col(c).alias(f"own_{i}") for i, c in enumerate(own)], F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    stats = statistics(named).withColumn("base_failed", failed).withColumns({"k_lang": tag("lang"), "k_source": tag("source")})
    base = written(stats.select(*[f"own_{i}" for i in range(len(own))], "k_lang", "k_source", *made[:8], *[x.alias(f"x{i}") for i, x in enumerate(_vector())]), "statistics")
    groups = written(_groups(base), "groups")
    placed = base.join(groups, ["k_lang", "k_source"], "left")
    est = estimates(placed.where("not base_failed").select("g_lang", "g_source", *[f"x{i}" for i in range(D)]))
    far = placed.join(est, ["g_lang", "g_source"], "left").withColumn("distance", F.coalesce(_distance(), F.lit(0.0)))
    return far.select(*[F.col(f"own_{i}").alias(c) for i, c in enumerate(own)], *made[:8], "distance", (~F.col("base_failed") & (F.col("distance") <= CUTOFF)).alias("kept"))
