"""Quality rules: base counts, and robust multivariate outliers by language and source; DataFrame functions only.

Each document gives a vector of transformed statistics. Per language and source a minimum-covariance-determinant fit
finds centre and scatter of the bulk. It goes out from three starts (medians and median deviations of the group; those of
its language; correlations of squashed deviations) and repeats concentration steps: keep the 75 % of vectors nearest by
Mahalanobis distance, estimate anew. After two steps the start with the smallest determinant goes on, until the determinant
settles; the smallest is kept, and one reweighting step follows. A document is rejected where its distance is beyond that of
nearly all clean ones. Equal vectors of a group count once in the fit, so copies can't become the bulk.

Every group has a fit of its own, of whatever size. Centre and scatter are shrunk towards those of the language, as if the
group had SHRINK_CENTRE and SHRINK_SCATTER more vectors there, and those of the language towards those of all: the fewer
vectors, the more. This is the regularised form of the estimate, and changes smoothly with a group's size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.llm import common

_SPACE = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "[#*$%&|<>]"
FEATURES = ("x1", "x2", "x3", "x4", "x5")
#: Least standard deviation taken for each feature: below it, differences mean nothing.
FLOOR = {"x1": 0.10, "x2": 0.05, "x3": 0.10, "x4": 0.06, "x5": 0.10}
CORE, FIRST_STEPS, MOST_STEPS, SETTLED = 0.75, 2, 10, 0.01
SHRINK_CENTRE, SHRINK_SCATTER = 10, 50
#: Of quantiles: their rank is off by at most one in so many, so they are exact in smaller groups.
ACCURACY = 10_000
#: Up to so many groups their parameters are broadcast (three rows of some 25 numbers each); beyond, joined by shuffling.
BROADCAST_GROUPS = 50_000
#: Probability that a clean Gaussian vector would be rejected: a limit of d2 = 30.9. Clean statistics have longer tails; the
#: limit is set from measured ones, and leaves 0.99 of the documents labelled clean (README).
REJECT = 1e-5


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function (series of the incomplete gamma function)."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_tail(x: float, k: int) -> float:
    """1 - chi2_cdf, without cancellation, for odd k."""
    z = x / 2
    total, term = math.erfc(math.sqrt(z)), math.exp(-z) * math.sqrt(z) / math.gamma(1.5)
    for i in range(1, k // 2 + 1):
        total += term
        term *= z / (i + 0.5)
    return total


def chi2_quantile(p: float, k: int, tail: bool = False) -> float:
    """The x with chi2_cdf(x, k) = p, or with chi2_tail(x, k) = p."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        if (chi2_tail(mid, k) > p) if tail else (chi2_cdf(mid, k) < p):
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each whole text, one row per row of ``docs``; a null text has none.

    A document's words, 3-word windows and window hashes are arrays of its own row: nothing is shuffled, and no lambda
    looks into anything but arrays that stand in a column already. Equal windows meet by sorting their 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    a = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.array_remove(F.split(text, _SPACE), "").alias("words"),
        F.regexp_count(text, F.lit(_SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        lines.alias("lines"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    windows = F.transform(F.slice("words", 1, F.size("words") - 2), lambda x, i: F.xxhash64(x, F.get("words", i + 1), F.get("words", i + 2)))
    b = a.select(
        "doc_id", "lang", "source", "n_symbols", "n_upper", "text_hash",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= 4, windows).alias("h"),
    )
    numbered = F.sort_array(F.arrays_zip(F.col("h").alias("h"), F.sequence(F.lit(0), F.size("h") - 1).alias("i")))
    c = b.withColumn("t", F.when(F.size(F.array_distinct("h")) < F.size("h"), numbered))
    twice = F.filter("t", lambda x, i: (F.get("t", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("t", F.greatest(i - 1, F.lit(0)))["h"] == x["h"])))
    d = c.withColumn("at", F.transform(twice, lambda x: x["i"]))
    in_windows = F.array_distinct(F.concat(F.col("at"), F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2)))
    return d.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("t").isNotNull(), F.size(in_windows)).otherwise(0).cast("long").alias("n_repeat_words"),
        "n_lines", "n_upper", "text_hash",
    )


def _features() -> dict[str, Column]:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "x2": F.sqrt(F.col("n_symbols") / chars),
        "x3": F.sqrt(F.col("n_repeat_words") / words),
        "x4": F.sqrt(F.col("n_upper") / chars),
        "x5": F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))),
    }


def _small(df: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(df) if groups <= BROADCAST_GROUPS else df


_P = len(FEATURES)
_MEAN = [f"m{i}" for i in range(_P)]
_LOW = {(i, j): f"l{i}{j}" for i in range(_P) for j in range(i + 1)}


def _with_distance(df: DataFrame) -> DataFrame:
    """d2, with each step of the substitution in a column of its own, so expressions stay small."""
    for i, x in enumerate(FEATURES):
        rest = F.col(x) - F.col(_MEAN[i])
        for j in range(i):
            rest = rest - F.col(_LOW[i, j]) * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", rest / F.col(_LOW[i, i]))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, _P)), F.col("z0") * F.col("z0")))


def _factor(df: DataFrame, cov) -> DataFrame:
    """``df`` with the Cholesky factor of the scatter cov(i, j), and the logarithm of its determinant."""
    for i, j in sorted(_LOW):
        value = cov(i, j) + F.lit(FLOOR[FEATURES[i]] ** 2 if i == j else 0.0)
        for k in range(j):
            value = value - F.col(_LOW[i, k]) * F.col(_LOW[j, k])
        # The floor keeps each pivot positive; rounding can't take more than a little of it.
        df = df.withColumn(_LOW[i, j], F.sqrt(F.greatest(value, F.lit(FLOOR[FEATURES[i]] ** 2 / 4))) if i == j else value / F.col(_LOW[j, j]))
    return df.withColumn("logdet", 2 * sum((F.log(F.col(_LOW[i, i])) for i in range(1, _P)), F.log(F.col(_LOW[0, 0]))))


def _estimate(near: DataFrame, consistent: float) -> DataFrame:
    """g, lg, s, mean, factor, logdet of each group and start from the vectors given, shrunk as the module says.

    ``consistent`` makes up for the scatter that was cut off with the vectors that are far.
    """
    cov = {(i, j): (F.covar_pop(FEATURES[i], FEATURES[j]) * consistent).alias(f"c{i}{j}") for i, j in _LOW}
    own = near.groupBy("g", "lg", "s").agg(F.count("*").alias("n"), *[F.avg(x).alias(_MEAN[i]) for i, x in enumerate(FEATURES)], *cov.values())
    own = common.materialise(own, "mcd")
    parts = [*_MEAN, *(f"c{i}{j}" for i, j in _LOW)]

    def pooled(to: str, *by: str) -> DataFrame:
        return own.groupBy(*by).agg(F.sum("n").alias(f"n_{to}"), *[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(f"{to}_{c}") for c in parts])

    def shrunk(c: str, n: str, of: str, to: str) -> Column:
        k = F.lit(float(SHRINK_CENTRE if c in _MEAN else SHRINK_SCATTER))
        return (F.col(n) * F.col(of + c) + k * F.col(to + c)) / (F.col(n) + k)

    every = pooled("all", "s").withColumnRenamed("s", "s_all")  # a row a start
    lang = pooled("lang", "lg", "s").join(F.broadcast(every), F.col("s") == F.col("s_all"))
    lang = lang.select(F.col("lg").alias("lg_of"), F.col("s").alias("s_of"), *[shrunk(c, "n_lang", "lang_", "all_").alias(f"to_{c}") for c in parts])
    out = own.join(lang, (F.col("lg") == F.col("lg_of")) & (F.col("s") == F.col("s_of")))
    out = out.select("g", "lg", "s", *[shrunk(c, "n", "", "to_").alias(c) for c in parts])
    return _factor(out, lambda i, j: F.col(f"c{i}{j}")).select("g", "lg", "s", *_MEAN, *_LOW.values(), "logdet")


def _middle(df: DataFrame, by: str) -> tuple[DataFrame, int]:
    """Median and 1.4826 times the median deviation (or the floor) of each feature, and for how many groups."""
    middle = common.materialise(df.groupBy(by).agg(*[F.percentile_approx(x, 0.5, ACCURACY).alias(f"a{i}") for i, x in enumerate(FEATURES)]), "mcd")
    n = middle.count()
    spread = df.join(_small(middle.withColumnRenamed(by, "of"), n), F.col(by) == F.col("of")).groupBy(by).agg(
        *[F.first(f"a{i}").alias(f"a{i}") for i in range(_P)], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"a{i}")), 0.5, ACCURACY).alias(f"d{i}") for i, x in enumerate(FEATURES)]
    )
    scale = [F.greatest(F.col(f"d{i}") * 1.4826, F.lit(FLOOR[x])).alias(f"d{i}") for i, x in enumerate(FEATURES)]
    return common.materialise(spread.select(by, *[f"a{i}" for i in range(_P)], *scale), "mcd"), n


def _starts(distinct: DataFrame) -> tuple[DataFrame, int]:
    """g, lg, s, mean, factor of the three starts of each group, and the number of groups."""
    groups = distinct.select("g", "lg").distinct()
    (own, n), (lang, n_lang) = _middle(distinct, "g"), _middle(distinct, "lg")
    zero = F.lit(0.0)
    plain = [*[F.col(f"a{i}").alias(_MEAN[i]) for i in range(_P)], *[(F.col(f"d{i}") if i == j else zero).alias(name) for (i, j), name in _LOW.items()]]
    first = groups.join(own, "g").select("g", "lg", F.lit(0).alias("s"), *plain)
    second = groups.join(_small(lang, n_lang), "lg").select("g", "lg", F.lit(1).alias("s"), *plain)
    # Squashed deviations have bounded weight, so their correlations are robust; the scales are those of the medians.
    squashed = distinct.join(_small(own.withColumnRenamed("g", "of"), n), F.col("g") == F.col("of"))
    squashed = squashed.select("g", "lg", *[F.col(f"a{i}") for i in range(_P)], *[F.col(f"d{i}") for i in range(_P)], *[F.tanh((F.col(x) - F.col(f"a{i}")) / F.col(f"d{i}")).alias(f"t{i}") for i, x in enumerate(FEATURES)])
    moments = squashed.groupBy("g", "lg").agg(*[F.first(f"{k}{i}").alias(f"{k}{i}") for k in "ad" for i in range(_P)], *[F.covar_pop(f"t{i}", f"t{j}").alias(f"v{i}{j}") for i, j in _LOW])
    root = lambda i, j: F.greatest(F.sqrt(F.col(f"v{i}{i}") * F.col(f"v{j}{j}")), F.lit(1e-12))
    third = moments.select("g", "lg", F.lit(2).alias("s"), *[F.col(f"a{i}").alias(_MEAN[i]) for i in range(_P)],
                           *[(F.col(f"d{i}") * F.col(f"d{j}") * (F.lit(1.0) if i == j else F.col(f"v{i}{j}") / root(i, j))).alias(f"c{i}{j}") for i, j in _LOW])
    third = _factor(third, lambda i, j: F.col(f"c{i}{j}")).select("g", "lg", "s", *_MEAN, *_LOW.values())
    return common.materialise(first.unionByName(second).unionByName(third), "mcd"), n


def _with_params(distinct: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """The distances of all vectors under the parameters of their groups, of which there are ``n``."""
    mine = params.withColumnRenamed("g", "of").drop("lg", "logdet", "settled")
    return _with_distance(distinct.join(_small(mine, n), F.col("g") == F.col("of")))


def _concentrate(distinct: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """One step: the nearest CORE of each group's vectors under ``params``, estimated anew."""
    far = _with_params(distinct, params, n)
    edge = far.groupBy("g", "s").agg(F.percentile_approx("d2", CORE, ACCURACY).alias("edge"))
    edge = common.materialise(edge.select(F.col("g").alias("g_of"), F.col("s").alias("s_of"), "edge"), "mcd")
    near = far.join(_small(edge, n), (F.col("g") == F.col("g_of")) & (F.col("s") == F.col("s_of"))).where(F.col("d2") <= F.col("edge") * (1 + 1e-9))
    return _estimate(near, CORE / chi2_cdf(chi2_quantile(CORE, _P), _P + 2))


def fit(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Centre and scatter per group ``g`` from the vectors x1.. of all rows, ``lg`` being its language: a row per group; and
    the number of groups.

    Of starts with equal determinants the first counts. No vectors give no rows.
    """
    distinct = common.materialise(vectors.select("g", "lg", *FEATURES).distinct(), "vectors")
    params, n = _starts(distinct)
    for _ in range(FIRST_STEPS):
        params = common.materialise(_concentrate(distinct, params, n), "mcd")
    best = params.groupBy("g", "lg").agg(F.min_by(F.struct(*_MEAN, *_LOW.values(), "logdet"), F.struct("logdet", "s")).alias("p"))
    best = common.materialise(best.select("g", "lg", F.lit(0).alias("s"), "p.*", F.lit(False).alias("settled")), "mcd")
    for _ in range(MOST_STEPS):
        then = _concentrate(distinct, best, n).select(F.col("g").alias("g_of"), F.struct(*_MEAN, *_LOW.values(), "logdet").alias("then"))
        was = F.struct(*_MEAN, *_LOW.values(), "logdet")
        on = F.col("settled") | (F.col("then.logdet") >= F.col("logdet"))
        done = on | (F.col("then.logdet") >= F.col("logdet") - SETTLED)
        best = best.join(_small(then, n), F.col("g") == F.col("g_of")).select("g", "lg", "s", F.when(on, was).otherwise(F.col("then")).alias("p"), done.alias("settled"))
        best = common.materialise(best.select("g", "lg", "s", "p.*", "settled"), "mcd")
        if not best.where("not settled").limit(1).count():
            break
    cut = chi2_quantile(0.975, _P)
    near = _with_params(distinct, best, n).where(F.col("d2") <= cut)
    better = common.materialise(_estimate(near, 0.975 / chi2_cdf(cut, _P + 2)).select("g", *_MEAN, *_LOW.values()), "mcd")
    # A group none of whose vectors is that near keeps the core's estimate.
    left = best.join(better.select("g"), "g", "left_anti").select("g", *_MEAN, *_LOW.values())
    return common.materialise(better.unionByName(left), "mcd"), n


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, the base counts, base_failed, kept, and d2 (null where the base rule fails).

    base_failed: under 50 words, or over half the words in repeated 3-word windows. The fit takes all other rows of the
    table. Null language or source is a group like any other. Null and empty texts fail the base rule. Repeated rows are
    judged each, alike; rows with null ids too. A distance at the limit is kept. An empty table gives no rows; other columns
    are ignored.
    """
    stats = common.materialise(statistics(docs, id_col, text_col), "statistics")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lang, source = (F.coalesce(F.concat(F.lit("="), c), F.lit("")) for c in ("lang", "source"))
    rows = stats.withColumn("base_failed", failed).withColumns(_features()).withColumns({"g": F.concat_ws("\u0001", lang, source), "lg": lang})
    good = rows.where("not base_failed")
    params, n = fit(good)
    mine = params.withColumnRenamed("g", "of")
    judged = _with_distance(rows.join(_small(mine, n), F.col("g") == F.col("of"), "left"))
    limit = chi2_quantile(REJECT, _P, tail=True)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= limit)).alias("kept"),
        d2.alias("d2"), "text_hash",
    )


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, all columns as they are. Rows are told apart by id and text."""
    gone = judge(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text"))
    gone = common.materialise(gone.distinct(), "rejected")
    same = docs[id_col].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs[text_col]) == gone["gone_text"])
    return docs.join(common.broadcast_small(gone), same, "left_anti")


def op10(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).drop("text_hash")
