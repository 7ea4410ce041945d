"""Operator 8: robust multivariate outliers among document statistics (native: DataFrame functions only).

Every document gets a vector of transformed statistics. For each language and source, the minimum covariance determinant
estimate (Rousseeuw & Van Driessen 1999, deterministic start after Hubert et al. 2012) gives a centre and a scatter; a
document whose Mahalanobis distance lies beyond the cut is rejected. All passes are grouped sums over a small written
table; the h-subset of a group is found by a mergeable quantile of its distances, so that no group meets in one task.

Defined results: a null or empty text has no words and fails the base rule; null lang or source form groups of their own;
groups under `min_group` rows take the estimate of all rows together; equal rows get equal verdicts; an empty table gives
an empty result; columns besides doc_id, text, lang and source are ignored by `statistics` and kept by `keep_quality`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Params:
    min_words: int = 50
    max_repeat: float = 0.5
    #: share of a group's rows that the determinant is minimised over
    support: float = 0.75
    #: concentration steps after the start
    steps: int = 4
    #: rows a group needs for an estimate of its own
    min_group: int = 200
    #: squared distance beyond which a document is rejected. Good documents' statistics have heavier tails than a normal
    #: distribution: its 0.999 quantile (20.5) would reject 1.5 % of the 3,243 documents of the 0.1 GB table that pass the base
    #: rules and are labelled good. None of these lies beyond 60; all 291 that are labelled bad lie beyond 200
    cut: float = 120.0
    #: accuracy of the quantiles (relative rank error 1/accuracy)
    accuracy: int = 2000


#: Transformed statistics, and the least standard deviation that each is taken to have: most documents have neither
#: symbols nor repeats, which would make the scatter singular.
FEATURES = {"x_len": 0.5, "x_chars": 0.1, "x_symbols": 0.3, "x_lines": 0.5, "x_repeat": 0.5}


def statistics(df: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (long) of column text.

    Windows of three words are compared by a 64-bit hash. Positions of repeated windows are marked by membership where
    few windows repeat, else by one sort of (hash, position), so that the cost stays near-linear in the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    one = (
        df.withColumn("__w", common.words(F.col("text")))
        .withColumn("n_words", F.size("__w").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"))
        .withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
        .withColumn(
            "__h",
            F.when(
                F.size("__w") >= 3,
                F.transform(F.slice("__w", 1, F.greatest(F.size("__w") - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(F.col("__w"), i + 1), F.get(F.col("__w"), i + 2))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array("__h")).otherwise(F.array().cast("array<bigint>")))
        .withColumn("__d", F.array_distinct(F.filter("__s", lambda x, i: x == F.get(F.col("__s"), i + 1))))
    )
    # where many windows repeat: sorted (hash, position), a window repeats if a neighbour has its hash
    pairs = F.array_sort(F.transform("__h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    two = one.withColumn("__p", F.when(F.size("__d") > 24, pairs))
    many = F.transform(
        F.filter(F.col("__p"), lambda x, i: (x["h"] == F.get(F.col("__p"), i + 1)["h"]) | ((i > 0) & (x["h"] == F.get(F.col("__p"), F.greatest(i - 1, F.lit(0)))["h"]))),
        lambda x: x["i"],
    )
    few = F.filter(F.transform("__h", lambda x, i: F.when(F.array_contains(F.col("__d"), x), i)), lambda i: i.isNotNull())
    at = F.when(F.size("__d") == 0, F.array().cast("array<int>")).when(F.size("__d") <= 24, few).otherwise(F.sort_array(many))
    three = two.withColumn("__at", at)
    # marked windows i cover words i, i+1, i+2: each adds the words up to the next marked window, three at most
    covered = F.aggregate(
        F.transform("__at", lambda i, k: F.least(F.lit(3), F.coalesce(F.get(F.col("__at"), k + 1) - i, F.lit(3)))), F.lit(0), lambda a, b: a + b
    )
    return three.withColumn("n_repeat_words", covered.cast("long")).drop("__w", "__lines", "__h", "__s", "__d", "__p", "__at")


def _features(df: DataFrame) -> DataFrame:
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return df.withColumns(
        {
            "x_len": F.log(n),
            "x_chars": F.log((F.col("word_chars") + 1) / n),
            "x_symbols": F.log1p(1000 * F.col("n_symbols") / chars),
            "x_lines": F.log1p(F.col("n_dup_lines")),
            "x_repeat": F.log1p(100 * F.col("n_repeat_words") / n),
        }
    )


def _moments(prefix: str = "") -> list[Column]:
    x = list(FEATURES)
    return [F.count(F.lit(1)).alias("m_n"), *[F.avg(c).alias(f"mu_{c}") for c in x], *[F.avg(F.col(a) * F.col(b)).alias(f"ss_{a}_{b}") for i, a in enumerate(x) for b in x[i:]]]


def _factor(stats: DataFrame, scale: Column) -> DataFrame:
    """Means and the rows of L in scatter = L D L', from moments; the scatter is multiplied by the consistency factor and
    keeps at least the least variances."""
    x = list(FEATURES)
    cov = {(a, b): F.col(f"ss_{a}_{b}") - F.col(f"mu_{a}") * F.col(f"mu_{b}") for i, a in enumerate(x) for b in x[i:]}
    out = stats.withColumns({f"c_{a}_{b}": scale * v + (F.lit(FEATURES[a] ** 2) if a == b else F.lit(0.0)) for (a, b), v in cov.items()})
    for j, a in enumerate(x):
        d = F.col(f"c_{a}_{a}")
        for k in x[:j]:
            d = d - F.col(f"l_{a}_{k}") * F.col(f"l_{a}_{k}") * F.col(f"d_{k}")
        out = out.withColumn(f"d_{a}", F.greatest(d, F.lit(1e-9)))
        for b in x[j + 1 :]:
            v = F.col(f"c_{a}_{b}")
            for k in x[:j]:
                v = v - F.col(f"l_{b}_{k}") * F.col(f"l_{a}_{k}") * F.col(f"d_{k}")
            out = out.withColumn(f"l_{b}_{a}", v / F.col(f"d_{a}"))
    keep = [c for c in stats.columns if not c.startswith(("mu_", "ss_", "m_n"))]
    return out.select(*keep, "m_n", *[f"mu_{a}" for a in x], *[f"d_{a}" for a in x], *[f"l_{b}_{a}" for j, a in enumerate(x) for b in x[j + 1 :]])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    x, y, total = list(FEATURES), {}, F.lit(0.0)
    for j, a in enumerate(x):
        v = F.col(a) - F.col(f"mu_{a}")
        for k in x[:j]:
            v = v - F.col(f"l_{a}_{k}") * y[k]
        y[a] = v
        total = total + v * v / F.col(f"d_{a}")
    return total


def mcd(vectors: DataFrame, keys: list[str], p: Params) -> DataFrame:
    """One row a group with its MCD centre and factored scatter; `vectors` has the keys and the features and should be a
    written table, as it is read once a step."""
    dim = len(FEATURES)
    # start: coordinate-wise medians and MADs
    med = vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("m_n"), *[F.percentile_approx(c, 0.5, p.accuracy).alias(f"mu_{c}") for c in FEATURES])
    mad = common.small_join(vectors, med, keys).groupBy(*keys).agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"mu_{c}")), 0.5, p.accuracy).alias(f"q_{c}") for c in FEATURES])
    est = common.small_join(med, mad, keys)
    x = list(FEATURES)
    est = est.select(
        *keys, "m_n", *[f"mu_{a}" for a in x], *[(F.pow(1.4826 * F.col(f"q_{a}"), 2) + FEATURES[a] ** 2).alias(f"d_{a}") for a in x],
        *[F.lit(0.0).alias(f"l_{b}_{a}") for j, a in enumerate(x) for b in x[j + 1 :]],
    )
    est = common.written(est, "mcd-start")
    # consistency factor of the covariance of the nearest `support` share under normality: support / P(chi2(dim+2) <= q)
    factor = p.support / _chi2_cdf(dim + 2, _chi2_quantile(dim, p.support))
    for _ in range(p.steps):
        far = common.small_join(vectors, est, keys).select(*keys, *x, _distance().alias("__d2"))
        radius = far.groupBy(*keys).agg(F.percentile_approx("__d2", p.support, p.accuracy).alias("__r"))
        subset = common.small_join(far, common.written(radius, "mcd-radius"), keys).where(F.col("__d2") <= F.col("__r"))
        est, old = common.written(_factor(subset.groupBy(*keys).agg(*_moments()), F.lit(factor)), "mcd-step"), est
        common.forget(old)
    return est


def _chi2_cdf(k: int, x: float) -> float:
    """Lower regularised gamma by its series."""
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = a
    for _ in range(1000):
        n += 1
        term *= z / n
        total += term
        if term < total * 1e-15:
            break
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def _chi2_quantile(k: int, q: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mid == 0 or _chi2_cdf(k, mid) < q else (lo, mid)
    return hi


def verdicts(stats: DataFrame, p: Params = Params()) -> DataFrame:
    """Adds base_failed, distance2 and kept to a (written) table with lang, source and the five statistics."""
    base = (F.col("n_words") < p.min_words) | (100 * F.col("n_repeat_words") > 100 * p.max_repeat * F.col("n_words"))
    rows = stats.withColumn("base_failed", base)
    # a group's key is null where the group is small; such rows are judged by the estimate of all rows
    sizes = common.written(rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("__n")), "mcd-sizes")
    keyed = common.small_join(_features(rows), sizes, ["lang", "source"])
    group = F.when(F.col("__n") >= p.min_group, F.to_json(F.struct("lang", "source")))
    keyed = keyed.withColumn("__g", F.coalesce(group, F.lit("*"))).drop("__n")
    sound = keyed.where(~F.col("base_failed")).select("__g", *FEATURES)
    own = mcd(sound.where(F.col("__g") != "*"), ["__g"], p)
    everything = mcd(sound.select(F.lit("*").alias("__g"), *FEATURES), ["__g"], p)
    est = common.written(own.unionByName(everything).drop("m_n"), "mcd-final")
    judged = common.small_join(keyed, est, ["__g"]).withColumn("distance2", _distance())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance2"), F.lit(0.0)) <= p.cut)
    return judged.withColumn("kept", kept).select(*stats.columns, "base_failed", "distance2", "kept")


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and distance2 of every row."""

    def work() -> DataFrame:
        stats = common.written(statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality-stats")
        return verdicts(stats, p).select("doc_id", *STATS, "base_failed", "kept", "distance2")

    return common.settled(work, "quality-result")


def keep_quality(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that the rules keep, unchanged: those without a rejected row of the same id, text and group."""
    key = [F.col("doc_id"), F.xxhash64("text", "lang", "source")]
    full = statistics(docs.select("text", "lang", "source", key[0].alias("__id"), key[1].alias("__key"))).drop("text")
    rejected = common.settled(lambda: verdicts(common.written(full, "quality-stats"), p).where(~F.col("kept")).select("__id", "__key").distinct(), "quality-rejected")
    packed = docs.select(F.struct("*").alias("row"), key[0].alias("row_id"), key[1].alias("row_key"))
    # by merge at every size: the list of rejected rows grows with the input
    return packed.join(rejected.hint("merge"), F.col("row_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__key")), "left_anti").select("row.*")
