"""Overlap metrics, score aggregates, paired comparisons, source attribution and the numbers behind figures."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import text as T
from ..settings import written
from .ordered import quantiles, smoothed  # noqa: F401  (smoothed is one of this module's names)
from .parse import display_name

#: numeric score columns that are summarised
METRICS = (
    "rouge1_f", "rouge2_f", "rougeL_f", "bertscore_p", "bertscore_r", "bertscore_f1", "judge_factual_accuracy", "judge_completeness", "judge_conciseness_style", "judge_legal_reasoning",
    "judge_overall",
)


def rouge_tokens(c: Column | str) -> Column:
    """Runs of ASCII letters and digits of the text in lower case."""
    return F.filter(F.split(F.lower(T._col(c)), "[^a-z0-9]+"), lambda w: w != "")


@F.pandas_udf(StructType([StructField(c, LongType()) for c in ("overlap", "n_pred", "n_ref")]))
def _clipped(prediction: pd.Series, reference: pd.Series, n: pd.Series) -> pd.DataFrame:
    rows = []
    for p, r, k in zip(prediction, reference, n, strict=True):
        a, b = (Counter(zip(*(t[i:] for i in range(k)), strict=False)) for t in ([] if p is None else list(p), [] if r is None else list(r)))
        rows.append((sum((a & b).values()), sum(a.values()), sum(b.values())))
    return pd.DataFrame(rows, columns=["overlap", "n_pred", "n_ref"])


def rouge_n(df: DataFrame, key: str, prediction: str, reference: str, n: int) -> DataFrame:
    """key, overlap, n_pred, n_ref and f of n-grams without stemming, counted within the row: nothing is shuffled."""
    out = df.select(key, _clipped(rouge_tokens(prediction), rouge_tokens(reference), F.lit(n)).alias("o")).select(key, "o.*")
    return out.withColumn("f", F.when(F.col("overlap") > 0, 2.0 * F.col("overlap") / (F.col("n_pred") + F.col("n_ref"))).otherwise(0.0))


_VOWELS = "aeiou"


def _measure(stem: str) -> int:
    """Vowel-consonant sequences of a stem."""
    shape = re.sub(r"(.)\1+", r"\1", "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem))))
    return shape.count("vc")


def _vowel(w: str, i: int) -> bool:
    return w[i] in _VOWELS or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    return len(w) > 2 and not _vowel(w, len(w) - 3) and _vowel(w, len(w) - 2) and not _vowel(w, len(w) - 1) and w[-1] not in "wxy"


# Suffixes of Porter (1980), steps 2, 3 and 4.
_STEP_2 = dict(pair.split(":") for pair in (
    "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous "
    "aliti:al iviti:ive biliti:ble"
).split())
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def porter(w: str) -> str:
    """Stem of a lower-case word after Porter (1980)."""
    if len(w) <= 2:
        return w
    for s, r in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(s):
            w = w[: len(w) - len(s)] + r
            break
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif (s := _longest(w, ("ed", "ing"))) and _has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP_2, _STEP_3):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    if (s := _longest(w, _STEP_4)) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if _measure(w) > 1 and w.endswith("ll"):
        w = w[:-1]
    return w


def _tokens(text: str) -> list[str]:
    return [porter(w) if len(w) > 3 else w for w in re.findall("[a-z0-9]+", text.lower())]


def _f1(hits: int, n: int, m: int) -> float:
    return 2 * hits / (n + m) if hits else 0.0


def _rows(a: list[str], where: dict[str, int], full: int, row: int) -> Iterator[int]:
    """The table of common subsequence lengths, row by row from `row` on, after Hyyro (2004): bit j of a row is 0 where the length
    grows from column j to j + 1."""
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _columns(b: list[str]) -> tuple[dict[str, int], int]:
    where: dict[str, bytearray] = {}
    for j, y in enumerate(b):
        where.setdefault(y, bytearray(len(b) // 8 + 1))[j >> 3] |= 1 << (j & 7)
    return {y: int.from_bytes(v, "little") for y, v in where.items()}, (1 << len(b)) - 1


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    known = set(a)
    places = [x for x in b if x in known]
    where, full = _columns(places)
    row = full
    for row in _rows(a, where, full, full):  # noqa: B007
        pass
    return len(places) - row.bit_count()


def _subsequence(a: list[str], b: list[str]) -> list[int]:
    """Places in a of one longest common subsequence: going back from the end, of two equal ways the one that leaves a's word.
    Only every k-th row of the table is held, and the rows in between of one stretch at a time."""
    where, full = _columns(b)
    step = isqrt(len(a)) + 1
    marks, row = [full], full
    for i, row in enumerate(_rows(a, where, full, full), 1):
        if i % step == 0:
            marks.append(row)
    out, i, j, held, first = [], len(a), len(b), [], 0
    grows = lambda r, k: not (held[r - first] >> k) & 1

    def hold(r: int) -> None:
        nonlocal held, first
        first = (r - 1) // step * step
        held = [marks[first // step], *_rows(a[first : first + step], where, full, marks[first // step])]

    while i and j:
        if not held or i - 1 < first:
            hold(i)
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
            continue
        # lengths of this row and the one above up to column j; they part by one at most
        low = (1 << j) - 1
        here, above = j - (held[i - first] & low).bit_count(), j - (held[i - 1 - first] & low).bit_count()
        while j and a[i - 1] != b[j - 1]:
            left = here - grows(i, j - 1)
            if left > above:
                above -= grows(i - 1, j - 1)
                here, j = left, j - 1
            else:
                i -= 1
                break
    return out[::-1]


def rouge(reference: str, prediction: str) -> tuple[float, float, float, float]:
    """F of stemmed ROUGE-1, -2, -L and -Lsum (Lin 2004): -Lsum takes, for each line of the reference, the union of its common
    subsequences with the lines of the prediction, each token counted at most as often as it occurs."""
    r, p = _tokens(reference), _tokens(prediction)
    out = []
    for grams in (lambda t: Counter(t), lambda t: Counter(pairwise(t))):
        a, b = grams(r), grams(p)
        out.append(_f1(sum((a & b).values()), sum(a.values()), sum(b.values())))
    out.append(_f1(_common(r, p), len(r), len(p)))
    left, right = ([_tokens(x) for x in t.split("\n") if x] for t in (reference, prediction))
    have, want, hits = Counter(w for x in left for w in x), Counter(w for x in right for w in x), 0
    for line in left:
        for i in sorted({i for other in right for i in _subsequence(line, other)}):
            w = line[i]
            if have[w] > 0 and want[w] > 0:
                hits, have[w], want[w] = hits + 1, have[w] - 1, want[w] - 1
    out.append(_f1(hits, sum(map(len, left)), sum(map(len, right))))
    return tuple(out)


@F.pandas_udf(StructType([StructField(c, DoubleType()) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum")]))
def rouge_scores(reference: pd.Series, prediction: pd.Series) -> pd.DataFrame:
    rows = [rouge(r or "", p or "") for r, p in zip(reference, prediction, strict=True)]
    return pd.DataFrame(rows, columns=["rouge1", "rouge2", "rougeL", "rougeLsum"])


def cosine(a: Column | str, b: Column | str) -> Column:
    """Of two vectors of equal length; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(T._col(x), T._col(y), lambda u, v: u.cast("double") * v), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))


def summarise(df: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ()) -> DataFrame:
    """mean, median, std (sample; 0 for one value), min, max and n by metric, nulls left out. Unrounded: round at the sink."""
    have = [m for m in metrics if m in df.columns]
    long = df.select(*by, *[F.col(m).cast("double").alias(m) for m in have]).unpivot(list(by), have, "metric", "value").where("value is not null")
    middle = quantiles(long, "value", [0.5], [*by, "metric"]).select(*[F.col(c).alias(f"__{c}") for c in (*by, "metric")], F.col("value").alias("median"))
    rest = long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n")
    )
    on = F.lit(True)
    for c in (*by, "metric"):
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rest.join(middle, on).select(*by, "metric", "mean", "median", "std", "min", "max", "n")


def paired(left: DataFrame, right: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Wins of either side and ties by metric over the keys that both have."""
    long = lambda d, name: d.select(key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot([key], list(metrics), "metric", name)
    both = long(left, "a").join(long(right, "b"), [key, "metric"])
    return both.groupBy("metric").agg(F.count_if(F.col("a") > F.col("b")).alias("left_wins"), F.count_if(F.col("a") < F.col("b")).alias("right_wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"))


#: least cosine of a sentence with its nearest chunk to be supported, and to have it as its primary source (our choice)
SUPPORTED, PRIMARY = 0.15, 0.35


#: words whose weights may be broadcast; products of words of sentences by chunks that are made at once; characters of a case's chunks that may be one row
WORDS, PRODUCTS, CHARS = 200_000, 2_000_000, 2_000_000


def weights(chunks: DataFrame) -> DataFrame:
    """w, idf of all words of the chunks, of all cases."""
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    df = chunks.select(F.explode(F.array_distinct(rouge_tokens("text"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("w", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # n is one row


def _weighed(sentences: DataFrame, chunks: DataFrame, key: str, idf: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Unit tf-idf vectors as rows (key, sid, w, x) and (key, cid, w, x). Document frequencies count chunks of all cases; a word that no
    chunk has is left out."""
    terms = lambda d, i: d.select(key, i, F.explode(rouge_tokens("text")).alias("w")).groupBy(key, i, "w").agg(F.count(F.lit(1)).alias("tf"))
    c, s = terms(chunks, "cid"), terms(sentences, "sid")
    idf = weights(chunks) if idf is None else idf

    def unit(d: DataFrame, i: str) -> DataFrame:
        x = d.join(idf, "w").withColumn("x", F.col("tf") * F.col("idf"))
        return x.withColumn("x", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key, i)))).drop("tf", "idf")  # of one text

    return written(unit(s, "sid"), "sentence-vectors"), written(unit(c, "cid"), "chunk-vectors")


def probes(s: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """One row a sentence: ts, its words that any chunk of the case has, with u, the most that a word can add to a cosine (its weight by the
    greatest that a chunk gives it), greatest first."""
    top = c.groupBy(key, F.col("w").alias("__w")).agg(F.max("x").alias("m")).withColumnRenamed(key, "__key")
    u = s.join(top, F.col(key).eqNullSafe(F.col("__key")) & (F.col("w") == F.col("__w")))
    return u.groupBy(key, "sid").agg(F.sort_array(F.collect_list(F.struct((F.col("x") * F.col("m")).alias("u"), "w", "x")), asc=False).alias("ts"))  # of one sentence


def _met(words: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Pairs (key, sid, cid) that share one of the words (key, sid, w)."""
    other = c.select(F.col(key).alias("__key"), F.col("w").alias("__w"), "cid")
    return words.join(other, F.col(key).eqNullSafe(F.col("__key")) & (F.col("w") == F.col("__w"))).select(key, "sid", "cid").distinct()


def _cosines(pairs: DataFrame, ts: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Pairs with their cosine, summed in the same order of words everywhere, so that equal chunks tie."""
    left = ts.select(F.col(key).alias("__k1"), F.col("sid").alias("__sid"), "ts")
    right = c.groupBy(F.col(key).alias("__k2"), F.col("cid").alias("__cid")).agg(F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))  # of one chunk
    both = pairs.join(left, F.col(key).eqNullSafe(F.col("__k1")) & (F.col("sid") == F.col("__sid"))).join(right, F.col(key).eqNullSafe(F.col("__k2")) & (F.col("cid") == F.col("__cid")))
    dot = F.aggregate("ts", F.lit(0.0), lambda a, t: a + t["x"] * F.coalesce(F.try_element_at("m", t["w"]), F.lit(0.0)))
    return both.select(key, "sid", "cid", dot.alias("cosine"))


def candidates(ts: DataFrame, c: DataFrame, key: str) -> DataFrame:
    """Pairs (key, sid, cid, cosine) that hold each sentence's nearest chunks: those that share its first word, and those that share one of
    the words without which the others together cannot reach the best of these. Words in nearly all chunks, which add little,
    meet no chunk."""
    first = written(_cosines(_met(ts.select(key, "sid", F.col("ts")[0]["w"].alias("w")), c, key), ts, c, key), "first-cosines")
    best = first.groupBy(F.col(key).alias("__k0"), F.col("sid").alias("__s0")).agg(F.max("cosine").alias("best"))
    known = ts.join(best, F.col(key).eqNullSafe(F.col("__k0")) & (F.col("sid") == F.col("__s0")))
    rest = F.aggregate(F.col("ts"), F.lit(0.0), lambda a, t: a + t["u"])
    # a word is needed if it and those after it could reach the best found; 1e-9 for the order of sums
    step = lambda a, t: F.struct((a["rest"] - t["u"]).alias("rest"), F.when(a["rest"] >= F.col("best") * (1 - 1e-9), F.array_append(a["ws"], t["w"])).otherwise(a["ws"]).alias("ws"))
    needed = F.aggregate("ts", F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("ws")), step)["ws"]
    words = known.select(key, "sid", F.explode(F.slice(needed, 2, F.greatest(F.size(needed) - 1, F.lit(0)))).alias("w"))
    seen = first.select(F.col(key).alias("__k0"), F.col("sid").alias("__s0"), F.col("cid").alias("__c0"))
    more = _met(words, c, key).join(seen, F.col(key).eqNullSafe(F.col("__k0")) & (F.col("sid") == F.col("__s0")) & (F.col("cid") == F.col("__c0")), "left_anti")
    return first.unionByName(_cosines(more, ts, c, key))


def _vectors(owner: np.ndarray, ids: np.ndarray, idf: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of n texts as (text, word, x), by text and word; of words with a weight."""
    known = ~np.isnan(idf[ids])
    places, tf = np.unique(owner[known] * len(idf) + ids[known], return_counts=True)
    o, w = np.divmod(places, len(idf))
    x = tf * idf[w]
    return o, w, x / np.sqrt(np.bincount(o, x * x, minlength=n))[o]


def _nearest_of(batch: pa.RecordBatch, key: str) -> pa.RecordBatch:
    """Each sentence's nearest chunk, of whole cases (key, cids, cts, sids, sts, ws, idfs)."""
    flat = lambda a: a.to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lambda a: flat(pc.list_value_length(a))
    each = lambda n: np.repeat(np.arange(len(n)), n)
    case_c, case_s = each(sizes(batch.column("cids"))), each(sizes(batch.column("sids")))
    cid, sid, texts_c, texts_s = (batch.column(c).flatten() for c in ("cids", "sids", "cts", "sts"))
    words_c, words_s, words = texts_c.flatten(), texts_s.flatten(), batch.column("ws").flatten()
    full = [x for x in (words_c, words_s, words) if len(x)]  # an empty array from Spark may have no offsets
    coded = pa.concat_arrays(full or [pa.array([], pa.string())]).dictionary_encode()
    ids, size = flat(coded.indices), max(1, len(coded.dictionary))
    idf = np.full(size, np.nan)
    idf[ids[len(words_c) + len(words_s) :]] = batch.column("idfs").flatten().to_numpy(zero_copy_only=False)
    co, cw, cx = _vectors(each(sizes(texts_c)), ids[: len(words_c)], idf, len(cid))
    so, sw, sx = _vectors(each(sizes(texts_s)), ids[len(words_c) : len(words_c) + len(words_s)], idf, len(sid))
    # chunks of the case that have a sentence's word; the sum of a pair runs over words in one order, so that equal chunks tie
    at = case_c[co] * size + cw
    order = np.argsort(at, kind="stable")
    at, want = at[order], case_s[so] * size + sw
    low = np.searchsorted(at, want)
    n = np.searchsorted(at, want, "right") - low
    met = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    pairs, place = np.unique(np.repeat(so, n) * max(1, len(cid)) + co[met], return_inverse=True)
    cosine = np.bincount(place, np.repeat(sx, n) * cx[met], minlength=len(pairs))
    s, c = np.divmod(pairs, max(1, len(cid)))
    cids = flat(cid)
    order = np.lexsort((cids[c], -cosine, s))
    s, first = np.unique(s[order], return_index=True)
    found, nearest, best = np.ones(len(sid), np.bool_), np.zeros(len(sid), np.int64), np.zeros(len(sid))
    found[s], nearest[s], best[s] = False, cids[c[order[first]]], cosine[order[first]]
    return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(case_s)), sid, pa.array(best), pa.array(nearest, mask=found)], [key, "sid", "cosine", "cid"])


def _nearest(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """So many cases at once as make PRODUCTS together."""
    for batch in batches:
        parts = np.cumsum(batch.column("products").to_numpy()) // PRODUCTS
        starts = np.flatnonzero(np.diff(parts, prepend=-1)).tolist()
        for i, j in zip(starts, [*starts[1:], batch.num_rows]):
            yield _nearest_of(batch.slice(i, j - i), key)


def _by_case(sentences: DataFrame, chunks: DataFrame, idf: DataFrame, key: str, parts: DataFrame) -> DataFrame:
    """(key, sid, cosine, cid) of cases that are gathered as one row each; of those in parts (__case, parts) the sentences are dealt over so
    many rows, each with all chunks of the case."""
    dealt = lambda d, p: d.join(parts, F.col(key).eqNullSafe(F.col("__case")), "left").withColumn("__p", p).drop("__case", "parts")
    n = F.coalesce("parts", F.lit(1))
    sentences, chunks = dealt(sentences, F.pmod(F.xxhash64("sid"), n).cast("int")), dealt(chunks, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    texts = lambda d, i: d.groupBy(key, "__p").agg(F.collect_list(F.struct(i, F.coalesce(rouge_tokens("text"), F.array().cast("array<string>")).alias("t"))).alias(i))  # noqa: E731  (of one case)
    of_row = F.col(key).eqNullSafe(F.col("__k")) & (F.col("__p") == F.col("__q"))
    c, s = texts(chunks, "cid").withColumnsRenamed({key: "__k", "__p": "__q"}), texts(sentences, "sid")
    both = s.join(c, of_row, "left")
    ids = lambda c: F.coalesce(F.col(c)[c].cast("array<bigint>"), F.array().cast("array<bigint>"))
    words = lambda c: F.coalesce(F.col(c)["t"], F.array().cast("array<array<string>>"))
    cases = written(both.select(key, "__p", ids("cid").alias("cids"), words("cid").alias("cts"), ids("sid").alias("sids"), words("sid").alias("sts")), "attributed-cases")
    each = cases.select(key, "__p", F.explode(F.array_distinct(F.concat(F.flatten("cts"), F.flatten("sts")))).alias("w"))
    known = each.join(idf, "w").groupBy(F.col(key).alias("__k"), F.col("__p").alias("__q")).agg(F.collect_list(F.struct("w", "idf")).alias("i"))  # of one case
    products = F.aggregate("sts", F.lit(0).cast("bigint"), lambda a, t: a + F.size(t)) * F.greatest(F.size("cids"), F.lit(1))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = cases.join(known, of_row, "left").select(
        key, "cids", "cts", "sids", "sts", F.coalesce(F.col("i")["w"], none("string")).alias("ws"), F.coalesce(F.col("i")["idf"], none("double")).alias("idfs"), products.alias("products")
    )
    kind = lambda d, c: d.schema[c].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _nearest(it, key), f"`{key}` {kind(sentences, key)}, sid bigint, cosine double, cid bigint")
    return out.withColumns({"sid": F.col("sid").cast(kind(sentences, "sid")), "cid": F.col("cid").cast(kind(chunks, "cid"))})


def attribute(sentences: DataFrame, chunks: DataFrame, key: str, products: int = PRODUCTS, chars: int = CHARS) -> DataFrame:
    """For each sentence (key, sid, text) its nearest chunk (key, cid, text) of the same case by tf-idf cosine, the least cid of equals, and
    whether that is its PRIMARY or a SUPPORTING source or none. A case is gathered as one row; if its sentences' words times its chunks
    are more than about `products`, in parts of its sentences. Words of cases whose chunks have more than `chars` characters are joined."""
    sentences, chunks = written(sentences, "sentences"), written(chunks, "chunks")
    idf = written(weights(chunks), "weights")
    idf = F.broadcast(idf) if idf.count() <= WORDS else idf
    length = F.coalesce(F.sum(F.length("text") + 1), F.lit(0))
    sizes = chunks.groupBy(key).agg(length.alias("c"), F.count(F.lit(1)).alias("n"), F.lit(0).alias("s")).unionByName(sentences.groupBy(key).agg(F.lit(0).alias("c"), F.lit(0).alias("n"), length.alias("s")))
    sizes = sizes.groupBy(F.col(key).alias("__case")).agg(F.sum("c").alias("c"), F.sum("n").alias("n"), F.sum("s").alias("s"))
    parts = F.ceil(F.greatest(F.col("s").cast("double") * F.col("n") / (6.0 * products), F.col("s") / 1e6, F.lit(1.0)))  # six characters a word
    large = written(sizes.select("__case", (F.col("c") > chars).alias("joined"), parts.alias("parts")).where("joined or parts > 1"), "large-cases")
    parted = large.where("not joined").select("__case", "parts")
    if large.where("joined").isEmpty():
        return _supported(_by_case(sentences, chunks, idf, key, parted))
    joined, of_case = large.where("joined").select("__case"), F.col(key).eqNullSafe(F.col("__case"))
    few, many = ([d.join(joined, of_case, how) for d in (sentences, chunks)] for how in ("left_anti", "left_semi"))
    return _supported(_by_case(*few, idf, key, parted).unionByName(_by_words(*many, idf, key)))


def _by_words(sentences: DataFrame, chunks: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, sid, cosine, cid) of cases of any size, through joins of words."""
    s, c = _weighed(sentences, chunks, key, idf)
    near = candidates(written(probes(s, c, key), "probes"), c, key)
    best = near.groupBy(F.col(key).alias("__k"), F.col("sid").alias("__s")).agg(F.max("cosine").alias("cosine"), F.max_by("cid", F.struct("cosine", -F.col("cid"))).alias("cid"))
    out = sentences.select(key, "sid").join(best, F.col(key).eqNullSafe(F.col("__k")) & (F.col("sid") == F.col("__s")), "left").drop("__k", "__s").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))
    return out.select(key, "sid", "cosine", "cid")


def _supported(out: DataFrame) -> DataFrame:
    return out.withColumn("support", F.when(F.col("cosine") >= PRIMARY, "PRIMARY").when(F.col("cosine") >= SUPPORTED, "SUPPORTING").otherwise("UNSUPPORTED"))


def coverage(attributed: DataFrame, key: str) -> DataFrame:
    """Shares of a case's sentences that are PRIMARY, and that are supported at all, averaged over cases, in percent."""
    share = lambda c: F.avg(c.cast("double"))
    per = attributed.groupBy(key).agg(share(F.col("support") == "PRIMARY").alias("p"), share(F.col("support") != "UNSUPPORTED").alias("s"))
    return per.agg((100 * F.avg(F.coalesce("p", F.lit(0.0)))).alias("primary_pct"), (100 * F.avg(F.coalesce("s", F.lit(0.0)))).alias("supported_pct"))


def distribution(df: DataFrame, value: str, *ties: str) -> DataFrame:
    """Rows with the place of their value in order, in percent: ties take different places, in order of the columns `ties`. Values
    are counted first and rows ranked within their value, so that no task orders all rows."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    # running counts over ranges of values: within each, and of those before it (one number a range)
    ranged = counts.repartitionByRange(F.col(value)).withColumn("__range", F.spark_partition_id())
    inner = ranged.withColumn("__before", F.sum("__n").over(Window.partitionBy("__range").orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, -1)))
    totals = ranged.groupBy("__range").agg(F.sum("__n").alias("__t"))
    totals = totals.select("__range", F.sum("__t").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__base"), F.sum("__t").over(Window.partitionBy()).alias("__all"))
    start = inner.join(totals, "__range").select(F.col(value).alias("__v"), (F.coalesce("__before", F.lit(0)) + F.coalesce("__base", F.lit(0))).alias("__start"), "__all")
    rank = F.row_number().over(Window.partitionBy(value).orderBy(*(ties or (F.lit(0),))))
    placed = df.withColumn("__rank", rank).join(start, F.col(value).eqNullSafe(F.col("__v")))
    return placed.withColumn("cdf", 100.0 * (F.col("__start") + F.col("__rank")) / F.col("__all")).drop("__rank", "__v", "__start", "__all")


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """Counts by bin [edge, next edge), the last open; and their share."""
    bin_of = F.lit(0)
    for i, e in enumerate(edges):
        bin_of = F.when(F.col(value) >= e, i).otherwise(bin_of)
    counts = df.where(F.col(value).isNotNull()).groupBy(bin_of.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()))


def percentiles(df: DataFrame, value: str, points: int = 21) -> DataFrame:
    """Exact percentiles at evenly spaced points, with linear interpolation."""
    got = quantiles(df, value, [i / (points - 1) for i in range(points)])
    return got.select((100.0 * F.round(F.col("fraction") * (points - 1)) / (points - 1)).alias("pct"), "value")


def spaced(bins: DataFrame, low: str, high: str, n: str) -> DataFrame:
    """n evenly spaced samples, ends included, for each bin."""
    step = (F.col(high) - F.col(low)) / F.greatest(F.col(n) - 1, F.lit(1))
    return bins.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n).cast("bigint") - 1)).alias("i")).withColumn("x", F.col(low) + F.col("i") * step)


def sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the least hash of key and seed: the same rows on any cluster, in the order of the hash."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return df.orderBy(h, key).limit(n)


def latest(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Of rows with one key the last in order of seq."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows still to be done."""
    return todo.join(done.select(key), key, "left_anti")


def resumed(done: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old results, and new ones for keys without any, in order."""
    return done.unionByName(pending(new, done, key), allowMissingColumns=True).orderBy(key)


def cited(citations: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Citations (key, s, sentence, chunks, grounded), one row for each chunk cited, with the chunk's (key, index) type and text;
    chunks that do not exist stay with nulls."""
    each = citations.select(key, "s", "sentence", "grounded", F.explode_outer("chunks").alias("index"))
    return each.join(chunks, [key, "index"], "left")


def with_sources(evals: DataFrame, sources: DataFrame) -> DataFrame:
    """Evaluation records (index, prediction, ...) with case_id, case_name and chunks of the source of the same line; without one,
    the record's own id and name if it has them, else its number and its prediction's first sentence, and no chunks."""
    s = sources.select(F.col("line").alias("__line"), F.col("case_id").alias("__id"), F.col("case_name").alias("__name"), F.col("chunks").alias("__chunks"))
    own = lambda c: F.col(c).cast("string") if c in evals.columns else F.lit(None).cast("string")
    both = evals.join(s, F.col("index") == F.col("__line"), "left")
    return both.withColumns(
        {
            "case_id": T.or_else("__id", F.coalesce(own("case_id"), F.col("index").cast("string"))), "case_name": display_name("__name", own("case_name"), F.coalesce("prediction", F.lit("")), F.col("index")),
            "chunks": F.coalesce("__chunks", F.array().cast(dict(s.dtypes)["__chunks"])),
        }
    ).drop("__line", "__id", "__name", "__chunks")


def rounded(df: DataFrame, digits: int = 4, *columns: str) -> DataFrame:
    """Numbers as sinks have them: rounded half to even. All double columns unless some are named."""
    names = columns or tuple(c for c, kind in df.dtypes if kind in ("double", "float"))
    return df.withColumns({c: F.bround(F.col(c).cast("double"), digits) for c in names})


def judged(df: DataFrame, overall: str = "overall", grounded: str = "grounded") -> DataFrame:
    """One row: mean judge score over scores above 0, and sentences that no source grounds (an array of booleans a record)."""
    open_sentences = F.size(F.filter(F.coalesce(F.col(grounded), F.array().cast("array<boolean>")), lambda g: ~g))
    return df.agg(F.avg(F.when(F.col(overall) > 0, F.col(overall))).alias("mean_score"), F.sum(open_sentences).alias("ungrounded"))


def spending(df: DataFrame) -> DataFrame:
    """One row of a run's totals: records, those done, cut prompts, cost, mean words of predictions and references."""
    done = F.col("prediction").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(done).alias("done"), F.count_if(F.col("truncated")).alias("truncated"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        (F.coalesce(F.sum(F.when(done, T.n_words("prediction"))), F.lit(0)) / F.greatest(F.count_if(done), F.lit(1))).alias("mean_words"),
    )


def cost_estimate(df: DataFrame, prompt: str, price_in: float, price_out: float, limit: int = 700_000, reply: int = 1000, samples: int = 50) -> DataFrame:
    """One row: what a run would cost before it is made. Prompts count up to their limit, replies for a fixed number of samples."""
    tokens = F.floor(F.sum(F.least(F.length(prompt), F.lit(limit))) / 4)
    return df.agg(tokens.alias("tokens_in"), F.lit(reply * samples).alias("tokens_out"), (tokens * price_in / 1e6 + reply * samples * price_out / 1e6).alias("cost"))
