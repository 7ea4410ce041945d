"""BERTScore: precision, recall and F1 of a generated text against its reference, from vectors of their tokens.

Each token of one side is matched greedily with the token of the other side whose vector is nearest by cosine; precision averages over
the generated text's tokens, recall over the reference's, weighted by the tokens' inverse document frequency among references. The
model that gives the vectors is the caller's. Pairs are independent, so the matching needs no shuffle: a pair's vectors are multiplied
in blocks of tokens within its task. Only document frequencies are counted over the table; weights travel without the vectors.

Defined results: a side without tokens, or without any vector of length, gives nulls; tokens whose vector is null, has no length or holds
null or non-finite parts are left out; where all weights are 0 (each token in every reference), all tokens weigh the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: tokens of one side that are held against the other at once, which bounds memory for long texts
BLOCK = 512
SCORES = ("bertscore_p", "bertscore_r", "bertscore_f1")


def document_frequencies(references: DataFrame, tokens: str) -> DataFrame:
    """token and idf of the tokens (an array column) of references, ln((N + 1) / (df + 1)); a row without an array is a reference, too."""
    n = references.agg(F.count(F.lit(1)).alias("n"))
    df = references.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n)).select("token", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))  # n is one row


def weighed(pairs: DataFrame, key: str, idf: DataFrame, n: Column, sides: tuple[str, str] = ("generated", "reference")) -> DataFrame:
    """With arrays of weights (generated_weights, reference_weights) for both sides' tokens (generated_tokens, reference_tokens). n: the
    number of references; a token that none has weighs ln(n + 1). The key must tell the rows apart."""
    out = pairs
    for side in sides:
        one = pairs.select(key, F.posexplode(f"{side}_tokens").alias("at", "token"))
        # frequent tokens are hot keys of this join; rows here are a token without its vector, and Spark splits such partitions
        have = one.join(idf, "token", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "idf"))).alias("w"))  # of one text
        out = out.join(have.select(key, F.transform("w", lambda x: F.coalesce(x["idf"], F.log(n + 1))).alias(f"{side}_weights")), key, "left")
    return out


def _vectors(values: list | None, weights: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the tokens that have one, and their weights."""
    values = values or []
    weights = [1.0] * len(values) if weights is None else weights
    kept = [(v, w) for v, w in zip(values, weights, strict=True) if v and not any(x is None for x in v)]
    if not kept:
        return np.zeros((0, 0)), np.zeros(0)
    v, w = np.array([v for v, _ in kept], np.float64), np.array([w for _, w in kept], np.float64)
    size = np.sqrt((v * v).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return v[good] / size[good, None], w[good]


def matched(generated: np.ndarray, reference: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """The greatest cosine of each token with any of the other side."""
    to_reference, to_generated = np.full(len(generated), -np.inf), np.full(len(reference), -np.inf)
    for i in range(0, len(generated), block):
        for j in range(0, len(reference), block):
            near = generated[i : i + block] @ reference[j : j + block].T
            np.maximum(to_reference[i : i + block], near.max(axis=1), out=to_reference[i : i + block])
            np.maximum(to_generated[j : j + block], near.max(axis=0), out=to_generated[j : j + block])
    return to_reference, to_generated


def _mean(values: np.ndarray, weights: np.ndarray) -> float:
    return float((values * weights).sum() / weights.sum()) if weights.sum() > 0 else float(values.mean())


def _scored(batches: Iterator[pa.RecordBatch], baselines: tuple[float, float, float], block: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for g, r, gw, rw in zip(*(batch.column(c) for c in ("generated", "reference", "generated_weights", "reference_weights"))):
            (a, wa), (b, wb) = _vectors(g.as_py(), gw.as_py()), _vectors(r.as_py(), rw.as_py())
            if not len(a) or not len(b):
                out.append((None,) * 3)
                continue
            to_b, to_a = matched(a, b, block)
            p, q = _mean(to_b, wa), _mean(to_a, wb)
            f = 2 * p * q / (p + q) if p + q else 0.0
            out.append(tuple((x - base) / (1 - base) for x, base in zip((p, q, f), baselines)))
        kept = [batch.column(i) for i, f in enumerate(batch.schema) if f.name == "key"]
        yield pa.RecordBatch.from_arrays([*kept, *[pa.array([x[i] for x in out], pa.float64()) for i in range(3)]], ["key", *SCORES])


def bert_scores(pairs: DataFrame, key: str, baselines: tuple[float, float, float] = (0.0, 0.0, 0.0), block: int = BLOCK) -> DataFrame:
    """key and the three scores of rows with arrays of vectors `generated` and `reference`, and, if there are, of weights
    (`weighed`). baselines: what a model gives to unrelated texts, taken to 0 as 1 stays 1."""
    weights = [F.col(c) if c in pairs.columns else F.lit(None).cast("array<double>").alias(c) for c in ("generated_weights", "reference_weights")]
    rows = pairs.select(F.col(key).alias("key"), "generated", "reference", *weights)
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, " + ", ".join(f"{c} double" for c in SCORES)
    return rows.mapInArrow(lambda it: _scored(it, baselines, block), schema).withColumnRenamed("key", key)
