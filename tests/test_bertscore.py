import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import bertscore


def plainly(g, r, wg=None, wr=None):
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    wg, wr = wg or [1] * len(g), wr or [1] * len(r)
    p = sum(w * max(cos(a, b) for b in r) for a, w in zip(g, wg)) / sum(wg)
    q = sum(w * max(cos(a, b) for a in g) for b, w in zip(r, wr)) / sum(wr)
    return p, q, 2 * p * q / (p + q)


def test_like_plain_matching(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=(rng.integers(1, 40), 8)).tolist(), rng.normal(size=(rng.integers(1, 40), 8)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, generated array<array<double>>, reference array<array<double>>")
    for block in (1, 7, 512):
        got = {r["id"]: tuple(r)[1:] for r in bertscore.bert_scores(df, "id", block=block).collect()}
        assert all(got[i] == pytest.approx(plainly(g, r)) for i, g, r in rows)
    base = {r["id"]: r["bertscore_p"] for r in bertscore.bert_scores(df, "id", baselines=(0.5, 0.5, 0.5)).collect()}
    assert base[3] == pytest.approx((plainly(*rows[3][1:])[0] - 0.5) / 0.5)


def test_weights_of_references(spark):
    rows = [(1, ["a", "b", "x"], ["a", "c"]), (2, ["a"], ["a", "a", "b"]), (3, ["q"], None)]
    df = spark.createDataFrame(rows, "id int, generated_tokens array<string>, reference_tokens array<string>")
    idf = bertscore.document_frequencies(df, "reference_tokens")
    assert {r["token"]: r["idf"] for r in idf.collect()} == pytest.approx({"a": math.log(4 / 3), "b": math.log(2), "c": math.log(2)})
    got = {r["id"]: (r["generated_weights"], r["reference_weights"]) for r in bertscore.weighed(df, "id", idf, F.lit(3)).collect()}
    assert got[1][0] == pytest.approx([math.log(4 / 3), math.log(2), math.log(4)]) and got[2][1] == pytest.approx([math.log(4 / 3)] * 2 + [math.log(2)]) and got[3][1] is None


def test_edges(spark):
    v, zero, odd = [1.0, 0.0], [0.0, 0.0], [float("nan"), 1.0]
    rows = [(1, [v], None), (2, [], [v]), (3, [zero, odd, None, [None, 1.0]], [v]), (4, [v, zero], [v, odd]), (5, [v] * 1500, [v] * 700)]
    df = spark.createDataFrame(rows, "id int, generated array<array<double>>, reference array<array<double>>")
    got = {r["id"]: tuple(r)[1:] for r in bertscore.bert_scores(df.withColumn("key", F.lit(0)), "id").collect()}
    assert got[1] == got[2] == got[3] == (None,) * 3 and got[4] == got[5] == pytest.approx((1.0, 1.0, 1.0))
    weights = df.where("id = 5").withColumns({f"{s}_weights": F.transform(s, lambda _: F.lit(0.0)) for s in ("generated", "reference")})
    assert bertscore.bert_scores(weights, "id").first()["bertscore_f1"] == pytest.approx(1.0)
    assert bertscore.bert_scores(df.limit(0), "id").count() == 0
