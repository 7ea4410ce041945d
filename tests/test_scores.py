import pytest
from pyspark.sql import functions as F

from millrace.operators import scores


@pytest.mark.parametrize(("w", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("happy", "happi"), ("sky", "sky"), ("generalizations", "gener"), ("agreed", "agre"), ("controlling", "control")])
def test_porter(w, stem):
    assert scores.porter(w) == stem


def test_rouge():
    r1, r2, rl, rs = scores.rouge("the cat sat on the mat", "the cat was on a mat")
    assert r1 == pytest.approx(8 / 12) and r2 == pytest.approx(2 / 10) and rl == pytest.approx(8 / 12) and rs == rl
    assert scores.rouge("a b\nc d", "c d\na b")[3] == 1.0 and scores.rouge("a b\nc d", "c d\na b")[2] == 0.5
    assert scores.rouge("", "a") == (0, 0, 0, 0)


def test_subsequences_like_the_whole_table():
    """Rows held as bits, a stretch at a time, give the places that the full table of lengths gives."""
    import random

    def whole(a, b):
        rows = [[0] * (len(b) + 1)]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[j]))
            rows.append(row)
        out, i, j = [], len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out, i, j = [i - 1, *out], i - 1, j - 1
            elif rows[i][j - 1] > rows[i - 1][j]:
                j -= 1
            else:
                i -= 1
        return out

    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcdefgh"[: rng.choice([2, 3, 8])]) for _ in range(rng.randrange(40))] for _ in range(2))
        assert scores._subsequence(a, b) == whole(a, b) and scores._common(a, b) == len(whole(a, b))
    long = [str(rng.randrange(3000)) for _ in range(20_000)]
    assert scores._common(long, long[:200]) == 200 and len(scores._subsequence(long, long[-300:])) == 300


def test_sources_of_records(spark):
    evals = spark.createDataFrame([(0, "c0", "A first sentence. More."), (1, None, "Abc"), (2, "c2", None)], "index int, case_id string, prediction string")
    sources = spark.createDataFrame([(2, "s2", "Doe v. Roe", [(1, "x")])], "line bigint, case_id string, case_name string, chunks array<struct<index:int,text:string>>")
    got = {r["index"]: (r["case_id"], r["case_name"], len(r["chunks"])) for r in scores.with_sources(evals, sources).collect()}
    assert got == {0: ("c0", "A first sentence", 0), 1: ("1", "Case 1", 0), 2: ("s2", "Doe v. Roe", 1)}


def test_rouge_n_is_the_unstemmed_count(spark):
    df = spark.createDataFrame([(1, "a b a c", "a a a d"), (2, "", "x"), (3, "q", "z")], "k int, p string, r string")
    got = {r["k"]: (r["overlap"], r["n_pred"], r["n_ref"]) for r in scores.rouge_n(df, "k", "p", "r", 1).collect()}
    assert got == {1: (2, 4, 4), 2: (0, 0, 1), 3: (0, 1, 1)}


def test_summary_of_one_value(spark):
    r = scores.summarise(spark.createDataFrame([(0.5, None)], "rouge1_f double, rouge2_f double")).collect()
    assert len(r) == 1 and r[0]["std"] == 0.0 and r[0]["n"] == 1


def test_attribution(spark):
    c = spark.createDataFrame([(1, 1, "the dog barked at night"), (1, 2, "ships sail over the sea")], "k int, cid int, text string")
    s = spark.createDataFrame([(1, 1, "the dog barked at night"), (1, 2, "nothing alike"), (1, 3, "")], "k int, sid int, text string")
    got = {r["sid"]: (r["cid"], r["support"]) for r in scores.attribute(s, c, "k").collect()}
    assert got == {1: (1, "PRIMARY"), 2: (None, "UNSUPPORTED"), 3: (None, "UNSUPPORTED")}
    assert scores.coverage(scores.attribute(s, c, "k"), "k").first()["primary_pct"] == pytest.approx(100 / 3)


def test_series_and_samples(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "step int, loss double")
    assert [round(r["ema"], 3) for r in scores.smoothed(df, "loss", "step", 0.1).orderBy("step").collect()] == [1.0, 1.1, 1.29]
    assert sorted(r["cdf"] for r in scores.distribution(spark.createDataFrame([(1,), (1,)], "x int"), "x").collect()) == [50.0, 100.0]
    many = spark.range(997).select((F.col("id") * 7919 % 101).alias("x"), "id").repartition(5)
    got = [r["id"] for r in scores.distribution(many, "x", "id").orderBy("cdf").collect()]
    assert got == [r["id"] for r in many.orderBy("x", "id").collect()]
    assert [r["value"] for r in scores.percentiles(df, "loss", 3).collect()] == [1.0, 2.0, 3.0]
    a, b = (scores.sample(spark.range(1000), "id", 5, 1).collect() for _ in range(2))
    assert a == b and len(a) == 5
    assert scores.resumed(df.where("step = 1"), df, "step").count() == 3 and scores.latest(df.withColumn("k", F.lit(1)), "k", "step").first()["loss"] == 3.0
