"""Exact quantiles in passes, and averages scanned in ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, scores

FRACTIONS = [0, 0.05, 0.3, 0.5, 0.77, 1]


@pytest.mark.parametrize("small, cells", [(10_000, 64), (20, 8), (1, 2)])
def test_quantiles_like_a_whole_sort(spark, small, cells):
    rng = np.random.default_rng(0)
    groups = {
        "even": rng.uniform(size=700), "far": 10.0 ** rng.integers(-300, 300, size=500) * rng.choice([-1, 1], size=500), "hot": np.where(rng.uniform(size=600) < 0.9, 7.0, rng.normal(size=600)),
        None: rng.integers(0, 5, size=300).astype(float), "one": np.array([3.0]), "two": np.array([1.0, 2.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {(r["g"], r["fraction"]): r["value"] for r in ordered.quantiles(df, "v", FRACTIONS, ["g"], small, cells).collect()}
    assert got.keys() == {(g, float(f)) for g in groups for f in FRACTIONS}
    for g, vs in groups.items():
        assert [got[g, f] for f in FRACTIONS] == pytest.approx(np.quantile(vs, FRACTIONS).tolist(), rel=1e-12)


def test_passes_are_few(spark):
    df = spark.range(200_000).select(F.hash("id").cast("double").alias("v"))
    want = np.quantile(np.array([r["v"] for r in df.collect()]), [0.5, 0.9])
    assert [r["value"] for r in ordered.quantiles(df, "v", [0.5, 0.9], small=100).orderBy("fraction").collect()] == pytest.approx(want.tolist())
    assert ordered.quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_summary_by_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "lang string, rouge1_f double")
    assert {(r["lang"], r["median"], r["n"]) for r in scores.summarise(df, by=["lang"]).collect()} == {(None, 2.0, 2), ("a", 2.0, 1)}


def plainly(rows, alpha):
    out, s = {}, {}
    for g, t, v in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1], r[2] is not None, r[2])):
        s[g] = None if v is None else v if s.get(g) is None else alpha * v + (1 - alpha) * s[g]
        out.setdefault((g, t), []).append(s[g])
    return out


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_averages_like_a_fold(spark, parts):
    rng = np.random.default_rng(parts)
    rows = [(None if i % 7 == 3 else "ab"[i % 2], int(rng.integers(0, 400)), None if rng.uniform() < 0.1 else float(rng.normal())) for i in range(900)] + [("c", 1, None), ("d", 1, 5.0)]
    df = spark.createDataFrame(rows, "g string, t bigint, v double").repartition(3)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {}
        for r in ordered.smoothed(df, "v", "t", 0.2, "g").collect():
            got.setdefault((r["g"], r["t"]), []).append(r["ema"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want, key = plainly(rows, 0.2), lambda v: (v is not None, v)
    assert got.keys() == want.keys()
    for k in want:
        for a, b in zip(sorted(got[k], key=key), sorted(want[k], key=key), strict=True):
            assert a == pytest.approx(b, abs=1e-12) if b is not None else a is None


def test_a_long_series(spark):
    n = 1_000_000
    df = spark.range(n).select("id", (F.col("id") % 97).cast("double").alias("v"))
    got = ordered.smoothed(df, "v", "id", 0.01)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    s = None
    for i in range(n):
        s = float(i % 97) if s is None else 0.01 * (i % 97) + 0.99 * s
    assert got.where(f"id = {n - 1}").first()["ema"] == pytest.approx(s, rel=1e-9)
