"""The nearest source of each sentence, found through few words."""

import math
import random
import re
from collections import Counter

import pytest

from millrace.operators import scores


def plainly(sentences, chunks):
    tokens = lambda t: Counter(w for w in re.split("[^a-z0-9]+", t.lower()) if w)
    df = Counter(w for *_, t in chunks for w in tokens(t))
    idf = {w: math.log((1 + len(chunks)) / (1 + n)) + 1 for w, n in df.items()}
    vec = lambda t: {w: n * idf[w] for w, n in tokens(t).items() if w in idf}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for k, i, t in sentences:
        v, best = vec(t), (0.0, None)
        for k2, c, u in sorted(chunks, key=lambda r: r[1]):
            x = vec(u)
            if k2 == k and (dot := sum(y * x.get(w, 0.0) for w, y in v.items())):
                cos = dot / norm(v) / norm(x)
                if cos > best[0] + 1e-12:
                    best = (cos, c)
        out[k, i] = best
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(["the", "of"] * (n // 4) + [rng.choice(words[: rng.choice([5, 50, 300])]) for _ in range(n)])
    chunks = [(f"k{i % 3}", i, text(rng.randint(3, 40))) for i in range(90)]
    chunks += [("k0", 200, chunks[0][2]), ("k0", 201, ""), (None, 202, "the w1")]
    sentences = [(f"k{i % 3}", i, text(rng.randint(1, 15))) for i in range(120)]
    sentences += [("k0", 300, chunks[0][2]), ("k1", 301, ""), ("k2", 302, "unheard words"), ("k9", 303, "the w1"), (None, 304, "The w1!")]
    return sentences, chunks


def test_like_all_pairs(spark, rows):
    sentences, chunks = rows
    s, c = spark.createDataFrame(sentences, "k string, sid bigint, text string"), spark.createDataFrame(chunks, "k string, cid bigint, text string")
    got = {(r["k"], r["sid"]): r for r in scores.attribute(s, c, "k").collect()}
    want = plainly(sentences, chunks)
    assert got.keys() == want.keys()
    for at, (cos, cid) in want.items():
        assert got[at]["cosine"] == pytest.approx(cos, abs=1e-9) and got[at]["cid"] == cid, at
    assert got["k0", 300]["cid"] == 0 and got["k0", 300]["support"] == "PRIMARY" and got["k2", 302]["support"] == "UNSUPPORTED"


def test_common_words_meet_no_chunk(spark, rows):
    sentences, chunks = rows
    s, c = scores._weighed(spark.createDataFrame(sentences, "k string, sid bigint, text string"), spark.createDataFrame(chunks, "k string, cid bigint, text string"), "k")
    every = s.join(c.withColumnRenamed("x", "y"), ["k", "w"]).count()
    pairs = scores.candidates(scores.probes(s, c, "k"), c, "k").count()
    assert pairs < every / 3


@pytest.mark.parametrize("options", [{"chars": 0}, {"products": 200, "chars": 3350}, {"products": 200}])
def test_cases_of_any_size(spark, rows, options):
    """All cases through joins of words, some, and none: cases that fit are gathered, each as one row or in parts, and give the same."""
    sentences, chunks = rows
    s, c = spark.createDataFrame(sentences, "k string, sid bigint, text string"), spark.createDataFrame(chunks, "k string, cid bigint, text string")
    got = {(r["k"], r["sid"]): r for r in scores.attribute(s, c, "k", **options).collect()}
    want = plainly(sentences, chunks)
    assert got.keys() == want.keys()
    for at, (cos, cid) in want.items():
        assert got[at]["cosine"] == pytest.approx(cos, abs=1e-9) and got[at]["cid"] == cid, at
