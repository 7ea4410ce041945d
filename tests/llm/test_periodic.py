"""Operator 11 against a brute-force version."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest

from millrace.llm import periodic, queries

from ..conftest import SF
from .data import documents


def words_plainly(text, doc_id):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and words and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def runs_plainly(w):
    """(start, length, period) of every run: maximal stretches of each period, of which those with a smaller period go."""
    found = set()
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - p:
            j = i
            while j < len(w) - p and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                piece = w[i : j + p]
                if not any(piece[q:] == piece[:-q] for q in range(1, p)):
                    found.add((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plainly(doc_id, text):
    w = words_plainly(text, doc_id)
    runs = runs_plainly(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(w), len(runs), *(best[:3] if best else (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_scan_finds_all_runs():
    rng = random.Random(0)
    for _ in range(500):
        n, k, w = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5]), []
        while len(w) < n:
            w += [str(rng.randrange(k)) for _ in range(rng.randint(1, 9))] * rng.choice([1, 1, rng.randint(1, 9)])
        w = w[:n]
        want = runs_plainly(w)
        ids, last = periodic.word_ids([x.encode() for x in w]), n // 4 if n >= 6 else 0
        for pairs in (5, 50, 1 << 18):
            assert sorted(((s, e - s, p) for (s, e), p in periodic.scan(ids, 1, last, pairs).items()), key=lambda r: (r[0], r[2])) == want
        parts = {}
        for lo, hi in (ranges := periodic.lag_ranges(n, rng.choice([3, 10, 100]))):
            for run, p in periodic.scan(ids, lo, hi).items():
                parts[run] = min(p, parts.get(run, p))
        assert {(s, e - s, p) for (s, e), p in parts.items()} == set(want)
        assert [x for lo, hi in ranges for x in range(lo, hi + 1)] == list(range(1, last + 1))


def test_a_periodic_long_text_takes_little_time():
    import time

    import numpy as np

    began = time.perf_counter()
    assert periodic.scan(np.zeros(300_000, np.int32), 1, 75_000) == {(0, 300_000): 1}
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize("long, pairs", [(60_000, 1 << 15), (300, 40), (0, 1 << 15)])
def test_rows_like_brute_force(spark, long, pairs):
    rng = random.Random(3)
    docs = documents(spark, 60, extra=True)
    more = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 90)))) for i in range(500, 560)]
    more += [(None, "x y x y x y x y"), (None, None), (500, "a a a a a a"), (500, "a a a a a a"), (700, "the  cat\n" * 40), (701, "é b é b " * 12)]
    docs = docs.select("doc_id", "text", "node", "size").unionByName(
        spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True
    )
    got = sorted((tuple(r) for r in periodic.detect(docs, long=long, pairs=pairs).collect()), key=repr)
    assert got == sorted((plainly(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)


def test_query_like_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r[2] > 0 for r in got.values()) > 5
    for r in docs:
        assert got[r["doc_id"]] == plainly(r["doc_id"], r["text"])


def test_empty_table(spark):
    out = periodic.detect(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.count() == 0 and out.columns == [c.split()[0] for c in periodic.RESULT.split(", ")]
