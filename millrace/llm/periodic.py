"""Operator 11: periodic runs of words, found by an all-lag scan.

The words of a text become an array of ids, which is held against itself at every shift up to n / EXPONENT. A stretch of equal
places at shift p that a run needs is at least max(LEAST - p, (EXPONENT - 1) * p) places long, so it holds a place whose number is
a multiple of that length: the vectorised comparison looks at these places first, and only where one is equal, with equal places
beside and halfway, is the whole stretch run-lengthed. No run can slip between them, and the shifts of a text of n words cost about
n * log(n) / 3 comparisons instead of n * n / 4. A stretch whose smallest period is a divisor of its shift is the run that the
divisor gave; it is dropped.

Spark deals texts to tasks; a text of more than `long` characters is cut into ranges of shifts of equal work, which are dealt on
their own, and its runs are brought together by its row.

Defined results: a null or empty text has no words, no runs, four nulls and the digests of the empty string; a row without an id
has its words as they are; equal rows give equal results, one a row; extra columns play no part.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: a run is at least so long, and so many times its period
LEAST, EXPONENT = 6, 4
#: comparisons made at once, which bound a task's memory
PAIRS = 1 << 18
#: characters from which a text's shifts are dealt on their own, and comparisons of one such range
LONG, RANGE = 60_000, 1 << 15
#: rows worked on at once
ROWS = 256

RESULT = "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"


def words_of(text: str | None, doc_id: int | None, repeats: bool = True) -> list[bytes]:
    """The words of a text; where the digest of its id says so, from some word on repetitions of a piece of it."""
    words = (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: splits at the six ASCII characters only
    n = len(words)
    if not repeats or doc_id is None or not n:
        return words
    g, tenth = divmod(zlib.crc32(b"%d" % doc_id), 10)
    if tenth:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    piece = words[a : a + p]
    return words[:a] + (piece * ((n - a) // p + 1))[: n - a]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words have equal ids."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), np.int32, len(words))


def work(n: int, lo: int, hi: int) -> np.ndarray:
    """Places looked at for each shift of lo to hi."""
    lags = np.arange(lo, hi + 1)
    return (n - lags) // np.maximum(LEAST - lags, (EXPONENT - 1) * lags)


def lag_ranges(n: int, pairs: int) -> list[tuple[int, int]]:
    """The shifts 1 to n / EXPONENT in ranges of about so many places to look at."""
    last = n // EXPONENT if n >= LEAST else 0
    if last < 1:
        return []
    ends = np.cumsum(work(n, 1, last))
    cuts = np.unique(np.searchsorted(ends, np.arange(pairs, ends[-1], pairs))) + 1
    edges = [0, *(int(c) for c in cuts if c < last), last]
    return [(a + 1, b) for a, b in zip(edges, edges[1:])]


def _reach(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """The first place from `at` on, in the direction of step, that differs from the one `lag` after it (or lies outside)."""
    n, size = len(ids) - lag, 64
    while 0 <= at < n:
        lo, hi = (at, min(at + size, n)) if step > 0 else (max(at - size + 1, 0), at + 1)
        differs = ids[lo:hi] != ids[lo + lag : hi + lag]
        if differs.any():
            return lo + int(differs.argmax()) if step > 0 else hi - 1 - int(differs[::-1].argmax())
        at, size = (hi if step > 0 else lo - 1), size * 2
    return at


def scan(ids: np.ndarray, lo: int, hi: int, pairs: int = PAIRS) -> dict[tuple[int, int], int]:
    """Runs (start, end) to their least period among the shifts lo to hi."""
    n, found = len(ids), {}
    if hi < lo:
        return found
    # of each place, the run that covers it and reaches furthest: its stretches at multiples of its period are known
    far, per = np.zeros(n, np.int64), np.ones(n, np.int64)
    guarded = np.concatenate(([-1, -2], ids, [-3, -4]))  # two places beyond either end, equal to nothing

    def same(a: np.ndarray, lag: np.ndarray) -> np.ndarray:
        return guarded[a + 2] == guarded[a + lag + 2]

    first = lo
    while first <= hi:
        last = first
        if first > 1:  # the shifts after it that fill the block; shift 1 on its own, as its runs are met at all others
            ends = np.cumsum(work(n, first, min(hi, 2 * first + 4096)))
            last = first + max(0, int(np.searchsorted(ends, pairs, "right")) - 1)
        lags = np.arange(first, min(last, hi) + 1)
        first = int(lags[-1]) + 1
        need = np.maximum(LEAST - lags, (EXPONENT - 1) * lags)
        count = (n - lags) // need
        lag, length = np.repeat(lags, count), np.repeat(need, count)
        at = (np.arange(len(lag)) - np.repeat(np.cumsum(count) - count, count) + 1) * length - 1
        hit = np.flatnonzero(ids[at] == ids[at + lag])
        if not len(hit):
            continue
        at, lag, half = at[hit], lag[hit], (length[hit] - 1) // 2
        # of the other places of a stretch, half or more lie on one side; two at least do
        after = same(at + 1, lag) & same(at + 2, lag) & same(np.minimum(at + half, n - lag - 1), lag)
        before = same(at - 1, lag) & same(at - 2, lag) & same(np.maximum(at - half, 0), lag)
        hit = np.flatnonzero((after | before) & ((at >= far[at] - lag) | (lag % per[at] != 0)))
        for a, p, h in zip(at[hit].tolist(), lag[hit].tolist(), half[hit].tolist()):
            if a < far[a] - p and p % per[a] == 0:
                continue
            s, e = _reach(ids, a, p, -1) + 1, _reach(ids, a, p, 1) + p
            if e - s >= max(LEAST, EXPONENT * p) and (s, e) not in found:
                found[s, e] = p
                further = far[s:e] < e
                far[s:e][further], per[s:e][further] = e, p
    return found


def summary(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The result's row. runs: (start, length, period)."""
    runs = sorted(runs, key=lambda r: (r[0], r[2]))
    best = (None,) * 4
    if runs:
        top = max(length / period for _, length, period in runs)
        near = [r for r in runs if r[1] / r[2] >= top * (1 - 1e-9)]  # doubles choose these few, fractions among them
        s, length, p = min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, p, 1000 * length // p)
    # a word goes if a run covers it after its first period: +1 where such a stretch begins, -1 where it ends
    change = np.zeros(len(words) + 1, np.int64)
    for s, length, p in runs:
        change[s + p] += 1
        change[s + length] -= 1
    kept = words
    if runs:
        kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
    listed = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
    return (doc_id, len(words), len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_RESULT = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in RESULT.split(", ")])
_RANGES = pa.schema([("row", pa.int64()), ("ids", pa.binary()), ("lo", pa.int64()), ("hi", pa.int64())])
_RUNS = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("period", pa.int64())])


def _columns(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[list]]:
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield [batch.column(c).slice(k, ROWS).to_pylist() for c in names]


def _short(batches: Iterator[pa.RecordBatch], repeats: bool) -> Iterator[pa.RecordBatch]:
    for ids, texts in _columns(batches, "doc_id", "text"):
        out = []
        for i, text in zip(ids, texts):
            words = words_of(text, i, repeats)
            n = len(words)
            runs = scan(word_ids(words), 1, n // EXPONENT if n >= LEAST else 0)
            out.append(summary(i, words, [(s, e - s, p) for (s, e), p in runs.items()]))
        yield _batch(out, _RESULT)


def _cut(batches: Iterator[pa.RecordBatch], repeats: bool, pairs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, i, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text"))):
            ids = word_ids(words_of(text.as_py(), i.as_py(), repeats))
            for lo, hi in lag_ranges(len(ids), pairs):
                yield _batch([(row.as_py(), ids.tobytes(), lo, hi)], _RANGES)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, ids, lo, hi in zip(*(batch.column(c) for c in _RANGES.names)):
            found = scan(np.frombuffer(ids.as_buffer(), np.int32), lo.as_py(), hi.as_py())
            out += [(row.as_py(), s, e, p) for (s, e), p in found.items()]
        yield _batch(out, _RUNS)


def _join(batches: Iterator[pa.RecordBatch], repeats: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text, runs in zip(*(batch.column(c) for c in ("doc_id", "text", "runs"))):
            yield _batch([summary(i.as_py(), words_of(text.as_py(), i.as_py(), repeats), [(r["start"], r["length"], r["period"]) for r in runs.as_py() or []])], _RESULT)


def detect(docs: DataFrame, *, repeats: bool = True, long: int = LONG, pairs: int = RANGE) -> DataFrame:
    """doc_id, n_words, n_runs, the run of greatest exponent and the digests of every row. repeats: words of some ids are replaced by
    repetitions (`words_of`); long: characters from which a text's shifts are dealt in ranges of so many `pairs`."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    is_long = F.length(F.coalesce("text", F.lit(""))) > long

    def work() -> DataFrame:
        # rows get a number that stays, as the table is written
        few = common.written(docs.where(is_long).withColumn("row", F.monotonically_increasing_id()), "periodic-long")
        cut = few.mapInArrow(lambda it: _cut(it, repeats, pairs), "row bigint, ids binary, lo bigint, hi bigint")
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        runs = cut.repartition(tasks, "row", "lo").mapInArrow(_ranges, "row bigint, start bigint, end bigint, period bigint")
        # a shift that is a multiple of a period may lie in another range than the period: the least is the run's
        runs = runs.groupBy("row", "start", "end").agg(F.min("period").alias("period"))
        runs = runs.groupBy("row").agg(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")).alias("runs"))  # of one text
        joined = few.join(runs, "row", "left").select("doc_id", "text", "runs").mapInArrow(lambda it: _join(it, repeats), RESULT)
        return docs.where(~is_long).mapInArrow(lambda it: _short(it, repeats), RESULT).unionByName(joined)

    return common.settled(work, "periodic-result")
