"""Operator 3: language-model scores from a probabilistic suffix tree (after Ron, Singer & Tishby 1996).

A text is a sequence of symbols: its words, A-Z lower-cased, and one end. The alphabet is the V symbols met in training and one
more, "a word not met", so that the base (add-one over V + 1 symbols) and the tree are distributions over the same alphabet. A
context is the last 1 to `depth` symbols, across everything between words; the start of the text counts as a symbol before it.

The tree is grown level by level. A context of k symbols is looked at if training has it at least twice, which the level before
has counted. Of its next symbols those met twice or more have a share of their own; the rest of its occurrences (s of n) is left
to the suffix, as is `prior`: P(x | context) = (c(x) + (s + prior) * P(x | suffix)) / (n + prior), with c(x) = 0 below 2. The
divergence test keeps the context if its distribution codes what followed it in training in `gain` digits less than that of its
longest kept proper suffix. P(x) without a context is c / (N + T) and, for a word not met, T / (N + T), T being one more than the
number of words met once. Every symbol is scored by the longest kept suffix of what stands before it.

Plan. Tasks number the words of their rows and write chunks of about `chunk` symbols, packed. Words are counted over all chunks
and get a number each that all chunks use. Then for each level, a chunk asks after its distinct (context, next) pairs, packed and grouped by the context's hash into parts; a part adds up the counts of all
chunks, runs the test and replies to every chunk in the order of its questions. A pair is not asked after if its context was met
once, or its next symbol once after the context's suffix: its own count is then known to be below 2. Contexts with HOT or more
occurrences are split over parts by their next symbol, and tested in a step of their own. No table of contexts is ever held in
one place but that of hot ones, whose number has a bound (N / hot, hot growing with N beyond 2^37 symbols).

Defined results: a null or empty text has the end as its only token; rows are scored alone, so that repeated rows and repeated
or null ids need no care (a row whose held_out is null is learned from); without training rows the only symbol is "a word not
met" and every score is 0; an empty table gives an empty result; other columns are ignored. Words and contexts are compared by
64-bit hashes. Probabilities in the divergence test have 1/100 digit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: bytes of a batch of rows between JVM and worker, and of a chunk in one row
BATCH, PIECE = 4 << 20, 1 << 18
#: fractions of a digit that a probability has in the divergence test
SCALE = 100


@dataclass(frozen=True)
class Params:
    depth: int = 3
    #: occurrences that a context leaves to its suffix besides those of next symbols met once
    prior: float = 1.0
    #: digits that a context must save over its suffix on what followed it
    gain: float = 0.5
    #: symbols in a chunk, and in a part, about
    chunk: int = 1_000_000
    part: int = 2_000_000
    #: occurrences from which a context is split over parts
    hot: int = 1 << 20


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, byte by byte (first all lowest bytes and so on), compressed."""
    body = b"".join(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() for a in arrays)
    head = np.array([len(body), *(len(a) for a in arrays)], "<i8").tobytes()
    return head + (pa.compress(body, codec="zstd", asbytes=True) if body else b"")


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    size, *sizes = np.frombuffer(data, "<i8", len(kinds) + 1).tolist()
    body = pa.decompress(data[8 * len(kinds) + 8 :], size, codec="zstd", asbytes=True) if size else b""
    out, at = [], 0
    for n, kind in zip(sizes, kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _order(key: np.ndarray) -> np.ndarray:
    """Places of sorted keys. Places are sorted along with the upper bits of the keys, which is several times faster; where these
    do not tell two keys apart, the keys are."""
    bits = np.uint64(max(1, (len(key) - 1).bit_length()))
    packed = key >> bits << bits | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    ordered = key[order]
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(key, kind="stable")


def _edges(ordered: np.ndarray) -> np.ndarray:
    """Whether each of some sorted numbers is the first of its kind."""
    return np.concatenate((np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]))


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in order of keys, and for each place which of them it is."""
    order = _order(key)
    new = _edges(key[order])
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


#: odd numbers that set two hashes apart before they are mixed
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: the start's number among all symbols
_START = 1 << 62
_ASKS = ("<u8", "<i8", "<u4", "<u8", "<u8", "<i8", "<u2")
_ROWS = "kind string, chunk bigint, level int, part bigint, payload binary, a bigint, b bigint, c bigint"
_NAMES = ["kind", "chunk", "level", "part", "payload", "a", "b", "c"]


def _row(kind: str, chunk: int | None, level: int, part: int | None, payload: bytes | None, a: int = 0, b: int = 0, c: int = 0) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((kind, chunk, level, part, payload, a, b, c), kinds, strict=True)], _NAMES)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 2  # 0 is the start, 1 the end
        return n


def _pieces(chunk: int, symbols: int, payload: bytes, ids: list, held: list[bool], id_type: pa.DataType) -> pa.RecordBatch:
    """A chunk's rows: large values in one row would be held by the JVM as large objects, which it seldom collects."""
    parts = [payload[i : i + PIECE] for i in range(0, len(payload), PIECE)]
    n = len(parts)
    cols = [pa.array([chunk] * n, pa.int64()), pa.array([symbols] + [0] * (n - 1), pa.int64()), pa.array(range(n), pa.int64()), pa.array(parts, pa.binary())]
    cols += [pa.array([ids] + [None] * (n - 1), pa.list_(id_type)), pa.array([held] + [None] * (n - 1), pa.list_(pa.bool_()))]
    return pa.RecordBatch.from_arrays(cols, ["chunk", "symbols", "part", "payload", "doc_id", "held_out"])


def _chunks(batches: Iterator[pa.RecordBatch], size: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, held_out, text) to chunks: symbols of all texts, their lengths, and hashes of the words."""
    from pyspark import TaskContext
    from xxhash import xxh64_intdigest

    chunk = TaskContext.get().partitionId() << 24
    numbers, rows, met, ids, held = _Numbers(), [], 0, [], []
    edges = [xxh64_intdigest(b"", 1), xxh64_intdigest(b"", 2)]

    def out() -> pa.RecordBatch:
        vocab = np.fromiter([*edges, *map(xxh64_intdigest, numbers)], "<u8", len(numbers) + 2)
        payload = _pack(np.concatenate(rows).astype("<u4"), np.array([len(r) for r in rows], "<u4"), vocab)
        return _pieces(chunk, met, payload, ids, held, id_type)

    for batch in batches:
        for i, h, text in zip(batch.column("doc_id"), batch.column("held_out").to_pylist(), batch.column("text"), strict=True):
            t = text.as_py()
            w = t.encode("utf-8", "surrogatepass").lower().split() if t else ()
            seq = np.empty(len(w) + 2, np.uint32)
            seq[0], seq[-1] = 0, 1
            seq[1:-1] = np.fromiter(map(numbers.__getitem__, w), np.uint32, len(w))
            rows.append(seq)
            ids.append(i.as_py())
            held.append(h)
            met += len(seq)
            if met >= size:
                yield out()
                chunk, numbers, rows, met, ids, held = chunk + 1, _Numbers(), [], 0, [], []
    if rows:
        yield out()


@dataclass
class _Asked:
    """The pairs of one level that a chunk asks after."""

    at: np.ndarray  # places in the chunk whose context was met twice
    inverse: np.ndarray  # the pair of each place
    first: np.ndarray  # a place of each pair
    sent: np.ndarray  # the pairs that are asked after, in order
    runs: np.ndarray  # where in `sent` a context begins
    run_of: np.ndarray  # the context of each pair
    route: np.ndarray  # of each context: the number that says its part
    hot: np.ndarray  # contexts that are split

    def bounds(self, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts that are asked, and the first context of each."""
        part = ((self.route >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
        return part[edge].astype(np.int64), edge


def _counted_in(payload: bytes, replies: list[bytes]) -> bytes:
    """A chunk with numbers and counts of its words over the corpus in place of hashes."""
    seq, lens, vocab = _unpack(payload, "<u4", "<u4", "<u8")
    got = [_unpack(r, "<i8", "<u8") for r in replies]
    counts, numbers, order = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.uint64), _order(vocab[1:]) + 1
    counts[order], numbers[order] = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
    counts[0], numbers[0] = counts[1], _START  # as many starts as ends
    return _pack(seq, lens, counts, numbers)


class Chunk:
    """A chunk's symbols, and what is known so far: star (count of each place's symbol after its context of the level done last,
    0 below 2) and q (its probability)."""

    def __init__(self, payload: bytes, held: list[bool], totals: tuple[int, int, int]):
        seq, lens, counts, numbers = _unpack(payload, "<u4", "<u4", "<i8", "<u8")
        lens = lens.astype(np.int64)
        self.start = np.cumsum(lens) - lens
        self.off = np.arange(len(seq)) - np.repeat(self.start, lens)
        self.train = np.repeat(~np.array(held, bool), lens) & (self.off > 0)
        (n, _, once), self.level, self.ctx = totals, 0, None
        p = np.where(counts > 0, counts, once + 1) / (n + once + 1)
        self.x, self.count, self.q, self.star = numbers[seq], counts[seq], p[seq], counts[seq]

    def ask(self, hot: int) -> _Asked:
        """The next level's pairs."""
        self.level += 1
        k = self.level
        self.n = np.concatenate(([0], self.star[:-1]))
        before = np.concatenate((np.zeros(k, np.uint64), self.x[:-k]))[: len(self.x)]
        self.ctx = _mixed(before * _A if k == 1 else self.ctx * _A + before)
        at = np.flatnonzero((self.off >= k) & (self.n >= 2))
        first, inverse = _distinct(_mixed(self.ctx[at] + self.x[at] * _B))
        first = at[first]
        x, n = self.x[first], self.n[first]
        salt = np.where(n >= hot, _mixed(x * _A) % np.maximum(n // (hot // 2), 1).astype(np.uint64), np.uint64(0))
        route = _mixed(self.ctx[first] + salt * _B)
        order = _order(route)
        new = _edges(route[order])
        edge, run = np.flatnonzero(new), np.cumsum(new) - 1
        wanted = self.star[first][order] >= 2
        if len(edge):  # a context has one question at least
            wanted[edge[~np.logical_or.reduceat(wanted, edge)]] = True
        run_of = np.empty(len(order), np.int64)
        run_of[order] = run
        kept = np.flatnonzero(wanted)
        runs = np.searchsorted(run[kept], np.arange(len(edge)))
        return _Asked(at, inverse, first, order[kept], runs, run_of, route[order][edge], n[order][edge] >= hot)

    def questions(self, asked: _Asked, parts: int) -> Iterator[tuple[int, bytes]]:
        if not len(asked.sent):
            return
        weight = np.bincount(asked.inverse, self.train[asked.at], len(asked.first)).astype(np.int64)[asked.sent]
        place = asked.first[asked.sent]
        x, p = self.x[place], np.clip(np.rint(-SCALE * np.log10(self.q[place])), 0, 65535).astype("<u2")
        n, ctx = self.n[place[asked.runs]], self.ctx[place[asked.runs]]
        length = np.diff(np.append(asked.runs, len(asked.sent))).astype("<u4")
        part, edge = asked.bounds(parts)
        for j, lo, hi in zip(part.tolist(), edge, [*edge[1:], len(asked.route)], strict=True):
            a, b = asked.runs[lo], asked.runs[hi] if hi < len(asked.runs) else len(asked.sent)
            route = asked.route[lo:hi]
            step = np.concatenate((route[:1], route[1:] - route[:-1]))
            yield j, _pack(step, n[lo:hi], length[lo:hi], ctx[lo:hi][asked.hot[lo:hi]], x[a:b], weight[a:b], p[a:b])

    def learn(self, asked: _Asked, replies: list[bytes], hot: dict[int, int], prior: float) -> None:
        """Takes the replies to all questions, in order of parts."""
        self.star = np.zeros(len(self.x), np.int64)
        if not len(asked.at):
            return
        got = [_unpack(r, "<i8", "<i8") for r in replies]
        star = np.zeros(len(asked.first), np.int64)
        star[asked.sent] = np.concatenate([g[0] for g in got])
        rest = np.concatenate([g[1] for g in got])
        if asked.hot.any():
            which = np.flatnonzero(asked.hot)
            rest[which] = [hot[c] for c in self.ctx[asked.first[asked.sent[asked.runs[which]]]].view(np.int64).tolist()]
        c, s = star[asked.inverse], rest[asked.run_of[asked.inverse]]
        self.star[asked.at] = c
        keep = s >= 0
        at = asked.at[keep]
        self.q[at] = (c[keep] + (s[keep] + prior) * self.q[at]) / (self.n[at] + prior)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, dict[int, list[bytes]]]]:
    """Rows of whole chunks, in order of chunk: the chunk, and the replies to it by level in order of part."""

    def out() -> tuple[dict, dict[int, list[bytes]]]:
        pieces = sorted(own, key=lambda row: row["part"])
        return pieces[0] | {"payload": b"".join(row["payload"] for row in pieces)}, {k: [x for _, x in sorted(v)] for k, v in replies.items()}

    now, own, replies = None, [], {}
    for batch in batches:
        for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
            if row["chunk"] != now:
                if own:
                    yield out()
                now, own, replies = row["chunk"], [], {}
            if row["kind"] == "chunk":
                own.append(row)
            else:
                replies.setdefault(row["level"], []).append((row["part"], row["payload"]))
    if own:
        yield out()


def _words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Questions of chunks after their words."""
    for own, _ in _met(batches):
        seq, lens, vocab = _unpack(own["payload"], "<u4", "<u4", "<u8")
        learned = np.repeat(~np.array(own["held_out"], bool), lens)
        order = _order(vocab[1:]) + 1
        h, weight = vocab[order], np.bincount(seq[learned], minlength=len(vocab))[order].astype("<i8")
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edge = np.flatnonzero(_edges(part))
        for lo, hi in zip(edge, [*edge[1:], len(h)], strict=True):
            yield _row("ask", own["chunk"], 0, int(part[lo]), _pack(np.concatenate((h[lo : lo + 1], h[lo + 1 : hi] - h[lo : hi - 1])), weight[lo:hi]))


def _rooted(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    for own, replies in _met(batches):
        yield _pieces(own["chunk"], 0, _counted_in(own["payload"], replies[0]), own["doc_id"], own["held_out"], id_type)


def _ask(batches: Iterator[pa.RecordBatch], level: int, parts: int, totals: tuple, hot: list[dict[int, int]], p: Params) -> Iterator[pa.RecordBatch]:
    """Questions of chunks at a level, from the replies to all levels before."""
    for own, replies in _met(batches):
        chunk = Chunk(own["payload"], own["held_out"], totals)
        for k in range(1, level):
            chunk.learn(chunk.ask(p.hot), replies.get(k, []), hot[k], p.prior)
        for part, payload in chunk.questions(chunk.ask(p.hot), parts):
            yield _row("ask", own["chunk"], level, part, payload)


def _gain(c: np.ndarray, digits: np.ndarray, s: np.ndarray, n: np.ndarray, prior: float) -> np.ndarray:
    """Digits that next symbols met c times save, given their probability after the suffix, and s of n occurrences that are left to it."""
    low = 10.0 ** (-digits / SCALE)
    return c * np.log10((c + (s + prior) * low) / ((n + prior) * low))


def _count(batches: Iterator[pa.RecordBatch], level: int, parts: int, p: Params) -> Iterator[pa.RecordBatch]:
    """Questions of whole parts, in order of part, to replies; and rows of split contexts, or of a part's words (level 0). Words get
    numbers from frequent to rare."""

    def words(part: int, asks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(x, *("<u8", "<i8")) for _, x in asks]
        h, weight = np.concatenate([np.cumsum(g[0]) for g in got]), np.concatenate([g[1] for g in got])
        first, inverse = _distinct(h)
        c = np.bincount(inverse, weight).astype(np.int64)
        number = np.empty(len(c), np.uint64)
        number[np.argsort(-c, kind="stable")] = np.arange(len(c), dtype=np.uint64) * np.uint64(parts) + np.uint64(part)
        yield _row("words", None, 0, part, None, int(c.sum()), int((c > 0).sum()), int((c == 1).sum()))
        at = 0
        for (chunk, _), g in zip(asks, got, strict=True):
            which = inverse[at : at + len(g[0])]
            yield _row("reply", chunk, 0, part, _pack(c[which], number[which]))
            at += len(g[0])

    def contexts(part: int, asks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        got = [_unpack(x, *_ASKS) for _, x in asks]
        route = np.concatenate([np.cumsum(g[0]) for g in got])
        n, length = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
        x, weight, digits = (np.concatenate([g[j] for g in got]) for j in (4, 5, 6))
        first_run, run = _distinct(route)
        owner = np.repeat(run, length)
        first, inverse = _distinct(_mixed(route[first_run][owner] + x * _B))
        c = np.bincount(inverse, weight).astype(np.int64)
        c[c < 2] = 0
        of, all_n = owner[first], n[first_run]
        s = all_n - np.bincount(of, c, len(all_n)).astype(np.int64)
        some = c > 0
        low = digits[first][some].astype(float)
        split = all_n >= p.hot
        saved = np.bincount(of[some], _gain(c[some], low, s[of[some]], all_n[of[some]], p.prior), len(all_n))
        saved += s * np.log10((s + p.prior) / (all_n + p.prior))
        rest = np.where(split, -2, np.where(saved >= p.gain, s, -1))
        if split.any():
            mine = np.concatenate([g[3] for g in got])
            where = dict(zip(run[n >= p.hot].tolist(), mine.view(np.int64).tolist(), strict=True))
            pairs = np.flatnonzero(some)
            for j in np.flatnonzero(split):
                own = pairs[of[pairs] == j]
                yield _row("hot", None, level, part, _pack(c[own], digits[first][own]), where[int(j)], int(all_n[j]), int(c[own].sum()))
        at = to = 0
        for (chunk, _), g in zip(asks, got, strict=True):
            yield _row("reply", chunk, level, part, _pack(c[inverse[at : at + len(g[4])]], rest[run[to : to + len(g[0])]]))
            at, to = at + len(g[4]), to + len(g[0])

    now, asks = None, []
    work = contexts if level else words
    for batch in batches:
        for row in batch.select(["part", "chunk", "payload"]).to_pylist():
            if row["part"] != now:
                if asks:
                    yield from work(now, asks)
                now, asks = row["part"], []
            asks.append((row["chunk"], row["payload"]))
    if asks:
        yield from work(now, asks)


def _saved(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, rest, payload) of split contexts to (a, saved)."""
    for batch in batches:
        out = []
        for n, s, payload in zip(batch.column("b").to_pylist(), batch.column("rest").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            c, digits = _unpack(payload, "<i8", "<u2")
            out.append(float(_gain(c, digits.astype(float), np.float64(s), np.float64(n), p.prior).sum()))
        yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(out, pa.float64())], ["a", "saved"])


def _tested(counted: DataFrame, p: Params) -> dict[int, int]:
    """Of split contexts: occurrences left to the suffix, -1 if not kept. There are N / p.hot at most."""
    hot = counted.where("kind = 'hot'").select("a", "b", "c", "payload")
    rest = hot.groupBy("a").agg((F.max("b") - F.sum("c")).alias("rest"))
    saved = hot.join(rest, "a").select("a", "b", "rest", "payload").mapInArrow(lambda it: _saved(it, p), "a bigint, saved double")
    # added up in whole millionths, so that the order does not matter
    saved = saved.groupBy("a").agg(F.sum(F.round(F.col("saved") * 1e6).cast("decimal(38,0)")).cast("double").alias("saved"))
    both = rest.join(saved, "a").join(hot.groupBy("a").agg(F.max("b").alias("n")), "a").collect()
    return {r["a"]: r["rest"] if r["saved"] / 1e6 + r["rest"] * math.log10((r["rest"] + p.prior) / (r["n"] + p.prior)) >= p.gain else -1 for r in both}


def _scored(batches: Iterator[pa.RecordBatch], totals: tuple[int, int, int], hot: list[dict[int, int]], p: Params, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    n, v, _ = totals
    for own, replies in _met(batches):
        chunk = Chunk(own["payload"], own["held_out"], totals)
        for k in range(1, p.depth + 1):
            chunk.learn(chunk.ask(p.hot), replies.get(k, []), hot[k], p.prior)
        count, symbol = chunk.count, chunk.off > 0
        of = lambda x: np.add.reduceat(np.where(symbol, x, 0), chunk.start)  # noqa: B023, E731
        base = np.log10((count + 1) / (n + v + 1))
        cols = [pa.array(own["doc_id"], id_type), pa.array(own["held_out"], pa.bool_()), *(pa.array(of(x), pa.int64()) for x in (1, (count > 0).astype(np.int64)))]
        cols += [pa.array(np.full(len(chunk.start), n, np.int64)), pa.array(of(base)), pa.array(of(np.log10(chunk.q)))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(docs: DataFrame, held_out: Column, p: Params = Params()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows are learned from where
    held_out is false."""
    # rows are large here; the default of 64 MB a batch is held several times by JVM and worker
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(name)
    conf.set(name, str(BATCH))
    try:
        return common.settled(lambda: _score(docs, held_out, p), "tree-result")
    finally:
        conf.set(name, before)


def _score(docs: DataFrame, held_out: Column, p: Params) -> DataFrame:
    from dataclasses import replace

    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    kind, id_type = dict(rows.dtypes)["doc_id"], to_arrow_type(rows.schema["doc_id"].dataType)
    schema = f"chunk bigint, symbols bigint, part bigint, payload binary, doc_id array<{kind}>, held_out array<boolean>"
    chunks = common.written(rows.mapInArrow(lambda it: _chunks(it, p.chunk, id_type), schema), "tree-chunks")
    size = chunks.agg(F.sum("symbols").alias("n")).first()["n"] or 0
    p = replace(p, hot=max(p.hot, size >> 17))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // p.part))
    counted: list[DataFrame] = []

    def whole(own: DataFrame) -> DataFrame:
        """Chunks with all replies so far, each chunk in one task."""
        out = own.select(F.lit("chunk").alias("kind"), "chunk", F.lit(0).alias("level"), "part", "payload", "doc_id", "held_out")
        for df in counted:
            out = out.unionByName(df.where("kind = 'reply'").select("kind", "chunk", "level", "part", "payload"), allowMissingColumns=True)
        return out.repartition("chunk").sortWithinPartitions("chunk")

    def replies(asks: DataFrame, level: int) -> DataFrame:
        asks = asks.select("part", "chunk", "payload").repartition(parts, "part").sortWithinPartitions("part", "chunk")
        return common.written(asks.mapInArrow(lambda it: _count(it, level, parts, p), _ROWS), "tree-replies")

    counted.append(replies(whole(chunks).mapInArrow(lambda it: _words(it, parts), _ROWS), 0))
    found = counted[0].where("kind = 'words'").agg(*[F.sum(c).alias(c) for c in "abc"]).first()
    totals = tuple(found[c] or 0 for c in "abc")
    rooted = common.written(whole(chunks).mapInArrow(lambda it: _rooted(it, id_type), schema), "tree-rooted")
    common.forget(chunks, counted.pop())

    hot: list[dict[int, int]] = [{} for _ in range(p.depth + 1)]
    for level in range(1, p.depth + 1):
        shared = spark.sparkContext.broadcast(hot)  # size / p.hot numbers a level, 2^17 at most
        counted.append(replies(whole(rooted).mapInArrow(lambda it, k=level, s=shared: _ask(it, k, parts, totals, s.value, p), _ROWS), level))
        if size >= p.hot:
            hot[level] = _tested(counted[-1], p)
    shared = spark.sparkContext.broadcast(hot)
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return whole(rooted).mapInArrow(lambda it: _scored(it, totals, shared.value, p, id_type), out)
