"""Operator 2: a linear-chain conditional random field that tags toxic spans.

Training. Labels are given for documents, a chain needs them for tokens. So marks are looked for first: features of words (the
word, beginnings of three to nine letters of longer words, the last five letters) that cover the toxic training documents and
seldom occur in clean ones, chosen greedily. A token of a toxic document that has a mark is labelled toxic, every other token
clean. A mark need not be certain: what it is worth, the chain learns from all tokens that have it, together with features that
have no part in the labels: the case of the token, and whether it begins a sentence (crossed), and the tokens next to it through
the transitions. The weights maximise the regularised conditional likelihood over stretches of REACH words around all marks, and
the first words of texts without any. The classifier is fitted on a bounded sample of labelled rows (`max_docs` of each class,
texts of up to `max_chars`), taken by a hash of the id; of near copies (equal least word hashes) one counts when marks are chosen.

Scoring. A text is a chain over all its words. Words without a mark have one and the same potential, so a run of k of them is the
k-th power of one 2x2 matrix; forward-backward over the other words and these powers gives the exact marginals. A document's
score is a logistic function of its marginals (the largest, and their sum over marked words) and its number of words, so that a
single doubtful word does not make a long text toxic; it is fitted on marginals from chains that have not seen the document (two
halves). Its spans are the runs of marked words with marginals above `span`.

Defined results: null and empty texts get score 0; the score depends on the text alone; repeated rows score alike; with no
toxic or no clean training row, or without any mark, every score is 0; other columns are ignored by `score` and kept by `keep_clean`, which also keeps
rows whose text is null.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")
#: powers of the neutral matrix that are told apart; it has converged long before
MAX_RUN = 64
#: words to either side of a mark that the chain is trained on
REACH = 8
#: what ends a sentence, between two words
STOP = re.compile(r"[.!?\n]")


@dataclass(frozen=True)
class Params:
    #: labelled documents of each class that the classifier is fitted on, and the longest text among them
    max_docs: int = 1500
    max_chars: int = 10_000
    #: toxic documents that a feature is in, at least, and those that it is the first chosen one to cover
    min_df: int = 3
    min_new: int = 2
    #: share of toxic documents among those (of a sample with as many clean ones) that a feature is in
    purity: float = 0.85
    #: documents newly covered that a feature must be worth for each clean one (of as many) that it touches
    price: float = 2.5
    max_features: int = 2000
    l2: float = 0.02
    rounds: int = 40
    span: float = 0.5


def features(word: str) -> tuple[str, ...]:
    """Names of a word's features: the word, beginnings of three to nine letters that it goes beyond, and its last five letters."""
    w = word.lower()
    return ("=" + w, *(f"^{w[:k]}" for k in range(3, min(10, len(w)))), *(("$" + w[-5:],) if len(w) >= 5 else ()))


def shape(word: str, between: str) -> str:
    """Name of a token's shape: its case, and whether a sentence ended before it."""
    return "#" + ("u" if word.isupper() else "l" if word.islower() else "t") + ("." if STOP.search(between) else "-")


SHAPES = tuple(f"#{c}{s}" for c in "ult" for s in ".-")


@dataclass
class Chain:
    """Weights: features' towards the toxic tag, and log potentials of the tags' transitions (0 clean, 1 toxic)."""

    weights: dict[str, float]
    bias: float
    trans: np.ndarray
    span: float = 0.5
    #: of the document's score: constant, and factors of the largest marginal's and the marginals' sum's logarithms and of that of the words
    final: tuple[float, ...] | None = None

    def __post_init__(self) -> None:
        self.known: dict[str, float | None] = {}
        self.sizes = sorted({len(f) - 1 for f in self.weights if f[0] == "^"})
        self.neutral = np.exp(self.trans) * np.array([1.0, np.exp(self.bias)])  # previous tag by tag, with the tag's potential
        self.powers = [np.eye(2)]
        for _ in range(MAX_RUN):
            m = self.powers[-1] @ self.neutral
            self.powers.append(m / m.max())
        # largest marginal of a chain of neutral words alone, by length
        self.plain = [0.0] + [self._marginals([], n)[1] for n in range(1, MAX_RUN + 1)]

    def potential(self, word: str) -> float | None:
        """A word's score towards toxic beyond the bias; None if it has no known feature."""
        got = self.known.get(word, self)
        if got is self:
            if len(self.known) > 100_000:
                self.known.clear()
            w, weights = word.lower(), self.weights
            names = ["=" + w, "$" + w[-5:], *[f"^{w[:k]}" for k in self.sizes if k < len(w)]]
            found = [weights[f] for f in names if f in weights]
            got = self.known[word] = sum(found) if found else None
        return got

    def _marginals(self, at: list[tuple[int, float]], n: int) -> tuple[list[float], float]:
        """Marginals of the words `at` (position, potential) in a chain of n; and of a neutral chain if there are none."""
        power = lambda k: self.powers[min(k, MAX_RUN)]
        emit = lambda v: np.array([1.0, np.exp(min(self.bias + v, 50.0))])
        first = np.array([1.0, np.exp(self.bias)])
        if not at:
            return [], max((lambda a, b: (a * b)[1] / (a * b).sum())(first @ power(i), power(n - 1 - i).sum(1)) for i in range(n)) if n else 0.0
        turn = np.exp(self.trans)
        ahead = []
        for j, (i, v) in enumerate(at):
            if j == 0:
                a = (first @ power(i - 1)) @ turn if i else np.ones(2)
            else:
                a = (ahead[-1] @ power(i - at[j - 1][0] - 1)) @ turn
            a = a * emit(v)
            ahead.append(a / a.sum())
        out, back, after = [], power(n - 1 - at[-1][0]).sum(1), None
        for j in range(len(at) - 1, -1, -1):
            if after is not None:
                i, v = at[j + 1]
                back = power(i - at[j][0] - 1) @ (turn @ (emit(v) * after))
                back = back / back.sum()
            m = ahead[j] * back
            out.append(float(m[1] / m.sum()))
            after = back
        return out[::-1], 0.0

    def summary(self, text: str | None) -> tuple[tuple[float, float, float] | None, list[tuple[int, int, float]]]:
        """What the document's score follows from (None: no word), and its toxic spans."""
        found = TOKEN.findall(text) if text else []
        n = len(found)
        if not n:
            return None, []
        known, potential, weights = self.known, self.potential, self.weights
        if not any((known[w] if w in known else potential(w)) is not None for w in found):
            plain = max(self.plain[min(n, MAX_RUN)], 1e-6)
            return (math.log(plain), math.log(plain), math.log(n)), []
        at, where, last = [], [], 0
        for i, m in enumerate(TOKEN.finditer(text)):
            v = potential(m[0])
            if v is not None:
                at.append((i, v + weights.get(shape(m[0], text[last : m.start()]), 0.0)))
                where.append((m.start(), m.end()))
            last = m.end()
        marginal, _ = self._marginals(at, n)
        spans: list[tuple[int, int, float]] = []
        before = -2
        for (i, _), (lo, hi), p in zip(at, where, marginal, strict=True):
            if p >= self.span:
                if before == i - 1:
                    spans[-1] = (spans[-1][0], hi, max(spans[-1][2], p))
                else:
                    spans.append((lo, hi, p))
                before = i
        return (math.log(max(*marginal, 1e-6)), math.log(max(sum(marginal), 1e-6)), math.log(n)), spans

    def tag(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and its toxic spans as offsets (code points) with their largest marginal."""
        seen, spans = self.summary(text)
        if seen is None or self.final is None:
            return 0.0, []
        z = self.final[0] + sum(a * b for a, b in zip(self.final[1:], seen, strict=True))
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z)))), spans


def cover(toxic: list[list[str]], clean: list[list[str]], p: Params) -> list[str]:
    """Features that cover the toxic documents and are pure, by lazy greedy choice; of equals the most specific."""
    count = Counter()
    for words in toxic:
        count.update({f for w in set(words) for f in features(w)})
    count = {f: c for f, c in count.items() if c >= p.min_df}
    other = Counter()
    for words in clean:
        other.update({f for w in set(words) for f in features(w)} & count.keys())
    scale = len(toxic) / len(clean)
    pure = {f for f, c in count.items() if c >= p.purity * (c + scale * other[f])}
    where: dict[str, list[int]] = {f: [] for f in pure}
    for i, words in enumerate(toxic):
        for f in {f for w in set(words) for f in features(w)} & pure:
            where[f].append(i)
    open_docs, out = set(range(len(toxic))), []
    # found in so many more toxic documents than their share that a mark among so many is no accident (one in twenty such samples)
    share, sure = len(toxic) / (len(toxic) + len(clean)), math.log(20 * max(len(count), 1))

    def evidence(k: int, o: int) -> float:
        n = k + o
        return k * math.log(k / n / share) + (o * math.log(o / n / (1 - share)) if o else 0.0)

    pure = {f for f in pure if evidence(len(where[f]), other[f]) >= sure}
    # what a mark is worth: documents newly covered, less its price for each clean one
    worth = lambda f: sum(i in open_docs for i in where[f]) - p.price * scale * other[f]
    queue = [(-worth(f), -len(f), f) for f in pure]
    heapq.heapify(queue)
    while queue and open_docs and len(out) < p.max_features:
        old, size, f = heapq.heappop(queue)
        new = worth(f)
        if new < p.min_new:
            continue
        if new < -old:
            heapq.heappush(queue, (-new, size, f))
            continue
        out.append(f)
        open_docs.difference_update(where[f])
    # marks about as frequent as the chosen ones that only occur beside them
    if out:
        usual = sorted(len(where[f]) for f in out)[len(out) // 2]
        for f in sorted(pure, key=lambda f: (-len(where[f]), -len(f), f)):
            if len(where[f]) < max(4, usual / 8) or len(out) >= p.max_features:
                break
            if not any(f[1:] in g[1:] or g[1:] in f[1:] for g in out):
                out.append(f)
    return out


def _least(words: list[str]) -> list[str]:
    """The three words of a text with the least hashes."""
    return sorted(set(words), key=lambda w: (zlib.crc32(w.encode()), w))[:3]


def _unlike(docs: list[list[str]]) -> list[list[str]]:
    """One of each group of documents whose three words of least hash agree: copies would make any of their words a mark."""
    seen: dict[tuple[str, ...], list[str]] = {}
    for words in docs:
        seen.setdefault(tuple(_least(words)), words)
    return list(seen.values())


def fit(rows: list[tuple[str, int]], p: Params) -> Chain:
    """A chain from (text, toxic) rows."""
    if len({bool(t) for _, t in rows}) < 2:
        return Chain({}, -30.0, np.zeros((2, 2)), p.span)
    shared: dict[str, str] = {}  # each distinct word is held once
    tokens = [[shared.setdefault(w, w) for w in TOKEN.findall(text or "")] for text, _ in rows]
    # the function of the score, from chains that have not seen the rows; copies are on one side
    half = [zlib.crc32(" ".join(_least(words)).encode()) % 2 for words in tokens]
    seen, toxic = [], []
    for k in (0, 1):
        learned = [i for i, h in enumerate(half) if h != k]
        if len({bool(rows[i][1]) for i in learned}) < 2:
            learned = range(len(rows))
        chain = _fit([rows[i] for i in learned], [tokens[i] for i in learned], p)
        for (text, t), h in zip(rows, half, strict=True):
            if h == k and (x := chain.summary(text)[0]) is not None:
                seen.append(x)
                toxic.append(bool(t))
    chain = _fit(rows, tokens, p)
    marks = any(not f.startswith("#") for f in chain.weights)
    return replace(chain, final=_logistic(np.array(seen).reshape(-1, 3), np.array(toxic, float)) if marks else None)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Constant and factors of a regularised logistic regression, by Newton's method."""
    x = np.column_stack((np.ones(len(x)), x))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-6, 1.0, 1.0, 1.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, x.T @ (y - q) - ridge @ w)
        w = w + step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def _fit(rows: list[tuple[str, int]], tokens: list[list[str]], p: Params) -> Chain:
    by_class = [[w for w, (_, t) in zip(tokens, rows, strict=True) if bool(t) == v] for v in (False, True)]
    best = cover(_unlike(by_class[1]), _unlike(by_class[0]), p)
    names = [*best, *SHAPES]
    number = {f: i for i, f in enumerate(names)}
    # only texts with a mark differ from a neutral run; the others teach the bias and the transitions
    known: dict[str, tuple[int, ...]] = {}
    chains = []
    for words, (text, toxic) in zip(tokens, rows, strict=True):
        seq = []
        for w in words:
            if w not in known:
                known[w] = tuple(number[f] for f in features(w) if f in number)
            seq.append(known[w])
        hits = [i for i, s in enumerate(seq) if s]
        label = [int(bool(toxic and s)) for s in seq]
        if hits:
            last = 0
            for i, m in enumerate(TOKEN.finditer(text)):
                if seq[i]:
                    seq[i] = (*seq[i], number[shape(m[0], text[last : m.start()])])
                last = m.end()
        lo = hi = 0
        for i in hits or [0]:
            if i - REACH > hi:
                chains.append((seq[lo:hi], label[lo:hi]))
                lo = i - REACH
            hi = min(len(seq), i + 1 + REACH + (0 if hits else 2 * REACH))
        chains.append((seq[lo:hi], label[lo:hi]))
    return _maximise([c for c in chains if c[0]], names, p)


def _maximise(chains: list[tuple[list[tuple[int, ...]], list[int]]], names: list[str], p: Params) -> Chain:
    """Gradient ascent with adaptive steps (Rprop) on the conditional log likelihood; chains of like length run together."""
    chains = sorted(chains, key=lambda c: len(c[0]))
    packs = []
    for k in range(0, len(chains), 256):
        part = chains[k : k + 256]
        t = max(len(c[0]) for c in part)
        mask, y = np.zeros((len(part), t)), np.zeros((len(part), t), int)
        where, which = [], []
        for r, (seq, lab) in enumerate(part):
            mask[r, : len(seq)], y[r, : len(seq)] = 1, lab
            for i, fs in enumerate(seq):
                where += [r * t + i] * len(fs)
                which += fs
        packs.append((mask, y, np.array(where, int), np.array(which, int)))
    d = len(names)
    theta = np.concatenate((np.full(d, 1.0), [-4.0], np.zeros(4)))  # features, bias, transitions
    step, last = np.full(d + 5, 0.2), np.zeros(d + 5)
    for _ in range(p.rounds):
        grad = -p.l2 * theta
        trans = theta[d + 1 :].reshape(2, 2)
        e = np.exp(trans)
        for mask, y, where, which in packs:
            r, t = mask.shape
            u = np.full(r * t, theta[d])
            np.add.at(u, where, theta[which])
            pot = np.ones((r, t, 2))
            pot[:, :, 1] = np.exp(np.clip(u.reshape(r, t), -50, 50))
            alpha, beta = np.zeros((r, t, 2)), np.ones((r, t, 2))
            alpha[:, 0] = pot[:, 0]
            alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
            for i in range(1, t):
                a = (alpha[:, i - 1] @ e) * pot[:, i]
                alpha[:, i] = np.where(mask[:, i, None] > 0, a / a.sum(1, keepdims=True), alpha[:, i - 1])
            for i in range(t - 2, -1, -1):
                b = (pot[:, i + 1] * beta[:, i + 1]) @ e.T
                beta[:, i] = np.where(mask[:, i + 1, None] > 0, b / b.sum(1, keepdims=True), 1.0)
            m = alpha * beta
            m = m[:, :, 1] / m.sum(2)
            diff = ((y - m) * mask).ravel()
            grad[d] += diff.sum()
            grad[:d] += np.bincount(which, diff[where], d) if len(which) else 0
            if t > 1:
                pair = alpha[:, :-1, :, None] * e[None, None] * (pot * beta)[:, 1:, None, :]
                pair /= pair.sum((2, 3), keepdims=True)
                pair *= mask[:, 1:, None, None]
                seen = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j) & (mask[:, 1:] > 0)).sum() for j in (0, 1)] for i in (0, 1)])
                grad[d + 1 :] += (seen - pair.sum((0, 1))).ravel()
        same = np.sign(grad) * last
        step = np.clip(np.where(same > 0, step * 1.2, np.where(same < 0, step * 0.5, step)), 1e-4, 1.0)
        last = np.where(same < 0, 0.0, np.sign(grad))
        theta += step * last
    return Chain({f: float(w) for f, w in zip(names, theta[:d], strict=True)}, float(theta[d]), theta[d + 1 :].reshape(2, 2), p.span)


def train(docs: DataFrame, labels: DataFrame, p: Params = Params(), learn: Callable | None = None) -> Chain:
    """Fits the chain on at most p.max_docs labelled documents of each class; `learn` makes, of the id's name, the condition
    that a row may be learned from. Of rows that repeat an id one counts."""
    lab = labels.where("doc_id is not null and toxic in (0, 1)")
    lab = lab.where(learn("doc_id")) if learn else lab
    pick = lambda v: lab.where(f"toxic = {v}").join(short, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.max_docs)
    short = docs.where(F.length("text").between(1, p.max_chars)).select("doc_id")
    chosen = pick(0).unionByName(pick(1))
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, p.max_chars)).join(F.broadcast(chosen), "doc_id")
    # of rows that repeat an id one, so that what the driver takes is bounded by the two parameters
    one = rows.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("toxic").alias("toxic"))
    got = one.select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    return fit(list(zip(got["text"], got["toxic"].astype(int), strict=True)), p)


def score(docs: DataFrame, chain: Chain, *, spans: bool = False) -> DataFrame:
    """Adds score and predicted to all rows, and with spans=True the toxic spans (start, end, marginal)."""
    model = docs.sparkSession.sparkContext.broadcast((chain.weights, chain.bias, chain.trans, chain.span, chain.final))  # max_features weights
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Chain(*model.value)
        for batch in batches:
            got = [c.tag(x.as_py()) for x in batch.column("__text")]
            s = [x[0] for x in got]
            cols = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name != "__text"]
            cols += [("score", pa.array(s, pa.float64())), ("predicted", pa.array([int(x >= 0.5) for x in s], pa.int32()))]
            if spans:
                cols.append(("spans", pa.array([[{"start": a, "end": b, "marginal": m} for a, b, m in x[1]] for x in got], kind)))
            yield pa.RecordBatch.from_arrays([x for _, x in cols], [k for k, _ in cols])

    keep = docs.select(*[F.col(c) for c in docs.columns if c not in ("score", "predicted", "spans", "__text")], F.col("text").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema if f.name != "__text")
    return keep.mapInArrow(run, f"{fields}, score double, predicted int" + ", spans array<struct<start:int,end:int,marginal:double>>" * spans)


def keep_clean(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs that are not tagged toxic, unchanged."""
    chain = train(docs, labels, p)
    tagged = score(docs.select(F.struct("*").alias("row"), "text"), chain)
    return tagged.where("predicted = 0").select("row.*")
