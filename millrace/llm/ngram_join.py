"""Operator 1: n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix.

Rows of the matrix are distinct sets of word shingles, columns are shingles in a global order, frequent ones last. Two sets
that reach the similarity share, among their first columns, a number of shingles that follows from the two sizes (Chaudhuri
et al. 2006, Xiao et al. 2008). So only these columns are multiplied:

1. shingles that many documents share are counted over all texts (exactly where prefixes are mostly made of them) and ordered
   last;
2. each class of equal sets gives the columns of its prefix once;
3. columns of up to BLOCK sets are multiplied out, overlaps are summed for each pair, and pairs below their bound go;
4. in wider columns all sets are first held against one pivot, then against some of the largest component. Where sets still
   lie in several components, their prefixes are multiplied in blocks: one side holds a block, the other streams by, and rows of
   the product with pairs that reach their bound remain;
5. every remaining candidate is verified on its whole texts, and links become components;
6. steps 4 and 5 leave out pairs whose component is known. To count links, sets of wide columns are multiplied with all others
   of their component in blocks, on whole texts; only the sums for each set come out.

No pair is dropped for the size of its column, and no task holds a whole column.

Defined results: words are split at ASCII white space after A-Z are lower-cased; null, empty and white texts have no
shingles and link with nothing; with fewer words than a shingle has, the sequence as a whole is the one shingle; rows with
the same id count as one document; rows without an id get their set's size and no component; extra columns are ignored.
Shingles are compared by 64-bit hashes, sets by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import components

#: widest column that is multiplied out pair by pair, and the document frequency from which a shingle is ordered last
BLOCK = 64
#: most frequent shingles that are ordered by frequency; only the speed depends on it
MAX_FREQUENT = 1_000_000
#: sets of the largest component, about, that a wide column's others are held against before all pairs are looked at
PIVOTS = 8
#: sets in the block that a task of the exact product holds, and sets that stream by in one task
HELD, STREAMED = 256, 1024
#: the same for the product that counts links, and numbers of the dense part of a block
COUNT_HELD, COUNT_STREAMED, DENSE = 1024, 8192, 1 << 24
#: shingles that a task counts before it reports: those that prefixes are mostly made of (see `frequent`), and others met REPORT times
CHUNK, REPORT = 1_500_000, 3
#: bits of a set's short name that hold its size: a text has 2^31 bytes at most
SIZE_BITS = 31
#: bits of the table that tells whose texts are needed; with many more ids, more texts than needed are moved
FILTER = 1 << 24

_TOP = np.uint64(1 << 63)


@dataclass(frozen=True)
class Params:
    #: words in a shingle
    words: int = 3
    #: linked if den * |a & b| >= num * |a | b|
    num: int = 90
    den: int = 100

    def prefix(self, n: int) -> int:
        return min(n, n - (self.num * n + self.den - 1) // self.den + 1 + n // 50)

    def prefix_sql(self, n: str) -> str:
        return f"least({n}, {n} - ({self.num} * {n} + {self.den - 1}) div {self.den} + 1 + {n} div 50)"

    def overlap_sql(self, a: str, b: str) -> str:
        return f"(({self.num} * ({a} + {b}) + {self.num + self.den - 1}) div {self.num + self.den})"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) >= 150_000:
            self.clear()
        out = self[word] = xxh64_intdigest(word)
        return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, k: int, cache: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else ()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    with np.errstate(over="ignore"):
        if len(w) < k:
            acc = np.array([len(w)], np.uint64)
            for x in h:
                acc = _mixed(acc + x)
            return acc
        acc = h[: len(w) - k + 1]
        for j in range(1, k):
            acc = _mixed(acc) + h[j : len(w) - k + 1 + j]
        acc = np.sort(_mixed(acc))
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]


def _frequent(batches: Iterator[pa.RecordBatch], k: int, low: int) -> Iterator[pa.RecordBatch]:
    cache, held, size = _Hashes(), [], 0

    def report() -> pa.RecordBatch:
        u, c = np.unique(np.concatenate(held), return_counts=True)
        often = (c >= REPORT) | (u < np.uint64(low))
        return pa.RecordBatch.from_arrays([pa.array(u[often].view(np.int64)), pa.array(c[often].astype(np.int64))], ["h", "c"])

    for batch in batches:
        for text in batch.column(0):
            s = shingles(text.as_py(), k, cache)
            held.append(s)
            size += len(s)
            if size >= CHUNK:
                yield report()
                held, size = [], 0
    if size:
        yield report()


def frequent(docs: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) of shingles that BLOCK documents or more share, and their ranks by frequency. Rare shingles are ordered by hash,
    so that a prefix is made of low hashes: these are counted exactly, and of the others those that a task meets again and again."""
    low = int(1.5 * (1 - p.num / p.den + 0.02) * 2**64)
    found = docs.select("text").mapInArrow(lambda it: _frequent(it, p.words, min(low, 2**64 - 1)), "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= BLOCK)
    top = found.orderBy(F.desc("c"), "h").limit(MAX_FREQUENT).select("h").toArrow()
    h = top["h"].to_numpy().astype(np.int64).view(np.uint64)
    rank = np.arange(len(h) - 1, -1, -1, dtype=np.uint64)  # rarer first
    order = np.argsort(h)
    return h[order], rank[order]


def _ordered(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Positions of shingles in the global order, sorted; signed so that they sort as they are."""
    o = s >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        o = np.where(hot[at] == s, _TOP | rank[at], o)
    o.sort()
    return (o ^ _TOP).view(np.int64)


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """doc_id, n (set size), hi and lo (the set's hash), node (a short hash with the size in its low SIZE_BITS bits) and prefix."""
    bc = docs.sparkSession.sparkContext.broadcast(frequent(docs, p))  # MAX_FREQUENT numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (hot, rank), cache, seen = bc.value, _Hashes(), set()
        for batch in batches:
            n, hi, lo, node, pre = [], [], [], [], []
            for text, named in zip(batch.column("text"), batch.column("doc_id").is_valid().to_pylist(), strict=True):
                s = shingles(text.as_py(), p.words, cache)
                n.append(len(s))
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                hi.append(int.from_bytes(d[:8], "little", signed=True))
                lo.append(int.from_bytes(d[8:], "little", signed=True))
                node.append((lo[-1] >> SIZE_BITS << SIZE_BITS) | len(s))
                if len(s) and named and d not in seen:  # copies within a task give their columns once; rows without an id none
                    seen.add(d)
                    pre.append(_ordered(s, hot, rank)[: p.prefix(len(s))])
                else:
                    pre.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, hi, lo, node)), pa.array(pre, pa.list_(pa.int64()))], ["doc_id", "n", "hi", "lo", "node", "prefix"]
            )

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(run, "doc_id bigint, n bigint, hi bigint, lo bigint, node bigint, prefix array<bigint>")


def _n(node: str) -> str:
    return f"({node} & {(1 << SIZE_BITS) - 1})"


def _verify(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, id, text) in order of block and side: sets of side 0 are held, sets of side 1 stream by."""
    cache, now, held, names, index = _Hashes(), None, [], [], None
    for batch in batches:
        a, b = [], []
        for block, side, i, text in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "id", "text")), strict=True):
            if block != now:
                now, held, names, index = block, [], [], None
            s = shingles(text, p.words, cache)
            if side == 0:
                held.append(s)
                names.append(i)
                continue
            if not held:
                continue
            if index is None:
                sizes = np.array([len(x) for x in held])
                flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
                order = np.argsort(flat, kind="stable")
                index = flat[order], owner[order], sizes
            flat, owner, sizes = index
            # the row of the product: how often each held set has a shingle of this one
            left, right = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            count = right - left
            total = int(count.sum())
            if not total:
                continue
            start = np.repeat(left - np.concatenate(([0], np.cumsum(count)[:-1])), count)
            overlap = np.bincount(owner[start + np.arange(total)], minlength=len(held))
            for j in np.flatnonzero((p.den * overlap >= p.num * (sizes + len(s) - overlap)) & (overlap > 0)):
                if names[j] != i:
                    a.append(names[j])
                    b.append(i)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _crossed(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, id, component, n, key, prefix, wide) in order of block and side: the product of prefixes, for sets
    that share column key. Of pairs of different components that reach their bound, both sides come out once a block; a pair is
    left to the first of the columns `wide` that it shares."""
    now, held, index, hubs, ids = None, [], None, set(), []

    def found() -> pa.RecordBatch:
        a = [index[2][j] for j in hubs] if hubs else []
        cols = [pa.array([now] * (len(a) + len(ids)), pa.string()), pa.array([0] * len(a) + [1] * len(ids), pa.int32()), pa.array([*a, *ids], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, ["block", "side", "id"])

    def matches(flat: np.ndarray, owner: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        left, right = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        count = right - left
        total = int(count.sum())
        if not total:
            return np.zeros(n, np.int64)
        start = np.repeat(left - np.concatenate(([0], np.cumsum(count)[:-1])), count)
        return np.bincount(owner[start + np.arange(total)], minlength=n)

    def indexed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(flat, kind="stable")
        return flat[order], owner[order]

    for batch in batches:
        sets, wides = batch.column("prefix"), batch.column("wide")
        for k, (block, side, i, comp, n, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "side", "id", "component", "n", "key")), strict=True)):
            if block != now:
                if ids:
                    yield found()
                now, held, index, hubs, ids = block, [], None, set(), []
            s, w = sets[k].values.to_numpy(), wides[k].values.to_numpy()
            w = w[w < key]
            if side == 0:
                held.append((s, w, i, comp, n))
                continue
            if not held:
                continue
            if index is None:
                sizes = np.array([x[4] for x in held])
                index = indexed([x[0] for x in held]), indexed([x[1] for x in held]), [x[2] for x in held], np.array([x[3] for x in held]), sizes, sizes - np.array([p.prefix(int(x)) for x in sizes])
            first, before, names, comps, sizes, rests = index
            shared = matches(*first, s, len(names))
            need = -(-p.num * (sizes + n) // (p.num + p.den)) - np.maximum(rests, n - p.prefix(n))
            fits = (p.den * np.minimum(sizes, n) >= p.num * np.maximum(sizes, n)) & (shared >= np.maximum(need, 1)) & (comps != comp)
            if fits.any() and len(w):
                fits &= matches(*before, w, len(names)) == 0
            if fits.any():
                hubs.update(np.flatnonzero(fits).tolist())
                ids.append(i)
    if ids:
        yield found()


def _tally(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, own, id, text) in order of block, side and id to (id, links): how many of the other side each set is
    linked with. Where a set meets its own part (own), pairs are met from both sides, so only the held one counts. Texts of one
    id count once. Shingles that many held sets have are multiplied as a dense matrix."""
    cache, now, held, names, index, chunk, size = _Hashes(), None, [], [], None, [], 0
    total: dict[int, int] = {}

    def build() -> tuple:
        sizes, owner = np.array([len(x) for x in held]), np.repeat(np.arange(len(held)), [len(x) for x in held])
        flat = np.concatenate(held)
        u, inv, c = np.unique(flat, return_inverse=True, return_counts=True)
        often = np.flatnonzero(c >= max(2, len(held) // 16))
        often = np.sort(often[np.argsort(-c[often], kind="stable")][: DENSE // len(held)])
        col = np.full(len(u), -1)
        col[often] = np.arange(len(often))
        at = col[inv]
        dense = np.zeros((len(held), len(often)), np.float32)
        dense[owner[at >= 0], at[at >= 0]] = 1
        rest, whose = flat[at < 0], owner[at < 0]
        order = np.argsort(rest, kind="stable")
        ids = np.array(names)
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        return sizes, u[often], dense, rest[order], whose[order], ids, first

    def multiply() -> None:
        nonlocal chunk, size, index
        if not chunk:
            return
        if index is None:
            index = build()
        sizes, cols, dense, rest, whose, ids, first = index
        n = np.array([len(s) for s, _, _ in chunk])
        flat, row = np.concatenate([s for s, _, _ in chunk]), np.repeat(np.arange(len(chunk)), n)
        m = np.zeros((len(chunk), len(cols)), np.float32)
        if len(cols):
            at = np.minimum(np.searchsorted(cols, flat), len(cols) - 1)
            hit = cols[at] == flat
            m[row[hit], at[hit]] = 1
        overlap = (m @ dense.T).astype(np.int64)
        left, right = np.searchsorted(rest, flat, "left"), np.searchsorted(rest, flat, "right")
        some = np.flatnonzero(right > left)
        count = (right - left)[some]
        ends = np.cumsum(count)
        lo = 0
        while lo < len(some):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 21), "right")))
            k = count[lo:hi]
            start = np.repeat(left[some[lo:hi]] - np.concatenate(([0], np.cumsum(k)[:-1])), k)
            cell = np.repeat(row[some[lo:hi]], k) * len(ids) + whose[start + np.arange(int(k.sum()))]
            overlap += np.bincount(cell, minlength=overlap.size).reshape(overlap.shape)
            lo = hi
        near = (p.den * overlap >= p.num * (sizes[None, :] + n[:, None] - overlap)) & (overlap > 0)
        asks = np.array([i for _, i, _ in chunk])
        near &= asks[:, None] != ids[None, :]
        if len(first) < len(ids):
            near = np.logical_or.reduceat(near, first, axis=1)
        start = np.flatnonzero(np.concatenate(([True], asks[1:] != asks[:-1])))
        if len(start) < len(asks):
            near = np.logical_or.reduceat(near, start, axis=0)
        for i, x in zip(ids[first].tolist(), near.sum(0).tolist(), strict=True):
            if x:
                total[i] = total.get(i, 0) + x
        for j, x in zip(start.tolist(), near.sum(1).tolist(), strict=True):
            if x and not chunk[j][2]:
                total[chunk[j][1]] = total.get(chunk[j][1], 0) + x
        chunk, size = [], 0

    def found() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "links"])
        total.clear()
        return out

    for batch in batches:
        for block, side, own, i, text in zip(*(batch.column(c).to_pylist() for c in ("block", "side", "own", "id", "text")), strict=True):
            if block != now:
                multiply()
                if total:
                    yield found()
                now, held, names, index = block, [], [], None
            s = shingles(text, p.words, cache)
            if side == 0:
                held.append(s)
                names.append(i)
            elif held:
                if chunk and chunk[-1][1] != i and (len(chunk) >= 256 or size >= 1 << 18):
                    multiply()
                chunk.append((s, i, own))
                size += len(s)
    multiply()
    if total:
        yield found()


def _counted(edges: DataFrame, wide: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """rep and links: how many other sets each set is linked with. wide has the sets (rep) of wide columns: pairs of these may be
    missing in edges, but only where edges join them to one component."""
    label = components(edges)
    member = label.join(wide, F.col("node") == F.col("rep")).select(F.col("node").alias("id"), "component")
    member = member.join(member.groupBy("component").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "component")
    member = member.withColumns({"blocks": F.ceil(F.col("m") / COUNT_HELD), "salts": F.ceil(F.col("m") / COUNT_STREAMED)}).withColumn("home", F.pmod(F.xxhash64("id"), "blocks"))
    member = common.written(member, "join-counted")
    cols = lambda side, own: (F.concat_ws(":", "component", "part", "salt").alias("block"), F.lit(side).alias("side"), own.alias("own"), "id")
    held = member.withColumn("part", F.col("home")).withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)")))
    stream = member.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(1)), "salts")).withColumn("part", F.explode(F.expr("sequence(home, blocks - 1)")))
    work = held.select(*cols(0, F.lit(True))).unionByName(stream.select(*cols(1, F.col("part") == F.col("home"))))
    work = work.hint("merge").join(_texts(docs, member.select("id")), "id").repartition("block").sortWithinPartitions("block", "side", "id")
    inner = work.select("block", "side", "own", "id", "text").mapInArrow(lambda it: _tally(it, p), "id bigint, links bigint").select(F.col("id").alias("rep"), "links")
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    flag = lambda c: wide.select(F.col("rep").alias(c), F.lit(True).alias(f"wide_{c}"))
    outer = ends.join(flag("a"), "a", "left").join(flag("b"), "b", "left").where("wide_a is null or wide_b is null").select(F.col("a").alias("rep"), F.lit(1).cast("bigint").alias("links"))
    return inner.unionByName(outer).groupBy("rep").agg(F.sum("links").alias("links"))


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of documents, those in ids and few others: a table of FILTER bits tells by a hash of the id which may be."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER))
    words = ids.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    words = words.toArrow()  # FILTER // 64 rows at most
    table = np.zeros(FILTER // 64, np.int64)
    table[words["at"].to_numpy()] = words["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be(bit: pd.Series) -> pd.Series:
        b = bit.to_numpy(np.int64)
        return pd.Series((shared.value[b >> 6] >> (b & 63)) & 1 == 1)

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), "text")
    return texts.where(may_be(bit))


def _linked(work: DataFrame, docs: DataFrame, p: Params) -> DataFrame:
    """Edges (a, b) found by the exact product of work (block, side, id)."""
    rows = work.hint("merge").join(_texts(docs, work.select("id")), "id").repartition("block").sortWithinPartitions("block", "side")
    return rows.select("block", "side", "id", "text").mapInArrow(lambda it: _verify(it, p), "a bigint, b bigint")


def _spread(pairs: DataFrame) -> DataFrame:
    """Work for pairs (hub, id): each hub is held, its partners stream by, STREAMED in a task."""
    degree = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("deg"))
    parts = pairs.join(degree, "hub").withColumn("salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("deg") / STREAMED)))
    block = F.concat_ws(":", "hub", "salt")
    probe = parts.select(block.alias("block"), F.lit(1).alias("side"), "id")
    return probe.unionByName(parts.select(block.alias("block"), F.lit(0).alias("side"), F.col("hub").alias("id")).distinct())


def join(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, n_shingles, component_id and links (how many other sets the row's set is linked with)."""
    return common.settled(lambda: _join(docs, p), "join-result")


def _join(docs: DataFrame, p: Params, count: bool = True) -> DataFrame:
    sig = common.written(signatures(docs, p), "join-signatures")
    named = sig.where("n > 0 and doc_id is not null")
    classes = common.written(
        named.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("node").alias("node"), F.first("n").alias("n"), F.first("prefix", ignorenulls=True).alias("prefix")), "join-classes"
    )
    entries = classes.select("node", F.explode("prefix").alias("key"))
    least = F.min(F.struct(F.expr(_n("node")).alias("n"), "node"))
    width = lambda df: df.groupBy("key").agg(F.count(F.lit(1)).alias("width"), least["node"].alias("pivot")).where("width > 1")
    # columns of frequent shingles (from 0 up, MAX_FREQUENT at most) are counted without dealing their sets out by column
    rare, often = entries.where("key < 0").repartition("key"), entries.where("key >= 0")
    columns = rare.join(width(rare), "key").unionByName(common.small_join(often, width(often), ["key"], "inner"))
    columns = common.written(columns, "join-columns")

    a, b = columns.where(F.col("width") <= BLOCK).alias("a"), columns.where(F.col("width") <= BLOCK).alias("b")
    na, nb = _n("a.node"), _n("b.node")
    pairs = a.join(b, F.expr(f"a.key = b.key and a.node < b.node and {p.den} * least({na}, {nb}) >= {p.num} * greatest({na}, {nb})"))
    counts = pairs.groupBy(F.col("a.node").alias("x"), F.col("b.node").alias("y")).agg(F.count(F.lit(1)).alias("c"))
    nx, ny = _n("x"), _n("y")
    bound = f"{p.overlap_sql(nx, ny)} - greatest({nx} - {p.prefix_sql(nx)}, {ny} - {p.prefix_sql(ny)})"
    narrow = counts.where(F.expr(f"c >= {bound}")).select("x", "y")

    wide = columns.where(F.col("width") > BLOCK)
    star = wide.withColumnRenamed("pivot", "x").where(F.expr(f"node <> x and {p.den} * {_n('x')} >= {p.num} * {_n('node')}")).select("x", F.col("node").alias("y")).distinct()

    # short names to representatives; equal short names of different sets give more candidates, never fewer
    rep = classes.select("node", "rep")
    found = narrow.unionByName(star).join(rep.select(F.col("node").alias("x"), F.col("rep").alias("hub")), "x").join(rep.select(F.col("node").alias("y"), F.col("rep").alias("id")), "y")
    alike = classes.groupBy("node").agg(F.min("rep").alias("hub"), F.collect_set("rep").alias("ids")).where("size(ids) > 1").select("hub", F.explode("ids").alias("id"))
    found = common.written(found.select("hub", "id").unionByName(alike).where("hub <> id").distinct(), "join-candidates")
    edges = common.written(_linked(_spread(found), docs, p).distinct(), "join-edges")

    # wide columns whose sets still lie in several components: first some sets of the largest component are held, then all others
    for first in (True, False) if not wide.isEmpty() else ():
        label = components(edges)
        member = wide.join(rep, "node").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        member = common.written(member.distinct(), "join-members")
        per = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"))
        main = per.groupBy("key").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("all")).where(F.col("top.m") < F.col("all"))
        main = common.written(main.select("key", F.col("top.component").alias("main"), F.col("top.m").alias("in_main"), "all"), "join-mixed")
        if main.isEmpty():
            break
        rows = common.small_join(member, main, ["key"], "inner")
        wides = rows.groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("wide"))  # part of the prefix
        inside = F.col("component") == F.col("main")
        if first:
            hold = inside & (F.pmod(F.xxhash64("rep", F.lit(2)), F.ceil(F.col("in_main") / PIVOTS)) == 0)
            rows, stream = rows.withColumn("blocks", F.lit(1).cast("bigint")), ~inside
        else:
            hold = ~inside
            rows, stream = rows.withColumn("blocks", F.ceil((F.col("all") - F.col("in_main")) / HELD)), F.lit(True)
        rows = rows.withColumn("salts", F.ceil(F.col("all") / STREAMED))
        salted = lambda side: (F.concat_ws(":", "key", "part", "salt").alias("block"), F.lit(side).alias("side"), F.col("rep").alias("id"), "component", "key")
        held = rows.where(hold).withColumn("part", F.pmod(F.xxhash64("rep"), "blocks")).withColumn("salt", F.explode(F.expr("sequence(0L, salts - 1)")))
        stream = rows.where(stream).withColumn("salt", F.pmod(F.xxhash64("rep", F.lit(1)), "salts")).withColumn("part", F.explode(F.expr("sequence(0L, blocks - 1)")))
        work = held.select(*salted(0)).unionByName(stream.select(*salted(1)))
        sets = classes.select(F.col("rep").alias("id"), "n", "prefix").join(wides.withColumnRenamed("rep", "id"), "id")
        work = work.join(sets, "id").repartition("block").sortWithinPartitions("block", "side")
        crossed = work.select("block", "side", "id", "component", "n", "key", "prefix", "wide").mapInArrow(lambda it: _crossed(it, p), "block string, side int, id bigint")
        crossed = common.written(crossed, "join-crossed")
        edges = common.written(edges.unionByName(_linked(crossed, docs, p)).distinct(), "join-edges")

    label = components(edges)
    reps = classes.select("hi", "lo", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    if count:
        reps = reps.join(_counted(edges, common.written(wide.select("node").distinct().join(rep, "node").select("rep").distinct(), "join-wide"), docs, p), "rep", "left")
    else:
        reps = reps.withColumn("links", F.lit(None).cast("bigint"))
    reps = reps.select("hi", "lo", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    out = sig.select("doc_id", "n", "hi", "lo").join(reps, ["hi", "lo"], "left")
    empty = F.col("n") == 0
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.when(empty, F.col("doc_id")).otherwise(F.col("component"))).alias("component_id"),
        F.when(empty, 0).otherwise(F.coalesce("links", F.lit(0))).alias("links"),
    )


def deduplicate(docs: DataFrame, p: Params = Params(words=5, num=80, den=100)) -> DataFrame:
    """The rows of docs whose id names their component, unchanged. Of rows with the same id one stays, of rows without an id
    all do."""
    verdict = common.settled(lambda: _join(docs, p, count=False).select("doc_id", "component_id"), "join-result").where("doc_id is not null")
    repeated = common.written(verdict.groupBy("doc_id").agg(F.count(F.lit(1)).alias("__rows"), F.min("component_id").alias("c")).where("__rows > 1 or c <> doc_id"), "join-repeated")
    gone = repeated.where("c <> doc_id").select(F.col("doc_id").alias("__id"))
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"))
    kept = packed.join(gone.hint("merge"), F.col("row_id") == F.col("__id"), "left_anti")
    again = repeated.where("c = doc_id").select(F.col("doc_id").alias("__id"))
    if again.isEmpty():
        return kept.select("row.*")
    single = kept.join(again, F.col("row_id") == F.col("__id"), "left_anti")
    return single.unionByName(kept.join(again, F.col("row_id") == F.col("__id"), "left_semi").dropDuplicates(["row_id"])).select("row.*")
