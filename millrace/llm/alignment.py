"""Operator 13: tokens of two tokenizers aligned by bytes, and how many documents hold each linked pair of ids.

A text is cut before single spaces and line feeds between other characters, where neither tokenizer ever joins (`Units` looks
through both vocabularies and cuts nothing if one of them could). Equal pieces are encoded once a worker, many at a time; the ends of
their tokens, merged, give links (one for each stretch between neighbouring ends) and groups (ends that both share).

A pair of ids is one number: A's id * 2^32 + B's id. Tasks gather documents into chunks and count in how many documents of the chunk
a pair occurs (np.unique); partial counts are sorted by range, and runs of equal keys summed (np.add.reduceat). What the highest
count of an A id is follows by one aggregate, a row an id. Sorted shards of (key, count, whether it is the highest) are written as
flat files in the shared folder; the tasks that finish the chunks map them into memory and look keys up by searchsorted, so
that no lookup is shuffled and only the touched pages are read. Where Python cannot open the shared folder (it is no mounted file system),
chunks meet the counts in a join of keys instead; the rows are the same.

Defined results: texts that are null or empty, and texts whose tokens do not spell them (for one of the two), have no tokens:
zeros and an empty column of groups. Rows without an id are documents like any; equal rows count each; extra columns play no part.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: pieces of text after which a chunk ends, and pieces that a worker keeps encoded
CHUNK, CACHE = 1 << 19, 150_000
#: chunks handed to Python at once where they are finished
HANDED = 4
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: what tasks hold of their input at once: else a worker and its executor each hold up to 64 MB of texts a task
_SMALL = {_BATCH: "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20), "spark.sql.parquet.columnarReaderBatchSize": "256"}
#: pieces encoded at once, and texts looked through at once
BLOCK, ROWS = 20_000, 128

RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_CHUNK = pa.schema([("chunk", pa.string()), ("doc_id", pa.list_(pa.int64())), *[(c, pa.list_(pa.int64())) for c in _COUNTS], ("groups_sha256", pa.list_(pa.string())),
                    ("sizes", pa.binary()), ("units", pa.binary()), ("widths", pa.binary()), ("pairs", pa.binary()), ("keys", pa.binary()), ("counts", pa.binary())])
_RESULT = pa.schema([(c.split()[0], pa.int64() if c.endswith("bigint") else pa.string()) for c in RESULT.split(", ")])

_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: white space that is no single space or line feed between other characters
_ODD = re.compile(r"\s\s|[^\S \n]|^\s|\s$")


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Grown:
    """An array that rows are put to; room doubles."""

    def __init__(self, kind: type, *shape: int) -> None:
        self.room, self.n = np.zeros((1024, *shape), kind), 0

    def extend(self, rows: np.ndarray) -> None:
        while self.n + len(rows) > len(self.room):
            self.room = np.concatenate([self.room, np.zeros_like(self.room)])
        self.room[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    @property
    def rows(self) -> np.ndarray:
        return self.room[: self.n]


def _ranges(starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The numbers of all places of some ranges."""
    return np.repeat(starts - np.cumsum(widths) + widths, widths) + np.arange(widths.sum())


class Units:
    """Both tokenizers, and the pieces of text that were encoded: each a number, under which its results lie."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        values = byte_values()
        a_bytes = {i: bytes(values[c] for c in t) if all(c in values for c in t) else t.encode() for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        a_bytes |= {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items() if i not in a_bytes}
        self.a_size = np.zeros(max(a_bytes) + 1, np.int64)
        for i, t in a_bytes.items():
            self.a_size[i] = len(t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_size = np.array([len(t) for t in self.b_bytes], np.int64)
        #: no piece goes on after its first character other than a space into another space, or holds a line feed
        self.cuts = not any(re.search("[^▁]▁|\n", p) for i, p in enumerate(pieces) if not (self.b.is_control(i) or self.b.is_unknown(i)))
        self.space = self.b.piece_to_id("▁")
        # ids as they are written: A's within a group and at its end, B's within and at the end
        m, n = len(self.a_size), len(pieces)
        self.written = [f"{i}{c}" for k, c in ((m, ","), (m, "|"), (n, ","), (n, ";")) for i in range(k)]
        self.width = np.array([len(t) for t in self.written], np.int64)
        self.number: dict[str, int] = {}
        self.text: list[str] = []  # groups, each piece's closed by a semicolon
        self.shape = Grown(np.int64, 4)  # tokens of A, of B, groups, links
        self.same = Grown(np.bool_)
        self.seen = Grown(np.int64)
        self.keys = Grown(np.int64)  # links of all pieces one after another
        self.start = Grown(np.int64)

    def pieces(self, text: str) -> list[str]:
        """The pieces of space + text; one that begins with a space, and goes on with neither a space nor a line feed, has lost it."""
        if self.cuts and not _ODD.search(text):
            return text.replace("\n", " \n").split(" ")
        first, *others = _CUT.split(text) if self.cuts else [text]
        return [" " + first if first[0] in " \n" else first, *[p[1:] if p[0] == " " else p for p in others]]

    def add(self, new: list[str]) -> None:
        """Encode pieces that have no number yet."""
        for k in range(0, len(new), BLOCK):
            self._add(new[k : k + BLOCK])

    def _add(self, new: list[str]) -> None:
        plain = [p if p[0] in " \n" else " " + p for p in new]
        a = [e.ids for e in self.a.encode_batch(plain, add_special_tokens=False)]
        b = self.b.encode([p[1:] if p[0] == " " else p for p in plain], num_threads=1)  # which adds a space
        for k, p in enumerate(plain):
            if p[0] == "\n" and b[k][:1] == [self.space]:
                b[k] = b[k][1:]
        raw, same = [p.encode() for p in plain], np.ones(len(new), np.bool_)
        if b"".join(map(self.b_bytes.__getitem__, chain.from_iterable(b))) != b"".join(raw):
            # pieces that B does not spell get no links; texts with one have none
            same = np.array([b"".join(map(self.b_bytes.__getitem__, ids)) == t for ids, t in zip(b, raw)])
            a, b = ([x if ok else [] for x, ok in zip(ids, same)] for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(new)) for x in (a, b))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, n.sum()) for x, n in ((a, n_a), (b, n_b)))
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        unit = np.cumsum(np.fromiter(map(len, raw), np.int64, len(new)) * same)
        both = np.sort(np.concatenate([end_a, end_b]))
        twice = both[1:] == both[:-1]
        shared, ends = both[1:][twice], both[np.concatenate([~twice, [True] * (len(both) > 0)]).astype(np.bool_)]
        keys = flat_a[np.searchsorted(end_a, ends)] << 32 | flat_b[np.searchsorted(end_b, ends)]
        links, groups = (np.diff(np.searchsorted(x, unit, "right"), prepend=0) for x in (ends, shared))
        # the groups as they are written: A's tokens of a group, then B's
        m, n = len(self.a_size), len(self.b_bytes)
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        last_a, last_b = (np.concatenate([g[1:] != g[:-1], [True] * (len(g) > 0)]).astype(np.bool_) for g in (group_a, group_b))
        entry = np.concatenate([flat_a + m * last_a, 2 * m + flat_b + n * last_b])
        place = np.concatenate([np.arange(len(flat_a)) + np.searchsorted(group_b, group_a), np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")])
        order = np.zeros(len(entry), np.int64)
        order[place] = entry
        text = "".join(map(self.written.__getitem__, order.tolist()))
        upto = np.concatenate([[0], np.cumsum(self.width[order])])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        first = len(self.text)
        self.number.update(zip(new, range(first, first + len(new))))
        self.text += [text[i:j] for i, j in zip(upto, upto[1:])]
        self.shape.extend(np.stack([n_a, n_b, groups, links], axis=1))
        self.same.extend(same)
        self.seen.extend(np.zeros(len(new), np.int64))
        self.start.extend(self.keys.n + np.cumsum(links) - links)
        self.keys.extend(keys)

    def thin(self, most: int) -> None:
        """Keep the pieces that were seen most often, so many at most; all get other numbers."""
        seen = self.seen.rows
        least = 2
        while np.count_nonzero(seen >= least) > most:
            least *= 2
        kept = np.flatnonzero(seen >= least)
        links = self.shape.rows[kept, 3]
        keys = self.keys.rows[_ranges(self.start.rows[kept], links)]
        names = list(self.number)  # in order of their numbers
        self.number = {names[i]: k for k, i in enumerate(kept.tolist())}
        self.text = [self.text[i] for i in kept.tolist()]
        for grown, rows in ((self.shape, self.shape.rows[kept]), (self.same, self.same.rows[kept]), (self.seen, np.ones(len(kept), np.int64)), (self.start, np.cumsum(links) - links), (self.keys, keys)):
            grown.n = 0
            grown.extend(rows)


class Chunk:
    """Documents gathered until their pieces fill a row of the chunks' table."""

    def __init__(self) -> None:
        self.ids, self.counts, self.shas, self.units, self.size = [], [], [], [], 0

    def add(self, doc_id: int | None, numbers: list[int], u: Units) -> None:
        units = np.array(numbers, np.int64)
        if not u.same.rows[units].all():
            numbers, units = [], units[:0]
        self.ids.append(doc_id)
        self.units.append(units.astype(np.int32))
        self.counts.append(u.shape.rows[units].sum(axis=0))
        self.shas.append(hashlib.sha256("".join(map(u.text.__getitem__, numbers))[:-1].encode()).hexdigest() if numbers else "")
        self.size += len(numbers)

    def row(self, u: Units) -> pa.RecordBatch:
        sizes, every = np.array([len(x) for x in self.units], np.int32), np.concatenate(self.units)
        times = np.bincount(every, minlength=len(u.text))
        u.seen.rows[:] += times
        used = np.flatnonzero(times)
        units = (np.cumsum(times > 0) - 1)[every]
        widths = u.shape.rows[used, 3]
        keys, pairs = np.unique(u.keys.rows[_ranges(u.start.rows[used], widths)], return_inverse=True)
        # in how many documents: of the pairs of a document, that which was written last under its number counts
        starts, counts, mark, at = np.cumsum(widths) - widths, np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32), 0
        for n in sizes.tolist():
            own = units[at : at + n]
            held = pairs[_ranges(starts[own], widths[own])]
            order = np.arange(len(held), dtype=np.int32)
            mark[held] = order
            counts[held[mark[held] == order]] += 1
            at += n
        packed = [x.tobytes() for x in (sizes, units.astype(np.int32), widths.astype(np.int32), pairs.astype(np.int32), keys, counts)]
        values = [uuid.uuid4().hex, self.ids, *np.array(self.counts).T, self.shas, *packed]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CHUNK)], schema=_CHUNK)


#: the tokenizers that this worker used last
_kept: dict[tuple[str, str], Units] = {}


def _gather(batches: Iterator[pa.RecordBatch], shared: dict, chunk: int, cache: int) -> Iterator[pa.RecordBatch]:
    if "units" not in shared:  # kept with the worker's copy of the broadcast value, and for later runs: a second pair beside the first takes as much memory again
        key = shared["a"], shared["b"]
        if key not in _kept:
            _kept.clear()
            _kept[key] = Units(*key)
        shared["units"] = _kept[key]
    u, now = shared["units"], Chunk()
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            rows = [(i, u.pieces(t) if t else []) for i, t in zip(batch.column("doc_id").slice(k, ROWS).to_pylist(), batch.column("text").slice(k, ROWS).to_pylist())]
            u.add(list({p for _, ps in rows for p in ps if p not in u.number}))
            for i, ps in rows:
                now.add(i, list(map(u.number.__getitem__, ps)), u)
            if now.size >= chunk or len(now.ids) >= chunk // 8 or len(u.text) >= cache:
                yield now.row(u)
                now = Chunk()
                if len(u.text) >= cache:
                    u.thin(cache // 2)
    if now.ids:
        yield now.row(u)


@contextlib.contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings that hold for what is written within."""
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def chunks(docs: DataFrame, a_file: str, b_file: str, *, chunk: int = CHUNK, cache: int = CACHE) -> DataFrame:
    """Documents aligned, in chunks of about so many pieces; written."""
    shared = docs.sparkSession.sparkContext.broadcast({"a": a_file, "b": b_file})
    ddl = "chunk string, doc_id array<bigint>, " + "".join(f"{c} array<bigint>, " for c in _COUNTS) + "groups_sha256 array<string>, sizes binary, units binary, widths binary, pairs binary, keys binary, counts binary"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(lambda it: _gather(it, shared.value, chunk, cache), ddl)
    with _set(docs.sparkSession, _SMALL):
        return common.written(rows, "align-chunks", common.WIDE)


_PARTIAL = pa.schema([("key", pa.int64()), ("n", pa.int64())])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts")):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (keys, counts)], schema=_PARTIAL)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys in a sorted partition, summed; the last run of a batch may go on in the next."""
    held_key, held = None, 0
    for batch in batches:
        keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys, n = keys[starts], np.add.reduceat(n, starts)
        if held_key is not None:
            if keys[0] == held_key:
                n[0] += held
            else:
                keys, n = np.concatenate(([held_key], keys)), np.concatenate(([held], n))
        held_key, held = keys[-1], n[-1]
        yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), pa.array(n[:-1])], schema=_PARTIAL)
    if held_key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held_key], pa.int64()), pa.array([held], pa.int64())], schema=_PARTIAL)


def pair_counts(rows: DataFrame) -> DataFrame:
    """key, n (documents that hold the pair linked) and best (whether no other pair of the A id has more) of every pair; written in
    order of keys, one range a file."""
    partial = rows.select("keys", "counts").mapInArrow(_unpacked, "key bigint, n bigint")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with _set(rows.sparkSession, {k: v for k, v in _SMALL.items() if k != _BATCH}):  # keys are narrow, chunks are not
        counted = common.written(partial.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(_summed, "key bigint, n bigint"), "align-counts")
    top = counted.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("top"))  # a row an id of A's vocabulary: 2^17 at most
    joined = counted.join(F.broadcast(top), F.shiftright("key", 32) == top["a"])
    return joined.select("key", "n", (F.col("n") == F.col("top")).alias("best"))


def _shard(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """A sorted partition as two flat files; a row that names them. A repeated attempt writes files of its own, and only what the
    attempt that counts has named is read."""
    os.makedirs(folder, exist_ok=True)
    name, first, last, total = f"{folder}/{uuid.uuid4().hex}", None, None, 0
    with open(name + ".keys", "wb") as keys, open(name + ".counts", "wb") as counts:
        for batch in batches:
            k = batch.column("key").to_numpy()
            if not len(k):
                continue
            keys.write(k.tobytes())
            best = batch.column("best").to_numpy(zero_copy_only=False)
            counts.write((batch.column("n").to_numpy() << 1 | best).tobytes())
            first, last, total = int(k[0]) if first is None else first, int(k[-1]), total + len(k)
    if total:
        yield pa.RecordBatch.from_pydict({"name": [name], "first": [first], "last": [last], "n": [total]})
    else:
        os.remove(name + ".keys")
        os.remove(name + ".counts")


def mounted(spark: SparkSession) -> str | None:
    """The shared folder as a path that Python can open on every machine, if it is one."""
    found = re.match(r"(?:file:(?://)?)?(/.*)", common.shared_dir(spark))
    return found[1] if found else None


def shards(counts: DataFrame, folder: str) -> list[tuple[str, int, int, int]]:
    """Sorted shards of counts in flat files; their names, bounds and sizes (one row a partition)."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = counts.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(lambda it: _shard(it, folder), "name string, first bigint, last bigint, n bigint")
    return sorted(((r["name"], r["first"], r["last"], r["n"]) for r in rows.collect()), key=lambda s: s[1])


def looked_up(keys: np.ndarray, files: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Count * 2 + best of each of some sorted keys, all of which lie in a shard."""
    out = np.zeros(len(keys), np.int64)
    for name, first, last, n in files:
        lo, hi = np.searchsorted(keys, first), np.searchsorted(keys, last, "right")
        if lo < hi:
            held, values = (np.memmap(f"{name}.{x}", np.int64, "r", shape=(n,)) for x in ("keys", "counts"))
            out[lo:hi] = values[np.searchsorted(held, keys[lo:hi])]
    return out


def _finished(row: dict, found: np.ndarray) -> pa.RecordBatch:
    """A chunk's documents, given count * 2 + best of its keys."""
    sizes, units, widths, pairs = (np.frombuffer(row[c], np.int32) for c in ("sizes", "units", "widths", "pairs"))

    def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        ends = np.concatenate(([0], np.cumsum(values)))[np.concatenate(([0], np.cumsum(lengths)))]
        return ends[1:] - ends[:-1]

    best, total = (sums(sums(v[pairs], widths)[units], sizes) for v in (found & 1, found >> 1))
    cols = [row["doc_id"], *[row[c] for c in _COUNTS], best, total, row["groups_sha256"]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RESULT)], schema=_RESULT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _mapped(batches: Iterator[pa.RecordBatch], files: list[tuple[str, int, int, int]]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        yield _finished(row, looked_up(np.frombuffer(row["keys"], np.int64), files))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        yield _finished(row, np.array([x["v"] for x in sorted(row["found"] or [], key=lambda x: x["key"])], np.int64))


def align(docs: DataFrame, a_file: str, b_file: str, *, chunk: int = CHUNK, cache: int = CACHE, files: bool = True) -> DataFrame:
    """One row a document, as RESULT has it. a_file: a byte-level tokenizer as JSON; b_file: a piece model. files=False: counts are looked
    up by a join even where the shared folder can be mapped."""
    spark = docs.sparkSession
    batch = spark.conf.get(_BATCH)

    def work() -> DataFrame:
        rows = chunks(docs, a_file, b_file, chunk=chunk, cache=cache)
        counts = common.written(pair_counts(rows), "align-pairs")
        folder = mounted(spark) if files else None
        if folder:
            folder = f"{folder}/align-shards-{uuid.uuid4().hex}"
            named = shards(counts, folder)
            kept.append(folder)
            spark.conf.set(_BATCH, str(HANDED))  # else a task is handed all chunks of its split at once, which grow with the input
            return rows.drop("counts").mapInArrow(lambda it: _mapped(it, named), RESULT)
        keys = rows.select("chunk", "keys").mapInArrow(_chunk_keys, "chunk string, key bigint")
        found = keys.join(counts, "key").groupBy("chunk").agg(F.collect_list(F.struct("key", (F.col("n") * 2 + F.col("best").cast("bigint")).alias("v"))).alias("found"))  # of one chunk
        return rows.drop("counts").join(found, "chunk", "left").mapInArrow(_joined, RESULT)

    kept: list[str] = []
    try:
        return common.settled(work, "align-result")
    finally:
        spark.conf.set(_BATCH, batch)
        for folder in kept:  # the driver sees the shared folder as the tasks do
            p = spark._jvm.org.apache.hadoop.fs.Path("file://" + folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk, keys in zip(batch.column("chunk"), batch.column("keys")):
            k = np.frombuffer(keys.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()] * len(k), pa.string()), pa.array(k)], ["chunk", "key"])


def pairs(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """a, b and n: how many documents hold the two ids linked; best: no other pair of the A id has more."""
    out = common.settled(lambda: pair_counts(chunks(docs, a_file, b_file)), "align-pairs")
    return out.select(F.shiftright("key", 32).alias("a"), F.col("key").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n", "best")
