"""Elements of a list in JSON documents of any size, read in byte ranges.

A document {"cases": [{...}, {...}], ...} need not have a line feed anywhere, so it is read with the closing brace as the end of a
line: Spark's text source then splits it into byte ranges like any other file, in every store that it reads. What a range means depends
on what came before: whether it begins within a string, and how deep. Each range is scanned once under both assumptions about the
string (its effect on depth and string state), the ranges' effects are composed in order, and a second scan, which knows how its range
begins, gives the elements. An element that crosses ranges comes as pieces, which are put together by the place where it began.

Defined results: elements are objects of the list under the key of the outermost object; other keys, and elements that are no objects, are
passed over; a document without the key has no elements; an empty file has none; a file that ends within a string or an object is
an error; elements need not be JSON by themselves: what stands between their braces is the caller's to parse.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: where an element is: its file, the range in which it began, and its number in it
AT = "file string, block bigint, number bigint"
_STRUCTURE = re.compile(r'"(?:[^"\\]|\\.)*+("?)|[\[\]{}]', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*+("?)', re.S)
#: records (up to a closing brace) worked on at once
ROWS = 4096


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """Runs of records of the same range as texts; a range's records come in order."""
    for batch in batches:
        files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
        lo = 0
        while lo < len(files):
            hi = lo + 1
            while hi < len(files) and hi - lo < ROWS and files[hi] == files[lo] and blocks[hi] == blocks[lo]:
                hi += 1
            yield files[lo], blocks[lo], "}".join(batch.column("value").slice(lo, hi - lo).to_pylist()) + "}"
            lo = hi


def effect(text: str, within: bool) -> tuple[int, bool]:
    """Change of depth, and whether the end lies within a string, of a text that begins within one or not."""
    depth, at = 0, 0
    if within:
        m = _REST_OF_STRING.match(text)
        if not m[1]:
            return 0, True
        at = m.end()
    for m in _STRUCTURE.finditer(text, at):
        c = text[m.start()]
        if c == '"':
            if not m[1]:
                return depth, True
        else:
            depth += 1 if c in "[{" else -1
    return depth, False


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, int], list] = {}
    for file, block, text in _ranges(batches):
        now = held.setdefault((file, block), [0, False, 0, True])
        for k in (0, 2):
            d, now[k + 1] = effect(text, now[k + 1])
            now[k] += d
    yield pa.RecordBatch.from_pydict({
        "file": pa.array([f for f, _ in held], pa.string()), "block": pa.array([b for _, b in held], pa.int64()),
        **{c: pa.array([v[k] for v in held.values()], t) for k, (c, t) in enumerate([("out_depth", pa.int64()), ("out_within", pa.bool_()), ("in_depth", pa.int64()), ("in_within", pa.bool_())])},
    })


class _Scan:
    """The second scan of one range: elements that begin and end in it, and the pieces of those that do not."""

    def __init__(self, depth: int, within: bool):
        self.depth, self.within, self.number = depth, within, -1
        self.key, self.last = None, "" if within and depth == 1 else None  # null: as the ranges before have it
        self.open = [] if depth >= 3 else None  # pieces of the element that is open; depth 3 is inside of an object of a list
        self.rows: list[tuple] = []  # number (-1: began before), piece, whether it ends, key

    def feed(self, text: str) -> None:
        at = begin = 0
        if self.within:
            m = _REST_OF_STRING.match(text)
            at, self.within = m.end(), not m[1]
        if not self.within:
            for m in _STRUCTURE.finditer(text, at):
                c = text[m.start()]
                if c == '"':
                    if not m[1]:
                        self.within = True
                        break
                    if self.depth == 1:  # of the strings here, the last before a list is its key
                        self.last = json.loads(m[0], strict=False)
                elif c in "[{":
                    if self.depth == 1:
                        self.key = (_BEFORE if self.last is None else self.last) if c == "[" else ""
                    elif self.depth == 2 and c == "{":
                        self.number += 1
                        self.open, begin = [], m.start()
                    self.depth += 1
                else:
                    self.depth -= 1
                    if self.depth == 2 and self.open is not None:
                        self.open.append(text[begin : m.end()])
                        self.rows.append((self.number, "".join(self.open), True, self.key))
                        self.open = None
        if self.open is not None:
            self.open.append(text[begin:])


#: a key that stands in the range before
_BEFORE = "\0"
_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("number", pa.int64()), ("piece", pa.string()), ("ends", pa.bool_()), ("key", pa.string()), ("last", pa.string()), ("tail", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of text with the depth and string state at their range's begin, to pieces; a range's own last row, without a piece, tells its
    last key and string and the element that is open at its end."""
    now, place = None, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_PIECES)], schema=_PIECES)

    def closed() -> pa.RecordBatch:
        rest = [] if now.open is None else [(*place, now.number, "".join(now.open), False, now.key, None, None)]
        return out([*rest, (*place, None, None, None, now.key, now.last, None if now.open is None else now.number)])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "block", "depth", "within")]
        states = {(f, b): (d, w) for f, b, d, w in zip(*columns)}
        for file, block, text in _ranges(iter([batch])):
            if (file, block) != place:
                if now:
                    yield closed()
                now, place = _Scan(*states[file, block]), (file, block)
            now.feed(text)
            if now.rows:
                yield out([(*place, *r, None, None) for r in now.rows])
                now.rows = []
    if now:
        yield closed()


def _begins(effects: DataFrame) -> DataFrame:
    """Depth and string state at the begin and the end of every range, from the effects of those before it in its file. The effect on
    the string state keeps it, turns it or sets it; so it is what the last range that set it gave, turned as often as since."""
    order = Window.partitionBy("file").orderBy("block")  # one row a range
    sets = F.col("out_within") == F.col("in_within")
    rows = effects.withColumn("turns", F.sum(F.when(~sets & F.col("out_within"), 1).otherwise(0)).over(order))
    since = F.last(F.when(sets, F.col("out_within").cast("int") + F.col("turns")), ignorenulls=True).over(order)
    rows = rows.withColumn("end_within", (F.coalesce(since, F.lit(0)) + F.col("turns")) % 2 == 1)
    rows = rows.withColumn("within", F.coalesce(F.lag("end_within").over(order), F.lit(False)))
    change = F.when(F.col("within"), F.col("in_depth")).otherwise(F.col("out_depth"))
    rows = rows.withColumn("end_depth", F.sum(change).over(order)).withColumn("depth", F.col("end_depth") - change)
    return rows.select("file", "block", "depth", "within", "end_depth", "end_within")


def split(texts: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(element, at) of rows (value, file, block) of a text source whose lines end with a closing brace, and (file, error) of files
    that end in the middle. The rows of a range must be in one task, in order, as the text source has them."""
    begins = _begins(texts.mapInArrow(_effects, "file string, block bigint, out_depth bigint, out_within boolean, in_depth bigint, in_within boolean"))
    end = F.max_by(F.struct("end_depth", "end_within"), "block")
    broken = begins.groupBy("file").agg(end.alias("e")).where(F.col("e.end_within") | (F.col("e.end_depth") > 0)).select("file", F.lit("ends within an element").alias("error"))
    # one row a range of the text source (128 MB unless set otherwise), which keeps the order of the other side
    known = F.broadcast(begins.select(F.col("file").alias("f"), F.col("block").alias("b"), "depth", "within"))
    rows = texts.join(known, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).select("file", "block", "value", "depth", "within")
    pieces = rows.mapInArrow(_pieces, "file string, block bigint, number bigint, piece string, ends boolean, key string, last string, tail bigint")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.where("piece is null")
    ends = ends.withColumn("key", F.when(F.col("key") == _BEFORE, F.last("last", ignorenulls=True).over(before)).otherwise(F.col("key")))
    told = ends.select(
        "file", "block", F.last("last", ignorenulls=True).over(before).alias("said"), F.last("key", ignorenulls=True).over(before).alias("under"),
        F.last(F.when(F.col("tail") >= 0, F.struct("block", "tail")), ignorenulls=True).over(before).alias("owner"),
    )
    found = pieces.where("piece is not null").join(F.broadcast(told), ["file", "block"])  # one row a range
    found = found.withColumn("key", F.when(F.col("key") == _BEFORE, F.col("said")).otherwise(F.coalesce("key", "under"))).where(F.col("key") == key)
    whole = found.where(F.col("ends") & (F.col("number") >= 0)).select(F.col("piece").alias("element"), "file", "block", "number")
    # a range's end may be that of an element and the begin of another: pieces belong to where their element began
    parts = found.where(~(F.col("ends") & (F.col("number") >= 0)))
    owner = F.when(F.col("number") >= 0, F.struct("block", F.col("number").alias("tail"))).otherwise(F.col("owner"))
    parts = parts.groupBy("file", owner.alias("o")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece", "ends"))), lambda x: x["piece"]), "").alias("element"), F.max("ends").alias("ends"))  # of one element
    crossing = parts.where("ends").select("element", "file", F.col("o.block").alias("block"), F.col("o.tail").alias("number"))
    return whole.unionByName(crossing).select("element", F.struct("file", "block", "number").alias("at")), broken


def texts(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.option("lineSep", "}").text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read(spark: SparkSession, path: str, key: str) -> DataFrame:
    """element and at of every object of the list under a key, in all files of a path."""
    return split(texts(spark, path), key)[0]


def broken(spark: SparkSession, path: str) -> DataFrame:
    """file and error of files that end in the middle."""
    return split(texts(spark, path), "")[1]
