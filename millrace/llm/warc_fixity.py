"""Operator 5: fixity audit of WARC replicas by Merkle trees.

Each page is a WARC response record: header lines, an empty line, the html, an empty line. Records lie one after another in
files; a record's offset is the sum of the lengths before it. Leaves hash records; an inner node hashes the FAN nodes below it in
order, each with the offset range that it spans, counted from the node's own start, so that a change of length does not show in
the branches behind it; a file's root stands for all of it. Two replicas are compared root by root, then only below nodes that
differ, level by level, until the records remain that are changed, missing or extra.

Records of a file are numbered by ordered ids, so that both replicas number alike; an id that only one replica has keeps its own
leaf position. A file has the records of FILE ids, files are named by ranges of ids. Each level of a tree is written once; from
the roots down, a level is joined with the open nodes above it alone.

`archives` makes WARC files of pages, `records` reads the records of such files with their offsets, so that `audit` can be held
against files as they lie: the bytes of a file from a record's start to its end are the record. `read` reads WARC files of any
writer, plain or gzip members, and `audit_files` compares two sets of them record by record. A file is one row, below 2 GB.

Defined results: a null html is an empty payload, a null url an empty target; rows without an id take no part; of rows with one
id all versions are hashed together, whatever their order and number (sums of their hashes), so repeated rows in one replica
only show as a change; identical replicas give no rows; an empty replica gives all records of the other as missing or extra; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FAN, FILE = 16, 4096
LEVELS = 3  # FAN ** LEVELS == FILE


def record(url: Column, page_id: Column, payload: Column) -> Column:
    """The bytes of a record; the length line tells the payload's bytes."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """file, slot (place in the file), page_id, start, end and hash of each record."""
    rec = record(F.col("url"), F.col("page_id"), F.col("html"))
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), F.sha2(rec.cast("binary"), 256).alias("h"), F.octet_length(rec).cast("bigint").alias("len"))
    # versions of one id are summed up, not gathered: four pieces of 60 bits of their hashes
    pieces = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    rows = rows.groupBy("page_id").agg(F.when(F.count(F.lit(1)) == 1, F.max("h")).otherwise(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *pieces)).alias("h"), F.sum("len").alias("len"))
    file = F.floor(F.col("page_id") / FILE)
    before = Window.partitionBy("file").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("file", file).withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("len"))
    return rows.select("file", F.pmod("page_id", F.lit(FILE)).alias("slot"), "page_id", "start", "end", F.sha2("h", 256).alias("hash"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels from the leaves up; the last has one node a file."""
    out = [leaf.select("file", F.col("slot").alias("node"), "start", "end", "hash")]
    for _ in range(LEVELS):
        below = out[-1]
        kids = F.array_sort(F.collect_list(F.struct("node", "start", "end", "hash")))  # FAN at most
        up = below.groupBy("file", F.floor(F.col("node") / FAN).alias("up")).agg(kids.alias("kids"), F.min("start").alias("start"), F.max("end").alias("end"))
        named = F.transform("kids", lambda k: F.concat_ws(":", k["node"], k["start"] - F.col("start"), k["end"] - F.col("start"), k["hash"]))
        out.append(common.written(up.select("file", F.col("up").alias("node"), "start", "end", F.sha2(F.array_join(named, ","), 256).alias("hash")), "fixity-level"))
    return out


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """page_id, file, kind (changed, missing from right, extra in right), and offset ranges in both replicas, of every
    record that differs. Trees are compared from the roots down; a level is only read below nodes that differ."""
    return common.settled(lambda: _audit(left, right), "fixity-result")


def _audit(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = (common.written(leaves(x), "fixity-leaves") for x in (left, right))
    ta, tb = tree(a), tree(b)
    open_nodes = None
    for level in range(LEVELS, -1, -1):
        x, y = ta[level], tb[level]
        if open_nodes is not None:
            near = open_nodes.select("file", F.col("node").alias("up"))
            x, y = (t.withColumn("up", F.floor(F.col("node") / FAN)).join(near, ["file", "up"], "left_semi") for t in (x, y))
        y = y.select("file", "node", F.col("hash").alias("other"))
        both = x.select("file", "node", "hash").join(y, ["file", "node"], "full_outer")
        open_nodes = common.written(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node"), f"fixity-open{level}")
    found = open_nodes.withColumnRenamed("node", "slot")
    x = a.select("file", "slot", F.col("page_id").alias("p"), F.col("start").alias("left_start"), F.col("end").alias("left_end"))
    y = b.select("file", "slot", F.col("page_id").alias("q"), F.col("start").alias("right_start"), F.col("end").alias("right_end"))
    out = found.join(x, ["file", "slot"], "left").join(y, ["file", "slot"], "left")
    kind = F.when(F.col("q").isNull(), "missing").when(F.col("p").isNull(), "extra").otherwise("changed")
    return out.select(F.coalesce("p", "q").alias("page_id"), "file", kind.alias("kind"), "left_start", "left_end", "right_start", "right_end")


def archives(pages: DataFrame) -> DataFrame:
    """file and warc (the file's bytes) of pages: the records of FILE ids one after another."""
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("bigint").alias("page_id"), record(F.col("url"), F.col("page_id"), F.col("html")).alias("r"))
    in_order = F.array_sort(F.collect_list(F.struct("page_id", "r")))
    return rows.groupBy(F.floor(F.col("page_id") / FILE).alias("file")).agg(F.array_join(F.transform(in_order, lambda x: x["r"]), "").cast("binary").alias("warc"))


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Start, end and content of a file's gzip members; a plain file is one."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data
        return
    at = 0
    while at < len(data):
        z, parts, to = zlib.decompressobj(31), [], at
        while not z.eof and to < len(data):
            parts.append(z.decompress(data[to : to + 65_536]))
            to = min(to + 65_536, len(data))
        if not z.eof:
            raise ValueError(f"the member at {at} is cut")
        to -= len(z.unused_data)
        yield at, to, b"".join(parts)
        at = to


def _fields(lines: list[str]) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    out, last = {}, ""
    for line in lines:
        if line[:1] in (" ", "\t"):
            out[last] = f"{out.get(last, '')} {line.strip()}".strip()
        else:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def _found(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Fields, block, start and end of each record; those of a gzip member have the member's."""
    for start, stop, text in _members(data):
        at, plain = 0, text is data
        while at < len(text):
            head = text.find(b"\r\n\r\n", at)
            lines = text[at:head].decode("utf-8", "replace").split("\r\n") if head >= 0 else [""]
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at {at if plain else start}")
            fields = _fields(lines[1:])
            size = fields.get("content-length", "")
            end = head + 8 + int(size) if size.isdecimal() else -1
            if text[end - 4 : end] != b"\r\n\r\n":
                raise ValueError(f"the record at {at if plain else start} is cut")
            yield fields, text[head + 4 : end - 4], *((at, end) if plain else (start, stop))
            at = end


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "type", "uri", "block", "file", "start", "end"]
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.int64())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for file, data in zip(batch.column("file").to_pylist(), batch.column("warc").to_pylist(), strict=True):
            rows, size = [], 0
            try:
                for fields, block, start, end in _found(data or b""):
                    rows.append((fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), block, file, start, end))
                    size += len(block)
                    if size > 8_000_000 or len(rows) == 256:
                        yield batch_of(rows)
                        rows, size = [], 0
            except (ValueError, zlib.error) as e:
                raise ValueError(f"file {file}: {e}") from e
            if rows:
                yield batch_of(rows)


def read(files: DataFrame) -> DataFrame:
    """record_id, type, uri, block (bytes), file, start and end of the records of WARC files (file, warc), of any type; null for
    a field that a record lacks. What is no record is an error. Records of one gzip member have the member's start and end."""
    schema = "record_id string, type string, uri string, block binary, file string, start bigint, end bigint"
    return files.select(F.col("file").cast("string").alias("file"), "warc").mapInArrow(_read, schema)


def records(files: DataFrame) -> DataFrame:
    """page_id, url, html, file, start and end of the pages in files that `archives` made."""
    own = F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1)
    return read(files).where(own != "").select(own.cast("bigint").alias("page_id"), F.col("uri").alias("url"), F.col("block").cast("string").alias("html"), F.col("file").cast("bigint").alias("file"), "start", "end")


def _numbered(ids: DataFrame) -> DataFrame:
    """record_id and page_id, its number from 0 in order."""
    ids = common.written(ids.distinct().repartitionByRange("record_id").withColumn("part", F.spark_partition_id()), "fixity-ids")
    sizes = ids.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    ids = ids.withColumn("i", F.row_number().over(Window.partitionBy("part").orderBy("record_id")))
    return common.small_join(ids, sizes.select("part", before.alias("before")), ["part"], "inner").select("record_id", (F.col("before") + F.col("i") - 1).alias("page_id"))


def audit_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """record_id, kind, and file, start and end in both sets of files (file, warc) of every record whose type, uri or block
    differs, or that one set lacks. Records that lack an id take no part; of records with one id the first place is told."""
    return common.settled(lambda: _audit_files(left, right), "fixity-files")


def _audit_files(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = (common.written(read(x).where("record_id is not null"), "fixity-read") for x in (left, right))
    ids = common.written(_numbered(a.select("record_id").unionAll(b.select("record_id"))), "fixity-numbers")
    # lengths before the parts, so that no two different records read alike
    text = F.concat(*[x for c in ("type", "uri") for x in (F.coalesce(F.octet_length(c), F.lit(-1)).cast("string"), F.lit(" "), F.coalesce(c, F.lit("")))], F.col("block").cast("string"))
    pages = [x.join(ids, "record_id").select("page_id", F.lit(None).cast("string").alias("url"), text.alias("html")) for x in (a, b)]
    found = audit(*pages).select("page_id", "kind").join(ids, "page_id").drop("page_id")
    for side, x in (("left", a), ("right", b)):
        place = x.groupBy("record_id").agg(F.min(F.struct("file", "start", "end")).alias("at"))
        found = found.join(place.select("record_id", *[F.col(f"at.{c}").alias(f"{side}_{c}") for c in ("file", "start", "end")]), "record_id", "left")
    return found


def damaged(pages: DataFrame) -> DataFrame:
    """A second replica with known faults, by id: 7 of 1009 loses its record, 11 of 1013 has a byte turned, 13 of 1019 is cut
    short."""
    html, i = F.coalesce(F.col("html"), F.lit("")), F.col("page_id")
    turned = F.concat(F.lit("~"), F.substring(html, 2, 2**31 - 1))
    bad = F.when(i % 1013 == 11, turned).when(i % 1019 == 13, F.substring(html, 1, 100)).otherwise(F.col("html"))
    return pages.where((i % 1009 != 7) | i.isNull()).withColumn("html", bad)
