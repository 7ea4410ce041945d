"""Operator 4: tokens of each document in flat, unindexed token files, found by a separator scan.

A token file is a sequence of little-endian 16-bit ids, documents one after another, each closed by the separator id; it has no
index and knows nothing of ids of documents. A file is kept and read in blocks of BLOCK bytes, cut without regard to documents.
Each block is searched for separators by one vectorised comparison and gives its documents' ends; a prefix scan over the blocks
of a file (their counts of separators and the tokens left open at their ends) stitches documents that cross blocks.

Defined results: a document without tokens counts 0; tokens after the last separator of a file form a document of their own,
marked as open; a block of odd length is an error; empty files and empty tables give no rows; documents whose text is null count
as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .bpe import ROWS, coder, load_ranks

BLOCK = 1 << 18


def _files(batches: Iterator[pa.RecordBatch], shared: dict, separator: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) to blocks of the task's token file, and the ids of its documents in order (doc_id, ordinal)."""
    from pyspark import TaskContext

    file, rest, block, ordinal = TaskContext.get().partitionId(), b"", 0, 0
    enc = coder(shared)[0]
    close = np.array([separator], "<u2").tobytes()

    def out(payloads: list[bytes], ids: pa.Array | None, first: int) -> pa.RecordBatch:
        nonlocal block
        n, m = len(payloads), 0 if ids is None else len(ids)
        cols = [pa.array([file] * (n + m), pa.int64()), pa.array([*range(block, block + n), *[None] * m], pa.int64()), pa.array([*payloads, *[None] * m], pa.binary())]
        names = pa.nulls(n, pa.int64()) if ids is None else pa.concat_arrays([pa.nulls(n, pa.int64()), ids])
        block += n
        return pa.RecordBatch.from_arrays([*cols, pa.array([*[None] * n, *range(first, first + m)], pa.int64()), names], ["file", "block", "payload", "ordinal", "doc_id"])

    for batch in (whole.slice(k, ROWS) for whole in batches for k in range(0, whole.num_rows, ROWS)):
        parts = [rest]
        for text in batch.column("text"):
            parts += (np.frombuffer(enc.encode(text.as_py() or ""), np.uint32).astype("<u2").tobytes(), close)
        rest = b"".join(parts)
        whole = len(rest) // BLOCK * BLOCK
        yield out([rest[k : k + BLOCK] for k in range(0, whole, BLOCK)], batch.column("doc_id"), ordinal)
        rest, ordinal = rest[whole:], ordinal + batch.num_rows
    if rest:
        yield out([rest], None, ordinal)


def token_files(docs: DataFrame, ranks: str, pattern: str, separator: int) -> tuple[DataFrame, DataFrame]:
    """Token files of the documents' texts, one a task: blocks (file, block, payload), and what the writer knows besides: the
    place of each document (file, ordinal, doc_id)."""
    shared = docs.sparkSession.sparkContext.broadcast({"tokens": load_ranks(ranks), "pattern": pattern})  # fixed size
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        lambda it: _files(it, shared.value, separator), "file bigint, block bigint, payload binary, ordinal bigint, doc_id bigint"
    )
    rows = common.written(rows, "token-files")
    return rows.where("payload is not null").select("file", "block", "payload"), rows.where("ordinal is not null").select("file", "ordinal", "doc_id")


def _scan(batches: Iterator[pa.RecordBatch], separator: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, sizes = [], []
        for payload in batch.column("payload"):
            ids = np.frombuffer(payload.as_buffer(), "<u2")
            ends.append(np.flatnonzero(ids == separator).astype(np.int32))
            sizes.append(len(ids))
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["file", "block", "size", "ends"])


def count(blocks: DataFrame, separator: int) -> DataFrame:
    """file, ordinal, start (tokens before it in the file), n_tokens and closed of each document of the files."""
    found = common.written(blocks.select("file", "block", "payload").mapInArrow(lambda it: _scan(it, separator), "file bigint, block bigint, size bigint, ends array<int>"), "token-ends")
    # prefix scan over the blocks' summaries: tokens and documents before, and where the open document began
    summary = found.select("file", "block", "size", F.size("ends").alias("docs"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    summary = summary.withColumn("docs_before", F.coalesce(F.sum("docs").over(before), F.lit(0)))
    summary = summary.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
    placed = found.join(summary.select("file", "block", "base", "docs_before", "open"), ["file", "block"])
    each = placed.select("file", "base", "docs_before", "open", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("ends", F.col("i") - 1) + 1)
    closed = each.select("file", (F.col("docs_before") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    whole = summary.groupBy("file").agg(F.sum("size").alias("size"), F.sum("docs").alias("docs"), F.max(F.coalesce(F.col("base") + F.col("last") + 1, F.lit(0))).alias("done"))
    tail = whole.where("size > done").select("file", F.col("docs").alias("ordinal"), F.col("done").alias("start"), (F.col("size") - F.col("done")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(tail)


def document_counts(docs: DataFrame, ranks: str, pattern: str, separator: int) -> DataFrame:
    """doc_id, file, ordinal, start and n_tokens of every document, by writing token files and scanning them."""

    def work() -> DataFrame:
        blocks, places = token_files(docs, ranks, pattern, separator)
        return places.join(count(blocks, separator), ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "start", "n_tokens")

    return common.settled(work, "token-counts")
