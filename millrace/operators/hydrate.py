"""Texts of documents fetched from where they lie, as a queue that is drained in leased batches.

A batch is the pending documents with the least ids that nobody holds; a commit writes their leases, which run out by themselves if their
holder dies. The texts are fetched in lanes that keep one rate together, written once, and put into the documents' buckets by a second
commit that also ends the leases. If that commit meets another writer's, only it is tried again; if the holder dies before it, the
written texts are found by the next run and put in without fetching them again. One document that fails is marked and told in
rejects, and the others go on.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.rest import RestReader
from . import warehouse
from .ingest import NO_TEXT, Warehouse, to_hydrate

_SCHEMA = pa.schema([("id", pa.string()), ("text", pa.string()), ("error", pa.string())])


@dataclass(frozen=True)
class Queue:
    #: documents leased at once, each batch being two commits; how long a lease lasts, which must be longer than fetching a batch takes
    batch: int = 10_000
    lease_seconds: float = 3600.0
    #: tasks that fetch at once, and the least time between two requests of all of them together
    lanes: int = 1
    gap: float = 1.5
    tries: int = 5
    backoff: float = 1.0
    max_backoff: float = 60.0
    token: str | None = None
    #: tries of a commit that meets others
    commits: int = 5

    def reader(self) -> Callable[[str], str | None]:
        """What fetches one text: the field `text` of a JSON object."""
        options = {"url": "", "gap": self.gap * self.lanes, "tries": self.tries, "backoff": self.backoff, "max_backoff": self.max_backoff} | ({"token": self.token} if self.token else {})
        rest = RestReader(options)
        return lambda url: rest.fetch(url).get("text")


def _fetched(batches: Iterator[pa.RecordBatch], reader: Callable[[], Callable[[str], object]]) -> Iterator[pa.RecordBatch]:
    fetch = reader()
    for batch in batches:
        for k, url in zip(batch.column("id").to_pylist(), batch.column("text_url").to_pylist()):
            text, error = None, None
            try:
                text = fetch(url)
            except Exception as e:  # one document's failure is its own
                error = f"{type(e).__name__}: {e}"[:500]
            text = text if text is None or isinstance(text, str) else json.dumps(text)
            yield pa.RecordBatch.from_pydict({"id": [k], "text": [text if text and text.strip() else NO_TEXT], "error": [error]}, schema=_SCHEMA)


def fetched(rows: DataFrame, reader: Callable[[], Callable[[str], object]], lanes: int = 1) -> DataFrame:
    """id, text and error of rows (id, text_url), in order of ids within each lane. A text that is missing, blank or failed is the mark."""
    dealt = rows.select("id", "text_url").repartition(lanes, "id").sortWithinPartitions("id")
    return dealt.mapInArrow(lambda it: _fetched(it, reader), "id string, text string, error string")


def written_back(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Documents with the texts that came for them; a text that is there stays."""
    new = texts.groupBy("id").agg(F.min("text").alias("__t"))
    out = documents.join(new, "id", "left")
    changed = F.col("text").isNull() & F.col("__t").isNotNull()
    return out.withColumn("updated_at", F.when(changed, F.current_timestamp()).otherwise(F.col("updated_at"))).withColumn("text", F.coalesce("text", "__t")).drop("__t")


def _without(old: DataFrame, gone: DataFrame) -> DataFrame:
    return old.join(gone.select("id"), "id", "left_anti")


def _committed(wh: Warehouse, work: Callable[[warehouse.Commit], None], tries: int) -> None:
    for k in range(tries):
        try:
            with wh.commit() as c:
                work(c)
            return
        except warehouse.ConflictError:
            if k + 1 == tries:
                raise
            time.sleep(0.2 * 2**k)


def lease(wh: Warehouse, q: Queue, worker: str) -> int:
    """Lease the next batch; how many documents it has."""
    n = 0

    def work(c: warehouse.Commit) -> None:
        nonlocal n
        held = c.read("leases").where(F.col("expires") > F.current_timestamp())
        due = to_hydrate(c.read("documents")).select("id", "text_url").join(held.select("id"), "id", "left_anti").orderBy("id").limit(q.batch)
        until = F.timestamp_seconds(F.lit(time.time() + q.lease_seconds))
        staged = c.stage("leases", due.select("id", "text_url", F.lit(worker).alias("worker"), until.alias("expires")))
        n = c.written["leases"]
        c.upsert("leases", staged, lambda old, new: _without(old, new).unionByName(new))

    _committed(wh, work, q.commits)
    return n


def write_back(wh: Warehouse, folder: str, q: Queue) -> dict[str, int]:
    """Texts of a folder of fetched ones into the documents, their leases ended, their errors told; the folder goes."""
    texts = wh.spark.read.schema("id string, text string, error string").parquet(f"{wh.path}/{folder}")
    told = texts.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("text") != NO_TEXT).alias("stored"), F.count("error").alias("failed")).first().asDict()

    def work(c: warehouse.Commit) -> None:
        c.upsert("documents", texts, written_back)
        c.upsert("leases", texts.select("id"), _without)
        if told["failed"]:
            c.append("rejects", texts.where("error is not null").select("id", "error", F.lit(None).cast("string").alias("ingestion_run_id"), F.lit("texts").alias("source"), F.current_timestamp().alias("created_at")))

    _committed(wh, work, q.commits)
    wh.delete(folder)
    return told


def drain(wh: Warehouse, q: Queue = Queue(), *, reader: Callable[[], Callable[[str], object]] | None = None, limit: int | None = None, progress: Callable[[dict], None] | None = None) -> dict[str, int]:
    """Fetch the texts of pending documents, batch after batch, until none is pending that is not leased to others (or `limit` are
    done). reader() gives, in a task, what fetches one text by its address. Gives how many were processed, stored and failed."""
    total, worker = {"processed": 0, "stored": 0, "failed": 0}, uuid.uuid4().hex

    def add(told: dict[str, int]) -> None:
        for k, v in told.items():
            total[k] += v
        if progress:
            progress(dict(total))

    for name in wh.names("_fetched"):
        # written by a run that ended before it could put them in
        if int(name.split("-")[0]) < time.time() and "_SUCCESS" in wh.names(f"_fetched/{name}"):
            add(write_back(wh, f"_fetched/{name}", q))
    while limit is None or total["processed"] < limit:
        expires = int(time.time() + q.lease_seconds)
        if not lease(wh, q, worker):
            break
        folder = f"_fetched/{expires}-{uuid.uuid4().hex}"
        mine = wh.read("leases").where(F.col("worker") == worker)
        fetched(mine, reader or q.reader, q.lanes).write.parquet(f"{wh.path}/{folder}")
        add(write_back(wh, folder, q))
    return total
