"""Ingestion of nested cases: flattening, upsert, payload archive, checkpoint and run log, as set operations on tables.

A run is one commit of the warehouse: its cases, dockets, documents, payloads, rejects, checkpoint and record appear together.
"""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import canonical_json, timestamp_or_null, timestamp_strict
from ..functions.text import or_else
from ..sources import elements
from . import warehouse
from .parse import heuristic_summary

CASES = "id string, name string, court string, state string, jurisdiction string, status string, updated_at_remote timestamp, documents_url string, dockets_url string, metadata_json string"
DOCKETS = "id string, case_id string, docket_number string, court string, state string, is_main boolean, updated_at_remote timestamp, metadata_json string"
DOCUMENTS = (
    "id string, docket_id string, case_id string, title string, document_type string, filed_date timestamp, court string, external_url string, text_url string, has_text boolean, text string, "
    "summary string, metadata_json string"
)
STAMPS = "created_at timestamp, updated_at timestamp"
PAYLOADS = "ingestion_run_id string, source string, resource_type string, resource_id string, case_id string, docket_id string, payload_sha256 string, payload_json string"
CHECKPOINTS = "key string, source string, last_case_id string, last_case_last_checked timestamp, last_run_id string"
RUNS = (
    "id string, source string, status string, started_at timestamp, finished_at timestamp, requested_since timestamp, effective_since timestamp, case_limit int, checkpoint_key string, "
    "resumed_from_checkpoint boolean, cases_ingested bigint, dockets_ingested bigint, documents_ingested bigint, errors bigint, error_message string"
)
REJECTS = "id string, error string, ingestion_run_id string, source string, created_at timestamp"
LEASES = "id string, text_url string, worker string, expires timestamp"
TABLES = {
    "cases": f"{CASES}, {STAMPS}", "dockets": f"{DOCKETS}, {STAMPS}", "documents": f"{DOCUMENTS}, {STAMPS}", "raw_api_payloads": f"{PAYLOADS}, {STAMPS}",
    "ingestion_checkpoints": f"{CHECKPOINTS}, {STAMPS}", "ingestion_runs": RUNS, "rejects": REJECTS, "leases": LEASES,
}
#: the column whose hash deals rows to buckets, where it is not the id
KEYS = {"raw_api_payloads": "resource_id", "ingestion_checkpoints": "key"}
NO_TEXT = "[[NO_TEXT_RETURNED]]"


class Warehouse(warehouse.Warehouse):
    """The tables of cases. buckets: as many as keep one within a task's memory; they stay as the first commit has them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = warehouse.BUCKETS):
        super().__init__(spark, path, TABLES, KEYS, buckets)


# Scans


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One row a case of JSON documents {"cases": [...]} of any size (`elements`): the case, and at, its place. Nested metadata stays as
    it is, in the case's own JSON. A case that is no JSON is an error when it is read; `parsed` tells such cases apart."""
    return elements.read(spark, path, "cases").select(F.parse_json("element").alias("raw"), "at")


def parsed(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw cases of elements, and (id, error) of those that are no JSON, named by their file and place."""
    rows = found.select(F.try_parse_json("element").alias("raw"), "at")
    where = F.concat_ws(":", F.regexp_extract("at.file", "[^/]*$", 0), F.col("at.block").cast("string"), F.col("at.number").cast("string"))
    return rows.where("raw is not null"), rows.where("raw is null").select(where.alias("id"), F.lit("no JSON").alias("error"))


def _get(raw: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(raw) if isinstance(raw, str) else raw, f"$.{path}", kind)


def _meta(raw: str) -> Column:
    return F.coalesce(F.to_json(F.try_variant_get(F.col(raw), "$.metadata", "variant")), F.lit("{}"))


def flatten(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cases, dockets and documents of raw cases. Children get the ids of those above; a docket without a state, or a document
    without a court key, has its parent's. A case without a state has its jurisdiction there, and as jurisdiction what its
    metadata say. A case's time that is no time is an error. Where raw cases have a place (at), all rows have theirs (__at), by which
    the last of several rows of one id is known."""
    placed = "at" in raw.columns
    at = lambda *parts: [F.struct(*parts).alias("__at")] if placed else []
    url = lambda kind: or_else(_get("raw", f"{kind}_url"), F.concat(F.lit("mock://cases/"), _get("raw", "id"), F.lit(f"/{kind}")))
    cases = raw.select(
        _get("raw", "id").alias("id"), _get("raw", "name").alias("name"), _get("raw", "court").alias("court"), or_else(_get("raw", "state"), _get("raw", "jurisdiction")).alias("state"),
        _get("raw", "metadata.jurisdiction").alias("jurisdiction"), _get("raw", "status").alias("status"), timestamp_strict(_get("raw", "updated_at")).alias("updated_at_remote"),
        url("documents").alias("documents_url"), url("dockets").alias("dockets_url"), _meta("raw").alias("metadata_json"), "raw", *at("at"),
    )
    d = cases.select(F.col("id").alias("case_id"), F.col("court").alias("c_court"), F.col("state").alias("c_state"), *(["__at"] * placed), F.posexplode(_get("raw", "dockets", "array<variant>")).alias("i", "raw"))
    dockets = d.select(
        _get("raw", "id").alias("id"), "case_id", _get("raw", "number").alias("docket_number"), _inherited("court", "c_court").alias("court"), or_else(_get("raw", "state"), F.col("c_state")).alias("state"),
        F.coalesce(_get("raw", "is_main", "boolean"), F.lit(True)).alias("is_main"), F.lit(None).cast("timestamp").alias("updated_at_remote"), _meta("raw").alias("metadata_json"), "raw", *at("__at", "i"),
    )
    e = dockets.select("case_id", F.col("id").alias("docket_id"), F.col("court").alias("d_court"), *(["__at"] * placed), F.posexplode(_get("raw", "documents", "array<variant>")).alias("j", "raw"))
    text = _get("raw", "text")
    documents = e.select(
        _get("raw", "id").alias("id"), "docket_id", "case_id", _get("raw", "title").alias("title"), _get("raw", "document_type").alias("document_type"),
        timestamp_strict(_get("raw", "filed_date")).alias("filed_date"), _inherited("court", "d_court").alias("court"), _get("raw", "source_url").alias("external_url"),
        _get("raw", "text_url").alias("text_url"), (F.coalesce(text, F.lit("")) != "").alias("has_text"), text.alias("text"), _meta("raw").alias("metadata_json"), *at("__at", "j"),
    )
    return cases.drop("raw"), dockets.drop("raw"), documents


def checked(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw cases that can be flattened, and (id, error) of those that cannot: a case, docket or document without an id, dockets or
    documents that are no list, a time that is none. One bad case does not fail the others."""
    bad = lambda v, path: (_get(v, path) != "") & timestamp_or_null(_get(v, path)).isNull()
    empty = F.array().cast("array<variant>")
    docs = F.flatten(F.transform(F.coalesce(_get("raw", "dockets", "array<variant>"), empty), lambda d: F.coalesce(F.try_variant_get(d, "$.documents", "array<variant>"), empty)))
    wrong = F.filter(docs, lambda x: F.coalesce(bad(x, "filed_date"), F.lit(False)))
    case_error = F.when(bad("raw", "updated_at"), F.concat(F.lit("updated_at is no time: "), _get("raw", "updated_at")))
    dockets = F.coalesce(_get("raw", "dockets", "array<variant>"), empty)
    no_list = lambda v, path: F.try_variant_get(v, f"$.{path}", "variant").isNotNull() & F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")) != "VOID", F.lit(True)) & _get(v, path, "array<variant>").isNull()
    nameless = lambda vs: F.exists(vs, lambda x: _get(x, "id").isNull())
    shape = (
        F.when(_get("raw", "id").isNull(), "case without an id").when(no_list(F.col("raw"), "dockets"), "dockets are no list").when(nameless(dockets), "docket without an id")
        .when(F.exists(dockets, lambda d: no_list(d, "documents")), "documents are no list").when(nameless(docs), "document without an id")
    )
    error = F.coalesce(shape, case_error, F.when(F.size(wrong) > 0, F.concat(F.lit("filed_date is no time: "), _get(F.get(wrong, F.lit(0)), "filed_date"))))
    rows = raw.withColumn("__error", error)
    return rows.where("__error is null").drop("__error"), rows.where("__error is not null").select(_get("raw", "id").alias("id"), F.col("__error").alias("error"))


def _inherited(name: str, parent: str) -> Column:
    """A key's own value, null included; the parent's only where the key is absent."""
    own = F.try_variant_get(F.col("raw"), f"$.{name}", "variant")
    return F.when(own.isNull(), F.col(parent)).otherwise(_get("raw", name))


def from_api(raw: DataFrame, kind: str) -> DataFrame:
    """Rows of a REST API (raw JSON text, and case_id for children) under our names. A missing id reads 'None', a missing title
    'Untitled'; text is fetched later."""
    v = raw.withColumn("raw", F.parse_json("raw")) if dict(raw.dtypes)["raw"] == "string" else raw
    ident, meta = F.coalesce(_get("raw", "id"), F.lit("None")).alias("id"), F.to_json("raw").alias("metadata_json")
    if kind == "case":
        return v.select(
            ident, F.coalesce(_get("raw", "name"), F.lit("")).alias("name"), _get("raw", "court").alias("court"), _get("raw", "state").alias("state"), _get("raw", "jurisdiction").alias("jurisdiction"),
            _get("raw", "case_status").alias("status"), timestamp_or_null(_get("raw", "last_checked_date")).alias("updated_at_remote"), _get("raw", "case_documents_url").alias("documents_url"),
            _get("raw", "case_dockets_url").alias("dockets_url"), meta,
        )
    if kind == "docket":
        return v.select(
            ident, F.col("case_id").cast("string").alias("case_id"), _get("raw", "docket_number_manual").alias("docket_number"), _get("raw", "court").alias("court"), _get("raw", "state").alias("state"),
            _get("raw", "is_main_docket", "boolean").alias("is_main"), F.lit(None).cast("timestamp").alias("updated_at_remote"), meta,
        )
    return v.select(
        ident, F.when(~_get("raw", "docket_id").isin("", "0"), _get("raw", "docket_id")).alias("docket_id"), F.col("case_id").cast("string").alias("case_id"),
        F.coalesce(_get("raw", "title"), F.lit("Untitled")).alias("title"), _get("raw", "document_type").alias("document_type"), timestamp_or_null(_get("raw", "date")).alias("filed_date"),
        _get("raw", "court").alias("court"), or_else(_get("raw", "external_url"), _get("raw", "clearinghouse_link")).alias("external_url"), _get("raw", "text_url").alias("text_url"),
        F.coalesce(~F.coalesce(_get("raw", "has_text"), F.lit("")).isin("", "false", "0"), F.lit(False)).alias("has_text"), F.lit(None).cast("string").alias("text"), meta,
    )


def updated_after(cases: DataFrame, since: Column | datetime.datetime | None, inclusive: bool = False) -> DataFrame:
    """Cases checked after a time, or without a time; inclusive as the REST filter has it."""
    if since is None:
        return cases
    t, s = F.col("updated_at_remote"), since if isinstance(since, Column) else F.lit(since)
    return cases.where(t.isNull() | ((t >= s) if inclusive else (t > s)))


def oldest(cases: DataFrame, limit: int) -> DataFrame:
    """The first cases of a run with a limit: those without a time, then those not checked for longest."""
    return cases.orderBy(F.asc_nulls_first("updated_at_remote"), "id").limit(limit)


def document_json(documents: DataFrame, case_id: str, document_id: str) -> DataFrame:
    """The one document of a case with an id, as JSON of all its columns, nulls included; no row if there is none."""
    return get_document(documents, case_id, document_id).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


# State


def upserted(target: DataFrame, source: DataFrame, key: str = "id", now: Column | None = None, keep_text: bool = False) -> DataFrame:
    """Target with the source's rows put in: the source wins on all its columns, created_at stays; of several rows of one key the
    last by its place (__at) does, or, without places, the greatest. keep_text: a text that was fetched is not lost to a source
    without."""
    now = F.current_timestamp() if now is None else now
    old = target.select(F.col(key).alias("__k"), F.col("created_at").alias("__c"), *([F.col("text").alias("__t")] if keep_text else []))
    source = warehouse.last_of(source, key, F.col("__at") if "__at" in source.columns else None)
    new = source.join(old, F.col(key) == F.col("__k"), "left")
    new = new.withColumn("created_at", F.coalesce("__c", now)).withColumn("updated_at", now)
    if keep_text:
        new = new.withColumn("text", F.coalesce("text", "__t"))
    return target.join(source.select(key), key, "left_anti").unionByName(new.select(*target.columns))


def archived(archive: DataFrame, payloads: DataFrame, run_id: str, source: str) -> DataFrame:
    """Payload versions (resource_type, resource_id, case_id, docket_id, metadata_json) that the archive lacks."""
    key = ["resource_type", "resource_id", "payload_sha256"]
    rows = payloads.withColumn("payload_json", canonical_json("metadata_json")).withColumn("payload_sha256", F.sha2(F.col("payload_json").cast("binary"), 256))
    return rows.dropDuplicates(key).join(archive.select(*key), key, "left_anti").select(F.lit(run_id).alias("ingestion_run_id"), F.lit(source).alias("source"), *key[:2], "case_id", "docket_id", key[2], "payload_json")


def advanced(checkpoints: DataFrame, cases: DataFrame, key: str, source: str, run_id: str) -> DataFrame:
    """Checkpoints after cases: the latest time, never an earlier one than before, with the id of its (last) case; while no case
    has had a time, the last case's id."""
    seen = cases.agg(F.max("updated_at_remote").alias("t"), F.max_by("id", F.struct("updated_at_remote", "id")).alias("i"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    old = checkpoints.where(F.col("key") == key).agg(F.max("last_case_last_checked").alias("t0"), F.max("last_case_id").alias("i0"), F.max("created_at").alias("c0"))
    both = seen.crossJoin(old)  # one row each
    later = F.col("t").isNotNull() & (F.col("t0").isNull() | (F.col("t") >= F.col("t0")))
    row = both.select(
        F.lit(key).alias("key"), F.lit(source).alias("source"), F.when(later, F.col("i")).when(F.col("t0").isNull() & (F.col("n") > 0), F.col("last")).otherwise(F.col("i0")).alias("last_case_id"),
        F.when(later, F.col("t")).otherwise(F.col("t0")).alias("last_case_last_checked"), F.lit(run_id).alias("last_run_id"), F.coalesce("c0", F.current_timestamp()).alias("created_at"),
        F.current_timestamp().alias("updated_at"),
    )
    return checkpoints.where(F.col("key") != key).unionByName(row)


def run(
    wh: Warehouse, cases: DataFrame, dockets: DataFrame, documents: DataFrame, *, source: str, since: datetime.datetime | None = None, case_limit: int | None = None, checkpoint_key: str | None = None,
    resume: bool = False, inclusive: bool = False, archive: bool = True, summarise: Callable[[DataFrame], DataFrame] | None = None, failed: DataFrame | None = None, continue_on_error: bool = True, batch: tuple[str, int] | None = None,
    progress: Callable[[str, int], None] | None = None,
) -> dict:
    """One run: the cases since a time or the checkpoint, oldest first and up to a limit, with their dockets and documents, go
    into the warehouse, with the checkpoint and the run's record in one commit. `failed` (id, error) are cases that could not be read
    (`checked`): they go into rejects, count as errors and make the run partial, or, without continue_on_error, fail it before anything is
    written. batch: a stream and the number of its batch, which is taken up once. progress(table, rows) is told of each table
    when it is staged. Counts come from the writes themselves. Gives the run's record."""
    spark, run_id, began = wh.spark, str(uuid.uuid4()), datetime.datetime.now(datetime.timezone.utc)
    effective, resumed = since, False
    if resume and checkpoint_key:
        at = wh.read("ingestion_checkpoints").where(F.col("key") == checkpoint_key).select("last_case_last_checked").first()
        if at and at[0] and (effective is None or at[0] > effective.replace(tzinfo=None)):
            effective, resumed = at[0], True
    counts, status, error, errors = {"cases": 0, "dockets": 0, "documents": 0}, "success", None, 0

    def record() -> dict:
        return {
            "id": run_id, "source": source, "status": status, "started_at": began, "finished_at": datetime.datetime.now(datetime.timezone.utc), "requested_since": since, "effective_since": effective,
            "case_limit": case_limit, "checkpoint_key": checkpoint_key, "resumed_from_checkpoint": resumed, "cases_ingested": counts["cases"], "dockets_ingested": counts["dockets"],
            "documents_ingested": counts["documents"], "errors": errors + int(status == "failed" and not errors), "error_message": error,
        }

    def logged() -> DataFrame:
        schema, row = wh.schema("ingestion_runs"), record()
        return spark.createDataFrame([tuple(row[f.name] for f in schema)], schema)

    now = F.current_timestamp()
    try:
        with wh.commit() as c:
            if batch and not c.batch(*batch):
                status = "repeated"
                return record()
            if failed is not None:
                bad = c.stage("rejects", failed.select("id", "error", F.lit(run_id).alias("ingestion_run_id"), F.lit(source).alias("source"), now.alias("created_at")).withColumn("id", F.coalesce("id", F.lit("None"))))
                errors = c.written["rejects"]
                error = bad.rows.agg(F.max_by("error", "id")).first()[0]
                if errors and not continue_on_error:
                    raise ValueError(error)
                status = "partial" if errors else status
                c.append("rejects", bad.rows)
            some = updated_after(cases, effective, inclusive)
            if case_limit is not None:
                some = oldest(some, case_limit)
            staged, ids = {}, None
            subject = F.get_json_object("metadata_json", "$.subject")
            plain = lambda d: d.withColumn("summary", heuristic_summary("title", "text", "document_type", "court", subject))
            for name, df in (("cases", some), ("dockets", dockets), ("documents", documents)):
                if ids is not None:
                    df = df.join(ids, "case_id", "left_semi")
                if name == "documents":
                    df = (summarise or plain)(df)
                staged[name] = c.stage(name, df)
                if ids is None:
                    ids = staged[name].rows.select(F.col("id").alias("case_id"))
                counts[name] = c.written[name]
                if progress:
                    progress(name, counts[name])
                c.upsert(name, staged[name], upserted)
            if archive:
                kinds = ("case", "id", F.lit(None).cast("string")), ("docket", "case_id", F.col("id")), ("document", "case_id", F.col("docket_id"))
                payloads = None
                for (kind, case, docket), part in zip(kinds, staged.values(), strict=True):
                    rows = part.rows.select(F.lit(kind).alias("resource_type"), F.col("id").alias("resource_id"), F.col(case).alias("case_id"), docket.alias("docket_id"), "metadata_json")
                    payloads = rows if payloads is None else payloads.unionByName(rows)
                # a payload lies in the bucket of its resource's id, so only the staged rows' buckets can hold it
                old = c.read("raw_api_payloads", set().union(*(p.buckets for p in staged.values())))
                c.append("raw_api_payloads", archived(old, payloads, run_id, source).withColumns({"created_at": now, "updated_at": now}))
            if checkpoint_key:
                c.replace("ingestion_checkpoints", advanced(c.read("ingestion_checkpoints"), staged["cases"].rows, checkpoint_key, source, run_id))
            c.append("ingestion_runs", logged())
    except Exception as e:
        counts, status, error = dict.fromkeys(counts, 0), "failed", str(e)
        with wh.commit() as c:
            c.append("ingestion_runs", logged())
        raise
    return record()


def to_hydrate(documents: DataFrame) -> DataFrame:
    """Documents that have a text somewhere which was not fetched yet."""
    return documents.where(F.col("has_text") & F.col("text_url").isNotNull() & F.col("text").isNull())


def hydrated(documents: DataFrame, fetch: Callable[[Column], Column]) -> DataFrame:
    """With the texts of pending documents; blank and failed ones get a mark, so that they are not asked for again."""
    due = F.col("has_text") & F.col("text_url").isNotNull() & F.col("text").isNull()
    got = fetch(F.col("text_url"))
    return documents.withColumn("text", F.when(due, F.when(F.trim(F.coalesce(got, F.lit(""))) == "", NO_TEXT).otherwise(got)).otherwise(F.col("text")))


def table_counts(wh: Warehouse) -> dict[str, int]:
    return {name: wh.read(name).count() for name in TABLES}


def get_document(documents: DataFrame, case_id: str, document_id: str) -> DataFrame:
    """The one document of a case with an id, or no row."""
    return documents.where((F.col("case_id") == case_id) & (F.col("id") == document_id)).limit(1)
