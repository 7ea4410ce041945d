import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest
from millrace.operators.models import generate, without_errors
from millrace.sources import files
from millrace.streaming.ingest import ingest_new_files


def fixture(tmp_path, name="cases.json", shift=0):
    cases = [
        {"id": f"case-{i}", "name": f"N{i}", "court": "C", "jurisdiction": "Federal", "updated_at": f"2024-0{i + shift}-01T00:00:00Z", "metadata": {"topics": ["b", "a"]},
         "dockets": [{"id": f"docket-{i}", "number": "1", "metadata": {}, "documents": [
             {"id": f"doc-{i}-{j}", "title": f"T{j}", "document_type": "Order", "filed_date": "2024-01-01T00:00:00Z", "text": "One. Two. Three." if j else "", "metadata": {"subject": "S"}} for j in (0, 1)]}]}
        for i in (1, 2)
    ] + [{"id": "case-3", "name": "empty", "dockets": []}] * (shift == 0)
    path = tmp_path / name
    path.write_text(json.dumps({"cases": cases}))
    return str(path)


def parts(spark, path):
    return ingest.flatten(ingest.read_cases(spark, path))


def test_flatten(spark, tmp_path):
    cases, dockets, documents = parts(spark, fixture(tmp_path))
    assert (cases.count(), dockets.count(), documents.count()) == (3, 2, 4)
    c = cases.where("id = 'case-1'").first()
    assert c["state"] == "Federal" and c["jurisdiction"] is None and c["documents_url"] == "mock://cases/case-1/documents"
    d = documents.where("id = 'doc-1-0'").first()
    assert d["court"] == "C" and d["has_text"] is False and d["docket_id"] == "docket-1" and dockets.first()["is_main"] is True


def test_runs_resume_and_are_idempotent(spark, tmp_path):
    wh = ingest.Warehouse(spark, str(tmp_path / "wh"))
    three = [x.where("id like '%-1%' or id like '%-2%'") if i == 0 else x for i, x in enumerate(parts(spark, fixture(tmp_path)))]
    first = ingest.run(wh, *three, source="t", checkpoint_key="k", case_limit=1)
    assert (first["cases_ingested"], first["dockets_ingested"], first["documents_ingested"]) == (1, 1, 2)
    assert wh.read("ingestion_checkpoints").first()["last_case_id"] == "case-1"
    again = ingest.run(wh, *three, source="t", checkpoint_key="k", resume=True)
    assert again["resumed_from_checkpoint"] and (again["cases_ingested"], again["documents_ingested"]) == (1, 2)
    before = wh.read("documents").where("id = 'doc-1-0'").first()["created_at"]
    ingest.run(wh, *three, source="t")
    n = ingest.table_counts(wh)
    assert (n["cases"], n["dockets"], n["documents"], n["raw_api_payloads"], n["ingestion_runs"]) == (2, 2, 4, 8, 3)
    d = wh.read("documents").where("id = 'doc-1-1'").first()
    assert d["summary"] == "Summary for T1 (Order, C, S)\n- One.\n- Two.\n- Three." and wh.read("documents").where("id = 'doc-1-0'").first()["created_at"] == before


def test_failure_is_recorded(spark, tmp_path):
    wh = ingest.Warehouse(spark, str(tmp_path / "wh"))
    with pytest.raises(ZeroDivisionError):
        ingest.run(wh, *parts(spark, fixture(tmp_path)), source="t", summarise=lambda d: 1 / 0)
    assert wh.read("ingestion_runs").first()["status"] == "failed" and wh.read("cases").count() == 0


def test_upsert_keeps_fetched_text(spark):
    t = spark.createDataFrame([("a", "old"), ("b", "kept")], "id string, text string").withColumns({"created_at": F.lit(1), "updated_at": F.lit(1)})
    s = spark.createDataFrame([("a", None), ("c", "new")], "id string, text string")
    got = {r["id"]: (r["text"], r["created_at"]) for r in ingest.upserted(t, s, now=F.lit(2), keep_text=True).collect()}
    assert got == {"a": ("old", 1), "b": ("kept", 1), "c": ("new", 2)}
    assert {r["text"] for r in ingest.upserted(t, s, now=F.lit(2)).collect()} == {None, "kept", "new"}


def test_api_rows_and_hydration(spark):
    raw = spark.createDataFrame([("7", '{"id": 5, "has_text": true, "text_url": "u", "clearinghouse_link": "l", "date": "2024-02-03"}'), ("7", "{}")], "case_id string, raw string")
    d = {r["id"]: r for r in ingest.from_api(raw, "document").collect()}
    assert d["5"]["title"] == "Untitled" and d["5"]["has_text"] and d["5"]["external_url"] == "l" and d["5"]["filed_date"].day == 3 and not d["None"]["has_text"]
    assert ingest.from_api(raw, "case").count() == 2 and ingest.from_api(raw, "docket").count() == 2
    docs = ingest.from_api(raw, "document")
    assert ingest.to_hydrate(docs).count() == 1
    assert {r["text"] for r in ingest.hydrated(docs, lambda u: F.lit(" ")).collect()} == {None, ingest.NO_TEXT}


def test_stream_takes_each_file_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    fixture(folder, "a.json")
    args = (spark, str(folder), str(tmp_path / "wh"), str(tmp_path / "ck"))
    ingest_new_files(*args)
    ingest_new_files(*args)
    wh = ingest.Warehouse(spark, str(tmp_path / "wh"))
    assert wh.read("cases").count() == 3 and wh.read("ingestion_runs").count() == 1
    fixture(folder, "b.json", shift=4)
    ingest_new_files(*args)
    assert wh.read("cases").count() == 3 and wh.read("ingestion_runs").count() == 2


def test_files(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"index": 5, "prediction": "a"}\n\n{"prediction": "b"}\n')
    assert files.read_jsonl(spark, str(p)).count() == 2
    assert sorted(r["index"] for r in files.read_eval(spark, str(p), "index bigint, prediction string").collect()) == [2, 5]
    assert files.read_eval(spark, str(p), "index bigint, prediction string", 2).count() == 1
    (tmp_path / "s.jsonl").write_text(json.dumps({"prompt": "x\nCase: Doe v. Roe\n", "case_id": 9}) + "\n" + json.dumps({"prompt": "y"}))
    assert [(r["case_id"], r["case_name"]) for r in files.read_sources(spark, str(tmp_path / "s.jsonl")).orderBy("line").collect()] == [("9", "Doe v. Roe"), ("1", "Case 1")]
    (tmp_path / "t.txt").write_text("two\nlines")
    assert files.read_text(spark, str(tmp_path / "t.txt")).first().asDict() == {"case_id": "t", "prediction": "two\nlines"}
    (tmp_path / "one.json").write_text('{"a": 1}')
    assert files.read_json(spark, str(tmp_path / "one.json")).count() == 1
    (tmp_path / "x.csv").write_text("a,b\n1,x\n3,y\n")
    assert files.numeric_means(files.read_csv(spark, str(tmp_path / "x.csv"))).first().asDict() == {"a": 2.0}
    df = spark.createDataFrame([("p", "r", None)], "prompt string, response string, n int")
    assert files.with_completion(df).first()["completion"] == "r"
    with pytest.raises(ValueError):
        files.with_completion(df.drop("response"))
    files.write_jsonl(df, str(tmp_path / "out"))
    assert '"n":null' in spark.read.text(str(tmp_path / "out")).first()[0]
    files.write_csv(df, str(tmp_path / "csv"))
    files.write_summary(df, str(tmp_path / "sum"))
    assert df.select(files.embedded(df.withColumn("x", F.lit("</script>")), "prompt")).count() == 1


def test_rest_source(spark):
    import http.server
    import threading

    class Api(http.server.BaseHTTPRequestHandler):
        failed = False

        def do_GET(self):
            if not Api.failed:
                Api.failed = True
                self.send_response(503)
                self.end_headers()
                return
            host = f"http://127.0.0.1:{self.server.server_port}"
            page = {"results": [{"id": 2}], "next": None} if "page=2" in self.path else {"results": [{"id": 1}], "next": f"{host}/?page=2"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(page).encode())

        def log_message(self, *_):
            pass

    from millrace.sources.rest import RestSource

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(RestSource)
    df = spark.read.format("caserest").option("url", f"http://127.0.0.1:{server.server_port}/").option("gap", "0").option("backoff", "0.01").load()
    assert sorted(r["id"] for r in ingest.from_api(df, "case").collect()) == ["1", "2"]
    server.shutdown()


def test_rest_lanes_share_the_gap():
    from millrace.sources.rest import RestReader

    r = RestReader({"url": "u", "cases": "a,b,c,d,e", "gap": "1.5", "lanes": "2"})
    assert [p.cases for p in r.partitions()] == [("a", "c", "e"), ("b", "d")] and r.gap == 3.0
    r = RestReader({"url": "u", "cases": "a,b"})
    assert [p.cases for p in r.partitions()] == [("a", "b")] and r.gap == 1.5
    assert r.wait(0, "2.5") == 2.5 and r.wait(0, "Wed, 21 Oct 2015 07:28:00 GMT") == 0.0 and 0 <= r.wait(0, "soon") <= 2


def test_a_failing_case_leaves_the_others(spark, tmp_path):
    js = [
        '{"id": "a", "updated_at": "2024-01-01T00:00:00", "dockets": [{"id": "d", "documents": [{"id": "x", "filed_date": "2020-01-01"}]}]}',
        '{"id": "b", "updated_at": "never"}', '{"id": "c", "dockets": [{"id": "e", "documents": [{"id": "y", "filed_date": "31/31"}, {"id": "z"}]}]}', '{"id": "d"}',
    ]
    raw = spark.createDataFrame([(j,) for j in js], "j string").select(F.parse_json("j").alias("raw"))
    good, failed = ingest.checked(raw)
    assert {r["id"]: r["error"] for r in failed.collect()} == {"b": "updated_at is no time: never", "c": "filed_date is no time: 31/31"}
    wh = ingest.Warehouse(spark, str(tmp_path / "wh"))
    record = ingest.run(wh, *ingest.flatten(good), source="test", failed=failed)
    assert (record["status"], record["errors"], record["cases_ingested"]) == ("partial", 2, 2) and wh.read("cases").count() == 2
    with pytest.raises(ValueError):
        ingest.run(wh, *ingest.flatten(good), source="test", failed=failed, continue_on_error=False)
    assert sorted(r["status"] for r in wh.read("ingestion_runs").collect()) == ["failed", "partial"]
    assert json.loads(ingest.document_json(wh.read("documents"), "a", "x").first()["json"])["docket_id"] == "d"


def test_readers_keep_the_snapshot_before(spark, tmp_path):
    wh = ingest.Warehouse(spark, str(tmp_path / "wh"))
    row = lambda i: spark.createDataFrame([(str(i), "t", None, None, None, None, None)], "key string, source string, last_case_id string, last_case_last_checked timestamp, last_run_id string, created_at timestamp, updated_at timestamp")
    wh.replace("ingestion_checkpoints", row(1))
    reader = wh.read("ingestion_checkpoints")
    wh.replace("ingestion_checkpoints", row(2))
    assert reader.first()["key"] == "1" and wh.read("ingestion_checkpoints").first()["key"] == "2"
    wh.replace("ingestion_checkpoints", row(3))
    assert len([d for d in (tmp_path / "wh/ingestion_checkpoints").iterdir() if d.name.startswith("v-")]) == 2


def test_judge_replies_are_written_back(spark):
    from millrace.operators.models import judged_by

    df = spark.createDataFrame([(1, '```json\n{"overall": 4, "brief_rationale": "good"}\n```'), (2, "none"), (3, '{"overall": 2}')], "id int, reply string")
    got = {r["id"]: (r["judge_overall"], r["judge_rationale"], r["judge_completeness"]) for r in judged_by(df, "reply").collect()}
    assert got == {1: (4, "good", None), 2: (None, None, None), 3: (2, "", None)}


def test_models(spark):
    df = spark.createDataFrame([("One. Two.",), ("x" * 200_000,)], "prompt string")
    assert [r["generated"] for r in generate(df).collect()] == ["One. Two.", None]
    assert [r["generated"] for r in generate(df, model=lambda ps: [p.upper() for p in ps]).collect()] == ["ONE. TWO.", None]

    def broken(_):
        raise RuntimeError("down")

    assert without_errors(generate(df, model=broken)).count() == 1
