"""The queue of texts: leased batches, failures, and runs that end in the middle."""

import http.server
import json
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import hydrate, ingest, warehouse


class Api(http.server.BaseHTTPRequestHandler):
    hits, served = Counter(), []

    def do_GET(self):
        n = int(self.path.rsplit("/", 1)[1])
        Api.hits[n] += 1
        busy = n % 4 == 1 and Api.hits[n] == 1
        status = 503 if busy else 404 if n % 7 == 3 else 200
        self.send_response(status)
        self.end_headers()
        if status == 200:
            Api.served.append(n)
            self.wfile.write(json.dumps({"text": None if n % 5 == 0 else " \n" if n % 5 == 1 else f"text {n}"}).encode())

    def log_message(self, *_):
        pass


@pytest.fixture
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Api.hits.clear()
    Api.served.clear()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def filled(spark, path, url, n=20):
    wh = ingest.Warehouse(spark, str(path), buckets=3)
    schema = wh.schema("documents")
    rows = spark.range(n).select(F.format_string("d%02d", "id").alias("id"), F.lit(True).alias("has_text"), F.concat(F.lit(url), F.col("id").cast("string")).alias("text_url"))
    more = spark.createDataFrame([("e1", True, None, "own"), ("e2", False, url + "99", None), ("e3", True, url + "98", "there")], "id string, has_text boolean, text_url string, text string")
    rows = rows.unionByName(more, allowMissingColumns=True)
    have = set(rows.columns)
    wh.replace("documents", rows.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]))
    return wh


def wanted(n):
    return ingest.NO_TEXT if n % 7 == 3 or n % 5 < 2 else f"text {n}"


QUICK = hydrate.Queue(batch=8, gap=0.0, backoff=0.001, max_backoff=0.01, lanes=2)


def test_all_texts_are_fetched_once(spark, tmp_path, url):
    wh, told = filled(spark, tmp_path, url), []
    total = hydrate.drain(wh, QUICK, progress=lambda t: told.append((t["processed"], sorted(Api.hits))))
    texts = {r["id"]: r["text"] for r in wh.read("documents").collect()}
    assert texts == {f"d{n:02d}": wanted(n) for n in range(20)} | {"e1": "own", "e2": None, "e3": "there"}
    assert total == {"processed": 20, "stored": sum(wanted(n) != ingest.NO_TEXT for n in range(20)), "failed": 3}
    assert [n for n, _ in told] == [8, 16, 20] and told[0][1] == list(range(8))  # batches by id
    assert len(Api.served) == len(set(Api.served)) == 17
    assert sorted(r["id"] for r in wh.read("rejects").collect()) == ["d03", "d10", "d17"] and wh.read("leases").count() == 0
    assert hydrate.drain(wh, QUICK)["processed"] == 0


def test_a_run_that_ends_before_its_commit_is_taken_up(spark, tmp_path, url, monkeypatch):
    wh = filled(spark, tmp_path, url)
    with monkeypatch.context() as m:
        m.setattr(hydrate, "write_back", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            hydrate.drain(wh, hydrate.Queue(batch=8, gap=0.0, backoff=0.001, lanes=2, lease_seconds=0.0))
    assert wh.read("leases").count() == 8 and wh.read("documents").where("text like 'text%'").count() == 0
    import time

    time.sleep(1.1)
    hydrate.drain(wh, QUICK)
    assert {r["id"]: r["text"] for r in wh.read("documents").where("id like 'd%'").collect()} == {f"d{n:02d}": wanted(n) for n in range(20)}
    assert len(Api.served) == len(set(Api.served)) and not wh.names("_fetched") and wh.read("leases").count() == 0


def test_leased_documents_are_left_to_their_holder(spark, tmp_path, url):
    wh = filled(spark, tmp_path, url)
    assert hydrate.lease(wh, QUICK, "other") == 8
    assert hydrate.drain(wh, QUICK, limit=5)["processed"] == 8 and set(Api.hits) == set(range(8, 16))
    assert hydrate.drain(wh, QUICK)["processed"] == 4 and wh.read("leases").where("worker = 'other'").count() == 8


def test_a_commit_that_meets_another_is_tried_again(spark, tmp_path, url, monkeypatch):
    wh, publish, met = filled(spark, tmp_path, url), warehouse.Warehouse._publish, []

    def meeting(self, manifest):
        if len(met) < 2 and "leases" in manifest["tables"]:
            met.append(1)
            raise warehouse.ConflictError("met")
        publish(self, manifest)

    monkeypatch.setattr(warehouse.Warehouse, "_publish", meeting)
    assert hydrate.drain(wh, QUICK)["processed"] == 20 and len(met) == 2 and len(Api.served) == len(set(Api.served))
