"""Commits over several tables, bucketed upserts, counters from the writes, streams that go on."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import ingest, warehouse
from millrace.streaming.ingest import ingest_new_files

TABLES = {"a": "id string, x bigint", "b": "id string, x bigint"}


def rows(spark, lo, hi, x):
    return spark.range(lo, hi).select(F.col("id").cast("string").alias("id"), F.lit(x).cast("bigint").alias("x"))


def merge(old, new):
    return old.join(new.select("id"), "id", "left_anti").unionByName(new)


def held(wh, name):
    return {r["id"]: r["x"] for r in wh.read(name).collect()}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    wh = warehouse.Warehouse(spark, str(tmp_path), TABLES, buckets=16)
    with wh.commit() as c:
        c.upsert("a", rows(spark, 0, 200, 1), merge)
        assert c.written == {"a": 200}
    before = wh.manifest()["tables"]["a"]
    with wh.commit() as c:
        touched = c.upsert("a", rows(spark, 5, 7, 2), merge)
    after = wh.manifest()["tables"]["a"]
    assert 1 <= len(touched) <= 2 and {b for b in before if before[b] != after[b]} == touched
    assert held(wh, "a") == {str(i): 2 if i in (5, 6) else 1 for i in range(200)}


def test_a_failing_write_leaves_the_old_state(spark, tmp_path):
    wh = warehouse.Warehouse(spark, str(tmp_path), TABLES, buckets=4)
    with wh.commit() as c:
        c.upsert("a", rows(spark, 0, 5, 1), merge)
        c.append("b", rows(spark, 0, 5, 1))
    with pytest.raises(Exception, match="(?i)zero"):
        with wh.commit() as c:
            c.upsert("a", rows(spark, 0, 9, 2), merge)
            c.append("b", rows(spark, 5, 9, 2))
            c.upsert("a", rows(spark, 0, 9, 3).withColumn("x", F.raise_error(F.lit("zero")).cast("bigint")), merge)
    assert wh.manifest()["n"] == 1 and held(wh, "a") == held(wh, "b") == {str(i): 1 for i in range(5)}
    assert {p.name for p in (tmp_path / "a").iterdir()} == {p.split("/")[1] for ps in wh.manifest()["tables"]["a"].values() for p in ps}
    assert not [*(tmp_path / "_staged").iterdir()]


def test_of_two_writers_the_second_fails(spark, tmp_path):
    wh = warehouse.Warehouse(spark, str(tmp_path), TABLES, buckets=2)
    with pytest.raises(warehouse.ConflictError):
        with wh.commit() as c:
            c.append("a", rows(spark, 0, 2, 1))
            wh.replace("b", rows(spark, 0, 1, 5))
    assert held(wh, "a") == {} and held(wh, "b") == {"0": 5}


def test_appends_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warehouse, "MANY", 3)
    wh = warehouse.Warehouse(spark, str(tmp_path), TABLES, buckets=1)
    for i in range(5):
        with wh.commit() as c:
            c.append("a", rows(spark, i, i + 2, i), new=lambda old, new: new.join(old, "id", "left_anti"))
    assert held(wh, "a") == {"0": 0, "1": 0, "2": 1, "3": 2, "4": 3, "5": 4}
    assert all(len(ps) < 3 for ps in wh.manifest()["tables"]["a"].values())
    named = {p.split("/")[1] for m in wh.names("_manifests") for ps in wh._load(m)["tables"]["a"].values() for p in ps}
    assert {p.name for p in (tmp_path / "a").iterdir()} == named


def test_a_reader_keeps_its_manifest(spark, tmp_path):
    wh = warehouse.Warehouse(spark, str(tmp_path), TABLES, buckets=2)
    wh.replace("a", rows(spark, 0, 3, 1))
    old, manifest = wh.read("a"), wh.manifest()
    with wh.commit() as c:
        c.upsert("a", rows(spark, 0, 3, 2), merge)
    assert {r["x"] for r in old.collect()} == {1} == {r["x"] for r in wh.read("a", manifest).collect()} and {r["x"] for r in wh.read("a").collect()} == {2}


def case(i, **more):
    return {"id": f"c{i}", "name": "n", "dockets": [{"id": f"d{i}", "documents": [{"id": f"x{i}", "title": "t"}]}]} | more


def test_counts_come_from_the_writes(spark, tmp_path):
    passes = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            passes.add(b.num_rows)
            yield b

    raw = spark.createDataFrame([(json.dumps(case(i)),) for i in range(7)], "j string").repartition(2).mapInArrow(counted, "j string").select(F.parse_json("j").alias("raw"))
    told = []
    wh = ingest.Warehouse(spark, str(tmp_path), buckets=2)
    record = ingest.run(wh, *(x if i else x for i, x in enumerate(ingest.flatten(raw))), source="t", progress=lambda t, n: told.append((t, n)))
    assert told == [("cases", 7), ("dockets", 7), ("documents", 7)] and record["documents_ingested"] == 7
    assert passes.value == 21  # each table's rows are made once


def test_a_bad_file_does_not_stop_the_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write = lambda name, *cases: (folder / name).write_text(json.dumps({"cases": cases}))
    args = (spark, str(folder), str(tmp_path / "wh"), str(tmp_path / "ck"))
    write("a.json", case(1), case(2, updated_at="never"))
    (folder / "b.json").write_text('{"cases": [' + json.dumps(case(3)) + ', {"id": "c4", "na')
    (folder / "c.json").write_text('{"cases": [{"id": c5}]}')
    ingest_new_files(*args)
    wh = ingest.Warehouse(spark, str(tmp_path / "wh"))
    ids = lambda t: sorted(r["id"] for r in wh.read(t).collect())
    assert ids("cases") == ["c1", "c3"]
    assert sorted((r["id"], r["error"]) for r in wh.read("rejects").collect()) == [("b.json", "ends within an element"), ("c.json:0:0", "no JSON"), ("c2", "updated_at is no time: never")]
    run = wh.read("ingestion_runs").first()
    assert (run["status"], run["errors"], run["cases_ingested"]) == ("partial", 3, 2)
    write("d.json", case(6))
    ingest_new_files(*args)
    assert ids("cases") == ["c1", "c3", "c6"] and wh.read("rejects").count() == 3


def test_a_repeated_batch_is_left_out(spark, tmp_path):
    wh = ingest.Warehouse(spark, str(tmp_path), buckets=2)
    raw = lambda i: ingest.flatten(spark.createDataFrame([(json.dumps(case(i)),)], "j string").select(F.parse_json("j").alias("raw")))
    assert ingest.run(wh, *raw(1), source="t", batch=("s", 0))["status"] == "success"
    assert ingest.run(wh, *raw(2), source="t", batch=("s", 0))["status"] == "repeated"
    assert wh.read("cases").count() == 1 == wh.read("ingestion_runs").count()
    assert ingest.run(wh, *raw(2), source="t", batch=("s", 1))["status"] == "success" and wh.read("cases").count() == 2
