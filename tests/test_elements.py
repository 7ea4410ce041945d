"""Elements of nested JSON, whatever the ranges in which it is read."""

import json
import random

import pytest

from millrace.operators import ingest
from millrace.sources import elements

ODD = ["{", "}", "[", "]", '"', "\\", '\\"', "}{", "a}b", "é", "\n", "cases", '"cases": [', "\U0001f600", "}" * 9, "\\\\"]


def documents(rng, n):
    def value(depth):
        kind = rng.randrange(6 if depth < 3 else 3)
        if kind == 0:
            return rng.randrange(100)
        if kind in (1, 2):
            return "".join(rng.choice(ODD) for _ in range(rng.randrange(6)))
        if kind == 3:
            return [value(depth + 1) for _ in range(rng.randrange(4))]
        return {rng.choice(ODD) + str(i): value(depth + 1) for i in range(rng.randrange(4))}

    cases = [{"id": i, "x": value(0)} for i in range(n)]
    rest = {"a": value(0), "more": [{"id": -1}], "text": "cases", "b}": [{"id": -2}]}
    if rng.random() < 0.5:
        return rest | {"cases": cases}
    return {"cases": cases} | rest


@pytest.mark.parametrize("split", [64, 257, 4096, 1 << 27])
def test_every_split_gives_the_same(spark, tmp_path, split):
    rng, want = random.Random(4), {}
    for k in range(4):
        doc = documents(rng, 60)
        (tmp_path / f"f{k}.json").write_text(json.dumps(doc, ensure_ascii=k % 2 == 0, indent=None if k < 2 else 1) + "\n" * (k == 3))
        want[f"f{k}.json"] = doc["cases"]
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "other.json").write_text('{"x": [{"id": 1}]}')
    name = "spark.sql.files.maxPartitionBytes"
    was, cost = spark.conf.get(name), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set(name, str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = {}
        for r in elements.read(spark, str(tmp_path), "cases").collect():
            got.setdefault(r["at"]["file"].rsplit("/", 1)[1], []).append((r["at"]["block"], r["at"]["number"], json.loads(r["element"])))
        assert {f: [x for *_, x in sorted(rows, key=lambda r: r[:2])] for f, rows in got.items()} == want
        if split < 1 << 20:
            assert len({b for rows in got.values() for b, *_ in rows}) >= (2 if split > 300 else 20)
        assert elements.broken(spark, str(tmp_path)).count() == 0
        (tmp_path / "cut.json").write_text('{"cases": [{"id": "a}b')
        assert [r["file"].rsplit("/", 1)[1] for r in elements.broken(spark, str(tmp_path)).collect()] == ["cut.json"]
    finally:
        spark.conf.set(name, was)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_the_last_row_of_an_id_wins(spark, tmp_path):
    docs = lambda t: [{"id": "d", "documents": [{"id": "x", "title": t}, {"id": "x", "title": t + "!"}]}]
    cases = [{"id": "a", "name": f"n{i}", "dockets": docs(f"t{i}")} for i in range(30)]
    (tmp_path / "c.json").write_text(json.dumps({"cases": cases}))
    raw = ingest.read_cases(spark, str(tmp_path / "c.json")).repartition(4)
    wh = ingest.Warehouse(spark, str(tmp_path / "wh"), buckets=3)
    ingest.run(wh, *ingest.flatten(raw), source="t")
    assert [r["name"] for r in wh.read("cases").collect()] == ["n29"] and [r["title"] for r in wh.read("documents").collect()] == ["t29!"]


def test_cases_that_cannot_be_taken_are_told(spark):
    js = ['{"name": "x"}', '{"id": "b", "dockets": 5}', '{"id": "c", "dockets": [{"documents": []}]}', '{"id": "d", "dockets": [{"id": "e", "documents": {}}]}', '{"id": "f", "dockets": [{"id": "e", "documents": [{}]}]}',
          '{"id": "g", "dockets": null}', '{"id": "h", "dockets": [{"id": "e", "documents": null}]}']
    from pyspark.sql import functions as F

    good, bad = ingest.checked(spark.createDataFrame([(j,) for j in js], "j string").select(F.parse_json("j").alias("raw")))
    assert {(r["id"], r["error"]) for r in bad.collect()} == {
        (None, "case without an id"), ("b", "dockets are no list"), ("c", "docket without an id"), ("d", "documents are no list"), ("f", "document without an id")
    }
    assert good.count() == 2
