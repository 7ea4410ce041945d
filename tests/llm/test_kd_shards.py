"""Operator 12 against a plain k-d tree over the same places."""

import zlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import kd_shards, queries

from ..conftest import SF
from .data import documents


def tree_plainly(rows, shards, slack):
    """Shard of each row: rows sorted whole, cut at the weighted median beside a digit, as deep as the slack asks."""
    if shards == 1 or not rows:
        return {r["id"]: 0 for r in rows}
    total = sum(r["size"] for r in rows)

    def spread(d):
        m = sum(r["size"] * r[d] for r in rows) / total
        return round(sum(r["size"] * r[d] ** 2 for r in rows) / total - m * m, -1)

    dim = max(kd_shards.PLACES, key=lambda d: (spread(d), -kd_shards.PLACES.index(d)))
    goal = total * (shards // 2) // shards
    for depth in range(1, 6):
        key = lambda r: (r[dim], r["d1"], r["d2"], r["d3"], r["d4"])[:depth]  # noqa: E731, B023
        units, before = {}, 0
        for r in sorted(rows, key=key):
            units[key(r)] = units.get(key(r), 0) + r["size"]
        for unit, here in units.items():
            if before <= goal < before + here:
                break
            before += here
        if min(goal - before, before + here - goal) <= slack * total / shards or depth == 5:
            break
    with_it = before + here - goal <= goal - before
    left = [r for r in rows if key(r) < unit or (with_it and key(r) == unit)]
    taken = {r["id"] for r in left}
    out = tree_plainly(left, shards // 2, slack)
    return out | {i: s + shards // 2 for i, s in tree_plainly([r for r in rows if r["id"] not in taken], shards - shards // 2, slack).items()}


def check(docs, out, shards=8):
    rows = out.collect()
    want = [(r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect()]
    assert sorted([(r["doc_id"], r["size"], r["text_crc32"]) for r in rows], key=repr) == sorted(want, key=repr)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and {(r["law"], r["grown_shard"]) for r in rows} <= {("bytes", None)}
    held = [[r for r in rows if r["shard"] == k] for k in range(shards)]
    assert sum(map(len, held)) == len(rows) and all(sorted(r["slot"] for r in h) == list(range(len(h))) for h in held)
    return [sum(r["size"] for r in h) for h in held], rows


@pytest.mark.parametrize("shards, slack", [(8, 0.001), (8, 0.05), (5, 0.001), (1, 0.001)])
def test_like_a_plain_tree(spark, shards, slack):
    rows = kd_shards.placed(documents(spark, 160, extra=True))
    plain = [r.asDict() | {"id": i} for i, r in enumerate(sorted(rows.collect(), key=repr))]
    want = tree_plainly(plain, shards, slack)
    got = sorted(kd_shards.leaves(rows, shards, slack).select(*rows.columns, "node").collect(), key=repr)
    assert [r["node"] for r in got] == [want[i] for i in range(len(plain))]


def test_laws(spark):
    docs = documents(spark, 400, extra=True)
    check(docs, kd_shards.shard(docs, part=7))  # with two texts of 25,000 bytes, together more than a shard
    few = docs.where("length(text) < 2000")
    sizes, rows = check(few, kd_shards.shard(few))
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
    again = kd_shards.shard(few.repartition(3)).collect()
    assert {(r["doc_id"], r["shard"]) for r in again} == {(r["doc_id"], r["shard"]) for r in rows}


def test_hot_rows_are_cut(spark):
    """One text in most rows, and one row over and over: shards stay near equal; other copies stay together."""
    docs = spark.range(3000).select(
        F.when(F.col("id") < 1500, F.col("id")).when(F.col("id") < 2500, F.lit(7)).alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 != 0, "hot").alias("source"),
        F.when(F.col("id") % 3 != 1, F.lit("the same text in every row")).otherwise(F.concat(F.lit("a text of its own "), (F.col("id") % 600).cast("string"))).alias("text"),
    )
    sizes, rows = check(docs, kd_shards.shard(docs, part=100))
    assert max(sizes) < 1.02 * min(sizes)
    of = {}
    for r in rows:
        of.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert sum(len(s) > 1 for s in of.values()) <= 7


def test_target_bytes_and_empty_tables(spark):
    docs = documents(spark, 100).where("length(text) < 2000")
    total = sum(len(r["text"].encode()) + 1 for r in docs.collect())
    out = kd_shards.shard(docs, target_bytes=total // 11)
    assert out.agg(F.max("shard")).first()[0] == 11
    check(docs, out, 12)
    assert kd_shards.shard(docs.limit(0)).count() == 0 and kd_shards.shard(docs.limit(0), target_bytes=5).count() == 0
    three = docs.orderBy("doc_id").limit(3)
    check(three, kd_shards.shard(three))


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, rows = check(docs, queries.op12_kd_shards(spark, SF))
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in rows)
