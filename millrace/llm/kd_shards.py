"""Operator 12: documents into shards of near equal bytes, by a k-d tree over their metadata.

A node of the tree is cut in two at the weighted median of its widest dimension, until every leaf is one shard (or reaches the
target bytes). Dimensions are the language and the source (a string's place is its hash, so no list of all values is ordered
anywhere) and the size (logarithmic); each runs from 0 to 65535, and the widest is that with the greatest variance, weighted by
bytes. Copies of a text share the least place of any of them, and rows that share a place are ordered by their text's hash, then
by a hash of their own: equal texts stay beside one another, and a hot source or one text in a third of all rows can still be
cut anywhere.

A median is found in passes over digits of 16 bits: bytes are summed up by node and digit (a partial aggregate before the shuffle,
65,536 groups a node at most), the digit that holds the middle is chosen, and the next pass looks only at rows with that digit,
until a cut beside the digit misses the middle by at most `slack` of a shard's bytes. Only where one text's copies weigh more than
that are they cut apart, by the rows' hashes. The driver holds the tree: a few numbers a shard, never rows.

Defined results: a text that is null has no bytes and counts as equal to the empty text; null languages and sources have a place
like any value; rows without an id and repeated rows are rows of their own; an empty table gives no rows; extra columns play no
part. Built-in functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARDS = 8
#: share of a shard's bytes by which a cut may miss its place
SLACK = 0.001
#: rows that are numbered in one task
PART = 50_000
DIGIT = 16
DIMENSIONS = ("lang", "source", "size")
PLACES = [f"at_{d}" for d in DIMENSIONS]
#: a row's place in the order of its node's dimension: the dimension, its text's hash, its own hash
DIGITS = [f"d{k}" for k in range(5)]


def _digit(hash64: Column, at: int) -> Column:
    """16 bits of a hash, from bit `at` on."""
    return F.shiftrightunsigned(hash64, at).bitwiseAND(F.lit((1 << DIGIT) - 1))


def placed(docs: DataFrame) -> DataFrame:
    """One row a document, written: its size, the digest of its text, its place in each dimension and the digits d1 to d4."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        _digit(F.xxhash64(F.lit("lang"), F.col("lang").cast("string")), 0).alias("at_lang"), _digit(F.xxhash64(F.lit("source"), F.col("source").cast("string")), 0).alias("at_source"),
        F.xxhash64(text).alias("same"), F.monotonically_increasing_id().alias("row"),
    )
    rows = common.written(rows, "kd-places")
    # a hot text's rows are one row of the groups after the map side's sum, and Spark deals its partition of the join anew
    copies = rows.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.min("at_lang").alias("l"), F.min("at_source").alias("s")).where("n > 1").drop("n")
    out = rows.join(copies, "same", "left").withColumns({"at_lang": F.coalesce("l", "at_lang"), "at_source": F.coalesce("s", "at_source")})
    # bytes are below 2^31, so a size's logarithm is below 22
    out = out.withColumn("at_size", F.least(F.lit(65535), F.floor(F.log(F.col("size")) * (65535 / 22.0))).cast("bigint"))
    own = F.xxhash64("doc_id", "row")
    digits = [_digit(F.col("same"), 16).alias("d1"), _digit(F.col("same"), 0).alias("d2"), _digit(own, 16).alias("d3"), _digit(own, 0).alias("d4")]
    out = common.written(out.select("doc_id", "size", "text_crc32", *PLACES, *digits), "kd-rows")
    common.forget(rows)
    return out


def _table(rows: DataFrame, tree: list[dict], *columns: str) -> DataFrame:
    """Nodes of the tree as a table of whole numbers."""
    js = json.dumps([{c: n[c] for c in columns} for n in tree])
    one = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(js), f"array<struct<{','.join(c + ' bigint' for c in columns)}>>")).alias("x"))
    return one.select("x.*")


def _in_nodes(rows: DataFrame, tree: list[dict], *columns: str) -> DataFrame:
    """Rows of the tree's open nodes with these columns of the node."""
    return common.small_join(rows, _table(rows, tree, "node", *columns), ["node"], "inner", n=len(tree))


def _d0() -> Column:
    return F.element_at(F.array(*PLACES), (F.col("dim") + 1).cast("int"))


def _widest(rows: DataFrame) -> list[dict]:
    """Open nodes with their bytes and the dimension (its number) of the greatest variance."""
    w = F.col("size").cast("double")
    sums = rows.groupBy("node", "leaves").agg(
        F.sum("size").alias("bytes"), *[F.sum(w * F.col(p)).alias(f"m_{p}") for p in PLACES], *[F.sum(w * F.col(p) * F.col(p)).alias(f"q_{p}") for p in PLACES]
    )
    # sums of doubles depend on their order in the last digits, which must not choose: tens of the variance, ties to the first
    spread = [F.round(F.col(f"q_{p}") / F.col("bytes") - F.pow(F.col(f"m_{p}") / F.col("bytes"), F.lit(2.0)), -1) for p in PLACES]
    best = F.greatest(*[F.struct(s.alias("s"), F.lit(-k).alias("k")) for k, s in enumerate(spread)])
    return [r.asDict() for r in sums.select("node", "leaves", "bytes", (-best["k"]).cast("bigint").alias("dim")).collect()]  # a row a node


def _cut(rows: DataFrame, tree: list[dict], slack: float) -> None:
    """Set each node's cut, c0 to c4: rows whose digits are less go left."""
    for n in tree:
        n["half"] = n["leaves"] // 2
        n["rest"] = n["bytes"] * n["half"] // n["leaves"]  # bytes that go left, of the rows that the digits chosen so far leave open
        n |= {f"c{k}": 0 for k in range(5)}
    todo = tree
    for k, digit in enumerate(DIGITS):
        at = _in_nodes(rows, todo, "dim", "rest", *[f"c{j}" for j in range(k)]).withColumn("d0", _d0())
        for j in range(k):
            at = at.where(F.col(f"d{j}") == F.col(f"c{j}"))
        sums = at.groupBy("node", "rest", digit).agg(F.sum("size").alias("here"))
        run = Window.partitionBy("node").orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)  # 65,536 rows at most
        sums = sums.withColumn("before", F.sum("here").over(run) - F.col("here"))
        reach = sums.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("here")))
        found = {r["node"]: r for r in reach.select("node", F.col(digit).alias("c"), "before", "here").collect()}  # a row a node
        more = []
        for n in todo:
            r = found[n["node"]]
            n["rest"] -= r["before"]
            over = r["here"] - n["rest"]
            n[f"c{k}"] = r["c"]
            if min(n["rest"], over) > slack * n["bytes"] / n["leaves"] and k < 4:
                more.append(n)
            elif over <= n["rest"]:  # the digit's rows go to the nearer side
                n[f"c{k}"] += 1
        if not (todo := more):
            return


def _left() -> Column:
    less, equal = F.lit(False), F.lit(True)
    for k, d in enumerate(DIGITS):
        less = less | (equal & (F.col(d) < F.col(f"c{k}")))
        equal = equal & (F.col(d) == F.col(f"c{k}"))
    return less


def leaves(rows: DataFrame, shards: int, slack: float = SLACK) -> DataFrame:
    """The rows of placed() with their node, the number of the leaf; written level by level."""
    rows = rows.withColumns({"node": F.lit(0).cast("bigint"), "leaves": F.lit(shards).cast("bigint")})
    while tree := _widest(rows.where("leaves > 1")):
        _cut(rows, tree, slack)
        names = ["dim", "half", *[f"c{k}" for k in range(5)]]
        at = common.small_join(rows, _table(rows, tree, "node", *names), ["node"], "left", n=len(tree)).withColumn("d0", _d0())
        # a node's number is its first leaf's, and the left side keeps it
        here, left = F.col("half").isNull(), _left()
        at = at.withColumns({
            "node": F.when(here | left, F.col("node")).otherwise(F.col("node") + F.col("half")),
            "leaves": F.when(here, F.col("leaves")).when(left, F.col("half")).otherwise(F.col("leaves") - F.col("half")),
        })
        old, rows = rows, common.written(at.select(*rows.columns), "kd-rows")
        common.forget(old)
    return rows


def numbered(rows: DataFrame, part: int = PART) -> DataFrame:
    """slot: gapless from 0 within each shard, whatever its size. Parts of about `part` rows are numbered on their own, by their
    hash; a part begins where the parts before it end."""
    parts = max(1, math.ceil(rows.count() / part))
    rows = rows.withColumn("__part", F.pmod(F.col("d3") * 65536 + F.col("d4"), F.lit(parts)))
    sizes = rows.groupBy("shard", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    starts = common.written(sizes.select("shard", "__part", before.alias("__start")), "kd-parts")  # one row for `part` rows of the table
    own = F.row_number().over(Window.partitionBy("shard", "__part").orderBy("d3", "d4", "doc_id", "d1", "d2"))
    out = common.small_join(rows.withColumn("__own", own), starts, ["shard", "__part"], "inner")
    return out.withColumn("slot", F.col("__start") + F.col("__own") - 1).drop("__part", "__own", "__start")


def shard(docs: DataFrame, shards: int = SHARDS, *, target_bytes: int | None = None, slack: float = SLACK, part: int = PART) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row. shards, or the bytes that leaves are to reach."""

    def work() -> DataFrame:
        rows, n = placed(docs), shards
        if target_bytes:
            n = max(1, math.ceil((rows.agg(F.sum("size")).first()[0] or 0) / target_bytes))
        out = leaves(rows, n, slack).withColumn("shard", F.col("node").cast("int"))
        return numbered(out, part).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

    return common.settled(work, "kd-result")
