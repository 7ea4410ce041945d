"""Order statistics and running averages that no task holds whole.

`quantiles` finds exact ranks in passes: a sketch of what is still open (mergeable, of bounded size) proposes splitters, an exact count by
cell follows, and only the cells that hold a wanted rank are open in the next pass, until a cell is one value or small. `smoothed`
is an associative scan of affine maps: ranges of the ordered rows are scanned on their own, one row a range is composed in order, and
each row is put through what comes before its range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..settings import written

#: values of a cell that are sorted at once, and cells that an open cell is cut into
SMALL, CELLS = 10_000, 64


def _same(by: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    return on


def quantiles(df: DataFrame, value: str, fractions: Sequence[float], by: Sequence[str] = (), small: int = SMALL, cells: int = CELLS) -> DataFrame:
    """by, fraction, value: exact quantiles with linear interpolation of a group's values, nulls left out; a group without values has no
    rows. Each pass reads df; the driver holds a few numbers a group and fraction."""
    spark, groups = df.sparkSession, [df.schema[c] for c in by]
    x = df.select(*by, F.col(value).cast("double").alias("__x")).where("__x is not null")
    first = x.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).collect()
    held = [(tuple(r[c] for c in by), r["__n"], r["__lo"], r["__hi"]) for r in first if r["__n"]]
    # of each wanted rank: the values it may be (least, greatest), how many lie below them, and how many there are
    ranks = {(g, k): (lo, hi, 0, n) for g, n, lo, hi in held for f in fractions for k in (math.floor(f * (n - 1)), math.ceil(f * (n - 1)))}
    schema = S.StructType([S.StructField("__id", S.LongType()), *[S.StructField(f"__g_{c.name}", c.dataType) for c in groups], S.StructField("__a", S.DoubleType()), S.StructField("__b", S.DoubleType()), S.StructField("__ks", S.ArrayType(S.LongType()))])

    def inside(open_: list[tuple]) -> DataFrame:
        rows = [(i, *g, lo, hi, sorted({k - below for (g2, k), s in ranks.items() if g2 == g and s == (lo, hi, below, n)})) for i, (g, (lo, hi, below, n)) in enumerate(open_)]
        return x.join(F.broadcast(spark.createDataFrame(rows, schema)), _same(by) & F.col("__x").between(F.col("__a"), F.col("__b")))  # a row a group and fraction

    while open_ := list(dict.fromkeys((g, s) for (g, _), s in ranks.items() if s[0] < s[1])):
        few, many = [o for o in open_ if o[1][3] <= small], [o for o in open_ if o[1][3] > small]
        if few:
            values = inside(few).groupBy("__id", "__ks").agg(F.sort_array(F.collect_list("__x")).alias("v"))  # SMALL values at most
            for r in values.select("__id", "__ks", F.transform("__ks", lambda k: F.get("v", k.cast("int"))).alias("v")).collect():
                g, (_, _, below, _) = few[r["__id"]]
                for k, v in zip(r["__ks"], r["v"]):
                    ranks[g, k + below] = (v, v, k + below, 1)
        if many:
            rows = inside(many)
            points = F.percentile_approx("__x", F.array(*[F.lit((i + 0.5) / cells) for i in range(cells)]), F.lit(100 * cells))
            told = rows.groupBy("__id").agg(F.array_distinct(points).alias("s"))
            # a cell lies between two splitters, or is one: so a value in most rows is a cell of its own
            cell = 2 * F.size(F.filter("s", lambda s: s < F.col("__x"))) + F.array_contains("s", F.col("__x")).cast("int")
            counts = rows.join(F.broadcast(told), "__id").groupBy("__id", cell.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
            found: dict[int, list] = {}
            for r in counts.collect():  # a few rows a splitter
                found.setdefault(r["__id"], []).append((r["c"], r["n"], r["lo"], r["hi"]))
            for i, (g, s) in enumerate(many):
                below = s[2]
                for _, n, lo, hi in sorted(found[i]):
                    for k in [k for (g2, k), s2 in ranks.items() if g2 == g and s2 == s and below <= k < below + n]:
                        ranks[g, k] = (lo, hi, below, n)
                    below += n
    out = []
    for g, n, _, _ in held:
        for f in fractions:
            at = f * (n - 1)
            a, b = ranks[g, math.floor(at)][0], ranks[g, math.ceil(at)][0]
            out.append((*g, float(f), a if a == b else a + (b - a) * (at - math.floor(at))))
    return spark.createDataFrame(out, S.StructType([*groups, S.StructField("fraction", S.DoubleType()), S.StructField("value", S.DoubleType())]))


def scanned(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Composition of each map s -> a * s + b with all before it."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:] += a[d:] * b[:-d]
        a[d:] = a[d:] * a[:-d]
        d *= 2
    return a, b


def _ranges(batches: Iterator[pa.RecordBatch], alpha: float) -> Iterator[pa.RecordBatch]:
    """Rows in order to the map that gives their average from what comes before their range: null, where their value is."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    carry, last, at = (1.0, 0.0), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column("__x").to_numpy(zero_copy_only=False).astype(np.float64)
        none = np.array(batch.column("__x").is_null())
        keys = batch.column("__key").to_pylist()
        # a series begins where the key changes or after a null; the range's first row is taken to go on
        before = [keys[0] if last is None else last[0], *keys[:-1]]
        starts = np.array([k != l for k, l in zip(keys, before)])
        starts[1:] |= none[:-1]
        starts[0] |= last is not None and last[1]
        a, b = np.where(starts, 0.0, 1 - alpha), np.where(starts, x, alpha * x)
        a[none], b[none] = 0.0, 0.0
        a, b = scanned(a, b)
        a, b = a * carry[0], a * carry[1] + b
        carry, last = (float(a[-1]), float(b[-1])), (keys[-1], bool(none[-1]))
        kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if not f.name.startswith("__")]
        n = batch.num_rows
        new = [("__part", pa.array([part] * n, pa.int64())), ("__at", pa.array(np.arange(at, at + n))), ("__key", batch.column("__key")), ("__x", pa.array(x, mask=none)), ("__a", pa.array(a)), ("__b", pa.array(b))]
        at += n
        yield pa.RecordBatch.from_arrays([c for _, c in kept + new], [c for c, _ in kept + new])


def smoothed(df: DataFrame, value: str, order: str, alpha: float, by: str | None = None) -> DataFrame:
    """by, order and ema: the exponential moving average along `order` (ties by value), s = alpha * x + (1 - alpha) * s, which begins with
    the first value, and anew after a null, which gives a null. A series of any length is cut into ranges; the scan is written
    once, in the shared folder."""
    spark, names = df.sparkSession, [*([by] if by else []), order]
    key = F.to_json(F.struct(by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = df.select(*names, key.alias("__key"), F.col(value).cast("double").alias("__x"))
    dealt = rows.repartitionByRange(*names).sortWithinPartitions(*names, "__x")
    schema = S.StructType([*[df.schema[c] for c in names], *S.StructType.fromDDL("__part bigint, __at bigint, __key string, __x double, __a double, __b double")])
    scan = written(dealt.mapInArrow(lambda it: _ranges(it, alpha), schema), "averages")
    ends = scan.groupBy("__part").agg(F.min_by(F.struct("__key", "__x"), "__at").alias("first"), F.max_by(F.struct("__key", "__x", "__a", "__b"), "__at").alias("last"))
    befores, s, last = [], None, None
    for r in sorted(ends.collect(), key=lambda r: r["__part"]):  # one row a range
        goes_on = last is not None and last == r["first"]["__key"] and s is not None
        # a series that begins here: with its first value before it, the first average is that value
        before = s if goes_on else (r["first"]["__x"] or 0.0)
        befores.append((r["__part"], float(before)))
        end = r["last"]
        last, s = end["__key"], None if end["__x"] is None else end["__a"] * before + end["__b"]
    told = spark.createDataFrame(befores, "__part bigint, __before double")
    out = scan.join(F.broadcast(told), "__part")  # one row a range
    return out.select(*names, F.when(F.col("__x").isNotNull(), F.col("__a") * F.col("__before") + F.col("__b")).alias("ema"))
