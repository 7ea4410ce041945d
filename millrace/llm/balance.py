"""Operator 9: mixing sources to target weights by entropy balancing (native: DataFrame functions only).

Rates. Each document of size x gets a rate r in [0, cap]. Among all rates that give a source its target of words, those
nearest to one copy of everything (least relative entropy, Hainmueller 2012) have the form min(cap, exp(l * x / mean)):
the dual, one multiplier l a source, is convex, and Newton's method on it needs only sums over documents. They run over
counts of equal sizes, all sources at once, with a bracket as safeguard.

Copies. Rates are rounded by systematic sampling: in order of size within salted parts of a source, the running sum of rates
is cut at whole numbers plus a phase. Neighbours have like sizes, so the taken words of a part miss their expectation by
about one document at most; of PHASES phases each source takes the one that comes nearest its target.

Defined results: a null text has size 0; documents of size 0 are taken once and add nothing; a source of size 0 has target
0; null is a source of its own, last in order; ties in size are ordered by a hash of the id, then by the id; rows that agree
in source, size and id get copies in any order, but the same number together; an empty table gives an empty result; other
columns are ignored by `mix` and kept by `mixed`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Params:
    #: weights of the sources in order, repeated as often as needed
    weights: Sequence[int] = field(default=(1, 2, 3))
    #: most copies of a document, and most multiple of a source's size that its target can be
    cap: int = 3
    #: Newton steps at most, and the relative gap to the target that ends them
    steps: int = 40
    tolerance: float = 1e-6
    #: rows of a source that are rounded in one task, about
    part: int = 4000
    phases: int = 32


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(common.words(F.col("text"))).cast("bigint"))


def targets(sources: DataFrame, p: Params) -> DataFrame:
    """Adds weight and target to one row a source with its source_size. The excess over cap * size is shared again by weight
    until none is above. A source is filled once the common level exceeds cap * size / weight; so the level follows from one
    ordered pass over the sources, a table of one small row a source."""
    one = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in p.weights]), (F.pmod(F.row_number().over(one) - 1, F.lit(len(p.weights))) + 1).cast("int"))
    rows = sources.withColumn("weight", w).withColumn("limit", F.lit(float(p.cap)) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").isNull(), "source")
    total, all_weight = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    full, used = F.coalesce(F.sum("limit").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # if sources before this one are full and none from here on, the level is what remains by what weight remains
    rows = rows.withColumn("level", (total - full) / (all_weight - used))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio").alias("r"), F.col("level").alias("l")))).over(Window.partitionBy())
    return rows.withColumn("level", level["l"]).select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _rate(multiplier: Column, x: Column, p: Params) -> Column:
    ceiling = F.log(F.lit(float(p.cap)))
    return F.exp(F.least(ceiling, multiplier * x))


def multipliers(hist: DataFrame, goals: DataFrame, p: Params) -> DataFrame:
    """source, mean and multiplier. hist: source, size, n; goals: source, source_size, target."""
    means = hist.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least"))
    state = common.small_join(goals.where("source_size > 0"), means, ["source"])
    # at multiplier hi even the smallest document reaches the cap; far below lo nothing is left
    state = state.select(
        "source", "mean", "target", F.lit(0.0).alias("l"), F.lit(-60.0 * 1000).alias("lo"),
        (F.log(F.lit(float(p.cap))) * F.col("mean") / F.col("least")).alias("hi"), F.lit(1.0).alias("gap"),
    )
    state = common.written(state, "balance-dual")
    x = F.col("size") / F.col("mean")
    for _ in range(p.steps):
        r = _rate(F.col("l"), x, p)
        tilted = common.small_join(hist.where("size > 0"), state.select("source", "mean", "l"), ["source"])
        sums = tilted.groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.when(F.col("l") * x < F.log(F.lit(float(p.cap))), F.col("n") * F.col("size") * x * r).otherwise(0.0)).alias("slope")
        )
        at = common.small_join(state, sums, ["source"])
        miss = F.col("target") - F.col("got")
        lo, hi = F.when(miss > 0, F.col("l")).otherwise(F.col("lo")), F.when(miss < 0, F.col("l")).otherwise(F.col("hi"))
        at = at.withColumns({"lo": lo, "hi": hi, "gap": F.abs(miss) / F.greatest("target", F.lit(1.0))})
        newton = F.col("l") + miss / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("lo")) & (newton < F.col("hi"))
        step = F.when(F.col("gap") <= p.tolerance, F.col("l")).when(inside, newton).otherwise((F.greatest(F.col("lo"), 4 * F.least(F.col("l"), F.lit(-1.0))) + F.col("hi")) / 2)
        new = common.written(at.select("source", "mean", "target", step.alias("l"), "lo", "hi", "gap"), "balance-dual")
        common.forget(state)
        state = new
        if state.where(F.col("gap") > p.tolerance).isEmpty():
            break
    # in steps of 2^-20: sums of doubles depend on their order in the last digits, which must not reach the rounding
    return state.select("source", "mean", (F.round(F.col("l") * (1 << 20)) / (1 << 20)).alias("multiplier"))


def mix(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken of every row."""
    return common.settled(lambda: _mix(sized(docs.select("doc_id", "source", "text")).drop("text"), p, "doc_id"), "balance-result")


def _mix(rows: DataFrame, p: Params, *extra: str) -> DataFrame:
    rows = common.written(rows, "balance-sizes")
    hist = common.written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "balance-counts")
    sources = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs"))
    goals = common.written(targets(sources.drop("docs"), p), "balance-goals")
    dual = common.small_join(common.small_join(goals, multipliers(hist, goals, p), ["source"]), sources.select("source", "docs"), ["source"])
    dual = common.written(dual, "balance-rates")

    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") >= p.cap * F.col("source_size"), float(p.cap)).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("mean"), p))
    tie = F.xxhash64(F.col("doc_id"))
    rated = common.small_join(rows, dual, ["source"]).withColumn("rate", rate)
    parts = rated.withColumn("__part", F.pmod(tie, F.ceil(F.col("docs") / p.part)))
    run = Window.partitionBy("source", "__part").orderBy("size", tie, "doc_id", F.monotonically_increasing_id())
    # rates in steps of 2^-32, so that the running sums are exact and do not depend on the order of addition
    unit = 1 << 32
    whole = F.round(F.col("rate") * unit).cast("bigint")
    parts = parts.withColumn("__r", whole).withColumn("__end", F.sum("__r").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    parts = common.written(parts.drop("mean", "multiplier", "docs"), "balance-runs")

    def copies(phase: Column) -> Column:
        return F.floor((F.col("__end") + phase) / F.lit(unit)) - F.floor((F.col("__end") - F.col("__r") + phase) / F.lit(unit))

    marks = [unit * k // p.phases + unit // (2 * p.phases) for k in range(p.phases)]
    sums = parts.groupBy("source", "target").agg(*[F.sum(copies(F.lit(m)) * F.col("size")).alias(f"s{k}") for k, m in enumerate(marks)])
    best = F.least(*[F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("d"), F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate(marks)])
    phase = sums.select("source", best["m"].alias("__phase"))
    out = common.small_join(parts, common.written(phase, "balance-phases"), ["source"])
    out = out.withColumn("copies", F.least(F.lit(p.cap), copies(F.col("__phase"))).cast("int"))
    return out.select(*extra, "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """The rows of docs as often as the mix takes them, unchanged otherwise. A row is matched by id and text; equal rows share
    their copies evenly."""
    key = F.xxhash64("text", "source")
    rows = docs.select("doc_id", "source", key.alias("__key"), F.size(common.words(F.col("text"))).cast("bigint").alias("size"))

    def copies() -> DataFrame:
        got = _mix(rows, p, "doc_id", "__key").groupBy("doc_id", "__key").agg(F.floor(F.avg("copies") + 0.5).cast("int").alias("__copies"))
        return got.where("__copies <> 1").select(F.col("doc_id").alias("__id"), F.col("__key").alias("__k"), "__copies")

    other = common.settled(copies, "balance-copies")
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), key.alias("row_key"))
    out = packed.join(other.hint("merge"), F.col("row_id").eqNullSafe(F.col("__id")) & (F.col("row_key") == F.col("__k")), "left")
    times = F.coalesce("__copies", F.lit(1))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
