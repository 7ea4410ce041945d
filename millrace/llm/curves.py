"""Operator 6: approximate nearest neighbours by shifted space-filling curves.

Vectors are projected on CURVES sets of DIMS orthogonal directions (those of one random rotation after another, so that
together they see every direction), shifted, and put in order along a Hilbert curve each. Spark sorts the orderings by range;
ranks cut them into cells of CELL vectors. A query is held against its own and both neighbouring cells of every ordering, so
against CELL to 2 * CELL vectors on either side, and the best of all cells are merged. Scores are inner products in double
precision of the original vectors.

How wide the windows must be depends on the number of vectors and their spread. So the true neighbours of SAMPLE queries are
found among all vectors (one pass), and windows are doubled until those lie within them by RECALL. Windows of more than HELD
numbers are several cells to either side. Orderings are kept as ids and keys; vectors join those that are searched. Where the
windows of all orderings together would hold as many vectors as the table, all cells of one ordering are searched instead, which
is less work and exact. Vectors without any structure (whose neighbours are hardly nearer than others) end there at every size.

Equal vectors are indexed once, with the ids that can matter (the k + 1 smallest), so that a common vector fills no cell.

Defined results: vectors that are null, zero, of another length than most, or that hold null or non-finite components take no
part, nor do rows without an id; rows that repeat an id and its vector count once; ties go to the smaller id; with at most
CELL distinct vectors the result is exact, as it is where all cells are searched; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Params:
    k: int = 20
    curves: int = 16
    dims: int = 8
    bits: int = 7
    #: vectors in a cell, to begin with: windows grow as the sampled queries need
    cell: int = 256
    seed: int = 11
    #: queries whose true neighbours are looked up, and the share of those that windows must reach
    sample: int = 200
    recall: float = 0.95
    #: numbers (vectors by their length) that a task holds of a wider window
    held: int = 1 << 22


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of grid cells (rows) on the Hilbert curve, by Gray decoding after Skilling (2004)."""
    x = cells.astype(np.int64)
    dims = x.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            flip = (x[:, i] & bit) != 0
            swap = np.where(flip, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(flip, low, swap)
            x[:, i] ^= swap if i else 0
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> level & 1)
    return key


def orderings(width: int, sigma: float, p: Params):
    """For each curve a function from vectors to positions on it."""
    dims = min(p.dims, width)
    each = max(1, width // dims)
    out = []
    for c in range(p.curves):
        turn = np.linalg.qr(np.random.default_rng((p.seed, c // each)).normal(size=(width, width)))[0]
        axes = turn[:, (c % each) * dims : (c % each + 1) * dims] / sigma
        shift = np.random.default_rng((p.seed, 1, c)).uniform(-4, 4, dims)

        def place(v: np.ndarray, axes=axes, shift=shift) -> np.ndarray:
            grid = np.floor((v @ axes + 8 + shift) * (1 << p.bits) / 16)
            return hilbert(np.clip(grid, 0, (1 << p.bits) - 1), p.bits)

        out.append(place)
    return out


def _placed(batches: Iterator[pa.RecordBatch], width: int, sigma: float, p: Params) -> Iterator[pa.RecordBatch]:
    places = orderings(width, sigma, p)
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        for c, place in enumerate(places):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(place(v)), batch.column("rep")], ["curve", "key", "rep"])


def _held(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (curve, cell, side, rep, embedding) in order of curve, cell and side: the vectors of a cell (side 0) are held, its
    queries (side 1) stream by; each gives its k best of the cell."""
    now, parts, ids, held = None, [], [], None
    kind = pa.list_(pa.struct([("score", pa.float64()), ("rep", pa.int64())]))
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("curve").to_numpy().astype(np.int64) << 40 | batch.column("cell").to_numpy()
        side, rep = batch.column("side").to_numpy(), batch.column("rep").to_numpy()
        v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        edges = np.flatnonzero(np.diff(key * 2 + side)) + 1
        who, best = [], []
        for lo, hi in zip([0, *edges], [*edges, len(key)], strict=True):
            if key[lo] != now:
                now, parts, ids, held = key[lo], [], [], None
            if side[lo] == 0:
                parts.append(v[lo:hi])
                ids.append(rep[lo:hi])
                continue
            if not parts:
                continue
            if held is None:
                held, names = np.concatenate(parts), np.concatenate(ids)
            take = min(k, len(names))
            few = max(1, (1 << 22) // len(names))
            for i in range(hi - lo):
                if i % few == 0:
                    near = v[lo + i : min(lo + i + few, hi)] @ held.T
                row = near[i % few]
                # rounding of the block product must not decide a tie: take those within it of the last
                last = np.partition(row, len(names) - take)[len(names) - take]
                at = np.flatnonzero(row >= last - 1e-9 * max(1.0, abs(last)))
                exact = (held[at] * v[lo + i]).sum(1)
                order = np.lexsort((names[at], -exact))[:take]
                who.append(rep[lo + i])
                best.append([{"score": float(s), "rep": int(r)} for s, r in zip(exact[order], names[at][order], strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(best, kind)], ["rep", "best"])


def _nearest(batches: Iterator[pa.RecordBatch], asked: np.ndarray, ids: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of a task's vectors (rep, embedding) for each of a few queries, itself left out."""
    score, near = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, asked.shape[1])
        rep = batch.column("rep").to_numpy()
        own = np.where(ids[:, None] == rep[None, :], -np.inf, asked @ v.T)
        score, near = np.hstack((score, own)), np.hstack((near, np.broadcast_to(rep, own.shape)))
        if score.shape[1] > k:
            at = np.argpartition(-score, k - 1, axis=1)[:, :k]
            score, near = np.take_along_axis(score, at, 1), np.take_along_axis(near, at, 1)
    cols = [pa.array(np.repeat(ids, score.shape[1])), pa.array(near.ravel()), pa.array(score.ravel())]
    yield pa.RecordBatch.from_arrays(cols, ["rep", "near", "score"])


def _window(vectors: DataFrame, ranked: DataFrame, n: int, width: int, p: Params) -> tuple[int, int, bool]:
    """Vectors in a cell, cells to either side of a query's, and whether all cells of one ordering are searched instead."""
    most = max(p.cell, p.held // width)
    whole = min(most, n), -(-n // min(most, max(n, 1))), True
    if n <= p.cell:
        return p.cell, 1, True
    some = vectors.where("asks").orderBy(F.xxhash64(F.lit(p.seed), "rep"), "rep").limit(p.sample).collect()
    if not some:
        return whole
    ids, asked = np.array([r["rep"] for r in some], np.int64), np.array([r["embedding"] for r in some], np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((asked, ids))  # p.sample vectors at most
    best = vectors.select("rep", "embedding").mapInArrow(lambda it: _nearest(it, *shared.value, p.k), "rep bigint, near bigint, score double")
    best = best.where(F.col("score") > float("-inf")).withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "near"))).where(F.col("r") <= p.k)
    pairs = np.array([(r["rep"], r["near"]) for r in best.select("rep", "near").collect()], np.int64)
    met = vectors.sparkSession.createDataFrame([(int(i),) for i in np.unique(pairs)], "rep bigint")  # (p.k + 1) * p.sample at most
    places = ranked.join(F.broadcast(met), "rep").select("curve", "rep", "rank").toPandas()
    order = places.pivot(index="rep", columns="curve", values="rank")
    a, b = order.loc[pairs[:, 0]].to_numpy(np.int64), order.loc[pairs[:, 1]].to_numpy(np.int64)
    window = p.cell
    while True:
        cell = min(window, most)
        reach = -(-window // cell)
        if p.curves * (2 * reach + 1) * cell >= n:
            return whole
        if (np.abs(a // cell - b // cell) <= reach).any(axis=1).mean() >= p.recall:
            return cell, reach, False
        window *= 2


def search(vectors: DataFrame, asks: Column, p: Params = Params()) -> DataFrame:
    """query_id, rank, vec_id and score of the p.k nearest found of each row that satisfies the condition `asks`."""
    return common.settled(lambda: _search(vectors, asks, p), "curves-result")


def _search(vectors: DataFrame, asks: Column, p: Params) -> DataFrame:
    sound = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = sound.where("vec_id is not null and size(embedding) > 0").where(finite & F.exists("embedding", lambda x: x != 0))
    power = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    shape = sound.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.avg(power).alias("p")).orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
    width, sigma = (shape[0]["width"], max((shape[0]["p"] / shape[0]["width"]) ** 0.5, 1e-300)) if shape else (1, 1.0)
    same = ("h1", "h2")
    sound = sound.where(F.size("embedding") == width).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding"), "asks": asks})

    # equal vectors: the representative, the ids that can be among the nearest, and whether any row asks
    first = Window.partitionBy(*same).orderBy("vec_id")
    few = sound.select("vec_id", *same).distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= p.k + 1)
    few = common.written(few.groupBy(*same).agg(F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "curves-ids")
    asking = common.written(sound.where("asks").select("vec_id", *same).distinct(), "curves-queries")
    distinct = sound.groupBy(*same).agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("rep"), F.max("asks").alias("asks"))

    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    distinct = distinct.select("rep", "asks", F.col("embedding").cast("array<float>").alias("embedding") if single else "embedding")
    distinct = common.written(distinct, "curves-vectors")
    # orderings hold ids alone; vectors join those that are searched
    placed = distinct.select("rep", "embedding").mapInArrow(lambda it: _placed(it, width, sigma, p), "curve int, key bigint, rep bigint")
    placed = placed.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep").withColumn("at", F.monotonically_increasing_id())
    placed = common.written(placed, "curves-orderings")
    # the rank of a row in its ordering: its place in its partition, and the rows of partitions before
    part = F.shiftright("at", 33)
    runs = placed.groupBy("curve", part.alias("part")).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = common.written(runs.withColumn("offset", before).drop("n"), "curves-runs")
    ranked = common.small_join(placed.withColumn("part", part), runs, ["curve", "part"]).select("curve", "rep", (F.col("offset") + F.col("at") - F.col("start")).alias("rank"))
    n = distinct.count()
    size, reach, whole = _window(distinct, ranked, n, width, p)
    cells = (ranked.where("curve = 0") if whole else ranked).join(distinct, "rep").withColumn("cell", F.floor(F.col("rank") / size))

    held = cells.select("curve", "cell", F.lit(0).alias("side"), "rep", "embedding")
    around = F.sequence(F.greatest(F.col("cell") - reach, F.lit(0)), F.least(F.col("cell") + reach, F.lit(max(n - 1, 0) // size)))
    ask = cells.where("asks").select("curve", F.explode(around).alias("cell"), F.lit(1).alias("side"), "rep", "embedding")
    work = held.unionByName(ask).repartition("curve", "cell").sortWithinPartitions("curve", "cell", "side", "rep")
    hits = work.mapInArrow(lambda it: _held(it, width, p.k + 1), "rep bigint, best array<struct<score:double,rep:bigint>>")

    # a query has a list of k + 1 from each of the cells it is held against
    merged = hits.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("best"))).alias("best"))
    ordered = F.sort_array(F.transform("best", lambda x: F.struct((-x["score"]).alias("s"), x["rep"].alias("near"))))
    merged = merged.select("rep", F.explode(F.slice(ordered, 1, p.k + 1)).alias("b")).select("rep", F.col("b.near").alias("near"), (-F.col("b.s")).alias("score"))
    wide = merged.join(few.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "score", F.explode("ids").alias("vec_id"))
    wide = wide.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= p.k + 1)
    named = asking.withColumnRenamed("vec_id", "query_id").join(few.select(*same, "rep"), list(same)).select("query_id", "rep")
    out = named.join(wide.drop("r"), "rep").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= p.k)
    return out.select("query_id", "rank", "vec_id", "score")
