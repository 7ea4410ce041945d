"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as Java and Python patterns take it; a word is a maximal run of anything else.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []
#: when unused shuffle files were looked for last
_swept = [0.0]


class _Scopes(threading.local):
    """Tables written within scopes that are open, of each thread."""

    def __init__(self) -> None:
        self.open: list[list[DataFrame]] = []


_scopes = _Scopes()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one of our own only where the cluster names none (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="millrace-"))
    return "file://" + _own_dir[0]


#: how rows of megabytes are written: Parquet's writer measures what it holds after the first 100 rows only, which would be all of a
#: task's, and then by its compressed size; a row group is also what a reader holds
WIDE = {"parquet.page.size.row.check.min": "1", "parquet.block.size": str(16 << 20), "parquet.block.row.count.limit": "4"}


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table in the shared folder and read it again: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options or {}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    if _scopes.open:
        _scopes.open[-1].append(out)
    del df
    swept(spark)
    return out


def swept(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more; else they stay until the driver's heap fills.
    The first collection frees what Python held, the second what that held in turn. Not more often than every two seconds: what
    a shorter time has written is small."""
    if time.monotonic() - _swept[0] < 2:
        return
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.1)
    spark.sparkContext._jvm.System.gc()
    _swept[0] = time.monotonic()


def settled(work: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of some work; tables that the work wrote on its way are deleted. The result's own table stays, as any
    number of plans may read it; it is the caller's to delete (`forget`), or goes with the shared folder."""
    scopes = _scopes.open
    scopes.append([])
    try:
        result = work()
        scopes.append([])
        try:
            return written(result, name)
        finally:
            final = scopes.pop()
            if len(scopes) > 1:
                scopes[-2].extend(final)
    finally:
        forget(*scopes.pop())


def forget(*frames: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_written_path", None)
        if path:
            spark = df.sparkSession
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def id_remainder(column: str, modulus: int) -> Column:
    """crc32 of the id written in decimal, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(-1))


#: Largest row count of a side that may be broadcast (rows here are keys with a few numbers, under 200 bytes).
BROADCAST_ROWS = 20_000


def small_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = 16, n: int | None = None) -> DataFrame:
    """Null-safe join with a table of one row a key. It is broadcast if its counted rows allow; else the big side's hot
    keys are spread over `salts` tasks and the small side is repeated that often. n: its size, where rows alone do not tell it."""
    n = small.count() if n is None else n
    left, right = big, small.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    drop = [f"__{k}" for k in keys]
    if n <= BROADCAST_ROWS:
        right = F.broadcast(right)
    else:
        left = left.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, k in big.dtypes if "map<" not in k]), F.lit(salts)).cast("int"))  # of the row: a task run again deals alike
        right = right.withColumn("__s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        on.append(F.col("__salt") == F.col("__s"))
        drop += ["__salt", "__s"]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(right, cond, how).drop(*drop)
