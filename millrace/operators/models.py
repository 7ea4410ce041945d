"""Places where a model can stand in: a callable over batches of texts, run by executors. Without one, a fixed heuristic serves, so
that every flow runs offline."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..functions.scalar import judge_reply
from .parse import extract

#: a batch of prompts to a batch of replies
Model = Callable[[Sequence[str]], Sequence[str]]


def replies(model: Model, prompts: Sequence[str], tries: int = 1, pause: float = 0.0) -> list[str]:
    """A reply for each prompt. A batch that fails, or that gives another number of replies, is halved until single prompts fail; these
    are tried `tries` times, with a pause that doubles, and give a text that starts with "ERROR:"."""
    out: list[str] = [""] * len(prompts)
    todo = [(0, len(prompts))] if len(prompts) else []
    while todo:
        lo, hi = todo.pop()
        for k in range(tries if hi - lo == 1 else 1):
            if k and pause:
                time.sleep(pause * 2 ** (k - 1))
            try:
                got = list(model(prompts[lo:hi]))
                if len(got) != hi - lo:
                    raise ValueError(f"{len(got)} replies to {hi - lo} prompts")
                out[lo:hi] = got
                break
            except Exception as e:
                error = f"ERROR: {e}"
        else:
            if hi - lo == 1:
                out[lo] = error
            else:
                mid = (lo + hi) // 2
                todo += [(mid, hi), (lo, mid)]
    return out


def generate(df: DataFrame, prompt: str = "prompt", model: Model | None = None, context_tokens: int = 32_768, reserve: int = 1024, tries: int = 1, pause: float = 0.0, batch: int = 256) -> DataFrame:
    """Adds generated. Prompts that leave no room in the context, and null ones, are not sent; one that fails (`replies`) gives a text that
    starts with "ERROR:", and costs the others nothing. A model is given `batch` prompts at most at once."""
    fits = T.tokens_estimate(prompt) + reserve <= context_tokens
    if model is None:
        return df.withColumn("generated", F.when(fits, F.array_join(T.first_sentences(F.coalesce(F.col(prompt), F.lit("")), 4), " ")))
    kind = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "generated") + ", generated string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, batch):
                part = whole.slice(k, batch)
                prompts, send = part.column(prompt).to_pylist(), part.column("__fits").to_pylist()
                got = iter(replies(model, [p for p, s in zip(prompts, send) if s], tries, pause))
                kept = [(f.name, part.column(i)) for i, f in enumerate(part.schema) if f.name != "__fits"]
                kept.append(("generated", pa.array([next(got) if s else None for s in send], pa.string())))
                yield pa.RecordBatch.from_arrays([c for _, c in kept], [c for c, _ in kept])

    return df.drop("generated").withColumn("__fits", F.coalesce(fits & F.col(prompt).isNotNull(), F.lit(False))).mapInArrow(run, kind)


def generate_into(path: str, df: DataFrame, key: str, prompt: str = "prompt", slices: int = 8, **options) -> DataFrame:
    """Rows of df with what was generated, kept in a folder: rows that have a reply there are not sent again, those that failed are. Work is
    put down slice by slice (by the key's hash), so that a run that ends in the middle loses one slice at most."""
    spark = df.sparkSession
    kind = StructType([*df.drop("generated").schema, StructField("generated", StringType())])
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    for k in range(slices):
        rows = df.where(F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(slices)) == k)
        if fs.exists(p):
            rows = rows.join(without_errors(spark.read.schema(kind).parquet(path)).select(key), key, "left_anti")
        generate(rows, prompt, **options).select(*kind.names).write.mode("append").parquet(path)
    made = spark.read.schema(kind).parquet(path)
    # of several tries the one that did not fail counts
    good = ~F.coalesce(F.col("generated").startswith("ERROR:"), F.lit(False))
    last = made.groupBy(key).agg(F.max_by("generated", F.struct(good, F.col("generated"))).alias("generated"))
    return df.drop("generated").join(last, key, "left")


def without_errors(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce(F.col("generated").startswith("ERROR:"), F.lit(False)))


# Dimensions of a judge's scores.
DIMENSIONS = ("factual_accuracy", "completeness", "conciseness_style", "legal_reasoning", "overall")


def judged_by(df: DataFrame, reply: str) -> DataFrame:
    """Writes a judge's replies back to their rows: judge_* and judge_rationale ('' if the reply has none). A reply that is no JSON
    leaves nulls, and counts as a failure."""
    got = judge_reply(reply)
    field = lambda name, kind: F.try_variant_get(F.col("__reply"), f"$.{name}", kind)
    out = df.withColumn("__reply", got).withColumns({f"judge_{d}": field(d, "double").cast("int") for d in DIMENSIONS})
    return out.withColumn("judge_rationale", F.when(F.col("__reply").isNotNull(), F.coalesce(field("brief_rationale", "string"), F.lit("")))).drop("__reply")


def extractor(model: Model | None = None) -> Callable[[Column], Column]:
    """For prompts.extract_first: a document's extract by a model, or by the heuristic."""
    if model is None:
        return lambda d: extract(d["body"])
    raise ValueError("a model's extracts go through the cache: generate() them, and give the table as cache")
