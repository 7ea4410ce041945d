"""File scans and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.parse import source_chunks


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line is an error."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """An array of objects, or a single one."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: its name without extension, and its text as the prediction."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(F.regexp_replace(name, r"\.[^.]*$", "").alias("case_id"), F.col("value").alias("prediction"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def numeric_means(df: DataFrame) -> DataFrame:
    return df.agg(*[F.avg(c).alias(c) for c, kind in df.dtypes if kind in ("double", "float", "int", "bigint", "smallint", "tinyint") or kind.startswith("decimal")])


def numbered_lines(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(line, value) with the number of each line, blank ones counted; the first n only if n is given. A file is split by bytes, so
    a line's number is its place in its split and the lines of splits before, which one pass counts (one row a split)."""
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    rows = spark.read.text(path).select("value", *split, F.monotonically_increasing_id().alias("at"))
    w = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file", "start").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"))
    counts = counts.select("file", "start", "first", F.coalesce(F.sum("lines").over(w), F.lit(0)).alias("before"))
    out = rows.join(counts, ["file", "start"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")
    return out.where(F.col("line") < n) if n else out


def read_eval(spark: SparkSession, path: str, schema: str, n: int | None = None) -> DataFrame:
    """Evaluation records; a record without an index has its line's number."""
    rows = numbered_lines(spark, path, n).where(T.strip("value") != "").select("line", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("line", "r.*")
    index = F.coalesce("index", "line") if "index" in rows.columns else F.col("line")
    return rows.withColumn("index", index).drop("line")


def read_sources(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(line, case_id, case_name, chunks) of split records."""
    rows = numbered_lines(spark, path, n).where(T.strip("value") != "").select("line", F.from_json("value", "case_id string, prompt string").alias("r"))
    prompt, case = F.coalesce("r.prompt", F.lit("")), F.coalesce("r.case_id", F.col("line").cast("string"))
    name = F.coalesce(T.strip(T.first_match(prompt, r"\nCase:\s*(.+)\n", 1)), F.concat(F.lit("Case "), case))
    return rows.select("line", case.alias("case_id"), name.alias("case_name"), source_chunks(prompt).alias("chunks"))


def with_completion(df: DataFrame) -> DataFrame:
    """Split records as training wants them: a prompt, and a completion that may be named response."""
    if "prompt" not in df.columns:
        raise ValueError("records need a prompt")
    if "completion" in df.columns:
        return df
    if "response" not in df.columns:
        raise ValueError("records need a completion or a response")
    return df.withColumn("completion", F.col("response"))


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    df.write.option("ignoreNullFields", not keep_nulls).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row table of nested metrics as JSON."""
    df.coalesce(1).write.option("ignoreNullFields", False).json(path)


def embedded(rows: DataFrame, *columns: str) -> Column:
    """JSON of a row that can stand in a script element."""
    return F.replace(F.to_json(F.struct(*columns)), F.lit("</"), F.lit("<\\/"))


def log_rows(lines: DataFrame, metric: str = "loss") -> DataFrame:
    """step and the metric of the lines (value) of a training log that have it as a number, not null; lines that are no JSON, or of another kind
    (evaluations, totals), are left out."""
    row = F.from_json("value", f"step bigint, `{metric}` double")
    return lines.select(row.alias("r")).select("r.step", F.col(f"r.`{metric}`").alias(metric)).where(F.col(metric).isNotNull())
