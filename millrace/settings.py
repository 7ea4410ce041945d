"""Settings of a deployment: options over environment variables with a prefix, over defaults."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; one of our own only with a local master (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="millrace-"))
    return "file://" + _own_dir[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written once in the shared folder and read again, for results that several steps read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Settings:
    api_url: str = ""
    api_token: str = ""
    request_gap_seconds: float = 1.5
    request_tries: int = 5
    backoff_seconds: float = 1.0
    max_backoff_seconds: float = 60.0
    warehouse: str = "warehouse"
    checkpoint_key: str = "live"
    resume: bool = True
    case_limit: int = 0
    archive_payloads: bool = True

    @classmethod
    def load(cls, prefix: str = "MILLRACE_", **options) -> Settings:
        """An unset or empty variable counts as absent."""
        out = {}
        for f in fields(cls):
            raw = options.get(f.name, os.environ.get(prefix + f.name.upper()) or None)
            if raw is not None:
                kind = type(f.default)
                out[f.name] = raw if not isinstance(raw, str) or kind is str else raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
        return cls(**out)
