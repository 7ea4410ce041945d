"""The curation pipeline: quality rules, toxicity, near duplicates, source mix, token ids.

Each stage takes a table with the columns of documents and hands on rows of it, unchanged and with all their columns (the last one
hands on token ids). An empty table, or one of which a stage rejects all rows, gives an empty table. Extra columns stay, whatever
they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import balance, bpe, common, ngram_join, quality_mcd, toxicity


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and are no outliers in their language and source. Null and empty texts fail; null lang or source
    form groups of their own; equal rows get equal verdicts; rows are told apart by their content, so a null or repeated id does
    no harm."""
    return quality_mcd.keep_quality(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is not tagged toxic, by a tagger fitted on the labelled rows among docs. A null or empty text counts as clean;
    without toxic or without clean labels nothing is rejected; ids play no part but to find labels."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts joined by links of similarity 0.8 or more over five-word shingles: that with the smallest id.
    Texts without words link with nothing; of rows that repeat an id one stays, rows without an id all do."""
    return ngram_join.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it (none to three times); null sources are one source, the last in order; a text without
    words weighs nothing."""
    return balance.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and ids of every row; a null text has no ids."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True, limits=(60_000, 40_000))


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", near_duplicates), ("mix", mix), ("token_ids", token_ids)]

#: no stage but the base rules of the first can be said in SQL; tests hold near duplicates and token ids against brute
#: force, and the other stages against the verdicts of their operators, which have tests of their own
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, before = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        common.forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
