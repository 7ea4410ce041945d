"""One query for each training-data operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, balance, bpe, common, curves, kd_shards, ngram_join, periodic, quality_mcd, style_tree, suffix_tree, token_counts, toxicity, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"), learn=lambda c: common.id_remainder(c, 5) != 0)
    out = toxicity.score(docs, chain, spans=True)
    return out.select("doc_id", (common.id_remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", F.col("spans"))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(_table(spark, sf_dir, "documents"), common.id_remainder("doc_id", 7) == 2)


#: id after the vocabulary's last, free for the end of a document
SEPARATOR = 50256


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_counts.document_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SEPARATOR).select("doc_id", "n_tokens")


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc_fixity.audit(pages, warc_fixity.damaged(pages))


def op6_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.quality(_table(spark, sf_dir, "documents"))


def op9_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = balance.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op10_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_tree.extract(_table(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect(_table(spark, sf_dir, "documents"))


def op12_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards.shard(_table(spark, sf_dir, "documents"), 8)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity_crf": op2_toxicity_crf,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_token_counts": op4_token_counts,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_hilbert_search": op6_hilbert_search,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_quality_mcd": op8_quality_mcd,
    "op9_entropy_balance": op9_entropy_balance,
    "op10_style_tree": op10_style_tree,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_kd_shards": op12_kd_shards,
    "op13_token_alignment": op13_token_alignment,
}

#: bytes of a record besides id, url, length and html
_FRAME = len("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Target-URI: \r\nContent-Type: text/html\r\nContent-Length: \r\n\r\n\r\n\r\n")


def _offsets(name: str, source: str) -> str:
    size = f"{_FRAME} + strlen(cast(page_id as varchar)) + strlen(url) + strlen(cast(strlen(html) as varchar)) + strlen(html)"
    return f"""{name} as (select page_id, html, cast(coalesce(sum(size) over (partition by page_id // 4096 order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as s,
  cast(sum(size) over (partition by page_id // 4096 order by page_id) as bigint) as e from (select page_id, html, {size} as size from {source}))"""


ORACLE: dict[str, str] = {
    "op5_warc_fixity": f"""
with a0 as (select page_id, coalesce(url, '') as url, coalesce(html, '') as html from pages where page_id is not null),
b0 as (select page_id, url, case when page_id % 1013 = 11 then '~' || substr(html, 2) when page_id % 1019 = 13 then substr(html, 1, 100) else html end as html
  from a0 where page_id % 1009 <> 7),
{_offsets("a", "a0")},
{_offsets("b", "b0")}
select a.page_id, a.page_id // 4096 as file, case when b.page_id is null then 'missing' else 'changed' end as kind,
  a.s as left_start, a.e as left_end, b.s as right_start, b.e as right_end
from a left join b on a.page_id = b.page_id where b.page_id is null or a.html <> b.html
""",
}
