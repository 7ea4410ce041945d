"""Registered queries over documents read in ranges, and over what commits leave in a warehouse; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import LINES_SQL, query, table
from .catalog_prompts import _CHUNKS as CHUNKS_SQL
from .catalog_prompts import _DOCS as DOCS_SQL
from .catalog_prompts import _chunked as chunked
from .catalog_prompts import _prepared as prepared
from .operators import bertscore, hydrate, ingest, models, parse, prompts
from .operators.parse import MARK
from .operators.prompts import STRUCTURED_TASK, TASK
from .settings import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cases in JSON, with an odd note, one docket, and an order's document for each order; 500 of them a document."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    docs = o.select("o_custkey", F.struct(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_orderpriority").alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed_date")).alias("d"))
    docs = docs.groupBy("o_custkey").agg(F.array_sort(F.collect_list("d")).alias("documents"))  # of one customer
    rows = c.join(docs, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        F.col("c_custkey").alias("k"), F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat("c_name", F.lit(' }"{[\\ "cases": [')).alias("name"), F.col("c_mktsegment").alias("state"),
        F.array(F.struct(F.concat(F.lit("d"), "c_custkey").alias("id"), F.coalesce("documents", F.array()).alias("documents"))).alias("dockets"),
    )
    part = F.floor(F.col("k") / 500)
    one = rows.groupBy(part.alias("p")).agg(F.array_sort(F.collect_list(F.struct("id", "name", "state", "dockets"))).alias("cases"))
    return one.select(F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("id"))).alias("others"), "cases")).alias("value"))


_NAME = """c_name || ' }"{[\\ "cases": ['"""


@query(f"""
select 'c' || cast(c_custkey as varchar) as id, {_NAME} as name, c_mktsegment as state, count(o_orderkey) as documents, min('o' || cast(o_orderkey as varchar)) as least, max(o_orderpriority) as title
from customer left join orders on o_custkey = c_custkey group by all""")
def split_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON documents written as files and read again in byte ranges, flattened."""
    folder = _folder(spark, "cases")
    _cases(spark, sf_dir).write.text(folder)
    cases, _, documents = ingest.flatten(ingest.read_cases(spark, folder))
    per = documents.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("title").alias("title"))
    return cases.join(per, F.col("id") == F.col("case_id"), "left").select("id", "name", "state", F.coalesce("n", F.lit(0)).alias("documents"), "least", "title")


@query("""
with c as (select c_custkey, c_custkey % 100 = 3 as again from customer)
select 'c' || cast(c_custkey as varchar) as id, case when again then 'changed' else c_name end as name, case when again then 2 else 1 end as version,
  case when again then 2 else 1 end as payloads, 1 as dockets from c join customer using (c_custkey)
union all select 'n' || cast(c_custkey as varchar), 'changed', 2, 1, 1 from c where again""")
def two_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warehouse after two runs: all customers as cases, then one in a hundred changed and as many new ones. The second rewrites the
    buckets of its ids only. Of rows that repeat an id the last in the document counts."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")

    def raw(rows: DataFrame, prefix: str, name: str, version: int) -> DataFrame:
        js = F.expr(f"""concat('{{"id": "{prefix}', c_custkey, '", "name": "', {name}, '", "metadata": {{"version": {version}}}, "dockets": [{{"id": "{prefix}d', c_custkey, '", "documents": []}}]}}')""")
        return rows.select(js.alias("element"), F.col("c_custkey").alias("number"))

    def taken(wh: ingest.Warehouse, found: DataFrame) -> None:
        good, bad = ingest.parsed(found.select("element", F.struct(F.lit("f").alias("file"), F.lit(0).alias("block"), "number").alias("at")))
        ingest.run(wh, *ingest.flatten(good), source="test", checkpoint_key="k", failed=bad)

    wh = ingest.Warehouse(spark, _folder(spark, "two-runs"))
    taken(wh, raw(c, "c", "c_name", 1))
    again = c.where("c_custkey % 100 = 3")
    stale = raw(again, "c", "'stale'", 2).withColumn("number", -F.col("number"))
    taken(wh, stale.unionByName(raw(again, "c", "'changed'", 2)).unionByName(raw(again, "n", "'changed'", 2)))
    payloads = wh.read("raw_api_payloads").where("resource_type = 'case'").groupBy(F.col("resource_id").alias("id")).agg(F.count(F.lit(1)).alias("payloads"))
    dockets = wh.read("dockets").groupBy(F.col("case_id").alias("id")).agg(F.count(F.lit(1)).alias("dockets"))
    version = F.get_json_object("metadata_json", "$.version").cast("int").alias("version")
    return wh.read("cases").select("id", "name", version).join(payloads, "id").join(dockets, "id").select("id", "name", "version", "payloads", "dockets")




@query("""
select doc_id, case when doc_id % 3 <> 0 then lang when doc_id % 2 = 0 or doc_id % 21 = 0 then '[[NO_TEXT_RETURNED]]' else 'got ' || source || '/' || cast(doc_id as varchar) end as text,
  doc_id % 21 = 0 as failed from documents""")
def drained_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document waits in the queue for its text; the fetch gives nothing for even ids and fails for some."""
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("has_text"), F.concat_ws("/", "source", "doc_id").alias("text_url"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("text")
    )

    def reader():
        def fetch(url: str) -> str | None:
            number = int(url.rsplit("/", 1)[1])
            if number % 21 == 0:
                raise ValueError("gone")
            return None if number % 2 == 0 else f"got {url}"

        return fetch

    wh = ingest.Warehouse(spark, _folder(spark, "texts"))
    have = set(d.columns)
    wh.replace("documents", d.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wh.schema("documents")]))
    hydrate.drain(wh, hydrate.Queue(batch=50_000, lanes=8), reader=reader)
    failed = wh.read("rejects").select("id", F.lit(True).alias("failed"))
    return wh.read("documents").join(failed, "id", "left").select(F.col("id").cast("bigint").alias("doc_id"), "text", F.coalesce("failed", F.lit(False)).alias("failed"))


@query("""
with t as (select vec_id // 10 as k, vec_id % 10 < 6 as g, vec_id, 't' || cast(vec_id % 7 as varchar) as w, embedding::double[] as v from embeddings),
refs as (select k, w from t where not g), n as (select count(distinct k) as n from t),
idf as (select w, ln((n + 1) / (count(distinct k) + 1)) as idf from refs, n group by w, n),
x as (select t.*, coalesce(idf, ln(n + 1)) as wt from t left join idf using (w), n),
m as (select a.k, a.vec_id as a, b.vec_id as b, a.wt as wa, b.wt as wb, list_cosine_similarity(a.v, b.v) as c from x a join x b on a.k = b.k and a.g and not b.g),
p as (select k, sum(c * wa) / sum(wa) as p from (select k, a, wa, max(c) as c from m group by all) group by k), r as (select k, sum(c * wb) / sum(wb) as r from (select k, b, wb, max(c) as c from m group by all) group by k)
select k as pair, round(p, 9) as bertscore_p, round(r, 9) as bertscore_r, round(2 * p * r / (p + r), 9) as bertscore_f1 from p join r using (k)""")
def bert_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors stand for tokens: of ten in a row, six are a generated text and four its reference."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("pair"), F.struct((F.col("vec_id") % 10).alias("at"), F.concat(F.lit("t"), F.col("vec_id") % 7).alias("t"), F.col("embedding").alias("v")).alias("x"))
    both = e.groupBy("pair").agg(*[F.array_sort(F.collect_list(F.when(c, F.col("x")))).alias(s) for s, c in (("g", F.col("x.at") < 6), ("r", F.col("x.at") >= 6))])  # ten rows
    pairs = both.select("pair", *[F.col(c).alias(name) for c, name in (("g.v", "generated"), ("r.v", "reference"), ("g.t", "generated_tokens"), ("r.t", "reference_tokens"))])
    n = pairs.count()
    idf = bertscore.document_frequencies(pairs, "reference_tokens")
    out = bertscore.bert_scores(bertscore.weighed(pairs, "pair", idf, F.lit(n)), "pair")
    return out.where("bertscore_f1 is not null").select("pair", *[F.round(c, 9).alias(c) for c in bertscore.SCORES])


@query("""
select doc_id, case when doc_id % 50 = 7 then 'ERROR: cannot read this' else lang || ' ' || source end as generated, doc_id % 100 <> 7 as good from documents""")
def bisected_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that fails as a whole wherever a batch holds a prompt that it cannot read; half of these it can read at a second run."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "lang", "source", "doc_id").alias("prompt"))

    def model(prompts, second=False):
        ids = [int(p.rsplit(" ", 1)[1]) for p in prompts]
        if any(i % (100 if second else 50) == 7 for i in ids):
            raise ValueError("cannot read this")
        return [p.rsplit(" ", 1)[0] for p in prompts]

    folder = _folder(spark, "replies")
    once = models.generate_into(folder, d, "doc_id", slices=2, model=model).select("doc_id", "generated")
    once.write.parquet(f"{folder}-first")  # the folder gets more below
    again = models.generate_into(folder, d, "doc_id", slices=2, model=lambda ps: model(ps, True))
    good = models.without_errors(again).select("doc_id", F.lit(True).alias("good"))
    return spark.read.schema(once.schema).parquet(f"{folder}-first").join(good, "doc_id", "left").select("doc_id", "generated", F.coalesce("good", F.lit(False)).alias("good"))


def _text(words: str) -> str:
    """A fixed wording as an SQL string."""
    return "'" + words.replace("'", "''") + "'"


_PROMPT_TEXTS = f"""
part as (select t.s, t.k, c.i, t.n, '20' || lpad(cast(l.p % 25 as varchar), 2, '0') || '-01-' || lpad(cast(l.p % 28 + 1 as varchar), 2, '0') as date, t.title, t.kind, t.tier,
    case when chars = -1 then repeat('The court granted it. Now x', l.tokens) else left(repeat('The court granted it. Now x', l.tokens), chars) || {_text(MARK)} end as body
  from taken t join choice c on c.s = t.s and c.k = t.k and c.n = t.n join {LINES_SQL} as l on l.k = t.k and l.n = t.n where chars <> -2),
shown as (select s, k, string_agg(case s when 'priority_filter' then chr(10) || '[DOCUMENT]' || chr(10) || 'Title: ' || title || case when kind = '' then '' else chr(10) || 'Type: ' || kind end || chr(10) || 'Date: ' || date || chr(10) || chr(10) || body
  else '#### [' || case tier when 1 then 'PRIMARY' when 2 then 'SUPPORTING' else 'CONTEXTUAL' end || '] ' || title || ', ' || date || chr(10) || body || chr(10) end, chr(10) order by i) as docs from part group by s, k),
times as (select k, string_agg('- ' || date || ': ' || title, chr(10) order by i) as times from (select *, row_number() over (partition by k order by tier, date, n) as i from docs where tier < 4) as x where i <= 15 group by k),
texts as (
  select p.k as id, 'priority_filter' as strategy, {_text(TASK)} || chr(10) || chr(10) || 'Case: Order ' || cast(p.k as varchar) || chr(10) || coalesce(chr(10) || s.docs, '') as x from per p left join shown s on s.k = p.k and s.s = 'priority_filter'
  union all select p.k, 'structured', '## Case: Order ' || cast(p.k as varchar) || chr(10) || coalesce(chr(10) || '### Case Timeline' || chr(10) || t.times || chr(10), '') || chr(10) || '### Key Documents (ordered by importance)' || chr(10)
    || coalesce(chr(10) || s.docs, '') || chr(10) || {_text(STRUCTURED_TASK)} from per p left join shown s on s.k = p.k and s.s = 'structured' left join times t on t.k = p.k)"""


@query(f"with recursive {DOCS_SQL}, {_PROMPT_TEXTS} select id, strategy, md5(x) as digest, length(x) as n_chars from texts")
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompts of two strategies, to the last character."""
    made = prepared(spark, sf_dir, "strategy", "prompt", timeline=prompts.TIMELINE, strategies=("priority_filter", "structured"))
    return made.select("id", "strategy", F.md5(F.col("prompt").cast("binary")).alias("digest"), F.length("prompt").cast("bigint").alias("n_chars"))


@query(f"""with {CHUNKS_SQL}, shown as (select k, n, tier, kind, left(rtrim(repeat('some text ', tokens * 10)), cast(least(room, 2800) as int)) as text from placed where room > 300)
select k, md5(coalesce(string_agg('[CHUNK ' || cast(n as varchar) || ' — ' || case when kind = '' then 'Date: 2010-01-02 10:00' else kind end || ' · 2010-01-02]' || chr(10) || text, chr(10) || chr(10) order by tier, n),
  '(No source documents provided — scoring factual grounding as N/A.)')) as digest from (select distinct k from chunks) as d left join shown using (k) group by k""")
def sources_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge's blocks of sources, to the last character."""
    return chunked(spark, sf_dir).select("k", F.md5(parse.sources_block("chunks").cast("binary")).alias("digest"))
