"""Registered queries over sources, state, scores and their sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import ORACLE, QUERIES, query, table
from .functions import scalar as C
from .functions import text as T
from .operators import ingest, qa, scores
from .sources import files

_ATTRIBUTED = """
c as (select conv_id, text, row_number() over (partition by conv_id order by turn, role, text) as cid from (select distinct conv_id, turn, role, text from conversations) as x),
s as (select conv_id, cid * 100000 + generate_subscripts(p, 1) - 1 as sid, unnest(p) as text from (select conv_id, cid,
  list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as p from c) as y),
ct as (select conv_id, cid, w, count(*) as tf from (select conv_id, cid, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as w from c) as x where w <> '' group by conv_id, cid, w),
st as (select conv_id, sid, w, count(*) as tf from (select conv_id, sid, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) as w from s) as x where w <> '' group by conv_id, sid, w),
idf as (select w, ln((1.0 + (select count(*) from c)) / (1.0 + count(*))) + 1.0 as idf from ct group by w),
cw as (select conv_id, cid, ct.w, tf * idf as x from ct join idf on idf.w = ct.w), sw as (select conv_id, sid, st.w, tf * idf as x from st join idf on idf.w = st.w),
cn as (select conv_id, cid, sqrt(sum(x * x)) as m from cw group by conv_id, cid), sn as (select conv_id, sid, sqrt(sum(x * x)) as m from sw group by conv_id, sid),
near as (select d.conv_id, d.sid, d.cid, dot / (sn.m * cn.m) as cosine from (select sw.conv_id, sid, cid, sum(sw.x * cw.x) as dot from sw join cw on cw.conv_id = sw.conv_id and cw.w = sw.w group by sw.conv_id, sid, cid) as d
  join sn on sn.conv_id = d.conv_id and sn.sid = d.sid join cn on cn.conv_id = d.conv_id and cn.cid = d.cid),
best as (select conv_id, sid, max(cosine) as cosine from near group by conv_id, sid),
a as (select s.conv_id, s.sid, round(coalesce(cosine, 0.0), 6) as cosine, case when cosine >= 0.35 then 'PRIMARY' when cosine >= 0.15 then 'SUPPORTING' else 'UNSUPPORTED' end as support from s left join best b on b.conv_id = s.conv_id and b.sid = s.sid)
"""


def _attributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each turn against all turns of the conversation as source chunks. Repeated turns are chunks of their own, equal
    rows are one."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    chunks = c.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("bigint").alias("cid"), "text")
    s = chunks.select("conv_id", "cid", F.posexplode(T.sentences("text")).alias("i", "text")).select("conv_id", (F.col("cid") * 100000 + F.col("i")).alias("sid"), "text")
    return scores.attribute(s, chunks, "conv_id")


@query(f"with {_ATTRIBUTED} select conv_id, sid, cosine, support from a")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(spark, sf_dir).select("conv_id", "sid", F.round("cosine", 6).alias("cosine"), "support")


@query(f"""with {_ATTRIBUTED} select round(100 * avg(p), 6) as primary_pct, round(100 * avg(q), 6) as supported_pct from (
  select conv_id, avg(case when support = 'PRIMARY' then 1.0 else 0.0 end) as p, avg(case when support <> 'UNSUPPORTED' then 1.0 else 0.0 end) as q from a group by conv_id) as x""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.coverage(_attributed(spark, sf_dir), "conv_id").select(F.round("primary_pct", 6).alias("primary_pct"), F.round("supported_pct", 6).alias("supported_pct"))


@query("""
with l as (select doc_id, text, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e]') as x from documents)
select doc_id, cast(case when text = '' then 0 when x[len(x)] = '' then len(x) - 1 else len(x) end as int) as n, case when text = '' then null when x[len(x)] <> '' then x[len(x)] else x[len(x) - 1] end as last from l""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.lines("text")).alias("n"), T.last_line("text").alias("last"))


@query("""
select o_orderkey as k, cast(cast(o_orderdate as date) as varchar) as day, left(cast(o_orderdate as varchar), 10) as prefix, cast(cast(o_orderdate as date) as varchar) as token, case when o_orderkey % 4 = 0 then null else cast(cast(o_orderdate as date) as varchar) end as strict from orders""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("t"))
    strict = C.timestamp_strict(F.when(F.col("k") % 4 != 0, F.col("t")))
    return o.select("k", F.to_date("t").cast("string").alias("day"), C.date_prefix("t").alias("prefix"), C.first_token("t").alias("token"), strict.cast("date").cast("string").alias("strict"))


@query("""
select event_id, greatest(0.0, least(1.5 * power(2.0, event_id % 8) + (event_id % 10) * 0.1, 60.0)) as pause from events""")
def retry_pauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.backoff_seconds(F.col("event_id") % 8, 1.5, 60.0, (F.col("event_id") % 10) * 0.1).alias("pause"))


@query("""
select l_orderkey, l_linenumber, round_even(l_extendedprice / 7, 4) as a, round_even(l_discount / 3, 4) as b from (select l_orderkey, l_linenumber, sum(l_extendedprice) as l_extendedprice, sum(l_discount) as l_discount from lineitem group by 1, 2) as l""")
def rounded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.sum("l_extendedprice") / 7).alias("a"), (F.sum("l_discount") / 3).alias("b"))  # noqa: E741
    return scores.rounded(l)


@query("""
select avg(l_quantity) as l_quantity, avg(l_discount) as l_discount, avg(l_linenumber) as l_linenumber from lineitem""")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.numeric_means(table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_linenumber", "l_shipdate", "l_returnflag"))


@query("""
select doc_id from documents where doc_id % 4 <> 0 and doc_id % 5 <> 0 and doc_id % 3 = 0 order by doc_id""")
def pending_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text is somewhere and was not fetched yet, in the order in which they are fetched."""
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4 != 0).alias("has_text"), F.when(F.col("doc_id") % 5 != 0, "http://text").alias("text_url"), F.when(F.col("doc_id") % 3 != 0, "text").alias("text"))
    return ingest.to_hydrate(d).select("doc_id").orderBy("doc_id")


@query("""
select o_orderkey as id, row_number() over (order by case when o_orderkey % 50 = 0 then 0 else 1 end, case when o_orderkey % 50 = 0 then null else o_orderdate end, o_orderkey) as n from orders
qualify n <= 500""")
def oldest_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cases that a run with a limit takes: those without a time, then the longest unchecked."""
    from pyspark.sql import Window

    t = F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderdate").cast("timestamp"))
    some = ingest.oldest(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), t.alias("updated_at_remote")), 500)
    return some.select("id", F.row_number().over(Window.orderBy(F.asc_nulls_first("updated_at_remote"), "id")).cast("bigint").alias("n"))  # 500 rows


@query("""
select avg(case when q > 0 then q end) as mean_score, cast(sum(n) as bigint) as ungrounded from (select cast(l_quantity % 6 as double) as q, case when l_orderkey % 5 = 0 then 0 else l_linenumber % 3 end as n from lineitem) as x""")
def judge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score and sentences without a source, over records with a list of whether each sentence has one."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    grounded = F.when(F.col("l_orderkey") % 5 != 0, F.concat(F.array_repeat(F.lit(False), (F.col("l_linenumber") % 3).cast("int")), F.array(F.lit(True))))
    return scores.judged(l.select((F.col("l_quantity") % 6).cast("double").alias("overall"), grounded.alias("grounded"))).select("mean_score", F.col("ungrounded").cast("bigint").alias("ungrounded"))


@query("""
with p as (select p_partkey as k, p_size / 100.0 as r, p_retailprice / 2500.0 - 0.6 as b, p_size % 6 as j from part)
select k, case when r < 0.25 then 'LOW_ROUGE,' else '' end || case when b < 0.0 then 'LOW_BERTSCORE,' else '' end || case when j <= 1 then 'JUDGE_REJECT' when j = 2 then 'JUDGE_WEAK' else '' end as codes from p""")
def qa_score_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that follow from given scores."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (F.col("p_size") / 100.0).alias("rougeLsum"), (F.col("p_retailprice") / 2500.0 - 0.6).alias("bertscore_f1"), (F.col("p_size") % 6).alias("judge_overall"))
    codes = lambda flags: F.array_join(F.transform(flags, lambda f: F.concat(f["code"], F.lit(","))), "")
    low, judge = qa.score_flags(F.col("rougeLsum"), F.col("bertscore_f1"), qa.Knobs()), qa.judge_flags(F.col("judge_overall").cast("double"))
    return p.select("k", F.concat(codes(low), F.array_join(F.transform(judge, lambda f: f["code"]), "")).alias("codes"))


@query("""
select 'c' || cast(c_custkey as varchar) as id, c_custkey % 7 <> 0 and c_custkey % 11 <> 0 as taken from customer""")
def case_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cases of which some have a time, or a document with a date, that is none: these alone fail."""
    js = F.expr("""concat('{"id": "c', c_custkey, '", "name": "n", "updated_at": "', if(c_custkey % 7 = 0, 'never', '2024-01-02T03:04:05'), '", "dockets": [{"id": "d", "documents": [{"id": "x", "title": "t"},
      {"id": "y", "title": "t", "filed_date": "', if(c_custkey % 11 = 0, '31/31/99', '2020-02-03'), '"}]}]}')""")
    good, failed = ingest.checked(table(spark, sf_dir, "customer").select(F.parse_json(js).alias("raw")))
    cs, _, _ = ingest.flatten(good)
    return cs.select("id", F.lit(True).alias("taken")).unionByName(failed.select("id", F.lit(False).alias("taken")))


@query("""
select k, replace(to_json({'k': k, 'name': name, 'note': note}), '</', '<\\/') as js from (select p_partkey as k, 'part ' || cast(p_partkey as varchar) || '</script>' as name, case when p_partkey % 2 = 0 then 'even' else 'odd' end as note from part) as p""")
def embedded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON that can stand in a script element of a review page."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("part "), F.col("p_partkey").cast("string"), F.lit("</script>")).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("note"))
    return p.select("k", files.embedded(p, "k", "name", "note").alias("js"))


@query("""
select cast(to_json({'case_id': source, 'id': cast(doc_id as varchar), 'lang': lang, 'note': null}) as varchar) as json from documents where source = 'src2' and doc_id = (select max(doc_id) from documents where source = 'src2')""")
def document_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("id"), "lang", F.lit(None).cast("string").alias("note"), "doc_id")
    last = d.where("case_id = 'src2'").agg(F.max("doc_id").cast("string")).first()[0]
    return ingest.document_json(d.drop("doc_id"), "src2", last or "")


@query("""
select o_orderkey as k, 'Task.' || chr(10) || 'Order ' || cast(o_orderkey as varchar) as prompt, case when o_orderkey % 2 = 0 then 'own' else null end as completion from orders""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split records as training wants them, with a response for a completion."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    rows = o.select("k", F.concat(F.lit("Task.\nOrder "), F.col("k").cast("string")).alias("prompt"), F.when(F.col("k") % 2 == 0, "own").alias("response"))
    return files.with_completion(rows).select("k", "prompt", "completion")


__all__ = ["ORACLE", "QUERIES"]
