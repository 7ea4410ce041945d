"""The registered queries of the library proper, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as C
from .functions import text as T
from .operators import classify, ingest, parse, prompts, qa, scores
from .plans import templates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Narrow rows before costly work on each: where a scan has fewer splits than the cluster has cores (a small file is one split),
    they are dealt out anew. Larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, summary) of all orders."""
    return dealt(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))).select("k", F.expr(templates.SUMMARY).alias("summary"))


#: lines of orders in a fixed order: (k, n, p, title, kind, tokens)
LINES_SQL = f"""(select k, n, p, {templates.TITLE} as title, {templates.KIND} as kind, q as tokens from (
  select l_orderkey as k, l_partkey as p, cast(l_quantity as int) as q,
    cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) as int) as n from lineitem) as x)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("int").alias("tokens"))
    return rows.select("k", "n", "p", F.expr(templates.TITLE).alias("title"), F.expr(templates.KIND).alias("kind"), "tokens")


def lines_by_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, d): an order's lines as an array in their order. Texts are made of them afterwards, so that only narrow rows are sorted."""
    return lines(spark, sf_dir).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("n", "p", "title", "kind", "tokens"))).alias("d"))


def made_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, prompt): an order's lines as the documents of a prompt, each with a body of 27 characters a token."""
    doc = lambda d: F.concat(
        F.lit("\n[DOCUMENT]\nTitle: "), d["title"], F.lit("\nType: "), d["kind"], F.lit("\nDate: 20"), F.lpad((d["p"] % 25).cast("string"), 2, "0"), F.lit("-01-"), F.lpad((d["p"] % 28 + 1).cast("string"), 2, "0"),
        F.lit("\n\n"), F.repeat(F.lit("The court granted it. Now x"), d["tokens"]),
    )
    return lines_by_order(spark, sf_dir).select("k", F.concat(F.lit("Task.\nCase: Order "), F.col("k").cast("string"), F.lit("\n"), F.array_join(F.transform("d", doc), "")).alias("prompt"))


# Text functions


@query("""
select doc_id, cast(length(text) // 4 as int) as tokens, cast(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) as int) as n_words,
  cast(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) as int) as n_sentences,
  cast(len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13))), lambda s: s <> '')) as int) as n_paragraphs,
  substr(text, 1, 20) as head, right(text, 20) as tail, substr(sha256('t|' || substr(text, 1, 2000)), 1, 16) as key
from documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", T.tokens_estimate(x).alias("tokens"), T.n_words(x).alias("n_words"), F.size(T.sentences(x)).alias("n_sentences"), F.size(T.paragraphs(x)).alias("n_paragraphs"),
        T.head(x, 20).alias("head"), T.tail(x, 20).alias("tail"), C.key16(F.lit("t"), x).alias("key"),
    )


@query("""
select k, case when length(summary) <= 60 then summary else substr(summary, 1, 30) || chr(10) || chr(10) || '[... ' || cast(length(summary) - 60 as varchar) || ' characters elided to fit context window ...]' || chr(10) || chr(10) || right(summary, 30) end as short
from """ + templates.orders() + " as s")
def elided_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases(spark, sf_dir).select("k", T.elide("summary", 60).alias("short"))


@query("""
select k, coalesce(trim(regexp_replace(trim(t), '^(?i:token)\\s+', '')), '') as token from (
  select k, case k % 4 when 0 then '  Token abc' || cast(k as varchar) || ' ' when 1 then 'token  xyz' when 2 then '' else 'plain' end as t from (select o_orderkey as k from orders) as o) as x""")
def api_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.expr("case k % 4 when 0 then '  Token abc' || cast(k as string) || ' ' when 1 then 'token  xyz' when 2 then '' else 'plain' end")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).select("k", C.bare_token(t).alias("token"))


@query("""
select event_id, cast(try_cast(case when event_id % 5 = 0 then 'bogus' when event_id % 5 = 1 then '2024-02-0' || cast(1 + event_id % 9 as varchar) else '2024-03-05T10:11:1' || cast(event_id % 10 as varchar) end as timestamp) as varchar) as t
from events""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.expr("case when event_id % 5 = 0 then 'bogus' when event_id % 5 = 1 then '2024-02-0' || cast(1 + event_id % 9 as string) else '2024-03-05T10:11:1' || cast(event_id % 10 as string) end")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(C.timestamp_or_null(s), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("""
select event_id, (user_id * 3.0 + event_id % 7 * 15.0 + 100 * 0.3 + 10 * 3.0 * 1.25) / 1e6 as cost from events""")
def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", C.usage_cost(F.lit("claude-sonnet-4-5"), F.col("user_id"), F.col("event_id") % 7, F.lit(100), F.lit(10)).alias("cost"))


@query("""
select event_id, cast(json_extract(props, '$.k') as int) as k from events""")
def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = F.expr("case event_id % 3 when 0 then '```json\n' || props || '\n```' when 1 then 'Scores: ' || props || ' end' else props end")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(C.judge_reply(wrapped), "$.k", "int").alias("k"))


@query("""
select event_id, sha256(props_c) as sha from (select event_id, '{"k":' || cast(json_extract(props, '$.k') as varchar) || '}' as props_c from events) as x""")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2(C.canonical_json("props").cast("binary"), 256).alias("sha"))


# Quality triage

_TRIAGE_FLAGS = """
w as (select doc_id, lang, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws, rtrim(text, ' ' || chr(9) || chr(10) || chr(13)) as ended from documents),
s as (select doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: length(x) > 40)) as s from w),
dup as (select distinct doc_id from (select doc_id, s, count(*) as c from s group by doc_id, s) as x where c >= 2),
g as (select doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: hash(ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4], ws[i + 5], ws[i + 6], ws[i + 7]))) as g from w where len(ws) >= 24),
loop as (select distinct doc_id from (select doc_id, g, count(*) as c from g group by doc_id, g) as x where c >= 3),
f as (select w.doc_id, lang, cast(len(ws) as int) as word_count,
  case when len(ws) < 30 then 'EXTREMELY_SHORT,' when len(ws) < 80 then 'TOO_SHORT,' when len(ws) > 2000 then 'TOO_LONG,' else '' end ||
  case when ended = '' then '' when position(right(ended, 1) in '.!?"'')]') = 0 then 'UNTERMINATED,' when ended like '%..' then 'ELLIPSIS_END,' else '' end ||
  case when dup.doc_id is not null then 'DUPLICATE_SENTENCE,' else '' end || case when loop.doc_id is not null then 'REPETITION_LOOP,' else '' end as codes
  from w left join dup on dup.doc_id = w.doc_id left join loop on loop.doc_id = w.doc_id),
t as (select *, case when codes like '%EXTREMELY_SHORT%' or codes like '%UNTERMINATED%' or codes like '%REPETITION_LOOP%' then 'REJECT' when codes <> '' then 'REVIEW' else 'PASS' end as status from f)
"""


def _triaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.quick_report(table(spark, sf_dir, "documents"), "text")


@query(f"with {_TRIAGE_FLAGS} select lang, status, count(*) as n, 100.0 * count(*) / sum(count(*)) over (partition by lang) as pct from t group by lang, status")
def qa_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.status_counts(_triaged(spark, sf_dir), "lang")


@query(f"with {_TRIAGE_FLAGS} select doc_id, word_count, rtrim(codes, ',') as codes, status from t")
def qa_triage_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triaged(spark, sf_dir).select("doc_id", "word_count", F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("codes"), "status")


def _re(pattern: str, mode: str = "") -> str:
    """A pattern as an SQL literal for an engine whose patterns lack Unicode classes; the texts here are ASCII."""
    return "'" + (f"(?{mode})" if mode else "") + pattern.replace("'", "''") + "'"


_STRIPPED = """regexp_replace(summary, '^(?:(?i:(?:united states district court|u\\.s\\. district court|district court|court of appeals|supreme court)\\b[^\\n]*|court\\s*:\\s*\\S[^\\n]*)\\n)+', '')"""
_COUNT = lambda pattern, mode="", group=0: f"len(regexp_extract_all(summary, {_re(pattern, mode)}, {group}))"
_CODES_SQL = f"""
r as (select k, summary, {_STRIPPED} as raw, list_filter(string_split_regex(summary, '\\s+'), lambda x: x <> '') as ws from {templates.orders()} as o),
sent as (select k, unnest(list_filter(string_split(regexp_replace(summary, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 40)) as s from r),
dup as (select distinct k from (select k, s, count(*) as c from sent group by k, s) as x where c >= 2),
gram as (select k, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) as g from r where len(ws) >= 24),
loop as (select distinct k from (select k, g, count(*) as c from gram group by k, g) as x where c >= 3),
c as (select r.k as k,
  case when len(ws) < 30 then 'EXTREMELY_SHORT,' when len(ws) < 80 then 'TOO_SHORT,' when len(ws) > 2000 then 'TOO_LONG,' else '' end ||
  case when position(right(rtrim(summary), 1) in '.!?"'')]') = 0 then 'UNTERMINATED,' when rtrim(summary) like '%..' then 'ELLIPSIS_END,' else '' end ||
  repeat('GARBLED_DATE,', cast(len(list_filter(regexp_extract_all(summary, '\\b[A-Za-z0-9]{{3,6}}\\b'), lambda t: regexp_matches(t, '[0-9][A-Za-z]|[A-Za-z][0-9]')
    and not regexp_matches(t, {_re(f"^(?:{qa.ORDINAL}|{qa.REPORTER})$", "i")}) and not regexp_matches(t, {_re(f"^(?:{qa.VERSION})$")}))) as bigint)) ||
  repeat('GARBLED_DATE,', cast({_COUNT(rf"\b{qa.YEAR_CUES}\s*,?\s*\b(\d{{5,}})\b", "i", 1)} as bigint)) ||
  repeat('GARBLED_DATE,', cast(len(list_filter(regexp_extract_all(summary, {_re(rf"(?:{qa.MONTHS}\s+\d{{1,2}},?\s*|\b{qa.DATE_CUES}\s+)(\d{{3}})\b", "i")}, 1), lambda t: regexp_matches(t, '^(?:19|20|21)'))) as bigint)) ||
  repeat('IMPLAUSIBLE_YEAR,', cast(len(list_filter(regexp_extract_all(summary, {_re(rf"\b{qa.YEAR_CUES}\s*,?\s*\b(\d{{4}})\b", "i")}, 1), lambda t: cast(t as int) < 1700 or cast(t as int) > 2027)) as bigint)) ||
  case when regexp_matches(raw, {_re(qa.CAPTION, "mi")}) then 'RAW_DOCUMENT_ARTIFACT,' else '' end || case when regexp_matches(raw, {_re(qa.NUMBERED_LINES, "m")}) then 'RAW_DOCUMENT_ARTIFACT,' else '' end ||
  case when regexp_matches(raw, {_re(qa.CAPS_RUN)}) then 'EXCESSIVE_CAPS,' else '' end ||
  case when dup.k is not null then 'DUPLICATE_SENTENCE,' else '' end || case when loop.k is not null then 'REPETITION_LOOP,' else '' end ||
  case when regexp_matches(summary, {_re(qa.META, "i")}) then 'META_PROMPT_LEAK,' else '' end || case when regexp_matches(summary, '\\bjudgement\\b') then 'WRONG_JUDGMENT_SPELLING,' else '' end ||
  case when {_COUNT(qa.PRESENT)} >= 3 and {_COUNT(qa.PRESENT)} > {_COUNT(qa.PAST)} then 'WRONG_TENSE,' else '' end ||
  case when regexp_matches(summary, '(?i)\\b\\w*(?:iiv|iin|jn|hn|kz|wv)\\w*\\b') then 'SUSPICIOUS_SPELLING,' else '' end ||
  {" || ".join(f"case when not regexp_matches(summary, {_re(pattern, 'i' if 'i' in mode else '')}) then '{code},' else '' end" for mode, pattern, _, code, _ in qa.ELEMENTS)} as codes
  from r left join dup on dup.k = r.k left join loop on loop.k = r.k)
"""
_CRITICAL = "EXTREMELY_SHORT|UNTERMINATED|GARBLED_DATE|RAW_DOCUMENT_ARTIFACT|REPETITION_LOOP|META_PROMPT_LEAK"
_WARNING = "TOO_SHORT|TOO_LONG|ELLIPSIS_END|IMPLAUSIBLE_YEAR|EXCESSIVE_CAPS|DUPLICATE_SENTENCE|WRONG_TENSE|SUSPICIOUS_SPELLING|MISSING_FILING_DATE|MISSING_COURT|MISSING_STATUTE"
_STATUS_SQL = f"case when regexp_matches(codes, '{_CRITICAL}') then 'REJECT' when regexp_matches(codes, '{_WARNING}') then 'REVIEW' else 'PASS' end"


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.report(cases(spark, sf_dir).withColumnRenamed("summary", "prediction"), reference=None, ids=("k",))


@query(f"with {_CODES_SQL} select k, rtrim(codes, ',') as codes, {_STATUS_SQL} as status from c")
def qa_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("k", F.array_join(F.transform("flags", lambda f: f["code"]), ",").alias("codes"), "status")


@query(f"""with {_CODES_SQL}, u as (select k, unnest(string_split(rtrim(codes, ','), ',')) as code from c where codes <> '')
select code, count(*) as flags, count(distinct k) as records from u group by code""")
def qa_code_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.code_counts(_reports(spark, sf_dir)).select("code", "flags", "records")


@query(f"with {_CODES_SQL} select {_STATUS_SQL} as status, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct from c group by 1")
def qa_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.status_counts(_reports(spark, sf_dir))


@query(f"""with {_CODES_SQL}, u as (select k, generate_subscripts(x, 1) as spot, unnest(x) as code from (select k, string_split(rtrim(codes, ','), ',') as x from c where codes <> '') as y),
v as (select k, code, row_number() over (partition by k order by case when regexp_matches(code, '^({_CRITICAL})$') then 0 when regexp_matches(code, '^({_WARNING})$') then 1 else 2 end, spot) as r from u)
select c.k, coalesce(string_agg(code, ' | ' order by r), '') as top from c left join v on v.k = c.k and r <= 3 group by c.k""")
def qa_top_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select("k", F.array_join(qa.top_codes("flags", 3), " | ").alias("top"))


@query("""
select doc_id, case when quality = 0 then 'JUDGE_REJECT' else '' end as codes from (
  select doc_id, case when quality = 0 then 1 else 4 end as judge_overall, quality from labels) as x""")
def qa_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("quality") == 0, 1).otherwise(4)
    return table(spark, sf_dir, "labels").select("doc_id", F.array_join(F.transform(qa.judge_flags(score.cast("double")), lambda f: f["code"]), ",").alias("codes"))


@query("""
select d.doc_id, case when r < 0.4 then 'LENGTH_TOO_SHORT_VS_REF' when r > 2.5 then 'LENGTH_TOO_LONG_VS_REF' else '' end as codes from (
  select d.doc_id, cast(len(list_filter(string_split_regex(d.text, '\\s+'), lambda x: x <> '')) as double) / len(list_filter(string_split_regex(b.text, '\\s+'), lambda x: x <> '')) as r
  from documents d join benchmark b on d.doc_id % 40 = b.item_id) as d""")
def qa_length_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    both = d.join(b, d.doc_id % 40 == b.item_id)
    return both.select("doc_id", F.array_join(F.transform(qa.reference_flags(T.n_words("text"), F.col("ref"), qa.Knobs()), lambda f: f["code"]), ",").alias("codes"))


@query()
def qa_full_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all documents with ROUGE against benchmark texts, dealt by id over all items, as the CSV sink has them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prediction"))
    b = table(spark, sf_dir, "benchmark").select(F.row_number().over(Window.orderBy("item_id")).alias("item"), F.col("text").alias("reference"))
    both = d.join(b, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(max(b.count(), 1))) + 1 == b.item, "left")
    scored = both.withColumn("r", scores.rouge_scores("reference", "prediction")).select("doc_id", "prediction", "reference", "r.*")
    return qa.csv_rows(qa.report(scored, ids=("doc_id",)))


# Classification and parsing

_TIER_SQL = f"""case when trim(lower(title || ' ' || kind)) = '' then 4 when regexp_matches(lower(title || ' ' || kind), {_re("|".join(classify.TIER_1))}) then 1
  when regexp_matches(lower(title || ' ' || kind), {_re("|".join(classify.TIER_4))}) then 4 when regexp_matches(lower(title || ' ' || kind), {_re("|".join(classify.TIER_2))}) then 2 else 3 end"""
_ROUTE_SQL = "case " + " ".join(f"when {' or '.join(f'contains(lower(title || chr(32) || kind), {_re(x)})' for x in v)} then '{k}'" for k, v in classify.ROUTES.items()) + " else 'default' end"


@query(f"""
select k, n, {_TIER_SQL} as tier, case {_TIER_SQL} when 1 then 'PRIMARY' when 2 then 'SUPPORTING' when 3 then 'CONTEXTUAL' else 'EXCLUDED' end as label,
  case when regexp_matches(kind, {_re(classify.CHUNK_TIER_1, "i")}) then 1 when regexp_matches(kind, {_re(classify.CHUNK_TIER_4, "i")}) then 4 else 2 end as chunk_tier, {_ROUTE_SQL} as route
from {LINES_SQL} as l""")
def document_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = classify.tier("title", "kind")
    return lines(spark, sf_dir).select("k", "n", t.alias("tier"), classify.tier_label(t).alias("label"), classify.chunk_tier("kind").alias("chunk_tier"), classify.route("title", "kind").alias("route"))


@query(f"""
select k, 'Order ' || cast(k as varchar) as case_name, cast(count(*) as int) as docs, cast(sum(case when t = 1 then 1 else 0 end) as int) as tier_1, cast(sum(case when t = 2 then 1 else 0 end) as int) as tier_2,
  cast(sum(case when t = 3 then 1 else 0 end) as int) as tier_3, cast(sum(case when t = 4 then 1 else 0 end) as int) as tier_4, cast(sum((27 * tokens) // 4) as int) as tokens
from (select k, tokens, {_TIER_SQL} as t from {LINES_SQL} as l) as x group by k""")
def parsed_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = made_prompts(spark, sf_dir).withColumns({"d": parse.documents("prompt"), "case_name": parse.case_name("prompt")})
    count = lambda t: F.size(F.filter("d", lambda x: x["tier"] == t)).alias(f"tier_{t}")
    return p.select("k", "case_name", F.size("d").alias("docs"), *[count(t) for t in (1, 2, 3, 4)], F.aggregate("d", F.lit(0), lambda a, x: a + x["tokens"]).alias("tokens"))


@query("""
select conv_id, turn, 'Summary for ' || role || ' (turn, ' || cast(turn as varchar) || ')' || chr(10) || case when len(s) = 0 then '- No text available for summarization yet.'
  else array_to_string(list_transform(s[1:2], lambda x: '- ' || x), chr(10)) end as summary
from (select conv_id, turn, role, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as s
  from (select distinct conv_id, turn, role, text from conversations) as c) as x""")
def heuristic_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").distinct()
    return c.select("conv_id", "turn", parse.heuristic_summary("role", "text", F.lit("turn"), F.col("turn").cast("string"), F.lit(None).cast("string"), 2).alias("summary"))


# Budgets

_PREFIX = "coalesce(sum(tokens) over (partition by k order by tier, n rows between unbounded preceding and 1 preceding), 0)"


@query(f"""
select k, cast(sum(case when before + tokens <= 60 then 1 else 0 end) as int) as whole, cast(sum(case when before <= 60 and before + tokens > 60 and 60 - before > 20 then 1 else 0 end) as int) as cut,
  cast(sum(case when before + tokens <= 60 then tokens else 0 end) as int) as used
from (select k, tokens, {_PREFIX} as before from (select *, {_TIER_SQL} as tier from {LINES_SQL} as l) as x) as y group by k""")
def budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("tier", classify.tier("title", "kind"))
    docs = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("tier", "n", "tokens"))).alias("d"))
    shown = docs.select("k", prompts.prefix(F.col("d"), F.lit(60), 20, lambda d: d["tokens"]).alias("s"))
    whole = F.filter("s", lambda x: x["chars"] == -1)
    used = F.aggregate(whole, F.lit(0), lambda a, x: a + x["n"])
    return shown.select("k", F.size(whole).alias("whole"), (F.size("s") - F.size(whole)).alias("cut"), used.cast("int").alias("used"))


@query(f"""
select k, n, cast(greatest(floor(50 * (cast(tokens as double) / sum(tokens) over (partition by k))), 5) as int) as share from {LINES_SQL} as l""")
def budget_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.sum("tokens").over(Window.partitionBy("k"))
    return lines(spark, sf_dir).select("k", "n", prompts.shares(F.col("tokens"), total, F.lit(50), 5).alias("share"))


@query(f"""
with recursive l as (select k, n, tokens, row_number() over (partition by k order by tier, n) as i, tier from (select *, {_TIER_SQL} as tier from {LINES_SQL} as l) as x where tier < 4),
f(k, i, used, taken, passed) as (
  select k, cast(0 as bigint), 0, 0, 0 from (select distinct k from l) as d
  union all
  select f.k, f.i + 1, case when f.used + l.tokens <= 60 then f.used + l.tokens when l.tier = 1 and f.used < 60 then 60 else f.used end,
    f.taken + case when f.used + l.tokens <= 60 or (l.tier = 1 and f.used < 60) then 1 else 0 end, f.passed + case when f.used + l.tokens <= 60 or (l.tier = 1 and f.used < 60) then 0 else 1 end
  from f join l on l.k = f.k and l.i = f.i + 1)
select k, arg_max(used, i) as used, arg_max(taken, i) as taken, arg_max(passed, i) as passed from f group by k""")
def budget_first_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("tier", classify.tier("title", "kind")).where("tier < 4")
    docs = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("tier", F.col("n").alias("pos"), "tokens"))).alias("d"))
    fit = docs.select("k", prompts.first_fit(F.col("d"), F.lit(60), True).alias("f"))
    return fit.select("k", "f.used", F.size("f.taken").alias("taken"), F.size("f.passed").alias("passed"))


# Scores


@query("""
select metric, avg(v) as mean, median(v) as median, coalesce(stddev_samp(v), 0) as std, min(v) as min, max(v) as max, count(v) as n from (
  select 'rouge1_f' as metric, l_discount as v from lineitem union all select 'rouge2_f', l_tax from lineitem union all select 'judge_overall', case when l_linenumber = 1 then null else l_quantity end from lineitem) as x
where v is not null group by metric""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("rouge1_f"), F.col("l_tax").alias("rouge2_f"), F.when(F.col("l_linenumber") != 1, F.col("l_quantity")).alias("judge_overall"))  # noqa: E741
    return scores.summarise(l)


@query("""
select m as metric, sum(case when a > b then 1 else 0 end) as left_wins, sum(case when a < b then 1 else 0 end) as right_wins, sum(case when a = b then 1 else 0 end) as ties from (
  select 'x' as m, cast(p.p_size as double) as a, cast(p.p_size % 25 * 2 as double) as b from part p union all select 'y', p.p_retailprice, cast(1000 as double) from part p) as z group by m""")
def paired_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    b = p.select("p_partkey", (F.col("p_size") % 25 * 2).alias("x"), F.lit(1000.0).alias("y"))
    return scores.paired(a, b, "p_partkey", ["x", "y"])


@query("""
with d as (select doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as p, doc_id % 40 as item_id from documents),
b as (select item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') as r from benchmark),
j as (select d.doc_id, p, r from d join b on b.item_id = d.item_id),
pc as (select doc_id, g, count(*) as c from (select doc_id, unnest(p) as g from j) as x group by doc_id, g), rc as (select doc_id, g, count(*) as c from (select doc_id, unnest(r) as g from j) as x group by doc_id, g),
o as (select pc.doc_id, sum(least(pc.c, rc.c)) as o from pc join rc on pc.doc_id = rc.doc_id and pc.g = rc.g group by pc.doc_id)
select j.doc_id, cast(coalesce(o, 0) as bigint) as overlap, len(p) as n_pred, len(r) as n_ref from j left join o on o.doc_id = j.doc_id""")
def rouge_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    return scores.rouge_n(d.join(b, d.doc_id % 40 == b.item_id), "doc_id", "text", "ref", 1).select("doc_id", "overlap", "n_pred", "n_ref")


@query("""
with s as (select doc_id, text, doc_id % 40 as item_id from documents),
w as (select doc_id, list_filter(string_split_regex(lower(s.text), '[^a-z0-9]+'), lambda x: x <> '') as p, list_filter(string_split_regex(lower(b.text), '[^a-z0-9]+'), lambda x: x <> '') as r from s join benchmark b on b.item_id = s.item_id),
pc as (select doc_id, g, count(*) as c from (select doc_id, unnest(list_transform(range(1, len(p)), lambda i: p[i] || ' ' || p[i + 1])) as g from w) as x group by doc_id, g),
rc as (select doc_id, g, count(*) as c from (select doc_id, unnest(list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1])) as g from w) as x group by doc_id, g),
o as (select pc.doc_id, sum(least(pc.c, rc.c)) as o from pc join rc on pc.doc_id = rc.doc_id and pc.g = rc.g group by pc.doc_id)
select w.doc_id, cast(coalesce(o, 0) as bigint) as overlap, greatest(len(p) - 1, 0) as n_pred, greatest(len(r) - 1, 0) as n_ref from w left join o on o.doc_id = w.doc_id""")
def rouge_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("ref"))
    return scores.rouge_n(d.join(b, d.doc_id % 40 == b.item_id), "doc_id", "text", "ref", 2).select("doc_id", "overlap", "n_pred", "n_ref")


@query()
def rouge_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return c.join(nxt, ["conv_id", "turn"]).withColumn("r", scores.rouge_scores("ref", "text")).select("conv_id", "turn", "r.*")


@query("""
select a.vec_id, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as cosine from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(nxt, "vec_id").select("vec_id", scores.cosine("embedding", "b").alias("cosine"))


@query("""
with recursive s as (select c_nationkey, c_custkey, c_acctbal, row_number() over (partition by c_nationkey order by c_custkey) as i from customer),
f as (select c_nationkey, c_custkey, i, c_acctbal as ema from s where i = 1 union all select s.c_nationkey, s.c_custkey, s.i, 0.1 * s.c_acctbal + 0.9 * f.ema from f join s on s.c_nationkey = f.c_nationkey and s.i = f.i + 1)
select c_nationkey, c_custkey, ema from f""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.smoothed(table(spark, sf_dir, "customer"), "c_acctbal", "c_custkey", 0.1, "c_nationkey")


@query("select p_partkey, p_retailprice, 100.0 * row_number() over (order by p_retailprice, p_partkey) / count(*) over () as cdf from part")
def empirical_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.distribution(table(spark, sf_dir, "part"), "p_retailprice", "p_partkey").select("p_partkey", "p_retailprice", "cdf")


@query("""
select b as bin, count(*) as n, 100.0 * count(*) / sum(count(*)) over () as pct from (
  select case when x >= 100000 then 6 when x >= 50000 then 5 when x >= 20000 then 4 when x >= 10000 then 3 when x >= 5000 then 2 when x >= 1000 then 1 else 0 end as b from (select length(text) / 4.0 * 4 as x from documents) as d) as y group by b""")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.length("text").alias("x"))
    return scores.histogram(d, "x", [0, 1000, 5000, 10000, 20000, 50000, 100000])


@query("""
select 5.0 * (i - 1) as pct, q[i] as value from (select quantile_cont(cast(length(text) as double) / 4, [0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1]) as q from documents) as x,
  (select unnest(range(1, 22)) as i) as r""")
def length_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.percentiles(table(spark, sf_dir, "documents").select((F.length("text") / 4.0).alias("x")), "x")


@query("""
select s_suppkey, i, s_acctbal + i * (10.0 / 4) as x from supplier, (select unnest(range(0, 5)) as i) as r""")
def spaced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_acctbal") + 10.0).alias("hi"), F.lit(5).alias("n"))
    return scores.spaced(s, "s_acctbal", "hi", "n").select("s_suppkey", "i", "x")


@query("select c_custkey, c_name from customer order by md5(cast(c_custkey as varchar) || '|42'), c_custkey limit 50")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.sample(table(spark, sf_dir, "customer"), "c_custkey", 50, 42).select("c_custkey", "c_name")


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by user_id")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.latest(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@query("""
select o_orderkey, 'old' as run from orders where o_orderkey % 3 = 0 union all select o_orderkey, 'new' from orders where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0""")
def resumed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return scores.resumed(o.where("o_orderkey % 3 = 0").withColumn("run", F.lit("old")), o.where("o_orderkey % 2 = 0").withColumn("run", F.lit("new")), "o_orderkey")


@query("""
select lang, cast(avg(length(text)) as double) as mean_chars, count(*) as n, sum(case when length(text) // 4 <= 500 then 1 else 0 end) as fit from documents group by lang""")
def fit_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.avg(F.length("text")).alias("mean_chars"), F.count(F.lit(1)).alias("n"), F.count_if(T.tokens_estimate("text") <= 500).alias("fit"))


# Ingestion over the test tables: customers stand for cases, orders for dockets, lines for documents, events for payloads

_NOW = "timestamp '2024-06-01 00:00:00'"


@query("""
select o_orderkey as id, case when o_orderkey % 4 = 0 then 'new' else o_orderstatus end as status, o_orderkey % 4 <> 0 or o_orderkey % 8 = 0 as kept from orders where o_orderkey % 4 <> 0
union all select o_orderkey, 'new', o_orderkey % 8 = 0 from orders where o_orderkey % 4 = 0""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth order is new or changed; rows that were there before keep the time they were made."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    was, now = F.expr("timestamp '2024-01-01 00:00:00'"), F.expr(_NOW)
    target = o.where("id % 4 <> 0 or id % 8 = 0").withColumns({"created_at": was, "updated_at": was})
    source = o.where("id % 4 = 0").withColumn("status", F.lit("new"))
    return ingest.upserted(target, source, now=now).select("id", "status", (F.col("created_at") == was).alias("kept"))


@query("""
select distinct 'event' as resource_type, cast(user_id as varchar) as resource_id, sha256('{"k":' || cast(json_extract(props, '$.k') as varchar) || '}') as payload_sha256 from events e
where not exists (select 1 from events o where o.event_id < 2000 and o.user_id = e.user_id and o.props = e.props)""")
def payload_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(F.lit("event").alias("resource_type"), F.col("user_id").cast("string").alias("resource_id"), F.lit(None).cast("string").alias("case_id"), F.lit(None).cast("string").alias("docket_id"), F.col("props").alias("metadata_json"), "event_id")
    empty = spark.createDataFrame([], "resource_type string, resource_id string, payload_sha256 string")
    old = ingest.archived(empty, rows.where("event_id < 2000").drop("event_id"), "r0", "test")
    return ingest.archived(old, rows.drop("event_id"), "r1", "test").select("resource_type", "resource_id", "payload_sha256")


@query("""
select 'k' as key, cast(arg_max(o_orderkey, (o_orderdate, cast(o_orderkey as varchar))) as varchar) as last_case_id, cast(max(o_orderdate) as varchar) as t from orders""")
def checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("updated_at_remote"))
    empty = spark.createDataFrame([], f"{ingest.CHECKPOINTS}, {ingest.STAMPS}")
    return ingest.advanced(empty, o, "k", "test", "r1").select("key", "last_case_id", F.date_format("last_case_last_checked", "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("""
select o_orderkey as id from orders where o_orderkey % 10 = 0 or o_orderdate > timestamp '1996-01-01 00:00:00'""")
def cases_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate").cast("timestamp"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), t.alias("updated_at_remote"))
    return ingest.updated_after(o, F.expr("timestamp '1996-01-01 00:00:00'")).select("id")


@query("""
select c_custkey as case_id, count(distinct o_orderkey) as dockets, count(l_orderkey) as documents from customer join orders on o_custkey = c_custkey left join lineitem on l_orderkey = o_orderkey group by c_custkey""")
def case_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), "o_orderkey")
    per = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("d"))
    return c.join(o, "case_id").join(per, "o_orderkey", "left").groupBy("case_id").agg(F.count(F.lit(1)).alias("dockets"), F.sum(F.coalesce("d", F.lit(0))).alias("documents"))


@query("""
select 'case-' || cast(c_custkey as varchar) as id, c_mktsegment as state, 'd-' || cast(c_custkey as varchar) as docket_id, case when c_custkey % 2 = 0 then 'own' else c_name end as court, c_custkey % 3 <> 0 as has_text from customer""")
def nested_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested JSON made of customers, flattened: what children take from their parents."""
    js = F.expr("""concat('{"id": "case-', c_custkey, '", "name": "n", "court": "', c_name, '", "jurisdiction": "', c_mktsegment, '", "dockets": [{"id": "d-', c_custkey, '"', if(c_custkey % 2 = 0, ', "court": "own"', ''),
      ', "documents": [{"id": "x", "title": "t"', if(c_custkey % 3 <> 0, ', "text": "some"', ''), '}]}]}')""")
    cs, ds, xs = ingest.flatten(table(spark, sf_dir, "customer").select(F.parse_json(js).alias("raw")))
    joined = cs.select("id", "state").join(ds.select(F.col("case_id").alias("id"), F.col("id").alias("docket_id")), "id").join(xs.select(F.col("case_id").alias("id"), "court", "has_text"), "id")
    return joined.select("id", "state", "docket_id", "court", "has_text")


@query("""
select doc_id, case when doc_id % 3 = 0 and doc_id % 2 = 0 then '[[NO_TEXT_RETURNED]]' when doc_id % 3 = 0 then 'got ' || source else lang end as text from documents""")
def hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document waits for its text; fetching gives nothing for even ids."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("has_text"), F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.col("source")).alias("text_url"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("text"))
    return ingest.hydrated(d, lambda url: F.when(url != "", F.concat(F.lit("got "), url)).otherwise("")).select("doc_id", "text")


@query("""
select event_type, date_trunc('hour', ts) as h, count(*) as n, sum(value) as total from events group by 1, 2""")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .streaming.ingest import windowed_counts

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(e.dropDuplicates(["event_id"]), streaming=False).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("h"), "n", "total")


@query("select doc_id, text from documents where source = 'src1' and doc_id = (select min(doc_id) from documents where source = 'src1')")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), F.col("doc_id").cast("string").alias("id"), "doc_id", "text")
    first = d.where("case_id = 'src1'").agg(F.min("doc_id").cast("string")).first()[0]
    return ingest.get_document(d, "src1", first or "").select("doc_id", "text")


@query("""
select count(*) as n, sum(case when event_type <> 'error' then 1 else 0 end) as done, sum(case when event_id % 7 = 0 then 1 else 0 end) as truncated, sum(value) as cost,
  cast(2 * sum(case when event_type <> 'error' then 1 else 0 end) as double) / sum(case when event_type <> 'error' then 1 else 0 end) as mean_words from events""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    words = F.when(F.col("event_type") != "error", F.concat(F.lit("type "), "event_type"))
    return scores.spending(e.select(words.alias("prediction"), (F.col("event_id") % 7 == 0).alias("truncated"), F.col("value").alias("cost")))


@query("""
select cast(floor(sum(least(length(text), 3000)) / 4) as bigint) as tokens_in, 50000 as tokens_out, floor(sum(least(length(text), 3000)) / 4) * 3.0 / 1e6 + 50000 * 15.0 / 1e6 as cost from documents""")
def cost_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.cost_estimate(table(spark, sf_dir, "documents"), "text", 3.0, 15.0, limit=3000)


@query("""
select a.conv_id, a.turn as s, a.turn + 1 as index, b.role as type from conversations a left join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1""")
def cited_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    cites = c.select("conv_id", F.col("turn").alias("s"), F.col("text").alias("sentence"), F.array(F.col("turn") + 1).alias("chunks"), F.lit(True).alias("grounded"))
    chunks = c.select("conv_id", F.col("turn").alias("index"), F.col("role").alias("type"), F.col("text").alias("chunk"))
    return scores.cited(cites, chunks, "conv_id").select("conv_id", "s", "index", "type")


@query(f"with {_CODES_SQL} select k from c where codes like '%META_PROMPT_LEAK%'")
def qa_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.search(_reports(spark, sf_dir), "meta_prompt").select("k")
