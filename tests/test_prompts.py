from pyspark.sql import functions as F

from millrace.functions.text import tokens_estimate
from millrace.operators import classify, parse, prompts

PROMPT = """Intro
Case: Doe v. Roe
[DOCUMENT]
Title: [Opinion]
Type: Order/Opinion
Date: 2011-02-03 10:00

Chunk 2:
First body.
[DOCUMENT]
Title: Docket (PACER)
Type:
Date: 2010-01-01
Docket body.
[DOCUMENT]
Title: Complaint
Not a header.
[DOCUMENT]
Title: Only headers
Type: none"""


def frame(spark, prompt=PROMPT):
    return spark.createDataFrame([("1", "c", prompt, "A response.")], "id string, case_id string, prompt string, response string")


def test_documents(spark):
    r = frame(spark).select(parse.documents("prompt").alias("d"), parse.case_name("prompt").alias("c"), parse.preamble("prompt").alias("p")).first()
    assert r["c"] == "Doe v. Roe" and r["p"] == "Intro\nCase: Doe v. Roe"
    got = [(d["title"], d["doc_type"], d["date"], d["tier"], d["body"]) for d in r["d"]]
    assert got[0] == ("Opinion", "Order/Opinion", "2011-02-03 10:00", 1, "First body.")
    assert got[1] == ("Docket (PACER)", "", "2010-01-01", 4, "Docket body.")
    assert got[2] == ("Complaint", "", "", 2, "Not a header.")
    assert got[3][4] == "Title: Only headers\nType: none"


def test_tiers(spark):
    rows = [("Border dispute", "", 1), ("Docket motion", "", 4), ("Amended Complaint", "", 2), ("Reply", "", 3), ("Exhibit", "", 3), ("", "", 4), ("Letter", "Findings letter", 1)]
    df = spark.createDataFrame(rows, "t string, k string, want int").select(classify.tier("t", "k").alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())
    assert spark.range(1).select(classify.route(F.lit("Consent Decree"), F.lit("Order")).alias("r")).first()["r"] == "settlement"


def many(spark, bodies):
    docs = "".join(f"\n[DOCUMENT]\nTitle: {t}\nDate: 20{10 - i:02}-01-01\n{'x' * n}" for i, (t, n) in enumerate(bodies))
    return frame(spark, "Case: A\n" + docs)


def test_priority_filter_skips_what_does_not_fit(spark):
    out = prompts.prepare(many(spark, [("Opinion", 1200), ("Complaint", 4000), ("Answer", 800), ("Reply", 400), ("Docket", 40)]), "priority_filter", 1000).first()
    # 798 tokens are left: 300 + (1000 does not fit) + 200 + 100
    assert out["selected_docs"] == 3 and out["excluded_doc_types"] == ["Complaint", "Docket"] and out["tier_counts"].asDict() == {"tier_1": 1, "tier_2": 2, "tier_3": 1, "tier_4": 1}
    assert out["used_chunk_count"] == 3 and out["completion"] == "A response." and out["prompt"].startswith("Summarize") and out["excluded_docs"] == 2


def test_first_tier_shares_and_cuts(spark):
    out = prompts.prepare(many(spark, [("Opinion", 8000), ("Order", 4000), ("Complaint", 40)]), "priority_filter", 1400).first()
    assert out["selected_docs"] == 2 and out["prompt"].count("[...truncated]") == 2 and out["excluded_doc_types"] == ["Complaint"]
    out = prompts.prepare(many(spark, [("Opinion", 8000), ("Complaint", 40)]), "structured", 1000).first()
    assert out["prompt"].count("[...truncated]") == 1 and out["excluded_doc_types"] == ["Complaint"] and "x" * 2000 in out["prompt"] and "x" * 2001 not in out["prompt"]


def test_structured_order(spark):
    out = prompts.prepare(many(spark, [("Reply", 4), ("Order", 4), ("Opinion", 4)]), "structured").first()["prompt"]
    assert out.index("[PRIMARY] Opinion, 2008-01-01") < out.index("[PRIMARY] Order") < out.index("[CONTEXTUAL] Reply") and "- 2008-01-01: Opinion\n- 2009-01-01: Order" in out


def test_extract_first(spark):
    cache = frame(spark, "x").select(F.lit("k").alias("key"), F.lit("cached").alias("extraction"))
    df = many(spark, [("Reply", 40), ("Opinion", 4000)])
    out = prompts.prepare(df, "extract_first", 1700, cache=cache).first()
    assert (out["relevant_docs"], out["extracted_docs"], out["cache_hits"]) == (2, 2, 0) and out["prompt"].index("Opinion") < out["prompt"].index("Reply")
    out = prompts.prepare(many(spark, [("Docket", 4)] * 5), "extract_first").first()
    assert out["relevant_docs"] == 3
    out = prompts.prepare(df, "extract_first", 800).first()
    assert out["extracted_docs"] == 1 and "x" * 2000 + "\n[...truncated]" in out["prompt"]


def test_no_documents_and_blank_responses(spark):
    df = spark.createDataFrame([("1", "c", "plain", "r"), ("2", "c", "plain", " ")], "id string, case_id string, prompt string, response string")
    rows = prompts.prepare(df, "structured").collect()
    assert len(rows) == 1 and rows[0]["error"] == "no_docs_parsed" and rows[0]["prompt"] == "plain"
    stats = prompts.prepared_stats(prompts.prepare(df, "structured").withColumn("prompt_tokens_est", F.lit(5)), 10).first()
    assert stats["n"] == 1 and stats["fit_pct"] == 100.0


def test_extract_and_chunks(spark):
    body = "\n\n".join(["first", "second", "plain", "it was granted and denied", "granted", "remand granted ordered", "last"])
    got = spark.range(1).select(parse.extract(F.lit(body)).alias("x")).first()["x"]
    assert got == "first\n\nsecond\n\n[...key holdings...]\n\nremand granted ordered\n\nit was granted and denied\n\n[...]\n\nlast"
    p = "Intro\nChunk 1:\n[DOCUMENT]\nTitle: A\nType: Motion\nDate: 2010-01-02 10:00\n\n" + "m" * 500 + "\nChunk 2:\n[DOCUMENT]\nTitle: B\nType: Opinion\n\n" + "o" * 13600 + "\nChunk 3:\nType: docket\n\nd"
    c = spark.range(1).select(parse.source_chunks(F.lit(p)).alias("c")).first()["c"]
    assert [(x["index"], x["tier"], len(x["text"]), x["date"]) for x in c] == [(2, 1, 13600, ""), (1, 2, 400, "2010-01-02")]
    assert len(spark.range(1).select(parse.source_chunks(F.lit("y" * 5000)).alias("c")).first()["c"][0]["text"]) == 4000
    assert spark.range(1).select(tokens_estimate(F.lit("abcdefg")).alias("n")).first()["n"] == 1


def test_rejected_records_and_documents_taken(spark):
    doc = "Task.\nCase: X\n" + "\n[DOCUMENT]\nTitle: Opinion\n\nThe court finds it so." * 3
    rows = [(1, doc, "yes"), (2, doc, " \n"), (3, doc, None), (4, None, "yes"), (5, "", "yes"), (6, "Task.\nCase: X\n", "yes"), (7, None, None)]
    df = spark.createDataFrame(rows, "id bigint, prompt string, response string").withColumns({"case_id": F.col("id"), "reason": F.lit("other")})
    got = {r.id: r.reason for r in prompts.rejected(df).collect()}
    assert got == {2: "no response", 3: "no response", 4: "no prompt", 5: "no prompt", 6: "no documents", 7: "no response"}
    assert prompts.rejected(df.limit(0)).count() == 0
    cache = prompts.prepare(df.where("id = 1"), "extract_first")
    r = prompts.document_stats(cache).first()
    assert (r.mean_taken, r.mean_total, r.median_total, r.cache_hits) == (3, 3, 3, 0)
    shown = spark.createDataFrame([(1, 2, 5, 4, 7), (2, 4, 9, None, None), (3, None, 1, 2, 1)], "id int, used_chunk_count int, total_docs int, relevant_docs int, cache_hits int")
    r = prompts.document_stats(shown).first()
    assert (r.mean_taken, r.median_taken, r.mean_total, r.median_total, r.cache_hits) == (2, 2, 5, 4, 8)


def test_log_rows(spark):
    from millrace.sources import files

    lines = ['{"loss": 1.5, "step": 2}', '{"step": 3}', '{"step": 4, "loss": null}', "no json", "", None, '{"loss": 0, "step": 1, "other": [1]}', '{"eval_loss": 3, "step": 5}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(map(tuple, files.log_rows(df).collect())) == [(1, 0.0), (2, 1.5)] and files.log_rows(df, "eval_loss").collect()[0].step == 5


def test_timeline_of_all_documents(spark):
    """More dated documents than a timeline shows: bounded by default, whole where no bound is given."""
    df = many(spark, [("Reply", 4)] * 20)
    dated = lambda rows: next(r["prompt"] for r in rows if r["strategy"] == "structured").count("\n- 20")
    assert dated(prompts.prepare_all(df).collect()) == 15 and dated(prompts.prepare_all(df, timeline=None).collect()) == 20


def test_marks_of_indented_lines_stay(spark):
    """Only a mark that begins its line goes, also where white space is cut off around it."""
    d = frame(spark, "Case: A\n[DOCUMENT]\nTitle: T\nDate: 2010-01-01\n  Chunk 1: x\nChunk 2:\nmore\u3000\x1c").select(parse.documents("prompt").alias("d")).first()["d"]
    assert [(x["title"], x["body"]) for x in d] == [("T", "Chunk 1: x\nmore")]


def test_only_what_is_asked_for_is_made(spark):
    """Some strategies and columns alone: the same rows, without the texts that no column needs."""
    prompt = "Task.\nCase: A\n" + "".join(f"\n[DOCUMENT]\nTitle: Order {i}\nType: Order\nDate: 2010-01-02\n\nbody {i}" for i in range(3))
    df = spark.createDataFrame([(1, 1, prompt, "r")], "id int, case_id int, prompt string, response string")
    names = ["strategy", "used_chunk_count", "total_docs"]
    some = prompts.prepare_all(df, strategies=("structured", "extract_first"), columns=names)
    rows = lambda d: sorted(map(tuple, d.select(names).collect()))
    assert rows(some) == rows(prompts.prepare_all(df).where("strategy <> 'priority_filter'"))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "prompt_tokens_est" not in some.columns and "prompt" not in some.columns and prompts.EXTRACTS_INTRO[:40] not in plan
