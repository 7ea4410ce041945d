import pytest
from pyspark.sql import functions as F

from millrace.operators import qa

FILL = "word " * 90 + "end."


def codes(spark, text, **more):
    df = spark.createDataFrame([(text, *more.values())], ["prediction", *more])
    r = qa.report(df, reference="reference" if "reference" in more else None, k=qa.Knobs(year=2024)).first()
    return [f["code"] for f in r["flags"]], r


@pytest.mark.parametrize(
    ("text", "code", "n"),
    [
        ("short.", "EXTREMELY_SHORT", 1), ("word " * 40 + "x.", "TOO_SHORT", 1), ("word " * 2001 + "x.", "TOO_LONG", 1), (FILL + " open", "UNTERMINATED", 1), (FILL + "..", "ELLIPSIS_END", 1),
        (FILL + " in 2oo4 and 20o3.", "GARBLED_DATE", 2), (FILL + " the 21st and No12 and 10x and v2.", "GARBLED_DATE", 0), (FILL + " the 2k00 case.", "GARBLED_DATE", 0),
        (FILL + " filed 21020.", "GARBLED_DATE", 1), (FILL + " number 21020.", "GARBLED_DATE", 0), (FILL + " May 3, 210.", "GARBLED_DATE", 1), (FILL + " in 350.", "GARBLED_DATE", 0),
        (FILL + " in 1650.", "IMPLAUSIBLE_YEAR", 1), (FILL + " in 2030.", "IMPLAUSIBLE_YEAR", 1), (FILL + " in 1999.", "IMPLAUSIBLE_YEAR", 0), (FILL + "\nSO ORDERED.\n" + FILL, "RAW_DOCUMENT_ARTIFACT", 1),
        ("1 a\n2 b\n3 c\n" + FILL, "RAW_DOCUMENT_ARTIFACT", 1), (FILL + " THIS IS ALL CAPS NOW.", "EXCESSIVE_CAPS", 1), (FILL + " Here is the summary of it.", "META_PROMPT_LEAK", 1),
        (FILL + " The judgement stands.", "WRONG_JUDGMENT_SPELLING", 1), (FILL + " He sues, alleges and seeks.", "WRONG_TENSE", 1), (FILL + " He sues, alleges and seeks; held, ruled, found.", "WRONG_TENSE", 0),
        (FILL + " The commmittee.", "SUSPICIOUS_SPELLING", 1), (FILL + " Chapter VIII.", "SUSPICIOUS_SPELLING", 0), (FILL + " John.", "SUSPICIOUS_SPELLING", 1), (FILL, "MISSING_COURT", 1),
        (FILL + " The Superior Court.", "MISSING_COURT", 0), (FILL + " under § 1983.", "MISSING_STATUTE", 1), (FILL + " 42 U.S.C. § 1983 applies.", "MISSING_STATUTE", 0), (FILL + " filed in May.", "MISSING_FILING_DATE", 0),
        (FILL + " damages.", "MISSING_REMEDY", 0), (FILL + " granted.", "MISSING_OUTCOME", 0), (FILL + " pro se.", "MISSING_ACTION_TYPE", 0),
    ],
)
def test_checks(spark, text, code, n):
    assert codes(spark, text)[0].count(code) == n


def test_header_is_no_artifact(spark):
    body = " ".join(f"w{i}x" for i in range(90)) + "."
    assert "RAW_DOCUMENT_ARTIFACT" not in codes(spark, "**Doe v. Roe**\n\nCase No. 12\nUnited States District Court\n" + body)[0]
    assert "RAW_DOCUMENT_ARTIFACT" in codes(spark, body + "\nUNITED STATES DISTRICT COURT\n" + body)[0]


def test_repetition(spark):
    s = "This very sentence is longer than forty characters, is it not. "
    found, r = codes(spark, "Start. " + s + "Between them. " + s)
    flag = next(f for f in r["flags"] if f["code"] == "DUPLICATE_SENTENCE")
    assert flag["message"] == "Sentence appears 2 times." and flag["evidence"] == s.strip()
    found, r = codes(spark, "a b c d e f g h " * 4 + "end.")
    assert "REPETITION_LOOP" in found and next(f for f in r["flags"] if f["code"] == "REPETITION_LOOP")["evidence"] == "a b c d e f g h"


def test_reference_judge_status(spark):
    found, r = codes(spark, FILL, reference="word " * 10, rougeLsum=0.1, judge_overall=2)
    assert {"LENGTH_TOO_LONG_VS_REF", "LOW_ROUGE", "JUDGE_WEAK"} <= set(found) and r["status"] == "REJECT"
    assert "LOW_ROUGE" not in codes(spark, FILL, reference="", rougeLsum=0.1)[0]
    assert codes(spark, FILL, judge_overall=1)[0][-1] == "JUDGE_REJECT"
    null = spark.createDataFrame([(None, "x")], "prediction string, case_id string")
    r = qa.report(null, reference=None).first()
    assert r["identifier"] == "x" and r["word_count"] == 0 and r["flags"][0]["code"] == "EXTREMELY_SHORT"


def test_status_follows_severities(spark):
    df = qa.report(spark.createDataFrame([(i, t) for i, t in enumerate([FILL, "x", FILL + " SO"])], "index int, prediction string"), reference=None)
    bad = df.where((F.col("status") == "REJECT") != (qa.severity_count("flags", "critical") > 0)).count()
    assert bad == 0 and qa.csv_rows(df).columns[0] == "identifier" and len(qa.csv_rows(df).columns) == 12
    assert qa.code_counts(df).where("code = 'MISSING_COURT'").first()["records"] == 3


def test_cues_in_other_scripts_and_cases(spark):
    """Texts that are not plain are searched by the whole patterns: a long s is an s in any case, and other white space stands before digits."""
    assert "IMPLAUSIBLE_YEAR" in codes(spark, FILL + " \u017fince\xa01650.")[0] and "IMPLAUSIBLE_YEAR" in codes(spark, FILL + " SINCE , 1650.")[0]
    assert "MISSING_OUTCOME" not in codes(spark, FILL + " It was di\u017fmi\u017f\u017fed.")[0] and "MISSING_OUTCOME" not in codes(spark, FILL + " DISMISSED.")[0]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reports_are_made_once(spark):
    """Counting codes adds no filter that makes all flags a second time."""
    df = qa.report(spark.createDataFrame([(1, FILL)], "index int, prediction string"), reference=None)
    assert plan(qa.code_counts(df)).count("GARBLED_DATE") == plan(df).count("GARBLED_DATE")


def test_screen_finds_what_the_checks_find(spark):
    """Texts are looked through in batches: a check is made only where something may be found, and on all texts that are no plain ASCII."""
    import pyarrow as pa

    loop, twice = "one two three four five six seven eight nine " * 3, "This very sentence is longer than forty characters, is it not. " * 2
    texts = [FILL, FILL + " open", FILL + " in 2oo4.", FILL + " May 3, 210.", FILL + " in 1650.", FILL + " filed 21020.", "**A v. B**\nCase No. 12\n" + FILL, FILL + "\nSO ORDERED.", "1 a\n2 b\n3 c\n" + FILL, loop, twice, FILL + " John.", " ", ""]
    bits = qa.screened(pa.array([*texts, FILL + " \u00a7", FILL + "\r\n", "a\x0bb"])).to_pylist()
    assert bits[-3:] == [(1 << qa._BITS) - 1] * 3
    assert [b >> qa._BITS for b in bits[:2]] == [91, 92]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, prediction string")
    # a blank that is no ASCII takes the other way, and changes no flag of these texts but their number of words
    other = df.withColumn("prediction", F.concat(F.lit("\u00e9 "), "prediction"))
    flags = lambda d: {r["i"]: [f["code"] for f in r["flags"]] for r in qa.report(d, reference=None, ids=("i",)).collect()}
    one, two = flags(df), flags(other)
    assert [one[i] for i in range(6)] == [two[i] for i in range(6)]
    assert "RAW_DOCUMENT_ARTIFACT" not in one[6] and "RAW_DOCUMENT_ARTIFACT" in one[7]
    assert "REPETITION_LOOP" in one[9] and "DUPLICATE_SENTENCE" in one[10] and "SUSPICIOUS_SPELLING" in one[11]
