import datetime
import hashlib
import json
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import scalar as C
from millrace.functions import text as T
from millrace.operators import parse


def one(spark, c, **values):
    names = list(values) or ["x"]
    row = tuple(values.values()) or (1,)
    kinds = ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, row, strict=True))
    return spark.createDataFrame([row], kinds).select(c.alias("r")).first()["r"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(alphabet=st.sampled_from("ab.!? \n\t\r\x0b\x1c\x85\xa0 é"), max_size=30), min_size=8, max_size=8))
def test_like_python(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", T.words("t").alias("w"), T.strip("t").alias("s"), T.lines("t").alias("l"), T.tokens_estimate("t").alias("n")).collect()
    for r in got:
        t = texts[r["i"]]
        assert r["w"] == t.split() and r["s"] == t.strip() and r["l"] == t.splitlines() and r["n"] == len(t) // 4


def test_sentences_and_paragraphs(spark):
    t = "One. Two!  Three?\n\nFour.\n\n \n\nFive"
    assert one(spark, T.sentences("t"), t=t) == ["One.", "Two!", "Three?", "Four.", "Five"]
    assert one(spark, T.paragraphs("t"), t=t) == ["One. Two!  Three?", "Four.", "Five"]
    assert one(spark, T.first_sentences("t", 3), t=t) == ["One.", "Two!", "Three?"]
    assert one(spark, T.sentences("t"), t="") == [] and one(spark, T.grams(T.words("t"), 2), t="a b c") == ["a b", "b c"]


@pytest.mark.parametrize(("n", "want"), [(2, "ab"), (0, ""), (-1, "abc"), (-9, "")])
def test_head(spark, n, want):
    assert one(spark, T.head("t", n), t="abcd") == want == "abcd"[:n]


def test_elide(spark):
    got = one(spark, T.elide("t", 10), t="a" * 2000)
    assert got == "aaaaa\n\n[... 1,990 characters elided to fit context window ...]\n\naaaaa" and one(spark, T.elide("t", 10), t="short") == "short"


@pytest.mark.parametrize(("token", "want"), [(" Token abc ", "abc"), ("token   x", "x"), ("abc", "abc"), ("  ", ""), (None, "")])
def test_token(spark, token, want):
    assert one(spark, C.bare_token("t"), t=token) == want


def test_scalars(spark):
    assert one(spark, C.timestamp_or_null("t"), t="bogus") is None and one(spark, C.timestamp_or_null("t"), t="") is None
    assert one(spark, C.timestamp_or_null("t"), t="2024-01-02T03:04:05Z") == datetime.datetime(2024, 1, 2, 3, 4, 5)
    body = "x" * 3000
    assert one(spark, C.key16(F.lit("t"), F.col("t")), t=body) == hashlib.sha256(f"t|{body[:2000]}".encode()).hexdigest()[:16]
    assert one(spark, C.canonical_json("t"), t='{"b": [1, {"é": null}], "a": 2}') == json.dumps({"a": 2, "b": [1, {"é": None}]}, sort_keys=True, separators=(",", ":"))
    assert one(spark, F.to_json(C.judge_reply("t")), t='```json\n{"a": 1}\n```') == '{"a":1}'
    assert one(spark, F.to_json(C.judge_reply("t")), t='well {"a": 2} so') == '{"a":2}' and one(spark, C.judge_reply("t").isNull(), t="none")
    assert one(spark, C.usage_cost(F.lit("claude-haiku-4-5"), F.lit(10**6), F.lit(None).cast("int"), F.lit(0), F.lit(10**6))) == pytest.approx(2.25)
    assert one(spark, C.identifier("a", "b", position=F.lit(7)), a="0", b=5) == "5" and one(spark, C.identifier("a", position=F.lit(7)), a=None) == "7"
    assert one(spark, C.backoff_seconds(F.lit(3), 1.0, 5.0, F.lit(0.5))) == 5.0


def test_long_texts_are_cut_like_short_ones(spark):
    odd = ["", " ", "a", " a ", "a  ", "\x1ca\x1f ", "é", " é　", "a \n", "~", "\x7f ", "x\u0085  ", "中文 ", None]
    got = spark.createDataFrame([(x,) for x in odd], "x string").select(T.strip_long("x"), T.strip("x"), T.at_most(F.col("x"), 1), F.left("x", F.lit(1)), T.at_most(F.col("x"), 2), F.left("x", F.lit(2))).collect()
    assert all(r[0] == r[1] and r[2] == r[3] and r[4] == r[5] for r in got)


def test_chunks_with_odd_heads(spark):
    """Fields and texts like patterns over the whole part, where its first paragraph does not tell."""
    parts = [
        "[DOCUMENT]\nTitle: A\nType: order\nDate: 2010-01-02 10:00\n\nText Title: B ", "[DOCUMENT]\nTitle:\n\nNext", "[DOCUMENT]\nType:  \n\n Type: letter of\n\nx", "no mark\n\nTitle: T\n\nbody [DOCUMENT] gone\n\nleft ",
        "x [DOCUMENT] a\n\nb [DOCUMENT] c\n\nd　", "[DOCUMENT]\nTitle: open", "pre\n[DOCUMENT]", "[DOCUMENT]\n\n", "\n\n[DOCUMENT] é\n\né ", "[DOCUM\n\nENT]\n\nTitle: x\nDate: d e",
    ]

    def field(part, name, other):
        m = re.search(rf"{name}:\s*([^\n]+)", part)
        return m[1].strip() if m else other

    for part in parts:
        row = spark.createDataFrame([(f"Task\nChunk 1:\n{part}",)], "p string").select(F.inline(parse.source_chunks("p"))).first()
        want = (field(part, "Title", "Document 1"), field(part, "Type", "Document"), re.sub(r"(?s)\[DOCUMENT\].*?\n\n", "", part).strip())
        assert row is None or (row["title"], row["type"], row["text"]) == want, part
