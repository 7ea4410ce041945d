"""Parsing of multi-document prompts, and the parts that reviewers see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import first_token
from .classify import chunk_tier, tier

_col = T._col
MARK = "\n[...truncated]"


def _rest(items: Column, start: Column) -> Column:
    """The elements from a place on; without a count of them, for which the array would be made a second time."""
    return F.slice(items, start, F.lit(1 << 30))


def _unchunked(c: Column) -> Column:
    return T.let(c, lambda x: T.strip(F.when(x.contains("Chunk"), F.regexp_replace(x, r"(?dmU)^Chunk\s+\d+:\s*\n?", "")).otherwise(x)))


def preamble(prompt: Column | str) -> Column:
    return T.strip(F.split_part(_col(prompt), F.lit("[DOCUMENT]"), F.lit(1)))


def case_name(prompt: Column | str) -> Column:
    """Of the preamble's first line that starts with "Case:", the rest; '' without one."""
    return T.strip(F.regexp_extract(preamble(prompt), r"(?dmU)^[^\S\n]*Case:(.*)$", 1))


def _header(rows: Column) -> Column:
    """title, kind, date and start (lines before the body). Header lines are read until a date or, after the first line, any
    other line; if neither comes, all lines stay in the body. Lines after the header cost nothing."""
    start = F.struct(F.lit("").alias("title"), F.lit("").alias("kind"), F.lit("").alias("date"), F.lit(0).alias("start"), F.lit(False).alias("done"), F.lit(0).alias("i"))

    def read(a: Column, x: Column) -> Column:
        made = lambda title=a["title"], kind=a["kind"], date=a["date"], start=a["start"], done=F.lit(False): F.struct(
            title.alias("title"), kind.alias("kind"), date.alias("date"), start.alias("start"), done.alias("done"), (a["i"] + 1).alias("i")
        )
        rest = lambda n: T.strip(F.substring(x, n, 1 << 30))
        return (
            F.when(x.startswith("Title:"), made(title=F.btrim(rest(7), F.lit("[]")))).when(x.startswith("Type:"), made(kind=rest(6)))
            .when(x.startswith("Date:"), made(date=rest(6), start=a["i"] + 1, done=F.lit(True)))
            .when((x != "") & (a["i"] > 0), made(start=a["i"], done=F.lit(True))).otherwise(made())
        )

    return F.aggregate(rows, start, lambda a, line: F.when(a["done"], a).otherwise(T.let(T.strip(line), lambda x: read(a, x))))


def documents(prompt: Column | str) -> Column:
    """Array of (pos, title, doc_type, date, body, tier, tokens) of a prompt's documents in order."""
    parts = F.split(_col(prompt), r"\[DOCUMENT\]")
    fragments = F.filter(F.transform(_rest(parts, F.lit(2)), _unchunked), lambda f: f != "")
    headed = F.transform(fragments, lambda f, i: T.let(F.split(f, "\n"), lambda rows: F.struct(rows.alias("rows"), i.alias("pos"), _header(rows).alias("h"))))

    def body(x: Column) -> Column:
        return _unchunked(F.array_join(_rest(x["rows"], x["h"]["start"] + 1), "\n"))

    full = F.transform(headed, lambda x: F.struct(x["pos"].alias("pos"), x["h"].alias("h"), body(x).alias("body")))
    return F.transform(
        full,
        lambda x: F.struct(
            x["pos"].alias("pos"), x["h"]["title"].alias("title"), x["h"]["kind"].alias("doc_type"), x["h"]["date"].alias("date"), x["body"].alias("body"),
            tier(x["h"]["title"], x["h"]["kind"]).alias("tier"), T.tokens_estimate(x["body"]).alias("tokens"),
        ),
    )


def source_chunks(prompt: Column | str, max_chars: int = 14_000) -> Column:
    """Array of (index, title, type, date, tier, text) for reviewers: without tier 4, tier 1 first, until max_chars are used up;
    the last text is cut to what is left if that is over 300. A prompt without chunks is one of up to 4000 characters."""
    p = _col(prompt)
    parts = F.split(p, r"\nChunk \d+:\n")

    def field(part: Column, head: Column, name: str, other: Column) -> Column:
        found = lambda x: F.regexp_extract(x, rf"(?dU){name}:\s*(.+)", 1)
        # what the part's first paragraph has is what the part has; only without it, or where white space crosses its end, all is read
        return F.coalesce(F.nullif(T.strip(found(head)), F.lit("")), T.strip(F.nullif(found(part), F.lit(""))), other)

    def body(part: Column, head: Column) -> Column:
        """Without all that lies between a mark and the next empty line; mostly one mark, in the first paragraph."""
        after = lambda size: F.substring(part.cast("binary"), size, F.lit(1 << 30)).cast("string")
        plain = lambda rest: head.contains("[DOCUMENT]") & (F.octet_length(part) > F.octet_length(head)) & ~rest.contains("[DOCUMENT]")
        cut = lambda rest: F.when(plain(rest), F.concat(F.substring_index(head, "[DOCUMENT]", 1), rest)).otherwise(F.regexp_replace(part, r"(?s)\[DOCUMENT\].*?\n\n", ""))
        return T.strip_long(T.let(after(F.octet_length(head) + 3), cut))

    def chunk(part: Column, head: Column, i: Column, kind: Column) -> Column:
        return F.struct(
            (i + 1).alias("index"), field(part, head, "Title", F.concat(F.lit("Document "), (i + 1).cast("string"))).alias("title"), kind.alias("type"),
            first_token(field(part, head, "Date", F.lit(""))).alias("date"), chunk_tier(kind).alias("tier"), body(part, head).alias("text"),
        )

    one = lambda part, i: T.let(F.substring_index(part, "\n\n", 1), lambda head: T.let(field(part, head, "Type", F.lit("Document")), lambda kind: chunk(part, head, i, kind)))
    made = lambda parts: F.transform(_rest(parts, F.lit(2)), one)
    ranked = lambda parts: F.array_sort(F.transform(F.filter(made(parts), lambda c: c["tier"] < 4), lambda c: F.struct(c["tier"].alias("t"), c["index"].alias("i"), c.alias("c"))))
    before = lambda lengths, i: F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda a, b: a + b)
    rooms = lambda r: T.let(
        F.transform(r, lambda x: F.length(x["c"]["text"])), lambda lengths: F.transform(r, lambda x, i: F.struct(x["c"].alias("c"), (F.lit(max_chars) - before(lengths, i)).alias("room")))
    )
    kept = lambda parts: F.transform(
        F.filter(T.let(ranked(parts), rooms), lambda x: x["room"] > 300),
        lambda x: F.struct(*[x["c"][k].alias(k) for k in ("index", "title", "type", "date", "tier")], T.at_most(x["c"]["text"], x["room"]).alias("text")),
    )
    whole = F.array(F.struct(F.lit(1).alias("index"), F.lit("Source").alias("title"), F.lit("Document").alias("type"), F.lit("").alias("date"), F.lit(2).alias("tier"), F.left(p, F.lit(4000)).alias("text")))
    return T.let(parts, lambda parts: F.when(F.size(parts) <= 1, whole).otherwise(kept(parts)))


def sources_block(chunks: Column | str) -> Column:
    """Chunks as a judge reads them, each text up to 2800 characters."""
    one = lambda c: F.concat(F.lit("[CHUNK "), c["index"].cast("string"), F.lit(" — "), c["type"], F.lit(" · "), c["date"], F.lit("]\n"), T.at_most(c["text"], 2800))
    block = lambda cs: F.when(F.size(cs) == 0, "(No source documents provided — scoring factual grounding as N/A.)").otherwise(F.array_join(F.transform(cs, one), "\n\n"))
    return T.let(_col(chunks), block)


def heuristic_summary(title: Column | str, text: Column | str, kind: Column | str, court: Column | str, subject: Column | str, n: int = 4) -> Column:
    """A heading and the first n sentences as a list."""
    filled = lambda c: F.when(_col(c) != "", _col(c))
    head = F.concat(F.lit("Summary for "), _col(title), F.lit(" ("), F.concat_ws(", ", F.coalesce(filled(kind), F.lit("Document")), filled(court), filled(subject)), F.lit(")"))
    found = T.first_sentences(F.coalesce(_col(text), F.lit("")), n)
    bullets = F.when(F.size(found) == 0, F.array(F.lit("No text available for summarization yet."))).otherwise(found)
    return F.concat(head, F.lit("\n"), F.array_join(F.transform(bullets, lambda s: F.concat(F.lit("- "), s)), "\n"))


# Words that mark holdings.
HOLDINGS = (
    "granted", "denied", "dismissed", "affirm", "revers", "remand", "ordered", "adjudged", "decreed", "we hold", "the court finds", "it is so ordered", "conclusion", "hereby",
    "accordingly", "for the foregoing reasons", "for these reasons", "judgment is entered", "summary judgment",
)


def extract(body: Column | str) -> Column:
    """Key paragraphs of a document. Up to four paragraphs: all, up to 12000 characters. Else the first two, of those between
    them and the last the two with most holding words (ties in order), and the last, up to 6000 characters."""
    body = T.strip(body)
    capped = lambda c, n: F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(MARK))).otherwise(c)
    score = lambda x: T.let(F.lower(x), lambda low: sum((low.contains(w).cast("int") for w in HOLDINGS[1:]), low.contains(HOLDINGS[0]).cast("int")))

    def condensed(paras: Column) -> Column:
        middle = F.transform(F.slice(paras, 3, F.greatest(F.size(paras) - 3, F.lit(0))), lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x")))
        picks = F.transform(F.slice(F.array_sort(F.filter(middle, lambda m: m["s"] < 0)), 1, 2), lambda m: m["x"])
        marked = F.when(F.size(picks) > 0, F.concat(F.array(F.lit("[...key holdings...]")), picks)).otherwise(picks)
        return F.array_join(F.concat(F.slice(paras, 1, 2), marked, F.array(F.lit("[...]")), F.slice(paras, -1, 1)), "\n\n")

    return T.let(body, lambda body: T.let(T.paragraphs(body), lambda paras: F.when(F.size(paras) <= 4, capped(body, 12000)).otherwise(T.let(condensed(paras), lambda c: capped(c, 6000)))))


def display_name(known: Column | str, own: Column | str, prediction: Column | str, index: Column | str) -> Column:
    """A case's name: known, else its own, else the prediction's first sentence if over 5 characters (80 at most), else a number."""
    first = T.strip(F.split_part(_col(prediction), F.lit("."), F.lit(1)))
    guess = F.when(F.length(first) > 5, F.left(first, F.lit(80))).otherwise(F.concat(F.lit("Case "), _col(index).cast("string")))
    return T.or_else(_col(known), _col(own), guess)
