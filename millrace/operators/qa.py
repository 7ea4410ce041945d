"""Quality triage of summaries: each check is a Column of flags, a report is their concatenation in a fixed order.

A flag is (severity, category, code, message, evidence). Any critical flag makes REJECT, else any warning REVIEW, else PASS.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import identifier

_col = T._col
FLAG = "struct<severity:string,category:string,code:string,message:string,evidence:string>"

# Patterns of the checks.
MONTHS = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
CAPTION = (
    r"^\s*(?:Plaintiffs?,?|Defendants?,?)\s*[)\]].*$|^\s*v\.\s*[)\]]|^\s*(?:UNITED STATES )?DISTRICT COURT\b|"
    r"^\s*Case No\.?\s*[:#]|^\s*Civil Action No\.?|^\s*/s/|^\s*SO ORDERED\.?\s*$|^\s*IT IS SO ORDERED\.?\s*$"
)
NUMBERED_LINES = r"(^\s*\d{1,2}\s+\S.*(?:\n|$)){3,}"
HEADER_LINE = (
    r"^\s*(?:\*\*[^*]{1,160}\*\*|\#{1,3}\s+\S.{0,160}|(?:civil action|case|docket)\s+no\.?\s*[:#]?\s*\S.*|"
    r"(?:united states district court|u\.s\. district court|district court|court of appeals|supreme court)\b.*|filed\s*:\s*\S.*|court\s*:\s*\S.*)\s*$"
)
META = (
    r"\b(as an ai|i (?:will|am|can|'ll|'m) (?:now |provide|be )?(?:summariz|creat|generat|writ|provid)|here(?:'s| is) (?:a |the |your )?(?:summary|case summary)|"
    r"based on the (?:provided|given|above) (?:documents?|text|case|information)|the following is a summary|summary:\s*\n)"
)
CAPS_RUN = r"(?:\b[A-Z]{2,}\b\s+){4,}"
PRESENT = r"\b(?:files|sues|alleges|argues|claims|seeks|brings|moves|asks|demands|challenges)\b"
PAST = r"\b(?:filed|sued|alleged|argued|claimed|sought|brought|moved|asked|demanded|challenged|held|ruled|found)\b"
FILING = (
    rf"\b(?:filed|commenced|brought|initiated)\b.*?(?:{MONTHS}|\d{{4}})|(?:on|in)\s+{MONTHS}\s+\d{{1,2}},?\s*\d{{4}}|{MONTHS}\s+\d{{1,2}},?\s*\d{{4}}"
)
COURT = (
    r"\b(?:U\.S\. District Court|United States District Court|Circuit Court|Court of Appeals|Supreme Court|District of [A-Z][a-z]+|Eastern District|Western District|Northern District|"
    r"Southern District|Middle District|[A-Z][a-zA-Z]+ County Court|Court of Common Pleas|Chancery Court|Superior Court)\b"
)
STATUTE = (
    r"\b(?:42 U\.?S\.?C\.?|28 U\.?S\.?C\.?|Title [IVX]+|Title VII|Americans with Disabilities Act|ADA\b|Section 1983|§\s*1983|First Amendment|Fourth Amendment|Fifth Amendment|"
    r"Eighth Amendment|Fourteenth Amendment|Equal Protection|Due Process|Voting Rights Act|Civil Rights Act|Rehabilitation Act|Fair Housing Act|FHA\b|IDEA\b|FMLA\b|RFRA\b|IDEA\b|FLSA\b)\b"
)
REMEDY = (
    r"\b(?:damages|injunctive relief|declaratory (?:judgment|relief)|compensatory|punitive|attorneys?'?\s*fees|restitution|preliminary injunction|permanent injunction|"
    r"(?:sought|seeking|requested|requesting)\s+(?:relief|damages|an? (?:order|injunction)))\b"
)
OUTCOME = (
    r"\b(?:dismissed|granted|denied|settled|affirmed|reversed|remanded|entered|approved|certified|judgment (?:for|against)|court (?:held|ruled|found|ordered|entered)|class certification)\b"
)
ACTION = r"\b(?:class action|class of|putative class|individual capacity|pro se)\b"
ORDINAL = r"\d{1,2}(?:st|nd|rd|th)"
REPORTER = r"(?:Nos?|Count|Doc|ECF|ID|PL|DEF|No\d+|Fed|Cir|Cal|Ill|Mich|Tex|Va|Wis|Pa|Ga|Md|Mo|Or|NC|NY|NJ|CA|DC|SD|ED|WD|MD|ND)\d+"
VERSION = r"\d+[xkKm]\d*|v\d+|p\d+|§\d+"
YEAR_CUES = f"(?:in|on|since|until|filed|year|dated|of|{MONTHS})"
DATE_CUES = "(?:in|on|since|until|filed|year|dated)"
#: the last two letters of all cues and months
CUE_ENDS = "in|on|ce|il|ed|ar|of|an|ry|eb|ch|pr|ay|ne|un|ly|ul|ug|st|ep|pt|er|ct|ov|ec"
CLUSTERS = (r"\b\w*iiv\w*\b", r"\b\w*iin\w*\b", r"\b\w*(?:jn|hn|kz|wv)\w*\b", r"\bYour[kt]\b(?!shire)")
TRIPLE = r"\b\w*([a-zA-Z])\1{2,}\w*\b"
JUDGE_FIELDS = ("judge_factual_accuracy", "judge_completeness", "judge_conciseness_style", "judge_legal_reasoning", "judge_overall")


@dataclass(frozen=True)
class Knobs:
    min_words: int = 80
    max_words: int = 2000
    least_ratio: float = 0.4
    most_ratio: float = 2.5
    rouge_warn: float = 0.25
    rouge_crit: float = 0.15
    bertscore_warn: float = 0.0
    bertscore_crit: float = -0.1
    #: the year that dates are judged by; a parameter, so that a report can be made again
    year: int = 2026


def _flag(severity: str, category: str, code: str, message: Column | str, evidence: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(code).alias("code"), lit(message).alias("message"), lit(evidence).alias("evidence"))


def _none() -> Column:
    return F.array().cast(f"array<{FLAG}>")


def _if(condition: Column, flag: Column) -> Column:
    return F.when(condition, F.array(flag)).otherwise(_none())


def _plain(text: Column) -> Column:
    """Whether a text is ASCII, for which patterns mean the same with and without Unicode classes and cases."""
    return F.octet_length(text) == F.length(text)


def _may(text: Column, *words: str, fold: bool = False) -> Column:
    """False only where a text holds none of some words, one of which a pattern needs; looking for words is much cheaper than the
    pattern. fold: in any case, by words in small letters."""
    c = F.lower(text) if fold else text
    found = c.contains(words[0])
    for w in words[1:]:
        found = found | c.contains(w)
    return found | ~_plain(text) if fold else found


def _has(text: Column, mode: str, pattern: str) -> Column:
    """text.rlike(mode + pattern). Plain texts are searched in small letters where case plays no part, without Unicode classes."""
    flags = mode.strip("(?)").replace("U", "")
    small = "i" in flags and not any(c.isupper() for c in pattern.replace("\\S", ""))
    flags = flags.replace("i", "") if small else flags
    plain = (F.lower(text) if small else text).rlike((f"(?{flags})" if flags else "") + pattern)
    return F.when(_plain(text), plain).otherwise(text.rlike(mode + pattern))


def _always(check: str) -> Column:
    return F.lit(True)


def _number(c: Column) -> Column:
    return c.cast("string")


def length_flags(n: Column, k: Knobs) -> Column:
    words = F.concat(_number(n), F.lit(" words"))
    return (
        F.when(n < 30, F.array(_flag("critical", "format", "EXTREMELY_SHORT", F.concat(F.lit("Summary is only "), words, F.lit(" — far too short to cover required elements.")), words)))
        .when(n < k.min_words, F.array(_flag("warning", "format", "TOO_SHORT", F.concat(F.lit("Summary ("), words, F.lit(f") is below the {k.min_words}-word minimum.")), words)))
        .when(n > k.max_words, F.array(_flag("warning", "format", "TOO_LONG", F.concat(F.lit("Summary ("), words, F.lit(f") exceeds the {k.max_words}-word budget.")), words)))
        .otherwise(_none())
    )


def ending_flags(text: Column) -> Column:
    end = T.rstrip(text)
    last = F.right(end, F.lit(1))
    open_end = _flag(
        "critical", "format", "UNTERMINATED", "Summary does not end with terminal punctuation — likely truncated mid-sentence or hit the max-token budget.",
        F.concat(F.lit("…"), F.right(T.last_line(end), F.lit(60))),
    )
    dots = _flag("warning", "format", "ELLIPSIS_END", "Summary ends in an ellipsis — may indicate content was dropped.", F.right(end, F.lit(20)))
    return F.when(end == "", _none()).when(~last.isin(*'.!?"\')]'), F.array(open_end)).when(end.endswith(".."), F.array(dots)).otherwise(_none())


def date_flags(text: Column, k: Knobs, may: Callable[[str], Column] = _always, known: Column | None = None) -> Column:
    """known: whether `may` is not a guess but says itself that a pattern is found, in a plain text."""
    each = lambda found, make: F.transform(found, make)
    # texts without digits, which are most, need none of the patterns that look for them
    none = F.array().cast("array<string>")
    # in plain texts, white space or a comma stands between a cue or month and the digits: it is looked for, then what is around it
    dated = ~_plain(text) | text.rlike(rf"(?i)[\s,](?=[\s,]*\d)(?<=(?:{CUE_ENDS})[\s,])")

    def digits(n: int, check: str, pattern: str) -> Column:
        found = F.when(dated & text.rlike(f"(?U)\\d{{{n}}}"), T.all_matches(text, f"(?iU){pattern}", 1)).otherwise(none)
        return F.when(~may(check), none).otherwise(found) if known is None else F.when(~may(check), none).when(known, T.all_matches(text, f"(?i){pattern}", 1)).otherwise(found)

    mixed = F.filter(
        F.when(may("mixed") & text.rlike("[0-9][A-Za-z]|[A-Za-z][0-9]"), T.all_matches(text, r"(?U)\b(?=[A-Za-z0-9]{3,6}\b)[A-Za-z0-9]*(?:[0-9][A-Za-z]|[A-Za-z][0-9])[A-Za-z0-9]*\b")).otherwise(none),
        lambda t: ~t.rlike(rf"(?i)\A(?:{ORDINAL}|{REPORTER})\z") & ~t.rlike(rf"\A(?:{VERSION})\z"),
    )
    long = digits(5, "long", rf"\b{YEAR_CUES}\s*,?\s*\b(\d{{5,}})\b")
    short = F.filter(digits(3, "short", rf"(?:{MONTHS}\s+\d{{1,2}},?\s*|\b{DATE_CUES}\s+)(\d{{3}})\b"), lambda t: t.rlike(r"\A(?:19|20|21)"))
    year = F.filter(digits(4, "year", rf"\b{YEAR_CUES}\s*,?\s*\b(\d{{4}})\b"), lambda t: F.coalesce((F.try_to_number(t, F.lit("9999")) < 1700) | (F.try_to_number(t, F.lit("9999")) > k.year + 1), F.lit(False)))
    garbled = lambda t, message: _flag("critical", "format", "GARBLED_DATE", message, t)
    return F.concat(
        each(mixed, lambda t: garbled(t, F.concat(F.lit("Alphanumeric token '"), t, F.lit("' looks like a garbled year (common overfitting artifact).")))),
        each(long, lambda t: garbled(t, F.concat(F.length(t).cast("string"), F.lit("-digit number '"), t, F.lit("' in year context — likely garbled year.")))),
        each(short, lambda t: garbled(t, F.concat(F.lit("3-digit 'year' '"), t, F.lit("' in date context — truncated year digit.")))),
        each(year, lambda t: _flag("warning", "format", "IMPLAUSIBLE_YEAR", F.concat(F.lit("Year "), t, F.lit(f" is outside plausible range (1700-{k.year + 1}).")), t)),
    )


def without_header(text: Column) -> Column:
    """Without up to eight leading lines of a displayed header, and blank lines among them."""
    def read(a: Column, blank: Column, header: Column) -> Column:
        return F.struct(
            F.when(blank | header, a["lines"] + 1).otherwise(a["lines"]).alias("lines"), F.when(~blank & header, a["headers"] + 1).otherwise(a["headers"]).alias("headers"),
            (~blank & ~header | (a["headers"] + (~blank & header).cast("int") >= 8)).alias("done"),
        )

    def step(a: Column, line: Column) -> Column:  # lines after the header cost nothing
        return F.when(a["done"], a).otherwise(T.let(T.strip(line), lambda x: T.let(F.struct((x == "").alias("blank"), x.rlike(f"(?idU){HEADER_LINE}").alias("header")), lambda y: read(a, y["blank"], y["header"]))))

    skipped = lambda rows: F.aggregate(rows, F.struct(F.lit(0).alias("lines"), F.lit(0).alias("headers"), F.lit(False).alias("done")), step)["lines"]
    return T.let(T.lines(text), lambda rows: T.lstrip(F.array_join(F.slice(rows, skipped(rows) + 1, F.greatest(F.size(rows), F.lit(1))), "\n")))


def artifact_flags(text: Column, may: Callable[[str], Column] = _always) -> Column:
    caption, caps = f"(?midU){CAPTION}", f"(?U){CAPS_RUN}"
    raw = "Summary contains raw pleading or order text (caption, signature block, or court header) — model is regurgitating source documents instead of summarizing."
    return F.concat(
        _if(may("caption") & _has(text, "(?midU)", CAPTION), _flag("critical", "format", "RAW_DOCUMENT_ARTIFACT", raw, F.left(F.regexp_extract(text, caption, 0), F.lit(80)))),
        _if(
            may("numbered") & text.contains("\n") & text.rlike(f"(?mdU){NUMBERED_LINES}"),
            _flag("critical", "format", "RAW_DOCUMENT_ARTIFACT", "Summary contains consecutive line-numbered lines — likely a raw transcript or brief block.", "line-numbered block detected"),
        ),
        _if(may("caps") & text.rlike(caps), _flag("warning", "format", "EXCESSIVE_CAPS", "Extended run of ALL-CAPS words — may indicate a court header or shout block.", F.left(F.regexp_extract(text, caps, 0), F.lit(80)))),
    )


def _most_common(items: Column, keys: Column, least: int) -> Column:
    """(n, -place, item) of the most frequent key that occurs at least `least` times, the first of equals; null without one.
    Sorting finds the repeated keys; only those are counted."""

    def counted(keys: Column, ordered: Column) -> Column:
        often = F.array_distinct(F.filter(ordered, lambda x, i: F.coalesce(x == F.get(ordered, i + (least - 1)), F.lit(False))))
        return F.transform(
            often, lambda x: F.struct(F.size(F.filter(keys, lambda y: y == x)).alias("n"), (-F.array_position(keys, x)).alias("at"), F.get(items, (F.array_position(keys, x) - 1).cast("int")).alias("item"))
        )

    return F.array_max(T.let(keys, lambda k: T.let(F.sort_array(k), lambda o: counted(k, o))))


def repetition_flags(text: Column, tokens: Column, may: Callable[[str], Column] = _always) -> Column:
    n = F.size(tokens)
    # a phrase that occurs three times makes nine words at least repeat an earlier one
    at = F.when((n >= 24) & (n - F.size(F.array_distinct(tokens)) >= 9), F.sequence(F.lit(0), F.greatest(n - 8, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(8)]))
    twice = lambda w: F.array(_flag("warning", "format", "DUPLICATE_SENTENCE", F.concat(F.lit("Sentence appears "), _number(w["n"]), F.lit(" times.")), F.left(w["item"], F.lit(100))))
    gram = lambda w: F.left(F.array_join(F.slice(tokens, (1 - w["at"]).cast("int") - 1, 8), " "), F.lit(80))
    loop = lambda w: F.array(_flag("critical", "format", "REPETITION_LOOP", F.concat(F.lit("8-word phrase repeats "), _number(w["n"]), F.lit(" times — model is stuck in a loop.")), gram(w)))
    some = lambda worst, make: T.let(worst, lambda w: F.when(w.isNotNull(), make(w)).otherwise(_none()))
    sentences = T.let(F.filter(T.sentences(text), lambda s: F.length(s) > 40), lambda long: some(_most_common(long, long, 2), twice))
    gate = lambda check, flags: F.when(may(check), flags).otherwise(_none())
    return F.concat(gate("sentences", sentences), gate("loop", some(T.let(hashes, lambda h: _most_common(h, h, 3)), loop)))


def _words(pattern: str) -> list[str]:
    """The words of a pattern that is a choice of words."""
    return pattern.removeprefix(r"\b(?:").removesuffix(r")\b").split("|")


def meta_flags(text: Column) -> Column:
    pattern = f"(?iU){META}"
    some = _may(text, "as an ai", "summar", "creat", "generat", "writ", "provid", "based on", fold=True)
    return _if(some & text.rlike(pattern), _flag("critical", "format", "META_PROMPT_LEAK", "Summary contains meta-prompt or self-referential AI language.", F.left(F.regexp_extract(text, pattern, 0), F.lit(80))))


def style_flags(text: Column, may: Callable[[str], Column] = _always) -> Column:
    def tense(now: Column, past: Column) -> Column:
        told = F.concat(F.lit("Summary appears to use present tense ("), _number(now), F.lit(" present-tense verbs vs "), _number(past), F.lit(" past-tense) — the house style is past tense."))
        return _if((now >= 3) & (now > past), _flag("warning", "content", "WRONG_TENSE", told, F.concat(_number(now), F.lit(" present / "), _number(past), F.lit(" past"))))

    count = lambda pattern: F.when(_plain(text), T.count_regex(text, pattern)).otherwise(T.count_regex(text, f"(?U){pattern}"))
    both = T.let(F.struct(count(PRESENT).alias("now"), count(PAST).alias("past")), lambda n: tense(n["now"], n["past"]))
    return F.concat(
        _if(may("judgement") & text.contains("judgement") & text.rlike(r"(?U)\bjudgement\b"), _flag("info", "content", "WRONG_JUDGMENT_SPELLING", "'Judgement' should be 'judgment' in U.S. legal usage.", "judgement")),
        F.when(may("tense") & _may(text, *_words(PRESENT)), both).otherwise(_none()),
    )


def spelling_flags(text: Column) -> Column:
    none = F.array().cast("array<string>")
    triples = F.when(text.rlike(r"([a-zA-Z])\1{2}"), F.filter(T.all_matches(text, f"(?U){TRIPLE}"), lambda t: ~t.rlike(r"(?i)\A[ivxlcdm]+\z"))).otherwise(none)
    # the letters of a cluster are looked for before the words around them
    clusters = [F.when(_may(text, *c.replace("[kt]", "").split("|"), fold=True) & text.rlike(f"(?iU){c}"), T.all_matches(text, f"(?iU){p}")).otherwise(none) for c, p in zip(("iiv", "iin", "jn|hn|kz|wv", "your[kt]"), CLUSTERS, strict=True)]
    some = F.slice(F.array_distinct(F.concat(triples, *clusters)), 1, 5)
    return _if(F.size(some) > 0, _flag("warning", "format", "SUSPICIOUS_SPELLING", F.concat(F.lit("Found "), _number(F.size(some)), F.lit(" possibly misspelled token(s).")), F.array_join(some, ", ")))


ELEMENTS = (
    ("(?idU)", FILING, "warning", "MISSING_FILING_DATE", "No filing date detected — required element."),
    ("(?U)", COURT, "warning", "MISSING_COURT", "No court name detected — required element."),
    ("(?U)", STATUTE, "warning", "MISSING_STATUTE", "No statutory or constitutional basis detected — required element."),
    ("(?iU)", REMEDY, "info", "MISSING_REMEDY", "No remedy or relief language detected — may need one."),
    ("(?iU)", OUTCOME, "info", "MISSING_OUTCOME", "No disposition or outcome language detected — may need one."),
    ("(?iU)", ACTION, "info", "MISSING_ACTION_TYPE", "Did not specify class vs. individual action — recommended."),
)


#: words of which a text holds one if it has the element; those of the first three in their case, none if there are no such words
ELEMENT_WORDS = {
    "MISSING_COURT": ("Court", "District"),
    "MISSING_STATUTE": ("42 U", "28 U", "Title", "Act", "ADA", "1983", "Amendment", "Protection", "Due Process", "FHA", "IDEA", "FMLA", "RFRA", "FLSA", "§"),
    "MISSING_REMEDY": ("damages", "relief", "declaratory", "compensatory", "punitive", "fees", "restitution", "injunction", "order"),
    "MISSING_OUTCOME": ("dismissed", "granted", "denied", "settled", "affirmed", "reversed", "remanded", "entered", "approved", "certified", "judgment", "court", "class"),
    "MISSING_ACTION_TYPE": ("class", "individual", "pro se"),
}


def element_flags(text: Column, may: Callable[[str], Column] = _always, known: Column | None = None) -> Column:
    """known: whether `may` is not a guess but says itself that an element is missing."""

    def found(mode: str, pattern: str, code: str) -> Column:
        has = _has(text, mode, pattern)
        if code not in ELEMENT_WORDS:
            return has
        return _may(text, *ELEMENT_WORDS[code], fold="i" in mode) & has

    missing = lambda mode, pattern, code: may(code) & (~found(mode, pattern, code) if known is None else known | ~found(mode, pattern, code))
    return F.concat(*[_if(missing(mode, pattern, code), _flag(severity, "element", code, message)) for mode, pattern, severity, code, message in ELEMENTS])


#: checks of which one pass over a batch of texts tells where they can find anything, as bits above the first
SCREENED = ("ending", "mixed", "long", "short", "year", "caption", "numbered", "caps", "sentences", "loop", "meta", "judgement", "tense", "spelling", *[e[3] for e in ELEMENTS])
_BITS = len(SCREENED) + 1
#: patterns without which a check finds nothing, for texts of tabs, line feeds and printable ASCII; for the elements, the pattern itself
_SCREENS = {
    "mixed": "[0-9][A-Za-z]|[A-Za-z][0-9]",
    "long": rf"(?i)\b{YEAR_CUES}\s*,?\s*\b\d{{5,}}\b",
    "short": rf"(?i)(?:{MONTHS}\s+\d{{1,2}},?\s*|\b{DATE_CUES}\s+)\d{{3}}\b",
    "year": rf"(?i)\b{YEAR_CUES}\s*,?\s*\b\d{{4}}\b",
    "caption": f"(?mi){CAPTION}",
    "numbered": f"(?m){NUMBERED_LINES}",
    "caps": CAPS_RUN,
    "meta": rf"(?i){META}",
    "judgement": r"\bjudgement\b",
    "spelling": "|".join(f"{c}{c}{c}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + "|(?i:iiv|iin|jn|hn|kz|wv|your[kt])",
} | {code: ("(?i)" if "i" in mode else "") + pattern for mode, pattern, _, code, _ in ELEMENTS}


def _repeated(rows: np.ndarray, keys: np.ndarray, times: int) -> np.ndarray:
    """Rows in which a key occurs so many times; by chance perhaps some others."""
    both = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    both ^= both >> np.uint64(29)
    at = np.sort(both)
    often = at[times - 1 :][at[times - 1 :] == at[: len(at) - times + 1]]
    return np.unique(rows[np.isin(both, often)]) if len(often) else rows[:0]


def _split(parts: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    flat = parts.flatten()
    return np.repeat(np.arange(len(parts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False)), flat


def screened(texts: pa.Array) -> pa.Array:
    """For each text the number of its words, above bits that say which checks may find something. The first bit and all others are
    set for texts that hold anything but tabs, line feeds and printable ASCII: of these nothing is known, and they count no words."""
    simple = pc.match_substring_regex(texts, r"\A[\t\n -~]*\z")
    x = pc.if_else(simple, texts, pa.scalar("", texts.type))
    n = len(x)
    found = {check: pc.match_substring_regex(x, pattern).to_numpy(zero_copy_only=False) for check, pattern in _SCREENS.items()}
    found |= {code: ~found[code] for *_, code, _ in ELEMENTS}
    closed = pc.and_not(pc.match_substring_regex(x, r"[.!?\"')\]]\s*\z"), pc.match_substring_regex(x, r"\.\.\s*\z"))
    found["ending"] = ~closed.to_numpy(zero_copy_only=False)
    now = pc.count_substring_regex(x, PRESENT)
    found["tense"] = pc.and_(pc.greater_equal(now, 3), pc.greater(now, pc.count_substring_regex(x, PAST))).to_numpy(zero_copy_only=False)
    found |= {"sentences": np.zeros(n, bool), "loop": np.zeros(n, bool)}
    rows, parts = _split(pc.split_pattern(pc.replace_substring_regex(x, r"([.!?])\s+", "\\1\x01"), "\x01"))
    parts = pc.ascii_trim_whitespace(parts)
    long = pc.greater(pc.binary_length(parts), 40).to_numpy(zero_copy_only=False)
    found["sentences"][_repeated(rows[long], parts.filter(pa.array(long)).dictionary_encode().indices.to_numpy(), 2)] = True
    rows, words = _split(pc.ascii_split_whitespace(x))
    some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    rows, codes = rows[some], words.filter(pa.array(some)).dictionary_encode().indices.to_numpy().astype(np.uint64)
    counts = np.bincount(rows, minlength=n)
    if len(rows) >= 24:
        grams = np.zeros(len(rows) - 7, np.uint64)
        for j in range(8):
            grams = grams * np.uint64(0x100000001B3) + codes[j : len(codes) - 7 + j] + np.uint64(1)
        within = (rows[:-7] == rows[7:]) & (counts[rows[:-7]] >= 24)
        found["loop"][_repeated(rows[:-7][within], grams[within], 3)] = True
    bits = counts.astype(np.int64) << _BITS
    for i, check in enumerate(SCREENED, 1):
        bits |= found[check].astype(np.int64) << i
    return pa.array(np.where(simple.to_numpy(zero_copy_only=False), bits, (1 << _BITS) - 1))


def _screen(text: Column) -> Column:
    return F.arrow_udf(screened, "long")(text)

def reference_flags(n: Column, reference: Column, k: Knobs) -> Column:
    m = T.n_words(reference)
    ratio = n / F.nullif(m, F.lit(0))
    shown = F.concat(F.lit("ratio="), F.format_string("%.2f", ratio))
    low = _flag("warning", "metric", "LENGTH_TOO_SHORT_VS_REF", F.concat(F.format_string("Summary is %.0f%%", ratio * 100), F.lit(" of reference length — likely missing required content.")), shown)
    high = _flag("warning", "metric", "LENGTH_TOO_LONG_VS_REF", F.concat(F.format_string("Summary is %.1f", ratio), F.lit("× reference length — likely padded.")), shown)
    return F.when(ratio < k.least_ratio, F.array(low)).when(ratio > k.most_ratio, F.array(high)).otherwise(_none())


def _threshold_flags(score: Column, crit: float, warn: float, code: str, name: str, what: tuple[str, str]) -> Column:
    shown = F.format_string(f"{name}=%.3f", score)
    make = lambda severity, text: F.array(_flag(severity, "metric", code, F.concat(shown, F.lit(text)), shown))
    return F.when(score < crit, make("critical", what[0])).when(score < warn, make("warning", what[1])).otherwise(_none())


def score_flags(rouge: Column, bertscore: Column, k: Knobs) -> Column:
    """Flags of low overlap with, and low similarity to, the reference."""
    low = (" — extremely low overlap with reference.", " — low overlap with reference.")
    weak = (" — below random baseline.", " — weak semantic similarity.")
    return F.concat(
        _threshold_flags(rouge, k.rouge_crit, k.rouge_warn, "LOW_ROUGE", "ROUGE-Lsum", low), _threshold_flags(bertscore, k.bertscore_crit, k.bertscore_warn, "LOW_BERTSCORE", "BERTScore F1", weak)
    )


def judge_flags(overall: Column) -> Column:
    shown = F.concat(F.lit("judge_overall="), overall.cast("string"))
    message = F.concat(F.lit("LLM judge gave overall score "), overall.cast("string"), F.lit("/5."))
    return F.when(overall <= 1, F.array(_flag("critical", "judge", "JUDGE_REJECT", message, shown))).when(overall == 2, F.array(_flag("warning", "judge", "JUDGE_WEAK", message, shown))).otherwise(_none())


def status(flags: Column | str) -> Column:
    has = lambda s: F.exists(_col(flags), lambda f: f["severity"] == s)
    return F.when(has("critical"), "REJECT").when(has("warning"), "REVIEW").otherwise("PASS")


def severity_count(flags: Column | str, severity: str) -> Column:
    return F.size(F.filter(_col(flags), lambda f: f["severity"] == severity))


def top_codes(flags: Column | str, n: int = 3) -> Column:
    """The first n distinct places by severity, then order: their codes."""
    rank = lambda f: F.when(f["severity"] == "critical", 0).when(f["severity"] == "warning", 1).otherwise(2)
    ordered = F.array_sort(F.transform(_col(flags), lambda f, i: F.struct(rank(f).alias("r"), i.alias("i"), f["code"].alias("c"))))
    return F.transform(F.slice(ordered, 1, n), lambda x: x["c"])


def report(df: DataFrame, prediction: str = "prediction", reference: str | None = "reference", ids: Sequence[str] = ("case_id", "index"), k: Knobs = Knobs()) -> DataFrame:
    """Adds identifier, word_count, metrics, flags and status. Metrics named rougeLsum, bertscore_f1 and judge_* are taken from
    columns of these names where df has them."""
    text = F.coalesce(F.col(prediction), F.lit(""))
    has = set(df.columns)
    double = lambda c: F.col(c).cast("double") if c in has else F.lit(None).cast("double")
    known = [c for c in ids if c in has]
    # texts are looked through in batches first; a check is made only where it can find something
    seen, at = F.col("__screen"), {check: i for i, check in enumerate(SCREENED, 1)}
    may = lambda check: seen.bitwiseAND(1 << at[check]) != 0
    only = lambda check, flags: F.when(may(check), flags).otherwise(_none())
    plain = seen.bitwiseAND(1) == 0
    df = df.withColumn("__screen", _screen(text))
    df = df.withColumn("word_count", F.when(plain, F.shiftright(seen, _BITS).cast("int")).otherwise(T.n_words(text)))
    df = df.withColumn("__tokens", F.when(may("loop"), T.words(text)).otherwise(F.array().cast("array<string>"))).withColumn("__raw", F.when(may("caption") | may("numbered") | may("caps"), without_header(text)))
    n = F.col("word_count")
    checks = [
        length_flags(n, k), only("ending", ending_flags(text)), date_flags(text, k, may, plain), artifact_flags(F.col("__raw"), may), repetition_flags(text, F.col("__tokens"), may),
        only("meta", meta_flags(text)), style_flags(text, may), only("spelling", spelling_flags(text)), element_flags(text, may, plain),
    ]
    ratio = F.lit(None).cast("double")
    if reference in has:
        given = F.coalesce(F.col(reference), F.lit("")) != ""
        ratio = F.when(given, n / F.nullif(T.n_words(F.col(reference)), F.lit(0)))
        gate = lambda c: F.when(given, c).otherwise(_none())
        checks.append(gate(reference_flags(n, F.col(reference), k)))
        checks.append(gate(score_flags(double("rougeLsum"), double("bertscore_f1"), k)))
    checks.append(judge_flags(double("judge_overall")))
    metrics = F.struct(ratio.alias("length_ratio"), *[double(c).alias(c) for c in ("rouge1", "rouge2", "rougeL", "rougeLsum", "bertscore_f1", *JUDGE_FIELDS)])
    out = df.withColumn("flags", F.concat(*checks)).withColumn("metrics", metrics).withColumn("status", status("flags"))
    position = F.monotonically_increasing_id()
    return out.withColumn("identifier", identifier(*known, position=position) if known else position.cast("string")).drop("__screen", "__tokens", "__raw")


def quick_report(df: DataFrame, text: str, k: Knobs = Knobs()) -> DataFrame:
    """Only length, ending and repetition: the checks that need no legal text."""
    c = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__tokens", T.words(c)).withColumn("word_count", F.size("__tokens"))
    flags = F.concat(length_flags(F.col("word_count"), k), ending_flags(c), repetition_flags(c, F.col("__tokens")))
    return df.withColumn("flags", flags).withColumn("status", status("flags")).drop("__tokens")


def csv_rows(reports: DataFrame) -> DataFrame:
    """The twelve columns of the CSV sink; a missing metric is ''."""
    metric = lambda c: F.coalesce(F.col(f"metrics.{c}").cast("string"), F.lit("")).alias(c)
    return reports.select(
        "identifier", "status", "word_count", severity_count("flags", "critical").alias("n_critical"), severity_count("flags", "warning").alias("n_warning"), severity_count("flags", "info").alias("n_info"),
        F.array_join(top_codes("flags", 5), " | ").alias("flags"), metric("length_ratio"), metric("rougeLsum"), metric("bertscore_f1"), metric("judge_overall"),
        T.no_breaks(F.left(F.coalesce("prediction", F.lit("")), F.lit(120))).alias("preview"),
    )


def code_counts(reports: DataFrame) -> DataFrame:
    """Flags and distinct records by code, with the severity of its first and of its last place."""
    # the outer form: else Spark makes the flags once more, to see that there are any
    # messages and evidence are left behind before each flag becomes a row
    short = F.transform("flags", lambda f: F.struct(f["severity"].alias("severity"), f["code"].alias("code")))
    each = reports.select("identifier", short.alias("flags")).select("identifier", F.posexplode_outer("flags").alias("at", "f")).where("at is not null")
    place = F.struct("identifier", "at")
    return each.groupBy(F.col("f.code").alias("code")).agg(
        F.count(F.lit(1)).alias("flags"), F.count_distinct("identifier").alias("records"), F.min_by("f.severity", place).alias("first_severity"), F.max_by("f.severity", place).alias("last_severity")
    )


def status_counts(reports: DataFrame, *by: str) -> DataFrame:
    """Records by status and their share of all; a missing status counts as UNKNOWN."""
    counts = reports.groupBy(*by, F.coalesce("status", F.lit("UNKNOWN")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return counts.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def search(reports: DataFrame, needle: str) -> DataFrame:
    """Reports whose identifier, status or codes contain the text, in any case."""
    codes = F.array_join(F.transform("flags", lambda f: f["code"]), " ")
    return reports.where(F.lower(F.concat_ws(" ", "identifier", "status", codes)).contains(needle.lower()))
