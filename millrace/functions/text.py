"""Text functions as Column builders. White space, word characters and lengths are those of Unicode code points, so that results
do not depend on the script of a text; lines end at \\n, \\r, \\r\\n, \\v, \\f, the separators \\x1c-\\x1e, \\x85, \\u2028 and \\u2029."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: one character of white space, for patterns with the flag U
WS = r"[\s\x1c-\x1f]"
#: the same characters one by one, for functions that take no pattern
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once: inside a lambda an expression is evaluated again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(SPACES))


def lstrip(c: Column | str) -> Column:
    return F.ltrim(_col(c), F.lit(SPACES))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(SPACES))


def strip_long(c: Column | str) -> Column:
    """strip() of long texts. Trimming more than blanks off the end walks the whole text, so the last byte is looked at before."""
    last = lambda x: F.substring(x.cast("binary"), F.lit(-1), F.lit(1))
    return let(F.rtrim(lstrip(c)), lambda x: F.when(last(x).between(F.lit(b"!"), F.lit(b"~")), x).otherwise(rstrip(x)))


def at_most(c: Column, n: int | Column) -> Column:
    """The first n code points; texts of no more bytes are taken as they are, without counting."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(F.octet_length(c) <= n, c).otherwise(F.left(c, n))


def words(c: Column | str) -> Column:
    """The maximal runs without white space."""
    return F.filter(F.split(_col(c), rf"(?U){WS}+"), lambda w: w != "")


def n_words(c: Column | str) -> Column:
    return F.size(words(c))


def sentences(c: Column | str) -> Column:
    """Cut after . ! or ? where white space follows; stripped, without empty ones."""
    # the white space is looked for before what precedes it: few characters are any
    return F.filter(F.transform(F.split(_col(c), rf"(?U){WS}(?<=[.!?]{WS}){WS}*"), strip), lambda s: s != "")


def paragraphs(c: Column | str) -> Column:
    """Cut at each pair of line feeds; stripped, without empty ones."""
    return F.filter(F.transform(F.split(_col(c), "\n\n"), strip), lambda p: p != "")


def lines(c: Column | str) -> Column:
    """Lines of a text; a final line end adds no empty line, and an empty text has none."""
    cut = F.split(_col(c), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(_col(c) == "", F.array().cast("array<string>")).otherwise(let(cut, lambda x: F.when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x)))


def last_line(c: Column | str) -> Column:
    return F.try_element_at(lines(c), F.lit(-1))


def head(c: Column | str, n: int | Column) -> Column:
    """The first n code points; with n below 0, all but the last -n."""
    c = _col(c)
    n = F.lit(n) if isinstance(n, int) else n
    return F.substring(c, F.lit(1), F.when(n >= 0, n).otherwise(F.greatest(F.length(c) + n, F.lit(0))))


def tail(c: Column | str, n: int) -> Column:
    return F.right(_col(c), F.lit(n))


def tokens_estimate(c: Column | str) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(_col(c)) / 4).cast("int")


def grams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a blank, in order."""

    def runs(t: Column) -> Column:
        count = F.size(t) - (n - 1)
        at = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(t, i + (j - 1)) for j in range(n)]))

    return let(tokens, runs)


def first_sentences(c: Column | str, n: int) -> Column:
    """The first n sentences, met paragraph by paragraph."""
    return F.slice(F.flatten(F.transform(paragraphs(strip(c)), sentences)), 1, n)


def or_else(*cs: Column | str) -> Column:
    """The first that is neither null nor empty; the last as it is."""
    *first, last = (_col(c) for c in cs)
    return F.coalesce(*[F.when(c != "", c) for c in first], last)


def no_breaks(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\n"), F.lit(" "))


def escape_html(c: Column | str) -> Column:
    c = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def elide(c: Column | str, limit: int = 700_000) -> Column:
    """Texts longer than limit keep their head and tail around a note of what is left out."""
    c = _col(c)
    half = limit // 2
    note = F.concat(F.lit("\n\n[... "), F.format_string("%,d", F.length(c) - limit), F.lit(" characters elided to fit context window ...]\n\n"))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.left(c, F.lit(half)), note, F.right(c, F.lit(limit - half))))


def count_regex(c: Column | str, pattern: str) -> Column:
    return F.regexp_count(_col(c), F.lit(pattern))


def all_matches(c: Column | str, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(group))


def first_match(c: Column | str, pattern: str, group: int = 0) -> Column:
    """Null where the pattern is not found."""
    return F.when(_col(c).rlike(pattern), F.regexp_extract(_col(c), pattern, group))
