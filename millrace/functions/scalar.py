"""Dates, identifiers, hashes, costs and judge replies as Column builders. The session's time zone is taken to be UTC."""

from __future__ import annotations

import datetime
import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import _col, strip


def timestamp_or_null(c: Column | str) -> Column:
    """An ISO date or date-time; null where it is neither."""
    return F.try_to_timestamp(F.when(_col(c) != "", _col(c)))


def timestamp_strict(c: Column | str) -> Column:
    """Null stays null; what is no ISO date-time is an error."""
    return F.to_timestamp(_col(c))


def date_prefix(c: Column | str) -> Column:
    return F.substring(_col(c), 1, 10)


def first_token(c: Column | str) -> Column:
    return F.split_part(_col(c), F.lit(" "), F.lit(1))


def bare_token(c: Column | str) -> Column:
    """An API token without white space around it and without a leading word "token"; blank and null give ''."""
    return F.coalesce(strip(F.regexp_replace(strip(c), r"(?iU)\Atoken\s+", "")), F.lit(""))


def key16(title: Column | str, body: Column | str) -> Column:
    """The first 16 hex digits of SHA-256 over the title, a bar, and the first 2000 code points of the body."""
    return F.substring(F.sha2(F.concat(_col(title), F.lit("|"), F.left(_col(body), F.lit(2000))).cast("binary"), 256), 1, 16)


def identifier(*cs: Column | str, position: Column) -> Column:
    """The first of the columns that is neither null, '' nor 0, else the position; as text, '?' for ''."""
    usable = [F.when(~_col(c).cast("string").isin("", "0", "0.0"), _col(c).cast("string")) for c in cs]
    got = F.coalesce(*usable, position.cast("string"))
    return F.when(got == "", "?").otherwise(got)


def _plain(value):
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def canonical(text: str | None) -> str | None:
    """JSON with sorted keys, no spaces and ASCII escapes. Spark's own writer keeps the order of the schema and does not escape,
    so this is one of the few functions that run in Python."""
    return None if text is None else json.dumps(_plain(json.loads(text)), sort_keys=True, separators=(",", ":"))


canonical_json = F.udf(canonical, StringType(), useArrow=True)


def payload_hash(text: str) -> str:
    return hashlib.sha256(canonical(text).encode()).hexdigest()


# USD for a million tokens.
PRICES = {
    "claude-opus-4-5": (15.00, 75.00, 1.50),
    "claude-sonnet-4-5": (3.00, 15.00, 0.30),
    "claude-haiku-4-5": (1.00, 5.00, 0.10),
    "claude-3-5-sonnet-latest": (3.00, 15.00, 0.30),
    "claude-3-5-haiku-latest": (0.80, 4.00, 0.08),
}


def usage_cost(model: Column | str, tokens_in: Column | str, tokens_out: Column | str, cache_read: Column | str, cache_write: Column | str) -> Column:
    """Writing the cache costs a quarter more than input. Null for a model without a price; null counts are 0."""
    prices = F.create_map(*[F.lit(x) for k, v in PRICES.items() for x in (k, F.array(*map(F.lit, v)))])
    p = F.try_element_at(prices, _col(model))
    count = lambda c: F.coalesce(_col(c), F.lit(0))
    return (count(tokens_in) * p[0] + count(tokens_out) * p[1] + count(cache_read) * p[2] + count(cache_write) * p[0] * 1.25) / 1e6


def judge_reply(c: Column | str) -> Column:
    """A judge's reply as a variant: a fence of ``` goes; if the rest is no JSON, its first {...} without inner braces counts."""
    text = strip(c)
    fenced = strip(F.regexp_replace(F.regexp_replace(text, r"\A```[^\n]*\n", ""), r"(?s)```(?!.*```).*\z", ""))
    body = F.when(text.startswith("```"), fenced).otherwise(text)
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(F.regexp_extract(body, r"(?s)\{[^{}]*\}", 0)))


def backoff_seconds(attempt: Column | str, base: float, most: float, jitter: Column) -> Column:
    """min(base * 2^attempt + jitter, most), jitter being drawn from [0, base]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(base) * F.pow(F.lit(2.0), _col(attempt)) + jitter, F.lit(most)))
