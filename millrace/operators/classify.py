"""Tiers of case documents and the routing of documents to extraction prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import _col, let, strip

# Patterns of the tiers, searched in "title type" in lower case.
TIER_1 = (
    "opinion", "order", "judgment", "decree", r"consent\s+decree", "settlement", r"appellate\s+decision", r"usca\s+opinion", r"per\s+curiam", r"memorandum\s+(opinion|decision)",
    r"report\s+and\s+recommendation", r"findings?\s+(of\s+fact|letter)",
)
TIER_4 = ("docket", "pacer", "correspondence", "letter", "newsletter", r"press\s+release", "untitled", r"justice\s+department")
TIER_2 = (
    "complaint", r"amended\s+complaint", r"class\s+action\s+complaint", r"motion\s+to\s+dismiss", r"motion\s+for\s+summary\s+judgment", r"class\s+cert",
    r"preliminary\s+injunction", r"temporary\s+restraining", r"brief\s+in\s+support", r"memorandum\s+in\s+(support|opposition)", r"motion\s+for\s+judgment", "answer",
)
LABELS = {1: "PRIMARY", 2: "SUPPORTING", 3: "CONTEXTUAL", 4: "EXCLUDED"}
CHUNK_TIER_1 = "opinion|order|judgment|consent.?decree|settlement"
CHUNK_TIER_4 = "docket|pacer|press.?release|correspondence|newsletter|letter"
#: routes in order: the first with a phrase that occurs
ROUTES = {
    "settlement": ("settlement", "consent decree", "agreed judgment", "stipulated dismissal"),
    "appellate_opinion": ("appellate", "usca", "per curiam", "circuit court", "court of appeals"),
    "class_certification": ("class cert", "class action certification", "motion to certify"),
    "motion_to_dismiss": ("motion to dismiss", "12(b)"),
    "motion_summary_judgment": ("summary judgment", "msj"),
    "district_opinion": ("opinion", "order", "judgment", "memorandum opinion", "memorandum decision", "report and recommendation", "findings"),
    "complaint": ("complaint", "amended complaint"),
    "motion": ("motion", "brief", "memorandum"),
}


def tier(title: Column | str, kind: Column | str | None = None) -> Column:
    """1 to 4. Tier 1 is tried first, then 4, then 2; whatever remains is 3, an empty title and type 4."""
    kind = F.lit("") if kind is None else F.coalesce(_col(kind), F.lit(""))
    found = lambda text, patterns: text.rlike("(?U)" + "|".join(patterns))
    return let(
        F.lower(strip(F.concat(F.coalesce(_col(title), F.lit("")), F.lit(" "), kind))),
        lambda text: F.when(text == "", 4).when(found(text, TIER_1), 1).when(found(text, TIER_4), 4).when(found(text, TIER_2), 2).otherwise(3),
    )


def tier_label(t: Column | str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), _col(t))


def chunk_tier(kind: Column | str) -> Column:
    """Of a source chunk, by its type alone: 1, 4, or else 2."""
    return F.when(_col(kind).rlike(f"(?iU){CHUNK_TIER_1}"), 1).when(_col(kind).rlike(f"(?iU){CHUNK_TIER_4}"), 4).otherwise(2)


def route(title: Column | str, kind: Column | str) -> Column:
    """Name of the extraction prompt for a document."""
    text = F.lower(F.concat(_col(title), F.lit(" "), _col(kind)))
    out = None
    for name, phrases in ROUTES.items():
        hit = text.contains(phrases[0])
        for x in phrases[1:]:
            hit = hit | text.contains(x)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("default")
