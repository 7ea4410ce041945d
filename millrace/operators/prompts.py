"""Prompt building under a token budget: three strategies, each a projection of one row to one row (no shuffle)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalar import date_prefix, key16
from .classify import tier_label
from .parse import MARK, case_name, documents, extract, preamble

# Wording of the prompts.
TASK = "Summarize the following legal case materials into a concise case summary. Focus on the dispute, major procedural posture, key rulings or events, and the current or final outcome when available."
STRUCTURED_TASK = (
    "### Instructions\nWrite a concise case summary in past tense covering: the dispute and stakes, filing date and court, whether class or individual action, type of counsel, legal claims and "
    "statutory basis, key procedural events, and outcome or current status."
)
EXTRACTS_TASK = (
    "### Instructions\nUsing ONLY the extracted information above, write a concise case summary in past tense covering: the dispute and stakes, filing date and court, whether class or individual "
    "action, type of counsel, legal claims and statutory basis, key procedural events, and outcome or current status."
)
EXTRACTS_INTRO = "The following are extracted key facts from court documents in this case. Documents are ordered by importance (PRIMARY first).\n"


def shares(tokens: Column, total: Column, budget: Column, least: int = 200) -> Column:
    """A document's proportional share of a budget that all do not fit in, `least` at least."""
    return F.greatest(F.floor(budget * (tokens / total)).cast("int"), F.lit(least))


def first_fit(docs: Column, budget: Column, cut_only_below: bool) -> Column:
    """A fold over (pos, tier, tokens) in order: what fits is taken, what does not is passed over, and later, smaller documents
    may still be taken. A first-tier document that does not fit is cut to what is left, which uses up the budget; with
    cut_only_below only while something is left. Gives used, taken (pos, chars or -1) and passed (pos)."""
    zero = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<pos:int,chars:int>>").alias("taken"), F.array().cast("array<int>").alias("passed"))

    def step(a: Column, d: Column) -> Column:
        fits = a["used"] + d["tokens"] <= budget
        cut = ~fits & (d["tier"] == 1) & ((a["used"] < budget) if cut_only_below else F.lit(True))
        take = F.struct(d["pos"].cast("int").alias("pos"), F.when(fits, -1).otherwise((budget - a["used"]) * 4).cast("int").alias("chars"))
        return F.struct(
            F.when(fits, a["used"] + d["tokens"]).when(cut, budget).otherwise(a["used"]).cast("int").alias("used"),
            F.when(fits | cut, F.array_append(a["taken"], take)).otherwise(a["taken"]).alias("taken"),
            F.when(fits | cut, a["passed"]).otherwise(F.array_append(a["passed"], d["pos"].cast("int"))).alias("passed"),
        )

    return F.aggregate(docs, zero, step)


def prefix(docs: Column, budget: Column, least: int, size: Callable[[Column], Column]) -> Column:
    """What is shown of documents in order until the budget is used up: structs (d, n, chars), n being a document's size and chars
    -1. The first that does not fit is cut to the rest (in characters) if that is over `least`; later, empty ones may follow."""
    zero = F.struct(F.lit(0).alias("b"), F.array().cast("array<int>").alias("all"))
    sums = lambda sizes: F.aggregate(sizes, zero, lambda a, x: F.struct((a["b"] + x).alias("b"), F.array_append(a["all"], a["b"]).alias("all")))["all"]
    chars = lambda b, n: F.when(b + n <= budget, -1).when((b <= budget) & (budget - b > least), (budget - b) * 4)
    placed = T.let(F.transform(docs, size), lambda sizes: F.zip_with(F.arrays_zip(docs.alias("d"), sizes.alias("n")), sums(sizes), lambda x, b: F.struct(x["d"].alias("d"), x["n"].alias("n"), chars(b, x["n"]).cast("int").alias("chars"))))
    return F.filter(placed, lambda x: x["chars"].isNotNull())


def proportional(docs: Column, budget: Column) -> Column:
    """first_fit's result for documents that share the budget."""
    cut = lambda d, total: F.when(F.length(d["body"]) > shares(d["tokens"], total, budget) * 4, shares(d["tokens"], total, budget) * 4).otherwise(-1)
    return T.let(
        F.aggregate(docs, F.lit(0), lambda a, d: a + d["tokens"]), lambda total: F.transform(docs, lambda d: F.struct(d["pos"].cast("int").alias("pos"), cut(d, total).cast("int").alias("chars")))
    )


def _select(docs: Column, ordered: Column, budget: Column, cut_only_below: bool) -> tuple[Column, Column]:
    """(taken, passed titles): proportional over the first tier if several such documents overflow the budget alone. `ordered`
    has the documents of tiers 1 to 3, then 4."""
    first = F.filter(ordered, lambda d: d["tier"] == 1)
    over = (F.aggregate(first, F.lit(0), lambda a, d: a + d["tokens"]) > budget) & (F.size(first) > 1)
    fit = first_fit(F.filter(ordered, lambda d: d["tier"] < 4), budget, cut_only_below)
    title = lambda p: F.get(docs, p)["title"]
    last = F.transform(F.filter(ordered, lambda d: d["tier"] == 4), lambda d: d["title"])
    rest = F.transform(F.filter(ordered, lambda d: d["tier"].isin(2, 3)), lambda d: d["title"])
    return F.when(over, proportional(first, budget)).otherwise(fit["taken"]), F.when(over, F.concat(rest, last)).otherwise(F.concat(F.transform(fit["passed"], title), last))


def _body(docs: Column, t: Column) -> Column:
    body = F.get(docs, t["pos"])["body"]
    return F.when(t["chars"] == -1, body).otherwise(F.concat(T.head(body, t["chars"]), F.lit(MARK)))


def _by(docs: Column, *keys: Callable[[Column], Column]) -> Column:
    """Documents in order of keys, then of their places."""
    keyed = F.transform(docs, lambda d: F.struct(*[k(d).alias(f"k{i}") for i, k in enumerate(keys)], d["pos"].alias("p"), d.alias("d")))
    return F.transform(F.array_sort(keyed), lambda x: x["d"])


def _dated(docs: Column) -> Column:
    return _by(docs, lambda d: d["tier"], lambda d: F.when(d["date"] == "", "9999-99-99").otherwise(date_prefix(d["date"])))


def _with_docs(df: DataFrame) -> DataFrame:
    if "__docs" in df.columns:
        return df
    p = F.col("prompt")
    return df.withColumns({"__docs": documents(p), "__case": case_name(p), "__pre": preamble(p)})


def _tier_counts() -> Column:
    count = lambda t: F.size(F.filter("__docs", lambda d: d["tier"] == t)).alias(f"tier_{t}")
    return F.struct(*[count(t) for t in (1, 2, 3, 4)])


def priority_filter(df: DataFrame, max_tokens: int = 24_000, pack: bool | Sequence[str] = False) -> DataFrame:
    """Documents by tier, in their order within a tier, after the task. Adds the columns of the strategy's report."""
    df = _with_docs(df)
    room = F.lit(max_tokens) - (T.tokens_estimate("__pre") + 200)
    budget = F.when(room < 500, max_tokens).otherwise(room).cast("int")
    df = df.withColumn("__ordered", _by(F.col("__docs"), lambda d: d["tier"])).withColumn("__budget", budget)
    taken, passed = _select(F.col("__docs"), F.col("__ordered"), F.col("__budget"), False)
    df = df.withColumn("__taken", taken).withColumn("excluded_doc_types", passed)

    def part(t: Column) -> Column:
        d = F.get(F.col("__docs"), t["pos"])
        line = lambda name, c: F.when(c != "", F.concat(F.lit(f"\n{name}: "), c)).otherwise("")
        return F.concat(F.lit("\n[DOCUMENT]\nTitle: "), d["title"], line("Type", d["doc_type"]), line("Date", d["date"]), F.lit("\n\n"), _body(F.col("__docs"), t))

    head = F.array(F.lit(TASK), F.concat(F.lit("\nCase: "), F.col("__case"), F.lit("\n")))
    built = F.array_join(F.concat(head, F.transform("__taken", part)), "\n")
    return _finished(df, built, "priority_filter", F.size("__docs") - F.size("__taken"), pack, tier_counts=_tier_counts())


#: entries that a timeline shows
TIMELINE = 15


def structured(df: DataFrame, max_tokens: int = 24_000, pack: bool | Sequence[str] = False, timeline: int | None = TIMELINE) -> DataFrame:
    """Documents by tier and date, after a timeline of the first dated documents (None: of all), before the task."""
    df = _with_docs(df).withColumn("__ordered", _dated(F.col("__docs")))
    budget = F.lit(max_tokens - 500)
    taken, passed = _select(F.col("__docs"), F.col("__ordered"), budget, True)
    df = df.withColumn("__taken", taken).withColumn("excluded_doc_types", passed)
    dated = F.filter("__ordered", lambda d: (d["date"] != "") & (d["tier"] <= 3))
    times = F.transform(dated, lambda d: F.concat(F.lit("- "), date_prefix(d["date"]), F.lit(": "), F.left(d["title"], F.lit(80))))
    df = df.withColumn("__times", times)

    def part(t: Column) -> Column:
        d = F.get(F.col("__docs"), t["pos"])
        date = F.when(d["date"] != "", F.concat(F.lit(", "), date_prefix(d["date"]))).otherwise("")
        return F.concat(F.lit("#### ["), tier_label(d["tier"]), F.lit("] "), F.left(d["title"], F.lit(80)), date, F.lit("\n"), _body(F.col("__docs"), t), F.lit("\n"))

    empty = F.array().cast("array<string>")
    line = F.when(F.size("__times") > 0, F.concat(F.array(F.lit("### Case Timeline")), F.slice("__times", 1, timeline) if timeline else F.col("__times"), F.array(F.lit("")))).otherwise(empty)
    head = F.array(F.concat(F.lit("## Case: "), F.col("__case"), F.lit("\n")))
    built = F.array_join(F.concat(head, line, F.array(F.lit("### Key Documents (ordered by importance)\n")), F.transform("__taken", part), F.array(F.lit(STRUCTURED_TASK))), "\n")
    return _finished(df, built, "structured", F.size("excluded_doc_types"), pack, timeline_entries=F.size("__times"))


def extract_first(df: DataFrame, max_tokens: int = 24_000, extractor: Callable[[Column], Column] | None = None, cache: DataFrame | None = None, pack: bool | Sequence[str] = False) -> DataFrame:
    """Extracts of the documents of tiers 1 to 3 (without any, of the first three), by tier, until the budget is used up; the
    first that does not fit is cut if over 200 tokens are left. `extractor` makes a document's extract from its struct; `cache`
    (key, extraction, and perhaps seq) has extracts made before, of which the last counts."""
    df = _with_docs(df)
    extractor = extractor or (lambda d: extract(d["body"]))
    some = F.filter("__docs", lambda d: d["tier"] <= 3)
    df = df.withColumn("__some", F.when(F.size(some) > 0, some).otherwise(F.slice("__docs", 1, 3)))
    if cache is not None:
        rows = df.withColumn("__row", F.monotonically_increasing_id())
        each = rows.select("__row", F.explode("__some").alias("d")).withColumn("key", key16("d.title", "d.body"))
        hits = each.join(latest_extracts(cache), "key").groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("d.pos"), "extraction"))).alias("__hits"))
        df = rows.join(hits, "__row", "left").drop("__row")
        found = lambda d: F.try_element_at("__hits", d["pos"])
        df = df.withColumn("cache_hits", F.coalesce(F.size("__hits"), F.lit(0)))
    else:
        found, df = (lambda d: F.lit(None).cast("string")), df.withColumn("cache_hits", F.lit(0))
    made = F.transform(_by(F.col("__some"), lambda d: d["tier"]), lambda d: F.struct(d["title"].alias("title"), d["date"].alias("date"), d["tier"].alias("tier"), F.coalesce(found(d), extractor(d)).alias("x")))
    df = df.withColumn("__made", made)
    shown = prefix(F.col("__made"), F.lit(max_tokens - 300), 200, lambda e: T.tokens_estimate(e["x"]))

    def part(s: Column) -> Column:
        e = s["d"]
        date = F.when(e["date"] != "", F.concat(F.lit(" ("), date_prefix(e["date"]), F.lit(")"))).otherwise("")
        body = F.when(s["chars"] == -1, e["x"]).otherwise(F.concat(T.head(e["x"], s["chars"]), F.lit(MARK)))
        return F.concat(F.lit("### ["), tier_label(e["tier"]), F.lit("] "), F.left(e["title"], F.lit(80)), date, F.lit("\n"), body, F.lit("\n"))

    df = df.withColumn("__shown", shown)
    head = F.array(F.concat(F.lit("## Case: "), F.col("__case"), F.lit("\n")), F.lit(EXTRACTS_INTRO))
    built = F.array_join(F.concat(head, F.transform("__shown", part), F.array(F.lit(EXTRACTS_TASK))), "\n")
    df = df.withColumn("__taken", F.col("__shown")).withColumn("excluded_doc_types", F.lit(None).cast("array<string>"))
    return _finished(df, built, "extract_first", F.lit(None).cast("int"), pack, relevant_docs=F.size("__some"), extracted_docs=F.size("__shown"), cache_hits=F.col("cache_hits"))


def _finished(df: DataFrame, built: Column, strategy: str, excluded: Column, pack: bool | Sequence[str], **more: Column) -> DataFrame:
    """The prompt and the report of a strategy; a prompt without documents stays as it is, with an error. pack: as one struct, so
    that other strategies can work on the same parsed row; names: of these columns alone, and what no column needs is not made."""
    parsed = F.size("__docs") > 0
    out = df.withColumn("__built", F.when(parsed, built).otherwise(F.col("prompt")))
    report = {
        "strategy": F.lit(strategy), "error": F.when(~parsed, "no_docs_parsed"), "total_docs": F.when(parsed, F.size("__docs")),
        "selected_docs": F.when(parsed, F.size("__taken")) if strategy != "extract_first" else F.lit(None).cast("int"), "excluded_docs": F.when(parsed, excluded),
        "excluded_doc_types": F.when(parsed, F.col("excluded_doc_types")), "prompt_tokens_est": F.when(parsed, T.tokens_estimate("__built")),
    }
    more = {k: F.when(parsed, v) for k, v in more.items()}
    if pack:
        used = F.coalesce(more["extracted_docs"] if "extracted_docs" in more else report["selected_docs"], "used_chunk_count", F.lit(0))
        all_of = report | {"used_chunk_count": used, "prompt": F.col("__built")}
        out = out.withColumn(f"__r_{strategy}", F.struct(*[v.alias(k) for k, v in all_of.items() if pack is True or k in pack]))
        return out.select(*df.columns[: df.columns.index("__pre") + 1], *[c for c in out.columns if c.startswith("__r_")])
    out = out.withColumns(report | more)
    return out.withColumn("prompt", F.col("__built")).drop(*[c for c in out.columns if c.startswith("__")])


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"priority_filter": priority_filter, "structured": structured, "extract_first": extract_first}


def _records(records: DataFrame) -> DataFrame:
    rows = records.where(T.strip("response") != "")
    for name, kind in (("split", "string"), ("completion", "string"), ("source_chunk_count", "int"), ("used_chunk_count", "int")):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def prepare(records: DataFrame, strategy: str, max_tokens: int = 24_000, **options) -> DataFrame:
    """Training records (id, case_id, prompt, response, and perhaps split, completion and counts) with new prompts. Records with a
    blank response are left out."""
    out = STRATEGIES[strategy](_records(records), max_tokens, **options)
    used = [F.col(c) for c in ("selected_docs", "extracted_docs", "used_chunk_count") if c in out.columns]
    return _filled(out.withColumn("used_chunk_count", F.coalesce(*used, F.lit(0))))


def rejected(records: DataFrame) -> DataFrame:
    """id and reason of the records that no prompt can be made of, the first reason that holds; the others go through `prepare`."""
    blank = lambda c: F.coalesce(T.strip(c), F.lit("")) == ""
    reason = F.when(blank("response"), "no response").when(blank("prompt"), "no prompt").when(F.size(documents(F.col("prompt"))) == 0, "no documents")
    return records.select("id", reason.alias("reason")).where("reason is not null")


def document_stats(rows: DataFrame, *by: str) -> DataFrame:
    """One row (for each group): documents taken and documents there were, mean and exact median, and the extracts found in a cache
    (0 where the strategy has none)."""
    hits = F.col("cache_hits") if "cache_hits" in rows.columns else F.lit(0)
    total = [c for c in ("relevant_docs", "total_docs") if c in rows.columns]  # where documents were sifted first, those that remained
    rows = rows.withColumns({"used_chunk_count": F.coalesce("used_chunk_count", F.lit(0)), "total_docs": F.coalesce(*total, F.lit(0))})
    return rows.groupBy(*by).agg(
        F.avg("used_chunk_count").alias("mean_taken"), F.median("used_chunk_count").alias("median_taken"), F.avg("total_docs").alias("mean_total"), F.median("total_docs").alias("median_total"),
        F.sum(F.coalesce(hits, F.lit(0))).alias("cache_hits"),
    )


def _filled(out: DataFrame) -> DataFrame:
    return out.withColumns({"split": F.coalesce("split", F.lit("")), "completion": F.coalesce("completion", "response"), "source_chunk_count": F.coalesce("source_chunk_count", F.lit(0))})


def prepare_all(records: DataFrame, max_tokens: int = 24_000, timeline: int | None = TIMELINE, strategies: Sequence[str] = tuple(STRATEGIES), columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each record and strategy, with the columns that all reports have, or those of them that are named. A prompt is parsed
    once; a strategy or text that is not asked for is not made."""
    df = _with_docs(_records(records))
    for name in strategies:
        df = STRATEGIES[name](df, max_tokens, pack=columns or True, **({"timeline": timeline} if name == "structured" else {}))
    keep = [c for c in df.columns if not c.startswith("__") and c not in ("prompt", "used_chunk_count")]
    return _filled(df.select(*keep, F.inline(F.array(*[f"__r_{name}" for name in strategies]))))


def cached(cache: DataFrame, wanted: DataFrame, make: Column) -> DataFrame:
    """A cache of extracts (key, extraction, and seq that orders a key's entries) with what is wanted (key) and missing put in:
    one row a key, the last entry of each, and whether it was made now."""
    have = latest_extracts(cache)
    missing = wanted.select("key").distinct().join(have, "key", "left_anti")
    return have.withColumn("fresh", F.lit(False)).unionByName(missing.select("key", make.alias("extraction"), F.lit(True).alias("fresh")))


def latest_extracts(cache: DataFrame) -> DataFrame:
    """The last extraction of each key, in order of seq if there is one, else of the text."""
    order = F.col("seq") if "seq" in cache.columns else F.col("extraction")
    return cache.groupBy("key").agg(F.max_by("extraction", order).alias("extraction"))


def prepared_stats(rows: DataFrame, budget: int, *by: str) -> DataFrame:
    """One row (for each group): prompt tokens (least, most, mean, median), how many fit the budget, documents taken."""
    t = F.col("prompt_tokens_est")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(t).alias("min_tokens"), F.max(t).alias("max_tokens"), F.avg(t).alias("mean_tokens"), F.median(t).alias("median_tokens"),
        F.count_if(t <= budget).alias("fit"), (100.0 * F.count_if(t <= budget) / F.count(F.lit(1))).alias("fit_pct"), F.avg("used_chunk_count").alias("mean_used"), F.median("used_chunk_count").alias("median_used"),
    )
