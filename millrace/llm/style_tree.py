"""Operator 10: main text of web pages by site style trees (after Yi, Liu & Li 2003).

Pages of a host are parsed into elements, tolerant of unclosed and misnested tags, and merged into one style tree: a node is a
path of element styles (tag, class, id; digits made equal). A node's presentation importance is the entropy of the child
sequences it has on the host's pages, its content importance is one less the mean entropy of its sentences over pages: what
every page repeats comes to 0, what is new on each page to 1. Menus and adverts are dealt to pages in turn, so a host repeats
each seldom; a sentence's pages are therefore counted at the same place of all hosts' trees, up to as many as the host itself
has. A node's importance combines its own and its children's. Branches of low importance are removed. Nodes are judged from
PAGES different pages on (equal pages of a host have the weight of one); what fewer have counts as new and is kept.

Names are the second evidence, for what too few pages have and for menus of which each is the only one. Elements whose tag,
role or class says menu, header, footer, sidebar, notice, advert, form or comments have no importance, at every number of
pages. Where a page marks its article or main part, what lies outside has none either, and within it only what nearly all
pages of the host repeat goes (importance below LOW_INSIDE, other hosts left out: articles that many hosts copy stay). An
element around the only main part is not removed for its class or for being a form, nor is a form that holds most of the
page's prose. `names=False` leaves all this to the tree.

Blocks are cut at block-level tags; character references are decoded, white space becomes one space, blocks are joined by an
empty line.

Defined results: a null, empty or tagless html gives what text it holds, or ''; scripts, styles and comments end at their own
end tag, or with the page; pages without a host in their url are judged alone; repeated pages get the same text; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: importance below which a branch goes, outside and inside of a marked article, and the different pages that must have an element
#: for it to be judged
LOW, LOW_INSIDE = 0.4, 0.1
PAGES = 8
#: weight of a node's children against its own presentation, by number of its presentations
GAMMA = 0.9

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr br label input".split()
)
#: an opening tag of the key closes open elements of the value
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody"), "body": ("head",),
}
#: such an element hides those outside of it from CLOSES
FENCES = frozenset("ul ol dl table select article section div main body blockquote form nav aside header footer".split())
#: opening tags that end a paragraph
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
DROPPED = frozenset("head title noscript template iframe object svg math canvas audio video button select textarea datalist applet map frameset noframes".split())
#: tags that name boilerplate
CHROME = frozenset("nav footer aside form dialog menu".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation topnav breadcrumb breadcrumbs "
    "footer foot header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login register "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget toolbar pagination pager skip search copyright".split()
)
REPLIES = frozenset("comment comments commentlist disqus reply replies respond".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd blockquote pre td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

#: classes that speak of what is beside or missing: with-sidebar, has-ads, no-menu
_MODIFIER = re.compile(r"(?:^|\s)(?:with|has|no|without|is|not)[-_][\w-]*")
#: what remains of an opening tag after its name, attribute values in quotes included
_REST = re.compile(r"""(?>[^>=]+|=\s*(?:"[^"]*"|'[^']*')|=)*+>""")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style")}
_ATTR = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_SENTENCE = re.compile(r"(?<=[.!?;:|\u00b7\u2022]) ")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("article", "boiler", "children", "fixed", "holds", "mark", "name", "own", "path", "tag", "up")

    def __init__(self, tag: str, name: str, path: int, up: Node | None, own: bool, fixed: bool, mark: bool):
        #: up: the element around; own: name or attributes mark boilerplate; fixed: the tag itself does; mark: they mark the main part
        self.tag, self.name, self.path, self.up, self.own, self.fixed, self.mark = tag, name, path, up, own, fixed, mark
        self.children: list[str] = []
        #: holds: an element within is marked; boiler, article: it lies in boilerplate, in the main part
        self.holds = self.boiler = self.article = False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """Of a page: ("text", text, ""), ("open", tag, attributes) and ("close", tag, ""). Comments, declarations, scripts and
    styles are left out. Every character is looked at a bounded number of times, however broken the page."""
    at, text, last, broken = 0, 0, page.rfind(">"), False
    while True:
        i = page.find("<", at)
        if i < 0:
            break
        if i > last and (page.startswith("<!--", i) or _NAME.match(page, i + 1 + page.startswith("</", i))):  # cut off within a tag
            page = page[:i]
            break
        end, out = -1, None
        after = page[i + 1 : i + 2]
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = len(page) if end < 0 else end + 3
        elif after in ("!", "?"):
            end = page.find(">", i) + 1
        else:
            close = after == "/"
            m = _NAME.match(page, i + 1 + close)
            if m:
                tag = m[0].lower()
                rest = None if broken else _REST.match(page, m.end())
                broken = broken or rest is None  # quotes that never end: from now on the next > ends a tag
                end = rest.end() if rest else page.find(">", m.end()) + 1
                out = ("close", tag, "") if close else ("open", tag, page[m.end() : end - 1])
                if not close and tag in _RAW_END:
                    stop, out = _RAW_END[tag].search(page, end), None
                    end = stop.end() if stop else len(page)
        if end <= i:
            at = i + 1
            continue
        if i > text:
            yield "text", page[text:i], ""
        if out:
            yield out
        at = text = end
    if text < len(page):
        yield "text", page[text:], ""


class Parser:
    """Turns pages into blocks; keeps what it has worked out of tags met before. names: whether names and marks count."""

    def __init__(self, names: bool = True) -> None:
        self.names = names
        self.styles: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}
        self.paths: dict[tuple[int, str], int] = {}

    def style(self, tag: str, attrs: str) -> tuple[str, bool, bool, bool]:
        """Of an opening tag: its style, whether name or attributes mark boilerplate, whether the tag alone does for certain, and
        whether they mark the main part."""
        got = self.styles.get((tag, attrs))
        if got is None:
            found = {k.lower(): (a or b or c) for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
            names = " ".join(_MODIFIER.sub(" ", found.get(k, "")) for k in ("class", "id"))
            words = set(_SPLIT.split(_CAMEL.sub(" ", names).lower()))
            role = found.get("role", "").strip().lower()
            hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
            main = tag in ("article", "main") or role in ("main", "article")
            # a reader's comment is often an article of its own; other words on a main part tell what it has, not what it is
            named = bool(words & (REPLIES if main else WORDS)) and tag not in ("html", "body")
            fixed = hidden or tag in DROPPED
            boiler = fixed
            if self.names:
                fixed = fixed or (tag in CHROME and tag != "form")
                boiler = fixed or tag == "form" or (role in ROLES and not main) or named
            name = tag + "".join(f"{mark}{re.sub(r'[0-9]+', '0', v)}" for mark, v in ((".", found.get("class", "")), ("#", found.get("id", "")), ("@", role)) if v)
            if len(self.styles) > 50_000:
                self.styles.clear()
            got = self.styles[tag, attrs] = (name, boiler, fixed, self.names and main and not boiler)
        return got

    def below(self, path: int, name: str) -> int:
        got = self.paths.get((path, name))
        if got is None:
            from xxhash import xxh64_intdigest

            if len(self.paths) > 50_000:
                self.paths.clear()
            got = self.paths[path, name] = xxh64_intdigest(f"{path}>{name}") >> 1
        return got

    def parse(self, page: str) -> tuple[list[tuple[Node, str]], list[Node]]:
        """Blocks (innermost block-level element, text), and all block-level elements, the page first, in order."""
        root = Node("", "", 0, None, False, False, False)
        nodes, blocks, parts = [root], [], []
        stack: list[Node | str] = [root]  # block-level elements, and the tags of inline ones
        within: list[Node] = [root]  # of these, the block-level elements
        inline_open: list[Counter] = [Counter()]  # of each open block-level element: inline tags open directly in it
        block_open: Counter = Counter()
        fenced: list[Counter] = [Counter()]  # block-level tags open since each of the open fences

        def flush() -> None:
            if parts:
                text = " ".join(html.unescape("".join(parts)).split())
                parts.clear()
                if text:
                    blocks.append((within[-1], text))

        def pop() -> str:
            top = stack.pop()
            if isinstance(top, str):
                inline_open[-1][top] -= 1
                return top
            within.pop()
            inline_open.pop()
            block_open[top.tag] -= 1
            if top.tag in FENCES:
                fenced.pop()
            else:
                fenced[-1][top.tag] -= 1
            return top.tag

        def close(*tags: str) -> None:
            while pop() not in tags:
                pass

        def innermost() -> Node:
            while isinstance(stack[-1], str):  # inline elements end where a block begins
                pop()
            return stack[-1]

        for what, tag, attrs in tokens(page):
            if what == "text":
                parts.append(tag)
                continue
            inline = tag in INLINE
            if tag == "br":
                parts.append("\n")
            elif what == "close":  # closes what is open inside; without its element it is ignored
                if inline:
                    if inline_open[-1][tag]:
                        close(tag)
                else:
                    flush()
                    if block_open[tag]:
                        close(tag)
            elif inline:
                if tag not in VOID:
                    stack.append(tag)
                    inline_open[-1][tag] += 1
            else:
                flush()
                if tag in ENDS_P and fenced[-1]["p"]:
                    close("p")
                if any(fenced[-1][t] for t in CLOSES.get(tag, ())):
                    close(*CLOSES[tag])
                if tag in VOID:
                    continue
                name, own, fixed, mark = self.style(tag, attrs)
                up = innermost()
                node = Node(tag, name, self.below(up.path, name), up, own, fixed, mark)
                up.children.append(name)
                nodes.append(node)
                stack.append(node)
                within.append(node)
                inline_open.append(Counter())
                block_open[tag] += 1
                if tag in FENCES:
                    fenced.append(Counter())
                else:
                    fenced[-1][tag] += 1
        flush()
        self._judge(nodes, blocks)
        return blocks, nodes

    def _judge(self, nodes: list[Node], blocks: list[tuple[Node, str]]) -> None:
        """What lies in boilerplate by its names, and what in the main part. An element around the only main part is no
        boilerplate, unless its tag is; nor is a form around most of the page."""

        def inherit() -> bool:
            found = False
            for n in nodes[1:]:
                within = n.up.article
                own = n.own or (self.names and n.tag == "header" and not within)
                n.boiler = n.up.boiler or (own and not n.holds)
                n.article = not n.boiler and (within or n.mark)
                found = found or n.article
            return found

        if inherit() or not self.names:
            return
        met: set[Node] = set()
        for n in nodes:
            if n.mark:
                while (n := n.up) is not None and n not in met:
                    met.add(n)
                    n.holds = not n.fixed
        if met and inherit():
            return
        form: dict[Node, Node | None] = {nodes[0]: None}
        for n in nodes[1:]:
            form[n] = None if n.fixed else n if n.tag == "form" else form[n.up]
        prose, other, free = Counter(), Counter(), 0
        for n, text in blocks:
            if form[n]:
                (prose if n.tag in PROSE else other)[form[n]] += len(text)
            elif not n.boiler:
                free += len(text)
        for n, k in prose.items():
            n.holds = k > max(free, other[n])
        inherit()


def _counts(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    """Rows (host, up, path, kind, value, n): how many pages have the value (a sequence of children, kind 0, or a sentence, 1) at
    the path, or the path itself (2). Of pages with c copies each counts 1 / c."""
    from xxhash import xxh64_intdigest

    parser = Parser(names)
    for batch in batches:
        count: Counter = Counter()
        for host, page, copies in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), batch.column("copies").to_pylist(), strict=True):
            if not page:
                continue
            blocks, nodes = parser.parse(page)
            seen = {(n.up.path, n.path, 0, xxh64_intdigest(" ".join(n.children)) >> 1) for n in nodes[1:]}
            seen.update((n.up.path, n.path, 2, 0) for n in nodes[1:])
            seen.update((n.up.path if n.up else 0, n.path, 1, xxh64_intdigest(part) >> 1) for n, text in blocks for part in _SENTENCE.split(text))
            for x in seen:
                count[host, *x] += 1 / (copies or 1)
        cols = list(zip(*count, strict=True)) if count else [()] * 5
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(cols, kinds, strict=True)), pa.array(list(count.values()), pa.float64())], ["host", "up", "path", "kind", "value", "n"])


def _importance(nodes: pd.DataFrame) -> pd.DataFrame:
    """Of one host's nodes (up, path, style, styles, content, content_here, rare): the largest importance in the branch of each,
    by either content, children before parents."""
    own = {r.path: r for r in nodes.itertuples()}
    kids: dict[int, list[int]] = {}
    for r in own.values():
        kids.setdefault(r.up, []).append(r.path)
    order = [x for x in own if own[x].up not in own or own[x].up == x]
    for x in order:  # parents before children; grows as it goes
        order += [c for c in kids.get(x, ()) if c != x]

    def largest(content: str) -> list[float]:
        value: dict[int, float] = {}
        most: dict[int, float] = {}
        for x in reversed(order):
            r, below = own[x], [c for c in kids.get(x, ()) if c in value]
            parts = [value[c] for c in below]
            if not np.isnan(getattr(r, content)):
                parts.append(getattr(r, content))
            if r.rare:  # what too few pages have to be judged counts as new
                parts.append(1.0)
            keep = GAMMA ** max(r.styles, 1)
            value[x] = (1 - keep) * r.style + keep * (sum(parts) / len(parts) if parts else r.style)
            # a branch is noise only if all of it is
            most[x] = max([1.0 if r.rare else value[x], *(most[c] for c in below)])
        return [most.get(p, 1.0) for p in nodes["path"]]

    return pd.DataFrame({"host": nodes["host"], "path": nodes["path"], "importance": largest("content"), "here": largest("content_here"), "pages": nodes["pages"]})


def style_tree(pages: DataFrame, names: bool = True) -> DataFrame:
    """host, path, importance, here (importance by what the host alone repeats) and pages (that it was judged over) of all nodes
    that PAGES different pages of the host have. pages has host and html."""
    known = pages.where("host is not null and html is not null")
    known = known.withColumns({"h1": F.xxhash64("html"), "h2": F.xxhash64(F.lit(1), "html")})
    same = ["host", "h1", "h2"]
    each = common.written(known.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), "style-pages")
    known = common.small_join(known.select(*same, "html"), common.written(each.where("copies > 1"), "style-copies"), same)
    counts = known.select("host", "html", "copies").mapInArrow(partial(_counts, names=names), "host string, up bigint, path bigint, kind int, value bigint, n double")
    # rounded, as copies of a page add up to 1 but for the last digits
    counts = common.written(counts.groupBy("host", "up", "path", "kind", "value").agg(F.round(F.sum("n"), 6).alias("n")), "style-counts")
    size = common.written(each.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= PAGES), "style-hosts")
    # sentences that other hosts have at the same place of their trees, with all their pages
    spread = counts.where("kind = 1").groupBy("path", "value").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("hosts")).where("hosts > 1")
    spread = spread.select(F.col("path").alias("at_path"), F.col("value").alias("at_value"), "all")
    ours = common.small_join(counts, size, ["host"], "inner")
    around = ours.where("kind = 2").groupBy("host", F.col("path").alias("up")).agg(F.sum("n").alias("around")).where(F.col("around") >= PAGES)
    around = common.written(around, "style-around")
    at = (F.col("path") == F.col("at_path")) & (F.col("value") == F.col("at_value"))
    ours = ours.where("kind = 1").join(spread, at, "left").drop("at_path", "at_value").unionByName(ours.where("kind <> 1"), allowMissingColumns=True)
    ours = common.small_join(ours, around, ["host", "up"]).withColumn("around", F.coalesce("around", "pages"))
    # presentation: entropy of the shares; content: one less the sentences' mean entropy; both over the pages that have the
    # element around, and content also with the pages of other hosts, as many as make a sentence one of every page
    total = F.sum("n")
    every = F.least(F.log(F.greatest("n", "all")), F.log("around"))
    nodes = ours.groupBy("host", "path", "pages", "kind").agg(
        F.min("up").alias("up"), F.min("around").alias("around"), total.alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum(F.col("n") * every).alias("w"), F.count(F.lit(1)).alias("values")
    )
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    nodes = nodes.groupBy("host", "path", "pages").agg(
        F.min("up").alias("up"), F.min("around").alias("around"), of(0, F.log("t") - F.col("s") / F.col("t")).alias("style"), F.coalesce(of(0, F.col("values")), F.lit(1)).alias("styles"),
        of(1, F.col("w") / F.col("t")).alias("content"), of(1, F.col("s") / F.col("t")).alias("content_here"), F.coalesce(of(2, F.col("t")), F.col("pages")).alias("have"),
    )
    nodes = common.written(nodes, "style-nodes")
    judged, seldom = nodes.where(F.col("have") >= PAGES), nodes.where(F.col("have") < PAGES)
    seldom = seldom.select(F.col("host").alias("in_host"), F.col("up").alias("in_path")).distinct().withColumn("rare", F.lit(True))
    nodes = judged.join(seldom, (F.col("host") == F.col("in_host")) & (F.col("path") == F.col("in_path")), "left")
    nodes = nodes.withColumn("pages", F.col("around").cast("bigint"))
    within = F.log("pages")
    less = lambda c: F.coalesce(1 - F.col(c) / within, F.lit(float("nan"))).alias(c)
    nodes = nodes.select(
        "host", "path", "pages", "up", F.coalesce(F.least(F.col("style") / within, F.lit(1.0)), F.lit(0.0)).alias("style"), "styles", less("content"), less("content_here"), F.coalesce("rare", F.lit(False)).alias("rare")
    )
    return nodes.groupBy("host").applyInPandas(_importance, "host string, path bigint, importance double, here double, pages bigint")


def _texts(batches: Iterator[pa.RecordBatch], names: bool) -> Iterator[pa.RecordBatch]:
    parser = Parser(names)
    for batch in batches:
        out = []
        for page, low in zip(batch.column("html").to_pylist(), batch.column("low").to_pylist(), strict=True):
            if not page:
                out.append("")
                continue
            blocks, nodes = parser.parse(page)
            low = {x["path"]: x["inside"] for x in low or ()}
            main = any(n.article for n, _ in blocks)
            around, gone = set(), set()
            for n in reversed(nodes):  # an element around the main part is not removed for what surrounds it
                if n.article or n in around:
                    around.add(n.up)
            for n in nodes:
                if n.up in gone or n.boiler or (low.get(n.path, False) if n.article else n.path in low and n not in around):
                    gone.add(n)
            kept = [text for n, text in blocks if n not in gone and (n.article or not main)]
            out.append("\n\n".join(kept))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, names: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page. Without names the tree alone decides."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    pages = pages.select("page_id", "url", "html", F.when(F.length(host) > 0, host).alias("host"))
    tree = style_tree(pages, names)
    inside = F.col("here") < LOW_INSIDE
    low = tree.where(F.col("importance") < LOW).groupBy("host").agg(F.collect_list(F.struct("path", inside.alias("inside"))).alias("low"))
    low = common.written(low, "style-low")
    n = low.agg(F.coalesce(F.sum(F.size("low")), F.lit(0)).alias("n")).first()["n"]
    kinds = dict(pages.dtypes)
    joined = common.small_join(pages, low, ["host"], n=n).select("page_id", "url", "html", "low")
    return joined.mapInArrow(partial(_texts, names=names), f"page_id {kinds['page_id']}, url string, text string, n_chars bigint")
