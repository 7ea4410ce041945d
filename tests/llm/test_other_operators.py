import collections
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.llm import curves, style_tree, warc_fixity

SF = "/root/testdata/sf0.001"


def nearest(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 20 == 0:
            s = (x * np.array(v, float)).sum(1)
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
    return out


def vectors(spark, n, same=0):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(n, 16)).astype(np.float32)
    v[:same] = v[0]
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [(5001, None), (5002, [0.0] * 16), (5003, [float("nan")] * 16), (5004, [1.0] * 3), (5005, [None] * 16), (None, [1.0] * 16), (5020, [float("inf")] * 16)]
    return rows, spark.createDataFrame([*rows, *bad], "vec_id bigint, embedding array<float>").withColumns({"cell": F.lit(1), "rep": F.lit(2), "score": F.lit(3), "rank": F.lit(0)})


def test_search_is_exact_in_one_cell(spark):
    rows, df = vectors(spark, 300, same=120)
    got: dict = {}
    for r in curves.search(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = nearest(rows, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]] and [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])
    assert curves.search(df.limit(0), F.lit(True)).count() == 0 and curves.search(df.where("vec_id < 3"), F.lit(True)).count() == 6


def test_recall_over_many_cells(spark):
    rows, df = vectors(spark, 3000)
    want = nearest(rows, 20)
    got = {(r.query_id, r.vec_id) for r in curves.search(df, F.col("vec_id") % 20 == 0, curves.Params(cell=256)).collect()}
    assert sum((q, v) in got for q, vs in want.items() for v, _ in vs) / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("more", [{}, {"held": 16 * 48}, {"curves": 64, "dims": 4}])
def test_windows_follow_the_number_of_vectors(spark, more):
    rows, df = vectors(spark, 6000)
    want = nearest(rows, 20)
    got = {(r.query_id, r.vec_id) for r in curves.search(df, F.col("vec_id") % 20 == 0, curves.Params(**{"cell": 16, "curves": 8, **more})).collect()}
    assert sum((q, v) in got for q, vs in want.items() for v, _ in vs) / (20 * len(want)) >= 0.9


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = curves.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body class=x><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div><aside>Side</aside><main><article><h1>A &amp; B</h1>
<p>First <b>bold</b> text<br>after.<p>Second&nbsp;one <!-- <p>gone --> here.<div class="ad">Buy</div><ul><li>one<li>two</ul><form><input>Sign <button>up</button></form>
<table><tr><td>x<td>y</table><section id="comments"><p>nice!</p></section></article></main><div>Related</div><footer>F</footer></body></html>"""


def texts(spark, pages):
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({"host": F.lit("h"), "low": F.lit(1), "path": F.lit(2), "text": F.lit("t")})
    return {r.page_id: r for r in style_tree.extract(df).collect()}


def test_extracts_the_article(spark):
    got = texts(spark, [(1, "http://a.example/x", PAGE), (2, None, None), (3, "no url", ""), (4, "http://a.example/y", "plain &lt;text&gt;"), (5, "http://a.example/z", "<p>open <b>tag"), (5, "http://a.example/z", "<p>open <b>tag")])
    assert got[1].text.split("\n\n") == ["A & B", "First bold text after.", "Second one here.", "one", "two", "x", "y"] and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("", "", "plain <text>", "open tag")


def test_style_tree_removes_what_pages_repeat(spark):
    rng = random.Random(1)
    prose = lambda: " ".join(rng.choice("abcdefghij") * 3 for _ in range(30))
    page = lambda i: f'<body><div class="top"><span>Our site</span></div><div class="c1">{"".join(f"<p>{prose()}</p>" for _ in range(1 + i % 5))}</div><div class="end"><p>All rights {i % 2}</p></div></body>'
    pages = [(i, f"https://b.example/{i}", page(i)) for i in range(40)]
    got = texts(spark, pages)
    assert all("Our site" not in r.text and "rights" not in r.text and r.text for r in got.values())
    alone = texts(spark, pages[:1])
    assert "Our site" in alone[0].text
    # copies of one page alone do not make its article repeat itself away
    copies = texts(spark, [(i, "https://c.example/", "<article><p>Same text</p></article>") for i in range(20)])
    assert {r.text for r in copies.values()} == {"Same text"}


def test_tree_alone_finds_the_main_text(spark):
    """Pages without any name or mark, menus, adverts and closing lines dealt in turn: the whole text of every page."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = lambda n: " ".join(word() for _ in range(n)) + "."
    menus, adverts, ends = [[word() for _ in range(5)] for _ in range(30)], [line(8) for _ in range(30)], [line(5) for _ in range(30)]
    pages, want = [], {}
    for i in range(360):
        host, k = i % 9, rng.randrange(30)
        main = [line(4), *(" ".join(line(9) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))]
        if i % 8 == 7:  # a copy of the page before, at another host
            main = want[i - 1].split("\n\n")
        body = f"<h2>{main[0]}</h2>" + "".join(f"<p>{x}</p>" for x in main[1:])
        items = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in menus[k])
        pages.append((i, f"https://h{host}.example/{i}", f"<body><ul class=xa>{items}</ul><div class=xb>{adverts[k]}</div><div class=xc>{body}</div><div class=xd>Site {host}. {ends[k]}</div></body>"))
        want[i] = "\n\n".join(main)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in style_tree.extract(df, names=False).collect()} == want
    assert {r.page_id: r.text for r in style_tree.extract(df).collect()} == want


def test_tree_alone_on_the_tables(spark):
    """Without names and marks the tree gives the texts that these give."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    named, alone = (style_tree.extract(df, names=x).select("page_id", "text") for x in (True, False))
    assert named.exceptAll(alone).count() == 0 and named.where("text <> ''").count() == df.count()


def test_an_article_that_many_hosts_copy_stays(spark):
    rng = random.Random(8)
    page = lambda i, text: f"<body><div class=top>Menu {i % 3}</div><article><p>{text}</p></article></body>"
    pages = [(i, f"https://h{i % 12}.example/{i}", page(i, "The same words everywhere." if i % 3 else f"Words {rng.random()}")) for i in range(360)]
    got = texts(spark, pages)
    assert all(r.text and "Menu" not in r.text for r in got.values())


def test_copies_of_a_page_do_not_remove_articles(spark):
    rng = random.Random(2)
    body = lambda i: f"<html><body><div class=top><p>Our site</p></div><article><p>{i} {rng.random()}</p></article></body></html>"
    one = body("same")
    # pages without a mark would be judged as the tree says: copies weigh once, so those that differ keep their text
    plain = lambda i: f"<html><body><div><p>words {i} {rng.random()}</p></div></body></html>"
    first, others = plain("same"), [plain(i) for i in range(10)]
    pages = [(i, "http://d.example/", one) for i in range(20)]
    pages += [(100 + i, "http://e.example/", one if i < 30 else body(i)) for i in range(40)]
    pages += [(200 + i, "http://f.example/", first if i < 30 else others[i - 30]) for i in range(40)]
    got = texts(spark, pages)
    assert all(r.text for r in got.values()) and not any("Our site" in r.text for r in got.values())


def test_a_section_of_a_large_host_is_judged(spark):
    rng = random.Random(3)
    prose = lambda: " ".join(rng.choice("abcdefghij") * 3 for _ in range(30))
    page = lambda i: f"<body><div class=c1><p>{prose()}</p></div></body>"
    part = lambda i: f"<body><div class=s1><div class=bar><p>Our section</p></div><div class=c2><p>{prose()}</p></div></div></body>"
    got = texts(spark, [(i, f"https://g.example/{i}", page(i) if i >= 20 else part(i)) for i in range(1200)])
    assert all(r.text and "section" not in r.text for r in got.values())


def test_marks_within_boilerplate_names(spark):
    wrap = [
        '<form action="/"><header>Site</header><article><p>Text</p></article><div class="ad">Buy</div></form>',
        '<div class="page with-sidebar"><main><p>Text</p></main><div class="sidebar">Side</div></div>',
        '<article class="post social-share"><p>Text</p><div class="share">Tweet</div></article>',
        '<div class="page has-menu"><p>Text</p></div><div class="menu">Home</div>',
        '<form><h1>Text</h1><nav>Home</nav></form>',
        '<article><p>Text</p><article class="comment"><p>Nice!</p></article></article>',
        '<article><p>Text</p></article><aside><article>Teaser</article></aside><div class="related"><article>More</article></div>',
        "<main><p>Text</p><form><p>Your mail address, please, and all else that we may ask of you</p></form></main>",
    ]
    got = texts(spark, [(i, f"http://h{i}.example/", f"<body>{w}</body>") for i, w in enumerate(wrap)])
    assert {i: r.text for i, r in got.items()} == dict.fromkeys(range(len(wrap)), "Text")


@pytest.mark.parametrize(("page", "text"), [
    ("<script " * 40_000, ""), ('<a "' * 80_000, ""), ("<div>" * 60_000 + "x", "x"), ("<i>" * 60_000 + "x" + "</b>" * 60_000, "x"), ("<center>" * 30_000 + "<h1></h1>" * 30_000 + "x", "x"),
    ("<b>" + "<div>" * 30_000 + "x" + "</b>" * 30_000, "x"), ("</p>" * 100_000 + "x", "x"), ("<a =" * 50_000 + ">x", "x"), ("<a x='" * 50_001 + ">x", "x"), ("<!-- " * 50_000, ""), ("< " * 9 + "x", "< " * 9 + "x"),
    ("<p>" * 60_000 + "x", "x"), ("<div>a</div>" * 20_000, "\n\n".join("a" * 20_000)), ("<div>a " * 20_000, "\n\n".join("a" * 20_000)), ("<form><div>a " * 20_000, ""), ("&#120;" * 100_000, "x" * 100_000), ("<p class='" + "x" * 500_000 + "'>x", "x"),
    ("<b>" * 100_000 + "x</div>" * 100_000, "\n\n".join("x" * 100_000)),
])
def test_broken_pages_take_linear_time(page, text):
    import time

    began = time.perf_counter()
    blocks, _ = style_tree.Parser().parse(page)
    assert "\n\n".join(t for n, t in blocks if not n.boiler) == text
    assert time.perf_counter() - began < 5


def test_importance_like_its_definition(spark):
    """Entropies and importance of a small host, worked out from nested dictionaries."""
    rng = random.Random(5)
    menu = lambda i: f"<div class=m><p>Menu</p><p>{'ab'[i % 2]}</p></div>"
    body = lambda i: "<div class=t>" + "".join(f"<h2>{rng.random()}</h2>" for _ in range(i % 3 + 1)) + "<span>x</span></div>"
    pages = [f"<body>{menu(i)}{body(i)}{'<pre>rare</pre>' if i < 3 else ''}</body>" for i in range(12)]
    df = spark.createDataFrame([("h", x) for x in [*pages, pages[0], pages[0]]], "host string, html string")
    got = sorted(round(r.importance, 6) for r in style_tree.style_tree(df).collect())

    seen: dict = {}
    for x in pages:
        blocks, nodes = style_tree.Parser().parse(x)
        path = lambda n: (*path(n.up), n.name) if n.up else ()
        for n in nodes[1:]:
            seen.setdefault(path(n), {}).setdefault(x, (set(), set()))[0].add(tuple(n.children))
        for n, t in blocks:
            seen[path(n)][x][1].add(t)
    entropy = lambda xs: -sum(c / len(xs) * math.log(c / len(xs)) for c in collections.Counter(xs).values())

    def importance(p):
        within = math.log(len(seen[p[:-1]]) if p[:-1] else 12)
        styles, contents = ([y for v in seen[p].values() for y in v[k]] for k in (0, 1))
        style = min(1.0, entropy(styles) / within)
        kids = [k for k in seen if k[:-1] == p]
        below = [importance(k)[0] for k in kids if len(seen[k]) >= 8]
        if contents:
            count = collections.Counter(contents)
            below.append(1 - sum(c * math.log(c) for c in count.values()) / sum(count.values()) / within)
        rare = any(len(seen[k]) < 8 for k in kids)
        below += [1.0] * rare
        keep = style_tree.GAMMA ** len(set(styles))
        own = (1 - keep) * style + keep * (sum(below) / len(below) if below else style)
        return own, max([1.0 if rare else own, *(importance(k)[1] for k in kids if len(seen[k]) >= 8)])

    assert got == sorted(round(importance(p)[1], 6) for p in seen if len(seen[p]) >= 8) and got[0] < 0.4 < got[-1]
    assert style_tree._importance(pd.DataFrame({"host": "h", "path": range(1, 2001), "up": [0] + [1] * 1999, "style": 0.0, "styles": 1, "content": [float("nan")] + [0.0] * 1998 + [1.0], "content_here": 1.0, "rare": False, "pages": 9}))["importance"][0] == 0.9


def test_fixity(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").withColumns({"hash": F.lit(1), "node": F.lit(2), "file": F.lit(3)})
    more = pages.unionByName(spark.createDataFrame([(None, "u", "x", 1, 2, 3), (9000, None, None, 1, 2, 3)], pages.schema))
    assert warc_fixity.audit(more, more).count() == 0
    other = more.where("page_id <> 7").withColumn("html", F.when(F.col("page_id") == 9, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).unionByName(spark.createDataFrame([(9001, "u", "new", 1, 2, 3)], pages.schema))
    got = {r.page_id: (r.kind, r.left_start, r.right_start) for r in warc_fixity.audit(more, other).collect()}
    assert {k: v[0] for k, v in got.items()} == {7: "missing", 9: "changed", 9001: "extra"} and got[9][1] > got[9][2]
    assert warc_fixity.audit(pages.limit(0), pages).count() == pages.count()


def test_archives_keep_records_at_their_offsets(spark):
    rows = [(i, f"http://x/{i}", "é" * (i % 7) + "<p>\r\n\r\n</p>") for i in range(5000) if i % 3] + [(9, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    files = warc_fixity.archives(pages)
    got = warc_fixity.records(files)
    assert sorted((r.page_id, r.url, r.html) for r in got.collect()) == sorted((i, u or "", h or "") for i, u, h in rows)
    other = got.where("page_id <> 4").withColumn("html", F.when(F.col("page_id") == 4100, F.lit("new")).otherwise(F.col("html")))
    found = {r.page_id: r for r in warc_fixity.audit(got, other).collect()}
    assert {i: r.kind for i, r in found.items()} == {4: "missing", 4100: "changed"}
    data = {r.file: bytes(r.warc) for r in files.collect()}
    assert all(f"<urn:page:{i}>".encode() in data[r.file][r.left_start : r.left_end][:80] for i, r in found.items())
    with pytest.raises(Exception, match="is cut"):
        warc_fixity.records(files.withColumn("warc", F.expr("substring(warc, 1, length(warc) - 3)"))).count()
    # any number of versions of an id, in any order
    many = spark.createDataFrame([(1, "u", f"v{i}") for i in range(50)], "page_id bigint, url string, html string")
    assert warc_fixity.audit(many, many.orderBy(F.desc("html"))).count() == 0 and warc_fixity.audit(many, many.where("html <> 'v7'")).count() == 1


def test_files_of_other_writers(spark):
    """Plain files and gzip members, any case of names, folded lines, records of all types."""
    import gzip

    def rec(kind, name, block, uri=None):
        head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID:<urn:uuid:{name}>\r\nX-Note: one\r\n  two\r\n" + (f"WARC-Target-URI: {uri}\r\n" if uri else "")
        return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    recs = [rec("warcinfo", "w", b"software: x")] + [rec("response", f"{i:04}", b"HTTP/1.1 200 OK\r\n\r\n\xff" + bytes([i % 256]) * (i * 37 % 90_000), f"http://x/{i}") for i in range(300)]
    pack = lambda rs: b"".join(gzip.compress(r) for r in rs)
    df = lambda *fs: spark.createDataFrame([(f, bytearray(x)) for f, x in fs], "file string, warc binary")
    left = df(("a.warc.gz", pack(recs[:150])), ("b.warc", b"".join(recs[150:])), ("empty", b""))
    got = warc_fixity.read(left).collect()
    assert len(got) == 301 and {r.type for r in got} == {"warcinfo", "response"} and next(r for r in got if r.type == "warcinfo").uri is None
    data = {"a.warc.gz": pack(recs[:150]), "b.warc": b"".join(recs[150:])}
    part = lambda r: data[r.file][r.start : r.end]
    assert sorted(gzip.decompress(part(r)) if r.file.endswith("gz") else part(r) for r in got) == sorted(recs)
    # the same records packed otherwise, but for one turned byte, one lost and one more
    other = [r for i, r in enumerate(recs) if i != 20]
    other[200] = other[200].replace(b"\xff", b"\xfe", 1)
    right = df(("c.warc.gz", pack([*other, rec("response", "more", b"new")])))
    found = {r.record_id: r for r in warc_fixity.audit_files(left, right).collect()}
    changed = f"<urn:uuid:{200:04}>"
    assert {k: r.kind for k, r in found.items()} == {"<urn:uuid:0019>": "missing", changed: "changed", "<urn:uuid:more>": "extra"}
    assert found[changed].left_file == "b.warc" and part(next(r for r in got if r.record_id == changed)) == data["b.warc"][found[changed].left_start : found[changed].left_end]
    assert warc_fixity.audit_files(left, left).count() == 0
    for bad in (pack(recs)[:-9], b"".join(recs)[:-1], b"no record"):
        with pytest.raises(Exception, match="is cut|no record"):
            warc_fixity.read(df(("bad", bad))).count()


def test_pipeline_stages(spark, tmp_path):
    """Every stage on rows with nulls, repeats and clashing columns, on none, and as a whole."""
    import corpus_pipeline as p
    from millrace.llm import balance, quality_mcd, toxicity

    from .data import documents, words
    from .test_text_operators import brute

    rng = random.Random(9)
    rows = [(100 + i, " ".join(words(rng, 60 + i % 50)), "en", f"s{i % 2}", None) for i in range(60)]
    rows += [(200 + i, rows[i][1].replace("th", "changed", i % 2), None, "s0", None) for i in range(20)]
    rows += [(None, rows[0][1], "en", "s0", None), (100, rows[0][1], "en", "s0", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").unionByName(documents(spark, 20, extra=True), allowMissingColumns=True)
    spark.createDataFrame([(100 + i, i % 9 == 0) for i in range(60)], "doc_id bigint, toxic boolean").selectExpr("doc_id", "1 as quality", "cast(toxic as int) as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    plain = lambda df: collections.Counter(tuple(r) for r in df.collect())
    seen, stages = docs, dict(p.STAGES)
    for name, stage in p.STAGES:
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0 and (name == "token_ids" or empty.columns == docs.columns), name
        out = p.common.written(stage(spark, seen, str(tmp_path)), f"test-{name}")
        if name == "quality":
            kept = {r.doc_id for r in quality_mcd.quality(seen).collect() if r.kept}
            assert {r.doc_id for r in out.collect()} == kept and not plain(out) - plain(seen)
        elif name == "toxicity":
            chain = toxicity.train(seen, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            assert out.count() == toxicity.score(seen.select("text"), chain).where("predicted = 0").count() and not plain(out) - plain(seen)
        elif name == "near_duplicates":
            want = {c for _, c in brute([(r.doc_id, r.text) for r in seen.collect() if r.doc_id is not None], 5, 80, 100).values()}
            got = [r.doc_id for r in out.collect()]
            assert sorted(i for i in got if i is not None) == sorted(want) and not plain(out) - plain(seen)
        elif name == "mix":
            assert out.count() == sum(r.copies for r in balance.mix(seen).collect())
        else:
            assert sorted(r.doc_id for r in out.collect() if r.doc_id) == sorted(r.doc_id for r in seen.collect() if r.doc_id)
        seen = out
    assert stages and seen.count() > 0


def test_pipeline_as_a_whole(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        seen = p.common.written(out, f"test-{name}")
    out = p.run(spark, SF)
    assert out.count() == seen.count() > 0 and {r.doc_id for r in out.collect()} <= {r.doc_id for r in docs.collect()}
