import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from millrace.llm import balance, bpe, common, ngram_join, quality_mcd, suffix_tree, token_counts, toxicity
from millrace.llm.graph import components

from .data import documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def lowered(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def shingles(t, k):
    w = lowered(t)
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_join_is_exact(spark, k, num):
    df = documents(spark, extra=True)
    want = brute([(r.doc_id, r.text) for r in df.collect()], k, num, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df, ngram_join.Params(k, num, 100)).collect()}
    assert got == want


def test_join_of_wide_columns(spark, monkeypatch):
    """A large group of near copies around the threshold, with columns far wider than a block."""
    rng = random.Random(3)
    base = words(rng, 60)
    rows = []
    for i in range(220):
        w = list(base) if i % 11 else words(rng, 60)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = rng.choice(["x", "y", f"z{i}"])
        rows.append((i, " ".join(w)))
    for name, value in (("BLOCK", 4), ("PIVOTS", 2), ("HELD", 8), ("STREAMED", 32)):
        monkeypatch.setattr(ngram_join, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_links_of_wide_columns_are_all_counted(spark, monkeypatch):
    """Near copies of two texts that share most columns with each other, and rows that repeat an id."""
    rng = random.Random(7)
    base = words(rng, 80)
    rows = []
    for i in range(150):
        w = [*base[:50], *base[i % 2 * 15 + 50 : i % 2 * 15 + 65]]
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"z{i}"
        rows.append((i, " ".join(w)))
    for name, value in (("BLOCK", 4), ("COUNT_HELD", 16), ("COUNT_STREAMED", 64), ("DENSE", 16 * 20)):
        monkeypatch.setattr(ngram_join, name, value)
    p = ngram_join.Params(3, 80, 100)
    sets = {shingles(t, 3) for _, t in rows}
    want = {i: sum(s != shingles(t, 3) and 100 * len(s & shingles(t, 3)) >= 80 * len(s | shingles(t, 3)) for s in sets) for i, t in rows}
    got = {r.doc_id: r.links for r in ngram_join.join(spark.createDataFrame([*rows, *rows[:5]], "doc_id bigint, text string"), p).collect()}
    assert got == want and max(want.values()) > 20


def test_join_of_repeated_and_missing_ids(spark):
    t = " ".join(words(random.Random(5), 40))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (3, None), (3, None)], "doc_id bigint, text string")
    got = [(r.doc_id, r.component_id) for r in ngram_join.join(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (1, 1), (2, 1), (None, None), (3, 3), (3, 3)], key=str)
    kept = [r.doc_id for r in ngram_join.deduplicate(df).collect()]
    assert sorted(kept, key=str) == sorted([1, 3, None], key=str)
    assert ngram_join.join(df.limit(0)).count() == 0


def test_join_of_a_copy_after_a_row_without_id(spark):
    w = words(random.Random(8), 60)
    t, near = " ".join(w), " ".join([*w[:-1], "other"])
    df = spark.createDataFrame([(None, t), (2, t), (1, near)], "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: (r.component_id, r.links) for r in ngram_join.join(df).collect()}
    assert got == {None: (None, 1), 2: (1, 1), 1: (1, 1)}


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace as Of

    nothing = Of(get=lambda *_: None)
    context = Of(getConf=lambda: nothing, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(Of(conf=nothing, sparkContext=context))
    context.getCheckpointDir = lambda: "hdfs://shared/"
    assert common.shared_dir(Of(conf=nothing, sparkContext=context)) == "hdfs://shared"


def test_salted_joins_are_like_broadcast_ones(spark, monkeypatch):
    """The side that is too large to broadcast is joined in salted parts, null keys included, the same rows each time."""
    big = spark.range(500).select(F.when(F.col("id") % 5 != 0, F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(i, i * 10) for i in range(5)] + [(None, 99)], "k bigint, x int")
    want = sorted(map(tuple, common.small_join(big, small, ["k"]).collect()), key=str)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, common.small_join(big, small, ["k"]).collect()), key=str) == want
    assert all((x == 99) == (k is None) for k, _, x in want)


def test_components_of_a_chain(spark):
    edges = spark.range(1, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.createDataFrame([(900, 800), (5, 5)], "a bigint, b bigint"))
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 301)) and got[900] == got[800] == 800


@pytest.fixture(scope="module")
def reference_encoder():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_like_the_library(reference_encoder):
    tokens = bpe.load_ranks(RANKS)
    enc, dec, rng = bpe.Encoder(tokens, public_tokenizers.PATTERN), bpe.Decoder(tokens), random.Random(2)
    pool = ["a", "th", "ing", "é", "中国", "\U0001f600", " ", "\n", "1", "'s", "!!", "ß", "=", "aaaa", "<|endoftext|>", "A"]
    cases = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [c * n for c in ("a", "=", "ab", "ха", "0") for n in (1, 63, 64, 65, 500)]
    for text in cases:
        ids = enc.encode(text).tolist()
        assert ids == reference_encoder.encode_ordinary(text)
        cut = rng.randint(1, 5)
        assert b"".join(dec.feed(ids[i : i + cut]) for i in range(0, len(ids), cut)) + dec.close() == text.encode()


def test_bpe_query(spark, reference_encoder):
    df = documents(spark, 40, extra=True)
    got = {r.doc_id: r for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN, ids=True).collect()}
    for r in df.collect():
        ids = reference_encoder.encode_ordinary(r.text or "")
        g = got[r.doc_id]
        assert (g.n_tokens, g.ids) == (len(ids), ids) and g.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_token_counts(spark, reference_encoder, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 64)
    df = documents(spark, 40, extra=True).withColumns({c: F.lit("x") for c in ("file", "ordinal", "payload", "ends", "start")})
    got = {r.doc_id: r.n_tokens for r in token_counts.document_counts(df, RANKS, public_tokenizers.PATTERN, 50256).collect()}
    assert got == {r.doc_id: len(reference_encoder.encode_ordinary(r.text or "")) for r in df.collect()}
    assert token_counts.document_counts(df.limit(0), RANKS, public_tokenizers.PATTERN, 50256).count() == 0


def test_open_end_of_a_token_file(spark):
    pack = lambda *ids: b"".join(i.to_bytes(2, "little") for i in ids)
    blocks = spark.createDataFrame([(0, 0, pack(1, 2)), (0, 1, pack(3, 9, 9)), (0, 2, pack(4)), (1, 0, pack(9))], "file bigint, block bigint, payload binary")
    got = sorted((r.file, r.ordinal, r.start, r.n_tokens, r.closed) for r in token_counts.count(blocks, 9).collect())
    assert got == [(0, 0, 0, 3, True), (0, 1, 4, 0, True), (0, 2, 5, 1, False), (1, 0, 0, 0, True)]


def base_statistics(t):
    w = WORD.findall(t or "")
    seen, lines = collections.Counter(zip(w, w[1:], w[2:], strict=False)), [x for x in (t or "").split("\n") if WORD.search(x)]
    marked = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked)


def test_quality(spark):
    rng = random.Random(4)
    rows = [(1000 + i, "\n".join(rng.choice(["a b c", "a b", "", "# x y z", " ".join(words(rng, 4))]) for _ in range(rng.randint(0, 60))), "en", "s", None) for i in range(40)]
    rows += [(2000 + i, " ".join(words(rng, 150)) + " #$%" * (200 * (i == 0)), "en", "s", None) for i in range(400)]
    df = documents(spark, extra=True).select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"))
    got = {r.doc_id: r for r in quality_mcd.quality(df).collect()}
    for r in df.collect():
        g, want = got[r.doc_id], base_statistics(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g.base_failed and g.kept)
    assert not got[2000].kept and all(got[2000 + i].kept for i in range(1, 400))
    kept = quality_mcd.keep_quality(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g.kept}
    assert quality_mcd.quality(df.limit(0)).count() == 0


def test_determinant_estimates_like_numpy(spark):
    """Centre, scatter and distances of one group, by the same steps on arrays."""
    p, rng = quality_mcd.Params(), np.random.default_rng(3)
    x = rng.multivariate_normal([5, 1.5, 2, 1, 1], np.diag([1, 0.1, 0.5, 0.4, 0.6]) + 0.05, 400)
    x[:40] += rng.uniform(5, 9, (40, 5))
    names = list(quality_mcd.FEATURES)
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "__g string, " + ", ".join(f"{n} double" for n in names))
    est = quality_mcd.mcd(df, ["__g"], p)
    got = df.join(est, "__g").select(*names, quality_mcd._distance().alias("d")).collect()
    at = lambda v, q: np.sort(v)[math.ceil(q * len(v)) - 1]
    floor = np.diag([quality_mcd.FEATURES[n] ** 2 for n in names])
    centre = np.array([at(c, 0.5) for c in x.T])
    scatter = np.diag([(1.4826 * at(np.abs(c - m), 0.5)) ** 2 for c, m in zip(x.T, centre, strict=True)]) + floor
    factor = p.support / quality_mcd._chi2_cdf(7, quality_mcd._chi2_quantile(5, p.support))
    far = lambda: np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
    for _ in range(p.steps):
        near = x[far() <= at(far(), p.support)]
        centre, scatter = near.mean(0), factor * np.cov(near.T, bias=True) + floor
    want = dict(zip(map(tuple, x.tolist()), far(), strict=True))
    assert all(r["d"] == pytest.approx(want[tuple(r[n] for n in names)], rel=1e-4) for r in got)
    assert np.sort(far())[-40:].min() > 3 * np.sort(far())[:-40].max()


def test_rates_solve_the_dual(spark):
    """Every source meets its target in expectation, with rates of the one form that has least relative entropy."""
    df = documents(spark, 400)
    by = collections.defaultdict(list)
    for r in balance.mix(df).collect():
        by[r.source].append(r)
    for rows in by.values():
        some = [r for r in rows if r["size"]]
        if not some or some[0].target >= 3 * some[0].source_size:
            assert all(r.rate == 3 for r in some)
            continue
        assert sum(r["size"] * r.rate for r in some) == pytest.approx(some[0].target, rel=1e-4)
        mean = sum(r["size"] for r in some) / len(some)
        tilt = [math.log(r.rate) * mean / r["size"] for r in some if r.rate < 3 - 1e-9]
        assert max(tilt) - min(tilt) < 1e-6 and all(0 < r.rate <= 3 for r in some)


def test_mix(spark):
    df = documents(spark, 400, extra=True)
    got = balance.mix(df).collect()
    again = sorted((r.doc_id, r.taken) for r in balance.mix(df).collect())
    assert sorted((r.doc_id, r.taken) for r in got) == again
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in df.collect()}
    by = collections.defaultdict(list)
    for r in got:
        assert r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        by[r.source].append(r)
    total, order = sum(size.values()), sorted(by, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    left, room, want = total, dict.fromkeys(order), {}
    while room:
        level = left / sum(weight[s] for s in room)
        full = [s for s in room if level * weight[s] > 3 * by[s][0].source_size]
        if not full:
            want |= {s: level * weight[s] for s in room}
            break
        for s in full:
            want[s] = 3 * by[s][0].source_size
            left -= want[s]
            room.pop(s)
    for s in order:
        assert by[s][0].source_size == sum(r["size"] for r in by[s]) and by[s][0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in by[s]) - want[s]) <= 0.02 * want[s] + 130
    out = balance.mixed(df)
    assert out.columns == df.columns and out.where("doc_id < 9000").count() == sum(r.copies for r in got if r.doc_id < 9000)
    assert balance.mix(df.limit(0)).count() == 0


def brute_tree(tokens, held, p):
    """The suffix tree's scores from dictionaries of contexts."""
    train = [t for i, t in tokens.items() if not held[i]]
    c = collections.Counter(w for t in train for w in t)
    n, v, spare = sum(c.values()), len(c), sum(x == 1 for x in c.values()) + 1
    kept = {}

    def probability(context, x, longest):
        out = c[x] / (n + spare) if c[x] else spare / (n + spare)
        for k in range(1, longest + 1):
            s = context[len(context) - k :]
            if len(s) == k and s in kept:
                share, rest, total = kept[s]
                out = (share.get(x, 0) + (rest + p.prior) * out) / (total + p.prior)
        return out

    for k in range(1, p.depth + 1):
        after = collections.defaultdict(collections.Counter)
        for t in train:
            seq = ("start", *t)
            for i in range(k, len(seq)):
                after[seq[i - k : i]][seq[i]] += 1
        new = {}
        for s, found in after.items():
            total, share = sum(found.values()), {x: y for x, y in found.items() if y > 1}
            rest = total - sum(share.values())
            saved = rest * math.log10((rest + p.prior) / (total + p.prior))
            for x, y in share.items():
                low = 10 ** (-round(-suffix_tree.SCALE * math.log10(probability(s[1:], x, k - 1))) / suffix_tree.SCALE)
                saved += y * math.log10((y + (rest + p.prior) * low) / (total + p.prior) / low)
            if total > 1 and saved >= p.gain:
                new[s] = share, rest, total
        kept.update(new)
    score = {}
    for i, t in tokens.items():
        seq = ("start", *t)
        score[i] = sum(math.log10(probability(seq[max(0, j - p.depth) : j], seq[j], p.depth)) for j in range(1, len(seq)))
    return c, n, v, score, kept


@pytest.mark.parametrize("small", [{}, {"chunk": 300, "part": 400, "hot": 8}])
def test_suffix_tree(spark, small):
    p = suffix_tree.Params(**small)
    more = spark.createDataFrame([(20_000 + i, " ".join(f"the w{j % 40}" for j in range(i, i + 30))) for i in range(30)], "doc_id bigint, text string")
    df = documents(spark, 200, extra=True).unionByName(more, allowMissingColumns=True)
    got = {r.doc_id: r for r in suffix_tree.score(df, common.id_remainder("doc_id", 7) == 2, p).collect()}
    tokens = {r.doc_id: [*lowered(r.text), None] for r in df.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c, n, v, score, kept = brute_tree(tokens, held, p)
    assert {len(s) for s in kept} == {1, 2, 3}
    for i, t in tokens.items():
        g = got[i]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (held[i], len(t), sum(c[w] > 0 for w in t), n)
        assert g.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) and g.score == pytest.approx(score[i])
    assert got[9001].score == got[9002].score and all(g.score > g.base_score for i, g in got.items() if i >= 20_000)


def test_suffix_tree_without_training_rows(spark):
    df = documents(spark, 6)
    got = suffix_tree.score(df.unionByName(df.select(F.lit(None).cast("bigint").alias("doc_id"), *df.columns[1:])), F.lit(True)).collect()
    assert len(got) == 32 and all(r.score == r.base_score == 0 and r.train_tokens == 0 for r in got)
    assert suffix_tree.score(df.limit(0), F.lit(False)).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    bad = ["clown", "scumbag", "idiot"]
    rows, labels = [], []
    for i in range(400):
        w = words(rng, rng.randint(5, 80))
        if i % 4 == 0:
            w[rng.randrange(len(w))] = rng.choice(bad).upper() + "!"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    df = documents(spark, 4, extra=True).select("doc_id", "text").where("doc_id > 9000").unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"))
    lab = spark.createDataFrame([*labels, (9001, 1), (None, 1)], "doc_id bigint, toxic int")
    chain = toxicity.train(df, lab, learn=lambda c: common.id_remainder(c, 5) != 0)
    got = {r.doc_id: r for r in toxicity.score(df, chain, spans=True).collect()}
    assert all(got[i].predicted == t and 0 <= got[i].score <= 1 for i, t in labels)
    for i, t in rows:
        if i % 4 == 0:
            assert [t[s.start : s.end].lower() for s in got[i].spans] == [next(w.lower().strip("!") for w in t.split() if "!" in w)]
    assert got[9001].score == got[9002].score == 0.0
    clean = toxicity.keep_clean(documents(spark, 4, extra=True), lab)
    assert clean.columns == documents(spark, 4, extra=True).columns and clean.count() == 14
    assert toxicity.score(df.limit(0), chain).count() == 0 and toxicity.fit([], toxicity.Params()).tag("x")[0] < 0.5


def test_repeated_ids_are_learned_from_once(spark, monkeypatch):
    """A labelled id in thousands of rows brings one of them to the driver, the same at every run."""
    taken = []
    monkeypatch.setattr(toxicity, "fit", lambda rows, p: taken.append(rows))
    docs = spark.range(5000).select((F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, 1), (2, None)], "doc_id bigint, toxic int")
    toxicity.train(docs, labels)
    toxicity.train(docs.repartition(7), labels)
    assert len(taken[0]) == 2 and taken[0] == taken[1]


def test_toxicity_of_documents_not_learned_from(spark):
    sf = "/root/testdata/sf0.01"
    docs, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, lab, learn=lambda c: common.id_remainder(c, 5) != 0)
    held = toxicity.score(docs.select("doc_id", "text"), chain).join(lab, "doc_id").where(common.id_remainder("doc_id", 5) == 0).collect()
    assert len(held) > 40 and sum(r.predicted == r.toxic for r in held) >= 0.93 * len(held)
    assert sum(r.predicted for r in held if not r.toxic) <= 0.02 * len(held)


def test_marginals_are_exact():
    """Runs of neutral words by powers give what the sum over all taggings gives."""
    chain = toxicity.Chain({"=bad": 2.0, "=worse": 3.0}, -1.0, np.array([[0.5, -0.3], [-0.2, 0.4]]))
    text = "bad so so worse so bad so so so so"
    toks = text.split()
    pot = [chain.bias + (chain.potential(w) or 0.0) for w in toks]
    weight, hit = 0.0, [0.0] * len(toks)
    for y in itertools.product((0, 1), repeat=len(toks)):
        s = math.exp(sum(p for p, t in zip(pot, y, strict=True) if t) + sum(chain.trans[a, b] for a, b in itertools.pairwise(y)))
        weight += s
        for i, t in enumerate(y):
            hit[i] += s * t
    at = [(i, chain.potential(w)) for i, w in enumerate(toks) if chain.potential(w) is not None]
    assert chain._marginals(at, len(toks))[0] == pytest.approx([hit[i] / weight for i, _ in at])
