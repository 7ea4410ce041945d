"""Operator 13 against a brute-force version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment, queries

from ..conftest import SF
from .data import documents

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ALPHABET = ["a", "B", "the", " ", "  ", "\n", "\t", "\r", "é", "中", " ", "　", "'s", "1", "!", "\x00", "\x1c", "\x85", "▁", "ﬁ", "́", "<s>", "<0x0A>", "<|endoftext|>", "don't", " th", "​", "\U0001f600", ";\r"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    values = alignment.byte_values()
    size = {i: bytes(values[c] for c in t) for t, i in a.get_vocab().items() if all(c in values for c in t)}

    def tokens(text):
        if not text:
            return [], []
        x = [(i, size[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
        want = (" " + text).encode()
        return (x, y) if b"".join(t for _, t in x) == want == b"".join(t for _, t in y) else ([], [])

    return tokens


def linked(x, y):
    """Groups, and links with every pair of tokens compared from the least that can overlap on."""
    def spans(ts):
        ends = np.cumsum([len(t) for _, t in ts]).tolist()
        return [(i, e - len(t), e) for (i, t), e in zip(ts, ends)]

    x, y = spans(x), spans(y)
    links, lo = [], 0
    for i, s, e in x:
        while lo < len(y) and y[lo][2] <= s:
            lo += 1
        links += [(i, j) for j, s2, e2 in y[lo : lo + e - s + 1] if s2 < e and s < e2]
    shared = sorted({e for *_, e in x} & {e for *_, e in y})
    groups = [(",".join(str(i) for i, _, e in x if s < e <= t), ",".join(str(i) for i, _, e in y if s < e <= t)) for s, t in zip([0, *shared], shared)]
    return links, groups


def plainly(docs, tokens):
    found = [(i, tokens(t)) for i, t in docs]
    found = [(i, x, y, *linked(x, y)) for i, (x, y) in found]
    held = Counter(p for *_, links, _ in found for p in set(links))
    top = defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    return [
        (i, len(x), len(y), len(groups), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join("|".join(g) for g in groups).encode()).hexdigest() if x else "")
        for i, x, y, links, groups in found
    ]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_pieces_give_what_whole_texts_give(both):
    u = alignment.Units(A, B)
    assert u.cuts
    for text in odd_texts(3000, 5) + ["\x00\nx", " \nx", "\nx", "x \n y", "x\n\ny\n"]:
        ps = u.pieces(text)
        u.add([p for p in dict.fromkeys(ps) if p not in u.number])
        ns = [u.number[p] for p in ps]
        x, y = both(text)
        links, groups = linked(x, y)
        if not u.same.rows[ns].all():
            assert not x
            continue
        assert "".join(u.text[i] for i in ns) == "".join("|".join(g) + ";" for g in groups)
        assert [k for i in ns for k in u.keys.rows[u.start.rows[i] :][: u.shape.rows[i, 3]].tolist()] == [a << 32 | b for a, b in links]
        assert u.shape.rows[ns].sum(axis=0).tolist() == [len(x), len(y), len(groups), len(links)]
        u.seen.rows[ns] += 1
        if len(u.text) > 2000:
            u.thin(500)
            assert len(u.text) <= 500 and all(u.number[p] < len(u.text) for p in u.number)


@pytest.mark.parametrize("options", [{}, {"chunk": 300, "cache": 200}, {"files": False}, {"chunk": 300, "files": False}])
def test_rows_like_brute_force(spark, both, options):
    docs = documents(spark, 60, extra=True).withColumn("key", F.lit("x")).withColumn("chunk", F.lit(1))
    more = [*((1000 + i, t) for i, t in enumerate(odd_texts(80, 7))), (None, "the end"), (None, "the end"), (5, None), (1000, "one two one two")]
    docs = docs.unionByName(spark.createDataFrame(more, "doc_id bigint, text string"), allowMissingColumns=True).repartition(3)
    got = sorted((tuple(r) for r in alignment.align(docs, A, B, **options).collect()), key=repr)
    assert got == sorted(plainly([(r["doc_id"], r["text"]) for r in docs.collect()], both), key=repr)


def test_query_like_brute_force(spark, both):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in queries.op13_token_alignment(spark, SF).collect())
    assert got == sorted(plainly([(r["doc_id"], r["text"]) for r in docs], both))


def test_empty_tables_and_pairs(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a"), (3, None)], "doc_id bigint, text string")
    assert alignment.align(docs.limit(0), A, B).count() == 0
    assert [r[3] for r in alignment.align(docs.where("doc_id = 3"), A, B).collect()] == [0]
    got = alignment.pairs(docs, A, B).orderBy("n").collect()
    assert [r["n"] for r in got] == [1, 2] and all(r["best"] for r in got)


def test_no_files_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(alignment.common, "shared_dir", lambda _: f"file://{tmp_path}")
    alignment.align(spark.createDataFrame([(1, "a b a")], "doc_id bigint, text string"), A, B)
    assert [p.name.split("-")[1] for p in tmp_path.iterdir()] == ["result"]


def test_a_later_run_loads_nothing_again():
    """Workers that serve a second run keep one pair of tokenizers, not one a run."""
    import pyarrow as pa

    files = {"a": P.path("byte_bpe_50k.json"), "b": P.path("piece_bpe_32k.model")}
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b", "c d"]})
    first, second = dict(files), dict(files)
    rows = [[r["groups_sha256"].to_pylist() for r in alignment._gather(iter([batch]), x, 100, 100)] for x in (first, second)]
    assert first["units"] is second["units"] and rows[0] == rows[1]


def test_tasks_hold_few_texts_at_once(spark, monkeypatch):
    """A split's texts come in small batches, whatever the session's batches are; and the session's settings stay."""
    gather = alignment._gather

    def counted(batches, *rest):
        def checked():
            for b in batches:
                assert b.num_rows <= 256 and b.nbytes <= 4 << 20, (b.num_rows, b.nbytes)
                yield b

        return gather(checked(), *rest)

    monkeypatch.setattr(alignment, "_gather", counted)
    before = spark.conf.get(alignment._BATCH)
    docs = spark.range(600).selectExpr("id as doc_id", "repeat('some words ', 5000) as text").repartition(1)
    assert alignment.align(docs, A, B).count() == 600
    assert spark.conf.get(alignment._BATCH) == before


def test_chunks_are_written_in_small_row_groups(spark):
    """A task holds a few chunks where it writes or reads them, however many it makes."""
    import glob

    import pyarrow.parquet as pq

    docs = spark.range(600).selectExpr("id as doc_id", "repeat('some words ', 5000) || id as text").repartition(1)
    rows = alignment.chunks(docs, A, B, chunk=1)
    try:
        found = [pq.ParquetFile(f).metadata for f in glob.glob(rows._written_path.removeprefix("file://") + "/*.parquet")]
        groups = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in found for i in range(m.num_row_groups)]
        assert sum(n for n, _ in groups) > 12 and all(n <= 4 and size < 10 << 20 for n, size in groups), groups
    finally:
        alignment.common.forget(rows)
