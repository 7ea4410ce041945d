import random


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "ed", "in", "st", "ou", "ha"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def texts(n: int, seed: int = 1) -> list[str]:
    """Texts of 5 to 120 words; every fourth copies one before, with up to three words changed."""
    rng, out = random.Random(seed), []
    for i in range(n):
        if i % 4 == 3:
            w = rng.choice(out).split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "changed"
        else:
            w = words(rng, rng.randint(5, 120))
        out.append(" ".join(w))
    return out


EDGES = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "one"), (9005, "one two"), (9006, "ONE Two"), (9007, "é ß \U0001f600 中文"), (9008, "long " * 5000), (9009, "long " * 5000), (9010, "a\x00b \x1f c")]


def documents(spark, n: int = 160, extra: bool = False):
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts(n))]
    rows += [(i, t, None if i % 2 else "de", None if i % 3 else "s0", None) for i, t in EDGES]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        for c in ("n", "hi", "lo", "node", "key", "block", "side", "size", "rate", "copies", "target", "score", "predicted", "kept", "prefix", "__id", "rep", "label"):
            df = df.withColumn(c, df.doc_id * 0)
    return df
