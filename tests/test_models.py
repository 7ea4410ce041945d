"""Models that fail: one prompt costs one row, and what was made stays."""

import pytest

from millrace.operators import models


def test_one_poisoned_prompt_costs_one_row():
    calls = []

    def model(ps):
        calls.append(len(ps))
        if "bad" in ps:
            raise ValueError("no")
        return [p.upper() for p in ps]

    prompts = [f"p{i}" for i in range(999)] + ["bad"]
    got = models.replies(model, prompts)
    assert got[:-1] == [p.upper() for p in prompts[:-1]] and got[-1] == "ERROR: no" and len(calls) <= 2 * 10 + 1
    assert models.replies(model, []) == [] and models.replies(lambda ps: ps[:1], ["a", "b"]) == ["a", "b"] and models.replies(lambda _: [], ["a"])[0].startswith("ERROR: 0 replies")


def test_single_prompts_are_tried_again():
    seen = []

    def model(ps):
        seen.append(list(ps))
        if ps == ["x"] and seen.count(["x"]) < 3:
            raise OSError("busy")
        if len(ps) > 1:
            raise OSError("busy")
        return ps

    assert models.replies(model, ["w", "x"], tries=3) == ["w", "x"] and seen.count(["x"]) == 3


def test_rows_keep_their_replies(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * 200_000 if i == 4 else f"p{i}", "old") for i in range(40)], "id int, prompt string, generated string")

    def model(ps):
        assert len(ps) <= 7
        if "p11" in ps:
            raise ValueError("no")
        return [p + "!" for p in ps]

    got = {r["id"]: r["generated"] for r in models.generate(df, model=model, batch=7).collect()}
    assert got == {i: None if i in (3, 4) else "ERROR: no" if i == 11 else f"p{i}!" for i in range(40)}


def test_a_run_that_ends_in_the_middle_goes_on(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(60)], "id int, prompt string")
    path, sent = str(tmp_path / "made"), spark.sparkContext.accumulator(0)

    def model(ps):
        sent.add(len(ps))
        if "p5" in ps:
            raise ValueError("no")
        return [p + "!" for p in ps]

    plain, calls = models.generate, []

    def ends(*args, **options):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return plain(*args, **options)

    with monkeypatch.context() as m:
        m.setattr(models, "generate", ends)
        with pytest.raises(KeyboardInterrupt):
            models.generate_into(path, df, "id", slices=4, model=model)
    half = {r["id"] for r in models.without_errors(spark.read.parquet(path)).collect()}
    assert 10 < len(half) < 50
    got = {r["id"]: r["generated"] for r in models.generate_into(path, df, "id", slices=4, model=model).collect()}
    assert got == {i: "ERROR: no" if i == 5 else f"p{i}!" for i in range(60)}
    before = sent.value
    again = {r["id"]: r["generated"] for r in models.generate_into(path, df, "id", slices=4, model=lambda ps: [p + "?" for p in ps]).collect()}
    assert again == got | {5: "p5?"} and sent.value == before
    rows = [r["id"] for r in spark.read.parquet(path).collect()]
    assert all(rows.count(i) == 1 for i in range(60) if i != 5)
