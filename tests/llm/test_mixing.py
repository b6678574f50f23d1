import math
import random

import pytest

from wordloom.llm import mixing
from wordloom.llm.mixing import DIMENSIONS, SMOOTH, mixture, rates, sampled, weighed

SCHEMA = "doc_id long, text string, source string, lang string, tokens int, rate string"


def rows(n=800):
    r = random.Random(4)
    return [(i, " ".join("w" for _ in range(r.randint(0, 30))) + (" 12345678" if i % 5 == 0 else ""), None if i % 11 == 0 else r.choice("aaab"), r.choice(["x", "x", "y", None]), 1, "z") for i in range(n)]


def brute(cells):
    share = {}
    for d in range(3):
        t = {}
        for k, v in cells.items():
            t[k[d]] = t.get(k[d], 0) + v
        s = sum(v**SMOOTH for v in t.values())
        share[d] = {k: v**SMOOTH / s for k, v in t.items()}
    f = {k: float(v) for k, v in cells.items()}
    for _ in range(500):
        for d in range(3):
            now = {}
            for k, v in f.items():
                now[k[d]] = now.get(k[d], 0) + v
            f = {k: v * share[d][k[d]] / now[k[d]] for k, v in f.items()}
    return f, share


@pytest.mark.parametrize("part", [50_000, 0])
def test_raking_meets_targets(spark, monkeypatch, part):
    monkeypatch.setattr(mixing, "PART", part)
    df = spark.createDataFrame(rows(), SCHEMA)
    fit = rates(weighed(df)).collect()
    cells = {tuple(r[d] for d in DIMENSIONS): r.tokens for r in fit}
    want, share = brute(cells)
    for r in fit:
        k = tuple(r[d] for d in DIMENSIONS)
        assert math.isclose(r.fitted, want[k], rel_tol=1e-3)
        assert 0 <= r.rate <= 1
    assert max(r.rate for r in fit) == pytest.approx(1)


def test_mixture_rows_and_columns(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    out = mixture(df).collect()
    assert len(out) == 800 and {r.doc_id for r in out} == set(range(800))
    kept = {r.doc_id for r in out if r.kept}
    got = sampled(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == kept
    expected = sum(r.rate for r in out)
    assert abs(len(kept) - expected) < 4 * math.sqrt(expected) + 5


@pytest.mark.parametrize("data", [[], [(1, None, None, None, 0, ""), (1, "", "a", None, 0, "")]])
def test_nothing_to_weigh(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    assert sampled(df).count() == 0 and mixture(df).count() == len(data)


def test_one_tiny_cell_does_not_set_the_size(spark):
    data = [(i, "w " * 40, "a" if i % 3 else "b", "x", 1, "z") for i in range(2000)] + [(9999, "12345678 9", "c", "y", 1, "z")]
    df = spark.createDataFrame(data, SCHEMA)
    fit = rates(weighed(df)).collect()
    tokens = sum(r.tokens for r in fit)
    assert math.isclose(sum(r.tokens * r.rate for r in fit), 0.5 * tokens, rel_tol=1e-4)
    tiny = next(r for r in fit if r.source == "c")
    assert tiny.rate == 1 and tiny.wanted > 1  # falls short, and says so
    free = [r for r in fit if r.rate < 1]
    assert free and all(r.rate == r.wanted for r in free)
    assert max(r.wanted * r.tokens / r.fitted for r in fit) == pytest.approx(min(r.wanted * r.tokens / r.fitted for r in fit))
    kept = [r for r in mixture(df).collect() if r.kept]
    assert abs(len(kept) - 1000) < 100 and 9999 in {r.doc_id for r in kept}


def test_more_than_the_budget_where_no_cell_falls_short(spark):
    df = spark.createDataFrame([(i, "w " * 40, "ab"[i % 2], "x", 1, "z") for i in range(400)], SCHEMA)
    assert all(r.rate == pytest.approx(1) for r in rates(weighed(df)).collect())
