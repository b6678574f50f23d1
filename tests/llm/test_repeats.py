import hashlib
import random
from collections import Counter

import pytest

from wordloom.llm import repeats
from wordloom.llm.repeats import without_repeats


def brute(rows, n=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
    out = []
    for (i, _), x in zip(rows, raw, strict=True):
        gone = [False] * len(x)
        for k in range(len(x) - n + 1):
            if seen[x[k : k + n]] > 1:
                gone[k : k + n] = [True] * n
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row long").repartition(4)
    return sorted(map(tuple, without_repeats(df).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é\n") for _ in range(n))
    passages = [text(r.choice([150, 199, 200, 201, 230, 400])) for _ in range(12)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(text(r.randint(0, 400)))
            if r.random() < 0.7:
                p = r.choice(passages)
                a = r.choice([0, 0, r.randrange(60)])
                parts.append(p[a : len(p) - r.choice([0, 0, r.randrange(60)])])
        rows.append((i, "".join(parts)))
    rows += [(100 + k, rows[k][1]) for k in range(0, 20, 4)] + [(7, rows[7][1]), (200, "ab" * 400), (201, "z" * 1000), (202, "x" * 199), (203, None), (204, ""), (205, text(300) * 3), (206, "q" * 200)]
    return rows


@pytest.mark.parametrize("hot", [2000, 5])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 8000)
    rows = corpus(hot)
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
