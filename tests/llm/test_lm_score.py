import math
import random
import re
import zlib
from collections import Counter

import pytest

from wordloom.llm import lm_score
from wordloom.llm.lm_score import scores


def toks(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def brute(rows):
    train = [toks(t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    uni = Counter(w for x in train for w in x)
    big = Counter(p for x in train for p in zip(["<s>"] + x[:-1], x, strict=True))
    after, fol = Counter(), Counter()
    for (a, _), c in big.items():
        after[a] += c
        fol[a] += 1
    n, v = sum(uni.values()), len(uni)
    n1, n2 = sum(c == 1 for c in big.values()), sum(c == 2 for c in big.values())
    d = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    root = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(a, w):
        if not after[a]:
            return root(w)
        return max(big[a, w] - d, 0) / after[a] * (big[a, w] > 0) + d * fol[a] / after[a] * root(w)

    out = []
    for i, t in rows:
        x = toks(t)
        out.append((i, zlib.crc32(str(i).encode()) % 5 == 1, len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10(root(w)) for w in x), sum(math.log10(p(a, w)) for a, w in zip(["<s>"] + x[:-1], x, strict=True))))
    for a in ["<s>", "w1", "never"]:
        assert math.isclose(sum(p(a, w) for w in uni) + p(a, "unseen"), 1, rel_tol=1e-9)
    return sorted(out)


@pytest.mark.parametrize("block", [1 << 11, 6 << 20])
def test_against_brute_force(spark, monkeypatch, block):
    from pyspark.sql import functions as F

    from wordloom.llm.common import fold

    monkeypatch.setattr(lm_score, "BLOCK_BYTES", block)
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["w1", "W1", "w2,", "é", f"x{r.randrange(60)}"]) for _ in range(r.randrange(40)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, "w1 " * 100_000), (5, rows[5][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, score int").repartition(3)
    got = sorted(tuple(x)[:7] for x in scores(df, fold(F.col("doc_id"), 5) == 1).collect())
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_empty_table(spark):
    from pyspark.sql import functions as F

    assert scores(spark.createDataFrame([], "doc_id long, text string"), F.lit(False)).count() == 0
