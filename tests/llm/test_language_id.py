import random

import numpy as np
import pytest

from wordloom.llm.language_id import codewords, predicted, recognised, train
from wordloom.llm.queries import op3_language_id

SCHEMA = "doc_id long, text string, lang string, score int"
WORDS = {"aa": ["bana", "kolo", "mipu"], "bb": ["strength", "thrust", "width"], "cc": ["éèo", "çaé", "ouî"], "dd": ["zzyx", "xqz", "wvz"], "ee": ["ñandu", "ñoño"], "ff": ["ößa", "üßt"], "gg": ["0ijij", "jiji"]}


def corpus(langs, n, seed=1):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS[x]) for _ in range(r.randint(3, 60))), x, 0) for i in range(n) for x in [r.choice(langs)]]


@pytest.mark.parametrize("langs", [["aa"], ["aa", "bb"], ["aa", "bb", "cc", "dd"], sorted(WORDS)])
def test_learns_languages(spark, langs):
    rows = corpus(langs, 400)
    model = train(spark.createDataFrame(rows, SCHEMA))
    got = predicted(spark.createDataFrame(corpus(langs, 300, 2), SCHEMA), model).collect()
    want = {i: x for i, _, x, _ in corpus(langs, 300, 2)}
    assert np.mean([r.lang_pred == want[r.doc_id] for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_defined_results(spark):
    model = train(spark.createDataFrame(corpus(["aa", "bb"], 200), SCHEMA))
    rows = [(1, None, "aa", 0), (2, "", None, 0), (3, "123 ... !", "bb", 0), (4, "漢字", None, 0), (4, "漢字", None, 0), (5, "bana kolo " * 200_000, None, 0), (None, "a", "aa", 0)]
    got = {r.doc_id: r for r in predicted(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert got[4].lang_pred in ("aa", "bb") and got[5].lang_pred == "aa"
    kept = recognised(spark.createDataFrame(rows, SCHEMA), model)
    assert kept.columns == ["doc_id", "text", "lang", "score"] and 5 in {r.doc_id for r in kept.collect()}
    assert train(spark.createDataFrame([], SCHEMA)) is None
    assert predicted(spark.createDataFrame(rows, SCHEMA), None).where("lang_pred <> 'und'").count() == 0


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 12):
        code = codewords(n)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= max(1, code.shape[1] // 4)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = op3_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").selectExpr("avg(cast(lang = lang_pred as int)) a", "count(*) n").first()
    assert held.n > 100 and held.a > 0.97
