import json
import math
import os
import random
import re
from dataclasses import replace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom import training
from wordloom.config import Prediction, Training
from wordloom.functions import strings as S
from wordloom.functions import terms as T
from wordloom.language import FRENCH, NONE
from wordloom.operators import correction as C
from wordloom.operators import dynamic as D
from wordloom.operators import ngrams as N
from wordloom.operators import prediction as P
from wordloom.operators import semantic as M
from wordloom.operators import vocabulary as V
from wordloom.operators.prediction import predict
from wordloom.operators.pruning import by_count, by_difference
from wordloom.plans import registry
from wordloom.sources import corpus, model
from wordloom.streaming import dynamic

SF = "/root/testdata/sf0.001"
TERMS = [
    ("73%", [("PERCENT", "73%")]), ("8,25 %", [("PERCENT", "8,25%")]), ("8.25 %", [("PERCENT", "8,25%")]), ("104.33", [("DECIMAL", "104,33")]), ("61", [("INTEGER", "61")]),
    ("l’arbre", [("WORD", "l'"), ("WORD", "arbre")]), ("A.B.C.", [("ACRONYM", "ABC")]), ("A.B.C..", [("ACRONYM", "ABC"), ("SEPARATOR", ".")]), ("va-t-on", [("WORD", "va-t-on")]),
    ("u-v-", [("WORD", "u"), ("SEPARATOR", "-"), ("WORD", "v"), ("SEPARATOR", "-")]), ("7x%", [("WORD", "7x"), ("SEPARATOR", "%")]), ("Aujourd'hui", [("WORD", "Aujourd'hui")]), ("", []), (None, []),
    ("a-b-t3", [("WORD", "a"), ("SEPARATOR", "-"), ("WORD", "b"), ("SEPARATOR", "-"), ("WORD", "t3")]), ("N.O.Pq", [("ACRONYM", "NO"), ("WORD", "Pq")]), ("mot ", [("WORD", "mot ")]), ("5.%", [("INTEGER", "5"), ("SEPARATOR", "."), ("SEPARATOR", "%")]),
]
DATES = [
    ("3/4/19", [("DATE_FULL_DIGIT", "03/04/2019")]), ("03-04-0099", [("DATE_FULL_DIGIT", "03/04/1999")]), ("31.12.2004", [("DATE_FULL_DIGIT", "31/12/2004")]), ("39/19/142", [("DATE_FULL_DIGIT", "39/19/0142")]),
    ("04 FEVRIER 21", [("DATE_FULL_TEXT", "4 février 1921")]), ("FÉVRIER 21", [("PROPER_NAME", "FÉVRIER"), ("INTEGER", "21")]), ("aout 2001", [("DATE_MONTH_YEAR", "août 2001")]),
    ("7 mars", [("DATE_DAY_MONTH", "7 mars")]), ("Lundi", [("DATE_WEEK_DAY", "lundi")]), ("Anna Bel Cor Dom Eva", [("PROPER_NAME", "Anna Bel Cor Dom"), ("PROPER_NAME", "Eva")]), ("Anna b", [("PROPER_NAME", "Anna"), ("WORD", "b")]),
]


@pytest.mark.parametrize("cases,matchers", [(TERMS, FRENCH.ngram_matchers), (DATES, FRENCH.semantic_matchers)])
def test_terms(spark, cases, matchers):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, text string")
    rows = df.select("i", F.posexplode(T.classified(F.col("text"), matchers)).alias("p", "x"))
    rows = rows.select("i", "p", F.col("x.k").alias("k"), T.value(F.col("x.t"), F.col("x.k")).alias("v")).where("v <> ' '").orderBy("i", "p").collect()
    for i, (text, want) in enumerate(cases):
        assert [(r.k, r.v) for r in rows if r.i == i] == want, text


def test_both_ways_to_classes_agree(spark):
    """The shapes that the fast way goes by, and the matchers one after the other."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("text").union(spark.createDataFrame([(t,) for t, _ in TERMS], "text string"))
    slow = tuple(m for m in FRENCH.ngram_matchers)[:-1] + (FRENCH.ngram_matchers[-1], FRENCH.ngram_matchers[-1])
    rows = df.select(T.classified(F.col("text")).alias("a"), T.classified(F.col("text"), slow).alias("b"))
    assert rows.where("a <> b").count() == 0


def test_sentences_keep_control_characters(spark):
    df = spark.createDataFrame([(1, "ab\x01cd ef\x02gh. \x03ij k"), (2, "Un deux! trois"), (3, "  ..\n"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.said for r in T.sentences(df).collect()}
    assert got == {1: [["ab\x01cd", "ef\x02gh"], ["\x03ij", "k"]], 2: [["Un", "deux"], ["trois"]], 3: [], 4: []}
    assert [r.said for r in T.sentences(df.where("doc_id = 2"), ended=True).collect()] == [[["Un", "deux"]]]


HARD = [
    "73% 8,25 % x 8.25 %a 104.33b", "l’arbre A.B.C. A.B.C.. B.C É.A. A.b", "va-t-on u-v- 7x% 50%% Aujourd'hui aujourd'huix", "", None, "1.2.3 1,2,3 1.2% 12 3% 5.% 5,", "  ..\n", "ab\x01cd ef\x02gh. \x03ij k\u0085l\x0bm",
    "\U0001d400.\U0001d401 X", "t3 3t 3 t <PERCENT> 50\n% 4 %", "a'b' 'c 5' 5-6 x-1 3.\n4", "\ufeffAb. \ufeffcd\n\ufeffEf\r\nGh\r", "x٣ ٣ ٣% Straße İx. İstanbul ǅe", " " * 3000 + "a" + " ." * 500,
]


def test_whole_texts_give_the_sentences_of_their_terms(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    want = T.sentences(df).select("doc_id", "n_terms", F.posexplode("said").alias("sent", "s")).select("doc_id", "n_terms", "sent", T.normal(F.col("s")).alias("words"))
    got = T.spoken(df)
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def test_longest_ngrams_and_ids_need_no_shuffle(spark):
    said = spark.createDataFrame([(9, ["a", "zz", "b"]), (9, ["b", "a", "b", "a", "<INTEGER>"]), (1, ["a"]), (9, ["zz"])], "n_terms int, words array<string>")
    ids = spark.createDataFrame([("a", 17), ("b", 18), ("<INTEGER>", 9)], "word string, word_id int")
    found = N.encoded(said, ids)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.ids for r in found.collect()) == [[16], [17, 16, 18], [18, 17, 18, 17, 9]]
    got = {tuple(w for w in r[1:5] if w != NONE): r.cnt for r in N.counts(found).collect()}
    want = {}
    for s in ([15, 17], [15], [15, 18, 17, 18, 17, 9], [18]):
        for i in range(len(s)):
            for k in range(1, 5):
                if i + k <= len(s):
                    want[tuple(s[i : i + k])] = want.get(tuple(s[i : i + k]), 0) + 1
    assert got == want


def test_queries_train_no_further_than_they_need(spark, tmp_path):
    small = f"file://{SF}"
    registry.case_stats(spark, small).collect()
    at, done = registry._TRAINED[spark.sparkContext.applicationId, small]
    assert done == training.STAGES.index("counts") and not os.path.exists(f"{at}/words")


def test_strings(spark):
    df = spark.createDataFrame([("ßa", "É", ""), ("élan", "éLAN", "l"), (None, None, "a")], "a string, b string, c string")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    rows = df.select(S.capitalize(a), S.uncapitalize(b), S.is_capitalized(b), S.is_upper(b), S.has_upper(b), S.is_blank(a), S.same(a, b), S.same_ignoring_case(a, b), S.position(c, a, F.lit(1))).collect()
    assert tuple(rows[0]) == ("ßa", "é", True, True, True, False, False, False, 1)
    assert tuple(rows[1]) == ("Élan", "éLAN", False, False, True, False, False, True, 1)
    assert tuple(rows[2])[5:8] == (True, True, True)


def _train(spark, text, how=None, lexicon=(), **more):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return training.train(docs, spark.createDataFrame(list(lexicon), "word string, freq double"), how or Training(valid_from=0), **more)


FOUR = "ka bo ce de\nka bo ge\nka bo ce fu ha li\nka bo mi ! "


def test_probabilities_of_four_sentences(spark):
    """Shares and back-off of four sentences with a common head, worked out by hand; x is a word of one letter."""
    m = _train(spark, "ka bo ce de\nka bo ge\nka bo ce fu ha li\nka bo mi x ju ku")
    assert {r.n: round(r.d, 9) for r in m.discounts.collect()} == {1: 0.8, 2: round(7 / 9, 9), 3: 0.75, 4: 0.9}
    assert {r.n: (r.unique_ngrams, r.total_ngrams) for r in N.totals(m.grams).collect()} == {1: (12, 22), 2: (10, 17), 3: (8, 12), 4: (7, 8)}
    ids = {r.word: r.word_id for r in m.words.collect()}
    start = 15
    rows = [(c, w) for c in ([start, ids["ka"], ids["bo"]], [NONE, ids["ka"], ids["bo"]], [NONE, NONE, ids["bo"]], [99, 98, ids["bo"]]) for w in [*ids.values(), start]]
    asked = spark.createDataFrame([(*c, w) for c, w in rows], "c1 int, c2 int, c3 int, word_id int")
    p = {(r.c1, r.c2, r.word_id): r.p for r in N.levels(asked, m.grams, m.contexts).collect()}
    want = {(NONE, ids["ka"]): (0.514204545, 0.108664773), (NONE, NONE): (0.358585859, 0.082070707), (start, ids["ka"]): (0.622088068, 0.098348722), (99, 98): (0.358585859, 0.082070707)}
    for c, (ce, ge) in want.items():
        assert math.isclose(p[(*c, ids["ce"])], ce, abs_tol=1e-8) and math.isclose(p[(*c, ids["ge"])], ge, abs_tol=1e-8)
        assert math.isclose(sum(v for k, v in p.items() if k[:2] == c), 1, abs_tol=1e-10)
    raw = N.raw_probability(asked, m.grams).collect()
    assert {r.c1 for r in raw} == {start} and math.isclose(sum(r.prob for r in raw), 1 - 3 * 0.9 / 4)
    one = N.backed_off(m.grams, m.contexts).collect()
    two = {(r.n, r.w1, r.w2, r.w3, r.w4): r.p for r in N.backed_off(m.grams, m.contexts, whole=False).collect()}
    assert all(math.isclose(r.p, two[r.n, r.w1, r.w2, r.w3, r.w4]) for r in one)


def test_pruning(spark):
    m = _train(spark, FOUR * 2 + "ka bo ce de fu\nli ka bo")
    grams = m.grams.drop("prob")
    for raw in (False, True):
        left = by_difference(grams, 0.05, raw)
        assert left.count() < grams.count() and left.where("n = 1").count() == grams.where("n = 1").count()
        of = N.contexts(left, N.discounts(left))
        sums = N.probabilities(left, of).groupBy("n", F.when(F.col("n") > 1, F.col("w1")).alias("a"), F.when(F.col("n") > 2, F.col("w2")).alias("b"), F.when(F.col("n") > 3, F.col("w3")).alias("c")).agg(F.sum("prob").alias("s"))
        bows = {(r.n, r.c1, r.c2, r.c3): r.bow for r in of.collect()}
        for r in sums.collect():
            key = (r.n, *(NONE if x is None else x for x in (r.a, r.b, r.c)))
            assert math.isclose(r.s + (bows[key] if r.n > 1 else 0), 1, abs_tol=1e-10)
    assert by_difference(grams, 0.0).count() == grams.count()
    kept = by_count(grams, {2: 3, 3: 3, 4: 3}).collect()
    heads = {(r.w1, r.w2, r.w3) for r in kept if r.n == 4}
    assert all(r.cnt >= 3 or (r.n == 3 and (r.w1, r.w2, r.w3) in heads) or r.n < 3 for r in kept)


def test_one_shuffle_finds_shares_and_contexts(spark):
    """Shares and contexts in one turn are those of two, however the rows of a context fall into batches."""
    r = random.Random(4)
    said = [[r.choice([17, 17, 18, 19, 20 + r.randrange(40)]) for _ in range(r.randint(1, 9))] for _ in range(400)]
    grams = N.counts(spark.createDataFrame([(x,) for x in said], "ids array<int>"))
    d = N.discounts(grams)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        freq, of = (sorted(map(tuple, df.collect())) for df in N.modelled(grams, d))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    want = N.contexts(grams, d)
    assert of == sorted(map(tuple, want.collect()))
    bow = {tuple(x[:4]): x.bow for x in want.collect()}
    assert freq == sorted((*x, bow[(x.n, *(x[k] if x.n > k else NONE for k in (1, 2, 3)))]) for x in N.probabilities(grams, want).collect())
    table, _ = N.modelled(grams, d)
    once = {tuple(x[:5]): x.p for x in N.backed_off(table, want).collect()}
    assert once == {tuple(x[:5]): x.p for x in N.backed_off(N.probabilities(grams, want), want).collect()}
    assert N.modelled(grams.where("n > 9"), d)[0].count() == 0


@pytest.mark.parametrize("raw", [False, True])
def test_difference_pruning_is_that_of_one_order_after_the_other(spark, raw):
    r = random.Random(5)
    said = [[17 + min(r.randrange(12), r.randrange(12)) for _ in range(r.randint(1, 7))] for _ in range(300)]
    grams = N.counts(spark.createDataFrame([(x,) for x in said], "ids array<int>"))
    left = {tuple(x[:5]): x.cnt for x in grams.collect()}
    want = spark.createDataFrame([(*k, c) for k, c in left.items()], grams.schema)
    for n in (4, 3, 2):
        of = N.contexts(want, N.discounts(want))
        freq = N.probabilities(want, of)
        p = {tuple(x[:5]): x.prob if raw else x.p for x in (freq if raw else N.backed_off(freq, of, upto=n)).collect()}
        q = {k: p[(n - 1, *k[2 : n + 1], *[NONE] * (5 - n))] for k in p if k[0] == n}
        gone = {k[1 : n + 1] for k in q if p[k] > 0 and q[k] > 0 and p[k] * math.log(p[k] / q[k]) <= 0.002}
        left = {k: c for k, c in left.items() if k[0] < n or k[1 : n + 1] not in gone}
        want = spark.createDataFrame([(*k, c) for k, c in left.items()], grams.schema)
    assert 0 < len(left) < grams.count() and {tuple(x[:5]): x.cnt for x in by_difference(grams, 0.002, raw).collect()} == left


def test_training_settings_stages_and_files(spark, tmp_path):
    seen = []
    how = Training(valid_from=0, pruning="order_count", least=[-1, 2, 2, 2])
    at = str(tmp_path / "a")
    m = _train(spark, FOUR, how, at=at, watch=lambda name, df: seen.append(name))
    assert seen == ["terms", "counts", "words-clean", "words", "words-ids", "sentences", "grams", "unpruned", "model-contexts"]
    assert m.grams.where("n > 1 and cnt < 2").count() == 0 and m.discounts.where("n = 1").first().d > 0
    first = sorted(map(tuple, m.grams.collect()))
    m = _train(spark, "other words here", how, at=at, since="grams")
    assert sorted(map(tuple, m.grams.collect())) == first
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        _train(spark, FOUR, how, at=at, overwrite=False)
    fixed = _train(spark, FOUR, Training(valid_from=0, discount=0.5))
    assert {r.d for r in fixed.discounts.collect()} == {0.5}
    assert Training.from_json(how.to_json()) == how and Training.from_json(json.dumps({"order": 3, "unheard": 1})).order == 3
    assert Prediction.from_json(Prediction(wanted=7, custom={"a": "b"}).to_json()).custom == {"a": "b"}
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a.txt").write_bytes("﻿un\r\ndeux".encode())
    (folder / "a.txt.info.json").write_text("{}")
    rows = corpus.folder(spark, str(folder)).collect()
    assert len(rows) == 1 and spark.createDataFrame(rows).select(T.canonical(F.col("text")).alias("t")).first().t == "un\ndeux"
    (tmp_path / "lexicon.tsv").write_text("\n".join(["\t".join(["word", *"bcdefghi", "freq"]), *("\t".join([w, *"bcdefghi", f]) for w, f in [("ka", "0.5"), ("ka", "2.5"), ("bo", "1"), ("ka", "x")])]))
    words = corpus.lexicon(spark, str(tmp_path / "lexicon.tsv"))
    assert sorted(map(tuple, words.collect())) == [("bo", 1.0), ("ka", 2.5)] and corpus.lexicon_total(words).first().total == 3.5
    (tmp_path / "stops.txt").write_text("Ka\nunheard\n\nbo\n")
    assert sorted(r.word for r in corpus.stop_words(spark, str(tmp_path / "stops.txt"), m.words).collect()) == ["Ka", "bo"]
    assert {r.word for r in corpus.stop_words(spark, None, m.words).collect()} == {"ce", "de"}


def test_vocabulary_rules(spark):
    """Case, lexicon, counts, one-letter words."""
    counts = spark.createDataFrame([("Zo", 3), ("zo", 2), ("Pa", 9), ("pa", 1), ("rare", 1), ("often", 30), ("Mi", 1), ("GRAND", 2), ("a", 50), ("b", 50), ("None", 1)], "word string, cnt long")
    lexicon = spark.createDataFrame([("mi", 0.5), ("grand", 1e-9), ("None", 0.0)], "word string, freq double")
    kept = {r.word: r.kept for r in V.cleaned(counts, lexicon).collect()}
    assert kept == {"Zo": None, "zo": None, "Pa": None, "pa": None, "rare": None, "often": "often", "Mi": "mi", "GRAND": "GRAND", "a": "a", "b": "b", "None": "None"}
    kept = {r.word: r.kept for r in V.cleaned(counts, lexicon, valid_from=0).collect()}
    assert kept["Zo"] == "zo" and kept["Pa"] == "Pa"
    kept = {r.word: r.kept for r in V.cleaned(counts, lexicon, valid_from=0, unknown_to=2).collect()}
    assert kept["Zo"] is None and kept["often"] == "often" and kept["rare"] is None
    words = V.word_ids(V.kept_words(V.cleaned(counts, lexicon)))
    assert [(r.word, r.word_id) for r in words.orderBy("word_id").collect()][:2] == [("a", 17), ("often", 18)] and words.where("word = 'b'").count() == 0
    asked = spark.createDataFrame([("Often",), ("often",), ("OFTEN",), ("unheard",)], "word string")
    assert {r.word: r.word_id for r in V.with_ids(asked, words).collect()} == {"Often": 18, "often": 18, "OFTEN": 18, "unheard": None}


TALK = "le chat dort. le chat mange la souris. le chien mange la viande. la souris dort. l'ami mange. l'eau dort. Paris dort. le chat dort. d'ici le chien part. "


@pytest.fixture(scope="module")
def talk(spark):
    return _train(spark, TALK + "le Chaton dort. je vois le Chaton. ", Training(valid_from=0, discount=0.5))


def _ask(spark, m, before, how=None, after=None, exclude=None, **more):
    df = spark.createDataFrame([(1, before, after, exclude)], "prompt_id long, before string, after string, exclude array<int>")
    return predict(df, m, how or Prediction(dynamic=False), **more).orderBy("rank").collect()


def test_predictions(spark, talk):
    first = _ask(spark, talk, "le ")
    assert first[0].display == "chat" and first[0].insert == "chat" and first[0].remove_before == 0 and len(first) == 5
    assert abs(sum(r.score for r in _ask(spark, talk, "le ", Prediction(wanted=100))) - 1) < 1e-9
    typed = _ask(spark, talk, "le ch", after="at noir")
    assert {"chat", "chien"} <= {r.display for r in typed} and typed[0].display == "chat" and typed[0].insert == "at" and typed[0].remove_after == 2
    assert "Chaton" in [r.display for r in typed]  # the prefix in other spellings, where few words have it as it is
    capital = _ask(spark, talk, "Le chat dort. Ch")
    assert capital[0].display == "Chat" and capital[0].insert == "at"
    begin = _ask(spark, talk, "")
    assert all(r.display[0].isupper() for r in begin) and begin[0].display in ("Le", "La")
    assert _ask(spark, talk, "le zzz") == []  # a word that nothing begins with
    assert _ask(spark, talk, "le c", Prediction(least_typed=2)) == [] and _ask(spark, talk, "le ", Prediction(least_typed=1)) == []
    chat = next(r.word_id for r in first if r.display == "chat")
    assert "chat" not in [r.display for r in _ask(spark, talk, "le ", exclude=[chat])]
    pair = _ask(spark, talk, "l", Prediction(wanted=20))
    assert {"l'ami", "l'eau", "l'", "le", "la"} <= {r.display.lower() for r in pair}
    assert all(r.space != r.display.endswith("'") for r in pair)
    one = next(r for r in pair if r.display.lower() == "l'ami")
    assert one.word2_id is not None and one.score > 0
    far = _ask(spark, talk, "x" * 200 + " le ")
    assert far[0].display == "chat"
    debug = _ask(spark, talk, "le ", Prediction(debug=True))
    assert debug[0].level == 3 and debug[0].dynamic_p == 0


def test_typed_words_that_cannot_win_are_summed(spark, monkeypatch):
    """Of 300 words with a prefix few are scored; ranks, shares and ties are those of scoring all of them."""
    rng = np.random.default_rng(5)
    names = [f"{a}b{c}{d}" for a in "aA" for c in "cdefghijklmnop" for d in "qrstuvwxyza"] + ["ab'", "abc'"]
    text = "".join(f"le {names[int(rng.zipf(2.5)) % 308]} zut {name}. " for name in names)
    m = _train(spark, text, Training(valid_from=0, lowered_from=2.0))
    some = [r.word_id for r in m.words.where("startswith(word, 'ab')").orderBy("word_id").limit(4).collect()]
    asks = [(i, t, x) for i, (t, x) in enumerate((t, x) for t in ["ab", "le ab", "zzz ab", "abcq le Ab", "le AB", "zut a", "l"] for x in (None, some))]
    asks = spark.createDataFrame(asks, "prompt_id long, before string, exclude array<int>")
    sizes, kept = [], P._typed_words
    # With thin factors scores differ less than they are rounded: there all words are scored, and go by their texts.
    thin = replace(m, words=m.words.withColumn("prob_factor", F.lit(1e-13)))

    def asked(of):
        rows = predict(asks, of, Prediction(wanted=3)).select("prompt_id", "rank", "display", F.round("score", 10)).collect()
        return sorted(map(tuple, rows))

    monkeypatch.setattr(P, "_typed_words", lambda *a: sizes.append(((out := kept(*a))[0].count(), P._every(a[1], a[2]).count())) or out)
    few = [asked(m), asked(thin)]
    assert all(own * 2 < every for own, every in sizes), sizes
    monkeypatch.setattr(P, "_typed_words", lambda cases, used, begun, *a: (P._every(used, begun), None))
    assert few == [asked(m), asked(thin)] and few[0] and [r[:3] for r in few[0]] != [r[:3] for r in few[1]]


def test_spellings_of_a_text_lose_one(spark):
    m = _train(spark, "je vois Mot ici. je vois mot ici. je vois MOT ici. je vois Mot. tu vois MOT. je vois mot la. ", Training(valid_from=0, lowered_from=0.99))
    assert sorted(r.display for r in _ask(spark, m, "je vois ") if r.display.lower() == "mot") in (["MOT", "Mot"], ["Mot", "mot"], ["MOT", "mot"])


def test_user_words_and_dynamic_model(spark, talk, tmp_path):
    said = spark.createDataFrame([(7, "le chat ronronne. le chat ronronne. le chat ronronne")], "user long, text string")
    new = D.learned_words(dynamic.used(said), talk)
    assert [(r.word, r.use_count, r.user_word) for r in new.collect()] == [("ronronne", 3, True)]
    model.save_user(new, talk.dictionary_id, str(tmp_path / "user"))
    mine = model.with_user(talk, spark.read.parquet(str(tmp_path / "user")))
    assert mine.words.count() == talk.words.count() + 1 and talk.words.where("word = 'ronronne'").count() == 0
    with pytest.raises(model.DictionaryMismatch):
        model.with_user(talk, spark.read.parquet(str(tmp_path / "user")).withColumn("dictionary_id", F.lit("other")))
    grams = D.as_ids(dynamic.counted(said), mine.words, 4)
    model.save_dynamic(grams, str(tmp_path / "dynamic"))
    dyn = D.interpolated(spark.read.parquet(str(tmp_path / "dynamic")).select(*grams.columns), talk)
    assert math.isclose(dyn["weight"], max(9 / talk.grams.where("n = 1").count(), 0.05))
    shown = [r.display for r in _ask(spark, mine, "le chat ", Prediction(least_uses=2), dynamic=dyn)]
    assert shown[0] == "ronronne" and "ronronne" not in [r.display for r in _ask(spark, mine, "le chat ", Prediction(least_uses=10), dynamic=dyn)]
    assert {r.word_id for r in D.used_words(grams).collect()} >= {15, mine.words.where("word = 'ronronne'").first().word_id}
    off = V.tuned(talk.words).where("word = 'chat'").withColumn("force_invalid", F.lit(True)).withColumn("modified", F.lit(True))
    assert "chat" not in [r.display for r in _ask(spark, model.with_user(talk, off), "le ")]
    louder = V.tuned(talk.words).where("word = 'chien'").withColumn("prob_factor", F.lit(50.0)).withColumn("modified", F.lit(True))
    assert _ask(spark, model.with_user(talk, louder), "le ")[0].display == "chien"
    assert V.changed(V.overlaid(talk.words, louder)).count() == 1


def test_dynamic_shares_by_hand(spark, talk):
    """Two words: all beginnings of what is inserted are children, with a count of 0 unless inserted."""
    said = spark.createDataFrame([(1, "chat dort")], "user long, text string")
    grams = D.as_ids(dynamic.counted(said), talk.words, 4)
    ids = {r.word: r.word_id for r in talk.words.collect()}
    c, d, s = ids["chat"], ids["dort"], 15
    got = {tuple(x for x in (r.w1, r.w2, r.w3, r.w4) if x != NONE): r.cnt for r in grams.collect()}
    assert got == {(s,): 0, (c,): 1, (d,): 1, (s, c): 1, (c, d): 1, (s, s): 0, (s, s, c): 0, (s, c, d): 1, (s, s, c, d): 1}
    prob = {tuple(x for x in (r.w1, r.w2, r.w3, r.w4) if x != NONE): r.prob for r in D.interpolated(grams, talk)["grams"].collect()}
    assert prob[(c,)] == 0.5 and prob[(s, c)] == 0.5 and prob[(s, s, c)] == 0 and prob[(s, s, c, d)] == 0.5


def test_corrections(spark):
    m = _train(spark, "un élève mange. une élève appelle. il a mangé des pommes. l'école appelle. un homme mange des pommes. la femme appelle un homme. ", Training(valid_from=0))
    tree = C.families()
    assert C.Node.from_json(tree.to_json()).active() == tree.active()
    tree.children[0].enabled = False
    assert len(C.Node("x", False, tree.rules, tree.children).active()) == 0 and len(tree.active()) < len(C.families().active())

    def fixed(text, names, **how):
        rules = C.expanded(spark, [r for c in C.families().children if c.name in names for r in c.active()])
        out = C.corrected(spark.createDataFrame([(text,)], "looked string"), rules, m, Prediction(**how))
        words = {r.word_id: r.word for r in m.words.collect()}
        return {(words[r.word_id] + r.separator + words.get(r.word2_id, "")): round(r.factor, 6) for r in out.collect()}

    assert fixed("eleve", ["accents"]) == {"élève": 0.5}  # two rules: (0.5 + 0.5) / 2 / (0.5 + 0.5)
    assert "appelle" in fixed("apelle", ["doubled"]) and "pommes" in fixed("pomes", ["doubled"])
    assert fixed("eleve", ["accents"], most_cost=0.6) == {}
    assert "homme appelle" not in fixed("hommeappelle", ["splits"]) and "des pommes" in fixed("despommes", ["splits"])
    assert "homme" in fixed("honme", ["m before m, b, p", "doubled"])
    rules = C.expanded(spark, [r for c in C.families().children if c.name == "accents" for r in c.active()])
    shown = _ask(spark, m, "un eleve", Prediction(correction=True), rules=rules)
    assert [(r.display, r.correction, r.remove_before) for r in shown] == [("élève", True, 5)]
    twice = C.expanded(spark, [C.Rule(["a"], ["b"], both_ways=True), C.confusion("a", "b")])
    assert sorted((r.error, r.replacement) for r in twice.collect()) == [("a", "b"), ("b", "a")]


def test_shares_of_what_is_asked(spark, talk):
    """Counts alone give what the whole model gives, also where pairs of words and words that follow nothing are rated."""
    grams = talk.grams.select("n", "w1", "w2", "w3", "w4", "cnt")
    lean = model.counted(talk.words.select("word", "cnt", "word_id"), grams, talk.discounts)
    asked = grams.where("n = 3").select(*[F.col(f"w{k}").alias(f"c{k}") for k in (1, 2, 3)]).unionByName(spark.createDataFrame([(15, 15, 15), (NONE, 16, 17)], "c1 int, c2 int, c3 int"))
    rows = asked.crossJoin(talk.words.select("word_id").unionByName(spark.createDataFrame([(999,)], "word_id int")))
    levels = [sorted(map(tuple, N.levels(rows, *parts).collect())) for parts in ((talk.grams, talk.contexts), talk.around(asked), lean.around(asked))]
    assert levels[0] == levels[1] == levels[2] and any(r[-1] > 0 for r in levels[0])
    few = lean.around(asked.limit(1))
    assert few[0].where("n = 1").count() == talk.words.count() + 1 and few[0].count() < talk.grams.count() and few[1].count() < talk.contexts.count()
    rules = C.expanded(spark, [r for c in C.families().children if c.name in ("accents", "splits", "doubled") for r in c.active()])
    asks = spark.createDataFrame(list(enumerate(["le ", "le ch", "", "zzz ", "le chatdort", "Le chat dort. chatn"])), "prompt_id long, before string")
    how = Prediction(correction=True, wanted=9)
    assert sorted(map(tuple, predict(asks, talk, how, rules=rules).collect())) == sorted(map(tuple, predict(asks, lean, how, rules=rules).collect()))


def test_corrections_need_no_shares_of_the_whole_corpus(spark, monkeypatch):
    """correct_words trains to the counts; a stage's own tables go once it is written."""
    made = []
    monkeypatch.setattr(registry, "_TRAINED", {})
    monkeypatch.setattr(training, "discard", lambda df, f=training.discard: (made.extend(df.inputFiles()), f(df)))
    assert registry.correct_words(spark, SF).count() > 0
    (at, done), = registry._TRAINED.values()
    assert training.STAGES[done] == "grams" and made and not any(os.path.exists(f.removeprefix("file:")) for f in made)
    assert spark.read.parquet(f"{at}/grams").count() > 0


def test_accents_are_put_on_words_of_any_length(spark):
    """correct_accents asks for every word of the vocabulary, short ones too, and trains to the counts alone."""
    words = [r.word for r in registry.stage(spark, SF, "words").collect()]
    plain = str.maketrans("éèêëàâîïôöùûüç", "eeeeaaiioouuuc")
    assert {r.looked for r in registry._misspelt(spark, SF).collect()} == {w.lower().translate(plain) for w in words}
    got = {(r.looked, r.word) for r in registry.correct_accents(spark, SF).collect()}
    short = {(w.lower().translate(plain), w) for w in words if len(w) < 5 and w == w.lower() and w.translate(plain) != w}
    assert short and short <= got


def test_meanings(spark):
    text = "chat noir dort bien. chien noir dort mal. chat blanc mange bien, chien blanc mange mal."
    m = _train(spark, text, Training(valid_from=0))
    stops = m.words.where("word = 'bien'").select("word_id")
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    spots = M.meant(M.positions(docs), m.words, stops)
    index = M.indexed(spots, 50, 50)
    pairs = {(r.row, r.col): r.value for r in M.cooccurrences(spots, index, 4).collect()}
    known, stop = {r.word: r.word_id for r in m.words.collect()}, {"bien"}
    rows = {r.word_id: r.row for r in index.collect()}
    flat = [part if part.isalpha() else None for part in re.findall(r"\w+|[^\w]", text)]
    window, want = [], {}
    for part in flat:  # the window takes a step for separators too
        if part is not None:
            window.append(part)
            window = window[-5:]
        if len(window) >= 3:
            at = len(window) - 3
            a = window[at]
            if a in known and a not in stop:
                for j, b in enumerate(window):
                    if j != at and b in known and b not in stop:
                        for x, y in ((a, b), (b, a)):
                            key = (rows[known[x]], rows[known[y]])
                            want[key] = want.get(key, 0) + 1
    assert pairs == want
    vecs = M.meanings(M.cooccurrences(spots, index, 4), index, 3)
    assert all(abs(sum(x * x for x in r.vec) - 1) < 1e-6 for r in vecs.collect())
    dense = M.densities(spark.createDataFrame([(1, [1.0, 0.0])], "id long, vec array<double>"), 5).collect()
    assert dense[0].density == 0.0


def test_texts_are_read_for_meanings_without_a_row_for_each_term(spark):
    """Windows over random ids by brute force; texts that are empty, of separators alone or shorter than half a window."""
    docs = spark.createDataFrame([(1, "Chat noir.")], "doc_id long, text string")
    assert M.positions(docs).columns == ["m"] and "transform(" not in M.positions(docs)._jdf.queryExecution().optimizedPlan().toString().lower()
    rng = np.random.default_rng(3)
    texts = [[], [-2, -2], [20], *(rng.choice([-2, -1, 17, 18, 19, 20], size=int(n)).tolist() for n in rng.integers(0, 30, 40))]
    ids, row, col = np.array([17, 18, 20]), np.array([2, 0, 1]), np.array([-1, 0, 1])
    of = {int(i): (int(r), int(c)) for i, r, c in zip(ids, row, col, strict=True)}
    for half in (1, 3):
        want = {}
        for t in texts:
            places = [i for i, x in enumerate(t) if x != -2]
            for k, i in enumerate(places):
                if k + half < len(places) and t[i] in of:
                    end = k + half
                    weight = (places[end + 1] if end + 1 < len(places) else len(t)) - places[end]
                    for j in (j for n, j in enumerate(places) if n != k and abs(n - k) <= half and t[j] in of):
                        for a, b in ((t[i], t[j]), (t[j], t[i])):
                            if of[b][1] >= 0:
                                want[of[a][0], of[b][1]] = want.get((of[a][0], of[b][1]), 0) + weight
        r, c, v = M._near(pa.array(texts, pa.list_(pa.int32())), half, ids, row, col)
        assert {(int(x), int(y)): int(z) for x, y, z in zip(r, c, v, strict=True)} == want


def test_meanings_are_of_all_words(spark):
    """lsa_fill and lsa_svd have every word as a row and as a column, as counted by hand; fewer columns are a part of that."""
    spots = registry.durable(registry._spots(spark, SF))
    texts = [r.ids for r in spots.collect()]
    counts = {}
    for w in (w for t in texts for w in t if w >= 0):
        counts[w] = counts.get(w, 0) + 1
    index = registry._index(spark, SF, spots)
    order = sorted(counts, key=lambda w: (-counts[w], w))
    assert len(order) > 500 and [(r.word_id, r.cnt, r.row, r.col) for r in index.orderBy("row").collect()] == [(w, counts[w], i, i) for i, w in enumerate(order)]
    cells = set()
    for t in ([w for w in t if w != M.APART] for t in texts):
        for i, a in enumerate(t[:-3]):
            for b in (b for j, b in enumerate(t[max(0, i - 3) : i + 4], max(0, i - 3)) if j != i):
                if a >= 0 and b >= 0:
                    cells |= {(a, b), (b, a)}
    filled = registry.lsa_fill(spark, SF).collect()
    assert [(r.cells, r.share) for r in filled] == [(len(cells), round(len(cells) / len(order) ** 2, 10))]
    vecs = registry.lsa_svd(spark, SF).collect()
    assert sorted(r.word_id for r in vecs) == sorted({a for a, _ in cells}) and {(r.rank, r.length) for r in vecs} == {(8, 1.0)}
    whole = {(r.row, r.col, r.value) for r in M.cooccurrences(spots, index, 6).collect()}
    part = {(r.row, r.col, r.value) for r in M.cooccurrences(spots, M.indexed(spots, 50, 20), 6).collect()}
    assert part == {x for x in whole if x[0] < 50 and x[1] < 20}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_as_sql(spark, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert got
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "events", "embeddings", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted(con.sql(f"SELECT {names} FROM ({sql})").fetchall(), key=repr)


def test_imports_without_training_data_operators():
    import ast

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(top, "wordloom")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    tree = ast.parse(open(os.path.join(folder, f)).read())
                    names = [n.module or "" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom)] + [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names]
                    assert not any("llm" in n for n in names)
