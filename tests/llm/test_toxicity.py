import random

import numpy as np

from wordloom.llm.queries import op5_toxicity
from wordloom.llm.toxicity import located, scored, train


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        said = [" ".join(f"w{r.randrange(300)}" for _ in range(r.randint(3, 12))) for _ in range(r.randint(1, 15))]
        bad = r.random() < 0.3
        if bad:
            k = r.randrange(len(said))
            said[k] += " " + r.choice(["Vile", "nasty,", "scummy"])
        out.append((i, ". ".join(said), int(bad)))
    return out


def test_learns_and_locates(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, 0.0) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:700]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = train(docs, labels)
    got = {r.doc_id: r for r in scored(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows[700:]]) > 0.95
    found = located(docs.where("doc_id >= 700"), model).collect()
    assert found and np.mean([any(b in r.sentence.lower() for b in ("vile", "nasty", "scummy")) for r in found]) > 0.9
    odd = [(1, None), (2, ""), (3, "...!?"), (4, "w1 " * 100_000), (None, "vile"), (1, None)]
    out = scored(spark.createDataFrame(odd, "doc_id long, text string"), model).collect()
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out) and [r.score for r in out if r.doc_id in (1, 2, 3)] == [0] * 4
    assert train(docs, labels.where("toxic = 1")) is None
    assert scored(docs.limit(3), None).where("score > 0").count() == 0


def test_held_out_accuracy(spark):
    """English has some 200 toxic rows to learn from here, the other languages some 40 each, inflected."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").join(docs, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == 1 for r in got if r.toxic == 1 and r.lang == "en"]) > 0.95
    assert np.mean([r.predicted == 1 for r in got if r.toxic == 1]) > 0.75
    assert np.mean([r.predicted == 1 for r in got if r.toxic == 0]) < 0.03
