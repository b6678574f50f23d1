import random
import re

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from wordloom.llm.mixing import mixture

from .test_bpe import RANKS
from .test_jaccard_join import brute as near_groups

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, maybe boolean, sha string, tokens int, component string"
WORDS = {"en": "the of and house river stone light water under bridge seven green walking again", "de": "der die und das haus fluss stein licht wasser unter brücke sieben grün gehen wieder", "fr": "le la et maison fleuve pierre lumière eau sous pont sept vert marcher encore", "es": "el los y casa río piedra luz agua bajo puente siete verde caminar otra"}


def corpus():
    r = random.Random(12)
    rows = []
    for i in range(160):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(25, 60))), lang, f"s{r.randrange(3)}"))
    rows += [(200 + i, re.sub(r" ", "  ", rows[i][1], count=3), *rows[i][2:]) for i in range(0, 20, 2)]  # equal but for spaces
    rows += [(300 + i, rows[i][1] + " und", *rows[i][2:]) for i in range(1, 20, 2)]  # near copies
    rows += [(400, None, "en", "s0"), (401, "", None, None), (402, " \n", "de", "s1"), (403, "12345 !!! 678", "en", "s1"), (None, "a house without a number but with a river and a bridge", None, "s2"), rows[5], rows[5], (404, "water " * 40_000, "en", None)]
    return [(*row, 0, 1, True, "x", 2, "y") for row in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave."""
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(corpus(), SCHEMA).repartition(4).write.parquet(f"{at}/documents.parquet")
    docs, out = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        got = spark.read.parquet(f"{at}/{name}")
        out[name] = (docs, got)
        docs = got
    return at, out


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=str)


def test_columns_stay(spark, stages):
    _, out = stages
    assert list(out) == ["language", "exact", "near", "mix", "tokenise"]
    for name, (docs, got) in out.items():
        more = {"n_tokens", "token_ids", "intact"} if name == "tokenise" else set()
        assert set(got.columns) - set(docs.columns) == more and set(docs.columns) <= set(got.columns)
        assert got.count() == 0 or got.select(docs.columns).exceptAll(docs).count() == 0  # rows are kept whole, none made


def test_language(spark, stages):
    docs, got = stages[1]["language"]
    lost = docs.exceptAll(got).collect()
    assert {r.doc_id for r in lost} == {400, 401, 402, 403}  # no text, or no letter


def test_exact(spark, stages):
    docs, got = stages[1]["exact"]
    groups = {}
    for r in docs.collect():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text), []).append(r)
    want = [min(g, key=lambda r: (-len(r.text), r.doc_id is None, r.doc_id or 0)).doc_id for g in groups.values()]
    assert ids(got) == sorted(want, key=str)


def test_near(spark, stages):
    docs, got = stages[1]["near"]
    rows = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]
    first = {c for _, _, c in near_groups(rows)}
    assert {-1 if i is None else i for i in ids(got)} == first and len(ids(got)) == len(first)


def test_mix(spark, stages):
    docs, got = stages[1]["mix"]
    told = mixture(docs)
    assert ids(got) == ids(told.where("kept")) and 0 < got.count() < docs.count()
    assert told.where("rate >= 1 and not kept").count() == 0


def test_tokenise(spark, stages):
    docs, got = stages[1]["tokenise"]
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert got.count() == docs.count()
    for r in got.collect():
        want = library.encode_ordinary(r.text)
        assert r.n_tokens == len(want) and bytes(r.token_ids) == b"".join(x.to_bytes(4, "little") for x in want) and r.intact


def test_run_is_its_stages(spark, stages):
    at, out = stages
    got = corpus_pipeline.run(spark, at)
    assert got.exceptAll(out["tokenise"][1]).count() == 0 and ids(got) == ids(out["tokenise"][1])


def test_empty_table(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0
