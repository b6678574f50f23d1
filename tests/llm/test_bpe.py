import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from wordloom.llm.bpe import Vocabulary, decoded, digests, encoded, read_ranks

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = Vocabulary(read_ranks(PATH), P.PATTERN)


def ids(text):
    return np.frombuffer(OURS.encode([text])[0], "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab '\n\t.,1é  \x1c\x85"))))
def test_as_the_library(text):
    assert ids(text) == LIBRARY.encode_ordinary(text)
    assert OURS.decode(OURS.encode([text])[0]) == text.encode()


def test_every_character_is_cut_alike():
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 4000):
        text = "".join(f"a{c}b {c}{c}  {c}1" for c in chars[i : i + 4000])
        assert ids(text) == LIBRARY.encode_ordinary(text), i


def test_long_pieces_and_texts():
    r = random.Random(1)
    for text in ("a" * 50_000, "ab" * 9_999, " " * 3000 + "x", "".join(r.choice("etaoin") for _ in range(20_000)), "the cat " * 60_000):
        assert ids(text) == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize("rows", [[], [(1, "Hello <|endoftext|> wörld"), (2, None), (3, ""), (None, "Hello"), (2, "again")]])
def test_tables(spark, rows):
    df = spark.createDataFrame([(i, t, 0, b"x", i) for i, t in rows], "doc_id long, text string, n_tokens int, token_ids binary, extra long")
    want = [(i, len(x := LIBRARY.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, digests(df, PATH, P.PATTERN).collect()), key=str) == sorted(want, key=str)
    back = decoded(encoded(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert back.columns == ["doc_id", "text", "extra", "n_tokens", "token_ids", "decoded"]
    assert sorted((r.doc_id, bytes(r.decoded).decode()) for r in back.collect() if r.doc_id) == sorted((i, t or "") for i, t in rows if i)


def test_decoding_takes_no_second_worker(spark):
    """Encoding and checking what the ids give back is one step, so that a task has one vocabulary in memory."""
    rows = [(1, "Hello wörld"), (2, None), (3, ""), (4, "again\x00 \U0001f600")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, intact string")
    out = corpus_pipeline.tokenise(spark, df, "")
    assert out.columns == ["doc_id", "text", "n_tokens", "token_ids", "intact"]
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.doc_id: (r.n_tokens, bytes(r.token_ids), r.intact) for r in out.collect()}
    want = {i: LIBRARY.encode_ordinary(t or "") for i, t in rows}
    assert got == {i: (len(x), np.array(x, "<u4").tobytes(), True) for i, x in want.items()}
