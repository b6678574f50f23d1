"""Language identification by error-correcting output codes.

Every language has a codeword; a binary classifier per bit, linear in byte trigrams, predicts that bit
of a text. Decoding sums over the bits a logistic loss weighted by how reliable the bit was on the
training rows and takes the language with the least loss. A text whose two best languages are closer
than `margin` is flagged as ambiguous.

The classifiers are fitted on a bounded sample of labelled rows: at most TRAIN_ROWS, spread evenly over
the languages, drawn by a hash of the id. Whole texts are read in training and in prediction.

Defined results. A text that is null or has no letter is `und` with score 0 and not ambiguous; so is
every text when no row is labelled. With one learned language every other text has it with score 1.
Repeated rows get equal results. Extra columns are ignored by predicted() and kept by recognised().
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import pieces, utf8

#: The most labelled rows that are fitted on.
TRAIN_ROWS = 3000
#: Hashed trigrams.
FEATURES = 4096
#: Steps of gradient descent and the penalty on squared weights.
STEPS, PENALTY = 150, 1e-4
#: Difference in loss for each bit under which the two best languages count as ambiguous.
MARGIN = 0.05
#: recognised() drops documents that are `und`, and ambiguous ones whose score is lower than so many times
#: that of an even guess among the learned languages.
LEAST_TIMES = 1.2

_MAP = np.full(256, 32, dtype=np.uint8)
_MAP[97:123] = np.arange(97, 123)
_MAP[65:91] = np.arange(97, 123)
_MAP[128:] = np.arange(128, 256)
_SPACES = 0x202020
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def trigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature of every byte trigram of the texts, each set between two spaces; whether it counts; n+1 offsets."""
    n = len(offs) - 1
    text = np.full(len(buf) + 2 * n, 32, dtype=np.uint8)
    at = np.arange(len(buf)) + np.repeat(2 * np.arange(n) + 1, np.diff(offs))
    low = _MAP[buf]
    # Capital letters of Latin-1 as UTF-8: the small ones are 32 higher in the second byte.
    low[1:][(buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E)] |= 0x20
    text[at] = low
    gram = text[:-2].astype(np.uint32) | text[1:-1].astype(np.uint32) << np.uint32(8) | text[2:].astype(np.uint32) << np.uint32(16)
    counts = gram != _SPACES
    feature = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    bounds = offs + 2 * np.arange(n + 1)
    # The two trigrams that begin at the end of a text and reach into the next one don't count.
    ends = bounds[1:]
    for back in (1, 2):
        p = ends - back
        counts[p[p < len(counts)]] = False
    return feature, counts, bounds


def codewords(languages: int) -> np.ndarray:
    """A row of +1 and -1 for each language: all splits in two for up to five, else random balanced ones."""
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 5:
        splits = [(1,) + rest for rest in itertools.product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(splits, dtype=float).T
    rng = np.random.Generator(np.random.PCG64(7))
    bits = math.ceil(10 * math.log2(languages))
    best, apart = None, -1
    for _ in range(50):
        half = np.array([1, -1] * languages)[:languages]
        code = np.stack([rng.permutation(half) for _ in range(bits)], axis=1).astype(float)
        least = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding

    def decode(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score and whether it is ambiguous, for rows of bit predictions."""
        n = len(f)
        if len(self.languages) == 1:
            return np.zeros(n, int), np.ones(n), np.zeros(n, bool)
        loss = (self.trust * np.logaddexp(0, -f[:, None, :] * self.code[None])).sum(2)
        best = loss.argmin(1)
        low = loss[np.arange(n), best]
        p = 1 / np.exp(low[:, None] - loss).sum(1)
        gap = np.partition(loss, 1, axis=1)[:, 1] - low
        return best, p, gap < MARGIN * self.trust.sum()


def features_of(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Shares of the hashed trigrams, a row for each text."""
    feature, counts, bounds = trigrams(buf, offs)
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(bounds))[: len(feature)]
    x = np.bincount(row[counts] * FEATURES + feature[counts], minlength=n * FEATURES).reshape(n, FEATURES).astype(np.float32)
    return x / np.maximum(x.sum(1, keepdims=True), 1)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Model:
    """Logistic regression of every bit by accelerated gradient descent; languages weigh alike."""
    code = codewords(len(languages))
    bits = code.shape[1]
    scale = 1 / (x.std(0) + 1e-4)
    mean = x.mean(0)
    z = (x - mean) * scale / math.sqrt(FEATURES)
    target = code[y]
    share = (1 / np.bincount(y, minlength=len(languages)))[y][:, None] / len(languages)
    w, b = np.zeros((FEATURES, bits)), np.zeros(bits)
    vw, vb = w.copy(), b.copy()
    rate = 8.0
    for step in range(STEPS):
        f = z @ vw.astype(np.float32) + vb
        g = -target * share / (1 + np.exp(np.clip(target * f, -30, 30)))
        nw, nb = vw - rate * (z.T @ g.astype(np.float32) + PENALTY * vw), vb - rate * g.sum(0)
        k = step / (step + 3)
        vw, vb, w, b = nw + k * (nw - w), nb + k * (nb - b), nw, nb
    f = z @ w + b
    wrong = np.clip((share * (np.sign(f) != target)).sum(0), 1e-3, 0.499)
    trust = np.log((1 - wrong) / wrong)
    flat = (w * scale[:, None] / math.sqrt(FEATURES)).astype(np.float32)
    return Model(languages, code, flat, b - mean @ flat, trust / trust.mean() if bits else trust)


def train(labelled: DataFrame) -> Model | None:
    """A model from (doc_id, text, lang); None without labelled rows."""
    spark = labelled.sparkSession
    small_batches(spark, 256)
    labelled = labelled.where("lang is not null").selectExpr("cast(doc_id as long) doc_id", "text", "cast(lang as string) lang")
    seen = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not seen:
        return None
    languages = sorted(seen)
    each = max(1, TRAIN_ROWS // len(languages))
    rate = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, 1.1 * each / seen[lang]))])
    draw = (F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5).alias("draw")
    some = labelled.withColumn("draw", draw).where(F.col("draw") < rate[F.col("lang")]).select("draw", "lang", "text")

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column(2))
            for i, j in pieces(offs, 1 << 20):
                x = features_of(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["draw", "lang", "x"])

    rows = some.mapInArrow(run, "draw double, lang string, x binary").collect()
    rows.sort(key=lambda r: (r.lang, r.draw, r.x))
    used = [r for _, own in itertools.groupby(rows, key=lambda r: r.lang) for r in itertools.islice(own, each)]
    x = np.stack([np.frombuffer(r.x, "<f2") for r in used]).astype(np.float32) if used else np.zeros((0, FEATURES), np.float32)
    languages = sorted({r.lang for r in used})
    return fit(x, np.array([languages.index(r.lang) for r in used]), languages) if used else None


def _letters(batch_texts: pa.Array, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    total = np.concatenate([[0], np.cumsum(_LETTER[buf])])
    has = total[offs[1:]] > total[offs[:-1]]
    for i in np.flatnonzero(~has & (np.diff(offs) > 0)):
        has[i] = any(map(str.isalpha, batch_texts[int(i)].as_py()))
    return has


def predict_batch(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    buf, offs = utf8(texts)
    n = len(offs) - 1
    lang, score, unsure = ["und"] * n, np.zeros(n), np.zeros(n, bool)
    if model is None or not n:
        return lang, score, unsure
    has = _letters(texts, buf, offs)
    bits = len(model.bias)
    for i, j in pieces(offs, 1 << 20):
        some, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        f = np.zeros((j - i, bits))
        if bits:
            for k in range(j - i):
                # One text can be long: its trigrams are weighed a few megabytes at a time.
                one = some[at[k] : at[k + 1]]
                total, count = np.zeros(bits), 0
                for a in range(0, max(1, len(one)), 1 << 20):
                    part = one[a : a + (1 << 20)]
                    feature, counts, _ = trigrams(part, np.array([0, len(part)]))
                    seen = np.bincount(feature[counts], minlength=FEATURES)
                    total += seen @ model.weights
                    count += int(seen.sum())
                f[k] = total / max(1, count) + model.bias
        best, p, close = model.decode(f)
        for k in range(i, j):
            if has[k]:
                lang[k], score[k], unsure[k] = model.languages[best[k - i]], p[k - i], close[k - i]
    return lang, score, unsure


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for each row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            lang, score, unsure = predict_batch(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def recognised(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns kept, whose language is recognised."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            lang, score, unsure = predict_batch(model, batch.column(batch.schema.get_field_index("text")))
            least = LEAST_TIMES / max(1, len(model.languages) if model else 1)
            keep = [x != "und" and not (u and s < least) for x, s, u in zip(lang, score, unsure, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
