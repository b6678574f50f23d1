"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in its words, whose weights are not negative: no number of harmless
words makes up for an offending one; a document's is the noisy-or of its sentences, one
minus the product of their complements. Weights are fitted to document labels through that noisy-or, so
that only sentences that explain a label get a high score; those are the ones that located() returns.

Fitting takes a bounded sample of labelled rows: TRAIN_ROWS at most, half of each label as far as there
are, drawn by a hash of the id. Words count that stand in LEAST_DOCS of its documents or more.

Defined results. Null, empty and wordless texts have score 0. Without labelled rows every score is 0.
Repeated rows get equal scores; a doc_id with several labels counts once for each. Sentences end at
`.`, `!`, `?` and line ends; words and what they begin with are features; words are runs of ASCII letters, digits and non-ASCII bytes, A-Z as a-z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .words import bounds, hashes, pieces, utf8

TRAIN_ROWS, LEAST_DOCS = 4000, 4
FEATURE_BITS, STEPS, RATE, PENALTY = 18, 200, 0.15, 2e-4
#: A word's features are itself (0) and its first bytes, so that inflected forms share some.
HEADS = (0, 3, 4, 5, 6)
#: Where a sentence's own probability is this or more, it is reported as offending.
OFFENDING = 0.5

_GAP = np.ones(256, dtype=bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 13, 33, 46, 63]] = True


def features(buf: np.ndarray, offs: np.ndarray):
    """Features of each word, the sentence it is in (numbered through), the text of each sentence, word spans."""
    starts, ends, at = bounds(buf, offs, _GAP)
    feature = np.stack([hashes(buf, starts, np.minimum(starts + k, ends) if k else ends) + np.uint64(((k << 40) * 0x9E3779B97F4A7C15) % (1 << 64)) for k in HEADS], axis=1)
    feature = (feature >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
    stops = np.concatenate([[0], np.cumsum(_STOP[buf])]) if len(buf) else np.zeros(1, int)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    mark = stops[starts] + text  # a new text begins a new sentence
    first = np.concatenate([[True], (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])]) if len(mark) else np.zeros(0, bool)
    sentence = np.cumsum(first) - 1
    return feature, sentence, text[first], starts, ends


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, feature, sentence, count):
        return self.bias + np.bincount(sentence, self.weights[feature].sum(1), count)


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """docs: features, a row for each word, and sentence numbers of each document."""
    size = 1 << FEATURE_BITS
    seen = np.zeros((2, size))
    for (f, _), label in zip(docs, y, strict=True):
        seen[label, np.unique(f)] += 1
    used = np.flatnonzero(seen.sum(0) >= LEAST_DOCS)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    n = np.maximum(np.bincount(y, minlength=2), 1)
    odds = np.log((seen[1, used] + 0.5) / (n[1] + 1)) - np.log((seen[0, used] + 0.5) / (n[0] + 1))
    feature, sentence, doc, top, count = [], [], [], 0, len(docs)
    for d in range(count):
        f, s = docs[d]
        docs[d] = None  # what follows takes its place in memory
        own = place[f]
        ok = own >= 0
        feature.append(own[ok])
        sentence.append(np.broadcast_to((s + top).astype(np.int32)[:, None], own.shape)[ok])
        own = int(s.max()) + 1 if len(s) else 0
        doc.append(np.full(own, d))
        top += own
    feature, sentence, doc = map(np.concatenate, (feature, sentence, doc))
    w, b = np.where(odds > 1.5, odds, 0.0) * 0.3, -5.0
    share = (0.5 / n)[y]
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + np.bincount(sentence, w[feature], top)
        p = _sigmoid(z)
        q = np.bincount(doc, -np.logaddexp(0, z), count)
        ratio = np.where(y == 1, -1 / np.expm1(np.clip(-q, 1e-9, 50)), 1.0)  # e^q / (1 - e^q), negated, for label 1
        g = (share * np.where(y == 1, np.maximum(ratio, -50), 1.0))[doc] * p
        gw = np.bincount(feature, g[sentence], len(used)) + PENALTY * (1 + w)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        w = np.maximum(0.0, w - RATE * fix * m / (np.sqrt(v) + 1e-6))
        b = min(-1.0, b - RATE * fix * mb / (np.sqrt(vb) + 1e-6))
    weights = np.zeros(size)
    weights[used] = w
    return Model(weights, float(b))


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from (doc_id, text) and (doc_id, toxic); None without labels of both kinds."""
    small_batches(docs.sparkSession, 256)
    labels = labels.where("toxic in (0, 1) and doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "cast(toxic as int) toxic")
    seen = {r.toxic: r.n for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return None
    rate = F.when(F.col("toxic") == 1, min(1.0, 0.55 * TRAIN_ROWS / seen[1])).otherwise(min(1.0, 0.55 * TRAIN_ROWS / seen[0]))
    some = labels.withColumn("draw", F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5).where(F.col("draw") < rate)
    some = some.orderBy("draw", "doc_id", "toxic").limit(int(1.2 * TRAIN_ROWS))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(some), "doc_id").select("draw", "toxic", "text")

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column(2))
            for i, j in pieces(offs, 1 << 20):
                f, s, text, _, _ = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                edge = np.searchsorted(text[s], np.arange(j - i + 1)) if len(s) else np.zeros(j - i + 1, int)
                out = [(f[a:b], (s[a:b] - s[a]) if b > a else s[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([x.astype(np.int32).tobytes() for x, _ in out], pa.binary()), pa.array([x.astype(np.int32).tobytes() for _, x in out], pa.binary())], ["draw", "toxic", "f", "s"])

    rows = sorted(rows.mapInArrow(run, "draw double, toxic int, f binary, s binary").collect(), key=lambda r: (r.draw, r.toxic, r.f))[:TRAIN_ROWS]
    y = np.array([r.toxic for r in rows], dtype=int)
    if len(set(y.tolist())) < 2:
        return None
    return fit([(np.frombuffer(r.f, np.int32).reshape(-1, len(HEADS)), np.frombuffer(r.s, np.int32).astype(int)) for r in rows], y)


def score_batch(model: Model | None, texts: pa.Array):
    """Score of each text; text, byte span and probability of each sentence with words."""
    buf, offs = utf8(texts)
    score = np.zeros(len(offs) - 1)
    found = []
    if model is not None:
        for i, j in pieces(offs, 1 << 20):
            f, s, text, starts, ends = features(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            if not len(f):
                continue
            z = model.sentences(f, s, len(text))
            score[i:j] = -np.expm1(np.bincount(text, -np.logaddexp(0, z), j - i))
            first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            last = np.append(first[1:], len(s)) - 1
            base = (offs[i : j + 1] - offs[i])[text]
            found.append((text + i, starts[first] - base, ends[last] - base, _sigmoid(z)))
    return score, [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, int)] * 4


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted, n_offending, worst sentence's probability."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            score, (text, _, _, p) = score_batch(model, batch.column(1))
            n = len(score)
            worst = np.zeros(n)
            np.maximum.at(worst, text, p)
            bad = np.bincount(text[p >= OFFENDING], minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(bad.astype(np.int64)), pa.array(worst)], ["doc_id", "score", "predicted", "n_offending", "worst"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, n_offending long, worst double")


def located(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, start, stop, p, sentence: the offending sentences as byte spans and texts."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            _, (text, start, stop, p) = score_batch(model, batch.column(1))
            keep = np.flatnonzero(p >= OFFENDING)
            raw = {t: (batch.column(1)[int(t)].as_py() or "").encode() for t in np.unique(text[keep])}
            said = [raw[text[k]][start[k] : stop[k]].decode(errors="replace") for k in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[keep])), pa.array(start[keep]), pa.array(stop[keep]), pa.array(p[keep]), pa.array(said, pa.string())], ["doc_id", "start", "stop", "p", "sentence"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, start long, stop long, p double, sentence string")
