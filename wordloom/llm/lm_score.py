"""LM scoring with a weighted backoff automaton over words.

States are the words that the training texts have as contexts, the start of a text, and the root. An
arc of a state is a bigram with weight (c - D) / C; its failure arc leads to the root and weighs
D * followers / C; the root has all words with additive smoothing, seen or not. A text is read once from
left to right: each token is looked up in the state that the token before it leads to, the failure
weight is paid, and the logarithms add up.

Counting and looking up are one exchange: each block of texts sends its distinct contexts and their
followers, with its training counts, to the bucket of the context; the bucket sums them over all blocks
and sends each block the counts of what it asked. Nothing is collected but four totals.

Defined results. Null text counts as empty, whose one token is the end. Words are `[^\\x20\\x09-\\x0D]+`
with A-Z as a-z, compared by 64-bit hashes, the followers of one context by 48 bits of them. Without training rows c, N and V are 0 and every
probability is that of an unseen word. Repeated rows are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, partitions, release, small_batches
from .words import bounds, hashes, pieces, utf8

#: Stand-ins for the end and the start of a text, and bytes of text in a block.
END, START, BLOCK_BYTES = np.uint64(0x5EED0E0D5EED0E0D), np.uint64(0x57A1257A12575A17), 8 << 20


def tokens(texts: pa.Array):
    """Hashes of the tokens of all texts, each text ended, and n+1 offsets of the texts."""
    buf, offs = utf8(texts)
    out, lens = [], []
    for i, j in pieces(offs, 1 << 20):
        some, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, words_at = bounds(some, at)
        words = hashes(some, starts, ends)
        out.append(np.insert(words, words_at[1:], END))
        lens.append(np.diff(words_at) + 1)
    n = np.concatenate(lens) if lens else np.zeros(0, int)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(n)])


def gathered(batches):
    """Blocks of rows, each one row of (block, compressed rows): nothing shuffles."""

    def row(parts):
        table = pa.Table.from_batches(parts)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        data = sink.getvalue().to_pybytes()
        block = xxhash.xxh64_intdigest(data) - (1 << 63)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([zstandard.ZstdCompressor(level=3).compress(data)], pa.binary())], ["block", "data"])

    parts, size = [], 0
    for batch in batches:
        _, offs = utf8(batch.column(1))
        for i, j in pieces(offs, BLOCK_BYTES):
            parts.append(batch.slice(i, j - i))
            size += int(offs[j] - offs[i])
            if size > BLOCK_BYTES:
                yield row(parts)
                parts, size = [], 0
    if parts:
        yield row(parts)


def block_of(data: bytes):
    """A block's tokens, text offsets, distinct words and pairs (context, word), sorted."""
    table = pa.ipc.open_stream(zstandard.decompress(data)).read_all()
    toks, offs = tokens(table.column("text"))
    words, at = np.unique(np.concatenate([toks, [START]]).astype(np.uint64), return_inverse=True)
    start, at = at[-1], at[:-1]
    before = np.concatenate([[start], at[:-1]])
    before[offs[:-1]] = start
    pair, pair_at = np.unique(before * len(words) + at, return_inverse=True)
    held = np.asarray(table.column("held_out").to_pylist(), dtype=bool)
    train = np.repeat(~held, np.diff(offs))
    return table, offs, words, at, train, pair, pair_at


def _cut(words, buckets):
    """The buckets that sorted words fall into, and the edges of these buckets in the words."""
    bucket = (((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    some, first = np.unique(bucket, return_index=True)
    return some.tolist(), np.append(first, len(words))


def asked(buckets: int):
    def one(block, data):
        _, _, words, at, train, pair, pair_at = block_of(data)
        count = np.bincount(at, train, len(words)).astype(np.uint64)
        pairs = np.bincount(pair_at, train, len(pair)).astype(np.uint64)
        context, word = pair // len(words), pair % len(words)
        some, edge = _cut(words, buckets)
        pair_edge = np.searchsorted(context, edge)
        rows = []
        for b, i, j, k, m in zip(some, edge[:-1], edge[1:], pair_edge[:-1], pair_edge[1:], strict=True):
            per = np.diff(np.searchsorted(context[k:m], np.arange(i, j + 1)))
            rows.append((b, block, words[i:j].tobytes(), _small(count[i:j]), per.astype(np.uint32).tobytes(), _planes(words[word[k:m]]), _small(pairs[k:m])))
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["bucket", "block", "words", "counts", "per", "next", "pairs"])

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield one(block, data.as_py())

    return run


def _planes(x: np.ndarray) -> bytes:
    """The upper six bytes of each hash, byte by byte; followers of a context differ in them."""
    return np.ascontiguousarray(x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _joined(data: bytes) -> np.ndarray:
    own = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, 2:] = own.T
    return out.view(">u8").ravel().astype(np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Counts, mostly below 255, as a byte each; the others follow in eight."""
    big = x >= 255
    return np.where(big, 255, x).astype(np.uint8).tobytes() + x[big].astype(np.uint64).tobytes()


def _large(data: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(data, np.uint8, n).astype(np.int64)
    low[low == 255] = np.frombuffer(data, np.uint64, offset=n)
    return low


def summed(table: pa.Table) -> pa.Table:
    """Totals of a bucket, sent back to each block in the order it asked, with the bucket's statistics."""
    blocks, col = table.column("block").to_pylist(), {c: table.column(c).to_pylist() for c in ("words", "counts", "per", "next", "pairs")}
    words = [np.frombuffer(x, np.uint64) for x in col["words"]]
    per = [np.frombuffer(x, np.uint32) for x in col["per"]]
    every, index = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(index, np.concatenate([_large(x, len(w)) for x, w in zip(col["counts"], words, strict=True)])).astype(np.int64)
    nexts = np.concatenate([_joined(x) for x in col["next"]])
    context = index[np.repeat(np.arange(len(index)), np.concatenate(per))]
    own = np.concatenate([_large(x, len(y) // 6) for x, y in zip(col["pairs"], col["next"], strict=True)])
    order = np.lexsort((nexts, context))
    sorted_context, sorted_next = context[order], nexts[order]
    new = np.concatenate([[True], (sorted_context[1:] != sorted_context[:-1]) | (sorted_next[1:] != sorted_next[:-1])]) if len(order) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    total = np.bincount(group, own[order], group[-1] + 1 if len(group) else 0).astype(np.int64)
    pair_total = np.empty(len(order), np.int64)
    pair_total[order] = total[group]
    of = sorted_context[new]
    after = np.bincount(of, total, len(every)).astype(np.int64)
    followers = np.bincount(of[total > 0], minlength=len(every)).astype(np.int64)
    stats = np.array([count.sum(), (count > 0).sum(), (total == 1).sum(), (total == 2).sum()], np.int64)
    out, a, b = [], 0, 0
    for n, (x, p) in enumerate(zip(words, per, strict=True)):
        i, j = index[a : a + len(x)], pair_total[b : b + int(p.sum())]
        out.append((blocks[n], table.column("bucket")[0].as_py(), len(i), _small(count[i]), _small(after[i]), _small(followers[i]), _small(j), *(stats.tolist() if n == 0 else [0] * 4)))
        a, b = a + len(x), b + len(j)
    cols = list(zip(*out, strict=True))
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4, *[pa.int64()] * 4]
    return pa.table([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "bucket", "size", "counts", "after", "followers", "pairs", "n", "v", "once", "twice"])


ANSWER = "block long, bucket int, size int, counts binary, after binary, followers binary, pairs binary, n long, v long, once long, twice long"


def traversed(n: int, v: int, discount: float):
    """Reads the texts of a block through the automaton."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        table, offs, words, at, _, pair, pair_at = block_of(texts.column("data")[0].as_py())
        answers = answers.sort_by([("bucket", "ascending")])
        count, after, followers = (np.concatenate([_large(x, k) for x, k in zip(answers.column(c).to_pylist(), answers.column("size").to_pylist(), strict=True)]).astype(np.float64) for c in ("counts", "after", "followers"))
        # The pairs of a bucket are those of its words, in order.
        sizes, raw, context = [], answers.column("pairs").to_pylist(), pair // len(words)
        edge = np.searchsorted(context, np.concatenate([[0], np.cumsum(answers.column("size").to_pylist())]))
        sizes = np.diff(edge)
        pairs = np.concatenate([_large(x, int(k)) for x, k in zip(raw, sizes, strict=True)]).astype(np.float64)
        root = (count + 0.5) / (n + 0.5 * (v + 1))
        state = context  # the state in which each pair's word is read
        known = after[state] > 0
        fail = np.where(known, discount * followers[state] / np.maximum(after[state], 1), 1.0)
        arc = np.where(pairs > 0, np.maximum(pairs - discount, 0) / np.maximum(after[state], 1), 0.0)
        step = np.log10(arc + fail * root[pair % len(words)])
        return pa.table(
            [
                table.column("doc_id"), table.column("held_out"), pa.array(np.diff(offs)), pa.array(np.add.reduceat((count[at] > 0).astype(np.int64), offs[:-1])), pa.array(np.full(len(table), n)),
                pa.array(np.add.reduceat(np.log10(root)[at], offs[:-1])), pa.array(np.add.reduceat(step[pair_at], offs[:-1])), pa.array(np.add.reduceat((pairs[pair_at] > 0).astype(np.int64), offs[:-1])),
            ],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_arcs"],
        )

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_arcs long"


def scores(docs: DataFrame, held_out) -> DataFrame:
    """One row per row of docs; learns from those where held_out, a column of docs, is not true."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    blocks = durable(rows.mapInArrow(gathered, "block long, data binary").withColumn("block", F.xxhash64("block", F.monotonically_increasing_id())))
    buckets = max(partitions(spark), blocks.count())
    questions = blocks.mapInArrow(asked(buckets), "bucket int, block long, words binary, counts binary, per binary, next binary, pairs binary")
    answers = durable(questions.groupBy("bucket").applyInArrow(summed, ANSWER))
    del questions
    release(spark)
    n, v, once, twice = (x or 0 for x in answers.agg(*[F.sum(c) for c in ("n", "v", "once", "twice")]).first())
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    return blocks.groupBy("block").cogroup(answers.drop("n", "v", "once", "twice").groupBy("block")).applyInArrow(traversed(n, v, discount), RESULT)
