"""Byte-level BPE encoding and decoding by merge replay over a corpus of distinct pieces.

A block of texts is cut into pieces by the pre-tokenisation pattern; its distinct pieces, those not
met before, form one corpus of symbols. The pairs of the corpus are indexed by rank and position, and
merges are replayed in rank order: a sweep applies the lowest rank of every piece at all positions that
the index has for it, and a merge touches the merged symbol's two neighbours only, whose new pairs
replace theirs in the index. Pieces share no symbols, so each gets the merges of the whole corpus' rank
order that fall into it, in that order. Texts are then the concatenation of their pieces' ids, so
nothing shuffles.

Defined results. Null text counts as empty and has no tokens. Special tokens are ordinary text. Texts
of any length are encoded whole. Ids are little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Pieces kept from block to block by a Python worker; beyond it they are encoded anew.
KEPT_PIECES = 600_000
#: Symbols whose merges are replayed together.
CORPUS_BYTES = 1 << 22
#: Stands for the rank of a pair that makes no token.
NO_PAIR = np.iinfo(np.int32).max


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    """Ranks of a tiktoken file and the pattern that cuts texts into pieces."""

    def __init__(self, ranks: bytes, pattern: str):
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        token = [b""] * (max(self.rank.values()) + 1)
        for x, rank in self.rank.items():
            token[rank] = x
        self.token_bytes = np.frombuffer(b"".join(token), np.uint8)
        self.token_size = np.array([len(x) for x in token])
        self.token_at = np.concatenate([[0], np.cumsum(self.token_size)])
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)])
        self.cut = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        # Every way to make a token of two tokens: the pair's key and the rank of what it makes.
        get = self.rank.get
        ways = {get(x[:k]) << 32 | get(x[k:]): r for x, r in self.rank.items() for k in range(1, len(x)) if x[:k] in self.rank and x[k:] in self.rank}
        self.pair = np.array(sorted(ways), np.int64)
        self.made = np.array([ways[k] for k in self.pair.tolist()], np.int64)
        self.of_bytes = self.merged(np.repeat(self.byte, 256), np.tile(self.byte, 256)).astype(np.int32)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of tokens as one token, or NO_PAIR."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), max(0, len(self.pair) - 1))
        return np.where(self.pair[at] == key, self.made[at], NO_PAIR) if len(self.pair) else np.full(len(key), NO_PAIR)

    def replay(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all pieces, one after the other, and n+1 offsets of the pieces in them.

        `rank` indexes each position by the rank of the pair that starts there. Every sweep applies, in
        each piece that has one, its lowest rank at all its positions, and looks up the pairs of the
        merged symbols with their neighbours; all other entries stay as they are.
        """
        whole = np.array([self.rank.get(x, -1) for x in pieces], np.int64)
        size = np.array([len(x) for x in pieces], np.int64)
        open_ = np.flatnonzero((whole < 0) & (size > 0))
        raw = np.frombuffer(b"".join([pieces[i] for i in open_.tolist()]), np.uint8)
        piece = np.repeat(open_, size[open_])
        symbol = self.byte[raw].astype(np.int32)
        rank = np.full(len(raw), NO_PAIR, np.int32)
        if len(raw) > 1:
            rank[:-1] = np.where(piece[1:] == piece[:-1], self.of_bytes[raw[:-1].astype(np.int32) << 8 | raw[1:]], NO_PAIR)
        done = [(np.flatnonzero(whole >= 0), whole[whole >= 0].astype(np.int32))]
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            count = np.diff(np.append(first, len(symbol)))
            low = np.minimum.reduceat(rank, first)
            ended = np.repeat(low == NO_PAIR, count)
            if ended.any():
                done.append((piece[ended], symbol[ended]))
                left = ~ended
                piece, symbol, rank, count, low = piece[left], symbol[left], rank[left], count[low < NO_PAIR], low[low < NO_PAIR]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(low, count))
            # Of positions that overlap, the leftmost is merged, then every other one.
            run = np.concatenate([[True], np.diff(at) > 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            symbol[at] = rank[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            piece, symbol, rank = piece[keep], symbol[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = NO_PAIR
            for p in (at[at + 1 < len(symbol)], at[at > 0] - 1):
                p = p[piece[p] == piece[p + 1]]
                rank[p] = self.merged(symbol[p], symbol[p + 1])
        of, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(pieces)))])

    def learn(self, pieces: set[str]) -> None:
        """Encodes the pieces that aren't kept yet, some megabytes at a time."""
        kept = self.kept
        if len(kept) > KEPT_PIECES:
            kept.clear()
        some: list[str] = []
        size = 0
        for piece in pieces:
            if piece not in kept:
                some.append(piece)
                size += len(piece)
                if size > CORPUS_BYTES:
                    self._learn(some)
                    some, size = [], 0
        self._learn(some)

    def _learn(self, some: list[str]) -> None:
        ids, offs = self.replay([x.encode() for x in some])
        data, edge = ids.astype("<u4").tobytes(), (4 * offs).tolist()
        self.kept.update(zip(some, [data[i:j] for i, j in zip(edge[:-1], edge[1:], strict=True)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cut = [self.cut(x) for x in texts]
        self.learn(set().union(*cut))
        kept = self.kept.__getitem__
        return [b"".join(map(kept, x)) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the tokens, gathered from the tokens' bytes a million ids at a time."""
        ids, out = np.frombuffer(ids, dtype="<u4"), []
        for i in range(0, len(ids), 1 << 20):
            own = ids[i : i + (1 << 20)]
            size = self.token_size[own]
            shift = self.token_at[own] - np.cumsum(size) + size
            out.append(self.token_bytes[np.arange(int(size.sum())) + np.repeat(shift, size)].tobytes())
        return b"".join(out)


_LOADED: dict[tuple, Vocabulary] = {}


def _vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    key = (hashlib.sha256(ranks).digest(), pattern)
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(ranks, pattern)
    return _LOADED[key]


def _blocks(texts: list[str], most: int = CORPUS_BYTES):
    """Runs of texts of about `most` characters."""
    some: list[str] = []
    size = 0
    for x in texts:
        some.append(x)
        size += len(x)
        if size > most:
            yield some
            some, size = [], 0
    if some:
        yield some


def encoded(docs: DataFrame, path: str, pattern: str, back: bool = False) -> DataFrame:
    """docs with `n_tokens` long and `token_ids` binary; columns of these names are replaced.

    With `back` also `intact` boolean: whether the ids, decoded, give the text's bytes. The worker that encodes
    decodes as well, so that a task has one vocabulary in memory.
    """
    small_batches(docs.sparkSession, 2048)
    ranks = read_ranks(path)
    more = ["n_tokens long", "token_ids binary"] + ["intact boolean"] * back
    docs = docs.drop(*[x.split()[0] for x in more])

    def run(batches):
        vocabulary = _vocabulary(ranks, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            ids = [x for some in _blocks(texts) for x in vocabulary.encode(some)]
            columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if back:
                columns.append(pa.array([vocabulary.decode(x) == text.encode() for x, text in zip(ids, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *[x.split()[0] for x in more]])

    return docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + more))


def decoded(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """tokens with `decoded` binary, the bytes that its `token_ids` stand for."""
    small_batches(tokens.sparkSession, 2048)
    ranks = read_ranks(path)
    tokens = tokens.drop("decoded")

    def run(batches):
        vocabulary = _vocabulary(ranks, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("token_ids")).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([vocabulary.decode(x or b"") for x in ids], pa.binary())], [*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema] + ["decoded binary"]))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a text encoded and its ids decoded, in one pass."""
    small_batches(docs.sparkSession, 2048)
    ranks = read_ranks(path)

    def run(batches):
        vocabulary = _vocabulary(ranks, pattern)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n, ids_sha, bytes_sha = [], [], []
            for some in _blocks(texts):
                for ids in vocabulary.encode(some):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    bytes_sha.append(hashlib.sha256(vocabulary.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(bytes_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    slim = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
