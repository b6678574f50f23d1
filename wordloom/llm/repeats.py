"""Repeated passages of LENGTH bytes or more, over all texts, by the interval tree of a suffix array.

A suffix array over all bytes would not spread over a cluster; one over anchors does. Of every LENGTH
bytes the GRAM-byte string with the least hash is an anchor (ties: all of them), so equal strings of
LENGTH bytes have equal anchors at equal places. Anchors that occur once are dropped by a bitmap of
bounded size. The others go, with the bytes around them, to the bucket of their hash. There the anchors'
suffixes are sorted, the array of common prefixes is scanned with a stack, and each interval of the tree
is a group of occurrences with a common right side. Within it the left sides are sorted: where they
differ the repeat cannot be extended, and the longest left side that an occurrence shares with another
one makes, with the right side, a maximal repeat. Repeats shorter than LENGTH are dropped.

Equal surroundings of an anchor within a block of texts are settled there, and one of them travels. An
anchor with more than HOT occurrences goes another, exact way: each LENGTH-byte window around it is
hashed, and windows, not anchors, are dealt out, once for each block.

Defined results. Null text is empty. Texts shorter than LENGTH have no repeat but count. Overlapping
repeats are one removed run. Rows that repeat a doc_id and its text are copies of one another. Windows
of hot anchors are compared by 128 bits of two hashes, all other repeats byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_CELLS, durable, maybe_in, partitions, release, small_batches
from .words import _BYTE, _powers, mixed, pieces, utf8

LENGTH, GRAM = 200, 50
#: Occurrences of an anchor beyond which its windows are dealt out instead of its surroundings.
HOT = 2000
LEFT = LENGTH - GRAM
BLOCK_BYTES, CHUNK, MOST_SPANS = 8 << 20, 1 << 17, 200_000
_SPREAD = 0xD1B54A32D192ED03
NONE = 255  # no byte of UTF-8; stands beyond the ends of a text and matches nothing


def rolled(buf: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of every run of `width` bytes; another one for each salt."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    byte = _BYTE if not salt else mixed(_BYTE + np.uint64(salt)) | np.uint64(1)
    for a in range(0, n, CHUNK):
        part = buf[a : min(n, a + CHUNK) + width - 1]
        up, down = _powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * up[: len(part)], out=total[1:])
        k = len(part) - width + 1
        out[a : a + k] = mixed((total[width:] - total[:k]) * down[:k])
    return out


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (minimum or maximum) of every `width` neighbours, by doubling."""
    size, out = 1, x
    while size * 2 <= width:
        out = best(out[:-size], out[size:])
        size *= 2
    return best(out[: len(x) - width + 1], out[width - size :][: len(x) - width + 1])


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, position in buf and hash of the anchors of texts that are LENGTH bytes long or more.

    Hashes are made for some hundred kilobytes at a time: what is held is buf and its anchors.
    """
    wide = LENGTH - GRAM + 1
    grams = len(buf) - GRAM + 1
    where, found = [], []
    step = CHUNK - 2 * wide
    for a in range(0, max(0, grams - wide + 1), step):
        since = max(0, a - wide + 1)
        h = rolled(buf[since : min(grams, a + step + wide - 1) + GRAM - 1], GRAM)
        own = (h >> np.uint64(32)).astype(np.uint32)
        if len(own) < wide:
            break
        low = _sliding(own, wide, np.minimum)
        edge = np.zeros(wide - 1, np.uint32)
        high = _sliding(np.concatenate([edge, low, edge]), wide, np.maximum)
        at = np.flatnonzero(high == own)
        where.append(at + since)
        found.append(h[at])
    at, first = np.unique(np.concatenate(where), return_index=True) if where else (np.zeros(0, int), np.zeros(0, int))
    h = np.concatenate(found)[first] if found else np.zeros(0, np.uint64)
    text = np.searchsorted(offs, at, side="right") - 1
    ok = (at + GRAM <= offs[text + 1]) & (offs[text + 1] - offs[text] >= LENGTH)
    # Least hashes are small numbers: mixed once more they spread over all buckets and cells.
    return text[ok], at[ok], mixed(h[ok] + np.uint64(_SPREAD))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _texts(batches, column=1):
    """Blocks of (row key, bytes, offsets)."""
    rows, parts, size = [], [], 0
    for batch in batches:
        buf, offs = utf8(batch.column(column))
        key = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j in pieces(offs, BLOCK_BYTES):
            rows.append(key[i:j])
            parts.append((buf[offs[i] : offs[j]].copy(), np.diff(offs[i : j + 1])))
            size += len(parts[-1][0])
            if size > BLOCK_BYTES:
                yield np.concatenate(rows), np.concatenate([p for p, _ in parts]), np.concatenate([[0], *[d for _, d in parts]]).cumsum()
                rows, parts, size = [], [], 0
    if parts:
        yield np.concatenate(rows), np.concatenate([p for p, _ in parts]), np.concatenate([[0], *[d for _, d in parts]]).cumsum()


def _rows(cols, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)


def _split(keys, buckets):
    """Order of keys by bucket, the buckets that have keys, and the edges of these buckets in that order."""
    order = np.argsort(keys, kind="stable")
    some, first = np.unique(_bucket(keys[order], buckets), return_index=True)
    return order, some.tolist(), np.append(first, len(keys))


def counted(buckets: int):
    """Each bucket's anchors, with the number of times a block has them."""

    def run(batches):
        for _, buf, offs in _texts(batches):
            key, count = np.unique(anchors(buf, offs)[2], return_counts=True)
            _, some, edge = _split(key, buckets)  # already in order
            count = np.minimum(count, 2**16 - 1).astype(np.uint16)
            if some:
                of = list(zip(edge[:-1], edge[1:], strict=True))
                yield _rows([some, [key[i:j].tobytes() for i, j in of], [count[i:j].tobytes() for i, j in of]], ["bucket", "keys", "counts"], [pa.int32(), pa.binary(), pa.binary()])

    return run


def _cells_of(bits: int):
    def run(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("counts").to_pylist()])
        key, at = np.unique(keys, return_inverse=True)
        total = np.bincount(at, counts)
        cell = lambda x: np.unique((x >> np.uint64(64 - bits)).astype(np.int64))
        # A cell with a hot anchor is hot for all its anchors.
        return pa.table([pa.array(np.concatenate([cell(key[total > 1]), cell(key[total > HOT])])), pa.array(np.repeat([0, 1], [len(cell(key[total > 1])), len(cell(key[total > HOT]))]).astype(np.int32))], names=["cell", "hot"])

    return run


def _bitmap(cells: DataFrame, bits: int) -> np.ndarray:
    """The cells as a bitmap, an eighth of 2**bits bytes at most."""
    rows = cells.groupBy(F.expr("cell div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("cell % 32768")).alias("map")).collect()
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in rows:
        part = np.frombuffer(bytes(r.map), np.uint8)[: len(out)]
        out[r.bucket * 4096 : r.bucket * 4096 + len(part)] = part[: len(out) - r.bucket * 4096]
    return out


def _has(bitmap: np.ndarray, keys: np.ndarray, bits: int) -> np.ndarray:
    cell = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return (bitmap[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def surroundings(buf, offs, text, at):
    """LEFT bytes before each anchor, nearest first, and LENGTH bytes from it on."""
    right = at[:, None] + np.arange(LENGTH)
    left = at[:, None] - 1 - np.arange(LEFT)
    last = len(buf) - 1
    r = np.where(right < offs[text + 1][:, None], buf[np.minimum(right, last)], NONE).astype(np.uint8)
    le = np.where(left >= offs[text][:, None], buf[np.maximum(left, 0)], NONE).astype(np.uint8)
    return le, r


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the rows of a and b."""
    same = (a == b) & (a != NONE)
    return np.where(same.all(1), a.shape[1], (~same).argmax(1))


def _void(x: np.ndarray) -> np.ndarray:
    """Rows as big-endian words for sorting."""
    wide = -(-x.shape[1] // 8) * 8
    out = np.zeros((len(x), wide), np.uint8)
    out[:, : x.shape[1]] = x
    return out.view(">u8")


def _by_rows(x: np.ndarray) -> np.ndarray:
    return np.lexsort(_void(x).astype(np.uint64).T[::-1])


def intervals(common: np.ndarray):
    """(depth, first, last) of each interval of the tree over an array of common prefixes, by a stack."""
    stack = [(0, 0)]
    for i, depth in enumerate([*common.tolist(), 0]):
        first = i
        while stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if stack[-1][0] < depth:
            stack.append((depth, first))


def group_repeats(left: np.ndarray, right: np.ndarray):
    """(member, bytes to the left, bytes to the right) of the maximal repeats of one anchor's occurrences."""
    order = _by_rows(right)
    common = _common(right[order[:-1]], right[order[1:]])
    for depth, first, last in intervals(common):
        if depth + LEFT < LENGTH:
            continue
        own = order[first : last + 1]
        own = own[_by_rows(left[own])]
        near = _common(left[own[:-1]], left[own[1:]])
        most = np.maximum(np.append(near, 0), np.insert(near, 0, 0))
        ok = most + depth >= LENGTH
        if ok.any():
            yield own[ok], most[ok], np.full(int(ok.sum()), depth)


def merged(row, start, stop):
    """Union of the spans of each row."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    _, group = np.unique(row, return_inverse=True)
    far = int(stop.max()) + 1
    reach = np.maximum.accumulate(stop + group * far)
    new = np.concatenate([[True], (start[1:] + group[1:] * far) > reach[:-1]])
    new[1:] |= row[1:] != row[:-1]
    first = np.flatnonzero(new)
    return row[first], start[first], np.maximum.reduceat(stop, first)


SPANS = "row long, start long, stop long"
SENT = "bucket int, kind int, keys binary, rows binary, at binary, around binary"
_SENT = (["bucket", "kind", "keys", "rows", "at", "around"], [pa.int32(), pa.int32(), *[pa.binary()] * 4])


def sent(some, hot, bits, buckets):
    """Surroundings of repeated anchors (kind 0), windows around hot ones (kind 1), settled spans (kind 2)."""

    def run(batches):
        for rows, buf, offs in _texts(batches):
            text, at, key = anchors(buf, offs)
            ok = _has(some.value, key, bits)
            text, at, key = text[ok], at[ok], key[ok]
            is_hot = _has(hot.value, key, bits)
            settled = []
            for a in range(0, int((~is_hot).sum()), 1 << 13):
                t, p, k = (x[~is_hot][a : a + (1 << 13)] for x in (text, at, key))
                le, r = surroundings(buf, offs, t, p)
                whole = np.concatenate([le, r], axis=1)
                mark = mixed(k ^ mixed((_void(whole).astype(np.uint64) * (np.arange(-(-whole.shape[1] // 8), dtype=np.uint64) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15))).sum(1)))
                order = np.argsort(mark, kind="stable")
                same = np.concatenate([[False], mark[order][1:] == mark[order][:-1]]) if len(order) else np.zeros(0, bool)
                if same.any():
                    same[1:] &= (whole[order][1:] == whole[order][:-1]).all(1)
                    both = order[same | np.append(same[1:], False)]
                    room_l = (le[both] != NONE).sum(1)
                    room_r = (r[both] != NONE).sum(1)
                    long = room_l + room_r >= LENGTH
                    settled.append((rows[t[both]][long], (p[both] - offs[t[both]] - room_l)[long], (p[both] - offs[t[both]] + room_r)[long]))
                keep = np.sort(order[~same])
                yield from _sent_rows(0, buckets, k[keep], rows[t[keep]], (p - offs[t])[keep], whole[keep])
            if is_hot.any():
                start, own, window, check = _windows(buf, offs, text[is_hot], at[is_hot])
                order = np.lexsort((check, window))
                new = (window[order][1:] != window[order][:-1]) | (check[order][1:] != check[order][:-1])
                first = np.concatenate([[True], new])
                size = np.diff(np.append(np.flatnonzero(first), len(order)))
                twice = order[np.repeat(size > 1, size)]
                settled.append((rows[own[twice]], start[twice] - offs[own[twice]], start[twice] - offs[own[twice]] + LENGTH))
                one = order[first]
                yield from _sent_rows(1, buckets, window[one], rows[own[one]], start[one] - offs[own[one]], check[one])
            if settled:
                row, a, b = merged(*map(np.concatenate, zip(*settled, strict=True)))
                if len(row):
                    yield _rows([[int(row[0]) % buckets], [2], [b.astype(np.int64).tobytes()], [row.astype(np.int64).tobytes()], [a.astype(np.int64).tobytes()], [b""]], *_SENT)

    return run


def _windows(buf, offs, text, at):
    """Start, text and two hashes of each LENGTH-byte window that reaches an anchor, made piece by piece."""
    found = []
    for i, j in pieces(offs, 1 << 20):
        own = (text >= i) & (text < j)
        if not own.any():
            continue
        since, until = int(offs[i]), int(offs[j])
        p, begin = at[own] - since, offs[text[own]] - since
        cover = np.zeros(until - since + 1, np.int32)
        np.add.at(cover, np.maximum(p - LEFT, begin), 1)
        np.add.at(cover, p + 1, -1)
        start = np.flatnonzero(np.cumsum(cover)[:-1] > 0)
        of = np.searchsorted(offs, start + since, side="right") - 1
        fits = start + since + LENGTH <= offs[of + 1]
        start, of = start[fits], of[fits]
        some = buf[since:until]
        found.append((start + since, of, rolled(some, LENGTH)[start], rolled(some, LENGTH, 1)[start]))
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _sent_rows(kind, buckets, key, row, at, around):
    """Rows of the buckets that have keys: no more rows than keys, however many buckets there are."""
    order, some, edge = _split(key, buckets)
    packer = zstandard.ZstdCompressor(level=3)
    for c in range(0, len(some), 64):
        cols = [[] for _ in range(6)]
        for b, i, j in zip(some[c : c + 64], edge[c : c + 64], edge[c + 1 :], strict=False):
            o = order[i:j]
            for col, x in zip(cols, (b, kind, key[o].tobytes(), row[o].astype(np.int64).tobytes(), at[o].astype(np.int64).tobytes(), packer.compress(around[o].tobytes())), strict=True):
                col.append(x)
        yield _rows(cols, *_SENT)


def _found(table: pa.Table) -> pa.Table:
    """Spans of the repeats of a bucket."""
    if table.num_rows == 0:
        return pa.table([pa.array([], pa.int64())] * 3, names=["row", "start", "stop"])
    kind = table.column("kind").to_numpy()

    def get(c, t, k):
        own = table.column(c).filter(pa.array(kind == k))
        return np.concatenate([np.zeros(0, t), *[np.frombuffer(x.as_buffer(), t) for x in own]])

    def opened(t, k):
        own = table.column("around").filter(pa.array(kind == k))
        return np.concatenate([np.zeros(0, t), *[np.frombuffer(zstandard.decompress(x.as_buffer()), t) for x in own]])

    out = [(get("rows", np.int64, 2), get("at", np.int64, 2), get("keys", np.int64, 2))]
    window, row, at = get("keys", np.uint64, 1), get("rows", np.int64, 1), get("at", np.int64, 1)
    if len(window):
        check = opened(np.uint64, 1)
        order = np.lexsort((check, window))
        w, c = window[order], check[order]
        same = np.concatenate([[False], (w[1:] == w[:-1]) & (c[1:] == c[:-1])])
        both = order[same | np.append(same[1:], False)]
        out.append((row[both], at[both], at[both] + LENGTH))
        del window, check, w, c, order, same
        out = [merged(*map(np.concatenate, zip(*out, strict=True)))]
    key, row, at = get("keys", np.uint64, 0), get("rows", np.int64, 0), get("at", np.int64, 0)
    around = opened(np.uint8, 0).reshape(-1, LEFT + LENGTH)
    del table
    if len(key):
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        size = np.diff(np.append(first, len(order)))
        twos = first[size == 2]
        for a in range(0, len(twos), 1 << 13):
            i, j = order[twos[a : a + (1 << 13)]], order[twos[a : a + (1 << 13)] + 1]
            le, r = _common(around[i, :LEFT], around[j, :LEFT]), _common(around[i, LEFT:], around[j, LEFT:])
            ok = le + r >= LENGTH
            for x in (i, j):
                out.append((row[x][ok], (at[x] - le)[ok], (at[x] + r)[ok]))
        size_now = 0
        for f, n in zip(first[size > 2], size[size > 2], strict=True):
            own = order[f : f + n]
            for who, le, r in group_repeats(around[own, :LEFT], around[own, LEFT:]):
                out.append((row[own[who]], at[own[who]] - le, at[own[who]] + r))
                size_now += len(who)
                if size_now > MOST_SPANS:  # an occurrence is in many intervals: their union is all that is kept
                    out, size_now = [merged(*map(np.concatenate, zip(*out, strict=True)))], 0
    row, a, b = merged(*map(np.concatenate, zip(*out, strict=True)))
    return pa.table([pa.array(row), pa.array(a), pa.array(b)], names=["row", "start", "stop"])


def spans(keyed: DataFrame) -> DataFrame:
    """(row, start, stop): bytes of the repeats of (row, text) rows; spans of a row may overlap."""
    spark = keyed.sparkSession
    sc = spark.sparkContext
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), size // (4 << 20))
    bits = 15
    while 1 << bits < min(MOST_CELLS, size // 4):
        bits += 1
    cells = keyed.mapInArrow(counted(buckets), "bucket int, keys binary, counts binary").groupBy("bucket").applyInArrow(_cells_of(bits), "cell long, hot int").persist()
    some, hot = (sc.broadcast(_bitmap(cells.where(f"hot = {k}"), bits)) for k in (0, 1))
    cells.unpersist()
    release(spark)
    return keyed.mapInArrow(sent(some, hot, bits, buckets), SENT).groupBy("bucket").applyInArrow(_found, SPANS)


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    of = durable(spans(slim.select("row", "text")).groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    release(docs.sparkSession)

    def run(batches):
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            cols = [[], [], [], []]
            for i, own in enumerate(batch.column(2).to_pylist()):
                raw = buf[offs[i] : offs[i + 1]].tobytes()
                kept, at, removed, n = [], 0, 0, 0
                for s in sorted((s["start"], s["stop"]) for s in own or []):
                    if s[0] > at or not n:
                        kept.append(raw[at : s[0]])
                        n += 1
                        at = s[0]
                    if s[1] > at:
                        removed += s[1] - at
                        at = s[1]
                kept.append(raw[at:])
                for c, x in zip(cols, (len(raw), removed, n, hashlib.sha256(b"".join(kept)).hexdigest()), strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    # Texts without repeats stay where they are; those that may have some meet their spans.
    slim = maybe_in(slim, "row", of.select("row"))
    whole = slim.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<struct<start: long, stop: long>>").alias("spans"))
    cut = slim.where("maybe").join(of, "row", "left").select("doc_id", "text", "spans")
    return whole.unionByName(cut).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
