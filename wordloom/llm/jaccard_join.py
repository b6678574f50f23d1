"""Similarity join of texts by the Jaccard similarity of their word shingles, exact.

Universe-partition pigeonhole. Sets are compared in windows of sizes. In a window sets that are similar
enough differ in at most H shingles, so the universe, cut by hash into segments with tolerances t (0 or
1) whose t + 1 sum to U = H + 1 + slack, has segments worth U - H units in which the two differ by at
most t. A segment of tolerance 0 is indexed by its subset of the set, one of tolerance 1 by the subset
and by its one-deletion neighbourhood. How many segments get which tolerance, and the slack, is the
cheapest allocation under a model that counts signatures, signatures that tell little, and sets that
need the second way below. Subsets of up to t shingles are not indexed: they take at most `weak` units.

Groups. A signature shared by few classes gives all their pairs, which a count of shared units thins
out. One shared by more than FEW classes is hot and gives none; what it costs a class in units is
summed. Only classes whose weak and hot units could hide a partner go a second way: their shingles are
indexed one by one, where a pair shares a shingle that is not hot unless most shingles of both are hot.
Classes of mostly hot shingles (big families of near copies) go a third way: members of a group are
compared with one pivot at a time; those linked to it leave the group unless the triangle inequality of
the Jaccard distance leaves room for a link to a member that isn't. All candidates are verified on the
whole sets. No pair of similar sets is lost: it is linked, or both are linked to a common text.

Texts with equal words are one class and are handled once. Candidates travel as packed arrays.

Defined results. Words are `[^\\x20\\x09-\\x0D]+` with A-Z as a-z; a text with fewer words than the
width is one shingle; null, empty and blank texts have none, link with nothing and are components of
their own. component_id is null only where all doc_ids of a component are null. Rows that repeat a
doc_id are rows of the result each. Shingles and words are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, maybe_in, partitions, release, rows_of, small_batches
from .words import bounds, hashes, mixed, pieces, shingles, utf8

WIDTH = 5
#: Pairs of sets link from 3/4 on: 100 * intersection >= 75 * union.
NEAR = 0.75
#: Signatures and shingles of more classes than this are hot.
FEW = 16
#: Shingles whose signatures are dealt out together, and bytes of signatures aimed at for a bucket.
BLOCK, BUCKET_BYTES = 1_500_000, 8 << 20
#: Signatures are dealt out in so many turns, by a bit of each, so that their shuffle files take that much less disk.
TURNS = 2

#: Families of near copies: pivots and rounds of comparing with them, and members of a block after that.
PIVOTS, ROUNDS, SIDE = 4, 2, 512

#: Lower ends of the windows: each set is at least as large as its window's lower end.
WINDOWS = [1, 2, 3, 4, 6, 9, 14]
while WINDOWS[-1] < 1 << 40:
    WINDOWS.append(WINDOWS[-1] * 9 // 5)


def largest_partner(n: int) -> int:
    return n * 4 // 3


def most_apart(a: int, b: int) -> int:
    """In how many shingles similar sets of these sizes can differ."""
    return (a + b) // 7


@lru_cache(None)
def allocation(window: int) -> tuple[int, int, int, int]:
    """(H, U, segments of tolerance 1, slack) of a window: the cheapest under the cost model."""
    low, high = WINDOWS[window], WINDOWS[window + 1] - 1
    h = most_apart(high, largest_partner(high))
    size = (low + high) / 2
    best = None
    if h == 0:
        return 0, 1, 0, 0
    for slack in sorted({*range(0, min(h, 8) + 1), *(int(h * x) for x in (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5))}):
        units = h + 1 + slack
        for pairs in {0, units // 2}:
            units_used = units + (units % 2 if pairs else 0)
            pairs = units_used // 2 if pairs else 0
            singles = units_used - 2 * pairs
            x = size / units_used
            weak0, weak1 = math.exp(-x), math.exp(-2 * x) * (1 + 2 * x)
            mean = singles * weak0 + 2 * pairs * weak1
            spread = math.sqrt(singles * weak0 * (1 - weak0) + 4 * pairs * weak1 * (1 - weak1)) + 1e-9
            second = 0.5 * math.erfc((units_used - h - 0.5 - mean) / spread / math.sqrt(2))
            thin = singles * x * weak0 + pairs * (2 * x) ** 2 * math.exp(-2 * x)
            cost = singles + pairs * (1 + 2 * x) + thin / 2 + second * size * 3
            if best is None or cost < best[0]:
                best = (cost, (h, units_used, pairs, units_used - h - 1))
    return best[1]


def windows_of(n: int) -> list[int]:
    """The window of a size, and the one below where it is the size of a larger partner."""
    own = bisect_right(WINDOWS, n) - 1
    below = [own - 1] if own and n <= largest_partner(WINDOWS[own] - 1) else []
    return [own, *below]


def signatures(sets: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Signatures of a sorted set in a window, the units of each, and the units of its weak segments."""
    h, units, pairs, _ = allocation(window)
    share = ((sets >> np.uint64(32)) * np.uint64(units)) >> np.uint64(32)
    seg = np.where(share < 2 * pairs, share // np.uint64(2), share - np.uint64(pairs)) if pairs else share
    first = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
    own = seg[first]
    content = mixed(sets + np.uint64(0x632BE59BD9B4E019))
    total = np.add.reduceat(content, first)
    count = np.diff(np.append(first, len(sets)))
    salt = mixed(own + np.uint64((window + 1) << 40))
    if not pairs:
        return mixed(total ^ salt), np.ones(len(own), np.int64), units - len(own)
    soft = own < pairs
    full = ~soft | (count > 1)
    weak = units - int((np.where(soft, 2, 1) * full).sum())
    where = np.repeat(np.arange(len(first)), count)
    drop = soft[where] & full[where]
    less = (total[where] - content)[drop] ^ salt[where][drop]
    return np.concatenate([mixed((total ^ salt)[full]), mixed(less)]), np.concatenate([np.where(soft, 2, 1)[full], np.full(len(less), 2)]), weak


def sets_of(texts: pa.Array, width: int):
    """For each text its class, a hash of its words, and its sorted distinct shingles."""
    buf, offs = utf8(texts)
    for i, j in pieces(offs, 1 << 20):
        some, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, words_at = bounds(some, at)
        words = hashes(some, starts, ends)
        for k in range(j - i):
            own = words[words_at[k] : words_at[k + 1]]
            runs = shingles(own, width)
            same = int(mixed(np.add.reduce(mixed(own + np.arange(len(own), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)), keepdims=True) + np.uint64(len(own)))[0]) if len(own) else 0
            yield i + k, same, np.unique(runs)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): row is a hash of both, which names a row whose id is null as well."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def classes(docs: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, cls, n_shingles) of each row; cls is null where the text has no words."""

    def run(batches):
        for batch in batches:
            found = [(same, len(s)) for _, same, s in sets_of(batch.column(2), width)]
            cls = np.array([x for x, _ in found], dtype=np.uint64).view(np.int64)
            n = np.array([x for _, x in found], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cls, mask=n == 0), pa.array(n)], ["row", "doc_id", "cls", "n_shingles"])

    return keyed(docs).mapInArrow(run, "row long, doc_id long, cls long, n_shingles long")


def packed(keys: np.ndarray) -> bytes:
    """The upper six bytes of sorted keys, byte by byte: the first planes are long runs that compress."""
    return np.ascontiguousarray(keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    own = np.frombuffer(planes, np.uint8).reshape(6, -1)
    out = np.zeros((own.shape[1], 8), np.uint8)
    out[:, :6] = own.T
    return out.view(">u8").ravel().astype(np.uint64)


BUCKETS = "bucket int, keys binary, units binary, who binary, cls binary, facts binary"


def _dealt(keys, units, who, cls, facts, buckets):
    """A block's keys as a packed row for each bucket that has some, so no more rows than keys. Keys that many
    classes of the block have are hot already: one of them goes out, marked by units of 0, and the others'
    units are summed here."""
    if not len(keys):  # a turn that has none of a small block's
        return [], np.zeros(len(cls), np.int64)
    keys = keys & np.uint64(0xFFFFFFFFFFFF0000)  # as they travel
    order = np.argsort(keys, kind="stable")
    keys, units, who = keys[order], units[order], who[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.append(first, len(keys)))
    hot = np.repeat(count > FEW, count)
    local = np.bincount(who[hot], units[hot], len(cls)).astype(np.int64)
    keep = ~hot
    keep[first[count > FEW]] = True
    units = np.where(hot, 0, units)
    keys, units, who = keys[keep], units[keep], who[keep]
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    some, first = np.unique(bucket, return_index=True)
    rows = []
    for b, i, j in zip(some.tolist(), first, np.append(first[1:], len(keys)), strict=True):
        there, at = np.unique(who[i:j], return_inverse=True)
        rows.append((b, packed(keys[i:j]), units[i:j].astype(np.uint8).tobytes(), at.astype(np.uint16).tobytes(), cls[there].tobytes(), facts[there].tobytes()))
    return rows, local


def _hot_rows(cls, units, facts, buckets):
    """Units that hot keys take of a block's classes; blocks are dealt over buckets below zero."""
    return (-1 - int(cls[0]) % buckets, b"", units.astype(np.int64).tobytes(), b"", cls.tobytes(), facts.tobytes())


def _batch_of(rows):
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "keys", "units", "who", "cls", "facts"])


def _blocks(items, keys_of, buckets):
    """items: (class, set). keys_of gives keys, units and the facts (size, weak, need) of a set."""
    seen, parts, size, hot = {}, [], 0, []

    def flush():
        cls = np.array([x for x in seen], dtype=np.uint64)
        facts = np.array(list(seen.values()), dtype=np.int32).reshape(-1, 3)
        keys, units = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        who = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        rows, local = _dealt(keys, units, who, cls, facts, buckets)
        local[facts[:, 2] <= 0] += 1 << 30
        if local.any():
            rows.append(_hot_rows(cls[local > 0], local[local > 0], facts[local > 0], buckets))
        for i in range(0, len(rows), 64):
            yield _batch_of(rows[i : i + 64])

    for same, s in items:
        if not len(s) or same in seen:
            continue
        keys, units, facts = keys_of(s)
        seen[same] = facts
        parts.append((keys, units))
        size += len(s)
        if size > BLOCK or len(parts) > 65_000:
            yield from flush()
            seen, parts, size = {}, [], 0
    if parts:
        yield from flush()


def signature_keys(s: np.ndarray, turn: int | None = None):
    """A set's signatures, their units and its facts; those of one turn only, with the same facts, where it is given."""
    keys, units, facts = [], [], None
    for w in windows_of(len(s)):
        k, u, weak = signatures(s, w)
        h, total, _, _ = allocation(w)
        keys.append(k)
        units.append(u)
        facts = (len(s), weak, total - h - weak) if facts is None else (*facts[:2], min(facts[2], total - h - weak))
    keys, units = np.concatenate(keys), np.concatenate(units)
    if turn is not None:
        own = (keys >> np.uint64(16)) % np.uint64(TURNS) == turn
        keys, units = keys[own], units[own]
    return keys, units, facts


def shingle_keys(s: np.ndarray):
    """Each shingle is a key; a class needs shingles that aren't hot, more than it can differ in."""
    return s, np.ones(len(s), np.int64), (len(s), 0, len(s) - most_apart(len(s), largest_partner(len(s))))


FOUND = "a long, b long, shared long, need long, size_a long, size_b long"


def _matched(single: bool):
    """Joins a bucket's keys: rows (a, b, shared units, units needed, sizes); b is null where a is a class with hot units."""

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in ("bucket", "keys", "units", "who", "cls", "facts")}
        out = []
        if col["bucket"][0] < 0:
            for u, c, f in zip(col["units"], col["cls"], col["facts"], strict=True):
                facts = np.frombuffer(f, np.int32).reshape(-1, 3)
                out.append((np.frombuffer(c, np.int64), None, np.frombuffer(u, np.int64), facts[:, 2], facts[:, 0], None))
        else:
            keys = np.concatenate([unpacked(x) for x in col["keys"]])
            units = np.concatenate([np.frombuffer(x, np.uint8) for x in col["units"]])
            names = [np.frombuffer(x, np.int64) for x in col["cls"]]
            facts = np.concatenate([np.frombuffer(x, np.int32).reshape(-1, 3) for x in col["facts"]])
            shift = np.cumsum([0] + [len(x) for x in names[:-1]])
            all_cls, first, index = np.unique(np.concatenate(names), return_index=True, return_inverse=True)
            facts = facts[first]
            who = index[np.concatenate([np.frombuffer(x, np.uint16) + s for x, s in zip(col["who"], shift, strict=True)])]
            del col, names
            order = np.lexsort((who, keys))
            keys, units, who = keys[order], units[order], who[order]
            new = np.concatenate([[True], keys[1:] != keys[:-1]])
            twice = np.concatenate([[False], (who[1:] == who[:-1]) & ~new[1:]])
            marked = np.unique(keys[units == 0])  # hot within a block
            if twice.any():  # a class of several blocks
                keep = ~twice
                keys, units, who, new = keys[keep], units[keep], who[keep], new[keep]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(keys)))
            hot = (count > FEW) | np.isin(keys[at], marked)
            is_hot = np.repeat(hot, count)
            h = np.bincount(who[is_hot], units[is_hot], len(all_cls)).astype(np.int64)
            some = h > 0
            out.append((all_cls[some], None, h[some], facts[some, 2], facts[some, 0], None))
            pairs, worth = [], []
            for g in range(2, FEW + 1):
                rows = at[(count == g) & ~hot]
                if len(rows):
                    i, j = np.triu_indices(g, 1)
                    pairs.append(np.stack([who[rows[:, None] + i].ravel(), who[rows[:, None] + j].ravel()]))
                    worth.append(np.minimum(units[rows[:, None] + i], units[rows[:, None] + j]).ravel())
            if pairs:
                pairs, worth = np.concatenate(pairs, axis=1), np.concatenate(worth)
                both = pairs[0] * len(all_cls) + pairs[1]
                both, inverse = np.unique(both, return_inverse=True)
                a, b = both // len(all_cls), both % len(all_cls)
                shared = np.bincount(inverse, worth).astype(np.int64)
                na, nb = facts[a, 0].astype(np.int64), facts[b, 0].astype(np.int64)
                small, large = np.minimum(na, nb), np.maximum(na, nb)
                fit = 4 * small >= 3 * large
                if single:
                    need = -(-3 * (na + nb) // 7)
                else:
                    weak = np.where((na < nb) | ((na == nb) & (facts[a, 1] > facts[b, 1])), facts[a, 1], facts[b, 1])
                    weak = np.where(na == nb, np.maximum(facts[a, 1], facts[b, 1]), weak)
                    total = np.array([allocation(w)[1] for w in range(bisect_right(WINDOWS, int(large.max())))])
                    need = total[np.searchsorted(WINDOWS, small, side="right") - 1] - (na + nb) // 7 - weak
                out.append((all_cls[a][fit], all_cls[b][fit], shared[fit], need[fit], na[fit], nb[fit]))
        arrays = []
        for i in range(6):
            arrays.append(pa.chunked_array([pa.array(np.asarray(o[i], np.int64)) if o[i] is not None else pa.nulls(len(o[0]), pa.int64()) for o in out], pa.int64()))
        return pa.table(arrays, names=["a", "b", "shared", "need", "size_a", "size_b"])

    return run


def candidates(turns: list[DataFrame], single: bool) -> tuple[DataFrame, DataFrame]:
    """(a, b) that share enough, and (cls, hot, size) of the classes that hot keys could hide links of.

    Each turn's keys are matched by themselves; units are summed over all of them.
    """
    matched = []
    for blocks in turns:
        matched.append(blocks.groupBy("bucket").applyInArrow(_matched(single), FOUND).groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("need").alias("need"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b")))
        if len(turns) > 1:
            matched[-1] = durable(matched[-1])
            release(blocks.sparkSession)
    found = durable(
        reduce(DataFrame.union, matched)
        .groupBy("a", "b")
        .agg(F.sum("shared").alias("shared"), F.max("need").alias("need"), F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"))
    )
    every = durable(found.where("b is null").select(F.col("a").alias("cls"), F.col("shared").alias("hot"), F.col("size_a").alias("size"), "need"))
    hot = every if single else durable(every.where("hot >= need"))
    pairs = found.where("b is not null").select("a", "b", "shared", "need")
    # A pair short of units needs hot ones of both classes, whether or not those go a further way.
    short = pairs.where("shared < need")
    for side in ("a", "b"):
        short = maybe_in(short, side, every.select(F.col("cls").alias(side))).where("maybe").drop("maybe")
    short = short.join(every.selectExpr("cls as a", "hot as hot_a"), "a").join(every.selectExpr("cls as b", "hot as hot_b"), "b")
    enough = F.col("shared") + F.least("hot_a", "hot_b") >= F.col("need")
    return pairs.where("shared >= need").select("a", "b").union(short.where(enough).select("a", "b")), hot


def stored_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of wanted (row) rows, read from their texts again."""

    def run(batches):
        for batch in batches:
            found = [(same, s) for _, same, s in sets_of(batch.column(0), width)]
            yield pa.RecordBatch.from_arrays([_signed([x for x, _ in found]), pa.array([packed(s) for _, s in found], pa.binary())], ["cls", "shingles"])

    rows = rows_of(keyed(docs), "row", wanted).dropDuplicates(["row", "text"])
    return durable(rows.select("text").mapInArrow(run, "cls long, shingles binary"))


def cells_of(keys: np.ndarray) -> np.ndarray:
    """A bitmap of the hash cells that a set has, 4 to 8 cells for each shingle."""
    n = max(64, 1 << (4 * len(keys) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[(keys >> np.uint64(16)) & np.uint64(n - 1)] = 1
    return np.packbits(bits, bitorder="little")


def least_apart(x: np.ndarray, y: np.ndarray) -> int:
    """In how many shingles the sets of two bitmaps differ at least: a cell that only one has takes one of them."""
    n = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(z.reshape(-1, n), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs but for those whose bitmaps of cells, a tenth of the sets' bytes, prove them too far apart."""

    def cells(batches):
        for batch in batches:
            own = [unpacked(s.as_buffer()) for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in own], pa.int64()), pa.array([cells_of(s).tobytes() for s in own], pa.binary())], ["cls", "n", "cells"])

    def near(batches):
        for batch in batches:
            sizes = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            both = zip(*([np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(i)] for i in (4, 5)), strict=True)
            keep = [least_apart(x, y) <= most_apart(n, m) for (n, m), (x, y) in zip(sizes, both, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    named = durable(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    of = durable(maybe_in(sets, "cls", named).where("maybe").select("cls", "shingles").mapInArrow(cells, "cls long, n long, cells binary"))
    joined = pairs.join(of.selectExpr("cls as b", "n as nb", "cells as right"), "b").join(of.selectExpr("cls as a", "n as na", "cells as left"), "a")
    return joined.select("a", "b", "na", "nb", "left", "right").mapInArrow(near, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, size_a, size_b): the exact intersection of each pair."""

    def run(batches):
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            out = []
            for x, y in zip(left, right, strict=True):
                x, y = unpacked(x.as_buffer()), unpacked(y.as_buffer())
                out.append((len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)))
            out = np.array(out, dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([a, b, *[pa.array(out[:, i]) for i in range(3)]], ["a", "b", "shared", "size_a", "size_b"])

    pairs = durable(pairs.select("a", "b"))
    release(pairs.sparkSession)
    named = durable(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
    sets = maybe_in(sets, "cls", named).where("maybe")
    joined = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("right")), "b")
    joined = joined.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("left")), "a")
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, shared long, size_a long, size_b long")


LINKED = "100 * shared >= 75 * (size_a + size_b - shared)"


def pivot_links(rows: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Links among classes of mostly hot shingles; rows: (key, cls) that any two similar ones share a key of.

    Classes that keys connect form a group, of which a class is one row. In each round about PIVOTS
    members are compared with all others. A member linked to a pivot leaves unless some member is so
    near to that pivot, without being linked to it, that the two might link. What is left after ROUNDS
    is compared in blocks, whose tasks return a spanning forest of links and no pairs.
    """
    rows = durable(rows)
    low = durable(rows.groupBy("key").agg(F.min("cls").alias("low")))
    group = components(rows.join(low, "key").selectExpr("low as a", "cls as b").distinct())
    left = durable(group.selectExpr("component as grp", "node as cls"))
    links = []
    for turn in range(ROUNDS):
        release(rows.sparkSession)
        size = durable(left.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("first")).where("n > 1"))
        if size.isEmpty():
            return links
        left = durable(left.join(size, "grp"))
        chosen = f"cls = first or pmod(xxhash64(cls, {turn}), greatest(1, n div {PIVOTS})) = 0"
        pivots = durable(left.where(chosen).selectExpr("grp", "cls as pivot"))
        pairs = left.select("grp", "cls").join(pivots, "grp").where("cls <> pivot")
        judged = durable(verified(pairs.selectExpr("pivot as a", "cls as b"), sets).selectExpr("a as pivot", "b as cls", "shared / (size_a + size_b - shared) as j", f"{LINKED} as linked"))
        links.append(judged.where("linked").selectExpr("pivot as a", "cls as b"))
        gray = durable(judged.where(f"not linked and j >= {2 * NEAR - 1 - 1e-9}").groupBy("pivot").agg(F.max("j").alias("gray")))
        gone = judged.where("linked").join(gray, "pivot", "left").where(f"gray is null or j > gray + {1 - NEAR + 1e-9}").select("cls").union(pivots.select(F.col("pivot").alias("cls"))).distinct()
        left = durable(left.select("grp", "cls").join(gone, "cls", "left_anti"))
    size = durable(left.groupBy("grp").agg(F.expr(f"cast(count(1) div {SIDE} + 1 as int)").alias("sides"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    if size.isEmpty():
        return links
    left = left.join(size, "grp").withColumn("side", F.expr("pmod(xxhash64(cls), sides)"))
    dealt = left.select("grp", "cls", "side", F.explode(F.expr("sequence(0, sides - 1)")).alias("other"))
    dealt = dealt.select(F.expr("xxhash64(grp, least(side, other), greatest(side, other))").alias("task"), "cls").join(rows_of(sets, "cls", durable(left.select("cls").distinct())), "cls")
    links.append(durable(dealt.groupBy("task").applyInArrow(_forest, "a long, b long")))
    return links


def _forest(table: pa.Table) -> pa.Table:
    """A spanning forest of the links among the sets of a task."""
    cls = table.column("cls").to_pylist()
    sets = [unpacked(s) for s in table.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), size)
    keys = np.concatenate(sets)
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    at = np.cumsum(first) - 1
    start = np.append(np.flatnonzero(first), len(keys))
    root = np.arange(len(sets))
    a, b = [], []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    where = np.empty(len(keys), np.int64)
    where[order] = at
    edge = np.concatenate([[0], np.cumsum(size)])
    for i in range(len(sets)):
        own = where[edge[i] : edge[i + 1]]
        hits = np.concatenate([who[start[k] : start[k + 1]] for k in own]) if len(own) else np.zeros(0, int)
        shared = np.bincount(hits, minlength=len(sets))
        for j in np.flatnonzero(100 * shared >= 75 * (size + size[i] - shared)):
            if j != i and (x := find(i)) != (y := find(j)):
                root[max(x, y)] = min(x, y)
                a.append(cls[i])
                b.append(cls[j])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _buckets(spark, shingles_in_all: int) -> int:
    return max(partitions(spark), int(shingles_in_all * 0.7 * 8 / BUCKET_BYTES))


def linked_classes(docs: DataFrame, slim: DataFrame, width: int = WIDTH) -> DataFrame:
    """(node, component) of the classes that link to others."""
    spark = docs.sparkSession
    total = slim.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = _buckets(spark, total)
    texts = docs.select("text")

    def sign(turn):
        def run(batches):
            yield from _blocks(((same, s) for batch in batches for _, same, s in sets_of(batch.column(0), width)), lambda s: signature_keys(s, turn), buckets)

        return run

    pairs, hot = candidates([texts.mapInArrow(sign(turn), BUCKETS) for turn in range(TURNS)], False)
    pairs = durable(pairs)
    release(spark)
    reps = slim.where("cls is not null").groupBy("cls").agg(F.min("row").alias("row"))
    touched = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).union(hot.select("cls")).distinct()
    sets = stored_sets(docs, durable(reps.join(touched, "cls", "left_semi").select("row")), width)
    release(spark)
    links = []
    if not hot.isEmpty():
        of_hot = rows_of(sets, "cls", durable(hot.select("cls").distinct()))

        def single(batches):
            items = ((c, unpacked(s.as_buffer())) for batch in batches for c, s in zip(batch.column(0).to_numpy().view(np.uint64).tolist(), batch.column(1), strict=True))
            yield from _blocks(items, shingle_keys, buckets)

        more, hotter = candidates([of_hot.mapInArrow(single, BUCKETS)], True)
        pairs = durable(pairs.union(more))
        release(spark)
        deep = durable(hotter.where("hot >= need").select("cls").distinct())

        def prefix(batches):
            for batch in batches:
                cls, keys = [], []
                for c, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    s = unpacked(s.as_buffer())
                    s = s[: len(s) - -(-3 * len(s) // 4) + 1]
                    keys.append(s)
                    cls.append(np.full(len(s), c, np.int64))
                if cls:
                    yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), pa.array(np.concatenate(cls))], ["key", "cls"])

        links = pivot_links(rows_of(sets, "cls", deep).mapInArrow(prefix, "key long, cls long"), sets)
        release(spark)
    return spanning_links(pairs, sets, links)


def spanning_links(pairs: DataFrame, sets: DataFrame, links: list[DataFrame]) -> DataFrame:
    """(node, component) of known links and of the pairs that verify.

    Each class is compared with the smallest of its partners first; of the other pairs only those are
    verified that are not connected by then.
    """
    pairs = durable(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first = durable(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    found = verified(first, sets).where(LINKED).select("a", "b")
    for x in links:
        found = found.union(x)
    found = durable(found)
    release(pairs.sparkSession)
    of = durable(components(found))
    other = pairs.join(of.selectExpr("node as a", "component as ca"), "a", "left").join(of.selectExpr("node as b", "component as cb"), "b", "left")
    other = durable(other.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b").join(first, ["a", "b"], "left_anti"))
    release(pairs.sparkSession)
    more = durable(verified(plausible(other, sets), sets).where(LINKED).select("a", "b"))
    return of if more.isEmpty() else components(of.selectExpr("node as a", "component as b").union(more))


def similar_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, and class_id, the same for equal words."""
    small_batches(docs.sparkSession)
    slim = durable(classes(docs, width))
    reached = linked_classes(docs, slim, width)
    own = slim.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("low"))
    of = durable(own.join(reached, own.cls == reached.node, "left").select("cls", "low", F.coalesce("component", "cls").alias("component")))
    lows = durable(of.groupBy("component").agg(F.min("low").alias("component_id")))
    of = durable(of.join(lows, "component").select("cls", "component_id"))
    out = slim.where("cls is not null").join(of, "cls").select("doc_id", "n_shingles", "component_id", F.col("cls").alias("class_id"))
    return out.unionByName(slim.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("cls").alias("class_id")))


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs, all columns kept, with the row of the smallest doc_id of each component. Rows that repeat
    that id all stay only where their texts differ in more than words."""
    groups = similar_groups(docs, width)
    keep = groups.where("doc_id = component_id or doc_id is null").select("doc_id").distinct()
    return docs.join(keep, docs.doc_id.eqNullSafe(keep.doc_id), "left_semi")
