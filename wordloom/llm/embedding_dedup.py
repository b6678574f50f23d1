"""Near-dedup of embeddings by sorted projection passes.

Vectors of a label that are equal in every component are one class. In each pass classes are ordered by
label and by the signs of their products, less the label's mean, with random directions; each class is
compared with the WINDOW next ones of its label in that order. A label of up to WINDOW + 1 classes is so
compared whole in one pass. Larger ones get as many passes as find a pair at the threshold with
probability RECALL, by the model in `turns_of`: more classes of a label, more passes. Links are found with
that probability, not for certain. Of a component that they make up all links are then counted exactly,
by blocks of SIDE; links between two components that no pass joined are missing from n_links.

Ordering is a range partitioning; a partition's last rows meet the next partition's first ones in a
second step. No label lands in one task.

Defined results. Rows whose label is null, or whose vector is null, zero or has null or non-finite
components, link with nothing. Vectors of different lengths don't link. A row that repeats a vec_id is
a row of the result; component_id is the smallest vec_id, nulls aside. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, durable, partitions, small_batches

#: Cosine from which two vectors link; neighbours compared in each pass, random directions of a pass.
COSINE, WINDOW, BITS = 0.93, 512, 32
#: Probability with which a pair at the threshold is to be found; how often its signs agree. That is for
#: pairs of a label whose others have a cosine of 0.5 at most: without the mean theirs is 0.86.
RECALL, AGREE = 0.98, 1 - math.acos(1 - (1 - COSINE) / 0.5) / math.pi
#: Classes of a block in the exact count within components.
SIDE = 1024


def classes(rows: DataFrame) -> DataFrame:
    """(vec_id, label, cls, vec): cls is null for rows that link with nothing; vec is of unit length, as bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array([], float) if v is None or None in v else np.array(v, dtype=np.float64)
                size = np.abs(x).max() if len(x) else 0
                if label is None or not np.isfinite(x).all() or not size > 0:
                    out.append(None)
                else:
                    x = x / size
                    out.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary())], ["vec_id", "label", "vec"])

    small_batches(rows.sparkSession, 2048)
    slim = rows.selectExpr("cast(vec_id as long) vec_id", "embedding", "cast(label as string) label")
    return durable(slim.mapInArrow(run, "vec_id long, label string, vec binary").withColumn("cls", F.when(F.col("vec").isNotNull(), F.xxhash64("label", "vec"))))


def turns_of(n: int) -> int:
    """Passes for a label of n classes. About log2(n / WINDOW) signs must agree for two to be in a window."""
    if n <= WINDOW + 1:
        return 1
    return math.ceil(math.log(1 - RECALL) / math.log1p(-(AGREE ** math.log2(n / WINDOW))))


def _matrix(vecs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, shorter ones padded by zeros, and their lengths."""
    width = np.array([len(v) for v in vecs])
    return np.frombuffer(b"".join(v.ljust(width.max(), b"\0") for v in vecs)).reshape(len(vecs), -1), width


def _window_links(label, cls, vecs, until=None, since=0):
    """Links (a, b) that connect what verified pairs connect: of rows before `until` with the WINDOW next ones
    of their label, from `since` on."""
    n = len(cls)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = np.unique(np.array(label, dtype=object), return_inverse=True)[1]
    x, width = _matrix(vecs)
    until = n if until is None else until
    a, b = [], []
    for i in range(max(0, since - WINDOW), until, WINDOW):
        left, right = slice(i, min(i + WINDOW, until)), slice(max(i, since), min(i + 2 * WINDOW, n))
        p, q = np.nonzero(x[left] @ x[right].T >= COSINE)
        p, q = p + left.start, q + right.start
        ok = (q > p) & (q <= p + WINDOW)
        ok[ok] = (label[p[ok]] == label[q[ok]]) & (width[p[ok]] == width[q[ok]])
        a.append(p[ok])
        b.append(q[ok])
    a, b = np.concatenate(a or [np.zeros(0, int)]), np.concatenate(b or [np.zeros(0, int)])
    root = np.arange(n)
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for side in (a, b):
            np.minimum.at(root, root[side], low)
        while (root[root] != root).any():
            root = root[root]
    cls = np.array(cls, dtype=np.int64)
    other = np.flatnonzero(root != np.arange(n))
    return cls[root[other]], cls[other]


def keys_of(x: np.ndarray, turn: int) -> list[bytes]:
    """Signs of the products of rows with a pass's directions."""
    ways = np.random.Generator(np.random.PCG64([turn, x.shape[1]])).standard_normal((BITS, x.shape[1]))
    return [k.tobytes() for k in np.packbits(x @ ways.T > 0, axis=1)]


def means_of(uniq: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The mean vector of each label and length of (label, vec)."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            for label, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(v.as_buffer())
                n, total = sums.get((label, len(x)), (0, 0.0))
                sums[label, len(x)] = n + 1, total + x
        rows = [(label, size, n, total.tobytes()) for (label, size), (n, total) in sums.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("label", "size", "n", "total"), r, strict=True)) for r in rows], pa.schema([("label", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("total", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(t) for t in table.column("total").to_pylist()], axis=0) / sum(table.column("n").to_pylist())
        return table.slice(0, 1).select(["label", "size"]).append_column("mean", pa.array([total.tobytes()], pa.binary()))

    parts = uniq.select("label", "vec").mapInArrow(run, "label string, size int, n long, total binary")
    return {(r["label"], r["size"]): np.frombuffer(r["mean"]) for r in parts.groupBy("label", "size").applyInArrow(add, "label string, size int, mean binary").collect()}


def passed(uniq: DataFrame, turn: int, count: int, means: dict) -> DataFrame:
    """(a, b) links found by one pass over (label, cls, vec)."""
    means = uniq.sparkSession.sparkContext.broadcast(means)

    def key(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, width = _matrix([v.as_buffer().to_pybytes() for v in batch.column(2)])
            keys = np.empty(len(x), object)
            own = np.array([means.value.get((label, w // 8)) is not None for label, w in zip(batch.column(0).to_pylist(), width, strict=True)])
            x = x.copy()
            for i, label in enumerate(batch.column(0).to_pylist()):
                if own[i]:
                    x[i, : width[i] // 8] -= means.value[label, width[i] // 8]
            for w in np.unique(width):
                rows = np.flatnonzero(width == w)
                keys[rows] = keys_of(x[rows, : w // 8], turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.binary())], ["label", "cls", "vec", "key"])

    def compare(batches):
        part, label, cls, vecs, done = TaskContext.get().partitionId(), [], [], [], 0
        head: list = []
        for batch in batches:
            label += batch.column(0).to_pylist()
            cls += batch.column(1).to_pylist()
            vecs += batch.column(2).to_pylist()
            if len(head) < WINDOW:
                head += list(zip(label[done:], cls[done:], vecs[done:], strict=True))[: WINDOW - len(head)]
            if len(cls) > 4 * WINDOW:
                yield _edge_batch(*_window_links(label, cls, vecs, since=done))
                label, cls, vecs, done = label[-WINDOW:], cls[-WINDOW:], vecs[-WINDOW:], WINDOW
        if cls:
            yield _edge_batch(*_window_links(label, cls, vecs, since=done))
            tail = list(zip(label, cls, vecs, strict=True))[-WINDOW:]
            yield _ends(part, [*enumerate(head)], 1)
            yield _ends(part + 1, [*enumerate(tail)], 0)

    sortable = uniq.mapInArrow(key, "label string, cls long, vec binary, key binary")
    parts = max(1, min(partitions(uniq.sparkSession), count // (8 * WINDOW)))
    dealt = sortable.repartitionByRange(parts, "label", "key", "cls").sortWithinPartitions("label", "key", "cls").select("label", "cls", "vec")
    out = durable(dealt.mapInArrow(compare, "a long, b long, seam int, place int, label string, vec binary"))

    def seam(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("b", "place", "a", "label", "vec")), strict=True), key=lambda r: r[:2])
        tail = sum(r[0] == 0 for r in rows)
        a, b = _window_links([r[3] for r in rows], [r[2] for r in rows], [r[4] for r in rows], tail, tail)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    seams = out.where("seam is not null").groupBy("seam").applyInArrow(seam, "a long, b long")
    return out.where("seam is null").select("a", "b").union(seams)


def _edge_batch(a, b):
    n = len(a)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string()), pa.nulls(n, pa.binary())], ["a", "b", "seam", "place", "label", "vec"])


def _ends(seam, rows, side):
    """Rows at an end of a partition: a is the class, b which side of the seam it is on."""
    n = len(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array([r[1] for _, r in rows], pa.int64()), pa.array([side] * n, pa.int64()), pa.array([seam] * n, pa.int32()), pa.array([i for i, _ in rows], pa.int32()), pa.array([r[0] for _, r in rows], pa.string()), pa.array([r[2] for _, r in rows], pa.binary())],
        ["a", "b", "seam", "place", "label", "vec"],
    )


def _counted(table: pa.Table) -> pa.Table:
    """For each class of side 0 how many vectors of the task's other classes link with it."""
    side, cls, n, vecs = (table.column(c).to_pylist() for c in ("side", "cls", "n", "vec"))
    side, n, cls = np.array(side), np.array(n), np.array(cls, dtype=np.int64)
    own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    out = np.zeros(len(own), np.int64)
    if len(own) and len(other):
        x, width = _matrix(vecs)
        for k in range(0, len(own), SIDE):
            i = own[k : k + SIDE]
            ok = (x[i] @ x[other].T >= COSINE) & (cls[i][:, None] != cls[other]) & (width[i][:, None] == width[other])
            out[k : k + SIDE] = ok @ n[other]
    return pa.table([pa.array(cls[own]), pa.array(out)], names=["cls", "links"])


def link_counts(uniq: DataFrame, reached: DataFrame) -> DataFrame:
    """(cls, links): vectors of other classes in the same component that link with those of the class."""
    rows = durable(uniq.join(reached, uniq.cls == reached.node).select("cls", "vec", "n", "component"))
    sides = durable(rows.groupBy("component").agg(F.expr(f"cast(count(1) div {SIDE} + 1 as int)").alias("sides")))
    rows = rows.join(sides, "component").withColumn("block", F.expr("pmod(xxhash64(cls), sides)"))
    pair = F.explode(F.expr("sequence(0, sides - 1)")).alias("peer")
    left = rows.select("component", F.col("block").alias("i"), pair, F.lit(0).alias("side"), "cls", "n", "vec").withColumnRenamed("peer", "j")
    right = rows.select("component", F.col("block").alias("j"), pair, F.lit(1).alias("side"), "cls", "n", "vec").withColumnRenamed("peer", "i")
    return left.unionByName(right).groupBy("component", "i", "j").applyInArrow(_counted, "cls long, links long").groupBy("cls").agg(F.sum("links").alias("links"))


def near_vectors(rows: DataFrame) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept."""
    every = classes(rows)
    uniq = durable(every.where("cls is not null").groupBy("cls").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low")))
    many = {r["label"]: r["count"] for r in uniq.groupBy("label").count().where(F.col("count") > WINDOW + 1).collect()}
    slim, means = uniq.select("label", "cls", "vec"), {}
    links = passed(slim.where(~F.col("label").isin(list(many))) if len(many) <= 1000 else slim, 0, uniq.count() - sum(many.values()), {})
    if many:
        turns = F.broadcast(rows.sparkSession.createDataFrame([(x, turns_of(n)) for x, n in many.items()], "label string, turns int"))
        slim = durable(slim.join(turns, "label"))
        means = means_of(slim)
    for turn in range(1, 1 + max(map(turns_of, many.values()), default=0)):
        now = {x: n for x, n in many.items() if turns_of(n) >= turn}
        links = links.union(passed(slim.where(F.col("turns") >= turn).select("label", "cls", "vec"), turn, sum(now.values()), means))
    links = durable(links)
    reached = durable(components(links))
    counts = durable(link_counts(uniq, reached))
    of = durable(uniq.join(reached, uniq.cls == reached.node, "left").select("cls", "n", "low", F.coalesce("component", "cls").alias("component")))
    lows = durable(of.groupBy("component").agg(F.min("low").alias("component_id")))
    of = durable(of.join(lows, "component").join(counts, "cls", "left").select("cls", "component_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    linked = every.where("cls is not null").select("vec_id", "cls").join(of, "cls").select("vec_id", "n_links", "component_id")
    alone = every.where("cls is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
