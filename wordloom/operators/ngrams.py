"""N-gram counts, discounts and back-off probabilities as tables of word ids.

An n-gram is a row (n, w1..w_order, cnt) with NONE in the columns after the n-th. A context is the row
(n, c1..c_{order-1}) of the n - 1 words that come before the n-th.
"""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.language import NONE, START, UNKNOWN
from wordloom.session import BROADCAST_ROWS, durable, released, small

ORDER = 4
#: Arrays that are handled at a time.
SLICE = 2000
#: Contexts that are asked for and may be broadcast: the driver holds them twice while it does so.
ASKED_ROWS = 100_000
#: Bounds of a discount that is found from counts, and the discount where no n-gram is rare.
LOWEST, HIGHEST, EVEN = 0.1, 0.9, 0.5


def _names(letter: str, count: int) -> list[str]:
    return [f"{letter}{k}" for k in range(1, count + 1)]


def numbered(rows: DataFrame, words: str, ids: DataFrame, missing: int) -> DataFrame:
    """(ids): rows' arrays of words as arrays of word ids, `missing` where ids has no row.

    ids: (word, word_id), a durable table, a row for each word. Where it is small it goes to every task and
    nothing is shuffled; else the one shuffle brings the ids of an array together again.
    """
    if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = ids.select("word", F.col("word_id").cast("int").alias("word_id")).toArrow()

        def encode(batches):
            texts, codes = (c.combine_chunks() for c in known.columns)
            codes = np.append(codes.to_numpy(), np.int32(missing))
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    said = batch.column(0).slice(start, SLICE)
                    at = pc.fill_null(pc.index_in(said.flatten(), value_set=texts), len(codes) - 1).to_numpy(zero_copy_only=False)
                    ends = np.append(0, np.cumsum(pc.list_value_length(said).to_numpy(zero_copy_only=False))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(codes[at], pa.int32()))], names=["ids"])

        return rows.select(words).mapInArrow(encode, "ids array<int>")
    rows = rows.select(F.monotonically_increasing_id().alias("key"), words)
    tokens = rows.select("key", F.posexplode(words).alias("pos", "word")).join(ids, "word", "left")
    of = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("word_id", F.lit(missing)).alias("id"))))
    return tokens.groupBy("key").agg(of.alias("of")).select(F.transform("of", lambda x: x["id"]).alias("ids"))


def encoded(spoken: DataFrame, ids: DataFrame) -> DataFrame:
    """(ids): the sentences of texts of several terms as arrays of word ids, UNKNOWN where ids has no row."""
    return numbered(spoken.where("n_terms > 1"), "words", ids, UNKNOWN)


def _longest(order: int):
    """The longest n-grams at each place of batches of (ids), as columns with how often a batch
    has them; NONE from the first unknown word on."""

    def cut(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.append(0, np.cumsum(sizes + 1))
            words = np.full(starts[-1] + order, NONE, np.int32)
            words[starts[:-1]] = START
            inner = np.ones(starts[-1], bool)
            inner[starts[:-1]] = False
            words[: starts[-1]][inner] = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            left = np.repeat(starts[1:], sizes + 1) - np.arange(starts[-1])
            ended, columns = np.zeros(starts[-1], bool), []
            for k in range(order):
                here = words[k : starts[-1] + k]
                ended = ended | (left <= k) | (here == UNKNOWN) | (here == NONE)
                columns.append(np.where(ended, np.int32(NONE), here))
            columns = [c[columns[0] != NONE] for c in columns]
            by = np.lexsort(columns[::-1])
            columns = [c[by] for c in columns]
            new = np.nonzero(np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in columns]))[: len(by)])[0]
            counted = pa.array(np.diff(np.append(new, len(by))), pa.int64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c[new], pa.int32()) for c in columns), counted], names=[*_names("w", order), "cnt"])

    return cut


def counts(sentences: DataFrame, order: int = ORDER) -> DataFrame:
    """(n, w1..w_order, cnt): the n-grams of all orders, with one START before each sentence, none with UNKNOWN.

    Only the longest n-gram that begins at a place is counted from the texts; those of a lower order are
    sums of these counts over what they begin with, each found from the next higher order's table.
    """
    cols = _names("w", order)
    of_all = sentences.select(F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_longest(order), ", ".join(f"{c} int" for c in cols) + ", cnt long")
    # Dealt by what the next lower order is counted by, so that its counts are summed before they are sent.
    table, tables = of_all.repartition(*cols[: max(1, order - 1)]).groupBy(*cols).agg(F.sum("cnt").alias("cnt")), []
    for n in range(order, 0, -1):
        if n < order:
            table = table.groupBy(*cols[:n]).agg(F.sum("cnt").alias("cnt"))
        table = durable(table)
        released(sentences.sparkSession)
        own = table.where(F.col(f"w{n}") != NONE)
        tables.append(own.select(F.lit(n).alias("n"), *cols[:n], *[F.lit(NONE).alias(w) for w in cols[n:]], "cnt"))
    return reduce(DataFrame.unionByName, tables)


def totals(grams: DataFrame) -> DataFrame:
    """(n, unique_ngrams, total_ngrams)."""
    return grams.groupBy("n").agg(F.count(F.lit(1)).alias("unique_ngrams"), F.sum("cnt").alias("total_ngrams"))


def discounts(grams: DataFrame, low: float = LOWEST, high: float = HIGHEST, fixed: float | None = None) -> DataFrame:
    """(n, n1, n2, d): the discount of each order, `fixed` or from the n-grams seen once and twice.

    n-grams with START don't count there: it stands first or nowhere.
    """
    rows = grams.groupBy("n").agg(F.count_if((F.col("cnt") == 1) & (F.col("w1") != START)).alias("n1"), F.count_if((F.col("cnt") == 2) & (F.col("w1") != START)).alias("n2"))
    raw = F.when(F.col("n1") + 2 * F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(EVEN)
    return rows.select("n", "n1", "n2", (F.lit(fixed) if fixed else F.least(F.lit(high), F.greatest(F.lit(low), raw))).cast("double").alias("d"))


def _context(order: int, alias: str = "c") -> list[Column]:
    return [F.when(F.col("n") > k, F.col(f"w{k}")).otherwise(NONE).alias(f"{alias}{k}") for k in range(1, order)]


def contexts(grams: DataFrame, d: DataFrame, order: int = ORDER) -> DataFrame:
    """(n, c1..c_{order-1}, total, children, d, bow); d: (n, d), a row for each order."""
    rows = grams.select("n", *_context(order), "cnt").groupBy("n", *_names("c", order - 1)).agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("children"))
    rows = rows.join(F.broadcast(d.select("n", "d")), "n")
    bow = F.when((F.col("n") > 1) & (F.col("total") > 0), F.try_divide(F.col("children") * F.col("d"), F.col("total").cast("double"))).otherwise(1.0)
    return rows.select("n", *_names("c", order - 1), "total", "children", "d", bow.alias("bow"))


def probabilities(grams: DataFrame, of: DataFrame, order: int = ORDER) -> DataFrame:
    """grams with prob, the discounted share of an n-gram among what follows its context; `of`: contexts."""
    cs = _names("c", order - 1)
    rows = grams.select("*", *_context(order)).join(of.select("n", *cs, "total", "d"), ["n", *cs])
    d = F.when(F.col("n") > 1, F.col("d")).otherwise(0.0)
    return rows.select(*grams.columns, F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("cnt") - d), F.col("total").cast("double")), F.lit(0.0)).alias("prob"))


def _lead(n, words, low, where):
    """One number of an n-gram's order and the first two words of its context; ids of 2**30 and more share numbers."""
    first = where(n > 1, words[0] * (1 << 30), low)
    return n * (1 << 60) + first + where(n > 2, words[1], low) if len(words) > 2 else n * (1 << 60) + first


def _totals(order: int):
    """What the contexts of batches of (n, w1.., cnt), sorted by `_lead`, add up to, beside each row; `first` is true in
    one row of a context. Rows whose lead may go on in the next batch wait for it; those of a lead are sorted here."""

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            own = [] if batch is None else [c.to_numpy() for c in batch.columns]
            own = own if held is None else held if batch is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
            if not own or not len(own[0]):
                continue
            lead = _lead(own[0].astype(np.int64), [w.astype(np.int64) for w in own[1 : order + 1]], np.int64(0), np.where)
            whole = int(np.argmax(lead == lead[-1])) if batch is not None else len(lead)
            held = [x[whole:] for x in own]
            if not whole:
                continue
            n, *context = own[0][:whole], *(np.where(own[0][:whole] > k, own[k][:whole], NONE) for k in range(1, order))
            by = np.lexsort([*context[::-1], n, lead[:whole]])
            own, n, context = [x[:whole][by] for x in own], n[by], [c[by] for c in context]
            new = np.append(True, reduce(np.logical_or, [c[1:] != c[:-1] for c in (n, *context)]))
            start = np.flatnonzero(new)
            children = np.diff(np.append(start, whole))
            total = np.add.reduceat(own[order + 1], start)
            more = [pa.array(np.repeat(x, children), pa.int64()) for x in (total, children)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in own), *more, pa.array(new)], names=["n", *_names("w", order), "cnt", "total", "children", "first"])

    return run


def modelled(grams: DataFrame, d: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(freq, of): what `probabilities`, with the context's bow beside prob, and `contexts` say, found by one shuffle.

    n-grams are dealt by the first two words of their contexts and sorted; each context is then a run of rows.
    Both are dealt and sorted in this way.
    """
    ws = _names("w", order)
    rows = grams.select(F.col("n").cast("int").alias("n"), *[F.col(w).cast("int").alias(w) for w in ws], F.col("cnt").cast("long").alias("cnt"))
    lead = _lead(F.col("n").cast("long"), [F.col(w).cast("long") for w in ws], F.lit(0).cast("long"), lambda c, a, b: F.when(c, a).otherwise(b))
    # Sorted by a single number, which takes no comparisons.
    dealt = rows.repartition(lead).sortWithinPartitions(lead)
    both = durable(dealt.mapInArrow(_totals(order), ", ".join(["n int", *(f"{w} int" for w in ws), "cnt long, total long, children long, first boolean"])))
    both = both.join(F.broadcast(d.select("n", "d")), "n")
    share = F.col("total").cast("double")
    bow = F.when((F.col("n") > 1) & (F.col("total") > 0), F.try_divide(F.col("children") * F.col("d"), share)).otherwise(1.0)
    less = F.when(F.col("n") > 1, F.col("d")).otherwise(0.0)
    prob = F.coalesce(F.try_divide(F.greatest(F.lit(0.0), F.col("cnt") - less), share), F.lit(0.0))
    freq = both.select("n", *ws, "cnt", prob.alias("prob"), bow.alias("bow"))
    return freq, both.where("first").select("n", *_context(order), "total", "children", "d", bow.alias("bow"))


def about(table: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """The rows of n-grams or contexts that belong to the contexts asked for, (c1..c_{order-1}), or to their
    ends at lower orders, as a durable table. A context has all of its n-grams there or none; single words are all there.
    """
    letter = "w" if "w1" in table.columns else "c"
    asked, parts = durable(asked.select(*_names("c", order - 1)).distinct()), [table.where("n = 1")]
    for n in range(2, order + 1):
        ends = asked.select(*[F.col(f"c{order - n + k}").alias(f"{letter}{k}") for k in range(1, n)]).distinct()
        own = table.where(F.col("n") == n).join(small(ends, ASKED_ROWS), _names(letter, n - 1), "left_semi")
        parts.append(own.select(*table.columns))
    return durable(reduce(DataFrame.unionByName, parts))


def levels(rows: DataFrame, freq: DataFrame, of: DataFrame, order: int = ORDER) -> DataFrame:
    """rows (c1..c_{order-1}, word_id, ...) with f_n, the share of the word at each order, b_n, the back-off
    weight of the context at each order, and p, the back-off probability.

    A context that the model lacks has share 0 and weight 1. Contexts are looked up once for each, words
    once for each row; a side is broadcast where Spark finds it small.
    """
    cs = _names("c", order - 1)
    seen = rows.select(*cs).distinct()
    for n in range(2, order + 1):
        last = cs[order - n :]
        own = of.where(F.col("n") == n).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(last, 1)], F.col("bow").alias(f"b{n}"))
        seen = seen.join(own, last, "left")
    rows = rows.join(seen.fillna(1.0, [f"b{n}" for n in range(2, order + 1)]), cs)
    for n in range(1, order + 1):
        last = cs[order - n :]
        own = freq.where(F.col("n") == n).select(*[F.col(f"w{k}").alias(c) for k, c in enumerate(last, 1)], F.col(f"w{n}").alias("word_id"), F.col("prob").alias(f"f{n}"))
        rows = rows.join(own, [*last, "word_id"], "left")
    rows = rows.fillna(0.0, [f"f{n}" for n in range(1, order + 1)])
    p = reduce(lambda low, n: F.col(f"f{n}") + F.col(f"b{n}") * low, range(2, order + 1), F.col("f1"))
    return rows.withColumn("p", p)


def raw_probability(rows: DataFrame, freq: DataFrame, order: int = ORDER) -> DataFrame:
    """rows (c1..c_{order-1}, word_id) whose context the model has, with the share at the highest order alone."""
    cs = _names("c", order - 1)
    own = freq.where(F.col("n") == order).select(*[F.col(f"w{k}").alias(f"c{k}") for k in range(1, order)], F.col(f"w{order}").alias("word_id"), "prob")
    known = own.select(*cs).distinct()
    return rows.join(known, cs, "left_semi").join(own, [*cs, "word_id"], "left").fillna(0.0, ["prob"])


def backed_off(freq: DataFrame, of: DataFrame, order: int = ORDER, whole: bool = True, upto: int | None = None) -> DataFrame:
    """freq with p, the back-off probability of each n-gram, found from `low`, that of its last n - 1 words.
    Where freq has the contexts' bow, as `modelled` gives it, `of` isn't needed for whole tables.

    In a whole table, of which nothing was pruned, these are an n-gram as well. In others the back-off of
    the shorter context stands in where they aren't. Orders above `upto` are left out.
    """
    cols, out = _names("w", order), []
    for n in range(1, (upto or order) + 1):
        rows = freq.where(F.col("n") == n).withColumn("p", F.col("prob")).withColumn("low", F.lit(None).cast("double"))
        if n > 1:
            rows = rows.drop("low")
            if "bow" not in freq.columns:
                bow = of.where(F.col("n") == n).select(*[F.col(f"c{k}").alias(f"w{k}") for k in range(1, n)], "bow")
                rows = rows.join(bow, cols[: n - 1])
            low = out[-1].select(*[F.col(f"w{k - 1}").alias(f"w{k}") for k in range(2, n + 1)], F.col("p").alias("low"))
            if not whole:
                ask = rows.select(*[F.lit(NONE).alias(f"c{k}") for k in range(1, order - n + 2)], *[F.col(f"w{k}").alias(f"c{order - n + k}") for k in range(2, n)], F.col(f"w{n}").alias("word_id")).distinct()
                low = levels(ask, freq, of, order).select(*[F.col(f"c{order - n + k}").alias(f"w{k}") for k in range(2, n)], F.col("word_id").alias(f"w{n}"), F.col("p").alias("low"))
            rows = rows.join(low, cols[1:n], "left" if "bow" in freq.columns else "inner").withColumn("p", F.col("prob") + F.col("bow") * F.col("low"))
        out.append(durable(rows.select("n", *cols, "cnt", "prob", "p", "low")))
    return reduce(DataFrame.unionByName, out)
