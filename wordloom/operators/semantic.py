"""Word meanings: which words stand near which, as a matrix of few dimensions, cosines and densities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wordloom.functions.strings import has_upper
from wordloom.functions.terms import canonical, kind_by, pattern_of, said
from wordloom.language import FIRST_WORD, FRENCH, NONE, LanguageSpec
from wordloom.session import durable, small

from .ngrams import numbered
from .vocabulary import tag_ids, word_ids

#: Vectors of a block that is compared with another one.
SIDE = 1024
#: Terms of texts whose windows are counted at a time.
TERMS = 300_000
#: Stands for a separator among the ids of a text.
APART = -2


def positions(docs: DataFrame, language: LanguageSpec = FRENCH) -> DataFrame:
    """(m): the terms of each text in order, separators included. Narrow."""
    return docs.select(F.regexp_extract_all(canonical(F.col("text")), F.lit(pattern_of(language.semantic_matchers)), F.lit(0)).alias("m"))


def meant(spots: DataFrame, words: DataFrame, stops: DataFrame, language: LanguageSpec = FRENCH) -> DataFrame:
    """(ids): the terms of (m) rows as word ids, NONE for unknown words and stop words, APART for separators;
    texts not found are looked up in lower case. Each distinct term is classified once."""
    spots = durable(spots)
    known = durable(words.select("word", "word_id").unionByName(tag_ids(words.sparkSession)).join(stops.select("word_id"), "word_id", "left_anti").select("word", "word_id"))
    lower = known.select(F.col("word").alias("low"), F.col("word_id").alias("low_id"))
    terms = spots.select(F.explode(F.array_distinct("m")).alias("t")).distinct().select(F.struct(kind_by(F.col("t"), language.semantic_matchers).alias("k"), "t").alias("x"))
    terms = terms.select("x", F.when(F.col("x.k") != "SEPARATOR", said(F.col("x"))).alias("word"))
    rows = terms.withColumn("low", F.when(has_upper(F.col("word")), F.lower("word"))).join(small(known), "word", "left").join(small(lower), "low", "left")
    of = F.when(F.col("x.k") == "SEPARATOR", APART).otherwise(F.coalesce("word_id", "low_id"))
    return numbered(spots, "m", durable(rows.select(F.col("x.t").alias("word"), of.alias("word_id")).where("word_id is not null")), NONE)


def indexed(spots: DataFrame, most_rows: int | None = 80_000, most_columns: int | None = 5000) -> DataFrame:
    """(word_id, cnt, row, col): words by falling count, then id; a column has its row's number, col is null beyond
    the most frequent words. None stands for all words.

    No more than most_rows words are ranked: they are taken by a limit first. All words are ranked by ranges.
    """
    counts = spots.select(F.explode("ids").alias("word_id")).where("word_id >= 0").groupBy("word_id").agg(F.count(F.lit(1)).alias("cnt"))
    if most_rows is None:
        ranked = word_ids(counts.withColumnRenamed("word_id", "word")).select(F.col("word").alias("word_id"), "cnt", (F.col("word_id") - FIRST_WORD).alias("row"))
    else:
        top = durable(counts.orderBy(F.desc("cnt"), "word_id").limit(most_rows))
        ranked = top.withColumn("row", F.row_number().over(W.orderBy(F.desc("cnt"), "word_id")) - 1)
    return ranked.withColumn("col", F.col("row") if most_columns is None else F.when(F.col("row") < most_columns, F.col("row")))


def cooccurrences(spots: DataFrame, index: DataFrame, window: int = 100) -> DataFrame:
    """(row, col, value): how often words stand within half a window of one another, counted from both sides.

    The window moves by one for each term and each separator, so a centre counts once more for every
    separator after the window's last term; centres whose window passes the text's end don't count.
    Of two columns the pair is summed once and told both ways, as the value is the same.
    """
    half = (window + 1 - window % 2) // 2
    known = index.select(F.col("word_id").cast("int").alias("id"), "row", F.coalesce("col", F.lit(-1)).alias("col")).orderBy("id").toArrow()
    columns = pc.sum(pc.greater_equal(known.column("col"), 0)).as_py() or 0

    def count(batches):
        ids, row, col = (c.combine_chunks().to_numpy() for c in known.columns)
        for batch in batches:
            for part in _parts(batch.column(0)):
                a, b, value = _near(part, half, ids, row, col)
                once = (a <= b) | (a >= columns)
                yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (a, b, value)], names=["row", "col", "value"])

    once = spots.select("ids").mapInArrow(count, "row int, col int, value long").groupBy("row", "col").agg(F.sum("value").alias("value"))
    own, other = F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))
    cells = F.when((F.col("row") != F.col("col")) & (F.col("row") < columns), F.array(own, other)).otherwise(F.array(own))
    return once.select(F.explode(cells).alias("x"), "value").select("x.row", "x.col", "value")


def _parts(texts: pa.ListArray):
    """texts in slices of some TERMS terms, or of one text that has more."""
    part = np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False)) // TERMS
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
    for start, end in zip(starts, [*starts[1:], len(part)], strict=True):
        yield texts.slice(start, end - start)


def _near(texts: pa.ListArray, half: int, ids: np.ndarray, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, col, value) of some texts, each row and column once; ids, in order, with their row and column, -1 for none."""
    words = texts.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(texts).to_numpy(zero_copy_only=False)
    at = np.nonzero(words != APART)[0]
    text = np.repeat(np.arange(len(sizes)), sizes)[at]
    first, last = np.searchsorted(text, text, "left"), np.searchsorted(text, text, "right") - 1
    n, here = len(at), np.arange(len(at))
    until = np.where(here == last, np.cumsum(sizes)[text], np.append(at[1:], 0)) if n else at
    weight = until - at  # a step for the term and for each separator after it
    found = np.minimum(np.searchsorted(ids, words[at]), max(len(ids) - 1, 0))
    place = np.where(ids[found] == words[at], found, -1) if len(ids) else np.full(n, -1)
    centres = here[(here + half <= last) & (place >= 0)]
    keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in [*range(-half, 0), *range(1, half + 1)]:
        other = centres + step
        both = other >= first[centres]
        a, b = centres[both], other[both]
        a, b = a[place[b] >= 0], b[place[b] >= 0]
        worth = weight[a + half]
        for x, y in ((place[a], place[b]), (place[b], place[a])):
            kept = col[y] >= 0
            keys.append(x[kept].astype(np.int64) * len(ids) + y[kept])
            values.append(worth[kept])
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(values), len(keys)).astype(np.int64)
    return row[keys // max(1, len(ids))].astype(np.int32), col[keys % max(1, len(ids))].astype(np.int32), total


def fill(matrix: DataFrame, rows: int, columns: int) -> DataFrame:
    """(cells, share): how many cells have a value, and which share of all."""
    return matrix.agg(F.count(F.lit(1)).alias("cells")).select("cells", (F.col("cells") / float(max(1, rows * columns))).alias("share"))


def meanings(matrix: DataFrame, index: DataFrame, rank: int = 100) -> DataFrame:
    """(word_id, vec): the left singular vectors of the matrix, by word, each row of length 1."""
    from pyspark.mllib.linalg import VectorUDT
    from pyspark.mllib.linalg.distributed import IndexedRowMatrix

    spark, width = index.sparkSession, index.where("col is not null").count()
    if not width:
        return spark.createDataFrame([], "word_id int, vec array<double>")
    rows = matrix.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", F.col("value").cast("double").alias("value")))).alias("x"))
    # Sparse vectors as they are stored, so that they are read as such and no Python stands between the passes over them.
    sparse = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(width).alias("size"), F.col("x.col").alias("indices"), F.col("x.value").alias("values"))
    stored = durable(rows.select(F.col("row").cast("long").alias("index"), sparse.alias("vector")))
    schema = StructType([StructField("index", LongType()), StructField("vector", VectorUDT())])
    read = spark.read.schema(schema).parquet(*stored.inputFiles()).persist()
    found = IndexedRowMatrix(read, 0, width).computeSVD(min(rank, width), computeU=True)
    own = found.U.rows.map(lambda r: (int(r.index), [float(v) for v in r.vector]))
    vecs = durable(spark.createDataFrame(own, "row long, vec array<double>"))
    read.unpersist()
    return vecs.join(index.select(F.col("row").cast("long").alias("row"), "word_id"), "row").select("word_id", normalized(F.col("vec")).alias("vec"))


def length(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))


def normalized(vec: Column) -> Column:
    """vec at length 1; a vector of zeros stays one."""
    size = length(vec)
    return F.when(size > 0, F.transform(vec, lambda x: x / size)).otherwise(vec)


def cosine(a: Column, b: Column) -> Column:
    """The product of two vectors of length 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _blocks(rows: DataFrame, compare, schema: str) -> DataFrame:
    """Each block of (id, vec) rows with each other one, a task for each pair of blocks; no row meets all others in one."""
    rows = durable(rows.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")))
    sides = rows.count() // SIDE + 1
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(sides)).cast("int"))
    peer = F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("peer")
    left = rows.select("id", "vec", F.col("block").alias("i"), F.lit(0).alias("side"), peer).withColumnRenamed("peer", "j")
    right = rows.select("id", "vec", F.col("block").alias("j"), F.lit(1).alias("side"), peer).withColumnRenamed("peer", "i")
    return left.unionByName(right.select("id", "vec", "i", "side", "j")).groupBy("i", "j").applyInArrow(compare, schema)


def _sides(table: pa.Table):
    side = table.column("side").to_numpy()
    ids = table.column("id").to_numpy()
    vecs = np.stack([np.array(v, float) for v in table.column("vec").to_pylist()])
    return ids[side == 0], vecs[side == 0], ids[side == 1], vecs[side == 1]


def similar_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine), a < b: pairs of (id, vec) rows, vectors of length 1, whose cosine is `least` or more."""

    def compare(table: pa.Table) -> pa.Table:
        a, x, b, y = _sides(table)
        found = x @ y.T if len(a) and len(b) else np.zeros((len(a), len(b)))
        i, j = np.nonzero((found >= least) & (a[:, None] < b[None, :]))
        return pa.table([pa.array(a[i]), pa.array(b[j]), pa.array(found[i, j])], names=["a", "b", "cosine"])

    return _blocks(rows, compare, "a long, b long, cosine double")


def densities(rows: DataFrame, neighbours: int = 200) -> DataFrame:
    """(id, density): the mean cosine of each (id, vec) row with its nearest other ones, 0 where there is none.

    Each pair of blocks sends on only the `neighbours` best of a row.
    """

    def compare(table: pa.Table) -> pa.Table:
        a, x, b, y = _sides(table)
        if not len(a) or not len(b):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", "cosine"])
        found = np.where(a[:, None] == b[None, :], -np.inf, x @ y.T)
        best = -np.sort(-found, axis=1)[:, :neighbours]
        i, j = np.nonzero(np.isfinite(best))
        return pa.table([pa.array(a[i]), pa.array(best[i, j])], names=["id", "cosine"])

    near = _blocks(rows, compare, "id long, cosine double")
    ranked = near.withColumn("place", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine")))).where(F.col("place") <= neighbours)
    means = ranked.groupBy("id").agg(F.avg("cosine").alias("density"))
    return rows.select("id").join(means, "id", "left").select("id", F.coalesce("density", F.lit(0.0)).alias("density"))


def scaled(rows: DataFrame, low: float, high: float) -> DataFrame:
    """(id, density, scaled): densities over the largest one, between two bounds; the largest is 0 at least."""
    most = rows.agg(F.greatest(F.max("density"), F.lit(0.0)).alias("most"))
    return rows.join(F.broadcast(most)).select("id", "density", (low + F.try_divide("density", "most") * (high - low)).alias("scaled"))


def context_similarity(contexts: DataFrame, rows: DataFrame, candidates: DataFrame, contrast: float = 1.0) -> DataFrame:
    """(context, id, cosine, weight, share) of (context, id) candidates: their cosine with the sum of the vectors
    of the (context, id) words, and that less the smallest cosine (0 at most), to the power `contrast`.

    Contexts without a known word, and candidates without a vector, have no row.
    """
    each = contexts.select("context", "id").join(rows.select("id", "vec"), "id").select("context", F.posexplode("vec").alias("at", "x"))
    total = each.groupBy("context", "at").agg(F.sum("x").alias("x")).groupBy("context").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
    total = total.select("context", normalized(F.transform("v", lambda c: c["x"])).alias("sum"))
    out = candidates.select("context", "id").join(total, "context").join(rows.select("id", "vec"), "id").select("context", "id", cosine(F.col("sum"), F.col("vec")).alias("cosine"))
    least = F.least(F.lit(0.0), F.min("cosine").over(W.partitionBy("context")))
    out = out.withColumn("weight", F.pow(F.col("cosine") - least, F.lit(contrast)))
    return out.withColumn("share", F.try_divide("weight", F.sum("weight").over(W.partitionBy("context"))))


def trained(docs: DataFrame, words: DataFrame, stops: DataFrame, how, language: LanguageSpec = FRENCH) -> DataFrame:
    """(word_id, vec, density) of a corpus: the whole semantic training run; how: config.Training."""
    spots = durable(meant(positions(docs, language), words, stops, language))
    index = durable(indexed(spots, how.semantic_rows, how.semantic_columns))
    vecs = durable(meanings(durable(cooccurrences(spots, index, how.semantic_window)), index, how.semantic_rank))
    dense = densities(vecs.select(F.col("word_id").alias("id"), "vec"), how.density_neighbours)
    return vecs.join(dense.withColumnRenamed("id", "word_id"), "word_id")
