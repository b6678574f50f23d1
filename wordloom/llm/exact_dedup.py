"""Exact dedup by two passes over a Bloom filter. [native]

Pass one counts hash cells and keeps, as bitmaps, the cells that two rows or more fall into. Pass two
probes them: a row with a cell of its own has no equal and passes straight through; only rows whose
cells are all shared are shuffled by their digest and grouped. False alarms of the filter form groups
of one and come out like rows that passed.

Defined results. Null text counts as empty; empty texts are equal to one another. Of equal texts the
one with the most code points stays, then the smallest doc_id (null ids come last), then the first
row. A row that repeats another one wholly, id included, is a copy: one of them stays. Extra columns
are ignored by the report and carried along by distinct_rows(). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable

#: What is deleted before texts are compared: space and the controls from tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
#: Cells of the filter for each row, and the largest number of cells. The bitmaps take an eighth of
#: that in bytes, which bounds what is broadcast: 32 MB.
CELLS_PER_ROW = 16
MOST_CELLS = 1 << 28
LAST_ID = (1 << 63) - 1


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, "")


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def _cell(sha: Column, which: int, cells: int) -> Column:
    """A cell from digits of the digest of its own: 12 hexadecimal digits for each hash function."""
    return F.pmod(F.conv(F.substring(sha, 1 + 12 * which, 12), 16, 10).cast("long"), F.lit(cells))


def repeated_cells(rows: DataFrame, cells: int, hashes: int = 2) -> DataFrame:
    """(bucket, bits): bitmaps of the cells that more than one row has; at most cells / 8 bytes."""
    hit = rows.select(F.explode(F.array(*[_cell(F.col("sha"), i, cells) + i * cells for i in range(hashes)])).alias("cell"))
    shared = hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return shared.groupBy(F.expr("cell div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("cell % 32768")).alias("bits"))


def flagged(rows: DataFrame, bitmaps: DataFrame, cells: int, hashes: int = 2) -> DataFrame:
    """rows with `maybe`: whether all cells of the row are shared."""
    maybe = F.lit(True)
    for i in range(hashes):
        cell = _cell(F.col("sha"), i, cells) + i * cells
        side = F.broadcast(bitmaps.select(F.col("bucket").alias(f"bucket{i}"), F.col("bits").alias(f"bits{i}")))
        rows = rows.withColumn(f"cell{i}", cell).join(side, F.expr(f"cell{i} div 32768") == F.col(f"bucket{i}"), "left")
        byte = F.conv(F.hex(F.expr(f"substring(bits{i}, cast((cell{i} % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
        bit = F.pow(F.lit(2), F.col(f"cell{i}") % 8).cast("int")
        maybe = maybe & F.coalesce(byte.bitwiseAND(bit) != 0, F.lit(False))
    return rows.withColumn("maybe", maybe).drop(*[f"{n}{i}" for i in range(hashes) for n in ("cell", "bucket", "bits")])


def repeat_filter(slim: DataFrame) -> tuple[DataFrame, int]:
    """Pass one: the bitmaps of shared cells, sized by the number of rows, and how many cells there are."""
    n, cells = slim.count(), 1 << 15
    while cells < min(MOST_CELLS // 2, CELLS_PER_ROW * n):
        cells *= 2
    return durable(repeated_cells(slim, cells)), cells


def groups_of(suspects: DataFrame) -> DataFrame:
    """For each digest of the suspects: how many rows have it and which of them stays."""
    order = F.struct(F.col("length"), -F.coalesce("doc_id", F.lit(LAST_ID)), -F.col("row"))
    return durable(
        suspects.groupBy("sha")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max_by(F.struct("doc_id", "row"), order).alias("keep"))
        .select("sha", "group_size", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row").alias("keep_row"))
    )


def slim_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, length, sha) of each row, written down so that both passes read the texts once."""
    return durable(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.length(F.coalesce("text", F.lit(""))).alias("length"),
            digest(F.col("text")).alias("sha"),
        )
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    slim = slim_rows(docs)
    marked = flagged(slim, *repeat_filter(slim))
    suspects = marked.where("maybe")
    through = marked.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    grouped = suspects.join(groups_of(suspects), "sha").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return through.unionByName(grouped)


def distinct_rows(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept. Unsuspected rows don't shuffle."""
    slim = slim_rows(docs)
    bitmaps, cells = repeat_filter(slim)
    groups = groups_of(flagged(slim, bitmaps, cells).where("maybe"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), digest(F.col("text")).alias("sha"))
    whole = flagged(whole, bitmaps, cells)
    through = whole.where("not maybe").select("doc")
    # Of the suspects only those with the id and digest of the row that stays are grouped.
    stays = groups.select("sha", F.coalesce("keep_id", F.lit(LAST_ID)).alias("keep_id"))
    suspects = whole.where("maybe").withColumn("keep_id", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(LAST_ID)))
    kept = suspects.join(stays, ["sha", "keep_id"], "left_semi")
    order = F.struct(F.length(F.col("doc.text")), F.xxhash64("doc"))
    kept = kept.groupBy("sha", "keep_id").agg(F.max_by("doc", order).alias("doc")).select("doc")
    return through.select("doc").unionByName(kept).select("doc.*")
