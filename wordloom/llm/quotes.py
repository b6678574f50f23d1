"""Chat formatting by quotation linking.

A message's lines are parsed into quote levels; what stands without a quote mark is its own content.
Each run of lines of one level is a quoted passage; it, its paragraphs and its lines are normalised and
hashed, and so is the own content of every message. The first message of a conversation with a passage
as its own is the passage's original. A message replies to the original that the longest matched passage
of its least quote level comes from. Of equally long ones the later source counts. Replies are ordered below the message they answer by `path`, and
what is left of a message has no quotes.

Defined results. Hashes are joined within a conversation, and an original must stand before the quote.
A message whose quotes match nothing, or without quotes, is a root of its own; a conversation without
quotes is thus in order of its turns. Null text is empty; messages with null conv_id or turn are roots
and link with nothing. Of rows that repeat (conv_id, turn) each is a row of the result; replies to them
meet at that turn. A quote of a message by itself is no link. Extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, small_batches

_MARK = re.compile(r"^[ \t]*((?:>[ \t]?)+)")
_WROTE = re.compile(r"^\s*(on\b.*\bwrote|le\b.*\ba écrit|am\b.*\bschrieb.*|el\b.*\bescribió)\s*:\s*$", re.IGNORECASE)
_PARAGRAPH = re.compile(r"\n\s*\n")


def parsed(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own content, and its quoted passages as (level, text)."""
    own, runs, last = [], [], 0
    for line in text.split("\n"):
        mark = _MARK.match(line)
        level = mark[1].count(">") if mark else 0
        if not level:
            own.append(line)
        elif level == last:
            runs[-1][1].append(line[mark.end() :])
        else:
            runs.append((level, [line[mark.end() :]]))
        last = level
    if runs:
        own = [line for line in own if not _WROTE.match(line)]
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in runs]


def hashed(passage: str) -> dict[int, int]:
    """Hash and length of a passage, its paragraphs and its lines, normalised; blank ones don't count."""
    out = {}
    for part in {passage, *_PARAGRAPH.split(passage), *passage.split("\n")}:
        plain = " ".join(part.lower().split())
        if plain:
            out[xxhash.xxh64_intdigest(plain) - (1 << 63)] = len(plain)
    return out


def messages(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, content, own (hashes), quotes (level, hash, length) of each message."""

    def run(batches):
        for batch in batches:
            content, own, quotes = [], [], []
            for text in batch.column(3).to_pylist():
                said, passages = parsed(text or "")
                content.append(said)
                own.append(list(hashed(said)))
                quotes.append([{"level": level, "hash": h, "size": n} for level, p in passages for h, n in hashed(p).items()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(content, pa.string()), pa.array(own, pa.list_(pa.int64())), pa.array(quotes, pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("size", pa.int32())])))],
                ["conv_id", "turn", "role", "content", "own", "quotes"],
            )

    small_batches(rows.sparkSession, 1024)
    slim = rows.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "text")
    return slim.mapInArrow(run, "conv_id long, turn long, role string, content string, own array<long>, quotes array<struct<level: int, hash: long, size: int>>")


def replies(parsed_rows: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn) of the messages with a matched quote."""
    ask = parsed_rows.where("size(quotes) > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*")
    ask = durable(ask)
    # Only hashes that are quoted at all are looked up.
    own = parsed_rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("own").alias("hash"))
    wanted = durable(ask.select("conv_id", "hash").distinct())
    first = durable(own.join(wanted, ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("source")))
    hit = ask.join(first, ["conv_id", "hash"]).where("source < turn")
    best = F.max_by("source", F.struct(-F.col("level"), F.col("size"), F.col("source")))
    return hit.groupBy("conv_id", "turn").agg(best.alias("parent_turn"))


def threaded(rows: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, content, parent_turn, root_turn, depth, path, n_quotes.

    Sorting by (conv_id, path) is the reply order. Ancestors are found by doubling: in each round every
    reply adds the path that its farthest known ancestor has found.
    """
    said = durable(messages(rows).withColumn("n_quotes", F.size("quotes").cast("long")))
    # Sixteen hexadecimal digits that sort as the turns do, negative ones first. A reply's source stands before
    # it, so that paths end however deep they are.
    label = lambda c: F.lpad(F.hex(c.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    up = durable(replies(said).select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("top"), F.lit(1).alias("depth"), label(F.col("turn")).alias("path")))
    while True:
        above = up.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("next"), F.col("depth").alias("more"), F.col("path").alias("before"))
        joined = up.join(above, ["conv_id", "top"], "left")
        if joined.where("next is not null").isEmpty():
            break
        up = durable(joined.select("conv_id", "turn", "parent_turn", F.coalesce("next", "top").alias("top"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.when(F.col("before").isNotNull(), F.concat_ws("/", "before", "path")).otherwise(F.col("path")).alias("path")))
    out = said.drop("own", "quotes").join(up, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "content", "parent_turn", F.coalesce("top", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat_ws("/", label(F.coalesce("top", "turn")), F.col("path")).alias("path"), "n_quotes",
    )


def formatted(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The messages in reply order, sorted over partitions: no conversation is gathered in one row."""
    out = threaded(rows)
    keys = ["conv_id", "path", "turn"]
    dealt = out.repartitionByRange(partitions, *keys) if partitions else out.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)
