"""What a user wrote as a model of its own beside the trained one, and how the two are mixed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.language import FIRST_WORD, NONE, UNKNOWN
from wordloom.session import durable
from wordloom.sources.model import Model

from .ngrams import contexts, discounts, probabilities
from .vocabulary import predictable, tag_ids, tuned, user_words, with_ids, word_ids

#: The discount of what a user wrote, for every order.
DISCOUNT = 0.5


def learned_words(said: DataFrame, model: Model) -> DataFrame:
    """User-word rows of a tuned table: words of (user, word[, at]) longer than two characters that the
    vocabulary lacks, with ids after its own, how often they were used and when last."""
    own = user_words(said, model.words).groupBy("word").agg(F.sum("cnt").alias("use_count"), *([F.max("last_use").alias("last_use")] if "at" in said.columns else []))
    last = model.words.agg(F.max("word_id")).first()[0] or UNKNOWN
    rows = word_ids(own.select("word", F.col("use_count").alias("cnt"))).drop("cnt").join(own, "word")
    rows = rows.select((F.col("word_id") - FIRST_WORD + last + 1).cast("int").alias("word_id"), "word", F.lit(0).cast("long").alias("cnt"), "use_count", F.lit(True).alias("user_word"), *(["last_use"] if "last_use" in own.columns else []))
    return tuned(rows)


def as_ids(counted: DataFrame, words: DataFrame, order: int) -> DataFrame:
    """(n, w1..w_order, cnt) of (n, gram, cnt), grams as arrays of words, over all users; unknown words are UNKNOWN.

    What the inserted n-grams begin with is there as well, with a count of 0 unless it was inserted itself.
    """
    cols = [f"w{k}" for k in range(1, order + 1)]
    grams = counted.groupBy("n", "gram").agg(F.sum("cnt").alias("cnt")).select(F.xxhash64("gram").alias("key"), "n", "gram", "cnt")
    known = durable(words.select("word", "word_id").unionByName(tag_ids(words.sparkSession)))
    each = with_ids(grams.select("key", "cnt", F.posexplode("gram").alias("pos", "word")), known)
    wide = each.groupBy("key", "cnt").agg(*[F.max(F.when(F.col("pos") == k, F.coalesce("word_id", F.lit(UNKNOWN)))).alias(c) for k, c in enumerate(cols)]).fillna(NONE, cols)
    size = reduce(lambda n, c: n + F.when(F.col(c) != NONE, 1).otherwise(0), cols, F.lit(0))
    wide = wide.select(size.alias("n"), *cols, "cnt")
    begins = wide.select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("m"), "n", *cols, "cnt")
    begins = begins.select(F.col("m").alias("n"), *[F.when(F.col("m") > k, F.col(c)).otherwise(NONE).alias(c) for k, c in enumerate(cols)], F.when(F.col("m") == F.col("n"), F.col("cnt")).otherwise(0).alias("cnt"))
    return begins.groupBy("n", *cols).agg(F.sum("cnt").alias("cnt"))


def interpolated(grams: DataFrame, model: Model, least_weight: float = 0.05) -> dict:
    """The tables of a dynamic model (n, w1.., cnt) with shares and back-off weights, and its weight: its words
    for each word of the trained model, `least_weight` at least. The weight may pass 1; it is not cut."""
    grams = durable(grams)
    of = durable(contexts(grams, discounts(grams, fixed=DISCOUNT), model.order))
    freq = durable(probabilities(grams, of, model.order))
    said = grams.where("n = 1").agg(F.sum("cnt")).first()[0] or 0
    known = model.grams.where("n = 1").count()
    return {"grams": freq, "contexts": of, "weight": max(said / known if known else 0.0, least_weight)}


def used_words(grams: DataFrame) -> DataFrame:
    """(word_id): words at the first two places of a dynamic model's n-grams."""
    return grams.select(F.explode(F.array("w1", "w2")).alias("word_id")).where(F.col("word_id") != NONE).distinct()


def valid_user_words(words: DataFrame, least_uses: int = 10) -> DataFrame:
    return words.where(F.col("user_word") & predictable(least_uses))
