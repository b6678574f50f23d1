"""Texts, lexicons and stop words from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators.vocabulary import with_ids


def folder(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, text) of a folder's files in UTF-8, one text for each; `.info.json` files are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    return rows.where(~F.endswith("path", F.lit(".info.json"))).select(F.xxhash64("path").alias("doc_id"), "path", "text")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) of a tab-separated file with a header: first column the word, tenth its frequency.

    Of a word's rows the largest frequency counts. The total is `lexicon_total`.
    """
    rows = spark.read.text(path).select(F.split("value", "\t").alias("c")).where(F.size("c") > 9)
    rows = rows.select(F.col("c")[0].alias("word"), F.try_to_number(F.trim(F.col("c")[9]), F.lit("9999999.999999999")).cast("double").alias("exact"), F.col("c")[9].try_cast("double").alias("freq"))
    return rows.select("word", F.coalesce("freq", "exact").alias("freq")).where(F.col("freq").isNotNull()).groupBy("word").agg(F.max("freq").alias("freq"))


def lexicon_total(words: DataFrame) -> DataFrame:
    """(total): the sum of all frequencies."""
    return words.agg(F.sum("freq").alias("total"))


def stop_words(spark: SparkSession, path: str | None, words: DataFrame) -> DataFrame:
    """(word, word_id) of a file's stop words, one a line, that the vocabulary has; Spark's French ones without a file."""
    if path:
        rows = spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")
    else:
        from pyspark.ml.feature import StopWordsRemover

        rows = spark.createDataFrame([(w,) for w in StopWordsRemover.loadDefaultStopWords("french")], "word string")
    return with_ids(rows.distinct(), words).where("word_id is not null").select("word", "word_id").distinct()
