"""Trains a model: python -m wordloom DOCUMENTS OUTPUT [--config FILE] [--text-files] [--lexicon FILE] ..."""

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wordloom import training
from wordloom.config import Training
from wordloom.language import FRENCH
from wordloom.operators import semantic
from wordloom.sources import corpus, model


def main() -> None:
    p = argparse.ArgumentParser(prog="wordloom")
    p.add_argument("documents", help="Parquet with a text column, or a folder of text files")
    p.add_argument("output", help="folder of the model; it must not exist unless --overwrite is given")
    p.add_argument("--config", help="a JSON file of settings")
    p.add_argument("--language", default="fr", choices=["fr"])
    p.add_argument("--lexicon", help="tab-separated words and frequencies")
    p.add_argument("--text-files", action="store_true")
    p.add_argument("--semantic", action="store_true", help="word meanings as well")
    p.add_argument("--since", default=training.STAGES[0], choices=training.STAGES, help="the first stage to run; earlier ones are read")
    p.add_argument("--overwrite", action="store_true")
    a = p.parse_args()
    how = Training()
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            how = Training.from_json(f.read())
    spark = SparkSession.builder.appName("wordloom").getOrCreate()
    docs = corpus.folder(spark, a.documents) if a.text_files else spark.read.parquet(a.documents).select("text").withColumn("doc_id", F.monotonically_increasing_id())
    lexicon = a.lexicon or how.lexicon
    words = corpus.lexicon(spark, lexicon) if lexicon else spark.createDataFrame([], "word string, freq double")
    trained = training.train(docs, words, how, a.output, a.since, FRENCH, overwrite=a.overwrite)
    if a.semantic:
        stops = corpus.stop_words(spark, how.stop_words, trained.words)
        model.save_meanings(semantic.trained(docs, trained.words, stops, how), f"{a.output}/meanings", a.overwrite)


if __name__ == "__main__":
    main()
