"""Training in stages, each a table that the next one reads; a run can start from any stage that is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.config import Training
from wordloom.functions.terms import spoken
from wordloom.language import FRENCH, LanguageSpec
from wordloom.operators import ngrams as N
from wordloom.operators import vocabulary as V
from wordloom.operators.pruning import by_count, by_difference
from wordloom.session import discard, durable, place
from wordloom.sources import model

STAGES = ("terms", "counts", "words", "sentences", "grams", "model")


def pruned(grams: DataFrame, how: Training) -> DataFrame:
    if how.pruning == "raw_count":
        return by_count(grams, dict.fromkeys(range(2, how.order + 1), how.raw_count), how.order)
    if how.pruning == "order_count":
        return by_count(grams, {n: how.least[n - 1] for n in range(2, how.order + 1)}, how.order)
    if how.pruning in ("difference", "raw_difference"):
        return by_difference(grams, how.difference, how.pruning == "raw_difference", how.order, how.discount)
    return grams


def train(docs: DataFrame, lexicon: DataFrame, how: Training | None = None, at: str | None = None, since: str = STAGES[0], language: LanguageSpec = FRENCH, watch: Callable[[str, DataFrame], None] | None = None, overwrite: bool = True, until: str = STAGES[-1]) -> model.Model | None:
    """A model of (doc_id, text) rows, with lexicon (word, freq); None where `until` is not the last stage.

    Stages are written below `at`; those before `since` are read from there, those after `until` are left out. `watch` is called with each
    stage's name and table, and with `unpruned` before pruning.
    """
    spark, how, at = docs.sparkSession, how or Training(), at or place(docs.sparkSession, "training")

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if STAGES.index(name.split("-")[0]) >= STAGES.index(since):
            made = make()
            made.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(f"{at}/{name}")
            if name == "grams":  # each order's counts are there twice now
                discard(made)
        out = spark.read.parquet(f"{at}/{name}")
        if watch:
            watch(name, out)
        return out

    last = STAGES.index(until)
    said = stage("terms", lambda: spoken(docs.select("doc_id", "text"), language.ngram_matchers))
    if last < STAGES.index("counts"):
        return None
    counts = stage("counts", lambda: V.counted(said))
    if last < STAGES.index("words"):
        return None
    clean = stage("words-clean", lambda: V.cleaned(counts, lexicon, how.lowered_from, how.respelled_from, how.unknown_to, how.valid_from))
    words = stage("words", lambda: V.word_ids(V.kept_words(clean, language)))
    ids = stage("words-ids", lambda: V.ids_of_spellings(clean, words))
    if last < STAGES.index("sentences"):
        return None
    sentences = stage("sentences", lambda: N.encoded(said, ids))
    if last < STAGES.index("grams"):
        return None
    grams = stage("grams", lambda: N.counts(sentences, how.order))
    if last < STAGES.index("model"):
        return None
    if STAGES.index(since) <= STAGES.index("model"):
        d = N.discounts(grams, how.discount_low, how.discount_high, how.discount)
        if watch:
            watch("unpruned", grams)
        left = pruned(grams, how)
        if how.pruning in ("difference", "raw_difference"):
            d = N.discounts(left, how.discount_low, how.discount_high, how.discount)
        elif how.pruning != "none":
            # What counts take away has no part in the contexts' totals; discounts are those of all n-grams.
            pass
        d = durable(d)
        freq, of = N.modelled(left, d, how.order)
        of = stage("model-contexts", lambda: of)
        model.save(words, freq.drop("bow"), of, d, f"{at}/model", overwrite, dealt=True)
    return model.load(spark, f"{at}/model")


def load(spark: SparkSession, at: str) -> model.Model:
    return model.load(spark, f"{at}/model")
