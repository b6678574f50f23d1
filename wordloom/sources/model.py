"""Models as Parquet: the vocabulary, n-grams with their shares, contexts with their back-off weights; users' files."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.operators import ngrams as N
from wordloom.operators.vocabulary import changed, overlaid, predictable, prefixes, tuned
from wordloom.session import durable, small


@dataclass
class Model:
    """A trained model's tables. They are never changed: a user's words are put over them, dynamic counts beside them.

    words (word_id, word, cnt, tuning), grams (n, w1.., cnt, prob), contexts (n, c1.., total, children, d, bow),
    discounts (n, n1, n2, d), heads (prefix, word_id, word): what words begin with.
    """

    words: DataFrame
    grams: DataFrame
    contexts: DataFrame
    discounts: DataFrame
    heads: DataFrame
    order: int
    dictionary_id: str

    def valid(self, least_uses: int = 10) -> DataFrame:
        return self.words.where(predictable(least_uses))

    def singles(self) -> DataFrame:
        """The n-grams of one word."""
        return self.grams.where("n = 1")

    def around(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of grams and contexts what the contexts asked for, (c1..), and their ends have."""
        return N.about(self.grams, asked, self.order), N.about(self.contexts, asked, self.order)


@dataclass
class Counted(Model):
    """A model whose grams have counts alone and which has no contexts: shares and weights are found for the
    contexts that are asked for. They are those of a whole model, as each comes of a context's own n-grams."""

    one: DataFrame

    def singles(self) -> DataFrame:
        return self.one

    def around(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = N.about(self.grams, asked, self.order)
        of = durable(N.contexts(own, self.discounts, self.order))
        return N.probabilities(own, small(of, N.ASKED_ROWS), self.order), of


class DictionaryMismatch(ValueError):
    """A user's file belongs to another vocabulary."""


PARTS = ("grams", "contexts", "discounts", "heads")


def save(words: DataFrame, grams: DataFrame, contexts: DataFrame, discounts: DataFrame, path: str, overwrite: bool = False, dealt: bool = False) -> None:
    """Writes a model's tables; n-grams and contexts by order, sorted, so that a look-up reads few row groups.

    dealt: both come as `modelled` gives them, by the first two words of a context, and aren't shuffled or sorted again.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    own = tuned(words).withColumn("dictionary_id", F.lit(uuid.uuid4().hex))
    own.write.mode(mode).parquet(f"{path}/words")
    prefixes(words).write.mode(mode).parquet(f"{path}/heads")
    for name, df in (("grams", grams), ("contexts", contexts)):
        cols = [c for c in df.columns if c[0] in "wc" and c[1:].isdigit()]
        df = df if dealt else df.repartition("n", *cols[:2]).sortWithinPartitions("n", *cols)
        df.write.mode(mode).partitionBy("n").option("compression", "zstd").parquet(f"{path}/{name}")
    discounts.write.mode(mode).parquet(f"{path}/discounts")


def load(spark: SparkSession, path: str) -> Model:
    """A saved model. Orders that a query doesn't use are not read."""
    words = spark.read.parquet(f"{path}/words")
    first = words.select("dictionary_id").first()
    parts = {name: spark.read.parquet(f"{path}/{name}") for name in PARTS}
    order = sum(c[0] == "w" and c[1:].isdigit() for c in parts["grams"].columns)
    return Model(words.drop("dictionary_id"), parts["grams"], parts["contexts"], parts["discounts"], parts["heads"], order, first[0] if first else "")


def counted(words: DataFrame, grams: DataFrame, d: DataFrame | None = None) -> Counted:
    """A model of words (word_id, word, cnt) and of n-grams that were counted and not pruned; d: discounts, found if not given."""
    order = sum(c[0] == "w" and c[1:].isdigit() for c in grams.columns)
    d, one = durable(N.discounts(grams)) if d is None else d, grams.where("n = 1")
    one = durable(N.probabilities(one, N.contexts(one, d, order), order))
    return Counted(tuned(words), grams, None, d, durable(prefixes(words)), order, uuid.uuid4().hex, one)


def save_user(words: DataFrame, dictionary_id: str, path: str, overwrite: bool = False) -> None:
    """A user's words and changed tunings, with the id of the vocabulary that they belong to."""
    changed(words).withColumn("dictionary_id", F.lit(dictionary_id)).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def with_user(model: Model, user: DataFrame) -> Model:
    """The model with a user's words over its own. A file of another vocabulary raises DictionaryMismatch."""
    if "dictionary_id" in user.columns:
        other = user.where(F.col("dictionary_id") != model.dictionary_id).first()
        if other:
            raise DictionaryMismatch(f"the file is of vocabulary {other.dictionary_id}, the model's is {model.dictionary_id}")
        user = user.drop("dictionary_id")
    words = durable(overlaid(model.words, user))
    return replace(model, words=words, heads=durable(prefixes(words)))


def save_dynamic(grams: DataFrame, path: str, overwrite: bool = False) -> None:
    """Counts of what a user wrote; shares are found anew when they are read."""
    grams.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("n").parquet(path)


def save_meanings(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """(word_id, vec, density)."""
    rows.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
