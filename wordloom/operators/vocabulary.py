"""The vocabulary: which spelling a counted word is kept under, which words are unknown, word ids, users' words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.strings import has_upper, is_capitalized, uncapitalize
from wordloom.language import FIRST_WORD, FRENCH, TAGS, LanguageSpec
from wordloom.session import durable, small

#: Share of lower-case use from which a capitalised word is lowered; lexicon frequency above which the
#: lexicon's spelling replaces a word; counts above which a word is known, or needs no lexicon.
LOWERED_FROM, RESPELLED_FROM, UNKNOWN_TO, VALID_FROM = 0.35, 1e-8, 0, 20
#: A user's word is valid once used this often.
USES = 10


def counted(spoken: DataFrame) -> DataFrame:
    """(word, cnt) of the plain words of sentences; classes of terms don't count."""
    words = spoken.select(F.explode("words").alias("word")).where(~F.startswith("word", F.lit("<")))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def case_stats(counts: DataFrame) -> DataFrame:
    """(word, upper, lower, share): capitalised words and the share of their lower-case spelling."""
    low = counts.select(F.col("word").alias("low"), F.col("cnt").alias("lower"))
    up = counts.where(is_capitalized(F.col("word"))).withColumn("low", F.lower("word"))
    return up.join(low, "low").select("word", F.col("cnt").alias("upper"), "lower", (F.col("lower") / (F.col("lower") + F.col("cnt"))).alias("share"))


def cleaned(counts: DataFrame, lexicon: DataFrame, lowered_from: float = LOWERED_FROM, respelled_from: float = RESPELLED_FROM, unknown_to: int = UNKNOWN_TO, valid_from: int = VALID_FROM) -> DataFrame:
    """(word, cnt, kept): the spelling each counted word is kept under; null where it is unknown.

    counts: (word, cnt); lexicon: (word, freq), one row per word.
    """
    lowered = case_stats(counts).where(F.col("share") >= lowered_from).select("word", F.lower("word").alias("to"), F.col("lower").alias("to_cnt"))
    rows = counts.join(lowered, "word", "left").select("word", "cnt", F.coalesce("to", "word").alias("form"), F.coalesce("to_cnt", "cnt").alias("form_cnt"))
    rows = rows.withColumn("first_low", uncapitalize(F.col("form"))).withColumn("all_low", F.lower("form"))
    for spelling in ("form", "first_low", "all_low"):
        rows = rows.join(lexicon.select(F.col("word").alias(spelling), F.col("freq").alias(f"f_{spelling}")), spelling, "left")

    def respelled(spelling: str) -> Column:
        return F.when(F.col(f"f_{spelling}") > respelled_from, F.col(spelling)).otherwise(F.col("form"))

    known = (
        F.when(F.col("f_form").isNotNull() | (F.col("form_cnt") > valid_from), F.col("form"))
        .when(is_capitalized(F.col("form")) & (F.col("f_first_low") > 0), respelled("first_low"))
        .when((F.col("form") != F.col("all_low")) & (F.col("f_all_low") > 0), respelled("all_low"))
    )
    return rows.select("word", "cnt", F.when(F.col("form_cnt") > unknown_to, known).alias("kept"))


def admitted(word: Column, language: LanguageSpec = FRENCH) -> Column:
    """Whether a known word enters the vocabulary: words of one letter only where the language has them."""
    return (F.length(word) > 1) | F.lower(word).isin(*language.one_letter_words)


def kept_words(clean: DataFrame, language: LanguageSpec = FRENCH) -> DataFrame:
    """(word, cnt) of the vocabulary: kept spellings with the counts of all words kept under them."""
    kept = clean.where(F.col("kept").isNotNull() & admitted(F.col("kept"), language))
    return kept.groupBy(F.col("kept").alias("word")).agg(F.sum("cnt").alias("cnt"))


def word_ids(counts: DataFrame) -> DataFrame:
    """(word, cnt, word_id): ids from FIRST_WORD on by falling count, then by word.

    Rows are dealt by ranges and numbered within each; the ranges' sizes, a row for each, give what to add.
    """
    ordered = counts.select("word", "cnt", (-F.col("cnt")).alias("less")).repartitionByRange("less", "word").sortWithinPartitions("less", "word")
    placed = durable(ordered.select("word", "cnt", F.monotonically_increasing_id().alias("place")))
    part, within = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each range
    before, shift = 0, []
    for r in sorted(sizes, key=lambda r: r.part):
        shift.append((r.part, before))
        before += r.n
    shifts = counts.sparkSession.createDataFrame(shift, "part long, before long")
    return placed.withColumn("part", part).join(F.broadcast(shifts), "part").select("word", "cnt", (within + F.col("before") + FIRST_WORD).cast("int").alias("word_id"))


def tag_ids(spark) -> DataFrame:
    """(word, word_id) of the tags and the classes of terms, as sentences have them."""
    return spark.createDataFrame(list(TAGS.items()), "word string, word_id int")


def ids_of_spellings(clean: DataFrame, words: DataFrame) -> DataFrame:
    """(word, word_id): what each counted spelling, and each class of terms, counts as. Unknown words have no row."""
    known = clean.where("kept is not null").select("word", "kept").join(words.select(F.col("word").alias("kept"), "word_id"), "kept")
    return known.select("word", "word_id").unionByName(tag_ids(clean.sparkSession))


def with_ids(rows: DataFrame, words: DataFrame, text: str = "word") -> DataFrame:
    """rows with word_id: of the text as it is, else of its lower-case spelling, else null."""
    exact = words.select(F.col("word").alias(text), F.col("word_id").alias("own_id"))
    lower = words.select(F.col("word").alias("lowered"), F.col("word_id").alias("lower_id"))
    found = rows.withColumn("lowered", F.when(has_upper(F.col(text)), F.lower(text))).join(small(exact), text, "left").join(small(lower), "lowered", "left")
    return found.withColumn("word_id", F.coalesce("own_id", "lower_id")).drop("lowered", "own_id", "lower_id")


def texts_of(ids: DataFrame, words: DataFrame, column: str = "word_id") -> DataFrame:
    """ids with `word`, null where no word has the id."""
    return ids.join(small(words.select(F.col("word_id").alias(column), "word")), column, "left")


#: What is known of a word beside its text; the columns of a word table.
TUNING = {"prob_factor": "1.0D", "force_valid": "false", "force_invalid": "false", "user_word": "false", "use_count": "0L", "last_use": "cast(null as timestamp)", "modified": "false"}


def tuned(words: DataFrame) -> DataFrame:
    """words with every column of TUNING, at its default where it is missing."""
    return reduce(lambda df, c: df if c[0] in df.columns else df.withColumn(c[0], F.expr(c[1])), TUNING.items(), words)


def predictable(least_uses: int = USES) -> Column:
    """Whether a word of a tuned table may be predicted; tags and classes have no row there."""
    used = F.col("force_valid") | (F.col("use_count") >= least_uses)
    return ~F.col("force_invalid") & (~F.col("user_word") | used)


def changed(words: DataFrame) -> DataFrame:
    """The rows of a tuned table that a user's dictionary holds: users' words and words whose tuning was changed."""
    return tuned(words).where("user_word or modified")


def overlaid(words: DataFrame, user: DataFrame) -> DataFrame:
    """A tuned word table with a user's rows put over those of the same id, and added where there is none."""
    base, own = tuned(words), tuned(user)
    names = [c for c in base.columns if c != "word_id"]
    joined = base.alias("b").join(own.select("word_id", *[F.col(c).alias(f"own_{c}") if c in own.columns else F.lit(None).alias(f"own_{c}") for c in names]), "word_id", "full_outer")
    return joined.select("word_id", *[F.coalesce(f"own_{c}", c).alias(c) for c in names])


def user_words(words: DataFrame, vocabulary: DataFrame, uses: int = USES) -> DataFrame:
    """(user, word, cnt, valid): words of a user, longer than two characters, that the vocabulary lacks.

    words: (user, word), with `at`, a time, where last_use is wanted.
    """
    last = [F.max("at").alias("last_use")] if "at" in words.columns else []
    own = words.where(F.length("word") > 2).groupBy("user", "word").agg(F.count(F.lit(1)).alias("cnt"), *last)
    return own.join(vocabulary.select("word"), "word", "left_anti").withColumn("valid", F.col("cnt") >= uses)


def prefixes(words: DataFrame, least: int = 1) -> DataFrame:
    """(prefix, word_id, word): a row for each beginning of each word, so that a typed prefix is an equi-join."""
    ends = F.sequence(F.lit(least), F.length("word"))
    return words.where(F.length("word") >= least).select(F.explode(ends).alias("n"), "word_id", "word").select(F.left("word", F.col("n")).alias("prefix"), "word_id", "word")
