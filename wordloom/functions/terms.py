"""Texts as terms: canonical separators, ordered matchers as one regular expression, sentences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.language import EDGE, FRENCH, MONTHS, Matcher

from .separators import ALIASES, ALL, END, ENDS, OFFICIALS, SEP, char_class
from .strings import is_capitalized

#: The matchers of FRENCH.ngram_matchers in one expression. Of the alternatives only those are tried that
#: can begin with a character, so that they need not stand in the order of the matchers: separators,
#: letters, digits, anything else.
NGRAM_PATTERN = "|".join(
    [
        f"[{SEP}]",
        rf"(?i:aujourd'hui){EDGE}",
        rf"\p{{Lu}}(?:\.\p{{Lu}}{EDGE})++\.?",
        rf"\p{{L}}++(?:'|(?:-\p{{L}}++{EDGE})++(?!-)|{EDGE})",
        rf"\d++[,.]\d++(?: ?%|{EDGE})",
        rf"\d++(?: ?%|{EDGE})",
        f"[^{SEP}]+",
    ]
)

#: The same terms, in one group each but for separators that end no sentence, and without a percentage's space.
_TOLD = "|".join(
    [
        f"([{END}])",
        f"[{char_class(''.join(c for c in ALL if c not in ENDS))}]",
        rf"((?i:aujourd'hui){EDGE}",
        rf"\p{{Lu}}(?:\.\p{{Lu}}{EDGE})++\.?",
        rf"\p{{L}}++(?:'|(?:-\p{{L}}++{EDGE})++(?!-)|{EDGE}))",
        rf"(\d++(?:[,.]\d++)?+)(?: ?(%)|{EDGE})",
        rf"(\d++)(?: ?(%)|{EDGE})",
        f"([^{SEP}]+)",
    ]
)


def pattern_of(matchers: tuple[Matcher, ...]) -> str:
    """Any matchers, in their order, as one expression."""
    return "|".join([*(m.pattern for m in matchers), f"[^{SEP}]+", f"[{SEP}]"])


def canonical(text: Column) -> Column:
    """Lines end in a newline, none after the last; byte order marks at line starts go; aliases as their class."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"\n\z", ""), r"(?m)^\x{feff}", "")
    return F.translate(text, ALIASES, OFFICIALS)


def terms(text: Column) -> Column:
    """The terms of a text in order, separators included."""
    return F.regexp_extract_all(canonical(text), F.lit(NGRAM_PATTERN), F.lit(0))


def kind(term: Column) -> Column:
    """SEPARATOR, WORD or the class of a term, from its shape: only matchers leave separators within a term."""
    digit = (term >= "0") & (term < ":")
    return (
        F.when(F.contains(F.lit(ALL), term), "SEPARATOR")
        .when(F.endswith(term, F.lit("%")), "PERCENT")
        .when(F.contains(term, F.lit(".")) | F.contains(term, F.lit(",")), F.when(digit, "DECIMAL").otherwise("ACRONYM"))
        .when(digit & F.regexp_like(term, F.lit(r"^\d+\z")), "INTEGER")
        .otherwise("WORD")
    )


def kind_by(term: Column, matchers: tuple[Matcher, ...]) -> Column:
    """The class of a term by the first of any matchers that it is."""
    out = F.when(F.regexp_like(term, F.lit(rf"^[{SEP}]\z")), "SEPARATOR")
    return reduce(lambda c, m: c.when(F.regexp_like(term, F.lit(rf"^(?:{m.pattern})\z")), m.kind), matchers, out).otherwise("WORD")


def _year(text: Column) -> Column:
    year = text.cast("int")
    return F.lpad(F.when(year <= 20, year + 2000).when(year <= 99, year + 1900).otherwise(year).cast("string"), 4, "0")


def _month(text: Column) -> Column:
    out = F.lower(text)
    for name, spellings in MONTHS.items():
        for other in spellings.split("|")[1:]:
            out = F.when(out == other, name).otherwise(out)
    return out


def value(term: Column, of: Column) -> Column:
    """What a term stands for: percentages without space and with a decimal comma, acronyms without points,
    dates as dd/MM/yyyy or with the month written out and four digits of the year, week days in lower case."""
    digits = F.split(term, r"[/\-.]")
    part = F.split(term, " ")
    day = lambda text: F.regexp_replace(text, "^0(?=.)", "")
    two = lambda text: F.lpad(text, 2, "0")
    return (
        F.when(of == "WORD", term)
        .when(of == "SEPARATOR", term)
        .when(of == "PERCENT", F.replace(F.replace(term, F.lit(" "), F.lit("")), F.lit("."), F.lit(",")))
        .when(of == "DECIMAL", F.replace(term, F.lit("."), F.lit(",")))
        .when(of == "ACRONYM", F.replace(term, F.lit("."), F.lit("")))
        .when(of == "DATE_FULL_DIGIT", F.concat_ws("/", two(digits[0]), two(digits[1]), _year(digits[2])))
        .when(of == "DATE_FULL_TEXT", F.concat_ws(" ", day(part[0]), _month(part[1]), _year(part[2])))
        .when(of == "DATE_MONTH_YEAR", F.concat_ws(" ", _month(part[0]), _year(part[1])))
        .when(of == "DATE_DAY_MONTH", F.concat_ws(" ", day(part[0]), _month(part[1])))
        .when(of == "DATE_WEEK_DAY", F.lower(term))
        .otherwise(term)
    )


def classified(text: Column, matchers: tuple[Matcher, ...] = FRENCH.ngram_matchers) -> Column:
    """The terms of a text as (k, t): class and term. Each term's class is found once."""
    if matchers == FRENCH.ngram_matchers:
        return F.transform(terms(text), lambda t: F.struct(kind(t).alias("k"), t.alias("t")))
    found = F.regexp_extract_all(canonical(text), F.lit(pattern_of(matchers)), F.lit(0))
    return F.transform(found, lambda t: F.struct(kind_by(t, matchers).alias("k"), t.alias("t")))


def with_terms(rows: DataFrame, matchers: tuple[Matcher, ...] = FRENCH.ngram_matchers) -> DataFrame:
    """rows with `m`, the classified terms, in place of text.

    m comes out of an explode of one element, so that it is found once for a text: as a plain column it
    would be put into the lambdas that use it and found again for each of their elements.
    """
    return rows.select(*[c for c in rows.columns if c != "text"], F.explode(F.array(classified(F.col("text"), matchers))).alias("m"))


def is_end(term: Column) -> Column:
    """Whether a classified term ends a sentence."""
    return (term["k"] == "SEPARATOR") & F.contains(F.lit(ENDS), term["t"])


def said(term: Column) -> Column:
    """A classified term as an element of a sentence: a word, or its class in brackets, which no word has."""
    return F.when(term["k"] == "WORD", term["t"]).otherwise(F.concat(F.lit("<"), term["k"], F.lit(">")))


def sentences(docs: DataFrame, matchers: tuple[Matcher, ...] = FRENCH.ngram_matchers, ended: bool = False) -> DataFrame:
    """docs' other columns, n_terms of the text, and `said`, the sentences as arrays without separators; without
    the last one, which is still being written, if only ended ones are wanted.

    Sentences are slices between the places of the ends; no mark is put into the text. Narrow.
    """
    other = [c for c in docs.columns if c != "text"]
    rows = with_terms(docs, matchers)
    ends = F.filter(F.transform("m", lambda x, i: F.when(is_end(x), i)), lambda i: i.isNotNull())
    rows = rows.select(*other, "m", ends.alias("ends"))

    def cut(a: Column, b: Column) -> Column:
        return F.transform(F.filter(F.slice("m", a + 2, b - a - 1), lambda x: x["k"] != "SEPARATOR"), said)

    every = F.zip_with(F.concat(F.array(F.lit(-1)), "ends"), F.concat("ends", F.array(F.size("m"))), cut)
    every = F.slice(every, F.lit(1), F.size("ends")) if ended else every
    return rows.select(*other, F.size("m").alias("n_terms"), F.filter(every, lambda s: F.size(s) > 0).alias("said"))


def normal(sentence: Column) -> Column:
    """A sentence whose first word, where capitalised, is in lower case."""
    first = F.element_at(sentence, 1)
    low = F.when(is_capitalized(first), F.lower(first)).otherwise(first)
    return F.concat(F.array(low), F.slice(sentence, F.lit(2), F.size(sentence)))


def told(text: Column) -> Column:
    """The terms of FRENCH.ngram_matchers with a space after each: words and ends as they are, classes in
    brackets, nothing for other separators. A word has no space, and a point only beside a space."""
    out = F.regexp_replace(canonical(text), _TOLD, "$1$2$3$4$5$6$7 ")
    out = F.regexp_replace(F.regexp_replace(out, r"[\d.,]+%", "<PERCENT>"), r"\d+[.,]\d+", "<DECIMAL>")
    return F.regexp_replace(F.regexp_replace(out, r"\p{Lu}(?:\.\p{Lu})+\.?", "<ACRONYM>"), r"(?<![^ ])\d++ ", "<INTEGER> ")


def _spoken(docs: DataFrame) -> DataFrame:
    """spoken by FRENCH.ngram_matchers: whole texts by regular expressions, with no expression for each term."""
    other = [c for c in docs.columns if c != "text"]
    rows = docs.select(*other, F.explode(F.array(told(F.col("text")))).alias("m"))
    lines = F.split(F.btrim(F.translate("m", ENDS, "\n" * len(ENDS)), F.lit(" \n")), r"\n[ \n]*")
    rows = rows.select(*other, (F.length("m") - F.length(F.replace("m", F.lit(" "), F.lit("")))).alias("n_terms"), lines.alias("lines"))
    rows = rows.select(*other, "n_terms", F.posexplode("lines").alias("sent", "s")).where("s <> ''")
    first = F.substring_index("s", " ", 1)
    low = F.when(is_capitalized(F.col("s")), F.concat(F.lower(first), F.substring("s", F.length(first) + 1, F.length("s")))).otherwise(F.col("s"))
    return rows.select(*other, "n_terms", "sent", F.split(F.rtrim(low), " +").alias("words"))


def spoken(docs: DataFrame, matchers: tuple[Matcher, ...] = FRENCH.ngram_matchers, ended: bool = False) -> DataFrame:
    """docs' other columns, n_terms, sent and words: a row for each sentence, numbered within its text. Narrow."""
    if matchers == FRENCH.ngram_matchers and not ended:
        return _spoken(docs)
    rows = sentences(docs, matchers, ended)
    other = [c for c in rows.columns if c != "said"]
    return rows.select(*other, F.posexplode("said").alias("sent", "s")).select(*other, "sent", normal(F.col("s")).alias("words"))
