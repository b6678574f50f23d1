"""What depends on a language: one-letter words, names of months and days, matchers, a keyboard, sizes."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.separators import SEP

EDGE = rf"(?=[{SEP}]|\z)"


@dataclass(frozen=True)
class Matcher:
    """A run of tokens that is one term: what it is and how it looks in canonical text."""

    kind: str
    pattern: str


# Spellings of months, as they are written and as they are read.
MONTHS = {
    "janvier": "janvier", "février": "février|fevrier", "mars": "mars", "avril": "avril", "mai": "mai", "juin": "juin", "juillet": "juillet",
    "août": "août|aout", "septembre": "septembre", "octobre": "octobre", "novembre": "novembre", "décembre": "décembre|decembre",
}
DAYS = ["lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi", "dimanche"]
_MONTH = "(?i:" + "|".join(MONTHS.values()) + ")"

PERCENT = Matcher("PERCENT", r"\d++[,.]\d++ ?%|\d++ ?%")
SPECIAL = Matcher("WORD", rf"(?i:aujourd'hui){EDGE}")
DECIMAL = Matcher("DECIMAL", rf"\d++[.,]\d++{EDGE}")
INTEGER = Matcher("INTEGER", rf"\d++{EDGE}")
APOSTROPHE = Matcher("WORD", r"\p{L}++'")
ACRONYM = Matcher("ACRONYM", rf"\p{{Lu}}(?:\.\p{{Lu}}{EDGE})++\.?")
HYPHEN = Matcher("WORD", rf"\p{{L}}++(?:-\p{{L}}++{EDGE})++(?!-)")
DATE_DIGIT = Matcher("DATE_FULL_DIGIT", rf"[0-3]?\d[/\-.][0-1]?\d[/\-.]\d{{2,4}}{EDGE}")
DATE_TEXT = Matcher("DATE_FULL_TEXT", rf"[0-3]?\d {_MONTH} \d{{2,4}}{EDGE}")
DATE_MONTH_YEAR = Matcher("DATE_MONTH_YEAR", rf"{_MONTH} \d{{2,4}}{EDGE}")
DATE_DAY_MONTH = Matcher("DATE_DAY_MONTH", rf"[0-3]?\d {_MONTH}{EDGE}")
DATE_WEEK_DAY = Matcher("DATE_WEEK_DAY", rf"(?i:{'|'.join(DAYS)}){EDGE}")
NAME = Matcher("PROPER_NAME", rf"\p{{Lu}}\p{{L}}++{EDGE}(?: \p{{Lu}}\p{{L}}++{EDGE}){{0,3}}")


@dataclass(frozen=True)
class LanguageSpec:
    """A language's parameters; another language is another instance, with matchers of its own."""

    name: str = "fr"
    one_letter_words: tuple[str, ...] = ("à", "a", "ô", "y")
    #: Matchers in the order in which they are tried, for n-grams and for word meanings.
    ngram_matchers: tuple[Matcher, ...] = (PERCENT, SPECIAL, DECIMAL, INTEGER, APOSTROPHE, ACRONYM, HYPHEN)
    semantic_matchers: tuple[Matcher, ...] = (DATE_DIGIT, DATE_TEXT, DATE_MONTH_YEAR, DATE_DAY_MONTH, PERCENT, SPECIAL, DATE_WEEK_DAY, DECIMAL, INTEGER, APOSTROPHE, ACRONYM, NAME, HYPHEN)
    word_length: int = 6
    vocabulary: int = 110_000
    keyboard: tuple[str, ...] = ("azertyuiop", "qsdfghjklm", "wxcvbn")
    accents: dict[str, str] = field(default_factory=lambda: {"a": "àâ", "e": "éèêë", "i": "îï", "o": "ôö", "u": "ùûü", "c": "ç"})


FRENCH = LanguageSpec()

#: Classes of terms by id, then the tags, then words from FIRST_WORD on.
KINDS = ["PERCENT", "DATE_DAY_MONTH", "DATE_MONTH_YEAR", "DATE_FULL_DIGIT", "DATE_FULL_TEXT", "DATE_WEEK_DAY", "DATE_MONTH", "DATE_HOUR", "MONEY_AMOUNT", "INTEGER", "DECIMAL", "ACRONYM", "PROPER_NAME", "MISC", "CUSTOM"]
START, UNKNOWN, FIRST_WORD = len(KINDS), len(KINDS) + 1, len(KINDS) + 2
#: Stands in a column of word ids where there is no word.
NONE = -1
TAGS = {**{f"<{kind}>": i for i, kind in enumerate(KINDS)}, "<START>": START, "<UNKNOWN>": UNKNOWN}
