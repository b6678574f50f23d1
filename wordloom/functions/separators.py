"""Separator classes: whether one ends a sentence, its own character and the aliases that are read as it."""

from __future__ import annotations

# Fixed values.
SEPARATORS = [
    (False, " ", "\u00a0\u200a\u2009\u202f"),
    (True, "!", ""),
    (True, "?", ""),
    (True, ".", "…_"),
    (True, "\n", "\r"),
    (False, "\t", ""),
    (False, ",", ""),
    (False, "'", "’´‘ˈ′"),
    (False, "(", ""),
    (False, ")", ""),
    (False, ";", ""),
    (False, '"', "«»“”″"),
    (False, "=", ""),
    (False, "[", ""),
    (False, "]", ""),
    (False, "<", ">"),
    (False, "/", "⁄"),
    (False, "\\", ""),
    (False, "#", ""),
    (False, ":", ""),
    (False, "€", ""),
    (False, "%", "‰"),
    (False, "-", "\u00ad\u2212\u2014\u2010\u2013"),
    (False, "|", ""),
    (False, "+", "~°$*¡}¿&@•×{→"),
]

ALIASES = "".join(alias for *_, alias in SEPARATORS)
OFFICIALS = "".join(own * len(alias) for _, own, alias in SEPARATORS)
ALL = "".join(own for _, own, _ in SEPARATORS)
ENDS = "".join(own for ends, own, _ in SEPARATORS if ends)


def char_class(chars: str) -> str:
    """The characters as the inside of a regular expression's class, for Java and RE2 alike."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in chars)


SEP = char_class(ALL)
END = char_class(ENDS)
