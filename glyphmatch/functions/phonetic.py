"""Soundex codes and the test for printable ASCII, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The class of each lower-case letter; a: vowels and y, h: silent.
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
LETTER_CLASSES = "a123a12ha22455a12623a1h2a2"


def phonetic(text: Column | str, method: str = "soundex", use_bytes: bool = False) -> Column:
    """Soundex code of four characters. Letters of a class that follow each other, with silent ones between, count once; vowels part them.

    Characters outside printable ASCII have the class `?`. Empty gives 0000, null null.
    use_bytes: each byte of the UTF-8 text counts as a character, so one outside ASCII gives as many marks as it has bytes.
    """
    if method != "soundex":
        raise ValueError("the only phonetic method is soundex")
    text = F.col(text) if isinstance(text, str) else text
    if use_bytes:
        text = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    ascii_ = F.regexp_replace(text, r"(?s)[^ -~]", "?")
    lower = F.translate(ascii_, _LETTERS.upper(), _LETTERS)
    # A question mark in the text is a mark like others; what stands for other characters is told apart first.
    classes = F.translate(F.regexp_replace(F.translate(F.regexp_replace(F.translate(text, "?", "!"), r"(?s)[^ -~]", "?"), _LETTERS.upper(), _LETTERS), r"[^a-z?]", "h"), _LETTERS, LETTER_CLASSES)
    head = F.translate(F.substring(classes, 1, 1), "h", "a")
    tail = F.regexp_replace(F.substr(classes, F.lit(2)), "h", "")
    runs = F.regexp_replace(F.concat(head, tail), r"(.)\1+", "$1")
    digits = F.substring(F.regexp_replace(F.substr(runs, F.lit(2)), "a", ""), 1, 3)
    first = F.substring(text, 1, 1)
    first = F.when(F.substring(lower, 1, 1).rlike("[a-z]"), F.upper(F.substring(ascii_, 1, 1))).otherwise(first)
    return F.when(text.isNull(), F.lit(None)).when(text == "", "0000").otherwise(F.concat(first, F.rpad(digits, 3, "0")))


def printable_ascii(text: Column | str) -> Column:
    """True where all characters are printable ASCII; also for null and empty texts."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(~text.rlike(r"[^ -~]"), F.lit(True))
