"""Word columns shared by the operators that run on built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Separators of plain words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
#: Everything below 128 that is neither a digit nor a lower-case letter.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(column: Column | str) -> Column:
    """The text, null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else: other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def split_trimmed(trimmed: Column, gap: str) -> Column:
    """Words between runs of ``gap`` in a text that neither starts nor ends with one; empty text has none."""
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, gap))


def blank_words(text: Column) -> Column:
    """Maximal runs without a blank."""
    return split_trimmed(F.trim(text, F.lit(BLANKS)), r"[\x20\x09-\x0D]+")


def marked_words(text: Column) -> Column:
    """An empty first element, then the lower-cased runs of digits, letters a-z and characters above 127."""
    spaced = F.ltrim(F.regexp_replace(lower_ascii(text), NON_WORD, " "))
    return F.split(F.rtrim(F.concat(F.lit(" "), spaced)), " ")
