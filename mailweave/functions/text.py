"""Text functions as Column -> Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def blank_to_null(col: Column) -> Column:
    """Empty text counts as missing."""
    return F.when(F.length(col) > 0, col)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip(col: Column) -> Column:
    """Without white space at either end, of any kind."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def tokens(col: Column) -> Column:
    """Lower-case word runs, repeated words kept; [] for null."""
    return F.regexp_extract_all(F.lower(text_or_empty(col)), F.lit(WORD), F.lit(0))


def word_count(col: Column) -> Column:
    """Words between white space."""
    return F.size(F.regexp_extract_all(text_or_empty(col), F.lit(r"\S+"), F.lit(0)))


def lines(col: Column) -> Column:
    return F.split(F.regexp_replace(text_or_empty(col), r"\r\n?", "\n"), "\n", -1)


def normalize_subject(col: Column) -> Column:
    """Without reply and forward prefixes, lower-case, single blanks; '' for null."""
    bare = F.regexp_replace(text_or_empty(col), r"(?i)^\s*((re|fw|fwd)\s*:\s*)+", "")
    return strip(F.regexp_replace(F.lower(bare), r"\s+", " "))


def normalize_address(col: Column) -> Column:
    return strip(F.lower(text_or_empty(col)))


def participants(sender: Column, *lists: Column) -> Column:
    """Distinct addresses of a message in the order sender, then each list."""
    listed = [F.coalesce(x, F.array().cast("array<string>")) for x in lists]
    every = F.concat(F.array(normalize_address(sender)), *[F.transform(x, normalize_address) for x in listed])
    return F.array_distinct(F.filter(every, lambda a: a != ""))


def sentences(col: Column) -> Column:
    """Stripped sentences, empty ones left out."""
    return F.filter(F.transform(F.split(text_or_empty(col), SENTENCE_BREAK), strip), lambda s: s != "")


def lower_first(col: Column) -> Column:
    return F.concat(F.lower(F.substring(col, 1, 1)), F.substring(col, 2, 1 << 30))


def squeeze(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"\s+", " "))
