"""Column helpers on text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lodestone import config

# Letters, digits and underscore of any script stay together as one term.
TERM_SEPARATOR = r"[^\p{L}\p{N}_]+"

_BLANK = r"\A[\s\x1c-\x1f\x85\p{Z}]*\z"


def tokens(text: Column) -> Column:
    """Lower-cased terms of a text in order, repeats kept."""
    return F.array_remove(F.split(F.lower(text), TERM_SEPARATOR), "")


def is_blank(text: Column) -> Column:
    """Empty or whitespace only, counting Unicode spaces."""
    return text.rlike(_BLANK)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(config.WHITESPACE))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(config.WHITESPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(config.WHITESPACE))


def fold_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def count_of(text: Column, piece: str) -> Column:
    """How often a piece occurs in a text, without overlaps."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))
    return (removed / F.lit(len(piece))).cast("int")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
