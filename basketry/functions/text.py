"""String expressions shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\x0B\f]+"


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one space; none is left at either end."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def trimmed(text: Column) -> Column:
    """White space removed at both ends only."""
    return F.regexp_replace(text, r"^[ \t\n\r\x0B\f]+|[ \t\n\r\x0B\f]+$", "")


def letters_only(text: Column) -> Column:
    """H1: lower case, ASCII letters only, one-letter words dropped."""
    letters = F.regexp_replace(collapse_spaces(F.lower(text)), r"[^a-z ]", " ")
    return collapse_spaces(F.regexp_replace(letters, r"\b[a-z]\b", " "))


def embedding_text(text: Column) -> Column:
    """H9: keep word characters and basic punctuation; empty texts get a placeholder."""
    kept = F.regexp_replace(collapse_spaces(text), r"[^\p{L}\p{M}\p{N}_ \-.,!?]", " ")
    clean = collapse_spaces(kept)
    return F.when(F.length(clean) == 0, F.lit("no description available")).otherwise(clean)
