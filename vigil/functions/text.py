"""Text expressions: article text, sentences, tokens, patterns, keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence boundary: whitespace preceded by . ! or ?
SENTENCE_SPLIT = r"(?<=[.!?])\s+"
# Between words: anything but letters, marks, digits and _ of any script
TOKEN_SPLIT = r"[^\p{L}\p{M}\p{N}_]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def article_text(title, description) -> Column:
    """``title description``; a missing part contributes nothing."""
    return F.concat_ws(" ", _c(title), _c(description))


def sentences(text) -> Column:
    """Array of sentences (split after terminal punctuation)."""
    return F.split(_c(text), SENTENCE_SPLIT)


def tokens(text) -> Column:
    """Lower-case word tokens; positions are array indices."""
    return F.split(F.lower(_c(text)), TOKEN_SPLIT)


def first_capture(text, patterns: list[str]) -> Column:
    """Array of the first group-1 capture of every pattern (case-insensitive),
    without white space at its ends; ``''`` where a pattern does not match."""
    return F.array(*[F.regexp_replace(F.regexp_extract(_c(text), "(?i)" + p, 1), r"^\s+|\s+$", "")
                     for p in patterns])


def normalise_name(name) -> Column:
    """Gazetteer key: lower case, word tokens joined by single spaces; null for
    a name without words."""
    return F.nullif(F.array_join(F.array_remove(tokens(name), ""), " "), F.lit(""))
