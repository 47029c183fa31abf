"""Text expressions: words, word chunks and column-like tokens. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.fixed import CHUNK_WORDS, IDENTIFIER, WHITESPACE


def words(text: Column) -> Column:
    """Whitespace-separated words of a text, without empty ones."""
    return F.filter(F.split(text, WHITESPACE), lambda w: w != "")


def chunks(text: Column, size: int = CHUNK_WORDS) -> Column:
    """Runs of ``size`` words joined by one space; an empty array for empty or null text."""

    def runs(tokens: Column) -> Column:
        last = F.greatest(F.size(tokens) - 1, F.lit(0))
        starts = F.filter(
            F.sequence(F.lit(0), last, F.lit(size)), lambda start: start < F.size(tokens)
        )
        return F.transform(
            starts, lambda start: F.array_join(F.slice(tokens, start + 1, F.lit(size)), " ")
        )

    # A transform over a one-element array binds the words to a name, so that the text is
    # split once and not again for every chunk.
    return F.transform(F.array(words(F.coalesce(text, F.lit("")))), runs)[0]


def identifiers(text: Column) -> Column:
    """Every column-like token of a text, repeats included, in order."""
    return F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
