"""Tokens and word n-grams as array expressions."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Runs of two or more word characters, any script.
WORD = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column, stop_words: Sequence[str]) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def ngrams(words: Column) -> Column:
    """The words and the pairs of neighbouring words."""
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)
