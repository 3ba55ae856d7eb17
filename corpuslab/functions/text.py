"""Column functions: normalisation, tokens and language signals. All but `composed` stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fixed import LEAKAGE_WORDS, QUECHUA_ENDINGS, QUECHUA_SIGNAL, SPACE, SPANISH_SIGNAL

_ALPHANUMERIC = "([A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]+)"


def words_of(*items: str) -> Column:
    return F.array(*(F.lit(i) for i in items))


def normalize_space(c: Column) -> Column:
    """White space of any kind to one space, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE + "+", " "))


def normalize_pair_text(c: Column) -> Column:
    """normalize_space, then no space before ,.;:?! and none after ¿¡."""
    tight = F.regexp_replace(normalize_space(c), SPACE + r"+([,.;:?!])", "$1")
    return F.regexp_replace(tight, "([¿¡])" + SPACE + "+", "$1")


def pair_words(c: Column) -> Column:
    """Lower-case tokens of word characters and hyphens."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_-]+)"), 1), F.lower)


def metric_tokens(c: Column) -> Column:
    """Lower-case alphanumeric tokens of the metric functions."""
    return F.regexp_extract_all(F.lower(normalize_space(c)), F.lit(_ALPHANUMERIC), 1)


def letters(c: Column) -> Column:
    """Distinct letters in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L})"), 1))


def share_of_larger(a: Column, b: Column) -> Column:
    """|a & b| / max(|a|, |b|) of two arrays as sets; 0 if one is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.greatest(F.size(x), F.size(y)))


def jaccard(a: Column, b: Column) -> Column:
    """|a & b| / |a | b| of two arrays as sets; 1 if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.when((F.size(x) == 0) & (F.size(y) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def has_spanish_signal(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, words_of(*SPANISH_SIGNAL))


def has_quechua_signal(tokens: Column) -> Column:
    return F.arrays_overlap(tokens, words_of(*QUECHUA_SIGNAL)) | F.exists(tokens, lambda t: t.rlike("(" + "|".join(QUECHUA_ENDINGS) + ")$"))


def content_tokens(tokens: Column, least: int = 3) -> Column:
    """Distinct tokens of `least` letters or more that are no leakage words."""
    return F.array_distinct(F.filter(tokens, lambda t: (F.char_length(t) >= least) & ~F.array_contains(words_of(*LEAKAGE_WORDS), t)))


def ngrams(tokens: Column, n: int) -> Column:
    """Joined windows of n tokens; none if there are fewer."""
    count = F.size(tokens) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))


_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸĀĂĄĆĈĊČĎĒĔĖĘĚĜĞĠĢĤĨĪĬĮİĴĶĹĻĽŃŅŇŌŎŐŔŖŘŚŜŞŠŢŤŨŪŬŮŰŲŴŶŹŻŽ"


def without_accents(c: Column) -> Column:
    """Latin letters without their marks, composed or combining."""
    bare = "".join(unicodedata.normalize("NFKD", x)[0] for x in _MARKED)
    return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), _MARKED, bare), r"[\x{300}-\x{36F}]", "")


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Unicode normal form C; built-in functions have none. A null stays null."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def prompt_tokens(c: Column) -> Column:
    """Words of three characters or more as first written, each once whatever its case."""
    words = F.regexp_extract_all(c, F.lit("([A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]{3,})"), 1)
    lower = F.transform(words, lambda w: F.lower(w))
    return F.filter(F.transform(words, lambda w, i: F.when(F.array_position(lower, F.lower(w)) == i + 1, w)), lambda w: w.isNotNull())


def canonical_key(c: Column) -> Column:
    """normalize_space in lower case without one full stop or comma at its end."""
    return F.regexp_replace(F.lower(normalize_space(c)), "[.,]$", "")
