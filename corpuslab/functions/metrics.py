"""Column functions: sentence metrics between a hypothesis, a reference and a source, and signals without a reference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import overlap
from . import text as T
from .fixed import CHAT_ARTIFACTS, COPIED_STEPS, ENTITY_STEPS, EXACT_COPY_PENALTY, LEAK_STEPS, LEAKAGE_WORDS, LENGTH_STEPS, LOW_OVERLAP_STEPS


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def token_overlap(hyp: Column, ref: Column) -> Column:
    """Tokens in common, with their multiplicities."""
    return overlap.common(hyp, ref)


def token_f1(hyp: Column, ref: Column) -> Column:
    """Twice the common tokens over all tokens; 0 if a side is empty."""
    return F.when((F.size(hyp) > 0) & (F.size(ref) > 0), 2.0 * token_overlap(hyp, ref) / (F.size(hyp) + F.size(ref))).otherwise(0.0)


def token_precision(hyp: Column, ref: Column) -> Column:
    return F.when((F.size(hyp) > 0) & (F.size(ref) > 0), token_overlap(hyp, ref) / F.size(hyp)).otherwise(0.0)


def n_words(text: Column) -> Column:
    """Words between white space; the empty text has none."""
    norm = T.normalize_space(text)
    return F.when(norm == "", 0).otherwise(F.size(F.split(norm, " ")))


def length_ratio_score(hyp: Column, ref: Column) -> Column:
    ratio = F.greatest(n_words(hyp), F.lit(1)) / F.greatest(n_words(ref), F.lit(1))
    return F.greatest(F.lit(0.0), 1.0 - F.abs(F.log(ratio)))


def overlong_penalty(hyp: Column, ref: Column, most: int | None = None, threshold: float = 0.0) -> Column:
    n, m = n_words(hyp), F.greatest(n_words(ref), F.lit(1))
    parts = [F.lit(0.0)]
    if most:
        parts.append(F.when(n >= most, F.least(F.lit(0.45), 0.25 + 0.02 * (n - most))).otherwise(0.0))
    if threshold:
        parts.append(F.when(n / m >= threshold, F.least(F.lit(0.45), 0.12 * (n / m - threshold + 1.0))).otherwise(0.0))
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(0.7), reduce(lambda a, b: a + b, parts)))


def leakage_penalty(tokens: Column) -> Column:
    hits = F.size(F.filter(tokens, lambda t: F.array_contains(T.words_of(*LEAKAGE_WORDS), t)))
    return F.least(F.lit(0.25), hits / F.greatest(F.lit(4), F.size(tokens)))


def source_copy_ratio(hyp: Column, source: Column) -> Column:
    """Share of the hypothesis' tokens, without leakage words, that the source has."""
    stop = T.words_of(*LEAKAGE_WORDS)
    h, s = (F.filter(t, lambda x: ~F.array_contains(stop, x)) for t in (hyp, source))
    # h has no leakage words, so the whole source can be asked; s would be filtered again for each word
    return F.when((F.size(h) > 0) & (F.size(s) > 0), F.size(F.filter(h, lambda x: F.array_contains(source, x))) / F.size(h)).otherwise(0.0)


def exact_copy(hyp: Column, source: Column) -> Column:
    return (F.coalesce(source, F.lit("")) != "") & (F.lower(T.normalize_space(hyp)) == F.lower(T.normalize_space(source)))


def repetition_penalty(tokens: Column, n: int = 3) -> Column:
    grams, count = T.ngrams(tokens, n), F.size(tokens) - (n - 1)
    return F.when(F.size(tokens) < 2 * n, 0.0).otherwise(F.least(F.lit(0.2), (count - F.size(F.array_distinct(grams))) / count))


def artifact_penalty(text: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(T.normalize_space(text)), F.lit(" "))
    hits = [((F.char_length(padded) - F.char_length(F.replace(padded, F.lit(a), F.lit("")))) / len(a)) for a in CHAT_ARTIFACTS]
    return F.least(F.lit(0.6), 0.18 * reduce(lambda a, b: a + b, hits))


def entities(source: Column) -> Column:
    """Distinct numbers and capitalised words of three letters or more."""
    numbers = F.regexp_extract_all(source, F.lit(r"(?<![\p{L}\p{N}_])(\d+(?:[.,]\d+)*)(?![\p{L}\p{N}_])"), 1)
    names = F.regexp_extract_all(source, F.lit(r"(?<![\p{L}\p{N}_])([A-ZÁÉÍÓÚÜÑ][A-ZÁÉÍÓÚÜÑa-záéíóúüñ]{2,})(?![\p{L}\p{N}_])"), 1)
    return F.array_distinct(F.concat(numbers, names))


def entity_preservation(hyp: Column, source: Column) -> Column:
    found = entities(F.coalesce(source, F.lit("")))
    kept = F.size(F.filter(found, lambda e: F.contains(F.lower(hyp), F.lower(e))))
    return F.when(F.size(found) == 0, 1.0).otherwise(kept / F.size(found))


def fast_chrf(hyp: Column, ref: Column) -> Column:
    """Mean F2 of character n-grams for n = 1 to 6, of normalised lower-case text; a shorter text is its own n-gram."""
    a, b = (F.lower(T.normalize_space(c)) for c in (hyp, ref))
    stats = overlap.letter_stats(a, b)

    def f2(n: int) -> Column:
        # a text of fewer than n characters is one n-gram, which only an equal text shares
        short_a, short_b = ((F.char_length(c) > 0) & (F.char_length(c) < n) for c in (a, b))
        x, y, both = (F.get(stats, F.lit(3 * (n - 1) + k)) for k in range(3))
        x, y = F.when(short_a, 1).otherwise(x), F.when(short_b, 1).otherwise(y)
        both = F.when(short_a | short_b, (short_a & short_b & (a == b)).cast("int")).otherwise(both)
        p, r = both / F.greatest(x, F.lit(1)), both / F.greatest(y, F.lit(1))
        return F.when(both > 0, 5.0 * p * r / (4.0 * p + r)).otherwise(0.0)

    return reduce(lambda x, y: x + y, [f2(n) for n in range(1, 7)]) / 6.0


def fast_bleu(hyp: Column, ref: Column) -> Column:
    """Mean n-gram precision for n = 1 to 4 times the length ratio up to 1, of token arrays."""
    stats = overlap.item_stats(hyp, ref)
    parts = [F.when(F.get(stats, F.lit(3 * n)) > 0, F.get(stats, F.lit(3 * n + 2)) / F.get(stats, F.lit(3 * n))).otherwise(0.0) for n in range(4)]
    short = F.least(F.lit(1.0), F.size(hyp) / F.greatest(F.size(ref), F.lit(1)))
    return F.when((F.size(hyp) > 0) & (F.size(ref) > 0), reduce(lambda x, y: x + y, parts) / 4.0 * short).otherwise(0.0)


def sentence_chrf(hyp: Column, ref: Column) -> Column:
    """Character F-score with word pairs, from 0 to 1."""
    return overlap.chrf_of(overlap.chrf_stats(hyp, ref))


def sentence_bleu(hyp: Column, ref: Column) -> Column:
    return overlap.bleu_of(overlap.bleu_stats(hyp, ref))


def _steps(value: Column, steps: tuple, other: Column, below: bool = False) -> Column:
    """The penalty of the first step that the value reaches (or stays below)."""
    out = None
    for bound, penalty in steps:
        test = value < bound if below else value >= bound
        out = F.when(test, penalty) if out is None else out.when(test, penalty)
    return out.otherwise(other)


def severity_of(chrf: Column, f1: Column, length: Column, copied: Column, exact: Column, leak: Column, entities: Column, repeated: Column, artifacts: Column) -> Column:
    """Steps for copying, leakage, low overlap, length and lost entities, then repetition and artifacts; 1 at most."""
    low = None
    for most_chrf, most_f1, penalty in LOW_OVERLAP_STEPS:
        test = (chrf < most_chrf) & (f1 < most_f1)
        low = F.when(test, penalty) if low is None else low.when(test, penalty)
    parts = [
        F.when(exact, EXACT_COPY_PENALTY).otherwise(_steps(copied, COPIED_STEPS, F.lit(0.0))),
        _steps(leak, LEAK_STEPS, leak),
        low.otherwise(0.0),
        _steps(length, LENGTH_STEPS, F.lit(0.0), below=True),
        _steps(entities, ENTITY_STEPS, F.lit(0.0), below=True),
        repeated,
        artifacts,
    ]
    return F.least(F.lit(1.0), reduce(lambda a, b: a + b, parts))


def severity_penalty(hyp: Column, ref: Column, source: Column, chrf: Column, f1: Column, length: Column, hyp_tokens: Column, source_tokens: Column) -> Column:
    """severity_of() from texts and their tokens."""
    return severity_of(chrf, f1, length, source_copy_ratio(hyp_tokens, source_tokens), exact_copy(hyp, source), leakage_penalty(hyp_tokens), entity_preservation(hyp, source), repetition_penalty(hyp_tokens), artifact_penalty(hyp))


def rerank_score(chrf: Column, bleu: Column, f1: Column, length: Column, copied: Column, exact: Column, leak: Column, artifacts: Column, repeated: Column) -> Column:
    """Reference-aware score of a candidate."""
    return 0.44 * chrf + 0.14 * bleu + 0.24 * f1 + 0.08 * length - 0.25 * copied - F.when(exact, 0.40).otherwise(0.0) - 0.22 * leak - 0.35 * artifacts - 0.12 * repeated


def reward_score(chrf: Column, bleu: Column, f1: Column, length: Column, copied: Column, leak: Column, artifacts: Column) -> Column:
    """The default reward."""
    return 0.62 * chrf + 0.18 * bleu + 0.12 * f1 + 0.08 * length - leak - 0.20 * copied - artifacts


def mbr_score(utility: Column, length_consensus: Column, copied: Column, leak: Column, artifacts: Column, repeated: Column, exact: Column) -> Column:
    """Consensus score of a candidate among its peers."""
    return utility + 0.08 * length_consensus - 0.28 * copied - 0.32 * leak - 0.30 * artifacts - 0.14 * repeated - F.when(exact, 0.30).otherwise(0.0)
