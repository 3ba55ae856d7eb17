"""Aligned pairs: scoring, flags, tiers, de-duplication and assembly."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import FLAG_PENALTIES, HARD_FLAGS, SENTENCE_ENDS


@dataclass(frozen=True)
class FlagLimits:
    min_chars: int = 18
    max_chars: int = 700
    min_words: int = 3
    min_ratio: float = 0.32
    max_ratio: float = 3.2
    max_token_overlap: float = 0.62
    max_char_overlap: float = 0.72


def either(test, *columns: Column) -> Column:
    return reduce(lambda a, b: a | b, [test(c) for c in columns])


def score_pairs(df: DataFrame, limits: FlagLimits = FlagLimits()) -> DataFrame:
    """df with source and target normalised, their sizes, flags in a fixed order and a quality score in [0, 1]."""
    df = df.withColumns({"source": T.normalize_pair_text(F.col("source")), "target": T.normalize_pair_text(F.col("target"))})
    df = df.withColumns({"_s": T.pair_words(F.col("source")), "_t": T.pair_words(F.col("target"))})
    s, t, sw, tw = (F.col(c) for c in ("source", "target", "_s", "_t"))
    ratio = F.char_length(t) / F.greatest(F.char_length(s), F.lit(1))
    copied = (T.share_of_larger(sw, tw) > limits.max_token_overlap) & (T.share_of_larger(T.letters(s), T.letters(t)) > limits.max_char_overlap)
    tests = {
        "empty_side": (s == "") | (t == ""),
        "too_short": either(lambda c: F.char_length(c) < limits.min_chars, s, t),
        "too_long": either(lambda c: F.char_length(c) > limits.max_chars, s, t),
        "too_few_words": either(lambda c: F.size(c) < limits.min_words, sw, tw),
        "punct_or_numbers_only": either(lambda c: c.rlike(r"^[^\p{L}]+$"), s, t),
        "bracketed_metadata": either(lambda c: c.rlike(r"^[\[(][^\n]{0,80}[\])]$"), s, t),
        "extreme_length_ratio": (ratio < limits.min_ratio) | (ratio > limits.max_ratio),
        "exact_copy": F.lower(s) == F.lower(t),
        "high_overlap_copy_risk": copied,
        "weak_spanish_signal": ~T.has_spanish_signal(sw),
        "weak_quechua_signal": ~T.has_quechua_signal(tw),
    }
    flags = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
    df = df.withColumns({"source_chars": F.char_length(s), "target_chars": F.char_length(t), "source_words": F.size(sw), "target_words": F.size(tw), "length_ratio": ratio, "flags": flags})
    return df.withColumn("quality_score", quality(F.col("flags"), F.col("length_ratio"), s, t)).drop("_s", "_t")


def quality(flags: Column, ratio: Column, source: Column, target: Column) -> Column:
    """1 less the flags' penalties, more for a usual length ratio and for sentences that both end."""
    penalties = reduce(lambda a, b: a + b, [F.when(F.array_contains(flags, name), p).otherwise(0.0) for name, p in FLAG_PENALTIES.items()])

    def ends(c: Column) -> Column:
        return F.right(c, F.lit(1)).isin(*SENTENCE_ENDS)

    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - penalties + F.when(ratio.between(0.65, 1.75), 0.06).otherwise(0.0) + F.when(ends(source) & ends(target), 0.04).otherwise(0.0)))


def with_tiers(scored: DataFrame, broad: float = 0.72) -> DataFrame:
    """High quality: no flag. Broad: a score of `broad` or more and no hard flag."""
    return scored.withColumns({"is_high": F.size("flags") == 0, "is_broad": (F.col("quality_score") >= broad) & ~F.arrays_overlap("flags", T.words_of(*HARD_FLAGS))})


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row by `order` of each group of equal keys; unlike dropDuplicates, which survivor stays is defined."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def keep_preferred(df: DataFrame, keys: list, preferred: Column, order: list, reverse: list) -> DataFrame:
    """Of each group the first preferred row, or the last row if none is preferred."""
    ranked = df.withColumn("_p", preferred)
    w = W.partitionBy(*keys)
    ranked = ranked.withColumn("_any", F.max(F.col("_p").cast("int")).over(w))
    ranked = ranked.withColumn("_n", F.when(F.col("_any") == 1, F.row_number().over(w.orderBy(F.desc("_p"), *order))).otherwise(F.row_number().over(w.orderBy(*reverse))))
    return ranked.filter("_n = 1").drop("_p", "_any", "_n")


def drop_leaks(df: DataFrame, held: DataFrame, on: list[tuple[Column, Column]]) -> DataFrame:
    """df without the rows of which any key equals that key of a held-out row: an anti-join for each key rather than a disjunction."""
    for k, (own, other) in enumerate(on):
        keys = held.select(other.alias(f"_leak{k}")).distinct()
        df = df.withColumn(f"_own{k}", own).join(keys, F.col(f"_own{k}") == F.col(f"_leak{k}"), "left_anti").drop(f"_own{k}")
    return df


def drop_containing(df: DataFrame, held: DataFrame, text: Column, passage: Column, words: int = 5) -> DataFrame:
    """df without the rows whose text holds a held-out passage, whole words in a row, whatever their case and spacing.

    A passage's first `words` words (all, if it has fewer) meet the texts' runs of as many words by their hash; the whole
    passage is then checked. No text is held against passages that it shares no run with.
    """
    spaced = lambda c: F.concat(F.lit(" "), F.lower(T.normalize_space(c)), F.lit(" "))
    body = df.withColumns({"_row": F.monotonically_increasing_id(), "_body": spaced(text)}).withColumn("_words", F.split(F.trim("_body"), " "))
    p = held.select(spaced(passage).alias("_passage")).filter("trim(_passage) <> ''").distinct()
    p = p.withColumn("_w", F.split(F.trim("_passage"), " "))
    p = p.withColumn("_size", F.least(F.size("_w"), F.lit(words)))
    sizes = [r["_size"] for r in p.select("_size").distinct().collect()]  # `words` numbers at most
    if not sizes:
        return df
    p = p.withColumn("_h", F.xxhash64("_size", F.array_join(F.slice(F.col("_w"), F.lit(1), F.col("_size")), " "))).drop("_w", "_size")
    runs = F.concat(*(_hashed_runs(F.col("_words"), n) for n in sorted(sizes)))
    flat = body.select("_row", "_body", F.explode(F.array_distinct(runs)).alias("_h"))
    hit = flat.join(p, "_h").filter(F.contains("_body", "_passage")).select("_row").distinct()
    return body.join(hit, "_row", "left_anti").drop("_row", "_body", "_words")


def _hashed_runs(words: Column, n: int) -> Column:
    return F.transform(T.ngrams(words, n), lambda g: F.xxhash64(F.lit(n), g))


def pending(rows: DataFrame, accepted: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """rows with status existing_accepted, existing_failed or pending; an accepted key stays accepted."""
    marks = accepted.select(key).withColumn("_m", F.lit(2)).union(failed.select(key).withColumn("_m", F.lit(1))).groupBy(key).agg(F.max("_m").alias("_m"))
    status = F.when(F.col("_m") == 2, "existing_accepted").when(F.col("_m") == 1, "existing_failed").otherwise("pending")
    return rows.join(marks, key, "left").withColumn("status", status).drop("_m")


def within_budget(rows: DataFrame, cost: Column, cap: float, order: list, scope: list) -> DataFrame:
    """The rows of each scope, in order, whose running cost stays within the cap."""
    w = W.partitionBy(*scope).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.withColumn("_spent", F.sum(cost).over(w)).filter(F.col("_spent") <= cap).drop("_spent")


def oversampled(df: DataFrame, matched: Column, times: int) -> DataFrame:
    """Each matched row `times` times (at least once), the others once; `copy` numbers them from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(matched, F.lit(max(times, 1) - 1)).otherwise(F.lit(0)))))


def split_by_hash(df: DataFrame, key: Column, seed: int, share: float, scope: list | None = None) -> DataFrame:
    """An exact held-out share (one row at least) of each scope, by the order of a seeded hash of the key."""
    w = W.partitionBy(*(scope or [F.lit(0)]))
    place = F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), key))
    size = F.greatest(F.lit(1), F.floor(F.count("*").over(w) * F.lit(share)))
    return df.withColumn("split", F.when(place <= size, "eval").otherwise("train"))


def expand_alternatives(df: DataFrame, column: str) -> DataFrame:
    """A row for each part of `a / b / c`, numbered from 0; a prefix before the last blank of the first part carries over to single-word parts."""
    parts = F.transform(F.split(F.col(column), "/"), lambda p: T.normalize_space(p))
    prefix = F.regexp_extract(F.element_at(parts, 1), r"^(.*\s)\S+$", 1)
    carried = F.transform(parts, lambda p, i: F.when((i > 0) & (prefix != "") & ~p.rlike(r"\s"), F.concat(prefix, p)).otherwise(p))
    return df.select("*", F.posexplode(F.filter(carried, lambda p: p != "")).alias("part_index", "part"))
