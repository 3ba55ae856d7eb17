"""Worded analyses of translations: what a row should speak of, what its analysis speaks of, and balanced selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import text as T
from ..functions.fixed import ANALYSIS_STOPWORDS, ANALYSIS_TERMS, COPY_EXEMPT, DOMAIN_TERMS, THEMES, WORD


def has_entity(c: Column) -> Column:
    """A digit, or a capitalised word that isn't the first one."""
    words = F.regexp_extract_all(c, F.lit(rf"(?<!{WORD})(\p{{L}}[\p{{L}}\p{{N}}_'-]*)"), 1)
    later = F.slice(words, 2, F.greatest(F.lit(1), F.size(words)))
    return c.rlike("[0-9]") | F.exists(later, lambda w: w.rlike(r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$"))


def has_domain_term(source: Column, target: Column) -> Column:
    both = F.lower(F.concat_ws(" ", source, target))
    return reduce(lambda a, b: a | b, [F.contains(both, F.lit(t)) for t in DOMAIN_TERMS])


def has_copy_risk(source: Column, target: Column) -> Column:
    """Whether both sides share a word of four letters or more that isn't exempt."""

    def words(c: Column) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(c, F.lit(f"({WORD}+)"), 1), lambda w: F.lower(w)), lambda w: w.rlike(r"^\p{L}{4,}$"))

    return F.arrays_overlap(F.filter(words(source), lambda w: ~w.isin(*COPY_EXEMPT)), words(target))


def expected_tags(source: Column, target: Column) -> Column:
    """The three tags that a row's analysis should hold: two fixed ones, and one by what the row shows."""
    third = F.when(has_entity(source) | has_entity(target), "ENTIDADES").when(has_domain_term(source, target), "TERMINOLOGIA").otherwise("ANTI_COPIA")
    return F.array(F.lit("SIGNIFICADO"), F.lit("GRAMATICA"), third)


def row_key(source: Column, target: Column) -> Column:
    return F.concat_ws("\t", F.lower(T.normalize_space(source)), F.lower(T.normalize_space(target)))


def analysis_tokens(c: Column) -> Column:
    """Distinct lower-case words without accents, less tags and stop words."""
    words = F.regexp_extract_all(F.lower(T.without_accents(c)), F.lit("([a-z]+)"), 1)
    skip = T.words_of(*ANALYSIS_STOPWORDS, *(t.lower() for t in THEMES))
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(skip, w)))


def described(rows: DataFrame) -> DataFrame:
    """rows (target or analysis, source, reference, expected) with tags, words, specific, missing and matches.

    Without an analysis it is read from the target, as is the final translation; tags stand in brackets. An analysis is
    specific if it holds a term of the craft or a long word of its row.
    """
    analysis = F.coalesce(F.nullif("analysis", F.lit("")), parsing.structured_answer(F.col("target"))["thought"], F.lit(""))
    rows = rows.withColumn("_a", analysis)
    tokens = analysis_tokens(F.col("_a"))
    own = F.filter(analysis_tokens(F.concat_ws(" ", "source", "reference")), lambda w: F.char_length(w) >= 4)
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    return rows.withColumns(
        {
            "expected": expected,
            "tags": F.filter(T.words_of(*THEMES), lambda t: F.contains(F.col("_a"), F.concat(F.lit("["), t, F.lit("]")))),
            "words": F.size(tokens),
            "specific": F.arrays_overlap(tokens, T.words_of(*ANALYSIS_TERMS)) | F.arrays_overlap(tokens, own),
            "missing": F.filter(expected, lambda t: ~F.contains(F.col("_a"), F.concat(F.lit("["), t, F.lit("]")))),
            "matches": (T.normalize_space(F.col("reference")) != "") & (parsing.final_answer(F.col("target")) == T.normalize_space(F.col("reference"))),
        }
    ).drop("_a")


def record_passes(analysis: Column, judgement: Column, score: Column, required: Column, least_tags: int, most_words: int = 45) -> Column:
    """Whether a generated record may be kept."""
    tags = F.size(F.filter(T.words_of(*THEMES), lambda t: F.contains(analysis, F.concat(F.lit("["), t, F.lit("]")))))
    words = F.size(F.filter(F.split(T.normalize_space(analysis), " "), lambda w: w != ""))
    all_there = F.forall(required, lambda t: F.contains(analysis, F.concat(F.lit("["), t, F.lit("]"))))
    return (analysis != "") & (judgement != "") & (tags >= least_tags) & all_there & (words <= most_words) & score.between(0, 1)


def balanced(rows: DataFrame, order: list, most: int) -> DataFrame:
    """`most` rows that use the third tag (column `third`) as evenly as they can, in order.

    The rows differ in their third tag only, so the greedy choice fills the tags level by level. Three counts and at most
    three places come to the driver; each tag's rows are a top-k by `order`, whose columns must tell all rows apart.
    """
    counts = {r["third"]: r["n"] for r in rows.groupBy("third").agg(F.count("*").alias("n")).collect()}
    low, high = 0, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(min(n, mid) for n in counts.values()) <= most else (low, mid - 1)
    quota = {t: min(n, low) for t, n in counts.items()}
    rest = most - sum(quota.values())
    names = [f"_o{k}" for k in range(len(order))]
    open_tags = sorted(t for t, n in counts.items() if n > low)
    if rest > 0 and open_tags:
        nexts = reduce(DataFrame.union, [rows.filter(F.col("third") == t).orderBy(*order).limit(low + 1).select("third", *(F.expr(o).alias(n) if isinstance(o, str) else o.alias(n) for o, n in zip(order, names, strict=True))).withColumn("_k", F.lit(t)) for t in open_tags])
        heads = nexts.groupBy("third").agg(F.max(F.struct(*names)).alias("at")).orderBy("at").limit(rest).collect()
        for r in heads:
            quota[r["third"]] += 1
    parts = [rows.filter(F.col("third") == t).orderBy(*order).limit(n) for t, n in sorted(quota.items()) if n]
    return reduce(DataFrame.unionByName, parts) if parts else rows.limit(0)


def shots(rows: DataFrame, key: str, columns: list[str], order: list, n: int) -> DataFrame:
    """rows with `shots`: the first n rows other than their own. n + 1 rows come to the driver."""
    first = rows.orderBy(*order).limit(n + 1).select(F.col(key).alias("key"), *columns).collect()
    names = ["key", *columns]
    array = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in names)) for r in first)) if first else F.array().cast(f"array<struct<{','.join(f'{c}:string' for c in names)}>>")
    return rows.withColumn("shots", F.slice(F.filter(array, lambda s: s["key"] != F.col(key)), 1, n))
