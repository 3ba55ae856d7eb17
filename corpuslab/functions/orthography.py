"""Column functions: spelling by rule, and the gate that lets only such edits through."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import KEPT_NAMES, LOANS, MARKED_LOANS, PLACE_NAMES, RULE_LOANS, RULE_STEPS, RULE_WORDS, SPELLING_RULES, SPELLINGS, WORD
from .text import normalize_space


def safe_token(token: Column) -> Column:
    """The one spelling a token may change to: a set word with its capital kept, else the rules in order."""
    table = F.create_map(*(F.lit(x) for pair in (LOANS | SPELLINGS).items() for x in pair))
    word = F.try_element_at(table, F.lower(token))
    capital = F.left(token, F.lit(1)) != F.lower(F.left(token, F.lit(1)))
    raised = F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, F.lit(2), F.char_length(word)))
    ruled = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), SPELLING_RULES, token)
    return F.when(word.isNotNull(), F.when(capital, raised).otherwise(word)).otherwise(ruled)


def tokens(text: Column) -> Column:
    norm = normalize_space(text)
    return F.when(norm == "", F.array().cast("array<string>")).otherwise(F.split(norm, " "))


def without_loan_mark(text: Column) -> Column:
    """nisqa after a marked loan goes; its ending joins the loan."""
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}_])({'|'.join(MARKED_LOANS)})(\S*)\s+ñ?nisqa(\S*)", "$1$2$3")


def verified(original: Column, proposed: Column) -> Column:
    """struct(text, vetoed, mismatch): each proposed token that is the safe form of the original one is taken, others are not; another number of tokens keeps the original unless only the loan mark went."""
    base = without_loan_mark(original)
    o, p = tokens(base), tokens(proposed)
    taken = F.zip_with(o, p, lambda a, b: F.when((a == b) | (b == safe_token(a)), b).otherwise(a))
    vetoed = F.size(F.filter(F.zip_with(o, p, lambda a, b: (a != b) & (b != safe_token(a))), lambda x: x))
    merged = normalize_space(proposed) == normalize_space(base)
    return F.when(F.size(o) == F.size(p), F.struct(F.array_join(taken, " ").alias("text"), vetoed.alias("vetoed"), F.lit(False).alias("mismatch"))).otherwise(
        F.struct(F.when(merged, base).otherwise(original).alias("text"), F.lit(0).alias("vetoed"), (~merged).alias("mismatch"))
    )


def corruptions(original: Column, proposed: Column) -> Column:
    """Tokens changed to something unsafe; all of them if their number differs."""
    o, p = tokens(original), tokens(proposed)
    bad = F.size(F.filter(F.zip_with(o, p, lambda a, b: (a != b) & (b != safe_token(a))), lambda x: x))
    return F.when(F.size(o) == F.size(p), bad).otherwise(F.greatest(F.size(o), F.size(p)))


def veto(original: Column, proposed: Column) -> Column:
    """Why a proposal is refused: apostrophes, tokens, length or aspirates that grew; null if it is not."""

    def grew(pattern: str) -> Column:
        return F.regexp_count(proposed, F.lit(pattern)) > F.regexp_count(original, F.lit(pattern))

    return (
        F.when(normalize_space(original) == normalize_space(proposed), F.lit(None).cast("string"))
        .when(grew("['’]"), "apostrophe_inserted")
        .when(F.size(tokens(proposed)) > F.size(tokens(original)), "token_count_increased")
        .when(F.char_length(normalize_space(proposed)) > F.char_length(normalize_space(original)) + 3, "length_explosion")
        .when(grew("chh|kh|ph|qh|th"), "aspirate_inserted")
    )


def rule_token(token: Column) -> Column:
    """A word by the plain rules: a set word, else the steps in order."""
    words = F.create_map(*(F.lit(x) for pair in RULE_WORDS.items() for x in pair))
    ruled = reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), RULE_STEPS, token)
    return F.coalesce(F.try_element_at(words, F.lower(token)), ruled)


def rule_normalized(text: Column) -> Column:
    """A sentence by the plain rules: place names, marked loans, then each word between its punctuation marks; names and words that begin with no letter stay."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)({'|'.join(MARKED_LOANS)})(\S*)\s+nisqa(\S*)", "$1$2$3")
    for old, new in PLACE_NAMES.items():
        t = F.regexp_replace(t, f"(?<!{WORD}){old}(?!{WORD})", new)
    loans = F.create_map(*(F.lit(x) for pair in RULE_LOANS.items() for x in pair))

    def one(word: Column) -> Column:
        head, core, tail = (F.regexp_extract(word, rf"(?s)^([^\p{{L}}\p{{N}}_]*)(.+?)([^\p{{L}}\p{{N}}_]*)$", k) for k in (1, 2, 3))
        new = F.when(core.isin(*KEPT_NAMES), core).otherwise(F.coalesce(F.try_element_at(loans, core), F.when(core.rlike(r"^\p{L}"), rule_token(core)).otherwise(core)))
        return F.concat(head, new, tail)

    return F.array_join(F.transform(tokens(t), one), " ")


def plain_dialect(token: Column) -> Column:
    """A word of the southern spelling in the plain one: a lone capital lowered, no apostrophe after stops, no aspirate at a word's start, u for o, qam for qan."""
    lone = token.rlike(r"^\p{Lu}") & ~token.rlike(r"^\p{Lu}\p{Lu}") & (F.char_length(token) > 1)
    t = F.when(lone, F.concat(F.lower(F.left(token, F.lit(1))), F.substring(token, F.lit(2), F.char_length(token)))).otherwise(token)
    for stop in ("k", "p", "t", "q", "ch", "s"):
        t = F.replace(t, F.lit(stop + "'"), F.lit(stop))
    t = F.regexp_replace(t, f"(?<!{WORD})(k|p|t|q|ch|s)h([aeiou])", "$1$2")
    t = F.translate(t, "oO", "uU")
    return F.when(F.lower(t) == "qan", "qam").otherwise(t)


def specificity_score(n_right: Column, n: Column, n_bad: Column, n_tokens: Column) -> Column:
    """Share of right sentences less the share of corrupted tokens."""
    return n_right / F.greatest(n, F.lit(1)) - n_bad / F.greatest(n_tokens, F.lit(1))
