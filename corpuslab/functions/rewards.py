"""Rewards of a translation: tables of weights over signal columns (fixed.py), and the reward that reads a structured answer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics as M
from . import text as T
from .fixed import ANSWER_GUARDS, CLEAN_PHRASES, FAULT_WORDS, REWARD_PARTS, REWARD_PROFILES, THEMES, VERIFIER_BLENDS


def flat(weights: dict[str, float]) -> dict[str, float]:
    """Weights of signals only: the parts are multiplied out."""
    out: dict[str, float] = {}
    for name, weight in weights.items():
        part = REWARD_PARTS.get("severity" if name == "severity_part" else name) if name != "severity" else None
        for signal, w in (part or {name: 1.0}).items():
            out[signal] = out.get(signal, 0.0) + weight * w
    return out


def weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f"s_{name}") * float(w) for name, w in flat(weights).items()])


def with_signals(df: DataFrame, hyp: str = "prediction", ref: str = "reference", source: str = "source") -> DataFrame:
    """df with every signal as a column s_<name>: overlap, guards, severity and the bounded quality. Tokens are made once."""
    h, r, s = (F.coalesce(F.col(c), F.lit("")) for c in (hyp, ref, source))
    df = df.withColumns({"_h": T.metric_tokens(h), "_r": T.metric_tokens(r), "_s": T.metric_tokens(s)})
    df = df.withColumns(
        {
            "s_chrf": M.sentence_chrf(h, r),
            "s_bleu": M.sentence_bleu(h, r),
            "s_f1": M.token_f1(F.col("_h"), F.col("_r")),
            "s_precision": M.token_precision(F.col("_h"), F.col("_r")),
            "s_length": M.length_ratio_score(h, r),
            "s_entities": M.entity_preservation(h, s),
            "s_copied": M.source_copy_ratio(F.col("_h"), F.col("_s")),
            "s_leak": M.leakage_penalty(F.col("_h")),
            "s_repeated": M.repetition_penalty(F.col("_h")),
            "s_artifacts": M.artifact_penalty(h),
            "s_exact": M.exact_copy(h, s).cast("int"),
        }
    )
    named = {k: F.col(f"s_{k}") for k in ("chrf", "f1", "length", "copied", "leak", "entities", "repeated", "artifacts")}
    df = df.withColumns(
        {
            "s_severity": M.severity_of(exact=F.col("s_exact") == 1, **named),
            "s_not_copied": 1.0 - F.least(F.lit(1.0), F.col("s_copied") * 1.8),
            "s_not_leaked": 1.0 - F.least(F.lit(1.0), F.col("s_leak") * 4.0),
            "s_calm": 1.0 - F.least(F.lit(1.0), F.col("s_repeated") * 5.0),
        }
    )
    return df.withColumn("s_quality", F.least(F.lit(1.0), F.greatest(F.lit(0.0), weighted(REWARD_PARTS["rerank"])))).drop("_h", "_r", "_s")


def reward(profile: str) -> Column:
    """The reward of a profile, from the columns of with_signals(); an unknown profile is the default one."""
    return weighted(REWARD_PROFILES.get(profile, REWARD_PROFILES["default"]))


def blend(name: str, first: str, second: str | None = None) -> Column:
    """A reward that takes verifier scores from columns."""
    weights = flat(VERIFIER_BLENDS[name])
    given = {"first_verifier": first, "second_verifier": second}
    return reduce(lambda a, b: a + b, [F.col(given.get(n) or f"s_{n}") * float(w) for n, w in weights.items()])


def without_artifacts(text: Column) -> Column:
    """What follows `final answer:`, else what precedes the first mark of a chat template or of visible reasoning."""
    t = T.normalize_space(text)
    stated = F.regexp_extract(t, r"(?i)(?:final answer|respuesta final)\s*:\s*(.+)$", 1)
    mark = r"(?i)thinking process|</?think|<\|im_(?:start|end)\|>|(?<![\p{L}\p{N}_])(?:assistant|user|system)(?![\p{L}\p{N}_])"
    return T.normalize_space(F.when(stated != "", stated).otherwise(F.element_at(F.split(t, mark, 2), 1)))


def last_content(messages: Column) -> Column:
    """The last message's content, normalised; null for no message."""
    return T.normalize_space(F.try_element_at(messages, F.lit(-1))["content"])


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def theme_tags(text: Column) -> Column:
    """The distinct known tags [TAG] of a text."""
    return F.array_intersect(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([A-Z_]+)\]"), 1)), T.words_of(*THEMES))


def thought_score(thought: Column) -> Column:
    """Worded reasoning: 0.30 for a length of 6 to 35 tokens (less for others), 0.45 for themes touched, 0.25 for tags."""
    t = F.lower(T.normalize_space(thought))
    n = F.size(T.metric_tokens(thought))
    length = F.when(n < 6, 0.25).when(n <= 35, 1.0).when(n <= 55, 0.55).when(n <= 70, 0.25).otherwise(0.10)
    themes = reduce(lambda a, b: a + b, [_any_in(t, words).cast("int") for words in THEMES.values()])
    tags = F.size(theme_tags(F.coalesce(thought, F.lit(""))))
    return F.when(t == "", 0.0).otherwise(0.30 * length + 0.45 * F.least(F.lit(1.0), themes / 3.0) + 0.25 * F.least(F.lit(1.0), tags / 2.0))


def self_judgement_score(analysis: Column, stated: Column, true: Column) -> Column:
    """How well a stated score and its analysis fit the true score."""
    t = F.lower(T.normalize_space(analysis))
    fault, clean = _any_in(t, FAULT_WORDS), _any_in(t, CLEAN_PHRASES)
    return (
        F.when(stated.isNull(), 0.0)
        .when(M.n_words(t) < 3, 0.35)
        .when((true < 0.45) & (stated >= 0.80), 0.0)
        .when((true < 0.65) & ~fault, 0.35)
        .when((true >= 0.82) & (stated <= 0.50), 0.45)
        .when((true >= 0.82) & fault & ~clean, 0.65)
        .otherwise(1.0)
    )


def answer_reward(answer: Column, judged: Column | None = None, need_thought: bool = False) -> Column:
    """The reward of a structured answer (struct of parsing.structured_answer), from the signals of its translation.

    `judged` replaces the rule for the self-judgement by a learned score.
    """
    true, stated = F.col("s_quality"), answer["self_score"]
    form = F.when(answer["has_thought_format"] if need_thought else answer["has_format"], 1.0).otherwise(0.15)
    near = F.when(stated.isNull(), 0.0).otherwise(1.0 - F.abs(stated - true))
    meta = self_judgement_score(answer["analysis"], stated, true)
    if judged is not None:
        meta = F.when(judged.isNull(), meta).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), judged)))
    own = near * meta * ((0.75 + 0.25 * thought_score(answer["thought"])) if need_thought else F.lit(1.0))
    guards = reduce(lambda a, b: a + b, [F.col(f"s_{k}") * w for k, w in ANSWER_GUARDS.items()])
    return form * (0.76 * true + 0.24 * own) - guards
