"""Rows for training: filters, labels, preferences, prompts, noise and retrieval from a dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import rewards as R
from ..functions import text as T
from ..functions.fixed import HIDDEN_SEVERITIES, LABEL_SCORE, LABEL_SEVERITIES, LEAKAGE_WORDS, PROMPT_MODES
from . import pairs as P


def source_tiers(subset: Column) -> dict[str, Column]:
    """Flags of where a row comes from."""
    return {"is_real": subset.isin("train_jw300", "dict", "extra"), "is_synthetic": subset == "synthetic", "is_eval": subset == "dev"}


def target_passes(source: Column, target: Column, most_copied: float = 2.0, most_leak: float = 2.0, most_artifacts: float = 2.0, no_exact: bool = True) -> Column:
    """Whether a target may be trained on; a limit above 1 asks nothing."""
    h, s = T.metric_tokens(target), T.metric_tokens(source)
    tests = [F.lit(True)]
    if no_exact:
        tests.append(~M.exact_copy(target, source))
    for limit, value in ((most_copied, M.source_copy_ratio(h, s)), (most_leak, M.leakage_penalty(h)), (most_artifacts, M.artifact_penalty(target))):
        if limit <= 1.0:
            tests.append(value <= limit)
    return reduce(lambda a, b: a & b, tests)


def simple_term(c: Column, most_chars: int, most_words: int) -> Column:
    t = T.normalize_space(c)
    return (t != "") & (F.char_length(t) <= most_chars) & (F.size(T.metric_tokens(t)) <= most_words) & ~t.rlike(r'[0-9/@#*_{}\[\]<>|=()"“”]')


def valid_term(source: Column, target: Column, least_chars: int = 3, most_chars: int = 40, most_words: int = 4) -> Column:
    """Whether a pair is a term: bounded, without digits or brackets, and no stop word."""
    s = T.normalize_space(source)
    return (F.char_length(s) >= least_chars) & ~F.lower(s).isin(*LEAKAGE_WORDS) & simple_term(source, most_chars, most_words) & simple_term(target, most_chars, most_words)


def reasoned_target(reasoning: Column, target: Column, combined: bool) -> Column:
    """The target, after its reasoning if combined."""
    return F.concat(F.lit("Razonamiento: "), F.trim(reasoning), F.lit("\n\nTraducción: "), target) if combined else target


def reject_reason(ok: Column, final: Column, gold: Column, finish: Column) -> Column:
    """Why a response is refused: api_error, no_final_line, final_mismatch or finish_reason_length; null if it isn't."""
    same = F.lower(T.normalize_space(final)) == F.lower(T.normalize_space(gold))
    return F.when(~F.coalesce(ok, F.lit(False)), "api_error").when(final.isNull(), "no_final_line").when(~same, "final_mismatch").when(finish == "length", "finish_reason_length")


def preference_rows(df: DataFrame, order: list, **limits) -> DataFrame:
    """Normalised (source, chosen, rejected) rows that are whole, differ, pass target_passes() and are the first of their kind whatever their case."""
    rows = df.withColumns({c: T.normalize_space(F.col(c)) for c in ("source", "chosen", "rejected")})
    rows = rows.filter((F.col("source") != "") & (F.col("chosen") != "") & (F.col("rejected") != "") & (F.col("chosen") != F.col("rejected")))
    rows = rows.filter(target_passes(F.col("source"), F.col("chosen"), **limits))
    return P.keep_first(rows, [F.lower("source"), F.lower("chosen"), F.lower("rejected")], order)


def chosen_target(prediction: Column, reference: Column, score: Column, least: float = 70.0) -> Column:
    """The prediction where its score reaches the limit, else the reference."""
    return F.when(score >= least, prediction).otherwise(reference)


def prompt_mode(mode: Column, default: str = "direct") -> Column:
    """direct, verify, thinking, compact or engineered; blank, global and default are the default; another name is an error."""
    m = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    table = F.create_map(*(F.lit(x) for pair in PROMPT_MODES.items() for x in pair))
    known = F.when(m.isin("", "global", "default"), default).otherwise(F.try_element_at(table, m))
    return F.coalesce(known, F.when(F.startswith(m, F.lit("engineered_reasoning")), "engineered"), F.raise_error(F.concat(F.lit("unknown prompt mode "), m)))


def first_present(*columns: Column) -> Column:
    """The first of the texts that isn't blank; null if all are."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def ledger_key(row_key: Column, source: Column, reference: Column, target: Column) -> Column:
    """The row's own key, else one made of its source and its reference (or target); null where a side is missing."""
    right = first_present(reference, target)
    made = F.when((F.coalesce(source, F.lit("")) != "") & right.isNotNull(), F.concat_ws("\t", F.lower(T.normalize_space(source)), F.lower(T.normalize_space(right))))
    return F.coalesce(F.nullif(row_key, F.lit("")), made)


def without_known(df: DataFrame, held: DataFrame, shots: DataFrame) -> DataFrame:
    """df (source, target) without held-out sources and without the pairs used as examples."""
    return df.join(held.select("source").distinct(), "source", "left_anti").join(shots.select("source", "target").distinct(), ["source", "target"], "left_anti")


def best_of_text(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Of each group's candidates with one normalised text that with the highest score, of equal ones the first."""
    same = F.lower(T.normalize_space(F.col("prediction")))
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys, same).orderBy(F.desc(score), "candidate_index"))).filter("_n = 1").drop("_n")


def gap_pairs(df: DataFrame, keys: list[str], score: str, least_gap: float, near: float, most: int, seed: int = 7) -> DataFrame:
    """(keys, chosen_index, rejected_index, gap): up to `most` pairs a group of a near-best winner and a loser `least_gap` below the best, distinct in text.

    Winners and losers are each ordered by a seeded hash; pair k takes winner k mod winners and the loser after it, so no
    group's pairs are all made.
    """
    w = W.partitionBy(*keys)
    best = F.max(score).over(w)
    kind = F.when(F.col(score) >= best - near, "w").when(F.col(score) <= best - least_gap, "l")
    rows = df.withColumn("_kind", kind).filter("_kind is not null")
    rows = P.keep_first(rows, [*keys, "_kind", "prediction"], ["candidate_index"])
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *keys, "candidate_index"))
    side = W.partitionBy(*keys, "_kind")
    rows = rows.withColumns({"_r": F.row_number().over(side.orderBy(h)) - 1, "_n": F.count("*").over(side)})
    losers = rows.filter((F.col("_kind") == "l") & (F.col("_r") < most)).select(*keys, F.col("_r").alias("_k"), F.col("candidate_index").alias("rejected_index"), F.col(score).alias("_ls"))
    winners = rows.filter("_kind = 'w'").select(*keys, "_r", "_n", F.col("candidate_index").alias("chosen_index"), F.col(score).alias("_ws"))
    joined = losers.join(winners, keys).filter(F.col("_r") == F.col("_k") % F.col("_n"))
    return joined.select(*keys, "chosen_index", "rejected_index", (F.col("_ws") - F.col("_ls")).alias("gap"))


def label_score() -> Column:
    """The label score of a candidate from the columns of rewards.with_signals(), before the floor for an equal text."""
    return R.weighted(LABEL_SCORE)


def bounded_label(prediction: Column, reference: Column) -> Column:
    """label_score() between 0 and 0.98, which a text equal to the reference gets."""
    same = F.lower(T.normalize_space(prediction)) == F.lower(T.normalize_space(reference))
    raw = F.when(same, F.greatest(label_score(), F.lit(0.98))).otherwise(label_score())
    return F.greatest(F.lit(0.0), F.least(F.lit(0.98), raw))


def severity(score: Column, hidden: bool = False) -> Column:
    steps = HIDDEN_SEVERITIES if hidden else LABEL_SEVERITIES
    out = F.lit("critical")
    for least, name in reversed(steps):
        out = F.when(score >= least, name).otherwise(out)
    return out


def rationale(score: Column) -> Column:
    """Why a candidate has its label, by its signals first."""
    return (
        F.when(F.col("s_exact") == 1, "model_output_copied_spanish_source")
        .when(F.col("s_leak") >= 0.08, "model_output_has_spanish_leakage")
        .when(F.col("s_copied") >= 0.25, "model_output_copies_source_terms")
        .when(F.col("s_repeated") > 0, "model_output_repetition")
        .when(score < 0.40, "model_output_low_reference_agreement")
        .when(score < 0.70, "model_output_partial_or_noisy_translation")
        .otherwise("model_output_near_reference_translation")
    )


def label_json(score: Column, level: Column, why: Column) -> Column:
    """The compact JSON of a label, its score to three digits."""
    return F.to_json(F.struct(F.round(score, 3).alias("score"), level.alias("severity"), why.alias("rationale")))


def anchors(pairs: DataFrame) -> DataFrame:
    """Each pair as a clean candidate (0.98) and as a copied source (0.02)."""
    made = F.array(
        F.struct(F.col("target").alias("candidate"), label_json(F.lit(0.98), F.lit("none"), F.lit("clean_reference_anchor")).alias("label")),
        F.struct(F.col("source").alias("candidate"), label_json(F.lit(0.02), F.lit("critical"), F.lit("source_copy_anchor")).alias("label")),
    )
    return pairs.withColumn("_e", F.explode(made)).select(*pairs.columns, "_e.candidate", "_e.label")


def meta_examples(examples: DataFrame) -> DataFrame:
    """Each labelled example with a faithful and a flawed analysis, and how good the analysis is."""
    parsed = F.from_json("label", "score double, severity string, rationale string")
    bad = F.coalesce(parsed["score"], F.lit(0.0)) < 0.7
    faithful = F.concat(F.lit("Severidad "), F.coalesce(parsed["severity"], F.lit("unknown")), F.lit(": "), F.replace(F.coalesce(parsed["rationale"], F.lit("unknown")), F.lit("_"), F.lit(" ")))
    flawed = F.when(bad, "Sin errores, traduccion correcta y fiel.").otherwise("Hay errores graves y falta contenido.")
    made = F.array(F.struct(faithful.alias("analysis"), F.lit(0.95).alias("meta_score")), F.struct(flawed.alias("analysis"), F.lit(0.05).alias("meta_score")))
    return examples.withColumn("_e", F.explode(made)).select(*examples.columns, "_e.analysis", "_e.meta_score")


def mixed_targets(pairs: DataFrame, compact: Column) -> DataFrame:
    """Each pair twice: its plain target (mode direct) and a compact worded one (mode compact)."""
    made = F.array(F.struct(T.normalize_space(F.col("target")).alias("t"), F.lit("direct").alias("prompt_mode")), F.struct(compact.alias("t"), F.lit("compact").alias("prompt_mode")))
    return pairs.withColumn("_e", F.explode(made)).withColumns({"target": F.col("_e.t"), "prompt_mode": F.col("_e.prompt_mode")}).drop("_e")


def chat(system: str | None, user: Column, assistant: Column | None = None) -> Column:
    """array<struct<role, content>> of a prompt."""
    turns = [(F.lit("system"), F.lit(system))] if system else []
    turns += [(F.lit("user"), user)] + ([(F.lit("assistant"), assistant)] if assistant is not None else [])
    return F.array(*(F.struct(r.alias("role"), c.alias("content")) for r, c in turns))


def noisy(df: DataFrame, text: str, keys: list[str], rules: list[tuple[str, str]], levels: dict[str, float], seed: int = 3) -> DataFrame:
    """A row for each level with some rules applied once each, in order: rule k goes ahead where a seeded hash of key, level and k lies below the level's rate. Rows that nothing changed are left out."""
    level = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(r).alias("rate")) for n, r in levels.items())))
    rows = df.withColumn("_l", level)
    out = F.col(text)
    for k, (pattern, new) in enumerate(rules):
        chance = F.pmod(F.xxhash64(F.lit(seed + k), F.col("_l.name"), *keys), F.lit(10_000)) / 10_000.0
        first = rf"(?s)^(.*?){pattern}"
        out = F.when(chance < F.col("_l.rate"), F.regexp_replace(out, first, "$1" + new)).otherwise(out)
    return rows.withColumns({"noisy": out, "level": F.col("_l.name")}).filter(F.col("noisy") != F.col(text)).drop("_l")


def dictionary_hits(texts: DataFrame, key: str, text: str, entries: DataFrame, top: int) -> DataFrame:
    """(key, es, qu, place): entries (es, qu, ord) that share a word with the text, or whose term of four letters or more is part of it; each form once, longest terms first, `top` of them.

    Words meet by equality. Terms inside longer words meet by their four first letters: every four letters of a text's
    words are looked up, so no text is held against the whole dictionary.
    """
    norm = lambda c: F.lower(T.without_accents(T.normalize_space(c)))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    body = texts.select(key, norm(F.col(text)).alias("_b"))
    e = entries.select("es", "qu", "ord", norm(F.col("es")).alias("_e"))
    by_word = body.select(key, F.explode(F.array_distinct(words(F.col("_b")))).alias("_w")).join(e.withColumn("_w", F.explode(F.array_distinct(words(F.col("_e"))))), "_w").select(key, "es", "qu", "ord")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("_b") - 3, F.lit(1))), lambda i: F.substring(F.col("_b"), i, F.lit(4))))
    parts = body.withColumn("_g", F.explode(grams)).join(e.filter(F.char_length("_e") >= 4).withColumn("_g", F.left("_e", F.lit(4))), "_g").filter(F.contains("_b", "_e")).select(key, "es", "qu", "ord")
    hits = P.keep_first(by_word.union(parts), [key, F.lower("qu")], ["ord"])
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.char_length("es")), "ord"))
    return hits.withColumn("place", place).filter(F.col("place") <= top).drop("ord")


def dictionary_block(hits: DataFrame, key: str, title: str) -> DataFrame:
    """(key, block): the hits as lines under a title."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("  • "), "es", F.lit(" → "), "qu").alias("line")))), lambda x: x["line"])
    return hits.groupBy(key).agg(F.concat_ws("\n", F.lit(title), F.array_join(lines, "\n")).alias("block"))
