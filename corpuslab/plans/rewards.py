"""Queries for rewards: signals, severity, profiles, blends with verifier scores, and structured answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, parsing
from ..functions import rewards as R
from ..functions import text as T
from ..operators import diagnostics
from . import sqltext as S
from .candidates import pool
from .registry import query, table
from .translation import BLEU_ROWS, CHRF_ROWS

_LOW = "CASE " + " ".join(f"WHEN chrf < {a} AND f1 < {b} THEN {p}" for a, b, p in fixed.LOW_OVERLAP_STEPS) + " ELSE 0 END"
_SEVERITY = f"""least(1.0, CASE WHEN exact = 1 THEN {fixed.EXACT_COPY_PENALTY} ELSE {S.steps('copied', fixed.COPIED_STEPS, '0')} END + {S.steps('leak', fixed.LEAK_STEPS, 'leak')} + {_LOW}
  + {S.steps('length', fixed.LENGTH_STEPS, '0', True)} + {S.steps('entities', fixed.ENTITY_STEPS, '0', True)} + repeated + artifacts)"""


def _linear(weights: dict[str, float]) -> str:
    return "(" + " + ".join(f"({w!r}) * {k}" for k, w in R.flat(weights).items()) + ")"


def signals_sql(source: str) -> str:
    """CTEs after a pool `source` (conv_id, candidate_index, prediction, reference, source) up to sg, which has every signal. chrf and bleu come from their own queries."""
    return f"""tk AS (SELECT *, {S.tokens('prediction')} AS ht, {S.tokens('reference')} AS rt, {S.tokens('source')} AS st FROM {source}),
    cm AS (SELECT *, {S.common('ht', 'rt')} AS common, {S.entities('source')} AS ents FROM tk),
    s0 AS (SELECT cm.*, chrf, bleu, CASE WHEN len(ht) > 0 AND len(rt) > 0 THEN 2.0 * common / (len(ht) + len(rt)) ELSE 0 END AS f1, CASE WHEN len(ht) > 0 AND len(rt) > 0 THEN common * 1.0 / len(ht) ELSE 0 END AS precision,
      greatest(0.0, 1.0 - abs(ln(greatest({S.n_words('prediction')}, 1) * 1.0 / greatest({S.n_words('reference')}, 1)))) AS length, CASE WHEN len(ents) = 0 THEN 1.0 ELSE len(list_filter(ents, lambda e: contains(lower(prediction), lower(e)))) * 1.0 / len(ents) END AS entities,
      {S.copied('ht', 'st')} AS copied, {S.leak('ht')} AS leak, {S.repeated('ht')} AS repeated, {S.artifacts('prediction')} AS artifacts, ({S.exact('prediction', 'source')})::INT AS exact
      FROM cm JOIN ({CHRF_ROWS}) c USING (conv_id, candidate_index) JOIN ({BLEU_ROWS}) b USING (conv_id, candidate_index)),
    s1 AS (SELECT *, {_SEVERITY} AS severity, 1.0 - least(1.0, copied * 1.8) AS not_copied, 1.0 - least(1.0, leak * 4.0) AS not_leaked, 1.0 - least(1.0, repeated * 5.0) AS calm FROM s0),
    sg AS (SELECT *, least(1.0, greatest(0.0, {_linear(fixed.REWARD_PARTS['rerank'])})) AS quality FROM s1)"""


_SIGNALS = f"WITH {S.POOL}, {signals_sql('pool')}"
_KEYS = "conv_id, candidate_index"


def _rows(df: DataFrame, digits: int = 5, **values) -> DataFrame:
    return df.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), *(F.round(v + (1e-9 if digits == 4 else 0), digits).alias(k) for k, v in values.items()))


@query("x41_severity", f"{_SIGNALS} SELECT {_KEYS}, round(severity, 5) AS severity, round(entities, 5) AS entities, round(quality, 5) AS quality FROM sg")
def x41(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(R.with_signals(pool(spark, sf_dir)), severity=F.col("s_severity"), entities=F.col("s_entities"), quality=F.col("s_quality"))


@query("x43_reward_profiles", f"{_SIGNALS} SELECT {_KEYS}, {', '.join(f'round({_linear(w)} + 1e-9, 4) AS {n}' for n, w in fixed.REWARD_PROFILES.items() if n != 'default')}, round({_linear(fixed.REWARD_PROFILES["default"])} + 1e-9, 4) AS baseline FROM sg")
def x43(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = {n: R.reward(n) for n in fixed.REWARD_PROFILES if n != "default"}
    return _rows(R.with_signals(pool(spark, sf_dir)), 4, **profiles, baseline=R.reward("default"))


_GIVEN = "((conv_id * 7 + candidate_index * 3) % 11) / 10.0 AS first_verifier, ((conv_id + candidate_index) % 5) / 4.0 AS second_verifier"


@query("x44_verifier_blends", f"{_SIGNALS} SELECT {_KEYS}, {', '.join(f'round({_linear(w)} + 1e-9, 4) AS {n}' for n, w in fixed.VERIFIER_BLENDS.items())} FROM (SELECT *, {_GIVEN} FROM sg)")
def x44(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"p": ((F.col("conv_id") * 7 + F.col("candidate_index") * 3) % 11) / 10.0, "q": ((F.col("conv_id") + F.col("candidate_index")) % 5) / 4.0}
    return _rows(R.with_signals(pool(spark, sf_dir)).withColumns(given), 4, **{n: R.blend(n, "p", "q") for n in fixed.VERIFIER_BLENDS})


_THOUGHTS = ("[SIGNIFICADO] conserva el sentido [GRAMATICA] sufijo y caso natural en chanka", "fiel sin errores", "falta un nombre y hay copia del espanol con error de sufijo", "")


@query(
    "x46_answer_rewards",
    f"""{_SIGNALS}, m AS (SELECT *, [{', '.join(repr(t) for t in _THOUGHTS)}][1 + candidate_index % 4] AS thought, CASE WHEN conv_id % 3 = 0 THEN 'correcta y fiel en todo' WHEN conv_id % 3 = 1 THEN 'hay un error y una duda' ELSE 'ok' END AS judgement, CASE WHEN conv_id % 5 = 4 THEN NULL ELSE (conv_id % 5) / 4.0 END AS stated FROM sg),
    k AS (SELECT *, trim(concat_ws(' ', nullif(thought, ''), judgement)) AS a, lower(thought) AS lt, {S.tokens('thought')} AS tt FROM m),
    j AS (SELECT *, ({' OR '.join(f"contains(lower(a), '{w}')" for w in fixed.FAULT_WORDS)}) AS fault, ({' OR '.join(f"contains(lower(a), '{w}')" for w in fixed.CLEAN_PHRASES)}) AS clean, ({' + '.join('(' + ' OR '.join(f"contains(lt, '{w}')" for w in ws) + ')::INT' for ws in fixed.THEMES.values())}) AS themes, len(list_filter({S.listing(fixed.THEMES)}, lambda x: contains(thought, '[' || x || ']'))) AS tags FROM k),
    r AS (SELECT *, CASE WHEN stated IS NULL THEN 0 WHEN {S.n_words('a')} < 3 THEN 0.35 WHEN quality < 0.45 AND stated >= 0.8 THEN 0 WHEN quality < 0.65 AND NOT fault THEN 0.35 WHEN quality >= 0.82 AND stated <= 0.5 THEN 0.45 WHEN quality >= 0.82 AND fault AND NOT clean THEN 0.65 ELSE 1.0 END AS meta,
      CASE WHEN thought = '' THEN 0 ELSE 0.30 * CASE WHEN len(tt) < 6 THEN 0.25 WHEN len(tt) <= 35 THEN 1.0 ELSE 0.55 END + 0.45 * least(1.0, themes / 3.0) + 0.25 * least(1.0, tags / 2.0) END AS thinking FROM j)
    SELECT {_KEYS}, round(meta, 5) AS meta, round(thinking, 5) AS thinking, round(CASE WHEN stated IS NOT NULL THEN 1.0 ELSE 0.15 END * (0.76 * quality + 0.24 * coalesce(1.0 - abs(stated - quality), 0) * meta) - ({' + '.join(f'{w} * {n}' for n, w in fixed.ANSWER_GUARDS.items())}), 5) AS reward FROM r WHERE NOT regexp_matches(prediction, '[:]')""",
)
def x46(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers written out with their labels, read back, and rewarded. Predictions with a colon could hold a label of their own."""
    p = pool(spark, sf_dir).filter(~F.contains("prediction", F.lit(":")))
    thought = F.element_at(T.words_of(*_THOUGHTS), (1 + F.col("candidate_index") % 4).cast("int"))
    judgement = F.when(F.col("conv_id") % 3 == 0, "correcta y fiel en todo").when(F.col("conv_id") % 3 == 1, "hay un error y una duda").otherwise("ok")
    score = F.when(F.col("conv_id") % 5 == 4, "").otherwise(F.concat(F.lit(" Puntaje: \\boxed{"), ((F.col("conv_id") % 5) / 4.0).cast("string"), F.lit("}")))
    raw = F.concat(F.lit("Analisis de traduccion: "), thought, F.lit("\nTraduccion final: "), "prediction", F.lit("\nAutoevaluacion: "), judgement, score)
    p = p.withColumn("answer", parsing.structured_answer(raw)).withColumn("prediction", F.col("answer.translation"))
    a = F.col("answer")
    signals = R.with_signals(p)
    return _rows(signals, meta=R.self_judgement_score(a["analysis"], a["self_score"], F.col("s_quality")), thinking=R.thought_score(a["thought"]), reward=R.answer_reward(a))


@query(
    "a5_self_verification",
    f"""{_SIGNALS}, m AS (SELECT *, CASE WHEN conv_id % 5 = 4 THEN NULL ELSE (conv_id % 5) / 4.0 END AS stated FROM sg WHERE NOT regexp_matches(prediction, '[:]'))
    SELECT conv_id % 3 AS part, count(*) AS n, round(100 * avg((stated IS NOT NULL)::INT), 5) AS format_rate, round(100 * avg((stated IS NULL)::INT), 5) AS missing_score_rate, round(avg(stated), 5) AS avg_self_score, round(avg(quality), 5) AS avg_true_score, round(avg(abs(stated - quality)), 5) AS avg_score_gap,
      round(100 * coalesce(avg((stated - quality >= 0.2)::INT), 0), 5) AS false_confidence_rate, round(100 * coalesce(avg((quality - stated >= 0.2)::INT), 0), 5) AS underconfidence_rate, 3.0 AS avg_analysis_words FROM m GROUP BY ALL""",
)
def a5b(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir).filter(~F.contains("prediction", F.lit(":")))
    score = F.when(F.col("conv_id") % 5 == 4, "").otherwise(F.concat(F.lit(" Score: "), ((F.col("conv_id") % 5) / 4.0).cast("string")))
    raw = F.concat(F.lit("Final: "), "prediction", F.lit(" Eval: fiel y natural"), score)
    found = diagnostics.self_verification(p.withColumn("raw", raw).withColumn("part", F.col("conv_id") % 3), ["part"], "raw")
    rounded = ("format_rate", "missing_score_rate", "avg_self_score", "avg_true_score", "avg_score_gap", "false_confidence_rate", "underconfidence_rate", "avg_analysis_words")
    return found.select("part", "n", *(F.round(c, 5).alias(c) for c in rounded))


@query(
    "x39_without_artifacts",
    f"SELECT conv_id, turn, md5({S.norm('text')}) AS digest, CASE WHEN turn % 3 = 0 THEN 'Respuesta final: ' WHEN turn % 3 = 1 THEN '' ELSE 'cut' END AS form FROM conversations WHERE NOT regexp_matches(lower(text), 'thinking process|think|im_start|im_end|assistant|user|system|final')",
)
def x39(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").filter(~F.lower("text").rlike("thinking process|think|im_start|im_end|assistant|user|system|final"))
    form = F.when(F.col("turn") % 3 == 0, "Respuesta final: ").when(F.col("turn") % 3 == 1, "").otherwise("cut")
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>x</think> Respuesta final: "), "text")).when(F.col("turn") % 3 == 1, F.col("text")).otherwise(F.concat("text", F.lit(" <|im_end|> user more")))
    return c.select("conv_id", "turn", F.md5(R.without_artifacts(raw).cast("binary")).alias("digest"), form.alias("form"))


@query("x61_verifier_scores", "SELECT event_id, round(CASE WHEN event_id % 4 = 3 THEN 0.0 ELSE (event_id % 10) / 10.0 END, 3) AS score FROM events")
def x61(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("event_id") % 10 / 10.0).cast("string")
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"score": '), number, F.lit("}"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("The Score is about "), number)).when(F.col("event_id") % 4 == 2, F.concat(F.lit("puntaje="), number)).otherwise(F.concat(F.lit("underscore "), number))
    return table(spark, sf_dir, "events").select("event_id", F.round(parsing.verifier_score(raw), 3).alias("score"))


@query(
    "x63_marked_translation",
    "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN 'last ' || n_name ELSE '' END AS translation FROM nation",
)
def x63(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("thoughts\nTraduccion final: "), "n_name", F.lit("\nPuntaje: 1"))).when(k == 1, F.concat(F.lit("Final: "), "n_name", F.lit("\n\nmore"))).when(k == 2, F.concat(F.lit("first\n\nlast "), "n_name", F.lit("\n  \n"))).otherwise("")
    return table(spark, sf_dir, "nation").select("n_nationkey", parsing.after_marker(raw, ["Traduccion final:", "Final:"], ["Razonamiento:", "Analisis:", "Puntaje:", "\n\n"]).alias("translation"))


@query("x64_teacher_answers", f"SELECT conv_id, turn, 'why ' || turn AS trace, md5(trim({S.norm('text')})) AS digest FROM conversations")
def x64(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = T.normalize_space(F.col("text"))
    quoted = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"'), norm, F.lit('"'))).otherwise(norm)
    raw = F.concat(F.lit("<think> why "), F.col("turn").cast("string"), F.lit(" </think>\nNormalized: "), quoted, F.lit("\n\nnote"))
    got = table(spark, sf_dir, "conversations").select("conv_id", "turn", parsing.teacher_answer(raw).alias("a"))
    return got.select("conv_id", "turn", "a.trace", F.md5(F.col("a.answer").cast("binary")).alias("digest"))


@query("x65_last_line_value", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS value FROM orders")
def x65(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("none here")).otherwise(F.concat(F.lit("Final: draft\ntext\n  FINAL : "), "o_orderstatus", F.lit("\n")))
    return table(spark, sf_dir, "orders").select("o_orderkey", parsing.last_line_value(raw, "final").alias("value"))


@query(
    "x67_labels",
    "SELECT severity, rationale, count(*) AS n, round(avg(score), 4) AS score FROM (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN value >= 50 THEN 'none' ELSE 'major' END AS severity, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS rationale, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value, 2) / 100 END AS score FROM events) GROUP BY ALL",
)
def x67(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels in JSON, one in seven broken, read tolerantly and counted (the histogram of rationales and severities)."""
    e = table(spark, sf_dir, "events")
    made = F.to_json(F.struct((F.round("value", 2) / 100).alias("score"), F.when(F.col("value") >= 50, "none").otherwise("major").alias("severity"), F.col("event_type").alias("rationale")))
    got = e.select(parsing.labelled(F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(made)).alias("l"))
    return diagnostics.label_histogram(got.select("l.*")).withColumn("score", F.round("score", 4))


@query("x68_secrets", "SELECT event_id FROM events WHERE event_id % 9 = 4 OR event_id % 9 = 5")
def x68(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = F.struct(F.col("props"), F.array(F.when(F.col("event_id") % 9 == 4, F.lit("Bearer abc")).when(F.col("event_id") % 9 == 5, F.lit("my api_key")).otherwise(F.lit("plain"))).alias("notes"))
    return table(spark, sf_dir, "events").filter(parsing.has_secret(nested)).select("event_id")


@query("x69_winners", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'B' ELSE NULL END AS winner FROM events")
def x69(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    raw = F.when(k == 0, F.lit('sure: {"winner": "a"}')).when(k == 1, F.lit("Candidate b is better")).when(k == 2, F.lit('{"winner": "B", "why": "A is longer"}')).otherwise(F.lit("neither"))
    return table(spark, sf_dir, "events").select("event_id", parsing.winner(raw).alias("winner"))
