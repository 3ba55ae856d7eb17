import pytest
from pyspark.sql import functions as F

from corpuslab.functions import metrics as M
from corpuslab.functions import parsing
from corpuslab.functions import text as T


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [("  a  b\x1cc\u0085 ", "a b c"), (None, ""), ("", ""), ("ñ  ó", "ñ ó")])
def test_normalize_space(spark, raw, want):
    assert one(spark, T.normalize_space(F.col("a")), a=raw) == want


def test_pair_text_closes_gaps_before_marks_and_after_openers(spark):
    assert one(spark, T.normalize_pair_text(F.col("a")), a="¿  Hola , tú ?") == "¿Hola, tú?"


def test_tokens(spark):
    assert one(spark, T.metric_tokens(F.col("a")), a="Ñuqa k'a 12 Él") == ["ñuqa", "k", "a", "12", "él"]
    assert one(spark, T.pair_words(F.col("a")), a="Bien-venido, Él") == ["bien-venido", "él"]


def test_token_f1_counts_multiplicities(spark):
    h, r = T.metric_tokens(F.col("a")), T.metric_tokens(F.col("b"))
    assert one(spark, M.token_f1(h, r), a="a a b", b="a c") == pytest.approx(0.4)
    assert one(spark, M.token_f1(h, r), a="", b="a") == 0.0
    assert one(spark, M.token_precision(h, r), a="a a b", b="a c") == pytest.approx(1 / 3)


def test_copying_and_leakage(spark):
    h, s = T.metric_tokens(F.col("a")), T.metric_tokens(F.col("b"))
    assert one(spark, M.source_copy_ratio(h, s), a="la casa wasi", b="casa grande") == pytest.approx(0.5)
    assert one(spark, M.leakage_penalty(h), a="la wasi", b="") == pytest.approx(0.25)
    assert one(spark, M.exact_copy(F.col("a"), F.col("b")), a=" Hola  a", b="hola A") is True
    assert one(spark, M.exact_copy(F.col("a"), F.col("b")), a="", b="") is False


def test_repetition_needs_six_tokens(spark):
    assert one(spark, M.repetition_penalty(T.metric_tokens(F.col("a"))), a="x x x x x") == 0.0
    assert one(spark, M.repetition_penalty(T.metric_tokens(F.col("a"))), a="x x x x x x") == pytest.approx(0.2)


def test_artifacts_are_capped(spark):
    assert one(spark, M.artifact_penalty(F.col("a")), a="<think> assistant x") == pytest.approx(0.36)
    assert one(spark, M.artifact_penalty(F.col("a")), a="<think><think><think><think>") == pytest.approx(0.6)


def test_better_hypotheses_score_higher(spark):
    near = one(spark, M.fast_chrf(F.col("a"), F.col("b")), a="allin punchaw", b="allin punchay")
    far = one(spark, M.fast_chrf(F.col("a"), F.col("b")), a="mana", b="allin punchay")
    same = one(spark, M.fast_chrf(F.col("a"), F.col("b")), a="allin", b="Allin")
    assert same == pytest.approx(1.0) and 1 > near > far >= 0


def test_entities(spark):
    assert sorted(one(spark, M.entities(F.col("a")), a="El 3,5 de Mayo en Lima y Lima")) == ["3,5", "Lima", "Mayo"]
    assert one(spark, M.entity_preservation(F.col("a"), F.col("b")), a="lima 7", b="Lima 3") == pytest.approx(0.5)
    assert one(spark, M.entity_preservation(F.col("a"), F.col("b")), a="x", b="nada") == 1.0


def test_structured_answers(spark):
    text = "Análisis: bien. Traducción final: Allin  kay. Autoevaluación: sí. Puntaje: \\boxed{0.75}"
    assert one(spark, parsing.final_answer(F.col("a")), a=text) == "Allin kay."
    assert one(spark, parsing.stated_score(F.col("a")), a=text) == 0.75
    assert one(spark, parsing.final_answer(F.col("a")), a="plain") == "plain"
    assert one(spark, parsing.stated_score(F.col("a")), a="plain") is None
    assert one(spark, parsing.winner(F.col("a")), a='so {"winner": "b"}') == "B"
    assert one(spark, parsing.winner(F.col("a")), a="I prefer a") == "A"
    assert one(spark, parsing.winner(F.col("a")), a="none") is None
    assert one(spark, parsing.without_reasoning(F.col("a")), a="<think>x\ny</think> z") == "z"
    assert one(spark, parsing.last_line_value(F.col("a"), "Final"), a="Final: a\nx\nfinal: b") == "b"
