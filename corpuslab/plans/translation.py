"""Queries for the translation metrics: character F-score, n-gram precision, edit rate, and corpus scores from summed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import edit_rate, overlap
from ..functions import metrics as M
from ..operators import corpus_scores
from . import sqltext as S
from .candidates import pool
from .registry import query

_KEYS = "conv_id, candidate_index"
_BOTH = f"{S.letter_grams(_KEYS, 'prediction', 'pool', 'h')} UNION ALL {S.letter_grams(_KEYS, 'reference', 'pool', 'r')}"
_WORDS = " UNION ALL ".join(
    f"SELECT {_KEYS}, '{side}' AS side, {n} AS ord, unnest(list_transform(range(1, len(t) - {n} + 2), lambda i: array_to_string(t[i : i + {n - 1}], ' '))) AS g FROM (SELECT {_KEYS}, {S.evaluation_tokens(c)} AS t FROM pool)"
    for side, c in (("h", "prediction"), ("r", "reference"))
    for n in range(1, 5)
)


def _stats(grams: str, orders: int) -> str:
    """CTEs up to st: for each row and order the n-grams of the hypothesis, of the reference and in common."""
    return f"""WITH {S.POOL}, g AS ({grams}), c AS (SELECT {_KEYS}, side, ord, g, count(*) AS c FROM g GROUP BY ALL), t AS (SELECT {_KEYS}, ord, coalesce(sum(c) FILTER (side = 'h'), 0)::BIGINT AS h, coalesce(sum(c) FILTER (side = 'r'), 0)::BIGINT AS r FROM c GROUP BY ALL),
    m AS (SELECT a.conv_id, a.candidate_index, a.ord, sum(least(a.c, b.c))::BIGINT AS m FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.candidate_index = b.candidate_index AND a.ord = b.ord AND a.g = b.g AND a.side = 'h' AND b.side = 'r' GROUP BY ALL),
    st AS (SELECT p.conv_id, p.candidate_index, o.ord, coalesce(h, 0) AS h, coalesce(r, 0) AS r, coalesce(m, 0) AS m FROM pool p CROSS JOIN (SELECT unnest(range(1, {orders + 1})) AS ord) o LEFT JOIN t ON t.conv_id = p.conv_id AND t.candidate_index = p.candidate_index AND t.ord = o.ord LEFT JOIN m ON m.conv_id = p.conv_id AND m.candidate_index = p.candidate_index AND m.ord = o.ord)"""


_BLEU = """CASE WHEN max(m) = 0 OR max(h) FILTER (ord = 1) = 0 THEN 0 ELSE exp(least(0.0, 1.0 - max(r) FILTER (ord = 1) * 1.0 / max(h) FILTER (ord = 1)))
  * exp(sum(CASE WHEN m > 0 THEN ln(m * 1.0 / h) ELSE -ln(pow(2.0, misses) * h) END) FILTER (h > 0) / count(*) FILTER (h > 0)) END"""


CHRF_ROWS = f"{_stats(_BOTH, 8)} SELECT {_KEYS}, {S.f_score('h', 'r', 'm')} AS chrf FROM st GROUP BY ALL"
BLEU_ROWS = f"{_stats(_WORDS, 4)}, w AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY {_KEYS} ORDER BY ord) AS misses FROM st) SELECT {_KEYS}, {_BLEU} AS bleu FROM w GROUP BY ALL"


@query("x47_chrf", f"{_stats(_BOTH, 8)} SELECT {_KEYS}, round({S.f_score('h', 'r', 'm')}, 6) AS chrf, round({S.f_score('h', 'r', 'm', 'ord <= 6')}, 6) AS chrf_letters FROM st GROUP BY ALL")
def x47(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir).withColumn("s", overlap.chrf_stats(F.col("prediction"), F.col("reference")))
    scores = {"chrf": overlap.chrf_of(F.col("s")), "chrf_letters": overlap.chrf_of(F.col("s"), words=False)}
    return p.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), *(F.round(v, 6).alias(k) for k, v in scores.items()))


@query("x48_bleu", f"{_stats(_WORDS, 4)}, w AS (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY {_KEYS} ORDER BY ord) AS misses FROM st) SELECT {_KEYS}, round({_BLEU}, 6) AS bleu FROM w GROUP BY ALL")
def x48(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir)
    return p.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), F.round(M.sentence_bleu(F.col("prediction"), F.col("reference")), 6).alias("bleu"))


@query("x49_edit_rate")
def x49(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits, shifts of phrases among them, which SQL can't search for."""
    p = pool(spark, sf_dir).withColumn("s", edit_rate.ter_stats(F.col("prediction"), F.col("reference")))
    return p.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), F.get("s", F.lit(0)).alias("edits"), F.get("s", F.lit(1)).alias("reference_words"), F.round(edit_rate.ter_of(F.col("s")), 6).alias("ter"))



@query(
    "a4_corpus_scores",
    f"""SELECT part, round(any_value(c.chrf), 4) AS chrf, round(any_value(c.chrf_letters), 4) AS chrf_letters, round(any_value(b.bleu), 4) AS bleu, any_value(s.n) AS n, round(any_value(s.leak), 4) AS leak, round(any_value(s.artifacts), 4) AS artifacts, round(any_value(s.words), 4) AS words FROM
    (SELECT part, 100 * {S.f_score('h', 'r', 'm')} AS chrf, 100 * {S.f_score('h', 'r', 'm', 'ord <= 6')} AS chrf_letters FROM ({_stats(_BOTH, 8)} SELECT conv_id % 3 AS part, ord, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM st GROUP BY ALL) GROUP BY part) c
    JOIN (SELECT part, 100 * {_BLEU} AS bleu FROM (SELECT *, sum((m = 0)::INT) OVER (PARTITION BY part ORDER BY ord) AS misses FROM ({_stats(_WORDS, 4)} SELECT conv_id % 3 AS part, ord, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM st GROUP BY ALL)) GROUP BY part) b USING (part)
    JOIN (WITH {S.POOL} SELECT conv_id % 3 AS part, count(*) AS n, 100 * avg({S.leak(S.tokens('prediction'))}) AS leak, 100 * avg({S.artifacts('prediction')}) AS artifacts, avg({S.n_words('prediction')}) AS words FROM pool GROUP BY ALL) s USING (part) GROUP BY part""",
)
def a4(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = corpus_scores.corpus_scores(pool(spark, sf_dir).withColumn("part", F.col("conv_id") % 3), ["part"], edit_rates=False)
    return scores.select("part", "n", *(F.round(c, 4).alias(c) for c in ("chrf", "chrf_letters", "bleu", "leak", "artifacts")), F.round("prediction_words", 4).alias("words"))
