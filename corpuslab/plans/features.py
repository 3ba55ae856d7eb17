"""Queries for features of candidates: dense rows, terminology, origins, sparse rows, consensus signals and ensembles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as X
from ..operators import pools as P
from ..operators import retrieval
from . import sqltext as S
from .candidates import _MBR, pool, scored, sources
from .registry import query, table

_KEYS = "conv_id, candidate_index"
# the forty most frequent long words of the first turns, each translated by the next one
_TERMS = f"""tc AS (SELECT w, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS w FROM conversations WHERE turn = 0) WHERE length(w) >= 4 GROUP BY w), tr AS (SELECT w, row_number() OVER (ORDER BY n DESC, w) AS r FROM tc QUALIFY r <= 40),
term AS (SELECT a.w AS source_term, b.w AS target_text, row_number() OVER (ORDER BY length(a.w) DESC, a.w, b.w) AS rank FROM tr a JOIN tr b ON b.r = a.r % 40 + 1)"""
_CHOSEN = f"""{_TERMS}, hit AS (SELECT {_KEYS}, source_term, target_text, rank, row_number() OVER (PARTITION BY {_KEYS}, lower(target_text) ORDER BY rank) AS k FROM sig JOIN term ON list_contains(regexp_extract_all(lower({S.norm('source')}), '[\\p{{L}}\\p{{N}}_]+'), source_term)),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {_KEYS} ORDER BY rank) AS p FROM hit WHERE k = 1) WHERE p <= 4)"""


def _stop(t: str) -> str:
    return f"list_filter({t}, lambda x: length(x) >= 4 AND NOT list_contains({S.listing(T.LEAKAGE_WORDS)}, x))"


_FEATURES = f"""{_MBR}, {_CHOSEN}, tf AS (SELECT s.conv_id, s.candidate_index, avg(cov::INT) AS coverage, sum(CASE WHEN root AND NOT cov AND leaked THEN 1 ELSE 0 END) * 1.0 / greatest(1, sum(root::INT)) AS leakage FROM
  (SELECT k.conv_id, k.candidate_index, length(source_term) >= 4 AND NOT list_contains({S.listing(T.LEAKAGE_WORDS)}, source_term) AS root, NOT list_contains({S.listing(T.LEAKAGE_WORDS)}, target_text) AND len(list_filter(tokens, lambda t: starts_with(t, target_text))) > 0 AS cov, len(list_filter(tokens, lambda t: starts_with(t, source_term))) > 0 AS leaked FROM pick k JOIN sig USING (conv_id, candidate_index)) s GROUP BY ALL),
ft AS (SELECT s.*, count(*) OVER g AS n, greatest(1, count(*) OVER g - 1) AS last, row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index DESC) - 1 AS place, max(mbr_score) OVER g AS best, count(*) OVER (PARTITION BY conv_id, lower({S.norm('prediction')})) AS same,
  {_stop('source_tokens')} AS roots, ['data/qwen3.5-9b/x', 'a/qwen35-4B_full', 'run/current', 'zz', ''][1 + candidate_index % 5] AS path FROM scored s WINDOW g AS (PARTITION BY conv_id)),
fe AS (SELECT ft.conv_id, ft.candidate_index, mbr_score, 1.0 - place * 1.0 / last AS mbr_rank, mbr_score - best AS mbr_gap_to_best, same * 1.0 / n AS duplicate_rate, length_consensus, copied AS source_copy_ratio, CASE WHEN len(roots) = 0 OR len(tokens) = 0 THEN 0 ELSE len(list_filter(roots, lambda r: len(list_filter(tokens, lambda t: starts_with(t, r))) > 0)) * 1.0 / len(roots) END AS source_root_copy_ratio,
  leak AS spanish_leakage_penalty, artifacts AS chat_artifact_penalty, repeated AS repetition_penalty, exact::INT AS exact_source_copy, coalesce(coverage, 0) AS terminology_target_coverage, coalesce(leakage, 0) AS terminology_source_root_leakage, ft.candidate_index * 1.0 / last AS candidate_index_fraction, n_tokens * 1.0 AS target_token_count, n_tokens * 1.0 / greatest(1, len(source_tokens)) AS target_source_token_ratio, path
  FROM ft LEFT JOIN tf ON tf.conv_id = ft.conv_id AND tf.candidate_index = ft.candidate_index)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").filter("turn = 0").select(F.explode(T.metric_tokens(F.col("text"))).alias("w")).filter("char_length(w) >= 4")
    top = words.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(40).withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "w")))
    return top.select("r", F.col("w").alias("source_term")).join(top.select(F.when(F.col("r") == 1, 40).otherwise(F.col("r") - 1).alias("r"), F.col("w").alias("target_text")), "r").withColumnRenamed("r", "ord")


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with dense features; what only their conversation's source gives is made once for each and joins last."""
    rows, source = scored(spark, sf_dir, "prediction", "tokens", "n_tokens"), sources(spark, sf_dir)
    chosen = retrieval.select_terms(source, "conv_id", "source", retrieval.terminology(_terms(spark, sf_dir), 4), 4)
    chosen = chosen.groupBy("conv_id").agg(F.collect_list(F.struct("source_term", "target_text")).alias("terms"))
    facts = source.select("conv_id", T.metric_tokens(F.col("source")).alias("source_tokens")).join(chosen, "conv_id", "left")
    path = F.element_at(T.words_of("data/qwen3.5-9b/x", "a/qwen35-4B_full", "run/current", "zz", ""), (1 + F.col("candidate_index") % 5).cast("int"))
    rows = rows.withColumn("path", path).join(facts, "conv_id", "left")
    return X.dense_features(rows, ["conv_id"], "terms", "path")


@query("m1_feature_rows", f"{_FEATURES} SELECT {_KEYS}, {', '.join(f'round({c} + 1e-9, 5) AS {c}' for c in X.DENSE)} FROM fe")
def m1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return featured(spark, sf_dir).select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in X.DENSE))


@query("x57_terminology", f"{_FEATURES} SELECT {_KEYS}, round(terminology_target_coverage, 5) AS coverage, round(terminology_source_root_leakage, 5) AS leakage FROM fe WHERE terminology_target_coverage + terminology_source_root_leakage > 0")
def x57(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir).filter("terminology_target_coverage + terminology_source_root_leakage > 0")
    return f.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), F.round("terminology_target_coverage", 5).alias("coverage"), F.round("terminology_source_root_leakage", 5).alias("leakage"))


@query("x58_pool_origins", f"WITH {S.POOL} SELECT {_KEYS}, [0, 0, 1, 0, 0][1 + candidate_index % 5]::DOUBLE AS origin_current, [0, 1, 0, 0, 0][1 + candidate_index % 5]::DOUBLE AS origin_qwen35_4b_full, [1, 0, 0, 0, 0][1 + candidate_index % 5]::DOUBLE AS origin_qwen35_9b, [0, 0, 0, 1, 0][1 + candidate_index % 5]::DOUBLE AS origin_other, [0, 0, 0, 0, 1][1 + candidate_index % 5]::DOUBLE AS origin_unknown FROM pool")
def x58(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(T.words_of("data/qwen3.5-9b/x", "a/qwen35-4B_full", "run/current", "zz", ""), (1 + F.col("candidate_index") % 5).cast("int"))
    kind = X.origin(path)
    return pool(spark, sf_dir).select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), *((kind == o).cast("double").alias(f"origin_{o}") for o in X.ORIGINS))


def _text_tokens(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(lower({S.norm(c)}), '[\\p{{L}}\\p{{N}}_ʼ’''-]+'), lambda x: trim(x, '-''ʼ’')), lambda x: x <> '')"


@query(
    "m7_named_features",
    f"""WITH {S.POOL}, t AS (SELECT {_KEYS}, list_slice(list_filter({_text_tokens('prediction')}, lambda x: length(x) >= 2), 1, 80) AS t, list_slice(list_filter({_text_tokens('source')}, lambda x: length(x) >= 3 AND NOT list_contains({S.listing(T.LEAKAGE_WORDS)}, x)), 1, 24) AS s, ' ' || lower({S.norm('prediction')}) || ' ' AS p FROM pool),
    f AS (SELECT {_KEYS}, 'pool_origin:unknown' AS name, 1.0 AS v FROM t UNION ALL SELECT {_KEYS}, 'pool_origin_first:unknown', 1.0 FROM t WHERE candidate_index = 0 UNION ALL SELECT {_KEYS}, 'cand_tok:' || unnest(t), 1.0 FROM t UNION ALL SELECT {_KEYS}, 'pool_cand_tok:unknown:' || unnest(t), 0.5 FROM t
      UNION ALL SELECT {_KEYS}, 'cand_wng:' || unnest(t), 1.0 FROM t UNION ALL SELECT {_KEYS}, 'cand_wng:' || unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])), 1.0 FROM t UNION ALL SELECT {_KEYS}, 'src_tok:' || unnest(s), 0.5 FROM t
      UNION ALL {' UNION ALL '.join(f"SELECT {_KEYS}, 'cand_cng:' || unnest(list_filter(list_transform(range(1, length(p) - {n} + 2), lambda i: substring(p, i, {n})), lambda x: trim(x) <> '')), 0.25 FROM t" for n in (3, 4, 5))}
      UNION ALL SELECT {_KEYS}, 'src_cand:' || a || '->' || unnest(t), 1.0 FROM (SELECT {_KEYS}, unnest(s) AS a, t FROM t))
    SELECT {_KEYS}, count(*) AS n, round(sum(v), 3) AS total, max(name) AS last, round(sum(v * length(name)), 2) AS weighed FROM (SELECT {_KEYS}, name, sum(v) AS v FROM f GROUP BY ALL) GROUP BY ALL""",
)
def m7n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and weights before hashing, digested for each candidate."""
    named = X.named_arrays(pool(spark, sf_dir), ["conv_id", "candidate_index"])
    total = F.aggregate("values", F.lit(0.0), lambda n, v: n + v)
    weighed = F.aggregate(F.zip_with("names", "values", lambda k, v: v * F.char_length(k)), F.lit(0.0), lambda n, v: n + v)
    return named.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), F.size("names").cast("long").alias("n"), F.round(total, 3).alias("total"), F.array_max("names").alias("last"), F.round(weighed, 2).alias("weighed"))


_WEIGHTS = {"mbr_score": 0.5, "mbr_rank": 0.2, "length_consensus": 0.3, "duplicate_rate": -0.1, "candidate_index_fraction": -0.05, "target_token_count": 0.02}


@query(
    "m10_ensemble",
    f"""{_FEATURES}, z AS (SELECT {_KEYS}, {' + '.join(f"{w} * (({c}) - avg({c}) OVER g) / CASE WHEN stddev_pop({c}) OVER g <= 1e-9 THEN 1 ELSE stddev_pop({c}) OVER g END" for c, w in _WEIGHTS.items())} AS score FROM fe WINDOW g AS (PARTITION BY conv_id)) SELECT {_KEYS}, round(score, 4) AS score FROM z""",
)
def m10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = featured(spark, sf_dir)
    return f.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), F.round(X.ensemble(f, ["conv_id"], _WEIGHTS), 4).alias("score"))


@query(
    "m12_consensus_signals",
    f"""{S.pool_signals()}, pr AS (SELECT a.conv_id, a.candidate_index, b.candidate_index AS peer, a.tokens AS t, b.tokens AS p, max((a.prediction <> b.prediction)::INT) OVER (PARTITION BY a.conv_id, a.candidate_index) AS any_other, a.prediction <> b.prediction AS differs FROM sig a JOIN sig b USING (conv_id)),
    pk AS (SELECT *, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY {_KEYS}) AS n FROM pr WHERE differs OR (any_other = 0 AND candidate_index = peer) WINDOW w AS (PARTITION BY {_KEYS} ORDER BY peer)),
    sel AS (SELECT * FROM pk WHERE n <= 3 OR list_contains(list_transform(range(0, 3), lambda i: round_even(i * (n - 1) / 2.0, 0)::INT), place)),
    mt AS (SELECT {_KEYS}, {S.common('t', 'p')} AS common, len(t) AS nt, len(p) AS np, CASE WHEN len(t) = 0 AND len(p) = 0 THEN 1.0 ELSE len(list_intersect(t, p)) * 1.0 / len(list_distinct(list_concat(t, p))) END AS jac FROM sel)
    SELECT {_KEYS}, count(*) AS peers, round(avg(CASE WHEN nt > 0 AND np > 0 THEN 2.0 * common / (nt + np) ELSE 0 END), 5) AS pairwise_token_f1, round(avg(CASE WHEN nt > 0 AND np > 0 THEN common * 1.0 / nt ELSE 0 END), 5) AS pairwise_precision, round(avg(jac), 5) AS pairwise_jaccard FROM mt GROUP BY ALL""",
)
def m12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three peers each, evenly spaced; the n-gram scores among the signals are compared in x50."""
    s = X.consensus_signals(P.length_consensus(P.signals(pool(spark, sf_dir)), ["conv_id"]), ["conv_id"], most=3)
    g = s.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), F.least(F.lit(3), F.greatest(F.lit(1), F.col("n_peers"))).cast("long").alias("peers"), *(F.round(c, 5).alias(c) for c in ("pairwise_token_f1", "pairwise_precision", "pairwise_jaccard")))
    return g
