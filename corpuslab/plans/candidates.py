"""Queries over candidate pools: the turns of a conversation, with its first turn as source and its last as reference."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import pools as P
from . import sqltext as S
from .registry import query, table

_SIG = S.pool_signals()
_KEY = ["conv_id"]
_F1 = """ov AS (SELECT a.conv_id, a.candidate_index, b.candidate_index AS peer, a.prediction <> b.prediction AS differs, len(a.tokens) AS n, len(b.tokens) AS m FROM sig a JOIN sig b ON a.conv_id = b.conv_id),
cnt AS (SELECT conv_id, candidate_index, t, count(*) AS c FROM (SELECT conv_id, candidate_index, unnest(tokens) AS t FROM sig) GROUP BY ALL),
com AS (SELECT a.conv_id, a.candidate_index, b.candidate_index AS peer, sum(least(a.c, b.c)) AS common FROM cnt a JOIN cnt b ON a.conv_id = b.conv_id AND a.t = b.t GROUP BY ALL),
pr AS (SELECT ov.*, CASE WHEN n > 0 AND m > 0 THEN 2.0 * coalesce(common, 0) / (n + m) ELSE 0 END AS f1, CASE WHEN n > 0 AND m > 0 THEN coalesce(common, 0) * 1.0 / n ELSE 0 END AS prec,
  max(differs::INT) OVER (PARTITION BY ov.conv_id, ov.candidate_index) AS any_differs FROM ov LEFT JOIN com ON ov.conv_id = com.conv_id AND ov.candidate_index = com.candidate_index AND ov.peer = com.peer),
lg AS (@GRAMS@), lc AS (SELECT conv_id, candidate_index, ord, g, count(*) AS c FROM lg GROUP BY ALL), lt AS (SELECT conv_id, candidate_index, ord, sum(c) AS total FROM lc GROUP BY ALL),
lm AS (SELECT a.conv_id, a.candidate_index, b.candidate_index AS peer, a.ord, sum(least(a.c, b.c)) AS m FROM lc a JOIN lc b ON a.conv_id = b.conv_id AND a.ord = b.ord AND a.g = b.g GROUP BY ALL),
ch AS (SELECT a.conv_id, a.candidate_index, b.candidate_index AS peer, @F@ AS chrf FROM lt a JOIN lt b ON a.conv_id = b.conv_id AND a.ord = b.ord LEFT JOIN lm ON lm.conv_id = a.conv_id AND lm.candidate_index = a.candidate_index AND lm.peer = b.candidate_index AND lm.ord = a.ord GROUP BY ALL),
ut AS (SELECT pr.conv_id, pr.candidate_index, 0.55 * avg(coalesce(chrf, 0)) + 0.30 * avg(f1) + 0.15 * avg(prec) AS utility, avg(coalesce(chrf, 0)) AS chrf, avg(f1) AS f1, avg(prec) AS precision, count(*) AS peers FROM pr LEFT JOIN ch ON ch.conv_id = pr.conv_id AND ch.candidate_index = pr.candidate_index AND ch.peer = pr.peer WHERE differs OR any_differs = 0 GROUP BY ALL),
med AS (SELECT *, greatest(0.0, 1.0 - abs(ln(greatest(n_tokens, 1) / greatest(median(greatest(n_tokens, 1)) OVER (PARTITION BY conv_id), 1.0)))) AS length_consensus FROM sig),
mbr AS (SELECT med.*, utility, chrf, f1, precision, peers, utility + 0.08 * length_consensus - 0.28 * copied - 0.32 * leak - 0.30 * artifacts - 0.14 * repeated - CASE WHEN exact THEN 0.30 ELSE 0 END AS raw FROM med JOIN ut ON med.conv_id = ut.conv_id AND med.candidate_index = ut.candidate_index),
scored AS (SELECT *, round(raw, 6) AS mbr_score FROM mbr)"""
_F1 = _F1.replace("@GRAMS@", S.letter_grams("conv_id, candidate_index", "prediction", "sig", "p")).replace("@F@", S.f_score("a.total", "b.total", "coalesce(m, 0)"))
_MBR = f"{_SIG}, {_F1}"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prediction"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, source, reference) of each conversation."""
    return _turns(spark, sf_dir).groupBy("conv_id").agg(F.min_by("prediction", "turn").alias("source"), F.max_by("prediction", "turn").alias("reference"))


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.indexed(_turns(spark, sf_dir), _KEY, ["turn"]).join(sources(spark, sf_dir), "conv_id").drop("turn")


def scored(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The pool's keys with the signals that mbr_score takes, utility and mbr_score, all in one partitioning by group.
    `more` are other columns of the pool or signals(); each passes through Python."""
    taken = ("length_consensus", "copied", "leak", "artifacts", "repeated", "exact")
    s = P.with_utilities(P.length_consensus(P.signals(pool(spark, sf_dir)), _KEY), _KEY, keep=[*_KEY, "candidate_index", *taken, *more])
    return s.withColumn("mbr_score", F.round(M.mbr_score(*(F.col(c) for c in ("utility", *taken))), 6))


def _index(name: str = "candidate_index"):
    return F.col(name).cast("long").alias(name)


@query("x34_candidate_signals", f"{_SIG} SELECT conv_id, candidate_index, round(copied, 6) AS copied, round(leak, 6) AS leak, round(artifacts, 6) AS artifacts, round(repeated, 6) AS repeated, exact, n_tokens FROM sig")
def x34(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.signals(pool(spark, sf_dir))
    return s.select("conv_id", _index(), *(F.round(c, 6).alias(c) for c in ("copied", "leak", "artifacts", "repeated")), "exact", F.col("n_tokens").cast("long").alias("n_tokens"))


@query(
    "x30_token_metrics",
    f"""{_SIG}, c1 AS (SELECT conv_id, candidate_index, t, count(*) AS c FROM (SELECT conv_id, candidate_index, unnest(tokens) AS t FROM sig) GROUP BY ALL),
    c2 AS (SELECT conv_id, candidate_index, t, count(*) AS c FROM (SELECT conv_id, candidate_index, unnest(reference_tokens) AS t FROM sig) GROUP BY ALL),
    o AS (SELECT c1.conv_id, c1.candidate_index, sum(least(c1.c, c2.c)) AS common FROM c1 JOIN c2 ON c1.conv_id = c2.conv_id AND c1.candidate_index = c2.candidate_index AND c1.t = c2.t GROUP BY ALL)
    SELECT s.conv_id, s.candidate_index, round(CASE WHEN len(tokens) > 0 AND len(reference_tokens) > 0 THEN 2.0 * coalesce(common, 0) / (len(tokens) + len(reference_tokens)) ELSE 0 END, 6) AS token_f1,
      round(CASE WHEN len(tokens) > 0 AND len(reference_tokens) > 0 THEN coalesce(common, 0) * 1.0 / len(tokens) ELSE 0 END, 6) AS token_precision,
      round(greatest(0.0, 1.0 - abs(ln(greatest({S.n_words('prediction')}, 1) * 1.0 / greatest({S.n_words('reference')}, 1)))), 6) AS length_score,
      round(CASE WHEN len(tokens) = 0 AND len(reference_tokens) = 0 THEN 1.0 ELSE len(list_intersect(tokens, reference_tokens)) * 1.0 / len(list_distinct(list_concat(tokens, reference_tokens))) END, 6) AS jaccard
    FROM sig s LEFT JOIN o ON s.conv_id = o.conv_id AND s.candidate_index = o.candidate_index""",
)
def x30(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.signals(pool(spark, sf_dir)).withColumn("reference_tokens", T.metric_tokens(F.col("reference")))
    h, r = F.col("tokens"), F.col("reference_tokens")
    values = {"token_f1": M.token_f1(h, r), "token_precision": M.token_precision(h, r), "length_score": M.length_ratio_score(F.col("prediction"), F.col("reference")), "jaccard": T.jaccard(h, r)}
    return s.select("conv_id", _index(), *(F.round(v, 6).alias(k) for k, v in values.items()))


@cache
def _grams(kind: str, sizes: range, source: str) -> str:
    """SQL for the n-gram counts of predictions and references, n in sizes."""
    parts = []
    for side in ("prediction", "reference"):
        for n in sizes:
            if kind == "char":
                body = f"lower({S.norm(side)})"
                items = f"CASE WHEN length({body}) = 0 THEN [] WHEN length({body}) < {n} THEN [{body}] ELSE list_transform(range(1, length({body}) - {n} + 2), lambda i: substring({body}, i, {n})) END"
            else:
                body = "tokens" if side == "prediction" else "reference_tokens"
                items = f"list_transform(range(1, len({body}) - {n} + 2), lambda i: array_to_string({body}[i : i + {n - 1}], ' '))"
            parts.append(f"SELECT conv_id, candidate_index, '{side}' AS side, {n} AS n, unnest({items}) AS g FROM {source}")
    return " UNION ALL ".join(parts)


_NGRAM = """cnt AS (SELECT conv_id, candidate_index, side, n, g, count(*) AS c FROM grams GROUP BY ALL), tot AS (SELECT conv_id, candidate_index, side, n, sum(c) AS total FROM cnt GROUP BY ALL),
com AS (SELECT a.conv_id, a.candidate_index, a.n, sum(least(a.c, b.c)) AS common FROM cnt a JOIN cnt b ON a.conv_id = b.conv_id AND a.candidate_index = b.candidate_index AND a.n = b.n AND a.g = b.g AND a.side = 'prediction' AND b.side = 'reference' GROUP BY ALL),
x AS (SELECT s.conv_id, s.candidate_index, k.n, coalesce(common, 0) AS common, h.total AS ht, r.total AS rt FROM sig s CROSS JOIN (SELECT unnest({ns}) AS n) k LEFT JOIN com ON com.conv_id = s.conv_id AND com.candidate_index = s.candidate_index AND com.n = k.n
  LEFT JOIN tot h ON h.conv_id = s.conv_id AND h.candidate_index = s.candidate_index AND h.n = k.n AND h.side = 'prediction' LEFT JOIN tot r ON r.conv_id = s.conv_id AND r.candidate_index = s.candidate_index AND r.n = k.n AND r.side = 'reference')"""


@query(
    "x50_fast_chrf",
    f"{_SIG}, grams AS ({_grams('char', range(1, 7), 'sig')}), {_NGRAM.format(ns=list(range(1, 7)))} SELECT conv_id, candidate_index, round(avg(CASE WHEN common > 0 THEN 5.0 * (common / ht) * (common / rt) / (4.0 * (common / ht) + common / rt) ELSE 0 END), 6) AS chrf FROM x GROUP BY ALL",
)
def x50(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("conv_id", _index(), F.round(M.fast_chrf(F.col("prediction"), F.col("reference")), 6).alias("chrf"))


@query(
    "x50_fast_bleu",
    f"{_SIG}, grams AS ({_grams('word', range(1, 5), 'sig')}), {_NGRAM.format(ns=list(range(1, 5)))} SELECT x.conv_id, x.candidate_index, round(avg(CASE WHEN ht > 0 THEN common * 1.0 / ht ELSE 0 END) * any_value(CASE WHEN len(tokens) = 0 OR len(reference_tokens) = 0 THEN 0 ELSE least(1.0, len(tokens) * 1.0 / len(reference_tokens)) END), 6) AS bleu FROM x JOIN sig s ON x.conv_id = s.conv_id AND x.candidate_index = s.candidate_index GROUP BY ALL",
)
def x50b(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.signals(pool(spark, sf_dir)).withColumn("reference_tokens", T.metric_tokens(F.col("reference")))
    return s.select("conv_id", _index(), F.round(M.fast_bleu(F.col("tokens"), F.col("reference_tokens")), 6).alias("bleu"))


@query("j9_mbr_scores", f"{_MBR} SELECT conv_id, candidate_index, peers, round(utility, 6) AS utility, round(length_consensus, 6) AS length_consensus, mbr_score FROM scored")
def j9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("conv_id", _index(), "peers", F.round("utility", 6).alias("utility"), F.round("length_consensus", 6).alias("length_consensus"), "mbr_score")


@query("w2_best_candidate", f"{_MBR} SELECT conv_id, candidate_index, mbr_score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index) AS r FROM scored) WHERE r = 1")
def w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.best(scored(spark, sf_dir), _KEY, "mbr_score").select("conv_id", _index(), "mbr_score")


@query(
    "w4_margin",
    f"{_MBR}, r AS (SELECT *, row_number() OVER w AS r, lead(mbr_score) OVER w AS nxt, count(*) OVER (PARTITION BY conv_id) AS n FROM scored WINDOW w AS (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index)) SELECT conv_id, candidate_index, mbr_score, round(greatest(0.0, coalesce(mbr_score - nxt, 0.0)), 6) AS margin, n AS candidate_count FROM r WHERE r = 1",
)
def w4(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.with_margin(scored(spark, sf_dir), _KEY, "mbr_score")
    return m.select("conv_id", _index(), "mbr_score", F.round("margin", 6).alias("margin"), "candidate_count")


@query(
    "p10_pseudo_labels",
    f"{_MBR}, r AS (SELECT *, row_number() OVER w AS r, lead(mbr_score) OVER w AS nxt, count(*) OVER (PARTITION BY conv_id) AS n FROM scored WINDOW w AS (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index)) SELECT conv_id, candidate_index FROM r WHERE r = 1 AND n >= 3 AND mbr_score >= 0.1 AND coalesce(mbr_score - nxt, 0) >= 0.002 AND utility >= 0.12 AND copied <= 0.6 AND leak <= 0.2 AND artifacts <= 0.1 AND NOT exact",
)
def p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.with_margin(scored(spark, sf_dir), _KEY, "mbr_score")
    sure = (F.col("candidate_count") >= 3) & (F.col("mbr_score") >= 0.1) & (F.col("utility") >= 0.12) & (F.col("margin") >= 0.002) & (F.col("copied") <= 0.6) & (F.col("leak") <= 0.2) & (F.col("artifacts") <= 0.1) & ~F.col("exact")
    return m.filter(sure).select("conv_id", _index())


@query(
    "w5_feature_ranks",
    f"{_MBR} SELECT conv_id, candidate_index, round(1.0 - (row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index DESC) - 1) * 1.0 / greatest(1, count(*) OVER g - 1), 6) AS mbr_rank, round(mbr_score - max(mbr_score) OVER g, 6) AS gap_to_best, round(count(*) OVER (PARTITION BY conv_id, lower({S.norm('prediction')})) * 1.0 / count(*) OVER g, 6) AS duplicate_rate, round(candidate_index * 1.0 / greatest(1, count(*) OVER g - 1), 6) AS index_fraction FROM scored WINDOW g AS (PARTITION BY conv_id)",
)
def w5(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, g = scored(spark, sf_dir, "prediction"), W.partitionBy("conv_id")
    last = F.greatest(F.lit(1), F.count("*").over(g) - 1)
    values = {
        "mbr_rank": 1.0 - (F.row_number().over(g.orderBy(F.desc("mbr_score"), F.desc("candidate_index"))) - 1) / last,
        "gap_to_best": F.col("mbr_score") - F.max("mbr_score").over(g),
        "duplicate_rate": F.count("*").over(W.partitionBy("conv_id", F.lower(T.normalize_space(F.col("prediction"))))) / F.count("*").over(g),
        "index_fraction": F.col("candidate_index") / last,
    }
    return s.select("conv_id", _index(), *(F.round(v, 6).alias(k) for k, v in values.items()))


@query(
    "w8_preferences",
    f"{_MBR}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score, candidate_index) AS z FROM scored) SELECT x.conv_id, x.candidate_index AS chosen_index, y.candidate_index AS rejected_index, round(x.mbr_score - y.mbr_score, 6) AS score_margin FROM r x JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY z) AS k FROM r WHERE a > 1) y ON x.conv_id = y.conv_id AND x.a = 1 AND y.k = 1 WHERE x.mbr_score - y.mbr_score >= 0.01",
)
def w8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.preferences(scored(spark, sf_dir), _KEY, "mbr_score", 0.01, "worst")
    return p.select("conv_id", _index("chosen_index"), _index("rejected_index"), F.round("score_margin", 6).alias("score_margin"))


@query(
    "j10_ordered_pairs",
    f"{_MBR} SELECT a.conv_id, a.candidate_index AS first_index, b.candidate_index AS second_index, CASE WHEN a.mbr_score > b.mbr_score THEN 'A' ELSE 'B' END AS winner FROM scored a JOIN scored b ON a.conv_id = b.conv_id AND a.candidate_index < b.candidate_index WHERE abs(a.mbr_score - b.mbr_score) >= 0.02 AND lower({S.norm('a.prediction')}) <> lower({S.norm('b.prediction')})",
)
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row meets its group's indices, scores and numbers of texts in one array; a join of the rows with themselves would score all twice in one stage."""
    g = W.partitionBy("conv_id")
    s = scored(spark, sf_dir, "prediction").withColumn("p", F.lower(T.normalize_space(F.col("prediction"))))
    s = s.select("conv_id", "candidate_index", "mbr_score", F.when(F.col("p").isNotNull(), F.dense_rank().over(g.orderBy("p"))).alias("p"))
    s = s.withColumn("others", F.collect_list(F.struct("candidate_index", "mbr_score", "p")).over(g))
    met = F.filter("others", lambda o: (F.col("candidate_index") < o["candidate_index"]) & (F.abs(F.col("mbr_score") - o["mbr_score"]) >= 0.02) & (F.col("p") != o["p"]))
    j = s.select("conv_id", "candidate_index", "mbr_score", F.explode(met).alias("o"))
    return j.select("conv_id", F.col("candidate_index").cast("long").alias("first_index"), F.col("o.candidate_index").cast("long").alias("second_index"), F.when(F.col("mbr_score") > F.col("o.mbr_score"), "A").otherwise("B").alias("winner"))


@query("a7_pool_stats", f"{_SIG} SELECT count(*) AS n_groups, sum(n)::BIGINT AS n_candidates, round(avg(n), 6) AS mean_size, min(n) AS least_size, max(n) AS most_size FROM (SELECT conv_id, count(*) AS n FROM sig GROUP BY conv_id)")
def a7(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_candidates"), F.round(F.avg("n"), 6).alias("mean_size"), F.min("n").alias("least_size"), F.max("n").alias("most_size"))


@query(
    "a9_group_zscores",
    f"{_SIG}, z AS (SELECT conv_id, candidate_index, copied, n_tokens, stddev_pop(copied) OVER g AS sc, avg(copied) OVER g AS mc, stddev_pop(n_tokens) OVER g AS sn, avg(n_tokens) OVER g AS mn FROM sig WINDOW g AS (PARTITION BY conv_id)) SELECT conv_id, candidate_index, round((copied - mc) / CASE WHEN sc <= 1e-9 THEN 1 ELSE sc END, 5) AS copied_z, round((n_tokens - mn) / CASE WHEN sn <= 1e-9 THEN 1 ELSE sn END, 5) AS n_tokens_z FROM z",
)
def a9(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = P.zscored(P.signals(pool(spark, sf_dir)), _KEY, ["copied", "n_tokens"])
    return z.select("conv_id", _index(), F.round("copied_z", 5).alias("copied_z"), F.round("n_tokens_z", 5).alias("n_tokens_z"))


@query(
    "d4_merged_pools",
    f"""{_SIG}, u AS (SELECT 0 AS pool, conv_id, candidate_index, prediction FROM sig UNION ALL SELECT 1, p.conv_id, row_number() OVER (PARTITION BY p.conv_id ORDER BY turn) - 1, replace(text, 'e', 'i') FROM conversations p WHERE role = 'assistant'),
    f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lower({S.norm('prediction')}) ORDER BY pool, candidate_index) AS n FROM u)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pool, candidate_index) - 1 AS candidate_index, pool, md5(prediction) AS digest FROM f WHERE n = 1""",
)
def d4(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pool(spark, sf_dir).select("conv_id", "candidate_index", "prediction")
    b = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.replace("text", F.lit("e"), F.lit("i")).alias("prediction"))
    m = P.merged([a, P.indexed(b, _KEY, ["turn"]).drop("turn")], _KEY)
    return m.select("conv_id", _index(), F.col("pool"), F.md5(F.col("prediction").cast("binary")).alias("digest"))


@query("w17_soft_targets", f"{_MBR}, e AS (SELECT conv_id, candidate_index, exp(least(60, greatest(-60, (mbr_score - max(mbr_score) OVER (PARTITION BY conv_id)) / 0.1))) AS e FROM scored) SELECT conv_id, candidate_index, round(e / sum(e) OVER (PARTITION BY conv_id), 5) AS soft FROM e")
def w17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.softmax(scored(spark, sf_dir), _KEY, "mbr_score", 0.1).select("conv_id", _index(), F.round("soft", 5).alias("soft"))
