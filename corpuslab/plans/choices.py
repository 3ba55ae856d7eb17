"""Queries that choose, rank and judge: rewards, wins, negatives, unions with provenance, next actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import pairs as P
from ..operators import pools
from . import sqltext as S
from .candidates import _MBR, _SIG, pool, scored
from .corpus import pairs
from .registry import query, table


def _index(df: DataFrame, *more) -> DataFrame:
    return df.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), *more)


@query(
    "x33_overlong",
    f"WITH {S.POOL}, n AS (SELECT conv_id, candidate_index, {S.n_words('prediction')} AS n, greatest(1, {S.n_words('reference')}) AS m FROM pool) SELECT conv_id, candidate_index, round(CASE WHEN n = 0 THEN 0 ELSE least(0.7, CASE WHEN n >= 80 THEN least(0.45, 0.25 + 0.02 * (n - 80)) ELSE 0 END + CASE WHEN n * 1.0 / m >= 1.5 THEN least(0.45, 0.12 * (n * 1.0 / m - 0.5)) ELSE 0 END) END, 6) AS penalty FROM n",
)
def x33(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(pool(spark, sf_dir), F.round(M.overlong_penalty(F.col("prediction"), F.col("reference"), 80, 1.5), 6).alias("penalty"))


@query(
    "w16_copeland",
    f"""{_MBR}, p AS (SELECT a.conv_id, CASE WHEN a.mbr_score >= b.mbr_score THEN a.candidate_index ELSE b.candidate_index END AS candidate_index FROM scored a JOIN scored b ON a.conv_id = b.conv_id AND a.candidate_index < b.candidate_index),
    c AS (SELECT conv_id, candidate_index, count(*) AS wins FROM p GROUP BY ALL) SELECT conv_id, candidate_index, wins FROM c QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY wins DESC, candidate_index) = 1""",
)
def w16(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).select("conv_id", "candidate_index", "mbr_score")
    o = s.select("conv_id", F.col("candidate_index").alias("j"), F.col("mbr_score").alias("t"))
    wins = s.join(o, "conv_id").filter("candidate_index < j").select("conv_id", F.when(F.col("mbr_score") >= F.col("t"), F.col("candidate_index")).otherwise(F.col("j")).alias("candidate_index"))
    return _index(pools.best(wins.groupBy("conv_id", "candidate_index").agg(F.count("*").alias("wins")), ["conv_id"], "wins"), "wins")


@query(
    "w15_hard_negatives",
    f"""{_MBR}, r AS (SELECT conv_id, candidate_index, row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index) AS place, md5('5:' || conv_id::VARCHAR || ':' || candidate_index::VARCHAR) AS h FROM scored),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, place > 3 ORDER BY h) AS k FROM r WHERE place > 1) SELECT conv_id, candidate_index, CASE WHEN place <= 3 THEN 'hard' ELSE 'random' END AS kind FROM n WHERE place <= 3 OR k <= 2""",
)
def w15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best losers and two of the rest by a seeded hash."""
    g = W.partitionBy("conv_id")
    r = scored(spark, sf_dir).withColumns({"place": F.row_number().over(g.orderBy(F.desc("mbr_score"), "candidate_index")), "h": F.md5(F.concat_ws(":", F.lit("5"), "conv_id", "candidate_index"))}).filter("place > 1")
    r = r.withColumns({"kind": F.when(F.col("place") <= 3, "hard").otherwise("random")}).withColumn("k", F.row_number().over(W.partitionBy("conv_id", "kind").orderBy("h")))
    return _index(r.filter("kind = 'hard' or k <= 2"), "kind")


@query("w12_diversity", f"WITH {S.POOL}, k AS (SELECT *, lower({S.norm('prediction')}) AS p FROM pool) SELECT conv_id, count(*) AS n, count(DISTINCT p) AS n_distinct, count(*) - count(DISTINCT p) AS duplicates FROM k GROUP BY conv_id")
def w12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "conversations").select("conv_id", F.lower(T.normalize_space(F.col("text"))).alias("p"))
    return k.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_distinct("p").alias("n_distinct"), (F.count("*") - F.count_distinct("p")).alias("duplicates"))


@query(
    "d6_union_with_provenance",
    f"""WITH {S.PAIRS}, u AS (SELECT 0 AS pool, conv_id * 100 + turn AS ord, source, target FROM pairs UNION ALL SELECT 1, doc_id, split_part(text, chr(10), 1), CASE WHEN contains(text, chr(10)) THEN substring(text, strpos(text, chr(10)) + 1) ELSE '' END FROM documents),
    k AS (SELECT *, lower({S.norm('source')}) AS key FROM u WHERE {S.norm('source')} <> '' AND {S.norm('target')} <> ''), f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY pool, ord) = 1)
    SELECT CASE WHEN pool = 0 THEN 'conversations' ELSE 'documents' END AS origin, count(*) AS n, sum(length(target))::BIGINT AS chars FROM f WHERE key NOT IN (SELECT lower({S.norm('text')}) FROM benchmark) GROUP BY pool""",
)
def d6(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = pairs(spark, sf_dir).select(F.lit("conversations").alias("origin"), (F.col("conv_id") * 100 + F.col("turn")).alias("ord"), "source", "target")
    at = F.locate("\n", F.col("text"))
    line = [F.split_part("text", F.lit("\n"), F.lit(1)), F.when(at > 0, F.substring(F.col("text"), at + 1, F.char_length("text"))).otherwise("")]
    b = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("ord"), line[0].alias("source"), line[1].alias("target"))
    u = a.unionByName(b).filter((T.normalize_space(F.col("source")) != "") & (T.normalize_space(F.col("target")) != ""))
    u = P.keep_first(u.withColumn("key", F.lower(T.normalize_space(F.col("source")))), ["key"], ["origin", "ord"])
    held = table(spark, sf_dir, "benchmark").select(F.lower(T.normalize_space(F.col("text"))).alias("held"))
    return P.drop_leaks(u, held, [(F.col("key"), F.col("held"))]).groupBy("origin").agg(F.count("*").alias("n"), F.sum(F.char_length("target")).alias("chars"))


@query(
    "q13_next_action",
    """WITH o AS (SELECT c.c_custkey, count(o_orderkey) AS n, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS part, max(o_totalprice) AS top FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey)
    SELECT c_custkey, CASE WHEN n = 0 THEN 'start' WHEN part > 0 THEN 'resume' WHEN done = n THEN 'publish' WHEN top > 300000 THEN 'review' ELSE 'wait' END AS action FROM o""",
)
def q13(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "P").alias("part"), F.max("o_totalprice").alias("top"))
    c = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    action = F.when(F.col("n").isNull(), "start").when(F.col("part") > 0, "resume").when(F.col("done") == F.col("n"), "publish").when(F.col("top") > 300000, "review").otherwise("wait")
    return c.select("c_custkey", action.alias("action"))


@query(
    "q10_missing_artifacts",
    "WITH a AS (SELECT l_orderkey, coalesce(list_sort(list(DISTINCT l_linestatus || l_linenumber) FILTER (l_returnflag = 'R')), []) AS m, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, n, array_to_string(m, '|') AS missing, row_number() OVER (ORDER BY len(m), n DESC, l_orderkey) AS place FROM a",
)
def q10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's returned lines flattened; place by how few there are. The ranges of the sort are counted first, so the ranking needs no single task."""
    m = F.collect_set(F.when(F.col("l_returnflag") == "R", F.concat("l_linestatus", F.col("l_linenumber").cast("string"))))
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(m).alias("m"), F.count("*").alias("n"))
    a = a.withColumn("size", F.size("m"))
    before = a.groupBy("size", "n").agg(F.count("*").alias("k")).withColumn("before", F.coalesce(F.sum("k").over(W.orderBy("size", F.desc("n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("k")
    inside = F.row_number().over(W.partitionBy("size", "n").orderBy("l_orderkey"))
    return a.join(F.broadcast(before), ["size", "n"]).select("l_orderkey", "n", F.array_join("m", "|").alias("missing"), (F.col("before") + inside).alias("place"))


@query("t6_offset_window", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) BETWEEN 3 AND 5")
def t6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.filter("k between 3 and 5").select("event_id", "user_id")


@query(
    "a5_conditional_rates",
    "SELECT d.lang, count(*) AS n, round(avg(l.quality), 6) AS quality_rate, round(avg(CASE WHEN l.quality = 0 THEN l.toxic END), 6) AS toxic_when_bad, round(avg(CASE WHEN l.quality = 1 THEN d.n_chars END), 4) AS chars_when_good, count(*) FILTER (l.quality = 0 AND l.toxic = 1) AS both_bad FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang",
)
def a5(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return j.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.round(F.avg("quality"), 6).alias("quality_rate"),
        F.round(F.avg(F.when(F.col("quality") == 0, F.col("toxic"))), 6).alias("toxic_when_bad"),
        F.round(F.avg(F.when(F.col("quality") == 1, F.col("n_chars"))), 4).alias("chars_when_good"),
        F.count_if((F.col("quality") == 0) & (F.col("toxic") == 1)).alias("both_bad"),
    )
