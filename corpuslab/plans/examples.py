"""Queries for spelling, examples, models and sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import orthography as O
from ..functions import text as T
from ..functions.fixed import LOANS, SPELLING_RULES, SPELLINGS
from ..operators import examples as X
from ..operators import pools, scoring
from . import sqltext as S
from .candidates import pool
from .corpus import pairs
from .registry import query, table


def _safe(c: str) -> str:
    """SQL for the safe form of a token without set words; RE2 has no look-behind, so l before q is doubled and ll kept by a mark."""
    out = c
    for a, b in SPELLING_RULES:
        if a == "(?<!l)l(q)":
            out = f"replace(regexp_replace(replace({out}, 'llq', chr(1)), 'l(q)', 'll\\1', 'g'), chr(1), 'llq')"
        elif "(?!" in a:
            out = f"regexp_replace(regexp_replace({out}, '{a[:2]}$', '{b}'), '{a[:2]}([^\\p{{L}}\\p{{N}}_])', '{b}\\1', 'g')"
        else:
            out = f"regexp_replace({out}, '{a.replace(chr(39), chr(39) * 2)}', '{b.replace('$', chr(92))}', 'g')"
    return out


_SET = LOANS | SPELLINGS


def _listed(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_WORD = f"list_extract({_listed(_SET.values())}, list_position({_listed(_SET)}, lower(token)))"


@query(
    "x81_safe_tokens",
    f"""WITH w AS (SELECT DISTINCT unnest(string_split({S.norm('text')}, ' ')) AS token FROM conversations UNION SELECT unnest({_listed(_SET)}) UNION SELECT unnest({_listed([w.capitalize() for w in _SET])}))
    SELECT token, CASE WHEN list_contains({_listed(_SET)}, lower(token)) THEN CASE WHEN left(token, 1) <> lower(left(token, 1)) THEN upper(left({_WORD}, 1)) || substring({_WORD}, 2) ELSE {_WORD} END ELSE {_safe('token')} END AS safe FROM w WHERE token <> ''""",
)
def x81(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of the texts, and every set word in small letters and with a capital."""
    w = table(spark, sf_dir, "conversations").select(F.explode(O.tokens(F.col("text"))).alias("token"))
    own = spark.createDataFrame([(x,) for w in _SET for x in (w, w.capitalize())], "token string")
    return w.union(own).distinct().select("token", O.safe_token(F.col("token")).alias("safe"))


@query(
    "a25_corruption_totals",
    f"""WITH t AS (SELECT conv_id, turn, role, string_split({S.norm('text')}, ' ') AS o, string_split({S.norm("replace(text, 'en', 'in')")}, ' ') AS p FROM conversations),
    u AS (SELECT conv_id, turn, role, unnest(o) AS a, unnest(p) AS b FROM t), c AS (SELECT role, conv_id, turn, sum(CASE WHEN a <> b AND b <> {_safe('a')} THEN 1 ELSE 0 END) AS bad FROM u GROUP BY ALL)
    SELECT role, count(*) AS texts, sum(CASE WHEN bad > 0 THEN 1 ELSE 0 END)::BIGINT AS corrupted, sum(bad)::BIGINT AS bad_tokens FROM c GROUP BY role""",
)
def a25(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    c = c.withColumn("bad", O.corruptions(F.col("text"), F.replace("text", F.lit("en"), F.lit("in"))))
    return c.groupBy("role").agg(F.count("*").alias("texts"), F.count_if(F.col("bad") > 0).alias("corrupted"), F.sum("bad").alias("bad_tokens"))


@query(
    "g6_verifier_examples",
    f"""WITH {S.PAIRS}, o AS (SELECT *, coalesce(lead(target) OVER w, first_value(target) OVER w) AS nxt, string_split(target, ' ') AS t FROM pairs WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    h AS (SELECT *, CASE WHEN nxt <> target THEN nxt END AS other, array_to_string(t[1 : greatest(1, len(t) // 2)], ' ') AS half, target || ' ' || array_to_string(t[greatest(1, len(t) - 2) : len(t)], ' ') AS tail, string_split(nxt, ' ') AS n FROM o),
    e AS (SELECT conv_id, turn, unnest(CASE WHEN other IS NULL THEN list_slice(['{{"score":0.98,"severity":"none","rationale":"faithful_reference_translation"}}', '{{"score":0.02,"severity":"critical","rationale":"copied_spanish_source"}}', '{{"score":0.38,"severity":"major","rationale":"incomplete_translation"}}', '{{"score":0.58,"severity":"major","rationale":"spanish_leakage"}}', '{{"score":0.72,"severity":"minor","rationale":"repetition_or_fluency_damage"}}', '{{"score":0.16,"severity":"critical","rationale":"fluent_but_semantically_unrelated_chanka"}}', '{{"score":0.42,"severity":"major","rationale":"mixed_translation_from_another_example"}}'], 1, 5) ELSE ['{{"score":0.98,"severity":"none","rationale":"faithful_reference_translation"}}', '{{"score":0.02,"severity":"critical","rationale":"copied_spanish_source"}}', '{{"score":0.38,"severity":"major","rationale":"incomplete_translation"}}', '{{"score":0.58,"severity":"major","rationale":"spanish_leakage"}}', '{{"score":0.72,"severity":"minor","rationale":"repetition_or_fluency_damage"}}', '{{"score":0.16,"severity":"critical","rationale":"fluent_but_semantically_unrelated_chanka"}}', '{{"score":0.42,"severity":"major","rationale":"mixed_translation_from_another_example"}}'] END) AS label, unnest(list_filter([target, source, half, target || ' de la autoridad', tail, other, CASE WHEN other IS NOT NULL THEN half || ' ' || array_to_string(n[1 : greatest(1, len(n) // 2)], ' ') END], lambda x: x IS NOT NULL)) AS candidate FROM h)
    SELECT conv_id, turn, label, md5(candidate) AS digest FROM e""",
)
def g6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.verifier_examples(pairs(spark, sf_dir), ["conv_id", "turn"], ["turn"]).select("conv_id", "turn", "label", F.md5(F.col("candidate").cast("binary")).alias("digest"))


@query(
    "w11_fill_down",
    "SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::VARCHAR AS last_purchase FROM events",
)
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("event_id").cast("string")).alias("last_purchase"))
    return X.filled_down(e, ["user_id"], ["ts", "event_id"], "last_purchase").drop("ts")


@query("w19_chunks", "SELECT l_orderkey, l_linenumber, (row_number() OVER w - 1) // 3 AS chunk, (row_number() OVER w - 1) % 3 AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)")
def w19(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return X.chunked(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], 3).select("l_orderkey", "l_linenumber", "chunk", F.col("place").cast("long").alias("place"))


@query("w18_adjacent_repeats", f"WITH t AS (SELECT doc_id, {S.tokens('text')} AS t FROM documents) SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] = t[i + 1])) > 0 AS repeats FROM t")
def w18(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.metric_tokens(F.col("text")).alias("t"))
    return d.select("doc_id", X.has_adjacent_repeat(F.col("t")).alias("repeats"))


_MODEL = {"bias": 0.1, "means": {"copied": 0.3, "n_tokens": 80.0}, "stds": {"copied": 0.2, "n_tokens": 40.0}, "weights": {"copied": -0.5, "n_tokens": 0.25}, "stumps": [{"feature": "n_tokens", "threshold": 0.5, "left": 0.2, "right": -0.1}]}


@query("m2_linear_stumps", f"{S.pool_signals()} SELECT conv_id, candidate_index, round(0.1 - 0.5 * (copied - 0.3) / 0.2 + 0.25 * (n_tokens - 80) / 40 + CASE WHEN (n_tokens - 80) / 40 <= 0.5 THEN 0.2 ELSE -0.1 END, 6) AS score FROM sig")
def m2(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pools.signals(pool(spark, sf_dir))
    return s.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), F.round(scoring.linear_score(_MODEL), 6).alias("score"))


@query("m7_sparse_features")
def m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pools.signals(pool(spark, sf_dir))
    named = {"cand_tok": (F.col("tokens"), 1.0), "cand_wng": (F.concat("tokens", T.ngrams(F.col("tokens"), 2)), 1.0), "src_tok": (T.content_tokens(F.col("source_tokens")), 0.5)}
    return scoring.sparse_features(s, ["conv_id", "candidate_index"], named)


@query("a20_mode", f"WITH g AS (SELECT conv_id, lower({S.norm('text')}) AS prediction, count(*) AS n, min(turn) AS first_turn FROM conversations GROUP BY ALL) SELECT conv_id, prediction FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, first_turn) = 1")
def a20(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", F.lower(T.normalize_space(F.col("text"))).alias("prediction")).agg(F.count("*").alias("n"), F.min("turn").alias("first_turn"))
    return c.groupBy("conv_id").agg(F.max_by("prediction", F.struct("n", -F.col("first_turn"))).alias("prediction"))


@query("a21_dictionary", "SELECT p_brand AS headword, array_to_string(list_sort(list(DISTINCT p_type)), '|') AS entries FROM part GROUP BY p_brand")
def a21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("headword")).agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("entries"))
