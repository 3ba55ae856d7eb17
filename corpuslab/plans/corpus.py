"""Queries over aligned pairs: user turns and the answers after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pairs as P
from . import sqltext as S
from .registry import query, table

_SCORED = S.scored_pairs()


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, source, target): each user turn with the assistant's turn after it."""
    c = table(spark, sf_dir, "conversations")
    asked = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    given = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return asked.join(given, ["conv_id", "turn"])


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.with_tiers(P.score_pairs(pairs(spark, sf_dir)))


@query("p1_scored_pairs", f"{_SCORED} SELECT conv_id, turn, length(source) AS source_chars, length(target) AS target_chars, len(sw) AS source_words, len(tw) AS target_words, round(length_ratio, 6) AS length_ratio, array_to_string(flags, '|') AS filter_flags, round(quality_score, 6) AS quality_score FROM scored")
def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.score_pairs(pairs(spark, sf_dir))
    sizes = [F.col(c).cast("long").alias(c) for c in ("source_chars", "target_chars", "source_words", "target_words")]
    return s.select("conv_id", "turn", *sizes, F.round("length_ratio", 6).alias("length_ratio"), F.array_join("flags", "|").alias("filter_flags"), F.round("quality_score", 6).alias("quality_score"))


@query("p3_tiers", f"{_SCORED} SELECT is_high, is_broad, count(*) AS n, round(avg(quality_score), 6) AS mean_score FROM tiers GROUP BY ALL")
def p3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiers(spark, sf_dir).groupBy("is_high", "is_broad").agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


@query("a2_flag_histogram", f"{_SCORED} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM scored) GROUP BY flag")
def a2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.score_pairs(pairs(spark, sf_dir)).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(
    "a1_split_counts",
    "SELECT d.lang, d.source, count(*) AS n, sum(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END)::BIGINT AS good, sum(CASE WHEN l.toxic = 1 THEN 1 ELSE 0 END)::BIGINT AS toxic, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL",
)
def a1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), table(spark, sf_dir, "labels").withColumn("known", F.lit(1))
    return d.join(lab, "doc_id", "left").groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("known").isNull()).alias("unlabelled"))


@query("x1_normalized_documents", f"SELECT doc_id, md5({S.norm('text')}) AS digest, length({S.norm('text')}) AS n_chars FROM documents")
def x1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.normalize_space(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.char_length("t").cast("long").alias("n_chars"))


@query("x20_pair_overlaps", f"{_SCORED} SELECT conv_id, turn, round({S.share('sw', 'tw')}, 6) AS token_share, round({S.share("list_distinct(regexp_extract_all(lower(source), '\\p{L}'))", "list_distinct(regexp_extract_all(lower(target), '\\p{L}'))")}, 6) AS letter_share FROM w")
def x20(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumns({"source": T.normalize_pair_text(F.col("source")), "target": T.normalize_pair_text(F.col("target"))})
    words = T.share_of_larger(T.pair_words(F.col("source")), T.pair_words(F.col("target")))
    return p.select("conv_id", "turn", F.round(words, 6).alias("token_share"), F.round(T.share_of_larger(T.letters(F.col("source")), T.letters(F.col("target"))), 6).alias("letter_share"))


@query("d1_keep_first", f"SELECT min(doc_id) AS doc_id, count(*) AS copies, md5(lower({S.norm('text')})) AS digest FROM documents GROUP BY digest")
def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.lower(T.normalize_space(F.col("text"))).cast("binary"))
    d = table(spark, sf_dir, "documents").select("doc_id", key.alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "d3_keep_preferred",
    f"""WITH k AS (SELECT d.doc_id, md5(lower({S.norm('text')})) AS digest, coalesce(l.quality = 1, false) AS good FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
    r AS (SELECT *, max(good::INT) OVER (PARTITION BY digest) AS any_good, row_number() OVER (PARTITION BY digest ORDER BY good DESC, doc_id) AS a, row_number() OVER (PARTITION BY digest ORDER BY doc_id DESC) AS b FROM k)
    SELECT doc_id, digest, good FROM r WHERE (any_good = 1 AND a = 1) OR (any_good = 0 AND b = 1)""",
)
def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.lower(T.normalize_space(F.col("text"))).cast("binary"))
    d = table(spark, sf_dir, "documents").select("doc_id", key.alias("digest")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = d.select("doc_id", "digest", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"))
    return P.keep_preferred(d, ["digest"], F.col("good"), ["doc_id"], [F.desc("doc_id")])


@query(
    "j2_leak_anti_join",
    f"""SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower({S.norm('b.text')}) = lower({S.norm('d.text')}))
    AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE lower({S.norm('b.text')}) = lower({S.norm("split_part(d.text, chr(10), 1)")}))
    AND NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(' ' || lower({S.norm('d.text')}) || ' ', ' ' || lower({S.norm('b.text')}) || ' '))""",
)
def j2(spark: SparkSession, sf_dir: str) -> DataFrame:
    def key(c):
        return F.lower(T.normalize_space(c))

    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select(F.col("text").alias("held"))
    d = P.drop_containing(d, b, F.col("text"), F.col("held"))
    return P.drop_leaks(d, b, [(key(F.col("text")), key(F.col("held"))), (key(F.split_part("text", F.lit("\n"), F.lit(1))), key(F.col("held")))]).select("doc_id")


@query(
    "j5_resume_status",
    "SELECT e.event_id, CASE WHEN a.user_id IS NOT NULL THEN 'existing_accepted' WHEN f.user_id IS NOT NULL THEN 'existing_failed' ELSE 'pending' END AS status FROM events e LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') a ON e.user_id = a.user_id LEFT JOIN (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') f ON e.user_id = f.user_id",
)
def j5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return P.pending(e.select("event_id", "user_id"), e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"), "user_id").select("event_id", "status")


@query(
    "j5_running_budget",
    "SELECT event_id, user_id FROM (SELECT event_id, user_id, sum(CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 12",
)
def j5b(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return P.within_budget(e, F.when(F.col("event_type") == "purchase", 2).otherwise(1), 12, ["ts", "event_id"], ["user_id"]).select("event_id", "user_id")


@query("g9_oversample", "SELECT d.doc_id, c.copy FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, (SELECT unnest([0, 1, 2]) AS copy) c WHERE c.copy = 0 OR l.toxic = 1")
def g9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return P.oversampled(d, F.coalesce(F.col("toxic") == 1, F.lit(False)), 3).select("doc_id", "copy")


@query(
    "t4_hash_split",
    "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('11:' || doc_id::VARCHAR), doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT doc_id, source, CASE WHEN place <= greatest(1, floor(n * 0.1)) THEN 'eval' ELSE 'train' END AS split FROM r",
)
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_by_hash(table(spark, sf_dir, "documents").select("doc_id", "source"), F.col("doc_id"), 11, 0.1, ["source"])


@query(
    "a10_word_document_counts",
    f"SELECT w AS word, count(*) AS documents FROM (SELECT doc_id, unnest(list_distinct({S.tokens('text')})) AS w FROM documents) GROUP BY w HAVING count(*) >= 5",
)
def a10(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.explode(F.array_distinct(T.metric_tokens(F.col("text")))).alias("word"))
    return d.groupBy("word").agg(F.count("*").alias("documents")).filter("documents >= 5")


@query(
    "r5_lexicon",
    f"""WITH {S.PAIRS}, p AS (SELECT list_distinct({S.tokens('source')}) AS s, list_distinct({S.tokens('target')}) AS t FROM pairs),
    n AS (SELECT count(*) AS n FROM p), st AS (SELECT s, unnest(t) AS b FROM p), c AS (SELECT unnest(s) AS a, b FROM st),
    ca AS (SELECT a, count(*) AS na FROM (SELECT unnest(s) AS a FROM p) GROUP BY a), cb AS (SELECT b, count(*) AS nb FROM (SELECT unnest(t) AS b FROM p) GROUP BY b),
    sc AS (SELECT c.a, c.b, count(*) AS both_n, (count(*) * 1.0 / any_value(na)) / (1 + any_value(nb) * 1.0 / any_value(n.n)) AS score FROM c JOIN ca ON c.a = ca.a JOIN cb ON c.b = cb.b, n WHERE na >= 3 AND length(c.a) >= 4 AND length(c.b) >= 4 GROUP BY c.a, c.b),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 4) DESC, b) AS place FROM sc WHERE both_n >= 2)
    SELECT a AS word, b AS translation, both_n, round(score, 4) AS score FROM r WHERE place <= 3""",
)
def r5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import lexicon

    return lexicon(pairs(spark, sf_dir), least_both=2, least_word=3, least_chars=4, top=3)


@query(
    "j11_few_shot",
    f"""WITH {S.PAIRS}, p AS (SELECT conv_id, turn, lower({S.norm('source')}) AS key, length(source) AS n, list_distinct({S.tokens('source')}) AS t FROM pairs),
    q AS (SELECT * FROM p), j AS (SELECT q.conv_id, q.turn, p.conv_id AS shot_conv, p.turn AS shot_turn, len(list_intersect(q.t, p.t)) * 1.0 / len(list_distinct(list_concat(q.t, p.t))) AS similarity, abs(q.n - p.n) AS gap
      FROM q, p WHERE q.key <> p.key AND list_has_any(q.t, p.t)),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(similarity, 9) DESC, gap, shot_conv, shot_turn) AS place FROM j)
    SELECT conv_id, turn, shot_conv, shot_turn, round(similarity, 6) AS similarity, place FROM r WHERE place <= 3""",
)
def j11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieval import few_shot

    found = few_shot(pairs(spark, sf_dir), top=3)
    return found.select("conv_id", "turn", "shot_conv", "shot_turn", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))
