"""Queries for aggregates, votes, gates, leaderboards and expansions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import parsing
from ..functions import text as T
from ..operators import pairs as P
from ..operators import pools, reports
from . import sqltext as S
from .registry import query, table


@query(
    "a18_exclusive_quantiles",
    """WITH r AS (SELECT source, n_chars::DOUBLE AS v, row_number() OVER (PARTITION BY source ORDER BY n_chars) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE n_chars IS NOT NULL),
    q AS (SELECT *, p, p * (n + 1) AS pos, least(greatest(floor(p * (n + 1)), 1), greatest(n - 1, 1)) AS low FROM r, (SELECT unnest([0.1, 0.5, 0.9]) AS p)),
    x AS (SELECT source, any_value(n) AS n, p, sum(v * CASE WHEN n = 1 THEN CASE WHEN r = 1 THEN 1 ELSE 0 END WHEN r = low THEN 1 - (pos - low) WHEN r = low + 1 THEN pos - low ELSE 0 END) AS val FROM q GROUP BY source, p)
    SELECT x.source, any_value(x.n) AS n, round(any_value(m.mean), 6) AS mean, round(max(val) FILTER (p = 0.1), 6) AS p10, round(max(val) FILTER (p = 0.5), 6) AS median, round(max(val) FILTER (p = 0.9), 6) AS p90 FROM x JOIN (SELECT source, avg(n_chars) AS mean FROM documents GROUP BY source) m ON m.source = x.source GROUP BY x.source""",
)
def a18(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = reports.exclusive_quantiles(table(spark, sf_dir, "documents"), ["source"], "n_chars", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    return q.select("source", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p10", "median", "p90")))


@query(
    "a8_population_stats",
    "SELECT 'l_quantity' AS feature, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std FROM lineitem UNION ALL SELECT 'l_discount', round(avg(l_discount), 6), round(stddev_pop(l_discount), 6) FROM lineitem UNION ALL SELECT 'l_tax', round(avg(l_tax), 6), round(stddev_pop(l_tax), 6) FROM lineitem",
)
def a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = reports.population_stats(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return s.select("feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(
    "a23_relative_scores",
    "SELECT o_orderkey, round(CASE WHEN count(*) OVER w = 1 THEN o_totalprice ELSE (o_totalprice - min(o_totalprice) OVER w) / greatest(1e-6, max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 6) AS relative FROM orders WINDOW w AS (PARTITION BY o_custkey)",
)
def a23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.relative_scores(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice").select("o_orderkey", F.round("relative", 6).alias("relative"))


@query(
    "a22_extremes",
    "SELECT o_custkey, max(o_orderkey) FILTER (b = 1) AS best, max(o_orderkey) FILTER (w = 1) AS worst, round(max(o_totalprice) - min(o_totalprice), 4) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS w FROM orders) GROUP BY o_custkey",
)
def a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.extremes(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").withColumn("gap", F.round("gap", 4))


@query("a26_duplicate_count", f"SELECT count(*) - count(DISTINCT lower({S.norm('text')})) AS duplicates, count(*) AS n FROM documents")
def a26(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.md5(F.lower(T.normalize_space(F.col("text"))).cast("binary"))
    return table(spark, sf_dir, "documents").select(key.alias("k")).agg((F.count("*") - F.count_distinct("k")).alias("duplicates"), F.count("*").alias("n"))


@query("t8_most_common", f"SELECT w AS word, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS w FROM conversations) GROUP BY w ORDER BY n DESC, w LIMIT 20")
def t8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.most_common(table(spark, sf_dir, "conversations").select(F.explode(T.metric_tokens(F.col("text"))).alias("word")), "word", 20)


_VOTE_SQL = """v AS (SELECT doc_id, 'a' AS teacher, 0 AS rank, 'q' || quality AS answer FROM labels UNION ALL SELECT doc_id, 'b', 1, CASE WHEN toxic = 1 THEN 'q0' ELSE 'q1' END FROM labels UNION ALL SELECT d.doc_id, 'c', 9, CASE WHEN n_chars >= 1000 THEN 'q1' ELSE 'short' END FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
t AS (SELECT doc_id, answer, count(*) AS n, min(rank) AS rank FROM v GROUP BY ALL), p AS (SELECT *, sum(n) OVER w AS n_votes, count(*) OVER w AS n_answers, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rank, answer) AS place FROM t WINDOW w AS (PARTITION BY doc_id)),
won AS (SELECT doc_id, answer AS winner, n AS top_count, n_votes::BIGINT AS n_votes, n_answers, CASE WHEN n_votes = 1 THEN 'single' WHEN n >= 2 THEN n || '-way' ELSE 'disagree' END AS agreement FROM p WHERE place = 1)"""


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    a = lab.select("doc_id", F.lit(0).alias("rank"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("answer"))
    b = lab.select("doc_id", F.lit(1).alias("rank"), F.when(F.col("toxic") == 1, "q0").otherwise("q1").alias("answer"))
    c = d.select("doc_id", "n_chars").join(lab.select("doc_id"), "doc_id").select("doc_id", F.lit(9).alias("rank"), F.when(F.col("n_chars") >= 1000, "q1").otherwise("short").alias("answer"))
    return pools.votes(reduce(DataFrame.union, [a, b, c]), "doc_id", "answer", "rank")


@query("a11_votes", f"WITH {_VOTE_SQL} SELECT * FROM won")
def a11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir)


@query("a12_vote_summary", f"WITH {_VOTE_SQL} SELECT agreement, winner, count(*) AS n FROM won GROUP BY ALL")
def a12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).groupBy("agreement", "winner").agg(F.count("*").alias("n"))


_BOARD = f"""b AS (SELECT d.source AS run, count(*) AS n, avg(l.quality) * 100 AS good, avg(l.toxic) * 100 AS bad, avg({S.leak(S.tokens('d.text'))}) * 100 AS leak FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source),
s AS (SELECT run, n, round(good, 4) AS good, round(bad, 4) AS bad, round(leak, 4) AS leak, round(0.45 * round(good, 4) - 0.25 * round(leak, 4) - 0.35 * round(bad, 4), 4) AS score FROM b)"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("run"), M.leakage_penalty(T.metric_tokens(F.col("text"))).alias("leak"))
    j = d.join(table(spark, sf_dir, "labels"), "doc_id")
    b = j.groupBy("run").agg(F.count("*").alias("n"), *(F.round(F.avg(c) * 100, 4).alias(k) for c, k in (("quality", "good"), ("toxic", "bad"), ("leak", "leak"))))
    return b.withColumn("score", F.round(0.45 * F.col("good") - 0.25 * F.col("leak") - 0.35 * F.col("bad"), 4))


@query("t1_leaderboard", f"WITH {_BOARD} SELECT *, row_number() OVER (ORDER BY score DESC, n DESC, run) AS place FROM s")
def t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.leaderboard(_board(spark, sf_dir), [F.desc("score"), F.desc("n"), "run"]).withColumn("place", F.col("place").cast("long"))


@query(
    "q2_gate",
    f"WITH {_BOARD}, g AS (SELECT *, list_filter([CASE WHEN n < 10 THEN 'too_few' END, CASE WHEN good < 80 THEN 'low_quality' END, CASE WHEN bad > 15 THEN 'toxic' END, CASE WHEN score < 30 THEN 'low_score' END], lambda x: x IS NOT NULL) AS r FROM s) SELECT run, array_to_string(r, '|') AS reasons, len(r) = 0 AS passed FROM g",
)
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = [("too_few", F.col("n") >= 10), ("low_quality", F.col("good") >= 80), ("toxic", F.col("bad") <= 15), ("low_score", F.col("score") >= 30)]
    return reports.gate(_board(spark, sf_dir), checks).select("run", F.array_join("reasons", "|").alias("reasons"), "passed")


@query("t7_first_passing", f"WITH {_BOARD} SELECT run, score FROM s WHERE n >= 10 AND bad <= 15 ORDER BY score DESC, run LIMIT 1")
def t7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _board(spark, sf_dir).filter("n >= 10 and bad <= 15").orderBy(F.desc("score"), "run").limit(1).select("run", "score")


@query(
    "q1_promotion",
    f"WITH {_BOARD}, base AS (SELECT * FROM s WHERE run = 'src0') SELECT s.run, round(s.score - base.score, 4) AS delta, s.score - base.score >= 0.5 AND s.bad <= base.bad AS promoted FROM s LEFT JOIN base ON true WHERE s.run <> 'src0'",
)
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _board(spark, sf_dir)
    base = b.filter("run = 'src0'").select(F.col("score").alias("base_score"), F.col("bad").alias("base_bad"))
    j = b.filter("run <> 'src0'").join(F.broadcast(base), F.lit(True), "left")  # one row; without it every delta is null
    return j.select("run", F.round(F.col("score") - F.col("base_score"), 4).alias("delta"), ((F.col("score") - F.col("base_score") >= 0.5) & (F.col("bad") <= F.col("base_bad"))).alias("promoted"))


@query(
    "x60_structured_answers",
    f"""WITH t AS (SELECT conv_id, turn, 'Final: ' || {S.norm('text')} || ' Score: 0.' || (turn % 10) AS answer, {S.norm('text')} AS plain FROM conversations WHERE role = 'assistant') SELECT conv_id, turn, md5(plain) AS digest, (turn % 10) / 10.0 AS score FROM t WHERE NOT regexp_matches(lower(plain), '(final|score|puntaje|eval)')""",
)
def x60(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = T.normalize_space(F.col("text"))
    t = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", plain.alias("plain"))
    t = t.filter(~F.lower("plain").rlike("(final|score|puntaje|eval)")).withColumn("answer", F.concat(F.lit("Final: "), F.col("plain"), F.lit(" Score: 0."), (F.col("turn") % 10).cast("string")))
    return t.select("conv_id", "turn", F.md5(parsing.final_answer(F.col("answer")).cast("binary")).alias("digest"), parsing.stated_score(F.col("answer")).alias("score"))


@query("x62_json_fields", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def x62(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("note: "), F.col("props"), F.lit(" end")).alias("p"))
    return e.select("event_id", parsing.rescued_json(F.col("p"), "k string")["k"].alias("k"))


@query("g1_alternatives", f"SELECT page_id, i - 1 AS part_index, parts[i] AS part FROM (SELECT page_id, list_filter(list_transform(string_split(url, '/'), lambda p: {S.norm('p')}), lambda p: p <> '') AS parts FROM pages), (SELECT unnest(range(1, 40)) AS i) WHERE i <= len(parts)")
def g1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.expand_alternatives(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", F.col("part_index").cast("long").alias("part_index"), "part")


@query(
    "g12_word_trigrams",
    f"WITH t AS (SELECT conv_id, turn, {S.tokens('text')} AS t FROM conversations) SELECT g AS trigram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM t) GROUP BY g HAVING count(*) >= 2",
)
def g12(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select(T.metric_tokens(F.col("text")).alias("t"))
    return t.select(F.explode(T.ngrams(F.col("t"), 3)).alias("trigram")).groupBy("trigram").agg(F.count("*").alias("n")).filter("n >= 2")


@query("g13_templates", "SELECT n.n_nationkey, t.k AS template, replace(replace(t.body, '{term}', n.n_name), '{place}', r.r_name) AS text FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey, (VALUES (0, 'What is {term}?'), (1, '{term} lies in {place}.')) t(k, body)")
def g13(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    forms = F.array(*(F.struct(F.lit(k).alias("template"), F.lit(b).alias("body")) for k, b in enumerate(("What is {term}?", "{term} lies in {place}."))))
    n = n.select("n_nationkey", "n_name", "r_name", F.explode(forms).alias("f"))
    return n.select("n_nationkey", "f.template", F.replace(F.replace("f.body", F.lit("{term}"), F.col("n_name")), F.lit("{place}"), F.col("r_name")).alias("text"))


@query(
    "r1_terminology",
    f"""WITH t AS (SELECT n_name AS term, 'N' || n_regionkey AS target, row_number() OVER (ORDER BY length(n_name) DESC, lower(n_name), lower('N' || n_regionkey)) AS rank FROM nation),
    b AS (SELECT c_custkey, lower({S.norm("c_name || ' of NATION_' || c_nationkey || ', NATION_' || (c_custkey % 25) || ' and nation_1x'")}) AS body FROM customer),
    m AS (SELECT c_custkey, term, target, rank, row_number() OVER (PARTITION BY c_custkey, lower(target) ORDER BY rank) AS k FROM b JOIN t ON list_contains(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}_]+'), lower(term)))
    SELECT c_custkey, term, target FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY rank) AS p FROM m WHERE k = 1) WHERE p <= 2""",
)
def r1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import retrieval

    terms = table(spark, sf_dir, "nation").select(F.col("n_name").alias("source_term"), F.concat(F.lit("N"), F.col("n_regionkey").cast("string")).alias("target_text"), F.col("n_nationkey").alias("ord"))
    c = table(spark, sf_dir, "customer")
    body = F.concat("c_name", F.lit(" of NATION_"), F.col("c_nationkey").cast("string"), F.lit(", NATION_"), (F.col("c_custkey") % 25).cast("string"), F.lit(" and nation_1x"))
    found = retrieval.select_terms(c.select("c_custkey", body.alias("text")), "c_custkey", "text", retrieval.terminology(terms, 1), 2)
    return found.select("c_custkey", F.col("source_term").alias("term"), F.col("target_text").alias("target"))
