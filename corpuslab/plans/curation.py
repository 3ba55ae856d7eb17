"""Queries for rows to train on: filters, labels, preferences, prompts, spelling, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import orthography as O
from ..functions import rewards as R
from ..functions import text as T
from ..operators import corpus_scores
from ..operators import curation as C
from ..operators import dictionaries as D
from ..operators import features as X
from ..operators import pools as P
from ..operators import reports
from . import sqltext as S
from .candidates import _MBR, pool, scored
from .corpus import pairs
from .registry import made, plain, query, table
from .rewards import _SIGNALS, _linear

_KEYS = "conv_id, candidate_index"


def _index(df: DataFrame, *more) -> DataFrame:
    return df.select("conv_id", F.col("candidate_index").cast("long").alias("candidate_index"), *more)


@query("p4_source_tiers", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS is_real, o_orderpriority = '4-NOT SPECIFIED' AS is_synthetic, o_orderpriority = '5-LOW' AS is_eval FROM orders")
def p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for x in ("1-URGENT", "train_jw300", "2-HIGH", "dict", "3-MEDIUM", "extra", "4-NOT SPECIFIED", "synthetic", "5-LOW", "dev")))
    return table(spark, sf_dir, "orders").select("o_orderkey", *(v.alias(k) for k, v in C.source_tiers(names[F.col("o_orderpriority")]).items()))


@query("p9_target_filter", f"{S.pool_signals()} SELECT {_KEYS} FROM sig WHERE NOT exact AND copied <= 0.3 AND leak <= 0.02 AND artifacts <= 0.1")
def p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(pool(spark, sf_dir).filter(C.target_passes(F.col("source"), F.col("prediction"), 0.3, 0.02, 0.1)))


@query("p9_filter_off", f"{S.pool_signals()} SELECT {_KEYS} FROM sig WHERE NOT exact")
def p9b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(pool(spark, sf_dir).filter(C.target_passes(F.col("source"), F.col("prediction"))))


@query("p12_valid_terms", "SELECT p_partkey FROM part WHERE p_partkey % 4 IN (0, 1)")
def p12(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = made(spark, sf_dir, "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'casa grande' WHEN 1 THEN ' rio ' WHEN 2 THEN 'la' ELSE 'uno dos tres cuatro cinco' END AS s, CASE WHEN p_partkey % 4 = 1 THEN 'mayu' ELSE 'hatun wasi' END AS t FROM {part}")
    return p.filter(C.valid_term(F.col("s"), F.col("t"), 3)).select("p_partkey")


@query("p14_reasoned_targets", "SELECT c_custkey, 'Razonamiento: ' || c_name || chr(10) || chr(10) || 'Traducción: ' || c_mktsegment AS target FROM customer WHERE c_custkey % 3 > 0")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("why", F.when(F.col("c_custkey") % 3 > 0, F.concat(F.lit(" "), "c_name", F.lit(" "))).otherwise("no"))
    return c.filter(F.char_length(F.trim("why")) >= 5).select("c_custkey", C.reasoned_target(F.col("why"), F.col("c_mktsegment"), True).alias("target"))


@query("p15_reject_reasons", "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'api_error' WHEN event_id % 7 = 0 THEN 'no_final_line' WHEN event_id % 4 = 1 THEN 'final_mismatch' WHEN event_id % 3 = 0 THEN 'finish_reason_length' END AS reason FROM events) GROUP BY reason")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    final = F.when(k % 7 != 0, F.when(k % 4 == 1, "other").otherwise(F.upper("event_type")))
    reason = C.reject_reason(k % 5 != 0, final, F.col("event_type"), F.when(k % 3 == 0, "length").otherwise("stop"))
    return table(spark, sf_dir, "events").select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_PREFERENCES = "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'Pregunta ' || (event_id % 50) END AS source, CASE WHEN event_id % 2 = 0 THEN ' Allin ' ELSE 'allin' END || (event_id % 50) AS chosen, CASE WHEN event_id % 9 = 0 THEN 'allin' || (event_id % 50) ELSE 'mana ' || (event_id % 3) END AS rejected FROM {events}"


@query(
    "p16_preference_rows",
    f"""SELECT event_id, source, trim(chosen) AS chosen, rejected FROM ({plain(_PREFERENCES)}) WHERE source <> '' AND trim(chosen) <> rejected QUALIFY row_number() OVER (PARTITION BY source, lower(trim(chosen)), rejected ORDER BY event_id) = 1""",
)
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.preference_rows(made(spark, sf_dir, _PREFERENCES), ["event_id"], most_copied=0.9).select("event_id", "source", "chosen", "rejected")


@query("p17_chosen_target", f"{_SIGNALS} SELECT {_KEYS}, md5(CASE WHEN 100 * chrf >= 70 THEN prediction ELSE reference END) AS digest FROM sg")
def p17(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.with_signals(pool(spark, sf_dir))
    return _index(s, F.md5(C.chosen_target(F.col("prediction"), F.col("reference"), 100 * F.col("s_chrf")).cast("binary")).alias("digest"))


@query("p18_prompt_modes", "SELECT s_suppkey, ['direct', 'verify', 'thinking', 'compact', 'engineered', 'verify'][1 + s_suppkey % 6] AS mode FROM supplier")
def p18(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(T.words_of("Direct", " self-verification", "bounded_thinking", "compact_thinking", "engineered_reasoning_v2", "global"), (1 + F.col("s_suppkey") % 6).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.prompt_mode(raw, "verify").alias("mode"))


@query("p19_first_present", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN p_brand WHEN 2 THEN p_type END AS value FROM part")
def p19(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", C.first_present(F.when(k == 0, " a "), F.when(k == 1, F.col("p_brand")).otherwise("  "), F.when(k == 2, F.col("p_type"))).alias("value"))


@query("p11_preference_filter", f"""{_MBR}, r AS (SELECT * FROM scored WHERE copied <= 0.5 AND leak <= 0.1 AND artifacts <= 0.1 AND NOT exact), t AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score, candidate_index) AS w FROM r) SELECT x.conv_id, x.candidate_index AS chosen_index, y.candidate_index AS rejected_index FROM t x JOIN t y ON x.conv_id = y.conv_id AND x.b = 1 AND y.b = 2 AND x.mbr_score - y.mbr_score >= 0.005""")
def p11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that pass the output filters, the best against the next best."""
    ok = scored(spark, sf_dir).filter("copied <= 0.5 and leak <= 0.1 and artifacts <= 0.1 and not exact")
    p = P.preferences(ok, ["conv_id"], "mbr_score", 0.005, "hard")
    return p.select("conv_id", F.col("chosen_index").cast("long").alias("chosen_index"), F.col("rejected_index").cast("long").alias("rejected_index"))


@query("j4_without_known", f"WITH {S.PAIRS}, p AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) AS r FROM pairs) SELECT conv_id, turn FROM p WHERE source NOT IN (SELECT source FROM p WHERE r <= 20) AND (source, target) NOT IN (SELECT (source, target) FROM p WHERE r BETWEEN 30 AND 40)")
def j4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).select("conv_id", "turn", "source", "target")
    first = p.orderBy("conv_id", "turn").limit(40)
    held = first.limit(20)
    shots = first.join(p.orderBy("conv_id", "turn").limit(29), ["conv_id", "turn"], "left_anti")
    return C.without_known(p, held, shots).select("conv_id", "turn")


@query("j6_ledger_keys", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'k' || event_id WHEN 1 THEN event_type || chr(9) || 'ref' WHEN 2 THEN event_type || chr(9) || 'tgt' END AS key FROM events")
def j6(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    own = F.when(k == 0, F.concat(F.lit("k"), F.col("event_id").cast("string"))).otherwise("")
    return table(spark, sf_dir, "events").select("event_id", C.ledger_key(own, F.upper("event_type"), F.when(k == 1, " Ref "), F.when(k == 2, "TGT")).alias("key"))


@query("w9_best_of_text", f"{_MBR} SELECT conv_id, candidate_index FROM scored QUALIFY row_number() OVER (PARTITION BY conv_id, lower({S.norm('prediction')}) ORDER BY mbr_score DESC, candidate_index) = 1")
def w9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(C.best_of_text(scored(spark, sf_dir, "prediction"), ["conv_id"], "mbr_score"))


@query(
    "w14_gap_pairs",
    f"""{_MBR}, m AS (SELECT conv_id, candidate_index, prediction, mbr_score, max(mbr_score) OVER (PARTITION BY conv_id) AS best FROM scored), k AS (SELECT *, CASE WHEN mbr_score >= best - 0.005 THEN 'w' WHEN mbr_score <= best - 0.03 THEN 'l' END AS kind FROM m),
    u AS (SELECT * FROM k WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, kind, prediction ORDER BY candidate_index) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY md5('7:' || conv_id || ':' || candidate_index)) - 1 AS r, count(*) OVER (PARTITION BY conv_id, kind) AS n FROM u)
    SELECT l.conv_id, w.candidate_index AS chosen_index, l.candidate_index AS rejected_index, round(w.mbr_score - l.mbr_score, 5) AS gap FROM r l JOIN r w ON l.conv_id = w.conv_id AND l.kind = 'l' AND w.kind = 'w' AND l.r < 2 AND w.r = l.r % w.n""",
)
def w14(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = C.gap_pairs(scored(spark, sf_dir, "prediction"), ["conv_id"], "mbr_score", 0.03, 0.005, 2)
    return g.select("conv_id", F.col("chosen_index").cast("long").alias("chosen_index"), F.col("rejected_index").cast("long").alias("rejected_index"), F.round("gap", 5).alias("gap"))


_LABEL = f"greatest(0.0, least(0.98, CASE WHEN lower({S.norm('prediction')}) = lower({S.norm('reference')}) THEN greatest({_linear(fixed.LABEL_SCORE)}, 0.98) ELSE {_linear(fixed.LABEL_SCORE)} END))"


@query(
    "x53_candidate_labels",
    f"""{_SIGNALS}, l AS (SELECT *, {_LABEL} AS score FROM sg) SELECT {_KEYS}, round(score + 1e-9, 4) AS score, CASE WHEN score >= 0.9 THEN 'none' WHEN score >= 0.7 THEN 'minor' WHEN score >= 0.4 THEN 'major' ELSE 'critical' END AS severity,
    'model_output_' || CASE WHEN exact = 1 THEN 'copied_spanish_source' WHEN leak >= 0.08 THEN 'has_spanish_leakage' WHEN copied >= 0.25 THEN 'copies_source_terms' WHEN repeated > 0 THEN 'repetition' WHEN score < 0.4 THEN 'low_reference_agreement' WHEN score < 0.7 THEN 'partial_or_noisy_translation' ELSE 'near_reference_translation' END AS rationale,
    CASE WHEN quality >= 0.86 THEN 'none' WHEN quality >= 0.68 THEN 'minor' WHEN quality >= 0.4 THEN 'major' ELSE 'critical' END AS hidden_severity FROM l""",
)
def x53(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.with_signals(pool(spark, sf_dir)).withColumn("score", C.bounded_label(F.col("prediction"), F.col("reference")))
    return _index(s, F.round(F.col("score") + 1e-9, 4).alias("score"), C.severity(F.col("score")).alias("severity"), C.rationale(F.col("score")).alias("rationale"), C.severity(F.col("s_quality"), True).alias("hidden_severity"))


@query("x66_label_json", """SELECT event_id, '{"score":' || CASE WHEN event_id % 4 = 0 THEN '0.0' ELSE '0.' || (event_id % 4) END || ',"severity":"major","rationale":"' || event_type || '"}' AS label FROM events""")
def x66(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", C.label_json(F.col("event_id") % 4 / 10.0, F.lit("major"), F.col("event_type")).alias("label"))


@query("g10_anchors", f"""WITH {S.PAIRS} SELECT conv_id, turn, md5(target) AS digest, '{{"score":0.98,"severity":"none","rationale":"clean_reference_anchor"}}' AS label FROM pairs UNION ALL SELECT conv_id, turn, md5(source), '{{"score":0.02,"severity":"critical","rationale":"source_copy_anchor"}}' FROM pairs""")
def g10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.anchors(pairs(spark, sf_dir)).select("conv_id", "turn", F.md5(F.col("candidate").cast("binary")).alias("digest"), "label")


@query("g7_meta_examples", f"""WITH {S.PAIRS} SELECT conv_id, turn, unnest(['Severidad none: clean reference anchor', 'Hay errores graves y falta contenido.', 'Severidad critical: source copy anchor', 'Sin errores, traduccion correcta y fiel.']) AS analysis, unnest([0.95, 0.05, 0.95, 0.05])::DOUBLE AS meta_score FROM pairs""")
def g7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.meta_examples(C.anchors(pairs(spark, sf_dir))).select("conv_id", "turn", "analysis", "meta_score")


@query("g8_mixed_targets", f"""WITH {S.PAIRS} SELECT conv_id, turn, 'direct' AS prompt_mode, md5({S.norm('target')}) AS digest FROM pairs UNION ALL SELECT conv_id, turn, 'compact', md5('Final: ' || target) FROM pairs""")
def g8(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.mixed_targets(pairs(spark, sf_dir), F.concat(F.lit("Final: "), "target"))
    return m.select("conv_id", "turn", "prompt_mode", F.md5(F.col("target").cast("binary")).alias("digest"))


@query("g14_chat_messages", f"""WITH {S.PAIRS} SELECT conv_id, turn, 3 AS n, md5('system:be brief|user:Traduce: ' || source || '|assistant:' || target) AS digest FROM pairs""")
def g14(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("m", C.chat("be brief", F.concat(F.lit("Traduce: "), "source"), F.col("target")))
    flat = F.array_join(F.transform("m", lambda x: F.concat_ws(":", x["role"], x["content"])), "|")
    return p.select("conv_id", "turn", F.size("m").alias("n"), F.md5(flat.cast("binary")).alias("digest"))


@query("g11_noisy_variants")
def g11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of noise; the hash that decides has no SQL."""
    p = pairs(spark, sf_dir).select("conv_id", "turn", "target")
    return C.noisy(p, "target", ["conv_id", "turn"], [("k", "kh"), ("th", "t"), ("i", "e"), ("u", "o"), ("h", "j")], {"light": 0.10, "medium": 0.30, "heavy": 0.55})


_SPELLED = {"Jatun": "hatun", "(mijuna),": "(mikuna),", "vaca": "waka", "k'anka": "kanka", "qhari": "qari", "Cuzco": "Qusqu", "Quispe": "Quispe", "qan": "qam", "alqu": "allqu", "huahua": "wahua", "7o": "7o", "urpi!": "urpi!", "orqo": "urqu", "yahuar": "yawar"}


@query("x80_rule_normalized", f"SELECT p_partkey, list_extract({S.listing(_SPELLED.values())}, (1 + p_partkey % {len(_SPELLED)})::INT) || ' ' || list_extract({S.listing(_SPELLED.values())}, (1 + p_partkey % 5)::INT) AS text FROM part")
def x80(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.words_of(*_SPELLED)
    raw = F.concat_ws("  ", F.element_at(words, (1 + F.col("p_partkey") % len(_SPELLED)).cast("int")), F.element_at(words, (1 + F.col("p_partkey") % 5).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", O.rule_normalized(raw).alias("text"))


_DIALECT = {"K'anchay": "kanchay", "khuyay": "kuyay", "QAN": "qam", "Qan": "qam", "orqo": "urqu", "llaqtakhuna": "llaqtakhuna", "ch'aska": "chaska", "USA": "USA"}


@query("x86_plain_dialect", f"SELECT s_suppkey, list_extract({S.listing(_DIALECT.values())}, (1 + s_suppkey % {len(_DIALECT)})::INT) AS word FROM supplier")
def x86(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(T.words_of(*_DIALECT), (1 + F.col("s_suppkey") % len(_DIALECT)).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", O.plain_dialect(word).alias("word"))


@query("q17_specificity", "SELECT lang, round(count(*) FILTER (n_chars % 3 = 0) * 1.0 / count(*) - sum(n_chars % 7) * 1.0 / sum(n_chars), 6) AS score FROM documents GROUP BY lang")
def q17(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") % 3 == 0).alias("right"), F.sum(F.col("n_chars") % 7).alias("bad"), F.sum("n_chars").alias("tokens"))
    return d.select("lang", F.round(O.specificity_score(F.col("right"), F.col("n"), F.col("bad"), F.col("tokens")), 6).alias("score"))


@query("a6_selection_metrics", f"{_MBR}, b AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index) = 1) SELECT conv_id % 2 AS part, count(*) AS n, round(100 * avg((candidate_index <> 0)::INT), 5) AS non_first_rate, round(avg(candidate_index), 5) AS mean_index FROM b GROUP BY ALL")
def a6(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = P.best(scored(spark, sf_dir), ["conv_id"], "mbr_score").withColumn("part", F.col("conv_id") % 2)
    return corpus_scores.selection_metrics(best, ["part"]).select("part", "n", F.round("non_first_rate", 5).alias("non_first_rate"), F.round("mean_index", 5).alias("mean_index"))


@query(
    "r6_dictionary_hits",
    """WITH e AS (SELECT n_nationkey AS ord, 'nation_' || (n_nationkey % 9) AS es, 'Q' || (n_nationkey % 7) AS qu FROM nation UNION ALL SELECT 100, 'customer', 'Rantiq' UNION ALL SELECT 101, 'tome', 'Tu'), b AS (SELECT c_custkey, lower(c_name || ' de nation_' || (c_custkey % 12) || ' X') AS b FROM customer),
    h AS (SELECT c_custkey, es, qu, ord FROM b JOIN e ON list_contains(regexp_extract_all(b, '[\\p{L}\\p{N}_]+'), es) OR (length(es) >= 4 AND contains(b, es))), u AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY c_custkey, lower(qu) ORDER BY ord) = 1),
    p AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY length(es) DESC, ord) AS place FROM u QUALIFY place <= 3) SELECT c_custkey, 'Diccionario:' || chr(10) || string_agg('  • ' || es || ' → ' || qu, chr(10) ORDER BY place) AS block FROM p GROUP BY c_custkey""",
)
def r6(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = made(spark, sf_dir, "SELECT n_nationkey AS ord, 'nation_' || (n_nationkey % 9) AS es, 'Q' || (n_nationkey % 7) AS qu FROM {nation} UNION ALL SELECT 100, 'customer', 'Rantiq' UNION ALL SELECT 101, 'tome', 'Tu'")
    c = made(spark, sf_dir, "SELECT c_custkey, c_name || ' de nation_' || (c_custkey % 12) || ' X' AS body FROM {customer}")
    return C.dictionary_block(C.dictionary_hits(c, "c_custkey", "body", e, 3), "c_custkey", "Diccionario:")


_LINES = """SELECT o_custkey % 300 AS part, o_orderkey AS line, CASE o_orderkey % 6 WHEN 0 THEN 'wasi/uta sust. casa (grande),' WHEN 1 THEN '' || (o_orderkey % 90) WHEN 2 THEN 'x; hogar.' WHEN 3 THEN 'mayu sust. río ' || o_orderstatus || ', agua.' WHEN 4 THEN 'A' ELSE 'puriy v.int. andar.' END AS text FROM {orders}"""


@query("g5_dictionary_lines", """SELECT o_orderkey AS line, CASE o_orderkey % 4 WHEN 0 THEN 'abandonar' WHEN 1 THEN 'alegrar' ELSE 'casa' END AS headword, unnest(CASE o_orderkey % 4 WHEN 0 THEN ['saqiy', 'wischuy'] WHEN 1 THEN ['kusichiy'] ELSE ['wasi'] END) AS form FROM orders WHERE o_orderkey % 4 < 3""")
def g5(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = made(spark, sf_dir, "SELECT o_orderkey AS line, CASE o_orderkey % 4 WHEN 0 THEN 'Abandonar saqiy; wischuy algo.' WHEN 1 THEN 'alegrar (a otro) kusichiy' WHEN 2 THEN 'casa wasi/rumi2x' ELSE '12' END AS text FROM {orders}")
    return D.line_entries(lines, "text", ["A"]).select("line", "headword", "form")


@query("g5_dictionary_entries")
def g5b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that run over lines; the carried text has no SQL."""
    return D.entries(made(spark, sf_dir, _LINES), ["part"], "line", "text", ["A"])


@query("a19_preference_means", f"""{_MBR}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY mbr_score DESC, candidate_index) AS b, count(*) OVER (PARTITION BY conv_id) AS n FROM scored), p AS (SELECT x.conv_id, x.mbr_score AS c, y.mbr_score AS j, x.n FROM r x JOIN r y ON x.conv_id = y.conv_id AND x.b = 1 AND y.b = 2)
    SELECT g.k AS part, count(p.c) AS pairs, round(coalesce(avg(c), 0), 5) AS chosen, round(coalesce(avg(j), 0), 5) AS rejected, round(coalesce(avg(c - j), 0), 5) AS margin, round(coalesce(avg(n), 0), 5) AS candidates FROM (SELECT unnest([0, 1, 2]) AS k) g LEFT JOIN p ON p.conv_id % 2 = g.k AND c - j >= 0.01 GROUP BY g.k""")
def a19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over pairs, 0 where there are none."""
    p = P.preferences(scored(spark, sf_dir), ["conv_id"], "mbr_score", 0.01).withColumn("part", F.col("conv_id") % 2)
    parts = spark.range(3).select(F.col("id").alias("part"))
    means = {"chosen": "chosen_score", "rejected": "rejected_score", "margin": "score_margin", "candidates": "candidate_count"}
    found = parts.join(p, "part", "left").groupBy("part").agg(F.count("chosen_score").alias("pairs"), *(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 5).alias(k) for k, c in means.items()))
    return found


@query("x7_text_tokens", f"""WITH t AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(lower({S.norm('text')}), '[\\p{{L}}\\p{{N}}_ʼ’''-]+'), lambda x: trim(x, '-''ʼ’')), lambda x: x <> '') AS t FROM conversations) SELECT conv_id, turn, len(t) AS n, md5(array_to_string(list_slice(list_filter(t, lambda x: length(x) >= 3 AND NOT list_contains({S.listing(fixed.LEAKAGE_WORDS)}, x)), 1, 8), '|')) AS digest FROM t""")
def x7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tokens counted, and the first eight content tokens."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.text_tokens(F.col("text")).alias("t"))
    content = F.slice(F.filter("t", lambda w: (F.char_length(w) >= 3) & ~w.isin(*fixed.LEAKAGE_WORDS)), 1, 8)
    return c.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.md5(F.array_join(content, "|").cast("binary")).alias("digest"))


@query("x42_reward_scores", f"{_SIGNALS} SELECT {_KEYS}, round({_linear(fixed.REWARD_PARTS['baseline'])} + 1e-9, 4) AS baseline, round({_linear(fixed.REWARD_PARTS['rerank'])} + 1e-9, 4) AS rerank, round(quality + 1e-9, 4) AS bounded FROM sg")
def x42(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = R.with_signals(pool(spark, sf_dir))
    values = {"baseline": R.weighted(fixed.REWARD_PARTS["baseline"]), "rerank": R.weighted(fixed.REWARD_PARTS["rerank"]), "bounded": F.col("s_quality")}
    return _index(s, *(F.round(v + 1e-9, 4).alias(k) for k, v in values.items()))


@query("x54_selection_scores", "SELECT o_orderkey, round(0.45 * (o_orderkey % 50) + 0.15 * (o_orderkey % 20) + 0.25 * (o_orderkey % 60) + 0.05 * (o_orderkey % 90) - 0.30 * (o_orderkey % 7) - 0.40 * (o_orderkey % 3) - 0.25 * (o_orderkey % 5) - 0.35 * (o_orderkey % 2) - 0.03 * CASE WHEN o_orderkey % 4 = 0 THEN 100 ELSE o_orderkey % 80 END, 5) AS score FROM orders")
def x54(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [k % m for m in (50, 20, 60, 90, 7, 3, 5, 2)]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(reports.selection_score(*parts, F.when(k % 4 > 0, k % 80)), 5).alias("score"))
