"""Queries for gates, manifests, worded analyses and balanced selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions import text as T
from ..operators import analyses as A
from ..operators import gates as G
from ..operators import reports
from . import sqltext as S
from .corpus import pairs
from .registry import made, plain, query, table

_TERM = " OR ".join(f"contains(lower(source || ' ' || target), '{t}')" for t in fixed.DOMAIN_TERMS)


def _entity(c: str) -> str:
    words = f"regexp_extract_all({c}, '\\p{{L}}[\\p{{L}}\\p{{N}}_''-]*')"
    return f"(regexp_matches({c}, '[0-9]') OR len(list_filter(list_slice({words}, 2, 100000), lambda w: regexp_full_match(w, '\\p{{Lu}}[^\\p{{Lu}}]*\\p{{Ll}}[^\\p{{Lu}}]*'))) > 0)"


_EXPECTED = f"""WITH {S.PAIRS}, e AS (SELECT *, CASE WHEN {_entity('source')} OR {_entity('target')} THEN 'ENTIDADES' WHEN {_TERM} THEN 'TERMINOLOGIA' ELSE 'ANTI_COPIA' END AS third FROM pairs)"""


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    tags = A.expected_tags(F.col("source"), F.col("target"))
    return p.withColumn("expected", tags).withColumn("third", F.element_at("expected", 3))


@query("x26_expected_tags", f"{_EXPECTED} SELECT conv_id, turn, 'SIGNIFICADO|GRAMATICA|' || third AS expected FROM e")
def x26(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _expected(spark, sf_dir).select("conv_id", "turn", F.array_join("expected", "|").alias("expected"))


@query("a24_expected_counts", f"{_EXPECTED} SELECT tag, count(*) AS n FROM (SELECT unnest(['SIGNIFICADO', 'GRAMATICA', third]) AS tag FROM e) GROUP BY tag")
def a24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tag_counts(_expected(spark, sf_dir), [], "expected")


def _words(c: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: lower(w)), lambda w: regexp_full_match(w, '\\p{{L}}{{4,}}'))"


@query("x26_copy_risk", f"WITH {S.PAIRS} SELECT conv_id, turn, len(list_intersect(list_filter({_words('source')}, lambda w: NOT list_contains({S.listing(fixed.COPY_EXEMPT)}, w)), {_words('target')})) > 0 AS risk, {_TERM} AS domain FROM pairs")
def x26b(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    return p.select("conv_id", "turn", A.has_copy_risk(F.col("source"), F.col("target")).alias("risk"), A.has_domain_term(F.col("source"), F.col("target")).alias("domain"))


_CLASSES = "SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '1%' THEN 'ENTIDADES' WHEN o_custkey % 50 = 7 THEN 'TERMINOLOGIA' ELSE 'ANTI_COPIA' END AS third FROM {orders}"


@query(
    "t5_balanced_selection",
    f"""WITH c AS ({plain(_CLASSES)}), n AS (SELECT *, row_number() OVER (PARTITION BY third ORDER BY k) AS level FROM c) SELECT k, third FROM n ORDER BY level, k LIMIT 1000""",
)
def t5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.balanced(made(spark, sf_dir, _CLASSES), ["k"], 1000).select("k", "third")


@query("t3_prefix_cap", "SELECT event_id FROM events ORDER BY ts, event_id LIMIT 500")
def t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy("ts", "event_id").limit(500).select("event_id")


@query("r4_first_shots", f"""WITH {S.PAIRS}, k AS (SELECT conv_id, turn, conv_id || ':' || turn AS key, source FROM pairs), f AS (SELECT key, row_number() OVER (ORDER BY conv_id, turn) AS r FROM k QUALIFY r <= 3)
    SELECT k.conv_id, k.turn, string_agg(f.key, '|' ORDER BY r) AS shots FROM k JOIN (SELECT k.key AS own, f.key, f.r, row_number() OVER (PARTITION BY k.key ORDER BY f.r) AS p FROM k JOIN f ON f.key <> k.key) f ON f.own = k.key AND p <= 2 GROUP BY ALL""")
def r4(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    got = A.shots(p, "key", ["source"], ["conv_id", "turn"], 2)
    return got.select("conv_id", "turn", F.array_join(F.transform("shots", lambda s: s["key"]), "|").alias("shots"))


_THOUGHT = "CASE event_id % 5 WHEN 0 THEN '[SIGNIFICADO] [GRAMATICA] fiel y el sufijo' WHEN 1 THEN '[SIGNIFICADO] la frase' WHEN 2 THEN 'nada' WHEN 3 THEN '[ANTI_COPIA][ENTIDADES] Ñandú ' || event_type ELSE '' END"
_ROWS = f"""SELECT event_id, user_id % 7 AS part, {_THOUGHT} AS analysis, 'uno ' || event_type AS source, event_type AS reference, CASE WHEN event_id % 3 = 0 THEN 'Traduccion final: ' || event_type || ' Puntaje: 1' ELSE 'Final: otro Eval: x' END AS target,
  CASE WHEN event_id % 2 = 0 THEN 'SIGNIFICADO' END AS want, event_id % 4 = 1 AS audited, event_id % 8 = 1 AS fine, (event_id % 10) / 10.0 AS grade FROM {{events}}"""
_DESCRIBED = f"""r AS ({plain(_ROWS)}), d AS (SELECT *, list_filter({S.listing(fixed.THEMES)}, lambda t: contains(analysis, '[' || t || ']')) AS tags, list_distinct(list_filter(regexp_extract_all(lower(strip_accents(analysis)), '[a-z]+'), lambda w: NOT list_contains({S.listing([*fixed.ANALYSIS_STOPWORDS, *(t.lower() for t in fixed.THEMES)])}, w))) AS w FROM r),
  x AS (SELECT *, len(list_intersect(w, {S.listing(fixed.ANALYSIS_TERMS)})) > 0 OR len(list_filter(list_intersect(w, regexp_extract_all(lower(source || ' ' || reference), '[a-z]+')), lambda y: length(y) >= 4)) > 0 AS specific, event_id % 3 = 0 AS matches, want IS NOT NULL AND NOT contains(analysis, '[SIGNIFICADO]') AS missing FROM d)"""
_COUNTS = f"""{_DESCRIBED}, c AS (SELECT part, count(*) AS written_rows, avg(len(tags)) AS avg_primitive_tags, avg((len(tags) >= 2)::INT) AS primitive_row_rate, len(list_distinct(flatten(list(tags)))) AS distinct_primitives, count(want) AS expected_rows, count(*) FILTER (want IS NOT NULL AND NOT missing) * 1.0 / greatest(1, count(want)) AS expected_primitive_coverage,
  avg(len(w)) AS avg_analysis_words, avg((len(w) >= 2)::INT) AS analysis_word_row_rate, avg(specific::INT) AS specific_analysis_rate, avg(audited::INT) AS audited_row_rate, avg((audited AND fine)::INT) AS audit_pass_rate, coalesce(avg(CASE WHEN audited THEN grade END), 0) AS avg_audit_score, avg(matches::INT) AS reference_final_match_rate FROM x GROUP BY part)"""
_RATES = ("avg_primitive_tags", "primitive_row_rate", "expected_primitive_coverage", "avg_analysis_words", "analysis_word_row_rate", "specific_analysis_rate", "audited_row_rate", "audit_pass_rate", "avg_audit_score", "reference_final_match_rate")


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = made(spark, sf_dir, _ROWS)
    audit = F.when(F.col("audited"), F.struct(F.col("fine").alias("pass"), F.col("grade").cast("double").alias("score")))
    rows = rows.withColumns({"expected": F.when(F.col("want").isNotNull(), F.array("want")), "audit": audit})
    blank = F.when(F.col("analysis") == "", F.lit(" ")).otherwise(F.col("analysis"))
    return G.analysis_counts(A.described(rows.withColumn("analysis", blank)), ["part"], 2, 2)


@query("a13_analysis_counts", f"WITH {_COUNTS} SELECT part, written_rows, distinct_primitives, expected_rows, {', '.join(f'round({c}, 6) AS {c}' for c in _RATES)} FROM c")
def a13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("part", "written_rows", F.col("distinct_primitives").cast("long").alias("distinct_primitives"), "expected_rows", *(F.round(c, 6).alias(c) for c in _RATES))


_LIMITS = {"written_rows": 1400, "accept_rate": 0.9, "avg_primitive_tags": 1.0, "primitive_row_rate": 0.4, "distinct_primitives": 4, "expected_primitive_coverage": 0.41, "avg_analysis_words": 1.5, "analysis_word_row_rate": 0.0, "specific_analysis_rate": 0.59, "audited_row_rate": 0.25, "audit_pass_rate": 0.12, "avg_audit_score": 0.5, "reference_final_match_rate": 0.334}


def _below(name: str, least: float, digits: int) -> str:
    return f"CASE WHEN {name} < {least} THEN printf('%s %.{digits}f < %.{digits}f', '{name}', {name}::DOUBLE, {float(least)}::DOUBLE) END"


@query(
    "q2_analysis_gate",
    f"""WITH {_COUNTS}, g AS (SELECT *, written_rows * 1.0 / (written_rows + part * 60) AS accept_rate FROM c), j AS (SELECT part, list_filter([{', '.join(_below(k, v, 0 if k in ('written_rows', 'distinct_primitives') else 4) for k, v in _LIMITS.items() if v > 0)}], lambda x: x IS NOT NULL) AS r FROM g) SELECT part, array_to_string(r, '|') AS reasons, len(r) = 0 AS passed FROM j""",
)
def q2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = G.analysis_gate(_counts(spark, sf_dir).withColumn("failed_rows", F.col("part") * 60), _LIMITS)
    return judged.select("part", F.array_join("reasons", "|").alias("reasons"), "passed")


@query(
    "p13_record_gate",
    f"SELECT event_id FROM ({plain(_ROWS)}) WHERE len(list_filter({S.listing(fixed.THEMES)}, lambda t: contains(analysis, '[' || t || ']'))) >= 1 AND (want IS NULL OR contains(analysis, '[SIGNIFICADO]')) AND grade <= 0.8",
)
def p13(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = made(spark, sf_dir, _ROWS)
    required = F.when(F.col("want").isNotNull(), F.array("want")).otherwise(F.array().cast("array<string>"))
    score = F.col("grade").cast("double") + 0.2
    return r.filter(A.record_passes(F.col("analysis"), F.lit("bien"), score, required, 1)).select("event_id")


@query("a15_top_reasons", "SELECT event_type || ' ' || (user_id % 40) AS reason, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY ALL ORDER BY n DESC, reason LIMIT 20")
def a15(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type <> 'purchase'").select(F.concat_ws(" ", "event_type", (F.col("user_id") % 40).cast("string")).alias("reason"))
    return reports.most_common(e, "reason", 20)


_REPORT = f"""WITH t AS (SELECT user_id % 9 AS part, unnest(CASE WHEN event_id % 3 = 0 THEN ['SIGNIFICADO', 'GRAMATICA'] WHEN event_id % 97 = 1 THEN ['SIGNIFICADO', 'ENTIDADES', 'TERMINOLOGIA'] ELSE ['ANTI_COPIA', 'GRAMATICA'] END) AS tag FROM events), n AS (SELECT part, tag, count(*) AS n FROM t GROUP BY ALL), s AS (SELECT user_id % 9 AS part, count(*) AS selected_rows FROM events GROUP BY ALL)"""


@query(
    "q3_selection_gate",
    f"""{_REPORT}, a AS (SELECT s.part, any_value(selected_rows) AS selected_rows, count(n.tag) AS distinct_tags, sum(n) * 1.0 / any_value(selected_rows) AS avg_tags, {', '.join(f"coalesce(max(n) FILTER (tag = '{t}'), 0) AS c_{t}" for t in fixed.THEMES)} FROM s LEFT JOIN n USING (part) GROUP BY s.part),
    j AS (SELECT part, list_filter([{_below('selected_rows', 1105, 0)}, {_below('distinct_tags', 5, 0)}, {_below('avg_tags', 2.006, 4)}, {', '.join(f"CASE WHEN c_{t} < 8 THEN printf('counts[{t}] %.0f < %.0f', c_{t}::DOUBLE, 8.0::DOUBLE) END" for t in fixed.THEMES)}, CASE WHEN selected_rows * 2 > 2240 THEN printf('estimated_requests %.0f > %.0f', (selected_rows * 2)::DOUBLE, 2240.0::DOUBLE) END], lambda x: x IS NOT NULL) AS r FROM a) SELECT part, array_to_string(r, '|') AS reasons, len(r) = 0 AS passed FROM j""",
)
def q3(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("part", F.col("user_id") % 9)
    tags = F.when(F.col("event_id") % 3 == 0, T.words_of("SIGNIFICADO", "GRAMATICA")).when(F.col("event_id") % 97 == 1, T.words_of("SIGNIFICADO", "ENTIDADES", "TERMINOLOGIA")).otherwise(T.words_of("ANTI_COPIA", "GRAMATICA"))
    counts = G.tag_counts(e.withColumn("tags", tags), ["part"], "tags").groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("counts"))
    report = e.groupBy("part").agg(F.count("*").alias("selected_rows")).join(counts, "part").withColumn("estimated_requests", F.col("selected_rows") * 2)
    return G.selection_gate(report, 1105, 5, 2.006, 8, 2240).select("part", F.array_join("reasons", "|").alias("reasons"), "passed")


_LINE = "Required primitive tags for this row:"


def _previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests made of events, some of them faulty: id % 23 names the fault."""
    e = table(spark, sf_dir, "events").withColumns({"part": F.col("user_id") % 5, "k": F.col("event_id") % 230})
    tags = F.when(F.col("k") == 7, F.lit("[OTHER]")).otherwise("[SIGNIFICADO]")
    line = F.when(F.col("k") == 8, F.lit("")).otherwise(F.concat(F.lit(f"{_LINE} "), tags))
    prompt = F.concat(F.lit("Source terms to consider:\n"), line, F.when(F.col("k") == 9, F.lit("")).otherwise(F.lit("\nReference terms to consider: x")))
    messages = F.when(F.col("k") == 3, F.array().cast("array<struct<role:string,content:string>>")).otherwise(F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))))
    payload = F.struct(F.when(F.col("k") == 2, "other").otherwise("m").alias("model"), messages.alias("messages"), F.when(F.col("k") == 4, "disabled").otherwise("enabled").alias("thinking"), F.when(F.col("k") == 5, "text").otherwise("json_object").alias("response_format"))
    row_key = F.concat(F.lit("r"), (F.col("event_id") - F.when(F.col("k") == 11, 230 * (F.col("event_id") / 230).cast("long")).otherwise(0)).cast("string"))
    e = e.select("event_id", "part", row_key.alias("row_key"), F.when(F.col("k") != 1, payload).alias("payload"), F.when(F.col("k") != 6, T.words_of("[SIGNIFICADO]")).alias("expected"), F.array(F.when(F.col("k") == 10, row_key).otherwise("r-none")).alias("few_shot_keys"), F.when(F.col("k") == 12, "Bearer x").otherwise("").alias("note"))
    return G.preview_records(e, "m", ["Source terms to consider:", "Reference terms to consider:"], _LINE)


_FAULTS = "CASE k WHEN 1 THEN 'no_payload|missing_tags|no_tag_line|vacuous' WHEN 2 THEN 'model' WHEN 3 THEN 'shape|missing_tags|no_tag_line|vacuous' WHEN 4 THEN 'thinking' WHEN 5 THEN 'json' WHEN 6 THEN 'no_expected' WHEN 7 THEN 'missing_tags' WHEN 8 THEN 'missing_tags|no_tag_line' WHEN 9 THEN 'vacuous' WHEN 10 THEN 'self_shot' WHEN 12 THEN 'secret' ELSE '' END"


@query("q4_preview_faults", f"SELECT event_id, {_FAULTS} AS faults FROM (SELECT event_id, event_id % 230 AS k FROM events) WHERE {_FAULTS} <> ''")
def q4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _previews(spark, sf_dir).filter(F.size("faults") > 0).select("event_id", F.array_join("faults", "|").alias("faults"))


@query(
    "q4_preview_gate",
    """WITH e AS (SELECT user_id % 5 AS part, event_id % 230 AS k, CASE WHEN event_id % 230 = 11 THEN event_id % 230 ELSE event_id END AS r FROM events) SELECT part, count(*) AS preview_rows, count(DISTINCT r) AS unique_row_keys, count(*) FILTER (k = 2) AS model_records, count(*) FILTER (k = 12) AS secret_records, count(*) FILTER (k = 10) AS self_shot_records, count(*) = 0 AS passed FROM e GROUP BY part""",
)
def q4b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.preview_gate(_previews(spark, sf_dir), ["part"], 100).select("part", "preview_rows", "unique_row_keys", "model_records", "secret_records", "self_shot_records", "passed")


@query(
    "q8_readiness",
    """WITH s AS (SELECT o_custkey % 40 AS part, o_orderkey FROM orders), p AS (SELECT o_custkey % 40 AS part, o_orderkey FROM orders WHERE o_custkey % 40 > 5 OR o_orderkey % 50 > 0), g AS (SELECT unnest(range(0, 36)) AS part)
    SELECT s.part, count(*) AS selected_rows, count(p.o_orderkey) AS matched_rows, count(p.o_orderkey) AS preview_rows, count(*) = count(p.o_orderkey) AND s.part % 3 > 0 AND s.part < 36 AS ready FROM s LEFT JOIN p ON p.part = s.part AND p.o_orderkey = s.o_orderkey GROUP BY s.part""",
)
def q8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected rows met by their previews (the join by row key) and both gates' verdicts."""
    s = made(spark, sf_dir, "SELECT o_custkey % 40 AS part, o_orderkey FROM {orders}")
    p = s.filter("part > 5 or o_orderkey % 50 > 0")
    gates = s.filter("part < 36").select("part").distinct().select("part", (F.col("part") % 3 > 0).alias("selection_passed"), F.lit(True).alias("preview_passed"))
    return G.readiness(s, p, ["part"], "o_orderkey", gates).select("part", "selected_rows", "matched_rows", F.coalesce("preview_rows", F.lit(0).cast("long")).alias("preview_rows"), "ready")


@query("q7_paid_gate", "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'paid gate missing or invalid' WHEN 1 THEN 'paid gate did not pass|report has no accepted rows' WHEN 2 THEN 'report has no gate metrics' ELSE '' END AS reasons, s_suppkey % 4 = 3 AS passed FROM supplier")
def q7(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey") % 4
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(k > 0, k > 1).alias("ok"), F.when(k != 2, F.create_map(F.lit("written_rows"), F.when(k == 1, 0.0).otherwise(5.0))).alias("metrics"))
    return G.paid_gate(s, "ok", "metrics").select("s_suppkey", F.array_join("reasons", "|").alias("reasons"), "passed")


def _cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    metrics = F.create_map(F.lit("chrf"), F.lit(30.0) + k % 9, F.lit("bleu"), F.lit(5.0) + k % 4, F.lit("token_f1"), F.lit(20.0) + k % 5, F.lit("ter"), F.lit(60.0) + k % 7, F.lit("false_confidence_rate"), (k % 3).cast("double"))
    artifact = lambda name, exists: F.struct(F.lit(name).alias("name"), F.lit("/x/" + name).alias("path"), exists.alias("exists"))
    artifacts = F.array(artifact("policy_adapter", k % 6 > 0), artifact("metrics", k % 4 > 0), artifact("baseline_metrics", F.lit(False)))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (k % 2 == 0).alias("promoted"), F.when(k % 5 == 0, "first").otherwise("second").alias("stage"), metrics.alias("metrics"), F.when(k % 3 == 0, T.words_of("weak")).alias("promotion_reasons"), (k * 10).alias("hardcases"), artifacts.alias("artifacts"))
    return G.cycle_score(s)


_CYCLES = """WITH c AS (SELECT s_suppkey AS k, s_suppkey % 2 = 0 AS promoted, 30.0 + s_suppkey % 9 AS chrf, 5.0 + s_suppkey % 4 AS bleu, 20.0 + s_suppkey % 5 AS f1, 60.0 + s_suppkey % 7 AS ter FROM supplier),
s AS (SELECT *, CASE WHEN promoted THEN 10.0 ELSE 0 END + 0.45 * chrf + 0.15 * bleu + 0.25 * f1 - 0.03 * ter - 0.05 * (k % 3) + least(5.0, 0.02 * k * 10) - CASE WHEN k % 3 = 0 THEN 2.0 ELSE 0 END AS score FROM c),
j AS (SELECT *, list_filter([CASE WHEN NOT promoted THEN 'cycle is not promoted' END, CASE WHEN k % 5 = 0 THEN 'stage first != second' END, CASE WHEN k % 6 = 0 AND k % 4 = 0 THEN 'missing artifacts 2 > 0: policy_adapter, metrics' WHEN k % 6 = 0 THEN 'missing artifacts 1 > 0: policy_adapter' WHEN k % 4 = 0 THEN 'missing artifacts 1 > 0: metrics' END,
  CASE WHEN k % 6 = 0 THEN 'policy_adapter artifact is missing' END, CASE WHEN chrf < 32 THEN printf('chrf %.4f < 32.0000', chrf::DOUBLE) END, CASE WHEN bleu < 6 THEN printf('bleu %.4f < 6.0000', bleu::DOUBLE) END], lambda x: x IS NOT NULL) AS r FROM s)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycle_gate(_cycles(spark, sf_dir), {"chrf": 32.0, "bleu": 6.0}, 0, "second")


@query("x55_cycle_scores", f"{_CYCLES} SELECT k AS s_suppkey, round(score, 6) AS score FROM s")
def x55(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cycles(spark, sf_dir).select("s_suppkey", F.round("cycle_score", 6).alias("score"))


@query("q6_cycle_gate", f"{_CYCLES} SELECT k AS s_suppkey, array_to_string(r, '|') AS reasons, len(r) = 0 AS passed FROM j")
def q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).select("s_suppkey", F.array_join("reasons", "|").alias("reasons"), "passed")


@query("q11_best_cycle", f"{_CYCLES} SELECT k AS s_suppkey, round(score, 6) AS score FROM j WHERE len(r) = 0 ORDER BY score DESC, chrf DESC, k % 3, k LIMIT 1")
def q11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.best_cycle(_judged(spark, sf_dir), "s_suppkey").select("s_suppkey", F.round("cycle_score", 6).alias("score"))


@query("q12_hardcase_paths", "SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 3 = 0 THEN ['/in/' || (s_suppkey % 4)] WHEN s_suppkey % 4 = 1 THEN ['/out/1', '/in/1'] ELSE ['/out/1', '/in/' || (s_suppkey % 4)] END) AS path FROM supplier")
def q12(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    file = lambda name, path, n: F.struct(F.lit(name).alias("name"), path.alias("path"), n.alias("records"))
    own = F.concat(F.lit("/in/"), (k % 4).cast("string"))
    artifacts = F.array(file("input_hardcases", own, F.lit(None).cast("long")), file("output_hardcases", F.lit("/out/1"), F.when(k % 3 == 0, 0).otherwise(4).cast("long")), file("input_hardcases", own, F.lit(2).cast("long")), file("metrics", F.lit("/m"), F.lit(9).cast("long")))
    return G.hardcase_paths(table(spark, sf_dir, "supplier").select("s_suppkey", artifacts.alias("artifacts")), "s_suppkey", with_inputs=True)


@query("d7_record_counts", "SELECT lang, count(*) AS records, count(*) FILTER (doc_id % 17 = 0) AS invalid_records, count(DISTINCT CASE WHEN doc_id % 17 > 0 THEN md5(text) || source END) AS valid_records FROM documents GROUP BY lang")
def d7(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("doc_id") % 17 > 0, F.col("text")).alias("text"))
    return G.record_counts(d, ["lang"], ["source", "text"])


@query("q5_hardcase_gate", "SELECT lang, array_to_string(list_filter([CASE WHEN valid < 120 THEN printf('valid_records %.0f < 120', valid::DOUBLE) END, CASE WHEN invalid > 0 THEN printf('invalid_records %.0f > 0', invalid::DOUBLE) END], lambda x: x IS NOT NULL), '|') AS reasons FROM (SELECT lang, count(DISTINCT CASE WHEN doc_id % 170 > 0 THEN md5(text) || source END) AS valid, count(*) FILTER (doc_id % 170 = 0) AS invalid FROM documents GROUP BY lang)")
def q5(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source", F.when(F.col("doc_id") % 170 > 0, F.col("text")).alias("text"))
    counts = G.record_counts(d, ["lang"], ["source", "text"])
    return G.judged(counts, [G.below("valid_records", F.col("valid_records"), 120, 0), G.above("invalid_records", F.col("invalid_records"), 0)]).select("lang", F.array_join("reasons", "|").alias("reasons"))


@query(
    "x56_self_labels",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 10) / 10.0 END AS s, (event_id % 13) / 13.0 AS t, event_id % 3 AS a FROM events),
    m AS (SELECT *, CASE WHEN s IS NULL THEN 0 WHEN a = 2 THEN 0.35 WHEN t < 0.45 AND s >= 0.8 THEN 0 WHEN t < 0.65 AND a = 0 THEN 0.35 WHEN t >= 0.82 AND s <= 0.5 THEN 0.45 WHEN t >= 0.82 AND a = 1 THEN 0.65 ELSE 1.0 END AS meta, abs(coalesce(s, 0) - t) AS off FROM e)
    SELECT event_id, round(CASE WHEN s IS NULL THEN 0 WHEN off >= 0.2 AND s > t THEN least(meta, 0.2) WHEN off >= 0.2 AND s < t THEN least(meta, 0.45) WHEN meta < 0.65 THEN meta ELSE greatest(0.8, meta) END, 4) AS score, CASE WHEN s IS NULL THEN 'missing_self_score' WHEN off >= 0.2 AND s > t THEN 'false_confidence_self_score_too_high' WHEN off >= 0.2 AND s < t THEN 'underconfident_or_hallucinated_issues' WHEN meta < 0.65 THEN 'analysis_does_not_match_translation_quality' ELSE 'self_analysis_matches_translation_quality' END AS rationale,
    CASE WHEN s IS NULL THEN 'critical' WHEN off >= 0.2 AND s > t THEN CASE WHEN off >= 0.4 THEN 'critical' ELSE 'major' END WHEN off >= 0.2 AND s < t THEN 'major' WHEN meta < 0.65 THEN 'major' WHEN meta >= 0.9 THEN 'none' ELSE 'minor' END AS severity FROM m""",
)
def x56(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    stated = F.when(k % 11 > 0, k % 10 / F.lit(10.0))
    analysis = F.when(k % 3 == 0, "todo bien y natural").when(k % 3 == 1, "hay un error grave aqui").otherwise("nada")
    label = G.self_judgement_label(stated, analysis, k % 13 / F.lit(13.0))
    return table(spark, sf_dir, "events").select("event_id", label.alias("l")).select("event_id", F.round("l.score", 4).alias("score"), "l.rationale", "l.severity")


@query("a16_payload_stats", "SELECT event_type, min(length(props)) AS least_chars, round(avg(length(props)), 4) AS mean_chars, max(length(props)) AS most_chars, count(*) AS n FROM events GROUP BY event_type")
def a16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.size_stats(table(spark, sf_dir, "events"), ["event_type"], F.char_length("props"))


@query("x9_without_accents", "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM documents WHERE text IS NOT NULL")
def x9(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.md5(F.lower(T.without_accents(F.col("text"))).cast("binary")).alias("digest"))


@query("x10_composed", "SELECT n_nationkey, nfc_normalize(n_name || ' e' || chr(769) || 'n' || chr(771)) AS name FROM nation")
def x10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", T.composed(F.concat("n_name", F.lit(" e\u0301n\u0303"))).alias("name"))


@query("x13_prompt_tokens", """WITH t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]{3,}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ0-9]{3,}'), 1) AS i FROM conversations), f AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id, turn, lower(w) ORDER BY i) = 1) SELECT conv_id, turn, md5(string_agg(w, '|' ORDER BY i)) AS digest FROM f GROUP BY ALL""")
def x13(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.prompt_tokens(F.col("text")).alias("t")).filter(F.size("t") > 0)
    return c.select("conv_id", "turn", F.md5(F.array_join("t", "|").cast("binary")).alias("digest"))


@query("x11_canonical_keys", f"SELECT conv_id, turn, md5(regexp_replace(lower({S.norm('text')}), '[.,]$', '')) AS digest FROM conversations")
def x11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.canonical_key(F.col("text")).cast("binary")).alias("digest"))
