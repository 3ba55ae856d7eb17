"""Queries for rows taken from printed tables: cells, review decisions, alternatives, glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extraction as X
from ..operators import pairs as P
from .registry import made, plain, query

# a printed table for each customer; every fifth row lacks its role, every fourth its source
_CELLS = """SELECT o_custkey AS tab, o_orderkey AS line, CASE WHEN o_orderkey % 5 = 2 THEN '' ELSE 'P' END AS role,
  CASE WHEN o_orderkey % 4 = 2 OR o_orderkey % 5 = 2 THEN '  ' WHEN o_orderkey % 7 = 3 THEN '¿ Clerk  alto/ bajo ?.' WHEN o_orderkey % 11 = 5 THEN 'una pare ja ja (literalmente)' ELSE 'frase ' || o_orderstatus END AS source,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 7 = 3 THEN 'runa /warmi' WHEN o_orderkey % 3 = 0 THEN 'wasi wasi ( nota )' ELSE 'allin punchaw !.' END AS target FROM {orders}"""


def _clean(c: str) -> str:
    """clean_cell for the values that _CELLS holds."""
    t = f"regexp_replace({c}, ' +', ' ', 'g')"
    for a, b in ((" /", "/"), ("/ ", "/"), ("¿ ", "¿")):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace({t}, ' +([?.!,;:])', '\\1', 'g')"
    for a, b in (("pare ja", "pareja"), ("?.", "?"), ("!.", "!")):
        t = f"replace({t}, '{a}', '{b}')"
    return f"trim({t})"


_FILLED = f"""WITH c AS (SELECT tab, line, role, {_clean('source')} AS source, {_clean('target')} AS target FROM ({plain(_CELLS)})),
st AS (SELECT *, last_value(CASE WHEN role = 'P' AND source <> '' THEN source END IGNORE NULLS) OVER (PARTITION BY tab ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM c),
fl AS (SELECT tab, line, role <> 'P' AS role_filled, source = '' AND prev IS NOT NULL AS source_filled, CASE WHEN source = '' AND prev IS NOT NULL THEN prev ELSE source END AS source, target FROM st WHERE role = 'P' OR (target <> '' AND source = '' AND prev IS NOT NULL)),
nt AS (SELECT *, regexp_matches(source, 'literalmente') AS remark, contains(source || target, '(') AS noted, {_clean("regexp_replace(source, '\([^()]*\)', '', 'g')")} AS s, {_clean("regexp_replace(target, '\([^()]*\)', '', 'g')")} AS t FROM fl),
fg AS (SELECT *, list_filter([CASE WHEN role_filled THEN 'role_filled_from_previous_row' END, CASE WHEN source_filled THEN 'source_filled_from_previous_row' END, CASE WHEN remark THEN 'source_note_removed' END, CASE WHEN noted THEN 'has_context_note' END,
  CASE WHEN contains(t, 'wasi wasi') OR contains(s, ' ja ja') THEN 'adjacent_duplicate_tokens' END, CASE WHEN contains(s, '/') OR contains(t, '/') THEN 'contains_alternative_marker' END, CASE WHEN s = '' OR t = '' THEN 'empty_side' END], lambda x: x IS NOT NULL) AS flags FROM nt)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = X.filled_cells(made(spark, sf_dir, _CELLS), ["tab"], ["line"], "role", "source", "target", "^P$")
    return X.cleaned_rows(filled, "source", "target")


@query("w11_filled_rows", f"{_FILLED} SELECT tab, line, role_filled, source_filled, source FROM fl")
def w11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.filled_cells(made(spark, sf_dir, _CELLS), ["tab"], ["line"], "role", "source", "target", "^P$").select("tab", "line", "role_filled", "source_filled", "source")


@query("p5_cell_flags", f"{_FILLED} SELECT tab, line, s AS source, t AS target, array_to_string(flags, '|') AS flags FROM fg")
def p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("tab", "line", "source", "target", F.array_join("flags", "|").alias("flags"))


_REVIEW = f"""{_FILLED}, rv AS (SELECT *, line % 97 = 1 AS out FROM fg), dc AS (SELECT *, CASE WHEN out THEN 'reviewed_exclude_semantic_mismatch' WHEN list_contains(flags, 'contains_alternative_marker') THEN 'reviewed_keep_needs_split'
  WHEN list_contains(flags, 'source_filled_from_previous_row') THEN 'reviewed_approved_alternative_translation' WHEN noted THEN 'reviewed_approved_context_note_removed' WHEN len(flags) > 0 THEN 'reviewed_approved_flag_checked' ELSE 'auto_passed_table_checks' END AS decision FROM rv)"""


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned_down = made(spark, sf_dir, "SELECT o_custkey AS tab, o_orderkey AS line FROM {orders} WHERE o_orderkey % 97 = 1")
    return X.reviewed(_cells(spark, sf_dir), "source", "target", turned_down, ["tab", "line"])


@query("p6_review_decisions", f"{_REVIEW} SELECT tab, line, decision, NOT out AS include, NOT out AND NOT list_contains(flags, 'contains_alternative_marker') AS training_ready FROM dc")
def p6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select("tab", "line", "decision", "include", "training_ready")


@query("a3_decision_counts", f"{_REVIEW} SELECT decision, count(*) AS n, count(*) FILTER (NOT out) AS kept FROM dc GROUP BY decision")
def a3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).groupBy("decision").agg(F.count("*").alias("n"), F.count_if("include").alias("kept"))


@query(
    "p7_corrections",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'corrected_broken_spanish_word' WHEN c_custkey % 3 = 1 THEN 'corrected_target_punctuation_or_duplicate' ELSE '' END AS corrections, CASE WHEN c_custkey % 3 = 2 THEN 'auto_passed_table_checks' ELSE 'reviewed_corrected' END AS decision, CASE WHEN c_custkey % 3 = 0 THEN 'la pareja' ELSE 'la casa' END AS source, CASE WHEN c_custkey % 3 = 1 THEN '¿wasi?' ELSE 'wasi' END AS target FROM customer",
)
def p7(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = made(spark, sf_dir, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'la pare ja' ELSE 'la casa' END AS source, CASE WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN '¿wasi?.' ELSE '¿wasi?wasi?' END ELSE 'wasi' END AS target FROM {customer}")
    c = c.withColumn("flags", F.array().cast("array<string>"))
    r = X.reviewed(c, "source", "target", c.filter("false"), ["c_custkey"], {"¿wasi?wasi?": "¿wasi?"})
    return r.select("c_custkey", F.array_join("corrections", "|").alias("corrections"), "decision", "source", "target")


@query(
    "p8_glossary_status",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'rich_entry_needs_term_review' WHEN 1 THEN 'rich_entry_needs_term_review' WHEN 2 THEN 'simple_entry_with_alternatives_or_note' WHEN 3 THEN 'simple_entry_with_alternatives_or_note' WHEN 4 THEN 'rich_entry_needs_term_review' ELSE 'simple_term_pair' END AS status FROM part""",
)
def p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = made(spark, sf_dir, "SELECT p_partkey, CASE WHEN p_partkey % 6 = 3 THEN 'uno, dos' ELSE 'uno' END AS term, CASE p_partkey % 6 WHEN 0 THEN 'huk: ' || p_brand WHEN 1 THEN 'huk' || chr(10) || 'iskay' WHEN 2 THEN 'huk (nota)' WHEN 4 THEN 'Herido huk' ELSE 'ejemplos' END AS entry FROM {part}")
    return p.select("p_partkey", X.entry_status(F.col("term"), F.col("entry")).alias("status"))


_ALTERNATIVES = """SELECT c_custkey AS row_id, CASE c_custkey % 5 WHEN 0 THEN 'la hija/o llega' WHEN 1 THEN 'con manta/poncho' WHEN 2 THEN 'uno' WHEN 3 THEN 'a b/c/d' ELSE 'vecino/a' END AS source,
  CASE c_custkey % 4 WHEN 0 THEN 'huk / iskay' WHEN 1 THEN 'huk' WHEN 2 THEN 'x/y/z' ELSE 'p/q' END AS target FROM {customer}"""


@query(
    "j16_alternative_pairs",
    f"""WITH a AS ({plain(_ALTERNATIVES)}), l AS (SELECT row_id, CASE source WHEN 'la hija/o llega' THEN ['la hija llega', 'la hijo llega'] WHEN 'con manta/poncho' THEN ['con manta', 'con poncho'] WHEN 'a b/c/d' THEN ['a b', 'a c', 'a d'] WHEN 'vecino/a' THEN ['vecino', 'vecina'] ELSE [source] END AS s,
      list_transform(string_split(target, '/'), lambda x: trim(x)) AS t FROM a),
    k AS (SELECT *, CASE WHEN len(s) = len(t) THEN 'pairwise' WHEN len(s) = 1 THEN 'duplicate_source' WHEN len(t) = 1 THEN 'duplicate_target' ELSE 'cartesian_review_recommended' END AS strategy FROM l),
    p AS (SELECT row_id, strategy, s, t, i, j FROM k, (SELECT unnest(range(1, 4)) AS i), (SELECT unnest(range(1, 4)) AS j) WHERE i <= len(s) AND j <= len(t) AND (strategy <> 'pairwise' OR i = j))
    SELECT row_id, strategy, row_number() OVER (PARTITION BY row_id ORDER BY i, j) AS split_index, s[i] AS source, t[j] AS target, strategy <> 'cartesian_review_recommended' AS training_ready FROM p""",
)
def j16(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.split_alternatives(made(spark, sf_dir, _ALTERNATIVES), "source", "target")
    return found.select("row_id", "strategy", F.col("split_index").cast("long").alias("split_index"), "source", "target", "training_ready")


_ENTRIES = "SELECT p_partkey, ' ' || p_brand || ' ' AS term, CASE p_partkey % 4 WHEN 0 THEN 'Saqiy, wischuy (algo). Otro: x' WHEN 1 THEN 'huk iskay; kimsá/tawa' WHEN 2 THEN '(nota) pichqa' ELSE '' END AS entry FROM {part}"


@query("g3_glosses", "SELECT p_partkey, lower(p_brand) AS term, unnest(CASE p_partkey % 4 WHEN 0 THEN ['saqiy', 'wischuy'] WHEN 1 THEN ['huk', 'tawa'] ELSE ['pichqa'] END) AS word FROM part WHERE p_partkey % 4 < 3")
def g3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.glosses(made(spark, sf_dir, _ENTRIES), "term", "entry").select("p_partkey", "term", "word")


_FORMS = "SELECT n_nationkey AS k, 'Lugar ' || (n_nationkey % 6) || ' (x), otro' AS term, CASE n_nationkey % 4 WHEN 0 THEN 'wasi; khuru/ñan' WHEN 1 THEN '' WHEN 2 THEN 'sach''a, allpá, mayu' ELSE ' ' END AS cell, CASE n_nationkey % 4 WHEN 1 THEN 'wasi' ELSE 'qhari' END AS lemma FROM {nation}"


@query(
    "g4_cell_forms",
    """WITH f AS (SELECT n_nationkey AS k, 'lugar ' || (n_nationkey % 6) AS term, unnest(CASE n_nationkey % 4 WHEN 0 THEN ['wasi', 'ñan'] WHEN 1 THEN ['wasi'] WHEN 2 THEN ['sach''a', 'mayu'] ELSE [] END) AS form, CASE WHEN n_nationkey % 4 = 1 THEN 'lemma_fallback' ELSE 'high' END AS confidence FROM nation)
    SELECT term, form, confidence, k FROM (SELECT *, row_number() OVER (PARTITION BY term, form ORDER BY confidence = 'high' DESC, CASE WHEN confidence = 'high' THEN k ELSE -k END) AS r FROM f) WHERE r = 1""",
)
def g4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of cells, of equal pairs the first sure one or else the last."""
    found = X.cell_pairs(made(spark, sf_dir, _FORMS), "term", "cell", "lemma")
    return P.keep_preferred(found, ["term", "form"], F.col("confidence") == "high", ["k"], [F.desc("k")]).select("term", "form", "confidence", "k")


@query("x25_plain_spelling", "SELECT s_suppkey, s_suppkey % 5 IN (0, 4) AS plain FROM supplier")
def x25(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = made(spark, sf_dir, "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Allin runa' WHEN 1 THEN 'ñan qhari' WHEN 2 THEN 'llaqtá' WHEN 3 THEN 'k''anchay' ELSE 'sumaqkhu' END AS word FROM {supplier}")
    return s.select("s_suppkey", X.looks_plain(F.col("word")).alias("plain"))
