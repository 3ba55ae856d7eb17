import pytest
from pyspark.sql import functions as F

from corpuslab.operators import pairs as P
from corpuslab.operators import pools, reports, retrieval


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_flags_and_quality(spark):
    df = spark.createDataFrame([(1, "La casa de mi abuelo es muy grande.", "Hatun apuypa wasinqa ancha hatunmi kachkan."), (2, "Hola", "Hola"), (3, None, "x")], "id int, source string, target string")
    got = {r["id"]: r for r in P.with_tiers(P.score_pairs(df)).collect()}
    assert got[1]["flags"] in ([], ["weak_quechua_signal"]) and got[1]["quality_score"] >= 0.8
    assert "exact_copy" in got[2]["flags"] and got[2]["quality_score"] == 0 and not got[2]["is_broad"]
    assert got[3]["flags"][0] == "empty_side" and got[3]["source_chars"] == 0


def test_keep_first_and_preferred(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 3, False), ("b", 4, False)], "k string, o int, good boolean")
    assert rows(P.keep_first(df, ["k"], ["o"]), "k") == [("a", 1, False), ("b", 3, False)]
    assert rows(P.keep_preferred(df, ["k"], F.col("good"), ["o"], [F.desc("o")]), "k") == [("a", 2, True), ("b", 4, False)]


def test_drop_leaks_on_either_key(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "s string, t string")
    held = spark.createDataFrame([("a", "q"), ("r", "y")], "hs string, ht string")
    assert rows(P.drop_leaks(df, held, [(F.col("s"), F.col("hs")), (F.col("t"), F.col("ht"))]), "s") == [("c", "z")]


def test_pending_prefers_accepted(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    one = spark.createDataFrame([(1,)], "k int")
    both = spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(P.pending(df, one, both, "k"), "k") == [(1, "existing_accepted"), (2, "existing_failed"), (3, "pending")]


def test_oversample_and_split(spark):
    df = spark.range(100)
    assert P.oversampled(df, F.col("id") < 10, 3).count() == 120
    assert P.oversampled(df, F.col("id") < 10, 1).count() == 100
    split = P.split_by_hash(df, F.col("id"), 7, 0.1)
    assert split.filter("split = 'eval'").count() == 10
    assert P.split_by_hash(df.filter("id = 5"), F.col("id"), 7, 0.1).first()["split"] == "eval"


def test_alternatives_carry_their_prefix(spark):
    df = spark.createDataFrame([("mi casa/hogar",), ("solo",), ("a//b",)], "x string")
    assert rows(P.expand_alternatives(df, "x").select("x", "part_index", "part"), "x", "part_index") == [("a//b", 0, "a"), ("a//b", 1, "b"), ("mi casa/hogar", 0, "mi casa"), ("mi casa/hogar", 1, "mi hogar"), ("solo", 0, "solo")]


def test_pool_merge_drops_what_came_before(spark):
    a = spark.createDataFrame([("g", 0, "p1"), ("g", 1, "p2")], "g string, candidate_index int, prediction string")
    b = spark.createDataFrame([("g", 0, "P2 "), ("g", 1, "p3")], "g string, candidate_index int, prediction string")
    got = pools.merged([a, b], ["g"]).select("prediction", "candidate_index")
    assert rows(got, "candidate_index") == [("p1", 0), ("p2", 1), ("p3", 2)]


def test_best_margin_and_preferences(spark):
    df = spark.createDataFrame([("g", 0, 0.2), ("g", 1, 0.7), ("g", 2, 0.7), ("h", 0, 0.1)], "g string, candidate_index int, s double")
    assert rows(pools.best(df, ["g"], "s"), "g") == [("g", 1, 0.7), ("h", 0, 0.1)]
    m = {r["g"]: r for r in pools.with_margin(df, ["g"], "s").collect()}
    assert m["g"]["margin"] == 0 and m["g"]["candidate_count"] == 3 and m["h"]["margin"] == 0
    assert pools.preferences(df, ["g"], "s", 0.1, "worst").select("chosen_index", "rejected_index").collect() == [(1, 0)]
    assert pools.preferences(df, ["g"], "s", 0.0, "hard").select("chosen_index", "rejected_index").collect() == [(1, 2)]


def test_evenly_spaced_peers(spark):
    df = spark.createDataFrame([("g", i, f"p{i}", [f"p{i}", "x"]) for i in range(7)], "g string, candidate_index int, prediction string, tokens array<string>")
    got = pools.peer_utilities(df, ["g"], most=3).filter("candidate_index = 6").first()
    # of "p6" and "p0" one letter of two agrees, no pair and no word; of their tokens one of two
    assert got["peers"] == 3 and got["utility"] == pytest.approx(0.55 * 0.5 / 3 + 0.30 * 0.5 + 0.15 * 0.5)


def test_votes(spark):
    df = spark.createDataFrame([(1, "x", 9), (1, "y", 0), (2, "x", 0), (2, "x", 1), (3, "z", 1)], "k int, a string, r int")
    assert rows(pools.votes(df, "k", "a", "r"), "k") == [(1, "y", 1, 2, 2, "disagree"), (2, "x", 2, 2, 1, "2-way"), (3, "z", 1, 1, 1, "single")]


def test_exclusive_quantiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 10)] + [("b", 5.0)], "k string, v double")
    got = {r["k"]: r for r in reports.exclusive_quantiles(df, ["k"], "v", {"p10": 0.1, "p50": 0.5}).collect()}
    assert (got["a"]["p10"], got["a"]["p50"], got["b"]["p50"]) == (1.0, 5.0, 5.0)


def test_gate_names_its_reasons(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "k int, v double")
    got = reports.gate(df, [("v_low", F.col("v") >= 6), ("v_high", F.col("v") < 9)])
    assert rows(got.select("k", "reasons", "passed"), "k") == [(1, ["v_low"], False), (2, ["v_low", "v_high"], False)]


def test_terms_longest_first_one_a_target(spark):
    terms = spark.createDataFrame([("casa", "wasi", 1), ("casa grande", "hatun wasi", 2), ("hogar", "wasi", 3), ("as", "x", 4)], "source_term string, target_text string, ord int")
    texts = spark.createDataFrame([(1, "La casa grande y el hogar"), (2, "casas")], "k int, t string")
    got = retrieval.select_terms(texts, "k", "t", retrieval.terminology(terms, 3), 5)
    assert rows(got.select("k", "source_term"), "k", "source_term") == [(1, "casa grande"), (1, "hogar")]
