import random
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuslab.functions import agreement, overlap
from corpuslab.functions import text as T
from corpuslab.operators import pools


def pools_of(seed, sizes):
    """Groups of short texts with copies, empty texts and nulls."""
    r = random.Random(seed)
    words = ["wasi", "a", "hatun", "ñan.", "漢字", "x", "(runa)", "aaaa"]
    texts = [None, "", *(" ".join(r.choice(words) for _ in range(r.randint(1, 7))) for _ in range(6))]
    return [(g, i, r.choice(texts)) for g, n in enumerate(sizes) for i in range(n)]


def by_pairs(spark, df):
    """The same means from one row for each pair."""
    rows = df.withColumn("tokens", T.metric_tokens(F.col("prediction")))
    other = rows.toDF("g", "p_index", "p_prediction", "p_tokens")
    stats = overlap.chrf_stats(F.col("prediction"), F.col("p_prediction"))
    pairs = rows.join(other, "g").withColumns({"common": overlap.common(F.col("tokens"), F.col("p_tokens")), "chrf": overlap.chrf_of(stats), "n": F.size("tokens"), "m": F.size("p_tokens")})
    found = {}
    for key, part in groupby(pairs.orderBy("g", "candidate_index").collect(), lambda p: (p["g"], p["candidate_index"])):
        part = list(part)
        own = part[0]["prediction"]
        peers = [p for p in part if None not in (own, p["p_prediction"]) and own != p["p_prediction"]] or ([] if own is None else part)
        if peers:
            both = [p for p in peers if p["n"] > 0 and p["m"] > 0]
            found[key] = (len(peers), sum(p["chrf"] for p in peers) / len(peers), sum(2 * p["common"] / (p["n"] + p["m"]) for p in both) / len(peers), sum(p["common"] / p["n"] for p in both) / len(peers))
    return found


@pytest.mark.parametrize("limits", [(1 << 18, 1 << 18, 1 << 20), (40, 9, 3)])
def test_means_equal_those_of_pairs(spark, monkeypatch, limits):
    df = spark.createDataFrame(pools_of(3, [1, 2, 9, 1, 14, 3, 3, 20]), "g int, candidate_index int, prediction string")
    rows = df.withColumns({"tokens": T.metric_tokens(F.col("prediction")), "_letters": overlap.without_space(F.col("prediction")), "_words": overlap.split_words(F.col("prediction"))})
    table = pa.Table.from_pandas(rows.orderBy("g", "candidate_index").toPandas(), preserve_index=False, schema=pa.schema([("g", pa.int32()), ("candidate_index", pa.int32()), ("prediction", pa.string()), ("tokens", pa.list_(pa.string())), ("_letters", pa.string()), ("_words", pa.list_(pa.string()))]))
    for name, limit in zip(("MOST_SYMBOLS", "MOST_PAIRS", "MOST_MEETINGS"), limits, strict=True):
        monkeypatch.setattr(agreement, name, limit)
    got = {}
    for batch in agreement.agreed(iter(table.to_batches(max_chunksize=7)), ["g"], "prediction", ("_letters", "_words", "tokens")):
        got |= {(r["g"], r["candidate_index"]): (r["peers"], r["chrf"], r["f1"], r["precision"]) for r in batch.to_pylist()}
    wanted = by_pairs(spark, df)
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], abs=1e-12) for k in wanted)


def test_a_group_makes_no_row_for_each_pair(spark):
    df = spark.createDataFrame([(0, i, f"runa {i % 700} wasi {i % 7}") for i in range(3000)], "g int, candidate_index int, prediction string")
    found = pools.with_utilities(df.withColumn("tokens", T.metric_tokens(F.col("prediction"))), ["g"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.agg(F.count("*"), F.min("peers"), F.max("peers")).first()
    # 700 texts stand 4 or 5 times
    assert tuple(got) == (3000, 2995, 2996)


def test_counts_take_a_bounded_number_of_symbols_at_once(monkeypatch):
    seen = []
    inner = overlap._shared
    monkeypatch.setattr(overlap, "MOST_SYMBOLS", 100)
    monkeypatch.setattr(overlap, "_shared", lambda sides, orders: seen.append(sum(len(c) for c, _ in sides)) or inner(sides, orders))
    r = np.random.default_rng(1)
    sizes = r.integers(0, 30, (2, 40))
    sides = [(r.integers(97, 100, n.sum()).astype(np.uint64), np.concatenate(([0], np.cumsum(n)))) for n in sizes]
    assert (overlap.shared(sides, 4) == inner(sides, 4)).all()
    assert max(seen) <= 100 and len(seen) > 1
    assert overlap.shared([(np.zeros(0, np.uint64), np.zeros(1, np.int64))] * 2, 2).shape == (0, 2, 3)


def test_signals_of_a_long_text_take_no_square_of_its_words(spark):
    """Filtering the source again for each word took minutes here."""
    import time

    from corpuslab.functions import metrics as M

    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(2000)), " ".join(f"w{i}" for i in range(1000, 3000)) + " de")], "a string, b string")
    tokens = df.select(T.metric_tokens(F.col("a")).alias("a"), T.metric_tokens(F.col("b")).alias("b")).cache()
    began = time.time()
    got = tokens.select(M.source_copy_ratio(F.col("a"), F.col("b")), M.repetition_penalty(F.concat("a", "a"))).first()
    assert tuple(got) == (pytest.approx(0.5), pytest.approx(0.2)) and time.time() - began < 20


def test_named_features_are_summed_in_their_row(spark):
    from corpuslab.operators import features as X

    df = spark.createDataFrame([(1, 0, "wasi wasi Runa", "la casa casa", 2.0, 0.0), (1, 1, None, "", None, 0.5)], "g int, candidate_index int, prediction string, source string, m double, z double")
    found = X.named_features(df, ["g", "candidate_index"], manual=["m", "z"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
    got = {(r["candidate_index"], r["name"]): r["value"] for r in found.collect()}
    assert len(got) == found.count()
    wanted = {"cand_tok:wasi": 2.0, "pool_cand_tok:unknown:wasi": 1.0, "cand_wng:wasi wasi": 1.0, "cand_wng:wasi": 2.0, "src_tok:casa": 1.0, "src_cand:casa->wasi": 4.0, "cand_cng:was": 0.5, "cand_cng: wasi": 0.5, "pool_origin_first:unknown": 1.0, "manual:m": 2.0}
    assert {k: got[0, k] for k in wanted} == wanted and (0, "manual:z") not in got
    assert {k: v for (i, k), v in got.items() if i == 1} == {"pool_origin:unknown": 1.0, "manual:z": 0.5}


def test_only_what_a_query_takes_passes_through_python(spark):
    """The source, its tokens and the reference of each row went to Python and back in all queries on mbr_score (F3 to F8, F18, F19)."""
    from corpuslab.plans import candidates

    found = candidates.scored(spark, "/root/testdata/sf0.001")
    assert not {"source", "source_tokens", "reference", "prediction", "tokens"} & set(found.columns)
    assert {"prediction", "mbr_score", "copied", "utility"} <= set(candidates.scored(spark, "/root/testdata/sf0.001", "prediction").columns)
    df = spark.createDataFrame([(0, 0, "wasi runa", "x"), (0, 1, "wasi", "y")], "g int, candidate_index int, prediction string, other string").withColumn("tokens", T.metric_tokens(F.col("prediction")))
    few, every = (pools.with_utilities(df, ["g"], keep=keep) for keep in (["candidate_index"], None))
    assert few.columns == ["candidate_index", *agreement.COLUMNS, "utility"] and "other" in every.columns
    assert few.orderBy("candidate_index").collect() == every.select(few.columns).orderBy("candidate_index").collect()


def test_the_source_of_a_conversation_is_read_once_and_scores_are_made_once(spark):
    """m10's terms came from the scored rows, so that all was scored twice (F10)."""
    from corpuslab.plans import features

    plan = features.m10(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_ordered_pairs_score_their_rows_once(spark):
    """A join of the scored rows with themselves had two Python workers for each task (F9)."""
    from corpuslab.plans import candidates

    plan = candidates.j10(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
