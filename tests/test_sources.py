import json

import pytest
from pyspark.sql import functions as F

from corpuslab.functions import orthography as O
from corpuslab.operators import examples as X
from corpuslab.operators import scoring
from corpuslab.sources import readers, writers
from corpuslab.streaming import ledger


def test_zipped_lines(spark, tmp_path):
    (tmp_path / "a").write_text("﻿uno\ndos\ntres\n")
    (tmp_path / "b").write_text("huk\niskay\n")
    got = readers.zipped_lines(spark, str(tmp_path / "a"), str(tmp_path / "b"), strict=False)
    assert [tuple(r) for r in got.orderBy("line").collect()] == [(0, "uno", "huk"), (1, "dos", "iskay")]
    with pytest.raises(ValueError, match="3 and 2 lines"):
        readers.zipped_lines(spark, str(tmp_path / "a"), str(tmp_path / "b"))


def test_line_numbers_over_splits(spark, tmp_path):
    (tmp_path / "a").write_text("".join(f"row {k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "a"))
        assert got.rdd.getNumPartitions() >= 1 and got.filter("value <> concat('row ', line)").count() == 0 and got.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_tabbed_keeps_numbers(spark, tmp_path):
    (tmp_path / "a").write_text("a\tb\tc\nbad\nd\te\tf\n")
    assert [tuple(r) for r in readers.tabbed(spark, str(tmp_path / "a"), ("x", "y", "z")).orderBy("line").collect()] == [(0, "a", "b", "c"), (2, "d", "e", "f")]


def test_jsonl_strict_lenient_missing(spark, tmp_path):
    (tmp_path / "a").write_text('{"k": 1}\n\n{bad\n{"k": 2}\n')
    assert readers.jsonl(spark, str(tmp_path / "a"), "k int", strict=False).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "a"), "k int").collect()
    assert readers.jsonl(spark, str(tmp_path / "none"), "k int").count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "ñ")], "z int, flags array<string>, a string")
    writers.tier(df, str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t/csv")).first()["flags"] == "a|b"
    writers.jsonl(df, str(tmp_path / "j"))
    assert list(json.loads(spark.read.text(str(tmp_path / "j")).first()["value"])) == ["a", "flags", "z"]
    assert "| z | flags | a |" in writers.markdown(df) and json.loads(writers.metrics(df))["a"] == "ñ"
    both = readers.parquet_splits(spark, {"x": str(tmp_path / "t/parquet")}, ("z",))
    assert both.first()["split"] == "x"


def test_ledger_takes_each_key_once_across_runs(spark, tmp_path):
    src, out, ck = (str(tmp_path / d) for d in ("src", "out", "ck"))
    for k, rows in enumerate(([(1, "a"), (1, "b")], [(1, "c"), (2, "d")])):
        spark.createDataFrame(rows, "key int, v string").coalesce(1).write.mode("append").json(src)
        ledger.append(ledger.first_outcomes(ledger.outcomes(spark, src, "key int, v string"), "key"), out, ck).awaitTermination()
        assert spark.read.schema("key int, v string").json(out).count() == k + 1


def test_spelling_gate(spark):
    df = spark.createDataFrame([("Jatun k'ita vaca", "Hatun kita waka"), ("radio nisqapi", "radiopi"), ("allin runa", "allin runakuna"), ("a b", "a b c")], "o string, p string")
    got = [tuple(r) for r in df.select(O.verified(F.col("o"), F.col("p")).alias("x"), O.corruptions(F.col("o"), F.col("p")).alias("c"), O.veto(F.col("o"), F.col("p")).alias("v")).collect()]
    assert [g[0]["text"] for g in got] == ["Hatun kita waka", "radiopi", "allin runa", "a b"]
    assert got[2][0]["vetoed"] == 1 and got[3][0]["mismatch"] and [g[1] for g in got] == [0, 2, 1, 3]
    assert got[2][2] == "length_explosion" and got[3][2] == "token_count_increased" and got[0][2] is None


def test_fill_down_and_chunks(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, " "), (4, "b")], "o int, s string").withColumn("g", F.lit(1))
    assert [r["s"] for r in X.filled_down(df, ["g"], ["o"], "s").orderBy("o").collect()] == ["a", "a", "a", "b"]
    assert [(r["chunk"], r["place"]) for r in X.chunked(df, ["g"], ["o"], 3).orderBy("o").collect()] == [(0, 0), (0, 1), (0, 2), (1, 0)]


def test_sparse_scores(spark):
    import zlib

    df = spark.createDataFrame([(1, ["a", "b", "a"])], "k int, t array<string>")
    f = scoring.sparse_features(df, ["k"], {"tok": (F.col("t"), 1.0)}, 1 << 20)
    index = zlib.crc32(b"tok:a") % (1 << 20)
    assert f.filter(f"index = {index}").first()["value"] == 2.0
    w = spark.createDataFrame([(index, 0.5)], "index long, weight double")
    assert scoring.sparse_scores(f, ["k"], w).first()["score"] == 1.0


def test_checked_jsonl_names_file_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert [(r["line"], r["k"]) for r in readers.checked_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").orderBy("line").collect()] == [(0, 1), (2, 2)]
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n{bad\n')
    with pytest.raises(Exception, match="b.jsonl:2"):
        readers.checked_jsonl(spark, str(tmp_path / "b.jsonl"), "k int").collect()


def test_readers_of_many_forms(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes("Spanish gloss\tChanka\tnota\nniño\twawa\tx\n".encode("latin-1"))
    got = readers.latin_table(spark, str(tmp_path / "t.tsv"), {"es": ["spanish", "gloss"], "qu": ["chanka"]}).first()
    assert (got["es"], got["qu"]) == ("niño", "wawa")
    with pytest.raises(ValueError, match="no column for z"):
        readers.latin_table(spark, str(tmp_path / "t.tsv"), {"z": ["missing"]})
    (tmp_path / "s.txt").write_text("uno\n \ndos\n")
    (tmp_path / "s.jsonl").write_text('{"source": "tres", "variant": "v"}\n')
    rows = readers.sources(spark, str(tmp_path / "s.txt"), str(tmp_path / "s.jsonl"), ["cuatro", " "], "d").orderBy("source").collect()
    assert [(r["source"], r["source_name"], r["variant"]) for r in rows] == [("cuatro", "inline", "d"), ("dos", "s.txt", "d"), ("tres", "records", "v"), ("uno", "s.txt", "d")]
    (tmp_path / "c.csv").write_text(",huk\niskay,x\n")
    (tmp_path / "k.jsonl").write_text('{"sentence": "a"}\n{"text": "b"}\n{"other": 1}\n')
    assert sorted(r[0] for r in readers.sentences(spark, str(tmp_path / "c.csv")).collect()) == ["huk", "iskay"]
    assert sorted(r[0] for r in readers.sentences(spark, str(tmp_path / "k.jsonl")).collect()) == ["a", "b"]
    assert sorted(r[0] for r in readers.sentences(spark, str(tmp_path / "s.txt")).collect()) == ["dos", "uno"]
    assert readers.expanded("a*.json, b.json ,") == ["a*.json", "b.json"]
    df = spark.createDataFrame([(" a ", "b"), ("", "c")], "reviewed_spanish string, reviewed_chanka_quechua string")
    assert [tuple(r) for r in readers.pair_columns(df, True).collect()] == [("a", "b", None, None)]


def test_file_facts_and_reports(spark, tmp_path):
    (tmp_path / "f.jsonl").write_text("{}\n\n{}\n")
    facts = {r["name"]: r for r in readers.file_facts(spark, {"f": str(tmp_path / "f.jsonl"), "none": str(tmp_path / "none"), "dir": str(tmp_path)}).collect()}
    assert facts["f"]["lines"] == 2 and facts["f"]["bytes"] == 7 and not facts["none"]["exists"] and facts["dir"]["is_dir"]
    df = spark.createDataFrame([(1, 0.5)], "a int, b double")
    assert "## Counts" in writers.sections({"Counts": df}) and "1,0.5000" in writers.sections({"Counts": df})
    with pytest.raises(ValueError, match="more than 3 rows"):
        writers.markdown(spark.range(5), most=3)
    nested = spark.createDataFrame([((1, [(2, 3)]),)], "z struct<y:int,x:array<struct<b:int,a:int>>>")
    writers.jsonl(nested, str(tmp_path / "n"))
    assert spark.read.text(str(tmp_path / "n")).first()["value"] == '{"z":{"x":[{"a":3,"b":2}],"y":1}}'
