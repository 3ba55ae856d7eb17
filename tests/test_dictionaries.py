from corpuslab.operators import dictionaries as D
from corpuslab.operators import pairs as P


def test_entries_run_over_lines(spark):
    lines = ["A", "12", "wasi/uta sust. casa (grande),", "hogar; a.", "puriy v.int/v.tr. andar.", "broken line", "mayu sust. río.", "tail adj. x"]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)] + [(2, 0, "allin adj. bueno, rico.")], "part int, line int, text string")
    got = [tuple(r) for r in D.entries(df, ["part"], "line", "text", ["A"]).orderBy("part", "headword", "gloss").collect()]
    assert got == [(1, "broken line mayu", "río"), (1, "puriy", "andar"), (1, "wasi", "casa"), (1, "wasi", "hogar"), (2, "allin", "bueno"), (2, "allin", "rico")]
    assert D.entries(df.limit(0), ["part"], "line", "text", ["A"]).count() == 0


def test_line_entries_and_merge(spark):
    df = spark.createDataFrame([("abandonar saqiy; wischuy algo.",), ("alegrar (a otro) kusichiy",), ("solo",), ("hablar bien rimay/parlay",)], "text string")
    got = sorted((r["headword"], r["form"]) for r in D.line_entries(df, "text", []).collect())
    assert got == [("abandonar", "saqiy"), ("abandonar", "wischuy"), ("alegrar", "kusichiy"), ("hablar bien", "parlay"), ("hablar bien", "rimay")]
    found = D.line_entries(df, "text", [])
    assert {r["headword"]: r["values"] for r in D.merged([found, found], "headword", "form").collect()}["abandonar"] == ["saqiy", "wischuy"]


def test_rows_that_contain_a_passage_go(spark):
    held = spark.createDataFrame([("One two three FOUR five six",), ("short one",), ("  ",), (None,)], "p string")
    df = spark.createDataFrame([(0, "x one  two three four five\nsix y"), (1, "one two three four five seven"), (2, "a short one"), (3, "a shortone"), (4, None), (5, "")], "k int, t string")
    from pyspark.sql import functions as F

    assert sorted(r["k"] for r in P.drop_containing(df, held, F.col("t"), F.col("p")).collect()) == [1, 3, 4, 5]
    assert P.drop_containing(df, held.limit(0), F.col("t"), F.col("p")).columns == ["k", "t"]
