"""Readers. Row order is data: every reader of lines gives `line`, the number of the line in its file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def parquet_splits(spark: SparkSession, paths: dict[str, str], required: tuple[str, ...] = ()) -> DataFrame:
    """The files one after the other with their split's name; columns a file lacks are null, missing required ones an error."""
    parts = []
    for split, path in paths.items():
        df = spark.read.parquet(path)
        missing = [c for c in required if c not in df.columns]
        if missing:
            raise ValueError(f"{path} lacks {missing}")
        parts.append(df.withColumn("split", F.lit(split)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines numbered from 0 within their file.

    Numbers follow the order in which a file's splits are read; only the splits' sizes meet in one place, so a file of
    any size is numbered in parallel.
    """
    raw = spark.read.text(path).withColumns({"file": F.input_file_name(), "_id": F.monotonically_increasing_id(), "_start": F.col("_metadata.file_block_start")})
    inside = F.row_number().over(W.partitionBy("file", "_start").orderBy("_id"))
    sizes = raw.groupBy("file", "_start").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return raw.withColumn("_in", inside).join(before, ["file", "_start"]).select("file", (F.col("_before") + F.col("_in") - 1).alias("line"), "value")


def zipped_lines(spark: SparkSession, source: str, target: str, strict: bool = True) -> DataFrame:
    """(line, source, target) of two line-aligned files; unequal counts are an error, or the rest is left out."""
    a = numbered_lines(spark, source).select("line", F.regexp_replace("value", "^﻿", "").alias("source"))
    b = numbered_lines(spark, target).select("line", F.regexp_replace("value", "^﻿", "").alias("target"))
    if strict and (n := a.count()) != (m := b.count()):
        raise ValueError(f"{n} and {m} lines")
    return a.join(b, "line")


def tabbed(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """(line, columns) of the rows with exactly as many fields as columns; `line` counts the others too."""
    parts = numbered_lines(spark, path).withColumn("f", F.split("value", "\t"))
    return parts.filter(F.size("f") == len(columns)).select("line", *(F.col("f")[k].alias(c) for k, c in enumerate(columns)))


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line is an error, or is left out. Blank lines don't count. A missing path is an empty relation."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def checked_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, line, the schema's columns) of JSON lines, blank ones left out; a line that is no JSON object fails the query and names file:line."""
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = numbered_lines(spark, path).filter(F.trim("value") != "")
    read = StructType([*wanted.fields, StructField("_bad", StringType())])
    parsed = rows.withColumn("r", F.from_json("value", read, {"columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r._bad").isNotNull() | ~F.trim("value").startswith("{")
    place = F.concat(F.col("file"), F.lit(":"), (F.col("line") + 1).cast("string"), F.lit(" is no JSON object"))
    whole = F.when(bad, F.raise_error(place)).otherwise(F.col("line"))
    return parsed.select("file", whole.alias("line"), *(F.col(f"r.{f.name}").alias(f.name) for f in wanted.fields))


def expanded(patterns: str) -> list[str]:
    """The patterns of a list with commas; Spark expands each one's wildcards."""
    return [p.strip() for p in patterns.split(",") if p.strip()]


def latin_table(spark: SparkSession, path: str, wanted: dict[str, list[str]]) -> DataFrame:
    """A tab-separated Latin-1 file with a header. Each wanted name is the first column whose header equals one of its
    preferences, whatever the case, else the first that holds one of them; a name without one is an error."""
    df = spark.read.option("sep", "\t").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    names = [c.strip().lower() for c in df.columns]
    chosen = {}
    for name, preferences in wanted.items():
        low = [p.lower() for p in preferences]
        at = next((names.index(p) for p in low if p in names), None)
        if at is None:
            at = next((k for p in low for k, c in enumerate(names) if p in c), None)
        if at is None:
            raise ValueError(f"{path} has no column for {name}: {df.columns}")
        chosen[name] = df.columns[at]
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in chosen.items()))


def sources(spark: SparkSession, plain: str | None = None, records: str | None = None, inline: list[str] | None = None, variant: str = "") -> DataFrame:
    """(source, source_name, variant) of a text file's lines, JSON records and given sentences, blanks left out."""
    empty = spark.createDataFrame([], "source string, source_name string, variant string")
    parts = [empty]
    if plain:
        lines = spark.read.text(plain)
        parts.append(lines.select(F.trim("value").alias("source"), F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source_name"), F.lit(variant).alias("variant")))
    if records:
        df = jsonl(spark, records, "source string, source_name string, variant string")
        parts.append(df.select(F.trim("source").alias("source"), F.coalesce("source_name", F.lit("records")).alias("source_name"), F.coalesce("variant", F.lit(variant)).alias("variant")))
    if inline:
        parts.append(spark.createDataFrame([(t.strip(), "inline", variant) for t in inline], empty.schema))
    return reduce(DataFrame.unionByName, parts).filter("source <> ''")


def sentences(spark: SparkSession, path: str, keys: tuple[str, ...] = ("text", "sentence", "input")) -> DataFrame:
    """(sentence) of a CSV (its first cell that isn't blank), JSON lines (the first key that is there) or a text file, by the path's ending."""
    if path.endswith(".csv"):
        df = spark.read.csv(path)
        value = F.coalesce(*(F.nullif(F.trim(F.col(c)), F.lit("")) for c in df.columns))
    elif path.endswith((".jsonl", ".json")):
        df = spark.read.text(path)
        value = F.coalesce(*(F.nullif(F.trim(F.get_json_object("value", f"$.{k}")), F.lit("")) for k in keys))
    else:
        df = spark.read.text(path)
        value = F.nullif(F.trim("value"), F.lit(""))
    return df.select(value.alias("sentence")).filter("sentence is not null")


def pair_columns(df: DataFrame, reviewed: bool) -> DataFrame:
    """(source, target, source_name, variant) from a frame of reviewed or raw pairs, rows with a blank side left out."""
    prefix = "reviewed_" if reviewed else ""
    optional = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in ("source_name", "variant")]
    out = df.select(F.trim(f"{prefix}spanish").alias("source"), F.trim(f"{prefix}chanka_quechua").alias("target"), *optional)
    return out.filter((F.col("source") != "") & (F.col("target") != ""))


def file_facts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, path, exists, is_dir, bytes, lines) of files by name: sizes from the store, lines (blank ones left out) counted by Spark; a missing file has 0 bytes and null lines."""
    conf, rows, parts = spark._jsc.hadoopConfiguration(), [], []
    for name, path in paths.items():
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = hadoop.getFileSystem(conf)
        found = store.exists(hadoop)
        folder = found and store.getFileStatus(hadoop).isDirectory()
        rows.append((name, path, found, folder, int(store.getFileStatus(hadoop).getLen()) if found and not folder else 0))
        if found and not folder:
            parts.append(spark.read.text(path).filter(F.trim("value") != "").agg(F.count("*").alias("lines")).withColumn("name", F.lit(name)))
    facts = spark.createDataFrame(rows, "name string, path string, exists boolean, is_dir boolean, bytes long")
    counts = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "lines long, name string")
    return facts.join(counts, "name", "left")


def newest(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """The records of the file that was modified last, of equal ones the greatest path; `label` is its folder's name."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("multiLine", True).json(glob)
    df = df.select("*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"))
    last = df.agg(F.max(F.struct("changed", "path")).alias("m")).select("m.path")
    return df.join(F.broadcast(last), "path").withColumn("label", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
