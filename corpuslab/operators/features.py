"""Features of candidates: consensus, copying, terminology and origin; dense rows, sparse hashed rows and ensembles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import metrics as M
from ..functions import overlap
from ..functions import text as T
from ..functions.fixed import LEAKAGE_WORDS, POOL_ORIGINS

DENSE = (
    "mbr_score", "mbr_rank", "mbr_gap_to_best", "duplicate_rate", "length_consensus", "source_copy_ratio", "source_root_copy_ratio", "spanish_leakage_penalty", "chat_artifact_penalty", "repetition_penalty",
    "exact_source_copy", "terminology_target_coverage", "terminology_source_root_leakage", "candidate_index_fraction", "target_token_count", "target_source_token_ratio",
)
MOST_NAMES = 1 << 17
ORIGINS = ("current", "qwen35_4b_full", "qwen35_9b", "other", "unknown")


def significant(tokens: Column) -> Column:
    """Tokens of four letters or more that are no leakage words."""
    return F.filter(tokens, lambda t: (F.char_length(t) >= 4) & ~F.array_contains(T.words_of(*LEAKAGE_WORDS), t))


def _begun(tokens: Column, root: Column) -> Column:
    """Whether a token begins with the root."""
    return F.exists(tokens, lambda t: F.startswith(t, root))


def covered(tokens: Column, term: Column) -> Column:
    """Whether every significant token of the term begins one of the tokens."""
    roots = significant(T.metric_tokens(term))
    return (F.size(roots) > 0) & F.forall(roots, lambda r: _begun(tokens, r))


def root_copy_ratio(source_tokens: Column, tokens: Column) -> Column:
    """The share of the source's significant tokens with which one of the tokens begins."""
    roots = significant(source_tokens)
    return F.when((F.size(roots) > 0) & (F.size(tokens) > 0), F.size(F.filter(roots, lambda r: _begun(tokens, r))) / F.size(roots)).otherwise(0.0)


def term_features(terms: Column, tokens: Column) -> tuple[Column, Column]:
    """(share of the terms whose target is covered, share of the source terms' roots that leak where it isn't) of array<struct<source_term, target_text>>."""
    named = F.transform(terms, lambda t: F.struct(covered(tokens, t["target_text"]).alias("ok"), significant(T.metric_tokens(t["source_term"])).alias("roots"), F.lower(t["target_text"]).alias("target")))
    done = F.transform(F.filter(named, lambda t: t["ok"]), lambda t: t["target"])
    checked = F.aggregate(named, F.lit(0), lambda n, t: n + F.size(t["roots"]))
    leaked = F.aggregate(F.filter(named, lambda t: ~F.array_contains(done, t["target"])), F.lit(0), lambda n, t: n + F.size(F.filter(t["roots"], lambda r: _begun(tokens, r))))
    some = F.size(F.coalesce(terms, F.array())) > 0
    return F.when(some, F.size(done) / F.size(terms)).otherwise(0.0), F.when(some, leaked / F.greatest(checked, F.lit(1))).otherwise(0.0)


def origin(path: Column) -> Column:
    """The kind of system that a pool came from, by parts of its path; unknown without a path."""
    t = F.replace(F.lower(path), F.lit("-"), F.lit("_"))
    out = F.lit("other")
    for name, marks in reversed(list(POOL_ORIGINS.items())):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks]), name).otherwise(out)
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown").otherwise(out)


def dense_features(scored: DataFrame, keys: list[str], terms: str | None = None, path: str | None = None) -> DataFrame:
    """The features DENSE and origin_<kind> of each candidate, from rows with signals, length_consensus and mbr_score.

    `terms` names an array of selected terms, `path` a pool path; without them these features are 0 and unknown. Equal
    scores rank the higher index better.
    """
    g = W.partitionBy(*keys)
    last = F.greatest(F.lit(1), F.count("*").over(g) - 1)
    place = F.row_number().over(g.orderBy(F.desc("mbr_score"), F.desc("candidate_index"))) - 1
    same = W.partitionBy(*keys, F.lower(T.normalize_space(F.col("prediction"))))
    coverage, leakage = term_features(F.col(terms), F.col("tokens")) if terms else (F.lit(0.0), F.lit(0.0))
    values = {
        "mbr_rank": 1.0 - place / last,
        "mbr_gap_to_best": F.col("mbr_score") - F.max("mbr_score").over(g),
        "duplicate_rate": F.count("*").over(same) / F.count("*").over(g),
        "source_copy_ratio": F.col("copied"),
        "source_root_copy_ratio": root_copy_ratio(F.col("source_tokens"), F.col("tokens")),
        "spanish_leakage_penalty": F.col("leak"),
        "chat_artifact_penalty": F.col("artifacts"),
        "repetition_penalty": F.col("repeated"),
        "exact_source_copy": F.col("exact").cast("double"),
        "terminology_target_coverage": coverage,
        "terminology_source_root_leakage": leakage,
        "candidate_index_fraction": F.col("candidate_index") / last,
        "target_token_count": F.col("n_tokens").cast("double"),
        "target_source_token_ratio": F.col("n_tokens") / F.greatest(F.lit(1), F.size("source_tokens")),
    }
    kind = origin(F.col(path)) if path else F.lit("unknown")
    return scored.withColumns(values).withColumns({f"origin_{o}": (kind == o).cast("double") for o in ORIGINS})


def text_tokens(c: Column) -> Column:
    """Lower-case words that may hold hyphens and apostrophes inside."""
    raw = F.regexp_extract_all(F.lower(T.normalize_space(c)), F.lit(r"([\p{L}\p{N}_ʼ’'-]+)"), 1)
    return F.filter(F.transform(raw, lambda t: F.btrim(t, F.lit("-'ʼ’"))), lambda t: t != "")


def padded_ngrams(c: Column, least: int, most: int) -> Column:
    """Character n-grams of the normalised lower-case text between two spaces, blanks left out."""
    t = F.concat(F.lit(" "), F.lower(T.normalize_space(c)), F.lit(" "))
    n = F.char_length(t)

    def of(size: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(size)))
        return F.when(n >= size, F.filter(grams, lambda g: F.trim(g) != "")).otherwise(F.array().cast("array<string>"))

    return F.concat(*(of(size) for size in range(least, most + 1)))


def named_features(df: DataFrame, keys: list[str], manual: list[str] | None = None, path: str | None = None, most_source: int = 24, most_tokens: int = 80, words: int = 2, letters: tuple[int, int] = (3, 5)) -> DataFrame:
    """(keys, name, value): what a candidate's text gives to a sparse model, in eight namespaces.

    manual (standardised columns), pool_origin and pool_origin_first, cand_tok, pool_cand_tok (half), cand_wng, cand_cng (a
    quarter), src_tok (half) and src_cand, every pair of a source and a candidate token (bounded by the two limits, which
    are the features' definition). Equal names of a row add up, in the row itself; zeros are left out. The keys tell rows apart.
    """
    rows = named_arrays(df, keys, manual, path, most_source, most_tokens, words, letters).select(*keys, F.explode(F.arrays_zip("names", "values")).alias("f"))
    return rows.select(*keys, F.col("f.names").alias("name"), F.col("f.values").alias("value"))


def named_arrays(df: DataFrame, keys: list[str], manual: list[str] | None = None, path: str | None = None, most_source: int = 24, most_tokens: int = 80, words: int = 2, letters: tuple[int, int] = (3, 5)) -> DataFrame:
    """(keys, names, values): named_features() with one row for each candidate, so nothing is sorted or shuffled."""
    kind = origin(F.col(path)) if path else F.lit("unknown")
    tokens = F.slice(F.filter(text_tokens(F.col("prediction")), lambda t: F.char_length(t) >= 2), 1, most_tokens)
    source = F.slice(F.filter(text_tokens(F.col("source")), lambda t: (F.char_length(t) >= 3) & ~F.array_contains(T.words_of(*LEAKAGE_WORDS), t)), 1, most_source)
    body = F.concat(F.lit(" "), F.lower(T.normalize_space(F.col("prediction"))), F.lit(" "))
    given = F.array(*(F.col(name).cast("double") for name in manual or ())).cast("array<double>")
    rows = df.select(*keys, kind.alias("_k"), (F.col("candidate_index") == 0).alias("_first"), tokens.alias("_t"), source.alias("_s"), body.alias("_p"), given.alias("_m"))
    schema = StructType([*rows.select(*keys).schema, StructField("names", ArrayType(StringType())), StructField("values", ArrayType(DoubleType()))])
    return rows.mapInArrow(lambda batches: _named(batches, len(keys), tuple(manual or ()), words, letters), schema)


def _names(kind: str, first: bool, tokens: list[str], source: list[str], body: str, manual: Iterable[tuple[str, float | None]], words: int, letters: tuple[int, int]) -> dict[str, float]:
    """named_features() of a row. No name stands in two namespaces, so equal ones are counted before they are spelt out."""
    t = Counter(tokens)
    out = {f"manual:{name}": value for name, value in manual if value}
    out[f"pool_origin:{kind}"] = 1.0
    if first:
        out[f"pool_origin_first:{kind}"] = 1.0
    for x, n in t.items():
        out["cand_tok:" + x] = 1.0 * n
        out[f"pool_cand_tok:{kind}:{x}"] = 0.5 * n
    grams = Counter(" ".join(tokens[i : i + n]) for n in range(1, words + 1) for i in range(len(tokens) - n + 1))
    out |= {"cand_wng:" + x: 1.0 * n for x, n in grams.items()}
    parts = Counter(body[i : i + n] for n in range(letters[0], letters[1] + 1) for i in range(len(body) - n + 1))
    out |= {"cand_cng:" + x: 0.25 * n for x, n in parts.items() if x.strip(" ")}
    for x, n in Counter(source).items():
        out["src_tok:" + x] = 0.5 * n
        prefix = f"src_cand:{x}->"
        out |= {prefix + y: 1.0 * n * m for y, m in t.items()}
    return out


def _named(batches: Iterator[pa.RecordBatch], keys: int, manual: tuple[str, ...], words: int, letters: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (keys, names, values), some MOST_NAMES names at once."""
    for batch in batches:
        at, names, values, sizes = 0, [], [], []
        columns = [batch.column(keys + k) for k in range(6)]
        for i in range(batch.num_rows):
            kind, first, tokens, source, body, given = (c[i].as_py() for c in columns)
            found = _names(kind, first, tokens, source, body, zip(manual, given, strict=True), words, letters)
            names += found.keys()
            values += found.values()
            sizes.append(len(found))
            if len(names) >= MOST_NAMES or i + 1 == batch.num_rows:
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(names, pa.string()), pa.array(values, pa.float64()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, i + 1 - at) for k in range(keys)), *lists], [*batch.schema.names[:keys], "names", "values"])
                at, names, values, sizes = i + 1, [], [], []


def hashed(named: DataFrame, keys: list[str], size: int = 1 << 20) -> DataFrame:
    """(keys, index, value) of named features: crc32(name) mod size."""
    return named.groupBy(*keys, (F.crc32(F.col("name").cast("binary")) % size).alias("index")).agg(F.sum("value").alias("value"))


def ensemble(df: DataFrame, keys: list[str], weights: dict[str, float]) -> Column:
    """The weighted sum of a row's columns, each standardised in its group (population deviation, 1 where it vanishes)."""
    w = W.partitionBy(*keys)

    def z(c: str) -> Column:
        spread = F.stddev_pop(c).over(w)
        return (F.col(c) - F.avg(c).over(w)) / F.when(F.coalesce(spread, F.lit(0.0)) <= 1e-9, 1.0).otherwise(spread)

    return reduce(lambda a, b: a + b, [z(c) * float(v) for c, v in weights.items()])


def consensus_signals(df: DataFrame, keys: list[str], most: int = 12) -> DataFrame:
    """df (with signals and length_consensus) with the mean agreement with its peers: pairwise_chrf, _bleu, _token_f1, _precision and _jaccard (approximate n-gram scores), and duplicate_rate and index_fraction.

    Peers have another prediction, `most` of them evenly spaced; without any a candidate is its own peer.
    """
    rows = df.select(*keys, "candidate_index", "prediction", "tokens")
    other = rows.select(*keys, *(F.col(c).alias(f"p_{c}") for c in ("candidate_index", "prediction", "tokens")))
    w = W.partitionBy(*keys, "candidate_index")
    pairs = rows.join(other, keys)
    differs = F.col("prediction") != F.col("p_prediction")
    pairs = pairs.withColumn("_any", F.max(differs.cast("int")).over(w)).filter(differs | ((F.col("_any") == 0) & (F.col("candidate_index") == F.col("p_candidate_index"))))
    n = F.count("*").over(w)
    wanted = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * F.col("_step")).cast("int"))
    pairs = pairs.withColumns({"_n": n, "_place": F.row_number().over(w.orderBy("p_candidate_index")) - 1, "_step": (n - 1) / F.lit(max(most - 1, 1))})
    pairs = pairs.filter((F.col("_n") <= most) | F.array_contains(wanted, F.col("_place")))
    t, p = F.col("tokens"), F.col("p_tokens")
    both, common = (F.size(t) > 0) & (F.size(p) > 0), F.col("_common")
    pairs = pairs.withColumn("_common", overlap.common(t, p))
    signals = {
        "pairwise_chrf": M.fast_chrf(F.col("prediction"), F.col("p_prediction")),
        "pairwise_bleu": M.fast_bleu(t, p),
        "pairwise_token_f1": F.when(both, 2.0 * common / (F.size(t) + F.size(p))).otherwise(0.0),
        "pairwise_precision": F.when(both, common / F.size(t)).otherwise(0.0),
        "pairwise_jaccard": T.jaccard(t, p),
    }
    means = pairs.select(*keys, "candidate_index", *(v.alias(k) for k, v in signals.items())).groupBy(*keys, "candidate_index").agg(F.count("*").alias("n_peers"), *(F.avg(k).alias(k) for k in signals))
    g = W.partitionBy(*keys)
    norm = F.lower(T.normalize_space(F.col("prediction")))
    own = {"duplicate_rate": F.when(norm == "", 0.0).otherwise(F.count("*").over(W.partitionBy(*keys, norm)) / F.count("*").over(g)), "index_fraction": F.col("candidate_index") / F.greatest(F.lit(1), F.max("candidate_index").over(g))}
    return df.withColumns(own).join(means, [*keys, "candidate_index"])
