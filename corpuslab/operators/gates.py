"""Gates over records of metrics, manifests and requests: each gives the list of reasons why a record fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions import rewards as R
from ..functions import text as T
from ..functions.fixed import THEMES


def below(name: str, value: Column, least: float, digits: int = 4) -> Column:
    """`name v < least` where the value (null: 0) is below; a limit of 0 or less asks nothing."""
    v = F.coalesce(value, F.lit(0.0)).cast("double")
    text = F.format_string(f"%s %.{digits}f < %.{digits}f", F.lit(name), v, F.lit(float(least)))
    return F.when(F.lit(least > 0) & (v < least), text)


def above(name: str, value: Column, most: float, digits: int = 0) -> Column:
    v = F.coalesce(value, F.lit(0.0)).cast("double")
    return F.when(v > most, F.format_string(f"%s %.{digits}f > %.{digits}f", F.lit(name), v, F.lit(float(most))))


def judged(df: DataFrame, failures: list[Column]) -> DataFrame:
    """df with reasons (the messages that apply, in order) and passed."""
    return df.withColumn("reasons", F.array_compact(F.array(*failures))).withColumn("passed", F.size("reasons") == 0)


def analysis_counts(rows: DataFrame, keys: list[str], least_tags: int, least_words: int) -> DataFrame:
    """Counts and rates of accepted rows for each key, from rows with tags, words, specific, expected, missing, audit (pass, score) and matches (see analyses.described). Shares of nothing are 0."""
    n = F.greatest(F.lit(1), F.count("*"))
    some = F.size("expected") > 0
    return rows.groupBy(*keys).agg(
        F.count("*").alias("written_rows"),
        (F.sum(F.size("tags")) / n).alias("avg_primitive_tags"),
        (F.count_if(F.size("tags") >= least_tags) / n).alias("primitive_row_rate"),
        F.size(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("distinct_primitives"),
        F.count_if(some).alias("expected_rows"),
        (F.count_if(some & (F.size("missing") == 0)) / F.greatest(F.lit(1), F.count_if(some))).alias("expected_primitive_coverage"),
        (F.sum("words") / n).alias("avg_analysis_words"),
        (F.count_if(F.col("words") >= least_words) / n).alias("analysis_word_row_rate"),
        (F.count_if("specific") / n).alias("specific_analysis_rate"),
        (F.count_if(F.col("audit").isNotNull()) / n).alias("audited_row_rate"),
        (F.count_if(F.coalesce(F.col("audit.pass"), F.lit(False))) / n).alias("audit_pass_rate"),
        F.coalesce(F.avg("audit.score"), F.lit(0.0)).alias("avg_audit_score"),
        (F.count_if("matches") / n).alias("reference_final_match_rate"),
    )


def analysis_gate(counts: DataFrame, limits: dict[str, float]) -> DataFrame:
    """counts (with failed_rows) judged by the limits; accept_rate is of written and failed rows. A limit of 0 asks nothing."""
    rate = F.col("written_rows") / F.greatest(F.lit(1), F.col("written_rows") + F.coalesce("failed_rows", F.lit(0)))
    counts = counts.withColumn("accept_rate", rate)
    whole = {"written_rows", "distinct_primitives"}
    return judged(counts, [below(k, F.col(k), v, 0 if k in whole else 4) for k, v in limits.items()])


def tag_counts(rows: DataFrame, keys: list[str], tags: str) -> DataFrame:
    """(keys, tag, n) of an array of tags; each row counts a tag once."""
    return rows.select(*keys, F.explode(F.array_distinct(tags)).alias("tag")).groupBy(*keys, "tag").agg(F.count("*").alias("n"))


def selection_gate(report: DataFrame, least_rows: int, least_distinct: int, least_average: float, least_each: int, most_requests: int = 0) -> DataFrame:
    """report (selected_rows, counts map<tag, long>, estimated_requests) judged: rows, distinct tags, tags a row, each known tag, requests."""
    count = lambda tag: F.coalesce(F.try_element_at("counts", F.lit(tag)), F.lit(0))
    values = F.map_values("counts")
    average = F.aggregate(values, F.lit(0).cast("long"), lambda a, v: a + v) / F.greatest(F.lit(1), F.col("selected_rows"))
    report = report.withColumns({"distinct_tags": F.size(F.filter(values, lambda v: v > 0)), "avg_tags": average})
    failures = [below("selected_rows", F.col("selected_rows"), least_rows, 0), below("distinct_tags", F.col("distinct_tags"), least_distinct, 0), below("avg_tags", F.col("avg_tags"), least_average)]
    failures += [below(f"counts[{tag}]", count(tag), least_each, 0) for tag in THEMES]
    if most_requests:
        failures.append(above("estimated_requests", F.col("estimated_requests"), most_requests))
    return judged(report, failures)


def preview_records(records: DataFrame, model: str, markers: list[str], line_start: str) -> DataFrame:
    """records (row_key, payload struct, expected, few_shot_keys) with faults: the names of what is wrong with each request."""
    p = F.col("payload")
    messages = F.coalesce(p["messages"], F.array().cast("array<struct<role:string,content:string>>"))
    prompt = F.array_join(F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: F.coalesce(m["content"], F.lit(""))), "\n")
    line = F.coalesce(F.try_element_at(F.filter(F.split(prompt, "\n"), lambda x: F.startswith(x, F.lit(line_start))), F.lit(1)), F.lit(""))
    expected = F.coalesce("expected", F.array().cast("array<string>"))
    tests = {
        "secret": parsing.has_secret(F.struct(*records.columns)),
        "no_payload": p.isNull(),
        "model": p.isNotNull() & ~F.coalesce(p["model"] == model, F.lit(False)),
        "shape": p.isNotNull() & ((F.size(messages) == 0) | F.exists(messages, lambda m: m["role"].isNull() | m["content"].isNull())),
        "thinking": p.isNotNull() & ~F.coalesce(p["thinking"] == "enabled", F.lit(False)),
        "json": p.isNotNull() & ~F.coalesce(p["response_format"] == "json_object", F.lit(False)),
        "no_expected": F.size(expected) == 0,
        "missing_tags": F.exists(expected, lambda t: ~F.contains(line, t)),
        "no_tag_line": line == "",
        "vacuous": ~F.forall(T.words_of(*markers), lambda m: F.contains(prompt, m)),
        "self_shot": F.coalesce(F.array_contains("few_shot_keys", F.col("row_key")), F.lit(False)),
    }
    return records.withColumn("faults", F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items()))))


def preview_gate(records: DataFrame, keys: list[str], least_rows: int, selected: DataFrame | None = None) -> DataFrame:
    """A row for each key of judged records: how many have each fault, distinct row keys, and whether all is well.

    `selected` (keys, selected_rows) asks for as many records as rows were selected.
    """
    names = ["secret", "no_payload", "model", "shape", "thinking", "json", "no_expected", "missing_tags", "no_tag_line", "vacuous", "self_shot"]
    found = records.groupBy(*keys).agg(
        F.count("*").alias("preview_rows"), F.count_distinct(F.nullif("row_key", F.lit(""))).alias("unique_row_keys"), *(F.count_if(F.array_contains("faults", n)).alias(f"{n}_records") for n in names)
    )
    failures = [below("preview_rows", F.col("preview_rows"), least_rows, 0)]
    if selected is not None:
        found = found.join(selected, keys, "left")
        failures.append(F.when(F.col("preview_rows") != F.col("selected_rows"), F.format_string("preview_rows %d != selected_rows %d", "preview_rows", "selected_rows")))
    failures += [above(f"{n}_records", F.col(f"{n}_records"), 0) for n in names]
    failures.append(F.when(F.col("unique_row_keys") < F.col("preview_rows"), F.format_string("unique_row_keys %d < preview_rows %d", "unique_row_keys", "preview_rows")))
    return judged(found, failures)


def readiness(selected: DataFrame, previews: DataFrame, keys: list[str], key: str, gates: DataFrame) -> DataFrame:
    """A row for each key of selected: rows, previews, how many rows have a preview, and ready: rows exist, as many previews, and both gates (selection_passed, preview_passed; null fails) passed."""
    have = previews.select(*keys, key).distinct().withColumn("_has", F.lit(1))
    rows = selected.join(have, [*keys, key], "left").groupBy(*keys).agg(F.count("*").alias("selected_rows"), F.count("_has").alias("matched_rows"))
    found = rows.join(previews.groupBy(*keys).agg(F.count("*").alias("preview_rows")), keys, "left").join(gates, keys, "left")
    ready = (F.col("selected_rows") > 0) & (F.coalesce("preview_rows", F.lit(0)) == F.col("selected_rows")) & F.coalesce("selection_passed", F.lit(False)) & F.coalesce("preview_passed", F.lit(False))
    return found.withColumn("ready", ready)


def paid_gate(df: DataFrame, passed: str, metrics: str | None = None) -> DataFrame:
    """Reasons why a paid run may not go on: the gate missing or failed, a report without metrics or accepted rows."""
    failures = [F.when(F.col(passed).isNull(), "paid gate missing or invalid").when(~F.col(passed), "paid gate did not pass")]
    if metrics:
        failures.append(F.when(F.col(metrics).isNull(), "report has no gate metrics").when(F.coalesce(F.try_element_at(metrics, F.lit("written_rows")), F.lit(0.0)) <= 0, "report has no accepted rows"))
    return judged(df, failures)


def metric(metrics: str, name: str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(F.col(metrics), F.lit(name)), F.lit(default))


def cycle_score(manifest: DataFrame) -> DataFrame:
    """manifests (promoted, metrics map, reasons array, hardcases long, artifacts array<struct<name, path, exists>>) with cycle_score and missing (names of artifacts that don't exist, the baseline's metrics aside)."""
    score = (
        F.when(F.coalesce("promoted", F.lit(False)), 10.0).otherwise(0.0)
        + 0.45 * metric("metrics", "chrf") + 0.15 * metric("metrics", "bleu") + 0.25 * metric("metrics", "token_f1") - 0.03 * metric("metrics", "ter", 100.0)
        - 0.05 * metric("metrics", "false_confidence_rate") - 0.04 * metric("metrics", "missing_score_rate")
        + F.least(F.lit(5.0), 0.02 * F.coalesce("hardcases", F.lit(0)))
        - F.when(F.size(F.coalesce("promotion_reasons", F.array().cast("array<string>"))) > 0, 2.0).otherwise(0.0)
    )
    missing = F.transform(F.filter("artifacts", lambda a: ~a["exists"] & (a["name"] != "baseline_metrics")), lambda a: a["name"])
    return manifest.withColumns({"cycle_score": score, "missing": F.coalesce(missing, F.array().cast("array<string>"))})


def cycle_gate(scored: DataFrame, least: dict[str, float], most_missing: int = 0, stage: str | None = None, adapter: bool = True) -> DataFrame:
    """Manifests with cycle_score judged: promoted, stage, missing artifacts, the policy adapter and least metrics."""
    has_adapter = F.exists(F.coalesce("artifacts", F.array().cast("array<struct<name:string,path:string,exists:boolean>>")), lambda a: (a["name"] == "policy_adapter") & a["exists"])
    failures = [F.when(~F.coalesce("promoted", F.lit(False)), "cycle is not promoted")]
    if stage:
        failures.append(F.when(~F.coalesce(F.col("stage") == stage, F.lit(False)), F.concat(F.lit("stage "), F.coalesce("stage", F.lit("None")), F.lit(f" != {stage}"))))
    n = F.size("missing")
    failures.append(F.when(n > most_missing, F.concat(F.lit("missing artifacts "), n.cast("string"), F.lit(f" > {most_missing}: "), F.array_join("missing", ", "))))
    if adapter:
        failures.append(F.when(~has_adapter, "policy_adapter artifact is missing"))
    return judged(scored, failures + [below(k, metric("metrics", k), v) for k, v in least.items()])


def best_cycle(judged_cycles: DataFrame, key: str) -> DataFrame:
    """The passing manifest that ranks first: promoted, score, chrf, least false confidence, then the key."""
    order = [F.desc(F.coalesce("promoted", F.lit(False))), F.desc("cycle_score"), F.desc(metric("metrics", "chrf")), metric("metrics", "false_confidence_rate"), key]
    return judged_cycles.filter("passed").orderBy(*order).limit(1)


def hardcase_paths(manifests: DataFrame, key: str, with_inputs: bool = False) -> DataFrame:
    """(key, path): each manifest's output file of hard cases, then its inputs, without files known to hold none; a path once."""
    kinds = ["output_hardcases", *(["input_hardcases"] if with_inputs else [])]
    wanted = F.filter("artifacts", lambda a: a["name"].isin(*kinds) & (F.coalesce(a["path"], F.lit("")) != "") & (F.coalesce(a["records"], F.lit(1)) > 0))
    ordered = F.array_sort(F.transform(wanted, lambda a, i: F.struct(F.when(a["name"] == "output_hardcases", 0).otherwise(1).alias("o"), i.alias("i"), a["path"].alias("path"))))
    return manifests.select(key, F.explode(F.array_distinct(F.transform(ordered, lambda a: a["path"]))).alias("path"))


def self_judgement_label(answer_score: Column, analysis: Column, true: Column, gap: float = 0.20) -> Column:
    """struct(score, severity, rationale): how well a self-judgement fits the true score."""
    meta = R.self_judgement_score(analysis, answer_score, true)
    off = F.abs(F.coalesce(answer_score, F.lit(0.0)) - true)
    fine = F.greatest(F.lit(0.80), meta)

    def label(score: Column, severity: Column | str, rationale: str) -> Column:
        return F.struct(score.cast("double").alias("score"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(rationale).alias("rationale"))

    return (
        F.when(answer_score.isNull(), label(F.lit(0.0), "critical", "missing_self_score"))
        .when((off >= gap) & (answer_score > true), label(F.least(meta, F.lit(0.20)), F.when(off >= 0.40, "critical").otherwise("major"), "false_confidence_self_score_too_high"))
        .when((off >= gap) & (answer_score < true), label(F.least(meta, F.lit(0.45)), "major", "underconfident_or_hallucinated_issues"))
        .when(meta < 0.65, label(meta, "major", "analysis_does_not_match_translation_quality"))
        .otherwise(label(fine, F.when(fine >= 0.90, "none").otherwise("minor"), "self_analysis_matches_translation_quality"))
    )


def record_counts(records: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, records, invalid_records, valid_records): rows with a missing field are invalid, of equal valid ones one counts."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    digest = F.when(whole, F.sha2(F.to_json(F.struct(*fields)), 256))
    return records.groupBy(*keys).agg(F.count("*").alias("records"), F.count_if(~whole).alias("invalid_records"), F.count_distinct(digest).alias("valid_records"))
