"""Rows taken from tables of printed books: cell cleaning, fill-down, flags, review, alternatives and glosses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import CELL_REMARKS, INNER_ALTERNATIVES, RICH_ENTRY_MARKS, SPACE, WORD
from .examples import has_adjacent_repeat

_NOTES = r"\(([^()]*)\)"


def clean_cell(c: Column) -> Column:
    """A cell's text: no soft hyphens, single spaces, none around slashes, after opening or before closing marks; null is empty."""
    t = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\u00ad"), F.lit("")), SPACE + "+", " ")
    for old, new in ((" /", "/"), ("/ ", "/"), ("¿ ", "¿"), ("¡ ", "¡")):
        t = F.replace(t, F.lit(old), F.lit(new))
    t = F.regexp_replace(t, SPACE + r"+([?.!,;:])", "$1")
    for old, new in (("pare ja", "pareja"), ("?.", "?"), ("!.", "!")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return F.trim(t)


def notes(c: Column) -> Column:
    """What stands in parentheses, blanks left out."""
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(_NOTES), 1), lambda x: F.trim(x)), lambda x: x != "")


def without_notes(c: Column) -> Column:
    return clean_cell(F.regexp_replace(c, _NOTES, ""))


def filled_cells(df: DataFrame, keys: list[str], order: list, role: str, source: str, target: str, roles: str) -> DataFrame:
    """Rows of tables with role_filled and source_filled, after rows without a role or a source took them from above.

    A row whose role matches the pattern `roles` keeps it and, if its source is blank, takes the last stated source. A row
    without a role stays only if it has a target and no source and a stated row precedes it, and takes both. Stated rows
    have a role and a source; the state ends with its table (keys).
    """
    cells = df.withColumns({c: clean_cell(F.col(c)) for c in (role, source, target)})
    known = F.col(role).rlike(roles)
    state = F.last(F.when(known & (F.col(source) != ""), F.struct(F.col(role).alias("role"), F.col(source).alias("source"))), ignorenulls=True)
    before = state.over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    cells = cells.withColumns({"_known": known, "_state": before})
    takes_both = ~F.col("_known") & (F.col(target) != "") & (F.col(source) == "") & F.col("_state").isNotNull()
    cells = cells.withColumns({"role_filled": takes_both, "source_filled": takes_both | (F.col("_known") & (F.col(source) == "") & F.col("_state").isNotNull())}).filter(F.col("_known") | F.col("role_filled"))
    taken = {role: F.when(F.col("role_filled"), F.col("_state.role")).otherwise(F.col(role)), source: F.when(F.col("source_filled"), F.col("_state.source")).otherwise(F.col(source))}
    return cells.withColumns(taken).drop("_known", "_state")


def cell_flags(source: Column, target: Column, raw_source: Column, raw_target: Column, all_notes: Column, source_filled: Column, role_filled: Column) -> Column:
    """The flags of a row in a fixed order."""
    remark = r"(?iu)(?<!" + WORD + ")(" + "|".join(CELL_REMARKS) + ")(?!" + WORD + ")"

    def words(c: Column) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(f"({WORD}+)"), 1), lambda x: F.lower(x))

    def repeats(c: Column) -> Column:
        return (F.size(words(c)) > 1) & has_adjacent_repeat(words(c))

    tests = {
        "role_filled_from_previous_row": role_filled,
        "source_filled_from_previous_row": source_filled,
        "long_cell": (F.char_length(source) > 140) | (F.char_length(target) > 160),
        "source_note_removed": raw_source.rlike(remark) | raw_target.rlike(remark),
        "has_context_note": F.size(all_notes) > 0,
        "adjacent_duplicate_tokens": repeats(source) | repeats(target),
        "contains_alternative_marker": F.contains(source, F.lit("/")) | F.contains(target, F.lit("/")),
        "empty_side": (source == "") | (target == ""),
    }
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))


def cleaned_rows(df: DataFrame, source: str, target: str) -> DataFrame:
    """Filled rows (filled_cells) with notes taken out of both sides, and their flags."""
    raw = [F.col(source), F.col(target)]
    df = df.withColumns({"raw_source": raw[0], "raw_target": raw[1], "notes": F.concat(notes(raw[0]), notes(raw[1]))})
    df = df.withColumns({source: without_notes(raw[0]), target: without_notes(raw[1])})
    return df.withColumn("flags", cell_flags(F.col(source), F.col(target), F.col("raw_source"), F.col("raw_target"), F.col("notes"), F.col("source_filled"), F.col("role_filled")))


def reviewed(df: DataFrame, source: str, target: str, excluded: DataFrame, keys: list[str], repeated_targets: dict[str, str] | None = None) -> DataFrame:
    """df (with flags) with corrections, decision, include and training_ready; the first rule that holds decides.

    `excluded` holds the keys of rows that a reader turned down; it is joined, so it may be of any size. A target that
    equals a key of repeated_targets becomes its value.
    """
    fixed_source = F.replace(F.col(source), F.lit("pare ja"), F.lit("pareja"))
    fixed_target = F.replace(F.replace(F.col(target), F.lit("?."), F.lit("?")), F.lit("!."), F.lit("!"))
    for old, new in (repeated_targets or {}).items():
        fixed_target = F.when(fixed_target == old, new).otherwise(fixed_target)
    named = F.array_compact(F.array(F.when(fixed_source != F.col(source), "corrected_broken_spanish_word"), F.when(fixed_target != F.col(target), "corrected_target_punctuation_or_duplicate")))
    out = excluded.select(*keys).distinct().withColumn("_out", F.lit(True))
    df = df.join(out, keys, "left").withColumns({"corrections": named, "_out": F.col("_out").isNotNull()})
    has = lambda *names: F.arrays_overlap("flags", T.words_of(*names))
    split = ~F.col("_out") & has("contains_alternative_marker")
    decision = (
        F.when(F.col("_out"), "reviewed_exclude_semantic_mismatch")
        .when(split, "reviewed_keep_needs_split")
        .when(F.size("corrections") > 0, "reviewed_corrected")
        .when(has("source_filled_from_previous_row", "role_filled_from_previous_row"), "reviewed_approved_alternative_translation")
        .when(has("has_context_note"), "reviewed_approved_context_note_removed")
        .when(F.size("flags") > 0, "reviewed_approved_flag_checked")
        .otherwise("auto_passed_table_checks")
    )
    df = df.withColumns({"decision": decision, "include": ~F.col("_out"), "training_ready": ~F.col("_out") & ~split})
    return df.withColumns({source: fixed_source, target: fixed_target}).drop("_out")


def entry_status(term: Column, raw_target: Column) -> Column:
    """A glossary entry: rich (examples, several lines), simple with alternatives or a note, or a plain pair."""
    words = "|".join(m.replace(".", "\\.") for m in RICH_ENTRY_MARKS)
    rich = F.contains(raw_target, F.lit("\n")) | raw_target.rlike(r"(?iu)[:¿¡]|(?<!" + WORD + ")(" + words + ")(?!" + WORD + ")")
    some = term.rlike(",") | raw_target.rlike("[,()]")
    return F.when(rich, "rich_entry_needs_term_review").when(some, "simple_entry_with_alternatives_or_note").otherwise("simple_term_pair")


def alternatives(c: Column, inner: dict[str, tuple[str, ...]] | None = None, carry: bool = True, whole: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The sentences that `a/b` stands for: a whole sentence's known ones, else one for each form of the first inner
    alternative found, else the parts, single words among them taking over what precedes the first part's last word."""
    parts = F.transform(F.split(c, "/"), lambda p: F.trim(p))
    prefix = F.regexp_extract(F.element_at(parts, 1), r"(?s)^(.*\s)\S+$", 1)
    split = F.transform(parts, lambda p, i: F.when((i > 0) & (prefix != ""), F.concat(prefix, p)).otherwise(p)) if carry else parts
    out = F.when(F.contains(c, F.lit("/")), split).otherwise(F.array(c))
    for form, options in reversed(list((INNER_ALTERNATIVES if inner is None else inner).items())):
        out = F.when(F.contains(c, F.lit(form)), F.array(*(F.replace(c, F.lit(form), F.lit(o)) for o in options))).otherwise(out)
    for sentence, options in (whole or {}).items():
        out = F.when(c == sentence, T.words_of(*options)).otherwise(out)
    return out


def split_alternatives(df: DataFrame, source: str, target: str, **known) -> DataFrame:
    """A row for each pair of alternatives, with split_index from 1, strategy and training_ready.

    As many on both sides: pair by pair. One on a side: it is repeated. Else every combination, to be reviewed.
    """
    df = df.withColumns({"_s": alternatives(F.col(source), whole=known.get("sources")), "_t": alternatives(F.col(target), inner={}, carry=False, whole=known.get("targets"))})
    n, m = F.size("_s"), F.size("_t")
    strategy = F.when(n == m, "pairwise").when(n == 1, "duplicate_source").when(m == 1, "duplicate_target").otherwise("cartesian_review_recommended")
    zipped = F.zip_with("_s", "_t", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.flatten(F.transform("_s", lambda a: F.transform("_t", lambda b: F.struct(a.alias("a"), b.alias("b")))))
    df = df.withColumn("strategy", strategy).select("*", F.posexplode(F.when(n == m, zipped).otherwise(crossed)).alias("_i", "_p"))
    return df.withColumns({"split_index": F.col("_i") + 1, source: F.col("_p.a"), target: F.col("_p.b"), "training_ready": F.col("strategy") != "cartesian_review_recommended"}).drop("_s", "_t", "_i", "_p")


def glosses(df: DataFrame, term: str, entry: str) -> DataFrame:
    """(term in lower case, first word) for each option of an entry's first statement: before a colon or full stop, split at commas, semicolons and slashes, without parentheses; words with accented vowels are none."""
    main = F.substring_index(F.substring_index(F.col(entry), ":", 1), ".", 1)
    options = F.transform(F.split(main, "[,;/]"), lambda o: F.lower(F.split(F.trim(F.regexp_replace(F.trim(o), SPACE + r"*\([^)]*\)" + SPACE + "*", " ")), " ")[0]))
    words = F.filter(options, lambda w: (w != "") & ~w.rlike("[áéíóú]"))
    return df.filter((F.trim(term) != "") & (F.trim(entry) != "")).withColumns({term: F.lower(F.trim(term)), "word": F.explode(words)})


def looks_plain(c: Column) -> Column:
    """Whether a word fits the plain spelling: no accented vowels, apostrophes after stops, or aspirated stops before a vowel at a word's start."""
    t = F.lower(F.trim(c))
    return (t != "") & ~t.rlike("[áéíóú]") & ~t.rlike("[kpqts]'") & ~t.rlike(r"(?<!" + WORD + ")(kh|qh|ph|th|chh)[aeiou]")


def cell_pairs(df: DataFrame, term: str, cell: str, lemma: str) -> DataFrame:
    """(term, form, confidence) for each plain form of a cell, or of the lemma where the cell is blank; the term is its first sense without parentheses."""
    stated = F.trim(F.coalesce(F.col(cell), F.lit(""))) != ""
    forms = F.when(stated, F.col(cell)).when(looks_plain(F.coalesce(F.col(lemma), F.lit(""))), F.col(lemma))
    sense = F.trim(F.regexp_replace(F.lower(F.trim(F.split(F.col(term), "[;,]")[0])), SPACE + r"*\([^)]*\)", ""))
    options = F.filter(F.transform(F.split(forms, "[;,/]"), lambda o: F.trim(o)), lambda o: looks_plain(o))
    df = df.withColumns({"_term": sense, "confidence": F.when(stated, "high").otherwise("lemma_fallback"), "form": F.explode(options)})
    return df.filter(F.char_length("_term") >= 2).withColumn(term, F.col("_term")).drop("_term")
