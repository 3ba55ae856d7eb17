"""Dictionaries from text lines: entries that run over several lines, and one-line entries in two languages."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import WORD_CLASSES


def is_furniture(line: Column, headers: list[str]) -> Column:
    """Page numbers, section letters and running headers."""
    return line.rlike("^[0-9]+$") | line.isin(*headers)


def entries(lines: DataFrame, keys: list[str], order: str, line: str, headers: list[str]) -> DataFrame:
    """(keys, headword, gloss) of entries `headword class. gloss, gloss.` that may run over lines.

    Lines of a section (keys) are read in order; what doesn't make an entry yet is carried on to the next line. A headword
    loses its alternatives and notes, a gloss its notes; glosses of one letter are none. A section is one group's list:
    choose keys (a page range) that bound it.
    """
    names = "|".join(re.escape(c) for c in sorted(WORD_CLASSES, key=len, reverse=True))
    whole = re.compile(rf"([A-Za-zñÑ'][A-Za-zñÑ' /()0-9]*?)\s+(?:{names})(?:[./](?:{names}))?\.\s+(.+)\.\s*", re.S)

    def read(section: pd.DataFrame) -> pd.DataFrame:
        out, carried = [], ""
        for text in section.sort_values(order, kind="stable")[line]:
            carried = f"{carried} {text}".strip()
            found = whole.fullmatch(carried)
            if not found:
                continue
            head = re.split(r"[/(]", found[1])[0].strip()
            glosses = (re.sub(r"\s*\([^)]*\)", "", g.strip().lower()).strip() for g in re.split("[;,]", found[2]))
            kept = [g for g in glosses if len(g) > 1]
            if kept:
                out += [(head, g) for g in kept]
                carried = ""
        own = {k: pd.Series([section[k].iloc[0]] * len(out), dtype=section[k].dtype) for k in keys}
        return pd.DataFrame({**own, "headword": pd.Series([h for h, _ in out], dtype=object), "gloss": pd.Series([g for _, g in out], dtype=object)})

    kept = lines.filter(~is_furniture(F.col(line), headers)).select(*keys, order, line)
    kinds = dict(kept.dtypes)
    return kept.groupBy(*keys).applyInPandas(read, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "headword string", "gloss string"]))


def looks_target(token: Column) -> Column:
    """Whether a token has the target language's shape: no accented vowel, no usual ending of the source language, and q, w, y or a final a, i, u."""
    t = F.btrim(F.lower(token), F.lit(".,;:/()"))
    ending = t.rlike("(ado|ido|mente|ión|ar|er|ir)$") & (F.char_length(t) > 4)
    return (t != "") & ~t.rlike("[áéíóú]") & ~ending & (t.rlike("[qwy]") | ((F.char_length(t) >= 3) & t.rlike("[aiu]$")))


def line_entries(lines: DataFrame, line: str, headers: list[str]) -> DataFrame:
    """lines with headword and form for each entry `headword form[; form]`: the forms begin at the first token, outside parentheses and not the first one, that looks like the target language (else at the second)."""
    tokens = F.filter(F.split(T.normalize_space(F.col(line)), " "), lambda t: t != "")
    df = lines.filter(~is_furniture(F.col(line), headers)).withColumn("_t", tokens).filter(F.size("_t") >= 2)
    opened = lambda i: F.regexp_count(F.array_join(F.slice(F.col("_t"), F.lit(1), i + 1), " "), F.lit(r"\(")) > F.regexp_count(F.array_join(F.slice(F.col("_t"), F.lit(1), i + 1), " "), F.lit(r"\)"))
    places = F.filter(F.transform("_t", lambda t, i: F.when((i > 0) & looks_target(t) & ~opened(i), i)), lambda i: i.isNotNull())
    df = df.withColumn("_at", F.coalesce(F.try_element_at(places, F.lit(1)), F.lit(1)))
    head = T.normalize_space(F.regexp_replace(F.lower(F.array_join(F.slice(F.col("_t"), F.lit(1), F.col("_at")), " ")), r"\s*\([^)]*\)\s*", " "))
    rest = F.array_join(F.slice(F.col("_t"), F.col("_at") + 1, F.size("_t")), " ")
    first = F.transform(F.split(rest, "[;/]"), lambda o: F.split(F.regexp_replace(F.lower(F.trim(o)), "[.,;:]+$", ""), " ")[0])
    forms = F.filter(first, lambda w: (w != "") & looks_target(w))
    return df.withColumns({"headword": head, "form": F.explode(forms)}).drop("_t", "_at")


def merged(parts: list[DataFrame], head: str, value: str) -> DataFrame:
    """(head, values): the sorted distinct values of each headword over all parts."""
    return reduce(DataFrame.unionByName, [p.select(head, value) for p in parts]).groupBy(head).agg(F.array_sort(F.collect_set(value)).alias("values"))
