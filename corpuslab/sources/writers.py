"""Writers."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def tier(df: DataFrame, path: str) -> None:
    """Parquet and CSV twins in path/parquet and path/csv; arrays are joined by | in the CSV."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    flat = [F.array_join(c, "|").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def _sorted(kind: DataType, c: Column) -> Column:
    """The value with the keys of its structs in order, at every depth."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(c.isNotNull(), F.struct(*(_sorted(f.dataType, c[f.name]).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, (StructType, ArrayType)):
        return F.transform(c, lambda x: _sorted(kind.elementType, x))
    return c


def jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines with sorted keys, nested ones too."""
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    rows = df.select(*(_sorted(f.dataType, F.col(f"`{f.name}`")).alias(f.name) for f in fields))
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def metrics(df: DataFrame) -> str:
    """Pretty JSON of a relation of one row."""
    return json.dumps(df.first().asDict(recursive=True), indent=2, sort_keys=True, ensure_ascii=False, default=str)


def _cell(v: object) -> str:
    return f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of a report's rows. A report of more than `most` rows is refused: it is no report."""
    got = df.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    rows = [df.columns, ["---"] * len(df.columns), *([_cell(v) for v in r] for r in got)]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def sections(parts: dict[str, DataFrame], most: int = 200) -> str:
    """Small relations as CSV blocks under headings of a markdown report; one of more than `most` rows is refused."""
    out = []
    for title, df in parts.items():
        got = df.limit(most + 1).collect()
        if len(got) > most:
            raise ValueError(f"{title}: more than {most} rows")
        text = io.StringIO()
        csv.writer(text, lineterminator="\n").writerows([df.columns, *([_cell(v) for v in r] for r in got)])
        out.append(f"## {title}\n\n```csv\n{text.getvalue()}```\n")
    return "\n".join(out)
