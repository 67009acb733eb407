"""Writers: JSON Lines, CSV bundles, quarantine, versioned rewrites, HTML data and LaTeX rows."""

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet appended to partitions by keys; what stands there stays."""
    df.write.mode("append").partitionBy(*keys).parquet(path)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Parquet that replaces the partitions it has rows for, so a retry is harmless; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One CSV and one JSON folder per table (report tables, small by definition); nested columns are JSON text in the CSV."""
    for name, df in tables.items():
        flat = df.select(*(F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name) for f in df.schema.fields))
        flat.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/{name[:31]}")
        df.coalesce(1).write.mode("overwrite").json(f"{path}/{name[:31]}.json")


def split_quarantine(df: DataFrame, valid, reason: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, other rows with the reason); a null condition is not valid."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("error", F.lit(reason))


def rewrite_guarded(df: DataFrame, source: DataFrame, target: str) -> None:
    """Writes to a new path after checking that the source has not grown meanwhile (a concurrent writer)."""
    before = source.count()
    df.write.mode("errorifexists").parquet(target)
    if source.count() != before:
        raise RuntimeError("the source changed during the rewrite; the target is not complete")


#: Rows of a report that are rendered as text.
MAX_REPORT_ROWS = 100_000


def report_rows(df: DataFrame) -> list[dict]:
    """The rows of a report table, whose number is checked."""
    rows = df.limit(MAX_REPORT_ROWS + 1).collect()
    if len(rows) > MAX_REPORT_ROWS:
        raise ValueError(f"a report has at most {MAX_REPORT_ROWS} rows")
    return [r.asDict(recursive=True) for r in rows]


def render_html(template: str, tables: dict[str, DataFrame], mark: str = "__DATA__") -> str:
    """The template with the tables as one JSON object in place of the mark, safe inside a script element."""
    data = json.dumps({k: report_rows(v) for k, v in tables.items()}, default=str).replace("<", "\\u003c")
    return template.replace(mark, data)


def latex_rows(df: DataFrame, columns: list[str], digits: int = 2) -> list[str]:
    """Table rows with decimal commas, built as expressions and ordered by the first column."""
    from ..functions.keys import decimal_comma, escape_latex

    kinds = dict(df.dtypes)
    cells = [F.coalesce(decimal_comma(F.col(c), digits) if kinds[c] in ("double", "float") else escape_latex(F.col(c).cast("string")), F.lit("--")) for c in columns]
    rows = df.orderBy(columns[0]).select(F.concat(F.concat_ws(" & ", *cells), F.lit(r" \\")).alias("row"))
    return [r["row"] for r in report_rows(rows)]
