"""Report files for spreadsheets: byte-order mark, semicolons, CRLF, labels, no formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def guarded(column: Column) -> Column:
    """A text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(column.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), column)).otherwise(column)


def report_lines(df: DataFrame, columns: Sequence[tuple[str, str]], title: str | None = None) -> DataFrame:
    """(position, line): the heading lines first, then one line per row in the given order. Reports are
    small aggregates, so a single ordered file is what the reader expects."""
    kinds = dict(df.dtypes)

    def cell(name: str) -> Column:
        if kinds[name].startswith("array"):
            text = guarded(F.array_join(name, ", "))
        elif kinds[name] == "string":
            text = guarded(F.col(name))
        else:
            text = F.col(name).cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[;"\\r\\n]'), quoted).otherwise(text), F.lit(""))

    spark = df.sparkSession
    heads = ([] if title is None else [title]) + [";".join(label for _, label in columns)]
    heading = spark.createDataFrame([(i - len(heads), ("﻿" if i == 0 else "") + h) for i, h in enumerate(heads)],
                                    "position bigint, line string")
    body = df.select(F.monotonically_increasing_id().alias("position"),
                     F.concat_ws(";", *[cell(name) for name, _ in columns]).alias("line"))
    return heading.unionByName(body)


def write_report(df: DataFrame, columns: Sequence[tuple[str, str]], path: str, title: str | None = None) -> None:
    (report_lines(df, columns, title).orderBy("position").coalesce(1).select("line")
     .write.mode("overwrite").option("lineSep", "\r\n").text(path))
