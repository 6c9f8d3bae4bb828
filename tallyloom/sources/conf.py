"""Key-value configuration lines: ``key<white space>value``, with ``#`` comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.text import words


def parse_conf(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keys and values of configuration lines; other columns, such as the line number, are kept.

    Blank lines, comments and lines without a value are skipped. A value of several words is joined by
    single blanks.
    """
    kept = [c for c in lines.columns if c != column]
    settings = F.filter(
        F.array(words(F.col(column))),
        lambda p: (F.size(p) >= 2) & ~F.startswith(F.get(p, F.lit(0)), F.lit("#")),
    )
    pair = lambda p: F.struct(
        F.get(p, F.lit(0)).alias("key"), F.array_join(F.slice(p, F.lit(2), F.size(p)), " ").alias("value")
    )
    return lines.select(*kept, F.inline(F.transform(settings, pair)))
