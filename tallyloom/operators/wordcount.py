"""Word counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.text import lines, raw_words, space_tokens


def text_lines(df: DataFrame, column: str = "text") -> DataFrame:
    """One row per line of a text column; only that column is carried along."""
    return df.select(F.explode(lines(F.col(column))).alias("value"))


def word_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Occurrences per word. Counts are combined before the shuffle, so a frequent word costs one row per task."""
    tokens = lines.select(F.explode(raw_words(F.col(column))).alias("word")).where("word <> ''")
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def space_token_counts(lines: DataFrame, column: str = "value") -> DataFrame:
    """Occurrences per token between single blanks, the empty token included."""
    tokens = lines.select(F.explode(space_tokens(F.col(column))).alias("word"))
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def distinct_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """Number of distinct words and of all words, from the word counts."""
    return word_counts(lines, column).agg(
        F.count("*").alias("distinct_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")
    )
