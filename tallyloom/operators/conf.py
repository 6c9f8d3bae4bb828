"""Configuration tables: lookup, insert-if-absent and upsert.

All sides are reduced to one row per key before they meet, except the configuration lines that an upsert
keeps one by one; there the other side is unique per key and AQE splits a hot key of the lines.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, functions as F


def _one_per_key(df: DataFrame, picked) -> DataFrame:
    return df.groupBy("key").agg(picked.alias("value"))


def first_match(conf: DataFrame, order: str = "line_no") -> DataFrame:
    """Value of the first line of each key."""
    return _one_per_key(conf, F.min_by("value", order))


def last_match(conf: DataFrame, order: str = "line_no") -> DataFrame:
    return _one_per_key(conf, F.max_by("value", order))


def lookup(wanted: DataFrame, overrides: DataFrame, conf: DataFrame, default: Any = "", order: str = "line_no") -> DataFrame:
    """Value per wanted key: the override if there is one, else the first line of the file, else the default.

    ``wanted`` and ``overrides`` hold each key once.
    """
    from_file = first_match(conf, order).withColumnRenamed("value", "file_value")
    from_env = overrides.select("key", F.col("value").alias("env_value"))
    return (
        wanted.select("key").join(from_env, "key", "left").join(from_file, "key", "left")
        .select("key", F.coalesce("env_value", "file_value", F.lit(default)).alias("value"))
    )


def insert_absent(conf: DataFrame, defaults: DataFrame, order: str = "line_no") -> DataFrame:
    """All lines of ``conf``, plus the first default of each key it does not have."""
    have = conf.select("key").distinct()
    missing = first_match(defaults, order).join(have, "key", "left_anti")
    return conf.select("key", "value").unionByName(missing)


def upsert(conf: DataFrame, updates: DataFrame, order: str = "line_no") -> DataFrame:
    """Every line whose key is updated takes the new value (the last one wins); new keys are added once."""
    new = last_match(updates, order).withColumnRenamed("value", "new_value")
    changed = conf.select("key", "value").join(new, "key", "left").select(
        "key", F.coalesce("new_value", "value").alias("value")
    )
    have = conf.select("key").distinct()
    added = new.join(have, "key", "left_anti").select("key", F.col("new_value").alias("value"))
    return changed.unionByName(added)
