"""From run tables to regression inputs: column rules, split, one-hot and vector assembly."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallyloom.functions.scalars import flag_from_text, hash_bucket
from tallyloom.operators.ordered import number_rows
from tallyloom.schemas import CATEGORICAL, FEATURES, TARGETS
from tallyloom.session import cut_lineage, scratch_path

# Percentage of test rows, and the train fractions of the learning curve.
TEST_PERCENT = 25
FRACTION_PERCENTS = [20, 36, 52, 68, 84, 100]


class Inputs(NamedTuple):
    """Rows with a ``label``, and which of their columns a model may use."""

    frame: DataFrame
    numeric: list[str]
    categorical: list[str]
    target: str


# How a column of a run table is read, and what stands for it if the table lacks it.
READ_AS = {"rdd_compress": flag_from_text}
IF_ABSENT = {"is_default": 0}


def regression_inputs(runs: DataFrame) -> Inputs:
    """One projection of a run table: flags read from text, absent columns replaced, the target as ``label``.

    Features that the table lacks are not used. The target is the median if there is one, else the single duration;
    rows without a target are left out.
    """
    have = set(runs.columns)
    target = [name for name in TARGETS if name in have][0]
    columns = [READ_AS.get(name, lambda c: c)(F.col(name)).alias(name) for name in runs.columns]
    columns += [F.lit(value).alias(name) for name, value in IF_ABSENT.items() if name not in have]
    label = F.col(target).cast("double")
    # The filter names the source column, so it reaches the scan.
    rows = runs.where(F.col(target).isNotNull() & ~F.isnan(label)).select(*columns, label.alias("label"))
    used = {kind: [n for n in FEATURES if n in have and (n in CATEGORICAL) == kind] for kind in (True, False)}
    return Inputs(rows, used[False], used[True], target)


def row_key(*columns: str, salt: str = "") -> Column:
    return F.concat_ws("|", F.lit(salt), *[F.col(c).cast("string") for c in columns])


def with_split(df: DataFrame, key: Sequence[str], test_percent: int = TEST_PERCENT) -> DataFrame:
    """Mark each row as train or test by the hash of its key; repartitioning or a rerun changes nothing."""
    part = F.when(hash_bucket(row_key(*key)) < test_percent, "test").otherwise("train")
    return df.withColumn("part", part)


def fraction_bucket(key: Sequence[str]) -> Column:
    """Second bucket, hashed independently of the split, so that the fractions of the train part are nested."""
    return hash_bucket(row_key(*key, salt="fraction"))


def fold_of(key: Sequence[str], folds: int) -> Column:
    return hash_bucket(row_key(*key, salt="fold"), folds)


def train_fractions(train: DataFrame, key: Sequence[str], percents: Sequence[int] = FRACTION_PERCENTS) -> DataFrame:
    """Each train row once per fraction that includes it, with the fraction in percent."""
    included = F.filter(F.array(*[F.lit(p) for p in percents]), lambda p: F.col("_bucket") < p)
    return train.withColumn("_bucket", fraction_bucket(key)).withColumn("percent", F.explode(included)).drop("_bucket")


def encoder(numeric: Sequence[str], categorical: Sequence[str], out: str = "features") -> Pipeline:
    """Numeric columns followed by one-hot columns in alphabetical order of the categories.

    An unseen or missing category gets zeros in all its columns.
    """
    stages = []
    hot = [f"{c}_hot" for c in categorical]
    if categorical:
        indexed = [f"{c}_index" for c in categorical]
        stages.append(StringIndexer(
            inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"
        ))
        stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True))
    stages.append(VectorAssembler(inputCols=[*numeric, *hot], outputCol=out, handleInvalid="keep"))
    return Pipeline(stages=stages)


def fit_encoder(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> PipelineModel:
    return encoder(numeric, categorical).fit(train)


def encoded_values(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> Column:
    """The values of the vector that a fitted encoder makes, as an array of plain expressions; for few categories.

    A scan then reads numbers only, and no row passes through the stages of the encoder.
    """
    values = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric]
    if categorical:
        for column, labels in zip(categorical, model.stages[0].labelsArray):
            same = [F.col(column).cast("string").eqNullSafe(F.lit(label)) for label in labels]
            values += [s.cast("double") for s in same]
    return F.array(*values)


def category_table(train: DataFrame, column: str) -> DataFrame:
    """(category, ordinal): the distinct categories of the train rows, numbered from 0 in alphabetical order.

    The table takes the place of an encoder's label list. It is dealt by range, so it is never in one task or on the driver.
    """
    seen = train.select(F.col(column).cast("string").alias("category")).where("category IS NOT NULL").distinct()
    numbered = number_rows(cut_lineage(seen), ["category"], out="ordinal")
    return cut_lineage(numbered.select("category", (F.col("ordinal") - 1).cast("int").alias("ordinal")))


def sparse_one_hot(df: DataFrame, numeric: Sequence[str], tables: dict[str, DataFrame]) -> DataFrame:
    """Adds ``size, indices, values``: the vector that ``encoder`` makes, without its zeros, for any number of categories.

    ``tables`` gives a category table per column. Rows and tables are joined by category, so a task sees only the
    categories of its rows; a category that is missing or unseen finds no partner and sets nothing.
    """
    entry = lambda at, value: F.struct(at.alias("at"), value.alias("value"))
    entries = [entry(F.lit(i), F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))) for i, c in enumerate(numeric)]
    size, rows = len(numeric), df
    for column, table in tables.items():
        place = f"_{column}_ordinal"
        named = table.select(F.col("category").alias(f"_{column}"), F.col("ordinal").alias(place))
        rows = rows.join(named, F.col(column).cast("string") == F.col(f"_{column}"), "left").drop(f"_{column}")
        entries.append(entry(F.col(place) + size, F.lit(1.0)))
        size += table.count()
    some = F.filter(F.array(*entries), lambda e: e["at"].isNotNull() & (e["value"] != 0))
    rows = rows.withColumn("_entries", some)
    return rows.select(
        *df.columns, F.lit(size).alias("size"), F.col("_entries.at").alias("indices"), F.col("_entries.value").alias("values")
    )


def with_sparse_vectors(df: DataFrame, out: str = "features") -> DataFrame:
    """``size, indices, values`` as one vector column. A vector is stored as such a struct, so the table is read back as vectors."""
    parts = F.struct(F.lit(0).cast("tinyint").alias("type"), "size", "indices", "values")
    rest = [c for c in df.columns if c not in ("size", "indices", "values")]
    path = scratch_path(df.sparkSession, "vectors")
    df.select(*rest, parts.alias(out)).write.parquet(path)
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(out, VectorUDT())])
    return df.sparkSession.read.schema(schema).parquet(path)
