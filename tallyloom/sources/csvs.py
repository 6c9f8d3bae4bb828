"""CSV tables with a header: declared-schema scan, collection of differently shaped files, sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Quotes inside a quoted value are doubled.
CSV = {"quote": '"', "escape": '"'}


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name, whatever order and further columns the files' headers have; a column that a
    file lacks is NULL."""
    table = collect_csv(spark, path, "*", schema)
    have = set(table.columns)
    return table.select(*[
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema
    ])


def _decoded(uri):
    """``_metadata.file_path`` is percent-encoded; a plus sign in it is a plus sign."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _plain_path(path):
    return F.regexp_replace(path, r"^file:(//)?", "")


def _lines(reader, folder: str, name_glob: str, path_pattern: str | None) -> DataFrame:
    """``value, path, at``: the lines of all files, with the offset of their split."""
    lines = (
        reader.option("recursiveFileLookup", True).option("pathGlobFilter", name_glob)
        .option("ignoreCorruptFiles", True).text(folder)
        .select("value", _decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("at"))
    )
    return lines.where(F.rlike("path", F.lit(path_pattern))) if path_pattern else lines


def line_stream(spark: SparkSession, folder: str, name_glob: str = "*.csv", path_pattern: str | None = None) -> DataFrame:
    """The lines of the files that are new, as a stream; a file is never cut between batches."""
    return _lines(spark.readStream, folder, name_glob, path_pattern)


def _text_rows(spark: SparkSession, folder: str, name_glob: str, path_pattern: str | None) -> DataFrame:
    """``value, path, at, row``: lines with their order in their split."""
    return _lines(spark.read, folder, name_glob, path_pattern).withColumn("row", F.monotonically_increasing_id())


def csv_headers(spark: SparkSession, folder: str, name_glob: str = "*.csv", path_pattern: str | None = None) -> DataFrame:
    """One row per readable, non-empty file: its path, its first line and that line's row."""
    return _headers(_text_rows(spark, folder, name_glob, path_pattern))


def _headers(lines: DataFrame) -> DataFrame:
    """Only the first split of a file can hold its header; the first line is picked map-side."""
    first = lines.where("at = 0")
    header = F.regexp_replace(F.col("first.value"), r"^\x{FEFF}|\s+$", "")
    return (
        first.groupBy("path").agg(F.min_by(F.struct("value", "row"), "row").alias("first"))
        .select("path", header.alias("header"), F.col("first.row").alias("header_row")).where("header <> ''")
    )


def skipped_files(spark: SparkSession, folder: str, name_glob: str = "*.csv", path_pattern: str | None = None) -> DataFrame:
    """``source_file`` of the files that a collection leaves out since no line of them can be read. Empty files hold
    nothing to leave out and are not listed."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).load(folder)
        .select(F.col("path"))
    )
    files = files.where(F.rlike("path", F.lit(path_pattern))) if path_pattern else files
    read = csv_headers(spark, folder, name_glob, path_pattern).select(_plain_path(F.col("path")).alias("source_file"))
    return files.select(_plain_path(F.col("path")).alias("source_file")).join(read, "source_file", "left_anti")


def _typed(text: Column, kind: T.DataType) -> Column:
    """Text as the declared type; a whole number may be written with a fraction of zero. What doesn't convert is NULL."""
    if isinstance(kind, T.IntegralType):
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast(kind))
        return F.coalesce(text.try_cast(kind), whole)
    return text.try_cast(kind)


def collect_csv(
    spark: SparkSession, folder: str, name_glob: str = "*.csv", known: T.StructType | None = None,
    path_pattern: str | None = None,
) -> DataFrame:
    """Union of all CSV files below ``folder`` by column name, plus ``source_file``.

    Every file has a header of its own: its first line is joined to its other lines by path, and a value's column is
    the header's name at its place. So there is one scan of the lines whatever the number of layouts, and no list of
    paths on the driver; it only learns the distinct column names, which are the schema. ``path_pattern`` is a regular
    expression that the whole path must contain. Columns of ``known`` that occur get their declared type, others are
    text. Values are one line each. With no file at all the result is empty. See ``skipped_files``.
    """
    return table_of_lines(_text_rows(spark, folder, name_glob, path_pattern), known)


def table_of_lines(lines: DataFrame, known: T.StructType | None = None) -> DataFrame:
    """The table that ``value, path, at, row`` lines of CSV files hold, see ``collect_csv``."""
    headers = _headers(lines)
    commas = F.length("header") - F.length(F.replace("header", F.lit(",")))
    width = headers.agg(F.max(commas)).first()[0]
    if width is None:
        empty = T.StructType([*(known or []), T.StructField("source_file", T.StringType())])
        return lines.sparkSession.createDataFrame([], empty)
    fields = [f"c{i}" for i in range(width + 1)]
    shape = ", ".join(f"{c} STRING" for c in fields)

    def cells(line: Column) -> Column:
        parsed = F.from_csv(line, F.lit(shape), CSV)
        return F.transform(F.array(parsed), lambda p: F.array(*[p[c] for c in fields]))[0]

    headers = headers.withColumn("names", F.transform(cells(F.col("header")), F.trim)).drop("header")
    found = {r[0] for r in headers.select(F.explode("names")).distinct().collect() if r[0]}
    types = {f.name: f.dataType for f in known or []}
    order = [*[n for n in types if n in found], *sorted(found - set(types))]
    lines = lines.join(headers, "path").where("row <> header_row AND trim(value) <> ''").select("path", "names", cells(F.rtrim("value")).alias("cells"))
    value = lambda name: F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1)
    return lines.select(
        *[_typed(value(n), types.get(n, T.StringType())).alias(n) for n in order], _plain_path(F.col("path")).alias("source_file")
    )


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, skip_empty: bool = False) -> bool:
    """Replace ``path`` by ``df`` with a header in every part, columns in the given order.

    An empty table still gets its header line, unless ``skip_empty`` asks for no output at all.
    """
    if skip_empty and df.isEmpty():
        return False
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).options(**CSV).csv(path)
    return True
