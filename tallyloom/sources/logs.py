"""Run logs and reports: text scans in log order, parsing to run records, log sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions import parse

# Fixed value: header of the tab-separated report.
REPORT_HEADER = "Benchmark\tEngine\tScale\tDuration(s)"

# Position of a line in a text input: time and name of the file, offset of the scan split, piece of the split; then the row.
LOG_BLOCK = ["log_time", "log_file", "log_offset", "log_piece"]
LOG_ORDER = ["log_row"]

# Rows of a piece. A compressed file is one split however long it is, and is cut into pieces by row.
PIECE_ROWS = 1_000_000


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a file or folder, one string column ``value``."""
    return spark.read.text(path)


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their position, so that log order survives any later shuffle.

    Files are in the order in which they were last written to, those of the same time by name: a log that is appended to
    file by file, by many tasks at once, keeps the order of its batches whatever its files are called. A split is read by
    one task from front to back, so the running id orders its rows. An absent file has no lines.
    """
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        shape = "value STRING, log_time TIMESTAMP, log_file STRING, log_offset BIGINT, log_piece INT, log_row BIGINT"
        return spark.createDataFrame([], shape)
    row = F.monotonically_increasing_id()
    return lines.select(
        "value",
        F.col("_metadata.file_modification_time").alias("log_time"),
        F.col("_metadata.file_path").alias("log_file"),
        F.col("_metadata.file_block_start").alias("log_offset"),
        F.floor(row.bitwiseAND((1 << 33) - 1) / PIECE_ROWS).cast("int").alias("log_piece"),
        row.alias("log_row"),
    )


def _records(lines: DataFrame, column: str, fields: Column, arity, number) -> DataFrame:
    """Zero or one record per line. The lambdas bind the split fields and the parsed number, so a line is
    split and parsed once however often the parts are used."""
    kept = [c for c in lines.columns if c != column]
    at = lambda f, i: F.get(f, F.lit(i))
    record = lambda f: F.struct(
        at(f, 0).alias("benchmark"), at(f, 1).alias("engine"), at(f, 2).alias("scale"),
        number(at(f, 3)).alias("duration_sec"),
    )
    whole = F.filter(F.array(fields), lambda f: arity(F.size(f)))
    timed = F.filter(F.transform(whole, record), lambda r: r["duration_sec"].isNotNull())
    return lines.where(parse.is_record(F.col(column))).select(*kept, F.inline(timed))


def parse_comma_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``benchmark,engine,scale,seconds`` lines with exactly four fields; a bad number drops the line."""
    return _records(lines, column, parse.comma_fields(F.col(column)), lambda n: n == 4, parse.strict_number)


def parse_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """Report lines of at least four tab or blank separated fields; ``12.3s`` is rescued as 12.3.

    The header line needs no test of its own: it does not start with the workload name.
    """
    return _records(lines, column, parse.blank_fields(F.col(column)), lambda n: n >= 4, parse.rescued_number)


def body_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither blank nor a header."""
    return lines.where(~parse.is_blank(F.col(column)) & ~parse.is_header(F.col(column)))


def first_nonempty(preferred: DataFrame, fallback: DataFrame) -> DataFrame:
    """``preferred`` if it has any row, else ``fallback``.

    The test is a job of its own that stops at the first record; the plan then holds one source only, so the
    other one is not scanned for nothing.
    """
    return fallback if preferred.isEmpty() else preferred


def comma_line(benchmark="benchmark", engine="engine", scale="scale", duration="duration_sec"):
    return F.concat_ws(",", benchmark, engine, scale, F.format_string("%.3f", F.col(duration)))


def report_line(benchmark="benchmark", engine="engine", scale="scale", duration="duration_sec"):
    return F.concat_ws("\t", benchmark, engine, scale, F.format_string("%.3f", F.col(duration)))


def append_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("append").text(path)


def replace_log(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def create_report(spark: SparkSession, path: str) -> None:
    """Start a report with its header line unless it exists already."""
    spark.createDataFrame([(REPORT_HEADER,)], "value STRING").write.mode("ignore").text(path)
