"""Scalar rules of configurations, durations and errors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Parallelism per scale label, and the rules for memory overhead and writer sizing.
SCALE_PARALLELISM = {"tiny": 8, "small": 64, "large": 256, "huge": 512}
DEFAULT_PARALLELISM = 128
MIN_OVERHEAD_GB = 0.384
OVERHEAD_SHARE = 0.1
MIN_WRITERS, MAX_WRITERS = 4, 64
MIN_BYTES_PER_WRITER = 134217728
GIB = 1024 * 1024 * 1024
ERROR_FLOOR = 1e-8


def scale_parallelism(scale: Column) -> Column:
    rule = None
    for label, degree in SCALE_PARALLELISM.items():
        rule = F.when(scale == label, degree) if rule is None else rule.when(scale == label, degree)
    return rule.otherwise(DEFAULT_PARALLELISM)


def parallelism_or_default(explicit: Column, scale: Column, auto: bool = True) -> Column:
    """Explicit value, else the default of the scale label, else the constant."""
    fallback = scale_parallelism(scale) if auto else F.lit(DEFAULT_PARALLELISM)
    return F.coalesce(explicit, fallback)


def flag_from_text(value: Column) -> Column:
    """1 for the text ``true`` in any case, 0 for anything else and for NULL."""
    return F.when(F.lower(value.cast("string")) == "true", 1).otherwise(0)


def memory_gb(text: Column) -> Column:
    """``4G``, ``4g`` or ``4GB`` as whole gigabytes, empty as 0; other units (``4096M``) are NULL."""
    upper = F.upper(text)
    digits = F.regexp_replace(F.regexp_replace(upper, "G$", ""), "GB$", "")
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("int"))


def overhead_gb(memory: Column) -> Column:
    return F.greatest(F.lit(MIN_OVERHEAD_GB), F.lit(OVERHEAD_SHARE) * memory.cast("double"))


def request_gb(executors: Column, memory: Column) -> Column:
    return executors * (memory + overhead_gb(memory))


def writers_for(parallelism: Column) -> Column:
    """A quarter of the parallelism, within the allowed number of writers."""
    return F.greatest(F.least(F.floor(parallelism / 4), F.lit(MAX_WRITERS)), F.lit(MIN_WRITERS)).cast("int")


def bytes_per_writer(input_gb: Column, writers: Column) -> Column:
    total = input_gb.cast("bigint") * F.lit(GIB)
    return F.greatest(F.call_function("div", total, writers.cast("bigint")), F.lit(MIN_BYTES_PER_WRITER).cast("bigint"))


def elapsed_sec(start_ns: Column, end_ns: Column) -> Column:
    """Nanoseconds to whole milliseconds to seconds."""
    return F.call_function("div", end_ns - start_ns, F.lit(1_000_000).cast("bigint")) / F.lit(1000.0)


def elapsed_whole_sec(start_s: Column, end_s: Column) -> Column:
    return (end_s - start_s).cast("double")


def epoch_ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * F.lit(1000).cast("bigint")


def round3(value: Column) -> Column:
    return F.round(value, 3)


def text3(value: Column) -> Column:
    return F.format_string("%.3f", value)


def config_label(executors: Column, cores: Column, memory: Column, par: Column, shuffle: Column) -> Column:
    """Short label of a configuration, as in ``2x1/2g P8 SP8``."""
    return F.concat(
        executors.cast("string"), F.lit("x"), cores.cast("string"), F.lit("/"), memory.cast("string"),
        F.lit("g P"), par.cast("int").cast("string"), F.lit(" SP"), shuffle.cast("int").cast("string"),
    )


def submit_options(row: dict[str, Column]) -> Column:
    """The ``--conf`` options of a run, from the columns of its configuration."""
    # Option names and their order.
    options = {
        "spark.executor.instances": row["executors"].cast("string"),
        "spark.executor.cores": row["executor_cores"].cast("string"),
        "spark.executor.memory": F.concat(row["executor_memory_gb"].cast("string"), F.lit("g")),
        "spark.driver.cores": row["driver_cores"].cast("string"),
        "spark.driver.memory": F.concat(row["driver_memory_gb"].cast("string"), F.lit("g")),
        "spark.default.parallelism": row["parallelism"].cast("string"),
        "spark.sql.shuffle.partitions": row["shuffle_partitions"].cast("string"),
        "spark.rdd.compress": row["rdd_compress"],
        "spark.io.compression.codec": row["io_compression_codec"],
    }
    return F.concat_ws(" ", *[F.concat(F.lit(f"--conf {key}="), value) for key, value in options.items()])


def absolute_error(y: Column, predicted: Column) -> Column:
    return F.abs(y - predicted)


def squared_error(y: Column, predicted: Column) -> Column:
    return (y - predicted) * (y - predicted)


def relative_error(y: Column, predicted: Column) -> Column:
    return F.abs(y - predicted) / F.greatest(F.abs(y), F.lit(ERROR_FLOOR))


def speedup(base: Column, value: Column) -> Column:
    return base / F.nullif(value, F.lit(0.0))


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """Stable bucket of a row key: the same under any partitioning and in any engine with md5."""
    return (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")
