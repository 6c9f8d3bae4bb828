"""Text generators: narrow plans from ``spark.range`` or from a seed column, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.scalars import GIB, MAX_WRITERS, MIN_BYTES_PER_WRITER, MIN_WRITERS

# Fixed value: the constant input line.
CONSTANT_LINE = "lorem ipsum dolor sit amet consectetur adipiscing elit"
DEFAULT_LINES = 500_000

# Line length in words and the consonants behind the sixteen hex digits.
SHORTEST_LINE, LONGEST_LINE = 25, 110
HEX_DIGITS, CONSONANTS = "0123456789abcdef", "bdfghjklmnprstvz"
WORD_DIGITS, WORD_BYTES, HASH_DIGITS = 3, 7, 32


def row_number() -> Column:
    """An integer per row of any table."""
    return F.monotonically_increasing_id()


def constant_line(line: str = CONSTANT_LINE) -> Column:
    """The same line for every row of any table."""
    return F.lit(line)


def integers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n)


def constant_lines(spark: SparkSession, n: int = DEFAULT_LINES, line: str = CONSTANT_LINE) -> DataFrame:
    return spark.range(n).select(constant_line(line).alias("value"))


def random_line(seed: Column) -> Column:
    """A line of words, three hash digits each: every digit gives a consonant, vowels go in between.

    Length and words depend on the seed only, so a task that is run again repeats its rows.
    """
    seed = seed.cast("string")
    spread = LONGEST_LINE - SHORTEST_LINE + 1
    number = F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("bigint")
    digits = ((SHORTEST_LINE + number % spread) * WORD_DIGITS).cast("int")
    hashes = F.transform(
        F.sequence(F.lit(0), F.call_function("div", digits, F.lit(HASH_DIGITS)).cast("int")),
        lambda block: F.md5(F.concat(seed, F.lit(":"), block.cast("string"))),
    )
    letters = F.translate(F.substring(F.array_join(hashes, ""), F.lit(1), digits), HEX_DIGITS, CONSONANTS)
    return F.rtrim(F.regexp_replace(letters, "(.)(.)(.)", "$1a$2e$3o "))


def random_text(rows: DataFrame, seed: str) -> DataFrame:
    """One random line per row of ``rows``."""
    return rows.select(random_line(F.col(seed)).alias("value"))


def writer_plan(input_gb: int, parallelism: int) -> tuple[int, int]:
    """Number of writers and bytes per writer for a target size, as plain numbers for the generator."""
    writers = max(MIN_WRITERS, min(MAX_WRITERS, parallelism // 4))
    per_writer = max(MIN_BYTES_PER_WRITER, input_gb * GIB // writers)
    return writers, per_writer


def write_random_text(spark: SparkSession, path: str, input_gb: int, parallelism: int) -> int:
    """Replace ``path`` by about ``input_gb`` GB of random text; returns the number of lines.

    The writer rule stops at 64 writers; beyond it more tasks share the work, so that none writes over 1 GB.
    """
    writers, per_writer = writer_plan(input_gb, parallelism)
    total = input_gb * GIB
    files = max(1, min(writers, total // per_writer), input_gb)
    line_bytes = WORD_BYTES * (SHORTEST_LINE + LONGEST_LINE) // 2
    n = total // line_bytes
    random_text(spark.range(0, n, 1, files), "id").write.mode("overwrite").text(path)
    return n
