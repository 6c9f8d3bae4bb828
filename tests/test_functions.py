"""Edge cases of the column functions, against plain Python where it defines the semantics."""

import re

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import parse, scalars, text


def one(spark, values, kind, *columns):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")
    return [tuple(r)[1:] for r in frame.select("i", *columns).orderBy("i").collect()]


LINES = ["", "   ", "a b", "  a  b ", "a\tb", "a b", "a\x1cb\x1fc", " x　y ", "a\x85b", "\ta\n", "é ü  ß"]


def test_words_split_like_python(spark):
    got = [r[0] for r in one(spark, LINES, "STRING", text.words(F.col("x")))]
    assert got == [line.split() for line in LINES]


def test_strip_like_python(spark):
    assert [r[0] for r in one(spark, LINES, "STRING", text.strip(F.col("x")))] == [line.strip() for line in LINES]


def test_space_tokens_keep_inner_and_leading_empties(spark):
    cases = {
        "": [""], "   ": [], "a b": ["a", "b"], " a": ["", "a"], "a  b": ["a", "", "b"], "a ": ["a"],
        "  a  b  ": ["", "", "a", "", "b"], "a\tb": ["a\tb"],
    }
    got = [r[0] for r in one(spark, list(cases), "STRING", text.space_tokens(F.col("x")))]
    assert got == list(cases.values())


def test_print_rewrite_like_python(spark):
    bodies = [
        "print x", "  print x  \nprint y\n", "\tprint 'a  b'\t ", "print(x)", "printer x", "print ", "print    ", "x\n print z",
        "print a\r\nprint b", "print a b", "print x ",
    ]
    expected = [
        re.sub(r"(?m)^[ \t]*print (.+)$", lambda m: "print(" + m.group(1).rstrip() + ")", body) for body in bodies
    ]
    assert [r[0] for r in one(spark, bodies, "STRING", text.call_style_prints(F.col("x")))] == expected


def test_shebang_and_quotes(spark):
    scripts = ["#!/usr/bin/env python2\nx", "#!/usr/bin/env python\nx", "#!/usr/bin/env python3\nx", "x\n#!/usr/bin/env python\n"]
    got = [r[0] for r in one(spark, scripts, "STRING", text.python3_shebang(F.col("x")))]
    assert got == ["#!/usr/bin/env python3\nx"] * 3 + ["x\n#!/usr/bin/env python\n"]
    assert one(spark, ['say "hi"'], "STRING", text.escape_quotes(F.col("x"))) == [('say \\"hi\\"',)]


NUMBERS = {
    "12.345": 12.345, "12": 12.0, "-1.5": -1.5, "+2": 2.0, ".5": 0.5, "5.": 5.0, "1e3": 1000.0, "1_000": 1000.0, "1_0.5_0": 10.5,
    "5d": None, "5f": None, "nan": None, "inf": None, "1e400": None, "n/a": None, "": None, "1__0": None, "1.2s": None, "0x10": None,
}


def test_strict_number(spark):
    assert [r[0] for r in one(spark, list(NUMBERS), "STRING", parse.strict_number(F.col("x")))] == list(NUMBERS.values())


def test_rescued_number_takes_the_first_unsigned_number(spark):
    cases = {"1.2s": 1.2, "-1.2s": 1.2, "5d": 5.0, "t=3.4.5": 3.4, "n/a": None, "": None, "-7": -7.0, "12.": 12.0}
    assert [r[0] for r in one(spark, list(cases), "STRING", parse.rescued_number(F.col("x")))] == list(cases.values())


def test_memory_sizes(spark):
    cases = {"4G": 4, "4g": 4, "4GB": 4, "4gb": 4, "4096M": None, "": 0, "16": 16, "x": None}
    assert [r[0] for r in one(spark, list(cases), "STRING", scalars.memory_gb(F.col("x")))] == list(cases.values())


def test_flags(spark):
    values = ["true", "True", "TRUE", "false", "yes", "", None]
    assert [r[0] for r in one(spark, values, "STRING", scalars.flag_from_text(F.col("x")))] == [1, 1, 1, 0, 0, 0, 0]
    assert [r[0] for r in one(spark, [True, False, None], "BOOLEAN", scalars.flag_from_text(F.col("x")))] == [1, 0, 0]


def test_scale_defaults(spark):
    scales = ["tiny", "small", "large", "huge", "custom", None]
    assert [r[0] for r in one(spark, scales, "STRING", scalars.scale_parallelism(F.col("x")))] == [8, 64, 256, 512, 128, 128]
    explicit = scalars.parallelism_or_default(F.lit(None).cast("int"), F.col("x"), auto=False)
    assert [r[0] for r in one(spark, ["tiny"], "STRING", explicit)] == [128]


@pytest.mark.parametrize("gb,par", [(1, 8), (1, 1), (8, 128), (500, 256), (1024, 512), (3, 17)])
def test_writer_sizing(spark, gb, par):
    maps = min(64, max(4, par // 4))
    size = max(134217728, gb * 1024**3 // maps)
    row = spark.range(1).select(
        scalars.writers_for(F.lit(par)).alias("w"), scalars.bytes_per_writer(F.lit(gb), scalars.writers_for(F.lit(par))).alias("b")
    ).first()
    assert (row.w, row.b) == (maps, size)


def test_request_and_elapsed(spark):
    row = spark.range(1).select(
        scalars.overhead_gb(F.lit(2)).alias("small"), scalars.overhead_gb(F.lit(8)).alias("large"),
        scalars.request_gb(F.lit(2), F.lit(4)).alias("request"),
        scalars.elapsed_sec(F.lit(1_000_000_000), F.lit(3_456_789_999)).alias("sec"), scalars.text3(F.lit(1.23456)).alias("t"),
        scalars.elapsed_whole_sec(F.lit(10), F.lit(14)).alias("whole"),
    ).first()
    assert (row.small, row.large, row.request, row.sec, row.t, row.whole) == (0.384, 0.8, 8.8, 2.456, "1.235", 4.0)


def test_errors_and_speedup_with_zero(spark):
    row = spark.range(1).select(
        scalars.relative_error(F.lit(0.0), F.lit(1.0)).alias("r"), scalars.speedup(F.lit(2.0), F.lit(0.0)).alias("s")
    ).first()
    assert row.r == pytest.approx(1e8) and row.s is None
