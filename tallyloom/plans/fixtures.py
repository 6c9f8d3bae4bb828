"""Run logs, configurations and regression data that Spark derives row by row from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyloom.functions.scalars import text3
from tallyloom.sources.logs import REPORT_HEADER
from tallyloom.sources.tables import balanced_table, table

ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _by_kind(number: Column, period: int, kinds: dict[int, Column], other: Column) -> Column:
    rule = None
    for kind, text in kinds.items():
        hit = number % period == kind
        rule = F.when(hit, text) if rule is None else rule.when(hit, text)
    return rule.otherwise(other)


def comma_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, value): one comma log line per event, with blank, malformed and oddly spaced lines among them."""
    scale, seconds = F.col("event_type"), text3(F.col("value"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    value = _by_kind(F.col("event_id"), 50, {
        0: F.lit(""),
        1: F.lit("Benchmark,Engine,Scale,Duration(s)"),
        2: line("WordCount,Spark,", scale),
        3: line("WordCount,Spark,", scale, ",n/a"),
        4: line("Sort,Spark,", scale, ",", seconds),
        5: line(" wordcount , Spark ,\t", scale, " , ", seconds, " "),
        6: line("WordCount,Spark,", scale, ",", seconds, "s"),
        7: line("WordCount,Spark,", scale, ",", seconds, ",extra"),
    }, line("WordCount,Spark,", scale, ",", seconds))
    return balanced_table(spark, folder, "events").select(F.col("event_id").alias("seq"), value.alias("value"))


def report_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(seq, value): one report line per event, tab or blank separated, with rescued and unusable durations."""
    scale, seconds = F.col("event_type"), text3(F.col("value"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    value = _by_kind(F.col("event_id"), 50, {
        0: F.lit("   "),
        1: F.lit(REPORT_HEADER),
        2: line("WordCount\tSpark\t", scale, "\tn/a"),
        3: line("wordcount  spark ", scale, " ", seconds, "s"),
        4: line("WordCount\tSpark\t", scale, "\t-", seconds, "s"),
        5: line("Sort\tSpark\t", scale, "\t", seconds),
        6: line("WordCount \t Spark\t", scale, " ", seconds, " more\tfields"),
        7: line("WordCount\tSpark\t", scale),
    }, line("WordCount\tSpark\t", scale, "\t", seconds))
    return balanced_table(spark, folder, "events").select(F.col("event_id").alias("seq"), value.alias("value"))


def event_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Clean run records: one per event, in event order."""
    return balanced_table(spark, folder, "events").select(
        F.col("event_id").alias("seq"), F.lit("WordCount").alias("benchmark"), F.lit("Spark").alias("engine"),
        F.col("event_type").alias("scale"), F.col("value").alias("duration_sec"),
    )


def spaced_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Document lines with leading, doubled and trailing blanks."""
    line = F.explode(F.split("text", "\n")).alias("line")
    return balanced_table(spark, folder, "documents").select(line).select(
        F.when(F.col("line") == "", F.col("line"))
        .otherwise(F.concat(F.lit(" "), F.replace("line", F.lit(", "), F.lit(",  ")), F.lit("  ")))
        .alias("value")
    )


def conf_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(line_no, value): one configuration line per order; keys repeat, some lines are comments or lack a value."""
    key = F.concat(F.lit("cust."), F.col("o_custkey").cast("string"))
    value = _by_kind(F.col("o_orderkey"), 20, {
        0: F.lit(""),
        1: F.concat(F.lit("# "), key, F.lit(" "), F.col("o_orderpriority")),
        2: key,
        3: F.concat(F.lit("  "), key, F.lit(" \t "), F.col("o_orderpriority"), F.lit("  ")),
    }, F.concat(key, F.lit("  "), F.col("o_orderpriority"), F.lit("   "), F.col("o_orderstatus")))
    return balanced_table(spark, folder, "orders").select(F.col("o_orderkey").alias("line_no"), value.alias("value"))


def conf_changes(spark: SparkSession, folder: str) -> DataFrame:
    """(line_no, key, value): two settings per customer, one per nation with many repetitions."""
    customer = table(spark, folder, "customer")
    pairs = F.array(
        F.struct(
            (F.col("c_custkey") * 2).alias("line_no"),
            F.concat(F.lit("cust."), (F.col("c_custkey") * 2).cast("string")).alias("key"),
            F.col("c_mktsegment").alias("value"),
        ),
        F.struct(
            (F.col("c_custkey") * 2 + 1).alias("line_no"),
            F.concat(F.lit("nation."), F.col("c_nationkey").cast("string")).alias("key"),
            F.col("c_name").alias("value"),
        ),
    )
    return customer.select(F.inline(pairs))


def agg_like(spark: SparkSession, folder: str) -> DataFrame:
    """Aggregate-table rows, one per part, with its key."""
    size, price = F.col("p_size"), F.col("p_retailprice")
    scale = F.element_at(F.array(*[F.lit(s) for s in ("tiny", "small", "large", "huge")]), size % 4 + 1)
    return balanced_table(spark, folder, "part").select(
        "p_partkey",
        F.lit("WordCount").alias("benchmark"), F.lit("Spark").alias("engine"), scale.alias("scale"),
        size.cast("bigint").alias("n"), price.alias("mean_sec"), (price - 1).alias("median_sec"),
        (price - 1).alias("p50_sec"), (price + 2).alias("p90_sec"), (price + 3).alias("p99_sec"),
        F.lit(0.5).alias("std_sec"), (size % 4 + 1).alias("executors"), (size % 3 + 1).alias("executor_cores"),
        (size % 5 + 1).alias("executor_memory_gb"), F.lit(1).alias("driver_cores"), F.lit(1).alias("driver_memory_gb"),
        (size * 8).alias("parallelism"), (size * 16).alias("shuffle_partitions"),
        F.lit("true").alias("rdd_compress"), F.lit("lz4").alias("io_compression_codec"), size.alias("input_gb"),
        F.when(size == 1, 1).otherwise(0).alias("is_default"),
    )


def agg_layouts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The aggregate rows in two layouts: one reversed and without ``p90_sec``, one with an extra ``note``."""
    rows = agg_like(spark, folder)
    names = [c for c in rows.columns if c != "p_partkey"]
    even = rows.where("p_partkey % 2 = 0").select(*[c for c in reversed(names) if c != "p90_sec"])
    odd = rows.where("p_partkey % 2 = 1").select(*names, F.concat(F.lit("part "), "p_partkey").alias("note"))
    return even, odd


def tuning_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One tuning record per order, with NULL targets, mixed-case booleans and some feature columns absent."""
    key = F.col("o_orderkey")
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return balanced_table(spark, folder, "orders").select(
        "o_orderkey",
        (key % 4 + 1).cast("int").alias("executors"),
        (key % 3 + 1).cast("int").alias("executor_cores"),
        (key % 100 + 8).cast("int").alias("parallelism"),
        F.when(priority == "1-URGENT", "true").when(priority == "2-HIGH", "TRUE").when(priority == "3-MEDIUM", "False")
        .when(priority == "5-LOW", "yes").alias("rdd_compress"),
        F.when(status == "F", "lz4").when(status == "O", "snappy").alias("io_compression_codec"),
        F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("median_sec"),
    )


def configurations(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with the configuration each of them ran under; one configuration is the default."""
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    default = (flag == "N") & (status == "O") & (line == 1)
    return balanced_table(spark, folder, "lineitem").select(
        F.concat(flag, status, line.cast("string")).alias("source_file"),
        line.alias("executors"),
        F.when(flag == "A", 1).when(flag == "N", 2).otherwise(4).alias("executor_cores"),
        F.when(status == "F", 2).otherwise(4).alias("executor_memory_gb"),
        (line * 8).alias("parallelism"), (line * 16).alias("shuffle_partitions"),
        F.when(default, 1).otherwise(0).alias("is_default"),
        F.col("l_extendedprice").alias("seconds"),
    )


def workers(spark: SparkSession, folder: str) -> DataFrame:
    """One worker per supplier, grouped to clusters by nation; memory sizes in several spellings."""
    key = F.col("s_suppkey")
    memory = F.when(key % 40 == 0, "4096M").otherwise(
        F.element_at(F.array(*[F.lit(m) for m in ("4G", "4GB", "4g", "8G")]), (key % 4 + 1).cast("int"))
    )
    return table(spark, folder, "supplier").select(
        F.col("s_nationkey").alias("cluster"), (F.col("s_nationkey") % 4 + 1).alias("cores"), memory.alias("memory")
    )


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """One executor request per part, sent to a cluster."""
    size = F.col("p_size")
    return balanced_table(spark, folder, "part").select(
        "p_partkey", (F.col("p_partkey") % 25).cast("int").alias("cluster"), (size % 4 + 1).alias("executors"),
        (size % 3 + 1).alias("executor_cores"), (size % 8 + 1).alias("executor_memory_gb"),
    )


def scripts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as script bodies: an interpreter line, then a print statement per text line."""
    body = F.replace("text", F.lit("\n"), F.lit("  \n\tprint "))
    return balanced_table(spark, folder, "conversations").select(
        "conv_id", "turn", "text", F.concat(F.lit("#!/usr/bin/env python2\n  print "), body).alias("script")
    )


def regression_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their net price as label."""
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return balanced_table(spark, folder, "lineitem").select(
        *ROW_KEY, "l_extendedprice", "l_discount", "l_tax", "l_quantity", "l_returnflag",
        (price * (1 - discount) * (1 + tax)).alias("label"),
    )


def scored_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Search traces of 61 draws each, one draw per part, with hash-picked scores and chances."""
    key = F.col("p_partkey")
    picked = lambda salt, buckets: (
        F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % buckets / 100.0
    )
    return balanced_table(spark, folder, "part").select(
        F.floor(key / 61).alias("search_id"), (key % 61).cast("int").alias("iter"),
        picked("s", 1000).alias("score"), picked("u", 100).alias("u"),
    )


def event_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(app, value): event-log lines, one per event; the event type decides the kind of line."""
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    event = lambda name, *fields: F.to_json(F.struct(F.lit(name).alias("Event"), *fields))
    number = F.col("event_id")
    task = event(
        "SparkListenerTaskEnd",
        (F.col("user_id") % 20).cast("int").alias("Stage ID"), F.lit(0).alias("Stage Attempt ID"),
        F.struct(
            number.alias("Task ID"), at.alias("Launch Time"),
            (at + F.round(F.col("value") * 1000).cast("bigint")).alias("Finish Time"),
        ).alias("Task Info"),
        F.struct(
            F.when(number % 3 == 0, number).otherwise(0).alias("Memory Bytes Spilled"),
            F.lit(0).alias("Disk Bytes Spilled"),
            F.struct((number * 3).alias("Remote Bytes Read"), number.alias("Local Bytes Read")).alias("Shuffle Read Metrics"),
            F.struct((number * 10).alias("Shuffle Bytes Written")).alias("Shuffle Write Metrics"),
        ).alias("Task Metrics"),
    )
    kind = F.col("event_type")
    line = (
        F.when(kind == "signup", event("SparkListenerApplicationStart", at.alias("Timestamp")))
        .when(kind == "purchase", event("SparkListenerApplicationEnd", at.alias("Timestamp")))
        .when(kind == "error", event("SparkListenerJobEnd", number.alias("Job ID")))
        .otherwise(task)
    )
    return balanced_table(spark, folder, "events").select(F.col("user_id").alias("app"), line.alias("value"))
