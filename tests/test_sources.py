"""Scans and sinks on files: round trips, mixed headers, missing and broken inputs, generators."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.collect import source_counts
from tallyloom.operators.ordered import number_rows
from tallyloom.plans import flows
from tallyloom.schemas import AGG, META, RUNS
from tallyloom.sources import csvs, files, generate, logs, meta
from tallyloom.sources.eventlog import read_event_log, task_table, app_durations
from tallyloom.operators.eventlog import stage_rollup


def rows(frame):
    return [tuple(r) for r in frame.collect()]


def test_csv_header_is_written_for_an_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], RUNS)
    assert csvs.write_csv(empty, str(tmp_path / "runs"), RUNS.fieldNames())
    lines = [line for line in rows(spark.read.text(str(tmp_path / "runs")))]
    assert lines == [(",".join(RUNS.fieldNames()),)]
    assert not csvs.write_csv(spark.createDataFrame([], AGG), str(tmp_path / "agg"), skip_empty=True)
    assert not (tmp_path / "agg").exists()


def test_collect_csv_places_values_by_name(spark, tmp_path):
    for name, body in {
        "a/one.csv": "scale,median_sec,n\r\ntiny,1.5,3\r\n",
        "b/c/two.csv": "n,scale,note\n4,small,\"x, y\"\n5,large,z\n",
        "b/three one+more.csv": "median_sec,scale\n2.5,huge\n",
        "b/empty.csv": "", "b/other.txt": "scale\nno\n", "header_only.csv": "scale,n\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body.encode())
    table = csvs.collect_csv(spark, str(tmp_path), "*.csv", AGG)
    types = dict(table.dtypes)
    assert (types["median_sec"], types["n"], types["note"]) == ("double", "bigint", "string")
    got = {r.scale: (r.median_sec, r.n, r.note, r.source_file) for r in table.collect()}
    at = lambda name: str(tmp_path / name)
    assert got == {
        "tiny": (1.5, 3, None, at("a/one.csv")), "small": (None, 4, "x, y", at("b/c/two.csv")),
        "large": (None, 5, "z", at("b/c/two.csv")), "huge": (2.5, None, None, at("b/three one+more.csv")),
    }
    assert rows(source_counts(table)) == [(4, 3)]


def test_collect_csv_takes_numbers_as_pandas_writes_them(spark, tmp_path):
    """Whole numbers with a fraction, reordered and quoted headers, doubled quotes, files of other tables, broken files."""
    import gzip

    for name, body in {
        "agg/one.csv": b"n,median_sec,scale\n2.0,1.5,tiny\n,2.5,small\n",
        "agg/two.csv": b'scale,"a, b",n,median_sec\nlarge,"say ""yes""",7,x\n',
        "runs/three.csv": b"scale,run_idx\nhuge,1\n",
        "agg/broken.csv.gz": gzip.compress(b"scale,n\n" + b"lost,1\n" * 10)[:12], "agg/empty.csv": b"",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(body)
    table = csvs.collect_csv(spark, str(tmp_path), "*.csv*", AGG, path_pattern="/agg/")
    got = {r.scale: (r.n, r.median_sec, r["a, b"]) for r in table.collect()}
    assert got == {"tiny": (2, 1.5, None), "small": (None, 2.5, None), "large": (7, None, 'say "yes"')}
    left_out = csvs.skipped_files(spark, str(tmp_path), "*.csv*", path_pattern="/agg/")
    assert sorted(r.source_file.rsplit("/", 1)[1] for r in left_out.collect()) == ["broken.csv.gz"]
    swapped = csvs.read_csv(spark, str(tmp_path / "agg/one.csv"), AGG)
    assert swapped.columns == AGG.fieldNames() and {r.median_sec for r in swapped.collect()} == {1.5, 2.5}


def test_collect_csv_without_files(spark, tmp_path):
    table = csvs.collect_csv(spark, str(tmp_path), "*.csv", AGG)
    assert table.columns == [*AGG.fieldNames(), "source_file"] and table.isEmpty()


def test_read_csv_with_declared_schema(spark, tmp_path):
    (tmp_path / "agg.csv").write_text(",".join(AGG.fieldNames()) + "\nWordCount,Spark,tiny,9,1,1,1,1,1,0.5,2,1,2,1,1,8,8,true,lz4,1,1\n")
    row = csvs.read_csv(spark, str(tmp_path / "agg.csv"), AGG).first()
    assert (row.n, row.std_sec, row.rdd_compress, row.is_default) == (9, 0.5, "true", 1)


def test_meta_round_trip_missing_and_broken(spark, tmp_path):
    built = meta.build_meta(spark, scale="large", is_default=1)
    meta.write_meta(built, str(tmp_path / "meta"))
    assert rows(meta.read_meta(spark, str(tmp_path / "meta"))) == rows(built)
    assert "--conf spark.executor.memory=2g" in built.first().spark_conf
    (tmp_path / "pretty.json").write_text(json.dumps({"input_gb": 7, "rdd_compress": "false", "extra": 1}, indent=2))
    pretty = meta.read_meta(spark, str(tmp_path / "pretty.json"))
    assert pretty.columns == META.fieldNames() and (pretty.first().input_gb, pretty.first().rdd_compress) == (7, "false")
    (tmp_path / "broken.json").write_text("{not json")
    for path, expected in (("pretty.json", 7), ("broken.json", 1), ("absent.json", 1)):
        assert rows(meta.meta_value(meta.read_meta(spark, str(tmp_path / path)), "input_gb", 1)) == [(expected,)]


def test_log_sinks(spark, tmp_path):
    path = str(tmp_path / "log")
    text = lambda *lines: spark.createDataFrame([(line,) for line in lines], "value STRING")
    logs.create_report(spark, path)
    logs.append_log(text("a"), path)
    logs.create_report(spark, path)
    assert sorted(rows(logs.read_lines(spark, path))) == [(logs.REPORT_HEADER,), ("a",)]
    logs.replace_log(text("b", "c"), path)
    assert sorted(rows(logs.read_lines(spark, path))) == [("b",), ("c",)]


def test_listing_reads_sizes_only(spark, data):
    expected = {f: os.path.getsize(os.path.join(data, f)) for f in os.listdir(data) if f.endswith(".parquet")}
    listed = {os.path.basename(r.source_file): r.bytes for r in files.list_files(spark, data, "*.parquet").collect()}
    assert listed == expected
    assert rows(files.input_size(spark, data, "*.parquet")) == [(len(expected), sum(expected.values()))]
    plan = files.input_size(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<length:bigint>" in plan


def test_generators(spark, tmp_path):
    assert generate.integers(spark, 1000).count() == 1000
    assert rows(generate.constant_lines(spark, 3)) == [(generate.CONSTANT_LINE,)] * 3
    lines = [r.value for r in generate.random_text(spark.range(200), "id").collect()]
    again = [r.value for r in generate.random_text(spark.range(200).repartition(9), "id").collect()]
    assert sorted(lines) == sorted(again) and len(set(lines)) == 200
    lengths = [len(line.split(" ")) for line in lines]
    assert min(lengths) >= generate.SHORTEST_LINE and max(lengths) <= generate.LONGEST_LINE
    assert all(len(word) == generate.WORD_BYTES - 1 for line in lines for word in line.split(" "))
    mean = sum(len(line) + 1 for line in lines) / len(lines)
    assert mean == pytest.approx(generate.WORD_BYTES * (generate.SHORTEST_LINE + generate.LONGEST_LINE) / 2, rel=0.1)
    assert generate.writer_plan(1, 8) == (4, 268435456) and generate.writer_plan(1, 1000) == (64, 134217728)


def test_write_random_text_replaces_the_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(generate, "GIB", 1 << 18)
    for _ in range(2):
        n = generate.write_random_text(spark, str(tmp_path / "text"), 2, 8)
    lines = spark.read.text(str(tmp_path / "text"))
    assert lines.count() == n > 500
    size = sum(len(r.value) + 1 for r in lines.collect())
    assert abs(size - 2 * (1 << 18)) < 0.1 * size


def test_log_to_csv_and_collect(spark, tmp_path):
    text, log = str(tmp_path / "text"), str(tmp_path / "log")
    generate.constant_lines(spark, 50).write.text(text)
    flows.measure_word_count(spark, text, log, runs=3)
    meta.write_meta(meta.build_meta(spark, is_default=1), str(tmp_path / "meta"))
    report = str(tmp_path / "report")
    logs.create_report(spark, report)
    flows.log_to_csv(spark, log, report, str(tmp_path / "meta"), str(tmp_path / "out/runs"), str(tmp_path / "out/agg"))
    runs = csvs.read_csv(spark, str(tmp_path / "out/runs"), RUNS)
    assert sorted(r.run_idx for r in runs.collect()) == [1, 2, 3] and runs.first().parallelism == 8
    dataset = flows.collect_tables(spark, str(tmp_path / "out/agg"), str(tmp_path / "dataset"), drop_duplicates=True)
    row = dataset.first()
    assert (row.n, row.is_default, row.scale) == (3, 1, "tiny") and "/out/agg/" in row.source_file
    flows.log_to_csv(spark, report, report, "/nowhere", str(tmp_path / "none/runs"), str(tmp_path / "none/agg"))
    assert (tmp_path / "none/runs").exists() and not (tmp_path / "none/agg").exists()
    for name, paths, n in (
        ("first", ("/absent/log", log), 3), ("second", (log, "/absent/report"), 3), ("neither", ("/absent/log", "/absent/report"), 0),
    ):
        flows.log_to_csv(spark, *paths[:1], paths[1], str(tmp_path / "meta"), str(tmp_path / name / "runs"), str(tmp_path / name / "agg"))
        assert csvs.read_csv(spark, str(tmp_path / name / "runs"), RUNS).count() == (n if name == "second" else 0)
    both = flows.collect_tables(spark, str(tmp_path / "out"), str(tmp_path / "both"), drop_duplicates=True, path_pattern="/agg/")
    assert both.count() == 1
    with pytest.raises(ValueError, match="below"):
        flows.collect_tables(spark, str(tmp_path / "out"), str(tmp_path / "out/dataset"))


def test_train_baselines(spark):
    frame = spark.range(400).select(
        F.concat(F.lit("f"), "id").alias("source_file"), (F.col("id") % 8 + 1).cast("int").alias("executors"),
        (F.col("id") % 3 + 1).cast("int").alias("executor_cores"), F.lit(2).alias("executor_memory_gb"),
        (F.col("id") % 5 * 8).cast("int").alias("parallelism"), F.lit(8).alias("shuffle_partitions"),
        F.when(F.col("id") % 2 == 0, "lz4").otherwise("zstd").alias("io_compression_codec"),
        F.when(F.col("id") == 3, 1).otherwise(0).alias("is_default"),
    ).withColumn("median_sec", 100.0 / F.col("executors") + F.col("executor_cores"))
    result = flows.train_baselines(frame, ["source_file"], draws=1, folds=2, steps=1, trees=[5], depths=[5])
    scores = {r.model: r.RMSE for r in result.scores.collect()}
    assert set(scores) == {"Dummy", "RandomSearch_RF", "SimAnneal_RF"} and scores["RandomSearch_RF"] < scores["Dummy"]
    assert result.anneal_trace.count() == 2 and result.curve.count() == 6 and result.speedups.count() == 20


def test_event_logs_keep_spaced_lines_and_applications_apart(spark, tmp_path):
    lines = [
        '{"Event":"SparkListenerTaskEnd","Stage ID":1,"Stage Attempt ID":0,"Task Info":{"Launch Time":0,"Finish Time":5}}',
        '{ "Event" : "SparkListenerTaskEnd", "Stage ID" : 1, "Stage Attempt ID" : 0, "Task Info" : {"Launch Time":0,"Finish Time":7}}',
        '{"Stage ID":1,"Stage Attempt ID":0,"Task Info":{"Launch Time":0,"Finish Time":9},"Event":"SparkListenerTaskEnd"}',
        '{"Event":"SparkListenerJobEnd","Note":"SparkListenerTaskEnd"}', "no json",
    ]
    for app in ("app-20240101000000-0001", "local-1700000000000-2"):
        (tmp_path / app).write_text("\n".join(lines) + "\n")
    tasks = task_table(read_event_log(spark, str(tmp_path)))
    rolled = stage_rollup(tasks, ["app"]).collect()
    assert [(r.tasks, r.p50_task_ms, r.max_task_ms) for r in rolled] == [(3, 7.0, 9)] * 2
    assert len({r.app for r in rolled}) == 2


def test_event_log_of_a_real_application(spark, tmp_path):
    """A small application in a process of its own writes the log that is read here."""
    import subprocess
    import sys

    script = (
        "from pyspark.sql import SparkSession\n"
        "s = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')\n"
        "     .config('spark.eventLog.enabled', 'true').config('spark.eventLog.dir', 'file://" + str(tmp_path) + "')\n"
        "     .config('spark.sql.shuffle.partitions', '3').getOrCreate())\n"
        "s.range(0, 1000, 1, 4).groupBy('id').count().count()\n"
        "s.stop()\n"
    )
    subprocess.run([sys.executable, "-c", script], check=True, timeout=120, capture_output=True)
    lines = read_event_log(spark, str(tmp_path))
    stages = stage_rollup(task_table(lines)).collect()
    assert stages and sum(r.tasks for r in stages) >= 4
    assert sum(r.shuffle_write_bytes for r in stages) > 0 and all(r.p50_task_ms <= r.max_task_ms for r in stages)
    assert app_durations(lines).first().app_sec > 0
    large = stage_rollup(task_table(lines), one_task=False).collect()
    assert sorted(map(tuple, large)) == sorted(map(tuple, stages))


@pytest.mark.parametrize("one_task", [True, False])
def test_runs_are_numbered_across_appended_and_compressed_files(spark, tmp_path, monkeypatch, one_task):
    """Names against the order of writing, a compressed file in pieces, lines that are no records in between."""
    import gzip
    import os

    monkeypatch.setattr(logs, "PIECE_ROWS", 7)
    seconds, when = iter(range(1, 1000)), 1_700_000_000
    for name, count in (("z.log", 25), ("m.log.gz", 40), ("a.log", 10), ("b.log", 1), ("c.log", 30)):
        lines = [f"WordCount,Spark,tiny,{next(seconds)}.0" if i % 4 else "# note" for i in range(count)]
        text = ("\n".join(lines) + "\n").encode()
        (tmp_path / name).write_bytes(gzip.compress(text) if name.endswith(".gz") else text)
        when += 0 if name == "a.log" else 10  # a.log and the file before it have the same time
        os.utime(tmp_path / name, (when, when))
    records = logs.parse_comma_log(logs.read_ordered_lines(spark, str(tmp_path)))
    numbered = number_rows(records, logs.LOG_ORDER, blocks=logs.LOG_BLOCK, one_task=one_task).collect()
    by_place = sorted(numbered, key=lambda r: (r.log_time, r.log_file, r.log_offset, r.log_row))
    assert [r.run_idx for r in by_place] == list(range(1, len(by_place) + 1))
    files = [r.log_file.rsplit("/", 1)[1] for r in by_place]
    assert list(dict.fromkeys(files)) == ["z.log", "a.log", "m.log.gz", "c.log"]  # b.log has no record
    within = {}
    for r in by_place:
        within.setdefault(r.log_file, []).append(r.duration_sec)
    assert all(v == sorted(v) for v in within.values()) and len({r.log_piece for r in by_place}) > 3
