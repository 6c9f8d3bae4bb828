"""SQL for the registered queries, written for DuckDB over the same tables.

Queries without an entry have no SQL form: file listings depend on the folder, forests are not SQL.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# Shared CTEs: the derived inputs.

COMMA_LINES = r"""
comma_lines AS (
    SELECT event_id AS seq, CASE event_id % 50
        WHEN 0 THEN ''
        WHEN 1 THEN 'Benchmark,Engine,Scale,Duration(s)'
        WHEN 2 THEN 'WordCount,Spark,' || event_type
        WHEN 3 THEN 'WordCount,Spark,' || event_type || ',n/a'
        WHEN 4 THEN 'Sort,Spark,' || event_type || ',' || printf('%.3f', value)
        WHEN 5 THEN ' wordcount , Spark ,' || chr(9) || event_type || ' , ' || printf('%.3f', value) || ' '
        WHEN 6 THEN 'WordCount,Spark,' || event_type || ',' || printf('%.3f', value) || 's'
        WHEN 7 THEN 'WordCount,Spark,' || event_type || ',' || printf('%.3f', value) || ',extra'
        ELSE 'WordCount,Spark,' || event_type || ',' || printf('%.3f', value) END AS line
    FROM events
),
comma_fields AS (
    SELECT seq, list_transform(string_split(trim(line, ' ' || chr(9)), ','), lambda x: trim(x, ' ' || chr(9))) AS f
    FROM comma_lines
),
comma_runs AS (
    SELECT seq, f[1] AS benchmark, f[2] AS engine, f[3] AS scale, try_cast(f[4] AS DOUBLE) AS duration_sec
    FROM comma_fields
    WHERE len(f) = 4 AND lower(f[1]) LIKE 'wordcount%' AND try_cast(f[4] AS DOUBLE) IS NOT NULL
)"""

REPORT_LINES = r"""
report_lines AS (
    SELECT event_id AS seq, CASE event_id % 50
        WHEN 0 THEN '   '
        WHEN 1 THEN 'Benchmark' || chr(9) || 'Engine' || chr(9) || 'Scale' || chr(9) || 'Duration(s)'
        WHEN 2 THEN 'WordCount' || chr(9) || 'Spark' || chr(9) || event_type || chr(9) || 'n/a'
        WHEN 3 THEN 'wordcount  spark ' || event_type || ' ' || printf('%.3f', value) || 's'
        WHEN 4 THEN 'WordCount' || chr(9) || 'Spark' || chr(9) || event_type || chr(9) || '-' || printf('%.3f', value) || 's'
        WHEN 5 THEN 'Sort' || chr(9) || 'Spark' || chr(9) || event_type || chr(9) || printf('%.3f', value)
        WHEN 6 THEN 'WordCount ' || chr(9) || ' Spark' || chr(9) || event_type || ' ' || printf('%.3f', value) || ' more' || chr(9) || 'fields'
        WHEN 7 THEN 'WordCount' || chr(9) || 'Spark' || chr(9) || event_type
        ELSE 'WordCount' || chr(9) || 'Spark' || chr(9) || event_type || chr(9) || printf('%.3f', value) END AS line
    FROM events
),
report_fields AS (
    SELECT seq, line, string_split_regex(trim(line, ' ' || chr(9)), '[\t ]+') AS f
    FROM report_lines WHERE trim(line, ' ' || chr(9)) <> '' AND NOT lower(line) LIKE 'benchmark%'
),
report_runs AS (
    SELECT * FROM (
        SELECT seq, line, f[1] AS benchmark, f[2] AS engine, f[3] AS scale,
               coalesce(try_cast(f[4] AS DOUBLE), try_cast(regexp_extract(f[4], '([0-9]+(\.[0-9]+)?)', 1) AS DOUBLE)) AS duration_sec
        FROM report_fields WHERE len(f) >= 4 AND lower(f[1]) LIKE 'wordcount%')
    WHERE duration_sec IS NOT NULL
)"""

CONF_LINES = r"""
conf_lines AS (
    SELECT o_orderkey AS line_no, CASE o_orderkey % 20
        WHEN 0 THEN ''
        WHEN 1 THEN '# cust.' || o_custkey || ' ' || o_orderpriority
        WHEN 2 THEN 'cust.' || o_custkey
        WHEN 3 THEN '  cust.' || o_custkey || ' ' || chr(9) || ' ' || o_orderpriority || '  '
        ELSE 'cust.' || o_custkey || '  ' || o_orderpriority || '   ' || o_orderstatus END AS line
    FROM orders
),
conf AS (
    SELECT line_no, f[1] AS key, array_to_string(f[2:], ' ') AS value
    FROM (SELECT line_no, string_split_regex(trim(line, ' ' || chr(9)), '\s+') AS f FROM conf_lines)
    WHERE len(f) >= 2 AND NOT f[1] LIKE '#%'
),
changes AS (
    SELECT c_custkey * 2 AS line_no, 'cust.' || (c_custkey * 2) AS key, c_mktsegment AS value FROM customer
    UNION ALL
    SELECT c_custkey * 2 + 1, 'nation.' || c_nationkey, c_name FROM customer
)"""

AGG_LIKE = """
agg_like AS (
    SELECT p_partkey, 'WordCount' AS benchmark, 'Spark' AS engine,
        ['tiny', 'small', 'large', 'huge'][p_size % 4 + 1] AS scale, CAST(p_size AS BIGINT) AS n,
        p_retailprice AS mean_sec, p_retailprice - 1 AS median_sec, p_retailprice - 1 AS p50_sec,
        p_retailprice + 2 AS p90_sec, p_retailprice + 3 AS p99_sec, CAST(0.5 AS DOUBLE) AS std_sec,
        p_size % 4 + 1 AS executors, p_size % 3 + 1 AS executor_cores, p_size % 5 + 1 AS executor_memory_gb,
        1 AS driver_cores, 1 AS driver_memory_gb, p_size * 8 AS parallelism, p_size * 16 AS shuffle_partitions,
        'true' AS rdd_compress, 'lz4' AS io_compression_codec, p_size AS input_gb,
        CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS is_default
    FROM part
)"""

REGRESSION = """
regression AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag,
        l_extendedprice * (1 - l_discount) * (1 + l_tax) AS label,
        '|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS row_key
    FROM lineitem
),
split_rows AS (
    SELECT *, CASE WHEN CAST('0x' || substr(md5(row_key), 1, 8) AS BIGINT) % 100 < 25 THEN 'test' ELSE 'train' END AS part
    FROM regression
)"""

PREDICTIONS = (
    REGRESSION
    + """,
predictions AS (
    SELECT 'Dummy' AS model, label, (SELECT median(label) FROM split_rows WHERE part = 'train') AS p
    FROM split_rows WHERE part = 'test'
    UNION ALL
    SELECT 'Mean', label, (SELECT avg(label) FROM split_rows WHERE part = 'train') FROM split_rows WHERE part = 'test'
),
scores AS (
    SELECT model, round(avg(abs(label - p)), 4) AS MAE, round(sqrt(avg((label - p) * (label - p))), 4) AS RMSE,
        round(1 - sum((label - p) * (label - p)) / (var_pop(label) * count(*)), 4) AS R2,
        round(avg(abs(label - p) / greatest(abs(label), 1e-8)) * 100, 4) AS MAPE
    FROM predictions GROUP BY model
)"""
)

STATS = """
    count(duration_sec) AS n, round(avg(duration_sec), 3) AS mean_sec, round(median(duration_sec), 3) AS median_sec,
    round(quantile_cont(duration_sec, 0.5), 3) AS p50_sec, round(quantile_cont(duration_sec, 0.9), 3) AS p90_sec,
    round(quantile_cont(duration_sec, 0.99), 3) AS p99_sec, round(stddev_pop(duration_sec), 3) AS std_sec
"""

SUBMIT_OPTIONS = """
    '--conf spark.executor.instances=' || executors || ' --conf spark.executor.cores=' || executor_cores ||
    ' --conf spark.executor.memory=' || executor_memory_gb || 'g --conf spark.driver.cores=' || driver_cores ||
    ' --conf spark.driver.memory=' || driver_memory_gb || 'g --conf spark.default.parallelism=' || parallelism ||
    ' --conf spark.sql.shuffle.partitions=' || shuffle_partitions || ' --conf spark.rdd.compress=' || rdd_compress ||
    ' --conf spark.io.compression.codec=' || io_compression_codec
"""

META = """
    2 AS executors, 1 AS executor_cores, 2 AS executor_memory_gb, 1 AS driver_cores, 1 AS driver_memory_gb,
    8 AS parallelism, 8 AS shuffle_partitions, 'true' AS rdd_compress, 'lz4' AS io_compression_codec, 1 AS input_gb
"""

# Word counts and generated text

ORACLES["wc_words"] = r"""
WITH w AS (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word"""

ORACLES["wc_single_space"] = r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
spaced AS (SELECT CASE WHEN line = '' THEN '' ELSE ' ' || replace(line, ', ', ',  ') || '  ' END AS line FROM l),
t AS (
    SELECT unnest(CASE WHEN line = '' THEN [''] WHEN rtrim(line, ' ') = '' THEN CAST([] AS VARCHAR[])
        ELSE string_split(rtrim(line, ' '), ' ') END) AS word
    FROM spaced)
SELECT word, count(*) AS n FROM t GROUP BY word"""

ORACLES["wc_distinct"] = r"""
WITH w AS (SELECT unnest(string_split_regex(text, '\s+')) AS word FROM documents)
SELECT count(DISTINCT word) AS distinct_words, count(*) AS words FROM w WHERE word <> ''"""

ORACLES["range_count"] = "SELECT count(*) AS n FROM lineitem"

ORACLES["gen_constant_lines"] = """
SELECT word, (SELECT count(*) FROM orders) AS n
FROM (SELECT unnest(string_split('lorem ipsum dolor sit amet consectetur adipiscing elit', ' ')) AS word)
WHERE (SELECT count(*) FROM orders) > 0"""

ORACLES["gen_random_text"] = r"""
WITH s AS (
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS seed,
        25 + CAST('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8) AS BIGINT) % 86 AS words
    FROM part),
p AS (SELECT p_partkey, seed, words, unnest(range(0, 12)) AS block FROM s),
h AS (SELECT p_partkey, words, string_agg(md5(seed || ':' || block), '' ORDER BY block) AS hex FROM p GROUP BY p_partkey, words)
SELECT p_partkey, rtrim(regexp_replace(translate(substr(hex, 1, CAST(3 * words AS INTEGER)), '0123456789abcdef', 'bdfghjklmnprstvz'),
    '(.)(.)(.)', '\1a\2e\3o ', 'g')) AS value
FROM h"""

ORACLES["text_rewrite"] = r"""
WITH s AS (
    SELECT conv_id, turn, text,
        '#!/usr/bin/env python2' || chr(10) || '  print ' || replace(text, chr(10), '  ' || chr(10) || chr(9) || 'print ') AS script
    FROM conversations)
SELECT conv_id, turn,
    replace(regexp_replace(regexp_replace(script, '(?m)^[ \t]*print [ \t]+$', 'print()', 'g'),
        '(?m)^[ \t]*print (.+?)[ \t]*$', 'print(\1)', 'g'), '/usr/bin/env python2' || chr(10), '/usr/bin/env python3' || chr(10)) AS script,
    replace(text, '"', '\"') AS escaped
FROM s"""

# Run logs

ORACLES["runs_from_csv_log"] = f"WITH {COMMA_LINES} SELECT * FROM comma_runs"

ORACLES["runs_from_report"] = f"WITH {REPORT_LINES} SELECT seq, benchmark, engine, scale, duration_sec FROM report_runs"

ORACLES["report_body"] = f"""
WITH {REPORT_LINES}
SELECT seq, line AS value FROM report_lines WHERE trim(line, ' ' || chr(9)) <> '' AND NOT lower(line) LIKE 'benchmark%'"""

ORACLES["runs_fallback"] = ORACLES["runs_from_report"]

ORACLES["runs_preferred"] = ORACLES["runs_from_csv_log"]

ORACLES["runs_enriched"] = f"""
WITH {COMMA_LINES}, m AS (SELECT {META})
SELECT benchmark, engine, scale, CAST(row_number() OVER (PARTITION BY scale ORDER BY seq) AS INTEGER) AS run_idx,
    round(duration_sec, 3) AS duration_sec, m.*, 0 AS is_default, {SUBMIT_OPTIONS} AS spark_conf
FROM comma_runs, m"""

ORACLES["runs_numbered"] = f"""
WITH {COMMA_LINES} SELECT *, row_number() OVER (ORDER BY seq) AS run_idx FROM comma_runs"""

ORACLES["run_stats"] = f"""
SELECT 'WordCount' AS benchmark, 'Spark' AS engine, event_type AS scale, {STATS.replace('duration_sec', 'value')}
FROM events GROUP BY event_type"""

ORACLES["log_stats"] = f"""
WITH {COMMA_LINES}
SELECT arg_min(benchmark, seq) AS benchmark, arg_min(engine, seq) AS engine, arg_min(scale, seq) AS scale, {STATS}
FROM comma_runs HAVING count(*) > 0"""

ORACLES["first_run_labels"] = f"""
WITH {REPORT_LINES}
SELECT scale, arg_min(benchmark, seq) AS benchmark, arg_min(engine, seq) AS engine, arg_min(duration_sec, seq) AS duration_sec
FROM report_runs GROUP BY scale"""

ORACLES["agg_rows"] = f"""
WITH {REPORT_LINES}
SELECT benchmark, engine, scale, {STATS}, {META}, 1 AS is_default
FROM report_runs GROUP BY benchmark, engine, scale"""

ORACLES["last_run_per_scale"] = f"""
WITH {REPORT_LINES}
SELECT seq, benchmark, engine, scale, duration_sec FROM report_runs
WHERE regexp_matches(line, '^WordCount\\s+Spark\\s+')
QUALIFY row_number() OVER (PARTITION BY scale ORDER BY seq DESC) = 1"""

ORACLES["log_head_tail"] = f"""
WITH {COMMA_LINES}
SELECT * FROM (SELECT *, 'head' AS part FROM comma_runs ORDER BY seq LIMIT 10)
UNION ALL
SELECT * FROM (SELECT *, 'tail' AS part FROM comma_runs ORDER BY seq DESC LIMIT 5)"""

ORACLES["log_append_roundtrip"] = """
SELECT 'WordCount' AS benchmark, 'Spark' AS engine, event_type AS scale, value AS duration_sec FROM events"""

ORACLES["elapsed_ms"] = """
SELECT user_id, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) * 1000 // 1000000 AS DOUBLE) / 1000 AS duration_sec
FROM events GROUP BY user_id"""

# Collected tables

ORACLES["collect_union"] = f"""
WITH {AGG_LIKE}
SELECT * EXCLUDE (p_partkey, p90_sec), CASE WHEN p_partkey % 2 = 1 THEN p90_sec END AS p90_sec,
    CASE WHEN p_partkey % 2 = 1 THEN 'part ' || p_partkey END AS note,
    CASE WHEN p_partkey % 2 = 1 THEN 'odd' ELSE 'even' END AS source
FROM agg_like"""

ORACLES["collect_csv_files"] = ORACLES["collect_union"]

ORACLES["collect_dedupe"] = """
SELECT l_orderkey, l_linenumber, l_extendedprice, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) = 1"""

ORACLES["collect_best_configs"] = f"""
WITH {AGG_LIKE}
SELECT * RENAME (p_partkey AS source_file) FROM agg_like
QUALIFY row_number() OVER (
    PARTITION BY executors, executor_cores, executor_memory_gb, driver_cores, driver_memory_gb, parallelism,
        shuffle_partitions, rdd_compress, io_compression_codec, input_gb, scale
    ORDER BY median_sec, p_partkey) = 1"""

ORACLES["collect_incremental"] = f"""
WITH {AGG_LIKE}
SELECT * FROM agg_like
QUALIFY row_number() OVER (
    PARTITION BY executors, executor_cores, executor_memory_gb, driver_cores, driver_memory_gb, parallelism,
        shuffle_partitions, rdd_compress, io_compression_codec, input_gb, scale
    ORDER BY median_sec, p_partkey) = 1"""

ORACLES["source_counts"] = "SELECT count(*) AS rows, count(DISTINCT source) AS files FROM documents"

ORACLES["dataset_build"] = """
SELECT o_orderkey, CAST(o_orderkey % 4 + 1 AS INTEGER) AS executors, CAST(o_orderkey % 3 + 1 AS INTEGER) AS executor_cores,
    CAST(o_orderkey % 100 + 8 AS INTEGER) AS parallelism,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS rdd_compress,
    CASE o_orderstatus WHEN 'F' THEN 'lz4' WHEN 'O' THEN 'snappy' END AS io_compression_codec,
    0 AS is_default, o_totalprice AS label
FROM orders WHERE o_totalprice >= 50000"""

ORACLES["speedup_top20"] = """
WITH c AS (
    SELECT l_returnflag || l_linestatus || l_linenumber AS source_file, l_linenumber AS executors,
        CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 4 END AS cores,
        CASE l_linestatus WHEN 'F' THEN 2 ELSE 4 END AS mem, median(l_extendedprice) AS median_sec,
        l_returnflag = 'N' AND l_linestatus = 'O' AND l_linenumber = 1 AS is_default
    FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber),
b AS (SELECT median_sec AS base FROM c WHERE is_default)
SELECT executors || 'x' || cores || '/' || mem || 'g P' || executors * 8 || ' SP' || executors * 16 AS label, source_file,
    round(median_sec, 4) AS median_sec, round(base / median_sec, 6) AS speedup
FROM c, b ORDER BY base / median_sec DESC, source_file LIMIT 20"""

# Configuration and resources

ORACLES["conf_scan"] = f"WITH {CONF_LINES} SELECT * FROM conf"

ORACLES["conf_scan_lookup"] = f"""
WITH {CONF_LINES}, first_lines AS (SELECT key, arg_min(value, line_no) AS value FROM conf GROUP BY key)
SELECT 'cust.' || c_custkey AS key, coalesce(s_name, f.value, 'none') AS value
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN first_lines f ON f.key = 'cust.' || c_custkey"""

ORACLES["conf_insert_absent"] = f"""
WITH {CONF_LINES}
SELECT key, value FROM conf
UNION ALL
SELECT key, arg_min(value, line_no) FROM changes WHERE key NOT IN (SELECT key FROM conf) GROUP BY key"""

ORACLES["conf_upsert"] = f"""
WITH {CONF_LINES}, new AS (SELECT key, arg_max(value, line_no) AS value FROM changes GROUP BY key)
SELECT conf.key, coalesce(new.value, conf.value) AS value FROM conf LEFT JOIN new USING (key)
UNION ALL
SELECT key, value FROM new WHERE key NOT IN (SELECT key FROM conf)"""

ORACLES["scale_parallelism"] = """
WITH s AS (
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'tiny' WHEN '2-HIGH' THEN 'small'
        WHEN '3-MEDIUM' THEN 'large' WHEN '5-LOW' THEN 'huge' ELSE 'custom' END AS scale
    FROM orders)
SELECT o_orderkey, scale, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 100 AS INTEGER)
    ELSE CASE scale WHEN 'tiny' THEN 8 WHEN 'small' THEN 64 WHEN 'large' THEN 256 WHEN 'huge' THEN 512 ELSE 128 END
    END AS parallelism
FROM s"""

ORACLES["prepare_sizing"] = """
WITH w AS (
    SELECT p_partkey, p_size, CAST(greatest(4, least(64, (p_partkey % 400) // 4)) AS INTEGER) AS writers FROM part)
SELECT *, greatest(134217728, CAST(p_size AS BIGINT) * 1073741824 // writers) AS bytes_per_writer FROM w"""

ORACLES["submit_options"] = f"WITH {AGG_LIKE} SELECT p_partkey, {SUBMIT_OPTIONS} AS spark_conf FROM agg_like"

WORKERS = """
workers AS (
    SELECT s_nationkey AS cluster, s_nationkey % 4 + 1 AS cores,
        CASE WHEN s_suppkey % 40 = 0 THEN NULL WHEN s_suppkey % 4 = 3 THEN 8 ELSE 4 END AS gb
    FROM supplier
)"""

ORACLES["resource_competition"] = f"""
WITH {WORKERS},
totals AS (
    SELECT cluster, CAST(sum(cores) AS BIGINT) AS sum_cores, CAST(sum(gb) AS BIGINT) AS sum_mem_gb, count(*) - count(gb) AS unknown_workers
    FROM workers GROUP BY cluster),
req AS (
    SELECT p_partkey, CAST(p_partkey % 25 AS INTEGER) AS cluster, CAST((p_size % 4 + 1) * (p_size % 3 + 1) AS BIGINT) AS cores,
        (p_size % 4 + 1) * ((p_size % 8 + 1) + greatest(CAST(0.384 AS DOUBLE), CAST(0.1 AS DOUBLE) * (p_size % 8 + 1))) AS mem
    FROM part),
each AS (
    SELECT *, round(greatest(cores / nullif(sum_cores, 0), mem / nullif(sum_mem_gb, 0)), 9) AS share,
        coalesce(unknown_workers = 0 AND cores <= sum_cores AND mem <= sum_mem_gb, false) AS alone
    FROM req LEFT JOIN totals USING (cluster)),
used AS (
    SELECT *, CAST(sum(CASE WHEN alone THEN cores ELSE 0 END) OVER w AS BIGINT) AS used_cores,
        CAST(sum(CASE WHEN alone THEN CAST(ceil(round(mem * 1000, 3)) AS BIGINT) ELSE 0 END) OVER w AS BIGINT) AS used_mb
    FROM each WINDOW w AS (PARTITION BY cluster ORDER BY share NULLS FIRST, p_partkey ROWS UNBOUNDED PRECEDING))
SELECT p_partkey, cluster, share, used_cores, round(used_mb / 1000, 3) AS used_gb,
    coalesce(alone AND used_cores <= sum_cores AND used_mb <= sum_mem_gb * 1000, false) AS granted
FROM used"""

ORACLES["resource_preflight"] = f"""
WITH {WORKERS},
totals AS (
    SELECT cluster, count(*) AS workers, CAST(sum(cores) AS BIGINT) AS sum_cores, CAST(sum(gb) AS BIGINT) AS sum_mem_gb,
        count(*) - count(gb) AS unknown_workers
    FROM workers GROUP BY cluster),
req AS (
    SELECT p_partkey, CAST(p_partkey % 25 AS INTEGER) AS cluster, CAST((p_size % 4 + 1) * (p_size % 3 + 1) AS BIGINT) AS req_cores,
        (p_size % 4 + 1) * ((p_size % 8 + 1) + greatest(CAST(0.384 AS DOUBLE), CAST(0.1 AS DOUBLE) * (p_size % 8 + 1))) AS mem
    FROM part),
each AS (
    SELECT p_partkey, p_size % 4 + 1 AS executors, p_size % 3 + 1 AS ec, CAST(p_partkey % 25 AS INTEGER) AS cluster,
        (p_size % 8 + 1) + greatest(CAST(0.384 AS DOUBLE), CAST(0.1 AS DOUBLE) * (p_size % 8 + 1)) AS need
    FROM part),
fit AS (
    SELECT p_partkey, executors, coalesce(sum(least(floor(cores / ec), floor(gb / need))), 0) >= executors AS fits
    FROM each LEFT JOIN workers USING (cluster) GROUP BY p_partkey, executors),
v AS (
    SELECT *, CASE WHEN workers IS NULL THEN 'skipped' WHEN unknown_workers > 0 THEN 'unknown'
        WHEN req_cores > sum_cores OR trunc(mem) > sum_mem_gb THEN 'reject' ELSE 'ok' END AS verdict
    FROM req LEFT JOIN totals USING (cluster))
SELECT p_partkey, cluster, req_cores, round(mem, 6) AS req_mem_gb, sum_cores, sum_mem_gb, verdict,
    CASE WHEN verdict IN ('ok', 'reject') THEN req_cores <= sum_cores AND mem <= sum_mem_gb END AS exact_fit,
    CASE WHEN verdict IN ('ok', 'reject') THEN fits END AS worker_fit
FROM v JOIN fit USING (p_partkey)"""

ORACLES["resource_totals"] = f"""
WITH {WORKERS}
SELECT count(*) AS workers, CAST(sum(cores) AS BIGINT) AS sum_cores, CAST(sum(gb) AS BIGINT) AS sum_mem_gb,
    count(*) - count(gb) AS unknown_workers FROM workers"""

# Features and models

ORACLES["hash_split"] = f"WITH {REGRESSION} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, part FROM split_rows"

ORACLES["train_fractions"] = f"""
WITH {REGRESSION},
b AS (SELECT l_orderkey, CAST('0x' || substr(md5('fraction' || row_key), 1, 8) AS BIGINT) % 100 AS bucket
      FROM split_rows WHERE part = 'train'),
f AS (SELECT unnest([20, 36, 52, 68, 84, 100]) AS percent)
SELECT percent, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM b JOIN f ON bucket < percent GROUP BY percent"""

ORACLES["one_hot"] = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS f0,
    CAST(l_returnflag = 'A' AS DOUBLE) AS f1, CAST(l_returnflag = 'N' AS DOUBLE) AS f2 FROM lineitem"""

ORACLES["written_sizes"] = """
SELECT coalesce(lang, 'none') AS lang, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY coalesce(lang, 'none')"""

ORACLES["one_hot_wide"] = """
WITH known AS (
    SELECT c, CAST(row_number() OVER (ORDER BY c) AS INTEGER) AS place
    FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS c FROM orders WHERE o_orderkey % 5 <> 0))
SELECT o_orderkey, CAST((SELECT count(*) FROM known) + 1 AS INTEGER) AS size, o_totalprice AS price, place AS hot,
    CASE WHEN place IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS flag
FROM orders LEFT JOIN known ON CAST(o_custkey AS VARCHAR) = c"""

ORACLES["dummy_metrics"] = f"WITH {PREDICTIONS} SELECT * FROM scores"

ORACLES["metrics_wide"] = ORACLES["dummy_metrics"]

ORACLES["metrics_long"] = f"""
WITH {PREDICTIONS}
SELECT model || '_' || metric AS key, value FROM (UNPIVOT scores ON MAE, RMSE, R2, MAPE INTO NAME metric VALUE value)"""

ORACLES["metric_series"] = f"WITH {PREDICTIONS} SELECT model, RMSE AS value FROM scores"

ORACLES["best_so_far"] = """
SELECT event_id, event_type, value,
    min(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM events"""

ORACLES["anneal_replay"] = """
WITH RECURSIVE draws AS (
    SELECT p_partkey // 61 AS search_id, CAST(p_partkey % 61 AS INTEGER) AS iter,
        CAST('0x' || substr(md5('s' || p_partkey), 1, 8) AS BIGINT) % 1000 / 100.0 AS score,
        CAST('0x' || substr(md5('u' || p_partkey), 1, 8) AS BIGINT) % 100 / 100.0 AS u
    FROM part),
firsts AS (SELECT search_id, min(iter) AS iter FROM draws GROUP BY search_id),
replay AS (
    SELECT search_id, iter, CAST(score AS DOUBLE) AS score FROM draws JOIN firsts USING (search_id, iter)
    UNION ALL
    SELECT d.search_id, d.iter,
        CASE WHEN d.score < r.score OR d.u < exp((r.score - d.score) / greatest(3.0 * pow(0.93, d.iter - 1), 1e-8))
            THEN d.score ELSE r.score END
    FROM replay r JOIN draws d ON d.search_id = r.search_id AND d.iter = r.iter + 1)
SELECT search_id, iter, score FROM replay"""

# Streams and event logs

ORACLES["gauge_rollup"] = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS source, count(*) AS n,
    round(avg(value), 9) AS avg_value, max(value) AS max_value
FROM events GROUP BY date_trunc('hour', ts), event_type"""

ORACLES["gauge_rollup_stream"] = """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type AS source, count(*) AS n,
    round(avg(value), 9) AS avg_value, max(value) AS max_value,
    date_trunc('hour', ts) + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 2 HOUR AS open
FROM events GROUP BY date_trunc('hour', ts), event_type"""

ORACLES["stream_run_stats"] = f"""
WITH {COMMA_LINES}
SELECT benchmark, engine, scale, count(*) AS n, min(duration_sec) AS min_sec, max(duration_sec) AS max_sec,
    round(avg(duration_sec), 6) AS mean_sec, round(stddev_pop(duration_sec), 6) AS std_sec
FROM comma_runs GROUP BY benchmark, engine, scale"""

ORACLES["stream_percentiles"] = f"""
WITH {COMMA_LINES}
SELECT benchmark, engine, scale, count(*) AS n, round(quantile_cont(duration_sec, 0.5), 6) AS p50_sec,
    round(quantile_cont(duration_sec, 0.9), 6) AS p90_sec, round(quantile_cont(duration_sec, 0.99), 6) AS p99_sec
FROM comma_runs GROUP BY benchmark, engine, scale"""

ORACLES["eventlog_rollup"] = """
WITH t AS (
    SELECT user_id AS app, CAST(user_id % 20 AS INTEGER) AS stage_id, event_id, CAST(round(value * 1000) AS BIGINT) AS ms
    FROM events WHERE event_type IN ('click', 'view'))
SELECT app, stage_id, 0 AS attempt, count(*) AS tasks, max(ms) AS max_task_ms, CAST(sum(event_id * 10) AS BIGINT) AS shuffle_write_bytes,
    CAST(sum(event_id * 4) AS BIGINT) AS shuffle_read_bytes,
    CAST(sum(CASE WHEN event_id % 3 = 0 THEN event_id ELSE 0 END) AS BIGINT) AS spill_bytes, median(ms) AS p50_task_ms
FROM t GROUP BY app, stage_id"""

ORACLES["app_durations"] = """
SELECT user_id AS app,
    CAST(max(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'purchase')
        - min(epoch_us(ts) // 1000) FILTER (WHERE event_type = 'signup') AS DOUBLE) / 1000 AS app_sec
FROM events WHERE event_type IN ('signup', 'purchase') GROUP BY user_id"""
