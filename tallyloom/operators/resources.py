"""Requested executors against what the workers offer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.scalars import memory_gb, overhead_gb, request_gb
from tallyloom.operators.ordered import running_sums


def worker_totals(workers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cores and gigabytes summed over workers, and how many workers state an unreadable memory size."""
    gb = memory_gb(F.col("memory"))
    return workers.groupBy(*by).agg(
        F.count("*").alias("workers"),
        F.sum("cores").alias("sum_cores"),
        F.sum(gb).alias("sum_mem_gb"),
        F.count_if(gb.isNull()).alias("unknown_workers"),
    )


def executors_that_fit(requests: DataFrame, workers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``requests`` with ``fitting``: how many of their executors the workers can run, each on one worker.

    A worker runs as many as its cores and its memory allow. Workers of the same size are counted first, so the join
    has one row per request and worker size.
    """
    need = F.col("executor_memory_gb") + overhead_gb(F.col("executor_memory_gb"))
    sizes = workers.select(*by, "cores", memory_gb(F.col("memory")).alias("gb")).groupBy(*by, "cores", "gb").agg(
        F.count("*").alias("like")
    )
    packed = sizes.groupBy(*by).agg(F.collect_list(F.struct("cores", "gb", "like")).alias("_sizes"))
    if by:
        joined = requests.join(packed, list(by), "left")
    else:
        joined = requests.withColumn("_sizes", packed.select("_sizes").scalar())
    per_worker = lambda w: F.least(
        F.floor(w["cores"] / F.col("executor_cores")), F.floor(w["gb"] / need)
    ) * w["like"]
    total = F.aggregate("_sizes", F.lit(0).cast("bigint"), lambda n, w: n + F.coalesce(per_worker(w), F.lit(0)).cast("bigint"))
    return joined.withColumn("fitting", F.coalesce(total, F.lit(0))).drop("_sizes")


def preflight(requests: DataFrame, workers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Verdict per request: ``ok``, ``reject``, ``skipped`` without workers, ``unknown`` if a memory size is unreadable.

    The memory request is compared in whole gigabytes; ``exact_fit`` tells if it also holds without
    that truncation, and ``worker_fit`` if every executor finds a worker that can hold it. With ``by`` each request is compared to the workers that share its key (one total row
    per key), else to all workers (a one-row subquery).
    """
    requests = executors_that_fit(requests, workers, by)
    totals = worker_totals(workers, by)
    if by:
        joined = requests.join(totals, list(by), "left")
    else:
        row = totals.select(F.struct("*").alias("t")).scalar()
        joined = requests.withColumn("_t", row).select(*requests.columns, "_t.*")
    wanted = joined.withColumn("req_cores", (F.col("executors") * F.col("executor_cores")).cast("bigint")).withColumn(
        "overhead_gb", overhead_gb(F.col("executor_memory_gb"))
    ).withColumn("req_mem_gb", request_gb(F.col("executors"), F.col("executor_memory_gb")))
    whole = F.col("req_mem_gb").cast("bigint")
    too_many_cores = F.col("req_cores") > F.col("sum_cores")
    verdict = (
        F.when(F.coalesce("workers", F.lit(0)) == 0, "skipped")
        .when(F.col("unknown_workers") > 0, "unknown")
        .when(too_many_cores | (whole > F.col("sum_mem_gb")), "reject")
        .otherwise("ok")
    )
    exact = ~too_many_cores & (F.col("req_mem_gb") <= F.col("sum_mem_gb"))
    return wanted.withColumn("verdict", verdict).withColumn(
        "exact_fit", F.when(F.col("verdict").isin("ok", "reject"), exact)
    ).withColumn(
        "worker_fit", F.when(F.col("verdict").isin("ok", "reject"), F.col("fitting") >= F.col("executors"))
    )


def competing_requests(verdicts: DataFrame, key: str, by: Sequence[str] = (), one_task: bool | None = None) -> DataFrame:
    """Which requests of a preflight the workers can serve together: ``share, used_cores, used_gb, granted``.

    Requests are served in the order of their dominant share, the larger of their shares of all cores and of all memory, then
    of ``key``; so most requests are served. ``used_*`` is what a request and those before it take, and a request is granted
    if that is within the totals; later ones are larger and do not overtake. Requests whose own verdict is not ``ok`` or
    that do not fit exactly take nothing. Memory is added in thousandths of a gigabyte, so sums are exact.
    """
    alone = (F.col("verdict") == "ok") & F.col("exact_fit")
    share = F.greatest(F.col("req_cores") / F.nullif("sum_cores", F.lit(0)), F.col("req_mem_gb") / F.nullif("sum_mem_gb", F.lit(0)))
    rows = verdicts.select(
        "*", F.round(share, 9).alias("share"), F.when(alone, F.col("req_cores")).otherwise(0).alias("_cores"),
        F.when(alone, F.ceil(F.round(F.col("req_mem_gb") * 1000, 3)).cast("bigint")).otherwise(0).alias("_gb"),
    )
    used = running_sums(rows, {"used_cores": "_cores", "_used_gb": "_gb"}, ["share", key], by, one_task=one_task)
    within = (F.col("used_cores") <= F.col("sum_cores")) & (F.col("_used_gb") <= F.col("sum_mem_gb") * 1000)
    return used.select(
        *verdicts.columns, "share", "used_cores", (F.col("_used_gb") / 1000).alias("used_gb"),
        F.coalesce(alone & within, F.lit(False)).alias("granted"),
    )
