"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tallyloom.llm.common import ROW, with_rows

K = 5
QUERY_EVERY = 50
SCALE = 256

# Rows whose lists one task holds, and queries it runs over them.
BLOCK_ROWS = 1024
QUERY_ROWS = 8192

# Each round reads this part of the lists.
ROUNDS = 16

NO_ID = (1 << 63) - 1


def _matrix(vectors, width: int) -> np.ndarray:
    """Integer components as doubles; shorter vectors are filled with zeros, which add nothing to a product."""
    m = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        m[i, : len(v)] = np.floor(SCALE * np.asarray(v, np.float64))
    return m


def threshold_top(lists: np.ndarray, rows: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int):
    """Positions of the k best rows by (score, smaller id), and how many rows were scored.

    ``lists[:, d]`` holds the rows in ascending order of component d. A round reads the next entries of every list, from
    its best end for the query's sign, and scores the rows not seen before. No row unseen can score above the sum of the
    last entries read, so the search ends once the kth score is above that bound; on a tie it goes on.
    ``own`` is the query's own position, or -1.
    """
    n = len(rows)
    dims = np.flatnonzero(query != 0)
    ends, weights = query[dims] > 0, query[dims]
    seen = np.zeros(n, bool)
    scores = np.zeros(n, rows.dtype)
    if own >= 0:
        seen[own] = True
    found = np.empty(0, np.int64)
    step = max(1, -(-n // ROUNDS))
    for start in range(0, n, step):
        stop = min(n, start + step)
        if len(dims):
            read = lists[np.where(ends, n - 1 - np.arange(start, stop)[:, None], np.arange(start, stop)[:, None]), dims]
            mark = np.zeros(n, bool)
            mark[read.ravel()] = True
            new = np.flatnonzero(mark & ~seen)
        else:
            new = np.flatnonzero(~seen)
        if len(new):
            seen[new] = True
            scores[new] = rows[new] @ query
            found = np.concatenate([found, new])
            if len(found) > k:
                kth = np.partition(scores[found], len(found) - k)[len(found) - k]
                found = found[scores[found] >= kth]  # rows tied with the kth stay
        if len(found) >= k:
            bound = (rows[read[-1], dims] * weights).sum() if len(dims) else 0
            if min(scores[found]) > bound:
                break
        if seen.all():
            break
    best = sorted(found.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]
    return best, scores, int(seen.sum())


def _search(k: int):
    def search(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(candidates) and len(queries):
            width = max(map(len, [*candidates["v"], *queries["v"]]))
            rows, asked = _matrix(candidates["v"], width), _matrix(queries["v"], width)
            if np.abs(rows).max(initial=0) * np.abs(asked).max(initial=0) * width >= 2.0**53:
                whole = np.frompyfunc(int, 1, 1)  # beyond exact doubles: Python integers
                rows, asked = whole(rows), whole(asked)
            lists = np.argsort(rows, axis=0, kind="stable")
            ids, places = candidates["id"].to_numpy(), candidates[ROW].to_numpy()
            where = {r: i for i, r in enumerate(places.tolist())}
            for row, query_id, q in zip(queries[ROW].tolist(), queries["id"].tolist(), asked):
                best, scores, _ = threshold_top(lists, rows, ids, q, where.get(row, -1), k)
                found += [(row, query_id, int(ids[i]), int(places[i]), max(-NO_ID, min(NO_ID, int(scores[i])))) for i in best]
        return pd.DataFrame(found, columns=["query_row", "query_id", "id", ROW, "score"]).astype("int64")

    return search


def top_inner_products(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose vec_id is divisible by ``every`` its ``k`` best other rows.

    Components become floor(256 * x); scores are exact integers (kept within the range of a long). Ties go to the
    smaller vec_id, null ids last. Only vec_id and embedding are read, so no other column can clash. Vectors that are null or hold null, NaN or infinite components take no part; shorter
    vectors count as filled up with zeros. Repeated ids are rows of their own. An empty table gives no rows.

    Rows are dealt into blocks by hash, queries into blocks as well, and each pair of blocks is searched by itself with
    its own lists; k rows per query and block go on to the last ranking, most of them dropped before the shuffle.
    """
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = with_rows(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v")))
    whole = whole.where(F.col("v").isNotNull() & ~F.exists("v", odd)).withColumn("id", F.coalesce("vec_id", F.lit(NO_ID)))
    asked = whole.where(F.col("vec_id") % every == 0)
    n, n_asked = whole.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    blocks, query_blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_asked // QUERY_ROWS))

    def dealt(rows, own, count, other, others):
        block = F.pmod(F.xxhash64(ROW), F.lit(count)).cast("int").alias(own)
        each = rows.select(block, F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other), ROW, "id", "v")
        return each.toDF(*each.columns)  # columns of its own, since both sides come from one table

    found = (
        dealt(whole, "block", blocks, "query_block", query_blocks).groupBy("block", "query_block")
        .cogroup(dealt(asked, "query_block", query_blocks, "block", blocks).groupBy("block", "query_block"))
        .applyInPandas(_search(k), f"query_row long, query_id long, id long, {ROW} long, score long")
    )
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "id", ROW))
    vec_id = F.when(F.col("id") < NO_ID, F.col("id")).alias("vec_id")
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", vec_id, "score")
