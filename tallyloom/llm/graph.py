"""Connected components over links, by smallest label with contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``a, b`` links to ``_row, comp``: for each row that has a link the smallest row it can reach.

    Each round every row takes the smallest of itself and its neighbours, then what that one took, and the links are
    renamed to what their ends took. A link that a row took its label over becomes one between that label and the label's
    own, so nothing comes apart; links within a label and repeated ones go. So links shrink from round to round and the rounds
    grow with the logarithm of the longest chain. Tables are stored; nothing of the graph reaches the driver but a count.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    edges, taken = stored(ordered.distinct(), "links"), []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), "nearest")
        then = first.select(F.col("a").alias("to"), F.col("to").alias("comp"))
        labels = stored(first.join(then, "to").select(F.col("a").alias("_row"), "comp"), "labels")
        taken.append(labels)
        ends = lambda k: labels.select(F.col("_row").alias(k), F.col("comp").alias(f"{k}_comp"))
        renamed = edges.join(ends("a"), "a").join(ends("b"), "b").where("a_comp <> b_comp")
        ordered = renamed.select(F.least("a_comp", "b_comp").alias("a"), F.greatest("a_comp", "b_comp").alias("b"))
        edges = stored(ordered.distinct(), "links")
        if edges.isEmpty():
            break
    labels = taken.pop()
    while taken:
        later = labels.select(F.col("_row").alias("comp"), F.col("comp").alias("last"))
        labels = stored(taken.pop().join(later, "comp", "left").select("_row", F.coalesce("last", "comp").alias("comp")), "labels")
    return labels
