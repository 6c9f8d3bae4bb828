"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import ROW, ascii_lower, packed, stored, with_rows

BLOCK_BYTES = 1024

NONE = -1


def name_texts(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One collision-free identity per row: ``_row, doc_id, text_sha256, level, name``; equal texts share level and name.

    A text, A-Z in lower case, null as empty, is cut into blocks of ``block_bytes`` bytes. Equal blocks get one integer
    name: the number of their first occurrence. Adjacent names are then paired, and pairs are named in the same way,
    until a text has one name left. Names stand for contents, not hashes, so different texts never meet; a last name
    without a partner is paired with -1, so the number of blocks is part of the identity.

    ``docs`` is a stored table (a scan of files gives the same occurrence numbers in every attempt); from level 1 on
    the numbers are read from a stored table. An empty table gives no rows. Other columns are ignored.
    A block that fills a third of the table is combined before the shuffle, and AQE splits it in the join.
    """
    text = ascii_lower(F.coalesce("text", F.lit("")))
    rows = with_rows(docs.select("doc_id", text.alias("_text")))
    rows = rows.select(
        ROW, "doc_id", F.sha2(F.col("_text").cast("binary"), 256).alias("sha"), F.col("_text").cast("binary").alias("bin")
    )
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("bin") / block_bytes).cast("int"))
    blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("bin"), i * block_bytes + 1, F.lit(block_bytes)))
    occurrences = rows.select(ROW, "doc_id", "sha", n.alias("n"), F.posexplode(blocks).alias("idx", "block")).withColumn(
        "occ", F.monotonically_increasing_id()
    )
    names = occurrences.groupBy("block").agg(F.min("occ").alias("name"))
    first = F.col("idx") == 0
    level = stored(
        occurrences.join(names, "block").select(
            ROW, F.when(first, F.col("doc_id")).alias("doc_id"), F.when(first, F.col("sha")).alias("text_sha256"),
            "n", "idx", "occ", "name",
        ),
        "block-names",
    )
    heads = level.where(first).select(ROW, "doc_id", "text_sha256")
    most = level.agg(F.max("n")).first()[0] or 1
    done, depth = [level.where("n = 1").select(ROW, F.lit(0).alias("level"), "name")], 0
    while most > 1:
        depth, most = depth + 1, (most + 1) // 2
        even = F.col("idx") % 2 == 0
        pairs = (
            level.where("n > 1").groupBy(ROW, F.floor(F.col("idx") / 2).cast("int").alias("at"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NONE)).alias("b"),
                F.min("occ").alias("occ"), F.ceil(F.max("n") / 2).cast("int").alias("n"),
            )
            .withColumnRenamed("at", "idx")
        )
        pairs = stored(pairs, "block-pairs")
        # Stored, so that the join deals both sides anew and a pair that very many texts share can be split.
        names = stored(pairs.groupBy("a", "b").agg(F.min("occ").alias("name")), "pair-firsts")
        level = stored(pairs.join(names, ["a", "b"]).select(ROW, "n", "idx", "occ", "name"), "pair-names")
        done.append(level.where("n = 1").select(ROW, F.lit(depth).alias("level"), "name"))
    return reduce(DataFrame.unionByName, done).join(heads, ROW)


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row ``_row, doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest doc_id stays; null ids are the smallest. Of repeated rows with that same
    id exactly one is kept.
    """
    named = name_texts(docs, block_bytes)
    groups = named.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", ROW)).alias("keep"), F.count("*").alias("group_size")
    )
    # Stored, so that the join deals both sides anew and a group with very many rows can be split.
    return named.join(stored(groups, "groups"), ["level", "name"]).select(
        ROW, "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col(f"keep.{ROW}") == F.col(ROW)).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, one of each group of equal texts, with all their columns."""
    kept = exact_groups(docs, block_bytes).where("kept").select(ROW)
    return packed(docs).join(kept, ROW, "left_semi").select("doc.*")
