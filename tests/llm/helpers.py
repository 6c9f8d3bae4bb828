"""Small tables with awkward rows, written as Parquet, and plain Python versions of the operators."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sentence(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rnd.randint(0, 9)) for _ in range(n))


def awkward_rows(seed=0, n=60):
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows and ids."""
    rnd = random.Random(seed)
    rows = [(i, sentence(rnd, rnd.choice([1, 3, 8, 40, 90])), rnd.choice(["en", "de"]), rnd.choice("abc"), 1) for i in range(n)]
    base = sentence(rnd, 200).split()
    for k in range(12):  # a chain of near copies
        base = list(base)
        base[k * 10] = f"changed{k}"
        rows.append((1000 + k, " ".join(base), "en", "a", None))
    rows += [(2000 + k, rows[3][1].upper(), "en", "b", 5) for k in range(5)]
    rows += [rows[4], rows[4], (7, "another text for a repeated id", "en", None, 3)]
    rows += [(3000, None, "en", "a", None), (3001, "", None, "b", 0), (3002, " \t\n", "en", "c", 3)]
    rows += [(None, "a text without an id", "en", "a", 4), (None, "a text without an id", "en", "a", 4), (None, None, None, None, None)]
    rows += [(4000, sentence(rnd, 30_000), "en", "a", 9), (4001, "É" * 5000 + "é", "fr", "d", 9), (4002, "x" * 5001, "fr", "d", 9)]
    return rows


def table_of(spark, folder, rows, schema=SCHEMA, name="documents", parts=3):
    path = f"{folder}/{name}.parquet"
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_clashes(df):
    """Extra columns named like the operators' own."""
    for name in ("_row", "key", "comp", "n", "name", "level", "size", "bucket", "block", "guess", "host", "doc", "group"):
        df = df.withColumn(name, df["doc_id"].cast("string"))
    return df


def plain_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
