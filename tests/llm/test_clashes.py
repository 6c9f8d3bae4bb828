"""Further columns with names that operators use inside change nothing; ties of rules; long urls."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ctw, html_text, sharding, topk, url_rules
from tests.llm.helpers import awkward_rows, plain_rows, table_of

NAMES = [
    "_row", "key", "comp", "n", "name", "level", "size", "bucket", "block", "guess", "host", "path", "doc", "group", "word", "cell", "c",
    "log", "tokens", "token", "rarest", "needed", "fired", "confidence", "id", "v", "query_block", "rank", "score", "parcel", "sha", "items",
]


def wide(df, own):
    for name in NAMES:
        if name not in df.columns:
            df = df.withColumn(name, F.col(own).cast("string"))
    return df


def same(make, df, own, tmp_path):
    wide(df, own).write.parquet(f"{tmp_path}/wide")
    plain, other = make(df), make(df.sparkSession.read.parquet(f"{tmp_path}/wide"))
    assert plain.columns == other.columns
    shown = [c for c in plain.columns if c != "_row"]
    rounded = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in plain.select(shown).dtypes]
    assert plain_rows(plain.select(rounded), *shown) == plain_rows(other.select(rounded), *shown)
    assert plain.count() > 0


@pytest.mark.parametrize("make", [sharding.shard_documents, ctw.score_documents])
def test_documents(spark, tmp_path, make):
    rows = [r for r in awkward_rows(n=20) if len(r[1] or "") < 3000]
    same(make, table_of(spark, tmp_path, rows, parts=1).select("doc_id", "text", "lang", "source"), "doc_id", tmp_path)


def test_pages_and_labels(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    labels = wide(spark.read.parquet(f"{data}/labels.parquet"), "doc_id")
    same(lambda p: url_rules.judge_urls(p, labels), pages, "page_id", tmp_path)
    same(html_text.extract_text, pages, "page_id", tmp_path / "text")


def test_vectors(spark, tmp_path):
    rnd = np.random.default_rng(2)
    rows = [(i, rnd.normal(size=4).astype(np.float32).tolist(), 1) for i in range(120)]
    same(topk.top_inner_products, table_of(spark, tmp_path, rows, "vec_id long, embedding array<float>, label int", "e", 1), "vec_id", tmp_path)


def test_rules_of_equal_confidence_and_long_urls(spark, tmp_path):
    """Two tokens that always come together give rules of equal confidence; a url of 200,000 characters is read to its end."""
    tail = "/".join(f"p{i}" for i in range(30_000))
    rows = [(i, f"http://h{i % 7}.net/spam/junk/{i}.html", None) for i in range(60)] + [(i, f"http://h{i % 7}.net/good/{i}.html", None) for i in range(60, 120)]
    rows += [(1000, f"http://far.net/{tail}/junk/spam/x", None), (1001, f"http://far.net/{tail}/x", None)]
    pages = table_of(spark, tmp_path, rows, "page_id long, url string, html string", "pages")
    labels = spark.createDataFrame([(i, 1, int(i < 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.verdict, r.fired) for r in url_rules.judge_urls(pages, labels).collect()}
    assert {got[i] for i in range(60)} == {("block", 1.0)} and {got[i] for i in range(60, 120)} == {("allow", None)}
    assert got[1000] == ("block", 1.0) and got[1001] == ("allow", None)


def test_mined_rules_are_all_rules_that_pass(spark):
    """Against an enumeration of all token sets: support and confidence of each, and the rarest token as the key."""
    import itertools
    import random
    from collections import Counter

    rnd = random.Random(11)
    rows = []
    for i in range(300):
        bad = rnd.random() < 0.3
        tokens = {t for t in "abcdef" if rnd.random() < (0.6 if bad and t in "ab" else 0.25)} | ({"always"} if i % 50 else set())
        rows.append((i, sorted(tokens), bad))
    labelled = spark.createDataFrame(rows, "_row long, tokens array<string>, bad boolean")
    got = {tuple(sorted(r.tokens)): r for r in url_rules.mine_rules(labelled, 0.03, 0.4).collect()}
    n = sum(bool(t or bad) for _, t, bad in rows)
    single = Counter(t for _, tokens, _ in rows for t in tokens)
    want = {}
    for k in range(1, 8):
        for chosen in itertools.combinations(["a", "always", "b", "c", "d", "e", "f"], k):
            met = [bad for _, tokens, bad in rows if set(chosen) <= set(tokens)]
            if sum(met) >= 0.03 * n and sum(met) >= 0.4 * len(met):
                want[chosen] = sum(met) / n, sum(met) / len(met)
    assert len(want) > 5 and set(got) == set(want)
    for chosen, (support, confidence) in want.items():
        r = got[chosen]
        assert (r.support, r.confidence) == (pytest.approx(support), pytest.approx(confidence))
        assert r.rarest == min(chosen, key=lambda t: (single[t], t))
