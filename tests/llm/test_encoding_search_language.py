import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tallyloom.llm import language, topk
from tallyloom.llm.bpe import TreeCodec, decode_documents, encode_documents, read_ranks
from tallyloom.llm.catalog import op5_language, op7_threshold_top, rank_file
from tallyloom.llm.common import stored
from tallyloom.llm.oracles import LLM_ORACLES
from tests.llm.helpers import awkward_rows, plain_rows, table_of, with_clashes
from tests.oracle_check import compare, connect

ALPHABET = ["a", "the", "ion", " ", "  ", "\n", "\t", "'s", "'re", "é", "ß", "1", "23", "!", "...", "中", "文", " ", "\x1c", "😀", "A", "'"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(rank_file()), special_tokens={})


def test_tree_codec_equals_the_library_on_random_texts(library):
    rnd = random.Random(1)
    codec = TreeCodec(read_ranks(rank_file()), public_tokenizers.PATTERN, leaf_chars=16, leaf_bytes=8)
    for i in range(6000):
        text = "".join(rnd.choice(ALPHABET if i % 3 else ALPHABET[:5]) for _ in range(rnd.randint(0, 80)))
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert codec.decode(ids, 8) == text.encode()


@pytest.mark.parametrize("text", [" " * 50_000 + "a", "a" * 20_000, "th ion" * 20_000, "\n" * 30_000, "中文" * 20_000, "<|endoftext|>" * 1000])
def test_tree_codec_on_long_runs(library, text):
    codec = TreeCodec(read_ranks(rank_file()), public_tokenizers.PATTERN)
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text) and codec.decode(ids) == text.encode()


def test_encoded_documents_decode_to_their_texts(spark, tmp_path, library):
    rows = awkward_rows()
    docs = with_clashes(table_of(spark, tmp_path, rows))
    got = encode_documents(docs, rank_file(), public_tokenizers.PATTERN, with_ids=True)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    got = stored(got, "encoded")
    assert Counter(map(tuple, got.drop("ids").collect())) == want
    texts = decode_documents(got, rank_file(), public_tokenizers.PATTERN)
    assert Counter(map(tuple, texts.collect())) == Counter((r[0], r[1] or "") for r in rows)
    assert encode_documents(docs.where("false"), rank_file(), public_tokenizers.PATTERN).count() == 0


# Top-k


def test_threshold_search_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    for n, width, k in ((300, 4, 5), (300, 1, 3), (3, 6, 5), (1, 2, 5), (500, 3, 5)):
        rows = rng.integers(-20, 20, (n, width)).astype(float)
        rows[n // 2 :] = rows[: n - n // 2]  # ties
        lists, ids = np.argsort(rows, axis=0, kind="stable"), rng.permutation(n)
        scored = []
        for own in (-1, 0):
            for query in (*rng.integers(-20, 20, (20, width)).astype(float), np.zeros(width)):
                best, _, seen = topk.threshold_top(lists, rows, ids, query, own, k)
                order = sorted((i for i in range(n) if i != own), key=lambda i: (-(rows[i] @ query), ids[i]))[:k]
                assert best == order
                scored.append(seen)
        if n == 300 and width == 1:
            assert min(scored) < n / 2


def test_top_inner_products_match_brute_force(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(5)]) for i in range(260)]
    rows += [(50, rows[3][1]), (50, rows[3][1]), (7, None), (100, [0.5, None, 1.0]), (101, [float("nan")] * 5), (102, [float("inf")] * 5)]
    rows += [(None, rows[9][1]), (200, []), (201, [1.0]), (250, [3.0e30] * 5), (251, [-2.0e30] * 5)]
    vectors = table_of(spark, tmp_path, rows, "vec_id long, embedding array<double>", "embeddings")
    for blocks in (1024, 40):
        topk.BLOCK_ROWS, topk.QUERY_ROWS = blocks, blocks // 10
        got = topk.top_inner_products(vectors).collect()
        topk.BLOCK_ROWS, topk.QUERY_ROWS = 1024, 1024
        whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
        want = Counter()
        for at, (query_id, q) in enumerate(whole):
            if query_id is not None and query_id % 50 == 0:
                scores = [
                    (max(-topk.NO_ID, min(topk.NO_ID, sum(a * b for a, b in zip(q, v)))), i)
                    for other, (i, v) in enumerate(whole) if other != at
                ]
                if any(abs(s) == topk.NO_ID for s, _ in scores):
                    continue  # beyond a long: kept within its range, order by the exact product
                ranked = sorted(scores, key=lambda t: (-t[0], t[1] is None, t[1] or 0))[:5]
                want.update((query_id, k + 1, i, s) for k, (s, i) in enumerate(ranked))
        large = {r.query_id for r in got if abs(r.score) == topk.NO_ID}
        assert Counter(tuple(r) for r in got if r.query_id not in large) == Counter({k: n for k, n in want.items() if k[0] not in large})
    assert topk.top_inner_products(vectors.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(LLM_ORACLES))
def test_queries_equal_their_sql(spark, data, name):
    from tallyloom.llm.catalog import LLM_REGISTRY

    assert compare(LLM_REGISTRY[name](spark, data), connect(data), LLM_ORACLES[name]) == []


def test_top_query_covers_the_table(spark, data):
    n = spark.read.parquet(f"{data}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert op7_threshold_top(spark, data).count() == 5 * n


# Language

SYLLABLES = {"aa": "ka ro mi tu".split(), "bb": "sch eu lich ung".split(), "cc": "é ñ ção lh".split()}


def made_up(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(2, 4))) for _ in range(n))


def test_language_follows_text_then_declarations_and_hosts(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, made_up(rnd, lang, 30), lang, f"site-{lang}", 1) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, made_up(rnd, "aa", 40), "bb", "site-bb", 1), (1001, made_up(rnd, "bb", 40), None, None, None)]
    rows += [(1002, "x", "cc", "site-cc", 1), (1003, "x", None, "site-aa", 1)]  # hardly any text: the rest decides
    rows += [(2000, None, "aa", "site-aa", 1), (2001, "", "aa", "site-aa", 1), (2002, "12345 --- !!! 67 %%", "aa", "site-aa", 1), (None, None, None, None, None)]
    rows += [rows[0], rows[0]]
    docs = table_of(spark, tmp_path, rows)
    got = language.identify(docs).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r for r in got}
    assert all(found[i].language == rows[i][2] and found[i].accepted for i in range(180))
    assert (found[1000].language, found[1001].language, found[1002].language, found[1003].language) == ("aa", "bb", "cc", "aa")
    assert not any(found[i].accepted for i in (2000, 2001, 2002, None))
    assert found[2000].language is None
    wide = stored(with_clashes(docs), "clash")
    kept = language.keep_identified(wide)
    assert kept.columns == wide.columns and kept.count() == len(rows) - 4
    evidence = spark.createDataFrame([(1003, "bb", "x.example.bb"), (1003, "bb", "x.example.bb"), (None, "aa", "a.aa")], "doc_id long, markup string, host string")
    again = language.identify(docs, evidence).collect()
    assert len(again) == len(rows)
    assert language.identify(docs.where("false")).count() == 0
    assert language.identify(docs.withColumn("lang", docs["lang"].substr(9, 1).cast("string")).where("doc_id = 2001")).count() == 1


def test_rare_and_many_languages_are_fitted_on_their_own_rows(spark):
    rows = [(i, "the common text of many rows", "aa") for i in range(3000)] + [(5000 + i, "zyxw wvut zyxw", "zz") for i in range(3)]
    rows += [(6000 + i, f"rarest {chr(0x4E00 + i)} text", f"l{i:03}") for i in range(250)] + [(7000, "123", "no")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, logs = language.fit_text_model(docs, 20)
    assert languages == sorted({r[2] for r in rows} - {"no"}) and logs.shape == (252, language.SLOTS)
    assert (logs.max(axis=1) - logs.min(axis=1) > 0.5).all()  # none is flat
    slots = np.bincount(language.trigram_slots(b"zyxw wvut zyxw") , minlength=language.SLOTS)
    want = np.log((0.5 + 3 * slots) / (0.5 + 3 * slots).sum())
    assert np.allclose(logs[languages.index("zz")], want, atol=1e-4)


def test_page_evidence_reads_number_markup_and_host(spark):
    pages = spark.createDataFrame(
        [(1, "https://A.example.org/en/17.html?x=1", "<!DOCTYPE html><html lang=\"EN\">"), (2, "http://b.de/de/18/", None), (3, None, "<html>"), (4, "http://b.de/x", "")],
        "page_id long, url string, html string",
    )
    assert plain_rows(language.page_evidence(pages), "doc_id", "markup", "host") == sorted(
        [(17, "en", "a.example.org"), (18, None, "b.de"), (None, None, None), (None, None, "b.de")], key=lambda t: tuple((x is None, str(x)) for x in t)
    )


def test_page_evidence_reads_the_html_tag_wherever_it_is(spark):
    long, many = "x" * 50_000, " ".join(f'data-a{i}="{i} > 0"' for i in range(20_000))
    htmls = {
        1: f"<!-- {long} <html lang='fr'> -->\n<html lang='de'>", 2: "\n" * 5_000 + "<html lang=es>", 3: f'<html {many} LANG = "it">',
        4: "<html class='a'><body><p>&lt;</p><html lang=fr>", 5: '<html title="x lang=fr" lang="nl">', 6: f"<html><!-- {long}", 7: "<html lang='pt-BR'>",
    }
    pages = spark.createDataFrame([(i, f"http://a.de/{i}", h) for i, h in htmls.items()], "page_id long, url string, html string")
    got = {r.doc_id: r.markup for r in language.page_evidence(pages).collect()}
    assert got == {1: "de", 2: "es", 3: "it", 4: None, 5: "nl", 6: None, 7: "pt"}


def test_language_query_agrees_with_held_out_labels(spark, data):
    rows = op5_language(spark, data).collect()
    clear = [r for r in rows if r.accepted]
    assert len(clear) > 0.95 * len(rows)
    assert sum(r.language == r.declared for r in clear) > 0.95 * len(clear)


def plain_posteriors(rows, evidence):
    """The fusion in plain Python, over rows (doc_id, text, lang, source) and doc_id -> (markup, host)."""
    slots = [language.trigram_slots((r[1] or "").encode()) for r in rows]
    counts = {}
    for (_, text, lang, _), s in zip(rows, slots):
        if lang is not None and text is not None and len(s):
            counts[lang] = counts.get(lang, 0.5) + np.bincount(s, minlength=language.SLOTS)
    names = sorted(counts)
    table = [np.log(counts[k] / counts[k].sum()).astype(np.float32).astype(float) for k in names]
    places = range(len(names) + 1)
    logs = [
        [language.TEMPER * (t[s].sum() if len(s) else 0.0) for t in table] + [-language.TEMPER * len(s) * math.log(language.SLOTS)] for s in slots
    ]
    guess = [x.index(max(x)) for x in logs]
    clear = [i for i, s in enumerate(slots) if len(s)]
    markup = [evidence.get(r[0], (None, None))[0] for r in rows]
    address = [evidence.get(r[0], (None, None))[1] for r in rows]
    host = [a if a is not None else r[3] for a, r in zip(address, rows)]
    suffix = [a.rsplit(".", 1)[-1].lower() or None if a is not None else None for a in address]

    def given(values, i):
        if values[i] is None or not any(values[j] == values[i] for j in clear):
            return [0.0 for _ in places]
        of = Counter(guess[j] for j in clear if values[j] is not None)
        n = Counter(guess[j] for j in clear if values[j] == values[i])
        return [math.log((n[k] + 0.5) / (of[k] + language.SMOOTHING)) for k in places]

    def shares(keys, key, wider):
        n = Counter(guess[j] for j in clear if keys is None or keys[j] == key)
        of = sum(n.values())
        return [(n[k] + language.SMOOTHING * wider[k]) / (of + language.SMOOTHING) for k in places]

    flat = [(1 - language.NONE_PRIOR) / len(names)] * len(names) + [language.NONE_PRIOR]
    every = shares(None, None, flat)
    pairs, declared, out = list(zip(host, suffix)), [r[2] for r in rows], []
    for i in range(len(rows)):
        total = [a + b + c for a, b, c in zip(logs[i], given(declared, i), given(markup, i))]
        if any(pairs[j] == pairs[i] for j in clear):
            total = [t + math.log(p) for t, p in zip(total, shares(pairs, pairs[i], shares(suffix, suffix[i], every)))]
        best = total.index(max(total))
        posterior = 1 / sum(math.exp(t - max(total)) for t in total)
        name = ([*names, "none"][best] if len(slots[i]) else None)
        out.append((rows[i][0], name, round(posterior, 6), bool(len(slots[i]) and best < len(names) and posterior >= language.LEAST_POSTERIOR)))
    return Counter(out)


def test_posteriors_equal_plain_python(spark, tmp_path):
    import random

    rnd = random.Random(8)
    rows = []
    for i in range(90):
        lang = rnd.choice(["aa", "bb", "cc"])
        text = rnd.choice([made_up(rnd, lang, rnd.choice([1, 2, 40])), made_up(rnd, rnd.choice(["aa", "bb"]), 3), "", "12 34", "x", None])
        rows.append((i, text, rnd.choice([lang, lang, None, "bb"]), rnd.choice(["site-a", "site-b", None]), None))
    rows += [(200, "é" * 40_000 + " long words " * 9000, "cc", "site-a", None), (None, "no id at all", None, None, None), rows[5], rows[5]]
    pages = [(i, rnd.choice(["aa", "bb", "zz", None]), rnd.choice(["h.aa", "x.h.bb", "h", None])) for i in range(0, 90, 3)]
    docs = table_of(spark, tmp_path, rows)
    evidence = spark.createDataFrame(pages, "doc_id long, markup string, host string")
    got = language.identify(docs, evidence).collect()
    want = plain_posteriors([r[:4] for r in rows], {i: (m, h) for i, m, h in pages})
    assert Counter((r.doc_id, r.language, round(r.posterior, 6), r.accepted) for r in got) == want
    assert {r.accepted for r in got} == {True, False}
