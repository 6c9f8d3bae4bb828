import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import near_dedup
from tallyloom.llm.common import stored
from tallyloom.llm.exact_dedup import drop_exact_copies, exact_groups, name_texts
from tallyloom.llm.graph import components
from tallyloom.llm.near_dedup import circulant_minhash, drop_near_copies, near_groups, shingle_set
from tests.llm.helpers import SCHEMA, WORD, awkward_rows, lower, plain_rows, sentence, table_of, with_clashes


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return table_of(spark, tmp_path_factory.mktemp("docs"), awkward_rows())


@pytest.mark.parametrize("block", [4, 1024])
def test_exact_groups_follow_the_texts(docs, block):
    rows = docs.collect()
    texts = defaultdict(list)
    for r in rows:
        texts[lower(r.text)].append(r.doc_id)
    want = []
    for r in rows:
        group = texts[lower(r.text)]
        keep = max((i for i in group if i is not None), default=None)
        want.append((r.doc_id, keep, len(group), hashlib.sha256(lower(r.text).encode()).hexdigest()))
    small = docs.where("length(coalesce(text, '')) < 10000") if block == 4 else docs
    got = exact_groups(small, block)
    short = {r.doc_id for r in rows if len(r.text or "") < 10000}
    want = [w for w in want if block != 4 or w[0] in short]
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size", "text_sha256").collect())) == Counter(want)
    kept = got.where("kept")
    assert kept.count() == len({w[3] for w in want}) == kept.select("text_sha256").distinct().count()
    assert kept.where("NOT doc_id <=> keep_id").count() == 0


def test_names_tell_block_counts_apart(spark, tmp_path):
    texts = ["ab", "abab", "ababab", "abababab", "", "a", "b", "ababab"]
    named = name_texts(table_of(spark, tmp_path, [(i, t, None, None, None) for i, t in enumerate(texts)]), 2)
    ids = {r.doc_id: (r.level, r.name) for r in named.collect()}
    assert len(set(ids.values())) == 7 and ids[2] == ids[7]


def test_drop_exact_copies_keeps_all_columns(docs, spark, tmp_path):
    wide = stored(with_clashes(docs), "clash")
    kept = drop_exact_copies(wide)
    assert kept.columns == wide.columns
    assert kept.count() == len({lower(r.text) for r in docs.collect()})


def brute_components(rows, size, percent):
    sets = []
    for r in rows:
        words = WORD.findall(lower(r.text))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                comp[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i].doc_id)
    least = {k: min((d for d in m if d is not None), default=None) for k, m in members.items()}
    return [(rows[i].doc_id, len(sets[i]), least[root(i)]) for i in range(len(rows))], len(members)


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_match_brute_force(docs, size):
    want, n = brute_components(docs.collect(), size, 80)
    got = near_groups(docs, size)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == Counter(want)
    assert got.where("stays").count() == n
    assert got.where("kept <> (doc_id = component_id)").count() == 0


def test_near_groups_in_large_buckets(spark, tmp_path):
    """Hundreds of copies with different numbers of edits: buckets are large, and some copies only link to one another."""
    import random

    rnd = random.Random(5)
    base = sentence(rnd, 150).split()
    rows = []
    for i in range(330):
        words = list(base)
        for k in rnd.sample(range(150), rnd.choice([0, 1, 2, 3, 5, 8, 12])):
            words[k] = f"e{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(words), "en", "a", 1))
    twin = rows[17][1].split()
    twin[5] = "twin"
    rows += [(900, " ".join(twin), "en", "a", 1), (901, " ".join(base[:140]), "en", "a", 1)]
    docs = table_of(spark, tmp_path, rows)
    want, _ = brute_components(docs.collect(), 4, 80)
    got = near_groups(docs, 4).select("doc_id", "n_shingles", "component_id")
    assert Counter(map(tuple, got.collect())) == Counter(want)


def near_copies(words, copies, edits, seed=5):
    """Copies of one text with a few words replaced: few are similar to any one of them, many to one another."""
    import random

    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        text = list(base)
        for k in rnd.sample(range(words), rnd.randint(*edits)):
            text[k] = f"e{rnd.randrange(40)}"
        rows.append((i, " ".join(text), "en", "a", 1))
    return rows


def test_chunk_pairs_match_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 40)
    docs = table_of(spark, tmp_path, near_copies(60, 420, (1, 3)))
    want, n = brute_components(docs.collect(), 5, 80)
    got = near_groups(docs, 5)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == Counter(want)
    assert 20 < n < 400 and got.where("stays").count() == n


def test_links_stay_in_proportion_to_the_rows(spark, tmp_path, monkeypatch):
    """A group of three times the copies has nine times the similar pairs, but about three times the links."""
    links = {}

    def counted(df, name):
        out = stored(df, name)
        if name in ("star-links", "inner-links", "cross-links"):
            links[copies] = links.get(copies, 0) + out.count()
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    for copies in (300, 900):
        near_groups(table_of(spark, tmp_path, near_copies(60, copies, (1, 2)), name=f"d{copies}"), 5)
    assert links[300] > 100 and links[900] <= 5 * links[300] and links[900] <= 3 * 900


def test_drop_near_copies_and_empty_tables(docs, spark, tmp_path):
    wide = stored(with_clashes(docs), "clash")
    kept = drop_near_copies(wide)
    assert kept.columns == wide.columns and kept.count() == brute_components(docs.collect(), 5, 80)[1]
    empty = table_of(spark, tmp_path, [], parts=1)
    for make in (drop_near_copies, drop_exact_copies, exact_groups, near_groups):
        assert make(empty).count() == 0


def test_minhash_agreement_estimates_similarity():
    hashes = {w.encode(): hash(w) % 2**64 for w in (f"w{i}" for i in range(4000))}
    words = [f"w{i}" for i in range(4000)]
    a = circulant_minhash(shingle_set(" ".join(words[:2400]).encode(), 3, hashes))
    b = circulant_minhash(shingle_set(" ".join(words[800:3200]).encode(), 3, hashes))
    assert abs((a == b).mean() - 0.5) < 0.2


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (200, 201)]
    got = plain_rows(components(spark.createDataFrame(links, "a long, b long")), "_row", "comp")
    want = sorted([(i, 0) for i in range(41)] + [(k, 100) for k in range(100, 160)] + [(200, 200), (201, 200)], key=lambda t: tuple((False, str(x)) for x in t))
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert SCHEMA and F


@pytest.mark.parametrize("seed", range(4))
def test_components_of_random_links(spark, seed):
    import random

    rnd = random.Random(seed)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(rnd.choice([120, 200, 320]))]
    best = {i: i for link in links for i in link if link[0] != link[1]}
    for _ in best:
        for a, b in links:
            if a != b:
                best[a] = best[b] = min(best[a], best[b])
    got = {r._row: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == best
