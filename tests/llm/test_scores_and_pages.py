import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import ctw, html_text, url_rules
from tallyloom.llm.catalog import op3_url_rules
from tests.llm.helpers import awkward_rows, lower, plain_rows, sentence, table_of
from zlib import crc32


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return table_of(spark, tmp_path_factory.mktemp("docs"), awkward_rows())


def is_held_out(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def test_rules_are_mined_from_all_labelled_rows(spark):
    from pyspark.sql import functions as F

    host = F.when(F.col("id") % 100 == 0, "host:bad").otherwise(F.concat(F.lit("host:"), F.col("id") % 10))
    labelled = spark.range(1_200_000).select(F.col("id").alias("_row"), F.array(host).alias("tokens"), (F.col("id") % 100 == 0).alias("bad"))
    rules = url_rules.mine_rules(labelled).collect()
    assert [(r.tokens, r.rarest, r.confidence, r.support) for r in rules] == [(["host:bad"], "host:bad", 1.0, 0.01)]


class PlainTree:
    """Context-tree weighting with dictionaries, straight from the definition."""

    def __init__(self, texts):
        self.counts = {}
        for text in texts:
            for path, symbol in self.steps(text):
                for d in range(6):
                    for node, bit in self.bits(symbol):
                        self.counts.setdefault((path[:d], node), [0, 0])[bit] += 1
        self.children = {}
        for path, node in self.counts:
            if path:
                self.children.setdefault((path[:-1], node), []).append((path, node))
        self.weighted = {}

    @staticmethod
    def steps(text):
        data = [255] * 5 + list(text) + [255]
        for i in range(5, len(data)):
            yield tuple(data[i - k] for k in (1, 2, 3, 4, 5)), data[i]

    @staticmethod
    def bits(symbol):
        node = 1
        for k in range(7, -1, -1):
            bit = symbol >> k & 1
            yield node, bit
            node = node * 2 + bit

    def log_kt(self, key):
        a, b = self.counts[key]
        g = math.lgamma
        return g(a + 0.5) + g(b + 0.5) - g(a + b + 1) - 2 * g(0.5)

    def log_weighted(self, key):
        if key not in self.weighted:
            own = self.log_kt(key)
            if len(key[0]) < 5:
                below = sum(self.log_weighted(c) for c in self.children[key])
                own = np.logaddexp(own, below) - math.log(2)
            self.weighted[key] = own
        return self.weighted[key]

    def one(self, path, node, d=0):
        key = (path[:d], node)
        if key not in self.counts:
            return 0.5
        a, b = self.counts[key]
        kt = (b + 0.5) / (a + b + 1)
        if d == 5 or (path[: d + 1], node) not in self.counts:
            return kt
        share = math.exp(self.log_kt(key) - math.log(2) - self.log_weighted(key))
        return share * kt + (1 - share) * self.one(path, node, d + 1)

    def score(self, text):
        return sum(
            math.log10(self.one(path, node) if bit else 1 - self.one(path, node))
            for path, symbol in self.steps(text) for node, bit in self.bits(symbol)
        )


def test_scores_match_plain_models(spark, tmp_path):
    rows = [r for r in awkward_rows(n=25) if len(r[1] or "") < 3000]
    docs = table_of(spark, tmp_path, rows)
    got = ctw.score_documents(docs).collect()
    training = [lower(r[1]) for r in rows if not is_held_out(r[0])]
    counts = Counter(w for t in training for w in [*t.split(), None])
    total, kinds = sum(counts.values()), len(counts)
    tree = PlainTree([t.encode() for t in training])
    want = Counter()
    for doc_id, text, *_ in rows:
        words = [*lower(text).split(), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words)
        want[doc_id, is_held_out(doc_id), len(words), sum(counts[w] > 0 for w in words), round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    scores = {(r[0], r[1] or ""): tree.score(lower(r[1]).encode()) for r in rows}
    assert sorted(r.score for r in got) == pytest.approx(sorted(scores[r[0], r[1] or ""] for r in rows), rel=2e-3, abs=0.01)
    assert {r.train_tokens for r in got} == {total}


def test_every_context_is_a_node_however_many_and_rare(spark, tmp_path, monkeypatch):
    letters = np.random.default_rng(3).integers(97, 123, 40_000).astype(np.uint8).tobytes().decode()
    rows = [(i, letters[at : at + 1000], None, None, None) for i, at in enumerate(range(0, 40_000, 1000))]
    tree = PlainTree([text.encode() for i, text, *_ in rows if not is_held_out(i)])
    assert len({path for path, _ in tree.counts}) > 1 << 16
    want = [tree.score(text.encode()) for _, text, *_ in rows]
    docs = table_of(spark, tmp_path, rows)
    for sent in (ctw.SENT_CELLS, 1000, 0):  # cells sent to the workers, most of them joined, all of them joined
        monkeypatch.setattr(ctw, "SENT_CELLS", sent)
        got = {r.doc_id: r.score for r in ctw.score_documents(docs).collect()}
        assert [got[i] for i in range(40)] == pytest.approx(want, rel=1e-6)


def test_scores_of_an_empty_table_and_a_model_without_texts(spark, tmp_path):
    assert ctw.score_documents(table_of(spark, tmp_path / "a", [], parts=1)).count() == 0
    held = next(i for i in range(100) if is_held_out(i))
    row = ctw.score_documents(table_of(spark, tmp_path / "b", [(held, "ab", None, None, None)], parts=1)).first()
    assert (row.train_tokens, row.n_known) == (0, 0) and row.score == pytest.approx(3 * math.log10(1 / 256), abs=1e-3)


def test_probabilities_of_all_bytes_add_up(spark):
    texts = spark.createDataFrame([(bytearray(b"abracadabra"),), (bytearray("né".encode()),)], "text binary")
    counts = ctw.count_corpus(texts).where("cell IS NOT NULL").select("cell", "n")
    every = counts.select((F.shiftright("cell", 8)).alias("context")).distinct().select(
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.shiftleft("context", 8).bitwiseOR(b))).alias("cell")
    )
    whole = every.join(counts, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))
    sums = ctw.cell_logs(whole).groupBy(F.shiftright("cell", 8)).agg(F.sum(F.pow(F.lit(10.0), "log")).alias("total"), F.count("*").alias("n"))
    assert {(round(r.total, 9), r.n) for r in sums.collect()} == {(1.0, 256)}


def test_long_texts_have_the_cells_of_their_pieces():
    text = bytes(np.random.default_rng(1).integers(0, 255, 10_001).astype(np.uint8))
    for part in (7, 1000, 10_001, 10_002, 20_000):
        assert np.array_equal(np.concatenate(list(ctw.text_parts(text, part))), ctw.cells(text))


def test_workers_need_no_copy_of_the_package(spark, tmp_path):
    """A session of its own in a folder without the package; what its workers get has to bring everything along."""
    import os
    import subprocess
    import sys

    table_of(spark, tmp_path / "in", [(i, f"some words {i} and more", "en", "a", 1) for i in range(40)])
    script = f"""
import sys
sys.path.insert(0, {os.getcwd()!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
import __spark_entry__ as entry
for name in ("op2_context_tree", "op11_fill_middle", "op12_secret_scan"):
    print(name, entry.queries()[name](spark, {str(tmp_path / "in")!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "elsewhere").mkdir()
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "elsewhere", env=env, capture_output=True, text=True, timeout=300)
    assert [line.split()[1] for line in done.stdout.splitlines() if line.startswith("op")] == ["40"] * 3, done.stderr[-2000:]


def test_scores_beat_byte_frequencies_on_held_out_texts(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: lower(r.text).encode() + b"\xff" for r in docs.collect()}
    seen = np.bincount(np.frombuffer(b"".join(t for i, t in texts.items() if not is_held_out(i)), np.uint8), minlength=256)
    logs = np.log10((seen + 0.5) / (seen.sum() + 128))
    rows = [r for r in ctw.score_documents(docs).collect() if r.held_out]
    plain = sum(logs[np.frombuffer(texts[r.doc_id], np.uint8)].sum() for r in rows)
    assert sum(r.score for r in rows) > 0.65 * plain


# URLs

URLS = [
    None, "", "no scheme", "http://EXAMPLE.org", "https://a.example.org/es/1?x=1", "http://example.org/en/12#t", "http://example.org/en/2",
    "http://notexample.org/es/1", "http://xorg/es/", "https://www.foo.com/de/1", "https://foo.com/fr/1.html", "https://foo.com/FR/1",
    "ftp://org/x", "http://foo.com:80/de/1", "http://a.org?q", "http://é.org/", "x://http://foo.com/de/", "https://foo.net/en/7",
]


def plain_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = lower(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0] if rest else ""
    best = None
    for rule in url_rules.RULES:
        name, start = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    return host, path, best


def test_fixed_rules(spark, tmp_path):
    pages = table_of(spark, tmp_path, list(enumerate(URLS)), "page_id long, url string", "pages")
    labels = table_of(spark, tmp_path, [], "doc_id long, quality int, toxic int", "labels", 1)
    got = {r.page_id: r for r in url_rules.judge_urls(pages, labels).collect()}
    for i, url in enumerate(URLS):
        host, path, rule = plain_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), url
        assert got[i].verdict == (url_rules.RULES[rule] if rule else "allow")


def test_mined_rules_block_what_their_tokens_cover(spark, tmp_path):
    """Pages of one host under one path are bad, and bad ones alone: the pair of tokens is a rule, neither token is."""
    urls, bad = [], []
    for i in range(400):
        host, part = ("pills", "shop")[i % 2 == 0], ("buy", "read")[i // 2 % 2]
        urls.append((i, f"https://{host}.example.net/{part}/{i}"))
        bad.append((i, 1, int(host == "pills" and part == "buy")))
    urls += [(5000 + i, url) for i, url in enumerate(["https://pills.example.net/buy/x", "https://pills.example.net/read/x", None])]
    pages = table_of(spark, tmp_path, [*urls, urls[0]], "page_id long, url string", "pages")
    labels = table_of(spark, tmp_path, [*bad, (None, 0, 1), (9999, None, None)], "doc_id long, quality int, toxic int", "labels")
    got = url_rules.judge_urls(pages, labels).collect()
    assert len(got) == len(urls) + 1
    verdicts = {r.page_id: r.verdict for r in got}
    for i, url in urls:
        assert verdicts[i] == ("block" if url and "pills" in url and "/buy/" in url else "allow"), url
    assert all(r.fired == 1.0 for r in got if r.verdict == "block")
    assert url_rules.judge_urls(pages.where("false"), labels).count() == 0


def test_url_query_keeps_every_page(spark, data):
    assert op3_url_rules(spark, data).count() == spark.read.parquet(f"{data}/pages.parquet").count()


# Pages

ARTICLE = "<html><body><nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><article><h1>Title</h1><p>One &amp; two.<p>Three\n four&nbsp;five<br>six</p></article><footer>&copy; me</footer></body></html>"
PAGES = {
    None: "", "": "", ARTICLE: "Title\n\nOne & two.\n\nThree four five six",
    "<div class=header>Menu</div><div id=content><p>Some words that go on for a while, as texts do.</p><p>And a second one of them.</p>"
    "<div class='comments'><p>Nice post!</p></div></div><div class=sidebar>Links</div>":
        "Some words that go on for a while, as texts do.\n\nAnd a second one of them.",
    "<main><h1>T</h1><p>a &lt; b</p><aside>more</aside><form><label>Name</label><input></form><div class='cookie-notice'>We use cookies</div>"
    "<script>if (a<b) '</p>'</script><style>p{}</style><p>x</p></main>": "T\n\na < b\n\nx",
    "just text": "just text", "<article><p>cut off <b>he": "cut off he", "<article><p>cut off <div cl": "cut off",
    "<article><p>a <!-- hidden --> b</p><img alt='>' src=x> tail &#65;&unknown;</article>": "a b\n\ntail A&unknown;",
}


def test_main_text_of_small_pages(spark, tmp_path):
    rows = [(i, None, page) for i, page in enumerate(PAGES)] + [(None, "u", ARTICLE), (2, None, ARTICLE)] + [(100 + i, "u", ARTICLE) for i in range(30)]
    pages = table_of(spark, tmp_path, rows, "page_id long, url string, html string", "pages")
    got = html_text.extract_text(pages).collect()
    want = Counter((i, PAGES[page]) for i, _, page in rows)
    assert Counter((r.page_id, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_marginals_equal_enumeration():
    """Sum-product on a small tree against the sum over all assignments."""
    import itertools

    page = html_text.Page("<div id=content><p>some text here.<div class=ad>buy <a>this</a></div></div>")
    model = html_text.TreeModel({}, {})
    n = len(page.parent)
    weight, total = [0.0] * n, 0.0
    for states in itertools.product((0, 1), repeat=n):
        w = (0.4, 0.6)[states[0]]
        for i, y in enumerate(states):
            w *= model.odds(page.features[i]) if y else 1.0
            if i:
                w *= model.pair[page.kind(i)][2 * states[page.parent[i]] + y]
        total += w
        for i, y in enumerate(states):
            weight[i] += w * y
    assert np.allclose(model.marginals(page), [w / total for w in weight])


def test_held_out_pages(spark, data):
    """Fitted on some of the pages, the texts of the others equal what their article elements hold."""
    import html

    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in html_text.extract_text(pages, fit_pages=20).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("<p>|</h1>", article))
        assert r.text == "\n\n".join(b for b in blocks if b)


def test_quoted_values_hide_their_markup_however_long_and_many():
    import time

    hidden = "<p>not <b>shown</b></p> " * 2_000
    pages = [
        f"<article><p data-json=\"{hidden}\">seen</p></article>", f"<article><p>seen <img title='{hidden}' alt=\"c > d\"></p></article>",
        "<article><p title=\"a > b\" alt='c > d' id = 'e > f'>seen</p></article>", "<article><p title=it's data-x='>'>seen</p></article>",
        "<article><p title=\"stray>seen</p></article>", "<article><p data-x=\" class='ad' > \">seen</p></article>",
    ]
    for source in pages:
        page = html_text.Page(source)
        assert list(page.texts.values()) == ["seen"] and ("article",) in page.features and not any("ad" in f for f in page.features)
    start = time.perf_counter()
    for source in ("<a b=\">" * 1 + "<a b='>" * 50_000, "<a b=\"'>" * 50_001, "<a b=' c=\">" * 50_001, "<p " + "x" * 500_000 + ">", "<p " + "= " * 200_000 + ">"):
        html_text.Page(source)
    assert time.perf_counter() - start < 15


def test_broken_markup_takes_linear_time():
    import time

    start = time.perf_counter()
    for source in ("<div>" * 50_000 + "x", "<a href='" * 50_000, "<svg>" * 20_000, "<p>" * 50_000, "</b>" * 50_000, "<!--" * 50_000, "<" * 200_000):
        html_text.TreeModel({}, {}).main_text(source)
    assert time.perf_counter() - start < 30
    assert plain_rows and sentence


FOREIGN = {
    "de": ("leserkommentare", "werbung", "hinweis", "Ein langer Satz über das Wetter, der für sich allein stehen kann."),
    "fr": ("commentaires", "publicite", "avis-partager", "Une phrase assez longue sur le temps, qui peut rester seule ici."),
    "es": ("comentarios", "publicidad", "aviso", "Una frase bastante larga sobre el tiempo, que puede quedar sola."),
    "en": ("comments", "advert", "notice", "A rather long sentence on the weather, which can stand for itself."),
}


def test_parts_named_in_other_languages_and_formulas(spark, data, tmp_path):
    """The given pages and, among them, pages whose classes have German, French and Spanish names."""
    rows = []
    for i, (comments, adverts, notice, text) in enumerate(FOREIGN.values()):
        html = (
            f"<html><body><article><h1>Title {i}</h1><p>{text}</p><div class='{adverts}'>buy now</div><p>{text} Let <math><mi>x</mi>"
            f"<mo>=</mo><mn>2</mn></math> hold.</p><div class='{comments}'><p>well said</p></div><div class='{notice}'>read this</div></article></body></html>"
        )
        rows.append((10**6 + i, f"http://x.org/{i}", html))
    given = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html")
    pages = table_of(spark, tmp_path, [*map(tuple, given.collect()), *rows], "page_id long, url string, html string", "pages")
    got = {r.page_id: r.text for r in html_text.extract_text(pages).where("page_id >= 1000000").collect()}
    for i, (*_, text) in enumerate(FOREIGN.values()):
        assert got[10**6 + i] == f"Title {i}\n\n{text}\n\n{text} Let x=2 hold."
