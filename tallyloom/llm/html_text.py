"""Main text of web pages: a tree-structured graphical model over the page's elements and text blocks.

Every block element and every block of text is a binary variable, content or not. A parent and its child share a
potential, and each variable has the evidence of what it looks like. Messages go up and down the tree once, which gives
the exact marginals; blocks whose marginal is at least one half are the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.common import bounded_batches

# The model is fitted on about so many pages, picked by hash; every page is extracted.
FIT_PAGES = 5_000

# Fixed values of the markup language: elements without content, elements that end an open paragraph or stand as a
# block, and elements whose content is no text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
RAW = frozenset("script style template noscript iframe svg canvas object audio video textarea select option title head".split())
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table".split())

# What names of elements, classes and ids say, as counts added to those of the labelled pages: the words of the web, and
# what German, French and Spanish sites call their parts.
CONTENT_WORDS = "article main content post entry story body text articlebody"
OTHER_WORDS = (
    "nav footer header aside form menu menubar navbar navigation breadcrumb breadcrumbs sidebar ad ads advert adverts "
    "advertisement sponsor sponsored promo banner cookie cookies consent notice alert popup modal overlay newsletter "
    "subscribe signup login share sharing social related recommended comment comments reply replies respond disqus "
    "discussion widget toolbar pagination pager copyright legal disclaimer skip button dialog search "
    "kommentar kommentare kommentaren leserkommentare leserbriefe antworten werbung anzeige anzeigen reklame fusszeile kopfzeile "
    "seitenleiste navigationsleiste hinweis teilen verwandt anmelden datenschutz impressum suche "
    "commentaire commentaires reponses publicite publicites annonce annonces pied barre partager connexion recherche connexes "
    "comentario comentarios respuestas publicidad anuncio anuncios pie barra lateral compartir relacionados buscar aviso"
)
OTHER = frozenset(OTHER_WORDS.split())
WORD_COUNT = 100.0
PAIR_COUNT = 20.0
# Share of children that are content below content, and below the rest: elements, elements in a part whose name says
# that it isn't content, and blocks of text.
BELOW = {"element": (0.7, 0.25), "named": (0.7, 0.03), "text": (0.98, 0.03)}

# Elements that any part of a page may use; their names say little beyond the pages they were counted on.
ANYWHERE = frozenset("html body div section p ul ol li dl dt dd table tbody thead tr td th blockquote center figure pre span".split())

NAME_AT = re.compile(r"/?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""(?<![^\s"'<>/=])([^\s"'<>/=]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
NAMING = frozenset(("class", "id", "role", "itemprop"))
TAG_STEP = re.compile(r"""=\s*+(?:(["'])|[^\s"'>][^\s>]*+)?|>""")  # the start of a value, an unquoted one whole, or the end
NAME = re.compile(r"[a-z]+")


def element_features(tag: str, attributes: str) -> tuple[str, ...]:
    names = [tag]
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in NAMING:
            names += NAME.findall((m[2] or m[3] or m[4] or "").lower())
    return tuple(dict.fromkeys(names))


class Page:
    """Variables in page order, parents first: ``parent``, ``features``; ``texts`` has the blocks' texts by variable."""

    def __init__(self, source: str):
        self.parent, self.features, self.texts = [-1], [("html",)], {}
        self.stack, self.blocks, self.open = [("html", 0)], [0], Counter(["html"])
        self.pieces, self.linked, self.plain = [], 0, 0
        self.unclosed: set[str] = set()
        self.spent: set[str] = set()  # quote signs that the rest of the page doesn't have
        at, n = 0, len(source)
        while at < n:
            start = source.find("<", at)
            self._text(source[at : start if start >= 0 else n])
            at = n if start < 0 else self._mark(source, start)
        self._flush()

    def _mark(self, source: str, start: int) -> int:
        """Handles what begins with a < and tells where it ends. A mark that is cut off at the end is dropped."""
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            return end + 3 if end >= 0 else len(source)
        name = NAME_AT.match(source, start + 1)
        if not name and source[start + 1 : start + 2] not in ("!", "?", "/"):
            self._text("<")
            return start + 1
        end = source.find(">", start)
        if end < 0:
            return len(source)
        if not name:
            return end + 1
        tag = name[1].lower()
        end = self._tag_end(source, name.end())
        if end < 0:
            return len(source)
        if source[start + 1] == "/":
            self._close(tag)
            return end + 1
        if tag in RAW:
            return self._skip(source, tag, end + 1)
        self._open(tag, source[name.end() : end])
        return end + 1

    def _tag_end(self, source: str, at: int) -> int:
        """Where the > of a tag is; quoted values, however many and long, are passed whole. A quote that is never closed
        is taken for a stray one."""
        while step := TAG_STEP.search(source, at):
            at, quote = step.end(), step[1]
            if step[0] == ">":
                return step.start()
            if quote and quote not in self.spent:
                closing = source.find(quote, at)
                if closing < 0:
                    self.spent.add(quote)
                else:
                    at = closing + 1
        return -1

    def _skip(self, source: str, tag: str, at: int) -> int:
        """Past an element whose content is no text; an unclosed one hides only itself, but for scripts and styles."""
        end = None
        if tag not in self.unclosed:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
        if end:
            return end.end()
        self.unclosed.add(tag)
        return len(source) if tag in ("script", "style", "textarea") else at

    def _text(self, piece: str) -> None:
        if piece:
            self.pieces.append(piece)
            if self.open["a"] > 0:
                self.linked += len(piece)
            self.plain += len(piece)

    def _flush(self) -> None:
        if self.pieces:
            text = " ".join(html.unescape("".join(self.pieces)).split())
            if text:
                share = self.linked / self.plain
                self.parent.append(self.blocks[-1])
                self.features.append(self._looks(text, share))
                self.texts[len(self.parent) - 1] = text
            self.pieces, self.linked, self.plain = [], 0, 0

    @staticmethod
    def _looks(text: str, link_share: float) -> tuple[str, ...]:
        return (
            f"#size{min(8, len(text).bit_length() // 2)}", f"#links{0 if link_share < 0.2 else 1 if link_share < 0.8 else 2}",
            f"#end{int(text[-1] in '.!?:;…。')}", f"#sign{int('©' in text)}",
        )

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append("\n")
            self.plain += 1
        if tag in BLOCK:
            self._flush()
            if self.open["p"]:
                self._pop_until({"p"}, SCOPES | {"button"})
            if tag in ENDS_ITSELF:
                self._pop_until(ENDS_ITSELF[tag], SCOPES)
            if tag not in ("html", "body") or not self.open[tag]:
                self.parent.append(self.blocks[-1])
                self.features.append(element_features(tag, attributes))
                if tag != "hr":
                    self.stack.append((tag, len(self.parent) - 1))
                    self.blocks.append(len(self.parent) - 1)
                    self.open[tag] += 1
        elif tag not in VOID and not attributes.endswith("/"):
            self.stack.append((tag, -1))
            self.open[tag] += 1

    def _pop_until(self, tags: set, scopes: frozenset | set) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k][0]
            if tag in tags:
                self._cut(k)
                return
            if tag in scopes:
                return

    def _cut(self, k: int) -> None:
        for tag, i in self.stack[k:]:
            self.open[tag] -= 1
            if i >= 0:
                self.blocks.pop()
        del self.stack[k:]

    def _close(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._cut(k)
                return
            if tag not in BLOCK and self.stack[k][1] >= 0:
                return  # an inline end tag doesn't close blocks

    def kind(self, i: int) -> str:
        """Which pair potential a variable has with its parent."""
        return "text" if i in self.texts else "element" if OTHER.isdisjoint(self.features[self.parent[i]]) else "named"


def weak_labels(page: Page) -> list[int] | None:
    """Labels that a page's own markup declares: an article (or else main) element with what is in it, but for parts
    whose names say otherwise; None if it declares none."""
    for marks in ({"article", "articlebody"}, {"main"}):
        roots = [i for i, f in enumerate(page.features) if marks & set(f)]
        if roots:
            break
    else:
        return None
    labels = [0] * len(page.parent)
    for i, f in enumerate(page.features):
        up = page.parent[i]
        says_other = not f[0].startswith("#") and not OTHER.isdisjoint(f)
        labels[i] = int((marks.isdisjoint(f) is False or (up >= 0 and labels[up] == 1)) and not says_other)
    return labels


class TreeModel:
    """Log potentials from counts: of a child's state given its parent's, and of features given a state."""

    def __init__(self, pairs: dict[tuple[str, int, int], float], words: dict[str, tuple[float, float]]):
        def pair(kind, up, down):
            prior = BELOW[kind][1 - up]
            seen = pairs.get((kind, up, 0), 0) + pairs.get((kind, up, 1), 0)
            # Other sites may be laid out otherwise: the labelled pages weigh half as much as the prior at most.
            weight = min(1.0, PAIR_COUNT / 2 / seen) if seen else 0.0
            share = prior if down else 1 - prior
            return (pairs.get((kind, up, down), 0) * weight + PAIR_COUNT * share) / (seen * weight + PAIR_COUNT)

        self.pair = {k: (pair(k, 0, 0), pair(k, 0, 1), pair(k, 1, 0), pair(k, 1, 1)) for k in BELOW}
        of = [1.0 + sum(n[y] for n in words.values()) for y in (0, 1)]
        self.ratio = {}
        for word in {*words, *CONTENT_WORDS.split(), *OTHER}:
            n0, n1 = words.get(word, (0.0, 0.0))
            if word.startswith("#"):  # looks of a text are weak evidence: many kinds of parts share them
                self.ratio[word] = 0.5 * max(-1.0, min(1.0, math.log(((n1 + 5) / of[1]) / ((n0 + 5) / of[0]))))
                continue
            weight = min(1.0, 200.0 / (n0 + n1)) if n0 + n1 else 0.0
            n1 = n1 * weight + (WORD_COUNT if word in CONTENT_WORDS.split() else 0) + 1
            n0 = n0 * weight + (WORD_COUNT if word in OTHER else 0) + 1
            self.ratio[word] = math.log(n1 / n0) * (0 if word in ("html", "body") else 0.2 if word in ANYWHERE else 1)
        self.cache: dict[tuple, float] = {}

    def odds(self, features: tuple[str, ...]) -> float:
        """Evidence for content against the rest, as a ratio."""
        if features not in self.cache:
            if len(self.cache) > 50_000:
                self.cache.clear()
            self.cache[features] = math.exp(max(-30.0, min(30.0, sum(self.ratio.get(f, 0.0) for f in features))))
        return self.cache[features]

    def marginals(self, page: Page) -> list[float]:
        """Probability of content for each variable, by sum-product up and down the tree."""
        n, parent = len(page.parent), page.parent
        own0, own1 = [1.0] * n, [self.odds(f) for f in page.features]
        up0, up1 = [1.0] * n, [1.0] * n  # message from a variable to its parent
        pair = [self.pair[page.kind(i)] for i in range(n)]
        for i in range(n - 1, 0, -1):
            a, b = own0[i], own1[i]
            p00, p01, p10, p11 = pair[i]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            s = m0 + m1
            up0[i], up1[i] = m0 / s, m1 / s
            j = parent[i]
            x, y = own0[j] * up0[i], own1[j] * up1[i]
            s = x + y
            own0[j], own1[j] = (x / s, y / s) if s else (0.5, 0.5)
        belief = [0.0] * n
        prior0, prior1 = 0.4 * own0[0], 0.6 * own1[0]
        belief[0] = prior1 / (prior0 + prior1)
        for i in range(1, n):
            j = parent[i]
            q0, q1 = (1 - belief[j]) / max(up0[i], 1e-300), belief[j] / max(up1[i], 1e-300)  # without this branch
            s = q0 + q1
            q0, q1 = q0 / s, q1 / s
            p00, p01, p10, p11 = pair[i]
            x, y = (q0 * p00 + q1 * p10) * own0[i], (q0 * p01 + q1 * p11) * own1[i]
            belief[i] = y / (x + y)
        return belief

    def main_text(self, source: str) -> str:
        page = Page(source)
        belief = self.marginals(page)
        return "\n\n".join(text for i, text in page.texts.items() if belief[i] >= 0.5)


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> TreeModel:
    """Counts over the labelled among a bounded number of pages; workers add up, the shuffle adds their sums."""
    total = pages.count()
    share = max(1, min(1 << 20, (1 << 20) * fit_pages // max(1, total)))
    picked = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < share)

    def count(batches):
        counts = Counter()
        for batch in batches:
            for source in batch.column(0):
                page = Page(source.as_py() or "")
                labels = weak_labels(page)
                if labels:
                    for i, f in enumerate(page.features):
                        counts.update((word, labels[i]) for word in f)
                        if i:
                            counts[f"={labels[page.parent[i]]}{page.kind(i)}", labels[i]] += 1
        words, states = zip(*counts) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array(states, pa.int32()), pa.array(list(counts.values()), pa.int64())],
            names=["word", "state", "n"],
        )

    sums = bounded_batches(picked.select("html")).mapInArrow(count, "word string, state int, n long")
    rows = sums.groupBy("word", "state").agg(F.sum("n").alias("n")).collect()  # bounded by fit_pages
    pairs = {(r.word[2:], int(r.word[1]), r.state): float(r.n) for r in rows if r.word.startswith("=")}
    words: dict[str, list[float]] = {}
    for r in rows:
        if not r.word.startswith("="):
            words.setdefault(r.word, [0.0, 0.0])[r.state] = float(r.n)
    return TreeModel(pairs, {w: tuple(n) for w, n in words.items()})


def extract_text(pages: DataFrame, fit_pages: int = FIT_PAGES) -> DataFrame:
    """Per row ``page_id, url, text, n_chars``: the article's blocks in page order, joined by a blank line.

    Character references are decoded, white space within a block becomes one blank. Null and empty pages have an empty
    text; broken markup is read as far as it goes; ids may be null or repeated; an empty table gives no rows. Without any
    page that declares its article, the model rests on what the names of elements, classes and ids say. Only page_id, url and
    html are read, so no other column can clash.
    """
    model = fit(pages, fit_pages)
    sent = pages.sparkSession.sparkContext.broadcast((model.pair, model.ratio))

    def extract(batches):
        model = TreeModel({}, {})
        model.pair, model.ratio = sent.value
        for batch in batches:
            texts = [model.main_text(source.as_py() or "") for source in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = bounded_batches(pages.select("page_id", "url", "html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
