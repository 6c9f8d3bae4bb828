"""Language identification by Bayesian fusion of text, declared language, address suffix and host priors."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import ROW, bounded_batches, packed, stored, with_rows

# Byte trigrams are counted in so many slots per language: the model has a fixed size.
SLOTS = 1 << 15

# The text model is fitted on all labelled rows of a language, or about so many, picked by hash, of one that has more;
# everything else uses all rows.
FIT_ROWS = 20_000

# Neighbouring trigrams overlap, so their logs count by a third.
TEMPER = 1 / 3

# Evidence rows that a host's own counts are worth less than: weight of the next wider group.
SMOOTHING = 20.0

NONE = "none"
NONE_PRIOR = 0.01
LEAST_POSTERIOR = 0.5

# A-Z in lower case, the controls of white space as blanks.
PLAIN = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))


def trigram_slots(text: bytes) -> np.ndarray:
    """Slots of the byte trigrams of letters and blanks, A-Z in lower case, white space as blank, the text between two
    blanks. Numbers, signs and what touches them say nothing about the language; a text without letters has none."""
    b = np.frombuffer(b" " + text.translate(PLAIN) + b" ", np.uint8).astype(np.uint32)
    letter = (b >= 97) & (b <= 122) | (b >= 128)
    fits = letter | (b == 32)
    fits = fits[:-2] & fits[1:-1] & fits[2:] & (letter[:-2] | letter[1:-1] | letter[2:])
    key = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:])[fits]
    return (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)


def fit_text_model(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log probabilities of the slots, one row per language; fitted on rows that declare a language.

    ``fit_rows`` bounds the rows per language, so none loses rows to others. Languages whose texts have no trigram are
    no class. The model has 128 KB per language.
    """
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    shares = {lang: max(1, (1 << 20) * fit_rows // n) for lang, n in sizes.items() if n > fit_rows}
    picked = labelled
    if shares:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang")), F.lit(1 << 20))
        # The row number tells rows apart whose ids are null or repeated.
        picked = with_rows(labelled).where(F.pmod(F.xxhash64("doc_id", "lang", ROW), F.lit(1 << 20)) < share)
    languages = sorted(sizes)
    place = {lang: i for i, lang in enumerate(languages)}

    def count(batches):
        sums = defaultdict(lambda: np.zeros(SLOTS, np.int64))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[place[lang]] += np.bincount(trigram_slots(text.as_py()), minlength=SLOTS)
        for lang, n in sums.items():
            slot = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(slot), lang), pa.int32()), pa.array(slot, pa.int32()), pa.array(n[slot])], names=["lang", "slot", "n"]
            )

    picked = bounded_batches(picked.select("lang", F.col("text").cast("binary").alias("text")))
    sums = picked.mapInArrow(count, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    met, at = np.unique(sums["lang"].to_numpy(int), return_inverse=True)
    languages = [languages[i] for i in met]
    counts = np.full((len(languages), SLOTS), 0.5)
    counts[at, sums["slot"].to_numpy(int)] += sums["n"].to_numpy(float)
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def text_evidence(docs: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """``_row, n_grams, logs`` (array<double>): tempered log likelihood of the whole text under each language, and last
    under no language, where all trigram slots are equally likely."""
    sent = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    classes = len(languages) + 1

    def score(batches):
        table = sent.value
        for batch in batches:
            sums, sizes = np.zeros((batch.num_rows, classes)), []
            for i, text in enumerate(batch.column(1)):
                slots = trigram_slots(text.as_py() or b"")
                sizes.append(len(slots))
                if len(slots):
                    counts = np.bincount(slots, minlength=SLOTS) if len(slots) > SLOTS else None
                    sums[i, :-1] = counts @ table if counts is not None else table[slots].sum(axis=0, dtype=np.float64)
                    sums[i, -1] = -len(slots) * np.log(SLOTS)
            values = pa.array((sums * TEMPER).ravel())
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * classes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                names=[ROW, "n_grams", "logs"],
            )

    rows = with_rows(docs.select(F.col("text").cast("binary").alias("text"))).select(ROW, "text")
    return bounded_batches(rows).mapInArrow(score, f"{ROW} long, n_grams long, logs array<double>")


def address_suffix(host: Column) -> Column:
    """The last label of a host, like ``org``."""
    return F.nullif(F.lower(F.substring_index(host, ".", -1)), F.lit(""))


def _best(logs: Column) -> Column:
    """Place of the largest entry, the first of equals."""
    return F.array_position(logs, F.array_max(logs)).cast("int") - 1


def _conditional(seen: DataFrame, value: str, classes: int) -> DataFrame:
    """``value`` with ``given``: for each class the log probability of the value, from the classes the texts point to."""
    counts = seen.where(F.col(value).isNotNull()).groupBy(value, "guess").agg(F.count("*").alias("n"))
    totals = counts.groupBy("guess").agg(F.sum("n").alias("of"))
    known = counts.join(F.broadcast(totals), "guess")  # one row per class
    pairs = known.groupBy(value).agg(F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("n"))
    of = {r["guess"]: r["of"] for r in totals.collect()}
    denominators = F.array(*[F.lit(float(of.get(i, 0) + SMOOTHING)) for i in range(classes)])
    logs = F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)),
        lambda i: F.log((F.coalesce(F.element_at("n", i), F.lit(0)) + 0.5) / F.element_at(denominators, i + 1)),
    )
    return pairs.select(value, logs.alias("given"))


def _priors(seen: DataFrame, classes: int) -> DataFrame:
    """``host`` with ``prior``: class logs of a host's rows, smoothed by its suffix's, those by all rows'."""
    places = F.sequence(F.lit(0), F.lit(classes - 1))
    counted = lambda *by: seen.groupBy(*by, "guess").agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("guess", "n"))).alias("n"), F.sum("n").alias("of")
    )
    share = lambda n, of, wider: F.transform(
        places, lambda i: (F.coalesce(F.element_at(n, i), F.lit(0)) + SMOOTHING * F.element_at(wider, i + 1)) / (of + SMOOTHING)
    )
    flat = F.array(*[F.lit((1 - NONE_PRIOR) / max(1, classes - 1))] * (classes - 1), F.lit(NONE_PRIOR))
    every = counted().select(share(F.col("n"), F.col("of"), flat).alias("p")).first()
    all_rows = F.array(*[F.lit(float(p)) for p in every["p"]]) if every and None not in every["p"] else flat
    groups = counted("suffix").select(F.col("suffix").alias("_suffix"), share(F.col("n"), F.col("of"), all_rows).alias("wider"))
    hosts = counted("host", "suffix").alias("h").join(groups, F.col("h.suffix").eqNullSafe(F.col("_suffix")))
    return hosts.select("host", "suffix", F.transform(share(F.col("n"), F.col("of"), F.col("wider")), lambda p: F.log(p)).alias("prior"))


def identify(docs: DataFrame, evidence: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row ``_row, doc_id, language, posterior, accepted, declared, n_grams``.

    ``docs`` has ``doc_id, text, lang, source``: the declared language and the source, which stands for the host.
    ``evidence`` may add, per doc_id, ``markup`` (language the page's markup declares) and ``host`` (of its address).

    Per language the tempered text log likelihood, the log probability of each declaration given the language, and the
    log prior of the host are added. Declarations and priors are counted over all rows, from the languages the texts
    alone point to; a host's prior leans on its address suffix's and that on all rows', each with the weight of 20 rows.
    A last class, no language, has equally likely trigrams. A row is rejected if that class wins, if the posterior is
    below 0.5, or if its text has no letters (null and empty texts too; language null then). Missing declarations add
    nothing. Without any labelled row everything is rejected. Ids may be null or repeated; an empty table gives no rows.
    """
    languages, logs = fit_text_model(docs, fit_rows)
    classes = len(languages) + 1
    rows = with_rows(docs.select("doc_id", "lang", "source"))
    texts = text_evidence(docs, languages, logs)
    seen = texts.join(rows, ROW).withColumn("guess", _best(F.col("logs")))
    if evidence is None:
        seen = seen.withColumns({"markup": F.lit(None).cast("string"), "address": F.lit(None).cast("string")})
    else:
        one = evidence.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("markup").alias("markup"), F.min("host").alias("address"))
        seen = seen.join(one, "doc_id", "left")
    host = F.coalesce("address", "source")
    seen = stored(seen.select(
        ROW, "doc_id", F.col("lang").alias("declared"), "markup", host.alias("host"), address_suffix(F.col("address")).alias("suffix"),
        "n_grams", "logs", "guess",
    ), "language-evidence")
    clear = seen.where("n_grams > 0")
    fused = seen
    for value in ("declared", "markup"):
        given = _conditional(clear, value, classes).select(value, F.col("given").alias(f"{value}_given"))
        fused = fused.join(given, value, "left")
    priors = _priors(clear, classes).select(F.col("host").alias("_host"), F.col("suffix").alias("_suffix"), "prior")
    fused = fused.join(
        priors, F.col("host").eqNullSafe(F.col("_host")) & F.col("suffix").eqNullSafe(F.col("_suffix")), "left"
    )
    add = lambda a, b: F.when(F.col(b).isNull(), a).otherwise(F.zip_with(a, F.col(b), lambda x, y: x + y))
    total = add(add(add(F.col("logs"), "declared_given"), "markup_given"), "prior")
    fused = fused.withColumn("total", total).withColumn("best", _best(F.col("total")))
    posterior = 1 / F.aggregate(
        F.transform("total", lambda x: F.exp(x - F.array_max("total"))), F.lit(0.0), lambda a, x: a + x
    )
    name = F.element_at(F.array(*map(F.lit, [*languages, NONE])), F.col("best") + 1)
    clear_enough = (F.col("n_grams") > 0) & (F.col("best") < classes - 1) & (F.col("posterior") >= LEAST_POSTERIOR)
    return fused.withColumn("posterior", posterior).select(
        ROW, "doc_id", F.when(F.col("n_grams") > 0, name).alias("language"), "posterior", clear_enough.alias("accepted"),
        "declared", "n_grams",
    )


def page_evidence(pages: DataFrame) -> DataFrame:
    """``doc_id, markup, host`` of pages whose address ends in a document's number, like ``/en/17.html``."""
    number = F.regexp_extract("url", r"/(\d{1,18})(?:[./?#][^/]*)?$", 1)
    # The first html tag outside comments, wherever it is. Possessive loops need no stack, however long the page.
    value = r"""=\s*+"[^"]*+"|=\s*+'[^']*+'"""
    bare = F.regexp_replace("html", r"(?s)<!--.*?(?:-->|\z)", "")
    tag = F.regexp_extract(bare, rf"(?i)<html(?=[\s/>])((?:{value}|[^>])*+)", 1)
    markup = F.regexp_extract(tag, rf"(?is)\A(?:(?!\slang\s*=)(?:{value}|.))*+\slang\s*=\s*[\"']?([a-z]+)", 1)
    host = F.regexp_extract("url", r"://([^/?#:]+)", 1)
    return pages.select(
        number.try_cast("long").alias("doc_id"),
        F.nullif(F.lower(markup), F.lit("")).alias("markup"), F.nullif(F.lower(host), F.lit("")).alias("host"),
    )


def keep_identified(docs: DataFrame, evidence: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, with all their columns."""
    accepted = identify(docs, evidence, fit_rows).where("accepted").select(ROW)
    return packed(docs).join(accepted, ROW, "left_semi").select("doc.*")
