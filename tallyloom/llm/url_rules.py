"""URL filtering by fixed rules and, beyond them, association rules that FP-growth mines from labelled pages."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import ROW, ascii_lower, stored, with_rows

# Rule and verdict.
RULES = {
    "org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block",
}

BAD = "label:bad"

# A rule needs this share of the labelled rows and must be right this often.
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.6


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path; both empty without ``://`` or for a null url."""
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        name, _, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host, its labels, path parts (numbers fall together), names of parameters, scheme."""
    tagged = lambda tag, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    numbers = F.regexp_replace(path, r"\d+", "0")
    query = F.regexp_extract(_after_scheme(url), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_distinct(F.concat(
        tagged("host:", F.array(host)), tagged("label:", F.split(host, r"\.")), tagged("path:", F.split(numbers, "/")),
        tagged("name:", F.coalesce(names, F.array().cast("array<string>"))),
        tagged("scheme:", F.array(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]+)://", 1))),
    ))


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``tokens, rarest, confidence, support`` of the rules ``tokens -> bad`` from all rows of ``tokens, bad``.

    ``rarest`` is the token of a rule that the fewest labelled rows have: the key of the inverted index.
    """
    baskets = stored(labelled.select(
        F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")
    ).where(F.size("items") > 0), "baskets")
    empty = "tokens array<string>, rarest string, confidence double, support double"
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.col("antecedent").alias("tokens"), "confidence", "support"
    )
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    parts = rules.select("tokens", "confidence", "support", F.explode("tokens").alias("token")).join(single, "token")
    first = F.min(F.struct("freq", "token"))["token"].alias("rarest")
    return stored(parts.groupBy("tokens", "confidence", "support").agg(first).select("tokens", "rarest", "confidence", "support"), "url-rules")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: dict[str, str] = RULES, **options) -> DataFrame:
    """Per row ``page_id, host, path, rule, verdict, fired``.

    A fixed rule decides if one fits. Else the page is blocked if a mined rule has all its tokens in the url; ``fired``
    is the highest confidence of such rules, null if there is none. Mined rules conclude ``bad`` (toxic, or low quality)
    from the labels of pages whose address ends in a labelled document's number.

    Null urls and urls without ``://`` have an empty host and path and no tokens. Urls of any length are read whole; a long
    one has more tokens. Of rules of equal confidence any gives the same verdict and ``fired``. Ids may be null or
    repeated; an empty table gives no rows; without labels nothing is mined and the method allows. Only page_id and url,
    and doc_id, quality and toxic of the labels, are read, so no other column can clash.
    """
    host, path = host_and_path(F.col("url"))
    rows = with_rows(pages.select("page_id", "url")).select(ROW, "page_id", "url", host.alias("host"), path.alias("path"))
    tokens = F.when(F.col("host") != "", url_tokens(F.col("url"), F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>"))
    number = F.regexp_extract("path", r"/(\d{1,18})(?:[./][^/]*)?$", 1).try_cast("long")
    rows = rows.select(ROW, "page_id", "host", "path", tokens.alias("tokens"), number.alias("doc_id"))
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    mined = mine_rules(rows.select(ROW, "tokens", "doc_id").join(known, "doc_id").select(ROW, "tokens", "bad"), **options)
    index = mined.select("rarest", F.col("tokens").alias("needed"), "confidence")
    hits = (
        rows.select(ROW, "tokens", F.explode("tokens").alias("token")).join(index, F.col("token") == F.col("rarest"))
        .where(F.size(F.array_except("needed", "tokens")) == 0).groupBy(ROW).agg(F.max("confidence").alias("fired"))
    )
    judged = rows.select(ROW, "page_id", "host", "path").join(hits, ROW, "left")
    rule = fixed_rule(F.col("host"), F.col("path"), rules)
    fixed = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("rule"))
    own = F.when(F.col("fired").isNotNull(), "block").otherwise("allow")
    judged = judged.withColumn("rule", rule)
    return judged.select("page_id", "host", "path", "rule", F.coalesce(fixed, own).alias("verdict"), "fired")
