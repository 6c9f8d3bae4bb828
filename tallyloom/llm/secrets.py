"""Secrets in texts: one pass of a keyword automaton, regular expressions anchored at its hits, checksums inside tokens."""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import bounded_batches

# In the copy that the automaton reads, A-Z are in lower case and all hexadecimal digits are this byte, which UTF-8 never
# uses. So keywords and long runs of digits are found by the same automaton.
DIGIT = b"\xff"
FOLD = bytes(
    DIGIT[0] if c in b"0123456789abcdefABCDEF" else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
LEAST_HEX = 24

BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _crc_token(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the thirty before them, in base 62."""
    body, check = match[1], match[2]
    value, digits = zlib.crc32(body), b""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit : digit + 1] + digits
    return digits == check


def _base58_key(match: re.Match) -> bool:
    """The last four of 82 bytes are the first four of the double SHA-256 of the others."""
    value = 0
    for c in match[0]:
        value = value * 58 + BASE58.index(c)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


class Rule(NamedTuple):
    """``valid`` drops a match; a dropped match still covers its characters."""

    kind: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    valid: object


# The patterns of the three base kinds. Kinds in the order in which spans of the same start are listed.
RULES = [
    Rule(
        "assign", (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
        re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
        lambda m: len(m[2]) >= 6,
    ),
    Rule("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    Rule("hex", (DIGIT * LEAST_HEX,), re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= LEAST_HEX),
    Rule(
        "github", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"),
        re.compile(rb"(?<![A-Za-z0-9_])gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"), _crc_token,
    ),
    Rule("npm", (b"npm_",), re.compile(rb"(?<![A-Za-z0-9_])npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])"), _crc_token),
    Rule("xprv", (b"xprv",), re.compile(rb"(?<![A-Za-z0-9])xprv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])"), _base58_key),
]
BASE_KINDS = ["assign", "access", "hex"]
DIGIT_RUN = re.compile(rb"[0-9a-fA-F]+")


def keyword_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for number, rule in enumerate(RULES):
        for keyword in rule.keywords:
            automaton.add_word(keyword.translate(FOLD).decode("latin-1"), (number, len(keyword)))
    automaton.make_automaton()
    return automaton


def byte_spans(raw: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """``(start, rule, end)`` of all secrets in bytes, by start and rule.

    Per rule, matches are taken from left to right and do not overlap. Keywords do not contain one another, so hits of a
    rule come in the order of their starts. The first hit of a run of digits starts at the run's first digit.
    """
    found, taken = [], [0] * len(RULES)
    for last, (number, length) in automaton.iter(raw.translate(FOLD).decode("latin-1")):
        start, rule = last + 1 - length, RULES[number]
        if start < taken[number]:
            continue
        if rule.kind == "hex":
            taken[number] = end = DIGIT_RUN.match(raw, start).end()
            matches = rule.pattern.finditer(raw, start, end)
        else:
            match = rule.pattern.match(raw, start)
            matches = [match] if match else []
            if match:
                taken[number] = match.end()
        found += [(m.start(), number, m.end()) for m in matches if rule.valid(m)]
    return sorted(found)


def code_points(raw: bytes, offsets: list[int]) -> dict[int, int]:
    """Code points before each byte offset."""
    data, places, before, at = np.frombuffer(raw, np.uint8), {}, 0, 0
    for offset in sorted(set(offsets)):
        before += int(np.count_nonzero((data[at:offset] & 0xC0) != 0x80))
        places[offset], at = before, offset
    return places


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` of every row; spans are ``(kind, start, end)`` in code points, end exclusive, by start and kind.

    Kinds ``assign``, ``access`` and ``hex`` are the leftmost matches of their patterns that are long enough; ``github``,
    ``npm`` and ``xprv`` are tokens whose embedded checksum is right. Spans of different kinds may overlap. Null and empty
    texts have none; whole texts are read, however long. Repeated rows and ids give one row each, a null doc_id stays null.
    Only doc_id and text are read, so no other column can clash. An empty table gives no rows.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        automaton = keyword_automaton()
        for batch in batches:
            spans = []
            for text in batch.column(1):
                raw = text.as_py() or b""
                hits = byte_spans(raw, automaton)
                at = code_points(raw, [x for start, _, end in hits for x in (start, end)]) if hits else {}
                spans.append([{"kind": RULES[k].kind, "start": at[start], "end": at[end]} for start, k, end in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long>>"
    return bounded_batches(rows).mapInArrow(scan, schema)


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
