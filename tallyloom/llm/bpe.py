"""Byte-level BPE by tree reduction: halves are encoded by themselves and joined by re-encoding around the seam."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from tallyloom.llm.common import bounded_batches

# Leaves are short, so that nearly every text is put together by joins; the library sees no more than a leaf or a window.
LEAF_CHARS = 256
LEAF_BYTES = 64
FIRST_WINDOW = 32


def read_ranks(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


class TreeCodec:
    """Encoder and decoder over a rank file and the pattern that splits texts before the merges.

    Leaves are encoded with the tokenizer library. Two facts make the joins exact:

    * A cut before white space that follows something else is a cut of the pattern too, whatever stands around it:
      no alternative runs from other characters into white space, and white space is never looked back at. So outside a
      window between two such cuts the matches, and hence the tokens, are final.
    * Inside one match, tokens are the encoding of their bytes exactly if each adjacent pair is the encoding of its own
      bytes. So a re-encoded window is final as soon as the pairs at its two edges are.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        self.library = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.library.encode_ordinary(text)
        middle = len(text) // 2
        return self._join(text, middle, self.encode(text[:middle]), self.encode(text[middle:]))

    def _join(self, text: str, middle: int, left: list[int], right: list[int]) -> list[int]:
        start, end, window = middle, middle, FIRST_WINDOW
        while start > 0 and not _is_cut(text, start) or start == middle:
            near = max(1, middle - window)
            start = next((p for p in range(start - 1, near - 1, -1) if _is_cut(text, p)), 0 if near == 1 else near)
            window *= 2
        window = FIRST_WINDOW
        while end < len(text) and not _is_cut(text, end) or end == middle:
            near = min(len(text) - 1, middle + window)
            end = next((p for p in range(end + 1, near + 1) if _is_cut(text, p)), len(text) if near == len(text) - 1 else near)
            window *= 2
        keep, drop = len(left), 0
        size = len(text[start:middle].encode())
        while size > 0:
            keep -= 1
            size -= len(self.tokens[left[keep]])
        size = len(text[middle:end].encode())
        while size > 0:
            size -= len(self.tokens[right[drop]])
            drop += 1
        return left[:keep] + self._window(text[start:end]) + right[drop:]

    def _window(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for match in self.pattern.finditer(text):
            ids += self.encode_match(match[0].encode())
        return ids

    def encode_match(self, piece: bytes) -> list[int]:
        """One match of the pattern, by the same reduction over its bytes."""
        if len(piece) <= self.leaf_bytes:
            return self.library._encode_single_piece(piece)
        middle = len(piece) // 2
        left, right = self.encode_match(piece[:middle]), self.encode_match(piece[middle:])
        tokens, near = self.tokens, 2
        while True:
            a, b = max(0, len(left) - near), min(len(right), near)
            inner = self.library._encode_single_piece(b"".join(tokens[i] for i in left[a:] + right[:b]))
            if (a == 0 or self._final(left[a - 1], inner[0])) and (b == len(right) or self._final(inner[-1], right[b])):
                return left[:a] + inner + right[b:]
            near *= 2

    def _final(self, a: int, b: int) -> bool:
        return self.library._encode_single_piece(self.tokens[a] + self.tokens[b]) == [a, b]

    def decode(self, ids: list[int], leaf: int = 4096) -> bytes:
        if len(ids) <= leaf:
            return b"".join([self.tokens[i] for i in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


def _is_cut(text: str, at: int) -> bool:
    return text[at].isspace() and not text[at - 1].isspace() and text[at] not in "\x1c\x1d\x1e\x1f"


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per row ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (array<int>).

    ``ranks`` is the content of a rank file, read once on the driver and sent with the tasks, so that executors need no
    file of their own. Null texts count as empty: no tokens, digests of nothing. Ids may be null or repeated; an empty
    table gives no rows. One row is in memory at a time beyond the Arrow batch.
    """
    schema = f"doc_id long, {DIGEST}" + ", ids array<int>" * with_ids

    def encode(batches):
        codec = TreeCodec(read_ranks(ranks), pattern)
        names = [str(i) for i in range(len(codec.tokens))]
        for batch in batches:
            n, by_ids, by_bytes, all_ids = [], [], [], []
            for text in batch.column(1):
                ids = codec.encode(text.as_py() or "")
                n.append(len(ids))
                by_ids.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                by_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(np.array(ids, np.int32))  # a batch of Python integers would take nine times the room
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())]
            names_out = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = pa.array(np.cumsum([0, *map(len, all_ids)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int32), *all_ids])))
                columns, names_out = [*columns, lists], [*names_out, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give an empty text, bytes that are no UTF-8 the replacement sign."""

    def decode(batches):
        codec = TreeCodec(read_ranks(ranks), pattern)
        for batch in batches:
            texts = [codec.decode(ids.as_py() or []).decode(errors="replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return bounded_batches(encoded.select("doc_id", "ids")).mapInArrow(decode, "doc_id long, text string")
