"""Fill-in-middle samples; the cuts come from a set of token boundaries in array, bitmap and run containers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.llm.common import bounded_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Of 100 hash values so many give no plain sample, and of those so many the order suffix, prefix, middle.
SHAPED_PERCENT, SPM_PERCENT = 90, 20

CONTAINER = 1 << 16
BITMAP_BYTES = CONTAINER // 8


class ArrayContainer:
    """The places themselves."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class RunContainer:
    """Starts of runs of neighbouring places, and how many places lie before each run."""

    def __init__(self, places: np.ndarray, starts: np.ndarray):
        self.starts, self.before = places[starts].astype(np.uint16), starts.astype(np.uint16)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


class BitmapContainer:
    """One bit per place, and how many bits are set before each word of 64."""

    def __init__(self, places: np.ndarray):
        bits = np.zeros(CONTAINER, bool)
        bits[places] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        left, bits = k - int(self.before[word]), int(self.words[word])
        for _ in range(left):
            bits &= bits - 1
        return 64 * word + (bits & -bits).bit_length() - 1


def container(places: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest of the three forms for ascending places below 2^16."""
    starts = np.flatnonzero(np.diff(places, prepend=-2) != 1)
    sizes = {RunContainer: 4 * len(starts), ArrayContainer: 2 * len(places), BitmapContainer: BITMAP_BYTES}
    kind = min(sizes, key=sizes.get)
    return RunContainer(places, starts) if kind is RunContainer else kind(places)


class BoundarySet:
    """The offsets at which a text can be cut between tokens, both ends included, in code points.

    A letter run of A-Z and a-z is one token, every other code point is one. Each container covers 2^16 offsets; one
    search over the counts before the containers finds the container of the kth offset, which then selects it.
    """

    def __init__(self, text: str):
        self.keys, self.containers, counts, inside = [], [], [], False
        for at in range(0, len(text) + 1, CONTAINER):
            chars = np.frombuffer(text[at : at + CONTAINER].encode("utf-32-le", "surrogatepass"), "<u4")
            letters = ((chars | 32) - np.uint32(97)) < 26
            follows = np.concatenate([[inside], letters[:-1]])[: len(letters)]
            places = np.flatnonzero(~(letters & follows))
            if at + CONTAINER > len(text):  # the end of the text
                places = np.append(places, len(chars))
            inside = bool(len(letters)) and bool(letters[-1])
            if len(places):
                self.keys.append(at)
                self.containers.append(container(places))
                counts.append(len(places))
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The kth offset, counted from 0: the length of the first k tokens."""
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return self.keys[at] + self.containers[at].select(k - int(self.before[at]))


def draws(doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(b"1:" + (b"" if doc_id is None else b"%d" % doc_id)).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def arranged(doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """Tokens, form, code points of prefix and middle (None if plain) and the sample of one text."""
    cuts = BoundarySet(text)
    n = len(cuts) - 1
    first, second, shape, order = draws(doc_id)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or shape % 100 >= SHAPED_PERCENT:
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = cuts.select(low), cuts.select(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row.

    Null texts are empty; an empty text has n = 0 and is plain. A null doc_id draws as if its digits were absent. Rows with
    the same doc_id draw the same numbers, equal rows give equal samples, and each row gives one. Texts of any length are cut
    by their whole boundary set. Only doc_id and text are read, so no other column can clash. An empty table gives no rows.
    """

    def arrange(batches):
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1))
            made = [(i, *arranged(i, text.as_py() or "")) for i, text in rows]
            columns = zip(*made) if made else [[]] * 6
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types)],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return bounded_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(arrange, schema)


def restored(output: Column, form: Column) -> Column:
    """The text of a sample. Its parts hold no sentinel, and none of the three begins as it ends, so the first one found is right."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.split(F.substr(output, F.lit(len(first) + 1)), second, 2)
        rest = F.split(body[1], MIDDLE, 2)
        return body[0], rest[0], rest[1]

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)
