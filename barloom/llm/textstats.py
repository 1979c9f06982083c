"""Counts of one whole text, and the labelled rows that models are fitted on."""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANKS = " \t\n\x0b\x0c\r"
#: The largest number of a word, three of which make one exact 63-bit key, and the words that a worker keeps numbered.
_MOST_WORDS, _KEPT_WORDS = (1 << 21) - 1, 200_000


class _Numbers(dict):
    """Word -> number, with a stable 32-bit hash for each number."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros(_MOST_WORDS + 1, np.uint32)

    def __missing__(self, word: str) -> int:
        n = len(self)
        self.hashes[n] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        self[word] = n
        return n


_NUMBERS: list[_Numbers] = []


def _numbered(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, hashes) of the words; equal numbers exactly for equal words."""
    if not _NUMBERS:
        _NUMBERS.append(_Numbers())
    table = _NUMBERS[0]
    if len(table) > _KEPT_WORDS:
        table.clear()
    if len(words) > _MOST_WORDS // 2:  # a text of over a million words numbers its own
        own: dict[str, int] = {}
        numbers = np.array([own.setdefault(w, len(own)) for w in words], np.int64)
        hashes = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in own], np.uint32)
        return numbers, hashes[numbers]
    numbers = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
    return numbers, table.hashes[numbers]


class TextStats:
    """Exact counts over a whole text; a null text counts as empty.

    n_words: runs of anything but ASCII blanks. word_chars: code points in them.
    n_symbols: characters of ``#*$%&|<>``. n_dup_lines: lines with a word, equal to
    an earlier line. n_repeat_words: words that stand in some three-word window
    found twice or more in the text.
    """

    __slots__ = ("bytes", "counts", "hashes", "lines", "n_dup_lines", "n_repeat_words", "n_symbols", "n_words", "numbers", "text", "word_chars")

    def __init__(self, text: str | None) -> None:
        self.text = text = text or ""
        words = WORD.findall(text)
        self.bytes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        self.counts = c = np.bincount(self.bytes, minlength=256)
        self.n_words = len(words)
        self.word_chars = int(len(self.bytes) - c[0x80:0xC0].sum() - c[9:14].sum() - c[32])
        self.n_symbols = int(sum(c[ord(x)] for x in "#*$%&|<>"))
        lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
        self.lines = len(lines)
        self.n_dup_lines = len(lines) - len(set(lines))
        self.numbers, self.hashes = _numbered(words)
        self.n_repeat_words = self._repeated()

    def code_points(self) -> np.ndarray:
        if len(self.bytes) == len(self.text):
            return self.bytes.astype(np.uint32)
        return np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _repeated(self) -> int:
        n = self.numbers
        if len(n) < 4:
            return 0
        if n.max() > _MOST_WORDS:
            _, pairs = np.unique((n[:-1] << 32) | n[1:], return_inverse=True)
            keys = (pairs[:-1].astype(np.int64) << 32) | n[2:]
        else:
            keys = (n[:-2] << 42) | (n[1:-1] << 21) | n[2:]
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        again = times[which] > 1
        covered = np.zeros(len(n), bool)
        for k in range(3):
            covered[k : k + len(again)] |= again
        return int(covered.sum())


def held_out(id_col: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, quality) of at most ``per_class`` labelled ids of each class, and the classes' whole sizes.

    Ids are taken in order of a hash, never held-out ones; an id labelled twice
    counts once, as its lower quality, and so does one that several documents have,
    with the least of their texts. So 2 * per_class rows come out at most, as many
    as the label side that is broadcast.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
    )
    sizes = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    taken = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    rows = taken[0].union(taken[1]).select(F.col("doc_id").alias("__id"), "quality")
    known_docs = docs.select("doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("__id"))
    return known_docs.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("doc_id", "text", "quality"), sizes
