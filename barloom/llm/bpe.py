"""Byte-level BPE by content-defined chunks, and decoding.

A text is cut where a rolling hash of its bytes says so, so that passages which
documents share give equal chunks. A chunk is encoded once and its ids are used
for every document that holds it; then the ids around each join are replaced by
those of a re-encoded stretch.

Where text ends and a blank begins is a token boundary in any text, and what
stands between two such places is encoded alike wherever it stands. A stretch
therefore runs from the last such place before the join to the first one after
it. It is encoded with one more run of blanks and word on both sides, and grows
until the ids of those agree exactly with the chunks' own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.batches import small_batches
from barloom.llm.tokens import byte_characters, encoder, public_vocabulary

#: A cut is made on average every 2 ** MASK_BITS bytes, none nearer than LEAST to the last.
MASK_BITS = 11
LEAST, MOST = 256, 32_768
#: Bytes of text whose chunks a worker remembers; the table is emptied when full.
REMEMBERED_BYTES = 48 << 20

_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29))
#: A byte that ends a word and the ASCII blank after it.
_EDGE = re.compile(rb"[!-~\x80-\xff](?=[ \n])")


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of a UTF-8 text; cuts depend on the 16 bytes before them and on the last cut."""
    if len(data) <= LEAST:
        return [len(data)]
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for width in (1, 2, 4, 8):
        h[width:] += h[:-width] << np.uint64(width)
    mask = np.uint64(((1 << MASK_BITS) - 1) << 20)
    # A cut stands before the byte, which must begin a character.
    marks = (np.nonzero((h[:-1] & mask) == 0)[0] + 1).tolist()
    ends, last = [], 0
    for m in marks:
        while m - last > MOST:
            last = _whole(data, last + MOST)
            ends.append(last)
        if m - last >= LEAST and data[m] & 0xC0 != 0x80:
            ends.append(m)
            last = m
    while len(data) - last > MOST:
        last = _whole(data, last + MOST)
        ends.append(last)
    return ends + [len(data)] if last < len(data) else ends


def _whole(data: bytes, at: int) -> int:
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


class ChunkEncoder:
    """Encodes and decodes whole texts; ids equal those of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.pieces = encoder("byte", path)
        self.tokenizer = self.pieces.tokenizer
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size()
        self.bytes = [self._bytes(i) for i in range(size)]
        self.widths = np.array([len(b) for b in self.bytes], np.int64)
        self.decimal = [str(i) for i in range(size)]
        self.known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def _bytes(self, i: int) -> bytes:
        token = self.tokenizer.id_to_token(i)
        if token in self.special:
            return token.encode()
        return bytes(_CHAR_BYTE[c] for c in token)

    def library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def chunk(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, their start bytes) of a chunk by itself."""
        if (found := self.known.get(data)) is not None:
            self.reused += 1
            return found
        self.encoded += 1
        ids = np.frombuffer(self.pieces.encode(data.decode()), "<i4")
        ends = np.cumsum(self.widths[ids])
        found = ids, np.concatenate([[0], ends])
        if self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        self.known[data] = found
        self.held += len(data)
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if any(s in text for s in self.special):
            return self.library(text)
        data = text.encode()
        ends = cut_points(data)
        if len(ends) == 1:
            return self.chunk(data)[0]
        ids, at, begin = [], [], 0
        for end in ends:
            i, starts = self.chunk(data[begin:end])
            ids.append(i)
            at.append(starts[:-1] + begin)
            begin = end
        ids, at = np.concatenate(ids), np.append(np.concatenate(at), len(data))
        return self._repaired(data, ids, at, ends[:-1])

    def _repaired(self, data: bytes, ids: np.ndarray, at: np.ndarray, joins: list[int]) -> np.ndarray:
        out, done = [], 0  # ids up to the byte ``done`` are in out
        for join in joins:
            if join < done:
                continue
            more = 1
            while True:
                a, z = self._edges(data, max(done, 0), join, more)
                new = self.tokenizer.encode_batch_fast([data[a:z].decode()], add_special_tokens=False)[0].ids
                new = np.array(new, np.int32)
                if self._agree(data, ids, at, new, a, z, done, join):
                    break
                more *= 2
            lo = int(np.searchsorted(at, done))
            out += [ids[lo : int(np.searchsorted(at, a))], new]
            done = z
        out.append(ids[int(np.searchsorted(at, done)) : len(ids)])
        return np.concatenate(out)

    @staticmethod
    def _edges(data: bytes, least: int, join: int, more: int) -> tuple[int, int]:
        """Bytes a < join <= z at word ends, ``more`` further words past the nearest on each side, or the ends."""
        reach = 64 * more
        while True:
            from_ = max(least, join - reach)
            before = [m.end() for m in _EDGE.finditer(data, from_, min(join + 1, len(data))) if m.end() < join]
            if len(before) > more or from_ == least:
                break
            reach *= 2
        a = before[-1 - more] if len(before) > more else least
        reach = 64 * more
        while True:
            to = min(len(data), join + reach)
            after = [m.end() for m in _EDGE.finditer(data, join, to)]
            if len(after) > more or to == len(data):
                break
            reach *= 2
        return a, after[more] if len(after) > more else len(data)

    def _agree(self, data: bytes, ids: np.ndarray, at: np.ndarray, new: np.ndarray, a: int, z: int, done: int, join: int) -> bool:
        """The stretch begins and ends with a word whose ids are those of the chunks (or at an end of the text)."""
        starts = np.concatenate([[0], np.cumsum(self.widths[new])]) + a
        left = a == done or self._same(ids, at, new, starts, a, min((m.end() for m in _EDGE.finditer(data, a + 1, min(join + 1, len(data)))), default=-1), join)
        edges = [m.end() for m in _EDGE.finditer(data, max(join, a), z)]
        edges = [e for e in edges if e < z]
        right = z == len(data) or (bool(edges) and self._same(ids, at, new, starts, edges[-1], z, None))
        return left and right

    @staticmethod
    def _same(ids, at, new, starts, a: int, z: int, join: int | None) -> bool:
        if z < 0 or (join is not None and z > join):
            return False
        i, j = np.searchsorted(at, [a, z])
        k, m = np.searchsorted(starts, [a, z])
        if j >= len(at) or at[i] != a or at[j] != z or m >= len(starts) or starts[k] != a or starts[m] != z:
            return False
        return np.array_equal(ids[i:j], new[k:m])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are not UTF-8 become replacement characters."""
        table = self.bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


_CHAR_BYTE = byte_characters()
_LOADED: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]


def bpe_round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """(id, n_tokens, ids, decoded) of each row; with ``digests`` (id, n_tokens, ids_sha256, decoded_sha256).

    Nothing is shuffled: a chunk is encoded once by each worker that meets it,
    while its bounded table holds it. Null and empty texts have no ids and decode
    to the empty text. Rows that share an id stay separate; other columns are left
    out.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def task(batches):
        coder = chunk_encoder(vocabulary)
        for b in batches:
            held, size = [], 0
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = coder.encode(text.as_py() or "")
                decoded = coder.decode(ids)
                if digests:
                    names = coder.decimal
                    listed = ",".join([names[i] for i in ids.tolist()])
                    held.append((doc_id, len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    held.append((doc_id, len(ids), ids.tolist(), decoded))
                size += len(decoded)
                if size > 4 << 20:
                    yield batch(held, b.schema.field(0).type)
                    held, size = [], 0
            if held:
                yield batch(held, b.schema.field(0).type)

    def batch(rows, id_type):
        kinds = (id_type, pa.int64(), pa.string(), pa.string()) if digests else (id_type, pa.int64(), pa.list_(pa.int32()), pa.string())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names_of)

    names_of = ["id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
    out = f"id {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(task, out)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_round_trip(docs, public_vocabulary("byte_bpe_50k.json"), digests=True).withColumnRenamed("id", "doc_id")
