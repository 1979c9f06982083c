"""Length-delimited binary records of token ids, with an offset index.

A file is a run of frames: the payload's length (uint64), the masked CRC-32C of
those eight bytes (uint32), the payload, and the payload's masked CRC-32C
(uint32), all little-endian. A payload is a header (int64 doc_id, uint8 flags,
uint8 bytes per id, uint32 count) and the ids. The index, a table beside the
files, has file, offset and length of each record, for shuffled reads (``read_at``).
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.batches import small_batches
from barloom.llm.tokens import encoder, public_vocabulary
from barloom.runtime import fresh_path

_HEAD = struct.Struct("<qBBI")
_LENGTH = struct.Struct("<QI")
NO_ID = 1
_TABLE_BYTES = 2048
#: Files that a task of ``read_at`` keeps open.
OPEN_FILES = 32


def _step_table() -> np.ndarray:
    """CRC-32C of a byte, by the reflected Castagnoli polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0x82F63B78), c >> 1)
    return c


class Crc32c:
    """CRC-32C by tables: T[k][b] is what byte b adds when k bytes follow it."""

    def __init__(self) -> None:
        step = _step_table()
        rows = [step]
        for _ in range(_TABLE_BYTES - 1):
            c = rows[-1]
            rows.append((c >> 8) ^ step[c & 255])
        # Rows in the order of a block's bytes: the last byte has none after it.
        self.table = np.stack(rows[::-1])
        self.flat = np.ascontiguousarray(self.table).ravel()
        self.at = np.arange(_TABLE_BYTES, dtype=np.int64) * 256

    def __call__(self, data: bytes) -> int:
        raw = np.frombuffer(data, np.uint8)
        crc = 0xFFFFFFFF
        for i in range(0, len(raw), _TABLE_BYTES):
            part = raw[i : i + _TABLE_BYTES].astype(np.int64)
            head = min(4, len(part))
            n = len(part)
            part[:head] ^= np.frombuffer(struct.pack("<I", crc), np.uint8)[:head]
            crc = int(np.bitwise_xor.reduce(self.flat[part + self.at[_TABLE_BYTES - n :]])) ^ (crc >> (8 * head) if head < 4 else 0)
        return crc ^ 0xFFFFFFFF


_CRC: list[Crc32c] = []


def masked_crc(data: bytes) -> int:
    if not _CRC:
        _CRC.append(Crc32c())
    c = _CRC[0](data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked_crc(n)), payload, struct.pack("<I", masked_crc(payload))))


def payload_of(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    head = _HEAD.pack(doc_id or 0, NO_ID if doc_id is None else 0, width, len(ids))
    return head + ids.astype(f"<u{width}").tobytes()


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags, width, n = _HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", n, _HEAD.size)
    return None if flags & NO_ID else doc_id, ids.astype("<u4")


def read_frame(stream) -> bytes | None:
    """The next payload, or None at the end; ValueError if a checksum is wrong or bytes lack."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12:
        raise ValueError("the file ends within a frame")
    n, crc = _LENGTH.unpack(head)
    if crc != masked_crc(head[:8]):
        raise ValueError("a length's checksum is wrong")
    body = stream.read(n + 4)
    if len(body) < n + 4:
        raise ValueError("the file ends within a frame")
    if struct.unpack("<I", body[n:])[0] != masked_crc(body[:n]):
        raise ValueError("a payload's checksum is wrong")
    return body[:n]


def write_records(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` into record files under ``path``; returns the index, read from ``path/index``.

    Files follow ascending id (null ids first, equal ids in any order), each file
    one range of ids, and of hashes of the texts where many rows share an id, and
    sorted within; ``end_id`` ends each document. A null or
    empty text gives that id alone. A task writes under a name of its own attempt
    and then renames, so a repeated task replaces the same file. Other columns are
    left out. An empty table gives an empty index.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession

    def task(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(f"{folder}/records", recursive=True)
        encode = encoder("byte", vocabulary).encode
        at = TaskContext.get()
        name = f"part-{at.partitionId():06d}.rec"
        draft = f"{folder}/records/.{name}.{at.taskAttemptId()}"
        out, offset, index = None, 0, []
        end = np.array([end_id], "<u4")
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                if out is None:
                    out = fs.open_output_stream(draft, compression=None)
                ids = np.concatenate([np.frombuffer(encode(text.as_py() or ""), "<u4"), end])
                framed = frame(payload_of(doc_id, ids))
                out.write(framed)
                index.append((doc_id, offset, len(framed), len(ids)))
                offset += len(framed)
        if out is None:
            return
        out.close()
        fs.move(draft, f"{folder}/records/{name}")
        for i in range(0, len(index), 10_000):
            ids_, offsets, lengths, tokens = zip(*index[i : i + 10_000])
            yield pa.record_batch(
                [pa.array([name] * len(ids_)), pa.array(ids_, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array(tokens, pa.int64())],
                names=["file", "doc_id", "offset", "length", "n_tokens"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id")
    ordered.mapInArrow(task, "file string, doc_id long, offset long, length long, n_tokens long").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, doc_id, start, n_tokens, ids) of all records, each checksum verified.

    ids are little-endian uint32 bytes; start counts the ids of all records before
    it. The index's totals give each file its start: a row per file.
    """
    files = spark.read.parquet(f"{path}/index").groupBy("file").agg(F.sum("n_tokens").alias("n"), F.sum("length").alias("bytes"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "bytes")

    def task(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        for b in batches:
            for file, start, size in zip(*(b.column(i).to_pylist() for i in range(3))):
                with fs.open_input_stream(f"{folder}/records/{file}", compression=None, buffer_size=1 << 20) as stream:
                    rows, held, seen = [], 0, 0
                    while (payload := read_frame(stream)) is not None:
                        doc_id, ids = parse(payload)
                        rows.append((file, doc_id, start, len(ids), ids.tobytes()))
                        start += len(ids)
                        held += len(payload)
                        seen += len(payload) + 16
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if seen != size:
                        raise ValueError(f"{file} holds {seen} bytes; its index says {size}")
                    if rows:
                        yield batch(rows)

    def batch(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "doc_id", "start", "n_tokens", "ids"])

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(task, "file string, doc_id long, start long, n_tokens long, ids binary")


def read_at(index: DataFrame, path: str) -> DataFrame:
    """(file, offset, doc_id, n_tokens, ids) of the records that rows of the index name, in the order of these rows.

    ``index`` is any selection of the index under ``path``, in any order, such as
    one dealt anew for training; a row that occurs twice is read twice. A task
    seeks to each record, so it reads no others, and keeps a few files open. Fails
    on a wrong checksum and where the index and a record disagree. An empty
    selection gives an empty table; other columns are left out.
    """

    def task(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        held: dict[str, pa.NativeFile] = {}
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = []
                for file, doc_id, offset, length, tokens in zip(*(c.to_pylist() for c in b.slice(i, 256).columns)):
                    if file not in held:
                        if len(held) >= OPEN_FILES:
                            held.pop(next(iter(held))).close()
                        held[file] = fs.open_input_file(f"{folder}/records/{file}")
                    held[file].seek(offset)
                    found, ids = parse(read_frame(io.BytesIO(held[file].read(length))) or b"")
                    if found != doc_id or len(ids) != tokens:
                        raise ValueError(f"{file} has another record at {offset} than its index says")
                    rows.append((file, offset, doc_id, tokens, ids.tobytes()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "offset", "doc_id", "n_tokens", "ids"])
        for stream in held.values():
            stream.close()

    return index.select("file", "doc_id", "offset", "length", "n_tokens").mapInArrow(task, "file string, offset long, doc_id long, n_tokens long, ids binary")


def ids_crc(ids: str = "ids"):
    return F.crc32(F.col(ids))


def op6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = fresh_path(spark, "records")
    write_records(docs, path, public_vocabulary("byte_bpe_50k.json"))
    return read_records(spark, path).select("doc_id", "start", "n_tokens", ids_crc().alias("ids_crc32"))
