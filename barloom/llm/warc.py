"""WARC archives, each record a Zstandard frame, with the dictionary in the file.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary
trained on the file's first records; each record follows as one frame, so that
any of them can be read alone at its offset. A payload that is repeated is stored
once; its other captures are revisit records.
"""

from __future__ import annotations

import re
import struct

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.batches import small_batches
from barloom.llm.bit_filter import filter_of, may_hold
from barloom.runtime import cut, fresh_path

MAGIC = 0x184D2A5D
LEAST_SHARED = 1000
#: Bits of the filter that tells which pages share their payload.
FILTER_BITS = 1 << 25
#: The dictionary is trained on this many bytes of a file's first records, each to SAMPLE_MOST bytes of it.
TRAIN_BYTES, SAMPLE_MOST, DICTIONARY_BYTES = 4 << 20, 16 << 10, 64 << 10
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_UNSAFE = re.compile(r"[^\x21-\x7e]")


# -- records ----------------------------------------------------------------


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _uri(url: str) -> str:
    """A header must stay on its line: blanks, controls and non-ASCII are percent-encoded."""
    return _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "surrogatepass")), url)


def build_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """A response record, or a revisit if payload is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if payload is None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    if payload is None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload), names in lower case; ValueError if it is malformed."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(warc["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    http_head, _, payload = rest[:n].partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http_head.decode("latin-1").split("\r\n")[1:])}
    return warc, http, payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary for records; empty if they are too few or too small to train one."""
    samples = [s[:SAMPLE_MOST] for s in samples]
    total = sum(map(len, samples))
    if len(samples) < 16 or total < 16 << 10:
        return b""
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, total // 8), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to a stream; holds TRAIN_BYTES of them until the dictionary is trained."""

    def __init__(self, out) -> None:
        self.out, self.at, self.waiting, self.held, self.packer = out, 0, [], 0, None

    def _start(self) -> list[tuple[int, int]]:
        trained = train([r for r in self.waiting])
        self._write(struct.pack("<II", MAGIC, len(trained)) + trained)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
        ready, self.waiting = self.waiting, []
        return [self._record(r) for r in ready]

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _record(self, record: bytes) -> tuple[int, int]:
        begin = self.at
        self._write(self.packer.compress(record))
        return begin, self.at - begin

    def add(self, record: bytes) -> list[tuple[int, int]]:
        """(offset, length) of the records written by now and not told before, in order."""
        if self.packer:
            return [self._record(record)]
        self.waiting.append(record)
        self.held += len(record)
        return self._start() if self.held >= TRAIN_BYTES else []

    def close(self) -> list[tuple[int, int]]:
        return [] if self.packer else self._start()


def read_archive(stream):
    """The records of one file, decompressed one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != MAGIC:
        raise ValueError("the file does not begin with a dictionary frame")
    trained = stream.read(size)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    held = b""
    while True:
        if not held and not (held := stream.read(1 << 20)):
            return
        one, parts = unpacker.decompressobj(), []
        while not one.eof:
            if not held and not (held := stream.read(1 << 20)):
                raise ValueError("the file ends within a record")
            parts.append(one.decompress(held))
            held = one.unused_data if one.eof else b""
        yield b"".join(parts)


# -- tables -----------------------------------------------------------------


def mark_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` with payload_bytes, payload_digest and refers_to (null for responses).

    Of rows whose payloads are equal and of LEAST_SHARED bytes or more, that with
    the largest id is the response, and so are rows that repeat its id or have
    none; the others refer to it. Digests that several rows have are found first,
    without the payloads. Only rows that a filter of FILTER_BITS bits takes for one
    of these meet them in a join; the payloads of the others stay where they were
    read. Beyond some ten million shared digests the filter lets all rows through.
    """
    body = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    sized = pages.withColumns({"payload_bytes": F.octet_length(body).cast("long"), "payload_digest": F.sha1(body)})
    shared = cut(
        sized.where(F.col("payload_bytes") >= LEAST_SHARED)
        .groupBy(F.col("payload_digest").alias("__digest"))
        .agg(F.max(id_col).alias("__latest"), F.count("*").alias("__n"))
        .where("__n > 1").drop("__n"),
        "warc-shared",
    )
    latest = shared.schema["__latest"].dataType
    bits = pages.sparkSession.sparkContext.broadcast(filter_of(shared.select(F.xxhash64("__digest")), FILTER_BITS))

    @F.pandas_udf("boolean")
    def maybe(names: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bits.value, names.to_numpy()))

    told = sized.withColumn("__maybe", (F.col("payload_bytes") >= LEAST_SHARED) & maybe(F.xxhash64("payload_digest")))
    met = told.where("__maybe").join(shared, F.col("payload_digest") == F.col("__digest"), "left")
    refers = F.when(F.col(id_col) < F.col("__latest"), F.col("__latest"))
    met = met.withColumn("refers_to", refers).select(*sized.columns, "refers_to")
    return met.union(told.where("not __maybe").select(*sized.columns, F.lit(None).cast(latest).alias("refers_to")))


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as files under ``path``; returns the index read from ``path/index``.

    A null html is an empty payload and a null url has no target header; rows with
    equal ids are records of their own. A task writes under its attempt's name and
    then renames. An empty table gives an empty index. Other columns are left out.
    """
    small_batches(pages.sparkSession)
    spark = pages.sparkSession
    kept = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = mark_revisits(kept).select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_bytes", "payload_digest", "refers_to")

    def task(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(f"{folder}/archives", recursive=True)
        at = TaskContext.get()
        name = f"part-{at.partitionId():06d}.warc.zst"
        draft = f"{folder}/archives/.{name}.{at.taskAttemptId()}"
        out = writer = None
        told: list[tuple[int | None, bool]] = []
        spans: list[tuple[int, int]] = []
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1), b.column(2), *(b.column(i).to_pylist() for i in (3, 4, 5))):
                if writer is None:
                    out = fs.open_output_stream(draft, compression=None)
                    writer = ArchiveWriter(out)
                page_id, url, html, size, digest, refers = row
                payload = None if refers is not None else (html.as_py() or "").encode()
                told.append((page_id, refers is not None))
                spans += writer.add(build_record(page_id, url.as_py(), payload, digest, size, refers))
        if writer is None:
            return
        spans += writer.close()
        out.close()
        fs.move(draft, f"{folder}/archives/{name}")
        for i in range(0, len(told), 10_000):
            ids, revisit = zip(*told[i : i + 10_000])
            offsets, lengths = zip(*spans[i : i + 10_000])
            yield pa.record_batch([pa.array([name] * len(ids)), pa.array(ids, pa.int64()), pa.array(revisit), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["file", "page_id", "revisit", "offset", "length"])

    rows.mapInArrow(task, "file string, page_id long, revisit boolean, offset long, length long").write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to."""
    files = spark.read.parquet(f"{path}/index").select("file").distinct()

    def number(value: str | None) -> int | None:
        digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def task(batches):
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        for b in batches:
            for file in b.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{folder}/archives/{file}", compression=None, buffer_size=1 << 20) as stream:
                    for record in read_archive(stream):
                        warc, http, payload = parse_record(record)
                        kind = warc["warc-type"]
                        rows.append((
                            number(warc["warc-record-id"]), warc.get("warc-target-uri"), None if kind == "revisit" else payload, int(http["content-length"]),
                            warc["warc-payload-digest"].removeprefix("sha1:"), kind, number(warc.get("warc-refers-to")),
                        ))
                        held += len(record)
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def batch(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(task, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    read = read_archives(spark, path)
    # A response's size and digest are those of the payload that was read.
    stored = F.col("payload").isNotNull()
    return read.select(
        "page_id",
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to",
    )


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
l AS (
  SELECT payload_digest, max(page_id) AS latest FROM p WHERE payload_bytes >= {LEAST_SHARED} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id < latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < latest THEN latest END AS refers_to
FROM p LEFT JOIN l USING (payload_digest)"""
