"""Token-id files with Elias-Fano document boundaries.

Documents are dealt to ranges of ``doc_id``, sorted, and tokenised; each task
streams the ids of its documents (an end id after each) into files under the
cluster's shared folder. A file is

    ids (2 or 4 bytes each, little-endian) | boundaries | doc ids | footer

Boundaries are the cumulative ends of the documents, Elias-Fano coded: the low
``l = floor(log2(ids / documents))`` bits packed, the rest as a unary bit
string, about 2 + l bits a document, plus a 32-bit position of every 256th one
bit. ``select`` answers "where does document i end" from these alone; no table
of 64-bit offsets is stored or built. The sorted doc ids are coded the same way.

A file's name holds the task attempt that wrote it, and only the manifest (a
Parquet table, so committed once) says which files count: a lost executor or a
repeated task leaves files that nobody reads. Files are opened through
``pyarrow.fs``, so the shared folder may be in any store it can reach.

Texts are encoded whole; for a byte-level BPE by their distinct pre-tokens
(``pre_tokens``), in a memory that a Python worker keeps from task to task.

Defined results: null text is empty (the end id only); null doc_ids come
first; rows under one doc_id are ordered by a hash of their text; repeated
rows are kept;
strings of special tokens in a text are ordinary text; an empty table has an
empty manifest. ``doc_id`` must be an integer column.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from gatewatch.llm.frames import written
from gatewatch.llm.pre_tokens import Encoder, cuts_by_pre_tokens
from gatewatch.session import scratch_path

PART_IDS = 1 << 25
PART_DOCS = 1 << 20
READ_IDS = 1 << 21
ENCODE_BYTES = 1 << 18  # a worker holds some 60 bytes for each of these
EVERY = 256
BLOCK = 1024
MAGIC = b"TOKENS01"
FOOTER = "<8sHHqqqqqqq"


# --- Elias-Fano -----------------------------------------------------------

class EliasFano:
    """A sorted sequence of non-negative integers in about 2 + log2(last / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        last = int(v[-1]) if n else 0
        low_bits = max(0, (last // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if low_bits and n:
            planes = np.empty((n, low_bits), np.uint8)
            for b in range(low_bits):
                planes[:, b] = (v >> np.uint64(b)) & np.uint64(1)
            low = np.packbits(planes.ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(ones[-1]) + 1) if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), ones[::EVERY].astype(np.uint32))

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.uint64)
        at = first * self.low_bits
        span = np.unpackbits(self.low[at // 8:(at + count * self.low_bits + 7) // 8], bitorder="little")
        planes = span[at % 8:at % 8 + count * self.low_bits].reshape(count, self.low_bits).astype(np.uint64)
        return (planes << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, first: int, count: int = 1) -> np.ndarray:
        """Values first .. first + count - 1: from the sample before, one bits are counted in the bit string."""
        if count <= 0:
            return np.zeros(0, np.uint64)
        s = first // EVERY
        begin = int(self.samples[s]) // 8
        after = (first + count - 1) // EVERY + 1
        end = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[begin:end], bitorder="little")) + begin * 8
        skip = int(np.searchsorted(ones, int(self.samples[s]))) + first - s * EVERY
        place = ones[skip:skip + count] - np.arange(first, first + count)
        return (place.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(first, count)

    def to_bytes(self) -> bytes:
        head = struct.pack("<qqqq", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = struct.unpack_from("<qqqq", raw)
        part = np.frombuffer(raw, np.uint8, offset=32)
        return cls(n, low_bits, part[:n_low], part[n_low:n_low + n_high], np.frombuffer(raw, "<u4", offset=32 + n_low + n_high))


# --- files ----------------------------------------------------------------

def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


class TokenWriter:
    """One file; ``add`` takes documents in ascending order, ``close`` writes the boundaries."""

    def __init__(self, uri: str, width: int):
        store, path = _store(uri)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.width = store.open_output_stream(path), width
        self.doc_ids: list[int] = []
        self.sizes: list[int] = []
        self.nulls = self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.sizes.append(len(ids) // self.width)
        self.n_ids += self.sizes[-1]
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> None:
        base = self.doc_ids[0] if self.doc_ids else 0
        ends = EliasFano.encode(np.cumsum(np.array(self.sizes, np.int64))).to_bytes()
        ids = EliasFano.encode(np.array([d - base for d in self.doc_ids], np.uint64)).to_bytes()
        self.out.write(ends + ids)
        self.out.write(struct.pack(FOOTER, MAGIC, 1, self.width, len(self.sizes), self.n_ids, self.nulls, base, len(ends), len(ids), 0))
        self.out.close()


class TokenReader:
    """Random access to one file through its select structures."""

    def __init__(self, uri: str):
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        magic, _, self.width, self.n_docs, self.n_ids, self.nulls, self.base, n_ends, n_docs, _ = struct.unpack(
            FOOTER, self.file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        at = self.n_ids * self.width
        self.ends = EliasFano.from_bytes(self.file.read_at(n_ends, at))
        self.ids = EliasFano.from_bytes(self.file.read_at(n_docs, at + n_ends))

    def offsets(self, first: int, count: int) -> np.ndarray:
        """count + 1 boundaries around documents first .. first + count - 1."""
        if first:
            return self.ends.select(first - 1, count + 1).astype(np.int64)
        return np.r_[np.int64(0), self.ends.select(0, count).astype(np.int64)]

    def doc_ids(self, first: int, count: int) -> list[int | None]:
        empty = max(0, min(self.nulls - first, count))
        return [None] * empty + [self.base + int(x) for x in self.ids.select(first + empty - self.nulls, count - empty)]

    def tokens(self, begin: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - begin) * self.width, begin * self.width)
        return np.frombuffer(raw, f"<u{self.width}")

    def runs(self, limit: int = READ_IDS) -> Iterator[tuple[int, np.ndarray]]:
        """(first document, boundaries) of runs of whole documents of about ``limit`` ids."""
        first = 0
        while first < self.n_docs:
            off = self.offsets(first, min(self.n_docs - first, 4096))
            n = max(1, int(np.searchsorted(off, off[0] + limit, "right")) - 1)
            yield first, off[:n + 1]
            first += n


# --- on Spark ----------------------------------------------------------------

def _runs_of_rows(column: pa.Array, limit: int = ENCODE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text, whole rows each."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.r_[0, np.cumsum(size)]
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 0, folder: str | None = None,
                      part_ids: int = PART_IDS, part_docs: int = PART_DOCS) -> DataFrame:
    """Files of ``docs`` (doc_id, text) under ``folder`` (a fresh one in the
    shared folder if none is given) -> the manifest, written: part, seq, file,
    n_docs, n_ids; ascending (part, seq) is ascending doc_id."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column")
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()  # a vocabulary: of the size of its file, whatever the corpus
    tokenizer = json.loads(spec)
    width = 2 if max(len(tokenizer["model"]["vocab"]) + len(tokenizer.get("added_tokens", [])), end_id + 1) <= 1 << 16 else 4
    by_parts = cuts_by_pre_tokens(tokenizer)
    shared = spark.sparkContext.broadcast({"spec": spec})  # also holds the worker's encoder
    folder = (folder or scratch_path(spark, "tokens")).rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, out, files = TaskContext.get(), None, None, []
        part = task.partitionId()

        def shut() -> None:
            out.close()
            files.append({"part": part, "seq": len(files), "file": name, "n_docs": len(out.sizes), "n_ids": out.n_ids})

        for b in batches:
            if encoder is None:
                held = shared.value
                encoder = held["encoder"] = held.get("encoder") or Encoder(held["spec"], end_id, width, by_parts)
            for lo, hi in _runs_of_rows(b.column(1)):
                ids = b.column(0)[lo:hi].to_pylist()
                texts = [t or "" for t in b.column(1)[lo:hi].to_pylist()]
                for doc_id, coded in zip(ids, encoder.encode(texts)):
                    if out is None:
                        name = f"part-{part:06d}-{len(files):05d}-{task.taskAttemptId()}.tok"
                        out = TokenWriter(f"{folder}/{name}", width)
                    out.add(doc_id, coded)
                    if out.n_ids >= part_ids or len(out.sizes) >= part_docs:
                        shut()
                        out = None
        if out is not None:
            shut()
        if files:
            yield pa.RecordBatch.from_pylist(files, schema)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    # equal rows may lie in any order, so a row number splits them over tasks
    rows = docs.select("doc_id", "text").repartitionByRange("doc_id", F.xxhash64("text"), F.monotonically_increasing_id()) \
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    files = rows.mapInArrow(run, "part int, seq int, file string, n_docs bigint, n_ids bigint")
    return written(files.withColumn("file", F.concat(F.lit(folder + "/"), "file")), "manifest")


def with_starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with ``start``: ids in all files before. Running sums inside
    blocks of ``BLOCK`` parts; the driver sees one total a block."""
    block = F.floor(F.col("part") / BLOCK).alias("block")
    inner = F.sum("n_ids").over(Window.partitionBy("block").orderBy("part", "seq")) - F.col("n_ids")
    totals = sorted(manifest.groupBy(block).agg(F.sum("n_ids").alias("n")).collect())
    ahead, rows = 0, []
    for b, n in totals:
        rows.append((b, ahead))
        ahead += n
    before = manifest.sparkSession.createDataFrame(rows, "block bigint, before bigint")
    return manifest.withColumn("block", block).withColumn("inner", inner).join(F.broadcast(before), "block") \
        .withColumn("start", F.col("before") + F.col("inner")).drop("block", "inner", "before")


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents
    before), n_tokens, ids_crc32 (of the ids as unsigned 32-bit integers), and
    with ``with_ids`` the ids themselves. One task a file."""
    n = max(1, manifest.count())
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def crc(reader: TokenReader, begin: int, end: int) -> int:
        have = 0
        for at in range(begin, end, READ_IDS):  # a document longer than a run
            have = zlib.crc32(reader.tokens(at, min(end, at + READ_IDS)).astype("<u4").tobytes(), have)
        return have

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reader = TokenReader(file)
                for first, off in reader.runs():
                    count = len(off) - 1
                    if int(off[-1] - off[0]) > 2 * READ_IDS and not with_ids:
                        sums, ids = [crc(reader, int(off[0]), int(off[1]))], None
                    else:
                        ids = reader.tokens(int(off[0]), int(off[-1]))
                        raw = memoryview(ids.astype("<u4").tobytes())
                        cut = (4 * (off - off[0])).tolist()
                        sums = [zlib.crc32(raw[x:y]) for x, y in zip(cut, cut[1:])]
                    columns = [pa.array(reader.doc_ids(first, count), pa.int64()), pa.array(off[:-1] + start),
                               pa.array(np.diff(off)), pa.array(sums, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(off - off[0], pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names)

    files = with_starts(manifest).select("file", "start").repartition(n)
    kind = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return files.mapInArrow(run, kind)


def fetch(spark: SparkSession, manifest: DataFrame, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents, through the select structures of the files that hold them."""
    found: dict[int, np.ndarray] = {}
    wanted = sorted(set(doc_ids))
    for file in manifest.orderBy("part", "seq").toLocalIterator():
        reader = TokenReader(file["file"])
        coded = reader.n_docs - reader.nulls
        for d in wanted:
            lo, hi = 0, coded  # binary search by select
            while lo < hi:
                mid = (lo + hi) // 2
                if reader.base + int(reader.ids.select(mid)[0]) < d:
                    lo = mid + 1
                else:
                    hi = mid
            if d not in found and lo < coded and reader.base + int(reader.ids.select(lo)[0]) == d:
                begin, end = reader.offsets(reader.nulls + lo, 1).tolist()
                found[d] = reader.tokens(begin, end)
    return found
