"""JSON results of any layout, by the documents' own spans.

A file may hold any number of documents one after the other, on a line, several
a line or over many lines: row objects, arrays of them, ``{"results": [...]}``.
Nothing is lost silently: what is no document comes back as a reject, with its
file, the number of its line and the reason.

Lines are read in parallel; a line that is a document by itself is done. Only a
file with some other line is read once more, in order, in one task: a document
is then parsed from its first line on, with twice as many lines each time, until
it ends. Where the text cannot be the beginning of a document, its first line is
a reject and the next line starts anew, so one bad line costs one line. Memory
is that of the longest document.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatewatch.session import scratch_path

FOUND = pa.schema([("file", pa.string()), ("line", pa.int64()), ("row", pa.string()), ("reject", pa.string()), ("reason", pa.string()),
                   ("again", pa.bool_())])
FOUND_SQL = "file string, line bigint, row string, reject string, reason string, again boolean"
REJECTS = "file string, line bigint, text string, reason string"
SPACE = " \t\r\n"


def rows_of(document: object) -> tuple[list[str], list[str]]:
    """(rows, values that are none) of a document, as JSON."""
    if isinstance(document, dict) and isinstance(document.get("results"), list):
        document = document["results"]
    every = document if isinstance(document, list) else [document]
    return [json.dumps(r) for r in every if isinstance(r, dict)], [json.dumps(r) for r in every if not isinstance(r, dict)]


class Documents:
    """Documents of one file, fed line by line."""

    def __init__(self) -> None:
        self.decode = json.JSONDecoder().raw_decode
        self.lines: list[str] = []
        self.first = 1  # number of the first line held
        self.next = 1  # lines at which to try again

    def feed(self, line: str) -> Iterator[tuple[int, object, str | None, str | None]]:
        """(line, document, None, None) or (line, None, rejected text, reason)."""
        self.lines.append(line)
        if len(self.lines) >= self.next:
            yield from self._take(False)

    def close(self) -> Iterator[tuple[int, object, str | None, str | None]]:
        yield from self._take(True)

    def _take(self, ended: bool) -> Iterator[tuple[int, object, str | None, str | None]]:
        text, at = "\n".join(self.lines), 0
        number, counted = self.first, 0
        self.lines, self.next = [], 1
        full = len(text.rstrip(SPACE))
        while True:
            while at < full and text[at] in SPACE:
                at += 1
            number, counted = number + text.count("\n", counted, at), at
            if at >= full:
                self.first = number + text.count("\n", counted) + 1
                return
            try:
                document, at_end = self.decode(text, at)
                yield number, document, None, None
                at = at_end
                continue
            except json.JSONDecodeError as e:
                open_ended, reason = e.pos >= full, e.msg
            except RecursionError:
                open_ended, reason = False, "nested too deeply"
            if open_ended and not ended:
                rest = text[at:]
                self.lines = rest.split("\n")
                self.first, self.next = number, 2 * len(self.lines)
                return
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            yield number, None, text[at:end].rstrip(SPACE), reason
            at = end


def _by_line(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that are documents by themselves; of the others only that there is one."""
    for b in batches:
        out: list[dict] = []
        for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            text = line.strip(SPACE)
            if not text:
                continue
            try:
                document = json.loads(text)
            except (json.JSONDecodeError, RecursionError):
                out.append({"file": file, "again": True})
                continue
            rows, others = ([text], []) if isinstance(document, dict) and "results" not in document else rows_of(document)
            out += [{"file": file, "row": r, "again": False} for r in rows]
            out += [{"file": file, "reject": r, "reason": "not a row", "again": False} for r in others]
        yield pa.RecordBatch.from_pylist(out, FOUND)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of whole files, in order -> their rows and rejects."""
    name, docs = None, Documents()

    def say(found: Iterator) -> list[dict]:
        out = []
        for number, document, text, reason in found:
            if reason is not None:
                out.append({"file": name, "line": number, "reject": text, "reason": reason, "again": False})
                continue
            rows, others = rows_of(document)
            out += [{"file": name, "line": number, "row": r, "again": False} for r in rows]
            out += [{"file": name, "line": number, "reject": r, "reason": "not a row", "again": False} for r in others]
        return out

    for b in batches:
        out: list[dict] = []
        for file, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if file != name:
                out += say(docs.close())
                name, docs = file, Documents()
            out += say(docs.feed(line))
        yield pa.RecordBatch.from_pylist(out, FOUND)
    yield pa.RecordBatch.from_pylist(say(docs.close()), FOUND)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows in ``schema``, rejects: file, line, text, reason). A field of a row
    that does not fit its type is null. Lines are numbered where a file was read
    in order, and null elsewhere. A missing path has neither."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema), spark.createDataFrame([], REJECTS)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("block"),
                                         F.monotonically_increasing_id().alias("at"))
    kept = scratch_path(spark, "json-lines")
    lines.select("file", "value").mapInArrow(_by_line, FOUND_SQL).write.parquet(kept)
    found = spark.read.schema(FOUND_SQL).parquet(kept)
    again = found.where("again").select(F.col("file").alias("gw_file")).distinct()
    ordered = lines.join(again, F.col("file") == F.col("gw_file"), "left_semi").repartition("file").sortWithinPartitions("file", "block", "at") \
        .select("file", "value").mapInArrow(_in_order, FOUND_SQL)
    every = found.join(again, F.col("file") == F.col("gw_file"), "left_anti").unionByName(ordered)
    whole = scratch_path(spark, "json-documents")
    every.write.parquet(whole)
    every = spark.read.schema(FOUND_SQL).parquet(whole)
    rows = every.where("row IS NOT NULL").select(F.from_json("row", schema).alias("r")).select("r.*")
    return rows, every.where("reason IS NOT NULL").select("file", "line", F.col("reject").alias("text"), "reason")
