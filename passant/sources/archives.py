"""Zipped corpora of any size: archives as rows of bytes, inflated piece by piece.

An archive's bytes are read by Spark's text scan with a line feed as separator, which any file system of Spark's serves
and which splits a file like any other; what lies between two line feeds is kept as it is. Pieces are put together to
chunks of about a megabyte where they are read, and each archive's chunks are brought in order. A deflate stream has no
places to start in the middle, so one task inflates an archive, holding a chunk, its window and a batch of lines at a
time, whatever the archive's size; its lines are dealt out to all tasks again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a chunk, and lines and bytes of a batch that is handed on.
CHUNK, LINES_A_BATCH, BYTES_A_BATCH = 1 << 20, 20_000, 8 << 20
#: Fixed values of the format: a local header's signature and length, and the number of the deflate method.
SIGNATURE, HEADER, DEFLATE = b"PK\x03\x04", 30, 8


def archive_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """archive (its path), block (where a split starts), seq and data: the bytes of files, in order of block and seq.

    A line feed follows the last byte of a file; it lies behind the archive's directory.
    """
    scan = spark.read.option("lineSep", "\n").text(path)
    pieces = scan.select(F.col("_metadata.file_path").alias("archive"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("data"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size, seq = None, [], 0, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([seq]), pa.array([b"\n".join([*held, b""])], pa.binary())], ["archive", "block", "seq", "data"])

        for batch in batches:
            for *place, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (place != now or size >= chunk):
                    yield row()
                    held, size, seq = [], 0, seq + 1 if place == now else 0
                now = place
                held.append(data)
                size += len(data) + 1
        if held:
            yield row()

    return pieces.mapInArrow(join, "archive string, block long, seq long, data binary")


class Inflater:
    """The lines of an archive's first member from its bytes in turn."""

    def __init__(self) -> None:
        self.head, self.rest, self.inflate, self.over = b"", b"", None, False

    def feed(self, data: bytes) -> Iterator[list[bytes]]:
        """The lines that are whole now, without blank ones, some at a time, however well they were compressed."""
        if self.over:
            return
        if self.inflate is None:
            self.head += data
            if len(self.head) < HEADER:
                return
            if self.head[:4] != SIGNATURE or int.from_bytes(self.head[8:10], "little") != DEFLATE:
                raise ValueError("not an archive whose first member is deflated")
            begin = HEADER + int.from_bytes(self.head[26:28], "little") + int.from_bytes(self.head[28:30], "little")
            if len(self.head) < begin:
                return
            self.inflate, data, self.head = zlib.decompressobj(-15), self.head[begin:], b""
        while data and not self.over:
            *whole, self.rest = (self.rest + self.inflate.decompress(data, BYTES_A_BATCH)).split(b"\n")
            yield [x for x in whole if x.strip()]
            data, self.over = self.inflate.unconsumed_tail, self.inflate.eof

    def last(self) -> list[bytes]:
        """A last line without a line feed."""
        if self.head:
            raise ValueError("not an archive whose first member is deflated")
        rest = self.rest + (self.inflate.flush() if self.inflate and not self.over else b"")
        return [x for x in rest.split(b"\n") if x.strip()]


def inflated_lines(chunks: DataFrame) -> DataFrame:
    """archive, place (from 0) and value: the lines that aren't blank of each archive's first member, by chunks (archive,
    block, seq, data). Sizes in headers aren't needed. Anything but a deflated member is an error; no chunk, no line."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, at = None, Inflater(), 0

        def rows(lines: list[bytes]) -> Iterator[pa.RecordBatch]:
            nonlocal at
            for i in range(0, len(lines), LINES_A_BATCH):
                part = lines[i : i + LINES_A_BATCH]
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part, pa.binary()).cast(pa.string())], ["archive", "place", "value"])
                at += len(part)

        for batch in batches:
            for i in range(batch.num_rows):
                archive, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                if archive != now:
                    if now is not None:
                        yield from rows(state.last())
                    now, state, at = archive, Inflater(), 0
                for b in range(0, len(data), CHUNK):
                    for lines in state.feed(data[b : b + CHUNK]):
                        yield from rows(lines)
        if now is not None:
            yield from rows(state.last())

    laid = chunks.repartition("archive").sortWithinPartitions("archive", "block", "seq")
    return laid.select("archive", "data").mapInArrow(act, "archive string, place long, value string")


def deflated_chunks(lines: DataFrame, level: int = 6, chunk: int = CHUNK) -> DataFrame:
    """The other way round: archive, block, seq and data of one archive for each name, by lines (archive, place, value)."""

    def act(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, deflate, held, seq = None, None, b"", 0

        def row(data: bytes) -> pa.RecordBatch:
            nonlocal seq
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([0]), pa.array([seq - 1]), pa.array([data], pa.binary())], ["archive", "block", "seq", "data"])

        for batch in batches:
            for archive, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if archive != now:
                    if now is not None:
                        yield row(held + deflate.flush())
                    now, deflate, seq = archive, zlib.compressobj(level, zlib.DEFLATED, -15), 0
                    name = b"lines.jsonl"  # sizes aren't known yet: all ones, as in large archives
                    held = SIGNATURE + (45).to_bytes(2, "little") + bytes(2) + DEFLATE.to_bytes(2, "little") + bytes(8) + b"\xff" * 8 + len(name).to_bytes(2, "little") + bytes(2) + name
                held += deflate.compress(value.encode() + b"\n")
                if len(held) >= chunk:
                    yield row(held)
                    held = b""
        if now is not None:
            yield row(held + deflate.flush())

    laid = lines.repartition("archive").sortWithinPartitions("archive", "place")
    return laid.select("archive", "value").mapInArrow(act, "archive string, block long, seq long, data binary")


def zipped_lines(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """archive, place and value of zipped files of lines, dealt out over `tasks` (as many as there are cores, if not given).

    What is read more than once should be written as Parquet first: inflating can't be split.
    """
    lines = inflated_lines(archive_chunks(spark, path))
    return lines.repartition(tasks or spark.sparkContext.defaultParallelism)
