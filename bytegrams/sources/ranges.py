"""Files of any size and any name as documents, in one read: overlapping byte ranges, gzipped files unpacked as they are read.

Spark's own reader gives a file as one row of 2 GB at most, and skips names
that start with _ or . - here a partition is a list of byte ranges of about
the same size in all, and a file that can't be read is a row with its error.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a row besides the overlap, of a partition, and of what is read or unpacked at once.
LIMIT, PARTITION, BLOCK = 16 << 20, 128 << 20, 1 << 20
SCHEMA = "doc_id string, chunk_no int, chunks int, content binary, error string"
NAMES = ["doc_id", "chunk_no", "chunks", "content", "error"]


def gzipped(head: bytes) -> bool:
    """Whether a header says so: bytes 1f 8b, then a method of 0 to 8."""
    return len(head) >= 3 and head[:2] == b"\x1f\x8b" and head[2] <= 8


def inflate(blocks: Iterator[bytes], most: int = BLOCK) -> Iterator[bytes]:
    """The unpacked bytes of gzip members, in pieces of at most so many. EOFError or zlib.error where they aren't whole."""
    member = zlib.decompressobj(31)
    for data in blocks:
        more = True
        while data or more:
            if member.eof:
                data = data.lstrip(b"\0")  # padding
                if not data:
                    break
                member = zlib.decompressobj(31)
            piece = member.decompress(data, most)
            data, more = (member.unused_data, False) if member.eof else (member.unconsumed_tail, len(piece) == most)
            if piece:
                yield piece
    if not member.eof:
        raise EOFError("it ends before the end of its gzip stream")


def overlapping(pieces: Iterator[bytes], limit: int, overlap: int) -> Iterator[bytes]:
    """Pieces as rows of limit + overlap bytes that begin every limit bytes; the last one is shorter."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while len(held) > limit + overlap:
            yield bytes(held[: limit + overlap])
            del held[:limit]
    yield bytes(held)


def unpacked_rows(blocks: Callable[[], Iterator[bytes]], limit: int, overlap: int) -> Iterator[tuple[int, int, bytes | None, str | None]]:
    """(chunk_no, chunks, content, error) of a gzipped content, which blocks() reads from the start. One that isn't whole is
    one row with an error: longer ones are read to the end before the first row is given, and then a second time."""
    try:
        first: list[bytes] = []
        size = 0
        for piece in inflate(blocks()):
            size += len(piece)
            if size <= limit + overlap:
                first.append(piece)
    except (OSError, EOFError, zlib.error) as e:
        yield 0, 1, None, str(e)[:200]
        return
    if size <= limit + overlap:
        yield 0, 1, b"".join(first), None
        return
    chunks = -(-(size - overlap) // limit)
    for k, content in enumerate(overlapping(inflate(blocks()), limit, overlap)):
        yield k, chunks, content, None


class Ranges(InputPartition):
    """(path, size, chunk_no, chunks) of the ranges of a partition."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


def opened(path: str) -> tuple:
    """(file system, path in it). Imported where it is used: it starts threads, and workers are forked."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.overlap = options["path"], int(options.get("overlap", 0))
        self.limit, self.partition = int(options.get("limit", LIMIT)), int(options.get("partition", PARTITION))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = opened(self.path)
        files = sorted((f for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.type != fs.FileType.Directory), key=lambda f: f.path)
        out: list[list[tuple[str, int, int, int]]] = [[]]
        held = 0
        for f in files:
            size = f.size or 0
            chunks = max(1, -(-(size - self.overlap) // self.limit))
            for k in range(chunks):
                if held >= self.partition:
                    out.append([])
                    held = 0
                out[-1].append((f.path, size, k, chunks))
                held += min(self.limit, size - k * self.limit) + 4096  # opening a file counts too
        return [Ranges(x) for x in out if x]

    def rows(self, store, path: str, size: int, k: int, chunks: int) -> Iterator[tuple[int, int, bytes | None, str | None]]:
        try:
            with store.open_input_file(path) as file:
                if gzipped(file.read(3)):
                    if k == 0:  # the first range stands for the file

                        def blocks() -> Iterator[bytes]:
                            file.seek(0)
                            while block := file.read(BLOCK):
                                yield block

                        yield from unpacked_rows(blocks, self.limit, self.overlap)
                    return
                file.seek(k * self.limit)
                content = file.read(self.limit + self.overlap)
            if len(content) < min(self.limit + self.overlap, size - k * self.limit):
                raise OSError("it has become shorter")
        except OSError as e:
            yield k, chunks, None, str(e)[:200]
            return
        yield k, chunks, content, None

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            held.clear()
            types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], NAMES)

        for path, length, k, chunks in partition.ranges:
            for row in self.rows(store, path, length, k, chunks):
                held.append((path, *row))
                size += len(row[2] or b"") + 100
                if size >= self.limit:
                    yield batch()
                    size = 0
        if held:
            yield batch()


class ByteRanges(DataSource):
    """Options: path (a URI that pyarrow's file systems know, or a path), limit, overlap, partition: numbers of bytes."""

    @classmethod
    def name(cls) -> str:
        return "byte_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def read_ranges(spark: SparkSession, path: str, overlap: int, limit: int = LIMIT, partition: int = PARTITION) -> DataFrame:
    """All files under path, at any depth and of any name and size: doc_id (the file's path), chunk_no, chunks, content, error.

    A row has at most limit + overlap bytes. overlap is a gram's bytes less
    one symbol, and limit a multiple of a symbol's bytes: then every window is
    in exactly one row, and counting functions take the rows with
    chunked=True. Files with a gzip header are unpacked as they are read,
    however large they get. Where something can't be read, error says why and
    content is null. Files are listed by the driver; links are followed as the
    file system does.
    """
    spark.dataSource.register(ByteRanges)
    return spark.read.format("byte_ranges").options(path=path, limit=limit, overlap=overlap, partition=partition).load()


def without_rejects(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read_ranges -> (rows of files all of whose ranges could be read, rejects (doc_id, error)). Rows should be stored first:
    then the files are read once."""
    failed = rows.filter("error IS NOT NULL")
    rejects = failed.groupBy("doc_id").agg(F.min("error").alias("error"))
    spoiled = failed.filter("chunks > 1").select("doc_id").distinct()
    good = rows.filter("error IS NULL").drop("error")
    return good.filter("chunks = 1").unionByName(good.filter("chunks > 1").join(spoiled, "doc_id", "left_anti").select(*good.columns)), rejects
