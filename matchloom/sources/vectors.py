"""Word vectors: a data source for the word2vec binary format, and Parquet (word, vec)."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK = 1 << 20
FILE_BYTES = 1 << 26
EVERY = 1 << 14


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it of a local path or a URI."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


class Words:
    """A word2vec stream, read in blocks of `block` bytes: a header line "count size", then for each word its text, a space, and floats."""

    def __init__(self, stream, at: int = 0, block: int = BLOCK) -> None:
        self.stream, self.block, self.held, self.at, self.base = stream, block, bytearray(), 0, at

    def more(self) -> bool:
        got = self.stream.read(self.block)
        self.base += self.at
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def until(self, end: bytes, what: str) -> bytes:
        while (i := self.held.find(end, self.at)) < 0:
            if not self.more():
                raise EOFError(f"the file ends in {what}")
        out, self.at = bytes(self.held[self.at : i]), i + 1
        return out

    def header(self) -> tuple[int, int]:
        count, size = map(int, self.until(b"\n", "its header").split())
        return count, size

    def word(self, size: int, vector: bool = True) -> tuple[str, list[float]] | None:
        """The next word; without `vector` it is only passed by."""
        word = self.until(b" ", "a word")
        while len(self.held) - self.at < 4 * size:
            if not self.more():
                raise EOFError("the file ends in a vector")
        self.at += 4 * size
        if vector:
            return word.replace(b"\n", b"").decode("utf-8", "replace"), list(struct.unpack_from(f"<{size}f", self.held, self.at - 4 * size))
        return None

    def place(self) -> int:
        return self.base + self.at


def read_word2vec(path: str, limit: int | None = None, block: int = BLOCK) -> Iterator[tuple[str, list[float]]]:
    """Words and vectors of a whole file."""
    system, at = file_system(path)
    with system.open_input_stream(at) as f:
        words = Words(f, block=block)
        count, size = words.header()
        for _ in range(min(count, count if limit is None else limit)):
            yield words.word(size)


def index_path(at: str) -> str:
    """The index stands beside its file, under a hidden name."""
    folder, _, name = at.rpartition("/")
    return f"{folder}/.{name}.index"


def write_index(path: str, every: int) -> int:
    """Offsets of every `every`-th word of a file, for reads by ranges; vectors are passed by, not decoded. Returns the words."""
    system, at = file_system(path)
    with system.open_input_stream(at) as f:
        words = Words(f)
        count, size = words.header()
        offsets = []
        for i in range(count):
            if i % every == 0:
                offsets.append(words.place())
            words.word(size, vector=False)
    told = {"bytes": system.get_file_info(at).size, "count": count, "size": size, "every": every, "offsets": offsets}
    with system.open_output_stream(index_path(at)) as out:
        out.write(json.dumps(told).encode())
    return count


def read_index(path: str) -> dict | None:
    """The index of a file, unless there is none or the file has another size since."""
    system, at = file_system(path)
    if system.get_file_info(index_path(at)).type != fs.FileType.File:
        return None
    with system.open_input_stream(index_path(at)) as f:
        told = json.loads(f.read())
    return told if told["bytes"] == system.get_file_info(at).size else None


def read_range(path: str, offset: int, n: int, size: int) -> Iterator[tuple[str, list[float]]]:
    """`n` words from an offset on."""
    system, at = file_system(path)
    with system.open_input_file(at) as f:
        f.seek(offset)
        words = Words(f, offset)
        for _ in range(n):
            yield words.word(size)


def files_of(path: str) -> list[str]:
    """The files of a folder in order of name, or the file itself."""
    system, at = file_system(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))
    return [f"{path.rstrip('/')}/{n}" for n in names]


@dataclass
class _Part(InputPartition):
    path: str
    offset: int | None = None
    words: int = 0
    size: int = 0


class _Reader(DataSourceReader):
    def __init__(self, path: str, limit: int | None) -> None:
        self.path, self.limit = path, limit

    def partitions(self) -> list[InputPartition]:
        """Words have no fixed length: a file is read by the ranges of its index, or in one go if it has none."""
        out = []
        for f in files_of(self.path):
            told = read_index(f)
            if told is None:
                out.append(_Part(f))
                continue
            most = told["count"] if self.limit is None else min(self.limit, told["count"])
            out += [_Part(f, offset, min(told["every"], most - i * told["every"]), told["size"]) for i, offset in enumerate(told["offsets"]) if i * told["every"] < most]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.offset is None:
            yield from read_word2vec(partition.path, self.limit)
        else:
            yield from read_range(partition.path, partition.offset, partition.words, partition.size)


class _Writer(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        """Files under names of the task's attempt, each of about FILE_BYTES, which wait in memory since the number of words comes first."""
        names, body, n, size = [], bytearray(), 0, 0
        system, at = file_system(self.path)

        def flush() -> None:
            system.create_dir(at, recursive=True)
            names.append(f"part-{uuid.uuid4().hex}.bin")
            with system.open_output_stream(f"{at}/.{names[-1]}") as out:
                out.write(f"{n} {size}\n".encode())
                out.write(bytes(body))

        for r in iterator:
            size = len(r["vec"])
            body += r["word"].encode() + b" " + struct.pack(f"<{size}f", *r["vec"]) + b"\n"
            n += 1
            if len(body) >= FILE_BYTES:
                flush()
                body, n = bytearray(), 0
        if n:
            flush()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Names of complete files lose their dot; what attempts that were lost have left stays hidden."""
        system, at = file_system(self.path)
        system.create_dir(at, recursive=True)
        for m in messages:
            for name in m.names if m is not None else ():
                system.move(f"{at}/.{name}", f"{at}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = file_system(self.path)
        for m in messages:
            for name in m.names if m is not None else ():
                system.delete_file(f"{at}/.{name}")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class Word2VecSource(DataSource):
    """spark.read.format("word2vec").option("limit", n).load(path) of a file, or of a folder whose files are read side by
    side (`limit` words of each); df.write.format("word2vec").mode("append").save(path) writes a folder."""

    @classmethod
    def name(cls) -> str:
        return "word2vec"

    def schema(self) -> str:
        return "word string, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        limit = self.options.get("limit")
        return _Reader(self.options["path"], int(limit) if limit else None)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def save_word2vec(words: DataFrame, path: str) -> None:
    """Writes (word, vec) as a folder of word2vec files."""
    words.sparkSession.dataSource.register(Word2VecSource)
    words.select("word", F.col("vec").cast("array<float>").alias("vec")).write.format("word2vec").mode("append").save(path)


def load_word2vec(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    spark.dataSource.register(Word2VecSource)
    r = spark.read.format("word2vec")
    return (r.option("limit", str(limit)) if limit else r).load(path)


def index_word2vec(spark: SparkSession, path: str, every: int = EVERY) -> int:
    """Writes an index beside each file of `path`, a task a file, so that later reads take a task for every `every` words. Returns the words."""
    spark.dataSource.register(Word2VecSource)
    names = files_of(path)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([write_index(p, every) for p in b.column(0).to_pylist()], pa.int64())], names=["n"])

    table = spark.createDataFrame([(n,) for n in names], "path string").repartition(max(1, len(names)), "path")
    return table.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def convert_to_keyed_vectors(spark: SparkSession, source: str, target: str, limit: int | None = None) -> None:
    """Writes a word2vec file as Parquet, which later reads prune and split."""
    load_word2vec(spark, source, limit).write.mode("overwrite").parquet(target)


def load_keyed_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
