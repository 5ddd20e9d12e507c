"""NDJSON of worker outputs as a Python data source, batch and stream: lines with their numbers, offsets by file."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: input: the file, null where the path is one file; line from 1; ordinal: the output's number in its file, from 0.
SCHEMA = "input string, line long, ordinal long, value string"
LINES = 4096
SUFFIXES = (".ndjson", ".jsonl", ".json", ".txt")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[int, str]]:
    """(time of the last change in ns, path) of the file, or of the files in the folder, in that order. Files are put
    there whole, by renaming; those that begin with . or _ don't count."""
    system, base = opened(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"worker input file not found: {path}")
    found = [info] if info.is_file else [x for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.is_file and x.base_name[0] not in "._" and x.base_name.endswith(SUFFIXES)]
    return sorted((x.mtime_ns or 0, x.path) for x in found)


class File(InputPartition):
    def __init__(self, path: str, alone: bool):
        self.path, self.alone = path, alone


def lines(root: str, part: File) -> Iterator[pa.RecordBatch]:
    """The lines of a file that are outputs; blank ones and notes (#) are passed over. A reader holds LINES of them."""
    system, base = opened(root)
    name = None if part.alone else part.path.removeprefix(base).lstrip("/")
    with system.open_input_stream(part.path) as stream:
        held: list[tuple[int, int, str]] = []
        ordinal, rest, number = 0, b"", 0

        def batch() -> pa.RecordBatch:
            at, nth, values = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(at, pa.int64()), pa.array(nth, pa.int64()), pa.array(values, pa.string())], names=["input", "line", "ordinal", "value"])

        while True:
            block = stream.read(1 << 20)
            *whole, rest = (rest + block).split(b"\n") if block else [rest, b""]
            for raw in whole:
                number += 1
                value = raw.decode("utf-8").strip()
                if value and not value.startswith("#"):
                    held.append((number, ordinal, value))
                    ordinal += 1
                if len(held) == LINES:
                    yield batch()
                    held.clear()
            if not block:
                break
        if held:
            yield batch()


class Outputs(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        found = files(self.path)
        alone = len(found) == 1 and found[0][1] == opened(self.path)[1].rstrip("/")
        return [File(p, alone) for _, p in found]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return lines(self.path, partition) if isinstance(partition, File) else iter(())


class OutputStream(DataSourceStreamReader):
    """An offset is the last file that was taken: files are taken by their times, then names."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"time": -1, "file": ""}

    def latestOffset(self) -> dict:
        found = files(self.path)
        return {"time": found[-1][0], "file": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        after, upto = (start["time"], start["file"]), (end["time"], end["file"])
        return [File(p, False) for t, p in files(self.path) if after < (t, p) <= upto]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return lines(self.path, partition)


class WorkerOutputs(DataSource):
    """`path`: a file, or a folder of files (.ndjson, .jsonl, .json, .txt); one task a file, in bounded memory."""

    @classmethod
    def name(cls) -> str:
        return "worker_ndjson"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Outputs(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return OutputStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkerOutputs)
