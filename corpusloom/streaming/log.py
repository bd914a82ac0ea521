"""A log of events with offsets: a stream sink that commits whole batches, and a stream source
that starts at any event, gives what is there and then what is new.

The log is a folder that driver and executors share, on any file system that pyarrow opens.
Tasks of a batch write files; the batch exists once its manifest does, which the driver
writes last, under the batch's number. A batch that is run again after a failure finds its
manifest there and drops its new files, so no event is told twice. Names of manifests hold
the number of the first event and of all in them: to plan a read, names are listed and only
the manifests read that hold something of it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Folder:
    """Files under a folder given as a path or an address of a file system."""

    def __init__(self, address: str):
        if address.startswith("file:") or "://" not in address:
            self.fs, self.root = pafs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")
        else:
            self.fs, self.root = pafs.FileSystem.from_uri(address)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def names(self, part: str) -> list[str]:
        found = self.fs.get_file_info(pafs.FileSelector(self.at(part), allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and not f.base_name.startswith("."))

    def put(self, name: str, data: bytes) -> None:
        """A file that is there whole or not at all."""
        folder, _, base = name.rpartition("/")
        self.fs.create_dir(self.at(folder), recursive=True)
        part = self.at(f"{folder}/.{base}-{uuid.uuid4().hex}")
        with self.fs.open_output_stream(part) as out:
            out.write(data)
        self.fs.move(part, self.at(name))

    def get(self, name: str) -> bytes:
        with self.fs.open_input_stream(self.at(name)) as file:
            return file.read()

    def drop(self, name: str) -> None:
        if self.fs.get_file_info(self.at(name)).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.at(name))


@dataclass
class Batch:
    """A committed batch: its number, that of its first event, and how many it has."""

    number: int
    first: int
    size: int

    @property
    def name(self) -> str:
        return f"manifests/{self.number:012d}-{self.first:018d}-{self.size:012d}.json"


def batches(folder: Folder) -> list[Batch]:
    return [Batch(*map(int, name.removesuffix(".json").split("-"))) for name in folder.names("manifests")]


@dataclass
class _Written(WriterCommitMessage):
    name: str
    size: int


class _Writer(DataSourceStreamArrowWriter):
    def __init__(self, address: str, schema: StructType):
        self.address, self.schema = address, schema

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        folder, name, size = Folder(self.address), f"events/{uuid.uuid4().hex}.parquet", 0
        folder.fs.create_dir(folder.at("events"), recursive=True)
        schema = to_arrow_schema(self.schema)
        with folder.fs.open_output_stream(folder.at(name)) as out, pq.ParquetWriter(out, schema) as writer:
            for batch in iterator:
                writer.write_batch(batch.cast(schema))
                size += batch.num_rows
        return _Written(name, size)

    def commit(self, messages: list[_Written | None], batchId: int) -> None:  # noqa: N803
        folder, written = Folder(self.address), [m for m in messages if m is not None]
        there = batches(folder)
        if any(b.number == batchId for b in there):  # told before, by a run that ended too soon
            return self.abort(messages, batchId)
        for m in written:
            if not m.size:
                folder.drop(m.name)
        kept = [m for m in written if m.size]
        first = max((b.first + b.size for b in there), default=0)
        made = Batch(batchId, first, sum(m.size for m in kept))
        folder.put(made.name, json.dumps([[m.name, m.size] for m in kept]).encode())

    def abort(self, messages: list[_Written | None], batchId: int) -> None:  # noqa: ARG002, N803
        folder = Folder(self.address)
        for m in messages:
            if m is not None:
                folder.drop(m.name)


@dataclass
class _Span(InputPartition):
    """Events skip .. skip + take of a file, the first of which is event `first`."""

    name: str
    skip: int
    take: int
    first: int


class _Reader(DataSourceStreamReader):
    def __init__(self, address: str, start: int):
        self.address, self.start = address, start

    def initialOffset(self) -> dict:  # noqa: N802
        return {"event": self.start}

    def latestOffset(self) -> dict:  # noqa: N802
        end = max((b.first + b.size for b in batches(Folder(self.address))), default=0)
        return {"event": max(self.start, end)}

    def partitions(self, start: dict, end: dict) -> list[_Span]:
        folder, found = Folder(self.address), []
        for batch in batches(folder):
            if batch.first + batch.size <= start["event"] or batch.first >= end["event"]:
                continue
            at = batch.first
            for name, size in json.loads(folder.get(batch.name)):
                low, high = max(at, start["event"]), min(at + size, end["event"])
                if low < high:
                    found.append(_Span(name, low - at, high - low, low))
                at += size
        return found

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        folder = Folder(self.address)
        with folder.fs.open_input_file(folder.at(partition.name)) as file:
            held, skip, left, at = pq.ParquetFile(file), partition.skip, partition.take, partition.first
            for batch in held.iter_batches():
                if skip >= batch.num_rows:
                    skip -= batch.num_rows
                    continue
                if left <= 0:
                    return
                part = batch.slice(skip, left)
                skip, left = 0, left - part.num_rows
                offset = pa.array(range(at, at + part.num_rows), pa.int64())
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([offset, *part.columns], names=["offset", *part.schema.names])


class EventLog(DataSource):
    """Format `event_log`. Options: path, the log's folder; to read, also `events` (the schema of
    an event) and `from` (number of the first event wanted, 0 by default). A reader's rows
    are the events after a column `offset`, the event's number: a client that has seen event
    n comes back with from = n + 1. One query writes to a log."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return f"offset long, {self.options['events']}"

    def streamReader(self, schema: StructType) -> _Reader:  # noqa: ARG002, N802
        return _Reader(self.options["path"], int(self.options.get("from", 0)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> _Writer:  # noqa: ARG002, N802
        return _Writer(self.options["path"], schema)
