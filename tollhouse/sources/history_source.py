"""The history of events as a data source: gzip JSON lines in chunks bounded by rows and bytes.

``history`` reads chunks with the role and instance of their names, and takes filters on day,
hour, role and instance before it opens files; as a sink of batches or streams it writes chunks
that are renamed into place when their batch commits.  Rows cross as JSON text, which Spark's own
functions make and parse.
"""

from __future__ import annotations

import gzip
import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from tollhouse.sources.history import STREAMS

#: Bounds of a chunk (fixed values); its age is the trigger of the stream that writes it.
MAX_RECORDS, MAX_BYTES = 1000, 8 << 20
_PLACE = re.compile(r"dt=(?P<dt>[^/]+)/hour=(?P<hour>[^/]+)/[0-9T.]+Z-(?P<role>[^-/]+)-(?P<instance>[^/]+)-\d{6}-[0-9a-f]{8}\.jsonl(?:\.gz)?$")
_FIELDS = ("dt", "hour", "role", "instance")
SCHEMA = "line string, dt string, hour string, role string, instance string"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


#: Folder name of Spark's writers for null.
_NONE = "__HIVE_DEFAULT_PARTITION__"
#: Threads that rename the chunks of a batch.
MOVERS = 16
#: Partitions that a read has at most; beyond that neighbouring chunks share one.
MAX_PARTITIONS = 1024


@dataclass
class Chunks(InputPartition):
    """Files, each with what its place says."""

    files: list[tuple[str, tuple[str, ...]]]


@dataclass
class Written(WriterCommitMessage):
    """Staged chunks of a task: path, day, hour and number in the task."""

    task: int
    chunks: list[tuple[str, str, str, int]]


class HistoryReader(DataSourceReader):
    """The chunks that the filters leave, a partition for each or, of very many, for neighbours."""

    def __init__(self, base: str):
        self.base = base
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In, IsNotNull)) and len(f.attribute) == 1 else None
            if name not in _FIELDS:
                yield f
                continue
            if isinstance(f, IsNotNull):
                continue  # every chunk has all fields
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted[name] & values if name in self.wanted else values

    def partitions(self) -> list[Chunks]:
        store, base = _store(self.base)
        found = []
        for day in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            # Days that no filter wants are not listed at all.
            dt = re.fullmatch(r"dt=(.+)", day.base_name)
            if not dt or ("dt" in self.wanted and dt[1] not in self.wanted["dt"]):
                continue
            for info in store.get_file_info(fs.FileSelector(day.path, recursive=True)):
                place = _PLACE.search(info.path)
                if info.is_file and place and all(place[n] in ok for n, ok in self.wanted.items()):
                    found.append((info.path, place.groups()))
        found.sort()
        together = -(-len(found) // MAX_PARTITIONS) or 1
        return [Chunks(found[i : i + together]) for i in range(0, len(found), together)] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.base)
        for path, fields in partition.files:
            with store.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None) as source:
                lines = source.read().decode().splitlines()
            columns = [pa.array(lines, pa.string()), *[pa.array([v] * len(lines), pa.string()) for v in fields]]
            yield pa.RecordBatch.from_arrays(columns, names=["line", *_FIELDS])


class HistoryWriter(DataSourceStreamWriter):
    """Writes rows (line, dt, hour) as chunks to a staging folder; a committed batch renames its own."""

    def __init__(self, options: dict):
        self.base = options["path"]
        self.role, self.instance = options.get("role", "sidecar"), options.get("instance", "spark")
        self.most_rows = int(options.get("maxrecords", MAX_RECORDS))
        self.most_bytes = int(options.get("maxbytes", MAX_BYTES))

    def write(self, iterator: Iterator) -> Written:
        store, base = _store(self.base)
        task, staged, held = TaskContext.get().partitionId(), [], {}

        def flush(place: tuple[str, str]) -> None:
            lines, _ = held.pop(place)
            path = f"{base}/_staging/{uuid.uuid4().hex}"
            with store.open_output_stream(path, compression=None) as out:
                out.write(gzip.compress("".join(f"{x}\n" for x in lines).encode(), mtime=0))
            staged.append((path, *place, len(staged)))

        store.create_dir(f"{base}/_staging", recursive=True)
        for row in iterator:
            place, size = (row.dt, row.hour), len(row.line.encode()) + 1
            if place in held and (len(held[place][0]) >= self.most_rows or held[place][1] + size > self.most_bytes):
                flush(place)
            lines, n = held.get(place, ([], 0))
            lines.append(row.line)
            held[place] = (lines, n + size)
        for place in sorted(held):
            flush(place)
        return Written(task, staged)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, base = _store(self.base)
        for dt, hour in {(dt, hour) for m in filter(None, messages) for _, dt, hour, _ in m.chunks}:
            store.create_dir(f"{base}/dt={dt}/hour={hour}", recursive=True)
        moves = []
        for m in filter(None, messages):
            for path, dt, hour, n in m.chunks:
                # A batch that runs again gives the same names, so it replaces what it wrote before.
                tail = hashlib.md5(f"{batchId}/{m.task}/{n}".encode()).hexdigest()[:8]
                name = f"{dt.replace('-', '')}T{hour}0000.000Z-{self.role}-{self.instance}-{batchId % 1_000_000:06d}-{tail}.jsonl.gz"
                moves.append((path, f"{base}/dt={dt}/hour={hour}/{name}"))
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: store.move(*m), moves))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        store, _ = _store(self.base)
        for m in filter(None, messages):
            for path, *_ in m.chunks:
                store.delete_file(path)


@dataclass
class Appended(WriterCommitMessage):
    """A task's staging folder and (day, hour, chunks) of its runs of an hour; its chunks are numbered through."""

    task: int
    folder: str
    runs: list[tuple[str, str, int]]


class HistoryAppender(DataSourceArrowWriter):
    """Appends rows (line, dt, hour) as chunks; rows of an hour should follow one another, as a task holds one chunk.

    A write names its chunks by an instance of its own, so none replaces another's.
    """

    def __init__(self, options: dict):
        self.base, self.instance = options["path"], uuid.uuid4().hex
        self.most_rows = int(options.get("maxrecords", MAX_RECORDS))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Appended:
        store, base = _store(self.base)
        folder = f"{base}/_staging/{self.instance}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        counts, held, n, own = [], [], 0, None

        def flush() -> None:
            nonlocal n
            with store.open_output_stream(f"{folder}/{n}", compression=None) as out:
                out.write(gzip.compress("".join(f"{x}\n" for x in held).encode(), compresslevel=6, mtime=0))
            held.clear()
            n += 1
            counts[-1][1] += 1

        for batch in iterator:
            for line, dt, hour in zip(*(batch.column(c).to_pylist() for c in ("line", "dt", "hour")), strict=True):
                if held and ((dt, hour) != own or len(held) == self.most_rows):
                    flush()
                if not counts or (dt, hour) != own:
                    own = (dt, hour)
                    counts.append([own, 0])
                held.append(line)
        if held:
            flush()
        return Appended(TaskContext.get().partitionId(), folder, [(*place, chunks) for place, chunks in counts])

    def commit(self, messages: list[Appended | None]) -> None:
        store, base = _store(self.base)
        moves = []
        for m in filter(None, messages):
            number = itertools.count()
            for dt, hour, chunks in m.runs:
                # Rows without a time lie where Spark's own writer puts them.
                day, at = (dt.replace("-", ""), hour) if dt is not None else ("00000000", "00")
                place = f"{base}/dt={dt or _NONE}/hour={hour or _NONE}"
                for n in itertools.islice(number, chunks):
                    moves.append((f"{m.folder}/{n}", f"{place}/{day}T{at}0000.000Z-spark-{self.instance}-{n % 10**6:06d}-{m.task:05x}{n // 10**6:03x}.jsonl.gz"))
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda f: store.create_dir(f, recursive=True), {to.rpartition("/")[0] for _, to in moves}))
            list(pool.map(lambda m: store.move(*m), moves))
        self._clean()

    def abort(self, messages: list[Appended | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        """Removes the write's staging folder with what failed attempts of tasks left there."""
        store, base = _store(self.base)
        if store.get_file_info(f"{base}/_staging/{self.instance}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/_staging/{self.instance}")


class HistorySource(DataSource):
    """``spark.read.format("history").load(folder)``, ``write`` in append mode and ``writeStream`` with it."""

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> HistoryAppender:
        if overwrite:
            raise ValueError("the history is only appended to")
        return HistoryAppender(self.options)

    def streamWriter(self, schema, overwrite: bool) -> HistoryWriter:  # noqa: N802
        return HistoryWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format ``history`` known to a session, with its filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(HistorySource)


def read_chunks(spark: SparkSession, base: str, stream: str, schema: str) -> DataFrame:
    """Rows of a stream (``schema``) with dt, hour, role and instance of their chunks; filters on these choose the files.

    A line that is not JSON gives a row of nulls; a missing folder gives no rows.
    """
    register(spark)
    lines = spark.read.format("history").load(f"{base}/{stream}")
    return lines.select(F.from_json("line", schema).alias("r"), *_FIELDS).select("r.*", *_FIELDS)


def chunk_rows(df: DataFrame, stream: str, ts_col: str = "ts") -> DataFrame:
    """Rows (line, dt, hour) for the sink; unknown streams raise."""
    if stream not in STREAMS:
        raise ValueError(f"unknown stream {stream}")
    return df.select(F.to_json(F.struct(*df.columns)).alias("line"), F.date_format(ts_col, "yyyy-MM-dd").alias("dt"), F.date_format(ts_col, "HH").alias("hour"))
