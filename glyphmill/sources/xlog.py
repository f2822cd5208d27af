"""The append-only experience log format as Spark data sources.

`format("xlog")` reads envelopes from chunk files `<prefix>-<number>.xlog` of a folder (or one file), `format("fidx")` their
index files. Chunks are cut at record borders known from their index, so a large chunk is read by many tasks; without an
index one task reads it. Time ranges (`start`, `end` options, or filters where Spark hands them over) prune by the index
before a payload is touched. Writing (`format("xlog")`) gives each task its own chunks, rotated by size; ids are the number
of the task's row, made unique by its partition.
"""

from __future__ import annotations

import atexit
import os
import struct
from collections.abc import Iterator
from glob import glob

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from .. import schemas
from .errors import CorruptRecordError, ExperienceFormatError, VersionMismatchError

# Fixed values of the format.
MAGIC, VERSION, HEADER = b"XLOG", 1, 16
INDEX = struct.Struct("<qqqfBBH")
ENTRY = np.dtype([("id", "<i8"), ("offset", "<i8"), ("ticks", "<i8"), ("reward", "<f4"), ("flags", "u1"), ("file_id", "u1"), ("episode", "<u2")])  # INDEX
HEAD = struct.Struct("<HqqiifBBBB")
FLAG_CODEC = 1
RECORDS_A_TASK = 100_000
#: Index entries read at once.
INDEX_READ = 10_000


def varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        if at >= len(data):
            raise CorruptRecordError("a length ends early")
        b = data[at]
        value |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return value, at
        shift += 7
        if shift > 63:
            raise CorruptRecordError("a length is too long")


def _blob(data: bytes | None) -> bytes:
    return varint(len(data or b"")) + (data or b"")


def encode(row: dict) -> bytes:
    """A record's payload."""
    out = HEAD.pack(VERSION, row["id"], row["ticks"], row["episode"], row["step"], row["reward"] or 0.0, bool(row["terminal"]), row["obs_kind"] or 0, row["act_kind"] or 0, 0)
    out += _blob(row["obs"]) + _blob(row["act"])
    after = row.get("next_obs")
    out += b"\x01" + _blob(after) if after else b"\x00"  # an empty next observation is none
    tags = row.get("tags") or []
    return out + varint(len(tags)) + b"".join(_blob(t.encode()) for t in tags)


def decode(data: bytes) -> tuple:
    """A row of schemas.ENVELOPE."""
    if len(data) < HEAD.size:
        raise CorruptRecordError("a record is shorter than its head")
    version, i, ticks, episode, step, reward, terminal, obs_kind, act_kind, _ = HEAD.unpack_from(data)
    if version != VERSION:
        raise VersionMismatchError(f"record version {version}")
    at = HEAD.size

    def blob() -> bytes:
        nonlocal at
        n, at = read_varint(data, at)
        if at + n > len(data):
            raise CorruptRecordError("a field ends early")
        at += n
        return data[at - n : at]

    obs, act = blob(), blob()
    if at >= len(data):
        raise CorruptRecordError("a record ends early")
    at += 1
    after = blob() if data[at - 1] else None
    count, at = read_varint(data, at)
    tags = [blob().decode() for _ in range(count)]
    return i, ticks, episode, step, reward, bool(terminal), obs_kind, act_kind, obs, act, after, tags or None


def files(path: str, ending: str) -> list[str]:
    path = path.removeprefix("file://")
    return [path] if os.path.isfile(path) else sorted(glob(f"{path}/*-*.{ending}"))


def check_header(head: bytes, path: str) -> None:
    if len(head) < HEADER or head[:4] != MAGIC:
        raise ExperienceFormatError(f"{path} is no experience log")
    version, flags = struct.unpack_from("<HH", head, 4)
    if version != VERSION:
        raise VersionMismatchError(f"{path} has version {version}")
    if flags & FLAG_CODEC:
        raise ExperienceFormatError(f"{path} is compressed with a codec that is not supported")


def scan(path: str, start: int = HEADER, stop: int | None = None) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of the records in [start, stop). A clean end stops; a cut one raises."""
    with open(path, "rb") as f:
        check_header(f.read(HEADER), path)
        f.seek(start)
        at = start
        while stop is None or at < stop:
            head = f.read(10)
            if not head:
                return
            n, used = read_varint(head, 0)
            f.seek(at + used)
            payload = f.read(n)
            if len(payload) < n:
                raise CorruptRecordError(f"{path}: the record at {at} is cut off")
            yield at, payload
            at += used + n


def read_at(path: str, offset: int) -> tuple:
    return decode(next(scan(path, offset))[1])


def index_rows(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        while len(data := f.read(INDEX_READ * INDEX.size)) >= INDEX.size:
            yield from INDEX.iter_unpack(data[: len(data) // INDEX.size * INDEX.size])


def index_table(path: str) -> np.ndarray:
    """The index entries as a mapped array; a cut last entry is left out."""
    n = os.path.getsize(path) // INDEX.size
    return np.memmap(path, ENTRY, "r", shape=(n,)) if n else np.zeros(0, ENTRY)


class Span(InputPartition):
    def __init__(self, path: str, start: int, stop: int | None, wanted: np.ndarray | None = None) -> None:
        self.path, self.start, self.stop, self.wanted = path, start, stop, wanted


class _Reader(DataSourceReader):
    def __init__(self, path: str, low: int | None, high: int | None) -> None:
        self.path, self.low, self.high = path, low, high

    def partitions(self) -> list[Span]:
        out = []
        for path in files(self.path, "xlog"):
            index = path[: -len("xlog")] + "fidx"
            known = index_table(index) if os.path.exists(index) else ()
            if not len(known):
                out.append(Span(path, HEADER, None))
                continue
            for k in range(0, len(known), RECORDS_A_TASK):
                part = known[k : k + RECORDS_A_TASK]
                first, stop = int(part["offset"][0]), int(known["offset"][k + RECORDS_A_TASK]) if k + RECORDS_A_TASK < len(known) else None
                if self.low is None and self.high is None:
                    out.append(Span(path, first, stop))
                    continue
                kept = np.ones(len(part), bool)
                if self.low is not None:
                    kept &= part["ticks"] >= self.low
                if self.high is not None:
                    kept &= part["ticks"] <= self.high
                if kept.any():
                    out.append(Span(path, first, stop, np.array(part["offset"][kept])))
        return out or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        if not span.path:
            return
        if span.wanted is not None:
            with open(span.path, "rb") as f:
                check_header(f.read(HEADER), span.path)
                for offset in span.wanted.tolist():
                    f.seek(offset)
                    n, used = read_varint(f.read(10), 0)
                    f.seek(offset + used)
                    if len(payload := f.read(n)) < n:
                        raise CorruptRecordError(f"{span.path}: the record at {offset} is cut off")
                    yield decode(payload)
            return
        for _, payload in scan(span.path, span.start, span.stop):
            row = decode(payload)
            if (self.low is None or row[1] >= self.low) and (self.high is None or row[1] <= self.high):
                yield row


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]], rows: int) -> None:
        self.moves, self.rows = moves, rows


class Writer:
    """Appends envelopes to chunks, a record and an index entry each; rotates after a chunk has reached its size, flushes every so many appends."""

    def __init__(self, folder: str, prefix: str = "exp", rotate: int = 2 << 30, first_id: int = 0, flush_every: int = 64, number: int | None = None) -> None:
        os.makedirs(folder, exist_ok=True)
        self.folder, self.prefix, self.rotate, self.id, self.flush_every = folder, prefix, rotate, first_id, max(1, flush_every)
        self.number = next_number(folder, prefix) if number is None else number
        self.paths: list[str] = []
        self._open()

    def _open(self) -> None:
        name = f"{self.folder}/{self.prefix}-{self.number:05d}"
        self._log, self._index = open(f"{name}.xlog", "xb"), open(f"{name}.fidx", "xb")
        self._log.write(MAGIC + struct.pack("<HH", VERSION, 0) + bytes(8))
        self.paths.append(name)
        atexit.register(self.flush)  # a process that ends without close() loses nothing

    def append(self, row: dict) -> int:
        row = {**row, "id": self.id}
        at = self._log.tell()
        payload = encode(row)
        self._log.write(varint(len(payload)) + payload)
        self._index.write(INDEX.pack(self.id, at, row["ticks"], row["reward"] or 0.0, int(bool(row["terminal"])), self.number & 0xFF, min(max(row["episode"], 0), 0xFFFF)))
        self.id += 1
        if self.id % self.flush_every == 0:
            self.flush()
        if self._log.tell() >= self.rotate:
            self.close()
            self.number += 1
            self._open()
        return self.id - 1

    def flush(self) -> None:
        for f in (self._log, self._index):
            if not f.closed:
                f.flush()
                os.fsync(f.fileno())

    def close(self) -> None:
        atexit.unregister(self.flush)
        for f in (self._log, self._index):
            f.close()


def next_number(folder: str, prefix: str) -> int:
    numbers = [os.path.basename(p).rsplit("-", 1)[1].split(".")[0] for p in glob(f"{folder}/{prefix}-*.xlog")]
    return max([int(n) + 1 for n in numbers if n.isdigit()], default=0)


def latest(folder: str, prefix: str = "exp", ending: str = "xlog") -> str | None:
    """The last file of a folder by name, None without one."""
    return max(glob(f"{folder}/{prefix}-*.{ending}"), default=None)


class _Sink(DataSourceWriter):
    def __init__(self, options: dict, schema) -> None:
        self.folder = options["path"].removeprefix("file://")
        self.prefix, self.rotate = options.get("prefix", "exp"), int(options.get("rotatebytes", 2 << 30))
        self.first = next_number(self.folder, self.prefix)

    def write(self, rows) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        writer = Writer(f"{self.folder}/_attempt-{part}-{attempt}", self.prefix, self.rotate, part << 40, number=0)
        n = 0
        for row in rows:
            writer.append(row.asDict())
            n += 1
        writer.flush()
        writer.close()
        return Written([(p, f"{part}") for p in writer.paths], n)

    def commit(self, messages) -> None:
        number = self.first
        for m in messages:
            for source, _ in m.moves if m else []:
                if m.rows:
                    for ending in ("fidx", "xlog"):
                        os.replace(f"{source}.{ending}", f"{self.folder}/{self.prefix}-{number:05d}.{ending}")
                    number += 1
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        import shutil

        for p in glob(f"{self.folder}/_attempt-*"):
            shutil.rmtree(p, ignore_errors=True)


class XLog(DataSource):
    """format("xlog"): options path, start and end (ticks, inclusive); writing: prefix, rotateBytes."""

    @classmethod
    def name(cls) -> str:
        return "xlog"

    def schema(self) -> str:
        return schemas.ENVELOPE

    def reader(self, schema) -> DataSourceReader:
        number = lambda k: int(self.options[k]) if k in self.options else None
        return _Reader(self.options["path"], number("start"), number("end"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Sink(self.options, schema)


class _IndexReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Span]:
        return [Span(p, 0, None) for p in files(self.path, "fidx")] or [Span("", 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        yield from index_rows(span.path) if span.path else ()


class FIdx(DataSource):
    """format("fidx"): the index entries of a folder or file."""

    @classmethod
    def name(cls) -> str:
        return "fidx"

    def schema(self) -> str:
        return schemas.INDEX

    def reader(self, schema) -> DataSourceReader:
        return _IndexReader(self.options["path"])


def register(spark) -> None:
    spark.dataSource.register(XLog)
    spark.dataSource.register(FIdx)


def to_envelopes(log):
    """An experience log (schemas.EXPERIENCE) as envelopes: floats and acts as little-endian bytes."""
    @F.pandas_udf("binary")
    def floats(col: pd.Series) -> pd.Series:
        return col.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    @F.pandas_udf("binary")
    def ints(col: pd.Series) -> pd.Series:
        return col.map(lambda v: struct.pack("<i", int(v)))

    kind = F.lit(schemas.KIND_VECTOR).cast("byte")
    tags = F.col("tags") if "tags" in log.columns else F.lit(None).cast("array<string>")
    return log.select("id", "ticks", "episode", "step", F.col("reward").cast("float").alias("reward"), "terminal", kind.alias("obs_kind"), kind.alias("act_kind"), floats("obs").alias("obs"), ints("act").alias("act"), floats("next_obs").alias("next_obs"), tags.alias("tags"))


def from_envelopes(rows):
    """Vector observations and discrete acts back as an experience log; other kinds are left out."""
    @F.pandas_udf("array<float>")
    def floats(col: pd.Series) -> pd.Series:
        return col.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    @F.pandas_udf("int")
    def ints(col: pd.Series) -> pd.Series:
        return col.map(lambda b: struct.unpack("<i", b)[0])

    kept = rows.where((F.col("obs_kind") == schemas.KIND_VECTOR) & (F.col("act_kind") == schemas.KIND_VECTOR))
    return kept.select("id", "ticks", "episode", "step", floats("obs").alias("obs"), ints("act").alias("act"), "reward", floats("next_obs").alias("next_obs"), "terminal", "tags")
