"""What the operators of this folder share: table access, scratch tables, byte-level word hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side that is broadcast on a checked row count of narrow (id-sized) rows; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000
#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        global _LOCAL
        _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="glyphmill-")
        found = _LOCAL
    return found.rstrip("/")


_LOCAL = ""


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and a lost executor costs only a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/glyphmill/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before the interpreter does
            return


def free(name: str, taken: list[str]) -> str:
    """name, or name with underscores before it, so that no column of an input has it (Spark's names ignore case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def few(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast if its counted rows are within BROADCAST_ROWS; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def crc_mod(col: str, n: int) -> Column:
    """crc32 of a column's decimal text, modulo n."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row: Spark repeats an expression that is used twice inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- byte-level words -------------------------------------------------------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply): equal inputs stay equal, others look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_BYTE = constants(256, 11)
_BASE = 0x5851F42D4C957F2D | 1
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, 2 * CHUNK_BYTES)
        for base, name in ((_BASE, "_POW"), (pow(_BASE, -1, 1 << 64), "_INV")):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            globals()[name] = np.cumprod(a, dtype=np.uint64)
    return _POW[:n], _INV[:n]


def sliced(batches, rows: int = 512):
    """The batches in slices of at most `rows`: what is made into Python objects at once stays small, whatever Arrow sends."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def chunks(texts: list[bytes]):
    """(first, texts) of runs of about CHUNK_BYTES."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ([^\\x20\\x09-\\x0D]+) of the texts in order, and each word's text number."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[buf])).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    power, inverse = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * power[: len(buf)], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return h, np.searchsorted(begins, starts, "right") - 1
