"""What the training-data operators share: staged tables, session settings and text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: Records of an Arrow batch, so that a batch of very long texts fits in a Python worker.
BATCH_ROWS = 1000
BATCH_BYTES = "16m"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; a folder of this session's own where that is unset and the session is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="granary-")
    return _own_dir[app]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return a reader of it, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path  # type: ignore[attr-defined]
    return out


def unstage(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches, and the reader's column batches, by rows; texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hashed words of many texts at once ------------------------------------------------------------------------------

_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = base
        np.multiply.accumulate(out, out=out)
    return out


_inv = pow(int(_P), -1, 2**64)
_tables: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("p", ())) < n:
        m = max(n, 1 << 19)
        _tables["p"], _tables["i"] = _powers(m, _P), _powers(m, _U(_inv))
    return _tables["p"][:n], _tables["i"][:n]


#: Bytes that part words: those of [\x20\x09-\x0D].
SPACE_CUT = np.zeros(256, dtype=bool)
SPACE_CUT[[0x20, *range(0x09, 0x0E)]] = True


def hashed_words(texts: list[bytes], cut: np.ndarray = SPACE_CUT) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of UTF-8 texts with A-Z lower-cased, and the place in them where each text starts (one more entry ends the last).

    Words are the longest runs of bytes that ``cut`` doesn't mark. Polynomial prefix sums modulo 2**64 over the joined texts give
    every word's hash without a loop over words.
    """
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    low = _LOWER[joined]
    gap = cut[low]
    if len(texts):
        gap[ends - 1] = True
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(joined) + 1)
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[low] * power[: len(joined)], out=sums[1:])
    words = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return words, np.concatenate(([0], np.searchsorted(start, ends))).astype(np.int64)


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its tasks, and large arrays leave holes behind."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; a null is empty and lone surrogates are replaced."""
    return b"" if text is None else text.encode("utf-8", "replace")


def slices(texts: list, limit: int = 300_000):
    """Ranges of consecutive texts of about ``limit`` characters; a longer text stands alone."""
    start = total = total_seen = 0
    for i, t in enumerate(texts):
        n = len(t) + 1
        total_seen += n
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
    if total_seen > 8 * limit:
        give_back()
