"""Shared parts of the training-data operators: the shared folder, vectorised words, hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one numpy step takes at once; a longer document is a step of its own.
STEP_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are no ASCII letter or digit; those of 0x80 and above belong to words.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:0x30] = NOT_ALNUM[0x3A:0x41] = NOT_ALNUM[0x5B:0x61] = NOT_ALNUM[0x7B:0x80] = True

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_R = np.uint64(0x9E3779B97F4A7C15)
_R_INV = np.uint64(pow(int(_R), -1, 2**64))
_GRAM = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share; where none is set, a local one in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/quillstone-{uuid.uuid4().hex}"


def staged(df: DataFrame, where: str) -> DataFrame:
    """Write and read again: cuts the lineage, and no later step computes df twice."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(kind: str, n: int) -> np.ndarray:
    got = _POWERS.get(kind)
    if got is None or len(got) < n:
        size = max(n, STEP_BYTES + 1)
        base = np.full(size, _R if kind == "r" else _R_INV, np.uint64)
        base[0] = 1
        got = np.multiply.accumulate(base)
        if size <= 4 * STEP_BYTES:
            _POWERS[kind] = got
    return got[:n]


def slices(texts: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or one row; nulls count nothing."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a, total = 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            yield a, i
            a, total = i, 0
        total += int(n)
    if a < len(sizes):
        yield a, len(sizes)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each span of bytes, the same wherever it stands."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    h = (_BYTE_LOWER if lower else _BYTE)[data]
    h *= _powers("r", n)
    np.cumsum(h, out=h)
    before = np.where(start > 0, h[start - 1], np.uint64(0))
    return mix((h[end - 1] - before) * _powers("i", n)[start] + (end - start).astype(np.uint64) * _GRAM[63])


class Words:
    """The words of several texts in one buffer.

    start, end: byte places of each word in data; hash: its 64-bit hash; first: at row i the index of
    the first word of text i, len(texts) + 1 entries. Null texts have no words.
    """

    def __init__(self, texts: list[bytes | None], sep: np.ndarray = SPACE, lower: bool = False, hashes: bool = True):
        self.raw = b" ".join(t or b"" for t in texts) + b" "
        data = self.data = np.frombuffer(self.raw, np.uint8)
        lens = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
        bounds = np.concatenate([[0], np.cumsum(lens)])
        word = ~sep[data]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.start, bounds)
        self.bounds = bounds
        if hashes:
            self.hash = span_hashes(data, self.start, self.end, lower)

    def __len__(self) -> int:
        return len(self.first) - 1

    def text(self, a: int, b: int) -> list[bytes]:
        return [self.raw[s:e] for s, e in zip(self.start[a:b].tolist(), self.end[a:b].tolist(), strict=True)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, one for each start; empty with fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n] * _GRAM[0]
    for j in range(1, k):
        out = mix(out) + h[j : j + n] * _GRAM[j % 61]
    return mix(out + np.uint64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def sliding_argmin(x: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each w consecutive values and its first place."""
    out, at, have = x, np.arange(len(x)), 1
    while have < w:
        step = min(have, w - have)
        right = out[step:] < out[:-step]
        out, at = np.where(right, out[step:], out[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return out, at


def arrow_texts(col: pa.Array) -> list[bytes | None]:
    return col.cast(pa.binary()).to_pylist()


def crc32_column(col):
    """Unsigned crc32 of a column's text form, as a long."""
    from pyspark.sql import functions as F

    return F.crc32(col.cast("string").cast("binary"))
