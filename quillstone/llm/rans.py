"""Token ids in a binary format: static range asymmetric numeral systems.

Documents go to ranges of doc_id; in each, sorted by doc_id (nulls first), their ids are cut into shards of
about SHARD symbols. A shard is one row of the files and holds, in this order,

    magic "QRS1", crc32 of the rest, then little-endian counts
    the frequency table that all of its blocks share
    the documents: ordinal in the range, doc_id, ids in this shard, whether it goes on
    checkpoints: for each block its first symbol, first word, symbols, crc32 of its symbols
    the interleaved final states of LANES coders for each block, and the words of all blocks

Blocks are independent: a reader takes any of them with the table alone. Decoding checks both sums.

Null texts are empty documents (the end id alone). Null doc_ids come first; repeated doc_ids are documents
of their own in any order. Very long documents are cut over several shards and their sums combined.
An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_parts, slices, staged, table
from .tok import encoder

LANES = 32
BLOCK = 1 << 14
SHARD = 1 << 20
SCALE = 18
LOW = np.uint64(1 << 31)
MAGIC = b"QRS1"
#: Ranges of doc_id at most: one long for each goes to the driver.
RANGES = 10_000


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that occur and their shares of 2**SCALE, each 1 at least."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    if len(symbols) > 1 << SCALE:
        raise ValueError("more symbols than slots")
    c = counts[symbols].astype(np.float64)
    f = np.maximum(1, np.floor(c * (1 << SCALE) / c.sum())).astype(np.int64)
    left = (1 << SCALE) - int(f.sum())
    order = np.argsort(-f, kind="stable")
    if left > 0:
        f[order[0]] += left
    for i in order:
        if left >= 0:
            break
        take = min(int(f[i]) // 2, -left)
        f[i] -= take
        left += take
    if f.sum() != 1 << SCALE:
        for i in np.argsort(-f, kind="stable"):
            take = min(int(f[i]) - 1, int(f.sum()) - (1 << SCALE))
            f[i] -= take
            if f.sum() == 1 << SCALE:
                break
    return symbols, f


def _encode(ranks: np.ndarray, f: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ranks: blocks x steps x LANES. Final states (blocks x LANES), words in reading order, words of each block."""
    blocks, steps, lanes = ranks.shape
    x = np.full((blocks, lanes), LOW, np.uint64)
    words, mask = np.zeros(ranks.shape, np.uint32), np.zeros(ranks.shape, bool)
    f64, s64, scale = f.astype(np.uint64), start.astype(np.uint64), np.uint64(SCALE)
    most = (LOW >> scale << np.uint64(32)) * f64
    for t in range(steps - 1, -1, -1):
        r = ranks[:, t]
        fr = f64[r]
        m = x >= most[r]
        words[:, t] = x.astype(np.uint32)
        mask[:, t] = m
        x = np.where(m, x >> np.uint64(32), x)
        q = x // fr
        x = (q << scale) + (x - q * fr) + s64[r]
    return x, words[mask], mask.reshape(blocks, -1).sum(axis=1)


def _decode(x: np.ndarray, words: np.ndarray, at: np.ndarray, steps: int, slot: np.ndarray, f: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Ranks, blocks x steps x LANES; x: final states, at: place of each block's first word."""
    out = np.empty((len(x), steps, x.shape[1]), np.int32)
    f64, s64, scale, low = f.astype(np.uint64), start.astype(np.uint64), np.uint64(SCALE), np.uint64((1 << SCALE) - 1)
    at, words = at.astype(np.int64).copy(), np.append(words, np.uint32(0))
    for t in range(steps):
        got = x & low
        r = slot[got.astype(np.int64)]
        out[:, t] = r
        x = f64[r] * (x >> scale) + got - s64[r]
        need = x < LOW
        k = np.cumsum(need, axis=1)
        w = words[np.minimum(at[:, None] + k - 1, len(words) - 1)]
        x = np.where(need, (x << np.uint64(32)) | w.astype(np.uint64), x)
        at += k[:, -1]
    return out


def pack_shard(ids: np.ndarray, docs: list[tuple[int, int | None, int, bool, bool]]) -> bytes:
    """One shard. docs: ordinal, doc_id, ids in this shard, whether the document goes on in the next and began before."""
    symbols, f = frequencies(ids)
    start = np.cumsum(f) - f
    rank = np.zeros(int(symbols[-1]) + 1, np.int32)
    rank[symbols] = np.arange(len(symbols))
    ranks = rank[ids]
    whole = len(ids) // BLOCK
    parts = [(ranks[: whole * BLOCK].reshape(whole, BLOCK // LANES, LANES),)] if whole else []
    if rest := len(ids) - whole * BLOCK:
        parts.append((np.pad(ranks[whole * BLOCK :], (0, -rest % LANES), mode="edge").reshape(1, -1, LANES),))
    made = [_encode(*p, f, start) for p in parts]
    states, words, sizes = np.concatenate([m[0] for m in made]), np.concatenate([m[1] for m in made]), np.concatenate([m[2] for m in made])
    n = len(sizes)
    check = np.zeros(n, np.dtype([("symbol", "<u8"), ("word", "<u8"), ("symbols", "<u4"), ("crc", "<u4")]))
    check["symbol"], check["word"] = np.arange(n) * BLOCK, np.cumsum(sizes) - sizes
    check["symbols"] = np.minimum(BLOCK, len(ids) - check["symbol"])
    raw = ids.astype("<u4").tobytes()
    check["crc"] = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(check["symbol"].tolist(), check["symbols"].tolist(), strict=True)]
    freq = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes() + f.astype("<u4").tobytes(), 6)
    index = zlib.compress(b"".join(struct.pack("<qq?I??", o, d or 0, d is None, k, more, begun) for o, d, k, more, begun in docs), 6)
    body = struct.pack("<QIIIIQ", len(ids), len(symbols), n, len(freq), len(index), len(words)) + freq + index + check.tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


class Shard:
    """A reader of one shard; blocks(a, b) decodes any run of blocks alone."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or struct.unpack_from("<I", data, 4)[0] != zlib.crc32(data[8:]):
            raise ValueError("not a whole shard")
        self.n, kinds, blocks, f_len, i_len, n_words = struct.unpack_from("<QIIIIQ", data, 8)
        at = 8 + struct.calcsize("<QIIIIQ")
        table = np.frombuffer(zlib.decompress(data[at : at + f_len]), "<u4").astype(np.int64)
        self.symbols, self.f = np.cumsum(table[:kinds]), table[kinds:]
        at += f_len
        self.docs = list(struct.iter_unpack("<qq?I??", zlib.decompress(data[at : at + i_len])))
        at += i_len
        kind = np.dtype([("symbol", "<u8"), ("word", "<u8"), ("symbols", "<u4"), ("crc", "<u4")])
        self.check = np.frombuffer(data, kind, blocks, at)
        at += blocks * kind.itemsize
        self.states = np.frombuffer(data, "<u8", blocks * LANES, at).reshape(blocks, LANES)
        self.words = np.frombuffer(data, "<u4", n_words, at + blocks * LANES * 8)
        self.start = np.cumsum(self.f) - self.f
        self.slot = np.repeat(np.arange(kinds, dtype=np.int32), self.f)

    def blocks(self, a: int, b: int) -> np.ndarray:
        """Ids of blocks a to b; a block whose sum is wrong raises."""
        out = []
        for x, y in ((a, b),) if b < len(self.check) or self.check["symbols"][-1] == BLOCK else ((a, b - 1), (b - 1, b)):
            if x < y:
                steps = -(-int(self.check["symbols"][x]) // LANES)
                r = _decode(self.states[x:y].astype(np.uint64), self.words, self.check["word"][x:y], steps, self.slot, self.f, self.start)
                out += [self.symbols[r[k].ravel()[: int(self.check["symbols"][x + k])]] for k in range(y - x)]
        for k, ids in enumerate(out):
            if zlib.crc32(ids.astype("<u4").tobytes()) != self.check["crc"][a + k]:
                raise ValueError(f"block {a + k} has a wrong sum")
        return np.concatenate(out).astype("<u4")

    def ids(self) -> np.ndarray:
        return self.blocks(0, len(self.check))


def crc32_combine(a: int, b: int, length: int) -> int:
    """crc32 of two strings in a row from their sums and the second's length in bytes."""

    def times(m: list[int], v: int) -> int:
        s, i = 0, 0
        while v:
            if v & 1:
                s ^= m[i]
            v >>= 1
            i += 1
        return s

    m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, x) for x in m]  # 8 bits
    while length:
        if length & 1:
            a = times(m, a)
        m = [times(m, x) for x in m]
        length >>= 1
    return a ^ b


def encode_documents(docs: DataFrame, where: str, vocabulary: str = "byte_bpe_50k.json", end: int = 0, shard: int = SHARD) -> None:
    """Encode every text, append the end id, and write the files (columns span, shard, first, n_ids, data) at where."""
    spark = docs.sparkSession
    n = max(1, min(RANGES, 2 * shuffle_parts(spark)))
    docs = docs.select(docs["doc_id"].cast("long"), "text")
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10 * n)).first()[0] or []
    bounds = np.unique(np.array(cuts, np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for i, j in slices(b.column("text"), 2 << 20):
                doc = b.column("doc_id").slice(i, j - i)
                key = np.searchsorted(bounds, doc.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
                ids, first = enc.flat([t or "" for t in b.column("text").slice(i, j - i).to_pylist()])
                ids, first = np.insert(ids, first[1:], end), first + np.arange(len(first))
                # two bytes an id, or an odd length with four
                if ids.max() < 1 << 16:
                    small = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(2 * first), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
                else:
                    raw = ids.astype("<u4").tobytes()
                    small = pa.array([b"\1" + raw[4 * x : 4 * y] for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int32()), doc, small], ["span", "doc_id", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, ordinal, number, first = None, 0, 0, 0
        parts: list[np.ndarray] = []
        index: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, first, parts, index, held
            ids = np.concatenate(parts)
            out = pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([pack_shard(ids, index)], pa.binary())], ["span", "shard", "first", "n_ids", "data"])
            number, first, parts, index, held = number + 1, first + len(ids), [], [], 0
            return out

        for b in batches:
            for s, d, raw in zip(*(b.column(c).to_pylist() for c in ("span", "doc_id", "ids")), strict=True):
                if s != span:
                    if held:
                        yield flush()
                    span, ordinal, number, first = s, 0, 0, 0
                ids = np.frombuffer(raw, "<u2").astype(np.int64) if len(raw) % 2 == 0 else np.frombuffer(raw[1:], "<u4").astype(np.int64)
                at = 0
                while at < len(ids):
                    take = min(len(ids) - at, shard)
                    parts.append(ids[at : at + take])
                    at += take
                    index.append((ordinal, d, take, at < len(ids), at > take))
                    held += take
                    if held >= shard:
                        yield flush()
                ordinal += 1
        if held:
            yield flush()

    made = docs.mapInArrow(encode, "span int, doc_id long, ids binary").repartition(n, "span").sortWithinPartitions("span", "doc_id")
    made.mapInArrow(pack, "span int, shard int, first long, n_ids long, data binary").write.mode("overwrite").option("compression", "none").parquet(where)


def decode_documents(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files alone."""
    files = spark.read.parquet(where)
    # one row for each range, RANGES at most
    totals = files.groupBy("span").agg(F.sum("n_ids").alias("n")).orderBy("span").collect()
    spans = np.array([r["span"] for r in totals], np.int64)
    base = np.cumsum([0, *(r["n"] for r in totals)])[:-1]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [("span", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("whole", pa.bool_())]
        for b in batches:
            for span, first, data in zip(b.column("span").to_pylist(), b.column("first").to_pylist(), b.column("data"), strict=True):
                s = Shard(data.as_py())
                raw = s.ids().tobytes()
                at, out, above = 0, [], first + int(base[np.searchsorted(spans, span)])
                for o, d, null, n, more, begun in s.docs:
                    out.append((span, o, None if null else d, above + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), not more and not begun))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), kinds, strict=True)], [k for k, _ in kinds])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, parts in zip(b.column("doc_id").to_pylist(), b.column("parts").to_pylist(), strict=True):
                crc = parts[0]["ids_crc32"]
                for p in parts[1:]:
                    crc = crc32_combine(crc, p["ids_crc32"], 4 * p["n_tokens"])
                out.append((d, parts[0]["start"], sum(p["n_tokens"] for p in parts), crc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    pieces = files.select("span", "first", "data").mapInArrow(rows, "span int, ordinal long, doc_id long, start long, n_tokens long, ids_crc32 long, whole boolean")
    pieces = staged(pieces, where + "-index")
    cut = pieces.where("not whole").groupBy("span", "ordinal").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("start", "n_tokens", "ids_crc32"))).alias("parts"))
    return pieces.where("whole").select("doc_id", "start", "n_tokens", "ids_crc32").unionByName(cut.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def op2_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = f"{shared_dir(spark)}/ids"
    encode_documents(table(spark, sf_dir, "documents"), where)
    return decode_documents(spark, where)


SQL: dict[str, str] = {}
QUERIES = {"op2_rans_ids": op2_rans_ids}
