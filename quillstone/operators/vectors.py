"""Top-k search over blocks of vectors, and product quantisation with an exact rerank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import store

#: Vectors in a block of each side. A pair of blocks is one task's unit: bounded, and as many as rows x queries need.
ROWS, QUERIES = 5000, 256
#: Hits that a task holds before it gives those of its oldest block of queries.
HELD = 500_000
#: Vectors that codebooks are fitted on; every vector is coded.
SAMPLE = 20_000
_BLOCK = "n int, ids binary, rows binary"
_HIT = "query_id long, vec_id long, score double"


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of at most size vectors (vec_id, embedding): ids and doubles as bytes. Null vectors are left out."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                part = b.slice(at, size)
                ids = part.column(0).to_numpy(zero_copy_only=False).astype("<i8")
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], ["n", "ids", "rows"])

    return vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(made, _BLOCK)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by id."""
    k = min(k, len(scores))
    near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def topk(vectors: DataFrame, queries: DataFrame, k: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, vector_blocks: DataFrame | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the k best of all vectors for each of a stated set of queries.

    A task holds the best of its own pairs of blocks for a bounded number of queries; a window over what tasks give, not over all scores, gives the ranks.
    Blocks are written once and a pair is scored where it lies in its Arrow batch, which Spark bounds by bytes: the memory of a task doesn't
    depend on how many pairs it has.
    score: from (queries, rows) to scores; the inner product by default.
    """
    left = store.kept(blocks(queries, QUERIES).select(F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows")), "queries")
    right = store.kept((blocks(vectors, ROWS) if vector_blocks is None else vector_blocks).select("ids", "rows"), "vectors")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}

        def given(of: bytes) -> pa.RecordBatch:
            hits = held.pop(of)
            q = np.repeat(np.frombuffer(of, "<i8"), [len(i) for i, _ in hits])
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for i, _ in hits])), pa.array(np.concatenate([x for _, x in hits]))], ["query_id", "vec_id", "score"])

        for b in batches:
            for j in range(b.num_rows):
                of, q_rows, ids, rows = b.column(1)[j].as_py(), b.column(2)[j].as_buffer(), b.column(3)[j].as_buffer(), b.column(4)[j].as_buffer()
                ids = np.frombuffer(ids, "<i8")
                q = np.frombuffer(q_rows, "<f8").reshape(b.column(0)[j].as_py(), -1)
                s = np.round(score(q, rows) if score else q @ np.frombuffer(rows, "<f8").reshape(len(ids), -1).T, 6)
                new = [(ids[at], x[at]) for x in s for at in (best(x, ids, k),)]
                if of in held:
                    both = [(np.concatenate(i), np.concatenate(x)) for i, x in (zip(o, n, strict=True) for o, n in zip(held[of], new, strict=True))]
                    new = [(i[at], x[at]) for i, x in both for at in (best(x, i, k),)]
                elif (len(held) + 1) * QUERIES * k > HELD and held:
                    yield given(next(iter(held)))
                held[of] = new
        for of in list(held):
            yield given(of)

    hits = left.crossJoin(right).select("q_n", "q_ids", "q_rows", "ids", "rows").mapInArrow(scored, _HIT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def train(vectors: DataFrame, parts: int, codes: int = 256, rounds: int = 12, sample: int = SAMPLE) -> np.ndarray:
    """Codebooks, parts x codes x width, by k-means on at most sample vectors in the order of a hash of their ids."""
    rows = vectors.where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    x = np.array([r["e"] for r in rows])
    if not len(x) or x.shape[1] % parts:
        raise ValueError("no vectors, or a length that the parts don't divide")
    width = x.shape[1] // parts
    books = np.empty((parts, codes, width))
    for p in range(parts):
        y = x[:, p * width : (p + 1) * width]
        c = y[np.arange(codes) * len(y) // codes]
        for _ in range(rounds):
            near = nearest(y, c)
            total = np.zeros_like(c)
            np.add.at(total, near, y)
            n = np.bincount(near, minlength=codes)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        books[p] = c
    return books


def nearest(y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The closest row of c for each row of y."""
    return np.argmin((c * c).sum(1) - 2 * (y @ c.T), axis=1)


def coded(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """Blocks as blocks() gives them, with a byte for each part of a vector in place of its doubles."""
    parts, _, width = books.shape

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for n, rows in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = np.frombuffer(rows, "<f8").reshape(n, parts, width)
                out.append(np.stack([nearest(x[:, p], books[p]) for p in range(parts)], axis=1).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["n", "ids", "rows"])

    return blocks(vectors, ROWS).mapInArrow(made, _BLOCK)


def pq_search(vectors: DataFrame, queries: DataFrame, k: int, depth: int = 400, parts: int = 16, books: np.ndarray | None = None) -> DataFrame:
    """query_id, vec_id, score, rank: the depth best by codes, then the k best of those by the exact inner product."""
    books = train(vectors, parts) if books is None else books
    width = books.shape[2]

    def by_codes(q: np.ndarray, rows: bytes) -> np.ndarray:
        codes = np.frombuffer(rows, np.uint8).reshape(-1, len(books))
        return sum(q[:, p * width : (p + 1) * width] @ books[p].T[:, codes[:, p]] for p in range(len(books)))

    near = topk(vectors, queries, depth, by_codes, coded(vectors, books)).select("query_id", "vec_id")
    v, q = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"))
    exact = F.aggregate(F.zip_with("embedding", "q", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = near.join(v, "vec_id").join(q, "query_id").select("query_id", "vec_id", F.round(exact, 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their place from 0 in an order: sorted in ranges, each of which begins where those before it end."""
    from pyspark.sql import Window

    ranged = rows.orderBy(*order).withColumn("part_", F.spark_partition_id())
    w = Window.partitionBy("part_").orderBy(*order)
    ranged = ranged.withColumn("in_", F.row_number().over(w) - 1)
    sizes = ranged.groupBy("part_").agg(F.count(F.lit(1)).alias("size_"))
    # a row for each partition
    before = sizes.withColumn("before_", F.coalesce(F.sum("size_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(before, "part_").withColumn(name, (F.col("before_") + F.col("in_")).cast("long")).drop("part_", "in_", "size_", "before_")


def gather(rows: DataFrame, wanted: DataFrame, key: str = "row") -> DataFrame:
    """The rows of some numbers; a number beyond the last raises when they are read."""
    got = wanted.join(rows.withColumn("there_", F.lit(True)), key, "left")
    ok = F.when(F.col("there_").isNull(), F.raise_error(F.concat(F.lit("no row "), F.col(key).cast("string")))).otherwise(F.col(key))
    return got.withColumn(key, ok).drop("there_")
