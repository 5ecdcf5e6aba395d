"""Benchmark decontamination by winnowing.

Of each w consecutive k-gram hashes the minimum is kept (ties: all of them), on both sides alike, with
k + w - 1 = WINDOW. So any WINDOW words that a document shares with an item hold a k-gram that both sides kept.
Kept hashes are joined, and each hit is extended along its diagonal: runs of WINDOW or more equal words count.
Items of fewer words are one window of their own length; they are looked up by the hash of that length.

The items' index is sent to executors in blocks of INDEX_BYTES of text at most, one scan of the documents for
each block; several blocks are merged by document.

Null texts have no words (n_words 0, not contaminated); items without words have no windows and occur
nowhere; rows of one item_id are one item; null item_ids are left out; repeated doc_ids keep a row each;
an empty benchmark hits nothing. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NOT_ALNUM, Words, arrow_texts, grams, shared_dir, slices, sliding_min, staged, table

WINDOW = 13
K = 6
INDEX_BYTES = 16 << 20


def kept(g: np.ndarray, w: int) -> np.ndarray:
    """Places of the minimum of each w consecutive hashes, all of them where there are ties."""
    if len(g) < w:
        return np.zeros(0, np.int64)
    low = sliding_min(g, w)
    # a hash is kept if it is the minimum of a window that holds it: the largest of those minima
    pad = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero(~sliding_min(~pad, w) == g)


class Index:
    """Fingerprints of items. words: hashes of all items' words in a row; first: where each item begins."""

    def __init__(self, ids: list[int], texts: list[bytes], window: int = WINDOW, k: int = K):
        w = Words(texts, NOT_ALNUM, lower=True)
        self.ids, self.window, self.k = ids, window, k
        self.words, self.first = w.hash, w.first
        fp, item, at = [], [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        for i in range(len(ids)):
            h = w.hash[w.first[i] : w.first[i + 1]]
            if len(h) >= window:
                p = kept(grams(h, k), window - k + 1)
                fp.append(grams(h, k)[p])
                item.append(np.full(len(p), i))
                at.append(p)
            elif len(h):
                self.short.setdefault(len(h), {}).setdefault(int(grams(h, len(h))[0]), []).append(i)
        fp, item, at = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((fp, np.uint64), (item, np.int64), (at, np.int64)))
        order = np.argsort(fp, kind="stable")
        self.fp, self.item, self.at = fp[order], item[order], at[order]

    def hits(self, w: Words) -> dict[int, tuple[np.ndarray, set[int]]]:
        """For each text with hits: a mask of its hit words, and the items found."""
        out: dict[int, tuple[np.ndarray, set[int]]] = {}

        def mark(doc: int, a: int, b: int, i: int) -> None:
            if doc not in out:
                out[doc] = np.zeros(w.first[doc + 1] - w.first[doc], bool), set()
            out[doc][0][a:b] = True
            out[doc][1].add(self.ids[i])

        if len(self.fp):
            g = grams(w.hash, self.k)
            p = kept(g, self.window - self.k + 1)
            a, b = np.searchsorted(self.fp, g[p], "left"), np.searchsorted(self.fp, g[p], "right")
            some = b > a
            p, a, n = p[some], a[some], (b - a)[some]
            p = np.repeat(p, n)
            e = np.repeat(a - np.cumsum(n) + n, n) + np.arange(len(p))
            doc = np.searchsorted(w.first, p, "right") - 1
            inside = p + self.k <= w.first[doc + 1]
            # one extension for each document, item and diagonal
            found = np.unique(np.stack([doc, self.item[e], p - w.first[doc] - self.at[e]])[:, inside], axis=1)
            for d, i, shift in found.T.tolist():
                x, y = w.hash[w.first[d] : w.first[d + 1]], self.words[self.first[i] : self.first[i + 1]]
                a, b = max(0, shift), min(len(x), len(y) + shift)
                same = np.flatnonzero(np.diff(np.concatenate([[0], (x[a:b] == y[a - shift : b - shift]).view(np.int8), [0]])))
                for s, t in zip(same[::2], same[1::2], strict=True):
                    if t - s >= self.window:
                        mark(d, a + s, a + t, i)
        for n, by in self.short.items():
            g = grams(w.hash, n)
            for p in np.flatnonzero(np.isin(g, np.fromiter(by, np.uint64, len(by)))).tolist():
                d = int(np.searchsorted(w.first, p, "right")) - 1
                if p + n <= w.first[d + 1]:
                    for i in by[int(g[p])]:
                        mark(d, p - w.first[d], p - w.first[d] + n, i)
        return out


def indexes(benchmark: DataFrame, window: int = WINDOW, k: int = K, limit: int = INDEX_BYTES) -> Iterator[tuple[int, Index]]:
    """How many indexes there are and each of them: over all items, each over about limit bytes of text, or one item."""
    items = benchmark.select(benchmark["item_id"].cast("long"), "text").where("item_id is not null and text is not null")
    n = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // limit)
    n = max(1, n)
    for block in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == block) if n > 1 else items
        rows = part.collect()  # about limit bytes
        yield n, Index([r["item_id"] for r in rows], [r["text"].encode() for r in rows], window, k)


def digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def finished(doc_ids, sizes, found) -> pa.RecordBatch:
    hit, items = [int(m.sum()) if m is not None else 0 for m, _ in found], [s for _, s in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array(list(map(len, items)), pa.int64()), pa.array(list(map(digest, items))), pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, sizes, strict=True)], pa.bool_())],
        [x.split()[0] for x in SCHEMA.split(", ")],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, limit: int = INDEX_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each document, and the columns to keep."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"].cast("long"), "text", *(k for k in keep if k not in ("doc_id", "text")))
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name in keep and f.name != "doc_id"]
    schema = SCHEMA + "".join(f", `{name}` {kind}" for name, kind in kinds)
    # an index is read once, and what it finds is written before the next one is made: one is held at a time
    blocks = indexes(benchmark, window, k, limit)
    n_blocks, first = next(blocks)
    found = spark.sparkContext.broadcast(first)

    def with_kept(done: pa.RecordBatch, part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*done.columns, *(part.column(name) for name, _ in kinds)], [*done.schema.names, *(name for name, _ in kinds)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                w = Words(arrow_texts(part.column("text")), NOT_ALNUM, lower=True)
                hits = found.value.hits(w)
                yield with_kept(finished(part.column("doc_id"), np.diff(w.first).tolist(), [hits.get(d, (None, set())) for d in range(len(w))]), part)

    if n_blocks == 1:
        return docs.mapInArrow(scan, schema)
    where = shared_dir(spark)
    rows = staged(docs.withColumn("row", F.monotonically_increasing_id()), f"{where}/docs")

    def scan_block(block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i, j in slices(b.column("text")):
                    w = Words(arrow_texts(b.column("text").slice(i, j - i)), NOT_ALNUM, lower=True)
                    hits = block.value.hits(w)
                    row = b.column("row").slice(i, j - i).to_pylist()
                    yield pa.RecordBatch.from_arrays([pa.array([row[d] for d in hits], pa.int64()), pa.array([np.packbits(m).tobytes() for m, _ in hits.values()], pa.binary()), pa.array([sorted(s) for _, s in hits.values()], pa.list_(pa.int64()))], ["row", "mask", "items"])

        return rows.mapInArrow(run, "row long, mask binary, items array<long>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text")):
                part = b.slice(i, j - i)
                w = Words(arrow_texts(part.column("text")), NOT_ALNUM, lower=True, hashes=False)
                sizes, out = np.diff(w.first).tolist(), []
                for n, masks, items in zip(sizes, part.column("masks").to_pylist(), part.column("items").to_pylist(), strict=True):
                    m = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x in masks or []]
                    out.append((np.logical_or.reduce(m) if m else None, {x for s in items or [] for x in s}))
                yield with_kept(finished(part.column("doc_id"), sizes, out), part)

    hits = staged(scan_block(found), f"{where}/hits0")
    for n, (_, index) in enumerate(blocks, 1):
        found.destroy()
        found = spark.sparkContext.broadcast(index)
        hits = hits.unionByName(staged(scan_block(found), f"{where}/hits{n}"))
    by = hits.groupBy("row").agg(F.collect_list("mask").alias("masks"), F.collect_list("items").alias("items"))
    return rows.join(by, "row", "left").drop("row").mapInArrow(merge, schema)


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = {
    "op6_winnowing": r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
     b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, greatest(2, len(w) - 11)), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM b WHERE len(w) > 0),
     sizes AS (SELECT DISTINCT n FROM bw),
     dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n),
     dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dp),
     h AS (SELECT doc_id, p, dw.n AS n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
     pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
     it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(array_to_string(list_sort(list_distinct(list(item_id::VARCHAR))), ',')) AS s FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)""",
}
QUERIES = {"op6_winnowing": op6_winnowing}
