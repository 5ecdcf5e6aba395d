"""Removal of repeated passages by FM-indexes over shards.

A window is WINDOW consecutive words of a document; words covered by a window that also starts earlier go.

1. Routing. Each window takes the least hash among its K-word grams; a run of windows with one minimum is a
   fragment. Equal windows have equal minima, so an index over the fragments of some minima judges all
   windows with those minima. Fragments whose minimum occurs once in the corpus are done with. In each task,
   equal minima are put together first: one row a task goes to the exchange for each.
2. Shards. Remaining fragments go to shards by their minimum (by the whole window for minima with very many
   fragments, so that a line which most documents share isn't one shard). Equal fragments of a task, and then
   of a shard, are put together: all but the first are repeated for certain.
3. Index. A shard's fragments are one text of word numbers. Its suffixes are sorted, the Burrows-Wheeler transform
   goes into a wavelet tree (level by level, bits packed, with counts for ranks), and the fragments are
   streamed backwards through it: each step narrows the interval of suffixes that match. A place's
   matching statistic is cut at WINDOW; where it reaches WINDOW, the interval's earliest place tells whether the
   window starts earlier elsewhere.
4. Repeated windows go back to their documents, which drop the covered words.

Words are compared by 64-bit hashes. doc_id identifies a document: equal rows that share one are the same place,
and neither is earlier; rows with a null doc_id are returned unchanged and are nobody's earlier text. Null texts
have no words. An empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Words, arrow_texts, grams, mix, shared_dir, shuffle_parts, slices, sliding_argmin, staged, table

WINDOW = 20
K = 6
#: Words of one index.
SHARD_WORDS = 400_000
#: Fragments of a minimum beyond which its windows are routed one by one; such minima (8 bytes each) are broadcast up to
#: HOT_MINIMA of them, else joined with every minimum's fragments dealt out over SALTS tasks.
HOT, HOT_MINIMA, SALTS = 1_000, 100_000, 32


class WaveletTree:
    """Ranks of symbols in a sequence; the tree's nodes of one level lie side by side (a wavelet matrix)."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.sums, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros(len(seq) // 64 + 1, "<u8")
            raw = np.packbits(bit, bitorder="little")
            packed.view(np.uint8)[: len(raw)] = raw
            self.bits.append(packed)
            self.sums.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])
        self.base = self._walk(np.zeros(sigma, np.int64), np.arange(sigma))

    def _walk(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for n, (bits, sums, zeros) in enumerate(zip(self.bits, self.sums, self.zeros, strict=True)):
            word = at >> 6
            ones = sums[word] + np.bitwise_count(bits[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> (self.levels - 1 - n) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(at, symbol) - self.base[symbol]


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling; what is in place already isn't sorted again."""
    n = len(seq)
    sa = np.argsort(seq, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.concatenate([[True], seq[sa][1:] != seq[sa][:-1]])
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    h = 1
    single = new & np.concatenate([new[1:], [True]])
    todo = np.flatnonzero(~single)
    while len(todo):
        part = sa[todo]
        after = part + h
        key2 = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[part] * np.int64(n + 2) + key2
        order = np.argsort(key, kind="stable")
        sa[todo] = part = part[order]
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = todo[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[part] = start
        single = new & np.concatenate([new[1:], [True]])
        todo = todo[~single]
        h *= 2
    return sa


class FMIndex:
    """Fragments of word hashes, each closed by a mark of its own."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        """first: where each fragment begins in words, with the end."""
        n = len(first) - 1
        kinds, ids = np.unique(words, return_inverse=True)
        self.n, self.size = n, np.diff(first)
        self.start = first[:-1] + np.arange(n)  # of each fragment in the text
        text = np.empty(len(words) + n, np.int64)
        ends = self.start + self.size
        is_word = np.ones(len(text), bool)
        is_word[ends] = False
        text[is_word] = ids + 1
        text[ends] = 0
        # marks differ from each other for sorting and are one symbol in the tree
        self.text = text
        sa = suffix_array(np.where(is_word, text + n, np.cumsum(~is_word) - 1))
        self.sa = sa
        sigma = len(kinds) + 1
        self.tree = WaveletTree(text[sa - 1], sigma)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams all fragments: for windows (by their start in the text) that occur at least twice, the interval of suffixes."""
        count = np.maximum(0, self.size - width + 1)
        lane = np.repeat(self.start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), len(self.text), np.int64)
        for step in range(width - 1, -1, -1):
            c = self.text[lane + step]
            if step == width - 1:
                lo, hi = self.less[c], self.less[c + 1]
            else:
                both = self.tree.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.tile(self.less[c], 2)
                lo, hi = both[: len(c)], both[len(c) :]
            more = hi - lo > 1  # else it matches nothing but itself
            lane, lo, hi = lane[more], lo[more], hi[more]
            if not len(lane):
                break
        return lane, lo, hi


def repeated_windows(words: np.ndarray, first: np.ndarray, doc: np.ndarray, at: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Fragment and offset of each window that starts earlier elsewhere. doc, at: where each fragment begins."""
    fm = FMIndex(words, first)
    lane, lo, hi = fm.windows(width)
    if not len(lane):
        return lane, lane
    # places of the text in order of (document, start); equal places are equal
    frag = np.repeat(np.arange(fm.n), fm.size + 1)
    offset = np.arange(len(fm.text)) - fm.start[frag]
    order = np.lexsort((at[frag] + offset, doc[frag]))
    d, s = doc[frag][order], (at[frag] + offset)[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(np.concatenate([[0], (np.diff(d) != 0) | (np.diff(s) != 0)]))
    # intervals of one width are equal or apart: one minimum for each
    starts, which = np.unique(lo, return_inverse=True)
    ends = np.zeros(len(starts), np.int64)
    ends[which] = hi
    edges = np.stack([starts, ends], axis=1).ravel()
    line = np.append(place[fm.sa], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(line, edges)[::2]
    again = place[lane] > least[which]
    lane = lane[again]
    return frag[lane], offset[lane]


def fragments(w: Words, width: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, windows and minimum of each fragment of several texts."""
    g = grams(w.hash, k)
    if len(g) < width - k + 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    low, place = sliding_argmin(g, width - k + 1)
    starts, sizes = w.first[:-1], np.diff(w.first)
    count = np.maximum(0, sizes - width + 1)
    doc = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    m, place = low[starts[doc] + at], place[starts[doc] + at]
    # by place: a text that repeats itself has one minimum at several places, and so several fragments
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])])) if len(doc) else np.zeros(0, np.int64)
    n = np.diff(np.append(new, len(doc)))
    return doc[new], at[new], n, m[new]


def route_rows(docs: DataFrame) -> DataFrame:
    """m, doc_id, at, n, c: fragments of all texts, c of them with this minimum in the task's slice.

    Where c > 1 the minimum is known to be repeated; its first row stands for all in the count.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in slices(b.column("text"), 2 << 20):
                ids = b.column("doc_id").slice(i, j - i).to_numpy()
                doc, at, n, m = fragments(Words(arrow_texts(b.column("text").slice(i, j - i))))
                order = np.argsort(m, kind="stable")
                new = np.flatnonzero(np.concatenate([[True], np.diff(m[order]) != 0])) if len(m) else np.zeros(0, np.int64)
                c = np.diff(np.append(new, len(m)))
                lead, counts = np.zeros(len(m), np.int64), np.repeat(c, c)
                lead[new] = c
                yield pa.RecordBatch.from_arrays([pa.array(m[order].view(np.int64)), pa.array(ids[doc[order]]), pa.array(at[order].astype(np.int32)), pa.array(n[order].astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(counts > 1)], ["m", "doc_id", "at", "n", "c", "known"])

    return docs.where("doc_id is not null and length(text) >= 39").mapInArrow(rows, "m long, doc_id long, at int, n int, c int, known boolean")


def candidates(docs: DataFrame, where: str) -> DataFrame:
    """Fragments whose minimum occurs twice or more: doc_id, at, n, m, and whether the minimum has very many (hot)."""
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    # rows that stand for none need no count: they are dealt out evenly
    dealt = route_rows(docs).withColumn("to", F.when(F.col("c") > 0, F.col("m")).otherwise(F.xxhash64("doc_id", "at")))
    dealt = dealt.repartition(parts, "to").sortWithinPartitions("to")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            c, to = b.column("c").to_numpy(), b.column("to").to_numpy()
            new = np.concatenate([[True], to[1:] != to[:-1]])
            group = np.cumsum(new) - 1
            total = np.bincount(group, weights=c).astype(np.int64)
            keep = (c == 0) | b.column("known").to_numpy(zero_copy_only=False) | (total[group] > 1)
            lead = np.where(new & (c > 0), total[group], 0)
            return pa.RecordBatch.from_arrays([*(b.column(x) for x in ("m", "doc_id", "at", "n")), pa.array(lead)], ["m", "doc_id", "at", "n", "total"]).filter(pa.array(keep))

        for b in batches:
            if held is not None and held.num_rows:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            to = b.column("to").to_numpy()
            cut = int(np.searchsorted(to, to[-1], "left")) if len(to) else 0
            # the last minimum may go on in the next batch; rows of one minimum are one a slice at most
            if cut:
                yield run(b.slice(0, cut))
            held = b.slice(cut)
        if held is not None and held.num_rows:
            yield run(held)

    got = staged(dealt.mapInArrow(rows, "m long, doc_id long, at int, n int, total long"), f"{where}/candidates")
    hot = staged(got.where(F.col("total") > HOT).select("m", F.lit(True).alias("hot")), f"{where}/hot")
    got, n = got.select("doc_id", "at", "n", "m"), hot.count()
    if n == 0:
        return got.withColumn("hot", F.lit(False))
    if n <= HOT_MINIMA:
        got = got.join(F.broadcast(hot), "m", "left")
    else:
        hot = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        got = got.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(hot, ["m", "salt"], "left").drop("salt")
    return got.withColumn("hot", F.coalesce("hot", F.lit(False)))


def packed(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, the compressed text and the columns to keep, for exchanges."""
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name in keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if t is None else z.compress(t) for t in arrow_texts(b.column("text"))], pa.binary()), *(b.column(k) for k, _ in kinds)], ["doc_id", "z", *(f"keep_{k}" for k, _ in kinds)])

    return docs.mapInArrow(rows, "doc_id long, z binary" + "".join(f", `keep_{k}` {kind}" for k, kind in kinds))


def unpacked(col: pa.Array) -> list[bytes | None]:
    z = zstandard.ZstdDecompressor()
    return [None if x is None else z.decompress(x) for x in col.to_pylist()]


def in_steps(col: pa.Array, limit: int = 300_000) -> Iterator[tuple[int, int]]:
    return slices(col, limit)


def to_shards(docs: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """route, content, doc_id, at, n: a row for each different fragment of a step; content null: repeated for certain."""
    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "m", "hot")).alias("f"))
    joined = packed(docs.where("doc_id is not null and text is not null")).join(by_doc, "doc_id")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in in_steps(b.column("z")):
                w = Words(unpacked(b.column("z").slice(i, j - i)))
                lists = b.column("f").slice(i, j - i)
                flat = lists.flatten()
                sizes = lists.value_lengths().to_numpy()
                doc = np.repeat(np.arange(j - i), sizes)
                at, n, m = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
                is_hot = flat.field(3).to_numpy(zero_copy_only=False).astype(bool)
                # rows that share a doc_id with another text may name words that aren't there
                ok = at + n + width - 1 <= np.diff(w.first)[doc]
                doc, at, n, m, is_hot = doc[ok], at[ok], n[ok], m[ok], is_hot[ok]
                if is_hot.any():
                    h = grams(w.hash, width)
                    one = np.flatnonzero(is_hot)
                    d, a = np.repeat(doc[one], n[one]), np.repeat(at[one] - np.cumsum(n[one]) + n[one], n[one]) + np.arange(int(n[one].sum()))
                    doc, at, m = np.concatenate([doc[~is_hot], d]), np.concatenate([at[~is_hot], a]), np.concatenate([m[~is_hot], h[w.first[d] + a].view(np.int64)])
                    n = np.concatenate([n[~is_hot], np.ones(len(d), np.int64)])
                ids = b.column("doc_id").slice(i, j - i).to_numpy()[doc]
                order = np.lexsort((at, ids))
                seen: dict[bytes, tuple[int, int]] = {}
                out: list[tuple] = []
                s, e = w.start[w.first[doc] + at], w.end[w.first[doc] + at + n + width - 2]
                for x in order.tolist():
                    content = w.raw[s[x] : e[x]]
                    here = int(ids[x]), int(at[x])
                    if seen.setdefault(content, here) != here:
                        out.append((int(mix(np.array([x], np.uint64))[0] >> np.uint64(1)), None, *here, int(n[x])))
                    else:
                        out.append((int(m[x]), content, *here, int(n[x])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["route", "content", "doc_id", "at", "n"])

    return joined.mapInArrow(rows, "route long, content binary, doc_id long, at int, n int")


def judge(fragments_: DataFrame, parts: int, width: int) -> DataFrame:
    """doc_id, at, n: runs of windows that start earlier elsewhere."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[int, int]] = {}
        sure: list[tuple[int, int, int]] = []
        size, route = 0, None

        def index() -> pa.RecordBatch:
            nonlocal held, sure, size
            if held:
                w = Words(list(held))
                pos = np.array(list(held.values()), np.int64)
                f, o = repeated_windows(w.hash, w.first, pos[:, 0], pos[:, 1], width)
                order = np.lexsort((o, f))
                f, o = f[order], o[order]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(f) != 0) | (np.diff(o) != 1)])) if len(f) else np.zeros(0, np.int64)
                run = np.diff(np.append(new, len(f)))
                sure += zip(pos[f[new], 0].tolist(), (pos[f[new], 1] + o[new]).tolist(), run.tolist(), strict=True)
            out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in sure], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "at", "n"])
            held, sure, size = {}, [], 0
            return out

        for b in batches:
            for r, content, d, a, n in zip(*(b.column(c).to_pylist() for c in ("route", "content", "doc_id", "at", "n")), strict=True):
                if content is None:
                    sure.append((d, a, n))
                    continue
                if r != route:
                    if size > SHARD_WORDS:
                        yield index()
                    route = r
                here, known = (d, a), held.get(content)
                if known is None:
                    held[content] = here
                    size += n + width - 1
                elif known != here:  # the later of two equal fragments is repeated
                    later = max(known, here)
                    held[content] = min(known, here)
                    sure.append((*later, n))
        if held or sure:
            yield index()

    return fragments_.repartition(parts, "route").sortWithinPartitions("route").mapInArrow(rows, "doc_id long, at int, n int")


def without_repeats(docs: DataFrame, width: int = WINDOW, with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the text that stays, with_text; null if text was), and columns to keep."""
    spark = docs.sparkSession
    where = shared_dir(spark)
    docs = docs.select(docs["doc_id"].cast("long"), "text", *keep)
    found = candidates(docs.select("doc_id", "text"), where)
    repeated = staged(judge(to_shards(docs.select("doc_id", "text"), found, width), shuffle_parts(spark), width), f"{where}/repeated")
    by_doc = repeated.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n")).alias("r"))
    rows_ = packed(docs, *keep).join(by_doc, "doc_id", "left")
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema if f.name in keep]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in in_steps(b.column("z")):
                texts = unpacked(b.column("z").slice(i, j - i))
                w = Words(texts, hashes=False)
                out = []
                for d, runs in enumerate(b.column("r").slice(i, j - i).to_pylist()):
                    n = int(w.first[d + 1] - w.first[d])
                    gone = np.zeros(n + 1, np.int64)
                    for r in runs or ():
                        if r["at"] + r["n"] + width - 1 <= n:
                            gone[r["at"]] += 1
                            gone[r["at"] + r["n"] + width - 1] -= 1
                    keep = np.cumsum(gone)[:n] == 0
                    all_ = w.text(int(w.first[d]), int(w.first[d + 1]))
                    text = b" ".join([x for x, k in zip(all_, keep.tolist(), strict=True) if k] if runs else all_)
                    out.append((n, int(n - keep.sum()), hashlib.sha256(text).hexdigest(), None if texts[d] is None else texts[d] if keep.all() else text))
                cols = list(zip(*out, strict=True))
                got = [b.column("doc_id").slice(i, j - i), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2])]
                got += [pa.array([None if t is None else t.decode() for t in cols[3]], pa.string())] if with_text else []
                got += [b.column(f"keep_{k}").slice(i, j - i) for k, _ in kinds]
                yield pa.RecordBatch.from_arrays(got, [*["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: 4 + with_text], *(k for k, _ in kinds)])

    return rows_.mapInArrow(rows, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text + "".join(f", `{k}` {kind}" for k, kind in kinds))


def op3_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


def repeats_sql(source: str) -> str:
    """DuckDB CTEs up to kept(doc_id, w, p) with the kept words' places, over a relation with doc_id and text."""
    return rf"""
rw AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {source}),
rg AS (SELECT doc_id, p, md5_number(array_to_string(w[p:p + 19], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM rw WHERE len(w) >= 20)),
rr AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM rg) WHERE k > 1),
rc AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM rr),
rk AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS q FROM rw) a ANTI JOIN rc USING (doc_id, q) GROUP BY 1),
rout AS (SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, coalesce(t, '') AS t FROM rw LEFT JOIN rk USING (doc_id))"""


SQL = {"op3_fm_index": f"WITH {repeats_sql('documents')} SELECT doc_id, n_words, n_removed, sha256(t) AS kept_sha256 FROM rout"}
QUERIES = {"op3_fm_index": op3_fm_index}
