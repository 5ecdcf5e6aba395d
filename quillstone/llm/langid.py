"""Language of texts and of spans in mixed-language text.

Words are runs of letters. The ranges of their letters name a script, and the script narrows the languages that
can be meant to those that were seen with it. A word's score for a language is the log probability of its letter
trigrams (word borders included), counted over every training document. A Viterbi search with a penalty for
each change of language labels the words of a text; the language with most letters is the document's.

Null texts and texts without a letter are "und" with score 0. Documents without a language, or with a null
doc_id, teach nothing and are still labelled. Without any training document every text is "und". Very long texts are
labelled whole; repeated rows are labelled alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_column, mix, slices, table

#: Trigram buckets, added count of each, log probability that a change of language costs, share of a language's
#: letters that makes it a candidate of a script.
BUCKETS, SMOOTH, PENALTY, SHARE = 1 << 16, 0.05, 12.0, 0.01
#: First letter, last letter and number of each script; other letters are script OTHER.
SCRIPTS = [
    (0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xAA, 0xAA, 1), (0xB5, 0xBA, 1), (0xC0, 0x24F, 1), (0x1E00, 0x1EFF, 1), (0x370, 0x3FF, 2), (0x1F00, 0x1FFF, 2), (0x400, 0x52F, 3),
    (0x530, 0x58F, 4), (0x590, 0x5FF, 5), (0x600, 0x6FF, 6), (0x750, 0x77F, 6), (0x900, 0x97F, 7), (0x980, 0xDFF, 8), (0xE00, 0xE7F, 9), (0x10A0, 0x10FF, 10),
    (0x1100, 0x11FF, 11), (0xAC00, 0xD7AF, 11), (0x3040, 0x30FF, 12), (0x3400, 0x9FFF, 13), (0x20000, 0x3FFFF, 13),
]
OTHER, KINDS = 14, 15
#: Language numbers: up to 32,767 languages.
LABEL = np.int16
_TABLE: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Script of each code point, 0 for what is no letter."""
    if not _TABLE:
        t = np.fromiter((OTHER if chr(c).isalpha() else 0 for c in range(0x110000)), np.uint8, 0x110000)
        for a, b, s in SCRIPTS:
            part = t[a : b + 1]
            part[part > 0] = s
        _TABLE.append(t)
    return _TABLE[0]


class Letters:
    """Words of several texts as runs of letters, with their scripts and trigram buckets."""

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
        c = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
        self.bounds = np.concatenate([[1], 1 + np.cumsum(sizes)])
        kind = script_table()[c]
        letter = kind > 0
        edge = np.flatnonzero(np.diff(letter.view(np.int8)))
        self.start, self.end = edge[::2] + 1, edge[1::2] + 1
        self.first = np.searchsorted(self.start, self.bounds)
        self.script = kind[self.start]
        self.size = self.end - self.start
        x = np.where(letter, c, np.uint32(32)).astype(np.uint64)
        g = x.copy()
        g[1:] += x[:-1] << np.uint64(21)
        g[2:] += x[:-2] << np.uint64(42)
        self.bucket = (mix(g) & np.uint64(BUCKETS - 1)).astype(np.int64)
        self.letter, self.kind = letter, kind

    def rows(self) -> np.ndarray:
        """Places whose trigram counts for a word: its letters and the place after it."""
        return self.letter | np.concatenate([[False], self.letter[:-1]])


def learn(docs: DataFrame) -> dict:
    """Counts of trigram buckets and scripts for each language over all rows of text and lang."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for i, j in slices(b.column("text")):
                langs = b.column("lang").slice(i, j - i).to_pylist()
                w = Letters(b.column("text").slice(i, j - i).to_pylist())
                use = w.rows()
                for k, lang in enumerate(langs):
                    a, z = w.bounds[k], w.bounds[k + 1]
                    got = sums.setdefault(lang, np.zeros(BUCKETS + KINDS, np.int64))
                    got[:BUCKETS] += np.bincount(w.bucket[a:z][use[a:z]], minlength=BUCKETS)
                    got[BUCKETS:] += np.bincount(w.kind[a:z], minlength=KINDS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    counted = docs.where("text is not null and lang is not null").select("text", "lang").mapInArrow(rows, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow().to_pydict()  # languages * (BUCKETS + KINDS) rows at most
    langs = sorted(set(got["lang"]))
    at = {x: k for k, x in enumerate(langs)}
    n = np.zeros((len(langs), BUCKETS + KINDS))
    n[[at[x] for x in got["lang"]], got["bucket"]] = got["n"]
    grams, kinds = n[:, :BUCKETS], n[:, BUCKETS:].copy()
    kinds[:, 0] = 0
    score = np.log((grams + SMOOTH) / (grams.sum(axis=1, keepdims=True) + SMOOTH * BUCKETS)).astype(np.float32)
    allowed = kinds >= SHARE * np.maximum(1, kinds.sum(axis=1, keepdims=True))
    allowed[:, ~allowed.any(axis=0)] = True
    return {"langs": langs, "score": score, "allowed": allowed}


def viterbi(score: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word. score: words x languages; first: where each text begins. All texts go in step."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, n = first[:-1][order], int((sizes > 0).sum())
    steps = int(sizes.max()) if len(sizes) else 0
    live = np.searchsorted(-sizes[order], -np.arange(steps), "left")  # texts that have a word t
    label = np.zeros(len(score), LABEL)
    if not n:
        return label
    stay = np.zeros(score.shape, bool)
    best = np.zeros(len(score), LABEL)
    v = score[begin[:n]].copy()
    final = np.zeros(len(sizes), LABEL)
    for t in range(1, steps):
        m = live[t]
        if m < len(v):
            final[m : len(v)] = v[m:].argmax(axis=1)
            v = v[:m]
        at = begin[:m] + t
        top = v.argmax(axis=1)
        best[at] = top
        other = (v.max(axis=1) - penalty)[:, None]
        stay[at] = v >= other
        v = score[at] + np.maximum(v, other)
    final[: len(v)] = v.argmax(axis=1)
    now = final.copy()
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at = begin[:m] + t
        label[at] = now[:m]
        if t:
            now[:m] = np.where(stay[at, now[:m]], now[:m], best[at])
    return label


def labelled(w: Letters, model: dict, penalty: float = PENALTY) -> np.ndarray:
    """Language number of each word."""
    langs = len(model["langs"])
    score = np.empty((len(w.start), langs), np.float32)
    for k in range(langs):
        s = np.cumsum(model["score"][k][w.bucket], dtype=np.float64)
        score[:, k] = s[w.end] - s[w.start - 1]
        score[~model["allowed"][k][w.script], k] -= 1e4
    return viterbi(score, w.first, penalty)


def languages(docs: DataFrame, model: dict, *keep: str, penalty: float = PENALTY) -> DataFrame:
    """The columns to keep, lang_pred, score (share of letters in it) and spans (words a to b, language) of each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema if f.name in keep}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = sent.value["langs"]
        span = pa.list_(pa.struct([("first_word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
        for b in batches:
            for i, j in slices(b.column("text"), 2 << 20):
                part = b.slice(i, j - i)
                w = Letters([t or "" for t in part.column("text").to_pylist()])
                label = labelled(w, sent.value, penalty) if langs else np.zeros(len(w.start), LABEL)
                pred, share, spans = [], [], []
                for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    if a == z or not langs:
                        pred.append("und")
                        share.append(0.0)
                        spans.append([])
                        continue
                    n = np.bincount(label[a:z], weights=w.size[a:z], minlength=len(langs))
                    best = int(n.argmax())
                    pred.append(langs[best])
                    share.append(float(n[best] / n.sum()))
                    new = np.concatenate([[0], np.flatnonzero(np.diff(label[a:z])) + 1, [z - a]])
                    spans.append([{"first_word": int(x), "words": int(y - x), "lang": langs[label[a + x]]} for x, y in zip(new[:-1], new[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kinds), pa.array(pred), pa.array(share, pa.float64()), pa.array(spans, span)], [*kinds, "lang_pred", "score", "spans"])

    schema = ", ".join([*(f"{k} {v}" for k, v in kinds.items()), "lang_pred string, score double, spans array<struct<first_word:int,words:int,lang:string>>"])
    return docs.select(*kinds, "text").mapInArrow(rows, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc32_column(F.col("doc_id")) % 3
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(fold != 1))
    rows = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    return languages(rows, model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")


SQL: dict[str, str] = {}
QUERIES = {"op7_language": op7_language}
