"""Chunks of documents: by sentences, by length where that fails, their pages and numbers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 1024
#: Tokens of a chunk, of which so many are the end of the one before; characters of the shortest chunk and of the longest title.
TOKENS, OVERLAP, SHORTEST, TITLE = 512, 77, 50, 200
_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[\"')\]]*|\n|$)\s*")


def windows(text: str, length: int = LENGTH) -> list[str]:
    """Windows of at most length characters, each ended at the last space in its second half if there is one."""
    parts, at = [], 0
    while at < len(text):
        stop = at + length
        if stop < len(text):
            space = text.rfind(" ", at + length // 2, stop)
            stop = space if space > at else stop
        part = text[at:stop].strip()
        parts += [part] if part else []
        at = max(min(stop, len(text)), at + 1)
    return parts


def hard_split(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, i, n, text of each chunk; null texts have none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                parts = windows(t or "", length)
                out += [(d, i, len(parts), p) for i, p in enumerate(parts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "i", "n", "text"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(rows, "doc_id long, i int, n int, text string")


def sentences(text: str, size: int = TOKENS, overlap: int = OVERLAP, count: Callable[[str], int] = lambda t: len(t.split())) -> list[str]:
    """Chunks of whole sentences, size tokens at most, each beginning with the last sentences of the one before, overlap tokens at most.

    A sentence that is longer than a chunk is cut between words. count is the tokenizer: parts between white space here.
    """
    parts: list[tuple[str, int]] = []
    for m in _SENTENCE.finditer(text):
        if not m[0].strip():
            continue
        n = count(m[0])
        if n <= size:
            parts.append((m[0], n))
            continue
        words, held = re.findall(r"\S+\s*", m[0]), ""
        for w in words:
            if held and count(held + w) > size:
                parts.append((held, count(held)))
                held = ""
            held += w
        parts.append((held, count(held)))
    out: list[str] = []
    own: list[tuple[str, int]] = []
    total, fresh = 0, False
    for part in parts:
        if fresh and total + part[1] > size:
            out.append("".join(p for p, _ in own).strip())
            keep: list[tuple[str, int]] = []
            left = min(overlap, size - part[1])
            for p in reversed(own):
                if p[1] > left:
                    break
                keep.insert(0, p)
                left -= p[1]
            own, total, fresh = keep, sum(n for _, n in keep), False
        own.append(part)
        total, fresh = total + part[1], True
    if fresh:
        out.append("".join(p for p, _ in own).strip())
    return out


def tried(text: str, first: Callable[[str], list[str]], then: Callable[[str], list[str]]) -> tuple[str, list[str]]:
    """How a text is cut: by first (split), where it fails by then (fallback), where that fails too into nothing (dropped)."""
    try:
        return "split", first(text)
    except Exception:  # whatever a splitter fails by, the document isn't lost
        try:
            return "fallback", then(text)
        except Exception:
            return "dropped", []


def with_fallback(docs: DataFrame, first: Callable[[str], list[str]], then: Callable[[str], list[str]] = windows) -> DataFrame:
    """doc_id, status, i, n, text: chunks by first, where it fails by then (fallback), where that fails too none (dropped: one row without text).

    A null or empty text has no row.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if not t:
                    continue
                status, parts = tried(t, first, then)
                out += [(d, status, None, 0, None)] if status == "dropped" else [(d, status, i, len(parts), p) for i, p in enumerate(parts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], ["doc_id", "status", "i", "n", "text"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(rows, "doc_id long, status string, i int, n int, text string")


def statuses(docs: DataFrame, first: Callable[[str], list[str]], then: Callable[[str], list[str]] = windows) -> DataFrame:
    """doc_id, status, n (chunks) of every row: texts without chunks and ids that occur again count too. A null text is an empty one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [tried(t or "", first, then) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s for s, _ in got], pa.string()), pa.array([len(p) for _, p in got], pa.int32())], ["doc_id", "status", "n"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(rows, "doc_id long, status string, n int")


def split_sentences(docs: DataFrame, size: int = TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, status, i, n, text of chunks of whole sentences, by length where a text can't be cut so."""
    return with_fallback(docs, lambda t: sentences(t, size, overlap))


def located(text: str, parts: list[str]) -> list[int]:
    """Where each chunk begins: at its first 80 characters from a cursor on that goes half a chunk further each time, or at the cursor."""
    out, cursor = [], 0
    for p in parts:
        at = text.find(p[:80], cursor) if p else -1
        at = cursor if at < 0 else at
        out.append(at)
        cursor = at + max(1, len(p) // 2)
    return out


def placed(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, i, at, page of the chunks of documents made of pages (doc_id, text, pages, starts)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for d, t, pages, starts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "pages", "starts")), strict=True):
                at = located(t, windows(t, length))
                out += [(d, i, a, pages[max(k for k, s in enumerate(starts) if s <= a)]) for i, a in enumerate(at)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "i", "at", "page"])

    return docs.select(docs["doc_id"].cast("long"), "text", F.col("pages").cast("array<long>"), F.col("starts").cast("array<long>")).mapInArrow(rows, "doc_id long, i int, at long, page long")


def long_enough(text: Column, least: int = SHORTEST) -> Column:
    return F.length(text) >= least


def numbered(docs: DataFrame, parts: Column, title: Column, key: str = "doc_id") -> DataFrame:
    """key, title (cut), n, i, text of each chunk of an array."""
    return docs.select(key, F.substring(F.coalesce(title, F.lit("")), 1, TITLE).alias("title"), F.size(parts).alias("n"), F.posexplode(parts).alias("i", "text"))
