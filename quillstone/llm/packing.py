"""Packing of documents into few sequences by bin completion.

Only lengths matter for a packing, and there are at most as many as tokens in a sequence. So the driver gets
the histogram of lengths (capacity rows at most, at any size of the corpus) and fills bins around the largest
remaining length: a depth-first branch and bound goes from the fullest to the emptier of the KEEP fullest
undominated fillings of what it leaves, each repeated as long as its lengths last, then once; it turns back where
the waste so far leaves no plan with fewer sequences than the best. Best-fit decreasing over the same histogram is
the first incumbent. Where that isn't at the lower bound, the search ends at the bound, when all is tried, or STEPS
fillings after its first dead end; in the last case it starts again with fillings that are as full in another order
while its share of WORK lasts, and then the best plan so far is used, which need not be the least.

The plan lists, for each length, runs of ranks and where they go. A document's rank among those of its length
comes from counts for each task and length, so no length, however common, is gathered in one task.

Null texts are empty documents (the end id alone); null and repeated doc_ids are documents of their own;
an empty table gives no rows; documents longer than a sequence are cut into whole pieces and a last one.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, staged, table
from .tok import encoder

CAPACITY = 4096
#: Nodes of the search for one filling, fillings that the outer search branches over, and its length after the first dead end.
NODES, KEEP, STEPS = 400, 24, 600
#: Work of all descents together, in lengths that they look at; lengths up to which sums are looked up.
WORK, FEW = 1_500_000, 300


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best-fit decreasing over classes of equal bins. Patterns: (bins, [(length, how many in each bin)])."""
    by_room: dict[int, list[list]] = {}  # room: [bins, pattern] groups
    rooms: list[int] = []

    def put(room: int, bins: int, pattern: tuple) -> None:
        if room not in by_room:
            by_room[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        by_room[room].append([bins, pattern])

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            k = bisect_right(rooms, length - 1)
            if k < len(rooms):
                room = rooms[k]
                bins, pattern = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room]
                    rooms.pop(k)
            else:
                room, bins, pattern = capacity, -(-left // (capacity // length)), ()
            each = room // length
            full = min(bins, left // each)
            if full:
                put(room - each * length, full, (*pattern, (length, each)))
                left -= full * each
            if bins > full:
                some = 0
                if left and full < bins:
                    some = min(left, each)
                    put(room - some * length, 1, (*pattern, (length, some)))
                    left -= some
                if rest := bins - full - bool(some):
                    put(room, rest, pattern)
    return [(n, list(p)) for groups in by_room.values() for n, p in groups if p]


def dominated(left: int, chosen: list[tuple[int, int]], lengths: list[int], counts: dict[int, int]) -> bool:
    """Whether another filling is at least as good: one more length fits, or one takes the place of up to three that it holds.

    What a sequence could do with the three it can do with the one, and the three are left for others (Martello and Toth).
    """
    used = dict(chosen)
    k = bisect_right(lengths, left)
    if any(counts[x] > used.get(x, 0) for x in lengths[:k]):
        return True
    items = [x for x, n in chosen for _ in range(min(n, 3))]
    for size in (1, 2, 3):
        for sub in set(combinations(items, size)):
            low, total = max(sub), sum(sub)
            i = bisect_right(lengths, total - 1 if size > 1 else total)
            while i < len(lengths) and lengths[i] <= total + left:
                if lengths[i] > low and counts[lengths[i]] > used.get(lengths[i], 0):
                    return True
                i += 1
    return False


def exact_fillings(room: int, lengths: list[int], counts: dict[int, int], keep: int, nodes: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """The same as fillings, by the sums that the smallest lengths reach: no branch is entered that doesn't come to its sum."""
    lengths = lengths[: bisect_right(lengths, room)]
    mask, reach = (1 << (room + 1)) - 1, [1]
    for x in lengths:
        r, n, step = reach[-1], min(counts[x], room // x), 1
        while n > 0:
            take = min(step, n)
            r |= r << (take * x)
            r &= mask
            n -= take
            step *= 2
        reach.append(r)
    best: list[tuple[int, tuple]] = []
    budget = nodes
    sums = reach[-1]

    def grow(top: int, left: int, total: int, chosen: list[tuple[int, int]]) -> bool:
        """True once enough is found."""
        nonlocal budget
        if left == 0:
            if not dominated(room - total, chosen, lengths, counts):
                best.append((total, tuple(chosen)))
            return len(best) >= keep
        for i in range(top - 1, -1, -1):
            if not reach[i + 1] >> left & 1:
                return False
            x = lengths[i]
            for n in range(min(counts[x], left // x), 0, -1):
                if reach[i] >> (left - n * x) & 1:
                    budget -= 1
                    if budget <= 0 and best:
                        return True
                    chosen.append((x, n))
                    if grow(i, left - n * x, total, chosen):
                        return True
                    chosen.pop()
        return False

    while sums:
        total = sums.bit_length() - 1
        sums ^= 1 << total
        if grow(len(lengths), total, total, []) or budget <= -8 * nodes:
            break
    return best or [(0, ())]


def fillings(room: int, lengths: list[int], counts: dict[int, int], keep: int, nodes: int = NODES) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Undominated fillings of a room, fullest first: (sum, ((length, how many), ...)).

    lengths ascend. With very many lengths, a depth-first search meets a full one soon; branches whose sum cannot
    beat the worst kept one are cut, and so is all once the room is filled. With few, sums that can't be reached are.
    """
    if bisect_right(lengths, room) <= FEW:
        return exact_fillings(room, lengths, counts, keep, nodes)
    best: list[tuple[int, tuple]] = []
    budget = nodes

    def grow(left: int, top: int, total: int, chosen: list[tuple[int, int]]) -> bool:
        nonlocal budget
        k = bisect_right(lengths, left, 0, top)
        if k == 0 or left == 0:
            if not dominated(left, chosen, lengths, counts):
                best.append((total, tuple(chosen)))
                best.sort(key=lambda x: -x[0])
                del best[keep:]
            return left == 0 and keep == 1 and bool(best)
        for i in range(k - 1, -1, -1):
            budget -= 1
            if budget <= 0:
                return bool(best)
            length = lengths[i]
            most = min(counts[length], left // length)
            if len(best) == keep and total + left <= best[-1][0]:
                return False
            for n in range(most, 0, -1) if keep > 1 or left - most * length < lengths[0] or i == 0 else (most, max(1, most - 1))[: 1 + (most > 1)]:
                chosen.append((length, n))
                if grow(left - n * length, i, total + n * length, chosen):
                    return True
                chosen.pop()
        return False

    grow(room, len(lengths), 0, [])
    return best or [(0, ())]


def descend(hist: dict[int, int], capacity: int, most: int, least: int, steps: int, work: list[int], order: random.Random | None) -> tuple[list | None, bool]:
    """A plan of fewer than most sequences, the best that the search meets, and whether all has been tried.

    work: what is left of it, counted down. order: None for the fullest filling of the largest lengths first, else
    fillings that are as full come in any order.
    """
    found, left, bins = None, sum(a * n for a, n in hist.items()), 0
    counts, lengths = dict(hist), sorted(hist)
    made: list[tuple[int, dict[int, int]]] = []
    others: list[list[tuple[int, dict[int, int]]] | None] = []  # what is still to try at each place, None before it is known

    def choices(keep: int) -> list[tuple[int, dict[int, int]]]:
        top = lengths[-1]
        work[0] -= 100 + len(lengths) * (8 if len(lengths) <= FEW else 1)
        counts[top] -= 1
        got = fillings(capacity - top, lengths if counts[top] else lengths[:-1], counts, keep)
        counts[top] += 1
        if order:
            got.sort(key=lambda x: (-x[0], order.random()))
        needs = [{**dict(p), top: dict(p).get(top, 0) + 1} for _, p in got]
        full = [(min(counts[a] // n for a, n in need.items()), need) for need in needs]
        return full + [(1, need) for times, need in full if times > 1 and keep > 1]

    def move(times: int, need: dict[int, int]) -> None:
        """Take a pattern so many times, or give it back if times is negative."""
        nonlocal left, bins
        bins += times
        for a, n in need.items():
            before = counts[a]
            counts[a] -= n * times
            left -= a * n * times
            if not counts[a]:
                lengths.pop(bisect_right(lengths, a) - 1)
            elif not before:
                insort(lengths, a)

    # the first descent isn't cut short before it has met a dead end
    wide, down, dead, met = 4 if order else 1, True, False, order is not None
    while most > least and steps > 0 and (work[0] > 0 or not met):
        steps -= dead
        if down and lengths and bins + -(-left // capacity) < most:
            made.append(choices(wide)[0])
            others.append(None)
            move(*made[-1])
            continue
        if down and not lengths and bins < most:
            found, most = [(times, sorted(need.items(), reverse=True)) for times, need in made], bins
        down, dead, met = False, True, True
        if not made:
            return found, True
        tried = made.pop()
        move(-tried[0], tried[1])
        rest = others.pop()
        if rest is None:
            rest = [c for c in choices(KEEP) if c != tried][::-1]
        while rest and not down:
            times, need = rest.pop()
            if bins + times + -(-(left - times * sum(a * n for a, n in need.items())) // capacity) < most:
                made.append((times, need))
                others.append(rest)
                move(times, need)
                down = True
    return found, most <= least


def plan(hist: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns of a packing of hist (length: how many)."""
    incumbent = best_fit(hist, capacity)
    least, most = -(-sum(a * n for a, n in hist.items()) // capacity), sum(n for n, _ in incumbent)
    work, attempt = [WORK], 0
    while most > least and work[0] > 0:
        found, over = descend(hist, capacity, most, least, steps, work, random.Random(attempt) if attempt else None)
        if found is not None:
            incumbent, most = found, sum(n for n, _ in found)
        if over:
            break
        attempt += 1
    return incumbent


def placed(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, runs in order of rank: first rank, first sequence, how many a sequence, offset."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for length, n in pattern:
            first = used.get(length, 0)
            runs.setdefault(length, []).append((first, sequence, n, offset))
            used[length] = first + n * times
            offset += n * length
        sequence += times
    return {a: np.array(r, np.int64) for a, r in runs.items()}


def piece_table(docs: DataFrame, vocabulary: str, end: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with a task number and a rank among the task's pieces of the same length."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        tail = np.array([end], "<u4").tobytes()
        for b in batches:
            for i, j in slices(b.column("text"), 2 << 20):
                out = []
                for d, raw in zip(b.column("doc_id").slice(i, j - i).to_pylist(), enc.encode(t or "" for t in b.column("text").slice(i, j - i).to_pylist()), strict=True):
                    raw += tail
                    for k, at in enumerate(range(0, len(raw) // 4, capacity)):
                        cut = raw[4 * at : 4 * (at + capacity)]
                        n = len(cut) // 4
                        out.append((d, k, at, n, zlib.crc32(cut), part, int(seen[n]), cut if with_ids else None))
                        seen[n] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", "ids"]
                n = 8 if with_ids else 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True))[:n], types[:n], strict=True)], names[:n])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids binary" * with_ids)


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids themselves, with_ids)."""
    spark = docs.sparkSession
    pieces = staged(piece_table(docs, vocabulary, end, capacity, with_ids), f"{shared_dir(spark)}/pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # capacity rows at most
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(placed(plan(hist, capacity)))
    before = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "part")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, z in zip(edges, [*edges[1:], len(order)], strict=True):
                at = order[a:z]
                r = runs.value[int(length[at[0]])]
                r = r[np.searchsorted(r[:, 0], rank[at], "right") - 1]
                d = rank[at] - r[:, 0]
                seq[at] = r[:, 1] + d // r[:, 2]
                off[at] = r[:, 3] + d % r[:, 2] * length[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(seq), pa.array(off)], [*columns, "sequence_id", "offset"])

    return ranked.select(*columns, "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")


def op9_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op9_bin_completion": op9_bin_completion}
