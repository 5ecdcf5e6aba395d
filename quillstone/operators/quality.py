"""Duplicates, shared openings, low prose, and the two-pass filter."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapsed, prose_score, shingles
from ..sources import store


def keyed(chunks: DataFrame) -> DataFrame:
    t = collapsed(F.col("text"))
    return chunks.withColumns({"h": F.sha1(t), "opening": F.sha1(F.substring(t, 1, 240)), "prose": prose_score(F.col("text"))})


def filter_reasons(chunks: DataFrame, least: int = 50, low_prose: float | None = None, across: bool = True) -> DataFrame:
    """reason of each chunk: boiler (an opening that least chunks share), lowprose, dup (an earlier equal text), or null: kept."""
    spark, where = chunks.sparkSession, store.scratch(chunks.sparkSession, "keys")
    # digests are made once and written narrow; what they are compared by is read three times
    keyed(chunks).select("src", "dnum", "i", "cid", "h", "opening", "prose").write.parquet(where)
    rows = spark.read.parquet(where)
    by = [] if across else ["src"]
    # counts are joined rather than windowed: partial sums meet, not all rows of a common opening
    counts = rows.groupBy(*by, "opening").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    # only texts that occur again have an earlier one: unique rows meet nothing
    first = rows.groupBy(*by, "h").agg(F.min(F.struct("src", "dnum", "i")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    rows = rows.join(counts, [*by, "opening"], "left").join(first, [*by, "h"], "left")
    low = (F.col("prose") < low_prose) if low_prose is not None else F.lit(False)
    reason = F.when(F.col("c") >= least, "boiler").when(low, "lowprose").when(F.struct("src", "dnum", "i") != F.col("first"), "dup")
    return rows.select("src", "dnum", "i", "cid", reason.alias("reason"))


def gutted(reasons: DataFrame, most: int = 20, share: float = 0.25) -> DataFrame:
    """Artifacts of more than most chunks that keep less than share of them."""
    return reasons.groupBy("src").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("reason").isNull(), 1)).alias("kept")).where((F.col("total") > most) & (F.col("kept") < share * F.col("total")))


def containment(mine: DataFrame, theirs: DataFrame, k: int = 5) -> DataFrame:
    """a, b, coverage: share of mine's distinct k-word runs that theirs has, for pairs that share any. Columns id and text."""
    a = mine.select(F.col("id").alias("a"), shingles(F.col("text"), k).alias("s"))
    x = a.select("a", F.size("s").alias("total"), F.explode("s").alias("g"))
    y = theirs.select(F.col("id").alias("b"), F.explode(shingles(F.col("text"), k)).alias("g"))
    return x.join(y, "g").groupBy("a", "b", "total").agg(F.count(F.lit(1)).alias("shared")).select("a", "b", F.round(F.col("shared") / F.col("total"), 6).alias("coverage"))


#: Ids of one block of neighbours.
BLOCK = 64
_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")


def neighbours(docs: DataFrame, k: int = 5) -> DataFrame:
    """doc_id, shared, mine, next: distinct k-word runs that a document shares with the next id's, and how many each has. Rows of one id are a pair each.

    A text is sent once, to the task of its block of ids, and the first of a block to the one before as well; in a task texts
    lie in the order of ids, and runs are made there and compared as words, two ids at a time. A null text has no words.
    """
    id_ = F.col("doc_id").cast("long")
    block = lambda d: F.shiftright(d, BLOCK.bit_length() - 1)
    rows = docs.where("doc_id is not null").select(id_.alias("doc_id"), "text", F.explode(F.array_distinct(F.array(block(id_), block(id_ - 1)))).alias("block"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "block").sortWithinPartitions("block", "doc_id").select("block", "doc_id", "text")

    def runs(text: str | None) -> set[tuple[str, ...]]:
        w = [x for x in _SPACE.split(text or "") if x]
        return set(zip(*(w[i:] for i in range(k)), strict=False))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[set] = []
        now: list[set] = []
        at: tuple[int, int] | None = None
        for b in batches:
            out = []
            for i in range(b.num_rows):
                here = (b.column(0)[i].as_py(), b.column(1)[i].as_py())
                if here != at:
                    last = now if at is not None and here == (at[0], at[1] + 1) else []
                    now, at = [], here
                s = runs(b.column(2)[i].as_py())
                now.append(s)
                # pairs belong to the block of their first id
                out += [(here[1] - 1, len(t & s), len(t), len(s)) for t in last if (here[1] - 1) >> (BLOCK.bit_length() - 1) == here[0]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), *[pa.int32()] * 3), strict=True)], ["doc_id", "shared", "mine", "next"])

    return rows.mapInArrow(compared, "doc_id long, shared int, mine int, next int")


def seeded_sample(rows: DataFrame, by: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each group in the order of md5(seed|key)."""
    w = Window.partitionBy(by).orderBy(F.md5(F.concat(F.lit(seed + "|"), F.col(key).cast("string"))), key)
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


#: Rows of one side of a path that meet in one task.
SIDE = 1000


def shared_paths(mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """mine, theirs: keys of rows of two artifacts with one path; rows that are equal in src, path and key count once.

    A path that very many rows of both sides have is a pair of each, which are all output. Such a path is cut into squares of SIDE x SIDE
    pairs at about, each of which may be a task's, so no task has all pairs of a path.
    """
    rows = lambda df, name: df.where("path is not null").select(*({"src", key, "path"} & set(df.columns))).distinct().select(F.col(key).alias(name), "path")
    a, b = rows(mine, "mine"), rows(theirs, "theirs")
    size = lambda df, name: df.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias(name))
    # paths of one square need no dealing; those of more are few: at most one for SIDE rows
    cuts = size(a, "na").join(size(b, "nb"), "path").where("na > 1 or nb > 1")
    cut = lambda df, col, n, other, mine_, theirs_: df.join(F.broadcast(cuts), "path", "left").withColumns({
        mine_: F.pmod(F.xxhash64(col), F.coalesce(n, F.lit(1))).cast("int"), theirs_: F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))}).select(col, "path", mine_, theirs_)
    x = cut(a, "mine", F.col("na"), F.col("nb"), "i", "j")
    y = cut(b, "theirs", F.col("nb"), F.col("na"), "j", "i")
    # dealt out by a stated number: merged by the bytes that they read, squares of many pairs would be one task again
    parts = int(mine.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = (df.repartition(parts, "path", "i", "j") for df in (x, y))
    return x.join(y, ["path", "i", "j"]).select("mine", "theirs")


def percentiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by and, for each share q, the value at place min(n - 1, int(n * q)) of all values in order. Counts of values are ordered, not rows."""
    c = rows.groupBy(by, F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("c_"))
    c = c.withColumns({"upto_": F.sum("c_").over(Window.partitionBy(by).orderBy("v_")), "n_": F.sum("c_").over(Window.partitionBy(by))})
    at = lambda q: F.min(F.when(F.col("upto_") >= F.least(F.col("n_"), F.floor(F.col("n_") * q) + 1), F.col("v_")))
    return c.groupBy(by).agg(*(at(q).alias(name) for name, q in shares.items()))
