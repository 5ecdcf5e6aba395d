"""What a search gives with and without its filters, against queries of their own, and between editions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shingles
from ..sources import store

# Characters of a text that a comparison of editions reads, and the ratio from which on two are near.
READ, NEAR = 6_000, 0.90


def mirror_set(mine: DataFrame, theirs: DataFrame, least: float = 0.99) -> DataFrame:
    """mine, coverage: rows (id, path, text) of one artifact whose words another one's row of the same path holds: least (above 0) of all five-word runs, or the whole text if it is shorter.

    Not all pairs of a path are compared. Equal texts cover each other. What covers another text may lack few of its runs, say m: it has one of any
    m + 1 of them, so the rarest m + 1 of the path give all candidates, and those are compared as strings. Runs meet by 64-bit hashes;
    equal hashes of different runs could add candidates and lose none.
    """
    if least <= 0:
        raise ValueError("a share that is covered is above 0")
    spark, h = mine.sparkSession, F.sha2("text", 256).alias("h")
    a, b = mine.select("id", "path", "text", h), theirs.select("path", "text", h)
    own = store.scratch(spark, "mirror")
    # digests are made once; what follows reads narrow rows
    a.select("id", "path", "h").where("path is not null and h is not null").write.parquet(f"{own}/mine")
    b.select("path", "h").where("path is not null and h is not null").distinct().write.parquet(f"{own}/theirs")
    ids, other = spark.read.parquet(f"{own}/mine"), spark.read.parquet(f"{own}/theirs")
    one = ids.select("path", "h").distinct()
    same = one.join(other, ["path", "h"], "left_semi")
    rest = one.join(other, ["path", "h"], "left_anti").join(other.select("path").distinct(), "path", "left_semi")
    against = other.join(rest.select("path").distinct(), "path", "left_semi")
    # a text of each path and digest, dealt out by both, so that a common path isn't a task of its own
    for name, rows, keys in (("a", a, rest), ("b", b, against)):
        texts = rows.select("path", "h", "text").join(keys, ["path", "h"], "left_semi").dropDuplicates(["path", "h"])
        texts.select(F.monotonically_increasing_id().alias("n"), "path", "h", "text").write.parquet(f"{own}/{name}")
    x, y = spark.read.parquet(f"{own}/a"), spark.read.parquet(f"{own}/b")
    runs = lambda df: df.select("n", F.transform(shingles(F.col("text")), lambda s: F.xxhash64("path", s)).alias("s"))
    left = runs(x).select("n", F.size("s").alias("total"), F.explode("s").alias("g"))
    right = runs(y).select(F.col("n").alias("of"), F.explode("s").alias("g"))
    often = right.groupBy("g").agg(F.count(F.lit(1)).alias("c"))
    # round() gives half of the sixth decimal away
    spare = F.floor(F.col("total") * (1 - least + 1e-6)).cast("int")
    rare = left.join(often, "g", "left").groupBy("n", "total").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "g"))).alias("r"))
    # where more runs than may lack are in no text of theirs, none covers this one
    asked = rare.where(F.get("r", F.least(spare, F.size("r") - 1))["c"] > 0).select("n", F.explode(F.filter(F.slice("r", F.lit(1), spare + 1), lambda r: r["c"] > 0)["g"]).alias("g"))
    pairs = asked.join(right, "g").select("n", "of").distinct()
    texts = pairs.join(x.select("n", "path", "h", F.col("text").alias("t")), "n").join(y.select(F.col("n").alias("of"), F.col("text").alias("u")), "of")
    got = pair_coverage(texts.select(F.struct(F.struct("path", "h").alias("mine")).alias("id"), "t", "u")).groupBy("mine").agg(F.max("coverage").alias("coverage"))
    got = got.where(F.col("coverage") >= least).select("mine.path", "mine.h", "coverage")
    return ids.join(same.select("path", "h", F.lit(1.0).alias("coverage")).unionByName(got), ["path", "h"]).groupBy(F.col("id").alias("mine")).agg(F.max("coverage").alias("coverage"))


def pair_coverage(pairs: DataFrame) -> DataFrame:
    """mine, coverage of texts t and u side by side (id: a struct with mine)."""
    s = pairs.select("id.mine", shingles(F.col("t")).alias("a"), shingles(F.col("u")).alias("b"))
    return s.select("mine", F.round(F.size(F.array_intersect("a", "b")) / F.size("a"), 6).alias("coverage"))


def without_itself(results: DataFrame, origin: DataFrame) -> DataFrame:
    """Results (query_id, cid) without those of the document that the query was made from (query_id, prefix of its cids)."""
    return results.join(origin, "query_id").where(~F.startswith("cid", F.concat("prefix", F.lit(":")))).drop("prefix")


def page_changes(on: DataFrame, off: DataFrame, n: int) -> DataFrame:
    """query_id, full, changed, gone: pages (query_id, cid, rank) with filters on, against those with them off."""
    size = lambda df, name: df.where(F.col("rank") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "cid")))["cid"].alias(name))
    both = size(off, "b").join(size(on, "a"), "query_id", "left")
    a = F.coalesce("a", F.slice("b", 1, 0))
    return both.select("query_id", (F.size(a) == n).alias("full"), (a != F.col("b")).alias("changed"), F.size(F.array_except("b", a)).alias("gone"))


def scoped_slots(slots: DataFrame) -> DataFrame:
    """Of slots (query_id, mode, topic, place: whether a result names each): counts by mode, and pages on which the topic is lost."""
    page = slots.groupBy("mode", "query_id").agg(F.count(F.lit(1)).alias("slots"), F.sum(F.col("topic").cast("int")).alias("topic"), F.sum(F.col("place").cast("int")).alias("place"), F.sum((F.col("topic") & F.col("place")).cast("int")).alias("both"))
    return page.groupBy("mode").agg(F.sum("slots").alias("slots"), F.sum("topic").alias("topic"), F.sum("place").alias("place"), F.sum("both").alias("both"), F.count(F.when(F.col("topic") < F.col("slots"), 1)).alias("pages_losing_topic"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, state of texts of one path in two editions: identical, near (most of their characters match in order) or differs; gone and new are of one edition alone."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x[:READ], y[:READ], autojunk=False).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")

    j = old.select("path", F.col("text").alias("a")).join(new.select("path", F.col("text").alias("b")), "path", "full")
    plain = j.select("path", "a", "b", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") == F.col("b"), "identical").alias("state"))
    other = plain.where("state is null").withColumn("state", F.when(ratio("a", "b") >= NEAR, "near").otherwise("differs"))
    return plain.where("state is not null").unionByName(other).select("path", "state")


def usurpers(exact: DataFrame, found: DataFrame, near: float = 0.95) -> DataFrame:
    """Misses of a search (query_id, vec_id, score, rank) at the first place: who took it, by what score, and whether it is as good as a copy."""
    own = exact.where("rank = 1").select("query_id", F.col("vec_id").alias("lost"), F.col("score").alias("own"))
    first = found.where("rank = 1").select("query_id", F.col("vec_id").alias("took"), F.col("score").alias("taken"))
    return own.join(first, "query_id", "left").where(~F.col("lost").eqNullSafe(F.col("took"))).select("query_id", "lost", "took", "own", "taken", F.coalesce(F.col("taken") >= near * F.col("own"), F.lit(False)).alias("copy"))


def verdict(total: Column, misses: Column, copies: Column) -> Column:
    """What a rate of misses means: sound, copies (most misses are taken by copies), worn or broken."""
    rate = misses / total
    return F.when(rate <= 0.02, "sound").when((misses > 0) & (copies / F.when(misses > 0, misses).otherwise(1) >= 0.8), "copies").when(1 - rate >= 0.7, "worn").otherwise("broken")


def sample_by_hash(rows: DataFrame, by: str, key: str, k: int, seed: str) -> DataFrame:
    """k rows of each group, the same for each seed: those with the least hashes."""
    w = Window.partitionBy(by).orderBy(F.sha1(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k).drop("pick")

