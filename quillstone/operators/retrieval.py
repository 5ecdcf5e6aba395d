"""Exact vector search, fusion of rankings and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as vectors_


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.sqrt(dot(v, v))
    n = F.when(n == 0, 1.0).otherwise(n)
    return F.transform(v, lambda x: x.cast("double") / n)


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, vec_id, score, rank by inner product, ties by vec_id. A stated query set is compared with all vectors, in blocks."""
    return vectors_.topk(vectors, queries, k)


def fuse(dense: DataFrame, sparse: DataFrame, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two lists (query_id, id, rank): score, final rank and origin of each id."""
    both = dense.select("query_id", "id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("s")).unionByName(sparse.select("query_id", "id", F.lit(None).cast("int").alias("d"), F.col("rank").alias("s")))
    one = both.groupBy("query_id", "id").agg(F.max("d").alias("d"), F.max("s").alias("s"))
    part = lambda r: F.coalesce(1.0 / (c + F.col(r)), F.lit(0.0))
    one = one.withColumn("score", F.round(part("d") + part("s"), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("d"), F.asc_nulls_last("s"))
    origin = F.when(F.col("d").isNull(), "keyword").when(F.col("s").isNull(), "dense").otherwise("both")
    return one.select("query_id", "id", "score", F.row_number().over(order).alias("rank"), origin.alias("origin"))


def agreement(in_both: Column) -> Column:
    return F.when(in_both == 0, "low").when(in_both <= 2, "weak").otherwise("good")


def mode_ran(mode: Column, vectors_there: Column) -> tuple[Column, Column]:
    """The mode that runs, and whether it isn't the one asked for: without vectors there are keywords alone."""
    lacks = mode.isin("dense", "hybrid") & ~vectors_there
    return F.when(lacks, "keyword").otherwise(mode), lacks


def backend(order: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first backend that is there, none without one, and whether it isn't the first."""
    out = F.lit("none")
    for name, there in reversed(order):
        out = F.when(there, name).otherwise(out)
    return out, out != order[0][0]


OUTCOME = "query_id int, rank int, outcome string"


def page(pool: DataFrame, n: int = 8) -> DataFrame:
    """query_id, rank, outcome of each candidate of a bounded pool, walked by rank until n are kept.

    pool: query_id, rank, src, dnum, text_key, reason (why it is excluded, or null), navigation. Outcomes: kept, the reason,
    navigation, same_document, same_text, and beyond for what isn't walked. Only kept rows count as seen, so an earlier
    duplicate doesn't hide its document's next passage; that is why this is a walk and not two windows.
    """

    def walk(rows):
        seen_documents, seen_texts, out = set(), set(), []
        rows = rows.sort_values("rank")
        for r in rows.itertuples():
            if len(seen_documents) >= n:
                what = "beyond"
            elif isinstance(r.reason, str):
                what = r.reason
            elif r.navigation:
                what = "navigation"
            elif (r.src, r.dnum) in seen_documents:
                what = "same_document"
            elif r.text_key in seen_texts:
                what = "same_text"
            else:
                what = "kept"
                seen_documents.add((r.src, r.dnum))
                seen_texts.add(r.text_key)
            out.append(what)
        return rows[["query_id", "rank"]].assign(outcome=out)

    return pool.select("query_id", "rank", "src", "dnum", "text_key", "reason", "navigation").groupBy("query_id").applyInPandas(walk, OUTCOME)


def payload(walked: DataFrame, pool: DataFrame, mode: str) -> DataFrame:
    """query_id, mode, n, consumed, results (cids in rank order), suppressed (rule: how often) of walked pages (query_id, rank, outcome) and their pools."""
    rows = walked.where("outcome <> 'beyond'").join(pool.select("query_id", "rank", "cid"), ["query_id", "rank"])
    kept = F.col("outcome") == "kept"
    g = rows.groupBy("query_id").agg(
        F.count(F.when(kept, 1)).alias("n"), F.max("rank").alias("consumed"), F.array_sort(F.collect_list(F.when(kept, F.struct("rank", "cid"))))["cid"].alias("results"), F.collect_list(F.when(~kept, F.col("outcome"))).alias("out")
    )
    rules = F.array_sort(F.array_distinct("out"))
    counts = F.map_from_arrays(rules, F.transform(rules, lambda r: F.size(F.filter("out", lambda o: o == r))))
    return g.select("query_id", F.lit(mode).alias("mode"), "n", "consumed", "results", counts.alias("suppressed"))
