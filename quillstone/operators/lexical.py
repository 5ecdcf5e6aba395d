"""BM25 over a stored index.

An index is a folder: postings (term, key, tf, dl, places) in BUCKETS folders by the term's hash, sorted by term, and a
table of totals with the stamp of the table that it was built from. A query reads the buckets of its terms alone, and in
them the row groups that hold them. It is built beside its place and put there by a rename, so no reader sees half of one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ACCENTED, PLAIN, content_words
from ..sources import store

BUCKETS = 64
#: Words of documents that are put in order at once.
WORDS = 300_000


def index_tokens(text: Column) -> Column:
    """Runs of letters and digits in lower case, without the accents of Latin letters."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, PLAIN), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, key, tf, dl, places of each document (key, t: its words), WORDS words at a time (or one document)."""
    for b in batches:
        sizes = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(sizes), 0
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORDS, "right")))
            part, n = b.slice(at, stop - at), sizes[at:stop]
            at = stop
            words = part.column(1).flatten().dictionary_encode()
            doc = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            k = doc * max(1, len(words.dictionary)) + words.indices.to_numpy()
            order = np.argsort(k, kind="stable")
            first = np.flatnonzero(np.diff(k[order], prepend=-1))
            one, bounds = order[first], np.append(first, len(order)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(place[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(words.indices.take(pa.array(one))), part.column(0).take(pa.array(doc[one])), pa.array(np.diff(bounds)), pa.array(n[doc[one]].astype(np.int32)), lists], ["term", "key", "tf", "dl", "places"])


def build(docs: DataFrame, path: str, key: str = "doc_id", stamp: str = "") -> None:
    """Write the index of docs (key, text). A document's words meet where it is read; one exchange of postings by bucket and key, so that
    a common word isn't a task of its own. Rows of one key are one document."""
    spark = docs.sparkSession
    building = f"{path}.building"
    t = docs.select(F.col(key).alias("key"), index_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    rows = t.mapInArrow(postings, f"term string, key {t.schema['key'].dataType.simpleString()}, tf int, dl int, places array<int>")
    if docs.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count():
        rows = rows.groupBy("term", "key").agg(F.sum("tf").cast("int").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("bucket", bucket(F.col("term"))).repartition(parts, "bucket", F.pmod(F.xxhash64("key"), F.lit(max(1, parts // 8))))
    rows.sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{building}/postings")
    # all words are in the postings: their number isn't counted in the texts again
    words = spark.read.schema("tf int").parquet(f"{building}/postings").agg(F.sum("tf").alias("words"))
    totals = docs.agg(F.count(F.lit(1)).alias("N")).crossJoin(words).select("N", F.try_divide(F.coalesce("words", F.lit(0)).cast("double"), "N").alias("avgdl"))
    totals.withColumn("stamp", F.lit(stamp)).coalesce(1).write.mode("overwrite").parquet(f"{building}/totals")
    store.swap(spark, building, path)


class Index:
    """A stored index; terms() reads what a query needs of it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @property
    def totals(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals")

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def terms(self, asked: list[str]) -> DataFrame:
        """Postings of the terms asked for: only their buckets are read."""
        if not asked:
            return self.postings.where("false")
        b = {r["b"] for r in self.spark.createDataFrame([(t,) for t in asked], "t string").select(bucket(F.col("t")).alias("b")).collect()}
        return self.postings.where(F.col("bucket").isin(*sorted(b)) & F.col("term").isin(*asked))


def stored(docs: DataFrame, key: str = "doc_id") -> Index:
    """The index of a table read from files, built unless one with its stamp is there."""
    spark = docs.sparkSession
    stamp = store.stamp(docs)
    path = f"{store.shared(spark)}/quillstone-bm25-{key}-{stamp}"
    if not store.exists(spark, f"{path}/totals/_SUCCESS"):
        build(docs, path, key, stamp)
    return Index(spark, path)


def scored(index: Index, queries: DataFrame, key: str = "doc_id") -> DataFrame:
    """query_id, key, score: all documents that have a term of each query (query_id, term), in no order.

    Scores are positive. A term of several words (parted by underscores) is a phrase: its words stand side by side. The queries' terms
    come to the driver to choose what is read; they are a page's questions, not a corpus.
    """
    asked = queries.withColumn("words", index_tokens(F.col("term"))).where(F.size("words") > 0)
    terms = [r["w"] for r in asked.select(F.explode("words").alias("w")).distinct().collect()]
    # a word's places less its number in the phrase: where all words of a phrase agree, it stands
    parts = asked.select("query_id", "term", F.size("words").alias("n_words"), F.posexplode("words").alias("nth", "word"))
    read = index.terms(terms).withColumnRenamed("term", "word").select("word", "key", "tf", "dl", "places")
    single = parts.where("n_words = 1").select("query_id", "term", "word").join(read.drop("places"), "word").select("query_id", "term", "key", "dl", F.col("tf").alias("f"))
    starts = parts.where("n_words > 1").join(read, "word").select("query_id", "term", "n_words", "key", "dl", F.transform("places", lambda p: p - F.col("nth")).alias("s"))
    lists = starts.groupBy("query_id", "term", "n_words", "key", "dl").agg(F.collect_list("s").alias("s")).where(F.size("s") == F.col("n_words"))
    phrase = lists.select("query_id", "term", "key", "dl", F.size(F.aggregate(F.slice("s", F.lit(2), F.size("s")), F.get("s", F.lit(0)), F.array_intersect)).alias("f")).where("f > 0")
    hit = single.unionByName(phrase)
    df = hit.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.greatest(F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("f") * 2.2 / (F.col("f") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    # a row for each term of a query
    return hit.join(F.broadcast(df), ["query_id", "term"]).crossJoin(F.broadcast(index.totals)).groupBy("query_id", F.col("key").alias(key)).agg(F.round(F.sum(part), 6).alias("score"))


def bm25(index: Index, queries: DataFrame, n: int = 10, key: str = "doc_id") -> DataFrame:
    """query_id, key, score, rank: the n best documents of each query (query_id, term), ties by key."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    return scored(index, queries, key).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def snippets(index: Index, top: DataFrame, queries: DataFrame, docs: DataFrame, width: int = 18, key: str = "doc_id") -> DataFrame:
    """query_id, key, snippet: width words of each result from the first place with most of the query's words within them."""
    asked = queries.select("query_id", F.explode(index_tokens(F.col("term"))).alias("word")).distinct()
    terms = [r["word"] for r in asked.select("word").distinct().collect()]
    p = index.terms(terms).select(F.col("term").alias("word"), F.col("key").alias(key), "places")
    hits = top.select("query_id", key).join(asked, "query_id").join(p, ["word", key]).groupBy("query_id", key).agg(F.array_sort(F.flatten(F.collect_list("places"))).alias("p"))
    count = F.transform("p", lambda a: F.struct((-F.size(F.filter("p", lambda b: (b >= a) & (b < a + width)))).alias("n"), a.alias("at")))
    at = hits.select("query_id", key, F.array_min(count)["at"].alias("at"))
    text = docs.select(key, index_tokens(F.col("text")).alias("t"))
    return at.join(text, key).select("query_id", key, F.array_join(F.slice("t", F.col("at") + 1, width), " ").alias("snippet"))


def scoped(index: Index, topic: list[str], place: list[str], key: str = "doc_id") -> DataFrame:
    """key of documents with a word of the topic and one of the place."""
    words = lambda w: index.terms(w).select(F.col("key").alias(key)).distinct()
    return words(topic).join(words(place), key, "left_semi")


def keyword(index: Index, queries: DataFrame, place: list[str], n: int = 10, scoped_first: bool = False, key: str = "doc_id") -> DataFrame:
    """Results of a keyword search; scoped_first puts those that name the place before the others, without repeats."""
    if not scoped_first:
        return bm25(index, queries, n, key)
    terms = [r["term"] for r in queries.select("term").distinct().collect()]
    inside = scoped(index, terms, place, key).withColumn("inside", F.lit(1))
    # the order is one key for all results, so each task keeps its n best and no list is sorted as a whole
    order = Window.partitionBy("query_id").orderBy(F.col("inside").isNull(), F.desc("score"), F.asc(key))
    every = scored(index, queries, key).join(inside, key, "left")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("inside")


def followup(own: Column, earlier: Column, carry: int = 8, most: int = 2) -> Column:
    """A follow-up's own words and up to carry new ones from the questions before; null if it stands alone or gains none."""
    extra = F.slice(F.array_except(F.array_distinct(earlier), own), 1, carry)
    return F.when((F.size(own) <= most) & (F.size(extra) > 0), F.array_join(F.concat(own, extra), " "))


def previous(questions: Column, most: int = 2, length: int = 400) -> Column:
    """The first of the questions before, cut and trimmed; what is empty then goes."""
    return F.filter(F.transform(F.slice(questions, 1, most), lambda q: F.trim(F.substring(F.coalesce(q, F.lit("")), 1, length))), lambda q: q != "")


def thread_words(turns: DataFrame) -> DataFrame:
    """conv_id, turn, own and earlier content words of user turns; the two questions before, the latest first."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = turns.where("role = 'user'").select("conv_id", "turn", "text", F.lag("text", 1).over(w).alias("p1"), F.lag("text", 2).over(w).alias("p2"))
    cut = lambda c: content_words(F.trim(F.substring(F.coalesce(c, F.lit("")), 1, 400)))
    return q.select("conv_id", "turn", content_words(F.col("text")).alias("own"), F.concat(cut(F.col("p1")), cut(F.col("p2"))).alias("earlier"))


def pool_size(n: Column, times: int = 8, least: int = 40) -> Column:
    """Candidates that a page of n results is filled from."""
    return F.greatest(n * times, F.lit(least))
