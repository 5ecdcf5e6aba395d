"""Tables of a corpus folder, and the views that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(docs: DataFrame) -> DataFrame:
    """Chunk records of documents: lines are chunks. src is the source's number, i counts from 0, n is the document's total."""
    parts = docs.select(F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("src"), F.col("doc_id").alias("dnum"), F.split("text", "\n").alias("parts"))
    return parts.select("src", "dnum", F.size("parts").cast("long").alias("n"), F.posexplode("parts").alias("i", "text")).select(F.concat_ws(":", "src", "dnum", "i").alias("cid"), "src", "dnum", F.col("i").cast("long").alias("i"), "n", "text")


CHUNKS_SQL = "chunks AS (SELECT concat_ws(':', src, dnum, i) AS cid, * FROM (SELECT regexp_extract(source, '([0-9]+)$', 1)::INT AS src, doc_id AS dnum, unnest(range(0, len(string_split(text, chr(10)))))::BIGINT AS i, len(string_split(text, chr(10)))::BIGINT AS n, unnest(string_split(text, chr(10))) AS text FROM documents))"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a line-wise JSON file; a line that doesn't parse raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and path of a checksum list, in both line forms."""
    line = r"^([0-9a-fA-F]{64}) [ *](?:\./)?(.+)$"
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.lower(F.regexp_extract("value", line, 1)).alias("sha256"), F.regexp_extract("value", line, 2).alias("path"))


def read_scope(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a scope file without comments and blank lines."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("entry")).where("entry <> ''")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key; where both have it, new's row stays; of several new rows of one key one does."""
    one = new.dropDuplicates([key])
    return one.unionByName(old.join(one.select(key), key, "left_anti"))


def without(rows: DataFrame, excluded: DataFrame, key: str = "cid") -> DataFrame:
    """Rows whose key isn't on a list."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def fetch(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of some keys; a key without a row raises when the rows are read."""
    known = ids.select(key).distinct().join(rows.withColumn("there_", F.lit(True)), key, "left")
    there = F.when(F.col("there_").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return known.withColumn(key, there).drop("there_")
