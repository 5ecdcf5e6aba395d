"""Readers and sinks of a library's files: lists, registries, catalogues in XML, logs, and folders of a source each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV file with a header, all as strings; quotes stand twice in quoted cells."""
    return spark.read.option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def by_key(rows: DataFrame, key: str) -> DataFrame:
    """One row a key."""
    return rows.dropDuplicates([key])


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Artifacts of a registry in the order of their numbers, which are stored as strings."""
    r = spark.read.schema("src string, file string").json(path)
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.col("src").cast("int"))))  # some hundred artifacts


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def hash_of(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """The rows (path) with the hash that a checksum list has for a file of that name; null without one."""
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    return rows.withColumn("name_", name("path")).join(sums.select(name("path").alias("name_"), "sha256").dropDuplicates(["name_"]), "name_", "left").drop("name_")


def ingest(rows: DataFrame, path: str, by: str = "src") -> None:
    """Write rows in a folder for each source; the folders of sources among the rows are replaced, the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def replace_source(rows: DataFrame, excluded: DataFrame, path: str, by: str = "src", key: str = "cid") -> None:
    """ingest without the excluded keys; counts what is written and raises if it isn't what was meant to be."""
    kept = rows.join(excluded.select(key).distinct(), key, "left_anti")
    wanted = {r[by]: r["n"] for r in kept.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each source
    ingest(kept, path, by)
    there = rows.sparkSession.read.parquet(path).where(F.col(by).isin(*wanted) if wanted else F.lit(False))
    got = {r[by]: r["n"] for r in there.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    if got != wanted:
        raise ValueError(f"sources were written in part: {sorted(k for k in wanted if got.get(k) != wanted[k])[:5]}")


def library_books(spark: SparkSession, path: str) -> DataFrame | None:
    """stem, title, lang of the books that a library lists; None, which is unknown and not empty, if it can't be read."""
    if not store.exists(spark, path):
        return None
    element = F.explode(F.regexp_extract_all("value", F.lit(r"<book\b[^>]*>"), F.lit(0)))
    books = spark.read.option("wholetext", True).text(path).select(element.alias("book"))

    def attribute(name: str) -> Column:
        out = F.regexp_extract("book", rf'\s{name}="([^"]*)"', 1)
        for mark, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
            out = F.replace(out, F.lit(mark), F.lit(letter))
        return out

    stem = F.regexp_replace(F.regexp_extract(F.translate(attribute("path"), "\\", "/"), "([^/]*)$", 1), r"(?i)\.zim$", "")
    return books.select(stem.alias("stem"), attribute("title").alias("title"), F.trim(F.split(attribute("language"), ",")[0]).alias("lang")).where("stem <> ''")


def listing(spark: SparkSession, where: str, names: str) -> DataFrame:
    """path, name, bytes of the files below a folder whose names fit; their contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(where)
    return f.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"))


def in_folders(found: DataFrame, where: str) -> DataFrame:
    """The files with their path below a folder, numbered by name in each folder."""
    rel = F.substring_index("path", where.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    folder = F.regexp_extract(rel, "^(.*?)/?[^/]*$", 1)
    return found.select(rel.alias("path"), "bytes", F.row_number().over(Window.partitionBy(folder).orderBy("name")).alias("place"))


def hashes(spark: SparkSession, where: str) -> DataFrame:
    """path and sha256 of every file below a folder; a file is hashed in one piece."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(where)
    return f.select(F.substring_index("path", where.rstrip("/").rsplit("/", 1)[-1] + "/", -1).alias("path"), F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, sums: DataFrame) -> DataFrame:
    """path, state: ok, differs, missing (listed alone) or new (there alone)."""
    j = found.join(sums.withColumnRenamed("sha256", "listed"), "path", "full")
    return j.select("path", F.when(F.col("sha256").isNull(), "missing").when(F.col("listed").isNull(), "new").when(F.col("sha256") == F.col("listed"), "ok").otherwise("differs").alias("state"))


def first_there(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """key, file: the first of a row's names that is among the files; null if none is."""
    hit = rows.select(key, F.posexplode("names").alias("nth", "file")).join(there, "file").groupBy(key).agg(F.min_by("file", "nth").alias("file"))
    return rows.select(key).join(hit, key, "left")


def buffers(lines: DataFrame) -> DataFrame:
    """place (gpu or host), n, mib: sums of the buffers that a log's lines name. A host's pinned memory and a CPU's are the host's."""
    shape = r"(\S+)\s+(?:\S+\s+)?buffer size\s*=\s*([0-9.]+)\s*MiB"
    b = lines.where(F.col("value").rlike(shape)).select(F.regexp_extract("value", shape, 1).alias("device"), F.regexp_extract("value", shape, 2).cast("double").alias("mib"))
    host = F.upper("device").contains("HOST") | F.upper("device").startswith("CPU")
    return b.groupBy(F.when(host, "host").otherwise("gpu").alias("place")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mib"), 2).alias("mib"))


def processes(lines: DataFrame) -> DataFrame:
    """pid, parent, command of the lines of a process list; headings and broken lines are left out."""
    shape = r"^\s*(\d+)\s+(\d+)\s+(.+)$"
    return lines.where(F.col("value").rlike(shape)).select(F.regexp_extract("value", shape, 1).cast("long").alias("pid"), F.regexp_extract("value", shape, 2).cast("long").alias("parent"), F.regexp_extract("value", shape, 3).alias("command"))


def instances(table: DataFrame, marks: list[str]) -> DataFrame:
    """Processes whose command holds all of the marks, in any case."""
    return table.where(F.forall(F.array(*map(F.lit, marks)), lambda m: F.lower("command").contains(F.lower(m))))


def form_languages(pages: DataFrame, field: str) -> DataFrame:
    """lang, books: how many forms offer each language in a field, whose values are lists."""
    values = F.regexp_extract_all("html", F.lit(rf'name="{field}"\s+value="([^"]*)"'), F.lit(1))
    langs = F.explode(F.flatten(F.transform(values, lambda v: F.split(v, r"\s*,\s*"))))
    return pages.select(langs.alias("lang")).where("lang <> ''").groupBy("lang").agg(F.count(F.lit(1)).alias("books"))


def content_keys(feed: Column) -> Column:
    """Distinct keys of a feed's links to contents, in their order."""
    return F.array_distinct(F.regexp_extract_all(feed, F.lit(r'href="/content/([^"/]+)'), F.lit(1)))
