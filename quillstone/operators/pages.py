"""Documents made of pages: one text, where each page begins, and references from one passage to its neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import percent_path

# References to a table or figure beside the text, and words that end a label.
REFERENCE = r"(?i)\b(?:table|figure|fig\.|chart)\b[ \t]*([^.,;:\n]{0,28}?)[ \t]*\b(below|above|following|preceding|opposite)\b"
TRAILING = r"(?i)\s+(?:and|or|by|of|in|to|for|with|the|a|an)(?:\s+\w+)*$"


def joined(rows: DataFrame, by: list[str], order: str, text: str = "text") -> DataFrame:
    """by, text (pages joined by line ends), pages and the place where each begins."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(text, F.lit(""))
    placed = rows.select(*by, F.col(order).alias("o_"), t.alias("t_"), F.coalesce(F.sum(F.length(t) + 1).over(w), F.lit(0)).alias("s_"))
    g = placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("o_", "s_", "t_"))).alias("p"))
    return g.select(*by, F.array_join("p.t_", "\n").alias("text"), F.col("p.o_").alias("pages"), F.col("p.s_").alias("starts"))


def page_at(pages: Column, starts: Column, at: Column) -> Column:
    """The last page that begins at a place or before it."""
    return F.get(pages, F.size(F.filter(starts, lambda s: s <= at)) - 1)


def citation(row: Column) -> Column:
    """struct of what a passage is cited by. row: file, shelf, path, title, i, n, page, book (null for folders of PDF), served (the name that a server was seen to use)."""
    served = F.coalesce(row["served"], row["book"])
    zim = F.concat_ws("/", percent_path(served), percent_path(row["path"]))
    rel = percent_path(F.concat_ws("/", row["shelf"], row["path"]))
    is_zim = row["book"].isNotNull()
    return F.struct(
        row["file"].alias("artifact"), F.coalesce(F.nullif(row["title"], F.lit("")), row["path"]).alias("title"), F.concat((row["i"] + 1).cast("string"), F.lit("/"), row["n"].cast("string")).alias("chunk"),
        F.when(is_zim, "zim").otherwise("pdf").alias("kind"), F.when(is_zim, row["served"].isNotNull()).alias("book_verified"),
        F.when(is_zim, F.concat(F.lit("/viewer#"), zim)).otherwise(F.concat(F.lit("/files/"), rel, F.lit("#page="), F.coalesce(row["page"], F.lit(1)).cast("string"))).alias("url"),
        F.when(is_zim, F.concat(F.lit("/content/"), zim)).otherwise(F.concat(F.lit("/files/"), rel)).alias("raw_url"),
    )


def reference(text: Column) -> Column:
    """struct<label, up>: the first reference with a label that names something and of which the text holds no caption; null without one."""
    labels = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    ways = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(2))
    names = lambda label: label.rlike("[0-9A-Z]")

    def one(label: Column, way: Column) -> Column:
        plain = F.trim(F.regexp_replace(label, r"\s+", " "))
        cut = F.when(names(plain), F.trim(F.regexp_replace(plain, TRAILING, ""))).otherwise("")
        seen = (F.length(text) - F.length(F.replace(F.lower(text), F.lower(cut), F.lit("")))) / F.length(cut)
        ok = (cut != "") & names(cut)
        return F.when(ok & (F.when(ok, seen).otherwise(9) < 2), F.struct(cut.alias("label"), F.lower(way).isin("above", "preceding").alias("up")))

    return F.get(F.filter(F.zip_with(labels, ways, one), lambda x: x.isNotNull()), F.lit(0))


def expand(results: DataFrame, chunks: DataFrame, limit: int = 2) -> DataFrame:
    """query_id, rank, cid, of: results with the neighbour that holds the caption of what a passage refers to, behind the passage (rank plus a half).

    results: query_id, rank, cid; chunks: cid, src, dnum, i, text. A neighbour must hold the caption: table or figure, and the label, side by side.
    limit neighbours a page at most, none that is on it already.
    """
    rows = results.join(chunks.select("cid", "src", "dnum", "i", "text"), "cid").withColumn("r", reference(F.col("text"))).where("r is not null")
    near = rows.select("query_id", "rank", F.col("cid").alias("of"), "src", "dnum", "r", F.explode(F.array(F.struct((F.col("i") + 1).alias("i"), F.col("r.up").alias("late")), F.struct((F.col("i") - 1).alias("i"), (~F.col("r.up")).alias("late")))).alias("n"))
    near = near.select("query_id", "rank", "of", "src", "dnum", "r", F.col("n.i").alias("i"), F.col("n.late").alias("late"))
    caption = F.concat(F.lit(r"(?i)\b(?:table|figure|fig\.|chart)\s+\Q"), F.col("r.label"), F.lit(r"\E\b"))
    found = near.join(chunks.select("src", "dnum", "i", "cid", F.regexp_replace("text", r"\s+", " ").alias("t")), ["src", "dnum", "i"]).where(F.regexp_like("t", caption))
    best = found.groupBy("query_id", "rank", "of").agg(F.min_by("cid", "late").alias("cid"))
    new = best.join(results.select("query_id", "cid"), ["query_id", "cid"], "left_anti")
    first = Window.partitionBy("query_id", "cid").orderBy("rank")
    new = new.withColumn("k", F.row_number().over(first)).where("k = 1").withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("k") <= limit)
    return results.select("query_id", F.col("rank").cast("double").alias("rank"), "cid", F.lit(None).cast("string").alias("of")).unionByName(new.select("query_id", (F.col("rank") + 0.5).alias("rank"), "cid", F.col("of").cast("string")))
