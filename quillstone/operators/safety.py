"""Figures that a reader may act on, over tables: column expressions of functions.figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import figures


def findings(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, at, until, term, category, tier, why: a row for each finding. Null and empty texts have none."""
    return rows.select(key, F.explode(figures.scan(F.col(text))).alias("f")).select(key, "f.*")


def assessed(rows: DataFrame, keys: list[str], text: str, question: str | None = None) -> DataFrame:
    """keys with level, categories and terms of a text and its question."""
    ask = F.col(question) if question else F.lit(None).cast("string")
    return rows.select(*keys, figures.assess(F.col(text), ask).alias("a")).select(*keys, "a.*")


def compared(rows: DataFrame, keys: list[str], one: str, other: str) -> DataFrame:
    """keys with the state of two answers."""
    return rows.select(*keys, figures.compare(F.col(one), F.col(other)).alias("state"))


def rates(found: DataFrame, rows: DataFrame, key: str, by: str) -> DataFrame:
    """by, category, rows with a finding of the category, and their share of all rows of the group. A group without any has one row: no category, none hit."""
    total = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"))
    # a document's findings become one row a category before they meet their group
    hit = found.select(key, "category").distinct().join(rows.select(key, by), key).groupBy(by, "category").agg(F.count(F.lit(1)).alias("hit"))
    n = F.coalesce("hit", F.lit(0))
    return total.join(hit, by, "left").select(by, "category", n.alias("hit"), F.round(n / F.col("total"), 6).alias("rate"))
