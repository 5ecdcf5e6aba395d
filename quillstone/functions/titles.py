"""Expressions on titles, names of files, and commands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import words

#: Beginnings of titles that are furniture, and the shortest and longest question.
FURNITURE = "^(welcome|index|home|contents)"
SHORTEST, LONGEST, WORDS = 25, 150, 5


def question(title: Column, brand: Column) -> Column:
    """A title without its brand if it is a question of some length, else null."""
    end = F.concat(F.lit(" - "), brand)
    t = F.trim(F.when(title.endswith(end), F.substring(title, F.lit(1), F.length(title) - F.length(end))).otherwise(title))
    ok = t.endswith("?") & F.length(t).between(SHORTEST, LONGEST) & (F.size(words(t)) >= WORDS) & ~F.lower(t).rlike(FURNITURE) & ~t.contains("\n")
    return F.when(ok, t)


def shell_word(text: Column) -> Column:
    """A text as one word of a shell: as it stands if it needs no quotes."""
    quoted = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(text.rlike("^[A-Za-z0-9_@%+=:,./-]+$"), text).otherwise(quoted)


def public(rows: DataFrame) -> DataFrame:
    """The columns that don't begin with an underscore."""
    return rows.select(*(c for c in rows.columns if not c.startswith("_")))


def pinned(requirements: Column, package: str) -> Column:
    """The version that a list of requirements pins a package to, or null."""
    return F.nullif(F.regexp_extract(requirements, rf"(?m)^{package}==([^\s#;]+)", 1), F.lit(""))


def platform(name: Column) -> Column:
    """The platform that a token of a file's name says, or null: for all."""
    low = F.lower(name)
    return F.when(low.rlike(r"(^|[^a-z])(win|windows|win64|exe|msi)([^a-z]|$)"), "windows").when(low.rlike(r"(^|[^a-z])(mac|macos|darwin|dmg)([^a-z]|$)"), "macos").when(low.rlike(r"(^|[^a-z])(linux|ubuntu|deb)([^a-z]|$)"), "linux")


def pretty(docs: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """key, title: the title in a document's data (meta), else the largest text (key, text, size, y: share of the height from the top) in the upper half, the upper one of equals, else the file's name."""
    top = blocks.where((F.trim("text") != "") & (F.col("y") < 0.5)).groupBy(key).agg(F.max_by(F.trim("text"), F.struct("size", -F.col("y"))).alias("top"))
    return docs.join(top, key, "left").select(key, F.coalesce(F.nullif("meta", F.lit("")), "top", "file").alias("title"))
