"""Tables found on pages of PDF: whether one can be believed, its text, and a page's text with its tables in place."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dehyphenated

# Limits of a table that is believed.
COLUMNS, FILL, CELL, FIGURES, SHARE, SINGLE, LEAST_SINGLE, WIDE, WIDTH = 8, 0.40, 200, 6, 0.6, 0.40, 6, 4, 0.18
PAD = 2.0


def quality(rows: Column, original: Column, width: Column) -> Column:
    """What is wrong with a table (array<array<string>> of cleaned cells, its columns before empty ones went, its share of the page's width); '' if nothing."""
    cells = F.flatten(rows)
    filled = F.filter(cells, lambda c: c != "")
    n = F.size(F.get(rows, F.lit(0)))
    figures = lambda c: F.regexp_count(c, F.lit(r"\d+(?:[.,]\d+)?"))
    words = lambda c: F.greatest(F.lit(1), F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    one = F.size(F.filter(filled, lambda c: F.length(c) == 1))
    return (
        F.when((F.size(rows) < 2) | (n < 2), "too small")
        .when(n > COLUMNS, "too many columns")
        .when(F.size(filled) / F.size(cells) < FILL, "mostly empty")
        .when(F.exists(cells, lambda c: F.length(c) > CELL), "a column collapsed")
        .when(F.exists(cells, lambda c: (figures(c) >= FIGURES) & (figures(c) / words(c) > SHARE)), "figures run together")
        .when((F.size(filled) >= LEAST_SINGLE) & (one / F.size(filled) >= SINGLE), "columns were sliced")
        .when((original >= WIDE) & (n * 2 <= original), "slice of a wider table")
        .when(width < WIDTH, "sliver of a page")
        .otherwise("")
    )


def shrunk(rows: Column) -> Column:
    """The rows and columns with any text, padded to one width."""
    some = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
    width = F.array_max(F.transform(some, lambda r: F.size(r)))
    even = F.transform(some, lambda r: F.transform(F.sequence(F.lit(0), width - 1), lambda i: cleaned(F.get(r, i))))

    def kept(rows: Column) -> Column:
        keep = F.filter(F.sequence(F.lit(0), F.size(F.get(rows, F.lit(0))) - 1), lambda i: F.exists(rows, lambda r: F.get(r, i) != ""))
        return F.transform(rows, lambda r: F.transform(keep, lambda i: F.get(r, i)))

    return F.when(F.size(some) > 0, F.get(F.transform(F.array(even), kept), F.lit(0))).otherwise(F.slice(rows, 1, 0))


def table_text(rows: list[list[str]], header: list[str] | None = None, external: bool = False) -> str | None:
    """A table as prose (two columns) or as lines of cells; rows as shrunk leaves them. None if only a caption is left.

    Leading rows with one filled cell are captions, of which the last one stays. A header that the finder names is used if two of its cells are
    filled; without one the first row is, if it is full.
    """
    lead = 0
    while lead < len(rows) and sum(map(bool, rows[lead])) == 1:
        lead += 1
    if lead == len(rows):
        return None
    caption = next(filter(None, rows[lead - 1])) if lead else ""
    body, n = rows[lead:], len(rows[lead])
    named = bool(header and any(header) and len(header) == n)
    if named and not external and body[0] == header:
        body = body[1:]
    title = f"Table ({caption})" if caption else "Table"
    if n == 2:
        return " ".join([f"{title}.", *(f"{a}: {b}." if b else f"{a}." for a, b in body)])
    head = header if named and sum(map(bool, header)) >= 2 else None
    if not named and body and all(body[0]):
        head, body = body[0], body[1:]
    line = lambda cells: f"| {' | '.join(cells)} |"
    rule = [line(head), "|" + "---|" * n] if head else []
    return "\n".join([f"{title}:", *rule, *map(line, body)])


def tables(rows: DataFrame) -> DataFrame:
    """id, why, text of tables (id, rows, width): text is null where why says what is wrong."""
    s = rows.select("id", F.array_max(F.transform("rows", lambda r: F.size(r))).alias("original"), shrunk(F.col("rows")).alias("s"), "width")
    caption = lambda r: F.size(F.filter(r, lambda c: c != "")) == 1
    # the gate judges what stands below the captions
    first = F.coalesce(F.array_min(F.filter(F.transform("s", lambda r, i: F.when(~caption(r), i)), lambda i: i.isNotNull())), F.size("s"))
    s = s.withColumn("body", F.slice("s", first + 1, F.greatest(F.size("s") - first, F.lit(0))))
    why = F.when(F.size("s") == 0, "empty").when(F.size("body") == 0, "caption only").otherwise(quality(F.col("body"), F.col("original"), F.col("width")))
    s = s.select("id", why.alias("why"), "s")

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [table_text(r) if not w else None for w, r in zip(b.column("why").to_pylist(), b.column("s").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("why"), pa.array(got, pa.string())], ["id", "why", "text"])

    return s.mapInArrow(text, f"id {dict(s.dtypes)['id']}, why string, text string")


def page_text(blocks: DataFrame, boxes: DataFrame, key: str = "id") -> DataFrame:
    """key, text: blocks (key, x0, y0, x1, y1, text) whose middle isn't in a table's box, and the tables (same columns), from top to bottom."""
    inside = blocks.select(key, "x0", "y0", "x1", "y1", "text").join(boxes.select(key, *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1"))), key, "left")
    mid_x, mid_y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    held = F.coalesce(mid_x.between(F.col("b_x0") - PAD, F.col("b_x1") + PAD) & mid_y.between(F.col("b_y0") - PAD, F.col("b_y1") + PAD), F.lit(False))
    free = inside.groupBy(key, "x0", "y0", "x1", "y1", "text").agg(F.max(held).alias("held")).where("not held")
    tidy = F.trim(F.regexp_replace("text", r"\s+", " "))
    pieces = free.select(key, "y0", tidy.alias("t")).where("t <> ''").unionByName(boxes.select(key, "y0", F.col("text").alias("t")))
    return pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("y0", "t"))).alias("p")).select(key, F.array_join("p.t", "\n").alias("text"))


def cleaned(cell: Column) -> Column:
    """A cell's text: soft hyphens between letters go with the space after them, white space is single; null is empty."""
    return F.trim(F.regexp_replace(dehyphenated(F.coalesce(cell, F.lit(""))), r"(?U)\s+", " "))
