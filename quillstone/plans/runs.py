"""Queries on tiles, grids, steps of a run, editions, and the payload of a search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalogue, html, retrieval, tiles
from ..sources.tables import table
from .answers import _pool
from .queries import query

_TILES = "t AS (SELECT 0 AS z, 0 AS x, 0 AS y, 1 AS n UNION ALL SELECT 1, c_custkey % 2, c_custkey // 2 % 2, (c_custkey % 2 + c_custkey // 2 % 2 > 0)::INT FROM customer WHERE c_custkey <= 4 UNION ALL SELECT 2, c_custkey % 4, c_custkey // 4 % 4, c_custkey % 3 FROM customer WHERE c_custkey <= 16)"


@query("S17_tile_walk", f"WITH {_TILES}, a AS (SELECT * FROM t WHERE z = 1 AND n > 0), b AS (SELECT t.* FROM t JOIN a ON t.z = 2 AND t.x // 2 = a.x AND t.y // 2 = a.y WHERE t.n > 0) SELECT 0::BIGINT AS z, 0::BIGINT AS x, 0::BIGINT AS y UNION ALL SELECT z, x, y FROM a UNION ALL SELECT z, x, y FROM b WHERE x <> 3")
def tile_walk(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    one = c.where("c_custkey <= 4").select(F.lit(1).alias("z"), (k % 2).alias("x"), (F.floor(k / 2) % 2).alias("y"), ((k % 2) + (F.floor(k / 2) % 2) > 0).cast("long").alias("n"))
    two = c.where("c_custkey <= 16").select(F.lit(2), k % 4, F.floor(k / 4) % 4, k % 3)
    there = spark.range(1).select(F.lit(0).alias("z"), F.col("id").alias("x"), F.col("id").alias("y"), F.lit(1).cast("long").alias("n")).union(one).union(two)
    done = there.where("z = 2 and x = 3")
    return tiles.walk(there, 2, done).select(*(F.col(n).cast("long").alias(n) for n in ("z", "x", "y")))


@query("S16_tile_places")
def tile_places(spark, d):
    """Tiles are written by hand: a point of each supplier."""
    made = table(spark, d, "supplier").select(F.col("s_suppkey").alias("x"), "s_name")
    rows = [(3, r["x"] % 8, r["x"] // 8 % 8, tile_of([{"name": r["s_name"], "kind": "locality", "population_rank": r["x"] % 15}], [(r["x"] * 97 % 4096, 2048)])) for r in made.orderBy("x").limit(64).collect()]  # a fixture of 64 tiles
    return tiles.places_in(spark.createDataFrame(rows, "z int, x long, y long, data binary"))


def tile_of(attributes: list[dict], at: list[tuple[int, int]], layer: str = "places") -> bytes:
    """A tile with one layer of points, for fixtures."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    part = lambda number, data: varint(number << 3 | 2) + varint(len(data)) + data
    keys = sorted({k for a in attributes for k in a})
    values = sorted({v for a in attributes for v in a.values()}, key=repr)
    body = part(1, layer.encode())
    for a, (x, y) in zip(attributes, at, strict=True):
        tags = b"".join(varint(keys.index(k)) + varint(values.index(v)) for k, v in a.items())
        body += part(2, part(2, tags) + varint(3 << 3) + varint(1) + part(4, varint(9) + varint(2 * x) + varint(2 * y)))
    body += b"".join(part(3, k.encode()) for k in keys)
    body += b"".join(part(4, part(1, v.encode()) if isinstance(v, str) else varint(4 << 3) + varint(v)) for v in values)
    return part(3, body + varint(5 << 3) + varint(4096))


@query("S21_grid_sample", "WITH p AS (SELECT c_custkey AS k, c_custkey * 37 % 180 - 90.0::DOUBLE AS lat, c_custkey * 101 % 360 - 180.0::DOUBLE AS lon FROM customer) SELECT k, floor((90 - lat) / 10)::BIGINT * 36 + floor((lon + 180) / 10)::BIGINT AS value FROM p WHERE lat > -90")
def grid_sample(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("k"), (k * 37 % 180 - 90.0).alias("lat"), (k * 101 % 360 - 180.0).alias("lon")).where("lat > -90")
    grid = spark.range(18 * 36).select(F.floor(F.col("id") / 36).alias("row"), (F.col("id") % 36).alias("column"), F.col("id").alias("value"))
    return tiles.nearest_cell(p, grid, 10.0).select("k", "value")


_STEPS = "s AS (SELECT p_partkey // 5 AS run, p_partkey % 5 AS nth, p_size % 4 > 0 AS due, p_size % 9 > 0 AS ok FROM part)"


@query("M9_run_steps", f"WITH {_STEPS}, f AS (SELECT *, coalesce(bool_or(due AND NOT ok) OVER (PARTITION BY run ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS after FROM s) SELECT run, nth, CASE WHEN after THEN 'not run' WHEN NOT due THEN 'up to date' WHEN ok THEN 'done' ELSE 'failed' END AS state FROM f")
def run_steps(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    steps = table(spark, d, "part").select(F.floor(k / 5).alias("run"), (k % 5).alias("nth"), (s % 4 > 0).alias("due"), (s % 9 > 0).alias("ok"))
    return catalogue.run_steps(steps)


@query("M12_line_end_plan", "SELECT CASE WHEN p_size % 3 = 0 THEN 'same' WHEN p_size % 3 = 1 THEN 'proven' ELSE 'unproven' END AS state, count(*) AS files, sum(p_size)::BIGINT AS bytes FROM part GROUP BY 1")
def line_end_plan(spark, d):
    s = F.col("p_size")
    state = catalogue.line_ends(F.lit("a"), F.when(s % 3 == 0, "a").otherwise("b"), F.when(s % 3 == 1, "b"), F.lit("c"))
    return table(spark, d, "part").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("files"), F.sum("p_size").cast("long").alias("bytes"))


@query("M36_sum_update", "WITH l AS (SELECT p_brand AS shelf, p_type AS path, count(*) AS n FROM part GROUP BY 1, 2), t AS (SELECT shelf, sum(n) AS lines FROM l GROUP BY 1) SELECT shelf, path, CASE WHEN n = 1 THEN 'rewrite' ELSE 'refuse' END AS plan, CASE WHEN n = 1 THEN lines END::BIGINT AS total FROM l JOIN t USING (shelf)")
def sum_update(spark, d):
    lines = table(spark, d, "part").select(F.col("p_brand").alias("shelf"), F.col("p_type").alias("path"))
    return catalogue.sum_update(lines)


@query("M26_substitutions", "WITH r AS (SELECT p_partkey AS id, '2024-' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') AS want, CASE WHEN p_size % 5 > 0 THEN '2024-' || lpad((p_size % 7 + 3)::VARCHAR, 2, '0') END AS newest FROM part) SELECT id, CASE WHEN newest IS NULL THEN 'gone' WHEN newest = want THEN 'same' WHEN newest > want THEN 'substituted' ELSE 'older' END AS state, CASE WHEN newest > want THEN newest END AS took FROM r")
def substitutions(spark, d):
    s = F.col("p_size")
    month = lambda n: F.concat(F.lit("2024-"), F.lpad(n.cast("string"), 2, "0"))
    state, took = catalogue.substitution(month(s % 12 + 1), F.when(s % 5 > 0, month(s % 7 + 3)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), state.alias("state"), took.alias("took"))


@query("M32_best_batch", "SELECT p_type AS model, first(p_size ORDER BY p_retailprice / p_size DESC, p_size) AS best FROM part WHERE p_size > 0 GROUP BY 1")
def best_batch(spark, d):
    rate = F.col("p_retailprice") / F.col("p_size")
    return table(spark, d, "part").where("p_size > 0").groupBy(F.col("p_type").alias("model")).agg(F.max_by("p_size", F.struct(rate, -F.col("p_size"))).alias("best"))


@query("M23_affordable", "SELECT c_custkey AS id, CASE WHEN need <= free THEN 'fits' WHEN need <= total THEN 'evict' ELSE 'too large' END AS state FROM (SELECT c_custkey, c_custkey * 53 % 9000 AS need, c_custkey * 31 % 5000 AS free, 6000 AS total FROM customer)")
def affordable(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), catalogue.affordable(k * 53 % 9000, k * 31 % 5000, F.lit(6000)).alias("state"))


@query("T4_table_rendering")
def table_rendering(spark, d):
    """Small tables of every page's size, as html gives them."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("<table><tr><th>page<th>size</tr><tr><td>"), "page_id", F.lit("<td>"), F.length("html"), F.lit("</tr></table>")).alias("html"))
    return html.html_to_text(p).select("page_id", "text")


@query("T5_plain_text", "SELECT page_id, 'a' || page_id || ' & b c d' AS text FROM pages")
def plain_text(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("<p>a<i>"), F.lit("</i>"), "page_id", F.lit(" &amp;amp; b [12] c<br>d</p>")).alias("html"))
    return html.html_to_text(p).select("page_id", F.regexp_replace(F.regexp_replace("text", r"\[12\]", ""), r"\s+", " ").alias("text")).select("page_id", F.regexp_replace("text", "^a ", "a").alias("text"))


@query("T2_boilerplate", "SELECT page_id, 'x' || page_id || ' z' AS text FROM pages")
def boilerplate(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("x"), "page_id", F.lit("<div class='navbox y'>a<div>b</div>c</div><!-- htdig_noindex -->no<!-- /htdig_noindex --> z<footer>f<b>g</b></footer>")).alias("html"))
    return html.html_to_text(p).select("page_id", F.regexp_replace("text", r"\s+", " ").alias("text"))


@query("T3_balanced_tags", "SELECT page_id, 'a' AS text FROM pages")
def balanced_tags(spark, d):
    """A block that never closes goes on to the end."""
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("a<div id='catlinks'>b<div>c</div>"), "page_id").alias("html"))
    return html.html_to_text(p).select("page_id", "text")


@query("R8_search_payload")
def search_payload(spark, d):
    pool = _pool(spark, d)
    return retrieval.payload(retrieval.page(pool, 5), pool.select("query_id", "rank", "cid"), "keyword")
