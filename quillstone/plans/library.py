"""Queries on a library's catalogue, its files, places and integrity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, places, quality
from ..sources.tables import table, upsert
from .answers import FOLD_SQL
from .queries import WORDS_SQL, query

# -- scalar rules


@query("T14_percent_path", "SELECT page_id, replace(url_encode(url || ' ~*é'), '%2F', '/') AS path FROM pages")
def percent_path(spark, d):
    return table(spark, d, "pages").select("page_id", T.percent_path(F.concat("url", F.lit(" ~*é"))).alias("path"))


@query("T15_fold", f"SELECT doc_id, sha1({FOLD_SQL('text')}) AS folded FROM documents")
def fold(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha1(T.folded(F.col("text"))).alias("folded"))


_VOTES = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in (("en", T.ONLY_EN), ("es", T.ONLY_ES))}


@query("T19_language_votes", f"SELECT doc_id, CASE WHEN len(list_filter(string_split({FOLD_SQL('text')}, ' '), lambda w: list_contains({_VOTES['es']}, w))) > len(list_filter(string_split({FOLD_SQL('text')}, ' '), lambda w: list_contains({_VOTES['en']}, w))) THEN 'es' ELSE 'en' END AS lang FROM documents")
def language_votes(spark, d):
    return table(spark, d, "documents").select("doc_id", T.lang_votes(F.col("text")).alias("lang"))


@query("T21_human_size", "SELECT p_partkey, CASE WHEN b < 1024 THEN format('{:.1f} B', b) WHEN b < 1048576 THEN format('{:.1f} KB', b / 1024) WHEN b < 1073741824 THEN format('{:.1f} MB', b / 1048576) WHEN b < 1099511627776 THEN format('{:.1f} GB', b / 1073741824) ELSE format('{:.1f} TB', b / 1099511627776) END AS size FROM (SELECT p_partkey, pow(2.0::DOUBLE, p_partkey % 50) + p_partkey AS b FROM part)")
def human_size(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", T.human_size(F.pow(F.lit(2.0), k % 50) + k).alias("size"))


@query("T30_blob_id", "SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text)) || chr(0)) || encode(text)) AS blob FROM documents")
def blob_id(spark, d):
    return table(spark, d, "documents").select("doc_id", T.blob_id(F.encode("text", "utf-8")).alias("blob"))


@query("T32_row_path", "WITH a AS (SELECT p_partkey, '\\' || replace(p_brand, '#', '\\') || '/' AS shelf, CASE WHEN p_partkey % 3 = 0 THEN string_split(p_brand, '#')[2] WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || '.zim' END AS file FROM part), n AS (SELECT p_partkey, trim(replace(shelf, '\\', '/'), '/') AS shelf, trim(replace(file, '\\', '/'), '/') AS file FROM a) SELECT p_partkey, CASE WHEN file = '' OR string_split(shelf, '/')[-1] = file THEN shelf ELSE shelf || '/' || file END AS path FROM n")
def row_path(spark, d):
    k = F.col("p_partkey")
    shelf = F.concat(F.lit("\\"), F.translate("p_brand", "#", "\\"), F.lit("/"))
    file = F.when(k % 3 == 0, F.split("p_brand", "#")[1]).when(k % 5 == 0, "").otherwise(F.concat("p_name", F.lit(".zim")))
    return table(spark, d, "part").select("p_partkey", T.artifact_path(shelf, file).alias("path"))


@query("T33_row_title", "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END, ''), nullif(split_part(CASE WHEN p_size % 3 = 0 THEN p_name || ': about' ELSE '' END, ': ', 1), ''), p_brand) AS title FROM part")
def row_title(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", T.row_title(F.when(s % 2 == 0, F.col("p_type")), F.when(s % 3 == 0, F.concat("p_name", F.lit(": about"))), F.col("p_brand")).alias("title"))


# -- rows, files and editions


@query("S13_upsert_pins", "SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation) UNION ALL SELECT n_nationkey, n_name FROM nation")
def upsert_pins(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return upsert(old, table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), "id")


@query("S30_nearest_checksum", "WITH f AS (SELECT p_partkey, [p_type || '/' || p_brand, p_type, ''] AS dirs FROM part), c AS (SELECT DISTINCT p_type || '/' || p_brand AS dir, 2 AS depth FROM part WHERE p_size % 2 = 0 UNION SELECT DISTINCT p_type, 1 FROM part WHERE p_size % 7 = 3 UNION SELECT '', 0), e AS (SELECT p_partkey, unnest(dirs) AS dir FROM f) SELECT p_partkey, first(dir ORDER BY depth DESC) AS dir FROM e JOIN c USING (dir) GROUP BY 1")
def nearest_checksum(spark, d):
    p = table(spark, d, "part")
    deep = F.concat_ws("/", "p_type", "p_brand")
    lists = p.where("p_size % 2 = 0").select(deep.alias("dir"), F.lit(2).alias("depth")).union(p.where("p_size % 7 = 3").select("p_type", F.lit(1))).distinct().union(spark.range(1).select(F.lit(""), F.lit(0)))
    up = p.select("p_partkey", F.explode(F.array(deep, F.col("p_type"), F.lit(""))).alias("dir"))
    return up.join(lists, "dir").groupBy("p_partkey").agg(F.max_by("dir", "depth").alias("dir"))


_FILES = "files AS (SELECT p_brand AS repo, replace(p_name, ' ', '_') || (['.safetensors', '.bin', '.pt', '.png', '.json', '.onnx'])[p_partkey % 6 + 1] AS name, p_size AS size FROM part WHERE p_partkey % 6 <> 0 OR p_brand < 'Brand#3')"


@query("F9_keep_names", f"WITH {_FILES}, g AS (SELECT *, max(name LIKE '%.safetensors') OVER (PARTITION BY repo) AS st FROM files) SELECT repo, name, count(*) AS n FROM g WHERE NOT lower(name) LIKE '%.png' AND NOT (st AND (lower(name) LIKE '%.bin' OR lower(name) LIKE '%.pt')) GROUP BY 1, 2")
def keep_names(spark, d):
    end = F.element_at(F.array(*map(F.lit, [".safetensors", ".bin", ".pt", ".png", ".json", ".onnx"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    files = table(spark, d, "part").where("p_partkey % 6 <> 0 or p_brand < 'Brand#3'").select(F.col("p_brand").alias("repo"), F.concat(F.translate("p_name", " ", "_"), end).alias("name"))
    return corpus.keep_names(files).groupBy("repo", "name").agg(F.count(F.lit(1)).alias("n"))


@query("F7_library_filter", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND list_has_all(string_split(lower(p_name || ' ' || p_brand), ' '), ['small']) AND p_size % 4 <> 3")
def library_filter(spark, d):
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    return table(spark, d, "part").where((F.col("p_type") == "ECONOMY") & corpus.has_words(hay, ["small"]) & (F.col("p_size") % 4 != 3)).select("p_partkey")


@query("K11_newest_edition", "WITH e AS (SELECT p_brand AS stem, p_partkey, (2020 + p_size % 5) || '-' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') AS date, CASE WHEN p_partkey % 3 = 0 THEN 'b' ELSE '' END AS rev FROM part) SELECT stem, max(date || rev) AS newest, count(DISTINCT date || rev) AS editions FROM e GROUP BY 1")
def newest_edition(spark, d):
    k, s = F.col("p_partkey"), F.col("p_size")
    e = table(spark, d, "part").select(F.col("p_brand").alias("stem"), F.concat((2020 + s % 5).cast("string"), F.lit("-"), F.lpad((k % 12 + 1).cast("string"), 2, "0")).alias("date"), F.when(k % 3 == 0, "b").otherwise("").alias("rev"))
    name = F.concat("date", "rev")
    return e.groupBy("stem").agg(F.max_by(name, F.struct("date", "rev")).alias("newest"), F.countDistinct(name).alias("editions"))


@query("K13_first_seen", "SELECT p_brand AS repo, array_to_string(list(p_type ORDER BY first), ',') AS types FROM (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY 1, 2) GROUP BY 1")
def first_seen(spark, d):
    f = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first"))
    return f.groupBy(F.col("p_brand").alias("repo")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("first", "p_type")))["p_type"], ",").alias("types"))


_TREES = "a AS (SELECT o_orderkey AS path, sha1(o_custkey::VARCHAR) AS h, o_custkey % 50 AS size FROM orders), b AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS path, sha1((CASE WHEN o_orderkey % 17 = 0 THEN o_custkey + 1 ELSE o_custkey END)::VARCHAR) AS h, o_custkey % 50 AS size FROM orders WHERE o_orderkey % 19 <> 0)"


def _trees(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, d, "orders")
    a = o.select(k.alias("path"), F.sha1(c.cast("string")).alias("h"), (c % 50).alias("size"))
    return a, o.where(k % 19 != 0).select(F.when(k % 13 == 0, k + 100000000).otherwise(k).alias("path"), F.sha1(F.when(k % 17 == 0, c + 1).otherwise(c).cast("string")).alias("h"), (c % 50).alias("size"))


@query("J16_tree_match", f"WITH {_TREES}, u AS (SELECT h, min(path) AS found FROM b GROUP BY 1), m AS (SELECT a.path, CASE WHEN b.h = a.h THEN 'same' WHEN u.found IS NOT NULL THEN 'renamed' WHEN b.path IS NULL THEN 'missing' ELSE 'differs' END AS state FROM a LEFT JOIN b ON a.path = b.path LEFT JOIN u ON u.h = a.h) SELECT state, count(*) AS n FROM m GROUP BY 1")
def tree_match(spark, d):
    return corpus.match_trees(*_trees(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("U3_tree_difference", f"WITH {_TREES} SELECT path, 'missing' AS side FROM (SELECT path FROM a EXCEPT SELECT path FROM b) UNION ALL SELECT path, 'new' FROM (SELECT path FROM b EXCEPT SELECT path FROM a)")
def tree_difference(spark, d):
    a, b = _trees(spark, d)
    return a.select("path").subtract(b.select("path")).withColumn("side", F.lit("missing")).unionByName(b.select("path").subtract(a.select("path")).withColumn("side", F.lit("new")))


@query("M11_pin_state", "WITH p AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 <> 0 THEN p_size END AS pinned, CASE WHEN p_size % 3 <> 0 THEN p_size - (p_size % 7 = 1)::INT END AS found FROM part) SELECT CASE WHEN found IS NULL THEN 'UNPINNED' WHEN pinned IS NULL THEN 'PINNED' WHEN pinned = found THEN 'CONFIRMED' ELSE 'DISAGREES' END AS state, count(*) AS n FROM p GROUP BY 1")
def pin_state(spark, d):
    s = F.col("p_size")
    p = table(spark, d, "part").select(F.when(s % 4 != 0, s).alias("pinned"), F.when(s % 3 != 0, s - (s % 7 == 1).cast("int")).alias("found"))
    return p.groupBy(corpus.pin_state(F.col("pinned"), F.col("found")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("J9_code_coverage", "WITH r AS (SELECT s_suppkey AS file, 100 + s_suppkey AS chunks FROM supplier), s AS (SELECT n_nationkey AS file, CASE WHEN n_nationkey % 5 = 0 THEN 99 ELSE 100 END + n_nationkey AS rows FROM nation) SELECT sum(chunks)::BIGINT AS total, coalesce(sum(chunks) FILTER (rows = chunks), 0)::BIGINT AS covered, count(*) FILTER (rows IS NULL) AS missing, count(*) FILTER (rows <> chunks) AS changed FROM r LEFT JOIN s USING (file)")
def code_coverage(spark, d):
    r = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), (100 + F.col("s_suppkey")).alias("chunks"))
    n = F.col("n_nationkey").cast("long")
    return corpus.coverage(r, table(spark, d, "nation").select(n.alias("file"), (F.when(n % 5 == 0, 99).otherwise(100) + n).alias("rows")))


@query("M8_index_state", "WITH r AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size % 3 END AS stamp, p_size % 2 AS now FROM part) SELECT id, CASE WHEN stamp IS NULL THEN 'missing' WHEN stamp <> now THEN 'stale' ELSE 'current' END AS state FROM r")
def index_state(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), corpus.index_state(F.when(s % 5 != 0, s % 3), s % 2).alias("state"))


_AFTER = ["doc_id + CASE WHEN doc_id % 23 = 0 THEN 1000000000 ELSE 0 END AS doc_id", "CASE WHEN doc_id % 5 = 0 THEN text || '.' ELSE text END AS text", "CASE WHEN doc_id % 13 = 0 THEN 'xx' ELSE lang END AS lang", "CASE WHEN doc_id % 17 = 0 THEN NULL ELSE n_chars END AS n_chars", "source"]


@query("M27_repair_verify", "SELECT count(*) FILTER (doc_id % 23 <> 0 AND ((doc_id % 13 = 0 AND lang IS DISTINCT FROM 'xx') OR (doc_id % 17 = 0 AND n_chars IS NOT NULL))) AS changed, count(*) FILTER (doc_id % 23 <> 0 AND doc_id % 5 = 0 AND text IS NOT NULL) AS repaired, (2 * count(*) FILTER (doc_id % 23 = 0))::BIGINT AS missing FROM documents")
def repair_verify(spark, d):
    a = table(spark, d, "documents")
    return corpus.verify_repair(a, a.selectExpr(*_AFTER), "doc_id", ["lang", "n_chars", "source"])


@query("A14_calibrate", "WITH p AS (SELECT p_brand AS file, p_type, p_size + 1 AS predicted, p_retailprice AS actual FROM part), r AS (SELECT *, actual / predicted AS ratio, row_number() OVER (PARTITION BY file ORDER BY actual / predicted) AS k, count(*) OVER (PARTITION BY file) AS n FROM p) SELECT file, round(sum(actual) / sum(predicted), 6) AS total, round(max(ratio) FILTER (k = n // 2 + 1), 6) AS upper_median, round(min(ratio), 6) AS lowest, round(max(ratio), 6) AS highest FROM r GROUP BY 1")
def calibrate(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("file"), (F.col("p_size") + 1).alias("predicted"), F.col("p_retailprice").alias("actual"))
    return corpus.calibrate(p)


@query("A16_extrapolate", "WITH p AS (SELECT p_brand AS file, p_size, p_partkey % 4 <> 1 AS seen FROM part), g AS (SELECT file, sum(p_size) FILTER (seen) AS chunks, count(*) FILTER (seen) AS docs, count(*) AS every FROM p GROUP BY 1) SELECT file, round(chunks / docs, 6) AS density, round(chunks * every / docs, 3) AS est_chunks FROM g WHERE docs > 0")
def extrapolate(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_size").alias("chunks"), (F.col("p_partkey") % 4 != 1).alias("seen"))
    return corpus.extrapolate(p)


@query("A21_case_share", f"WITH w AS (SELECT unnest({WORDS_SQL('text')}) AS w FROM documents) SELECT lower(w) AS word, count(*) AS n, round(count(*) FILTER (w <> lower(w)) / count(*), 6) AS upper_share FROM w GROUP BY 1 HAVING count(*) >= 20 AND count(*) FILTER (w <> lower(w)) >= 0.2 * count(*)")
def case_share(spark, d):
    w = table(spark, d, "documents").select(F.explode(T.words(F.col("text"))).alias("w"))
    g = w.groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("w") != F.lower("w"), 1)).alias("u"))
    return g.where("n >= 20 and u >= 0.2 * n").select("word", "n", F.round(F.col("u") / F.col("n"), 6).alias("upper_share"))


@query("L11_near_duplicate_pages", "WITH s AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT doc_id, " + WORDS_SQL("text") + " AS w FROM documents)) SELECT a.doc_id, len(list_intersect(a.s, b.s)) >= 0.55 * least(len(a.s), len(b.s)) AS near FROM s a JOIN s b ON b.doc_id = a.doc_id + 1 WHERE len(a.s) > 0 AND len(b.s) > 0")
def near_duplicate_pages(spark, d):
    n = quality.neighbours(table(spark, d, "documents")).where("mine > 0 and next > 0")
    return n.select("doc_id", (F.col("shared") >= 0.55 * F.least("mine", "next")).alias("near"))


# -- suggestion


@query("M3_token_match", "WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS k FROM part), t AS (SELECT k || s AS t FROM w, (VALUES (''), ('s'), ('ing'), ('ly'), ('ers'))  AS x(s)) SELECT t, k, t = k OR (length(t) >= 4 AND length(k) >= 4 AND ((starts_with(t, k) AND list_contains(['s', 'es', 'ed', 'd', 'ing', 'er', 'ers'], t[length(k) + 1:])) OR (starts_with(k, t) AND list_contains(['s', 'es', 'ed', 'd', 'ing', 'er', 'ers'], k[length(t) + 1:])))) AS match FROM t JOIN w ON t[1:2] = k[1:2]")
def token_match(spark, d):
    w = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("k")).distinct()
    t = w.select(F.explode(F.array(*(F.concat("k", F.lit(s)) for s in ("", "s", "ing", "ly", "ers")))).alias("t"))
    return t.join(w, F.substring("t", 1, 2) == F.substring("k", 1, 2)).select("t", "k", corpus.token_match(F.col("t"), F.col("k")).alias("match"))


@query("M4_topic_score")
def topic_score(spark, d):
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.array(F.lower("p_name"), F.lower("p_type")).alias("keywords"), F.when(F.col("p_size") % 2 == 0, "en").otherwise("es").alias("lang"))
    asked = spark.createDataFrame([(0, "which small rings are economy"), (1, "a large ring"), (2, "nothing here")], "query_id int, question string")
    return corpus.suggest(rows, asked, 3)


# -- places

_POINTS = "p AS (SELECT c_custkey AS k, 'n' || c_nationkey AS norm, c_custkey * 37 % 1000 / 100.0::DOUBLE AS lat, c_custkey * 101 % 1000 / 100.0::DOUBLE AS lon, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 30 END AS poprank FROM customer)"


def _points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), F.concat(F.lit("n"), "c_nationkey").alias("norm"), (k * 37 % 1000 / 100.0).alias("lat"), (k * 101 % 1000 / 100.0).alias("lon"), F.when(k % 4 != 0, k % 30).alias("poprank"))


@query("A11_place_rank", f"WITH {_POINTS} SELECT norm, max(coalesce(poprank, 0)) AS poprank, count(*) AS n FROM p GROUP BY 1")
def place_rank(spark, d):
    return _points(spark, d).groupBy("norm").agg(F.max(F.coalesce("poprank", F.lit(0))).alias("poprank"), F.count(F.lit(1)).alias("n"))


@query("K6_candidates", f"WITH {_POINTS} SELECT norm, k, row_number() OVER (PARTITION BY norm ORDER BY poprank DESC NULLS LAST, k) AS place FROM p")
def candidates(spark, d):
    w = Window.partitionBy("norm").orderBy(F.desc_nulls_last("poprank"), "k")
    return _points(spark, d).select("norm", "k", F.row_number().over(w).cast("long").alias("place"))


_KM = "2 * 6371 * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


@query("J13_names_at", f"WITH {_POINTS} , s AS (SELECT s_suppkey AS s, s_suppkey * 53 % 1000 / 100.0::DOUBLE AS lat, s_suppkey * 29 % 1000 / 100.0::DOUBLE AS lon FROM supplier), m AS (SELECT a.s, b.norm, b.k, {_KM} AS km FROM s a JOIN p b ON abs(b.lat - a.lat) < 0.6) SELECT s, norm, first(k ORDER BY round(km, 6), k) AS k, round(min(km), 4) AS km FROM m WHERE km <= 50 GROUP BY 1, 2")
def names_at(spark, d):
    k = F.col("s_suppkey")
    at = table(spark, d, "supplier").select(k.alias("s"), (k * 53 % 1000 / 100.0).alias("lat"), (k * 29 % 1000 / 100.0).alias("lon"))
    near = places.nearest_names(at, _points(spark, d).select("k", "norm", "lat", "lon"), 50.0, "s", "k")
    return near.select("s", "norm", "k", F.round("km", 4).alias("km"))


@query("G2_tile_point", "WITH t AS (SELECT c_custkey AS k, c_custkey % 8 AS z, c_custkey % (1 << (c_custkey % 8)) AS x, c_custkey * 7 % (1 << (c_custkey % 8)) AS y, c_custkey * 13 % 4096 AS px, c_custkey * 17 % 4096 AS py FROM customer) SELECT k, round((x + px / 4096) / pow(2.0::DOUBLE, z) * 360 - 180, 6) AS lon, round(degrees(atan(sinh(pi() * (1 - 2 * (y + py / 4096) / pow(2.0::DOUBLE, z))))), 6) AS lat FROM t")
def tile_point(spark, d):
    k = F.col("c_custkey")
    n = F.shiftleft(F.lit(1), 3)  # zoom levels below 8
    size = F.pow(F.lit(2.0), k % n).cast("long")
    t = table(spark, d, "customer").select(k.alias("k"), (k % n).alias("z"), (k % size).alias("x"), (k * 7 % size).alias("y"), (k * 13 % 4096).alias("px"), (k * 17 % 4096).alias("py"))
    lon, lat = places.tile_point(*(F.col(c) for c in ("z", "x", "y", "px", "py")))
    return t.select("k", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_CUES = "[" + ", ".join(f"'{c}'" for c in places.CUES) + "]"
_ASK = "(['Where is the town of ', 'how far is ', '¿Cuál es el clima en ', 'Donde puedo comprar ', 'who wrote '])[turn % 5 + 1] || text"


@query("G5_cue", f"WITH t AS (SELECT conv_id, turn, {FOLD_SQL(_ASK)} AS t FROM conversations WHERE role = 'user'), c AS (SELECT *, list_filter({_CUES}, lambda c: contains(' ' || t || ' ', ' ' || c || ' ')) AS cs FROM t) SELECT conv_id, turn, CASE WHEN len(cs) > 0 THEN cs[1] WHEN regexp_matches(t, '^where(\\s*abouts)?\\s*(\\w+\\s+){{0,3}}(is|are|was|were)\\b') THEN 'where is' WHEN regexp_matches(t, '^(a\\s+)?donde\\s*(\\w+\\s+){{0,3}}(queda|quedan|esta|estan|se encuentra|se encuentran)\\b') THEN 'donde queda' END AS cue FROM c")
def cue(spark, d):
    asks = F.element_at(F.array(*map(F.lit, ["Where is the town of ", "how far is ", "¿Cuál es el clima en ", "Donde puedo comprar ", "who wrote "])), (F.col("turn") % 5 + 1).cast("int"))
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", places.cue(F.concat(asks, "text")).alias("cue"))


@query("G11_climate", "WITH s AS (SELECT c_custkey AS k, [c_custkey % 5, c_custkey % 3, c_custkey % 5 + (c_custkey % 7 = 0)::INT] AS seq, 60 + c_custkey % 40 AS c0, 60 + c_custkey * 3 % 40 AS c1 FROM customer) SELECT k, CASE WHEN seq[1] <> seq[-1] THEN 'moved' WHEN len(list_distinct(seq)) > 1 THEN 'returned' ELSE 'stable' END AS change, least(c0, c1) < 75 AS weak FROM s")
def climate(spark, d):
    k = F.col("c_custkey")
    s = table(spark, d, "customer").select(k.alias("k"), F.array(k % 5, k % 3, k % 5 + (k % 7 == 0).cast("int")).alias("seq"), (60 + k % 40).alias("c0"), (60 + k * 3 % 40).alias("c1"))
    return s.select("k", places.climate_change(F.col("seq")).alias("change"), (F.least("c0", "c1") < 75).alias("weak"))
