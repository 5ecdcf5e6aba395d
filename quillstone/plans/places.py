"""Queries on a table of place names and on places in texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import gazetteer as G
from ..operators import places
from ..sources.tables import table
from .queries import query

COUNTRIES = ["Algeria", "Argentina", "Brazil", "Canada", "Egypt", "Ethiopia", "France", "Germany", "India", "Indonesia", "Iran", "Iraq", "Japan", "Jordan", "Kenya", "Morocco", "Mozambique", "Peru", "China", "Romania", "Saudi Arabia", "Vietnam", "Russia", "United Kingdom", "Chile"]
_CASED = "([" + ", ".join(f"'{c}'" for c in COUNTRIES) + "])[n_nationkey % 25 + 1]"
_NAME_COLUMNS = "CASE WHEN k % 2 = 0 THEN 'country' ELSE 'locality' END AS kind, CASE WHEN k % 5 <> 0 THEN k % 17 END AS poprank, (k * 37 % 140) - 70.0::DOUBLE AS lat, (k * 101 % 350) - 175.0::DOUBLE AS lon, (k % 9) AS minzoom"
NAMES_SQL = f"names AS (SELECT k AS id, CASE WHEN k >= 100 THEN 'Port ' ELSE '' END || nm AS name, lower(CASE WHEN k >= 100 THEN 'Port ' ELSE '' END || nm) AS norm, lang, {_NAME_COLUMNS} FROM (SELECT n_nationkey AS k, {_CASED} AS nm, '' AS lang FROM nation UNION ALL SELECT n_nationkey + 100, {_CASED}, 'en' FROM nation UNION ALL SELECT n_nationkey + 200, {_CASED}, 'es' FROM nation WHERE n_nationkey % 3 = 0))"
_SAY = "CASE turn % 4 WHEN 0 THEN 'How far is ' || a || ' from here, I asked' WHEN 1 THEN 'they drove near Port ' || a || ', ' || b || ' and back' WHEN 2 THEN 'the ' || a || ' Stock is not a place, ' || text ELSE text END"
TEXTS_SQL = f"texts AS (SELECT conv_id * 1000 + turn AS id, {_SAY} AS text FROM conversations JOIN (SELECT n_nationkey AS x, {_CASED} AS a FROM nation) ON x = conv_id % 25 JOIN (SELECT n_nationkey AS y, {_CASED} AS b FROM nation) ON y = conv_id * 7 % 25 WHERE role = 'user')"


def _country():
    return F.element_at(F.array(*map(F.lit, COUNTRIES)), (F.col("n_nationkey") % 25 + 1).cast("int"))


def names(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), _country().alias("nm"))
    port = F.concat(F.lit("Port "), "nm")
    rows = n.select("k", F.col("nm").alias("name"), F.lit("").alias("lang")).union(n.select(F.col("k") + 100, port, F.lit("en"))).union(n.where("k % 3 = 0").select(F.col("k") + 200, port, F.lit("es")))
    k = F.col("k")
    return rows.select(k.alias("id"), "name", G.norm(F.col("name")).alias("norm"), "lang", F.when(k % 2 == 0, "country").otherwise("locality").alias("kind"), F.when(k % 5 != 0, k % 17).cast("int").alias("poprank"), ((k * 37 % 140) - 70.0).alias("lat"), ((k * 101 % 350) - 175.0).alias("lon"), (k % 9).alias("minzoom"))


def texts(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("x"), _country().alias("a"))
    c = table(spark, d, "conversations").where("role = 'user'").withColumns({"x": F.col("conv_id") % 25, "y": F.col("conv_id") * 7 % 25})
    rows = c.join(n, "x").join(n.select(F.col("x").alias("y"), F.col("a").alias("b")), "y")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.expr(_SAY).alias("text"))


def _found(spark, d):
    return G.mentions(texts(spark, d), names(spark, d))


@query("T17_norms", f"WITH {NAMES_SQL} SELECT id, name, norm, 2 AS norm_version FROM names")
def norms(spark, d):
    return G.norms(names(spark, d).select("id", "name")).select("id", "name", "norm", "norm_version")


@query("G12_place_ranks", f"WITH {NAMES_SQL} SELECT norm, max(coalesce(poprank, 0))::INT AS rank FROM names GROUP BY 1")
def place_ranks(spark, d):
    return G.place_ranks(names(spark, d)).withColumn("rank", F.col("rank").cast("int"))


@query("J11_mention_lookup", f"WITH {NAMES_SQL}, {TEXTS_SQL}, t AS (SELECT id, text FROM texts WHERE id % 1000 % 4 = 1), m AS (SELECT id, regexp_extract_all(text, 'Port ([A-Z][a-z]+(?: [A-Z][a-z]+)?), ([A-Z][a-z]+(?: [A-Z][a-z]+)?) and', 1)[1] AS a, regexp_extract_all(text, 'Port ([A-Z][a-z]+(?: [A-Z][a-z]+)?), ([A-Z][a-z]+(?: [A-Z][a-z]+)?) and', 2)[1] AS b FROM t) SELECT id, 'port ' || lower(a) AS norm FROM m UNION ALL SELECT id, lower(b) FROM m")
def mention_lookup(spark, d):
    """In texts of one form, in which places stand behind near and a comma."""
    t = texts(spark, d).where("id % 1000 % 4 = 1")
    return G.mentions(t, names(spark, d)).select("id", "norm")


@query("G7_mentions")
def mentions(spark, d):
    return _found(spark, d).drop("clause")


@query("G6_word_spans", f"WITH {TEXTS_SQL} SELECT id, len(regexp_extract_all(text, '[0-9A-Za-zÀ-ɏ'']+'))::INT AS n, array_to_string(list_filter(regexp_extract_all(text, '[0-9A-Za-zÀ-ɏ'']+'), lambda w: length(w) > 9), ' ') AS long FROM texts")
def word_spans(spark, d):
    t = texts(spark, d).select("id", G.text_words(F.col("text")).alias("w"))
    return t.select("id", F.size("w").alias("n"), F.array_join(F.filter(F.transform("w", lambda x: x["w"]), lambda x: F.length(x) > 9), " ").alias("long"))


@query("G8_references", "WITH c AS (SELECT c_custkey AS k, (['in', 'of', 'near', 'the'])[c_custkey % 4 + 1] AS prev, c_custkey % 3 = 0 AS cb, c_custkey % 5 = 0 AS ca, (['', 'Stock', 'and'])[c_custkey % 3 + 1] AS nxt, c_custkey % 7 = 0 AS np, c_custkey % 11 AS rank FROM customer), r AS (SELECT *, (prev IN ('in', 'near') OR cb OR ca) AND NOT (nxt = 'Stock' AND NOT np AND NOT ca) AS ref FROM c) SELECT k, ref AS reference, ref AND rank >= 10 AND (CASE WHEN k % 13 = 0 THEN ca AND np ELSE NOT (k % 2 = 0 AND NOT cb AND prev = 'near') END) AS passage FROM r")
def references(spark, d):
    k = F.col("c_custkey")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i + 1).cast("int"))
    m = table(spark, d, "customer").select(
        k.alias("k"), pick(["in", "of", "near", "the"], k % 4).alias("prev"), (k % 3 == 0).alias("comma_before"), (k % 5 == 0).alias("comma_after"), pick(["", "Stock", "and"], k % 3).alias("next"), (k % 7 == 0).alias("next_is_place"),
        (k % 11).alias("rank"), F.lit(False).alias("clause"), F.when(k % 13 == 0, "Turkey").otherwise("Cairo").alias("text"), (k % 2 == 0).alias("prev_capital"), F.lit(False).alias("prev_is_place"),
    )
    return m.select("k", G.is_place_reference().alias("reference"), G.in_passage().alias("passage"))


@query("G9_classify")
def classify(spark, d):
    asked = texts(spark, d).withColumn("cue", places.cue(F.col("text")))
    return G.classify(asked, G.mentions(asked, names(spark, d)), G.candidates(names(spark, d)))


@query("G10_passage_places")
def passage_places(spark, d):
    return G.passage_places(_found(spark, d), G.candidates(names(spark, d)))


@query("K7_passage_order", f"WITH {NAMES_SQL}, {TEXTS_SQL}, b AS (SELECT norm, first(coalesce(poprank, 0) ORDER BY poprank DESC NULLS LAST, minzoom, id) AS rank FROM names GROUP BY 1), m AS (SELECT id, lower(regexp_extract(text, 'near (Port [A-Z][a-z]+(?: [A-Z][a-z]+)?),', 1)) AS a, lower(regexp_extract(text, ', ([A-Z][a-z]+(?: [A-Z][a-z]+)?) and', 1)) AS b FROM texts WHERE id % 1000 % 4 = 1), p AS (SELECT id, a AS norm, 0 AS pl FROM m UNION ALL SELECT id, b, 1 FROM m), r AS (SELECT id, norm, row_number() OVER (PARTITION BY id ORDER BY rank DESC, pl)::INT AS nth FROM p JOIN b USING (norm) WHERE rank >= 10) SELECT id, norm, nth FROM r WHERE nth <= 3")
def passage_order(spark, d):
    t = texts(spark, d).where("id % 1000 % 4 = 1")
    return G.passage_places(G.mentions(t, names(spark, d)), G.candidates(names(spark, d))).select("id", "norm", "nth")


@query("L10_place_words", f"WITH {NAMES_SQL}, {TEXTS_SQL}, r AS (SELECT norm, max(coalesce(poprank, 0)) AS rank FROM names GROUP BY 1), m AS (SELECT id, unnest([lower(regexp_extract(text, 'near (Port [A-Z][a-z]+(?: [A-Z][a-z]+)?),', 1)), lower(regexp_extract(text, ', ([A-Z][a-z]+(?: [A-Z][a-z]+)?) and', 1))]) AS norm FROM texts WHERE id % 1000 % 4 = 1) SELECT id, array_to_string(list_sort(list(norm)), '|') AS words FROM m JOIN r USING (norm) WHERE rank >= 10 GROUP BY 1")
def place_words(spark, d):
    m = G.mentions(texts(spark, d).where("id % 1000 % 4 = 1"), names(spark, d))
    kept = m.where((F.col("rank") >= G.RANK) & ~F.col("clause") & ~F.lower("text").isin(G.AMBIGUOUS))
    return kept.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("norm")), "|").alias("words"))


@query("F10_gates")
def gate_counts(spark, d):
    return G.gates(_found(spark, d))


@query("J12_clusters")
def clusters(spark, d):
    return G.clusters(names(spark, d), ["norm"], [F.desc_nulls_last("poprank"), F.asc("minzoom"), F.asc("id")]).select("norm", "id", "place")


@query("G4_candidates")
def candidates(spark, d):
    return G.candidates(names(spark, d))


@query("G4_labels")
def labels(spark, d):
    n = names(spark, d)
    return G.labels(n.select("id", "name", "lat", "lon"), n, "id", 50.0)


@query("G3_first_sightings")
def first_sightings(spark, d):
    n = names(spark, d)
    again = n.withColumn("lat", F.col("lat") + 0.05).withColumn("id", F.col("id") + 1000)
    return G.first_sightings(n.unionByName(again), [F.asc("minzoom"), F.asc("id")]).select("id", "norm", "lang")


@query("F12_box", "WITH p AS (SELECT c_custkey AS k, c_custkey * 37 % 170 - 85.0::DOUBLE AS lat, c_custkey * 101 % 360 - 180.0::DOUBLE AS lon FROM customer) SELECT k FROM p WHERE lat BETWEEN 40 AND 60 AND abs((lon - 175 + 540) % 360 - 180) <= 20")
def box(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k.alias("k"), (k * 37 % 170 - 85.0).alias("lat"), (k * 101 % 360 - 180.0).alias("lon"))
    return p.where(places.in_box(F.col("lat"), F.col("lon"), 50.0, 175.0, 10.0, 20.0)).select("k")


@query("M18_firing_rate", f"WITH {TEXTS_SQL} SELECT count(*) AS texts, count(*) FILTER (id % 1000 % 4 = 0) AS with_cue FROM texts WHERE id % 1000 % 4 IN (0, 1)")
def firing_rate(spark, d):
    t = texts(spark, d).where("id % 1000 % 4 in (0, 1)")
    return t.agg(F.count(F.lit(1)).alias("texts"), F.count(F.when(places.cue(F.col("text")) == "how far", 1)).alias("with_cue"))
