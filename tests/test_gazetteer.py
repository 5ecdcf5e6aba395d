"""Places in texts and tables of names, on small cases."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import gazetteer as G

NAMES = [
    ("Cairo", "en", "locality", 14, 30.04, 31.23, 3), ("القاهرة", "", "locality", 14, 30.045, 31.235, 3), ("Cairo", "vi", "locality", 14, 30.04, 31.24, 3), ("Cairo", "", "locality", 5, 37.0, -89.18, 9),
    ("Tromsø", "", "locality", 9, 69.65, 18.96, 6), ("Tromso", "tr", "locality", 9, 69.65, 18.97, 6), ("Ottawa", "", "locality", 12, 45.42, -75.7, 5), ("Canada", "", "country", 15, 60.0, -96.0, 1),
    ("New York", "", "locality", 14, 40.71, -74.0, 3), ("York", "", "locality", 8, 53.96, -1.08, 7), ("Turkey", "en", "country", 15, 39.0, 35.0, 1), ("On", "", "locality", None, 1.0, 1.0, 9),
    ("Lima", "", "locality", 13, -12.04, -77.03, 3), ("Peru", "", "country", 15, -10.0, -75.0, 1), ("Suva", "", "locality", 11, -18.14, 178.44, 4), ("Apia", "", "locality", 10, -13.83, -171.76, 4),
]


@pytest.fixture(scope="module")
def names(spark):
    rows = [(i, *n) for i, n in enumerate(NAMES)]
    return G.norms(spark.createDataFrame(rows, "id int, name string, lang string, kind string, poprank int, lat double, lon double, minzoom int")).cache()


def found(spark, names, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    out = {}
    for r in G.mentions(rows, names).orderBy("id", "at_word").collect():
        out.setdefault(r["id"], []).append(r)
    return [out.get(i, []) for i in range(len(texts))]


def test_norms(spark, names):
    words = ["Bogotá", "TROMSØ", "Æro  Straße", "İzmir", "O’Brien's", "Łódź", "ÞÓR"]
    got = [r["n"] for r in spark.createDataFrame(list(enumerate(words)), "i int, w string").select("i", G.norm(F.col("w")).alias("n")).orderBy("i").collect()]
    assert got == [G.normalise(w) for w in words] and got[:3] == ["bogota", "tromso", "aero strasse"]
    assert {r["norm_version"] for r in names.collect()} == {G.NORM_VERSION}


def test_mentions(spark, names):
    texts = [
        "How cold is Cairo in winter?", "Is turkey on the menu?", "On the road to New York", "where is tromso", "Which of These Towns near Ottawa Are Most Cold Now?", "OTTAWA is cold",
        "Ottawa, Canada is cold. We drove through Ottawa without stopping", None, "", "we asked what about York then? Turkey Stock is sold in Lima, Peru",
    ]
    got = found(spark, names, *texts)
    assert [[m["text"] for m in x] for x in got] == [["Cairo"], [], ["New York"], [], ["Ottawa"], [], ["Ottawa", "Canada", "Ottawa"], [], [], ["York", "Turkey", "Lima", "Peru"]]
    first, canada, second = got[6]
    assert first["comma_after"] and first["clause"] and first["next_is_place"] and not second["comma_after"] and canada["comma_before"] and canada["prev_is_place"]
    york, turkey, lima, peru = got[9]
    assert turkey["clause"] and turkey["next"] == "Stock" and lima["prev"] == "in" and peru["rank"] == 15


def test_references(spark, names):
    rows = spark.createDataFrame(list(enumerate(["We ate Turkey Stock near Lima beans.", "It rains in Lima, Peru and near Ottawa today.", "you should ask George York about it, in Cairo then."])), "id int, text string")
    m = G.mentions(rows, names)
    ok = {(r["id"], r["text"]): (r["a"], r["b"]) for r in m.select("id", "text", G.is_place_reference().alias("a"), G.in_passage().alias("b")).collect()}
    assert ok[0, "Turkey"] == (False, False) and ok[0, "Lima"] == (True, False)  # lima beans
    assert ok[1, "Lima"] == (True, True) and ok[1, "Ottawa"] == (True, True) and ok[1, "Peru"] == (True, True) and ok[2, "Cairo"] == (True, True) and ok[2, "York"][1] is False
    best = G.candidates(names)
    top = {(r["id"], r["nth"]): (r["norm"], r["times"]) for r in G.passage_places(m, best).collect()}
    assert top[1, 1] == ("peru", 1) and top[1, 2] == ("lima", 1) and top[1, 3] == ("ottawa", 1) and (0, 1) not in top
    steps = {r["gate"]: r["mentions"] for r in G.gates(m).collect()}
    assert steps["mention"] == 7 and steps["passage"] == 4


def test_candidates(spark, names):
    got = [tuple(r) for r in G.candidates(names).where("norm = 'cairo'").orderBy("place").select("place", "poprank", "spellings").collect()]
    assert got == [(0, 14, 2), (1, 5, 1)]
    seen = G.first_sightings(names.union(names.withColumn("lat", F.col("lat") + 0.1).withColumn("id", F.col("id") + 100)), [F.asc("minzoom"), F.asc("id")])
    assert seen.count() == len(NAMES)
    label = {r["id"]: (r["label"], r["own_name"]) for r in G.labels(names.where("id in (2, 4, 5, 12)").select("id", "name", "lat", "lon"), names, "id").collect()}
    assert label == {2: ("Cairo (القاهرة)", True), 4: ("Tromsø", True), 5: ("Tromsø", True), 12: ("Lima", True)}


def test_near_points(spark):
    at = [(i, lat, lon) for i, (lat, lon) in enumerate([(0.0, 179.99), (0.0, -179.99), (89.99, 10.0), (89.99, -170.0), (60.0, 20.0), (60.0, 20.4), (-45.0, 0.0), (-45.2, 0.1), (52.0, 179.9), (52.05, -179.95)])]
    points = spark.createDataFrame(at, "id int, lat double, lon double")
    other = points.withColumnRenamed("id", "other")
    for km in (5.0, 30.0, 700.0):
        got = {(r["id"], r["other"]): r["km"] for r in G.near_points(points, other, km).collect()}
        every = points.crossJoin(other.withColumnsRenamed({"lat": "a", "lon": "b"})).select("id", "other", G.haversine_km(F.col("lat"), F.col("lon"), F.col("a"), F.col("b")).alias("km")).where(F.col("km") <= km)
        assert got.keys() == {(r["id"], r["other"]) for r in every.collect()} and len(got) > 10
        assert G.near_points(points, other, km).count() == len(got)


def test_classify(spark, names):
    asked = spark.createDataFrame([(0, "How far is Cairo from Lima", "how far"), (1, "I live in Suva, and moved from Apia", None), (2, "what is the climate there", "climate"), (3, "Turkey Stock", None)], "id int, text string, cue string")
    got = {r["id"]: r for r in G.classify(asked, G.mentions(asked, names), G.candidates(names)).collect()}
    assert [got[i]["intent"] for i in range(4)] == ["spatial", "place", "cue_without_place", None]
    assert 12000 < got[0]["distance_km"] < 12900 and 1000 < got[1]["distance_km"] < 1200 and got[3]["distance_km"] is None
