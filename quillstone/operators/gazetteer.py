"""A table of place names, and the places that texts name.

Names: norm, name, lang ("" for a place's own), kind, poprank (or null), lat, lon, minzoom, and an id. Texts are cut
into runs of one to three words, which meet the names by an equi join on their norm; what overlaps is settled in
each text by a fold over its few hits. No side is sent whole to the tasks; Spark broadcasts one if it is small.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.figures import located
from ..functions.text import haversine_km

#: Raised when the rule of norms changes; a stored table with another number has to be built again.
NORM_VERSION = 2
# Letters that don't come apart into a letter and a mark.
TRANSLIT = {"ø": "o", "œ": "oe", "æ": "ae", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "ŧ": "t", "ħ": "h", "ŀ": "l", "ĸ": "k", "ʼ": "", "'": "", "’": ""}
# Words that are towns somewhere and mean none.
FUNCTION_WORDS = """
a an the and or but if then than so as at by for from in into of off on onto out over to up with within without is are was were be been being am do does did done
have has had having can could may might must shall should will would this that these those it its i we you he she they them us my your our their his her no not
none all any both each few many more most much several some such only own same very just also back next last here there when where which who whom whose what
how why does isnt dont
""".split()
# The same in Spanish, and some in French; for passages alone.
FUNCTION_WORDS_ES = """
a al ante bajo cabe con contra de del desde durante en entre hacia hasta mediante para por segun sin so sobre tras via el la los las un una unos unas
lo y e o u ni que quien quienes cual cuales cuyo cuya como cuando donde porque aunque pero sino si no ya solo tambien tampoco muy mas menos todo
toda todos todas otro otra otros otras cada mismo misma este esta estos estas ese esa esos esas aquel aquella su sus mi mis tu tus nuestro nuestra
es son era eran ser estar esta estan fue fueron hay haber le les leur leurs dans pour avec sans sous chez du des
""".split()
# Words that point at a place, and those that anchor it.
LOCATIVE = ["in", "near", "at", "from", "around", "outside", "of", "for", "across", "beyond", "between"]
ANCHORS = ["in", "near", "at", "from", "around", "outside"]
# Names that are mostly written in lower case, and so mostly no places.
AMBIGUOUS = ["nice", "split", "mobile", "colon", "springs", "cita", "turkey", "lima", "guinea", "island"]
#: Least population rank of a place in a passage.
RANK = 10
# Kilometres within which rows of one kind are the same place.
SAME_KM = {"region": 120.0, "country": 400.0}
OTHER_KM = 25.0
WORD = "[0-9A-Za-zÀ-ɏ']+"


def normalise(s: str) -> str:
    """The key of a name: no marks, folded case, plain letters, single spaces."""
    plain = "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn").casefold()
    return " ".join("".join(TRANSLIT.get(c, c) for c in plain).split())


#: Every letter of the Latin blocks with the key that it gets, for norms in column expressions.
_LATIN = {chr(c): normalise(chr(c)) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]}
_ONE = {a: b for a, b in _LATIN.items() if len(b) == 1 and a != b}
_MORE = {a: b for a, b in {**_LATIN, **TRANSLIT}.items() if len(b) != 1}


def norm(name: Column) -> Column:
    """normalise as a column expression, for names in Latin letters; those of other scripts are only put in lower case."""
    t = F.translate(F.lower(name), "".join(_ONE), "".join(_ONE.values()))
    for a, b in _MORE.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\p{Mn}", ""), r"(?U)\s+", " "))


def norms(names: DataFrame, column: str = "name") -> DataFrame:
    """The rows with norm and norm_version; names of any script."""

    @F.pandas_udf("string")
    def keyed(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else normalise(x))

    return names.withColumn("norm", keyed(column)).withColumn("norm_version", F.lit(NORM_VERSION))


def place_ranks(names: DataFrame) -> DataFrame:
    """norm and the highest rank of a place of that name, 0 where none has one."""
    return names.groupBy("norm").agg(F.max(F.coalesce("poprank", F.lit(0))).alias("rank"))


def text_words(text: Column) -> Column:
    """array<struct<at, w, low, first, clause, comma>>: words, whether their capital is free, and what stands before them.

    clause: the word starts a clause; before: what stands between it and the word before.
    """
    found = located(F.coalesce(text, F.lit("")), WORD)

    def word(s: Column, x: Column, i: Column) -> Column:
        end = F.when(i == 0, F.lit(0)).otherwise(F.get(s["w"], i - 1)["at"] + F.length(F.get(s["w"], i - 1)["term"]))
        gap = F.substring(s["t"], end + 1, x["at"] - end)
        low = F.lower(x["term"])
        return F.struct(x["at"].alias("at"), x["term"].alias("w"), low.alias("low"), ((i == 0) | gap.rlike("[.?!:;]")).alias("clause"), gap.alias("gap"))

    s = F.struct(F.coalesce(text, F.lit("")).alias("t"), found.alias("w"))
    return F.get(F.transform(F.array(s), lambda s: F.transform(s["w"], lambda x, i: word(s, x, i))), F.lit(0))


def capital(w: Column) -> Column:
    first = F.substring(w, 1, 1)
    return (first == F.upper(first)) & (first != F.lower(first))


def is_title_case(words: Column, least: int = 4, share: float = 0.6) -> Column:
    """Whether most of the longer words have a capital, so that capitals say nothing."""
    long = F.filter(words, lambda x: F.length(x["w"]) > 2)
    return (F.size(long) >= least) & (F.size(F.filter(long, lambda x: capital(x["w"]))) > share * F.size(long))


def mentions(texts: DataFrame, names: DataFrame, key: str = "id", text: str = "text", most: int = 3, least: int = 3) -> DataFrame:
    """key, at_word, text, norm, rank and what is around it, for every place that a text names; the longest name from each word on.

    A name needs a capital that isn't free, unless the whole text is in title case or it starts a clause; in title case a locative
    word must stand before it. Function words, acronyms of four letters and names of fewer than three letters are none.
    """
    rows = texts.select(F.col(key).alias("key_"), F.col(text).alias("t_"), text_words(F.col(text)).alias("w"))
    rows = rows.withColumn("titled", is_title_case(F.col("w")))
    x, before = (lambda i: F.get("w", i)), (lambda i: F.get("w", i - 1))

    def starts(i: Column) -> Column:
        free = x(i)["clause"] | F.col("titled")
        acronym = (x(i)["w"] == F.upper(x(i)["w"])) & (x(i)["w"] != F.lower(x(i)["w"])) & (F.length(x(i)["w"]) >= 4)
        pointed = ~F.col("titled") | ((i > 0) & before(i)["low"].isin(LOCATIVE))
        return (free | capital(x(i)["w"])) & ~x(i)["low"].isin(FUNCTION_WORDS) & ~acronym & pointed

    def runs(i: Column, k: int) -> Column:
        part = F.slice("w", i + 1, k)
        proper = F.forall(part, lambda p: capital(p["w"]) | p["low"].isin(FUNCTION_WORDS))
        return F.when(starts(i) & (i + k <= F.size("w")) & proper, F.struct(i.alias("i"), F.lit(k).alias("k"), F.array_join(F.transform(part, lambda p: p["low"]), " ").alias("run"), F.array_join(F.transform(part, lambda p: p["w"]), " ").alias("text")))

    places = F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1)).otherwise(F.array().cast("array<int>"))
    every = F.flatten(F.transform(places, lambda i: F.array(*(runs(i, k) for k in range(1, most + 1)))))
    asked = rows.select("key_", F.explode(F.filter(every, lambda r: r.isNotNull())).alias("r")).select("key_", "r.*").withColumn("norm", norm(F.col("run"))).where(F.length("norm") >= least)
    ranks = place_ranks(names)
    hits = asked.join(ranks, "norm").groupBy("key_").agg(F.array_sort(F.collect_list(F.struct("i", (-F.col("k")).alias("minus"), "k", "norm", "text", "rank"))).alias("h"))
    # from left to right, the longest first: a hit counts if it begins where no earlier one still goes on
    begin = F.struct(F.lit(0).alias("free"), F.filter("h", lambda h: F.lit(False)).alias("kept"))
    walk = F.aggregate("h", begin, lambda a, h: F.when(h["i"] >= a["free"], F.struct((h["i"] + h["k"]).alias("free"), F.concat(a["kept"], F.array(h)).alias("kept"))).otherwise(a), lambda a: a["kept"])
    kept = hits.select("key_", F.explode(walk).alias("h")).join(rows, "key_")
    i, k = F.col("h.i"), F.col("h.k")
    after, ahead = F.get("w", i + k), F.get("w", i - 1)
    end = F.get("w", i + k - 1)
    rest = F.substring(F.col("t_"), end["at"] + F.length(end["w"]) + 1, F.length("t_"))
    out = kept.select(
        F.col("key_").alias(key), i.alias("at_word"), F.col("h.text").alias("text"), F.col("h.norm").alias("norm"), F.col("h.rank").alias("rank"), F.get("w", i)["clause"].alias("clause"),
        F.coalesce(ahead["low"], F.lit("")).alias("prev"), F.coalesce(capital(ahead["w"]), F.lit(False)).alias("prev_capital"), F.coalesce(after["w"], F.lit("")).alias("next"),
        F.rtrim(F.substring("t_", F.lit(1), F.get("w", i)["at"])).rlike("[,-]$").alias("comma_before"), F.ltrim(rest).startswith(",").alias("comma_after"),
    )
    # whether the words beside it are places: two lookups of single words
    for side in ("prev", "next"):
        one = ranks.select(F.col("norm").alias(f"norm_{side}"), F.lit(True).alias(f"{side}_is_place"))
        out = out.withColumn(f"norm_{side}", norm(F.col(side))).join(one, f"norm_{side}", "left").withColumn(f"{side}_is_place", F.coalesce(f"{side}_is_place", F.lit(False)) & (F.col(side) != "")).drop(f"norm_{side}")
    return out


def is_place_reference() -> Column:
    """Of a mention: anchored by a word or a comma, and not the beginning of a longer proper name."""
    anchored = F.col("prev").isin(ANCHORS) | F.col("comma_before") | F.col("comma_after")
    return anchored & ~(capital(F.col("next")) & ~F.col("next_is_place") & ~F.col("comma_after"))


def in_passage() -> Column:
    """Of a mention in running text: what a question's needs, and no free capital, acronym, low rank, ambiguous name or tail of a longer one."""
    acronym = (F.col("text") == F.upper("text")) & (F.length("text") >= 3)
    tail = F.col("prev_capital") & ~F.col("prev_is_place") & ~F.col("comma_before") & ~F.col("prev").isin(FUNCTION_WORDS + FUNCTION_WORDS_ES)
    return is_place_reference() & ~F.col("clause") & ~acronym & (F.col("rank") >= RANK) & F.when(F.lower("text").isin(AMBIGUOUS), F.col("comma_after") & F.col("next_is_place")).otherwise(~tail)


def same_km(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in SAME_KM.items()), F.lit(OTHER_KM))


def _greedy(rows: pd.DataFrame) -> np.ndarray:
    """Number of each row's place: that of the first place within its own distance, else a new one."""
    lat, lon, near = (rows[c].to_numpy(float) for c in ("lat", "lon", "near"))
    first: list[int] = []
    out = np.empty(len(rows), np.int64)
    for i in range(len(rows)):
        at = np.array(first, int)
        dlon = np.radians((lon[at] - lon[i] + 180.0) % 360.0 - 180.0)
        h = np.sin(np.radians(lat[at] - lat[i]) / 2) ** 2 + np.cos(np.radians(lat[i])) * np.cos(np.radians(lat[at])) * np.sin(dlon / 2) ** 2
        hit = np.flatnonzero(2 * 6371.0 * np.arcsin(np.minimum(1.0, np.sqrt(h))) < near[i])
        out[i] = hit[0] if len(hit) else len(first)
        if not len(hit):
            first.append(i)
    return out


def clusters(names: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The rows with place: a number within each group of by; a row belongs to the first earlier place within its kind's distance.

    The rule depends on the order, so each group is walked in one task. Groups are rows of one name, which the number
    of places that share it bounds.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    rows = names.withColumn("near", same_km(F.col("kind"))).withColumn("nth", F.row_number().over(w))
    columns = [*rows.columns, "place"]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("nth")
        return group.assign(place=_greedy(group))[columns]

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(*by).applyInPandas(walk, f"{kinds}, place long").drop("near", "nth")


def candidates(names: DataFrame, limit: int = 12) -> DataFrame:
    """norm, place, name, kind, poprank, lat, lon, spellings: distinct places of each name, the most populous first, limit at most."""
    placed = clusters(names, ["norm"], [F.desc_nulls_last("poprank"), F.asc("minzoom"), F.asc("id")])
    w = Window.partitionBy("norm", "place").orderBy(F.desc_nulls_last("poprank"), F.asc("minzoom"), F.asc("id"))
    best = placed.withColumn("k", F.row_number().over(w)).where("k = 1")
    n = placed.groupBy("norm", "place").agg(F.count(F.lit(1)).alias("spellings"))
    return best.join(n, ["norm", "place"]).where(F.col("place") < limit).select("norm", "place", "id", "name", "kind", "poprank", "lat", "lon", "spellings")


def first_sightings(names: DataFrame, order: list[Column]) -> DataFrame:
    """One row for each place of a norm and language: later sightings within its kind's distance are the same."""
    placed = clusters(names, ["norm", "lang"], order)
    w = Window.partitionBy("norm", "lang", "place").orderBy(*order)
    return placed.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "place")


def near_points(points: DataFrame, names: DataFrame, km: float) -> DataFrame:
    """Each point (lat, lon) with the names within km and their distance: an equi join on cells of both coordinates.

    Cells are as high as the distance, and as wide as it is at their row's edge nearer to the pole, so neighbours are one cell away;
    rows at a pole are one cell. Longitudes wrap. The other columns of both sides differ.
    """
    high = km / (6371.0 * pi / 180)
    row = lambda c: F.floor((c + 90.0) / high)
    edge = lambda r: F.least(F.lit(90.0), F.greatest(F.abs(r * high - 90.0), F.abs((r + 1) * high - 90.0)))
    count = lambda r: F.greatest(F.lit(1.0), F.floor(F.cos(F.radians(edge(r))) * 360.0 / high)).cast("long")  # noqa: E731  cells of a row
    cell = lambda lon, n: F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * n).cast("long")
    left = points.withColumn("row_", F.explode(F.array(*(row(F.col("lat")) + i for i in (-1, 0, 1)))))
    n = count(F.col("row_"))
    left = left.withColumn("cell_", F.explode(F.array_distinct(F.array(*(F.pmod(cell(F.col("lon"), n) + i, n) for i in (-1, 0, 1))))))
    right = names.withColumnsRenamed({"lat": "lat_", "lon": "lon_"}).withColumn("row_", row(F.col("lat_")))
    right = right.withColumn("cell_", F.pmod(cell(F.col("lon_"), count(F.col("row_"))), count(F.col("row_"))))
    far = haversine_km(F.col("lat"), F.col("lon"), F.col("lat_"), F.col("lon_"))
    return left.join(right, ["row_", "cell_"]).withColumn("km", far).where(F.col("km") <= km).drop("row_", "cell_")


def labels(points: DataFrame, names: DataFrame, key: str, km: float = 5.0) -> DataFrame:
    """key and label: the nearest English name, else the place's own, else the point's name; the own one in brackets if it differs."""
    own = names.where(F.col("lang").isin("", "en", "es")).select(F.col("name").alias("name_"), F.col("lang").alias("lang_"), "lat", "lon")
    at = near_points(points.select(key, "name", "lat", "lon"), own, km).groupBy(key).agg(
        F.min_by("name_", F.when(F.col("lang_") == "en", F.struct("km", "name_"))).alias("en"), F.min_by("name_", F.when(F.col("lang_") == "", F.struct("km", "name_"))).alias("local")
    )
    rows = points.join(at, key, "left")
    shown = F.coalesce("en", "local", "name")
    return rows.select(key, F.when(F.col("local").isNotNull() & (F.col("local") != shown), F.concat(shown, F.lit(" ("), "local", F.lit(")"))).otherwise(shown).alias("label"), (F.coalesce("en", "local").isNull() | (shown == F.col("en")) | (shown == F.col("local"))).alias("own_name"))


def classify(asked: DataFrame, found: DataFrame, places: DataFrame, key: str = "id") -> DataFrame:
    """key, intent, n_places, distance_km of questions (key, cue) by their mentions and the best candidate of each name.

    With a cue every mention counts, without one those that refer to a place. distance_km is that of the first two.
    """
    best = places.where("place = 0").select("norm", "lat", "lon")
    used = found.withColumn("sure", is_place_reference()).join(asked, key).where("sure or cue is not null").join(best, "norm")
    by = used.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at_word", "lat", "lon"))).alias("p"))
    rows = asked.join(by, key, "left")
    n = F.coalesce(F.size("p"), F.lit(0))
    n = F.when(F.col("p").isNull(), 0).otherwise(n)
    intent = F.when(F.col("cue").isNotNull() & (n > 0), "spatial").when(n > 0, "place").when(F.col("cue").isNotNull(), "cue_without_place")
    a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    return rows.select(key, "cue", intent.alias("intent"), n.alias("n_places"), F.when(n > 1, F.round(haversine_km(a["lat"], a["lon"], b["lat"], b["lon"]), 1)).alias("distance_km"))


def passage_places(found: DataFrame, places: DataFrame, key: str = "id", limit: int = 3) -> DataFrame:
    """key, norm, times, place_rank: the places of a passage, the most populous first, ties as they appear, limit at most."""
    one = found.where(in_passage()).groupBy(key, "norm").agg(F.count(F.lit(1)).alias("times"), F.min("at_word").alias("first"))
    one = one.join(places.where("place = 0").select("norm", F.col("id").alias("place_id"), F.coalesce("poprank", F.lit(0)).alias("poprank")), "norm")
    w = Window.partitionBy(key).orderBy(F.desc("poprank"), F.asc("first"))
    return one.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= limit).drop("first")


def gates(found: DataFrame) -> DataFrame:
    """How many mentions pass each gate of a passage, one after another, and the texts that still have one."""
    steps = [("mention", F.lit(True)), ("reference", is_place_reference()), ("not_free", ~F.col("clause")), ("no_acronym", ~((F.col("text") == F.upper("text")) & (F.length("text") >= 3))), ("ranked", F.col("rank") >= RANK), ("passage", in_passage())]
    passed, columns = F.lit(True), []
    for name, ok in steps:
        passed = passed & ok
        columns.append(passed.alias(name))
    flat = found.select("id", *columns)
    return flat.select(F.explode(F.array(*(F.when(F.col(n), F.struct(F.lit(i).alias("step"), F.lit(n).alias("gate"), F.col("id"))) for i, (n, _) in enumerate(steps)))).alias("g")).where("g is not null").groupBy("g.step", "g.gate").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("g.id").alias("texts"))


def words_at(texts: Iterator[str]) -> list[str]:
    """Norms of plain strings, for tests and small lists."""
    return [normalise(t) for t in texts]
