"""Places: tiles, distances, cues of a question, climate sequences."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import folded
from .gazetteer import near_points

# Phrases (folded) that ask for a place, in the order in which they are tried.
CUES = [
    "terrain", "elevation", "region", "location", "how far", "altitude", "climate", "latitude", "longitude", "hemisphere", "in my area", "coordinates",
    "map of", "sea level", "which country", "what country", "how high", "nearest", "which side", "how cold", "growing season", "hardiness zone",
    "rainfall", "kilometres", "whereabouts", "clima", "terreno", "altitud", "elevacion", "ubicacion", "latitud", "longitud", "hemisferio", "coordenadas",
    "mapa de", "nivel del mar", "que pais", "cual pais", "que tan lejos", "a que distancia", "que tan alto", "que altura", "que tan frio", "kilometros",
    "mas cercano", "mas cercana", "que lado", "temporada de siembra", "temporada de cultivo", "zona de rusticidad", "lluvias", "en mi zona",
]
# The shapes of where-is questions, over folded text.
WHERE_IS = r"^where(?:\s*abouts)?\s*(?:\w+\s+){0,3}(?:is|are|was|were)\b"
DONDE = r"^(?:a\s+)?donde\s*(?:\w+\s+){0,3}(?:queda|quedan|esta|estan|se encuentra|se encuentran)\b"



def cue(question: Column) -> Column:
    """The first cue of a question, or null."""
    t = folded(question)
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    first = F.get(F.filter(F.array(*map(F.lit, CUES)), lambda c: padded.contains(F.concat(F.lit(" "), c, F.lit(" ")))), F.lit(0))
    return F.coalesce(first, F.when(t.rlike(WHERE_IS), "where is").when(t.rlike(DONDE), "donde queda"))


def tile_point(z: Column, x: Column, y: Column, px: Column, py: Column, extent: float = 4096.0) -> tuple[Column, Column]:
    """Longitude and latitude of a tile's pixel (inverse Mercator)."""
    n = F.pow(F.lit(2.0), z)
    return (x + px / extent) / n * 360.0 - 180.0, F.degrees(F.atan(F.sinh(F.lit(pi) * (1 - 2 * (y + py / extent) / n))))


def within(points: DataFrame, named: DataFrame, km: float) -> DataFrame:
    """Each point (lat, lon) with the named rows within km, and their distance, by cells of both coordinates."""
    return near_points(points, named, km)


def nearest_names(points: DataFrame, named: DataFrame, km: float, key: str, id_: str) -> DataFrame:
    """key, norm, id_, km: the nearest row (id_, norm, lat, lon) of each norm within km of each point (key, lat, lon), ties to 6 decimals by id_.

    Points of one position have the same neighbours, and of the rows of one norm at one position the first by id_ stands for all: so
    positions meet, not rows, and what is joined behind that is a row for each point and norm.
    """
    spots = points.where("lat is not null and lon is not null").select("lat", "lon").distinct()
    first = named.where("lat is not null and lon is not null").groupBy("norm", "lat", "lon").agg(F.min(id_).alias(id_))
    best = within(spots, first, km).groupBy("lat", "lon", "norm").agg(F.min_by(id_, F.struct(F.round("km", 6), id_)).alias(id_), F.min("km").alias("km"))
    # a key that stands at several positions takes the nearest of them all
    every = points.select(key, "lat", "lon").distinct().join(best, ["lat", "lon"])
    return every.groupBy(key, "norm").agg(F.min_by(id_, F.struct(F.round("km", 6), id_)).alias(id_), F.min("km").alias("km"))


def in_box(lat: Column, lon: Column, at_lat: float, at_lon: float, dlat: float, dlon: float) -> Column:
    """Whether a point is within so many degrees of another one; longitudes wrap."""
    return lat.between(at_lat - dlat, at_lat + dlat) & (F.abs(F.pmod(lon - at_lon + 180.0, F.lit(360.0)) - 180.0) <= dlon)


def climate_change(seq: Column) -> Column:
    """moved if the ends differ, returned if only what lies between does, else stable."""
    return F.when(F.element_at(seq, 1) != F.element_at(seq, -1), "moved").when(F.size(F.array_distinct(seq)) > 1, "returned").otherwise("stable")
