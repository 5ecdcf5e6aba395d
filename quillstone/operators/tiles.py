"""Vector tiles: names at points of a layer, and the walk from the world down to the tiles that hold any."""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .places import tile_point


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message; fixed widths come as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
            yield tag >> 3, value
            continue
        size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else _varint(data, at)
        if kind not in (1, 2, 5) or at + size > len(data):
            raise ValueError("a message is broken off")
        yield tag >> 3, data[at : at + size]
        at += size


def numbers(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = _varint(data, at)
        out.append(n)
    return out


def signed(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def attribute(data: bytes) -> str | float | int | bool | None:
    for number, value in fields(data):
        if number == 1:
            return value.decode()
        if number in (2, 3):
            return struct.unpack("<f" if number == 2 else "<d", value)[0]
        return signed(value) if number == 6 else bool(value) if number == 7 else value
    return None


def points(data: bytes, layer: str) -> list[tuple[dict, int, int, int]]:
    """Attributes, x, y and the extent of each point of a layer of a tile, compressed or not."""
    out: list[tuple[dict, int, int, int]] = []
    for number, body in fields(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
        if number != 3:
            continue
        parts: dict[int, list] = {}
        for n, value in fields(body):
            parts.setdefault(n, []).append(value)
        if parts.get(1, [b""])[0].decode() != layer:
            continue
        keys, values, extent = [k.decode() for k in parts.get(3, [])], [attribute(v) for v in parts.get(4, [])], parts.get(5, [4096])[0]
        for feature in parts.get(2, []):
            f = dict(fields(feature))
            if f.get(3) != 1:
                continue
            tags, shape = numbers(f.get(2, b"")), numbers(f.get(4, b""))
            x = y = 0
            for k in range(shape[0] >> 3 if shape and shape[0] & 7 == 1 else 0):
                x, y = x + signed(shape[1 + 2 * k]), y + signed(shape[2 + 2 * k])
                out.append(({keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}, x, y, extent))
    return out


def places_in(tiles: DataFrame, layer: str = "places") -> DataFrame:
    """z, x, y, nth, name, kind, poprank, lon, lat of the named points of tiles (z, x, y, data); a null tile has none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
        names = ["z", "x", "y", "nth", "name", "kind", "poprank", "px", "py"]
        for b in batches:
            out = []
            for z, x, y, data in zip(*(b.column(c).to_pylist() for c in ("z", "x", "y", "data")), strict=True):
                for nth, (a, px, py, extent) in enumerate(points(data, layer) if data else []):
                    if a.get("name"):
                        rank = a.get("population_rank")
                        out.append((z, x, y, nth, str(a["name"]), a.get("kind"), None if rank is None else int(rank), px * 4096 / extent, py * 4096 / extent))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    got = tiles.select(F.col("z").cast("int"), F.col("x").cast("long"), F.col("y").cast("long"), "data").mapInArrow(rows, "z int, x long, y long, nth int, name string, kind string, poprank int, px double, py double")
    lon, lat = tile_point(*(F.col(c) for c in ("z", "x", "y", "px", "py")))
    return got.select("z", "x", "y", "nth", "name", "kind", "poprank", (F.pmod(lon + 180.0, F.lit(360.0)) - 180.0).alias("lon"), lat.alias("lat"))


def walk(there: DataFrame, deepest: int, done: DataFrame | None = None) -> DataFrame:
    """z, x, y of the tiles that a walk meets: those under a tile that isn't empty (there: z, x, y, n), without those that are done.

    A level is one join of the children with the tiles that are there, and there are as many levels as zooms.
    """
    full = there.where("n > 0").select("z", "x", "y")
    level = full.where("z = 0")
    every = level
    for _ in range(deepest):
        four = F.explode(F.array(*(F.struct((2 * F.col("x") + i).alias("x"), (2 * F.col("y") + j).alias("y")) for i in (0, 1) for j in (0, 1))))
        level = level.select((F.col("z") + 1).alias("z"), four.alias("c")).select("z", "c.x", "c.y").join(full, ["z", "x", "y"], "left_semi")
        every = every.unionByName(level)
    return every if done is None else every.join(done.select("z", "x", "y"), ["z", "x", "y"], "left_anti")


def nearest_cell(points_: DataFrame, grid: DataFrame, step: float) -> DataFrame:
    """The points (lat, lon) with the value of the grid's cell (row, column from the north-west corner) that they lie in."""
    row = F.least(F.floor((90.0 - F.col("lat")) / step), F.lit(180.0 / step - 1)).cast("long")
    column = F.pmod(F.floor((F.col("lon") + 180.0) / step), F.lit(360.0 / step)).cast("long")
    return points_.withColumns({"row": row, "column": column}).join(grid, ["row", "column"], "left")
