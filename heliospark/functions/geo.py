"""Geometry on columns. A ring is an array of structs (x, y); a polygon is an array of rings, read by the even-odd rule."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from heliospark.constants import BLOCK, CROWN_FROM_CELL, EARTH, METRES_PER_DEGREE

POINT = "struct<x:double,y:double>"
RING, RINGS = f"array<{POINT}>", f"array<array<{POINT}>>"


def let(value: Column, body) -> Column:
    """body(value), value computed once."""
    return F.transform(F.array(value), body)[0]


def hypot(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


# On the sphere


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(b) * F.sin(b)
    return 2 * F.lit(EARTH) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, at_lat: Column) -> Column:
    """Local equirectangular metres; degrees of longitude are narrowed at at_lat."""
    return hypot((lat1 - lat2) * METRES_PER_DEGREE, (lon1 - lon2) * METRES_PER_DEGREE * F.cos(F.radians(at_lat)))


def quadkey(lat: Column, lon: Column, zoom: int) -> Column:
    """Web-mercator tile name."""
    n = 2**zoom
    clip = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), F.lit(n - 1)).cast("long")
    tx = clip((lon + 180) / 360 * n)
    ty = clip((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    bit = lambda v, i: F.call_function("shiftright", v, i).bitwiseAND(F.lit(1).cast("long"))
    digits = F.transform(F.sequence(F.lit(zoom - 1), F.lit(0), F.lit(-1)), lambda i: (bit(tx, i) + 2 * bit(ty, i)).cast("string"))
    return F.array_join(digits, "")


def tiles_over(south: float, west: float, north: float, east: float, zoom: int) -> Column:
    """Sorted names of the tiles that a box's corners, edge middles and centre lie in."""
    mid = lambda a, b: (a, (a + b) / 2, b)
    return F.array_sort(F.array_distinct(F.array(*[quadkey(F.lit(a), F.lit(o), zoom) for a in mid(south, north) for o in mid(west, east)])))


# Transverse Mercator by Krüger's series, fourth order in the third flattening of WGS 84

_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = 6_378_137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K, _E0 = 0.9996, 500_000.0
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280]
_BETA = [_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280]
_DELTA = [2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630]


def _sum(terms):
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def to_utm(lat: Column, lon: Column, zone: int = 42) -> Column:
    """struct(x, y), northern hemisphere."""
    s, c = F.sin(F.radians(lat)), 2 * math.sqrt(_N) / (1 + _N)
    dl = F.radians(lon - (6 * zone - 183))
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    x = _E0 + _K * _A * (eta + _sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)))
    y = _K * _A * (xi + _sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)))
    return F.struct(x.alias("x"), y.alias("y"))


def from_utm(x: Column, y: Column, zone: int = 42) -> Column:
    """struct(lat, lon)."""
    xi, eta = y / (_K * _A), (x - _E0) / (_K * _A)
    u = xi - _sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    v = eta - _sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi + _sum(d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(F.atan2(F.sinh(v), F.cos(u))) + (6 * zone - 183)).alias("lon"))


# Rings and lines


def ring_edges(ring: Column) -> Column:
    """Array of structs (a, b): a ring's edges, the closing one too; edges without length are left out."""
    closed = let(ring, lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1))))
    edges = let(closed, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1))), lambda i: F.struct(F.element_at(r, i).alias("a"), F.get(r, i).alias("b"))))
    return F.filter(edges, lambda e: e["a"] != e["b"])


def rings_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, ring_edges))


def _fold(edges: Column, start, step) -> Column:
    return F.aggregate(edges, start, step)


def ring_area(ring: Column) -> Column:
    """Without sign. Measured from the first corner, so that large coordinates lose no digits."""
    o = F.element_at(ring, 1)
    cross = lambda e: (e["a"]["x"] - o["x"]) * (e["b"]["y"] - o["y"]) - (e["b"]["x"] - o["x"]) * (e["a"]["y"] - o["y"])
    return F.abs(_fold(ring_edges(ring), F.lit(0.0), lambda acc, e: acc + cross(e))) / 2


def polygon_area(rings: Column) -> Column:
    """The outer ring less its holes."""
    return ring_area(F.element_at(rings, 1)) - F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings), F.lit(1))), F.lit(0.0), lambda acc, r: acc + ring_area(r))


def ring_centroid(ring: Column) -> Column:
    """Area centroid of an outer ring; of a flat one, the mean of its corners."""
    return let(ring, _centroid)


def _centroid(ring: Column) -> Column:
    o = F.element_at(ring, 1)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc, e):
        ax, ay, bx, by = e["a"]["x"] - o["x"], e["a"]["y"] - o["y"], e["b"]["x"] - o["x"], e["b"]["y"] - o["y"]
        c = ax * by - bx * ay
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (ax + bx) * c).alias("x"), (acc["y"] + (ay + by) * c).alias("y"))

    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(ring)
    return let(
        _fold(ring_edges(ring), zero, step),
        lambda s: F.struct(
            F.when(s["a"] != 0, o["x"] + s["x"] / (3 * s["a"])).otherwise(mean("x")).alias("x"), F.when(s["a"] != 0, o["y"] + s["y"] / (3 * s["a"])).otherwise(mean("y")).alias("y")
        ),
    )


def point_inside(rings: Column) -> Column:
    """A point in a polygon, which the centroid of a bent one is not: the middle of the widest stretch inside on a level halfway between the corners around mid-height. Null for a polygon without height. The rings, their heights and the level are made once, however the rings are given."""

    def of(rings):
        def widest(y):
            met = F.filter(F.flatten(F.transform(rings, ring_edges)), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
            xs = F.array_sort(F.transform(met, lambda e: e["a"]["x"] + (y - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
            spans = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 2, F.lit(2)), lambda i: F.struct((F.get(v, i + 1) - F.get(v, i)).alias("wide"), ((F.get(v, i) + F.get(v, i + 1)) / 2).alias("x")))
            return F.struct(let(xs, lambda v: F.array_max(spans(v))["x"]).alias("x"), y.alias("y"))

        def among(ys):
            level = lambda half: (F.array_max(F.filter(ys, lambda v: v <= half)) + F.array_min(F.filter(ys, lambda v: v > half))) / 2
            return F.when(F.array_max(ys) > F.array_min(ys), let(let((F.array_min(ys) + F.array_max(ys)) / 2, level), widest))

        return let(F.array_sort(F.array_distinct(F.transform(F.flatten(rings), lambda p: p["y"]))), among)

    return let(rings, of)


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule for one ring: a ray to the east crosses an odd number of edges."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["a"]["x"] - e["b"]["x"]) * (y - e["b"]["y"]) / F.nullif(e["a"]["y"] - e["b"]["y"], F.lit(0.0)) + e["b"]["x"])
    return F.aggregate(ring_edges(ring), F.lit(False), lambda acc, e: F.when(crosses(e), ~acc).otherwise(acc))


def in_rings(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd over all rings, so holes and several parts need no special case."""
    return F.aggregate(rings, F.lit(False), lambda acc, r: acc != in_ring(r, x, y))


def footprint_at(polygons: Column, x: Column, y: Column) -> Column:
    """The first polygon whose outer ring holds the point, else null."""
    return F.get(F.filter(polygons, lambda p: in_ring(F.element_at(p, 1), x, y)), 0)


def distance_to_segment(x: Column, y: Column, e: Column) -> Column:
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    t = ((x - e["a"]["x"]) * dx + (y - e["a"]["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return hypot(x - e["a"]["x"] - t * dx, y - e["a"]["y"] - t * dy)


def distance_to_polygon(rings: Column, x: Column, y: Column) -> Column:
    """0 inside, else to the nearest edge."""
    return F.when(in_rings(rings, x, y), F.lit(0.0)).otherwise(F.array_min(F.transform(rings_edges(rings), lambda e: distance_to_segment(x, y, e))))


def within(rings: Column, x: Column, y: Column, radius: float) -> Column:
    """Whether a polygon comes as near to a point as the radius; its nearest edge counts, not its centre."""
    return distance_to_polygon(rings, x, y) <= radius


def line_within(coords: Column, x: Column, y: Column, radius: float) -> Column:
    """The same of a line, or of a point (a line of one)."""
    only = F.element_at(coords, 1)
    far = F.when(F.size(coords) == 1, hypot(only["x"] - x, only["y"] - y)).otherwise(F.array_min(F.transform(segments(coords), lambda e: distance_to_segment(x, y, e))))
    return far <= radius


def segments(coords: Column) -> Column:
    """Array of structs (a, b) of a line."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(coords) - 1, F.lit(1))), lambda i: F.struct(F.element_at(coords, i).alias("a"), F.get(coords, i).alias("b")))


def line_length(coords: Column) -> Column:
    return F.aggregate(segments(coords), F.lit(0.0), lambda acc, e: acc + F.coalesce(hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]), F.lit(0.0)))


def line_at(coords: Column, share: float) -> Column:
    """The point at a share of a line's length."""
    zero = F.struct((line_length(coords) * share).alias("left"), F.lit(None).cast(POINT).alias("p"))

    def step(acc, e):
        size = hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"])
        t = acc["left"] / F.nullif(size, F.lit(0.0))
        p = F.struct((e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"])).alias("x"), (e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])).alias("y"))
        return F.struct((acc["left"] - size).alias("left"), F.when(acc["p"].isNull() & (acc["left"] <= size), p).otherwise(acc["p"]).alias("p"))

    return F.coalesce(F.aggregate(segments(coords), zero, step)["p"], F.element_at(coords, -1))


def merge_lines(lines: Column) -> Column:
    """Lines of a walk, in order, as one: a corner that two share stands once."""
    return F.aggregate(lines, F.array().cast(RING), lambda acc, l: F.concat(acc, F.when((F.size(acc) > 0) & (F.element_at(acc, -1) == F.element_at(l, 1)), F.slice(l, 2, F.greatest(F.size(l), F.lit(1)))).otherwise(l)))


def block(x: Column, y: Column, size: float = BLOCK) -> Column:
    """Name of the square of a spatial cross-validation."""
    return F.concat_ws("_", F.floor(x / size).cast("string"), F.floor(y / size).cast("string"))


def crown(x: Column, y: Column, radius: float = CROWN_FROM_CELL, corners: int = 16) -> Column:
    """A round crown as a ring of corners; with the radius for a lattice cell its area is the cell's."""
    at = [2 * math.pi * i / corners for i in range(corners)]
    return F.array(*[F.struct((x + radius * math.cos(a)).alias("x"), (y + radius * math.sin(a)).alias("y")) for a in [*at, at[0]]])
