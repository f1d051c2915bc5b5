"""How much of each street lies in shadow, without polygon overlay.

A shadow is its footprint and the bands that the footprint's edges sweep, so a straight piece of street meets
it in intervals; the union of these intervals is the covered length."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospark.constants import CANOPY_OPACITY, CANOPY_SOURCES, MAX_SHADOW
from heliospark.functions import geo
from heliospark.functions.geo import let
from heliospark.functions.solar import shadow_vector
from heliospark.operators import overlay
from heliospark.operators.near import cells, grid_join
from heliospark.operators.rings import polygons
from heliospark.sources.files import lon_lat, simplified
from heliospark.sources.tables import dropped, stored

EPS = 1e-9
#: Parts of the first lot in its fullest cell, and the most lots.
FIRST, LOTS = 512, 12
SPAN = ["stamp", "edge_id", "piece", "soft", "t0", "t1"]
BAND = "struct<x:double,y:double,ex:double,ey:double,vx:double,vy:double,fx:double,fy:double,gx:double,gy:double>"


def shadow_parts(casters: DataFrame, stamps: DataFrame, leading: bool = True) -> DataFrame:
    """(stamp, soft, rings, band, r_x0, r_y0, r_x1, r_y1): bands (a corner, an edge and the sun's vector) and footprints (rings, of every stamp, so their stamp is null). casters(rings, height_m, height_source), stamps(stamp, altitude, azimuth).

    stamps has at most some dozens of rows, so it goes to every task. With leading, only edges that face the way the shadow falls have bands."""
    soft = F.col("height_source").isin(CANOPY_SOURCES)
    sided = casters.select(soft.alias("soft"), "height_m", (sided_edges(F.col("rings")) if leading else F.transform(geo.rings_edges(F.col("rings")), lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.lit(0.0).alias("side")))).alias("es"))
    at = sided.crossJoin(F.broadcast(stamps)).withColumn("v", shadow_vector(F.col("height_m"), F.col("altitude"), F.col("azimuth"))).where("v is not null")
    edges = at.select("stamp", "soft", "v", F.explode("es").alias("e"))
    a, b, v = F.col("e.a"), F.col("e.b"), F.col("v")
    ex, ey = b["x"] - a["x"], b["y"] - a["y"]
    turn = ex * v["dy"] - ey * v["dx"]
    # the shares of the edge and of the vector that lead from the corner to a point are sums of its offsets times these
    shares = [(v["dy"] / turn).alias("fx"), (-v["dx"] / turn).alias("fy"), (-ey / turn).alias("gx"), (ex / turn).alias("gy")]
    band = F.struct(a["x"].alias("x"), a["y"].alias("y"), ex.alias("ex"), ey.alias("ey"), v["dx"].alias("vx"), v["dy"].alias("vy"), *shares)
    low = lambda k, d: F.least(a[k], b[k]) + F.least(v[d], F.lit(0.0))
    high = lambda k, d: F.greatest(a[k], b[k]) + F.greatest(v[d], F.lit(0.0))
    faces = F.when(F.col("e.side") == 0, F.abs(turn)).otherwise(F.col("e.side") * turn) > EPS
    bands = edges.where(faces).select(
        "stamp", "soft", F.lit(None).cast(geo.RINGS).alias("rings"), band.alias("band"), low("x", "dx").alias("r_x0"), low("y", "dy").alias("r_y0"), high("x", "dx").alias("r_x1"), high("y", "dy").alias("r_y1")
    )
    day = stamps.where("altitude > 0").limit(1).select(F.lit(None).cast(stamps.schema["stamp"].dataType).alias("stamp"))
    feet = _boxed(casters.select(soft.alias("soft"), "rings").crossJoin(F.broadcast(day)))  # one row, or none at night
    return bands.unionByName(feet.withColumn("band", F.lit(None).cast(bands.schema["band"].dataType)))


def sided_edges(rings):
    """Array of structs (a, b, side): edges that face the way a shadow falls are those whose turn towards its vector has the sign of side.

    What they sweep and the footprint are the whole shadow: from any point of it, the way back to the footprint first meets such an edge. A
    ring inside an odd number of others is a hole, whose edges face inwards."""

    def of(ring):
        def side(edges):
            first = F.element_at(edges, 1)["a"]
            cross = lambda e: (e["a"]["x"] - first["x"]) * (e["b"]["y"] - first["y"]) - (e["b"]["x"] - first["x"]) * (e["a"]["y"] - first["y"])
            turns = F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + cross(e))
            p = F.element_at(edges, 1)
            x, y = (p["a"]["x"] + p["b"]["x"]) / 2, (p["a"]["y"] + p["b"]["y"]) / 2
            hole = F.when(F.size(rings) == 1, F.lit(False)).otherwise(F.aggregate(F.filter(rings, lambda r: r != ring), F.lit(False), lambda acc, r: acc != geo.in_ring(r, x, y)))
            return F.when((turns > 0) != hole, F.lit(-1.0)).otherwise(F.lit(1.0))

        return geo.let(geo.ring_edges(ring), lambda edges: geo.let(side(edges), lambda k: F.transform(edges, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), k.alias("side")))))

    return F.flatten(F.transform(rings, of))


def shadow_polygons(casters: DataFrame, stamps: DataFrame) -> DataFrame:
    """(stamp, kind, rings) for a map: each footprint and each band that its edges sweep, soft or solid; where they overlap a map draws the kind once. Night has none."""
    parts = shadow_parts(casters, stamps, leading=False)
    b = F.col("band")
    corner = lambda e, v: F.struct((b["x"] + (b["ex"] if e else 0) + (b["vx"] if v else 0)).alias("x"), (b["y"] + (b["ey"] if e else 0) + (b["vy"] if v else 0)).alias("y"))
    swept = F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))
    kind = F.when(F.col("soft"), "soft").otherwise("solid").alias("kind")
    days = F.broadcast(stamps.where("altitude > 0").select("stamp"))  # some dozens of stamps
    feet = parts.where("band is null").drop("stamp").crossJoin(days).select("stamp", kind, "rings")
    return parts.where("band is not null").select("stamp", kind, swept.alias("rings")).unionByName(feet)


def swept_parts(casters: DataFrame, stamps: DataFrame) -> DataFrame:
    """(stamp, soft, rings), whose union is the shadow: of a convex caster its shadow as one ring, of others the footprints and the bands of their leading edges."""
    at = casters.withColumn("__edges", F.when(F.size("rings") == 1, geo.ring_edges(F.col("rings")[0]))).withColumn("__turn", _convex_turn(F.col("__edges")))
    whole = at.where("__turn != 0").crossJoin(F.broadcast(stamps)).withColumn("v", shadow_vector(F.col("height_m"), F.col("altitude"), F.col("azimuth"))).where("v is not null")  # some dozens of stamps
    v = F.col("v")
    moved = lambda p: F.struct((p["x"] + v["dx"]).alias("x"), (p["y"] + v["dy"]).alias("y"))
    leads = lambda e: ((e["b"]["x"] - e["a"]["x"]) * v["dy"] - (e["b"]["y"] - e["a"]["y"]) * v["dx"]) * F.col("__turn") < -EPS
    ring = F.flatten(F.transform("__edges", lambda e: F.when(leads(e), F.array(moved(e["a"]), moved(e["b"]))).otherwise(F.array(e["a"], e["b"]))))
    hulls = whole.select("stamp", F.col("height_source").isin(CANOPY_SOURCES).alias("soft"), F.array(ring).alias("rings"))
    parts = shadow_parts(at.where("coalesce(__turn, 0) = 0").drop("__edges", "__turn"), stamps)
    b = F.col("band")
    corner = lambda e, v: F.struct((b["x"] + (b["ex"] if e else 0) + (b["vx"] if v else 0)).alias("x"), (b["y"] + (b["ey"] if e else 0) + (b["vy"] if v else 0)).alias("y"))
    swept = F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0)))
    days = F.broadcast(stamps.where("altitude > 0").select("stamp"))  # some dozens of stamps
    feet = parts.where("band is null").drop("stamp").crossJoin(days).select("stamp", "soft", "rings")
    return hulls.unionByName(parts.where("band is not null").select("stamp", "soft", swept.alias("rings"))).unionByName(feet)


def _convex_turn(edges):
    """1 if a ring of these edges is convex and runs against the clock, -1 if with it, else 0: all corners turn one way, and it rises and falls once."""
    n = F.size(edges)
    nexts = lambda a: F.concat(F.slice(a, 2, F.greatest(F.size(a), F.lit(1))), F.slice(a, 1, 1))
    turn = lambda e, f: (e["b"]["x"] - e["a"]["x"]) * (f["b"]["y"] - f["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (f["b"]["x"] - f["a"]["x"])
    turns = F.zip_with(edges, nexts(edges), turn)
    rises = F.filter(edges, lambda e: e["a"]["y"] != e["b"]["y"])
    changes = F.size(F.filter(F.zip_with(rises, nexts(rises), lambda e, f: (e["b"]["y"] > e["a"]["y"]) != (f["b"]["y"] > f["a"]["y"])), lambda x: x))
    once = (n > 2) & (changes == 2)
    return F.when(once & F.forall(turns, lambda t: t > 0), 1.0).when(once & F.forall(turns, lambda t: t < 0), -1.0).otherwise(0.0)


def shadow_layers(casters: DataFrame, stamps: DataFrame) -> DataFrame:
    """(stamp, kind, ring, area): rings of the dissolved solid shadow, and of the dappled one where no solid one lies. Night has none."""
    return overlay.layers(swept_parts(casters, stamps))


def shadow_blobs(casters: DataFrame, stamps: DataFrame) -> DataFrame:
    """(stamp, kind, rings): the separate patches of each layer, with their holes."""
    return polygons(shadow_layers(casters, stamps), ["stamp", "kind"])


def shadow_frame(blobs: DataFrame, stamps: DataFrame, date: str, offset: str = "+05:00") -> DataFrame:
    """(time, altitude_deg, azimuth_deg, kind, rings) of shadow_blobs for a map: simplified rings as arrays of [lon, lat], the time as ISO text of the city's fixed offset, angles to two digits."""
    ring = lambda r: F.transform(simplified(r), lon_lat)
    at = F.broadcast(stamps.select("stamp", F.round("altitude", 2).alias("altitude_deg"), F.round("azimuth", 2).alias("azimuth_deg")))  # some dozens of stamps
    time = F.concat(F.lit(f"{date}T"), "stamp", F.lit(f":00{offset}"))
    return blobs.join(at, "stamp").select(time.alias("time"), "altitude_deg", "azimuth_deg", "kind", F.transform("rings", ring).alias("rings"))


def near_streets(casters: DataFrame, edges: DataFrame, cell: float = 256.0) -> DataFrame:
    """The casters whose longest shadow may reach a street, by cells, before they are multiplied by stamps. What meets the streets' cells are ids and cells; the casters are a stored table."""
    pieces = street_pieces(edges)
    cells_of = lambda x0, y0, x1, y1: F.explode(cells(x0, y0, x1, y1, cell))
    used = pieces.select(cells_of(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("__cell")).distinct()
    boxed = stored(_boxed(casters.withColumn("__id", F.monotonically_increasing_id())))
    far = F.lit(MAX_SHADOW)
    spread = boxed.select("__id", cells_of(F.col("r_x0") - far, F.col("r_y0") - far, F.col("r_x1") + far, F.col("r_y1") + far).alias("__cell"))
    return boxed.join(spread.join(used, "__cell", "left_semi").select("__id").distinct(), "__id", "left_semi").select(casters.columns)


def _boxed(parts: DataFrame) -> DataFrame:
    xs, ys = F.transform(F.flatten("rings"), lambda p: p["x"]), F.transform(F.flatten("rings"), lambda p: p["y"])
    return parts.select("*", F.array_min(xs).alias("r_x0"), F.array_min(ys).alias("r_y0"), F.array_max(xs).alias("r_x1"), F.array_max(ys).alias("r_y1"))


def street_pieces(edges: DataFrame) -> DataFrame:
    """(edge_id, piece, a, b, size, x0, y0, x1, y1) of edges(edge_id, coords)."""
    s = edges.select("edge_id", F.posexplode(geo.segments(F.col("coords"))).alias("piece", "s")).select("edge_id", "piece", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    size = geo.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    return s.withColumn("size", size).select(
        "*", F.least("a.x", "b.x").alias("x0"), F.least("a.y", "b.y").alias("y0"), F.greatest("a.x", "b.x").alias("x1"), F.greatest("a.y", "b.y").alias("y1")
    )


def inside(rings, a, b):
    """Array of structs (t0, t1): where the piece a-b lies in the rings (even-odd; a boundary counts as inside). t runs from 0 to 1."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size2 = F.greatest(dx * dx + dy * dy, F.lit(EPS * EPS))

    def cuts(e):
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        wx, wy = e["a"]["x"] - a["x"], e["a"]["y"] - a["y"]
        turn = dx * ey - dy * ex
        t, u = (wx * ey - wy * ex) / F.nullif(turn, F.lit(0.0)), (wx * dy - wy * dx) / F.nullif(turn, F.lit(0.0))
        along = lambda p: ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / size2
        flat = (F.abs(turn) <= EPS) & (F.abs(wx * dy - wy * dx) <= EPS * F.sqrt(size2))
        return F.when(flat, F.array(along(e["a"]), along(e["b"]))).when(u.between(-EPS, 1 + EPS), F.array(t)).otherwise(F.array().cast("array<double>"))

    def pick(edges):
        ts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.flatten(F.transform(edges, cuts))), lambda t: t.between(0, 1))))

        def lit_at(t):
            x, y = a["x"] + t * dx, a["y"] + t * dy
            edge = F.exists(edges, lambda e: geo.distance_to_segment(x, y, e) <= EPS)
            return edge | geo.in_rings(rings, x, y)

        spans = let(ts, lambda v: F.transform(F.sequence(F.lit(1), F.greatest(F.size(v) - 1, F.lit(1))), lambda i: F.struct(F.element_at(v, i).alias("t0"), F.get(v, i).alias("t1"))))
        return F.filter(spans, lambda s: (s["t1"] > s["t0"]) & lit_at((s["t0"] + s["t1"]) / 2))

    return let(geo.rings_edges(rings), pick)


def band_shares(band, a, b) -> dict:
    """Where the piece a-b begins and how far it goes, in shares of the edge (0) and of the vector (1) that lead from a band's corner."""
    dx, dy, wx, wy = b["x"] - a["x"], b["y"] - a["y"], a["x"] - band["x"], a["y"] - band["y"]
    return {"at0": wx * band["fx"] + wy * band["fy"], "by0": dx * band["fx"] + dy * band["fy"], "at1": wx * band["gx"] + wy * band["gy"], "by1": dx * band["gx"] + dy * band["gy"]}


def in_band():
    """struct(t0, t1) from the columns of band_shares: where the piece lies in the parallelogram, t0 above t1 where it does not: each share is between 0 and 1."""
    slab = lambda at, by: (
        F.when(F.abs(by) > EPS, F.least(-at / by, (1 - at) / by)).when(at.between(-EPS, 1 + EPS), F.lit(0.0)).otherwise(F.lit(2.0)),
        F.when(F.abs(by) > EPS, F.greatest(-at / by, (1 - at) / by)).otherwise(F.lit(1.0)),
    )
    (l0, h0), (l1, h1) = (slab(F.col(f"at{k}"), F.col(f"by{k}")) for k in (0, 1))
    return F.struct(F.greatest(F.lit(0.0), l0, l1).alias("t0"), F.least(F.lit(1.0), h0, h1).alias("t1"))


def dark_lengths(spans: DataFrame) -> DataFrame:
    """(stamp, edge_id, both, solid): covered lengths of all and of solid spans(stamp, edge_id, piece, soft, t0, t1), in one pass over each piece's spans in order with two running ends."""
    w = Window.partitionBy("stamp", "edge_id", "piece").orderBy("t0", "t1", "soft").rowsBetween(Window.unboundedPreceding, -1)
    solid_end = F.when(~F.col("soft"), F.col("t1"))
    more = lambda end: F.greatest(F.col("t1") - F.greatest(F.col("t0"), F.coalesce(F.max(end).over(w), F.col("t0"))), F.lit(0.0))
    grown = spans.select("stamp", "edge_id", more(F.col("t1")).alias("both"), F.when(F.col("soft"), 0.0).otherwise(more(solid_end)).alias("solid"))
    return grown.groupBy("stamp", "edge_id").agg(F.sum("both").alias("both"), F.sum("solid").alias("solid"))


def score_streets(edges: DataFrame, casters: DataFrame, stamps: DataFrame) -> DataFrame:
    """score() of all that casters throw; by day a street that nothing reaches is in the sun, and without any caster every stamp is night."""
    if not casters.limit(1).count():
        stamps = stamps.withColumn("altitude", F.lit(-90.0))
    return score(edges, shadow_parts(stored(near_streets(casters, edges)), stamps), stamps)


def score(edges: DataFrame, parts: DataFrame, stamps: DataFrame, cell: float = 128.0, first: int = FIRST) -> DataFrame:
    """(stamp, edge_id, shade) for edges(edge_id, coords) and every stamp: the share of an edge's own length in solid shadow, and CANOPY_OPACITY of that in soft shadow alone. Night is where stamps' altitude says so, or else a stamp without any part.

    Where shadows lie many times over each other, most add nothing. So parts are dealt to lots, each about a fourth of the next, of which the first
    has some `first` parts in the fullest cell, and a lot meets only the gaps that those before it have left: a street in full shadow is done. Rings,
    which are asked far slower than bands, come last."""
    days = stamps.where("altitude > 0") if "altitude" in stamps.columns else stamps
    if "band" not in parts.columns:
        parts = parts.withColumn("band", F.lit(None).cast(BAND))
    # a lot's number is by chance, and one higher in a fourth of the cases
    chance = (F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 31)) + 1) / float(1 << 31)
    parts = stored(parts.withColumn("lot", F.least(F.lit(LOTS), F.floor(-F.log(chance) / math.log(4))).cast("int")), "lot")
    ringed = F.col("rings").isNotNull()
    full = parts.groupBy(ringed.alias("ringed"), "stamp", "soft", F.floor(F.col("r_x0") / cell), F.floor(F.col("r_y0") / cell)).agg(F.count("*").alias("n")).groupBy("ringed").agg(F.max("n").alias("n")).orderBy("ringed").collect()  # two rows
    pieces = stored(street_pieces(edges))
    # a span without length at each piece's end, before which a gap may lie
    end = F.col("size")
    spans = stored(_grown(pieces.crossJoin(F.broadcast(days.select("stamp"))).select("stamp", "edge_id", "piece", F.lit(False).alias("soft"), end.alias("t0"), end.alias("t1"))))  # some dozens of stamps
    for rings, most in full:
        top = min(LOTS, max(0, math.ceil(math.log(most / first, 4))))
        for k in range(top, -1, -1):
            gaps = stored(_gaps(spans, pieces))
            if not gaps.limit(1).count():
                dropped(gaps)
                break
            lot = parts.where(ringed if rings else ~ringed).where(F.col("lot") >= top if k == top else F.col("lot") == k).drop("lot")
            old, spans = spans, stored(_grown(spans.select(SPAN).unionByName((_ring_spans if rings else _band_spans)(gaps, lot, cell))))
            dropped(gaps, old)
    sums = dark_lengths(spans).select("stamp", "edge_id", (F.col("solid") + CANOPY_OPACITY * (F.col("both") - F.col("solid"))).alias("dark"))
    if "altitude" in stamps.columns:
        night = stamps.where("not coalesce(altitude > 0, false)").select("stamp", F.lit(True).alias("night"))
    else:
        night = stamps.select("stamp").join(parts.select("stamp").distinct(), "stamp", "left_anti").withColumn("night", F.lit(True))
    whole = edges.select("edge_id", geo.line_length(F.col("coords")).alias("length"))
    all_rows = whole.crossJoin(F.broadcast(stamps.select("stamp").join(night, "stamp", "left")))  # some dozens of stamps
    shade = F.when(F.col("night"), 1.0).otherwise(F.least(F.lit(1.0), F.coalesce(F.try_divide("dark", "length"), F.lit(0.0))))
    return all_rows.join(sums, ["stamp", "edge_id"], "left").select("stamp", "edge_id", shade.cast("float").alias("shade"))


def _span(i) -> list:
    return [F.col("stamp"), F.col("edge_id"), F.col("piece"), F.col("soft"), (i["t0"] * F.col("size")).alias("t0"), (i["t1"] * F.col("size")).alias("t1")]


def _band_spans(gaps: DataFrame, parts: DataFrame, cell: float) -> DataFrame:
    """SPAN of the bands that meet the gaps of their kind, along the whole piece."""
    # exploded, so that the interval is not asked for before the boxes are
    met = grid_join(gaps, parts.drop("rings"), cell, ["stamp", "soft"]).withColumns(band_shares(F.col("band"), F.col("a"), F.col("b")))
    return met.withColumn("i", F.explode(F.array(in_band()))).where("i.t1 > i.t0").select(*_span(F.col("i")))


def _ring_spans(gaps: DataFrame, parts: DataFrame, cell: float) -> DataFrame:
    """SPAN of the rings that meet the gaps of their kind, along the whole piece; what is of every stamp meets a piece once for all stamps at which it has gaps."""
    parts, within = parts.drop("band"), F.explode(inside(F.col("rings"), F.col("a"), F.col("b")))
    own = grid_join(gaps, parts.where("stamp is not null"), cell, ["stamp", "soft"]).withColumn("i", within).select(*_span(F.col("i")))
    low, high = [F.min(c).alias(c) for c in ("x0", "y0")], [F.max(c).alias(c) for c in ("x1", "y1")]
    of_all = gaps.groupBy("edge_id", "piece", "soft", "a", "b", "size").agg(F.collect_set("stamp").alias("at"), *low, *high)
    feet = grid_join(of_all, parts.where("stamp is null").drop("stamp"), cell, ["soft"]).withColumn("i", within).withColumn("stamp", F.explode("at"))
    return own.unionByName(feet.select(*_span(F.col("i"))))


def _grown(spans: DataFrame) -> DataFrame:
    """The spans that add to what those before them in their piece cover, all or solid, with how far that goes; what is left out adds nothing."""
    w = Window.partitionBy("stamp", "edge_id", "piece").orderBy("t0", "t1", "soft").rowsBetween(Window.unboundedPreceding, -1)
    ends = spans.select(*SPAN, F.coalesce(F.max("t1").over(w), F.lit(0.0)).alias("end_both"), F.coalesce(F.max(F.when(~F.col("soft"), F.col("t1"))).over(w), F.lit(0.0)).alias("end_solid"))
    return ends.where((F.col("t1") > F.col("end_both")) | ~F.col("soft") & (F.col("t1") > F.col("end_solid")))


def _gaps(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """pieces with stamp and soft, once for each gap between spans, whose box is theirs: solid parts are asked for where no solid one lies, soft ones where none lies. Gaps of up to EPS are none."""
    kinds = F.array(*(F.struct(F.lit(soft).alias("soft"), F.col(f"end_{end}").alias("g0"), F.when(F.lit(soft) | ~F.col("soft"), F.col("t0")).alias("g1")) for soft, end in ((True, "both"), (False, "solid"))))
    gaps = spans.select("stamp", "edge_id", "piece", F.explode(kinds).alias("g")).select("stamp", "edge_id", "piece", "g.*").where(F.col("g1") - F.col("g0") > EPS)
    at = lambda g, v: F.col(f"a.{v}") + (F.col(f"b.{v}") - F.col(f"a.{v}")) * (F.col(g) / F.col("size"))
    box = [f(at("g0", v), at("g1", v)).alias(f"{v}{n}") for n, f in enumerate((F.least, F.greatest)) for v in "xy"]
    return gaps.join(pieces.drop("x0", "y0", "x1", "y1"), ["edge_id", "piece"]).select("stamp", "soft", "edge_id", "piece", "a", "b", "size", *box)
