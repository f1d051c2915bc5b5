"""More operators on the tables at hand: geometry, the sun, canopy, the survey, the score store and summaries, with the SQL that says the same."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark import constants as C
from heliospark.functions import geo, solar
from heliospark.operators import canopy, heights, places, quality, shade, survey
from heliospark.plans import nightly
from heliospark.queries import STAMP_SQL, _mass, dbl, load, query, stamps
from heliospark.sources import files, geometry, scorestore, tables
from heliospark.sources.tables import scratch


def box(x, y, w, h):
    """One closed ring."""
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    zero = F.lit(0.0)
    return F.array(F.array(at(zero, zero), at(w, zero), at(w, h), at(zero, h), at(zero, zero)))


# Geometry


@query("""with p as (select c_custkey, greatest(x, -(x + 12), 0) as dx, greatest(y, -(y + 9), 0) as dy from (select c_custkey, c_custkey * 37 % 4001 - 2000 as x, c_custkey * 53 % 4001 - 2000 as y from customer))
  select c_custkey from p where dx * dx + dy * dy <= 1000 * 1000""")
def disc_filter(s, d):
    """Houses that come as near to the centre as a radius."""
    k = F.col("c_custkey")
    at = load(s, d, "customer").select("c_custkey", box(dbl(k * 37 % 4001 - 2000), dbl(k * 53 % 4001 - 2000), F.lit(12.0), F.lit(9.0)).alias("rings"))
    return at.where(geo.within(F.col("rings"), F.lit(0.0), F.lit(0.0), 1000.0)).select("c_custkey")


@query("""select s_suppkey, cast(w * h as double) as area, round(x + w / 2.0::double, 6) as cx, round(y + h / 2.0::double, 6) as cy, cast(2 * (w + h) as double) as around, cast(x + w as double) as mx, cast(y + h as double) as my
  from (select s_suppkey, s_suppkey * 37 % 1009 as x, s_suppkey * 53 % 1013 as y, s_suppkey % 50 + 1 as w, s_nationkey + 1 as h from supplier)""")
def ring_measures(s, d):
    k = F.col("s_suppkey")
    r = load(s, d, "supplier").select("s_suppkey", box(dbl(k * 37 % 1009), dbl(k * 53 % 1013), dbl(k % 50 + 1), dbl(F.col("s_nationkey") + 1)).alias("rings"))
    ring = F.col("rings")[0]
    return r.select(
        "s_suppkey", geo.polygon_area(F.col("rings")).alias("area"), F.round(geo.ring_centroid(ring)["x"], 6).alias("cx"), F.round(geo.ring_centroid(ring)["y"], 6).alias("cy"), geo.line_length(ring).alias("around"),
        geo.line_at(ring, 0.5)["x"].alias("mx"), geo.line_at(ring, 0.5)["y"].alias("my"),
    )


@query("select s_suppkey, cast(s_suppkey % 5 + 2 as int) as corners, cast((s_suppkey % 5 + 1) * 10 as double) as metres from supplier")
def merged_walk(s, d):
    """Lines in order as one line: a corner that two share stands once."""
    at = lambda i: F.struct((i * 10).cast("double").alias("x"), F.lit(0.0).alias("y"))
    pieces = F.transform(F.sequence(F.lit(0), (F.col("s_suppkey") % 5).cast("int")), lambda i: F.array(at(i), at(i + 1)))
    return load(s, d, "supplier").select("s_suppkey", geo.merge_lines(pieces).alias("m")).select("s_suppkey", F.size("m").alias("corners"), geo.line_length(F.col("m")).alias("metres"))


@query("""select c_custkey, case when x > 10 and x < 40 and y > 10 and y < 60 then 10.0::double when x > 30 and x < 90 and y > 30 and y < 80 then 30.0::double end as corner
  from (select c_custkey, c_custkey * 37 % 101 + 0.5::double as x, c_custkey * 53 % 103 + 0.5::double as y from customer)""")
def footprint_under(s, d):
    k = F.col("c_custkey")
    two = F.array(box(F.lit(10.0), F.lit(10.0), F.lit(30.0), F.lit(50.0)), box(F.lit(30.0), F.lit(30.0), F.lit(60.0), F.lit(50.0)))
    found = geo.footprint_at(two, dbl(k * 37 % 101) + 0.5, dbl(k * 53 % 103) + 0.5)
    return load(s, d, "customer").select("c_custkey", found[0][0]["x"].alias("corner"))


@query("select c_custkey, round(50 + c_custkey % 977 / 977.0::double, 7) as lat, round(70 + c_custkey * 7 % 1009 / 500.0::double, 7) as lon from customer")
def projected_and_back(s, d):
    k = F.col("c_custkey")
    lat, lon = 50 + dbl(k % 977) / 977, 70 + dbl(k * 7 % 1009) / 500
    p = load(s, d, "customer").select("c_custkey", geo.to_utm(lat, lon).alias("p"))
    back = p.select("c_custkey", geo.from_utm(F.col("p.x"), F.col("p.y")).alias("b"))
    return back.select("c_custkey", F.round("b.lat", 7).alias("lat"), F.round("b.lon", 7).alias("lon"))


@query("""select c_custkey, round(sqrt(pow((lat - 51.1605::double) * 111320.0::double, 2) + pow((lon - 71.4704::double) * 111320.0::double * cos(radians(51.1605::double)), 2)), 5) as metres
  from (select c_custkey, 51 + c_custkey % 1000 / 2000.0::double as lat, 71 + c_custkey * 7 % 1000 / 1000.0::double as lon from customer)""")
def flat_metres(s, d):
    k = F.col("c_custkey")
    lat, lon = 51 + dbl(k % 1000) / 2000, 71 + dbl(k * 7 % 1000) / 1000
    return load(s, d, "customer").select("c_custkey", F.round(geo.flat_distance(lat, lon, F.lit(C.LAT), F.lit(C.LON), F.lit(C.LAT)), 5).alias("metres"))


@query("""select s_suppkey, case s_suppkey % 3 when 0 then 'Polygon' else 'MultiPolygon' end as type, cast(case s_suppkey % 3 when 0 then 1 else 2 end as int) as n_rings, cast(s_suppkey * 37 % 1009 as double) as x from supplier where s_suppkey % 3 <> 2""")
def polygons_of_features(s, d):
    """GeoJSON features of several types: those that are polygons, with their rings."""
    k = F.col("s_suppkey")
    x, y = (k * 37 % 1009).cast("string"), (k * 53 % 1013).cast("string")
    ring = F.concat(F.lit("[["), x, F.lit(","), y, F.lit("],["), x, F.lit(".5,"), y, F.lit("],["), x, F.lit(","), y, F.lit(".5],["), x, F.lit(","), y, F.lit("]]"))
    body = F.when(k % 3 == 0, F.concat(F.lit('"Polygon","coordinates":['), ring, F.lit("]"))).when(k % 3 == 1, F.concat(F.lit('"MultiPolygon","coordinates":[['), ring, F.lit("],["), ring, F.lit("]]")))
    body = F.coalesce(body, F.concat(F.lit('"LineString","coordinates":'), ring))
    text = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":{"type":'), body, F.lit("}}"))
    rows = load(s, d, "supplier").select("s_suppkey", geometry.from_geojson(text).alias("g")).withColumn("type", F.col("g.type"))
    return geometry.polygons(rows, "g").select("s_suppkey", "type", F.size("rings").alias("n_rings"), F.col("rings")[0][0]["x"].alias("x"))


# The sun

SUN_SQL = """with o as (select o_orderkey, datediff('day', date '2000-01-01', cast(o_orderdate as date)) - 0.5::double + (o_orderkey % 1440 - 300) / 1440.0::double as days from orders),
  a as (select *, (days + 69.2::double / 86400) / 36525 as t from o),
  b as (select *, (((280.46646::double + t * (36000.76983::double + t * 0.0003032::double)) % 360) + 360) % 360 as ml, radians(357.52911::double + t * (35999.05029::double - 0.0001537::double * t)) as an, radians(125.04::double - 1934.136::double * t) as nd from a),
  c as (select *, radians(ml + sin(an) * (1.914602::double - t * (0.004817::double + 0.000014::double * t)) + sin(2 * an) * (0.019993::double - 0.000101::double * t) + sin(3 * an) * 0.000289::double - 0.00569::double - 0.00478::double * sin(nd)) as lg,
    radians(23 + (26 + (21.448::double - t * (46.815::double + t * (0.00059::double - t * 0.001813::double))) / 60) / 60 + 0.00256::double * cos(nd)) as tl from b),
  e as (select *, asin(sin(tl) * sin(lg)) as dc, radians(280.46061837::double + 360.98564736629::double * days + 0.000387933::double * t * t + 71.4704::double - degrees(atan2(cos(tl) * sin(lg), cos(lg)))) as h, radians(51.1605::double) as phi from c),
  f as (select *, degrees(asin(sin(phi) * sin(dc) + cos(phi) * cos(dc) * cos(h))) as up, degrees(atan2(sin(h), cos(h) * sin(phi) - tan(dc) * cos(phi))) + 180 as az from e)
  select o_orderkey, round(up + case when up > -1 then 1.02::double / tan(radians(up + 10.3::double / (up + 5.11::double))) / 60 * (1013.25::double / 1010) * (283 / 288.15::double) else 0 end - 8.794::double / 3600 * cos(radians(up)), 5) as altitude,
    round(((az % 360) + 360) % 360, 4) as azimuth from f"""


@query(SUN_SQL)
def sun_at(s, d):
    p = solar.sun_position(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 1440).cast("int"))
    return load(s, d, "orders").select("o_orderkey", p.alias("p")).select("o_orderkey", F.round("p.altitude", 5).alias("altitude"), F.round("p.azimuth", 4).alias("azimuth"))


@query("select p_partkey, round(90 - abs(51.1605::double - d), 6) as altitude, round(1 / tan(radians(90 - abs(51.1605::double - d))), 6) as ratio from (select p_partkey, p_size - 25.5::double as d from part)")
def noon_angle(s, d):
    a = solar.sun_angle(C.LAT, dbl("p_size") - 25.5)
    return load(s, d, "part").select("p_partkey", F.round(a["altitude"], 6).alias("altitude"), F.round(a["ratio"], 6).alias("ratio"))


SUN_ROWS = [("09:00", 16.2, 134.3), ("12:00", 27.0, 178.0), ("22:00", -9.0, 310.0)]


@query("""with v as (select stamp, p_partkey % 9 = 0 as soft, 12 * abs(least(p_size / tan(radians(alt)), 300) * cos(radians(az + 180))) * 2 + 9 * abs(least(p_size / tan(radians(alt)), 300) * sin(radians(az + 180))) * 2 + 108 as area
    from part, (values ('09:00', 16.2::double, 134.3::double), ('12:00', 27.0::double, 178.0::double)) t(stamp, alt, az))
  select stamp, case when soft then 'soft' else 'solid' end as kind, cast(count(*) * 5 as bigint) as n, round(sum(area), 2) as area from v group by all""")
def shadow_features(s, d):
    """Shadow polygons of all houses at three stamps, the last at night."""
    k = F.col("p_partkey")
    houses = load(s, d, "part").select(box(dbl(k * 37 % 2003), dbl(k * 53 % 1999), F.lit(12.0), F.lit(9.0)).alias("rings"), dbl("p_size").alias("height_m"), F.when(k % 9 == 0, "canopy_model").otherwise("tag").alias("height_source"))
    parts = shade.shadow_polygons(houses, s.createDataFrame(SUN_ROWS, "stamp string, altitude double, azimuth double"))
    return parts.groupBy("stamp", "kind").agg(F.count("*").alias("n"), F.round(F.sum(geo.polygon_area(F.col("rings"))), 2).alias("area"))


# Canopy


@query("""with c as (select 'tag' as height_source, true as always, cast(p_size as double) as h from part union all select 'tree_default', false, 4.0::double from supplier union all select 'chm_height', false, cast(c_nationkey as double) from customer),
  t as (select * from (values (true, '2024-06-15'), (false, '2024-01-15')) t(leaf, day)) select day, height_source, count(*) as n, sum(h) as height from c, t where always or leaf group by all""")
def union_casters(s, d):
    """What casts shadows on a summer and on a winter day."""
    k = F.lit(1.0)
    row = lambda t, h, source: load(s, d, t).select(box(k, k, k, k).alias("rings"), dbl(h).alias("height_m"), F.lit(source).alias("height_source"))
    all_of = [row("part", "p_size", "tag"), row("supplier", F.lit(C.TREE_HEIGHT), "tree_default"), row("customer", "c_nationkey", "chm_height")]
    days = [canopy.casters(*all_of, day).withColumn("day", F.lit(day)) for day in ("2024-06-15", "2024-01-15")]
    return days[0].unionByName(days[1]).groupBy("day", "height_source").agg(F.count("*").alias("n"), F.sum("height_m").alias("height"))


@query("""with a as (select distinct p_partkey * 37 % 97 as row, p_partkey * 53 % 89 as col from part), b as (select distinct s_suppkey * 37 % 97 as row, s_suppkey * 53 % 89 as col from supplier) select row, col from a except select row, col from b""")
def pixels_outside(s, d):
    at = lambda t, c: load(s, d, t).select((F.col(c) * 37 % 97).alias("row"), (F.col(c) * 53 % 89).alias("col")).distinct()
    return canopy.overlay(at("part", "p_partkey"), at("supplier", "s_suppkey"))


LOTS_SQL = "select s_suppkey as id, s_suppkey * 37 % 1009 + 0.25::double as x, s_suppkey * 53 % 1013 + 0.25::double as y, s_suppkey % 40 + 5 as w, s_nationkey + 5 as h from supplier"
CELLS_SQL = f"""select id, i * 10 + 5.0::double as cx, j * 10 + 5.0::double as cy from (select *, unnest(range(0, 110)) as i from ({LOTS_SQL})), range(0, 110) t(j) where i * 10 + 5 > x and i * 10 + 5 < x + w and j * 10 + 5 > y and j * 10 + 5 < y + h"""


def _polygons(s, d) -> DataFrame:
    k = F.col("s_suppkey")
    return load(s, d, "supplier").select(k.alias("polygon_id"), box(dbl(k * 37 % 1009) + 0.25, dbl(k * 53 % 1013) + 0.25, dbl(k % 40 + 5), dbl(F.col("s_nationkey") + 5)).alias("rings"))


@query(f"select id as polygon_id, cx as x, cy as y from ({CELLS_SQL})")
def lattice_cells(s, d):
    return canopy.cell_centres(_polygons(s, d), 10.0)


@query(f"select distinct cast(floor(cy / 10) as int) as row, cast(floor(cx / 10) as int) as col from ({CELLS_SQL})")
def burnt_pixels(s, d):
    return canopy.burn(_polygons(s, d), 10.0)


@query(f"select count(*) as n, round(count(*) * {0.5 * 16 * C.CROWN_FROM_CELL**2}::double * sin(pi() / 8), 2) as area from ({CELLS_SQL})")
def round_crowns(s, d):
    """Lattice cells as round crowns of 16 corners."""
    return canopy.round_cells(_polygons(s, d)).agg(F.count("*").alias("n"), F.round(F.sum(geo.polygon_area(F.col("rings"))), 2).alias("area"))


@query("select cast(sum(ceil(p_size * 3 / 6.0::double) + 1) as bigint) as n from part")
def row_crowns(s, d):
    """Rows of trees: a crown at every two radii."""
    at = lambda v: F.struct(v.alias("x"), F.lit(0.0).alias("y"))
    rows = load(s, d, "part").select(F.array(at(F.lit(0.0)), at(dbl(F.col("p_size") * 3))).alias("coords"))
    return canopy.tree_crowns(rows, C.CROWN_RADIUS).agg(F.count("*").alias("n"))


@query("select c_name as scene from customer where c_custkey * 7 % 1000 / 10.0::double < 5 order by c_custkey * 7 % 1000, c_name limit 1")
def clearest_scene(s, d):
    return canopy.best_scene(load(s, d, "customer").select(F.col("c_name").alias("scene"), (dbl(F.col("c_custkey") * 7 % 1000) / 10).alias("cloud")))


# Heights and summaries


@query("""select p_partkey as id, case when p_partkey % 13 = 0 then cast(p_size + 1 as double) end as override_levels from part""")
def overridden_levels(s, d):
    """Overrides written as CSV, read back and laid on the buildings."""
    p, path = load(s, d, "part"), scratch(s, "overrides")
    rows = p.where("p_partkey % 13 = 0").select(F.lit("way").alias("osm_element"), F.col("p_partkey").alias("osm_id"), (F.col("p_size") + 1).alias("levels"), F.lit("seen").alias("source"))
    rows.write.mode("overwrite").option("header", True).csv(path)
    b = p.select(F.lit("way").alias("element"), F.col("p_partkey").alias("id"))
    return heights.with_overrides(b, tables.overrides(s, path)).select("id", "override_levels")


@query("select p_type as source, count(*) as n, cast(sum(p_size) as bigint) as area from part group by p_type")
def area_by_source(s, d):
    return quality.by_source(load(s, d, "part").withColumn("area", F.col("p_size").cast("long")), "p_type", "area")


@query("select p_brand as value, count(*) as n from part group by p_brand order by n desc, value limit 10")
def commonest_values(s, d):
    return quality.top_values(load(s, d, "part"), "p_brand", 10)


@query("""select p_type, count(*) as n, cast(sum(p_size) as double) / count(*) as mean, cast(min(p_size) as double) as least, quantile_cont(p_size, 0.25) as q1, quantile_cont(p_size, 0.5) as q2, quantile_cont(p_size, 0.75) as q3, cast(max(p_size) as double) as most from part group by p_type""")
def described(s, d):
    return quality.describe(load(s, d, "part").select("p_type", dbl("p_size").alias("v")), "v", ["p_type"])


@query("select count(*) as n, count(distinct p_brand) as n_p_brand, count(distinct p_type) as n_p_type, cast(sum(p_size) as bigint) as sum_p_size from part")
def table_extent(s, d):
    return quality.extent(load(s, d, "part").withColumn("p_size", F.col("p_size").cast("long")), ["p_brand", "p_type"], ["p_size"])


# Places


@query("""with l as (select p_brand as name, p_size as len, p_partkey as pos from part) select name, arg_max(len, len * 1e9::double - pos) / 2.0::double as x, 0.0::double as y from l group by name""")
def longest_street(s, d):
    """The middle of each name's longest piece, of equally long ones the first."""
    at = lambda v: F.struct(v.alias("x"), F.lit(0.0).alias("y"))
    rows = load(s, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_brand").alias("name"), F.array(at(F.lit(0.0)), at(dbl("p_size"))).alias("coords"))
    return places.street_entries(rows)


# The survey


QUEUE_SQL = "select p_partkey as osm_id, p_type as tag, sqrt(p_retailprice) * p_size as m from part where p_partkey % 3 <> 0 order by m desc, osm_id limit 2500"


@query(f"""with q as ({QUEUE_SQL}), pr as (select p_type as tag, cast(max(p_size) as double) as prior from part group by p_type)
  select osm_id, prior, case when osm_id % 7 = 0 then cast(osm_id % 20 + 1 as double) end as answer, osm_id % 11 = 0 as skipped from q left join pr using (tag) where osm_id % 5 <> 0""")
def survey_flags(s, d):
    """The queue with footprints, priors and what is done."""
    p, k = load(s, d, "part"), F.col("p_partkey")
    key = [F.lit("way").alias("osm_element"), k.alias("osm_id")]
    feet = p.where("p_partkey % 5 <> 0").select(*key, box(dbl("p_size"), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("rings"), F.col("p_type").alias("tag"), F.lit("m").alias("bin"))
    priors = p.groupBy(F.col("p_type").alias("tag")).agg(F.max(dbl("p_size")).alias("prior")).withColumn("bin", F.lit("m"))
    out = survey.payload(survey.queue(_mass(s, d)), feet, priors, p.where("p_partkey % 7 = 0").select(*key, dbl(k % 20 + 1).alias("levels")), p.where("p_partkey % 11 = 0").select(*key))
    return out.select("osm_id", "prior", "answer", "skipped")


@query(f"""with q as ({QUEUE_SQL}) select count(*) filter (where osm_id % 7 = 0) as counted, count(*) filter (where osm_id % 11 = 0) as skipped, count(*) filter (where osm_id % 7 <> 0 and osm_id % 11 <> 0) as n_left,
  round(sum(case when osm_id % 7 = 0 then m else 0 end) / sum(m), 6) as mass_share from q""")
def survey_progress(s, d):
    p, k = load(s, d, "part"), F.col("p_partkey")
    key = [F.lit("way").alias("osm_element"), k.alias("osm_id")]
    q = _mass(s, d).where("levels is null").orderBy(F.desc("shadow_mass"), "osm_id").limit(C.SURVEY_TOP)
    out = survey.progress(q, p.where("p_partkey % 7 = 0").select(*key), p.where("p_partkey % 11 = 0").select(*key))
    return out.withColumn("mass_share", F.round("mass_share", 6)).withColumnRenamed("left", "n_left")


@query("""with n as (select p_partkey as k, case when p_partkey % 4 = 0 then null else p_partkey % 80 + 1 end as v from part where p_partkey % 3 = 0), a as (select p_partkey as k, 5 as v from part where p_partkey % 2 = 0), sk as (select p_partkey as k from part where p_partkey % 5 = 0)
  select 'answer' as kind, k as osm_id, cast(v as double) as levels from n where v is not null union all select 'answer', k, cast(v as double) from a where k not in (select k from n)
  union all select 'skip', k, null from n where v is null union all select 'skip', k, null from sk where k not in (select k from n)""")
def survey_answers(s, d):
    """Answers and skips after new ones came: each clears the other's row."""
    p, k = load(s, d, "part"), F.col("p_partkey")
    rows = lambda where, levels: p.where(where).select(F.lit("way").alias("osm_element"), k.alias("osm_id"), levels.cast("double").alias("levels"), F.lit("seen").alias("source"))
    answers, skips = survey.answer(rows("p_partkey % 2 = 0", F.lit(5)), rows("p_partkey % 5 = 0", F.lit(None)).drop("levels", "source"), rows("p_partkey % 3 = 0", F.when(k % 4 != 0, k % 80 + 1)))
    a = answers.select(F.lit("answer").alias("kind"), "osm_id", "levels")
    return a.unionByName(skips.select(F.lit("skip").alias("kind"), "osm_id", F.lit(None).cast("double").alias("levels")))


# The score store


def _store(s, d) -> tuple[str, DataFrame]:
    """Suppliers' edges scored at four stamps: all, every second, some above 1, and none of the network's own."""
    import datetime as dt

    e = load(s, d, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.col("s_suppkey").alias("u"), F.col("s_nationkey").cast("long").alias("v"), F.lit(0).alias("key"))
    row = lambda stamp, share, rows: rows.select(F.lit(1).alias("radius_m"), F.lit(dt.date(2024, 6, 1)).alias("date"), F.lit(stamp).alias("stamp"), "u", "v", "key", share.alias("shade_fraction"))
    half = F.lit(0.5)
    parts = [row("06:00", half, e), row("06:20", half, e.where("u % 2 = 0")), row("06:40", F.when(F.col("u") % 7 == 0, 1.5).otherwise(0.25), e), row("08:00", half, e.withColumn("u", F.col("u") + 1_000_000_000))]
    root = scratch(s, "scores")
    scorestore.save(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), root)
    return root, e


@query("""with n as (select count(*) as n, count(*) filter (where s_suppkey % 2 = 0) as half from supplier)
  select unnest(['07:00 is missing', concat('06:20 covers ', half, ' of ', n, ' edges'), '06:40 has shade outside 0 to 1', concat('08:00 covers 0 of ', n, ' edges')]) as wrong from n""")
def validate_scores(s, d):
    import datetime as dt

    root, e = _store(s, d)
    wrong = scorestore.validate(s, root, 1, dt.date(2024, 6, 1), ["06:00", "06:20", "06:40", "07:00", "08:00"], e)
    return s.createDataFrame([(w,) for w in wrong], "wrong string")


@query("""select stamp, n as n_edges, case stamp when '06:20' then half when '08:00' then 0 else n end as n_scored, stamp <> '06:40' as valid from (select count(*) as n, count(*) filter (where s_suppkey % 2 = 0) as half from supplier), (select unnest(['06:00', '06:20', '06:40', '08:00']) as stamp)""")
def score_coverage(s, d):
    root, e = _store(s, d)
    return scorestore.coverage(e, scorestore.scan(s, root), ["06:00", "06:20", "06:40", "08:00"])


@query(f"select stamp from {STAMP_SQL} where stamp not in ('06:00', '06:20', '06:40', '08:00')")
def missing_stamps(s, d):
    import datetime as dt

    root, _ = _store(s, d)
    asked = [r["stamp"] for r in stamps(s).orderBy("stamp_idx").collect()]
    return s.createDataFrame([(x,) for x in scorestore.missing(s, root, 1, dt.date(2024, 6, 1), asked)], "stamp string")


@query("select s_suppkey as edge_id, 0.5::double as shade from supplier")
def loaded_scores(s, d):
    import datetime as dt

    root, e = _store(s, d)
    return scorestore.load(s, root, 1, dt.date(2024, 6, 1), "06:00", e).select("edge_id", dbl("shade").alias("shade"))


@query("select n_name as name from nation where n_nationkey % 3 <> 0")
def stale_anti(s, d):
    """Names on disk that a run did not write."""
    n = load(s, d, "nation")
    names = lambda rows: [r["n_name"] for r in rows.collect()]  # noqa: E731  # 25 nations
    return nightly.stale(s, names(n), names(n.where("n_nationkey % 3 = 0")))


@query("select s_suppkey, cast(4 as int) as corners from supplier")
def simplified_rings(s, d):
    """Squares with corners a hand's breadth off their sides lose these; the closing corner isn't counted."""
    k = F.col("s_suppkey")
    x, y = dbl(k * 37 % 1009), dbl(k * 53 % 1013)
    off = dbl(k % 9) / 10
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    ring = F.array(at(0, 0), at(10, off), at(20, -off), at(40, 0), at(40 - off, 20), at(40, 40), at(20, 40 + off), at(0, 40), at(0, 0))
    return tables.dealt(load(s, d, "supplier")).select("s_suppkey", (F.size(files.simplified(ring)) - 1).alias("corners"))


from heliospark import city_queries, day_queries, layer_queries  # noqa: E402, F401  # they register themselves
