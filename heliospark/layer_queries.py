"""Dissolved shadows and canopy as polygons on the tables at hand, with the SQL that says the same by points and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.functions import geo
from heliospark.geo_queries import SUN_ROWS, box
from heliospark.operators import buffers, canopy, overlay, places, shade
from heliospark.queries import INDEX_SQL, _index, dbl, fold_sql, load, query
from heliospark.sources import raster

#: A lattice of points, whose corner is off every corner of a house.
STEP, OFF_X, OFF_Y = 2.75, 0.137, 0.291


def houses(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return load(s, d, "part").select(box(dbl(k * 37 % 2003), dbl(k * 53 % 1999), F.lit(12.0), F.lit(9.0)).alias("rings"), dbl("p_size").alias("height_m"), F.when(k % 9 == 0, "canopy_model").otherwise("tag").alias("height_source"))


def sun(s: SparkSession) -> DataFrame:
    return s.createDataFrame(SUN_ROWS, "stamp string, altitude double, azimuth double")


def lattice_rows(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, j, points): how many points of each row of the lattice lie in rings(keys, ring), counted at the boundary: what lies west of an edge that runs north, less what lies west of one that runs south."""
    e = rings.select(*keys, F.explode(geo.ring_edges(F.col("ring"))).alias("e")).select(*keys, "e.a", "e.b").where("a.y != b.y")
    row = lambda y: F.ceil((y - OFF_Y) / STEP)
    e = e.withColumn("j0", row(F.least("a.y", "b.y"))).withColumn("j1", row(F.greatest("a.y", "b.y")) - 1).where("j0 <= j1")
    e = e.withColumn("j", F.explode(F.sequence("j0", "j1")))
    x = F.col("a.x") + (F.col("j") * STEP + OFF_Y - F.col("a.y")) / (F.col("b.y") - F.col("a.y")) * (F.col("b.x") - F.col("a.x"))
    west = F.ceil((x - OFF_X) / STEP)
    return e.groupBy(*keys, "j").agg(F.sum(F.when(F.col("b.y") > F.col("a.y"), west).otherwise(-west)).cast("long").alias("points")).where("points != 0")


SUN_SQL = "(values " + ", ".join(f"('{n}', {alt}::double, {az}::double)" for n, alt, az in SUN_ROWS) + ") t(stamp, alt, az)"
#: A point is in a house's shadow if some share of the way back to the house lies in it.
LAYERS_SQL = f"""with h as (select stamp, p_partkey % 9 = 0 as soft, p_partkey * 37 % 2003 as x, p_partkey * 53 % 1999 as y, least(p_size / tan(radians(alt)), 300) * sin(radians(az + 180)) as vx, least(p_size / tan(radians(alt)), 300) * cos(radians(az + 180)) as vy from part, {SUN_SQL} where alt > 0),
  i as (select *, unnest(range(ceil((x + least(vx, 0) - {OFF_X}) / {STEP})::bigint, floor((x + 12 + greatest(vx, 0) - {OFF_X}) / {STEP})::bigint + 1)) as i from h),
  p as (select *, i * {STEP}::double + {OFF_X}::double as px, j * {STEP}::double + {OFF_Y}::double as py from (select *, unnest(range(ceil((y + least(vy, 0) - {OFF_Y}) / {STEP})::bigint, floor((y + 9 + greatest(vy, 0) - {OFF_Y}) / {STEP})::bigint + 1)) as j from i)),
  q as (select stamp, soft, i, j from p where greatest(0, least((px - x - 12) / vx, (px - x) / vx), least((py - y - 9) / vy, (py - y) / vy)) <= least(1, greatest((px - x - 12) / vx, (px - x) / vx), greatest((py - y - 9) / vy, (py - y) / vy))),
  g as (select stamp, i, j, bool_and(soft) as soft from q group by stamp, i, j)
  select stamp, case when soft then 'soft' else 'solid' end as kind, j, count(*) as points from g group by all"""


@query(LAYERS_SQL)
def shadow_layers(s, d):
    """Dissolved shadows of all houses, solid and dappled, as points of a lattice in them."""
    return lattice_rows(shade.shadow_layers(houses(s, d), sun(s)), ["stamp", "kind"])


@query(f"select stamp, true as balanced from {SUN_SQL} where alt > 0")
def layer_areas(s, d):
    """What the layers cover apart is what all shadows cover together."""
    parts = shade.swept_parts(houses(s, d), sun(s))
    both = parts.select(F.concat("stamp", F.lit(" apart")).alias("stamp"), "soft", "rings").unionByName(parts.select(F.concat("stamp", F.lit(" at once")).alias("stamp"), F.lit(False).alias("soft"), "rings"))
    area = overlay.layers(both).groupBy(F.substring("stamp", 1, 5).alias("stamp")).agg(F.sum(F.when(F.col("stamp").endswith("apart"), F.col("area")).otherwise(-F.col("area"))).alias("off"))
    return area.select("stamp", (F.abs("off") < 0.01).alias("balanced"))


def _patches(pixels: str, near: str) -> str:
    """Patches of pixels(row, col), their pixels and the sides that they share with no other."""
    return f"""with recursive p as ({pixels}), e as (select a.row * 1000 + a.col as a, b.row * 1000 + b.col as b from p a join p b on {near}),
  r as (select a as n, a as l from e union select e.b, r.l from r join e on e.a = r.n), l as (select n, min(l) as l from r group by n),
  s as (select n, count(*) as sides from (select row * 1000 + col as n, unnest([row * 1000 + col - 1, row * 1000 + col + 1, row * 1000 + col - 1000, row * 1000 + col + 1000]) as m from p) where m not in (select row * 1000 + col from p) group by n)
  select cast(l // 1000 as bigint) * 2147483648 + l % 1000 as label, cast(count(*) as double) as area, cast(sum(coalesce(sides, 0)) as double) as around from l left join s using (n) group by l"""


@query(_patches("select p_partkey * 37 % 97 as row, p_partkey * 53 % 89 as col from part group by all having max(p_size) >= 30", "abs(a.row - b.row) <= 1 and abs(a.col - b.col) <= 1"))
def crown_outlines(s, d):
    """Rings around patches of high pixels: what they enclose and how long they are."""
    k = F.col("p_partkey")
    high = load(s, d, "part").select((k * 37 % 97).cast("int").alias("row"), (k * 53 % 89).cast("int").alias("col"), "p_size").groupBy("row", "col").agg(F.max("p_size").alias("h")).where("h >= 30")
    return _measured(canopy.label(high.select("row", "col")))


FILL_PIXELS = """select row, col from (select distinct row, unnest(range(x, x + 5)) as col from (select x, unnest(range(96 - y, 100 - y)) as row from (select s_suppkey * 37 % 89 as x, s_suppkey * 53 % 83 + 4 as y from supplier)))
  except select p_partkey * 37 % 97 as row, p_partkey * 53 % 89 as col from part where p_partkey % 5 = 0"""


def _fill(s, d) -> DataFrame:
    k, m = F.col("s_suppkey"), F.col("p_partkey")
    blobs = load(s, d, "supplier").select(box(dbl(k * 37 % 89), dbl(k * 53 % 83 + 4), F.lit(5.0), F.lit(4.0)).alias("rings"))
    mask = load(s, d, "part").where(m % 5 == 0).select((m * 37 % 97).alias("row"), (m * 53 % 89).alias("col"))
    return canopy.overlay(canopy.burnt_in_chunks(blobs, 0.0, 100.0, 1.0, 32), mask)


@query(FILL_PIXELS)
def filled_pixels(s, d):
    """Pixels of blobs that no measured one covers, met chunk by chunk."""
    return _fill(s, d)


@query(_patches(FILL_PIXELS, "abs(a.row - b.row) + abs(a.col - b.col) <= 1"))
def fill_outlines(s, d):
    return _measured(canopy.label(_fill(s, d).select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")), diagonal=False))


def _measured(labelled: DataFrame) -> DataFrame:
    rings = canopy.outlines(labelled.select("label", "row", "col"), ["label"])
    return rings.groupBy("label").agg(F.sum("area").alias("area"), F.sum(geo.line_length(F.col("ring"))).alias("around"))


@query(f"""with i as ({INDEX_SQL}), q as (select query, {fold_sql('query')} as qc, replace(replace({fold_sql('query')}, 'kh', 'h'), 'y', 'i') as ql from (select distinct n_name as query from nation union select distinct substr(p_name, 3, 4) from part union select distinct p_brand from part)),
  h as (select query, entry, n, row_number() over (partition by query order by (qc <> '' and contains(c, qc) and (starts_with(c, qc) or contains(c, ' ' || qc)) or ql <> '' and contains(l, ql) and (starts_with(l, ql) or contains(l, ' ' || ql))) desc, length(n), entry) as rank from i, q where qc <> '' and contains(c, qc) or ql <> '' and contains(l, ql))
  select query, cast(rank as int) as rank, cast(entry as int) as entry, n from h where rank <= 7""")
def search_many(s, d):
    """Every nation, brand and piece of a part's name as a search."""
    p = load(s, d, "part")
    asked = load(s, d, "nation").select(F.col("n_name").alias("query")).union(p.select(F.substring("p_name", 3, 4))).union(p.select("p_brand")).distinct()
    return places.rank(_index(s, d), asked).select("query", "rank", F.col("entry").cast("int").alias("entry"), "n")


@query("""with p as (select p_partkey * 37 % 97 as row, p_partkey * 53 % 89 as col, max(p_size) as v from part group by all), w as (select s_suppkey as window_id, s_suppkey * 37 % 97 - 8 as row, s_suppkey * 53 % 89 - 8 as col, s_suppkey % 20 + 1 as h, s_nationkey + 1 as w from supplier)
  select window_id, w.h * w.w as pixels, cast(coalesce(sum(v), 0) as double) as total, cast(coalesce(sum(v * ((p.row - w.row) * w.w + p.col - w.col)), 0) as double) as placed from w left join p on p.row between w.row and w.row + w.h - 1 and p.col between w.col and w.col + w.w - 1 group by window_id, w.h, w.w""")
def window_reads(s, d):
    """Windows across tiles and edges of a raster: how many pixels, their sum, and their sum weighted by where they lie."""
    k = F.col("s_suppkey")
    tiles = raster.tiled(load(s, d, "part").select((F.col("p_partkey") * 37 % 97).alias("row"), (F.col("p_partkey") * 53 % 89).alias("col"), F.col("p_size").alias("value")), 16)
    asked = load(s, d, "supplier").select(k.alias("window_id"), (k * 37 % 97 - 8).alias("row"), (k * 53 % 89 - 8).alias("col"), (k % 20 + 1).alias("height"), (F.col("s_nationkey") + 1).alias("width"))
    v = raster.windows(tiles, asked, 16).withColumn("v", raster.values("pixels"))
    each = F.transform("v", lambda x, i: dbl(x) * i)
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + dbl(x))
    return v.select("window_id", F.size("v").cast("long").alias("pixels"), add(F.col("v")).alias("total"), add(each).alias("placed"))


#: Of a round join of 16 corners and radius 3.
ROUND = "(8 * 9 * sin(radians(22.5::double)))"


@query(f"""select s_suppkey as id, round(case s_suppkey % 3 when 0 then 6 * a + {ROUND} when 1 then 6 * (a + b) - 9 + 1.25::double * {ROUND} else a * b + 6 * (a + b) + {ROUND} end, 2) as area from (select s_suppkey, s_suppkey % 40 + 10 as a, s_nationkey + 10 as b from supplier)""")
def buffer_areas(s, d):
    """Strips around straight lines, lines with a corner, and boxes."""
    k, a, b = F.col("s_suppkey"), dbl(F.col("s_suppkey") % 40 + 10), dbl(F.col("s_nationkey") + 10)
    x, y = dbl(k * 37 % 1009), dbl(k * 53 % 1013)
    at = lambda u, v: F.struct((x + u).alias("x"), (y + v).alias("y"))
    zero = F.lit(0.0)
    rows = load(s, d, "supplier")
    lines = rows.where(k % 3 < 2).select(k.alias("id"), F.when(k % 3 == 0, F.array(at(zero, zero), at(a, zero))).otherwise(F.array(at(zero, zero), at(a, zero), at(a, b))).alias("coords"))
    boxes = rows.where(k % 3 == 2).select(k.alias("id"), box(x, y, a, b).alias("rings"))
    both = buffers.buffered(lines, 3.0).unionByName(buffers.buffered(boxes, 3.0, closed=True))
    return both.select("id", F.round(geo.polygon_area(F.col("rings")), 2).alias("area"))
