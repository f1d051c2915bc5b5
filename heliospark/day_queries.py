"""Days, requests, charts, the search index and extracted features on the tables at hand, with the SQL that says the same."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from heliospark import constants as C
from heliospark.functions import clock, geo, solar
from heliospark.geo_queries import SUN_SQL, _store
from heliospark.operators import advice, places, quality, survey
from heliospark.plans import days, routing
from heliospark.queries import DEPARTURES_SQL, STAMP_SQL, STAMPS, _departures, _mass, dbl, load, query
from heliospark.sources import files, geometry, scorestore, tables
from heliospark.sources.tables import scratch

_MINUTES = f"""d as (select distinct cast(o_orderdate as date) as day from orders), m as (select h * 60 + q as minute from range(24) h(h), (select unnest([0, 20, 40]) as q)),
  o as (select cast(datediff('day', date '1970-01-01', day) as bigint) * 1440 + minute as o_orderkey, datediff('day', date '2000-01-01', day) - 0.5::double + (minute - 300) / 1440.0::double as days from d, m),"""
_ALTITUDES = "with " + _MINUTES + SUN_SQL[SUN_SQL.index("\n  a as") :].replace("round(up + case", "(up + case").replace("cos(radians(up)), 5) as altitude", "cos(radians(up))) as altitude")


@query(f"""with s as ({_ALTITUDES}), u as (select date '1970-01-01' + cast(floor(o_orderkey / 1440) as int) as day, cast(o_orderkey % 1440 as int) as minute, altitude from s),
  h as (select *, first_value(altitude) over (partition by day, minute // 60 order by minute) as whole from u)
  select cast(day as date) as day, count(*) as n, min(minute) as first, max(minute) as last, cast(sum(minute) as bigint) as total from h where altitude > 0 and (minute % 60 = 0 or whole < {C.LOW_SUN_DEG!r}::double) group by day""")
def daylight_stamps(s, d):
    """How many stamps every date that something was ordered on has, the first, the last and their sum."""
    o = load(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    per = solar.daylight(o, "day").groupBy("day")
    return per.agg(F.count("*").alias("n"), F.min("minute").cast("int").alias("first"), F.max("minute").cast("int").alias("last"), F.sum("minute").alias("total"))


@query(f"""select o_orderkey, printf('%02d:%02d', o_orderkey % 1440 // 60, o_orderkey % 60) in (select stamp from {STAMP_SQL}) as lit from orders""")
def lit_orders(s, d):
    at = clock.to_hhmm(F.col("o_orderkey") % 1440)
    return load(s, d, "orders").select("o_orderkey", clock.is_daylight(at, F.array(*map(F.lit, STAMPS))).alias("lit"))


TODAY = dt.date(1995, 6, 1)


@query("""with e as (select event_id as k, cast(cast(ts as date) as varchar) as day from events),
  f as (select k, case when k % 11 = 0 then null else date '1995-06-01' + cast(k % 900 - 450 as int) end as day, k % 27 - 1 as hour, k % 7 * 10 as minute from e)
  select k as event_id, case when k % 19 = 0 then 'the body is no JSON object' when k % 13 = 0 then 'unknown field: pace' when day is null or abs(datediff('day', date '1995-06-01', day)) > 366 then 'date is too far from today'
    when hour not between 0 and 23 then 'hour is outside 0 to 23' when minute not in (0, 20, 40) then 'minute is no step of the clock' end as refused from f""")
def request_errors(s, d):
    """Events as request bodies: some are cut off, some hold a field that nobody knows, some a date, an hour or a minute that is not taken."""
    k = F.col("event_id")
    day = F.when(k % 11 != 0, F.date_add(F.lit(TODAY), (k % 900 - 450).cast("int")).cast("string"))
    body = F.to_json(F.struct(day.alias("date"), (k % 27 - 1).alias("hour"), (k % 7 * 10).alias("minute"), F.when(k % 13 == 0, 5).alias("pace")))
    body = F.when(k % 19 == 0, F.substring(body, 2, 9)).otherwise(body)
    return load(s, d, "events").select("event_id", routing.body_refusal(body, TODAY).alias("refused"))


@query(f"""with n as (select s_suppkey as node_id, s_suppkey * 7919 % 20011 as nx, s_suppkey * 104729 % 20021 as ny from supplier),
  c as (select c_custkey as req_id, c_custkey * 31337 % 20011 as ox, c_custkey * 27644437 % 20021 as oy, (c_custkey * 31337 + c_custkey % 5 * 4001) % 20011 as dx, c_custkey * 27644437 % 20021 as dy from customer),
  p as (select req_id, 'o' as e, ox as x, oy as y from c union all select req_id, 'd', dx, dy from c),
  m as (select req_id, e, arg_min(node_id, (x - nx) * (x - nx) + (y - ny) * (y - ny) + node_id / 1e9::double) as node from p join n on abs(x - nx) <= 300 and abs(y - ny) <= 300 where (x - nx) * (x - nx) + (y - ny) * (y - ny) <= 90000 group by req_id, e)
  select req_id, o.node as origin, g.node as goal, o.node is null or g.node is null as far, coalesce(o.node = g.node, false) as same from c left join (from m where e = 'o') o using (req_id) left join (from m where e = 'd') g using (req_id)""")
def snapped_requests(s, d):
    """Customers ask for walks between two points: where each begins and ends, and which cannot be walked."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    nodes = load(s, d, "supplier").select(k.alias("node_id"), k.alias("pos"), dbl(k * 7919 % 20011).alias("x"), dbl(k * 104729 % 20021).alias("y"))
    x, y = c * 31337 % 20011, dbl(c * 27644437 % 20021)
    asked = load(s, d, "customer").select(c.alias("req_id"), dbl(x).alias("o_x"), y.alias("o_y"), dbl((c * 31337 + c % 5 * 4001) % 20011).alias("d_x"), y.alias("d_y"))
    out = routing.snap(asked, nodes)
    return out.select("req_id", "origin", "goal", F.coalesce(F.startswith("error", F.lit("a point")), F.lit(False)).alias("far"), F.coalesce(F.startswith("error", F.lit("the points")), F.lit(False)).alias("same"))


@query(f"""with d as ({DEPARTURES_SQL}), m as (select o_custkey, pos, pos % 1440 as tm from d), x as (select *, first_value(tm) over w as lo, last_value(tm) over w as hi from m window w as (partition by o_custkey order by pos rows between unbounded preceding and unbounded following)),
  s as (select *, case when hi > lo then {C.CHART_PAD!r}::double + (tm - lo) / (hi - lo)::double * ({C.CHART_WIDTH!r}::double - 2 * {C.CHART_PAD!r}::double) else {C.CHART_WIDTH!r}::double / 2 end as x from x),
  b as (select *, coalesce((lag(x) over (partition by o_custkey order by pos) + x) / 2, 0) as band_x, coalesce((x + lead(x) over (partition by o_custkey order by pos)) / 2, {C.CHART_WIDTH!r}::double) as till from s)
  select o_custkey, cast(row_number() over (partition by o_custkey order by pos) - 1 as int) as i, x, band_x, greatest(till - band_x, 0) as width from b""")
def chart_bands(s, d):
    """Where a customer's departures stand on the axis of a chart, and which part of it a click on each takes."""
    c = advice.chart(_departures(s, d), ["o_custkey"])
    return c.select("o_custkey", F.posexplode(F.arrays_zip("xs", "bands")).alias("i", "b")).select("o_custkey", "i", F.col("b.xs").alias("x"), F.col("b.bands.x").alias("band_x"), F.col("b.bands.width").alias("width"))


@query("""with q as (select p_partkey as k, row_number() over (order by sqrt(p_retailprice) * p_size desc, p_partkey) - 1 as pos from (from part where p_partkey % 3 <> 0 order by sqrt(p_retailprice) * p_size desc, p_partkey limit 2500))
  select min(pos) as pos from q where k % 2 = 0 and k % 5 <> 0""")
def resume_position(s, d):
    """Where a survey goes on whose odd rows are answered, and every fifth skipped."""
    q = survey.queue(_mass(s, d))
    numbered = q.agg(F.array_sort(F.collect_list(F.struct((-F.col("shadow_mass")).alias("m"), "osm_id"))).alias("q")).select(F.posexplode("q").alias("pos", "r"))  # at most 2500 rows
    rows = numbered.select(F.lit("way").alias("osm_element"), F.col("r.osm_id").alias("osm_id"), F.col("pos").cast("long").alias("pos"))
    done = load(s, d, "part").where("p_partkey % 2 = 1 or p_partkey % 5 = 0").select(F.lit("way").alias("osm_element"), F.col("p_partkey").alias("osm_id"))
    return survey.resume_at(rows, done)


@query("""select p_type, least(count(*), 40) as n, least(count(*), 40) as n_ids, true as own from part group by p_type""")
def class_samples(s, d):
    """At most forty parts of each type, each once, and each of its own type."""
    p = load(s, d, "part").select("p_partkey", "p_type")
    got = quality.hash_sample(p, "p_partkey", 40, ["p_type"]).join(p.withColumnRenamed("p_type", "true_type"), "p_partkey")
    return got.groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_partkey").alias("n_ids"), F.bool_and(F.col("p_type") == F.col("true_type")).alias("own"))


@query("""with t as (select *, row_number() over (order by sqrt(p_retailprice) * p_size desc, p_partkey) as r from part), u as (from t where r <= 1000), k as (select p_type as kind, count(*) as n from u group by p_type order by n desc, kind limit 4)
  select (select count(*) from u) as n, (select median(p_retailprice::double) from u) as median, (select string_agg(concat(kind, ' ', n), ', ' order by n desc, kind) from k) as commonest""")
def top_thousand(s, d):
    """The thousand parts that cast most: the median of their areas and their commonest types."""
    out = quality.top_summary(_mass(s, d), "shadow_mass", "osm_id", "area_m2", "tag")
    return out.select("n", "median", F.array_join(F.transform("commonest", lambda k: F.concat(k["kind"], F.lit(" "), k["n"])), ", ").alias("commonest"))


@query("select p_partkey as osm_id, p_size::double as size from part order by p_size desc, p_partkey limit 1")
def tallest_part(s, d):
    return quality.tallest(_mass(s, d), "size", "osm_id").select("osm_id", "size")


@query("""with r as (select 0 as src, s_suppkey as pos, s_name as n from supplier where s_suppkey % 4 <> 0 union all select 1, p_partkey, p_name from part union all select 2, c_custkey, c_name from customer where c_custkey % 3 <> 0)
  select cast(row_number() over (order by src, pos) - 1 as int) as entry, n, case src when 0 then 'Street' when 1 then 'Building' else 'Place' end as d from r""")
def index_sources(s, d):
    """Suppliers as streets, parts as buildings and customers as places of one index; what has no name is left out."""

    def of(table, key, name, detail, where=True):
        return load(s, d, table).select(F.col(key).alias("pos"), F.when(where, F.col(name)).alias("name"), F.lit(detail).alias("detail"), F.lit(51.1).alias("lat"), F.lit(71.4).alias("lon"), F.array().cast("array<string>").alias("aliases"))

    rows = places.index_rows(of("supplier", "s_suppkey", "s_name", "Street", F.col("s_suppkey") % 4 != 0), of("part", "p_partkey", "p_name", "Building", F.lit(True)), of("customer", "c_custkey", "c_name", "Place", F.col("c_custkey") % 3 != 0))
    return places.entries(rows).select(F.col("entry").cast("int").alias("entry"), "n", "d")


@query("select p_partkey as entry, p_name as n, p_brand as d, 51 + p_partkey % 100 / 10000.0::double as lat, 71 + p_partkey % 77 / 10000.0::double as lon from part")
def index_read_back(s, d):
    """An index written as JSON and read as a client reads it."""
    k, path = F.col("p_partkey"), scratch(s, "index")
    e = load(s, d, "part").select(k.alias("entry"), F.col("p_name").alias("n"), F.col("p_brand").alias("d"), (51 + dbl(k % 100) / 10000).alias("lat"), (71 + dbl(k % 77) / 10000).alias("lon"), F.col("p_name").alias("c"), F.col("p_name").alias("l"))
    files.index_json(e).write.mode("overwrite").text(path)
    return files.read_index(s, path).select("entry", "n", "d", "lat", "lon")


_ALIASES = [(m["kind"], a, m["lat"], m["lon"], m["name"], m["icon"]) for m in C.LANDMARKS for a in m["aliases"]]
_MARK_SQL = ", ".join(f"({i}, '{a[0]}', '{a[1]}', {a[2]!r}::double, {a[3]!r}::double, '{a[4]}', '{a[5]}')" for i, a in enumerate(_ALIASES))


@query(f"""with a as (select * from (values {_MARK_SQL}) a(i, kind, alias, lat, lon, name, icon)), p as (select p_partkey as id, p_partkey % 4 as case_of, a.* from part join a on p_partkey % {len(_ALIASES)} = i)
  select id, case when case_of = 0 then name else alias end as name, case_of = 0 as landmark, case when case_of = 0 then icon end as icon, case when case_of = 0 then 0 end as priority, case when case_of = 0 then 11.5::double end as min_zoom from p""")
def landmark_places(s, d):
    """Parts by the names of the landmarks in all spellings: where they stand, two streets off, and, where they stand, as what they are not and under a longer name."""
    k = F.col("p_partkey")
    of = lambda j: F.element_at(F.array(*[F.lit(a[j]) for a in _ALIASES]), (k % len(_ALIASES) + 1).cast("int"))
    kind = F.when(k % 4 == 2, "Clinic").otherwise(F.initcap(of(0)))
    key = F.when(k % 4 == 3, F.concat(of(1), F.lit(" North"))).otherwise(of(1))
    rows = load(s, d, "part").select(F.lit(0).alias("src_rank"), k.alias("pos"), key.alias("name"), F.concat(kind, F.lit(" · x")).alias("detail"), (of(2) + F.when(k % 4 == 1, 0.002).otherwise(0.0003)).alias("lat"), of(3).alias("lon"), F.array().cast("array<string>").alias("aliases"))
    numbered = places.map_places(places.entries(rows))
    mark = F.col("icon").startswith("landmark-")
    return numbered.select(F.col("id").cast("long").alias("id"), F.regexp_replace("name", " North$", "").alias("name"), mark.alias("landmark"), F.when(mark, F.col("icon")).alias("icon"), F.when(mark, F.col("priority")).alias("priority"), F.when(mark, F.col("min_zoom")).alias("min_zoom"))


@query("""select p_partkey, x + t / 2 as px, y + h / 2 as py, true as centroid_outside from (select p_partkey, p_partkey * 37 % 2003 as x, p_partkey * 53 % 1999 as y, p_size + 40.0::double as h, 2.0::double as t from part)""")
def inner_points(s, d):
    """A point inside of courts that are open to the east, where the centroid is not."""
    k = F.col("p_partkey")
    x, y, w, h, t = dbl(k * 37 % 2003), dbl(k * 53 % 1999), dbl("p_size") + 30, dbl("p_size") + 40, F.lit(2.0)
    at = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    zero = F.lit(0.0)
    ring = F.array(at(zero, zero), at(w, zero), at(w, t), at(t, t), at(t, h - t), at(w, h - t), at(w, h), at(zero, h), at(zero, zero))
    p = tables.dealt(load(s, d, "part")).select("p_partkey", ring.alias("ring"), geo.point_inside(F.array(ring)).alias("p"), geo.ring_centroid(ring).alias("c"))
    return p.select("p_partkey", F.col("p.x").alias("px"), F.col("p.y").alias("py"), (~geo.in_ring(F.col("ring"), F.col("c.x"), F.col("c.y"))).alias("centroid_outside"))


@query("""select case when p_partkey % 3 = 0 then 'node' else 'way' end as element, p_partkey as id, p_name as name, case when p_partkey % 2 = 0 then p_type end as building, case when p_partkey % 5 = 0 then p_size::varchar end as levels, 'Point' as type,
    (p_partkey % 97)::double as x, (p_partkey % 89)::double as y from part where p_partkey % 7 <> 0""")
def tagged_features(s, d):
    """Parts as extracted features, one way of naming them or the other, some tags absent, some without a geometry."""
    k = F.col("p_partkey")
    element = F.when(k % 3 == 0, "node").otherwise("way")
    whole = F.concat(element, F.lit("/"), k)
    tags = F.struct(
        F.col("p_name").alias("name"), F.when(k % 2 == 0, F.col("p_type")).alias("building"), F.when(k % 5 == 0, F.col("p_size").cast("string")).alias("building:levels"),
        F.when(k % 4 == 0, element).alias("@type"), F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, whole).alias("@id"),
    )
    shape = F.when(k % 7 != 0, F.struct(F.lit("Point").alias("type"), F.array(dbl(k % 97), dbl(k % 89)).alias("coordinates")))
    text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.when(k % 4 > 1, whole).alias("id"), tags.alias("properties"), shape.alias("geometry")))
    out = geometry.tagged(load(s, d, "part").select(text.alias("feature")), "feature", ["name", "building", "building:levels"])
    p = F.col("geometry.rings")[0][0]
    return out.select("element", "id", "name", "building", F.col("building:levels").alias("levels"), F.col("geometry.type").alias("type"), p["x"].alias("x"), p["y"].alias("y"))


@query("""select s_suppkey as edge_id, '06:20' as stamp, case when s_suppkey % 2 = 0 then 0.5::double else 0 end as shade, 1441::bigint as n_minutes from supplier""")
def one_stamp_day(s, d):
    """A day of which the store has not every stamp is that of the stamp nearest to the walk: here one that only half of the edges were scored at, which is scored anew."""
    root, e = _store(s, d)
    again = lambda stamp: e.where("u % 2 = 0").select("edge_id", F.lit(0.5).alias("shade"))
    day = days.assemble(s, root, 1, dt.date(2024, 6, 1), e, ["06:00", "06:20", "07:00"], "06:30", again)
    n = day.clock.groupBy("stamp_idx").agg(F.count("*").alias("n_minutes"))
    return day.shade.join(n, "stamp_idx").select("edge_id", F.lit(day.stamps[0]).alias("stamp"), dbl("shade").alias("shade"), "n_minutes")


@query("""select s_suppkey as edge_id, i as stamp_idx, case when i = 0 then 0.5::double else 0.25 end as shade, n as n_minutes from supplier, (select unnest([0, 1]) as i, unnest([40, 41])::bigint as n) where i = 0 or s_suppkey % 7 <> 0""")
def whole_day(s, d):
    """Two stamps of a day, and for how many minutes each counts; scores above 1 left out."""
    root, e = _store(s, d)
    day = days.assemble(s, root, 1, dt.date(2024, 6, 1), e, ["06:00", "06:40"], "06:00")
    n = day.clock.groupBy("stamp_idx").agg(F.count("*").alias("n_minutes"))
    return day.shade.where("shade <= 1").join(n, "stamp_idx").select("edge_id", "stamp_idx", dbl("shade").alias("shade"), "n_minutes")


@query("select date '2024-06-01' as date, stamp, case stamp when '06:20' then half else n end as n from (select count(*) as n, count(*) filter (where s_suppkey % 2 = 0) as half from supplier), (select unnest(['06:00', '06:20', '06:40', '08:00']) as stamp)")
def pruned_store(s, d):
    """A store of two dates after the older one went: the date that is released, and its rows by stamp."""
    root, _ = _store(s, d)
    rows = scorestore.scan(s, root).where("stamp = '06:00'").withColumn("date", F.lit(dt.date(2024, 5, 31)))
    scorestore.save(rows, root)
    scorestore.prune(s, root, dt.date(2024, 6, 1))
    return scorestore.scan(s, root).where(F.col("date") == scorestore.release_date(s, root)).groupBy("date", "stamp").agg(F.count("*").alias("n"))
