"""The place index: entries, near duplicates, ranking, map places."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospark.constants import LANDMARK_RADIUS, LANDMARKS, METRES_PER_DEGREE, SAME_PLACE, SEARCH_LIMIT
from heliospark.functions import text as T
from heliospark.functions.geo import flat_distance, line_at, line_length
from heliospark.operators.near import small
from heliospark.sources.tables import dropped, stored


def street_entries(streets: DataFrame) -> DataFrame:
    """(name, x, y) from streets(pos, name, coords): the middle of the longest piece of each name, of equally long ones the first."""
    named = streets.where(F.col("name").isNotNull()).withColumn("length", line_length(F.col("coords")))
    best = named.groupBy("name").agg(F.max_by("coords", F.struct(F.col("length"), (-F.col("pos")).alias("p"))).alias("coords"))
    return best.withColumn("m", line_at(F.col("coords"), 0.5)).select("name", F.col("m.x").alias("x"), F.col("m.y").alias("y"))


def index_rows(streets: DataFrame, buildings: DataFrame, venues: DataFrame | None = None) -> DataFrame:
    """Rows for `entries` from tables of (pos, name, detail, lat, lon, aliases): streets before buildings before places, each in its own order, those without a name left out. Without a table of places the index has none."""
    cols = ["pos", "name", "detail", "lat", "lon", "aliases"]
    ranked = [t.where("name is not null").select(F.lit(i).alias("src_rank"), *cols) for i, t in enumerate((streets, buildings, venues)) if t is not None]
    return reduce(DataFrame.unionByName, ranked)


def entries(rows: DataFrame) -> DataFrame:
    """rows(src_rank, pos, name, detail, lat, lon, aliases) as index entries in order of preference: n, d, lat, lon, c, l."""
    w = Window.orderBy("src_rank", "pos")
    keyed = rows.select(
        "src_rank", "pos", F.col("name").alias("n"), F.col("detail").alias("d"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), T.search_keys(F.col("name"), F.col("aliases"), T.fold).alias("c"), T.search_keys(F.col("name"), F.col("aliases"), T.latinise).alias("l")
    )
    return keyed.withColumn("entry", F.row_number().over(w) - 1).drop("src_rank", "pos")


def dedupe(rows: DataFrame, key: str = "c", order: str = "entry", lat: str = "lat", lon: str = "lon", within: float = SAME_PLACE) -> DataFrame:
    """rows without those that have a kept one of the same key within some metres and before them in order; degrees of longitude are narrowed at the later one's latitude.

    Keeping depends on what was kept before, which rounds of joins settle for all keys at once: places of one key and spot
    are one; each meets the earlier ones in its own and the eight cells around; one without an earlier neighbour is kept, its later neighbours
    go, and so on with what is left, until no pair is. Rows without a place are kept; order is taken to tell a key's rows apart."""
    spot = rows.select(F.coalesce(F.col(key), F.lit("")).alias("k"), F.col(lat).cast("double").alias("a"), F.col(lon).cast("double").alias("o"), F.col(order).alias("at")).where("a is not null and o is not null and not isnan(a) and not isnan(o)")
    n = stored(spot.groupBy("k", "a", "o").agg(F.min("at").alias("at")).withColumn("id", F.monotonically_increasing_id()))
    far = n.agg(F.max(F.abs("a"))).first()[0]
    wide = within / (METRES_PER_DEGREE * max(math.cos(math.radians(min(far or 0.0, 90.0))), 1e-9))
    cells_of = n.withColumn("cy", F.floor(F.col("a") * METRES_PER_DEGREE / within)).withColumn("cx", F.floor(F.col("o") / wide))
    around = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    early = cells_of.select("k", "cy", "cx", F.col("id").alias("early"), F.col("a").alias("b"), F.col("o").alias("p"), F.col("at").alias("before"))
    near = flat_distance(F.col("a"), F.col("o"), F.col("b"), F.col("p"), F.col("a")) <= within
    pairs = stored(cells_of.withColumn("cy", around("cy")).withColumn("cx", around("cx")).join(early, ["k", "cy", "cx"]).where((F.col("before") < F.col("at")) & near).select("early", F.col("id").alias("late")))
    kept = stored(n.select("id").join(pairs.select(F.col("late").alias("id")).distinct(), "id", "left_anti"))
    sure, all_kept, tables = kept, [kept], [pairs]
    while pairs.limit(1).count():
        gone = stored(pairs.join(sure.withColumnRenamed("id", "early"), "early").select(F.col("late").alias("id")).distinct())
        left = stored(pairs.join(gone.withColumnRenamed("id", "late"), "late", "left_anti").join(gone.withColumnRenamed("id", "early"), "early", "left_anti"))
        open_ = pairs.select(F.col("late").alias("id")).distinct().join(gone, "id", "left_anti")
        sure = stored(open_.join(left.select(F.col("late").alias("id")).distinct(), "id", "left_anti"))
        all_kept.append(sure)
        tables += [gone, left]
        pairs = left
    whole = stored(n.join(reduce(DataFrame.unionByName, all_kept), "id").select(F.col("k").alias("__k"), F.col("a").alias("__a"), F.col("o").alias("__o"), F.col("at").alias("__at")))
    dropped(n, *tables, *all_kept)
    a, o = F.col(lat).cast("double"), F.col(lon).cast("double")
    placed = rows.join(whole, (F.coalesce(F.col(key), F.lit("")) == F.col("__k")) & (a == F.col("__a")) & (o == F.col("__o")) & (F.col(order) == F.col("__at")), "left_semi")
    return placed.unionByName(rows.where(a.isNull() | o.isNull() | F.isnan(a) | F.isnan(o)))


def _grams(text, sizes: list[int]):
    """Array of structs (size, gram): all runs of characters of these lengths, each once."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.struct(F.lit(n).alias("size"), F.substring(text, i, F.lit(n)).alias("gram"))))
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(of(n), F.array().cast("array<struct<size:int,gram:string>>")) for n in sizes])))


def _holders(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, entry) where the text q of queries(query, script, q) is in the key of index(entry, script, key) of the same script: keys are cut into runs of three characters (fewer for
    shorter queries), each query's rarest run is joined, and what holds that is searched for the whole query."""
    q = queries.where("q != ''").withColumn("size", F.least(F.lit(3), F.length("q")))
    sizes = sorted(r[0] for r in q.select("size").distinct().collect())  # at most three
    if not sizes:
        return index.select(F.lit("").alias("query"), "entry").limit(0)
    asked = q.select("query", "script", "q", F.explode(_grams(F.col("q"), sizes)).alias("g"), "size").where("g.size = size").select("query", "script", "q", "g")
    runs = index.select("entry", "script", "key", F.explode(_grams(F.col("key"), sizes)).alias("g"))
    often = runs.join(small(asked.select("script", "g").distinct()), ["script", "g"], "left_semi").groupBy("script", "g").agg(F.count("*").alias("n"))
    rarest = asked.join(often, ["script", "g"], "left").groupBy("query", "script", "q").agg(F.min_by("g", F.struct(F.coalesce("n", F.lit(0)), F.col("g"))).alias("g"))
    return runs.join(small(stored(rarest)), ["script", "g"]).where(F.contains("key", "q")).select("query", "entry")


def rank(index: DataFrame, queries: DataFrame, limit: int = SEARCH_LIMIT) -> DataFrame:
    """(query, rank, entry, n, d, lat, lon) of the best `limit` entries that contain each query: at the start of a word first, then shorter names, then index order.

    A query that folds to nothing has no answers. Candidates come by their rarest run of characters, and ranks are cut before they are shuffled."""
    # an index numbered in one task is spread again
    index = stored(index.repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "entry"))
    q = stored(queries.select("query", T.fold(F.col("query"), T.DROP_UNDERSCORE).alias("qc"), T.latinise(F.col("query"), T.DROP_UNDERSCORE).alias("ql")).where("qc != '' or ql != ''").distinct())
    scripts = lambda c, l, name: F.explode(F.array(F.struct(F.lit("c").alias("script"), F.col(c).alias(name)), F.struct(F.lit("l").alias("script"), F.col(l).alias(name))))  # noqa: E731, E741
    found = _holders(index.select("entry", scripts("c", "l", "key").alias("x")).select("entry", "x.*"), q.select("query", scripts("qc", "ql", "q").alias("x")).select("query", "x.*")).distinct()
    by_script, by_latin = (F.col("qc") != "") & F.contains("c", "qc"), (F.col("ql") != "") & F.contains("l", "ql")
    lead = (by_script & T.starts_word(F.col("c"), F.col("qc"))) | (by_latin & T.starts_word(F.col("l"), F.col("ql")))
    w = Window.partitionBy("query").orderBy(F.desc("lead"), F.length("n"), "entry")
    hits = index.join(found, "entry").join(small(q), "query").withColumn("lead", lead).withColumn("rank", F.row_number().over(w))
    return hits.where(F.col("rank") <= limit).select("query", "rank", "entry", "n", "d", "lat", "lon")


def map_places(index: DataFrame) -> DataFrame:
    """entries as points of a map: (id, name, detail, icon, category, priority, min_zoom, lat, lon)."""
    kind = T.kind_of(F.col("d"))
    good = index.withColumn("kind", kind).where((F.col("kind") != "street") & (F.trim("n") != "") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    out = good.withColumn("category", T.category_of(F.col("kind")))
    keys = F.array(*[T.latinise(F.col(c), T.DROP_UNDERSCORE) for c in ("n", "c", "l")])
    which = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(LANDMARKS))):
        aliases = F.array(*[T.latinise(F.lit(a), T.DROP_UNDERSCORE) for a in m["aliases"]])
        near = flat_distance(F.col("lat"), F.col("lon"), F.lit(m["lat"]), F.lit(m["lon"]), F.lit(m["lat"])) <= LANDMARK_RADIUS
        which = F.when((F.col("kind") == m["kind"]) & near & F.arrays_overlap(keys, aliases), F.lit(i)).otherwise(which)
    out = out.withColumn("mark", which).withColumn("category", F.when(F.col("mark").isNotNull(), "landmark").otherwise(F.col("category")))
    seen = T.visibility_of(F.col("kind"), F.col("category"))
    named = lambda field, other: F.coalesce(*[F.when(F.col("mark") == i, m[field]) for i, m in enumerate(LANDMARKS)], other)
    return out.select(
        F.col("entry").alias("id"), named("name", F.trim("n")).alias("name"), F.col("d").alias("detail"), named("icon", F.concat(F.lit("poi-"), F.col("category"))).alias("icon"), "category",
        F.when(F.col("mark").isNotNull(), 0).otherwise(seen["priority"]).alias("priority"), F.when(F.col("mark").isNotNull(), 11.5).otherwise(seen["min_zoom"].cast("double")).alias("min_zoom"), "lat", "lon",
    )


def out_of_reach(points: DataFrame, lat: float, lon: float, reach: float) -> DataFrame:
    """points(lat, lon) with away and whether a walk cannot begin there."""
    from heliospark.functions.geo import haversine

    return points.withColumn("away", haversine(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))).withColumn("out_of_reach", F.col("away") > reach)
