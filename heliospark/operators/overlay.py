"""Unions and differences of polygons, of any number of them, tile by tile.

Coordinates are rounded to UNIT. Parts are dealt to tiles; a tile of many edges is cut into
four, sixteen and so on, by their number; of one that is cut often, the cells that lie whole in one solid part are known without a sweep (`covered`). In a tile the heights of
all corners, crossings and border crossings cut its edges into slabs in which nothing crosses, and one sweep over all slabs at once
counts from west to east how many solid and how many soft parts hold what lies between two edges (each part by the even-odd rule).
Where that changes from one region to another is boundary: the slabs' edges, and along their heights what is in a region above and not below, or
the other way round. So the pieces always close, whatever was rounded. Pieces are joined to chains within the tile. What lies on a tile's border is
only said with its sign; the two sides are summed in a window along each border, and what cancels is no boundary. Chains that
cross tiles are joined to rings in rounds of joins (`rings.link`).

An edge's place on a border or at a height is the same whole number in every tile that asks, as it comes from the edge's own
corners in whole numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospark.functions import geo
from heliospark.operators import rings as R
from heliospark.operators.near import cells, small
from heliospark.sources.tables import dropped, stored

#: Metres of a unit; metres of a tile's side, edges above which it is cut, and how often it may be.
UNIT, TILE, MOST, CUTS = 1e-6, 64.0, 96, 5
#: Cuts from which on cells that one part covers are left out, and how many of them lie along a tile's side.
DEEP = 3
CELLS = 1 << DEEP
#: Edges of a stamp that is a tile of its own, how far in metres it may go (the square of that in units is far below the largest whole number), and how many of them a task takes.
FEW, REACH, EACH = 512, 500.0, 1_000
SOLID, SOFT = 1, 2
OUT = "kind int, region int, path array<struct<x:bigint,y:bigint>>, upright boolean, line long, p0 long, p1 long, sign int"


def ratio(a: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """a + num / den, rounded, in whole numbers; den above 0."""
    return a + (2 * num + den) // (2 * den)


def levels_of(e: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """All heights within the tile at which something begins, ends or crosses; e has rows (ax, ay, bx, by) with ay < by."""
    x0, y0, x1, y1 = box
    ax, ay, bx, by = e.T
    ys = [np.array([y0, y1]), ay, by]
    for line in (x0, x1):
        hit = (np.minimum(ax, bx) < line) & (np.maximum(ax, bx) > line)
        y = ay[hit] + (line - ax[hit]) * (by[hit] - ay[hit]) // (bx[hit] - ax[hit])
        ys += [y, y + 1]
    fx, fy, dx, dy = (ax - x0).astype(float), (ay - y0).astype(float), (bx - ax).astype(float), (by - ay).astype(float)
    for k in range(0, len(e), 256):
        i = slice(k, k + 256)
        turn = dx[i, None] * dy[None] - dy[i, None] * dx[None]
        wx, wy = fx[None] - fx[i, None], fy[None] - fy[i, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (wx * dy[None] - wy * dx[None]) / turn, (wx * dy[i, None] - wy * dx[i, None]) / turn
        a, b = np.nonzero((t > 0) & (t < 1) & (u >= 0) & (u <= 1) & (np.arange(len(e))[None] != np.arange(len(e))[i, None]))
        x = fx[i][a] + t[a, b] * dx[i][a]
        y = np.floor(fy[i][a] + t[a, b] * dy[i][a])[(x >= -2) & (x <= x1 - x0 + 2)].astype(np.int64) + y0
        ys += [y, y + 1]
    y = np.unique(np.concatenate(ys))
    return y[(y >= y0) & (y <= y1)]


def runs(key: list[np.ndarray]) -> np.ndarray:
    """Where in sorted rows a new key begins."""
    new = np.zeros(len(key[0]), bool)
    new[:1] = True
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sweep(part: np.ndarray, soft: np.ndarray, e: np.ndarray, box: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The boundary in a tile: edges (region, x, y, x, y, source), directed, and border pieces (region, upright, line, p0, p1, sign)."""
    x0, y0, x1, y1 = box
    up = e[:, 3] > e[:, 1]
    e = np.where(up[:, None], e, e[:, [2, 3, 0, 1]])
    y = levels_of(e, box)
    first, last = np.searchsorted(y, np.maximum(e[:, 1], y0)), np.searchsorted(y, np.minimum(e[:, 3], y1))
    many = np.maximum(last - first, 0)
    k = np.repeat(np.arange(len(e)), many)
    slab = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
    ax, ay, bx, by = e[k].T
    at = lambda h: np.clip(ratio(ax, (h - ay) * (bx - ax), by - ay), x0, x1)
    xb, xt = at(y[slab]), at(y[slab + 1])
    mid = xb + xt
    order = np.lexsort((k, mid, part[k], slab))
    k, slab, xb, xt, mid = k[order], slab[order], xb[order], xt[order], mid[order]
    starts = runs([slab, part[k]])
    enter = 1 - 2 * ((np.arange(len(k)) - np.repeat(starts, np.diff(np.r_[starts, len(k)]))) % 2)
    # all that is at one place counts at once
    order = np.lexsort((xt, xb, mid, slab))
    k, slab, xb, xt, enter = k[order], slab[order], xb[order], xt[order], enter[order]
    at_once = runs([slab, xb, xt])
    if not len(at_once):
        return np.zeros((0, 6), np.int64), np.zeros((0, 6), np.int64)
    hard = np.add.reduceat(np.where(soft[k], 0, enter), at_once)
    light = np.add.reduceat(np.where(soft[k], enter, 0), at_once)
    k, slab, xb, xt = k[at_once], slab[at_once], xb[at_once], xt[at_once]
    begin = runs([slab])
    size = np.diff(np.r_[begin, len(slab)])
    inner = lambda d: np.cumsum(d) - np.repeat((np.cumsum(d) - d)[begin], size)
    held = np.where(inner(hard) > 0, SOLID, np.where(inner(light) > 0, SOFT, 0))
    before = np.r_[0, held[:-1]]
    before[begin] = 0
    # what is open at the end of a slab ends at the border
    end = begin + size - 1
    open_ = held[end] != 0
    tail = end[open_]
    k, slab, left, right = np.r_[k, np.full(len(tail), -1)], np.r_[slab, slab[tail]], np.r_[before, held[tail]], np.r_[held, np.zeros(len(tail), np.int64)]
    xb, xt = np.r_[xb, np.full(len(tail), x1)], np.r_[xt, np.full(len(tail), x1)]
    turn = left != right
    k, slab, left, right, xb, xt = (c[turn] for c in (k, slab, left, right, xb, xt))
    edges, border = [], []
    yb, yt = y[slab], y[slab + 1]
    on = (xb == xt) & ((xb == x0) | (xb == x1))
    for region in (SOLID, SOFT):
        for side, sign in ((left, 1), (right, -1)):
            own = (side == region) & ~on
            a, b = np.stack([xb, yb], 1)[own], np.stack([xt, yt], 1)[own]
            if sign < 0:
                a, b = b, a
            edges.append(np.column_stack([np.full(len(a), region), a, b, k[own]]))
            own = (side == region) & on
            border.append(np.column_stack([np.full(own.sum(), region), np.ones(own.sum(), np.int64), xb[own], yb[own], yt[own], np.full(own.sum(), sign)]))
        # along a height: what is above and not below runs east, what is below and not above west
        step = (right == region).astype(np.int64) - (left == region)
        own = step != 0
        h, x, d = np.r_[slab[own], slab[own] + 1], np.r_[xb[own], xt[own]], np.r_[step[own], -step[own]]
        order = np.lexsort((x, h))
        h, x, d = h[order], x[order], d[order]
        place = runs([h, x]) if len(h) else np.zeros(0, int)
        if len(place):
            h, x, d = h[place], x[place], np.add.reduceat(d, place)
            total = np.cumsum(d)
            row = np.flatnonzero((total[:-1] != 0) & (h[1:] == h[:-1]))
            height, sign = y[h[row]], np.sign(total[row])
            rim = (height == y0) | (height == y1)
            border.append(np.column_stack([np.full(rim.sum(), region), np.zeros(rim.sum(), np.int64), height[rim], x[row][rim], x[row + 1][rim], sign[rim]]))
            row, height, sign = row[~rim], height[~rim], sign[~rim]
            a, b = np.where(sign > 0, x[row], x[row + 1]), np.where(sign > 0, x[row + 1], x[row])
            edges.append(np.column_stack([np.full(len(row), region), a, height, b, height, -2 - h[row]]))
    return np.concatenate(edges), np.concatenate(border)


def chains(edges: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(region, points) of edges joined end to end, to the left where several begin; corners inside one source edge are left out."""
    begins: dict[tuple, list[int]] = {}
    rows = edges.tolist()
    ends = set()
    for n, (region, ax, ay, bx, by, _) in enumerate(rows):
        begins.setdefault((region, ax, ay), []).append(n)
        ends.add((region, bx, by))
    out, used = [], [False] * len(rows)

    def follow(n: int) -> None:
        points, sources = [tuple(rows[n][1:3])], []
        while True:
            used[n] = True
            region, ax, ay, bx, by, source = rows[n]
            points.append((bx, by))
            sources.append(source)
            free = [m for m in begins.get((region, bx, by), ()) if not used[m]]
            if not free:
                break
            if len(free) > 1:
                back = np.arctan2(ay - by, ax - bx)
                turn = lambda m, back=back: (back - np.arctan2(rows[m][4] - rows[m][2], rows[m][3] - rows[m][1])) % (2 * np.pi) or 7.0
                free.sort(key=turn)
            n = free[0]
        kept = [points[0], *(p for p, a, b in zip(points[1:], sources, sources[1:], strict=False) if a != b), points[-1]]
        if points[0] == points[-1] and sources[0] == sources[-1] and len(kept) > 4:
            kept = [*kept[1:-1], kept[1]]
        out.append((region, kept))

    for n, (region, ax, ay, *_) in enumerate(rows):  # first those that begin where no other ends
        if not used[n] and (region, ax, ay) not in ends:
            follow(n)
    for n in range(len(rows)):
        if not used[n]:
            follow(n)
    return out


def boundary(parts: DataFrame, tile: float = TILE, most: int = MOST) -> DataFrame:
    """(stamp, region, path): boundary rings of the union of the solid parts and of what the soft ones add, of parts(stamp, soft, rings)."""
    side = max(1 << CUTS, round(tile / UNIT) >> CUTS << CUTS)
    to_unit = lambda v: F.round(v / UNIT).cast("long")
    edges = F.transform(geo.rings_edges(F.col("rings")), lambda e: F.struct(to_unit(e["a"]["x"]).alias("ax"), to_unit(e["a"]["y"]).alias("ay"), to_unit(e["b"]["x"]).alias("bx"), to_unit(e["b"]["y"]).alias("by")))
    p = parts.select("stamp", "soft", edges.alias("es")).dropDuplicates(["stamp", "soft", "es"]).where("size(es) > 0")
    low = lambda k: F.least(F.array_min(F.transform("es", lambda e: e[f"a{k}"])), F.array_min(F.transform("es", lambda e: e[f"b{k}"])))
    high = lambda k: F.greatest(F.array_max(F.transform("es", lambda e: e[f"a{k}"])), F.array_max(F.transform("es", lambda e: e[f"b{k}"])))
    p = stored(p.select("*", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1")).withColumn("part", F.monotonically_increasing_id()))
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    # how often a tile is cut follows from how many edges it would have
    dealt = p.select("stamp", "part", F.size("es").alias("n"), "x0", "y0", "x1", "y1", F.explode(cells(*box, side)).alias("base"))
    depth = F.least(F.lit(CUTS), F.greatest(F.lit(0), F.ceil(F.log(F.sum("n") / float(most)) / math.log(4)))).cast("int")
    cuts = dealt.groupBy("stamp", "base").agg(depth.alias("cut"))
    whole = stored(covered(p, side))
    # of a tile that is cut often, the cells that one solid part covers need no sweep: what lies in them is not read further
    masks = whole.withColumn("base", F.struct(*[F.floor(F.col(c) / CELLS).alias(c) for c in ("cx", "cy")])).groupBy("stamp", "base").agg(F.bit_or(_bit(F.col("cx"), F.col("cy"))).alias("mask"))
    cuts = stored(cuts.join(masks, ["stamp", "base"], "left").withColumn("mask", F.when(F.col("cut") >= DEEP, F.coalesce("mask", F.lit(0)))))
    fine = F.call_function("shiftright", F.lit(side), F.col("cut")).cast("long")
    spans = [F.greatest(F.floor(F.col(f"{k}0") / fine), F.call_function("shiftleft", F.col(f"base.c{k}"), F.col("cut"))) for k in "xy"], [F.least(F.floor(F.col(f"{k}1") / fine), F.call_function("shiftleft", F.col(f"base.c{k}") + 1, F.col("cut")) - 1) for k in "xy"]
    within = F.flatten(F.transform(F.sequence(spans[0][0], spans[1][0]), lambda cx: F.transform(F.sequence(spans[0][1], spans[1][1]), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    dealt = dealt.join(small(cuts), ["stamp", "base"])
    once = dealt.where("mask is null").select("stamp", "part", "cut", F.explode(within).alias("c"))
    # the cells that are left of the others, and how often each of them is cut again
    spans = [[F.greatest(F.floor(F.col(f"{k}0") / (side >> DEEP)), F.col(f"base.c{k}") * CELLS), F.least(F.floor(F.col(f"{k}1") / (side >> DEEP)), F.col(f"base.c{k}") * CELLS + CELLS - 1)] for k in "xy"]
    open_ = F.filter(F.flatten(F.transform(F.sequence(*spans[0]), lambda cx: F.transform(F.sequence(*spans[1]), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy"))))), lambda c: F.col("mask").bitwiseAND(_bit(c["cx"], c["cy"])) == 0)
    left = stored(dealt.where("mask is not null").select("stamp", "part", "n", "x0", "y0", "x1", "y1", F.explode(open_).alias("c")))
    again = F.least(F.lit(CUTS - DEEP), F.greatest(F.lit(0), F.ceil(F.log(F.sum("n") / float(most)) / math.log(4)))).cast("int")
    left = left.join(left.groupBy("stamp", "c").agg(again.alias("more")), ["stamp", "c"])
    part_of = lambda v: F.floor(v / F.call_function("shiftright", F.lit(side >> DEEP), F.col("more")))
    spans = [[F.greatest(part_of(F.col(f"{k}0")), F.call_function("shiftleft", F.col(f"c.c{k}"), F.col("more"))), F.least(part_of(F.col(f"{k}1")), F.call_function("shiftleft", F.col(f"c.c{k}") + 1, F.col("more")) - 1)] for k in "xy"]
    finer = F.flatten(F.transform(F.sequence(*spans[0]), lambda cx: F.transform(F.sequence(*spans[1]), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))
    dealt = once.unionByName(left.select("stamp", "part", (F.col("more") + DEEP).alias("cut"), F.explode(finer).alias("c")))
    s = F.call_function("shiftright", F.lit(side), F.col("cut")).cast("long")
    tiled = dealt.select("stamp", "part", "cut", "c", (F.col("c.cx") * s).alias("tx0"), (F.col("c.cy") * s).alias("ty0"), s.alias("s")).join(p.select("part", "soft", "es"), "part")
    e = tiled.select("stamp", "part", "soft", "cut", F.col("c.cx").alias("cx"), F.col("c.cy").alias("cy"), "tx0", "ty0", "s", F.explode("es").alias("e")).select("*", "e.*").drop("e")
    # edges to the west count, at the border; those above, below and to the east do not
    e = e.where("ay != by and least(ay, by) < ty0 + s and greatest(ay, by) > ty0 and least(ax, bx) <= tx0 + s")
    names, kinds = [x.split()[0] for x in OUT.split(", ")], parts.schema["stamp"].dataType.simpleString()

    def tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (x, y, size), g in pdf.groupby(["tx0", "ty0", "s"], sort=False):
            numbers, part = np.unique(g["part"].to_numpy(), return_inverse=True)
            cut, rim = sweep(part, g["soft"].to_numpy(bool), g[["ax", "ay", "bx", "by"]].to_numpy(np.int64), (x, y, x + size, y + size))
            out += [(0, region, [{"x": a, "y": b} for a, b in path], None, None, None, None, None) for region, path in chains(cut)]
            out += [(1, r, None, bool(u), line, a, b, sign) for r, u, line, a, b, sign in rim.tolist()]
        got = pd.DataFrame(out, columns=names)
        got.insert(0, "stamp", pdf["stamp"].iloc[0])
        return got.astype({c: "Int64" for c in ("line", "p0", "p1", "sign")} | {"upright": "boolean"})

    # a covered cell is a square of the solid region: its sides, with the signs that a sweep gives
    x, y, one = F.col("cx") * (side >> DEEP), F.col("cy") * (side >> DEEP), F.lit(side >> DEEP)
    sign = lambda v: F.lit(v).alias("sign")
    side_of = lambda upright, line, a, k: F.struct(F.lit(upright).alias("upright"), line.alias("line"), a.alias("p0"), (a + one).alias("p1"), sign(k))
    of_tile = lambda c: F.floor(F.col(c) / CELLS)
    squares = whole.withColumns({"bx": of_tile("cx"), "by": of_tile("cy")}).join(cuts.where("mask is not null").select("stamp", F.col("base.cx").alias("bx"), F.col("base.cy").alias("by")), ["stamp", "bx", "by"], "left_semi")
    squares = squares.select("stamp", F.explode(F.array(side_of(True, x, y, -1), side_of(True, x + one, y, 1), side_of(False, y, x, 1), side_of(False, y + one, x, -1))).alias("q")).select("stamp", F.lit(SOLID).alias("region"), "q.*")
    made = stored(e.withColumn("bx0", F.floor(F.col("cx") / 4)).withColumn("by0", F.floor(F.col("cy") / 4)).groupBy("stamp", "cut", "bx0", "by0").applyInPandas(tiles, f"stamp {kinds}, {OUT}"))
    line = ["stamp", "region", "upright", "line", "seg"]
    rim = made.where("kind = 1").select("stamp", "region", "upright", "line", "p0", "p1", "sign").unionByName(squares).withColumn("seg", F.floor((F.col("p0") + F.col("p1")) / 2 / side))
    turns = rim.select(*line, F.explode(F.array(F.struct(F.col("p0").alias("p"), F.col("sign").alias("d")), F.struct(F.col("p1").alias("p"), (-F.col("sign")).alias("d")))).alias("t")).groupBy(*line, "t.p").agg(F.sum("t.d").alias("d"))
    w = Window.partitionBy(*line).orderBy("p")
    net = turns.withColumn("sum", F.sum("d").over(w)).withColumn("to", F.lead("p").over(w)).where("sum != 0 and to is not null")
    at = lambda v: F.struct(F.when(F.col("upright"), F.col("line")).otherwise(F.col(v)).alias("x"), F.when(F.col("upright"), F.col(v)).otherwise(F.col("line")).alias("y"))
    sides = net.select("stamp", "region", F.when(F.col("sum") > 0, F.array(at("p"), at("to"))).otherwise(F.array(at("to"), at("p"))).alias("path"))
    out = R.link(made.where("kind = 0").select("stamp", "region", "path").unionByName(sides), ["stamp", "region"])
    dropped(made, p, whole, cuts, left)
    return out


def _bit(cx, cy):
    """A cell's bit among those of its tile."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (F.pmod(cx, F.lit(CELLS)) * CELLS + F.pmod(cy, F.lit(CELLS))).cast("int"))


def covered(p: DataFrame, side: int) -> DataFrame:
    """(stamp, cx, cy), distinct: the cells of side >> DEEP that lie whole in one solid convex part of p(stamp, soft, es, x0, y0, x1, y1).

    In a row of cells a convex part covers what it holds of the row's lower and upper line, so no cell is tried that is not covered.
    The ends are drawn in by two units for what is rounded."""
    cell = side >> DEEP
    turn = lambda e, f: (e["bx"] - e["ax"]).cast("double") * (f["by"] - f["ay"]).cast("double") - (e["by"] - e["ay"]).cast("double") * (f["bx"] - f["ax"]).cast("double")
    n = F.size("es")
    # one ring whose corners all turn the same way, and that goes round once: it rises and falls once
    nexts = F.concat(F.slice("es", 2, n), F.slice("es", 1, 1))
    turns = F.zip_with("es", nexts, turn)
    joined = F.forall(F.zip_with("es", nexts, lambda e, f: (e["bx"] == f["ax"]) & (e["by"] == f["ay"])), lambda x: x)
    rises = F.filter("es", lambda e: e["ay"] != e["by"])
    changes = F.size(F.filter(F.zip_with(rises, F.concat(F.slice(rises, 2, n), F.slice(rises, 1, 1)), lambda e, f: (e["by"] > e["ay"]) != (f["by"] > f["ay"])), lambda x: x))
    convex = joined & (F.forall(turns, lambda t: t >= 0) | F.forall(turns, lambda t: t <= 0)) & (changes == 2)
    row = F.explode(F.sequence(F.ceil(F.col("y0") / cell), F.floor(F.col("y1") / cell) - 1)).alias("cy")
    rows = p.where(~F.col("soft") & (n > 2) & (F.floor(F.col("y1") / cell) - 1 >= F.ceil(F.col("y0") / cell)) & (F.col("x1") - F.col("x0") > cell)).where(convex).select("stamp", "es", row)

    def at(y, up: bool):
        """Where the edges that rise, or fall, cross a height: (least, most)."""
        own = F.filter("es", lambda e: ((e["by"] > e["ay"]) if up else (e["by"] < e["ay"])) & (F.least(e["ay"], e["by"]) <= y) & (F.greatest(e["ay"], e["by"]) >= y))
        xs = F.transform(own, lambda e: e["ax"] + (e["bx"] - e["ax"]) * ((y - e["ay"]) / (e["by"] - e["ay"])))
        return F.array_min(xs), F.array_max(xs)

    lower, upper = F.col("cy") * cell, (F.col("cy") + 1) * cell
    ends = [at(y, up) for y in (lower, upper) for up in (True, False)]
    (a, b), (c, d) = ([F.least(ends[i][0], ends[i + 1][0]), F.greatest(ends[i][1], ends[i + 1][1])] for i in (0, 2))
    held = rows.select("stamp", "cy", F.ceil((F.greatest(a, c) + 2) / cell).alias("first"), (F.floor((F.least(b, d) - 2) / cell) - 1).alias("last"))
    return held.where("last >= first").select("stamp", F.explode(F.sequence("first", "last")).alias("cx"), "cy").distinct()


def layers(parts: DataFrame, tile: float = TILE, most: int = MOST) -> DataFrame:
    """(stamp, kind, ring, area): rings of the union of the solid parts, and of the soft parts' less the solid ones', of parts(stamp, soft, rings). Holes have a negative area."""
    return _measured(boundary(parts, tile, most))


def _measured(b: DataFrame) -> DataFrame:
    # stored, or a filter by area would put the straightening of a path in place of each of its corners
    straight = stored(b.select("stamp", F.when(F.col("region") == SOLID, "solid").otherwise("soft").alias("kind"), R.straightened(F.col("path")).alias("path")))
    return straight.where("size(path) > 3").select("stamp", "kind", R.in_metres(F.col("path"), UNIT).alias("ring"), (R.signed_area(F.col("path")) * UNIT * UNIT).alias("area"))


def layers_each(parts: DataFrame, few: int = FEW, reach: float = REACH) -> DataFrame:
    """layers() of very many stamps, most of which have few parts near each other: a stamp of up to `few` edges that goes no farther than `reach` is a tile
    of its own, whose chains are whole rings, and a task sweeps some EACH of them. The others are cut into tiles as ever."""
    parts = stored(parts)
    points = F.flatten("rings")
    over = lambda k, f: f(F.transform(points, lambda q: q[k]))
    of = parts.select("stamp", F.size(points).alias("n"), *[over(k, f).alias(f"{k}{i}") for k in "xy" for i, f in enumerate((F.array_min, F.array_max))])
    box = of.groupBy("stamp").agg(F.sum("n").alias("n"), *[f(f"{k}{i}").alias(f"{k}{i}") for k in "xy" for i, f in enumerate((F.min, F.max))])
    own = stored(box.where((F.col("n") <= few) & (F.col("x1") - F.col("x0") <= reach) & (F.col("y1") - F.col("y0") <= reach)).select("stamp"))
    to_unit = lambda v: F.round(v / UNIT).cast("long")
    edges = F.transform(geo.rings_edges(F.col("rings")), lambda e: F.struct(to_unit(e["a"]["x"]).alias("ax"), to_unit(e["a"]["y"]).alias("ay"), to_unit(e["b"]["x"]).alias("bx"), to_unit(e["b"]["y"]).alias("by")))
    e = parts.join(own, "stamp", "left_semi").withColumn("part", F.monotonically_increasing_id()).select("stamp", "part", "soft", F.explode(edges).alias("e")).select("stamp", "part", "soft", "e.*").where("ay != by")
    e = e.withColumn("lot", F.pmod(F.xxhash64("stamp"), F.lit(own.count() // EACH + 1)))

    def tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        stamp, _ = pd.factorize(pdf["stamp"])
        order = np.argsort(stamp, kind="stable")
        part, soft, at = pdf["part"].to_numpy()[order], pdf["soft"].to_numpy(bool)[order], pdf[["ax", "ay", "bx", "by"]].to_numpy(np.int64)[order]
        starts = runs([stamp[order]])
        rows, out = [], []
        for i, j in zip(starts, np.r_[starts[1:], len(order)], strict=True):
            x, y = at[i:j, [0, 2]], at[i:j, [1, 3]]
            # wider than the parts, so that nothing lies on its border
            cut, _ = sweep(np.unique(part[i:j], return_inverse=True)[1], soft[i:j], at[i:j], (x.min() - 1, y.min() - 1, x.max() + 1, y.max() + 1))
            got = chains(cut)
            rows += [order[i]] * len(got)
            out += [(region, [{"x": a, "y": b} for a, b in path]) for region, path in got]
        found = pd.DataFrame(out, columns=["region", "path"])
        found.insert(0, "stamp", pdf["stamp"].to_numpy()[rows])
        return found

    kind = parts.schema["stamp"].dataType.simpleString()
    small_ones = stored(e.groupBy("lot").applyInPandas(tiles, f"stamp {kind}, region int, path {R.PATH}"))
    rest = parts.join(own, "stamp", "left_anti")
    return _measured(small_ones.unionByName(boundary(rest).select("stamp", "region", "path")) if rest.limit(1).count() else small_ones)


def union(polygons: DataFrame) -> DataFrame:
    """(rings) of the union of polygons(rings): outer rings with their holes."""
    merged = layers(polygons.select(F.lit(0).alias("stamp"), F.lit(False).alias("soft"), "rings"))
    return R.polygons(merged.select("stamp", "ring", "area"), ["stamp"]).select("rings")


def difference(polygons: DataFrame, less: DataFrame) -> DataFrame:
    """(rings) of what polygons(rings) cover and less(rings) does not."""
    parts = polygons.select(F.lit(0).alias("stamp"), F.lit(True).alias("soft"), "rings").unionByName(less.select(F.lit(0).alias("stamp"), F.lit(False).alias("soft"), "rings"))
    return R.polygons(layers(parts).where("kind = 'soft'").select("stamp", "ring", "area"), ["stamp"]).select("rings")
