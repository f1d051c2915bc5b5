"""Exact top-k search by inner product with two cover trees, one over the queries and one over the data.

A node is a run of rows, a centre among them and the covering radius, the distance to its farthest row. Its
children's centres are the node's own centre and a net of rows none of which is within half the radius
of another; each row goes to the nearest. A node of few rows is a leaf, and children of very few rows are gathered to one leaf.

1. Centres of a bounded sample (PIVOTS rows, first by hash) cut the space into cells; every row, query or not, goes
to the cell of the nearest, and a cell's rows to blocks of about BLOCK by hash, so that a cell that holds a third of
all rows is as many blocks as others together. A task builds a block's tree; the blocks are written as a table.
2. Each query's scores against the sample give it a first floor under its k-th score. 3. Queries are taken in chunks
of bounded size, and a chunk's trees are sent to all tasks. A task walks them against the tree of each
of its blocks: a pair of nodes goes if <a, b> + |a| rb + |b| ra + ra rb, the best score any of its rows could
have, is below the worst k-th score of the query node's rows; leaves that are left are multiplied, which lifts those scores for
the blocks that follow. 4. The tasks' best are merged by rank.

So a task holds one chunk and one block, the driver one chunk; what moves is each vector once, and for each chunk
at most k rows of a query and task. A chunk's result is a table, which a lost executor doesn't undo.

Defined cases: rows whose vector is null or holds a null, a non-finite or an overlong component (vectors.LIMIT), and
rows without an id, take no part; a shorter vector counts as filled up with zeros; every row counts, repeated ones
too, as a query and as a candidate, but no candidate has its query's own id; equal scores go by the smaller id; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospark.llm import vectors as V
from heliospark.llm.shared import drop_tables, stored

#: Rows of the sample; of a block; queries of a chunk; rows of a leaf.
PIVOTS, BLOCK, QUERIES, LEAF = 2048, 2048, 16384, 64
#: Bounds are counted in doubles and widened by this part, and by one.
SLACK = 1e-9
FAR = -(1 << 62)
NODE = np.dtype([("start", "i4"), ("end", "i4"), ("centre", "i4"), ("first", "i4"), ("last", "i4"), ("radius", "f8")])


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows and the nodes (NODE) of a tree over the rows of x; node 0 is the root, and a node's children are those from first to last."""
    x = x.astype(np.float64)
    n, sq = len(x), (x * x).sum(1)
    dist = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * (x @ x.T), 0))
    middle = int(np.argmin(((x - x.mean(0)) ** 2).sum(1)))
    order, nodes, todo = np.arange(n), [(0, n, middle, -1, -1, float(dist[middle].max()))], [0]
    while todo:
        k = todo.pop()
        start, end, centre, _, _, radius = nodes[k]
        if end - start <= leaf or radius == 0:
            continue
        rows = order[start:end].copy()
        near = dist[centre, rows]
        net, nearest = [centre], np.zeros(len(rows), np.int32)
        while near.max() > radius / 2:
            far = int(near.argmax())
            net.append(int(rows[far]))
            d = dist[net[-1], rows]
            closer = d < near
            near, nearest = np.where(closer, d, near), np.where(closer, len(net) - 1, nearest)
        held = np.bincount(nearest, minlength=len(net))
        # children of few rows, neighbours in the order of their distance from the centre, share a leaf
        by = sorted(range(len(net)), key=lambda c: (held[c] < leaf // 4, dist[centre, net[c]]))
        groups: list[list[int]] = []
        for c in by:
            if held[c] < leaf // 4 and groups and held[groups[-1][0]] < leaf // 4 and sum(held[g] for g in groups[-1]) + held[c] <= leaf:
                groups[-1].append(c)
            else:
                groups.append([c])
        first, at = len(nodes), start
        for g in groups:
            own = rows[np.isin(nearest, g)]
            order[at : at + len(own)] = own
            nodes.append((at, at + len(own), net[g[0]], -1, -1, float(dist[net[g[0]], own].max())))
            at += len(own)
        if len(groups) == 1:  # the net fell into one leaf
            del nodes[first:]
            continue
        nodes[k] = (start, end, centre, first, len(nodes), radius)
        todo += range(first, len(nodes))
    out = np.array(nodes, NODE)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    out["centre"] = place[out["centre"]]
    return order, out


class Trees:
    """The trees of several blocks side by side, with their rows in the order of the nodes."""

    def __init__(self, blocks: list[tuple[bytes, bytes, bytes, bytes]], width: int) -> None:
        ids, vs, floors, nodes = (list(x) for x in zip(*blocks, strict=True))
        self.ids = np.frombuffer(b"".join(ids), np.int64)
        self.floor = np.frombuffer(b"".join(floors), np.int64).copy()
        x = np.frombuffer(b"".join(vs), np.int32).reshape(-1, width)
        self.top = int(np.abs(x).max(initial=0))
        self.x = x
        parts = [np.frombuffer(b, NODE).copy() for b in nodes]
        rows = np.cumsum([0, *(p["end"][0] for p in parts)])
        at = np.cumsum([0, *(len(p) for p in parts)])
        for p, r, k in zip(parts, rows, at, strict=False):
            for name in ("start", "end", "centre"):
                p[name] += r
            inner = p["first"] >= 0
            p["first"][inner] += k
            p["last"][inner] += k
        self.roots, self.nodes = at[:-1], np.concatenate(parts)
        self.centre = self.x[self.nodes["centre"]].astype(np.float64)
        self.norm = np.sqrt((self.centre**2).sum(1))

    def worst(self, floor: np.ndarray) -> np.ndarray:
        """For each node the least of its rows' floors: what a pair of nodes has to reach."""
        starts = self.nodes["start"]
        order = np.argsort(starts, kind="stable")
        edges = np.unique(np.r_[starts, self.nodes["end"]])[:-1]
        least = np.minimum.reduceat(floor, edges)
        a, b = np.searchsorted(edges, starts), np.searchsorted(edges, self.nodes["end"])
        out = np.empty(len(starts), np.int64)
        for k in order:
            out[k] = least[a[k] : b[k]].min()
        return out


def children(nodes: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the nodes k its children, and which of k each is from."""
    many = nodes["last"][k] - nodes["first"][k]
    of = np.repeat(np.arange(len(k)), many)
    return nodes["first"][k][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many), of


def leaf_pairs(q: Trees, d: Trees, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves that may hold a score not below the query's floor."""
    inner = q.centre @ d.centre.T
    a, b = np.repeat(q.roots, len(d.roots)), np.tile(d.roots, len(q.roots))
    ends = []
    while len(a):
        ra, rb = q.nodes["radius"][a], d.nodes["radius"][b]
        best = inner[a, b] + q.norm[a] * rb + d.norm[b] * ra + ra * rb
        stay = best + (q.norm[a] + ra) * (d.norm[b] + rb) * SLACK + 1 >= worst[a]
        a, b, ra, rb = a[stay], b[stay], ra[stay], rb[stay]
        la, lb = q.nodes["first"][a] < 0, d.nodes["first"][b] < 0
        both = la & lb
        ends.append((a[both], b[both]))
        split_a = ~la & (lb | (ra >= rb))
        split_b = ~both & ~split_a
        ca, of_a = children(q.nodes, a[split_a])
        cb, of_b = children(d.nodes, b[split_b])
        a, b = np.r_[ca, a[split_b][of_b]], np.r_[b[split_a][of_a], cb]
    return tuple(np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.zeros(0, int), np.zeros(0, int))


class Best:
    """The k best (score, id) of each query so far, better ones first."""

    def __init__(self, q: Trees, k: int) -> None:
        self.q, self.k, self.floor = q, k, q.floor.copy()
        self.score, self.id = np.full((len(q.ids), k), FAR, np.int64), np.full((len(q.ids), k), np.iinfo(np.int64).max)

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.where(ids[None] == self.q.ids[rows][:, None], FAR, scores)
        hit = (scores >= self.floor[rows][:, None]).any(1)
        if not hit.any():
            return
        rows, scores = rows[hit], scores[hit]
        s, i = np.hstack([self.score[rows], scores]), np.hstack([self.id[rows], np.broadcast_to(ids, scores.shape)])
        by = np.lexsort((i, -s), axis=-1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
        self.floor[rows] = np.maximum(self.floor[rows], self.score[rows, -1])


def search_block(q: Trees, qx: np.ndarray, d: Trees, best: Best) -> int:
    """Meets the queries with one block; returns how many scores were counted."""
    a, b = leaf_pairs(q, d, q.worst(best.floor))
    dx = d.x.astype(qx.dtype)
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]
    done = 0
    for part in np.split(np.arange(len(b)), np.flatnonzero(np.diff(b)) + 1):
        if len(part):
            node = d.nodes[b[part[0]]]
            rows = np.concatenate([np.arange(q.nodes["start"][n], q.nodes["end"][n]) for n in a[part]])
            span = slice(node["start"], node["end"])
            best.take(rows, (qx[rows] @ dx[span].T).astype(np.int64), d.ids[span])
            done += len(rows) * (node["end"] - node["start"])
    return done


def index(rows: DataFrame, is_query: Column, k: int, width: int) -> tuple[DataFrame, int]:
    """Blocks (query, chunk, block, ids, vectors, floors, nodes) of all rows (vec_id, v), and again of those that are queries, and the number of chunks."""
    spark = rows.sparkSession
    pivots, picked = V.sample(rows, PIVOTS, "pivot")
    known = np.array([r["vec_id"] for r in picked], np.int64)
    order, nodes = cover_tree(pivots)
    centres = pivots[order][nodes["centre"][nodes["first"] < 0]].astype(np.float64)
    top = int(np.abs(pivots).max(initial=0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(1) / 2
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                c = b.slice(at, 4096)
                x, ask = V.lists_to_matrix(c.column(1), width), np.asarray(c.column(2), bool)
                cell = (x.astype(np.float64)[:, : pivots.shape[1]] @ centres.T - half).argmax(1) if len(centres) else np.zeros(len(x), int)
                floor = np.full(len(x), FAR, np.int64)
                if ask.any() and len(pivots) > k:
                    q = V.exact(x[ask][:, : pivots.shape[1]], max(top, int(np.abs(x).max(initial=0))))
                    s = (q @ pivots.astype(q.dtype).T).astype(np.int64)
                    s[np.asarray(c.column(0))[ask][:, None] == known[None]] = FAR
                    floor[ask] = np.partition(s, len(pivots) - k, axis=1)[:, len(pivots) - k]
                yield pa.RecordBatch.from_arrays([c.column(0), V.packed(x), c.column(2), pa.array(cell, pa.int32()), pa.array(floor)], names=["vec_id", "v", "query", "cell", "floor"])

    placed = stored(rows.select("vec_id", "v", is_query.alias("query")).mapInArrow(place, "vec_id long, v binary, query boolean, cell int, floor long"))
    # at most a row for each cell, twice
    sides = placed.withColumn("query", F.lit(False)).unionByName(placed.where("query"))
    counts = sides.groupBy("query", "cell").count().withColumn("salts", F.ceil(F.col("count") / BLOCK).cast("int")).select("query", "cell", "salts", "count")
    chunks = max(1, -(-(counts.where("query").agg(F.sum("count")).first()[0] or 0) // QUERIES))
    salted = sides.join(F.broadcast(counts), ["query", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf["v"]), np.int32).reshape(-1, width)
        out = []
        for a in range(0, len(x), 2 * BLOCK):  # one block, unless many rows are the same
            order, nodes = cover_tree(x[a : a + 2 * BLOCK])
            order += a
            out.append((bool(key[0]), f"{key[1]}:{key[2]}:{a}", pdf["vec_id"].to_numpy(np.int64)[order].tobytes(), x[order].tobytes(), pdf["floor"].to_numpy(np.int64)[order].tobytes(), nodes.tobytes()))
        return pd.DataFrame(out, columns=["query", "block", "ids", "vectors", "floors", "nodes"])

    made = salted.groupBy("query", "cell", "salt").applyInPandas(build, "query boolean, block string, ids binary, vectors binary, floors binary, nodes binary")
    out = stored(made.withColumn("chunk", F.when(F.col("query"), F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")).otherwise(-1)), "chunk")
    drop_tables(spark, [placed.hs_path])
    return out, chunks


def top_k(rows: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row (vec_id, v) that is a query, the k rows of other ids with the highest inner products."""
    spark = rows.sparkSession
    schema = "block string, pos int, query_id long, vec_id long, score long"
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return rows.limit(0).selectExpr("vec_id as query_id", "int(0) as rank", "vec_id", "0L as score")
    blocks, chunks = index(rows, is_query, k, width)
    data, found = blocks.where("chunk = -1").select("ids", "vectors", "floors", "nodes"), []
    for chunk in range(chunks):
        got = blocks.where(F.col("chunk") == chunk).select("block", "ids", "vectors", "floors", "nodes").collect()
        if not got:
            continue
        sent = spark.sparkContext.broadcast([tuple(bytes(x) if i else x for i, x in enumerate(r)) for r in got])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q, best, qx = None, None, None
            for b in batches:
                for row in b.to_pylist():
                    if q is None:
                        q = Trees([x[1:] for x in sent.value], width)
                        best = Best(q, k)
                    d = Trees([(row["ids"], row["vectors"], row["floors"], row["nodes"])], width)
                    if qx is None or qx.dtype == np.float64:
                        qx = V.exact(q.x, max(q.top, d.top))
                    search_block(q, qx, d, best)
            if q is None:
                return
            pos = np.concatenate([np.arange(len(x[1]) // 8) for x in sent.value])
            block = np.repeat(np.array([x[0] for x in sent.value], object), [len(x[1]) // 8 for x in sent.value])
            row, col = np.nonzero(best.score > FAR)
            for at in range(0, len(row), 100_000):
                r, c = row[at : at + 100_000], col[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(block[r], pa.string()), pa.array(pos[r], pa.int32()), pa.array(q.ids[r]), pa.array(best.id[r, c]), pa.array(best.score[r, c])], names=["block", "pos", "query_id", "vec_id", "score"])

        w = Window.partitionBy("block", "pos").orderBy(F.desc("score"), "vec_id")
        ranked = data.mapInArrow(run, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        found.append(stored(ranked.select("query_id", "rank", "vec_id", "score")).hs_path)
        sent.unpersist()
    drop_tables(spark, [blocks.hs_path])
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*found) if found else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def report(embeddings: DataFrame) -> DataFrame:
    """The rows of the contract for op12."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null")
    return top_k(V.whole_vectors(e, 256), F.col("vec_id") % 50 == 0)
