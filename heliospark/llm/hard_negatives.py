"""Hard-negative mining by an inverted multi-index.

A vector's two halves each have a codebook of CODES points, fitted on a bounded sample (SAMPLE rows, first by
hash); the pair of nearest points is its cell. Every row is indexed: a task cuts the rows that it reads into parts of about PART
rows, sorts a part by cell, and writes it with the radius of each half's codes, the distance to the farthest of the
part's halves there.

A half-space bound of an anchor and a code is <q, c> + |q| r, and no row of a cell scores above the sum of its two. A
heap over the two falling lists (the multi-sequence) visits a part's cells by that sum. What is sought are the best rows
of windows of scores: [floor, any] for positives, of which the anchor's k best rows of its label are kept, and for
each positive [low, high] for the rows of other labels. A window is certified when the sum falls below its lower end, or below
the last of as many rows as it keeps; when all windows are, the part is done. Anchors of like codes share a heap in
groups of GROUP: their bound is the highest of theirs, and they stop together.

Anchors are taken in chunks of bounded size, which are sent to all tasks; a task goes through its parts with what it
has found so far. So no row is shuffled, a vector that a third of all rows hold is spread as they are, and
what moves is a few rows for each anchor, window and task. The result of each chunk is a table.

Defined cases: rows without an id or a label, or whose vector is null or holds a null, a non-finite or an overlong
component (vectors.LIMIT) take no part; a shorter vector counts as filled up with zeros; every row counts, repeated ones
too, as anchor and as candidate, but a row of the anchor's own id is never its positive or negative; equal scores
go by the smaller id; an anchor without positives gives no row; a window of a negative score is empty; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospark.llm import vectors as V
from heliospark.llm.shared import drop_tables, stored

#: Points of a half's codebook, rows it is fitted on, rows of a part, anchors of a chunk and of a group, rows multiplied at once.
CODES, SAMPLE, PART, ANCHORS, GROUP, STEP = 16, 2048, 4096, 8192, 32, 512
SLACK = 1e-9
LEAST, MOST = -(1 << 62), 1 << 62


def codebook(x: np.ndarray, codes: int = CODES, rounds: int = 8) -> np.ndarray:
    """Centres of x by a few rounds of k-means from rows spread over it."""
    x = np.unique(x.astype(np.float64), axis=0)
    if not len(x):
        return np.zeros((1, x.shape[1]))
    c = x[np.linspace(0, len(x) - 1, min(codes, len(x))).astype(int)]
    for _ in range(rounds):
        at = nearest(x, c)
        c = np.array([x[at == k].mean(0) if (at == k).any() else c[k] for k in range(len(c))])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) @ c.T - (c**2).sum(1) / 2).argmax(1)


class Part:
    """The rows of a part by cell, and each half's codes that occur, with their radii."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> None:
        half = books[0].shape[1]
        a, b = nearest(x[:, :half], books[0]), nearest(x[:, half:], books[1])
        cell = a * len(books[1]) + b
        order = np.argsort(cell, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.cuts = np.searchsorted(cell[order], np.arange(len(books[0]) * len(books[1]) + 1))
        self.wide = len(books[1])
        self.codes = []
        for c, at, y in ((books[0], a, x[:, :half]), (books[1], b, x[:, half:])):
            far = np.zeros(len(c))
            np.maximum.at(far, at, np.sqrt(((y - c[at]) ** 2).sum(1)))
            used = np.unique(at)
            self.codes.append((used, c[used], far[used]))

    def bounds(self, q: np.ndarray) -> list[np.ndarray]:
        """For each half, the highest bound of any of the anchors q with each code that occurs."""
        half, out = self.codes[0][1].shape[1], []
        for y, (_, c, far) in zip((q[:, :half], q[:, half:]), self.codes, strict=True):
            norm = np.sqrt((y**2).sum(1))[:, None]
            out.append((y @ c.T + norm * far + norm * (np.sqrt((c**2).sum(1)) + far) * SLACK + 1).max(0))
        return out

    def cells(self, q: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(bound, first row, row behind the last) of the part's cells, the highest bound first."""
        b1, b2 = self.bounds(q)
        o1, o2 = np.argsort(-b1, kind="stable"), np.argsort(-b2, kind="stable")
        b1, b2, u1, u2 = b1[o1].tolist(), b2[o2].tolist(), (self.codes[0][0][o1] * self.wide).tolist(), self.codes[1][0][o2].tolist()
        heap = [(-(b1[0] + b2[0]), 0, 0)]
        while heap:
            bound, i, j = heappop(heap)
            if j + 1 < len(b2):
                heappush(heap, (-(b1[i] + b2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(b1):
                heappush(heap, (-(b1[i + 1] + b2[0]), i + 1, 0))
            start, end = self.cuts[u1[i] + u2[j]], self.cuts[u1[i] + u2[j] + 1]
            if start < end:
                yield -bound, start, end


class Windows:
    """For windows (anchor, low, high, same label or not), the `keep` best (score, id) in each so far."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, keep: int) -> None:
        self.ids, self.labels, self.x, self.same, self.keep = ids, labels, x, same, keep
        order = np.argsort(anchor, kind="stable")  # windows of a group of anchors stand together
        self.order, self.anchor, self.low, self.high = order, anchor[order], low[order].copy(), high[order]
        self.need = self.low.copy()
        self.score, self.id = np.full((len(order), keep), LEAST, np.int64), np.full((len(order), keep), np.iinfo(np.int64).max)
        self.groups = [slice(*np.searchsorted(self.anchor, (a, a + GROUP))) for a in range(0, len(ids), GROUP)]
        self.top = int(np.abs(x).max(initial=0))

    def visit(self, part: Part) -> int:
        """Meets all anchors with a part; returns how many scores were counted."""
        done, y = 0, V.exact(part.x, max(self.top, int(np.abs(part.x).max(initial=0))))
        for w in self.groups:
            if w.start == w.stop:
                continue
            first, last = self.anchor[w.start], self.anchor[w.stop - 1] + 1
            q, spans, held = self.x[first:last].astype(y.dtype), [], 0
            open_ = self.low[w] <= self.high[w]
            if not open_.any():
                continue
            for bound, start, end in part.cells(q.astype(np.float64)):
                if bound < self.need[w][open_].min():
                    if not spans:
                        break
                    # rows already gathered may lie in a window
                    done += self.take(w, first, q, y, part, spans)
                    spans, held = [], 0
                    break
                spans.append(np.arange(start, end))
                held += end - start
                if held >= STEP:
                    done += self.take(w, first, q, y, part, spans)
                    spans, held = [], 0
            if spans:
                done += self.take(w, first, q, y, part, spans)
        return done

    def take(self, w: slice, first: int, q: np.ndarray, y: np.ndarray, part: Part, spans: list[np.ndarray]) -> int:
        rows = np.concatenate(spans)
        ids = part.ids[rows]
        s = (q @ y[rows].T).astype(np.int64)
        own = slice(first, first + len(q))
        fit = ((part.labels[rows][None] == self.labels[own][:, None]) == self.same) & (ids[None] != self.ids[own][:, None])
        s = np.where(fit, s, LEAST)[self.anchor[w] - first]
        inside = (s >= self.need[w][:, None]) & (s <= self.high[w][:, None])
        hit = np.flatnonzero(inside.any(1))
        if len(hit):
            at = hit + w.start
            s = np.hstack([self.score[at], np.where(inside[hit], s[hit], LEAST)])
            i = np.hstack([self.id[at], np.broadcast_to(ids, (len(hit), len(ids)))])
            by = np.lexsort((i, -s), axis=-1)[:, : self.keep]
            self.score[at], self.id[at] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)
            self.need[at] = np.maximum(self.low[at], self.score[at, -1])
        return len(q) * len(rows)


def indexed(rows: DataFrame, books: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """Parts (ids, labels, vectors) of rows (vec_id, label, v), each as large as PART if its task reads as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def part() -> pa.RecordBatch:
            ids, labels, x = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            p = Part(ids, labels, x, books)
            return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (p.ids, p.labels, p.x)], names=["ids", "labels", "vectors"])

        for b in batches:
            for at in range(0, b.num_rows, PART):
                c = b.slice(at, PART)
                held.append((np.asarray(c.column(0), np.int64), np.asarray(c.column(1), np.int64), V.lists_to_matrix(c.column(2), width)))
                if sum(len(h[0]) for h in held) >= PART:
                    yield part()
        if held:
            yield part()

    return rows.select("vec_id", "label", "v").mapInArrow(run, "ids binary, labels binary, vectors binary")


def windows_met(index: DataFrame, anchors: list, same: bool, keep: int, books: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """(anchor, win, vec_id, score): the best rows of each window, from each task; anchors are rows (anchor, vec_id, label, v, windows), windows a list of (win, low, high)."""
    sent = index.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = names = wins = None
        for b in batches:
            for row in b.to_pylist():
                if met is None:
                    x = np.frombuffer(b"".join(a[3] for a in sent.value), np.int32).reshape(-1, width)
                    half = books[0].shape[1]
                    order = np.lexsort((nearest(x[:, half:], books[1]), nearest(x[:, :half], books[0])))  # anchors of like codes share a heap
                    got = [sent.value[k] for k in order]
                    flat = [(k, *win) for k, a in enumerate(got) for win in a[4]]
                    if not flat:
                        return
                    at, wins, low, high = (np.array(c, np.int64) for c in zip(*flat, strict=True))
                    names = np.array([a[0] for a in got], object)
                    met = Windows(np.array([a[1] for a in got], np.int64), np.array([a[2] for a in got], np.int64), x[order], at, low, high, same, keep)
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                met.visit(Part(ids, labels, np.frombuffer(row["vectors"], np.int32).reshape(-1, width), books))
        if met is None:
            return
        r, c = np.nonzero(met.score > LEAST)
        for at in range(0, len(r), 100_000):
            i, j = r[at : at + 100_000], c[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(names[met.anchor[i]], pa.string()), pa.array(wins[met.order[i]], pa.int32()), pa.array(met.id[i, j]), pa.array(met.score[i, j])], names=["anchor", "win", "vec_id", "score"])

    best = index.mapInArrow(run, "anchor string, win int, vec_id long, score long")
    w = Window.partitionBy("anchor", "win").orderBy(F.desc("score"), "vec_id")
    out = stored(best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep))
    sent.unpersist()
    return out


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (vec_id, label, v).

    The negatives of an anchor and one of its positives have a score of low to high percent of the positive's."""
    spark, none = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width = rows.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], none)
    width = max(2, width)
    x, picked = V.sample(rows, SAMPLE, "code")
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    books = (codebook(x[:, : width // 2]), codebook(x[:, width // 2 :]))
    known, tags = np.array([r["vec_id"] for r in picked], np.int64), np.array([r["label"] for r in picked], np.int64)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors with the k-th best score that the sample has to offer."""
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                ids, labels, q = np.asarray(c.column(1), np.int64), np.asarray(c.column(2), np.int64), V.lists_to_matrix(c.column(3), width)
                y = V.exact(q, max(int(np.abs(q).max(initial=0)), int(np.abs(x).max(initial=0))))
                s = np.where((labels[:, None] == tags) & (ids[:, None] != known), (y @ x.astype(y.dtype).T).astype(np.int64), LEAST)
                floor = np.partition(s, len(x) - positives, axis=1)[:, len(x) - positives] if len(x) >= positives else np.full(len(q), LEAST)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), c.column(2), V.packed(q), pa.array(floor, pa.int64()), c.column(4)], names=["anchor", "vec_id", "label", "v", "floor", "chunk"])

    index = stored(indexed(rows, books, width))
    asked = rows.where(is_anchor)
    chunks = max(1, -(-asked.count() // ANCHORS))
    # rows that are equal in all have the same results: they are one anchor, counted
    keyed = asked.groupBy("vec_id", "label", "v").agg(F.count("*").alias("times")).select(F.sha2(F.concat_ws(":", "vec_id", "label", F.concat_ws(",", F.col("v").cast("array<string>"))), 256).alias("anchor"), "vec_id", "label", "v", F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)).cast("int").alias("chunk"), "times")
    keyed = stored(keyed)
    anchors = stored(keyed.select("anchor", "vec_id", "label", "v", "chunk").mapInArrow(floors, "anchor string, vec_id long, label long, v binary, floor long, chunk int"), "chunk")
    found = []
    for chunk in range(chunks):
        own = anchors.where(F.col("chunk") == chunk)
        got = [(r["anchor"], r["vec_id"], r["label"], bytes(r["v"]), [(0, r["floor"], MOST)]) for r in own.collect()]
        if not got:
            continue
        good = windows_met(index, got, True, positives, books, width)
        wins: dict[str, list] = {}
        for r in good.select("anchor", "rank", "score").collect():
            wins.setdefault(r["anchor"], []).append((r["rank"], -(-low * r["score"] // 100), high * r["score"] // 100))
        bad = windows_met(index, [(a, i, t, v, wins.get(a, [])) for a, i, t, v, _ in got], False, negatives, books, width)
        out = bad.select("anchor", "win", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        out = out.join(good.select("anchor", F.col("rank").alias("win"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor", "win"])
        out = out.join(keyed.where(F.col("chunk") == chunk).select("anchor", F.col("vec_id").alias("anchor_id"), "times"), "anchor")
        out = out.withColumn("one", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        found.append(stored(out).hs_path)
        drop_tables(spark, [good.hs_path, bad.hs_path])
    drop_tables(spark, [index.hs_path, keyed.hs_path, anchors.hs_path])
    return spark.read.schema(none).parquet(*found) if found else spark.createDataFrame([], none)


def report(embeddings: DataFrame) -> DataFrame:
    """The rows of the contract for op13."""
    e = embeddings.where("vec_id is not null and label is not null")
    e = e.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(V.whole_vectors(e, 256), F.col("vec_id") % 50 == 0)
