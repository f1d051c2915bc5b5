"""Centroid clustering, exact, with bounds that geometric drift tightening keeps close.

Each vector carries an upper bound of the distance to its centroid and a lower bound of that to any other. When
centroids have moved, the upper bound grows by its own centroid's drift. The lower bound shrinks by less than
the largest drift: all vectors of a cluster lie in the sphere around the old centroid whose radius is the
largest upper bound in it, and for each other centroid that moved from a to b the plane through a, b and the
sphere's centre says how far d(x, a) - d(x, b) can go in it: at the midpoint of a and b let t be the angle between
the direction of the move and the sphere's centre, and f the angle under which the sphere is seen; then the
difference is at most |b - a| * max(0, cos(max(0, t - f))), as a branch of a hyperbola lies within its asymptotes.
A vector whose upper bound is below its lower bound stays. For the others the distance to their own centroid is
counted, and if that does not settle it, all centroids are scanned in whole numbers, ties to the smaller one.

A round is one pass: a task reads vectors and bounds, writes them anew, and adds a row for each cluster with
the sums that changed, the count, and the largest upper bound. Only those rows, clusters x tasks of them, are gathered;
no vector is shuffled, and no cluster's size matters. The table of the round before is then deleted.

Defined cases: rows whose vector is null, of another length, or holds a null, a non-finite or an overlong
component (vectors.LIMIT) are not kept; each kept row counts, repeated ones too; a row with a null id is clustered
but starts no centroid; with fewer kept ids than clusters there are fewer clusters; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm import vectors as V
from heliospark.llm.shared import drop_tables, stored

#: Bounds are widened by this part, far more than doubles lose.
SLACK = 1e-9
STATE = "kind int, vec_id long, v binary, cluster int, upper double, lower double, distance long, n long, scanned long, sums array<long>"


def squares(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Squared distances of whole rows to a whole point, or to one point each."""
    d = x - centre
    return np.einsum("ij,ij->i", d, d)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, the most by which the distance to any other centroid can have shrunk for a vector in its sphere."""
    k, out = len(old), np.zeros(len(old))
    for i in range(k):
        for j in range(k):
            move = new[j] - old[j]
            drift = float(np.sqrt(move @ move))
            if j == i or not drift:
                continue
            to = old[i] - (old[j] + new[j]) / 2
            far = float(np.sqrt(to @ to))
            if far <= radius[i]:
                share = 1.0
            else:
                angle = np.arccos(np.clip((to @ move) / (far * drift), -1, 1)) - np.arcsin(radius[i] / far)
                share = max(0.0, np.cos(max(0.0, angle)))
            out[i] = max(out[i], drift * (share + SLACK))
    return out


def assigned(state: DataFrame, centres: np.ndarray, own: np.ndarray, loose: np.ndarray, last: bool) -> DataFrame:
    """The state after one assignment, and rows of kind 1 with what each task has to add to the clusters. Rows of the first state have no cluster yet."""
    k, dims = centres.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count, scanned, top, total = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.zeros(k, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            x = V.unpacked(b.column("v"), dims).astype(np.int64)
            was = np.asarray(b.column("cluster"), np.int64)
            c, known = np.maximum(was, 0), was >= 0
            upper = np.where(known, np.asarray(b.column("upper")) * (1 + SLACK) + own[c], np.inf)
            lower = np.where(known, np.asarray(b.column("lower")) * (1 - SLACK) - loose[c], 0.0)
            i = np.flatnonzero(~(upper < lower))
            upper[i] = np.sqrt(squares(x[i], centres[c[i]])) * (1 + SLACK)
            i = i[~(upper[i] < lower[i]) | ~known[i]]
            if len(i):
                d = np.stack([squares(x[i], m) for m in centres], 1)
                c[i] = d.argmin(1)
                upper[i] = np.sqrt(d[np.arange(len(i)), c[i]]) * (1 + SLACK)
                d[np.arange(len(i)), c[i]] = np.iinfo(np.int64).max
                lower[i] = np.sqrt(d.min(1)) * (1 - SLACK) if k > 1 else np.inf
                scanned += np.bincount(c[i], minlength=k)
            moved = np.flatnonzero(c != was)
            old = moved[was[moved] >= 0]
            for m in range(k):
                sums[m] += x[moved[c[moved] == m]].sum(0) - x[old[was[old] == m]].sum(0)
            count += np.bincount(c[moved], minlength=k) - np.bincount(was[old], minlength=k)
            np.maximum.at(top, c, upper)
            distance = squares(x, centres[c]) if last else np.zeros(len(x), np.int64)
            np.add.at(total, c, distance)
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(x), np.int32)), b.column("vec_id"), b.column("v"), pa.array(c, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance), none, none, pa.nulls(len(x), pa.list_(pa.int64()))], names=names
            )
        none = pa.nulls(k, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(k, np.int32)), none, pa.nulls(k, pa.binary()), pa.array(np.arange(k), pa.int32()), pa.array(top), pa.nulls(k, pa.float64()), pa.array(total), pa.array(count), pa.array(scanned), pa.array(sums.tolist(), pa.list_(pa.int64()))], names=names
        )

    names = [x.split()[0] for x in STATE.split(", ")]
    return state.select("vec_id", "v", "cluster", "upper", "lower").mapInArrow(run, STATE)


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, factor: int = 1024, dims: int = 64, seed: str = "3") -> tuple[DataFrame, np.ndarray, list[int]]:
    """Of rows (vec_id, embedding): (vec_id, cluster, distance, cluster_inertia, inertia) per kept row, the final centroids, and how many vectors each assignment had to scan.

    The centroids start as the k kept vectors whose ids come first by hash; repeats of an id are told apart by their components."""
    spark = rows.sparkSession
    kept = V.whole_vectors(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.size("embedding") == dims), factor)
    first = kept.where("vec_id is not null").orderBy(V.by_hash(F.col("vec_id"), seed), "v").limit(k).collect()
    if not first:
        none = kept.limit(0).selectExpr("vec_id", "int(0) as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia")
        return none, np.zeros((0, dims), np.int64), []
    centres = np.array([r["v"] for r in first], np.int64)
    k = len(centres)

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = V.lists_to_matrix(b.column(1), dims)
            n = len(x)
            yield pa.RecordBatch.from_arrays([b.column(0), V.packed(x), pa.array(np.full(n, -1, np.int32)), pa.array(np.zeros(n)), pa.array(np.zeros(n))], names=["vec_id", "v", "cluster", "upper", "lower"])

    state = kept.mapInArrow(to_bytes, "vec_id long, v binary, cluster int, upper double, lower double")
    sums, count, own, loose, scans, path = np.zeros((k, dims), object), np.zeros(k, object), np.zeros(k), np.zeros(k), [], None
    for r in range(rounds + 1):
        made = stored(assigned(state, centres, own, loose, r == rounds), "kind")
        told = made.where("kind = 1")
        for x in told.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum("col").alias("s")).collect():
            sums[x["cluster"], x["pos"]] += x["s"]
        radius, total = np.zeros(k), [0] * k
        scans.append(0)
        for x in told.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("upper").alias("top"), F.sum("scanned").alias("scanned"), F.sum("distance").alias("d")).collect():
            count[x["cluster"]] += x["n"]
            radius[x["cluster"]], total[x["cluster"]] = x["top"], x["d"]
            scans[-1] += x["scanned"]
        if path:
            drop_tables(spark, [path])
        state, path = made.where("kind = 0"), made.hs_path
        if r < rounds:
            new = np.array([[s // n for s in row] if (n := count[c]) else centres[c] for c, row in enumerate(sums)], np.int64)
            before, after = centres.astype(np.float64), new.astype(np.float64)
            own, loose = np.sqrt(((after - before) ** 2).sum(1)) * (1 + SLACK), loosening(before, after, radius)
            centres = new
    inertia = F.array(*[F.lit(int(x)).cast("long") for x in total])
    out = state.select("vec_id", "cluster", "distance", inertia[F.col("cluster")].alias("cluster_inertia"), F.lit(sum(total)).cast("long").alias("inertia"))
    return out, centres, scans


def report(embeddings: DataFrame) -> DataFrame:
    """The rows of the contract for op11."""
    out, centres, _ = cluster(embeddings)
    hashes = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centres]) if len(centres) else F.array(F.lit(""))
    return out.withColumn("centroid_sha256", hashes[F.col("cluster")])
