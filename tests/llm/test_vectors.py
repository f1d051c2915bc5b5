"""Operators 11 to 13 against loops over all pairs."""

import hashlib

import duckdb
import numpy as np
import pytest

from heliospark.llm import centroids, cover_tree, hard_negatives, oracles
from heliospark.llm import vectors as V

KIND = "vec_id long, embedding array<float>, label int, v string, distance int, rank int, chunk int"


def rows_of(vectors, labels=None):
    return [(i, None if v is None else [None if x is None else float(x) for x in v], (labels or {}).get(i, i % 4), "v", 1, 2, 3) for i, v in enumerate(vectors)]


def some(seed, n, dims=64, spread=0.05):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 0.3, (6, dims))
    x = (middle[r.integers(0, 6, n)] + r.normal(0, spread, (n, dims))).astype(np.float32)
    x[n // 3 : n // 3 + n // 4] = x[0]  # one vector of a quarter of all rows
    return x.tolist()


def hard(n=600, dims=64):
    x = some(5, n, dims)
    x[7], x[50], x[51][3], x[100][0], x[101][5], x[102][2] = None, [], None, float("nan"), float("inf"), 1e30
    return x


def used(rows, factor):
    return [(i, np.floor(np.float64(v) * factor).astype(np.int64)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) and abs(x * factor) <= V.LIMIT for x in np.float32(v).tolist())]


def lloyd(rows, k=8, rounds=10):
    kept = [(i, v) for i, v in used(rows, 1024) if len(v) == 64]
    x = np.array([v for _, v in kept])
    first = sorted(range(len(kept)), key=lambda r: (hashlib.sha256(f"3:{kept[r][0]}".encode()).hexdigest(), tuple(x[r])))[:k]
    m = x[first]
    for r in range(rounds + 1):
        d = ((x[:, None] - m[None]) ** 2).sum(2)
        at = d.argmin(1)
        if r < rounds:
            m = np.array([x[at == c].sum(0) // (at == c).sum() if (at == c).any() else m[c] for c in range(len(m))])
    return sorted((kept[r][0], int(at[r]), int(d[r, at[r]])) for r in range(len(kept))), m


def fill(v, width):
    return np.r_[v, np.zeros(width - len(v), np.int64)]


def pairs_of(rows):
    kept = used(rows, 256)
    width = max((len(v) for _, v in kept), default=0)
    return [i for i, _ in kept], np.array([fill(v, width) for _, v in kept]).reshape(len(kept), width)


def best(rows, k=5):
    ids, x = pairs_of(rows)
    out = []
    for a in [r for r, i in enumerate(ids) if i % 50 == 0]:
        found = sorted((-int(s), i) for i, s in zip(ids, x @ x[a], strict=True) if i != ids[a])[:k]
        out += [(ids[a], r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def mined(rows):
    tag = {i: (t + 1) % 10 if i % 7 == 0 else t for i, _, t, *_ in rows if i is not None and t is not None}
    ids, x = pairs_of([r for r in rows if r[0] is not None and r[2] is not None])
    out = []
    for a in [r for r, i in enumerate(ids) if i % 50 == 0]:
        s = sorted((-int(s), i) for i, s in zip(ids, x @ x[a], strict=True) if i != ids[a])
        for p, pid in [(-s, i) for s, i in s if tag[i] == tag[ids[a]]][:5]:
            good = [(-s, i) for s, i in s if tag[i] != tag[ids[a]] and 50 * p <= -100 * s <= 95 * p][:3]
            out += [(ids[a], pid, r + 1, i, p, s) for r, (s, i) in enumerate(good)]
    return sorted(out)


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, KIND).repartition(parts)


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


OP11, OP12, OP13 = ("vec_id", "cluster", "distance"), ("query_id", "rank", "vec_id", "score"), ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def test_centroids_match_lloyd(spark):
    rows = [*rows_of(hard()), (-3, [0.1] * 64, 1, "", 0, 0, 0), (601, [0.5] * 63, 1, "", 0, 0, 0)]
    want, m = lloyd(rows)
    df = centroids.report(frame(spark, rows))
    assert got(df, *OP11) == want
    by = {c: sum(d for _, a, d in want if a == c) for c in range(8)}
    for r in df.collect():
        assert (r["cluster_inertia"], r["inertia"]) == (by[r["cluster"]], sum(by.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, m[r["cluster"]])).encode()).hexdigest()


def test_bounds_spare_scans_and_keep_the_result(spark):
    rows = rows_of(some(11, 900, spread=0.1))
    out, centres, scans = centroids.cluster(frame(spark, rows).select("vec_id", "embedding"))
    want, m = lloyd(rows)
    assert got(out, *OP11) == want and (centres == m).all()
    assert scans[0] == 900 and sum(scans[1:]) < 0.5 * 900 * 10


def test_loosening_bounds_the_drift():
    """No point of the sphere loses more distance than the plane allows, and the plane allows less than the drift."""
    r = np.random.default_rng(3)
    tighter = 0
    for _ in range(200):
        old, new = r.normal(0, 5, (2, 3)), None
        new = old + r.normal(0, 2, (2, 3))
        radius = np.array([r.uniform(0, 4), 0])
        most = centroids.loosening(old, new, radius)[0]
        x = r.normal(size=(3000, 3))
        x = old[0] + x / np.linalg.norm(x, axis=1)[:, None] * radius[0] * r.uniform(0, 1, (3000, 1)) ** (1 / 3)
        lost = np.linalg.norm(x - old[1], axis=1) - np.linalg.norm(x - new[1], axis=1)
        assert lost.max() <= most + 1e-9
        tighter += most < np.linalg.norm(new[1] - old[1]) * 0.99
    assert tighter > 50


@pytest.mark.parametrize("rows", [[], [(0, None, 1, "", 0, 0, 0)], [(0, [0.5] * 64, 1, "", 0, 0, 0)], rows_of([[0.25] * 64] * 60), rows_of(some(3, 5))])
def test_few_rows(spark, rows):
    df = frame(spark, rows, 1)
    assert got(centroids.report(df), *OP11) == (lloyd(rows)[0] if used(rows, 1024) else [])
    assert got(cover_tree.report(df), *OP12) == best(rows)
    assert got(hard_negatives.report(df), *OP13) == mined(rows)


def test_repeated_rows_and_ids(spark):
    x = some(8, 120)
    rows = [*rows_of(x), (0, x[0], 0, "", 0, 0, 0), (50, x[3], 2, "", 0, 0, 0), (7, x[7], 3, "", 0, 0, 0), (None, x[1], 1, "", 0, 0, 0)]
    df = frame(spark, rows)
    assert got(cover_tree.report(df), *OP12) == best(rows)
    assert [r[0] for r in got(centroids.report(df.where("vec_id is not null")), *OP11)] == sorted(r[0] for r in rows if r[0] is not None)
    assert sum(r["vec_id"] is None for r in centroids.report(df).collect()) == 1


def test_search_matches_all_pairs(spark, monkeypatch):
    for name, value in (("PIVOTS", 40), ("BLOCK", 64), ("QUERIES", 5), ("LEAF", 8)):
        monkeypatch.setattr(cover_tree, name, value)
    rows = [*rows_of(hard()), (650, [0.5] * 3, 1, "", 0, 0, 0), (-50, [1.0] * 70, 1, "", 0, 0, 0)]
    assert got(cover_tree.report(frame(spark, rows)), *OP12) == best(rows)


def test_search_with_large_components(spark):
    r = np.random.default_rng(2)
    rows = rows_of((r.normal(0, 1e5, (200, 8))).astype(np.float32).tolist())
    assert got(cover_tree.report(frame(spark, rows)), *OP12) == best(rows)
    assert got(hard_negatives.report(frame(spark, rows)), *OP13) == mined(rows)


def test_tree_covers_and_prunes():
    x = np.floor(256 * np.array(some(21, 1500, 16, 0.02))).astype(np.int64)
    order, nodes = cover_tree.cover_tree(x, 16)
    assert sorted(order) == list(range(1500))
    y = x[order]
    for n in nodes:
        assert np.sqrt(((y[n["start"] : n["end"]] - y[n["centre"]]) ** 2).sum(1)).max() <= n["radius"] + 1e-6
        if n["first"] >= 0:
            kids = nodes[n["first"] : n["last"]]
            assert sorted((k["start"], k["end"]) for k in kids)[0][0] == n["start"] and kids["end"].max() == n["end"] and (kids["end"] - kids["start"]).sum() == n["end"] - n["start"]
    q = np.flatnonzero(np.arange(1500) % 10 == 0)
    qo, qn = cover_tree.cover_tree(x[q], 16)
    make = lambda ids, v, n: cover_tree.Trees([(ids.astype(np.int64).tobytes(), v.astype(np.int32).tobytes(), np.full(len(ids), cover_tree.FAR, np.int64).tobytes(), n.tobytes())], 16)
    a, d = make(q[qo], x[q][qo], qn), make(order, y, nodes)
    top = cover_tree.Best(a, 5)
    cover_tree.search_block(a, a.x.astype(np.float64), d, top)
    counted = cover_tree.search_block(a, a.x.astype(np.float64), d, cover_tree.Best(make(q[qo], x[q][qo], qn), 5)), cover_tree.search_block(a, a.x.astype(np.float64), d, top)
    assert counted[1] < 0.6 * counted[0]


def test_negatives_match_all_pairs(spark, monkeypatch):
    for name, value in (("SAMPLE", 40), ("PART", 50), ("ANCHORS", 4), ("GROUP", 3), ("STEP", 16), ("CODES", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = [*rows_of(hard(), {3: None, 100: 2}), (650, [0.5] * 3, 1, "", 0, 0, 0), (-50, [1.0] * 70, 1, "", 0, 0, 0), (700, [0.3], None, "", 0, 0, 0)]
    want = mined(rows)
    assert want and got(hard_negatives.report(frame(spark, rows)), *OP13) == want


def test_a_repeated_anchor_has_its_rows_again(spark):
    x = some(8, 120)
    rows = rows_of(x)
    once = got(hard_negatives.report(frame(spark, rows)), *OP13)
    twice = got(hard_negatives.report(frame(spark, [*rows, rows[50]])), *OP13)
    assert once == mined(rows) and [r for r in twice if r[0] == 50] == sorted(2 * [r for r in once if r[0] == 50])


def test_cells_come_by_falling_bounds_and_certify():
    x = np.floor(256 * np.array(some(31, 800, 8, 0.02))).astype(np.int64)
    books = (hard_negatives.codebook(x[:, :4]), hard_negatives.codebook(x[:, 4:]))
    part = hard_negatives.Part(np.arange(800), np.zeros(800, int), x, books)
    q = x[[5]].astype(np.float64)
    cells = list(part.cells(q))
    assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True)
    assert sorted(r for _, a, b in cells for r in range(a, b)) == list(range(800))
    assert all((part.x[a:b] @ q[0]).max() <= bound for bound, a, b in cells)
    w = hard_negatives.Windows(np.array([-1]), np.array([0]), x[[5]], np.array([0]), np.array([hard_negatives.LEAST]), np.array([hard_negatives.MOST]), True, 5)
    assert w.visit(part) < 800


@pytest.mark.parametrize("sql,op,cols", [(oracles.OP11, centroids, OP11), (oracles.OP12, cover_tree, OP12), (oracles.OP13, hard_negatives, OP13)])
def test_same_as_sql(spark, sql, op, cols):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql("create view embeddings as select * from '/root/testdata/sf0.001/embeddings.parquet'")
    rel = duck.sql(sql)
    out = op.report(df)
    assert sorted(rel.columns) == sorted(out.columns)
    assert sorted(tuple(r) for r in out.select(*rel.columns).collect()) == sorted(rel.fetchall())
