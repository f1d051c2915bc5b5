"""N-gram Jaccard join by vertical partitioning.

The global order of shingles is that of their hashes. It is cut into fragments, and a set is the sequence of
its parts in them. Two sets with 100 * intersection >= percent * union differ in at most
D = (100 - percent) * (sum of sizes) / (100 + percent) shingles, so of K fragments K - D at least agree in both.
Each set is cut by size class (K is about 1.5 D of the largest sets of a class), in its own class and in those
above that may hold a partner.

1. Equal sets become one node. 2. Each node's fragments meet those of all others. A node that shares fewer
than K - D fragments with anyone (its own D, less its empty fragments) has no partner and leaves; so do most
that share a passage and nothing else. A set with so many empty fragments that the bound says nothing sends
them too, and stays. What is left and shares a fragment is tied, and connected components are clusters.
3. Sets of a cluster meet in blocks of bounded size, where overlaps are counted fragment by fragment and
summed per pair; a block returns a spanning forest of its links. 4. Components of these are the result. No
pair is a row anywhere but where it is a link of a forest.

Defined cases: a null text is empty; a text without words has an empty set and is linked with nothing; a text
of fewer words than a shingle is one shingle; rows of one doc_id are one document; a null doc_id takes part in
no component (component_id is null unless other rows hold the same set); an empty table gives an empty
result; extra columns are not read by `classes`, and `keep_one` passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm import hashing as H
from heliospark.llm.components import components
from heliospark.llm.hashing import parts
from heliospark.llm.shared import small, stored

#: Sets in a block; signatures gathered in a task before they are sent.
BLOCK, HELD = 1024, 1_000_000
RATIO = 1.25


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    data, offsets = H.strings(texts)
    starts, ends, firsts = H.word_bounds(data, offsets)
    return H.shingles(H.word_hashes(data, starts, ends), firsts, size)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    a = int(np.add.reduce(H.mix(s + H.ODD[0]), dtype=np.uint64))
    b = int(np.bitwise_xor.reduce(H.mix(s * H.ODD[6]))) if len(s) else 0
    return tuple(x - (1 << 64) if x >> 63 else x for x in (a, b))


def differences(percent: int, both: int) -> int:
    """The most shingles in which two linked sets of `both` shingles together differ."""
    return (100 - percent) * both // (100 + percent)


def size_class(n: int, percent: int) -> list[tuple[int, int, int]]:
    """(class, fragments, agreeing ones that a partner needs) for the classes that a set of n shingles joins."""
    out, low, k = [], 1, 0
    while True:
        high = max(low, int(low * RATIO))
        if n * 100 < percent * low:
            return out
        d = differences(percent, 2 * high)
        if n <= high and d:
            fragments = d + 2 + ceil(d / 2)
            out.append((k, fragments, fragments - differences(percent, n + min(high, 100 * n // percent))))
        low, k = high + 1, k + 1


def signatures(s: np.ndarray, classes: list[tuple[int, int, int]]) -> list[tuple[int, int, np.ndarray]]:
    """For each class, (class, how many must be shared, a hash for each fragment); empty fragments are sent only where so many are empty that none that is not need agree."""
    out = []
    marked = H.mix(s * H.ODD[5])
    top = s >> np.uint64(32)
    for k, fragments, need in classes:
        scalar = lambda x: np.uint64((k + 1) * int(x) % 2**64)  # noqa: B023, E731
        at = ((top * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)  # not falling, as s is sorted
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sigs = H.mix(np.add.reduceat(marked, first) * H.ODD[3] + at[first].astype(np.uint64) * H.ODD[1] + scalar(H.ODD[2]))
        need -= fragments - len(first)
        if need < 1:
            empty = np.setdiff1d(np.arange(fragments), at[first]).astype(np.uint64)
            sigs, need = np.r_[sigs, H.mix(empty * H.ODD[4] + scalar(H.ODD[7]))], 1
        out.append((k, need, sigs))
    return out


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n, fp, fp2) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, 1):
                sets = sets_of(b.column(1), size)
                fp = [fingerprint(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([f[i] for f in fp], pa.int64()) for i in (0, 1))], names=["doc_id", "n", "fp", "fp2"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, fp long, fp2 long")


def narrow(sig: np.ndarray) -> bytes:
    """The upper five bytes of each hash, byte by byte. Fewer bits only add candidates, which the sets decide."""
    return np.ascontiguousarray(sig.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def wide(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(5, -1).T
    return out.view(">u8").ravel().astype(np.uint64)


def shared_fragments(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, node, cls, need): the fragments that some other node shares, per node and class."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_size: dict[int, list] = {}

    def send(members: list[tuple[int, int, int]], sigs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not sigs:
            return
        sig = np.concatenate(sigs)
        owner = np.repeat(np.arange(len(members), dtype=np.uint32), [len(x) for x in sigs])
        order = np.argsort(sig)
        sig, owner = sig[order], owner[order]
        # what a task's own nodes share is known here; one of them goes on, marked as counted, to meet other tasks'
        again = np.r_[False, sig[1:] == sig[:-1]]
        known = again | np.r_[again[1:], False]
        table = np.array([m[0] for m in members], np.int64)
        code = np.array([m[1] << 25 | m[2] for m in members], np.uint32)  # class and need
        rows: list[tuple] = []

        def row(shard: int, where: np.ndarray, counted: int) -> None:
            used, at = np.unique(owner[where], return_inverse=True)
            rows.append((shard, counted, table[used].tobytes(), code[used].tobytes(), narrow(sig[where]), at.astype(np.uint16 if len(used) <= 1 << 16 else np.uint32).tobytes()))

        at = np.flatnonzero(known)
        own = H.mix(table.view(np.uint64))[owner[at]] % np.uint64(shards)
        at = at[np.argsort(own, kind="stable")]
        for k, part in enumerate(np.split(at, np.cumsum(np.bincount(own.astype(np.int64), minlength=shards))[:-1])):
            if len(part):
                row(k, part, 2)
        for counted, mask in ((0, ~known), (1, known & ~again)):
            at = np.flatnonzero(mask)
            shard = ((sig[at] >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            cut = np.searchsorted(shard, np.arange(shards + 1))
            for k in range(shards):
                if cut[k] < cut[k + 1]:
                    row(k, at[cut[k] : cut[k + 1]], counted)
        for i in range(0, len(rows), 64):
            c = list(zip(*rows[i : i + 64], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.binary()) for x in c[2:])], names=["shard", "counted", "nodes", "codes", "sigs", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, sigs, held, seen = [], [], 0, set()
        for whole in batches:
            for b in parts(whole, 0):
                for s in sets_of(b.column(0), size):
                    if len(s) and (fp := fingerprint(s)[0]) not in seen:
                        seen.add(fp)
                        if len(s) not in by_size:
                            by_size[len(s)] = size_class(len(s), percent)
                        for k, need, sig in signatures(s, by_size[len(s)]):
                            members.append((fp, k, need))
                            sigs.append(sig)
                            held += len(sig)
                if held > HELD:
                    yield from send(members, sigs)
                    members, sigs, held, seen = [], [], 0, set()
        yield from send(members, sigs)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = [wide(x) for x in pdf["sigs"]]
        shift = np.cumsum([0, *(len(x) // 8 for x in pdf["nodes"])])
        at = np.concatenate([np.frombuffer(x, np.uint16 if len(x) == 2 * len(y) else np.uint32) + np.uint32(z) for x, y, z in zip(pdf["at"], sig, shift[:-1], strict=True)])
        nodes = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["nodes"]])
        code = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["codes"]])
        counted = np.repeat(pdf["counted"].to_numpy(np.int8), [len(x) for x in sig])
        sig = np.concatenate(sig)
        out = counted == 2
        rest = np.flatnonzero(~out)
        if len(rest):
            rest = rest[np.lexsort((nodes[at[rest]], sig[rest]))]
            s, n = sig[rest], nodes[at[rest]]
            new = np.r_[True, s[1:] != s[:-1]]
            group = np.cumsum(new) - 1
            # equal sets of several tasks are one node: they share nothing with themselves
            many = np.bincount(group, weights=new | np.r_[True, n[1:] != n[:-1]]) > 1
            out[rest[many[group] & (counted[rest] == 0)]] = True
        at = at[out]
        return pd.DataFrame({"sig": sig[out].view(np.int64), "node": nodes[at], "cls": (code[at] >> 25).astype(np.int32), "need": (code[at] & ((1 << 25) - 1)).astype(np.int32)})

    d = docs.select("text").mapInArrow(run, "shard int, counted int, nodes binary, codes binary, sigs binary, at binary")
    return d.groupBy("shard").applyInPandas(meet, "sig long, node long, cls int, need int")


def candidate_edges(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): nodes that share a fragment and may have a partner.

    A node's fragments meet in one task, which counts them, drops nodes that share too few, ties those of its own that agree,
    and sends on one node for each fragment; so a fragment of very many nodes is a row of each task and no more."""

    def able(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not got:
            return
        sig, node, cls, need = (np.concatenate(c) for c in zip(*got, strict=True))
        order = np.lexsort((sig, cls, node))
        sig, node, cls, need = sig[order], node[order], cls[order], need[order]
        new = np.r_[True, (node[1:] != node[:-1]) | (cls[1:] != cls[:-1])]
        once = new | np.r_[True, sig[1:] != sig[:-1]]  # a node of several tasks counts a fragment once
        group = np.cumsum(new) - 1
        keep = once & (np.bincount(group, weights=once)[group] >= need)
        sig, node = sig[keep], node[keep]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        first = np.r_[True, sig[1:] != sig[:-1]] if len(sig) else np.zeros(0, bool)
        same = np.flatnonzero(~first)
        tied = forest(node[same - 1], node[same])
        for kind, a, b in ((0, np.array(list(tied), np.int64), np.array(list(tied.values()), np.int64)), (1, sig[first], node[first])):
            for i in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[i : i + 100_000]), kind, np.int32)), pa.array(a[i : i + 100_000]), pa.array(b[i : i + 100_000])], names=["kind", "a", "b"])

    rows = stored(shared_fragments(docs, size, percent).repartition("node").mapInArrow(able, "kind int, a long, b long"), "kind")
    met = rows.where("kind = 1").groupBy("a").agg(F.array_sort(F.collect_list("b")).alias("n")).where("size(n) > 1")  # a row of each task at most
    across = met.select(F.explode(F.slice("n", 2, F.size("n") - 1)).alias("a"), F.col("n")[0].alias("b")).where("a != b")
    return rows.where("kind = 0").select("a", "b").unionByName(across).distinct()


def forest(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Each node of the edges and the least one of its component, but for those that are their own."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: top(x) for x in list(parent)}


def overlaps(sets: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """Intersection sizes of all pairs of a block: counted apart in each fragment of the shingles' order, and summed."""
    m = len(sets)
    total = np.zeros((m, m), np.float32 if max(map(len, sets)) < 1 << 24 else np.float64)
    shingle, owner = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(shingle, kind="stable")
    shingle, owner = shingle[order], owner[order]
    first = np.flatnonzero(np.r_[True, shingle[1:] != shingle[:-1]])
    width = np.diff(np.r_[first, len(shingle)])
    column = np.repeat(np.arange(len(first)), width)
    rare = np.repeat((width > 1) & (width <= 8), width)
    # shingles of a few sets: their pairs one by one; 8 at most for each
    for step in range(1, 8):
        hit = np.flatnonzero(rare[step:] & (column[step:] == column[:-step]))
        np.add.at(total, (owner[hit], owner[hit + step]), 1)
        np.add.at(total, (owner[hit + step], owner[hit]), 1)
    often = np.repeat(width > 8, width)
    column, owner = np.unique(column[often], return_inverse=True)[1] if often.any() else np.zeros(0, np.int64), owner[often]
    wide = max(64, cells // m)
    for low in range(0, int(column.max()) + 1 if len(column) else 0, wide):
        i, j = np.searchsorted(column, [low, low + wide])
        part = np.zeros((m, int(column[j - 1]) - low + 1), np.float32)
        part[owner[i:j], column[i:j] - low] = 1
        total += part @ part.T
    np.fill_diagonal(total, 0)
    return total


def links(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> dict[int, int]:
    n = np.array([len(s) for s in sets], np.float64)
    inter = overlaps(sets).astype(np.float64)
    x, y = np.nonzero(np.triu(100 * inter >= percent * (n[:, None] + n[None, :] - inter), 1))
    return forest(ids[x], ids[y])


def placed(reps: DataFrame, percent: int) -> DataFrame:
    """(doc_id, fp, fp2, block): each node of reps (doc_id, n, fp, fp2, cluster) goes to every block in which it may meet a partner.

    Clusters of up to BLOCK sets are one block. Larger ones are dealt by size, in steps as wide as partners may differ, and by
    hash; a block is then a pair of such groups of neighbouring steps."""
    width = log(100 / percent)
    r = reps.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int"))
    whole = r.groupBy("cluster").agg(F.count("*").alias("m"))
    steps = r.groupBy("cluster", "step").agg(F.ceil(F.count("*") / (BLOCK // 2)).cast("int").alias("c"))
    r = r.join(whole, "cluster").join(steps, ["cluster", "step"])
    up = steps.select("cluster", (F.col("step") - 1).alias("step"), F.col("c").alias("c_up"))
    down = steps.select("cluster", (F.col("step") + 1).alias("step"), F.col("c").alias("c_down"))
    r = r.join(up, ["cluster", "step"], "left").join(down, ["cluster", "step"], "left").withColumn("i", F.pmod(F.xxhash64("fp", "fp2"), F.col("c")).cast("int"))

    def keys(count, make):
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), make)).otherwise(F.array().cast("array<string>"))

    name = lambda s, i, t, j: F.concat_ws(":", F.col("cluster"), s, i, t, j)
    many = F.flatten(
        F.array(
            keys(F.col("c"), lambda j: name(F.col("step"), F.least(F.col("i"), j), F.col("step"), F.greatest(F.col("i"), j))),
            keys(F.coalesce("c_up", F.lit(0)), lambda j: name(F.col("step"), F.col("i"), F.col("step") + 1, j)),
            keys(F.coalesce("c_down", F.lit(0)), lambda j: name(F.col("step") - 1, j, F.col("step"), F.col("i"))),
        )
    )
    blocks = F.when(F.col("m") <= BLOCK, F.array(F.col("cluster").cast("string"))).otherwise(many)
    return r.select("doc_id", "fp", "fp2", F.explode(F.array_distinct(blocks)).alias("block"))


def link_forest(docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b): spanning forests of the links of each block, between doc_ids."""
    spark = docs.sparkSession
    to = stored(placed(reps, percent))
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), to.count() // (BLOCK * 2) + 1)
    per_doc = stored(to.groupBy("doc_id", "fp", "fp2").agg(F.collect_list("block").alias("blocks")))
    # only ids are ever broadcast: their blocks are wide, grow with the input, and meet the few texts that are left in a shuffle
    ids = small(stored(per_doc.select("doc_id").distinct()))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").join(per_doc.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "fp", "fp2", "blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, 1, 1 << 20):
                ids, fps, blocks = b.column(0).to_pylist(), list(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)), b.column(4).to_pylist()
                rows = [(k, i, s.tobytes()) for i, fp, ks, s in zip(ids, fps, blocks, sets_of(b.column(1), size), strict=True) if fingerprint(s) == fp for k in ks]
                for j in range(0, len(rows), 512):
                    c = list(zip(*rows[j : j + 512], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], names=["block", "doc_id", "items"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, int] = {}
        a, b = [], []
        for _, g in pdf.groupby("block", sort=False):
            g = g.drop_duplicates("items")  # rows that repeat a text; one id may have several texts
            if len(g) > 1:
                out = links(g["doc_id"].to_numpy(), [np.frombuffer(x, np.uint64) for x in g["items"]], percent)
                a += out
                b += out.values()
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    sent = text.mapInArrow(run, "block string, doc_id long, items binary").withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins)).cast("int"))
    return sent.groupBy("bin").applyInPandas(meet, "a long, b long")


def classes(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id."""
    d = stored(fingerprints(docs, size))
    reps = d.where("n > 0").groupBy("fp", "fp2").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"))
    clusters = components(candidate_edges(docs, size, percent))
    reps = stored(reps.join(clusters.select(F.col("node").alias("fp"), F.col("root").alias("cluster")), "fp", "left"))
    edges = link_forest(docs, reps.where("doc_id is not null and cluster is not null"), size, percent)
    several = stored(d.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.collect_set(F.struct("fp", "fp2")).alias("sets")).where("size(sets) > 1"))
    if several.limit(1).count():  # ids with several texts tie the documents that share one of these
        own = several.select(F.col("doc_id").alias("a"), F.explode("sets").alias("s")).select("a", "s.fp", "s.fp2")
        edges = edges.unionByName(own.join(reps.where("doc_id is not null").select("fp", "fp2", F.col("doc_id").alias("b")), ["fp", "fp2"]).select("a", "b"))
    roots = components(edges)
    named = reps.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("fp", "fp2", F.coalesce("root", "doc_id").alias("component_id"))
    full = d.where("n > 0").join(named, ["fp", "fp2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(d.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that share a component with a smaller doc_id; of repeated rows of one id, one stays."""
    found = stored(classes(docs, size, percent))
    drop = small(stored(found.where("doc_id != component_id").select(F.col("doc_id").alias("__hs_id")).distinct()))
    kept = docs.join(drop, docs["doc_id"] == drop["__hs_id"], "left_anti")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"]).unionByName(kept.where(F.col("doc_id").isNull()))
    return kept


def report(docs: DataFrame) -> DataFrame:
    """The rows of the contract for op1."""
    return classes(docs, size=4, percent=85)
