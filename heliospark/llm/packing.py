"""Best-fit packing with swap-based local search.

Documents become token ids and a closing id; what is longer than a sequence is cut. Pieces of one length are
alike to a packer, so it works on the counts per length, a table no longer than the capacity: best-fit
decreasing gives classes of equally filled sequences, and a local search then moves pieces, or exchanges one
for one, two for one or one for two, between underfull sequences wherever the sum of squared fills grows,
until no exchange helps or the bound total / capacity is met. An index tells for each sum of one or two pieces
which classes hold it and how much room they have, so a class finds its exchange by its own pieces. Each piece finds its place by its rank among
the pieces of its length; ranks are counted in buckets, so that no task holds all pieces of a length.

Defined cases: a null text is empty, and an empty one still has the closing id; repeated rows are packed one
by one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
import json
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospark.llm.hashing import parts
from heliospark.llm.shared import stored

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


@functools.lru_cache(2)
def tokenizer(path: str):
    """encode(text) -> ids, as the tokenizers library gives them without special tokens added."""
    import tiktoken
    from tokenizers import Tokenizer

    exact: list = []  # read only if a text needs it
    spec = json.load(open(path, encoding="utf-8"))
    added = [t["content"] for t in spec.get("added_tokens", [])]
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    plain_split = spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"] and spec["model"]["type"] == "BPE"
    if not plain_split or any(spec["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        # another way of splitting than the one below
        other = Tokenizer.from_file(path)
        return lambda text: other.encode(text, add_special_tokens=False).ids
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added):
            if not exact:
                exact.append(Tokenizer.from_file(path))
            return exact[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, closing_id: int = 2, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document's first piece takes what is left over by the others."""
    d = docs.select("doc_id", "text")
    out = PIECES.format(id=d.schema["doc_id"].dataType.simpleString()) + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path)
        for b in (p for whole in batches for p in parts(whole, 1)):
            rows: list[list] = [[] for _ in range(5 + with_ids)]
            at = []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), closing_id], dtype="<u4")
                start, n = 0, len(ids)
                size = n if n <= capacity else n % capacity or capacity
                k = 0
                while start < n:
                    part = ids[start : start + size]
                    at.append(i)
                    for x, v in zip(rows[1:], (k, start, len(part), zlib.crc32(part.tobytes()), part.astype("<i4")), strict=False):
                        x.append(v)
                    start, k, size = start + len(part), k + 1, capacity
            cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(rows[5], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return d.mapInArrow(run, out)


Classes = Counter  # tuple of lengths, longest first -> how many sequences are filled so


def best_fit(counts: dict[int, int], capacity: int) -> Classes:
    """Best-fit decreasing over counts per length; many equal sequences are filled in one step."""
    left: dict[int, Counter] = defaultdict(Counter)  # room -> patterns
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in left if r >= length), default=None)
            if room is None:
                each, bins, pattern = capacity // length, None, ()
            else:
                each = room // length
                pattern, bins = next(iter(left[room].items()))
            take = n // each if bins is None else min(n // each, bins)
            put = each
            if not take:
                take, put = 1, n
            if bins is not None:
                left[room][pattern] -= take
                if not left[room][pattern]:
                    del left[room][pattern]
                if not left[room]:
                    del left[room]
            new = pattern + (length,) * put
            left[(capacity if room is None else room) - put * length][new] += take
            n -= take * put
    out: Classes = Counter()
    for patterns in left.values():
        out.update(patterns)
    return out


def _sums(pattern: tuple[int, ...]) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """The distinct sums of one piece and of two, and pieces that make them."""
    distinct = sorted(set(pattern), reverse=True)
    pairs = {x + y: (x, y) for i, x in enumerate(distinct) for y in distinct[i + 1 :]}
    pairs |= {2 * x: (x, x) for x, n in Counter(pattern).items() if n > 1}
    return {x: (x,) for x in distinct}, pairs


class Underfull:
    """Classes with room, by what they can hand over: nothing or one piece (kind 0), or two (kind 1)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.members: dict[tuple[int, int, int], dict[tuple[int, ...], None]] = defaultdict(dict)
        self.held = np.zeros((2, 2 * capacity + 1, capacity + 1), bool)  # [kind, sum, room]
        self.most = np.full((2, 2 * capacity + 1), -1)  # the most room of those that hold the sum

    def _places(self, pattern: tuple[int, ...]) -> Iterator[tuple[int, int, int]]:
        room = self.capacity - sum(pattern)
        ones, twos = _sums(pattern)
        yield from ((0, x, room) for x in (0, *ones))
        yield from ((1, x, room) for x in twos)

    def add(self, pattern: tuple[int, ...]) -> None:
        for at in self._places(pattern):
            self.members[at][pattern] = None
            self.held[at] = True
            self.most[at[:2]] = max(self.most[at[:2]], at[2])

    def drop(self, pattern: tuple[int, ...]) -> None:
        for at in self._places(pattern):
            del self.members[at][pattern]
            if not self.members[at]:
                del self.members[at]
                self.held[at] = False
                if self.most[at[:2]] == at[2]:
                    rooms = np.flatnonzero(self.held[at[:2]])
                    self.most[at[:2]] = rooms[-1] if len(rooms) else -1

    def exchange(self, source: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]] | None:
        """(target, what source gives, what it gets): one that raises the sum of squared fills, or none. Source is not in the index.

        Of the exchanges that fill a target to the brim the one with the most room; else the one that moves most."""
        fill = sum(source)
        limit = self.capacity - fill  # targets are no emptier than the source
        best: tuple | None = None
        for give_kind, gives in enumerate(_sums(source)):
            for s, given in gives.items():
                for kind in (0, 1) if not give_kind else (0,):
                    low = max(0, s - limit)
                    x = np.arange(low, s)
                    if not len(x):
                        continue
                    brim = np.flatnonzero(self.held[kind, x, s - x])
                    if len(brim):
                        rank, found = (1, int(s - x[brim[0]])), (kind, int(x[brim[0]]), int(s - x[brim[0]]))
                    else:
                        fits = np.flatnonzero(self.most[kind, x] >= s - x)
                        choice = None
                        for i in fits.tolist():
                            rooms = np.flatnonzero(self.held[kind, x[i], s - x[i] : limit + 1])
                            if len(rooms):
                                choice = (kind, int(x[i]), int(s - x[i] + rooms[0]))
                                break
                        if choice is None:
                            continue
                        rank, found = (0, s - choice[1]), choice
                    if best is None or rank > best[0]:
                        best = (rank, found, given)
        if best is None:
            return None
        _, (kind, x, room), given = best
        target = next(iter(self.members[kind, x, room]))
        return target, given, _sums(target)[kind][x] if x else ()


def _without(pattern: tuple[int, ...], out: tuple[int, ...], more: tuple[int, ...]) -> tuple[int, ...]:
    rest = list(pattern)
    for x in out:
        rest.remove(x)
    return tuple(sorted([*rest, *more], reverse=True))


def local_search(classes: Classes, capacity: int) -> Classes:
    """Exchanges between underfull sequences; each raises the sum of squared fills, and the emptiest are emptied first.

    Ends when no class has an exchange or the bound is met; there are finitely many fills, so it does end."""
    total = sum(sum(p) * n for p, n in classes.items())
    left = sum(classes.values()) - -(-total // capacity)
    index = Underfull(capacity)
    queue: list[tuple[int, tuple[int, ...]]] = []

    def change(pattern: tuple[int, ...], by: int) -> None:
        if not pattern:
            return
        old = classes[pattern]
        classes[pattern] = old + by
        if not classes[pattern]:
            del classes[pattern]
        if sum(pattern) < capacity and bool(old) != bool(old + by):
            (index.add if by > 0 else index.drop)(pattern)
            if by > 0:
                heapq.heappush(queue, (sum(pattern), pattern))

    for p in list(classes):
        if sum(p) < capacity:
            index.add(p)
    moved = True
    while left > 0 and moved:
        # every class is asked once; a pass without an exchange is the end
        queue[:] = sorted((sum(p), p) for p in classes if sum(p) < capacity)
        moved = False
        while left > 0 and queue:
            _, source = heapq.heappop(queue)
            while left > 0 and classes.get(source, 0):
                n = classes[source]
                index.drop(source)
                move = index.exchange(source)
                index.add(source)
                if not move and n > 1:  # two of one class
                    alone = Underfull(capacity)
                    alone.add(source)
                    move = alone.exchange(source)
                if not move:
                    break
                target, given, got = move
                m = n // 2 if target == source else min(n, classes[target])
                emptied = _without(source, given, got)
                change(source, -m)
                change(target, -m)
                change(emptied, m)
                change(_without(target, got, given), m)
                left -= 0 if emptied else m
                moved = True
    return classes


def plan(counts: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: from which rank on, to which first sequence, at which offset."""
    classes = local_search(best_fit(counts, capacity), capacity)
    out: dict[int, list] = defaultdict(list)
    used: Counter = Counter()
    base = 0
    for pattern, n in sorted(classes.items(), reverse=True):
        offset = 0
        for length in pattern:
            out[length].append((used[length], base, offset))
            used[length] += n
            offset += length
        base += n
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v, strict=True)) for k, v in out.items()}


def place(cut: DataFrame, capacity: int = 1024) -> DataFrame:
    """cut (a stored table of pieces) with sequence_id and offset."""
    spark = cut.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = cut.columns
    salted = cut.withColumn("__hs_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy("length", "__hs_salt").agg(F.count("*").alias("__hs_n"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = spark.sparkContext.broadcast(plan(counts, capacity))
    w = Window.partitionBy("length").orderBy("__hs_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("length", "__hs_salt", F.coalesce(F.sum("__hs_n").over(w), F.lit(0)).alias("__hs_before"))
    rank = F.row_number().over(Window.partitionBy("length", "__hs_salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("__hs_rank", rank).join(before, ["length", "__hs_salt"]).select(*cols, (F.col("__hs_rank") + F.col("__hs_before")).alias("__hs_rank"))
    n_length, n_rank = cols.index("length"), len(cols)
    schema = ", ".join(f"`{c}` {t}" for c, t in cut.dtypes) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = slots.value
        for b in batches:
            length, rank = b.column(n_length).to_numpy(), b.column(n_rank).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, base, offset = where[int(x)]
                i = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = base[i] + rank[at] - first[i], offset[i]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_rank)), pa.array(seq), pa.array(off)], names=[*cols, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, closing_id: int = 2, with_ids: bool = False) -> DataFrame:
    """The rows of the contract for op8 (and the ids, where asked for)."""
    return place(stored(pieces(docs, tokenizer_path, capacity, closing_id, with_ids)), capacity)
