"""Language-model scoring with a weighted backoff automaton.

Events are the tokens of the training texts and one more for all unseen ones, as in the base score. Unigrams
have Good-Turing-like discounts for counts of 1, 2 and more, estimated from the counts of counts; what is
taken off is the probability of an unseen token. The automaton's root holds the unigrams; its states are single
tokens and bigrams seen LEAST times or more. A state's arcs hold the discounted shares of the successors it was
seen with LEAST times or more, and its failure arc, at the weight of the mass kept back, leads from a bigram to
its last token and from a token to the root. One left-to-right traversal carries the state and adds up. A text
begins in the state of END alone. The numbers of states and arcs grow with the corpus and have no bound.

Counts are exact, over all training texts, and never meet in one place: texts are read once into chunks; each
chunk asks the shards that hold the counts of its distinct tokens, then those of its bigrams, then those of its
trigrams, and gets the answers back. An n-gram's count is at most that of any of its parts, so n-grams of a part
seen fewer than LEAST times need not be asked for. The answers number the other parts, so that contexts and
successors are short numbers. A context's n-grams are in one shard, which adds up its mass; those of a context
that would fill a shard of its own are dealt to all, and the masses of these few (at most as many as there are
shards) are sent to every task. The number of shards grows with the texts.

Defined cases: a null text is empty, and an empty one is its end token; repeated rows are scored one by one
and, if in training, counted one by one; a null doc_id counts as the empty string for the split; without
training texts every token is unseen and scores 0; an empty table gives an empty result; extra columns are
not read.
"""

from __future__ import annotations

import os
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm import hashing as H
from heliospark.llm.hashing import parts
from heliospark.llm.shared import TABLES, drop_tables, stored

#: Arcs are bigrams and trigrams seen so often.
LEAST = 2
DISCOUNT = 0.75
CHUNK = 12 << 20
#: Training tokens for one shard of bigrams or of trigrams, and bytes of text for one of tokens.
SHARE, TEXT = 1 << 22, 256 << 20
#: Stands for the end of a text as a token, and for its start as a context.
END = np.uint64(0x5851F42D4C957F2D)


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def _packed(**x) -> bytes:
    return zstandard.compress(pickle.dumps(x), 3)


def _unpacked(x: bytes) -> dict:
    return pickle.loads(zstandard.decompress(x))


def _sharded(keys: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted keys."""
    cut = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1))
    return [(k, i, j) for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if i < j]


def _tight(x: np.ndarray) -> bytes:
    """Whole numbers of at least 0, by byte planes, whose upper ones are mostly zeros."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def _loose(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T).view("<i8").ravel()


ROWS = "kind int, chunk long, shard int, n long, a binary, b binary, c binary"


def _rows(kind: int, chunk: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """rows: (shard, n, a, b, c)."""
    for i in range(0, len(rows), 32):
        shard, n, a, b, c = zip(*rows[i : i + 32], strict=True)
        m = len(shard)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * m, pa.int32()), pa.array([chunk] * m, pa.int64()), pa.array(shard, pa.int32()), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (a, b, c))],
            names=["kind", "chunk", "shard", "n", "a", "b", "c"],
        )


def _shards(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // TEXT + 1)


def read(docs: DataFrame, shards: int) -> DataFrame:
    """One pass over the texts: chunks (kind 0; n: their training tokens) and what they ask the shards (1: tokens, counts in training texts)."""

    def rows(ids: list, hashes: list, lengths: list) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        name = int.from_bytes(os.urandom(7), "little")
        length = np.concatenate(lengths)
        held = np.array([held_out(i) for i in ids])
        # each text is its words and END
        ends = np.cumsum(length + 1) - 1
        tokens = np.full(int(ends[-1]) + 1, END)
        tokens[np.setdiff1d(np.arange(len(tokens)), ends, assume_unique=True)] = np.concatenate(hashes)
        distinct, which = np.unique(tokens, return_inverse=True)
        train = np.bincount(which, weights=np.repeat(~held, length + 1), minlength=len(distinct)).astype(np.int64)
        yield from _rows(0, name, [(0, int(train.sum()), _packed(ids=ids, held=held, length=length + 1, which=_tight(which), end=int(which[-1])), None, None)])
        yield from _rows(1, name, [(k, 0, distinct[i:j].tobytes(), train[i:j].tobytes(), None) for k, i, j in _sharded(distinct, shards)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, lengths, size = [], [], [], 0
        for whole in batches:
            for b in parts(whole, 1):
                data, offsets = H.strings(b.column(1))
                starts, ends, firsts = H.word_bounds(data, offsets)
                ids += b.column(0).to_pylist()
                hashes.append(H.word_hashes(data, starts, ends))
                lengths.append(np.diff(firsts))
                size += len(data)
                if size >= CHUNK:
                    yield from rows(ids, hashes, lengths)
                    ids, hashes, lengths, size = [], [], [], 0
        yield from rows(ids, hashes, lengths)

    return stored(docs.select("doc_id", "text").mapInArrow(run, ROWS), "kind")


def answers(seen: DataFrame, least: int) -> DataFrame:
    """(chunk, shard, a, b): the training counts of the tokens that a chunk asked a shard for, and the steps between the numbers in the shard of those that occur `least` times or more; for chunk -1, the tokens in all, the distinct ones, and those seen 1, 2, 3 and 4 times."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [np.frombuffer(x, np.uint64) for x in pdf["a"]]
        found, which = np.unique(np.concatenate(asked), return_inverse=True)
        counts = np.zeros(len(found), np.int64)
        np.add.at(counts, which, np.concatenate([np.frombuffer(x, np.int64) for x in pdf["b"]]))
        number = np.cumsum(counts >= least) - 1
        at = np.split(which, np.cumsum([len(x) for x in asked])[:-1])
        got = [_tight(counts[i]) for i in at]
        often = [_tight(np.diff(number[i[counts[i] >= least]], prepend=0)) for i in at]
        out = pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "a": got, "b": often})
        sums = np.array([counts.sum(), (counts > 0).sum(), *((counts == k).sum() for k in (1, 2, 3, 4))], np.int64)
        out = pd.concat([out, pd.DataFrame({"chunk": [-1], "shard": pdf["shard"].iloc[:1].to_list(), "a": [b""], "b": [b""]})])
        for i in range(6):
            out[f"n{i}"] = 0
            out.iloc[-1, out.columns.get_loc(f"n{i}")] = int(sums[i])
        return out

    kinds = ", ".join(f"n{i} long" for i in range(6))
    return stored(seen.where("kind = 1").select("chunk", "shard", "a", "b").groupBy("shard").applyInPandas(meet, f"chunk long, shard int, a binary, b binary, {kinds}"))


def _dealt(x: np.ndarray, shards: int) -> np.ndarray:
    return (((H.mix(x) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def _order(*keys: np.ndarray) -> np.ndarray:
    """What sorts by whole numbers of at least 0, the first one first, equal rows in any order; as one number where they fit into it, which sorts several times as fast."""
    whole, room = np.zeros(len(keys[0]), np.int64), 1
    for k in keys:
        size = int(k.max(initial=0)) + 1
        room *= size
        if room >= 1 << 63:
            return np.lexsort(keys[::-1])
        whole = whole * size + k
    return np.argsort(whole)


def grams(before: np.ndarray, which: np.ndarray, at: np.ndarray, names: np.ndarray, number: np.ndarray, heavy: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
    """What a chunk asks the shards of n-grams, in order: contexts, their shards and how many successors each has there; contexts, successors and shards of the n-grams. Then which n-gram stands at each place, or -1.

    before: the context of each place, or -1; which: its token; at: the places to ask for; names and number: the numbers of contexts and tokens; heavy: the contexts that are dealt to all shards."""
    pairs, place = np.unique(before[at].astype(np.uint64) << np.uint64(32) | which[at].astype(np.uint64), return_inverse=True)
    # a context that is not dealt to all is asked for without a successor, too
    alone = np.unique(before)
    alone = alone[alone >= 0]
    alone = alone[~heavy[alone]]
    a = np.r_[(pairs >> np.uint64(32)).astype(np.int64), alone]
    b = np.r_[(pairs & np.uint64(0xFFFFFFFF)).astype(np.int64), np.full(len(alone), -1)]
    x, y = names[a], np.where(b < 0, -1, number[b])
    shard = _dealt(np.where(heavy[a], x.astype(np.uint64) * H.ODD[1] + y.astype(np.uint64) * H.ODD[2], x.astype(np.uint64)), shards)
    order = _order(shard, x, y + 1)
    a, b, shard, real = a[order], b[order], shard[order], b[order] >= 0
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (shard[1:] != shard[:-1])]) if len(a) else np.zeros(0, np.int64)
    successors = np.add.reduceat(real.astype(np.int64), first) if len(a) else first
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(real) - 1
    found = np.full(len(which), -1, np.int64)
    found[at] = rank[: len(pairs)][place]
    return a[first], shard[first], successors, a[real], b[real], shard[real], found


def _by_count(counts: np.ndarray) -> np.ndarray:
    """The frequent tokens first: ranks in this order are mostly small numbers."""
    return np.argsort(-counts, kind="stable")


class Chunk:
    """A chunk's texts as places among its distinct tokens, and what it has been told."""

    def __init__(self, x: dict, least: int, total: int, dealt: int, shards: int):
        self.counts = np.concatenate([_loose(a) for _, a, _ in x["tokens"]])
        self.number, often = np.zeros(len(self.counts), np.int64), self.counts >= least
        self.number[often] = np.concatenate([np.cumsum(_loose(b)) * dealt + k for k, _, b in x["tokens"]])
        self.which, self.length, self.end = _by_count(self.counts)[_loose(x["ranks"])] if "ranks" in x else _loose(x["which"]), x["length"], x["end"]
        self.in_train = np.repeat(~x["held"], self.length)
        self.first = np.cumsum(self.length) - self.length
        self.heavy = often & (self.counts * shards >= total)
        before = np.empty(len(self.which), np.int64)
        before[1:] = self.which[:-1]
        # END goes before the first token of each text
        before[self.first] = self.end
        self.before = np.where(often[before], before, -1)
        at = np.flatnonzero((self.before >= 0) & often[self.which])
        self.pairs = grams(self.before, self.which, at, self.number, self.number, self.heavy, shards)
        self.total, self.shards = total, shards

    def packed(self, x: dict) -> bytes:
        order = _by_count(self.counts)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return _packed(**{k: v for k, v in x.items() if k != "which"}, ranks=_tight(rank[self.which]))

    def hear(self, replies: list[tuple]) -> None:
        """(shard, counts, masses, steps between the numbers) of the bigrams, in order of shards."""
        self.arc, self.mass = (np.concatenate([np.zeros(0, np.int64), *(_loose(r[i]) for r in replies)]) for i in (1, 2))
        self.arc_number = np.zeros(len(self.arc), np.int64)
        self.arc_number[self.arc > 0] = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_loose(r[3])) * self.shards + r[0] for r in replies)])
        found = self.pairs[-1]
        kept = np.full(len(found), -1, np.int64)
        asked = np.flatnonzero(found >= 0)
        kept[asked] = np.where(self.arc[found[asked]] > 0, found[asked], -1)
        # the first token of a text has no bigram before it
        self.state = np.r_[-1, kept[:-1]][: len(kept)]
        self.state[self.first] = -1
        self.heavy_arc = (self.arc > 0) & (self.arc * self.shards >= self.total)
        at = np.flatnonzero((self.state >= 0) & (kept >= 0))
        self.triples = grams(self.state, self.which, at, self.arc_number, self.number, self.heavy_arc, self.shards)

    def ask(self, name: int, gram: tuple[np.ndarray, ...], names: np.ndarray, heavy: np.ndarray) -> list[tuple]:
        c, c_shard, m, a, b, shard, found = gram
        n = np.bincount(found[self.in_train & (found >= 0)], minlength=len(a))
        names = names[c] * 2 + heavy[c]
        out = []
        for k in np.unique(c_shard).tolist():
            (i, j), (p, q) = np.searchsorted(c_shard, [k, k + 1]), np.searchsorted(shard, [k, k + 1])
            out.append((1, name, k, int(j - i), _tight(np.r_[names[i:j], m[i:j]]), _tight(self.number[b[p:q]]), _tight(n[p:q])))
        return out


COLUMNS = ["kind", "chunk", "shard", "n", "a", "b", "c"]


def joined(seen: DataFrame, told: DataFrame, least: int, total: int, dealt: int, shards: int) -> DataFrame:
    """Chunks with the counts and numbers of their tokens (kind 0), and what they ask the shards of bigrams (1: contexts, if they are dealt to all, and how many successors of each follow; successors; training counts). dealt: the shards of tokens."""

    def meet(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        x = _unpacked(chunk["a"].iloc[0])
        x["tokens"] = list(got.sort_values("shard")[["shard", "a", "b"]].itertuples(index=False, name=None))
        c, name = Chunk(x, least, total, dealt, shards), int(chunk["chunk"].iloc[0])
        return pd.DataFrame([(0, name, 0, 0, c.packed(x), None, None), *c.ask(name, c.pairs, c.number, c.heavy)], columns=COLUMNS)

    left = seen.where("kind = 0").select("chunk", "a").groupBy("chunk")
    right = told.where("chunk >= 0").select("chunk", "shard", "a", "b").groupBy("chunk")
    return stored(left.cogroup(right).applyInPandas(meet, ROWS), "kind")


def extended(chunks: DataFrame, replies: DataFrame, least: int, total: int, dealt: int, shards: int) -> DataFrame:
    """Chunks with what they were told of bigrams (kind 0), and what they ask of trigrams, whose contexts are bigrams (1)."""

    def meet(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        x, name = _unpacked(chunk["a"].iloc[0]), int(chunk["chunk"].iloc[0])
        x["told"] = list(got.sort_values("shard")[["shard", "a", "b", "c"]].itertuples(index=False, name=None))
        c = Chunk(x, least, total, dealt, shards)
        c.hear(x["told"])
        return pd.DataFrame([(0, name, 0, 0, _packed(**x), None, None), *c.ask(name, c.triples, c.arc_number, c.heavy_arc)], columns=COLUMNS)

    left = chunks.where("kind = 0").select("chunk", "a").groupBy("chunk")
    right = replies.where("chunk >= 0").select("chunk", "shard", "a", "b", "c").groupBy("chunk")
    return stored(left.cogroup(right).applyInPandas(meet, ROWS), "kind")


def arcs(chunks: DataFrame, least: int, numbered: bool) -> DataFrame:
    """(chunk, shard, a, b, c, number, mass): the counts of the arcs among the n-grams that a chunk asked a shard for, else 0 (a), four times the mass of all arcs of each context (b), and, if asked for, the steps between the numbers of the arcs in the shard (c); for chunk -1, contexts that are dealt to all shards, and the mass of their arcs in one."""

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        asked = [_loose(x).reshape(2, -1) for x in pdf["a"]]
        names = np.concatenate([x[0] for x in asked])
        contexts, of = np.unique(names, return_inverse=True)
        a = np.repeat(of, np.concatenate([x[1] for x in asked]))
        sent = [_loose(x) for x in pdf["b"]]
        b = np.concatenate(sent)
        n = np.concatenate([_loose(x) for x in pdf["c"]])
        order = _order(a, b)
        new = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])] if len(a) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        sums = np.add.reduceat(n[order], first) if len(a) else n
        sums = np.where(sums >= least, sums, 0)
        mass = np.zeros(len(contexts), np.int64)
        np.add.at(mass, a[order][first], np.where(sums > 0, 4 * sums - round(4 * DISCOUNT), 0))
        counts, number = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
        counts[order] = sums[np.cumsum(new) - 1]
        number[order] = (np.cumsum(sums > 0) - 1)[np.cumsum(new) - 1]
        cut = np.cumsum([len(x) for x in sent])[:-1]
        got = np.split(counts, cut)
        steps = [_tight(np.diff(i[c > 0], prepend=0)) if numbered else None for i, c in zip(np.split(number, cut), got, strict=True)]
        masses = np.split(mass[of], np.cumsum([x.shape[1] for x in asked])[:-1])
        out = pd.DataFrame({"chunk": pdf["chunk"], "shard": pdf["shard"], "a": [_tight(x) for x in got], "b": [_tight(x) for x in masses], "c": steps, "number": 0, "mass": 0})
        heavy = np.flatnonzero(contexts % 2 == 1)
        more = pd.DataFrame({"chunk": -1, "shard": pdf["shard"].iloc[0], "a": b"", "b": b"", "c": b"", "number": contexts[heavy] // 2, "mass": mass[heavy]})
        return pd.concat([out, more]) if len(more) else out

    asked = chunks.where("kind = 1").select("chunk", "shard", "a", "b", "c")
    return stored(asked.groupBy("shard").applyInPandas(meet, "chunk long, shard int, a binary, b binary, c binary, number long, mass long"))


def dealt_masses(replies: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and masses of the contexts that are dealt to all shards; at most as many as there are shards are so frequent."""
    rows = replies.where("chunk = -1").groupBy("number").agg(F.sum("mass").alias("m")).orderBy("number").collect()
    return np.array([r["number"] for r in rows], np.int64), np.array([r["m"] for r in rows], np.int64)


def masses(n: int, asked: np.ndarray, mass: np.ndarray, names: np.ndarray, heavy: np.ndarray, dealt: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The mass of the arcs of each of n contexts."""
    out = np.zeros(n)
    out[asked] = mass / 4
    numbers, sums = dealt
    mine = np.flatnonzero(heavy)
    if len(numbers):
        at = np.minimum(np.searchsorted(numbers, names[mine]), len(numbers) - 1)
        out[mine] = np.where(numbers[at] == names[mine], sums[at], 0) / 4
    return out


class Root:
    """The discounts of tokens without a context."""

    def __init__(self, total: int, distinct: int, once: tuple[int, int, int, int]):
        n1, n2, n3, n4 = once
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.75]
        self.off = np.array([0.0, *(min(max(d, 0.1), 0.95 * k) for d, k in zip(raw, (1, 2, 3), strict=True))])
        self.total = total
        taken = (self.off[1] * n1 + self.off[2] * n2 + self.off[3] * (distinct - n1 - n2)) / total if total else 1.0
        self.unseen = max(taken, 0.5 / (total + 1)) if total else 1.0
        self.scale = (1 - self.unseen) / (1 - taken) if total else 0.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        seen = self.scale * (counts - self.off[np.minimum(counts, 3)]) / max(self.total, 1)
        return np.where(counts > 0, seen, self.unseen)


def descend(p: np.ndarray, context: np.ndarray, counts: np.ndarray, found: np.ndarray, arc: np.ndarray, out: np.ndarray) -> None:
    """p at each place where a state has arcs: by its arc, and by its failure arc to the state below, whose p it was."""
    live = np.flatnonzero(context >= 0)
    live = live[out[context[live]] > 0]
    a, i = context[live], found[live]
    n = np.where(i >= 0, arc[i], 0) if len(arc) else np.zeros(len(live))
    p[live] = (np.where(n > 0, n - DISCOUNT, 0.0) + (counts[a] - out[a]) * p[live]) / counts[a]


def score(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, least = docs.sparkSession, LEAST
    mark = len(TABLES)
    dealt = _shards(docs)
    seen = read(docs, dealt)
    told = answers(seen, least)
    total, distinct, *once = told.where("chunk = -1").agg(*(F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(6))).first()
    shards = max(dealt, total // SHARE + 1)
    chunks = joined(seen, told, least, total, dealt, shards)
    drop_tables(spark, TABLES[mark:-1])
    replies = arcs(chunks, least, True)
    of_tokens = dealt_masses(replies)
    chunks = extended(chunks, replies, least, total, dealt, shards)
    drop_tables(spark, TABLES[mark:-1])
    replies = arcs(chunks, least, False)
    known = spark.sparkContext.broadcast((Root(total, distinct, tuple(once)), of_tokens, dealt_masses(replies)))
    id_type = docs.schema["doc_id"].dataType
    batch_type = to_arrow_type(id_type)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(chunk: pa.Table, got: pa.Table) -> pa.Table:
        root, of_tokens, of_pairs = known.value
        x = _unpacked(chunk.column("a")[0].as_py())
        c = Chunk(x, least, total, dealt, shards)
        c.hear(x["told"])
        got = got.sort_by("shard")
        triple, mass = (np.concatenate([np.zeros(0, np.int64), *(_loose(v) for v in got.column(k).to_pylist())]) for k in ("a", "b"))
        counts, which, length = c.counts, c.which, c.length
        p = root.probabilities(counts)[which]
        descend(p, c.before, counts, c.pairs[-1], c.arc, masses(len(counts), c.pairs[0], c.mass, c.number, c.heavy, of_tokens))
        descend(p, c.state, c.arc, c.triples[-1], triple, masses(len(c.arc), c.triples[0], mass, c.arc_number, c.heavy_arc, of_pairs))
        base = np.log10((counts + 0.5) / (total + 0.5 * (distinct + 1)))
        values = [np.add.reduceat(v, c.first) for v in ((counts > 0).astype(np.int64)[which], base[which], np.log10(p))]
        columns = [x["ids"], x["held"], length, values[0], np.full(len(length), total), values[1], values[2]]
        types = [batch_type, pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], names=names)

    left = chunks.where("kind = 0").select("chunk", "a").groupBy("chunk")
    right = replies.where("chunk >= 0").select("chunk", "shard", "a", "b").groupBy("chunk")
    schema = f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return left.cogroup(right).applyInArrow(run, schema)
