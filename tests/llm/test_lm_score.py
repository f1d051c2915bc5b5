import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from heliospark.llm import lm_score
from tests.llm.helpers import docs_frame, hard_texts, word_soup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END = object()


def tokens(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), END]


def brute_model(texts):
    """The model by its definition, with dictionaries."""
    grams = [Counter() for _ in range(4)]
    for t in texts:
        k = [END, *tokens(t)]
        for i in range(1, len(k)):
            for m in range(1, min(i + 1, 3) + 1):
                grams[m][tuple(k[i - m + 1 : i + 1])] += 1
    uni = {k[0]: c for k, c in grams[1].items()}
    n, v = sum(uni.values()), len(uni)
    if not n:
        return lambda t: 0.0
    n1, n2, n3, n4 = (sum(c == k for c in uni.values()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    off = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.75]
    off = [min(max(d, 0.1), 0.95 * k) for d, k in zip(off, (1, 2, 3), strict=True)]
    taken = (off[0] * n1 + off[1] * n2 + off[2] * (v - n1 - n2)) / n
    unseen = max(taken, 0.5 / (n + 1))
    arcs = {}
    for m in (2, 3):
        for k, c in grams[m].items():
            if c >= lm_score.LEAST:
                arcs.setdefault(k[:-1], {})[k[-1]] = c - 0.75

    def prob(state, w):
        if not state:
            return (1 - unseen) / (1 - taken) * (uni[w] - off[min(uni[w], 3) - 1]) / n if w in uni else unseen
        own, c, below = arcs.get(state), grams[len(state)][state], prob(state[1:], w)
        return own.get(w, 0) / c + (1 - sum(own.values()) / c) * below if own else below

    # everything that can come next sums to 1, in states of either length
    for state in [(a,) for a in list(uni)[:10]] + [k for k in arcs if len(k) == 2][:20]:
        assert sum(prob(state, b) for b in uni) + prob(state, None) == pytest.approx(1)

    def score(t):
        k = [END, *tokens(t)]
        return sum(math.log10(prob(tuple(k[max(i - 2, 0) : i]), k[i])) for i in range(1, len(k)))

    return score


def check(spark, rows, got):
    train = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            train.update(tokens(t))
    n, v = sum(train.values()), len(train)
    model = brute_model([t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1])
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        k = tokens(t)
        base = sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in k)
        own = model(t)
        want.setdefault(i, []).append((zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1, len(k), sum(train[x] > 0 for x in k), n, base, own))
    for r in got:
        assert any(tuple(r)[1:5] == w[:4] and r["base_score"] == pytest.approx(w[4], rel=1e-9) and r["score"] == pytest.approx(w[5], rel=1e-6) for w in want[r["doc_id"]]), (r, want[r["doc_id"]])


def test_like_brute_force(spark, monkeypatch):
    texts = [*hard_texts(), *(word_soup(i, 40, words=("Aé", "abc", "abd", "ß", "x", f"n{i}")) for i in range(30))]
    extra = [(None, "abc null", "", "", 0), (20, texts[20], "", "", 0)]
    docs = docs_frame(spark, texts, extra=extra).selectExpr("*", "1 as n", "2 as chunk").repartition(3)
    rows = [*enumerate(texts), *((e[0], e[1]) for e in extra)]
    check(spark, rows, lm_score.score(docs).collect())
    monkeypatch.setattr(lm_score, "CHUNK", 300)
    check(spark, rows, lm_score.score(docs).collect())
    monkeypatch.setattr(lm_score, "LEAST", 5)
    monkeypatch.setattr(lm_score, "TEXT", 500)
    monkeypatch.setattr(lm_score, "SHARE", 100)
    check(spark, rows, lm_score.score(docs).collect())
    assert lm_score.score(docs.limit(0)).count() == 0


def test_one_held_out_text_alone(spark):
    i = next(i for i in range(50) if lm_score.held_out(i))
    docs = docs_frame(spark, []).union(spark.createDataFrame([(i, "a b", "", "", 0)], docs_frame(spark, ["x"]).schema))
    r = lm_score.score(docs).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0) and r["base_score"] == pytest.approx(0.0) and r["score"] == 0.0


def test_held_out_texts_score_better_than_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.score(docs).where("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert r["s"] / r["n"] > r["b"] / r["n"] + 0.05


def test_a_bigram_seen_twice_is_an_arc_in_a_large_corpus(spark):
    train = [i for i in range(20) if not lm_score.held_out(i)][:5]
    held = next(i for i in range(20) if lm_score.held_out(i))
    texts = {i: "x " * 150_000 for i in train} | {train[0]: "x " * 150_000 + "ann bob", train[1]: "ann bob", held: "ann bob"}
    rows = [(i, t, "", "", 0) for i, t in texts.items()]
    r = lm_score.score(docs_frame(spark, [], extra=rows)).where("held_out").first()
    assert r["train_tokens"] > 600_000 and r["n_tokens"] == 3
    # only ann goes by the root; without the arcs to bob and to the end, each of the three costs 5 or more
    assert r["score"] > -10


@pytest.mark.parametrize("top", [5, 1 << 40])
def test_order_by_one_number_or_several(top):
    rng = np.random.default_rng(1)
    keys = [rng.integers(0, top, 500) for _ in range(3)]
    order = lm_score._order(*keys)
    rows = list(zip(*(k.tolist() for k in keys), strict=True))
    assert sorted(order.tolist()) == list(range(500)) and [rows[i] for i in order] == sorted(rows)
    assert len(lm_score._order(*(k[:0] for k in keys))) == 0
