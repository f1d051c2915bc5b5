import random
import re

import numpy as np
import pytest

from heliospark.llm import jaccard_join as J
from tests.llm.helpers import docs_frame, hard_texts, word_soup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size, percent):
    sets = [shingles(t, size) for _, t in rows]
    ids = [i for i, _ in rows]
    root = {i: i for i in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            n = len(sets[x] & sets[y])
            if n and 100 * n >= percent * len(sets[x] | sets[y]):
                a, b = top(ids[x]), top(ids[y])
                root[max(a, b)] = min(a, b)
    return sorted((i, len(s), top(i)) for i, s in zip(ids, sets, strict=True))


def corpus(seed, n):
    """Near copies of all degrees, exact copies, a passage that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 5)))
    passage = " ".join(word() for _ in range(30))
    bases = [[word() for _ in range(r.choice([5, 9, 20, 60, 200, 500]))] for _ in range(n // 12)]
    out = []
    for _ in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 9])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.1:
            w = w[: r.randint(1, len(w))]
        t = " ".join(w)
        if r.random() < 0.2:
            t += "\n" + passage
        out.append(t.upper() if r.random() < 0.1 else t)
    return out


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 1024), (5, 80, 1024), (4, 85, 8)])
def test_classes_like_brute_force(spark, monkeypatch, size, percent, block):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = [*hard_texts(), *corpus(size + block, 400)]
    docs = docs_frame(spark, texts, extra=[(7, texts[7], "en", "s", 1)]).selectExpr("*", "1 as n", "2 as fp")
    got = sorted(tuple(r) for r in J.classes(docs, size, percent).collect())
    assert got == brute([*enumerate(texts), (7, texts[7])], size, percent)


def test_empty_and_null_ids(spark):
    docs = docs_frame(spark, ["a b c d e", None], extra=[(None, "a b c d e", "", "", 0), (None, "x y", "", "", 0)])
    assert J.classes(docs.limit(0)).count() == 0
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.classes(docs).collect()}
    assert got == {(0, 1, 0), (1, 0, 1), (None, 1, 0), (None, 1, None)}


def test_keep_one(spark):
    texts = corpus(3, 120)
    docs = docs_frame(spark, texts).selectExpr("*", "1 as root")
    kept = J.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i, _, c in brute([*enumerate(texts)], 5, 80) if i == c]


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_agree_in_a_fragment(percent):
    r = np.random.default_rng(4)
    for _ in range(1500):
        n = int(r.integers(1, 120))
        x = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        gone = int(r.integers(0, max(1, n // 4) + 1))
        y = np.unique(np.r_[x[gone:], r.integers(0, 2**64, int(r.integers(0, max(1, n // 5) + 1)), dtype=np.uint64)])
        inter = len(np.intersect1d(x, y))
        if len(y) and 100 * inter >= percent * (len(x) + len(y) - inter) and inter < max(len(x), len(y)):
            a, b = ({k: (need, sig) for k, need, sig in J.signatures(s, J.size_class(len(s), percent))} for s in (x, y))
            # in some class both find enough in common
            assert any(min(n := len(np.intersect1d(a[c][1], b[c][1])), 1) and n >= a[c][0] and n >= b[c][0] for c in set(a) & set(b)), (len(x), len(y), inter)


def test_overlaps_like_sets():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, 30).astype(np.uint64) * np.uint64(2**58)) if i % 2 else np.unique(r.integers(0, 2**20, 30, dtype=np.uint64)) for i in range(40)]
    got = J.overlaps(sets, cells=64)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def test_an_id_with_several_texts(spark):
    """Rows of one id are one document, whatever order they come in."""
    r = random.Random(4)
    a = [f"w{r.randrange(10**6)}" for _ in range(400)]
    b, c = a.copy(), a.copy()
    for k in range(5):
        b[10 + 40 * k] = c[10 + 40 * k] = f"new{k}"
    for k in range(5):
        c[30 + 40 * k] = f"more{k}"
    a, b, c, d = (" ".join(x) for x in (a, b, c, [f"v{k}" for k in range(300)]))
    for rows in ([(1, a), (1, b), (2, c)], [(1, b), (1, a), (2, c)], [(2, c), (1, b), (1, a)], [(5, d), (3, d), (3, a), (4, b)]):
        assert len(brute(rows, 4, 85)) == len(rows)
        got = sorted(tuple(x) for x in J.report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).select("doc_id", "n_shingles", "component_id").collect())
        assert got == brute(rows, 4, 85)
    assert {x[2] for x in brute([(1, b), (1, a), (2, c)], 4, 85)} == {1}


def test_only_ids_are_broadcast(spark, monkeypatch):
    asked = []
    small = J.small
    monkeypatch.setattr(J, "small", lambda t: (asked.append(t.dtypes), small(t))[1])
    docs = docs_frame(spark, [word_soup(i % 20, 60) for i in range(60)])
    assert J.keep_one(docs).count() == 20
    assert asked and all(len(t) == 1 and t[0][1] == "bigint" for t in asked)
