import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from heliospark.llm import packing
from tests.llm.helpers import docs_frame, hard_texts, word_soup

PATH = P.path("byte_bpe_50k.json")


def test_ids_like_the_tokenizers_library():
    exact, encode = Tokenizer.from_file(PATH), packing.tokenizer(PATH)
    marks = [" ", "　", " ", " ", "ͅ", "ᛮ", "\U0001d7d8", "ำ", "ẞ", "﻿", "‍", "\U0001f600", "it's'll", "12 345", "  x", "\r\n\r\n "]
    r = random.Random(5)
    texts = ["".join(r.choice([*marks, "ab", "Éz", "#$"]) for _ in range(40)) for _ in range(300)] + ["a<|endoftext|>b", " " * 5000, "x" * 5000, *(t for t in hard_texts() if t)]
    for t in texts:
        assert encode(t) == exact.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_pieces_and_never_needs_more(seed):
    r = random.Random(seed)
    counts = Counter(r.randint(1, 40) for _ in range(300))
    first = packing.best_fit(counts, 40)
    last = packing.local_search(Counter(first), 40)
    for classes in (first, last):
        assert all(0 < sum(p) <= 40 for p in classes)
        assert Counter({x: 0 for x in counts}) + Counter(x for p, n in classes.items() for x in p * n) == counts
    assert sum(last.values()) <= sum(first.values())


def test_exchange_empties_a_sequence():
    counts = {6: 2, 5: 2, 4: 2}
    assert sum(packing.best_fit(counts, 15).values()) == 3
    assert sum(packing.local_search(packing.best_fit(counts, 15), 15).values()) == 2


def improving(p, q, capacity):
    """Whether one or two pieces of p, for at most two of the fuller q and three in all, would fill q more."""
    some = lambda x: {c for k in (1, 2) for c in combinations(x, k)}
    return any(0 < sum(g) - sum(h) <= capacity - sum(q) for g in some(p) for h in some(q) | {()} if len(g) + len(h) <= 3)


@pytest.mark.parametrize("seed", range(30))
def test_search_ends_where_no_exchange_is_left(seed):
    r = random.Random(seed)
    capacity = r.choice([12, 20, 40])
    counts = Counter(r.randint(max(1, capacity // r.choice([8, 4, 3])), capacity // r.choice([1, 2])) for _ in range(r.choice([6, 25, 60])))
    classes = packing.local_search(packing.best_fit(counts, capacity), capacity)
    if sum(classes.values()) > -(-sum(k * v for k, v in counts.items()) // capacity):
        each = [p for p, n in classes.items() for _ in range(min(n, 2)) if sum(p) < capacity]
        assert not any(improving(p, q, capacity) for i, p in enumerate(each) for j, q in enumerate(each) if i != j and sum(p) <= sum(q))


def fewest(pieces, capacity):
    """Fewest sequences, by trying all."""
    best = [len(pieces)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for k in {x: k for k, x in enumerate(rooms) if x >= pieces[i]}.values():
            put(i + 1, [*rooms[:k], rooms[k] - pieces[i], *rooms[k + 1 :]])
        put(i + 1, [*rooms, capacity - pieces[i]])

    put(0, [])
    return best[0]


def test_few_pieces_against_all_packings():
    r = random.Random(1)
    more = 0
    for _ in range(200):
        pieces = sorted((r.randint(2, 12) for _ in range(r.randint(3, 9))), reverse=True)
        n = sum(packing.local_search(packing.best_fit(Counter(pieces), 15), 15).values())
        assert n <= fewest(pieces, 15) + 1
        more += n > fewest(pieces, 15)
    assert more <= 4


def test_many_lengths_are_searched_to_the_end():
    r = random.Random(7)
    counts = Counter(r.randint(260, 520) for _ in range(4000))
    first = packing.best_fit(counts, 1024)
    n = sum(first.values())
    last = packing.local_search(first, 1024)
    assert sum(last.values()) < n and Counter(x for p, m in last.items() for x in p * m) == counts


def test_round_trip(spark):
    texts = [*hard_texts(), word_soup(5, 3000), *(word_soup(i, 30) for i in range(50))]
    docs = docs_frame(spark, texts, extra=[(3, "one", "en", "s", 1), (None, "two", "en", "s", 1)]).selectExpr("*", "1 as piece", "2 as length")
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    encode = packing.tokenizer(PATH)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in rows:
        assert x["length"] == len(x["ids"]) <= 1024 and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes())
        by_doc[x["doc_id"]].append(x)
        by_seq[x["sequence_id"]].append(x)
    for k, v in by_doc.items():
        if k == 3:
            assert len(v) == 2
            continue
        v.sort(key=lambda x: x["piece"])
        want = [*encode("two" if k is None else texts[k] or ""), 2]
        assert [i for x in v for i in x["ids"]] == want and [x["piece"] for x in v] == list(range(len(v)))
        assert all(x["length"] == 1024 for x in v[1:]) and (len(want) > 1024 or len(v) == 1)
        assert [x["start"] for x in v] == list(np.cumsum([0, *(x["length"] for x in v)])[:-1])
    for v in by_seq.values():
        at = 0
        for x in sorted(v, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 1024
    total = sum(x["length"] for x in rows)
    assert len(by_seq) <= -(-total // 1024) + 2
    assert packing.pack(docs.limit(0), PATH).count() == 0
