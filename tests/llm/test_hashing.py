import random
import re

import numpy as np
import pyarrow as pa

from heliospark.llm import hashing as H
from tests.llm.helpers import hard_texts


def of(texts, folded=True, bounds=H.word_bounds):
    data, offsets = H.strings(pa.array(texts))
    starts, ends, firsts = bounds(data, offsets)
    return H.word_hashes(data, starts, ends, folded), firsts


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


def test_words_that_sums_of_powers_confuse_are_told_apart():
    for n in (64, 1024, 2048, 4096):
        x, y = thue_morse(n), thue_morse(n, "b", "a")
        assert len(set(of([x, y])[0].tolist())) == 2


def test_one_hash_for_each_word(monkeypatch):
    r = random.Random(3)
    words = {"".join(r.choice("aAbé9-") for _ in range(r.choice([1, 2, 3, 7, 8, 9, 16, 17, 60, 255, 256, 257, 300]))) for _ in range(4000)}
    words |= {"abCde", "abcDe", "a" * 300 + "x", "a" * 300 + "y", "a" * 256, "a" * 257, "\0", "\0\0"}
    words = sorted(words)
    text = " ".join(words)
    exact = of([text, None, "", text], folded=False)[0]
    assert len(set(exact[: len(words)].tolist())) == len(words) and (exact[: len(words)] == exact[len(words) :]).all()
    lower = [w.translate({i: i + 32 for i in range(65, 91)}) for w in words]
    folded = of([text])[0]
    assert len(set(folded.tolist())) == len(set(lower)) and (folded == of([" ".join(lower)])[0]).all()
    monkeypatch.setattr(H, "BLOCK", 50)
    assert (of([text], folded=False)[0] == exact[: len(words)]).all()


def test_tokens_are_runs_of_one_kind():
    texts = hard_texts() + ["a-b!!  (x1)é.", "..", "a", "-a"]
    _, firsts = of(texts, bounds=H.tokens_bounds)
    want = [len(re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+|[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]+", t or "")) for t in texts]
    assert np.diff(firsts).tolist() == want
