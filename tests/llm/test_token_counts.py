import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from heliospark.llm import token_counts as T
from tests.llm.helpers import docs_frame, hard_texts, word_soup

PATH = P.path("piece_bpe_32k.model")


def library(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def big():
    return library(T.vocabulary(PATH)), T.counter(PATH)


TEXT = st.text(alphabet=st.sampled_from(list("abcdehinorst ▁\n.é日語\U0001f600<unk>0 ")), max_size=60)


@settings(max_examples=500, deadline=None)
@given(TEXT)
def test_like_the_library_with_a_public_vocabulary(big, text):
    assert big[1](text) == big[0](text)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.lists(st.text(alphabet="ab▁ cd", max_size=12), min_size=1, max_size=8))
def test_like_the_library_with_ties(seed, texts):
    r = random.Random(seed)
    pieces = {"".join(r.choice("abc▁") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 25))}
    vocab = [("<unk>", 0.0), *((p, -float(r.randint(1, 4))) for p in sorted(pieces))]
    want, got = library(vocab), T.Counter(vocab)
    for t in texts:
        assert got(t) == want(t)


def test_long_texts(big):
    for t in [" " * 3000, "x" * 20_000, "\n" * 500, word_soup(3, 3000), *(t for t in hard_texts() if t)]:
        assert big[1](t) == big[0](t)


def test_query(spark, big):
    texts = hard_texts()
    docs = docs_frame(spark, texts, extra=[(3, "one", "en", "s", 1), (None, "two", "en", "s", 1)]).selectExpr("*", "1 as n_tokens")
    got = T.count_tokens(docs, PATH).collect()
    assert len(got) == len(texts) + 2
    assert all(r["n_tokens"] == big[0]("two" if r["doc_id"] is None else texts[r["doc_id"]] or "") for r in got)
    assert T.count_tokens(docs.limit(0), PATH).count() == 0
