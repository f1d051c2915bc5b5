"""Documents that meet the hard cases: nulls, empty and long texts, ties, repeated rows."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_frame(spark, texts, extra=()):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, *extra], DOCS)


def word_soup(seed, n, words=("the", "of", "Éa", "ß", "token", "x1", "it's", "AND", "and", "42", "a\tb", "🙂"), seps=(" ", " ", " ", "\n", "  ", "\t", "\x0b", ", ")):
    r = random.Random(seed)
    return "".join(r.choice(words) + r.choice(seps) for _ in range(n))


def hard_texts():
    return [None, "", " \n\t ", "one", "a b c", "a b c a b c", "x " * 300, "Ünïcode\u00a0word \u2028 sep", word_soup(1, 5), word_soup(2, 400), word_soup(3, 4000, words=("p", "q")), "word\n" * 30 + "other line here\n" * 3, word_soup(2, 400)]
