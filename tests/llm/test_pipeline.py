import random

import public_tokenizers as P
import pytest

from heliospark.llm import packing, pii
from tests.llm.helpers import DOCS
from tests.llm.test_jaccard_join import brute
from tests.llm.test_native_ops import words10

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    clean = [sentence(r, r.randint(60, 300)) for _ in range(60)]
    item = sentence(r, 40)
    near = [clean[0].replace(" ", "  ", 1), clean[1] + " tail"]
    leak = [clean[2][:400] + " " + item + " " + clean[3][:300]]
    private = [sentence(r, 80) + " mail a.b@mail3.example.com or +1 (017) 555-7713 " + sentence(r, 30)]
    junk = ["### $$$ " * 100, None, "", "short", ("word " * 200)]
    texts = [*clean, *near, *leak, *private, *junk]
    return texts, item, len(clean), len(near)


def test_stages(spark, tmp_path, rows):
    texts, item, n_clean, n_near = rows
    data = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s", 1)]
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "pack":
            assert docs.columns == before.columns and dict(docs.dtypes) == dict(before.dtypes)
            kept[name] = {r["doc_id"]: r for r in docs.collect()}
    k = list(kept.values())
    assert set(range(n_clean)) <= set(k[0]) and not set(range(len(texts) - 5, len(texts))) & set(k[0])
    want = {i for i, _, c in brute(sorted((i, x["text"]) for i, x in k[0].items()), 5, 80) if i == c}
    assert set(k[1]) == want == set(k[0]) - set(range(n_clean, n_clean + n_near))
    assert set(k[2]) == {i for i in k[1] if not _hit(texts[i], item)} == set(k[1]) - {n_clean + n_near}
    for i, r in k[3].items():
        assert r["text"] == pii.mask(texts[i], pii.find_pii(texts[i])) and r["n_chars"] == len(r["text"])
    assert "[EMAIL] or [PHONE]" in k[3][n_clean + n_near + 1]["text"]
    encode = packing.tokenizer(P.path("byte_bpe_50k.json"))
    want = {i: len(encode(r["text"])) + 1 for i, r in k[3].items()}
    got = {r["doc_id"]: r["n"] for r in docs.groupBy("doc_id").sum("length").withColumnRenamed("sum(length)", "n").collect()}
    assert got == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, whole.select(cols).collect())) == sorted(map(tuple, docs.select(cols).collect()))


def _hit(text, item):
    w, v = words10(text), words10(item)
    wins = {tuple(v[i : i + 10]) for i in range(len(v) - 9)}
    return any(tuple(w[i : i + 10]) in wins for i in range(len(w)))


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
