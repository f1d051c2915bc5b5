import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospark.llm import decontaminate, quality_rules, url_filter
from tests.llm.helpers import DOCS, docs_frame, hard_texts, word_soup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def metrics(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    rep = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_quality_metrics_and_verdicts(spark):
    texts = [*hard_texts(), *(word_soup(i, 120) for i in range(20, 40)), "###$$$ " * 200]
    docs = docs_frame(spark, texts, extra=[(None, "a b", None, None, None), (5, "a b c a b c", "en", "s", 1)])
    got = quality_rules.report(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = "a b" if r["doc_id"] is None else texts[r["doc_id"]]
        want = metrics(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert not next(r for r in got if r["doc_id"] == len(texts) - 1)["kept"]
    assert quality_rules.report(docs.limit(0)).count() == 0


def test_quality_filter_keeps_columns(spark):
    docs = docs_frame(spark, hard_texts()).selectExpr("*", "1 as n_words", "2 as __x")
    assert quality_rules.quality_filter(docs).columns == docs.columns


def brute_em(patterns):
    """The same estimates in numpy, a text at a time."""
    votes = np.array([v for v, n in patterns for _ in range(n)])
    bad, said = votes < 0, votes != 0
    g, b, share = np.full(votes.shape[1], 0.02), np.full(votes.shape[1], 0.4), 0.9
    post = lambda: 1 / (1 + (1 - share) / share * np.prod(np.where(bad, b / g, np.where(said, (1 - b) / (1 - g), 1)), axis=1))
    for _ in range(quality_rules.ROUNDS):
        p = post()[:, None]
        g, b = (((bad * q).sum(0) + 20 * x) / ((said * q).sum(0) + 20) for q, x in ((p, 0.02), (1 - p, 0.4)))
        share = (p.sum() + 18) / (len(votes) + 20)
    return share, g, b, post()


def vote(**x):
    return tuple(x.get(name, 0) for name, _, _ in quality_rules.RULES)


def test_fit_is_expectation_maximisation():
    n = len(quality_rules.RULES)
    patterns = [((1,) * n, 900), (vote(length=1, symbols=-1, marks=-1), 60), (vote(length=1, lines=-1, symbols=1, marks=1, capitals=1), 9), ((0,) * n, 17), (vote(length=-1), 4)]
    share, g, b = quality_rules.fit(patterns)
    want = brute_em(patterns)
    assert np.allclose(share, want[0]) and np.allclose(g, want[1]) and np.allclose(b, want[2])
    p = [quality_rules.posterior(v, (share, g, b)) for v, m in patterns for _ in range(m)]
    assert np.allclose(p, want[3])
    assert p[0] > 0.99 and p[900] < 0.01 and p[970] >= 0.5
    assert quality_rules.fit([])[0] == 0.9


def test_a_vote_weighs_what_its_agreement_earns():
    """A bad vote that goes with others' bad votes weighs much, one that goes with good ones little."""
    n = len(quality_rules.RULES)
    lone = tuple(-1 if name == "lines" else 1 for name, _, _ in quality_rules.RULES)
    agrees = tuple(-1 if name in ("lines", "repeats", "stutters") else 1 for name, _, _ in quality_rules.RULES)
    noisy = quality_rules.fit([((1,) * n, 500), (lone, 400)])
    sure = quality_rules.fit([((1,) * n, 900), (lone, 2), (agrees, 200)])
    weight = lambda model: quality_rules.weights(model)[1][[r[0] for r in quality_rules.RULES].index("lines")][0]
    assert weight(noisy) > -1 and weight(sure) < -4
    assert quality_rules.posterior(lone, noisy) > 0.9 and quality_rules.posterior(agrees, sure) < 0.01


def test_posterior_and_kept_like_brute_force(spark):
    texts = [*hard_texts(), *(word_soup(i, 120) for i in range(20, 60)), *("##$ " * 80 + word_soup(i, 5) for i in range(8)), "one two three four " * 3]
    docs = docs_frame(spark, texts)
    seen, into = quality_rules.judge(docs)
    rows = seen.select("doc_id", *[v.alias(f"v{i}") for i, v in enumerate(quality_rules.votes(f"{into}`.`m"))], f"{into}.p", f"{into}.good").collect()
    counts = {}
    for r in rows:
        v = tuple(r[1:-2])
        counts[v] = counts.get(v, 0) + 1
    want = brute_em(list(counts.items()))[3]
    want = dict(zip([v for v, m in counts.items() for _ in range(m)], want))
    for r in rows:
        assert abs(r["p"] - want[tuple(r[1:-2])]) < 1e-9 and r["good"] == (r["p"] >= 0.5 and bool(metrics(texts[r["doc_id"]])[0]))


def test_verdicts_on_labelled_text(spark):
    """Nothing is fit to these labels; the rules see the texts alone."""
    for sf in ("sf0.01", "sf0.001"):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        kept = quality_rules.quality_filter(docs).select("doc_id", F.lit(True).alias("kept"))
        share = {r["quality"]: r["s"] for r in labels.join(docs, "doc_id").join(kept, "doc_id", "left").groupBy("quality").agg(F.avg(F.coalesce("kept", F.lit(False)).cast("int")).alias("s")).collect()}
        assert share[1] > 0.99 and share[0] < 0.1, sf


def test_clashing_names_pass(spark):
    names = ["__hs_m", "__HS_M_", "n_words", "m", "p", "x", "text.y"]
    docs = docs_frame(spark, [word_soup(1, 200), word_soup(2, 200)]).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)])
    out = quality_rules.quality_filter(docs)
    assert out.columns == docs.columns and [tuple(r)[5:] for r in out.collect()] == [tuple(range(len(names)))] * 2


def words10(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 0])
def test_decontaminate_like_brute_force(spark, most):
    items = {1: word_soup(7, 40), 2: "short item only", 3: None, 4: "!!", 5: word_soup(9, 12), 6: "short item only"}
    texts = [*hard_texts(), "xx " + items[1] + " yy", "A Short, ITEM only. " * 3, word_soup(7, 39) + items[5], word_soup(9, 11), "É é " + items[1].upper()]
    docs = docs_frame(spark, texts, extra=[(14, texts[14], "en", "s", 1), (None, "short item only", "", "", 0)])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = decontaminate.report(docs, bench, broadcast_bytes=most).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        w = words10("short item only" if r["doc_id"] is None else texts[r["doc_id"]])
        hit, found = set(), set()
        for k, t in items.items():
            v = words10(t)
            for win in {tuple(v[i : i + 10]) for i in range(max(1, len(v) - 9))} if v else ():
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(str(k))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    kept = decontaminate.drop_contaminated(docs.selectExpr("*", "1 as w", "2 as anchor"), bench)
    assert kept.columns == [*docs.columns, "w", "anchor"]
    assert kept.count() == sum(not r["contaminated"] for r in got)
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_url_rules_and_reputation(spark):
    urls = {
        0: "http://EXAMPLE.com/en/1", 1: "https://www.example.com/en/", 2: "https://a.www.example.com/en/x?y#z", 3: "ftp://x.net/es/", 4: "http://x.net/es", 5: "no scheme", 6: None,
        7: "http://com", 8: "http://com/", 9: "://h?x://y/z", 10: "http://notexample.com/en/", 11: "http://a.org#f/en/", 12: "http://É.Example.com/fr/", 13: "a\n://b.com/\n/c",
    }
    want = {
        0: ("example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/", "www.example.com/en/", "allow"), 2: ("a.www.example.com", "/en/x", "www.example.com/en/", "allow"),
        3: ("x.net", "/es/", "net/es/", "block"), 4: ("x.net", "/es", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("com", "", None, "allow"), 8: ("com", "/", "com/", "allow"),
        9: ("h", "", None, "allow"), 10: ("notexample.com", "/en/", "com/", "allow"), 11: ("a.org", "", None, "allow"), 12: ("É.example.com", "/fr/", "com/", "allow"), 13: ("b.com", "/\n/c", "com/", "allow"),
    }
    bad = [(100 + i, f"http://spam.evil.org/{i}") for i in range(30)] + [(200, "http://good.kind.org/1")]
    pages = spark.createDataFrame([*urls.items(), *bad, (1, urls[1])], "page_id long, url string")
    labels = spark.createDataFrame([(100 + i, 0, 0) for i in range(30)] + [(i, 1, 0) for i in range(12)] + [(200, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = url_filter.report(pages, labels).collect()
    assert len(got) == len(urls) + len(bad) + 1
    for r in got:
        if r["page_id"] in want:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == want[r["page_id"]], r
    assert all(r["verdict"] == ("block" if r["host"].startswith("spam") else "allow") for r in got if r["page_id"] >= 100)
    assert url_filter.report(pages.limit(0), labels).count() == 0
    assert url_filter.report(pages, labels.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_strengths_and_posterior_bound(spark):
    """Against the gamma function and a sum of the beta density."""
    grid = [(a / 4, b / 4) for a in (1, 3, 9, 40, 161, 900) for b in (2, 5, 12, 77, 400, 880)]
    d = spark.createDataFrame(grid, "a double, b double")
    for r in d.select("a", "b", url_filter.log_gamma(F.col("a")).alias("g"), url_filter.surely_above_half(F.col("a"), F.col("b")).alias("x")).collect():
        assert abs(r["g"] - math.lgamma(r["a"])) < 1e-9 * max(1, abs(r["g"]))
        if r["a"] > r["b"]:
            at = (np.arange(200_000) + 0.5) / 400_000
            below = np.exp((r["a"] - 1) * np.log(at) + (r["b"] - 1) * np.log1p(-at) + math.lgamma(r["a"] + r["b"]) - math.lgamma(r["a"]) - math.lgamma(r["b"])).sum() / 400_000
            assert r["x"] == (below <= 0.05) or abs(below - 0.05) < 1e-3, (r, below)
        else:
            assert not r["x"]
    rows = [(n, k, 0.3) for n, k in ((10, 10), (12, 0), (9, 9), (8, 0), (20, 1))]
    alike = [(20, 6, 0.3)] * 30
    log = lambda s, x: sum(math.lgamma(k + s * m) + math.lgamma(n - k + s * (1 - m)) - math.lgamma(n + s) + math.lgamma(s) - math.lgamma(s * m) - math.lgamma(s * (1 - m)) for n, k, m in x)
    for x in (rows, alike):
        assert url_filter.fitted(spark.createDataFrame(x, "n long, k long, up double")) == max(url_filter.GRID, key=lambda s: log(s, x))


def test_levels_of_hosts(spark):
    want = {"a.b.example.com": ("example.com", "com"), "a.co.uk": ("a.co.uk", "co.uk"), "b.a.co.uk": ("a.co.uk", "co.uk"), "1.2.3.4": ("1.2.3.4", ""), "com": ("com", "com"), "": ("", ""), "user@x.a.org:8080": ("a.org", "org")}
    d = spark.createDataFrame([(k,) for k in want], "h string").withColumn("b", url_filter.bare_of(F.col("h")))
    got = d.select("h", *[c.alias(n) for c, n in zip(url_filter.levels_of(F.col("b")), "ds", strict=True)]).collect()
    assert {r["h"]: (r["d"], r["s"]) for r in got} == want


def test_long_urls_and_clashing_columns(spark):
    long = "http://a.org/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long, "a", "b"), (2, None, "c", "d")], "page_id long, url string, __hs_url string, host string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    d, into = url_filter.judge_urls(pages, labels)
    rows = {r["page_id"]: r for r in d.collect()}
    assert d.columns == [*pages.columns, into] and rows[1][into]["path"] == long[12:] and rows[2]["__hs_url"] == "c"


def test_windows_meet_by_one_long(spark):
    docs = docs_frame(spark, [" ".join(f"w{i}" for i in range(40))])
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5, 20)))], "item_id long, text string")
    plan = decontaminate.scan(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join Inner" in x]
    assert len(joins) == 1 and joins[0].split("Join Inner, ")[1].count(" = ") == 1
