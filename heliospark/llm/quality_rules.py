"""Quality rules by weak supervision, in DataFrame functions alone.

Each rule votes good, votes bad or abstains on a text. Expectation-maximisation over the counts of vote
patterns (at most 3 ** len(RULES) rows, whatever the corpus) estimates how often each rule votes bad on good and
on bad texts, and the share of good ones; an abstention says nothing. The estimates are maxima a posteriori:
PRIOR texts' worth of belief that rules are better than chance, which a corpus outweighs. Nothing is clamped,
so a vote weighs what its agreement with the other rules earns it. A text is kept if its posterior
probability of being good is at least KEEP_FROM; `report` adds the hard base rules, `quality_filter` does not.

Defined cases: a null text counts as empty; a text without words has all metrics 0, fails the base rules
and is not kept; repeated rows are judged one by one; an empty table gives an empty result; a null doc_id
stays null; other columns of the input, whatever their names, pass through `quality_filter` untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.llm.shared import fresh, let, stored

SPACES = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_wordless", "n_stutters", "n_lines"]
KEEP_FROM = 0.5
#: How many texts the beliefs below weigh; the share of good texts; how often a rule's vote is bad on good and on bad texts.
PRIOR, GOOD, BAD_IN_GOOD, BAD_IN_BAD = 20.0, 0.9, 0.02, 0.4
ROUNDS = 50

#: name, votes bad if, votes good if; between the two, a rule abstains. Shares say nothing of texts with fewer than FEW words.
FEW = 5
RULES: list[tuple[str, str, str]] = [
    ("length", "n_words < 2", "n_words >= 50"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 12 * n_words", "word_chars >= 3 * n_words and word_chars <= 9 * n_words"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("marks", "100 * n_marks > 15 * word_chars", "100 * n_marks <= 10 * word_chars"),
    ("wordless", "5 * n_wordless > n_words", "20 * n_wordless <= n_words"),
    ("lines", "2 * n_dup_lines > n_lines", "5 * n_dup_lines <= n_lines"),
    ("repeats", "100 * n_repeat_words > 40 * n_words", "100 * n_repeat_words <= 20 * n_words"),
    ("stutters", "5 * n_stutters > n_words", "20 * n_stutters <= n_words"),
    ("capitals", "2 * n_capitals > word_chars", "5 * n_capitals <= word_chars"),
]


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside a 3-word window that the text holds at least twice.

    A window's hash keeps its upper bits and gives the lower ones, as many as positions need, to the window's
    place; so one sort of longs brings equal windows together in the order of their places. Neighbours count
    as equal if their words are."""

    def windows(mask: Column) -> Column:
        # the hash takes the three words as one array; its values are mixed by position
        return F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(mask).bitwiseOR(i.cast("long")),
        )

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(mask: Column, s: Column) -> Column:
        last = F.size(s) - 1

        def same(a: Column, b: Column) -> Column:
            i, j = (x.bitwiseAND(F.bitwise_not(mask)).cast("int") for x in (a, b))
            return (a.bitwiseAND(mask) == b.bitwiseAND(mask)) & (words[i] == words[j]) & (words[i + 1] == words[j + 1]) & (words[i + 2] == words[j + 2])

        return F.sort_array(
            F.transform(
                F.filter(s, lambda x, k: ((k > 0) & same(x, F.get(s, k - 1))) | ((k < last) & same(x, F.get(s, k + 1)))),
                lambda x: x.bitwiseAND(F.bitwise_not(mask)),
            )
        )

    mask = F.call_function("shiftleft", F.lit(-1).cast("long"), F.length(F.bin(n.cast("long"))))
    return F.when(n >= 4, let(mask, lambda m: let(F.sort_array(windows(m)), lambda s: let(repeated(m, s), covered)))).otherwise(F.lit(0).cast("long"))


def metrics(text: Column) -> Column:
    """A struct of METRICS, as longs."""

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        count = lambda x: F.size(x).cast("long")
        chars = F.length(_without(t, " " + SPACES)).cast("long")
        return let(
            words_of(t),
            lambda w: let(
                lines,
                lambda ls: F.struct(
                    count(w).alias("n_words"),
                    chars.alias("word_chars"),
                    (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                    _repeat_words(w, F.size(w)).alias("n_repeat_words"),
                    F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
                    F.length(F.regexp_replace(t, r"[\p{L}\p{N}\x20\x09-\x0D]+", "")).cast("long").alias("n_marks"),
                    count(F.filter(w, lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).alias("n_wordless"),
                    count(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))).alias("n_stutters"),
                    count(ls).alias("n_lines"),
                ),
            ),
        )

    return let(F.coalesce(text.cast("string"), F.lit("")), of)


def votes(into: str) -> list[Column]:
    """One column per rule: 1 good, -1 bad, 0 abstains; `into` is a column of `metrics`."""

    def on(sql: str) -> Column:
        return F.expr(" ".join(f"`{into}`.{w}" if w in METRICS else w for w in sql.split(" ")))

    enough = on(f"n_words >= {FEW}")
    return [F.when(on(bad) & (F.lit(True) if name == "length" else enough), F.lit(-1)).when(on(good) & enough, F.lit(1)).otherwise(F.lit(0)) for name, bad, good in RULES]


Fit = tuple[float, list[float], list[float]]  # share of good texts; per rule, how often its vote is bad on good and on bad texts


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> Fit:
    """Expectation-maximisation over (votes, how many texts)."""
    n_rules = len(RULES)
    share, in_good, in_bad = GOOD, [BAD_IN_GOOD] * n_rules, [BAD_IN_BAD] * n_rules
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = 0.0
        bad_votes, all_votes = [[[0.0, 0.0] for _ in range(n_rules)] for _ in range(2)]
        for vote, n in patterns:
            p = posterior(vote, (share, in_good, in_bad))
            good += n * p
            for r, v in enumerate(vote):
                for k, weight in enumerate((n * p, n * (1 - p)) if v else ()):
                    all_votes[r][k] += weight
                    bad_votes[r][k] += weight * (v < 0)
        share = (good + PRIOR * GOOD) / (total + PRIOR)
        in_good = [(b[0] + PRIOR * BAD_IN_GOOD) / (a[0] + PRIOR) for b, a in zip(bad_votes, all_votes, strict=True)]
        in_bad = [(b[1] + PRIOR * BAD_IN_BAD) / (a[1] + PRIOR) for b, a in zip(bad_votes, all_votes, strict=True)]
    return share, in_good, in_bad


def weights(model: Fit) -> tuple[float, list[tuple[float, float]]]:
    """The log-odds of good texts, and for each rule what a bad and a good vote add to them."""
    share, in_good, in_bad = model
    return math.log(share / (1 - share)), [(math.log(g / b), math.log((1 - g) / (1 - b))) for g, b in zip(in_good, in_bad, strict=True)]


def posterior(vote: tuple[int, ...], model: Fit) -> float:
    odds, by_rule = weights(model)
    odds += sum((bad if v < 0 else good) for v, (bad, good) in zip(vote, by_rule, strict=True) if v)
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame, text: str = "text", keep_columns: list[str] | None = None) -> tuple[DataFrame, str]:
    """keep_columns (all unless given) of docs and one struct more, whose name is returned too: m (metrics), p (posterior), base_failed and good.

    The texts are read once; the metrics, with the columns asked for, are a table in the shared folder."""
    cols = docs.columns if keep_columns is None else keep_columns
    into = fresh("__hs_m", docs.columns)
    seen = stored(docs.select(*[F.col(f"`{c}`") for c in cols], metrics(F.col(f"`{text}`")).alias(into)))
    pattern = F.concat_ws(",", *[v.cast("string") for v in votes(into)])
    counts = seen.groupBy(pattern.alias("p")).count().collect()  # at most 3 ** len(RULES) rows
    prior, by_rule = weights(fit([(tuple(map(int, r["p"].split(","))), r["count"]) for r in sorted(counts)]))
    odds = F.lit(prior)
    for v, (bad, good) in zip(votes(into), by_rule, strict=True):
        odds = odds + F.when(v < 0, F.lit(bad)).when(v > 0, F.lit(good)).otherwise(F.lit(0.0))
    m = F.col(f"`{into}`")
    failed = (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    p = 1 / (1 + F.exp(-odds))
    verdict = F.struct(m.alias("m"), p.alias("p"), failed.alias("base_failed"), ((m["n_words"] > 0) & (p >= KEEP_FROM)).alias("good"))
    return seen.withColumn(into, verdict), into


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules' joint verdict keeps, with their own columns."""
    seen, into = judge(docs, text)
    return seen.where(F.col(f"`{into}`.good")).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """The rows of the contract for op7; p_good is rounded."""
    seen, into = judge(docs, keep_columns=["doc_id"])
    x = F.col(f"`{into}`")
    return seen.select(
        "doc_id",
        *[x["m"][c].alias(c) for c in METRICS[:5]],
        x["base_failed"].alias("base_failed"),
        (~x["base_failed"] & x["good"]).alias("kept"),
        F.round(x["p"], 6).alias("p_good"),
    )
