"""Personal data by a semi-Markov conditional random field.

Tokens with a digit, an `@` or a spelt-out "at", and the few around them, form islands. Inside an island every
run of up to MAX_TOKENS tokens whose counts are within the bounds of a type is a candidate segment of it; no
pattern stands before that. Features of the whole span (its shape, digit groups, checks, separators, the word
before it) are weighted, and a dynamic program picks the boundaries and types of the best-scoring
segmentation. Weights are learnt here: stochastic gradient on the conditional log-likelihood of segmentations,
with forward and backward sums, over sentences that a generator writes. They are fit once, on the driver.
The base patterns are found beside it and always stay; segments that overlap one are not added.

Defined cases: a null or empty text has no spans; repeated rows give a row each; texts of any length, and spans
of any length in characters, are scanned whole and in linear time; other columns of the input pass through
`redact` untouched.
"""

from __future__ import annotations

import functools
import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm import spans as S

#: The base kinds in their order, and their patterns.
BASE = ["email", "ip", "card", "phone"]
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TYPES = ["email", "ip", "card", "phone", "national_id"]
KINDS = [*BASE, *(f"crf_{t}" for t in TYPES)]
MAX_TOKENS = 8
#: Least and most digits, at-marks and groups of digits of a segment of a type.
BOUNDS = {"email": ((0, 40), (1, 1), (0, 9)), "ip": ((4, 32), (0, 0), (1, 32)), "card": ((12, 19), (0, 0), (1, 7)), "phone": ((7, 15), (0, 0), (1, 6)), "national_id": ((5, 12), (0, 0), (1, 4))}
TOKEN = re.compile(r"[^\s,;:!?\"'<>\[\]{}|]+")
#: An at-mark; the plain word is one only before a name with a dot or a spelt-out dot.
AT = re.compile(r"@|\(at\)|\[at\]|(?<=\s)(?:at|AT)(?=\s+\S+?(?:\.[A-Za-z]|\s+\(?(?:dot|DOT)\b))")
MARK = re.compile(rf"[0-9]+|{AT.pattern}")
#: Tokens that belong to an island before its first and after its last mark, and between two marks.
BEFORE, AFTER, GAP = 3, 4, 3
SPELT_AT, SPELT_DOT = re.compile(r"\s*(?:\(at\)|\[at\])\s*|\s+(?:at|AT)\s+"), re.compile(r"\s*\(dot\)\s*|\s*\[dot\]\s*|\s+(?:dot|DOT)\s+")
#: Words before a span that say what it is.
CUES = {
    "email": "email", "e-mail": "email", "mail": "email", "contact": "email", "ip": "ip", "host": "ip", "server": "ip", "address": "ip", "card": "card", "visa": "card", "credit": "card", "mastercard": "card", "tel": "phone",
    "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "ssn": "national_id", "passport": "national_id", "social": "national_id", "nif": "national_id",
}
DIGITS = re.compile(r"[0-9]")
GROUPS = re.compile(r"[0-9]+")
WORDS, NUMBERS, BLANKS, NOT_PLAIN = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+"), re.compile(r"\s{2,}"), re.compile(r"[\W_]")


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])
    return total % 10 == 0


def find_base(text: str) -> list[tuple[str, int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > end and text[s - 1] in LOCAL:
            s -= 1
        m = AT_DOMAIN.match(text, at) if s < at else None
        if m:
            out.append(("email", s, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", end)
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x) <= 3 and int(x or "0") <= 255 for x in (p.lstrip("0") for p in m[0].split(".")))]
    for kind, pattern, least, most in (("card", CARD, 16, 19), ("phone", PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = "".join(DIGITS.findall(m[0]))
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def features(text: str, a: int, b: int, kinds: list[str], before: str) -> list[list[str]]:
    """Of a whole candidate span under each of the types."""
    span = BLANKS.sub(" ", text[a:b])  # a wide gap counts as one blank, and costs no more than that below
    groups = GROUPS.findall(span)
    digits = "".join(groups)
    bare = NUMBERS.sub("9", WORDS.sub("a", span))
    seps = "".join(sorted(set(NOT_PLAIN.findall(span))))
    goes_on = (a > 1 and text[a - 1] in ".-:@/" and text[a - 2].isalnum(), text[b : b + 1] in (".", "-", ":", "@", "/") and text[b + 1 : b + 2].isalnum())
    cue = CUES.get(before.lower().strip(".:()#")) if len(before) < 40 else None
    sizes = "-".join(str(min(len(g), 9)) for g in groups)
    all_out = []
    for kind in kinds:
        plain = SPELT_DOT.sub(".", SPELT_AT.sub("@", span)) if kind == "email" else span
        shape = bare if plain == span else NUMBERS.sub("9", WORDS.sub("a", plain))
        out = [f"{kind} bias", f"{kind} goes on {goes_on}", f"{kind} digits {min(len(digits), 20)}", f"{kind} shape {shape}", f"{kind} seps {seps}"]
        if kind == "email":
            user, _, host = plain.partition("@")
            labels = host.split(".")
            spelt = ("@" not in span and "(at)" not in span and "[at]" not in span, bool(SPELT_DOT.search(span)))
            top = labels[-1][:6].lower() if len(labels[-1]) < 6 else f"{labels[-1][:5].lower()} and more"
            out += [f"email spelt {spelt}", f"email spelt {spelt} top {top}", f"email user {bool(user) and ' ' not in user}", f"email host {len(labels) > 1 and all(labels) and ' ' not in host}", f"email last {min(len(labels[-1]), 7) if labels[-1].isalpha() else 0}", f"email top {top}"]
        else:
            out += [f"{kind} groups {sizes}", f"{kind} letters {'a' in bare}"]
        if kind == "card":
            out.append(f"card luhn {len(digits) >= 12 and luhn(digits)}")
        if kind == "ip":
            parts = span.split(".")
            out.append(f"ip parts {len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts)}")
            words = span.split(":")
            out.append(f"ip six {len(words) >= 4 and all(len(x) <= 4 and all(c in '0123456789abcdefABCDEF' for c in x) for x in words)}")
        if kind == "phone":
            out += [f"phone first {span[0] if not span[0].isdigit() else span[:1] == '0'}", f"phone spread {len(groups) > 1}"]
        out.append(f"{kind} cue {cue == kind if cue else None}")
        all_out.append(out)
    return all_out


Tokens = list[tuple[int, int]]


def candidates(text: str, tokens: Tokens, first_before: str) -> list[list[tuple[int, str, int, int, list[str]]]]:
    """By last token: (first token, type, start, end, features) of the segments within bounds."""
    digits, ats, groups = [0], [0], [0]
    for a, b in tokens:
        t = text[a:b]
        found = GROUPS.findall(t)
        digits.append(digits[-1] + sum(map(len, found)))
        groups.append(groups[-1] + len(found))
        ats.append(ats[-1] + (1 if t in ("at", "AT") else t.count("@") + t.count("(at)")))
    out: list[list] = [[]]
    for j in range(1, len(tokens) + 1):
        here: list = []
        for i in range(max(0, j - MAX_TOKENS), j):
            sizes = [x[j] - x[i] for x in (digits, ats, groups)]
            kinds = [k for k in TYPES if all(low <= x <= high for x, (low, high) in zip(sizes, BOUNDS[k], strict=True))]
            if not kinds:
                continue
            a, b = tokens[i][0], tokens[j - 1][1]
            while b > a and text[b - 1] in ".-(":
                b -= 1
            if b > a:
                before = text[slice(*tokens[i - 1])] if i else first_before
                here += [(i, k, a, b, f) for k, f in zip(kinds, features(text, a, b, kinds, before), strict=True)]
        out.append(here)
    return out


def segment(text: str, tokens: Tokens, first_before: str, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The best segmentation of an island into typed spans and single outside tokens (which score nothing)."""
    best, back = [0.0], [None]
    for j, here in enumerate(candidates(text, tokens, first_before)[1:], 1):
        score, how = best[j - 1], None
        for i, kind, a, b, f in here:
            s = best[i] + sum(weights.get(x, 0.0) for x in f)
            if s > score:
                score, how = s, (i, kind, a, b)
        best.append(score)
        back.append(how)
    out, j = [], len(tokens)
    while j:
        if back[j]:
            j, kind, a, b = back[j]
            out.append((kind, a, b))
        else:
            j -= 1
    return out[::-1]


def islands(text: str):
    """(tokens, the word before them) around marks."""
    marks = MARK.finditer(text)
    mark = next(marks, None)
    waiting: list[tuple[int, int]] = []  # the last few tokens outside
    run: list[tuple[int, int]] = []
    before, since = "", 0
    for m in TOKEN.finditer(text) if mark else ():
        span, hit = m.span(), False
        while mark and mark.start() < span[1]:
            hit = hit or mark.end() > span[0]
            mark = next(marks, None)
        if run:
            run.append(span)
            since = 0 if hit else since + 1
            if since > max(GAP, AFTER):
                yield run[:-1], before
                waiting, run = run[-BEFORE - 1 :], []
        elif hit:
            before = text[slice(*waiting[0])] if len(waiting) > BEFORE else ""
            run, since = [*waiting[-BEFORE:], span], 0
        else:
            waiting = [*waiting[-BEFORE:], span]
        if not (run or waiting) or (not mark and not run):
            break
    if run:
        yield run, before


def examples(rounds: int, seed: int):
    """Sentences with typed spans, written by a generator; numbers and words that are no personal data stand among them."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(2, 10)))

    def card() -> str:
        body = r.choice("3456") + d(r.choice([13, 14, 14, 14]))
        body += next(c for c in "0123456789" if luhn(body + c))
        return r.choice(["", " ", "-", "."]).join(body[i : i + 4] for i in range(0, len(body), 4))

    def email() -> str:
        user = r.choice(["", ".", "_", "-"]).join(w() for _ in range(r.randrange(1, 3))) + r.choice(["", d(2)])
        at, dot = r.choice([("@", "."), (" (at) ", "."), ("(at)", "."), (" at ", "."), (" at ", " dot "), (" at ", " dot "), (" [at] ", "."), (" (at) ", " (dot) ")])
        return user + at + dot.join([*(w() + r.choice(["", "", d(1)]) for _ in range(r.randrange(1, 3))), r.choice(["com", "org", "de", "fr", "info", "net"])])

    def phone() -> str:
        sep = r.choice([" ", "-", "."])
        area = r.choice([f"({d(3)})", f"0{d(2)}", f"({d(2)})", d(3), f"00{d(2)}{sep}{d(3)}", f"00{d(2)} (0){d(2)}"])
        return area + r.choice([" ", sep]) + sep.join(d(r.choice([2, 3, 4])) for _ in range(r.choice([2, 2, 3])))

    def ip() -> str:
        return ".".join(str(r.randrange(256)) for _ in range(4)) if r.random() < 0.5 else ":".join(f"{r.randrange(65536):x}" for _ in range(r.choice([6, 8])))

    def national() -> str:
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{r.choice('ABKX')}{r.choice('CMTZ')}{d(6)}{r.choice(['', 'A', 'D'])}", f"{d(8)}-{r.choice('ABCDEFGH')}", f"{d(8)}{r.choice('ABCDEFGH')}"])

    make = {"email": email, "ip": ip, "card": card, "phone": phone, "national_id": national}
    other = [
        lambda: d(r.randrange(1, 13)), lambda: f"{d(r.randrange(1, 4))}.{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: d(16), lambda: " ".join(d(2) for _ in range(r.randrange(2, 7))), lambda: f"{d(3)}.{d(3)}.{d(3)}.3{d(2)}",
        lambda: " ".join(d(4) for _ in range(r.randrange(1, 6))), lambda: f"{d(2)}/{d(2)}/20{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{w()}{d(3)}", lambda: f"{d(3)} to {d(3)}", lambda: f"{w()} at {w()}.{w()} {w()}",
        lambda: f"{w()} @ {d(2)}", lambda: f"pp. {d(3)}-{d(3)}", lambda: f"1-2-3-{d(1)}-{d(1)}", lambda: f"20{d(2)} 20{d(2)} 20{d(2)}",
    ]
    cue = defaultdict(list)
    for word, t in CUES.items():
        cue[t].append(word)
    for _ in range(rounds):
        for kind in (*TYPES, "email"):
            text = f"{w()} {r.choice([d(2), w()])} {r.choice([*cue[kind], w(), w(), 'the', 'of'])}{r.choice(['', ':'])} "
            start = len(text)
            text += make[kind]()
            end = len(text)
            yield text + r.choice([" ", ", ", ". "]) + f"{w()} {r.choice([w(), d(3)])} {w()} {w()}", [(kind, start, end)]
        for f in other:
            yield f"{w()} {r.choice([w(), *CUES])} {f()} {w()} {w()} {w()} {r.choice(other)()} {w()} {w()}", []


@functools.lru_cache(1)
def learnt(rounds: int = 60, epochs: int = 8, batch: int = 16, seed: int = 11) -> dict[str, float]:
    """Weights that make the examples' own segmentations likely; adaptive steps over batches of islands, and weights pulled to zero a little."""
    number: dict[str, int] = {}
    data = []
    for text, gold in examples(rounds, seed):
        for tokens, before in islands(text):
            data.append((len(tokens), [(i, j, (k, a, b) in gold, [number.setdefault(x, len(number)) for x in f]) for j, here in enumerate(candidates(text, tokens, before)) for i, k, a, b, f in here]))
    random.Random(seed).shuffle(data)
    weights, squares = np.zeros(len(number)), np.zeros(len(number))
    batches = [_batch(data[k : k + batch]) for k in range(0, len(data), batch)]
    for epoch in range(epochs):
        for k in np.random.default_rng(seed + epoch).permutation(len(batches)):
            size, at, i, j, gold, of, feats = batches[k]
            s = np.bincount(of, weights[feats], len(at))
            longest, rows = int(size.max()), np.arange(len(size))
            ahead, behind = np.full((len(size), longest + 1), -np.inf), np.full((len(size), longest + 1), -np.inf)
            ahead[:, 0], behind[rows, size] = 0, 0
            cuts = np.searchsorted(j, np.arange(longest + 2))
            for e in range(1, longest + 1):
                c = slice(cuts[e], cuts[e + 1])
                ahead[:, e] = ahead[:, e - 1]
                np.logaddexp.at(ahead[:, e], at[c], ahead[at[c], i[c]] + s[c])
            for e in range(longest, 0, -1):
                c = slice(cuts[e], cuts[e + 1])
                behind[:, e - 1] = np.logaddexp(behind[:, e - 1], behind[:, e])
                np.logaddexp.at(behind, (at[c], i[c]), s[c] + behind[at[c], e])
            p = np.exp(ahead[at, i] + s + behind[at, j] - ahead[rows, size][at])
            used = np.unique(feats)
            g = np.bincount(feats, (gold - p)[of], len(number))[used] - 1e-3 * weights[used]
            squares[used] += g * g
            weights[used] += 0.5 * g / np.sqrt(squares[used] + 1e-8)
    return {x: float(weights[n]) for x, n in number.items()}


def _batch(islands_of: list) -> tuple[np.ndarray, ...]:
    """Sizes of the islands; of their segments by last token: island, first token, last token, whether right; and the features with the segment of each."""
    rows = sorted(((e, x) for e, (_, here) in enumerate(islands_of) for x in here), key=lambda r: r[1][1])
    at, i, j, gold = (np.array(c) for c in zip(*((e, x[0], x[1], x[2]) for e, x in rows), strict=True))
    of = np.repeat(np.arange(len(rows)), [len(x[3]) for _, x in rows])
    return np.array([n for n, _ in islands_of]), at, i, j, gold, of, np.array([f for _, x in rows for f in x[3]])


def find_pii(text: str, weights: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as listed and then by start."""
    if not MARK.search(text):
        return []
    weights = learnt() if weights is None else weights
    out = find_base(text)
    base = sorted((a, b) for _, a, b in out)
    i = reach = 0
    for tokens, before in islands(text):
        for kind, a, b in segment(text, tokens, before, weights):
            while i < len(base) and base[i][0] < b:
                reach = max(reach, base[i][1])
                i += 1
            if reach <= a:
                out.append((f"crf_{kind}", a, b))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.removeprefix('crf_').upper()}]"]
        elif b > done:
            out.append("")
        done = max(done, b)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """columns of docs and __hs_spans."""
    return S.find(docs, functools.partial(find_pii, weights=learnt()), columns, text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its type in brackets, and __hs_spans (places in the old text)."""
    return S.find(docs, functools.partial(find_pii, weights=learnt()), docs.columns, text, mask)


def report(docs: DataFrame) -> DataFrame:
    """The rows of the contract for op10."""
    found = scan(docs, ["doc_id"])
    s = F.col(found.columns[-1])
    return found.select(
        "doc_id", *[S.count(s, k).alias(f"n_{k}") for k in BASE], F.sha2(S.joined(S.of_kinds(s, BASE)), 256).alias("base_sha256"), S.joined(s).alias("spans")
    )
