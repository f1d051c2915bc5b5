"""Secret scans by assignment-aware lexing.

Around every `:` and `=` the lexer reads a target name to the left and a literal to the right: a quoted
string, a bare value, a concatenation of strings, or the name of an earlier constant, whose literal it then
stands for. A literal is scored by how sensitive its target name sounds and how much its characters look
like a credential. The base patterns are found beside it and always stay; a literal inside a base span is
not reported again. Inside a bare value, each further `:` takes only what stands up to the next one.

A constant is a summary of its characters and the literals and constants it is made of. Sums of constants
merge summaries, and scores go back to literals in one pass at the end, so that no chain of constants costs more
than its links.

Defined cases: a null or empty text has no spans; repeated rows give a row each; texts of any length are
scanned whole and in linear time; other columns of the input pass through `redact` untouched.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm import spans as S

#: The base kinds in their order, and their patterns.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "literal"]
ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words in a target name and what they add to a literal's score.
NAME_SCORES = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "pass": 2.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api": 1.0, "key": 1.5, "private": 1.5, "credential": 2.5,
    "credentials": 2.5, "auth": 1.5, "bearer": 2.0, "access": 1.0, "signing": 1.5, "encryption": 1.5, "salt": 1.5, "pin": 1.0, "session": 1.0, "client": 0.5, "public": -3.0, "name": -2.0,
    "path": -2.0, "file": -2.0, "url": -2.0, "id": -1.0, "length": -3.0, "type": -2.0, "label": -2.0, "hint": -3.0,
}
REPORT_FROM = 4.0
PLACEHOLDER = re.compile(r"(?i)^(?:none|null|nil|true|false|undefined|changeme|example|test|todo|x+|\*+|\.+|-+|<.*>|\$\{.*\}|%\w+%|your.*)$")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-$")
LITERAL = re.compile(r"""[ \t]*(?:[bru]{0,2}"((?:[^"\\\n]|\\.)*+)"|[bru]{0,2}'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([^\s"'`,;(){}\[\]<>=]++={0,2}))""")
#: A further value inside a bare one.
INNER = re.compile(r"""([^\s"'`,;(){}\[\]<>=:]++={0,2})""")
BRACKETS = [("<", ">"), ("${", "}"), ("%", "%")]
PLUS = re.compile(r"[ \t]*[+.&][ \t]*(?=[\"'`A-Za-z_])")
NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_.$]*")
OPERATOR = re.compile(r"[:=]")


def name_score(name: str) -> float:
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    return sum(NAME_SCORES.get(p, 0.0) for p in parts) + (1.0 if "api" in parts and "key" in parts else 0.0)


class Value:
    """What scoring needs to know of a string, of any length; + is concatenation."""

    __slots__ = ("size", "counts", "flags", "head", "tail", "other", "lead", "trail", "inner", "solid")

    @classmethod
    def of(cls, text: str) -> Value:
        v = cls()
        found = Counter(text)
        v.size, v.counts = float(len(text)), [0.0] * 128
        for c, n in found.items():
            v.counts[ord(c) & 127] += n
        has = lambda f: any(map(f, found))
        v.flags = (has(str.islower), has(str.isupper), has(str.isdigit), has(lambda c: not c.isalnum()), not has(lambda c: not c.isdigit()))
        v.other = float(sum(n for c, n in found.items() if not (c.isalnum() or c == "_")))
        v.head, v.tail = text[:16], text[-1:]
        bare = text.strip()
        v.solid, v.inner = bool(bare), " " in bare
        v.lead = " " in text[: len(text) - len(text.lstrip())]
        v.trail = " " in text[len(text.rstrip()) :]
        return v

    def __add__(self, b: Value) -> Value:
        v = Value()
        # shares of characters matter, and sizes only if they are small
        shrink = 1.0 if self.size + b.size < 1e12 else 1e-6
        v.size = (self.size + b.size) * shrink
        v.counts = [(x + y) * shrink for x, y in zip(self.counts, b.counts, strict=True)]
        v.flags = (*(x or y for x, y in zip(self.flags[:4], b.flags[:4], strict=True)), self.flags[4] and b.flags[4])
        v.other = (self.other + b.other) * shrink if shrink < 1 else self.other + b.other
        v.head, v.tail = (self.head + b.head)[:16] if len(self.head) < 16 else self.head, b.tail or self.tail
        v.solid = self.solid or b.solid
        v.inner = self.inner or b.inner or (self.solid and b.solid and (self.trail or b.lead))
        v.lead = self.lead or (not self.solid and b.lead)
        v.trail = b.trail or (not b.solid and self.trail)
        return v

    def score(self) -> float:
        """Length, spread of characters and mix of classes; placeholders and sentences score below nothing."""
        if self.size < 6 or self.placeholder():
            return -9.0
        if self.inner:
            return -3.0
        spread = -sum(c / self.size * math.log2(c / self.size) for c in self.counts if c)
        return min(spread, 4.5) / 1.5 + 0.5 * (sum(self.flags[:4]) - 1) + (0.5 if self.size >= 16 else 0.0) - (2.0 if self.flags[4] else 0.0)

    def placeholder(self) -> bool:
        if self.size <= 16 and PLACEHOLDER.fullmatch(self.head):
            return True
        most = max(self.counts)
        same = most == self.size or self.counts[ord("x")] + self.counts[ord("X")] == self.size
        return (same and self.head[:1] in {*"xX*.-"}) or self.head[:4].lower() == "your" or any(self.head.startswith(a) and self.tail == b and (a != "%" or (self.other == 2 and self.size > 2)) for a, b in BRACKETS)


class Node:
    """A literal (span) or a sum of nodes, and the best score of a name that it was given to."""

    __slots__ = ("value", "span", "parts", "best")

    def __init__(self, value: Value, span: tuple[int, int] | None, parts: list[Node]):
        self.value, self.span, self.parts, self.best = value, span, parts, 0.0


def _literal_at(text: str, at: int, known: dict[str, Node], longest: int, nodes: list[Node], inside: int) -> tuple[Node, int, bool] | None:
    """The value at `at`, where it ends, and whether that is a bare one; new nodes are appended. Up to `inside` a bare value goes on that was read before."""
    parts, bare = [], False
    while m := LITERAL.match(text, at) if at >= inside else INNER.match(text, at):
        k, bare = m.lastindex, m.lastindex == 4 or at < inside
        a, b = m.span(k)
        part = m[k] if b - a <= longest else None  # no constant so far has a longer name
        constant = bare and part is not None and part in known and NAME.fullmatch(part)
        if constant:
            parts.append(known[part])
        else:
            parts.append(Node(Value.of(text[a:b]), (a, b), []))
            nodes.append(parts[-1])
        at = m.end()
        if (bare and not constant) or not (plus := PLUS.match(text, at)):
            break
        at = plus.end()
    if not parts:
        return None
    if len(parts) == 1:
        return parts[0], at, bare
    value = parts[0].value
    for p in parts[1:]:
        value = value + p.value
    nodes.append(Node(value, None, parts))
    return nodes[-1], at, bare


def literals(text: str) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals that reach REPORT_FROM under some target name."""
    known: dict[str, Node] = {}
    nodes: list[Node] = []
    done = inside = longest = 0
    for op in OPERATOR.finditer(text):
        p = op.start()
        if p < done:
            continue
        j = p
        if j and text[j - 1] in ":?!+-|&":
            j -= 1
        while j > done and text[j - 1] in " \t":
            j -= 1
        if j > done and text[j - 1] in "\"'`]":
            j -= 1
        e = j
        while j > done and text[j - 1] in NAME_CHARS:
            j -= 1
        if j == e:
            continue
        name, at = text[j:e], p + 1
        while at < len(text) and text[at] in "=>~":
            at += 1
        got = _literal_at(text, at, known, longest, nodes, inside)
        if not got:
            continue
        node, end, bare = got
        known[name.rsplit(".", 1)[-1]] = known[name] = node
        longest = max(longest, len(name))
        if (s := name_score(name)) > 0 and s + (v := node.value.score()) >= REPORT_FROM:
            node.best = max(node.best, s + v)
        if not bare:
            done = end
        inside = max(inside, end) if bare else inside
    best: dict[tuple[int, int], float] = {}
    for node in reversed(nodes):  # parts come before what is made of them
        if node.best:
            for part in node.parts:
                part.best = max(part.best, node.best)
            if node.span:
                best[node.span] = max(best.get(node.span, 0.0), node.best)
    return [(a, b, s) for (a, b), s in sorted(best.items())]


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then by kind as listed."""
    out = []
    named = "=" in text or ":" in text
    if named:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    if named:
        base = sorted((a, b) for _, a, b in out)
        i, reach = 0, 0
        for a, b, _ in literals(text):
            while i < len(base) and base[i][0] <= a:
                reach = max(reach, base[i][1])
                i += 1
            if reach < b:
                out.append(("literal", a, b))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, done = [], 0
    for _, a, b in sorted(spans, key=lambda x: x[1:]):
        if a >= done:
            out += [text[done:a], "[SECRET]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def scan(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """columns of docs and __hs_spans."""
    return S.find(docs, find_secrets, columns, text)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced, and __hs_spans (places in the old text)."""
    return S.find(docs, find_secrets, docs.columns, text, mask)


def report(docs: DataFrame) -> DataFrame:
    """The rows of the contract for op2."""
    found = scan(docs, ["doc_id"])
    s = F.col(found.columns[-1])
    return found.select(
        "doc_id", *[S.count(s, k).alias(f"n_{k}") for k in BASE], F.sha2(S.joined(S.of_kinds(s, BASE)), 256).alias("base_sha256"), S.joined(s).alias("spans")
    )
