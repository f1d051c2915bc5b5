"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary's pieces that end at each place of a word; a dynamic program
carries the best score, the number of pieces on its path and whether it ends in an unknown one. Ties and
unknown characters follow the tokenizers library: of equal scores the one with the earlier start stays; a
character that is no piece of its own costs 10 less than the lowest score; unknown pieces in a row count once.
Spaces become the mark U+2581, one is put in front, and words are cut before each mark.

Vocabulary and scores are read from a public SentencePiece file (its control and byte pieces left out); they
are never trained here.

Defined cases: a null text counts as empty and has no tokens; repeated rows give a row each; texts of any
length are counted whole; extra columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from heliospark.llm.hashing import parts

MARK, UNKNOWN_COST, REMEMBERED = "▁", 10.0, 400_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score), the unknown piece first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return [("<unk>", 0.0), *plain]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]]):
        """pieces: the first is the unknown one."""
        self.matches = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            self.matches.add_word(piece, (len(piece), score, i == 0))
        self.matches.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_COST
        known = {c for p, _ in pieces for c in p}
        self.singles = {p for p, _ in pieces if len(p) == 1}
        self.runs = re.compile("[" + "".join(re.escape(c) for c in sorted(known)) + "]+|[^" + "".join(re.escape(c) for c in sorted(known)) + "]+")
        self.known = known
        self.words: dict[str, int] = {}
        self.cuts: dict[str, tuple[int, bool, bool]] = {}

    def path(self, run: str) -> tuple[int, bool, bool]:
        """(pieces, first is unknown, last is unknown) of the best path of a run of characters that pieces have."""
        n = len(run)
        scores, counts, first, last = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1), [False] * (n + 1)
        done = 0
        singles, unknown = self.singles, self.unknown
        best = None
        hits = self.matches.iter(run)
        hit = next(hits, None)
        for end in range(1, n + 1):
            best, done = None, 0
            while hit is not None and hit[0] == end - 1:
                size, score, is_unknown = hit[1]
                score += scores[end - size]
                if best is None or score > best:  # longer pieces come first
                    best, done, unk = score, size, is_unknown
                hit = next(hits, None)
            if run[end - 1] not in singles:
                score = scores[end - 1] + unknown
                if best is None or score > best:
                    best, done, unk = score, 1, True
            start = end - done
            scores[end] = best
            counts[end] = counts[start] + (not (unk and start and last[start]))
            first[end] = first[start] if start else unk
            last[end] = unk
        return counts[n], first[n], last[n]

    def word(self, word: str) -> int:
        total, after = 0, False
        for run in self.runs.findall(word):
            if run[0] in self.known:
                got = self.cuts.get(run)
                if got is None:
                    if len(self.cuts) > REMEMBERED:
                        self.cuts.clear()
                    got = self.path(run)
                    if n_short(run):
                        self.cuts[run] = got
            else:
                got = (1, True, True)
            total += got[0] - (after and got[1])
            after = got[2]
        return total

    def __call__(self, text: str) -> int:
        if not text:
            return 0
        text = text.replace(" ", MARK)
        if text[0] != MARK:
            text = MARK + text
        total, words = 0, self.words
        for w in text[1:].split(MARK):
            n = words.get(w)
            if n is None:
                n = self.word(MARK + w)
                if len(words) > REMEMBERED:
                    words.clear()
                if n_short(w):
                    words[w] = n
            total += n
        return total


def n_short(word: str) -> bool:
    """Whether a word may be remembered; long ones are counted again each time."""
    return len(word) <= 64


@functools.lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path)
        for b in (p for whole in batches for p in parts(whole, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(t) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_tokens long")
