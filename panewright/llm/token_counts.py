"""Token counts of a unigram tokenizer by a Viterbi pass that counts only.

An Aho-Corasick automaton lists the vocabulary's matches in a text by where they end; the pass keeps the best score
of each place and the number of pieces that reach it, and no piece itself. At equal scores the longest last piece wins, as in
tokenizers' Unigram model, which tries starts in order and changes only for a better score.

No piece crosses the place before a space mark, nor a character that only stands alone in the vocabulary, so the best
path of a text is made of those of the segments between. Integer scores, as the public file has,
add up without rounding, so this holds for ties, too; a vocabulary with others is scored whole. What was counted
is kept in a table of bounded size.

The query's file, piece_bpe_32k.model, defines a BPE tokenizer; the public package has no unigram file. Its pieces and scores are read as
a Unigram model, without its normalizer, so counts are not those of the file's own tokenizer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MARK = "▁"
#: Fixed value: what an unknown character scores below the worst piece.
PENALTY = 10.0
KEPT = 300_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece file; the scores serve as log probabilities."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(k), float(p.get_score(k))) for k in range(p.get_piece_size())]


class Counter:
    def __init__(self, pieces: list[tuple[str, float]], kept: int = KEPT) -> None:
        self.pieces, self.kept = pieces, kept
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)
        self.unknown = min((s for _, s in pieces), default=0.0) - PENALTY
        self.known: dict[str, int] = {}
        self.single = {p for p, _ in pieces if len(p) == 1}
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        exact = all(s == int(s) for _, s in pieces)
        marked = any(MARK in p.lstrip(MARK) for p in names)
        joined = {c for p in names if len(p) > 1 for c in p}
        ends = "\n" if "\n" not in joined else ""
        #: Segments: spaces with what follows up to the next, and line ends alone, if the vocabulary allows it.
        self.segments = re.compile(f"{MARK}*[^{MARK}{ends}]+|[{ends}]|{MARK}+" if ends else f"{MARK}*[^{MARK}]+|{MARK}+") if exact and not marked else re.compile(r"(?s).+")

    def _plain(self, s: str) -> int:
        """viterbi() for a short text of which every character is a piece."""
        best, count, last = [0.0] * (len(s) + 1), [0] * (len(s) + 1), -1
        for end, (size, score) in self.automaton.iter(s):
            start = end + 1 - size
            got = best[start] + score
            if end != last or got > best[end + 1]:
                best[end + 1], count[end + 1], last = got, count[start] + 1, end
        return count[len(s)]

    def viterbi(self, s: str) -> int:
        """The number of pieces of the best path through s; a ring holds the places a piece can start from."""
        m, n = self.longest + 1, len(s)
        best, count = [0.0] * m, [0] * m
        single = -1
        at = 0
        top: float | None = None
        pieces = 0
        unknown = self.unknown
        weigh = (lambda c: len(c.encode("utf-8", "replace"))) if self.bytes else (lambda c: 1)
        runs = [False] * m  # whether a place is reached by an unknown character: without byte pieces neighbouring ones are one piece

        def close(at: int) -> None:
            before = at % m
            if single != at:  # no piece is this one character: it is unknown
                score = best[before] + unknown
                if top is None or score > top:
                    best[(at + 1) % m] = score
                    count[(at + 1) % m] = count[before] + (weigh(s[at]) if self.bytes else 0 if runs[before] else 1)
                    runs[(at + 1) % m] = True
                    return
            best[(at + 1) % m], count[(at + 1) % m], runs[(at + 1) % m] = top, pieces, False

        for end, (size, score) in self.automaton.iter(s):
            while at < end:
                close(at)
                at, top = at + 1, None
            start = end + 1 - size
            got = best[start % m] + score
            if top is None or got > top:
                top, pieces = got, count[start % m] + 1
            if size == 1:
                single = end
        while at < n:
            close(at)
            at, top = at + 1, None
        return count[n % m]

    def count(self, text: str | None) -> int:
        """The number of pieces of a text with a space before it; none for a null or empty one."""
        if not text:
            return 0
        known, total = self.known, 0
        for s in self.segments.findall(MARK + text.replace(" ", MARK)):
            n = known.get(s)
            if n is None:
                n = self._plain(s) if self.single.issuperset(s) and len(s) <= 64 else self.viterbi(s)
                if len(known) >= self.kept:
                    known.clear()
                if len(s) <= 64:
                    known[s] = n
            total += n
        return total


@lru_cache(2)
def counter(path: str) -> Counter:
    """One for each Python worker."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, n_tokens. Null and empty texts have none of either; repeated rows are counted each."""
    small_batches(docs.sparkSession)
    d = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([len(t or "") for t in texts], pa.int64()), pa.array([c.count(t) for t in texts], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n_chars bigint, n_tokens bigint")
