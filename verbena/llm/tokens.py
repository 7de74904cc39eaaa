"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic
programming keeps, for each character, the best score of a segmentation that ends there and the
number of its pieces, but no path. Ties follow the unigram tokenizer's rule: candidates come
from the earliest start to the latest (the longest piece first) and only a strictly better score
replaces the present one; a character that is no piece costs the least score less 10, and counts
as its UTF-8 bytes (byte fallback). Scores are added exactly, as integers over a common
denominator; a tokenizer that adds in single precision can differ on texts long enough to round.

No piece holds a space after another character, so every best segmentation is cut before each
run of spaces; the units between are counted once for each batch and kept in a bounded memo of
the worker, which changes the time and never a count.

Defined cases: a null or empty text has 0 tokens; blanks are pieces like other characters; one
row comes out for each row, repeated rows and null ids included; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, hash_spans

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10
SPACE = "▁"
MEMO_UNITS = 1_000_000
MAX_PIECES = 1_000_000


@dataclass
class Unigram:
    """A unigram vocabulary with exact integer scores; prefixes the text with a space and keeps all white space."""

    pieces: dict[str, float]
    unknown: float | None = None
    scores: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        exact = {p: Fraction(s) for p, s in self.pieces.items()}
        unknown = min(exact.values()) - UNKNOWN_PENALTY if self.unknown is None else Fraction(self.unknown)
        scale = math.lcm(unknown.denominator, *(s.denominator for s in exact.values()))
        self.scores = {p: int(s * scale) for p, s in exact.items()}
        self.unknown_score = int(unknown * scale)
        self.cut = not any(SPACE in p.lstrip(SPACE) for p in self.pieces)
        self.single = {p for p in self.pieces if len(p) == 1}
        self._automaton, self._memo = None, {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_memo": {}}

    def viterbi(self, text: str) -> tuple[int, int]:
        """Best score and number of pieces of a text whose spaces are escaped."""
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for p, s in self.scores.items():
                self._automaton.add_word(p, (len(p), s))
            self._automaton.make_automaton()
        n, single, unknown = len(text), self.single, self.unknown_score
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = done = 0
        for end, (length, score) in self._automaton.iter(text):
            while done < end:
                done += 1
                c = text[done - 1]
                if c not in single:
                    self._unknown(c, best, count, done)
            start = end + 1 - length
            score += best[start]
            now = best[end + 1]
            if now is None or score > now:
                best[end + 1], count[end + 1] = score, count[start] + 1
        while done < n:
            done += 1
            c = text[done - 1]
            if c not in single:
                self._unknown(c, best, count, done)
        return best[n], count[n]

    def _unknown(self, c: str, best: list, count: list[int], at: int) -> None:
        score = best[at - 1] + self.unknown_score
        if best[at] is None or score > best[at]:
            best[at], count[at] = score, count[at - 1] + len(c.encode("utf-8", "replace"))

    def _unit(self, unit: bytes) -> int:
        found = self._memo.get(unit)
        if found is None:
            if len(self._memo) >= MEMO_UNITS:
                self._memo.clear()
            found = self._memo[unit] = self.viterbi(unit.decode().replace(" ", SPACE))[1]
        return found

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Pieces of each text."""
        out = np.zeros(len(texts), np.int64)
        for lo, hi in chunks(texts, 1 << 22):
            data = [(" " + t.replace(SPACE, " ")).encode("utf-8", "replace") if t else b"" for t in texts[lo:hi]]
            sizes = np.fromiter(map(len, data), np.int64, len(data))
            buf = np.frombuffer(b"".join(data), np.uint8)
            if not len(buf):
                continue
            ends = np.cumsum(sizes)
            first = (ends - sizes)[sizes > 0]
            if self.cut:
                blank = buf == 32
                blank[1:] &= ~blank[:-1].copy()
                blank[first] = True
                start = np.flatnonzero(blank)
            else:
                start = first
            end = np.append(start[1:], len(buf))
            _, at, back = np.unique(hash_spans(buf, start, end), return_index=True, return_inverse=True)
            raw = buf.tobytes()
            each = np.fromiter((self._unit(raw[s:e]) for s, e in zip(start[at].tolist(), end[at].tolist())), np.int64, len(at))
            out[lo:hi] = np.bincount(np.searchsorted(ends, start, "right"), weights=each[back], minlength=len(data)).astype(np.int64)
        return out


def read_vocabulary(path: str = VOCABULARY) -> Unigram:
    """The pieces and scores of a vocabulary file with byte fallback, read as a unigram vocabulary."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    if not any(sp.is_byte(i) for i in ids):
        raise ValueError(f"{path} has no byte pieces")
    return Unigram({sp.id_to_piece(i): sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))})


def token_counts(docs: DataFrame, vocabulary: Unigram | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens), one for each row; nothing is shuffled. The vocabulary, of MAX_PIECES pieces at most, is sent once to each executor."""
    vocabulary = vocabulary or read_vocabulary()
    if len(vocabulary.pieces) > MAX_PIECES:
        raise ValueError(f"a vocabulary of more than {MAX_PIECES} pieces")
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            n = model.counts(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["doc_id", "n_tokens"])

    ident = F.col(f"`{id_col}`")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(ident.alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
