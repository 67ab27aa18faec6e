"""Token counts without tokens: a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the vocabulary's matches by their end; the dynamic programme carries the
best score and its number of pieces at every end. Ties are settled as unigram tokenizers settle them: a later start
replaces an earlier one only with a strictly better score, so the longest piece wins. A character that no piece
spells costs the lowest score less 10 and counts as its UTF-8 bytes (byte fallback).

Vocabulary and scores are those of a public piece model, given by its path. Pieces never run over a line
feed, nor from a letter into a word mark, so texts are counted exactly segment by segment, and the
count of a segment is kept while memory allows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsida.llm.common import TOKENIZERS, Kept, per_process

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments of each kind whose counts a worker keeps, over all its tasks.
KEPT = 400_000


def load_pieces(path: str = MODEL) -> dict[str, float]:
    """The ordinary pieces of a model and their scores; control, unknown and byte pieces match no text."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not odd(i)}


class UnigramCounter:
    def __init__(self, pieces: dict[str, float]):
        if any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces):
            raise ValueError("a piece runs over a segment's end")
        self.automaton = ahocorasick.Automaton()
        for p, score in pieces.items():
            self.automaton.add_word(p, (len(p), score))
        self.automaton.make_automaton()
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        self.plain, self.marked = Kept(self.viterbi, KEPT), Kept(lambda word: self.viterbi(MARK + word), KEPT)

    def viterbi(self, s: str) -> int:
        """Number of pieces of the best segmentation of s."""
        n = len(s)
        score, count = [0.0] + [None] * n, [0] * (n + 1)
        found = self.automaton.iter(s)
        end, piece = next(found, (n, None))
        for e in range(n):
            best, pieces = None, 0
            while end == e:  # longest piece first
                size, gain = piece
                total = score[e + 1 - size] + gain
                if best is None or total > best:
                    best, pieces = total, count[e + 1 - size] + 1
                end, piece = next(found, (n, None))
            if s[e] not in self.single:
                total = score[e] + self.unknown
                if best is None or total > best:
                    best, pieces = total, count[e] + len(s[e].encode("utf-8", "surrogatepass"))
            score[e + 1], count[e + 1] = best, pieces
        return count[n]

    def count(self, text: str | None) -> int:
        """Tokens of a text; none for null or empty."""
        if not text:
            return 0
        lines = text.split("\n")
        total, first = len(lines) - 1, True
        for line in lines:
            if line or first:
                if "  " in line or MARK in line or line[:1] == " " or line[-1:] == " ":
                    for s in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (MARK if first else "") + line.replace(" ", MARK)):
                        total += self.plain[s]
                else:
                    words = line.split(" ")
                    total += (self.marked if first else self.plain)[words[0]] + sum(map(self.marked.__getitem__, words[1:]))
            first = False
        return total


def count_tokens(docs: DataFrame, id_col="doc_id", text_col="text", model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) of every row, whole texts; rows without a doc_id keep their null, repeated rows repeat."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = per_process(("unigram", model), lambda: UnigramCounter(load_pieces(model)))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(counter.count, b.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long")


def op4_token_count(docs: DataFrame) -> DataFrame:
    return count_tokens(docs.select("doc_id", "text"))
