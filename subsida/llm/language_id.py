"""Language ID by segmentation-marginalised unigrams.

Every language has probabilities over the pieces of a fixed public vocabulary. The probability of a word is the
sum over all its segmentations into pieces, found by the forward algorithm; a text's is the product over its words.
The piece probabilities are fitted by expectation maximisation to the word counts of a bounded sample of labelled
documents (PER_LANGUAGE each, by the smallest hash of the id, of the LANGUAGES most frequent labels). Pieces are matched by an Aho-Corasick automaton.

Words are runs of letters in lower case, whole texts, each with a word mark before it. Words longer than CHUNK
letters are scored in chunks, so that no product vanishes.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subsida.llm.common import materialize, per_process
from subsida.llm.token_count import MARK, MODEL, load_pieces

#: Labelled documents of a language that the model is fitted to.
PER_LANGUAGE = 300
#: Labels that are learned: the most frequent ones, of equally frequent ones the first by name.
LANGUAGES = 500
ROUNDS = 3
SMOOTHING = 0.05
UNKNOWN = 1e-7
CHUNK = 32
#: Tokens whose probabilities a worker keeps, over all its tasks.
KEPT = 400_000
REJECT_BELOW = 0.5

WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    if not all(map(str.isalpha, found)):  # numbers like ½ and ② are no letters either
        found = [w for f in found for w in "".join(c if c.isalpha() else " " for c in f).split()]
    return found


class Matcher:
    """Vocabulary matches of a word as (start, end, piece), by end; a letter of no piece matches piece -1."""

    def __init__(self, vocabulary: list[str]):
        self.size = len(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(vocabulary):
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.single = {p for p in vocabulary if len(p) == 1}

    def __call__(self, word: str) -> list[tuple[int, int, int]]:
        out = [(e + 1 - n, e + 1, i) for e, (n, i) in self.automaton.iter(word)]
        if not self.single.issuperset(word):
            out += [(i, i + 1, -1) for i, c in enumerate(word) if c not in self.single]
            out.sort(key=lambda m: m[1])
        return out


def forward(matches, length: int, p) -> list[float]:
    """p[i] is a piece's probability (p[-1] an unknown letter's); the sums over segmentations of every prefix."""
    a = [1.0] + [0.0] * length
    for s, e, i in matches:
        a[e] += a[s] * p[i]
    return a


def chunks(word: str) -> list[str]:
    w = MARK + word
    return [w] if len(w) <= CHUNK else [w[i : i + CHUNK] for i in range(0, len(w), CHUNK)]


def fit(counts: dict[str, dict[str, int]], vocabulary: list[str], rounds: int = ROUNDS, smoothing: float = SMOOTHING) -> tuple[list[str], list[list[float]]]:
    """Languages and their piece probabilities, from word counts by language; the last probability is an unknown letter's."""
    matcher, langs, tables = Matcher(vocabulary), sorted(counts), []
    v = len(vocabulary)
    for lang in langs:
        parts = Counter()
        for w, n in counts[lang].items():
            for c in chunks(w):
                parts[c] += n
        items = [(matcher(w), len(w), n) for w, n in sorted(parts.items())]
        p = [1.0 / v] * v + [UNKNOWN]
        for _ in range(rounds):
            gain = [0.0] * (v + 1)
            for m, length, n in items:
                a = forward(m, length, p)
                if not a[length]:
                    continue
                b = [0.0] * length + [1.0]
                scale = n / a[length]
                for s, e, i in reversed(m):
                    x = p[i] * b[e]
                    b[s] += x
                    gain[i] += a[s] * x * scale
            total = sum(gain[:v]) + smoothing * v
            p = [(g + smoothing) / total for g in gain[:v]] + [UNKNOWN]
        tables.append(p)
    return langs, tables


class Scorer:
    def __init__(self, langs: list[str], tables: list[list[float]], vocabulary: list[str]):
        self.langs, self.tables, self.matcher = langs, tables, Matcher(vocabulary)
        self.index: dict[str, int] = {}
        self.logs, self.vain = np.zeros((KEPT + 1, len(langs) + 1)), 0  # the last row stays zero

    def token(self, token: str) -> list[float]:
        """Log probabilities of the words of a token without white space, by language, and their number."""
        total, found = [0.0] * len(self.langs), words(token)
        for c in (c for w in found for c in chunks(w)):
            m = self.matcher(c)
            for k, p in enumerate(self.tables):
                total[k] += math.log(max(forward(m, len(c), p)[len(c)], 1e-300))
        return [*total, float(len(found))]

    def text(self, text: str | None) -> tuple[str, float]:
        """The most probable language (the first by name among equals) and its posterior under equal priors.

        No word runs over white space, so a text's sums are those of its tokens, and a token's are made once.
        """
        tokens = text.lower().split() if text else []
        total, index = np.zeros(len(self.langs) + 1), self.index
        for start in range(0, len(tokens), 50_000):
            part = tokens[start : start + 50_000]
            extra = {}
            for w in set(part).difference(index):
                if len(index) < KEPT:
                    self.logs[len(index)] = self.token(w)
                    index[w] = len(index)
                else:
                    extra[w] = self.token(w)
            if extra:
                total += sum(np.multiply(extra[w], n) for w, n in Counter(filter(extra.__contains__, part)).items())
                at = np.fromiter((index.get(w, KEPT) for w in part), dtype=np.int64, count=len(part))
            else:
                at = np.fromiter(map(index.__getitem__, part), dtype=np.int64, count=len(part))
            total += self.logs[at].sum(axis=0)
            self.vain += len(extra)
            if self.vain > KEPT:  # the texts have changed
                index.clear()
                self.vain = 0
        if not total[-1] or not self.langs:
            return "und", 0.0
        total = total[:-1]
        odds = np.exp(total - total.max())
        best = int(np.argmax(odds))
        return self.langs[best], float(odds[best] / odds.sum())


def held_out(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text leaves 0 by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample_counts(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict[str, dict[str, int]]:
    """Word counts of at most `per_language` documents of each language, of those that may be learned from.

    The ids are ranked first, in a narrow table; texts of the chosen documents alone are split into words.
    """
    ids = docs.where("lang is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).select("lang", F.xxhash64("doc_id").alias("h")).distinct()
    # hashes are uniform: twice the wanted share of each language, then the exact rank among those few
    share = ids.groupBy("lang").agg((F.lit(2.0 * per_language) / F.count(F.lit(1))).alias("share"))
    share = share.orderBy("share", "lang").limit(LANGUAGES)
    share = materialize(share, "language-shares")  # a row for each language: of known size when the ids are planned
    near = ids.join(share, "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = near.withColumn("nth", rank).where(F.col("nth") <= per_language).groupBy("lang").agg(F.max("h").alias("last"))
    last = materialize(last, "language-sample")  # likewise, for the texts
    labelled = docs.where(~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    few = labelled.join(last, "lang").where("h <= last").groupBy("lang", "h").agg(F.min(F.col("text").cast("string")).alias("text"))
    few = few.select("lang", "text")  # one text of each id, however often the id is repeated

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found.update((lang, w) for w in words(text))
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = {}
    for r in few.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        counts.setdefault(r.lang, {})[r.word] = int(r.n)
    return counts


def train(docs: DataFrame, model: str = MODEL, per_language: int = PER_LANGUAGE) -> tuple[list[str], list[list[float]], list[str]]:
    """Languages, piece probabilities and vocabulary; a label without any word in its sample isn't learned."""
    vocabulary = sorted(p for p in load_pieces(model) if (p == MARK or p.removeprefix(MARK).isalpha()) and p == p.lower())
    langs, tables = fit(sample_counts(docs, per_language), vocabulary)
    return langs, tables, vocabulary


def identify(docs: DataFrame, model: str = MODEL, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    lang_pred is `und` with score 0 for null texts, texts without a letter, and where no language was learned. Rows with
    null ids or labels are judged but not learned from; repeated rows are returned as often as they occur.
    """
    held, tag = docs.sparkSession.sparkContext.broadcast(train(docs, model, per_language)), uuid.uuid4().hex  # the vocabulary times the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_process(("scorer", tag), lambda: Scorer(*held.value))
        for b in batches:
            got = [scorer.text(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: str = MODEL, per_language: int = PER_LANGUAGE, least: float = REJECT_BELOW) -> DataFrame:
    """docs less the rejected: texts without letters, and texts whose best language has a posterior under `least`."""
    held, tag = docs.sparkSession.sparkContext.broadcast(train(docs, model, per_language)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = per_process(("scorer", tag), lambda: Scorer(*held.value))
        for b in batches:
            got = (scorer.text(t) for t in b.column(b.schema.get_field_index("text")).to_pylist())
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score in got], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_language_id(docs: DataFrame) -> DataFrame:
    return identify(docs.select("doc_id", "text", "lang"))
