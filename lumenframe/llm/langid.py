"""Language identification by unigrams of pieces, marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The likelihood of
a word is the sum, over all ways to cut it into pieces, of the products of their probabilities; a
forward pass computes it for all languages at once.  A text's score is the product over its words
(maximal runs of letters, lower-cased), and the posterior under equal priors picks the language.

The piece probabilities are fitted by expectation maximisation on all words of a bounded sample of
labelled texts: at most SAMPLE_ROWS rows and SAMPLE_BYTES of text, in hash order.

A text that is null, empty or has no letter is `und` with score 0.  Languages that are null are
not learned.  With no labelled text at all, everything is `und`.  Of equal posteriors the language that
is first in order wins.  Repeated rows are told alike, and learned from once.  Words of very long texts
are counted whole; a word over LONG characters is scored one character after the other.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.batches import chunked, span_hashes, text_buffer
from lumenframe.llm.bpe import _with_columns
from lumenframe.llm.tables import bounded_sample, drop

#: Runs of letters and of signs that Python counts as numbers but not as digits.
RUNS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
SAMPLE_ROWS, SAMPLE_BYTES = 2_500, 32 << 20
ROUNDS = 4
#: Added to each piece's expected count.
SMOOTHING = 0.01
#: Probability of a character that isn't in the vocabulary, the same for all languages.
UNKNOWN = 1e-8
#: Factor for each character, against underflow; words over LONG characters are scored by logarithms.
SCALE, LONG = 16.0, 48
CACHE = 300_000
START = "▁"


@lru_cache(maxsize=2)
def pieces(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece vocabulary: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not odd(i)]


def words_of(text: str) -> list[str]:
    """The runs of letters of a text, in lower case."""
    found = RUNS.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in ("".join(c if c.isalpha() else " " for c in run).split())]


class Lattice:
    """Finds the pieces of a vocabulary in words; words of one length side by side."""

    def __init__(self, vocabulary: list[str]):
        self.longest = max(map(len, vocabulary), default=1)
        data, offsets = text_buffer(pa.array(vocabulary, pa.string()))
        hashes = span_hashes(data, offsets[:-1], offsets[1:])
        self.order = np.argsort(hashes)
        self.hashes, self.none = hashes[self.order], len(hashes)
        self.maybe = np.zeros(1 << 20, dtype=bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes; `none` for others."""
        out = np.full(len(hashes), self.none, dtype=np.int64)
        likely = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hashes, hashes[likely]), self.none - 1)
        good = self.hashes[at] == hashes[likely] if self.none else np.zeros(0, bool)
        out[likely[good]] = self.order[at[good]]
        return out

    def edges(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(i, j, places of words, pieces) for the pieces that go from i to j in words of one length.

        A single character that is no piece counts as the piece `none`.
        """
        k, n = len(words), len(words[0]) + 1
        data, offsets = text_buffer(pa.array([START + w for w in words], pa.string()))
        edge = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data)).astype(np.int64)  # of characters
        first = np.arange(k, dtype=np.int64) * n
        pairs = [(i, j) for j in range(1, n + 1) for i in range(max(0, j - self.longest), j)]
        starts, ends = (np.concatenate([edge[first + pair[side]] for pair in pairs]) for side in (0, 1))
        out = []
        for (i, j), row in zip(pairs, self.find(span_hashes(data, starts, ends)).reshape(len(pairs), k), strict=True):
            hit = np.arange(k) if i == j - 1 else np.flatnonzero(row != self.none)
            if len(hit):
                out.append((i, j, hit, row[hit]))
        return out

    def edges_of_one(self, word: str) -> list[list[tuple[int, int]]]:
        """For each end in one word of any length, (start, piece)."""
        s = START + word
        data, offsets = text_buffer(pa.array(list(s), pa.string()))
        out: list[list[tuple[int, int]]] = [[]]
        for j in range(1, len(s) + 1):
            i = max(0, j - self.longest)
            begin = offsets[i]
            row = self.find(span_hashes(data[begin : offsets[j]], offsets[i:j] - begin, np.full(j - i, offsets[j] - begin)))
            out.append([(i + k, r) for k, r in enumerate(row.tolist()) if r != self.none or i + k == j - 1])
        return out

    def blocks(self, words: list[str]) -> Iterator[list[int]]:
        """Places of words of the same length, in blocks of bounded size; words over LONG one by one."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for n, same in sorted(by.items()):
            step = 1 if n > LONG else max(1, 400_000 // (n + 1) // self.longest)
            yield from (same[lo : lo + step] for lo in range(0, len(same), step))


def expected_of_block(edges: list[tuple[int, int, np.ndarray, np.ndarray]], n: int, counts: np.ndarray, scaled: np.ndarray, expected: np.ndarray) -> None:
    """Adds the expected numbers of pieces in words of one length to expected, for all languages.

    counts are words x languages; scaled are the probabilities times SCALE for each character.
    """
    alpha, beta = np.zeros((n + 1, *counts.shape)), np.zeros((n + 1, *counts.shape))
    alpha[0] = beta[n] = 1.0
    for i, j, hit, row in edges:
        alpha[j][hit] += alpha[i][hit] * scaled[row]
    for i, j, hit, row in reversed(edges):
        beta[i][hit] += scaled[row] * beta[j][hit]
    share = counts / alpha[n]
    for i, j, hit, row in edges:
        np.add.at(expected, row, share[hit] * alpha[i][hit] * scaled[row] * beta[j][hit])


def expected_of_word(edges: list[list[tuple[int, int]]], counts: np.ndarray, scaled: np.ndarray, expected: np.ndarray) -> None:
    """The same for one word of any length: sums are kept with the logarithms of their scales."""
    n, m = len(edges) - 1, len(counts)
    alpha, logs = np.zeros((n + 1, m)), np.zeros((n + 1, m))
    beta, after = np.zeros((n + 1, m)), np.zeros((n + 1, m))
    alpha[0] = beta[n] = 1.0
    for j in range(1, n + 1):
        top = logs[j - 1]
        now = sum(alpha[i] * np.exp(logs[i] - top) * scaled[r] for i, r in edges[j])
        alpha[j], logs[j] = 1.0, top + np.log(np.maximum(now, 1e-300))
    for j in range(n, 0, -1):  # beta[i] * exp(after[i]); what is pushed to earlier places is settled when they are reached
        size = np.maximum(beta[j], 1e-300)
        beta[j], after[j] = 1.0, after[j] + np.log(size)
        for i, r in edges[j]:
            shift = after[j] - np.where(beta[i] > 0, after[i], after[j])
            after[i] = np.where(beta[i] > 0, after[i], after[j])
            beta[i] += np.exp(shift) * scaled[r]
    for j in range(1, n + 1):
        for i, r in edges[j]:
            expected[r] += counts * np.exp(logs[i] + after[j] - logs[n]) * scaled[r]


def fit_pieces(words: list[str], counts: np.ndarray, vocabulary: list[str]) -> np.ndarray:
    """Piece probabilities (languages x pieces) by expectation maximisation; the last entry is that of unknown characters."""
    n, m = len(vocabulary), counts.shape[1]
    lattice = Lattice(vocabulary)
    size = np.array([SCALE ** len(s) for s in vocabulary] + [SCALE])[:, None]
    p = np.full((n + 1, m), 1.0 / n)
    p[n] = UNKNOWN
    blocks = [(b, lattice.edges_of_one(words[b[0]]) if len(words[b[0]]) > LONG else lattice.edges([words[k] for k in b])) for b in lattice.blocks(words)]
    for _ in range(ROUNDS):
        expected, scaled = np.zeros((n + 1, m)), p * size
        for b, edges in blocks:
            if len(words[b[0]]) > LONG:
                expected_of_word(edges, counts[b[0]], scaled, expected)
            else:
                expected_of_block(edges, len(words[b[0]]) + 1, counts[b], scaled, expected)
        p = expected + SMOOTHING
        p[n] = 0
        p /= p.sum(axis=0)
        p[n] = UNKNOWN
    return p.T


class Model:
    """Languages, and for each piece its probabilities in them."""

    def __init__(self, languages: list[str], vocabulary: list[str], probabilities: np.ndarray):
        self.languages, self.vocabulary, self.probabilities = languages, vocabulary, probabilities

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """Scores words in blocks: words of one length go through the forward pass side by side."""

    def __init__(self, model: Model):
        self.languages = model.languages
        self.lattice = Lattice(model.vocabulary)
        size = np.array([SCALE ** len(s) for s in model.vocabulary] + [SCALE])
        self.scaled = model.probabilities.T * size[:, None] if model.languages else np.zeros((len(size), 0))
        self.scaled[-1] = UNKNOWN * SCALE
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((CACHE, max(1, len(self.languages))))

    def score(self, words: list[str]) -> np.ndarray:
        """Log likelihoods of words of the same length, in characters, in each language."""
        n = len(words[0]) + 1
        alpha = np.zeros((n + 1, len(words), len(self.languages)))
        alpha[0] = 1.0
        for i, j, hit, row in self.lattice.edges(words):
            alpha[j][hit] += alpha[i][hit] * self.scaled[row]
        return np.log(alpha[n]) - n * math.log(SCALE)

    def long_word(self, word: str) -> np.ndarray:
        """The same for one word of any length, with each position's sums divided by their largest."""
        s, logs = START + word, np.zeros(len(self.languages))
        data, offsets = text_buffer(pa.array(list(s), pa.string()))
        window = [np.ones(len(self.languages))]  # sums at the last positions, all times exp(-logs)
        for j in range(1, len(s) + 1):
            now = np.zeros(len(self.languages))
            first = j - len(window)
            begin = offsets[first]
            row = self.lattice.find(span_hashes(data[begin : offsets[j]], offsets[first:j] - begin, np.full(j - first, offsets[j] - begin)))
            for i, r in enumerate(row.tolist()):
                if r != self.lattice.none or first + i == j - 1:
                    now += window[i] * self.scaled[r]
            top = np.maximum(now, 1e-300)
            window = ([w / top for w in window] + [now / top])[-self.lattice.longest :]
            logs += np.log(top)
        return logs - len(s) * math.log(SCALE)

    def learn(self, words: set[str]) -> None:
        every = list(words)
        for block in self.lattice.blocks(every):
            part = [every[k] for k in block]
            got = np.array([self.long_word(w) for w in part]) if len(part[0]) > LONG else self.score(part)
            base = len(self.at)
            self.at.update(zip(part, range(base, base + len(part)), strict=True))
            self.rows[base : base + len(part)] = got

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        counted = [Counter(words_of(t)) if t else {} for t in texts]
        total = np.zeros((len(texts), len(self.languages)))
        waiting: list[tuple[int, list[str], np.ndarray]] = []
        fresh: set[str] = set()

        def settle() -> None:
            self.learn(fresh)
            fresh.clear()
            for k, words, counts in waiting:
                total[k] += counts @ self.rows[[self.at[w] for w in words]]
            waiting.clear()

        for k, words in enumerate(counted):
            every = list(words)
            for lo in range(0, len(every), CACHE // 2):
                part = every[lo : lo + CACHE // 2]
                new = [w for w in part if w not in self.at and w not in fresh]
                if len(self.at) + len(fresh) + len(new) > CACHE:
                    settle()
                    self.clear()
                    new = part
                fresh.update(new)
                waiting.append((k, part, np.array([words[w] for w in part], dtype=float)))
        settle()
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total[np.arange(len(texts)), best][:, None]).sum(axis=1)
        return [(self.languages[b], float(s)) if c else (UNDETERMINED, 0.0) for b, s, c in zip(best, share, counted, strict=True)]


def _count_words(text: str, lang: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], int] = Counter()
        for batch in batches:
            for t, y in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist(), strict=True):
                counts.update((y, w) for w in words_of(t or ""))
                if len(counts) > CACHE:
                    yield _rows(counts)
                    counts = Counter()
        yield _rows(counts)

    return run


def _rows(counts: dict[tuple[str, str], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "n"])


def fit(labelled: DataFrame, path: str, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Fits the model on the bounded sample that comes first in hash order of key."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    sample = bounded_sample(rows, SAMPLE_ROWS, SAMPLE_BYTES)
    counts = sample.select("t", "l").mapInArrow(_count_words("t", "l"), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = sorted((r["word"], r["lang"], r["n"]) for r in counts.collect())  # words of the sample
    drop(sample)
    vocabulary = pieces(path)
    languages, words = sorted({y for _, y, _ in found}), sorted({w for w, _, _ in found})
    counted = np.zeros((len(words), len(languages)))
    row, column = {w: k for k, w in enumerate(words)}, {y: k for k, y in enumerate(languages)}
    for w, y, n in found:
        counted[row[w], column[y]] = n
    return Model(languages, vocabulary, fit_pieces(words, counted, vocabulary))


def identify(df: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Adds the predicted language and its posterior probability."""
    add = {lang: T.StringType(), score: T.DoubleType()}
    schema = _with_columns(df, add)
    keep = [f.name for f in schema.fields if f.name not in add]
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: vocabulary x languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in chunked(batches, text):
            found = scorer.predict(batch.column(text).to_pylist())
            columns = [batch.column(c) for c in keep] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *add])

    return df.mapInArrow(run, schema)


def fold(key: str, n: int) -> Column:
    """crc32 of the key's text modulo n; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % n
