"""Exact token counts of every prefix of a text, by dynamic programming.

Let s be a piece of the split pattern.  Every prefix of a BPE encoding is itself the encoding of
the text it covers, so for each prefix of s one value is enough: its last token.  That token is the
one whose predecessor prefix ends in a token with which it forms a stable pair (encoding the two
tokens' symbols together gives the two tokens again).  The count at a prefix is one more than the
count where its last token starts.  A prefix that ends a text has a word-end token last; the
same step with word-end tokens gives the count of each prefix taken as a text of its own.

A text's prefix table holds the exact count up to the end of each of its words (words are what white
space and special tokens delimit; no token crosses them).  The text's count is its last entry, and how
much of it fits a budget is a lookup; within a word the same is read off the word's own prefixes, so
nothing is encoded again.  Prefixes are those of the normalised text (NFC, lower case).

Null counts as empty and has an empty table.  Long texts go whole, with one entry a word.  Repeated rows
are counted alike.  Columns that have an output's name are replaced, all others are kept.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.batches import chunked
from lumenframe.llm.bpe import CACHE_WORDS, ODD_SPACE, WORD_END, Recent, Vocabulary, _lists, _with_columns, merge, normalise, pieces_of, vocabulary


def sizes(tokens: dict[str, int]) -> dict[str, tuple[int, ...]]:
    """By the last three symbols: the lengths that tokens that end so can have, longest first."""
    found: dict[str, set[int]] = {}
    for s in tokens:
        if len(s) > 2:
            found.setdefault(s[-3:], {1, 2}).add(len(s))
    return {end: tuple(sorted(n, reverse=True)) for end, n in found.items()}


#: The lengths where no longer token ends so.
SHORT = (2, 1)
#: Symbols of a piece whose prefixes are filled in from its end, a call inside a call; those of longer pieces go from its start.
DEEP = 128


class PrefixCounter:
    """Counts of prefixes, over symbols: one symbol is one byte of the text."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.stable: Recent = Recent(2 * CACHE_WORDS)
        self.pieces, self.words = Recent(CACHE_WORDS), Recent(CACHE_WORDS)
        self.inner, self.final = {}, {}
        parts: dict[int, tuple[int, ...]] = {i: (i,) for i in [*vocab.inner, *vocab.final]}
        for a, b, new in vocab.pairs:
            parts[new] = parts[a] + parts[b]
        self.parts = parts
        for string, i in vocab.ids.items():
            if i in parts:
                if string.endswith(WORD_END) and len(string) > len(WORD_END):
                    self.final[string[: -len(WORD_END)]] = i
                else:
                    self.inner[string] = i
        self.inner_sizes, self.final_sizes = sizes(self.inner), sizes(self.final)

    def fits(self, left: int, right: int) -> bool:
        """Whether the symbols of two tokens, encoded together, give the two tokens; left -1: right alone."""
        key = (left + 1) * self.vocab.size + right
        known = self.stable.young.get(key)
        if known is None:
            known = self.stable.get(key)
        if known is None:
            want = [right] if left < 0 else [left, right]
            known = merge([s for t in want for s in self.parts[t]], self.vocab) == want
            self.stable.put(key, known)
        return known

    def last_tokens(self, symbols: str) -> tuple[list[int], list[int]]:
        """For each prefix of a piece: its last token and its count, as the inner part of a longer piece."""
        last, count = [-1], [0]
        find, fits, lengths = self.inner.get, self.fits, self.inner_sizes.get
        stable, size = self.stable, self.vocab.size
        for j in range(1, len(symbols) + 1):
            for n in lengths(symbols[j - 3 : j], SHORT) if j > 2 else SHORT:
                i = j - n
                if i < 0 or (token := find(symbols[i:j])) is None:
                    continue
                known = stable.young.get((last[i] + 1) * size + token)
                if known or known is None and fits(last[i], token):
                    last.append(token)
                    count.append(count[i] + 1)
                    break
        return last, count

    def ending(self, symbols: str, j: int, last: list[int], count: list[int]) -> int:
        for n in self.final_sizes.get(symbols[j - 3 : j], SHORT) if j > 2 else SHORT:
            i = j - n
            if i >= 0 and (token := self.final.get(symbols[i:j])) is not None and self.fits(last[i], token):
                return count[i] + 1
        raise ValueError("the vocabulary lacks a byte")

    def reached(self, symbols: str, j: int, last: list[int | None], count: list[int]) -> int:
        """last_tokens() of one prefix; only prefixes that can come before one of its tokens are filled in."""
        find, stable, size = self.inner.get, self.stable, self.vocab.size
        for n in self.inner_sizes.get(symbols[j - 3 : j], SHORT) if j > 2 else SHORT:
            i = j - n
            if i < 0 or (token := find(symbols[i:j])) is None:
                continue
            if (left := last[i]) is None:
                left = self.reached(symbols, i, last, count)
            known = stable.young.get((left + 1) * size + token)
            if known or known is None and self.fits(left, token):
                last[j], count[j] = token, count[i] + 1
                return token
        raise ValueError("the vocabulary lacks a byte")

    def total_of(self, symbols: str) -> int:
        """The count of a whole piece, from the prefixes that its last token can follow."""
        j = len(symbols)
        if j > DEEP:
            return self.ending(symbols, j, *self.last_tokens(symbols[:-1]))
        last: list[int | None] = [-1] + [None] * j
        count = [0] * (j + 1)
        for n in self.final_sizes.get(symbols[-3:], SHORT) if j > 2 else SHORT:
            i = j - n
            if i < 0 or (token := self.final.get(symbols[i:])) is None:
                continue
            left = last[i]
            if left is None:
                left = self.reached(symbols, i, last, count)
            if self.fits(left, token):
                return count[i] + 1
        raise ValueError("the vocabulary lacks a byte")

    def piece(self, piece: str) -> int:
        known = self.pieces.get(piece)
        if known is None:
            known = self.total_of("".join([self.vocab.byte_symbol[b] for b in piece.encode("utf-8")]))
            if len(piece) <= 64:
                self.pieces.put(piece, known)
        return known

    def prefixes(self, piece: str) -> list[int]:
        """Counts of the prefixes of a piece of 1, 2, ... characters, each as a text of its own."""
        if piece[0] == "'" and len(piece) > 1 and piece[1] != "'":  # a contraction; its prefixes split otherwise
            return [sum(self.piece(m[0]) for m in pieces_of(piece[:k])) for k in range(1, len(piece) + 1)]
        raw = [c.encode("utf-8") for c in piece]
        symbols = "".join([self.vocab.byte_symbol[b] for c in raw for b in c])
        last, count = self.last_tokens(symbols)
        return [self.ending(symbols, j, last, count) for j in np.cumsum([len(c) for c in raw]).tolist()]

    def word(self, word: str) -> int:
        known = self.words.get(word)
        if known is None:
            # Letters alone are one piece.
            known = self.piece(word) if word.isalpha() else sum([self.piece(m[0]) for m in pieces_of(word)])
            if len(word) <= 64:
                self.words.put(word, known)
        return known

    def parts_of(self, text: str) -> Iterator[tuple[str, bool]]:
        split = self.vocab.special_split
        for i, part in enumerate(split.split(text) if split is not None and "<|" in text else [text]):
            if part:
                yield part, bool(i % 2)

    def prefix_table(self, text: str | None) -> array:
        """The exact count up to the end of each word or special token."""
        counts: list[int] = []
        for part, special in self.parts_of(text or ""):
            if special:
                counts.append(1)
                continue
            part = normalise(part)
            words = [part] if ODD_SPACE.search(part) else part.split()
            known = list(map(self.words.young.get, words))
            if None in known:
                known = [self.word(w) if n is None else n for w, n in zip(words, known, strict=True)]
            counts += known
        return array("i", accumulate(counts))

    def total(self, text: str | None) -> int:
        known = self.prefix_table(text)
        return known[-1] if known else 0

    def table(self, text: str | None) -> tuple[str, array, array]:
        """The normalised text, and the end offset and total count after each of its pieces."""
        ends, counts, base, n, whole = array("q"), array("q"), 0, 0, []
        for part, special in self.parts_of(text or ""):
            part = part if special else normalise(part)
            whole.append(part)
            if special:
                n += 1
                ends.append(base + len(part))
                counts.append(n)
            else:
                for m in pieces_of(part):
                    n += self.piece(m[0])
                    ends.append(base + m.end())
                    counts.append(n)
            base += len(part)
        return "".join(whole), ends, counts

    def longest_prefix(self, text: str | None, budget: int) -> str:
        """The longest prefix of the normalised text that has at most budget tokens."""
        whole, ends, counts = self.table(text)
        k = bisect_right(counts, budget)
        if k == len(counts):
            return whole
        done, start = (counts[k - 1], ends[k - 1]) if k else (0, 0)
        piece = whole[start : ends[k]]
        blank = len(piece) - len(piece.lstrip())
        fit = 0
        if piece.strip() not in self.vocab.special:
            inner = self.prefixes(piece[blank:])
            fit = max((i + 1 for i, c in enumerate(inner) if done + c <= budget), default=0)
        return whole[: start + blank + fit]


@lru_cache(maxsize=1)
def counter_of(path: str) -> PrefixCounter:
    """The counter of a Python worker, whose caches serve all tasks that the worker runs."""
    return PrefixCounter(vocabulary(path))


def prefix_table(df: DataFrame, path: str, text: str = "text", out: str = "prefix_tokens") -> DataFrame:
    """Adds array<int>: the exact count of the text up to the end of its first, second, ... word."""
    schema = _with_columns(df, {out: T.ArrayType(T.IntegerType())})
    keep = [f.name for f in schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in chunked(batches, text):
            tables = [counter.prefix_table(t) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [_lists(tables)], names=[*keep, out])

    return df.mapInArrow(run, schema)


def total(table: Column) -> Column:
    """The count of the whole text, from its prefix table."""
    return F.when(F.size(table) > 0, F.element_at(table, -1)).otherwise(0).cast("long")


def words_within(table: Column, budget: int) -> Column:
    """How many of the text's first words have at most budget tokens together, from its prefix table."""
    return F.size(F.filter(table, lambda n: n <= budget)).cast("long")


def count_tokens(df: DataFrame, path: str, text: str = "text", count: str = "n_tokens", prefixes: str | None = None) -> DataFrame:
    """Adds the token count of the whole text and, if named, its prefix table."""
    name = prefixes or "_prefix_tokens"
    plain = df.drop(*[c for c in df.columns if c.lower() == count.lower()])
    done = prefix_table(plain, path, text, name)
    counted = done.withColumn(count, total(F.col(name)))
    return counted if prefixes else counted.drop(name)


def truncate(df: DataFrame, path: str, budget: int, text: str = "text", out: str = "truncated") -> DataFrame:
    """Adds the longest prefix of the normalised text with at most budget tokens; null gives an empty one."""
    schema = _with_columns(df, {out: T.StringType()})
    keep = [f.name for f in schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in chunked(batches, text):
            cut = [counter.longest_prefix(t, budget) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(cut, type=pa.string())], names=[*keep, out])

    return df.mapInArrow(run, schema)
