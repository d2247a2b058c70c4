"""BPE encoding and decoding with a public vocabulary file.

Encoding follows a merge list: a priority queue holds the possible merges of neighbouring symbols
by (rank, position), the symbols form a doubly linked list, and queue entries whose symbols have
changed since they were pushed are skipped.  Decoding concatenates the vocabulary strings of the
ids; the file has no decoder, so the library puts one space between them, and so does `decode`.

Words repeat, so the ids of a white-space-delimited word are kept in a bounded per-worker cache.
A null text counts as empty and gives no ids and an empty decoded text.  Long texts go whole.  Repeated rows
get the same ids each.  Equal ranks don't occur; of the places of one merge the leftmost goes first.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenframe.llm.batches import chunked

# Fixed value: the split pattern of the vocabulary file.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def code_points(ranges: str) -> str:
    """The inside of a character class, from hexadecimal code points and ranges of them."""
    return "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in ranges.split())


# Letters and digits that are younger than the library's Unicode version (16.0).
YOUNG = code_points("""
    0558 058B 058C 088F 0C5C 0CDC 208F 209D-209F A7CE A7CF
    A7D2 A7D4 A7DD A7E2 A7F1 AB6C AB6D 107BB-107BF 10940-10959 10EC5-10EC7
    10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3
    16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
    1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4 1E6E5 1E6E7-1E6ED 1E6F0-1E6F4
    1E6FE 1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
""")
# Marks that are younger than the library's tables for NFC (9.0), which therefore neither moves
# nor composes them nor anything across them; and the second part of U+11938, which it doesn't know.
YOUNG_MARKS = code_points("""
    07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA
    A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A
    11930 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97
    11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
""")
# The lower case of letters that are younger than Python's Unicode version (15.1).
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
YOUNG_FIND = regex.compile(f"[{YOUNG}]")
YOUNG_PIECE = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{YOUNG}]]+|[\p{{N}}--[{YOUNG}]]|[[^\s\p{{L}}\p{{N}}]||[{YOUNG}]]+")
YOUNG_MARK_FIND = regex.compile(f"([{YOUNG_MARKS}]+)")
NEW_UPPER_FIND = regex.compile("[" + "".join(map(chr, NEW_LOWER)) + "]")
# Separators for str.split() that the pattern's \s doesn't know.
ODD_SPACE = regex.compile("[\x1c-\x1f]")
WORD_END = "</w>"
#: Words in each of the two generations of a worker's cache.
CACHE_WORDS = 250_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """The parts of a vocabulary file that encoding and decoding need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.ids = ids
        self.strings = [""] * (max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for s, i in ids.items():
            self.strings[i] = s
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.strings[i] = s
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = len(self.strings)
        self.pairs: list[tuple[int, int, int]] = []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.append((ids[a], ids[b], ids[a + b]))
        self.ranks = {a * self.size + b: rank for rank, (a, b, _) in enumerate(self.pairs)}
        self.byte_symbol = byte_symbols()
        self.inner = [ids[s] for s in self.byte_symbol]
        self.final = [ids[s + WORD_END] for s in self.byte_symbol]

    def symbols(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        return [self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]] if raw else []


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge(symbols: list[int], vocab: Vocabulary) -> list[int]:
    """Applies the merges of lowest rank, leftmost first, until none is left.

    A queue entry is one integer, rank and position; the rank tells the pair it was pushed for.
    """
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of, pairs, size, bits = vocab.ranks.get, vocab.pairs, vocab.size, n.bit_length()
    low = (1 << bits) - 1
    at = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [r << bits | i for i in range(n - 1) if (r := rank_of(at[i] * size + at[i + 1])) is not None]
    heapq.heapify(queue)
    push, pop = heapq.heappush, heapq.heappop
    while queue:
        entry = pop(queue)
        i = entry & low
        left, right, new = pairs[entry >> bits]
        j = after[i]
        if at[i] != left or j >= n or at[j] != right:
            continue  # stale
        at[i], at[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (r := rank_of(new * size + at[k])) is not None:
                push(queue, r << bits | i)
        h = before[i]
        if h >= 0 and (r := rank_of(at[h] * size + new)) is not None:
            push(queue, r << bits | h)
    return [s for s in at if s >= 0]


def normalise(text: str) -> str:
    """NFC and lower case, character by character (so without the rule for a final sigma)."""
    if not text.isascii():
        if YOUNG_MARK_FIND.search(text):
            text = "".join(part if i % 2 else unicodedata.normalize("NFC", part) for i, part in enumerate(YOUNG_MARK_FIND.split(text)))
        else:
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")
        if NEW_UPPER_FIND.search(text):
            text = text.translate(NEW_LOWER)
    return text.lower()


def pieces_of(text: str) -> Iterator[regex.Match]:
    return (YOUNG_PIECE if not text.isascii() and YOUNG_FIND.search(text) else PIECE).finditer(text)


class Recent:
    """A bounded map: when the young generation is full it becomes the old one, and hits come back."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = limit, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """Encodes texts; per_piece turns a piece of the split pattern into ids."""

    def __init__(self, vocab: Vocabulary, per_piece: Callable[[str], list[int]] | None = None):
        self.vocab = vocab
        self.per_piece = per_piece or (lambda piece: merge(vocab.symbols(piece), vocab))
        self.words, self.pieces = Recent(CACHE_WORDS), Recent(CACHE_WORDS)

    def word(self, word: str) -> array:
        if (known := self.words.get(word)) is not None:
            return known
        out = array("i")
        for m in pieces_of(word):
            piece = m[0]
            ids = self.pieces.get(piece)
            if ids is None:
                ids = tuple(self.per_piece(piece))
                if len(piece) <= 64:
                    self.pieces.put(piece, ids)
            out.extend(ids)
        if len(word) <= 64:
            self.words.put(word, out)
        return out

    def plain(self, text: str, out: array) -> None:
        text = normalise(text)
        for word in [text] if ODD_SPACE.search(text) else text.split():
            ids = self.words.young.get(word)
            out.extend(ids if ids is not None else self.word(word))

    def encode(self, text: str | None) -> array:
        out = array("i")
        if not text:
            return out
        if "<|" in text and self.vocab.special_split is not None:
            for i, part in enumerate(self.vocab.special_split.split(text)):
                if i % 2:
                    out.append(self.vocab.special[part])
                elif part:
                    self.plain(part, out)
        else:
            self.plain(text, out)
        return out


def decode_ids(ids: array | list[int], vocab: Vocabulary) -> str:
    return " ".join(map(vocab.strings.__getitem__, ids))


def _lists(parts: list[array]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.frombuffer(b"".join(p.tobytes() for p in parts), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int32()))


def _with_columns(df: DataFrame, add: dict[str, T.DataType]) -> T.StructType:
    taken = {c.lower() for c in add}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in taken] + [T.StructField(c, t) for c, t in add.items()])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Adds array<int> ids of the whole text and, if named, the text decoded from those ids.

    Columns that already have those names are replaced; all others are kept.
    """
    add = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    schema = _with_columns(df, add)
    keep = [f.name for f in schema.fields if f.name not in add]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        encoder = Encoder(vocab)
        for batch in chunked(batches, text):
            parts = [encoder.encode(t) for t in batch.column(text).to_pylist()]
            columns = [batch.column(c) for c in keep] + [_lists(parts)]
            if decoded:
                columns.append(pa.array([decode_ids(p, vocab) for p in parts], type=pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *add])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of an array<int> column; null ids give null."""
    schema = _with_columns(df, {decoded: T.StringType()})
    keep = [f.name for f in schema.fields if f.name != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else decode_ids(x, vocab) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, type=pa.string())], names=[*keep, decoded])

    return df.mapInArrow(run, schema)
