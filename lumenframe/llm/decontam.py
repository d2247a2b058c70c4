"""Benchmark decontamination by the q-gram lemma.

Texts are compared as bytes without white space and with A-Z lower-cased.  A document is contaminated
by an item if WINDOW consecutive bytes of the item (the whole item, if shorter) align with a
stretch of the document with at most BUDGET of that many edits.  If they do, the two share at least
window - q + 1 - q * edits q-grams, on diagonals that differ by no more than the edits.  So: find the
shared q-grams, count them in overlapping bands of diagonals, keep the bands with item windows that
reach that count, and verify those by alignment within the band.  q is Q, or for a short item the
largest for which that count is positive.

An item that allows no edits (under 14 bytes) matches where it neither begins nor ends inside a word.
Words are runs of ASCII letters and digits and of characters of two bytes (Latin, Greek, Cyrillic,
Hebrew, Arabic); other scripts, many of which have no spaces, have a boundary at every character.

Null or empty texts match nothing, nor do items of white space alone or without a key.  The items go to
all tasks in blocks of BLOCK_BYTES, one pass over the documents for each block.  Texts and items that share
more than HITS q-grams at once are taken apart (texts, then stretches of a text, items, and stretches of an
item, with overlaps that hold a whole window), so that memory is bounded however repetitive they are.

Of several alignments of a document and an item the first that is found is reported, by half-band, band
and item position; which one it is doesn't change whether there is one.  Repeated rows are looked at each;
items of equal key are items of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.batches import ASCII_LOWER, IS_SEPARATOR, chunked, mix, text_buffer

Q = 10
WINDOW = 80
BUDGET = 0.075
BLOCK_BYTES = 8 << 20
#: Bytes of a document that are matched at once; neighbours overlap by OVERLAP.
PIECE, OVERLAP = 2 << 20, 4096

#: Shared q-grams that are looked at together, about.
HITS = 4 << 20

U64 = np.uint64
FILTER_BITS = 22


def squeeze(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes without white space, and the texts' offsets in them."""
    keep = ~IS_SEPARATOR[data]
    if len(offsets) == 2:  # one text, which can be long
        return ASCII_LOWER[data[keep]], np.array([0, np.count_nonzero(keep)])
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(keep, out=total[1:])
    return ASCII_LOWER[data[keep]], total[offsets]


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte that squeeze() keeps, whether no word goes on before it, and after it."""
    lower = ASCII_LOWER[data]
    word = ((lower >= ord("a")) & (lower <= ord("z"))) | ((data >= ord("0")) & (data <= ord("9"))) | ((data >= 0xC3) & (data <= 0xDF))
    word[1:] |= (data[1:] >= 0x80) & (data[1:] <= 0xBF) & word[:-1] & (data[:-1] >= 0xC3)
    apart = np.ones(len(data) + 1, dtype=bool)
    apart[1:-1] = ~(word[1:] & word[:-1])
    apart[offsets] = True
    keep = ~IS_SEPARATOR[data]
    return apart[:-1][keep], apart[1:][keep]


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q bytes from each position on (q up to 16)."""
    if len(data) < q:
        return np.zeros(0, dtype=U64)
    x = data.astype(U64)
    if q <= 8:
        total = np.zeros(len(data) - q + 1, dtype=U64)
        for k in range(q):
            total |= x[k : len(data) - q + 1 + k] << U64(8 * k)
        return mix(total * U64(0x9E3779B97F4A7C15))
    for k, shift in ((1, 8), (2, 16), (4, 32)):
        x = x[:-k] | (x[k:] << U64(shift))
    return mix(x[: len(data) - q + 1] * U64(0x9E3779B97F4A7C15) + x[q - 8 :])


class Index:
    """The q-grams of some items, sorted, with the places where they occur."""

    def __init__(self, q: int, numbers: np.ndarray, texts: list[np.ndarray]):
        self.q = q
        every = [grams(b, q) for b in texts]
        hashes = np.concatenate(every)
        item, pos = np.repeat(numbers, [len(g) for g in every]), np.concatenate([np.arange(len(g)) for g in every])
        order = np.argsort(hashes, kind="stable")
        self.item, self.pos = item[order], pos[order]
        self.hashes, self.first, self.n = np.unique(hashes[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.maybe[(self.hashes >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def common(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in data of shared q-grams, and their numbers here."""
        h = grams(data, self.q)
        at = np.flatnonzero(self.maybe[(h >> U64(64 - FILTER_BITS)).astype(np.int64)]) if len(h) else np.zeros(0, dtype=np.int64)
        k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        same = self.hashes[k] == h[at] if len(at) else np.zeros(0, dtype=bool)
        return at[same], k[same]

    def hits(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in data, items and positions in them, of what common() gives."""
        n = self.n[k]
        entry = np.repeat(self.first[k] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
        return np.repeat(at, n), self.item[entry], self.pos[entry]


class Items:
    """A block of items and the indexes of their q-grams."""

    def __init__(self, ids: list[int], texts: list[np.ndarray]):
        self.ids, self.bytes = ids, texts
        size = np.array([len(b) for b in texts], dtype=np.int64)
        self.window = np.minimum(WINDOW, size)
        self.edits = np.floor(self.window * BUDGET).astype(np.int64)
        self.q = np.minimum(Q, self.window // (self.edits + 1))
        self.bound = self.window - self.q + 1 - self.q * self.edits
        self.indexes = [Index(q, own := np.flatnonzero(self.q == q), [texts[k] for k in own]) for q in np.unique(self.q).tolist()]
        self.words = bool((self.edits == 0).any())
        self.parts: list[tuple[Items, int, int]] | None = None

    @classmethod
    def of(cls, ids: list[int], texts: list[str]) -> Items:
        """The items that have a byte that isn't white space."""
        data, offsets = squeeze(*text_buffer(pa.array(texts, pa.string())))
        some = [k for k in range(len(ids)) if offsets[k + 1] > offsets[k]]
        return cls([ids[k] for k in some], [data[offsets[k] : offsets[k + 1]] for k in some])

    def halves(self) -> list[tuple[Items, int, int]]:
        """(items, number of the first, its offset): half of the items each, or overlapping halves of a long one; none of a short one."""
        if self.parts is None:
            n, size = len(self.ids), len(self.bytes[0])
            if n > 1:
                self.parts = [(Items(self.ids[lo:hi], self.bytes[lo:hi]), lo, 0) for lo, hi in ((0, n // 2), (n // 2, n))]
            elif size > 4 * WINDOW:
                self.parts = [(Items(self.ids, [self.bytes[0][lo:hi]]), 0, lo) for lo, hi in ((0, size // 2 + WINDOW), (size // 2, size))]
            else:
                self.parts = []
        return self.parts

    def edges(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """word_edges() where an item needs them."""
        return word_edges(data, offsets) if self.words else None

    def hits(self, data: np.ndarray, edges: tuple[np.ndarray, np.ndarray] | None, common: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in data, items and positions in them of all shared q-grams, without words that go on."""
        none = np.zeros(0, dtype=np.int64)
        at, item, pos = map(np.concatenate, zip((none, none, none), *(index.hits(*c) for index, c in zip(self.indexes, common, strict=True)), strict=True))
        if edges is not None:
            start, end = at - pos, at - pos + self.window[item]
            fits = (start >= 0) & (end <= len(data))
            whole = edges[0][np.where(fits, start, 0)] & edges[1][np.where(fits, end, 1) - 1] & fits
            good = whole | (self.edits[item] > 0)
            at, item, pos = at[good], item[good], pos[good]
        return at, item, pos


def band_edits(pattern: np.ndarray, text: np.ndarray, most: int) -> int:
    """The least edits that turn the pattern into a stretch of text, within a band; most + 1 if more.

    The stretch may start up to 2 * `most` into the text; the band has that width and `most` on either side.
    """
    width = 4 * most + 1
    far = most + 1
    padded = np.concatenate([np.zeros(most, np.int16), text.astype(np.int16) + 1, np.zeros(width + len(pattern), np.int16)])
    lane = np.arange(width)
    row = np.where((lane >= most) & (lane <= 3 * most), 0, far).astype(np.int64)
    for i, c in enumerate(pattern.tolist()):
        diagonal = row + (padded[i : i + width] != c + 1)
        above = np.append(row[1:], far) + 1
        now = np.minimum(diagonal, above)
        now = np.minimum.accumulate(now - lane) + lane  # runs of insertions
        row = np.minimum(now, far)
        if row.min() >= far:
            return far
    return int(row.min())


def apart(data: np.ndarray, offsets: np.ndarray, items: Items, edges: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[tuple, tuple[int, int, int, int]]]:
    """find()'s arguments for two parts of the work, with what to add to the parts' texts, items and positions."""
    part = lambda lo, hi: (data[lo:hi], edges and (edges[0][lo:hi], edges[1][lo:hi]))
    n = len(offsets) - 1
    if n > 1:
        out = []
        for first, past in ((0, n // 2), (n // 2, n)):
            d, e = part(offsets[first], offsets[past])
            out.append(((d, offsets[first : past + 1] - offsets[first], items, e), (first, 0, 0, 0)))
        return out
    if len(data) > 2 * OVERLAP:
        out = []
        for lo, hi in ((0, len(data) // 2 + OVERLAP // 2), (len(data) // 2 - OVERLAP // 2, len(data))):
            d, e = part(lo, hi)
            out.append(((d, np.array([0, hi - lo]), items, e), (0, 0, 0, lo)))
        return out
    return [((data, offsets, half, edges), (0, first, lo, 0)) for half, first, lo in items.halves()]


def find(data: np.ndarray, offsets: np.ndarray, items: Items, edges: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, shared q-grams, edits, item position, text position) of all contaminated pairs."""
    common = [index.common(data) for index in items.indexes]
    if sum(int(index.n[k].sum()) for index, (_, k) in zip(items.indexes, common, strict=True)) > HITS and (parts := apart(data, offsets, items, edges)):
        best: dict[tuple[int, int], tuple] = {}
        for part, shifts in parts:
            for t, i, shared, edits, s, at in find(*part):
                best.setdefault((t + shifts[0], i + shifts[1]), (shared, edits, s + shifts[2], at + shifts[3]))
        return [(*pair, *hit) for pair, hit in sorted(best.items())]
    at, item, pos = items.hits(data, edges, common)
    text = np.searchsorted(offsets[1:], at, side="right")
    inside = at + items.q[item] <= offsets[text + 1] if len(at) else np.zeros(0, dtype=bool)
    at, item, pos, text = at[inside], item[inside], pos[inside], text[inside]
    if len(at) == 0:
        return []
    span = 2 * items.edits[item] + 1  # a band of twice this width holds any alignment once it is offset by half
    diagonal = at - offsets[text] - pos
    pair = text * len(items.ids) + item
    found: dict[tuple[int, int], tuple] = {}
    for half in (0, 1):
        band = (diagonal + half * span) // (2 * span)
        order = np.lexsort((pos, band, pair))
        p, b = pair[order], band[order]
        begin = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (b[1:] != b[:-1])))
        count = np.diff(np.append(begin, len(p)))
        enough = count >= items.bound[item[order[begin]]]
        for b, n in zip(begin[enough].tolist(), count[enough].tolist(), strict=True):
            part = order[b : b + n]
            t, i = int(text[part[0]]), int(item[part[0]])
            if (t, i) not in found and (hit := verify(data[offsets[t] : offsets[t + 1]], items, i, pos[part], at[part] - offsets[t])):
                found[t, i] = hit
    return [(t, i, *hit) for (t, i), hit in sorted(found.items())]


def verify(text: np.ndarray, items: Items, i: int, pos: np.ndarray, at: np.ndarray) -> tuple[int, int, int, int] | None:
    """The first item window of a band that has enough q-grams and aligns within the edits."""
    own, w, most, bound, q = items.bytes[i], int(items.window[i]), int(items.edits[i]), int(items.bound[i]), int(items.q[i])
    starts = np.arange(len(own) - w + 1)
    places, nth = np.unique(pos, return_index=True)
    lo, hi = np.searchsorted(places, starts), np.searchsorted(places, starts + w - q, side="right")
    diagonals = at[nth] - places
    for s in starts[hi - lo >= bound].tolist():
        inner = diagonals[lo[s] : hi[s]]
        middle = int((inner.min() + inner.max()) // 2)
        for shift in dict.fromkeys((middle, int(inner.min()), int(inner.max()))):
            start = s + shift - most
            piece = text[max(0, start) : s + shift + w + 2 * most]
            piece = np.concatenate([np.zeros(min(len(own), max(0, -start)), np.uint8), piece])
            edits = band_edits(own[s : s + w], piece, most)
            if edits <= most:
                return int(hi[s] - lo[s]), edits, s, max(0, s + shift)
    return None


def item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[Items]:
    """The items in blocks of about BLOCK_BYTES of text, in order of their keys."""
    sized = benchmark.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    total = sized.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    for b in range(blocks):
        rows = sized.filter(F.pmod(F.xxhash64("k"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        yield Items.of(*map(list, zip(*sorted((r["k"], r["t"]) for r in rows), strict=True)) if rows else ([], []))


FOUND = "doc_id long, item_id long, shared int, edits int, item_start int, doc_start int, text_hash long"


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it contains, with the first alignment found.

    Positions count bytes of the squeezed texts; text_hash tells rows of equal key apart.  Other columns
    are not looked at.
    """
    out = None
    for block in item_blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = shared.value
            for batch in chunked(batches, "t"):
                raw = text_buffer(batch.column("t"))
                (data, offsets), edges = squeeze(*raw), items.edges(*raw)
                found = find(data, offsets, items, edges) if len(data) <= PIECE else in_pieces(data, offsets, items, edges)
                ids = batch.column("k")
                columns = list(zip(*found, strict=True)) if found else [[]] * 6
                rows = pa.array(columns[0], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array([items.ids[i] for i in columns[1]], pa.int64()), *[pa.array(c, pa.int32()) for c in columns[2:]], batch.column("h").take(rows)], names=["doc_id", "item_id", "shared", "edits", "item_start", "doc_start", "text_hash"])

        got = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")).mapInArrow(run, FOUND)
        out = got if out is None else out.unionByName(got)
    return out


def in_pieces(data: np.ndarray, offsets: np.ndarray, items: Items, edges: tuple[np.ndarray, np.ndarray] | None) -> list[tuple]:
    """find() for long texts, in overlapping pieces; of several alignments of a pair the first stays."""
    found: dict[tuple[int, int], tuple] = {}
    for t in range(len(offsets) - 1):
        for lo in range(int(offsets[t]), max(int(offsets[t]) + 1, int(offsets[t + 1]) - OVERLAP), PIECE - OVERLAP):
            hi = min(lo + PIECE, int(offsets[t + 1]))
            part = data[lo:hi]
            for _, i, shared, edits, s, at in find(part, np.array([0, len(part)]), items, edges and (edges[0][lo:hi], edges[1][lo:hi])):
                found.setdefault((t, i), (shared, edits, s, at + lo - int(offsets[t])))
    return [(t, i, *hit) for (t, i), hit in sorted(found.items())]


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows that contain no item, those without a key included."""
    bad = matches(docs, benchmark, text, key).select(F.col("doc_id").alias("_bad"), F.col("text_hash").alias("_bad_text")).distinct()
    return docs.join(bad, F.col(key).cast("long").eqNullSafe(F.col("_bad")) & (F.xxhash64(text) == F.col("_bad_text")), "left_anti")
