"""NumPy views of Arrow text columns, shared by the text operators.

Every text operator here works on the UTF-8 bytes of whole texts.  Arrow keeps a
column's texts back to back in one buffer, so rolling hashes, word boundaries and
class counts are computed over that buffer at once instead of text by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a single longer text is one chunk.
CHUNK_BYTES = 1 << 21

#: Bytes of one longer text whose arrays are held at once.
PIECE_BYTES = 1 << 22

U64 = np.uint64

# ASCII separators of words (space and \x09-\x0D).
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SEPARATOR = np.zeros(256, dtype=bool)
IS_SEPARATOR[list(SEPARATORS)] = True

#: ASCII letters A-Z folded to a-z, other bytes unchanged.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over an array of unsigned 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


#: A random 64-bit value for each byte.
BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))

_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, from one running sum."""
    up, down = _power_table(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], dtype=U64, out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; text i is bytes[offsets[i]:offsets[i + 1]], null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, dtype=np.uint8)
    return data, at - at[0]


def chunked(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Splits batches so that each holds at most about limit bytes of text (one text at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the words `[^\\x20\\x09-\\x0D]+`; words never cross texts."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~IS_SEPARATOR[data]
    before = np.empty_like(inside)
    before[1:], before[0] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1] = inside[1:], False
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-folded words of all texts, and their text numbers.

    A longer chunk (which is one text) goes in pieces that end at separators, so that only the
    words' hashes grow with it.
    """
    if len(data) <= PIECE_BYTES or len(offsets) != 2:
        starts, ends, of = word_spans(data, offsets)
        return span_hashes(ASCII_LOWER[data], starts, ends), of
    parts, at = [], 0
    while at < len(data):
        to = min(at + PIECE_BYTES, len(data))
        while to < len(data) and not IS_SEPARATOR[data[to]]:
            to += 1
        part = data[at:to]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]))
        parts.append(span_hashes(ASCII_LOWER[part], starts, ends))
        at = to
    hashes = np.concatenate(parts)
    return hashes, np.zeros(len(hashes), dtype=np.int64)
