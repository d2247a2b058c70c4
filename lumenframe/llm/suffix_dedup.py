"""Removal of long byte strings that occur more than once, by a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same text
or another; strings never cross texts, overlaps count, and the input is what is judged.

A transform of a whole corpus is not one task's work, so equal windows are first brought together:

1. A window's anchor is its smallest K-byte hash (the leftmost one on ties), so equal windows have
   equal anchors at equal offsets.  Consecutive windows with the same anchor are a run; the bytes
   they span are its context.
2. Anchors that occur once are out.  Their fingerprints meet in packed blocks, and each block gets
   back one bit an anchor, so a fingerprint of very many copies is one entry of each block.
3. Equal contexts become one string with a multiplicity.
4. The strings of an anchor go to a suffix array and its transform, in which a string of multiplicity n
   stands for n equal ones.  Starting from the empty string, intervals are extended backwards breadth
   first; the boundaries that a level meets for the first time have that level as the length of their common
   prefix.  The expansion ends at `length`; boundaries that are left don't separate suffixes that share at
   least `length` bytes, and between two others the multiplicities are added up.
5. An anchor with more than CAP strings is split: its windows are dealt to ranges of offsets, and the string
   that all windows of a range share becomes part of the key.  Ranges get finer until a range is a single
   window, where a unit has one string; each unit goes to a transform as in step 4.

Null texts count as empty; texts shorter than `length` keep all.  Rows with equal key and text are copies
of each other like any others; rows without a key are treated like those with one.  Long texts go in pieces
that overlap.  There are no ties to settle: a repeated string goes wherever it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm import batches
from lumenframe.llm.batches import chunked, span_hashes, text_buffer
from lumenframe.llm.tables import cut, workers

U64 = np.uint64
LENGTH = 200
K = 32
#: Strings of one anchor that go to one transform, and strings of one transform, about.
CAP, BATCH = 3_000, 500
#: Numbers of ranges of offsets that larger anchors are split into; the last gives single windows.
SPLITS = (4, 24, None)
#: Text of a block of packed fingerprints, and fingerprints that meet in one place.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of all runs: anchor's fingerprint, context's hash, text, first window, windows - 1, anchor's offset in the context."""
    none = np.zeros(0, dtype=np.int64)
    width = length - K + 1
    if len(data) < length:
        return none.astype(U64), none.astype(U64), none, none, none, none
    at = np.arange(len(data) - K + 1)
    h = span_hashes(data, at, at + K)
    least = (h & U64(0xFFFFFFFF00000000)) | at.astype(U64)
    size = 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(least) - (width - size)], least[width - size :])
    anchor = (least & U64(0xFFFFFFFF)).astype(np.int64)
    start = np.arange(len(anchor))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    inside = start + length <= offsets[text + 1]
    start, anchor, text = start[inside], anchor[inside], text[inside]
    if len(start) == 0:
        return none.astype(U64), none.astype(U64), none, none, none, none
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
    p, text = anchor[first], text[first]
    context = span_hashes(data, lo, hi + length) + (p - lo).astype(U64) * U64(0x9E3779B97F4A7C15)
    return h[p], context, text, lo - offsets[text], hi - lo, p - lo


def runs_of_chunk(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """runs(); a longer chunk, which is one text, goes in pieces that share length - 1 bytes.

    A run that is cut gives two contexts of the same anchor, with disjoint windows.
    """
    if len(data) <= batches.PIECE_BYTES or len(offsets) != 2:
        return runs(data, offsets, length)
    parts = []
    for at in range(0, len(data) - length + 1, batches.PIECE_BYTES):
        piece = data[at : at + batches.PIECE_BYTES + length - 1]
        fp, ctx, text, lo, span, left = runs(piece, np.array([0, len(piece)]), length)
        parts.append((fp, ctx, text, lo + at, span, left))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_array(strings: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, order of all suffixes by at least depth bytes, number of bytes left at each, and string of each.

    Each string ends in a separator of its own, below all bytes.
    """
    data = np.frombuffer(b"".join(strings), dtype=np.uint8)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    ends = np.cumsum(sizes)
    of = np.repeat(np.arange(len(strings)), sizes)
    n = len(data)
    left = ends[of] - np.arange(n)
    symbol = np.cumsum(np.bincount(data, minlength=256) > 0)  # the bytes that occur, from 1
    bits = int(symbol[-1]).bit_length()
    covered, symbols, at = 63 // bits, symbol[data], np.arange(n)
    key = np.zeros(n, dtype=np.int64)
    for k in range(covered):
        key <<= bits
        m = max(0, n - k)
        key[:m] |= np.where(left[:m] > k, symbols[n - m :], 0)
    order = np.argsort(key, kind="stable")  # equal ones that end stay in the order of their strings
    alone = left[order] < covered
    places = (n + len(strings)).bit_length()
    while True:
        a = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.append(False, (a[1:] != a[:-1]) | alone[1:]))
        if covered >= depth or rank[order[-1]] == n - 1:
            return data, order, left, of
        times = 3 if 3 * places <= 63 else 2  # ranks that one key holds
        key = rank
        for far in range(covered, times * covered, covered):
            after = rank[np.minimum(at + far, n - 1)]
            key = key << places | np.where(left > far, len(strings) + after, np.where(left == far, of, 0))
        order = np.argsort(key)
        alone = np.zeros(n, dtype=bool)
        covered *= times


def repeats(strings: list[bytes], length: int, times: np.ndarray | None = None) -> np.ndarray:
    """For each byte of the joined strings, whether the `length` bytes from there start elsewhere too.

    times are the multiplicities of the strings, 1 if not given.
    """
    data, order, left, of_string = suffix_array(strings, length)
    n = len(order)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    first = data[order]
    before = order - 1
    inner = np.ones(n, dtype=bool)  # suffixes that have a byte before them in their string
    inner[place[np.append(0, np.flatnonzero(left[:-1] == 1) + 1)]] = False
    step = np.where(inner, place[before], -1)  # the row of the suffix that is one byte longer
    known = np.zeros(n + 1, dtype=bool)  # boundaries whose common prefix is shorter than length
    known[0] = known[n] = True
    changes = np.flatnonzero(first[1:] != first[:-1]) + 1
    known[changes] = True
    lo, hi = np.append(0, changes), np.append(changes, n)
    places = n.bit_length()
    low = (1 << places) - 1
    for level in range(1, length):
        size = hi - lo
        past = np.cumsum(size)
        rows = np.repeat(lo - past + size, size) + np.arange(past[-1])
        to = step[rows]
        keep = to >= 0
        keys = np.sort((np.repeat(np.arange(len(lo)) << places, size) | to)[keep])
        to = keys & low
        kind = keys >> places << 8 | first[to]  # the interval that was extended, and the byte before it
        edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1])) if len(to) else np.zeros(0, np.int64)
        lo, hi = to[edge], to[np.append(edge[1:], len(to)) - 1] + 1 if len(to) else to[edge]
        if level == 1:  # the separators' own extensions
            last = np.sort(place[left == 1])
            lo, hi = np.append(lo, last), np.append(hi, last + 1)
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        if len(hi) == 0:
            if level > 1:
                break
            continue
        known[hi] = True
    group = np.cumsum(known[:n]) - 1
    weight = np.ones(n) if times is None else times[of_string[order]]
    out = np.zeros(n, dtype=bool)
    out[order] = np.bincount(group, weight)[group] > 1
    return out & (left >= length)


def _bytes_of(parts: list[np.ndarray], kind: str) -> bytes:
    return (np.concatenate(parts) if parts else np.zeros(0)).astype(kind).tobytes()


ANCHORS = {"fp": "<u8", "ctx": "<u8", "at": "<i4", "lo": "<i8", "span": "<i2", "left": "<i2"}


def blocks(docs: DataFrame, length: int) -> DataFrame:
    """A row for each block of texts: keys, text hashes, and the packed runs of all its texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 24, 0
        ids, hashes, held, size, texts = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            columns = [_bytes_of([h[k] for h in held], kind) for k, kind in enumerate(ANCHORS.values())]
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([[i for part in ids for i in part]], pa.list_(pa.int64())), pa.array([[i for part in hashes for i in part]], pa.list_(pa.int64())), *[pa.array([c], pa.binary()) for c in columns]], names=["block", "ids", "hashes", *ANCHORS])

        for batch in chunked(rows, "text"):
            data, offsets = text_buffer(batch.column("text"))
            fp, ctx, text, lo, span, left = runs_of_chunk(data, offsets, length)
            held.append((fp, ctx, text + texts, lo, span, left))
            ids.append(batch.column("doc_id").to_pylist())
            hashes.append(batch.column("h").to_pylist())
            texts += batch.num_rows
            size += len(data)
            if size >= BLOCK_BYTES:
                yield out()
                ids, hashes, held, size, texts, seq = [], [], [], 0, 0, seq + 1
        if held:
            yield out()

    kinds = ", ".join(f"{c} binary" for c in ANCHORS)
    return docs.mapInArrow(run, f"block long, ids array<long>, hashes array<long>, {kinds}")


def _bucket(fp: np.ndarray, n: int) -> np.ndarray:
    return ((fp >> U64(20)) % U64(n)).astype(np.int64)


def repeated_runs(packed: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, h, fp, ctx, lo, span, left) of the runs whose anchor occurs more than once."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw in zip(batch.column("block").to_pylist(), batch.column("fp"), strict=True):
                fp, n = np.unique(np.frombuffer(raw.as_py(), "<u8"), return_counts=True)
                bucket = _bucket(fp, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b + 1] > cuts[b]]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()), pa.array([fp[o].tobytes() for _, o in rows], pa.binary()), pa.array([(n[o] > 1).astype(np.uint8).tobytes() for _, o in rows], pa.binary())], names=["bucket", "block", "fps", "many"])

    def meet(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u8") for x in table.column("fps").to_pylist()]
        many = np.frombuffer(b"".join(table.column("many").to_pylist()), np.uint8)
        _, where, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        total = np.bincount(where, many + 1.0)
        again = (total[where] > 1).astype(np.uint8)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return pa.table([table.column("block"), table.column("bucket"), pa.array([p.tobytes() for p in np.split(again, cuts)], pa.binary())], names=["block", "bucket", "again"])

    sent = packed.select("block", "fp").mapInArrow(send, "bucket int, block long, fps binary, many binary")
    bits = sent.groupBy("bucket").applyInArrow(meet, "block long, bucket int, again binary").groupBy("block").agg(F.collect_list(F.struct("bucket", "again")).alias("bits"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = {c: np.frombuffer(row[c], kind) for c, kind in ANCHORS.items()}
                fp, where = np.unique(a["fp"], return_inverse=True)
                bucket = _bucket(fp, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                again = np.zeros(len(fp), dtype=np.uint8)
                for b in row["bits"] or []:
                    again[order[cuts[b["bucket"]] : cuts[b["bucket"] + 1]]] = np.frombuffer(b["again"], np.uint8)
                k = np.flatnonzero(again[where])
                ids, hashes = pa.array(row["ids"], pa.int64()), pa.array(row["hashes"], pa.int64())
                for lo in range(0, len(k), 20_000):
                    some = k[lo : lo + 20_000]
                    at = pa.array(a["at"][some])
                    yield pa.RecordBatch.from_arrays([ids.take(at), hashes.take(at), pa.array(a["fp"][some].view(np.int64)), pa.array(a["ctx"][some].view(np.int64)), *[pa.array(a[c][some], kind) for c, kind in (("lo", pa.int64()), ("span", pa.int16()), ("left", pa.int16()))]], names=["doc_id", "h", "fp", "ctx", "lo", "span", "left"])

    return packed.join(bits, "block").mapInArrow(take, "doc_id long, h long, fp long, ctx long, lo long, span short, left short")


SPANS = "array<struct<a: int, b: int>>"  # first windows, and the windows after the last


def _stretches(flags: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"a": int(a), "b": int(b)} for a, b in edge.reshape(-1, 2)]


def transform(rows: DataFrame, length: int) -> DataFrame:
    """(unit, s, spans) for written rows (unit, s, n, bytes): windows that occur more than once in their batch.

    Only windows of one unit can be equal, and a unit's rows are in one batch; n are multiplicities.
    """
    parts = max(1, -(-rows.count() // BATCH))

    def run(table: pa.Table) -> pa.Table:
        strings = table.column("bytes").to_pylist()
        flags = repeats(strings, length, table.column("n").to_numpy())
        cuts = np.cumsum([len(s) for s in strings])[:-1]
        spans = [_stretches(part) for part in np.split(flags, cuts)]
        return pa.table([table.column("unit"), table.column("s"), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["unit", "s", "spans"])

    dealt = rows.select("unit", "s", "n", "bytes", F.pmod(F.xxhash64("unit"), F.lit(parts)).alias("batch"))
    return dealt.groupBy("batch").applyInArrow(run, f"unit long, s long, spans {SPANS}").filter(F.size("spans") > 0)


def split_windows(rows: DataFrame, parts: int | None, length: int) -> DataFrame:
    """Rows (fp, ctx, n, left, bytes) dealt to ranges of the anchor's offset a in the window.

    All windows of a range share the bytes from its smallest offset to length - 1 - its largest
    offset around the anchor; with the fingerprint they are the unit.
    """
    width = length - K + 1
    step = 1 if parts is None else -(-width // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for fp, ctx, n, left, raw in zip(*(batch.column(c).to_pylist() for c in ("fp", "ctx", "n", "left", "bytes")), strict=True):
                last = left - (len(raw) - length)  # the smallest offset: that of the last window
                for r in range(last // step, left // step + 1):
                    big, small = min(left, r * step + step - 1), max(last, r * step)
                    core = raw[left - r * step : left - (r * step + step - 1) + length]
                    out.append((fp, ctx, n, left - big, b"%d:" % r + core, raw[left - big : left - small + length]))
            data = [pa.array([o[k] for o in out], kind) for k, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*data, pa.array([o[4] for o in out], pa.binary()), pa.array([o[5] for o in out], pa.binary())], names=["fp", "ctx", "n", "base", "core", "bytes"])

    sub = rows.select("fp", "ctx", "n", "left", "bytes").mapInArrow(run, "fp long, ctx long, n long, base int, core binary, bytes binary")
    return sub.withColumn("unit", F.xxhash64("fp", "core")).withColumn("s", F.xxhash64("bytes", "unit")).drop("core")


def finer(rows: DataFrame, length: int) -> DataFrame:
    """(fp, ctx, spans) for the strings (fp, ctx, n, left, bytes) of anchors with more than CAP of them."""
    out = rows.select("fp", "ctx", F.lit(None).cast(SPANS).alias("spans")).limit(0)
    for parts in SPLITS:
        if rows.isEmpty():
            break
        sub = cut(split_windows(rows, parts, length))
        strings = sub.groupBy("unit", "s").agg(F.sum("n").alias("n"), F.first("bytes").alias("bytes"))
        units = cut(strings.groupBy("unit").agg(F.count("*").alias("m"), F.sum("n").alias("n")).filter("n > 1").select("unit", "m"))
        some = units if parts is None else units.filter(F.col("m") <= CAP)
        mine = cut(strings.join(some.select("unit"), "unit"))
        shifted = F.transform("spans", lambda x: F.struct((x["a"] + F.col("base")).alias("a"), (x["b"] + F.col("base")).alias("b")))
        got = cut(sub.select("unit", "s", "fp", "ctx", "base").join(transform(mine, length), ["unit", "s"]).select("fp", "ctx", shifted.alias("spans")), mine)
        out = out.unionByName(got)
        if parts is not None:
            below = sub.join(units.filter(F.col("m") > CAP), "unit", "left_semi").select("fp", "ctx").distinct()
            rows = cut(rows.join(below, ["fp", "ctx"], "left_semi"), sub, units, rows)
    return out


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, h, spans): ranges of window starts of each text (doc_id, h, text) that occur elsewhere too."""
    spark = docs.sparkSession
    packed = cut(blocks(docs, length))
    size = packed.agg(F.sum(F.octet_length("fp").cast("long")).alias("n")).first()["n"] or 0
    found = cut(repeated_runs(packed, max(workers(spark), -(-size // BUCKET_BYTES))), packed)
    place = F.struct("doc_id", "h", "lo", "span", "left")
    contexts = cut(found.groupBy("fp", "ctx").agg(F.count("*").alias("n"), F.min(place).alias("at")))
    anchors = cut(contexts.groupBy("fp").agg(F.count("*").alias("m")))  # written, so that the join below can split its large partitions
    open_ = contexts.join(anchors, "fp").select("fp", "ctx", F.least("n", F.lit(2)).alias("n"), "m", "at.*")
    wanted = open_.groupBy("doc_id", "h").agg(F.collect_list(F.struct("fp", "ctx", "n", "m", "lo", "span", "left")).alias("w"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "text"):
            out: list[tuple] = []
            for text, wants in zip(batch.column("text"), batch.column("w").to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8")
                out += [(w["fp"], w["ctx"], w["n"], w["m"], w["left"], raw[w["lo"] : w["lo"] + w["span"] + length]) for w in wants]
            for lo in range(0, len(out), 5_000):
                part = out[lo : lo + 5_000]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in part], kind) for k, kind in enumerate(kinds)], names=["fp", "ctx", "n", "m", "left", "bytes"])

    # Rows with equal key and text give their contexts more than once.
    own = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["h"] == wanted["h"])
    strings = cut(docs.join(wanted, own).select("text", "w").mapInArrow(slices, "fp long, ctx long, n long, m long, left int, bytes binary").dropDuplicates(["fp", "ctx"]), contexts, anchors)
    common = transform(strings.filter(F.col("m") <= CAP).select(F.col("fp").alias("unit"), F.col("ctx").alias("s"), "n", "bytes"), length)
    rest = finer(strings.filter(F.col("m") > CAP).drop("m"), length)
    spans = cut(common.select(F.col("unit").alias("fp"), F.col("s").alias("ctx"), "spans").unionByName(rest), strings)
    hits = found.select("doc_id", "h", "fp", "ctx", "lo").join(spans, ["fp", "ctx"])
    placed = F.transform("spans", lambda x: F.struct((x["a"] + F.col("lo")).alias("a"), (x["b"] + F.col("lo")).alias("b")))
    return hits.groupBy("doc_id", "h").agg(F.flatten(F.collect_list(placed)).alias("spans"))


def covered(starts: list[dict[str, int]] | None, length: int) -> list[tuple[int, int]]:
    """The bytes that windows with these starts cover, as maximal stretches."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"] - 1 + length) for x in starts or []):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", kept: str = "kept", spans: str = "spans", as_text: bool = False) -> DataFrame:
    """Adds kept, the remaining bytes, and spans, the removed stretches, to every row of docs.

    With as_text, kept is a string without characters of which only some bytes are left.  All other columns stay; columns that have those names are replaced.
    """
    keep = [c for c in docs.columns if c.lower() not in (kept.lower(), spans.lower())]
    body = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("h"), body.alias("text"))
    found = repeated_windows(plain, length)
    rows = docs.select(F.struct(*keep).alias("row"), F.col(key).cast("long").alias("doc_id"), F.xxhash64(body).alias("h"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["h"] == found["h"]), "left").select("row", "spans")
    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + [T.StructField(kept, T.StringType() if as_text else T.BinaryType()), T.StructField(spans, T.ArrayType(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_text = (pa.RecordBatch.from_arrays([b.column("row"), b.column("spans"), b.column("row").field(text)], names=["row", "spans", "t"]) for b in batches)
        for batch in chunked(with_text, "t"):
            left, gone = [], []
            for t, s in zip(batch.column("t").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, stretches = (t or "").encode("utf-8"), covered(s, length)
                edges = [0, *[x for pair in stretches for x in pair], len(raw)]
                left.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                gone.append([{"start": a, "end": b} for a, b in stretches])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("row").field(c) for c in keep] + [pa.array([x.decode("utf-8", "ignore") for x in left], pa.string()) if as_text else pa.array(left, pa.binary()), pa.array(gone, kinds)], names=[*keep, kept, spans])

    return joined.mapInArrow(run, schema)
