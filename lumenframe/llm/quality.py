"""A quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE bytes.  Each passage is encoded from the byte stream alone:
the shares of pairs of byte classes, and how its words repeat.  A hidden layer maps a passage to h;
gated attention, w . (tanh(V h) * sigmoid(U h)), is normalised over the bag, and the weighted mean
of the h gives the score.  Only documents have labels; which passages matter is learned from them.

The network is fitted on a bounded sample: at most SAMPLE_ROWS labelled rows and SAMPLE_BYTES of text, in
hash order of their keys, with all of their passages.  Scoring reads every passage of the whole text.
An empty or null text is one empty passage.  Rows with a null label are not learned from.  A key with
several labels is learned with each.  Repeated rows are scored alike, and learned from once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.batches import ASCII_LOWER, chunked, span_hashes, text_buffer, word_spans
from lumenframe.llm.bpe import _with_columns
from lumenframe.llm.tables import bounded_sample, drop

PASSAGE = 512
SAMPLE_ROWS, SAMPLE_BYTES = 3_000, 32 << 20
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 10, 64, 4e-3, 1e-4
SEED = 11

CLASSES = 16


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 15, dtype=np.int64)  # other ASCII
    for members, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3), (b"\n\r", 4), (b".", 5), (b",;:", 6), (b"!", 7), (b"?", 8), (b"#$%", 9), (b"&*@", 10), (b"|", 11), (b"\"'()-", 12)):
        kind[list(members)] = k
    kind[0x80:0xC0], kind[0xC0:] = 14, 13
    return kind


BYTE_CLASS = _byte_classes()
FEATURES = CLASSES * CLASSES + 4


#: Bytes of one longer text that are encoded at once; each such piece ends like a text.
PIECE = 2048 * PASSAGE


def encode_passages(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a column, and the number of passages of each text (one at least)."""
    data, offsets = text_buffer(column)
    if len(column) == 1 and len(data) > PIECE:
        parts = [_features(data[at : at + PIECE], np.array([0, len(data[at : at + PIECE])]))[0] for at in range(0, len(data), PIECE)]
        return np.vstack(parts), np.array([sum(map(len, parts))])
    return _features(data, offsets)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(offsets)
    per = np.maximum(1, -(-lengths // PASSAGE))
    first = np.concatenate([[0], np.cumsum(per)])
    total = int(first[-1])
    counts = np.zeros(total * CLASSES * CLASSES)
    words = np.zeros((total, 4))
    if len(data):
        doc = np.repeat(np.arange(len(lengths)), lengths)
        passage = first[doc] + (np.arange(len(data)) - offsets[doc]) // PASSAGE
        kind = BYTE_CLASS[data]
        after = np.append(kind[1:], 4)
        after[offsets[1:][lengths > 0] - 1] = 4  # a text ends like a line
        counts = np.bincount((passage * CLASSES + kind) * CLASSES + after, minlength=len(counts)).astype(float)
        starts, ends, of = word_spans(data, offsets)
        if len(starts):
            where = passage[starts]
            hashes = span_hashes(ASCII_LOWER[data], starts, ends)
            same = np.zeros(len(starts))
            same[1:] = (hashes[1:] == hashes[:-1]) & (where[1:] == where[:-1])
            order = np.lexsort((hashes, where))
            fresh = np.ones(len(starts))
            fresh[order[1:]] = (hashes[order[1:]] != hashes[order[:-1]]) | (where[order[1:]] != where[order[:-1]])
            n = np.bincount(where, minlength=total)
            some = np.maximum(n, 1)
            words[:, 0] = np.bincount(where, same, minlength=total) / some
            words[:, 1] = np.bincount(where, fresh, minlength=total) / some
            words[:, 2] = np.bincount(where, ends - starts, minlength=total) / some / 10
            words[:, 3] = n / 100
    pairs = counts.reshape(total, CLASSES * CLASSES)
    pairs = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    return np.hstack([pairs, words]).astype(np.float32), per


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def forward(self, x: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, dict]:
        w, first = self.w, np.concatenate([[0], np.cumsum(per)[:-1]])
        bag = np.repeat(np.arange(len(per)), per)
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        e = (v * u) @ w["w"]
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        p = _sigmoid(z @ w["c"] + w["d"][0])
        return p, {"h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag, "first": first}

    def score(self, column: pa.Array) -> np.ndarray:
        x, per = encode_passages(column)
        return self.forward(x, per)[0].astype(np.float64)


def gradients(model: Model, x: np.ndarray, per: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log loss of these bags, for each weight."""
    w = model.w
    p, t = model.forward(x, per)
    bag, a, h, z = t["bag"], t["a"], t["h"], t["z"]
    dp = (p - y) / len(y)
    dz = dp[:, None] * w["c"]
    da = (dz[bag] * h).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, t["first"])[bag])
    gate = de[:, None] * w["w"]
    dv, du = gate * t["u"] * (1 - t["v"] ** 2), gate * t["v"] * t["u"] * (1 - t["u"])
    dh = (a[:, None] * dz[bag] + dv @ w["V"].T + du @ w["U"].T) * (1 - h**2)
    return {"c": z.T @ dp, "d": np.array([dp.sum()]), "w": (t["v"] * t["u"]).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": x.T @ dh, "b": dh.sum(axis=0)}


def fit_bags(x: np.ndarray, per: np.ndarray, y: np.ndarray) -> Model:
    """Minimises the log loss of bags by Adam on mini-batches."""
    rng = np.random.default_rng(SEED)
    shape = {"W": (x.shape[1], HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
    model = Model(w)
    if len(y) == 0:
        return model
    m, s = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    start = np.concatenate([[0], np.cumsum(per)])
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            take = order[lo : lo + BATCH]
            rows = np.concatenate([np.arange(start[i], start[i + 1]) for i in take])
            xb = x[rows]
            g = gradients(model, xb, per[take], y[take])
            step += 1
            for k, v in w.items():
                grad = (g[k] + DECAY * v).astype(np.float32)
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.99 * s[k] + 0.01 * grad**2
                w[k] = v - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-7)
            model.w = w
    return model


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id") -> Model:
    """Fits on the bounded sample of labelled rows of docs that comes first in hash order of key.

    Candidates are chosen by keys alone, so that no other rows' texts are shuffled.
    """
    marks = labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).distinct()
    known = marks.join(docs.select(F.col(key).alias("k")), "k", "left_semi")
    first = known.select("k", "y", F.xxhash64("k").alias("h")).orderBy("h", "k", "y").limit(SAMPLE_ROWS).select("k", "y")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(first.select("k").distinct()), "k", "left_semi")  # SAMPLE_ROWS keys
    sample = bounded_sample(texts, SAMPLE_ROWS, SAMPLE_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, "t"):
            x, per = encode_passages(batch.column("t"))
            parts = np.split(x.astype(np.float16), np.cumsum(per)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column("k").cast(pa.string()), batch.column("y"), pa.array(per, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["k", "y", "n", "x"])

    encoded = sample.join(F.broadcast(first), "k").select("k", "y", "t").mapInArrow(run, "k string, y double, n long, x binary")
    got = sorted(encoded.collect(), key=lambda r: (r["k"] or "", r["y"], bytes(r["x"])))  # passages of the sample
    drop(sample)
    if not got:
        return fit_bags(np.zeros((0, FEATURES), np.float32), np.zeros(0, int), np.zeros(0))
    x = np.vstack([np.frombuffer(r["x"], np.float16).reshape(r["n"], FEATURES) for r in got]).astype(np.float32)
    return fit_bags(x, np.array([r["n"] for r in got]), np.array([r["y"] for r in got], dtype=np.float32))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of the whole text, from 0 to 1."""
    schema = _with_columns(df, {out: T.DoubleType()})
    keep = [f.name for f in schema.fields if f.name != out]
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunked(batches, text, 1 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(shared.value.score(batch.column(text)), pa.float64())], names=[*keep, out])

    return df.mapInArrow(run, schema)
