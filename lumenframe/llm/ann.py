"""Nearest neighbours by inner product with additive quantisation.

A vector, scaled to length 1, is approximated by a sum of one full-dimensional word from each of BOOKS
codebooks, fitted to residuals in turn on a bounded sample; encoding is a beam search over the books.
With the codes go the vector's norm, the ratio of its length to that of its approximation, and a bound of
what the approximation times that ratio misses.  A query makes a table of its inner products with all words;
a candidate's score is the sum of BOOKS table entries times its ratio and norm.  The SHORT best candidates
of a block are ranked again by exact double-precision products.  A candidate's exact product is at most its
score and the bound times the query's norm; all candidates for which that reaches the product of the best
`top` so far are ranked exactly too.  So copies and near copies of a vector, however many, are all compared,
and nothing is lost.  Where no bound is known (lengths with under WORDS vectors in the sample, norms
beyond double precision) all candidates are ranked exactly.

Queries and codes meet in blocks: every query block goes to every code block (a stated query set
against all rows), and each pair of blocks returns the best `top` of a query.

Vectors that are null, zero, or hold null or non-finite components take no part.  Vectors of several
lengths are searched each among those of its own.  Rows that repeat both id and vector are one row; an id
with several vectors is several rows, each of which is a query of its own and a candidate for the others.
Equal scores go to the smaller id.  With fewer than `top` candidates all are returned.  A product that
overflows is infinite, and one that is not a number is last.  Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.tables import cut, workers

BOOKS, WORDS = 32, 256
SAMPLE_ROWS = 12_000
ITERATIONS = 8
BEAM = 3
#: Candidates of a query that are ranked exactly first, from each block of codes.
SHORT = 150
#: Components of the vectors of a block of codes, rows of such a block where there are few, queries of a block.
BLOCK_VALUES, FEW_ROWS, QUERY_BLOCK = 1 << 22, 4_096, 4_096
SEED = 5


def usable(vector: str) -> Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def fit_books(sample: np.ndarray) -> np.ndarray:
    """BOOKS codebooks of WORDS words, each by k-means on what the ones before it leave."""
    rng = np.random.default_rng(SEED)
    rest = sample.astype(np.float32).copy()
    books = []
    for _ in range(BOOKS):
        k = min(WORDS, len(rest))
        words = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(ITERATIONS):
            near = (rest @ words.T - 0.5 * (words**2).sum(axis=1)).argmax(axis=1)
            n = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            full = np.flatnonzero(n)
            words[full] = np.add.reduceat(rest[order], np.concatenate([[0], np.cumsum(n)[:-1]])[full], axis=0) / n[full][:, None]
            if len(empty := np.flatnonzero(n == 0)):
                words[empty] = rest[rng.choice(len(rest), len(empty))]
        near = (rest @ words.T - 0.5 * (words**2).sum(axis=1)).argmax(axis=1)
        rest -= words[near]
        books.append(np.vstack([words, np.zeros((WORDS - k, rest.shape[1]), np.float32)]))
    return np.array(books)


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, BOOKS) by beam search, and the ratios of norms."""
    n, d = x.shape
    rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), dtype=np.uint8)
    size = (x**2).sum(axis=1)[:, None].astype(np.float32)
    for words in books:
        gain = (words**2).sum(axis=1) - 2 * rest @ words.T + size[:, :, None]  # what would be left
        flat = gain.reshape(n, -1)
        best = np.argpartition(flat, min(BEAM, flat.shape[1] - 1), axis=1)[:, :BEAM]
        beam, word = best // len(words), best % len(words)
        rest = np.take_along_axis(rest, beam[:, :, None], axis=1) - words[word]
        codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        size = np.take_along_axis(flat, best, axis=1)
    k = size.argmin(axis=1)
    pick = np.arange(n)
    left = rest[pick, k]
    own, near = np.linalg.norm(x, axis=1), np.linalg.norm(x - left, axis=1)
    return codes[pick, k], (own / np.maximum(near, 1e-12)).astype(np.float32)


def missed(x: np.ndarray, codes: np.ndarray, ratio: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Norms of what the approximations miss, with the rounding of single-precision scores; infinite if unknown."""
    near, size = np.zeros(x.shape), np.zeros(len(x))
    with np.errstate(all="ignore"):
        for m, words in enumerate(books.astype(np.float64)):
            near += words[codes[:, m]]
            size += np.linalg.norm(words, axis=1)[codes[:, m]]
        ratio = ratio.astype(np.float64)
        left = np.linalg.norm(x - near * ratio[:, None], axis=1)
        rounding = 2 * (x.shape[1] + len(books)) * np.finfo(np.float32).eps * (size * ratio + np.linalg.norm(x, axis=1))
        bound = left + rounding
    return np.where(np.isfinite(bound), bound, np.inf)


def products(q: np.ndarray, columns: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products of q with some columns, summed in order of the components, so equal vectors have equal ones."""
    total = np.zeros(len(at))
    for x, row in zip(q.tolist(), columns, strict=True):
        total += row[at] * x
    return total


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in the same directions, and the lengths; no step over- or underflows but the last product."""
    top = np.abs(x).max(axis=1, initial=0.0)
    unit = x / np.where(top > 0, top, 1.0)[:, None]
    size = np.linalg.norm(unit, axis=1)
    with np.errstate(over="ignore"):
        return unit / np.where(size > 0, size, 1.0)[:, None], size * top


def nearest(q: np.ndarray, score: np.ndarray, most: np.ndarray, ids: np.ndarray, columns: np.ndarray, own: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact products of the `top` best columns, without own; equal ones by smaller id.

    score are the approximate products of the scaled query and most their upper bounds.
    """
    size = scaled(q[None, :])[1][0]
    score, most = np.where(np.isnan(score), -np.inf, score), np.where(np.isnan(most), np.inf, most)
    score[own] = most[own] = -np.inf
    others = np.ones(len(score), dtype=bool)
    others[own] = False
    k = max(SHORT, top)
    at = np.argpartition(-score, k)[:k] if len(score) > k else np.arange(len(score))
    at = at[others[at]]
    with np.errstate(all="ignore"):
        exact = products(q, columns, at)
        if len(score) > k:
            if len(at) >= top and np.isfinite(exact).all() and 1e-280 < size < np.inf:
                most[at] = -np.inf
                more = np.flatnonzero(most >= np.partition(exact, len(exact) - top)[len(exact) - top] / size)
                at, exact = np.concatenate([at, more]), np.concatenate([exact, products(q, columns, more)])
            else:
                at = np.flatnonzero(others)
                exact = products(q, columns, at)
    best = np.lexsort((ids[at], -np.where(np.isnan(exact), -np.inf, exact), np.isnan(exact)))[:top]
    return at[best], exact[best]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _once(ids: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Places of the distinct (id, vector), by id."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i], raw[i]))
    return np.array([i for n, i in enumerate(order) if n == 0 or (ids[i], raw[i]) != (ids[order[n - 1]], raw[order[n - 1]])], dtype=np.int64)


def search(vectors: DataFrame, queries: DataFrame, top: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of vectors to each query, itself apart.

    Both frames need key and vector.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vector].dataType.elementType.typeName()
    kind = np.float32 if element == "float" else np.float64  # vectors travel as they are
    good = vectors.filter(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.filter(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("q")).withColumn("qn", F.xxhash64("q"))
    sample = good.select("vec_id", "v", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(SAMPLE_ROWS).select("v").toArrow()  # SAMPLE_ROWS rows
    out = "query_id long, qn long, vec_id long, score double"
    lists = sample.column("v").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    books: dict[int, np.ndarray] = {}  # at most SAMPLE_ROWS / WORDS lengths
    for d, n in zip(*np.unique(sizes, return_counts=True), strict=True):
        if n >= WORDS:
            books[int(d)] = fit_books(scaled(_matrix(lists.filter(pa.array(sizes == d))))[0])
    shared = spark.sparkContext.broadcast(books)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            for d in np.unique(size).tolist():
                same = np.flatnonzero(size == d)
                for lo in range(0, len(same), 1024):
                    part = batch.take(pa.array(same[lo : lo + 1024]))
                    x = _matrix(part.column("v"))
                    unit, norm = scaled(x)
                    if d in shared.value:
                        codes, ratio = encode(unit.astype(np.float32), shared.value[d])
                        bound = missed(unit, codes, ratio, shared.value[d])
                        bound[~((norm > 1e-280) & (norm < np.inf))] = np.inf
                    else:
                        codes, ratio, bound = np.zeros((len(x), BOOKS), np.uint8), np.zeros(len(x), np.float32), np.full(len(x), np.inf)
                    bytes_ = [pa.array([row.tobytes() for row in rows], pa.binary()) for rows in (codes, x.astype(kind))]
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(np.full(len(x), d), pa.int32()), bytes_[0], pa.array(ratio, pa.float32()), pa.array(bound, pa.float64()), pa.array(norm, pa.float64()), bytes_[1]], names=["vec_id", "dim", "codes", "ratio", "bound", "norm", "v"])

    coded = cut(good.mapInArrow(pack, "vec_id long, dim int, codes binary, ratio float, bound double, norm double, v binary"))
    total = coded.agg(F.count("*").alias("n"), F.sum(F.col("dim").cast("long")).alias("values")).first()
    n_asked = asked.count()
    code_blocks = max(1, -(-(total["values"] or 0) // BLOCK_VALUES), min(workers(spark), -(-total["n"] // FEW_ROWS)))
    query_blocks = max(1, -(-n_asked // QUERY_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # One row for a block: codes are BOOKS + 28 bytes a vector and the vector itself, queries 8 bytes a component.
    code_rows = coded.groupBy("dim", block("vec_id", code_blocks).alias("cb")).agg(F.collect_list(F.struct("vec_id", "codes", "ratio", "bound", "norm", "v")).alias("c"))
    query_rows = asked.groupBy(F.size("q").alias("dim"), block("query_id", query_blocks).alias("qb")).agg(F.collect_list(F.struct("query_id", "qn", "q")).alias("q"))
    pairs = query_rows.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1)))).join(code_rows, ["dim", "cb"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                words = shared.value.get(batch.column("dim")[k].as_py())
                c, q = batch.column("c").slice(k, 1).flatten(), batch.column("q").slice(k, 1).flatten()
                raw = c.field("v").to_pylist()
                at = _once(c.field("vec_id").to_numpy(), raw)
                ids, raw = c.field("vec_id").to_numpy()[at], [raw[i] for i in at]
                codes = np.ascontiguousarray(np.frombuffer(b"".join(c.field("codes").to_pylist()), np.uint8).reshape(-1, BOOKS)[at].T)
                ratio, bound, norm = (c.field(f).to_numpy()[at] for f in ("ratio", "bound", "norm"))
                columns = np.ascontiguousarray(np.frombuffer(b"".join(raw), kind).reshape(len(ids), -1).T.astype(np.float64))
                asking, numbers, wanted = q.field("query_id").to_numpy(), q.field("qn").to_numpy(), _matrix(q.field("q"))
                same = [x.astype(kind).tobytes() for x in wanted]
                only = _once(asking, same)
                for lo in range(0, len(only), 256):
                    rows = []
                    part = only[lo : lo + 256]
                    unit = scaled(wanted[part])[0]
                    tables = None if words is None else np.einsum("mwd,nd->nmw", words, unit.astype(np.float32))
                    for n, i in enumerate(part.tolist()):
                        s = np.zeros(len(ids), np.float32)
                        if words is not None:
                            for m in range(BOOKS):
                                s += tables[n, m][codes[m]]
                            s *= ratio
                        with np.errstate(all="ignore"):
                            score, most = s * norm, (s + bound) * norm
                        first, past = np.searchsorted(ids, asking[i]), np.searchsorted(ids, asking[i], side="right")
                        own = np.array([j for j in range(first, past) if raw[j] == same[i]], dtype=np.int64)
                        best, exact = nearest(wanted[i], score, most, ids, columns, own, top)
                        rows.append((np.full(len(best), asking[i]), np.full(len(best), numbers[i]), ids[best], exact))
                    columns_ = map(np.concatenate, zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns_, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "qn", "vec_id", "score"])

    scored = pairs.repartition(min(query_blocks * code_blocks, 4096), "dim", "qb", "cb").mapInArrow(meet, out)
    worst = F.when(F.isnan("score"), F.lit(float("-inf"))).otherwise(F.col("score"))
    rank = Window.partitionBy("query_id", "qn").orderBy(F.isnan("score"), worst.desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
