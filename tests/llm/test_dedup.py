"""The Jaccard join, the suffix dedup and the components against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_brute import brute_components

from lumenframe.llm import graph, ngram_join, suffix_dedup


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4))) for _ in range(80)]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(1, 90))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w).title() if rng.random() < 0.2 else " ".join(w)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two")]


@pytest.mark.parametrize(("seed", "percent", "block"), [(1, 90, 2000), (3, 80, 7)])
def test_join_equals_brute_force(spark, monkeypatch, seed, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, 3, percent).collect()}
    assert got == brute_components(rows, 3, percent)


@pytest.mark.parametrize("bits", [64, 1 << 25])
def test_join_deals_no_texts_and_needs_no_filter_to_be_right(spark, monkeypatch, bits):
    monkeypatch.setattr(ngram_join, "FILTER_BITS", bits)  # one of 64 is full
    plans, whole = [], ngram_join.whole_sets

    def kept(*given):
        out = whole(*given)
        plans.append((out._jdf.queryExecution().executedPlan().toString(), out.count()))
        return out

    monkeypatch.setattr(ngram_join, "whole_sets", kept)
    rows = corpus(2) + [(3, "lone"), (None, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).localCheckpoint()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, 3, 90).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = brute_components(corpus(2), 3, 90)
    assert got == Counter([(k, *v) for k, v in want.items()] + [(3, 1, 3), (None, 1, None)])
    ((plan, sets),) = plans
    assert sets > 20
    # Sets and the keys asked for are dealt once each; nothing below the step that makes sets is.
    assert plan.count("Exchange hashpartitioning") == 2
    assert "Exchange" not in plan[plan.rindex("MapInArrow") :].split("Scan ExistingRDD")[0]


def test_a_key_filter_misses_no_key(spark):
    keys = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    words = ngram_join.key_filter(spark.createDataFrame([(int(k),) for k in keys], "k long").repartition(4), 1 << 17)
    assert ngram_join._passed(pa.array(keys), words, 1 << 17).to_numpy(zero_copy_only=False).all()
    others = pa.array([None, *range(5000)], pa.int64())
    assert not ngram_join._passed(others, words, 1 << 17)[0].as_py()
    assert ngram_join._passed(others, words, 1 << 17).true_count < 100


def test_join_of_odd_rows(spark):
    a = " ".join(f"w{i}" for i in range(40))
    rows = [(5, a), (5, a), (7, a + " end"), (None, a), (8, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, component_id string, grams int")
    got = ngram_join.join(df, 3, 90).collect()
    assert len(got) == 5
    assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(5, 5), (7, 5), (8, 8)}
    assert ngram_join.join(df.limit(0), 3, 90).count() == 0


@pytest.mark.parametrize(("n", "percent", "words"), [(3, 90, 11), (5, 80, 8)])
def test_join_of_a_set_inside_one_a_gram_larger(spark, n, percent, words):
    w = [f"w{i}" for i in range(words + 1)]
    rows = [(1, " ".join(w[:-1])), (2, " ".join(w)), (3, " ".join(w[:-2])), (4, " ".join(w[1:-1]) + " end"), (5, "own " + " ".join(w[1:]))]
    want = brute_components(rows, n, percent)
    assert want[2][1] == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, n, percent).collect()} == want
    alone = df.filter("doc_id < 3")
    assert {r["component_id"] for r in ngram_join.join(alone, n, percent).collect()} == {1}


@pytest.mark.parametrize(("n", "percent"), [(1, 50), (2, 67), (1, 100)])
def test_join_of_short_sets_equals_brute_force(spark, n, percent):
    rng = random.Random(n * percent)
    rows = []
    for base in range(8):
        w = [f"b{base}w{i}" for i in range(rng.randint(1, 14))]
        for _ in range(5):
            lo = rng.choice([0, 0, 1])
            rows.append((len(rows), " ".join(w[lo : len(w) - rng.choice([0, 0, 1])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, n, percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_trie_partners():
    rng = np.random.default_rng(0)
    for _ in range(60):
        v = int(rng.integers(5, 50))
        base = [set(rng.choice(v, int(rng.integers(1, v)), replace=False).tolist()) for _ in range(3)]
        sets = [np.array(sorted((base[rng.integers(3)] ^ {int(rng.integers(v))}) or {0})) for _ in range(20)]
        trie = ngram_join.Trie(sets)
        for x in sets:
            want = {j for j, y in enumerate(sets) if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))}
            assert {trie.order[k] for k in trie.partners(x, 80).tolist()} == want


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_rounds_of_long_chains(spark, order):
    n = 1000
    name = {"up": list(range(n)), "down": list(range(n))[::-1], "mixed": random.Random(1).sample(range(n), n)}[order]
    edges = spark.createDataFrame([(name[i], name[i + 1]) for i in range(n - 1)], "a long, b long")
    assert {r["root"] for r in graph.components(edges).collect()} == {0}
    assert graph.last_rounds[0] <= 10 and graph.last_rounds[1] <= 25


def test_tries_leave_dead_branches():
    import time

    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 62, 400)).astype(np.int64) for _ in range(1000)]
    for s in sets:
        s[:3] = [1, 2, 3]
    start = time.perf_counter()
    assert ngram_join.forest(np.arange(1000), np.arange(1000), sets, [np.ones(len(s), np.int64) for s in sets], 90) == []
    assert time.perf_counter() - start < 6


def test_groups_that_are_joined_already_are_not_walked():
    sets = [np.array([1, 2, 3, 4, 5 + k]) for k in range(4)] + [np.array([7, 8, 9, 10, 11]), np.array([7, 8, 9, 10, 12])]
    often = [np.ones(5, np.int64)] * 6
    links = ngram_join.forest(np.arange(6), np.array([0, 0, 0, 0, 4, 5]), sets, often, 60)
    assert [set(x) for x in links] == [{4, 5}]


@pytest.mark.parametrize("block", [3])
def test_join_of_large_buckets(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 90):
        w = list(base if i % 3 else rows[-1][1].split())
        for _ in range(rng.randint(1, 5 if i % 4 else 14)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 25)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(df, 2, 80).collect()}
    assert got == brute_components(rows, 2, 80)


def test_rows_of_one_key_and_different_texts(spark):
    a, b = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    rows = [(5, a), (5, b), (9, a + " x"), (3, b + " y"), (7, "own text"), (7, a)]
    got = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, mark="h").collect())
    assert got == [(3, 3, 39), (5, 3, 38), (5, 5, 38), (7, 5, 38), (7, 7, 1), (9, 5, 39)]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 150), (9, 9), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100}


def brute_dedup(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    n = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for (i, _), r in zip(rows, raw, strict=True):
        gone = [False] * len(r)
        for k in range(len(r) - length + 1):
            if n[r[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def texts(seed, n=60):
    rng = random.Random(seed)
    syllables = [rng.choice(["th", "é", "an", "ro", "ка", "q"]) + rng.choice("aeiou ") for _ in range(40)]
    make = lambda k: "".join(rng.choice(syllables) for _ in range(k))
    passages = [make(60), make(90), make(200), "ab" * 150, make(52)]
    rows = [(i, "".join(rng.choice([make(rng.randint(1, 50)), rng.choice(passages), rng.choice(passages)[: rng.randint(1, 120)]]) for _ in range(rng.randint(0, 5)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, rows[3][1]), (n + 2, rows[3][1]), (n + 3, "x" * 700)]


@pytest.mark.parametrize(("seed", "cap"), [(1, 3000), (2, 3000), (3, 2)])
def test_dedup_equals_brute_force(spark, monkeypatch, seed, cap):
    monkeypatch.setattr(suffix_dedup, "CAP", cap)
    rows = texts(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = []
    for r in suffix_dedup.remove(df, 60).collect():
        got.append((r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
    assert sorted(got, key=str) == brute_dedup(rows, 60)


def test_dedup_keeps_other_columns_and_cuts_no_character(spark):
    same = "é" * 150
    df = spark.createDataFrame([(1, "a" + same, 3), (2, "b" + same, 4), (None, "short", 5)], "doc_id long, text string, Kept int")
    got = suffix_dedup.remove(df, as_text=True).orderBy("doc_id").collect()
    assert [r["kept"] for r in got] == ["short", "a", "b"] and got[0].asDict().keys() == {"doc_id", "text", "kept", "spans"}
    assert suffix_dedup.remove(df.limit(0)).count() == 0


def test_dedup_of_rows_without_a_key(spark):
    rng = random.Random(12)
    make = lambda k: "".join(rng.choice("abcdefghij ") for _ in range(k))
    shared = [make(90), make(200), make(61), make(140)]
    rows = [(None, make(40) + shared[0] + make(70) + shared[1] + make(9)), (1, make(150) + shared[0] + make(33)), (None, make(20) + shared[2]), (None, shared[2] + make(80) + shared[3] + "x"), (2, make(30) + shared[1] + make(60)), (3, "y" + shared[3] + make(200)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in suffix_dedup.remove(df, 60).collect()]
    assert sorted(got, key=str) == brute_dedup(rows, 60)


def test_transform_against_counts():
    rng = random.Random(5)
    for _ in range(80):
        length = rng.choice([1, 2, 4, 9])
        base = bytes(rng.choice(b"ab") for _ in range(50))
        strings = [base[(a := rng.randint(0, 30)) : a + rng.randint(1, 20)] for _ in range(6)]
        n = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [i + length <= len(s) and n[s[i : i + length]] > 1 for s in strings for i in range(len(s))]
        assert suffix_dedup.repeats(strings, length).tolist() == want
        times = [rng.choice([1, 1, 2, 5]) for _ in strings]
        n = Counter(s[i : i + length] for s, k in zip(strings, times, strict=True) for i in range(len(s) - length + 1) for _ in range(k))
        want = [i + length <= len(s) and n[s[i : i + length]] > 1 for s in strings for i in range(len(s))]
        assert suffix_dedup.repeats(strings, length, np.array(times)).tolist() == want


def test_long_texts_in_pieces_give_the_same(monkeypatch):
    import pyarrow as pa

    from lumenframe.llm import batches

    rng = random.Random(9)
    text = " ".join(rng.choice(["Ab", "b", "cdé", "e" * 40]) for _ in range(4000))
    whole = ngram_join.shingle_sets(pa.array([text]), 3)
    data, offsets = batches.text_buffer(pa.array([text]))
    first = suffix_dedup.runs_of_chunk(data, offsets, 60)
    monkeypatch.setattr(batches, "PIECE_BYTES", 1000)
    cut = ngram_join.shingle_sets(pa.array([text]), 3)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])
    second = suffix_dedup.runs_of_chunk(data, offsets, 60)
    spread = lambda r: sorted((int(lo) + k, int(fp), int(left) - k) for fp, _, _, lo, span, left in zip(*r, strict=True) for k in range(int(span) + 1))
    assert spread(first) == spread(second)


@pytest.mark.parametrize("alphabet", [b"a", b"ab", bytes(range(256))])
def test_suffixes_are_sorted_by_a_few_ranks_at_a_time(alphabet, monkeypatch):
    draw = np.random.default_rng(len(alphabet))
    strings = [bytes(draw.choice(list(alphabet), size)) for size in (90, 1, 70, 33)]
    strings += [strings[0][5:80], strings[2]]
    sorts = []
    monkeypatch.setattr(np, "argsort", lambda *a, f=np.argsort, **b: sorts.append(1) or f(*a, **b))
    monkeypatch.setattr(np, "lexsort", lambda *a, f=np.lexsort, **b: sorts.append(2) or f(*a, **b))
    data, order, left, of = suffix_dedup.suffix_array(strings, 60)
    assert sum(sorts) <= 3
    text = b"".join(strings)
    ends = [(text[i : i + left[i]][:60], left[i] >= 60, of[i]) for i in order]
    # A string's end is below all bytes, and ends are in the order of their strings.
    assert [e[0] for e in ends] == sorted(e[0] for e in ends)
    assert all(a[2] < b[2] for a, b in zip(ends, ends[1:], strict=False) if a[0] == b[0] and not a[1] and not b[1])
