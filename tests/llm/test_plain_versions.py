"""Queries that SQL can't express, against plain versions on small fixtures."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_brute import edits

from lumenframe.llm import ann, decontam, langid, quality, suffix_dedup, urls, warc
from lumenframe.llm.queries import PIECES, URL_RULES, op1_url_filter, tokenizer


# Urls

def plain_host_and_path(url):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3 :]
    cut = min([k for k in map(rest.find, "/?#") if k >= 0], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return host, tail[: min([k for k in map(tail.find, "?#") if k >= 0], default=len(tail))]


def plain_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits, key=lambda r: (len(r), r), default=None)


def plain_templates(rows):
    """{(host, segments): template} for rows (host, segments, bad), by recursion."""
    out = {}

    def grow(host, tmpl, shapes):  # shapes: {rest: [(segments, n, bad, labelled)]}
        lo, hi = min(shapes), max(shapes)
        k = 0
        while k < min(len(lo), len(hi)) and lo[k] == hi[k]:
            k += 1
        tmpl, shapes = tmpl + lo[:k], {r[k:]: s for r, s in shapes.items()}
        if len(shapes) == 1:
            for s in shapes.values():
                out[host, s[0]] = tmpl
            return
        kids = {}
        for r, (_, n, b, m) in shapes.items():
            kid = kids.setdefault(r[0] if r else "", [0, 0, 0])
            kid[0], kid[1], kid[2] = kid[0] + n, kid[1] + b, kid[2] + m
        every, fan, single = sum(k[0] for k in kids.values()), len(kids), sum(k[0] == 1 and s != "" for s, k in kids.items())
        rare = {s for s, k in kids.items() if s and fan > urls.FEW and (fan > urls.FAN and k[0] < urls.MIN_SHARE * every or k[0] == 1 and 2 * single >= every)}
        named = urls.merge_branches([(s, k[1], k[2]) for s, k in kids.items() if s and s not in rare])
        groups = {}
        for r, s in shapes.items():
            seg = r[0] if r else ""
            if seg == "":
                out[host, s[0]] = (*tmpl, "")
            else:
                groups.setdefault("*" if seg in rare else named.get(seg, seg), {}).setdefault(r[1:], []).append(s)
        for name, below in groups.items():
            # Shapes that fall together go on together.
            flat = {}
            for rest, parts in below.items():
                flat[rest] = (parts[0][0], sum(p[1] for p in parts), sum(p[2] for p in parts), sum(p[3] for p in parts))
            twins = [(p[0], parts[0][0]) for parts in below.values() for p in parts[1:]]
            grow(host, (*tmpl, name), flat)
            for twin, first in twins:
                out[host, twin] = out[host, first]

    by = {}
    for host, segs, bad in rows:
        shape = by.setdefault(host, {}).setdefault(segs, [segs, 0, 0, 0])
        shape[1], shape[2], shape[3] = shape[1] + 1, shape[2] + (bad or 0), shape[3] + (bad is not None)
    for host, shapes in by.items():
        grow(host, (), {s: tuple(v) for s, v in shapes.items()})
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_url_verdicts_equal_plain_ones(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        host = rng.choice(["a.org", "b.net"])
        depth = rng.choice([0, 1, 2, 3, 3, 7])
        path = ["deep", "er"] if depth == 7 else []
        for d in range(depth):
            path.append(rng.choice(["x", "y", "z"][: d + 1]) if rng.random() < 0.6 else rng.choice([f"n{rng.randrange(400)}", f"p{rng.randrange(12)}", "*", "a|b"]))
        bad = None if rng.random() < 0.4 else int(rng.random() < (0.85 if "y" in path or "p3" in path else 0.1))
        rows.append((i, f"http://{host}/" + "/".join(path) + rng.choice(["", "/", "?q"]), bad))
    df = spark.createDataFrame([(i, u, b, "mine") for i, u, b in rows], "page_id long, url string, bad int, rest string").repartition(3)
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in urls.judge(df, {}).collect()}
    cut = lambda u: tuple(s.replace("*", "%2A").replace("|", "%7C") for s in plain_host_and_path(u)[1].split("/") if s)
    shapes = [(plain_host_and_path(u)[0], cut(u), b) for _, u, b in rows]
    tmpl = plain_templates(shapes)
    sums = {}
    for host, segs, b in shapes:
        t = sums.setdefault((host, tmpl[host, segs]), [0, 0])
        t[0], t[1] = t[0] + (b or 0), t[1] + (b is not None)
    prior = sum(b or 0 for _, _, b in shapes) / max(1, sum(b is not None for _, _, b in shapes))
    blocked = {t for t, (b, n) in sums.items() if n >= urls.MIN_LABELS and (b + urls.PRIOR_WEIGHT * prior) / (n + urls.PRIOR_WEIGHT) >= urls.REJECT}
    want = {i: ("".join(f"/{s}" for s in tmpl[h, s]), "block" if (h, tmpl[h, s]) in blocked else "allow") for (i, _, _), (h, s, _) in zip(rows, shapes, strict=True)}
    assert got == want
    assert {"block", "allow"} == {v for _, v in want.values()}


def test_deep_trees_tell_their_branches_apart(spark):
    stem = "/".join("abcdefgh")
    rows = [(i, f"http://h.org/{stem}/{'bad' if i % 2 else 'good'}/v{i}", i % 2) for i in range(120)]
    rows += [(500, "http://h.org/" + "long/" * 3000, None)]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), {}).collect()}
    assert got == {i: "block" if i % 2 and i < 120 else "allow" for i in got}


def test_url_query_against_plain_rules(spark, tmp_path):
    rng = random.Random(5)
    pool = ["http://", "HTTPS://", "x", "Example.COM", "example.net", ".", "org", "/", "/en/", "/de/8", "/es/", "?", "#", "7", "://", "é"]
    rows = [(i, None if i == 0 else "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(400)] + [(500 + k, f"a://{h}{p}") for k, (h, p) in enumerate((h, p) for h in ("example.com", "q.example.net", "net", "org", "notorg") for p in ("/en/7", "/de/8", "/es/1", "/en", ""))]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for r in op1_url_filter(spark, str(tmp_path)).collect():
        host, path = plain_host_and_path(dict(rows)[r["page_id"]])
        rule = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, URL_RULES.get(rule, "allow"))


# Decontamination

def test_contaminated_pairs_equal_plain_ones(spark):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    items = [(1, letters(110)), (2, letters(95)), (3, letters(50)), (4, "xyzzy")]
    docs = []
    for i in range(24):
        own = list(rng.choice(items)[1])
        lo = rng.randrange(max(1, len(own) - 80)) if rng.random() < 0.5 else 0
        leak = own[lo : lo + rng.choice([60, 85, 110])]
        for _ in range(rng.randrange(9)):
            if leak:
                k = rng.randrange(len(leak))
                leak[k : k + 1] = rng.choice([["#"], [], [leak[k], "#"]])
        docs.append((i, letters(rng.randrange(40)) + " " + "".join(leak).upper() + " " + letters(rng.randrange(40))))
    squeeze = lambda t: "".join(t.split()).lower().encode()
    want = set()
    for d, t in docs:
        text = squeeze(t)
        for i, own in items:
            s = squeeze(own)
            w = min(80, len(s))
            if w < 14:
                if own in t.lower().split():
                    want.add((d, i))
            elif any(edits(s[k : k + w], text) <= int(w * 0.075) for k in range(len(s) - w + 1)):
                want.add((d, i))
    got = decontam.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["edits"] <= 6 for r in got) and len(got) == len(want)


def test_rows_of_one_key_are_removed_by_text(spark):
    item = "one sentence of a benchmark that nobody would write twice in the very same words, surely"
    rows = [(1, "clean"), (1, f"so: {item}"), (None, item), (None, "clean too"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in decontam.remove(df, marks).collect()} == {(1, "clean"), (None, "clean too"), (2, None)}


def test_items_over_a_megabyte():
    rng = random.Random(3)
    own = "".join(rng.choice("abcdefghijkl") for _ in range(1_200_000))
    items = decontam.Items.of([1], [own])
    text = np.frombuffer(("zz" * 50 + own[1_150_000:1_150_100] + "zz" * 50).encode(), np.uint8)
    got = decontam.find(text, np.array([0, len(text)]), items, None)
    assert [(t, i, e <= 6) for t, i, _, e, _, _ in got] == [(0, 0, True)]


# Quality

def plain_score(text, w):
    raw = (text or "").encode()
    bag = []
    for at in range(0, max(1, len(raw)), quality.PASSAGE):
        part = raw[at : at + quality.PASSAGE]
        pairs = Counter()
        for k in range(at, at + len(part)):
            after = quality.BYTE_CLASS[raw[k + 1]] if k + 1 < len(raw) else 4
            pairs[int(quality.BYTE_CLASS[raw[k]]), int(after)] += 1
        x = [math.sqrt(pairs[a, b] / max(1, len(part))) for a in range(16) for b in range(16)]
        starts = [k for k in range(at, at + len(part)) if raw[k : k + 1].strip(b" \t\n\x0b\x0c\r") and (k == 0 or not raw[k - 1 : k].strip(b" \t\n\x0b\x0c\r"))]
        words, every = [], raw.lower() if raw.isascii() else bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
        for k in starts:
            e = k
            while e < len(raw) and raw[e : e + 1].strip(b" \t\n\x0b\x0c\r"):
                e += 1
            words.append(every[k:e])
        n = max(1, len(words))
        x += [sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, len(set(words)) / n, sum(map(len, words)) / n / 10, len(words) / 100]
        h = np.tanh(np.array(x) @ w["W"] + w["b"])
        bag.append((h, float((np.tanh(h @ w["V"]) * (1 / (1 + np.exp(-h @ w["U"])))) @ w["w"])))
    top = max(e for _, e in bag)
    total = sum(math.exp(e - top) for _, e in bag)
    z = sum(math.exp(e - top) / total * h for h, e in bag)
    return 1 / (1 + math.exp(-float(z @ w["c"] + w["d"][0])))


def test_scores_equal_plain_ones(spark, monkeypatch):
    rng, gen = random.Random(6), np.random.default_rng(6)
    shape = {"W": (quality.FEATURES, 5), "b": (5,), "V": (5, 3), "U": (5, 3), "w": (3,), "c": (5,), "d": (1,)}
    model = quality.Model({k: gen.normal(size=s) for k, s in shape.items()})
    word = lambda: rng.choice(["the", "The", "été", "12,5", "a!", "x" * 30, "(y)", "#1|2"])
    texts = [None, "", " ", "one", *[rng.choice([" ", "\n"]).join(word() for _ in range(rng.randrange(400))) for _ in range(25)], "the " * 3000]
    df = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)] * 2, "doc_id long, text string, Score string")
    got = quality.score(df, model).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        assert r["score"] == pytest.approx(plain_score(texts[r["doc_id"]], model.w), abs=1e-5)


def test_long_texts_are_scored_in_pieces():
    import pyarrow as pa

    text = "Some words, 1 or 2. " * 60_000
    x, per = quality.encode_passages(pa.array([text]))
    assert per.tolist() == [-(-len(text) // quality.PASSAGE)] and x.shape[0] == per[0] and np.isfinite(x).all()


# Language

def test_counts_expected_in_words_equal_plain_ones():
    rng = np.random.default_rng(1)
    vocabulary = ["▁", "a", "b", "ab", "▁a", "ba", "abab"]
    lattice = langid.Lattice(vocabulary)
    p = rng.random((len(vocabulary) + 1, 2)) / 5
    size = np.array([langid.SCALE ** len(s) for s in vocabulary] + [langid.SCALE])[:, None]
    for word in ("ab", "abab", "aébab", "babab"):
        s, counts = langid.START + word, np.array([[2.0, 3.0]])
        want = np.zeros(p.shape)
        paths = [((), 0)]
        done = []
        while paths:
            path, at = paths.pop()
            if at == len(s):
                done.append(path)
                continue
            known = [(k, len(v)) for k, v in enumerate(vocabulary) if s.startswith(v, at)]
            known += [] if any(n == 1 for _, n in known) else [(len(vocabulary), 1)]
            paths += [((*path, k), at + n) for k, n in known]
        weight = np.array([np.prod([p[k] for k in path], axis=0) for path in done])
        for path, w in zip(done, weight / weight.sum(axis=0), strict=True):
            for k in path:
                want[k] += w * counts[0]
        got, other = np.zeros(p.shape), np.zeros(p.shape)
        langid.expected_of_block(lattice.edges([word]), len(s), counts, p * size, got)
        langid.expected_of_word(lattice.edges_of_one(word), counts[0], p * size, other)
        assert np.allclose(got, want) and np.allclose(other, want)


def test_texts_without_a_letter_are_undetermined(spark):
    df = spark.createDataFrame([(1, "der und die", "de"), (2, "le les une", "fr"), (3, "x" * 200, "fr"), (3, "x" * 200, "fr")], "doc_id long, text string, lang string")
    model = langid.fit(df, tokenizer(PIECES))
    odd = spark.createDataFrame([(1, "½ ² ① 12"), (2, "²der"), (3, "\u0301 !"), (4, "𝟙 ٣ Ⅷ")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, model).collect()} == {1: "und", 2: "de", 3: "und", 4: "und"}
    same = spark.createDataFrame([(1, "das ist", "b"), (2, "das ist", "a")], "doc_id long, text string, lang string")
    tied = langid.fit(same, tokenizer(PIECES))
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(same, tied).collect()} == {("a", 0.5)}


# Columns whose names the operators use themselves

def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a" + "é" * 150), (2, "b" + "é" * 150), (None, None)], "doc_id long, text string")
    for name in ("_h", "_k", "_g", "_s", "row", "h", "spans_", "t"):
        df = df.withColumn(name, F.lit(name))
    out = suffix_dedup.remove(df, as_text=True).collect()
    assert sorted((r["kept"], r["_h"], r["row"], r["h"]) for r in out) == [("", "_h", "row", "h"), ("a", "_h", "row", "h"), ("b", "_h", "row", "h")]
    pages = spark.createDataFrame([(1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string").withColumn("_k", F.lit(1)).withColumn("d", F.lit(2)).withColumn("k", F.lit(3))
    assert sorted((r["page_id"], r["refers_to"], r["_k"], r["d"], r["k"]) for r in warc.refer(pages).collect()) == [(1, None, 1, 2, 3), (2, 1, 1, 2, 3)]


def test_recall_of_the_given_vectors(spark):
    import os

    path = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(path):
        pytest.skip("needs the driver's tables")
    df = spark.read.parquet(path)
    rows = df.select("vec_id", "embedding").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = {}
    for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(best & got[int(ids[q])]), total + 20
    assert hits / total >= 0.9
