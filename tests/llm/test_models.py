"""Language identification, quality, decontamination, urls, archives and neighbours."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_brute import edits

from lumenframe.llm import ann, decontam, langid, quality, urls, warc
from lumenframe.llm.queries import PIECES, URL_RULES, tokenizer

VOCABULARY = tokenizer(PIECES)


# Language

def brute_likelihood(word, p, unknown):
    s, n = langid.START + word, len(word) + 1
    a = [1.0] + [0.0] * n
    for j in range(1, n + 1):
        for i in range(j):
            q = p.get(s[i:j], unknown if i == j - 1 else 0.0)
            a[j] += a[i] * q
    return math.log(a[n])


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(0)
    vocabulary = ["▁", "a", "b", "é", "ab", "▁a", "▁ab", "bé", "abab"]
    p = rng.random((2, len(vocabulary) + 1)) / 10
    scorer = langid.Model(["x", "y"], vocabulary, p).scorer()
    for word in ("ab", "abab", "bé", "éé", "zz", "ababbézab"):
        want = [brute_likelihood(word, dict(zip(vocabulary, q, strict=False)), langid.UNKNOWN) for q in p]
        assert scorer.score([word])[0] == pytest.approx(want)
        assert scorer.long_word(word) == pytest.approx(want)


def test_languages_are_told_apart(spark):
    rng = random.Random(1)
    words = {"de": ["der", "und", "nicht", "heit", "ung"], "fr": ["le", "les", "été", "tion", "eaux"]}
    rows = [(i, " ".join(rng.choice(words[y]) for _ in range(30)), y) for i, y in enumerate(["de", "fr"] * 30)]
    df = spark.createDataFrame([*rows, (100, "der", None), (101, None, "de"), (102, "123", "fr")], "doc_id long, text string, lang string")
    model = langid.fit(df, VOCABULARY)
    assert model.languages == ["de", "fr"]
    test = spark.createDataFrame([(1, "Und nicht DER"), (2, "les eaux"), (3, None), (4, ""), (5, "12 !?"), (6, "der " * 50_000), (6, "der " * 50_000)], "doc_id long, text string").withColumn("Score", F.lit("x"))
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(test, model).collect())
    assert got == [(1, "de"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de")]
    nothing = langid.fit(df.limit(0), VOCABULARY)
    assert {r["lang_pred"] for r in langid.identify(test, nothing).collect()} == {"und"}
    assert langid.identify(test.limit(0), model).count() == 0


# Quality

def test_quality_learns_from_bags(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda n: " ".join(word() for _ in range(n)) + "."
    bad = lambda n: " ".join(word().upper() + "!!" for _ in range(n))
    rows = [(i, good(rng.randint(20, 400)) + (bad(100) if i % 4 == 0 else ""), int(i % 4 != 0)) for i in range(600)]
    df = spark.createDataFrame([*rows, (900, None, 1), (901, "", None)], "doc_id long, text string, quality int")
    model = quality.fit(df.filter("doc_id % 3 > 0"), df)
    got = quality.score(df, model).filter("doc_id % 3 = 0 and doc_id < 600").collect()
    assert np.mean([(r["score"] >= 0.3) == bool(r["quality"]) for r in got]) > 0.9
    odd = quality.score(df.filter("doc_id >= 900"), model).collect()
    assert len(odd) == 2 and all(0 <= r["score"] <= 1 for r in odd)
    assert quality.score(df.limit(0), quality.fit(df.limit(0), df)).count() == 0


def test_gradients_of_attention_by_differences():
    rng = np.random.default_rng(0)
    x, per, y = rng.random((9, 5)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])
    shape = {"W": (5, 4), "b": (4,), "V": (4, 3), "U": (4, 3), "w": (3,), "c": (4,), "d": (1,)}
    model = quality.Model({k: rng.normal(size=s) for k, s in shape.items()})

    def loss():
        p, state = model.forward(x, per)
        assert np.allclose(np.add.reduceat(state["a"], state["first"]), 1)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = quality.gradients(model, x, per, y)
    for k in shape:
        for at in np.ndindex(shape[k]):
            old = model.w[k][at]
            model.w[k][at] = old + 1e-6
            up = loss()
            model.w[k][at] = old - 1e-6
            down = loss()
            model.w[k][at] = old
            assert found[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_passages_of_empty_and_long_texts():
    x, per = quality.encode_passages(pa.array(["", None, "ab " * 700, "x"]))
    assert per.tolist() == [1, 1, 5, 1] and x.shape == (8, quality.FEATURES) and np.isfinite(x).all()


# Decontamination

def test_planted_items_are_found(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8))) for _ in range(n))
    items = [(i, prose(rng.randint(8, 60))) for i in range(12)]
    docs, want = [], set()
    for i in range(40):
        text = prose(rng.randint(0, 300))
        if i % 2:
            k = rng.randrange(12)
            leak = list(items[k][1])
            if i % 4 == 1:
                for _ in range(2):
                    leak[rng.randrange(len(leak))] = "#"
            text += " " + "".join(leak).upper().replace(" ", "\n ") + " " + prose(20)
            want.add((i, k))
        docs.append((i, text))
    docs += [(50, None), (51, ""), (52, items[0][1]), (52, items[0][1]), (53, prose(60_000) + items[1][1])]
    want |= {(52, 0), (53, 1)}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    marks = spark.createDataFrame([*items, (90, None), (91, ""), (None, "x" * 50)], "item_id long, text string")
    got = decontam.matches(df, marks).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    kept = {r["doc_id"] for r in decontam.remove(df, marks).collect()}
    assert kept == {i for i, _ in docs} - {d for d, _ in want}
    assert decontam.matches(df.limit(0), marks).count() == 0
    assert decontam.matches(df, marks.limit(0)).count() == 0


def test_short_items_are_found(spark):
    items = [(1, "Yes"), (2, "17 + 25"), (3, "été"), (4, "北京是中国的首都"), (5, "What is the  capital?"), (6, "a"), (7, " \n"), (8, "42."), (9, "C3PO, really")]
    docs = [(10, "he said yes."), (11, "yesterday, eyes"), (12, "is 17+25 more"), (13, "117 + 25"), (14, "cet ÉTÉ, l'été\nici"), (15, "les étés"), (16, "我知道北京是中国的首都。对"), (17, "so what is\nthe capital?42"), (18, "what is thee capital?"), (19, "17 + 2 5"), (20, "it's 42."), (21, "c3po,really"), (22, "xC3PO, really")]
    want = {(10, 1), (12, 2), (14, 3), (16, 4), (17, 5), (18, 5), (19, 2), (20, 8), (21, 9)}
    long = "z " * (decontam.PIECE - 3) + "yes " + "z " * 50
    df = spark.createDataFrame([*docs, (30, long), (31, None), (32, "")], "doc_id long, text string")
    marks = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(df, marks).collect()} == want | {(30, 1)}
    assert {r["doc_id"] for r in decontam.remove(df, marks).collect()} == {11, 13, 15, 22, 31, 32}


def test_items_of_every_length_against_full_alignment():
    rng = random.Random(6)
    prose = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n)).decode()
    for size in [*range(1, 45), 60, 79, 80]:
        most = int(size * decontam.BUDGET)
        own = prose(size)
        items = decontam.Items.of([3], [own])
        texts, want = [], []
        for _ in range(25):
            leak = list(own)
            for _ in range(rng.randint(0, most + 1)):
                k = rng.randrange(len(leak))
                leak[k : k + 1] = rng.choice([[], ["x"], ["x", leak[k]]])
            if not leak:
                continue
            text = prose(30) + " " + "".join(leak) + " " + prose(30)
            texts.append(text)
            if most:
                want.append(edits(own, text.replace(" ", "")) <= most)
            else:
                want.append(f" {own} " in f" {text} ")
        raw = decontam.text_buffer(pa.array(texts))
        got = {t for t, *_ in decontam.find(*decontam.squeeze(*raw), items, items.edges(*raw))}
        assert got == {t for t, w in enumerate(want) if w}, size


def test_repetitive_texts_are_taken_apart(monkeypatch):
    monkeypatch.setattr(decontam, "HITS", 500)
    monkeypatch.setattr(decontam, "OVERLAP", 256)
    rng = random.Random(5)
    prose = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    texts = ["a" * 900, prose(700) + "ab" * 200, "", prose(300), "a" * 60 + prose(90)]
    own = ["ab" * 300, prose(200), "a" * 85, "a" * 500 + prose(80), texts[3][100:250], texts[1][600:720], "b"]
    items = decontam.Items.of(list(range(7)), own)
    raw = decontam.text_buffer(pa.array(texts))
    got = {(t, i) for t, i, *_ in decontam.find(*decontam.squeeze(*raw), items, items.edges(*raw))}
    want = set()
    for i, o in enumerate(own):
        w = min(decontam.WINDOW, len(o))
        for t, x in enumerate(texts):
            if any(edits(o[s : s + w], x) <= int(w * decontam.BUDGET) for s in range(0, len(o) - w + 1)) and w > 1:
                want.add((t, i))
    assert got == want


def test_band_alignment_equals_full_alignment():
    rng = random.Random(4)
    for _ in range(200):
        a = bytes(rng.choice(b"ab") for _ in range(rng.randint(5, 25)))
        most, shift = 3, rng.randint(0, 6)
        b = bytearray(bytes(rng.choice(b"ab") for _ in range(shift)) + a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([b"", b"c", b"cc"])
        b = bytes(b)[: len(a) + 3 * most]
        got = decontam.band_edits(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), most)
        assert got >= min(edits(a, b), most + 1)
        if shift <= 2 * most - 3:
            assert got <= most or edits(a, b) > most or shift > most


# Urls

def test_hosts_paths_and_rules(spark):
    rows = [
        (1, "https://A.Example.COM/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"), (2, "http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
        (3, "http://example.net/de/8/9", "example.net", "/de/8/9", "example.net/de/8", "block"), (4, "http://q.net/de/1#z", "q.net", "/de/1", "net/de/", "allow"),
        (5, None, "", "", None, "allow"), (6, "no scheme", "", "", None, "allow"), (7, "s://h?x://y/z", "h", "", None, "allow"), (8, "a://org/es/", "org", "/es/", "org/es/", "block"),
        (9, "http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"), (10, "://", "", "", None, "allow"), (2, "http://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
    ]
    df = spark.createDataFrame([(r[0], r[1], None, "mine") for r in rows], "page_id long, url string, bad int, Verdict string")
    got = sorted(((r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df, URL_RULES).collect()), key=str)
    assert got == sorted(rows, key=str)
    assert urls.judge(df.limit(0), URL_RULES).count() == 0


def test_bad_templates_are_rejected(spark):
    rows = [(i, f"http://h.org/shop/{i}", 1 if i % 8 else None) for i in range(80)] + [(100 + i, f"http://h.org/wiki/page{i}", 0) for i in range(80)]
    rows += [(300 + i, f"http://h.org/x{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}/z", 0) for i in range(100)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r["page_id"]: (r["template"], r["verdict"]) for r in urls.judge(df, {}).collect()}
    assert {v for i, v in got.items() if i < 80} == {("/shop/*", "block")}
    assert {v for i, v in got.items() if i >= 300} == {("/*/z", "allow")}
    assert {v[1] for i, v in got.items() if 100 <= i < 300} == {"allow"}


def test_similar_branches_merge():
    assert urls.merge_branches([("a", 90, 100), ("b", 88, 100), ("c", 2, 100)]) == {"a": "a|b", "b": "a|b", "c": "c"}
    assert urls.merge_branches([]) == {}


# Archives

def test_archives_round_trip(spark, tmp_path):
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b\r\nX: y", "<p>x</p>"), (2, None, None), (5, "u", ""), (4, "v", "é" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("mine")).repartition(2)
    assert warc.write_files(df, str(tmp_path / "w")).count() >= 1
    got = {r["page_id"]: r for r in warc.read_files(spark, str(tmp_path / "w"), "block").collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert bytes(r["block"]) == (b"" if r["refers_to"] is not None else raw)
    assert {i: r["refers_to"] for i, r in got.items()} == {1: None, 2: None, 3: 1, 4: None, 5: 2}
    assert {i for i, r in got.items() if r["record_type"] == "revisit"} == {3, 5}
    assert warc.read(warc.write(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x"), (2, "y"), (None, "x"), (None, None)], "page_id long, html string").withColumn("url", F.lit("u"))
    got = sorted(((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in warc.read(warc.write(odd)).collect()), key=str)
    assert got == sorted([(1, 1, None), (2, 1, 1), (2, 1, 1), (2, 1, None), (None, 1, None), (None, 0, None)], key=str)


@pytest.mark.parametrize("spoil", ["digest", "length", "cut", "tail"])
def test_bad_archives_are_refused(spoil):
    whole = warc.page_record(1, "u", b"hello", None) + warc.page_record(2, "v", b"world", None)
    assert [b for _, b in warc.read_stream(warc.slices(whole, 7))] == [b"hello", b"world"]
    inner = zlib.decompress(warc.page_record(1, "u", b"hello", None), 31)
    if spoil == "digest":
        bad = inner.replace(b"hello", b"hellp")
    elif spoil == "length":
        bad = inner.replace(b"Content-Length: 5", b"Content-Length: 4")
    elif spoil == "tail":
        bad = inner[:-2]
    else:
        with pytest.raises(warc.BadRecord):
            list(warc.read_stream(warc.slices(whole[:-9], 7)))
        return
    with pytest.raises(warc.BadRecord):
        warc.parse(bad)


# Neighbours

def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "FEW_ROWS", 150)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 16))
    x = (centres[rng.integers(8, size=600)] + 0.5 * rng.normal(size=(600, 16))).astype(np.float32)
    x[7] = x[3]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)] + [(900, None, "b"), (920, [0.0] * 16, "c"), (940, [float("nan")] + [1.0] * 15, "d"), (960, [None] + [1.0] * 15, "e"), (980, [1.0] * 3, "f"), (None, [1.0] * 16, "g")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string")
    got = ann.search(df, df.filter("vec_id % 20 = 0"), 10).collect()
    assert len(got) == 30 * 10 and {r["query_id"] for r in got} == set(range(0, 600, 20))
    d = x.astype(float)
    hits = 0
    for q in range(0, 600, 20):
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:10].tolist()
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(r["score"] == pytest.approx(float(d[r["vec_id"]] @ d[q])) for r in mine)
        assert [(-r["score"], r["vec_id"]) for r in mine] == sorted((-r["score"], r["vec_id"]) for r in mine)
        hits += len(set(best) & {r["vec_id"] for r in mine})
    assert hits / 300 >= 0.9


def brute_neighbours(rows, query, top):
    """The contract's list for one (id, vector), from distinct (id, vector) of its length."""
    score = lambda v: sum(float(a) * float(b) for a, b in zip(v, query[1], strict=True))
    others = [(i, v) for i, v in {(i, tuple(v)) for i, v in rows} if len(v) == len(query[1]) and (i, v) != (query[0], tuple(query[1]))]
    return sorted(((score(v), i) for i, v in others), key=lambda s: (-s[0], s[1]))[:top]


def test_repeated_rows_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(size=6 if i % 3 else 4).tolist()) for i in range(60)]
    rows = vectors * 3 + [(20, rng.normal(size=6).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = ann.search(df, df.filter("vec_id % 20 = 0"), 15).collect()
    by = {}
    for r in got:
        by.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    want = {}
    for q in {(i, tuple(v)) for i, v in rows if i % 20 == 0}:
        want.setdefault(q[0], []).extend(brute_neighbours(rows, q, 15))
    assert {i: [n for _, n in sorted(x)] for i, x in by.items()} == {i: [n for _, n in sorted(x)] for i, x in want.items()}
    assert all(sorted(r["rank"] for r in got if r["query_id"] == i) == sorted([*range(1, 16)] * (len(x) // 15)) for i, x in want.items())


def test_equal_vectors_and_large_ones(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=8)
    rows = [(i, same.tolist()) for i in rng.permutation(1000).tolist()] + [(1000 + i, rng.normal(size=8).tolist()) for i in range(500)]
    big = rng.normal(size=8)
    rows += [(2000, (1e25 * big).tolist()), (2001, (1e200 * big).tolist()), (2002, (-1e200 * big).tolist()), (2003, [1e-200] * 8), (2004, (1e308 * np.sign(big)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [0, 77, 1001, 1002, 2000, 2001, 2003]
    got = ann.search(df, df.filter(F.col("vec_id").isin(asked)), 20).collect()
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    for q in asked:
        s = np.zeros(len(ids))
        with np.errstate(over="ignore"):
            for k, a in enumerate(x[ids == q][0].tolist()):
                s += x[:, k] * a
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(int(ids[k]), s[k]) for k in best], q


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = ann.search(df, df.filter("vec_id = 1"), 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 2]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_among_many_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1800, 16)).astype(np.float32)
    x[200:900] = x[200]  # copies
    x[900:1500] = x[900] + 1e-4 * rng.normal(size=(600, 16)).astype(np.float32)  # near copies
    ids = rng.permutation(1800)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    asked = [int(ids[k]) for k in (0, 1, 250, 600, 899, 950, 1200, 1499)]
    got = ann.search(df, df.filter(F.col("vec_id").isin(asked)), 20).collect()
    for q in asked:
        own = x[np.flatnonzero(ids == q)[0]].astype(float)
        s = sum(x[:, k].astype(float) * own[k] for k in range(16))
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(int(ids[k]), s[k]) for k in best]
