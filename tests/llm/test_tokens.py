"""BPE and token counts against the tokenizers library."""

import hashlib

import pytest

from lumenframe.llm import bpe, token_counts
from lumenframe.llm.queries import WORD_BPE, tokenizer

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer(WORD_BPE)
TEXTS = ["", "Hello, World!", "it's don't we'LL 're x'", "É étude ÀÉ ﬁ ǅ İı Σας", "<|endoftext|>a<|startoftext|>", "<|endoftext", "x" * 3000, "a\x1cb!\x1f! \x85c", "½²3४ 12", "日本語 текст", "  \n\t ", "🙂🙂!!??", "a\u0558b \ua7cb\ua7dc \U000323b0x"]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def length(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", TEXTS)
def test_ids_and_decoding(library, text):
    vocab = bpe.vocabulary(PATH)
    ids = list(bpe.Encoder(vocab).encode(text))
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert bpe.decode_ids(ids, vocab) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_counts_of_all_prefixes(library, text):
    counter = token_counts.PrefixCounter(bpe.vocabulary(PATH))
    assert counter.total(text) == length(library, text)
    plain = bpe.normalise(text)[:60]
    for piece in (m[0] for m in bpe.pieces_of(plain)):
        assert counter.prefixes(piece) == [length(library, piece[:k]) for k in range(1, len(piece) + 1)]


@pytest.mark.parametrize("budget", [0, 1, 2, 5, 9])
def test_truncation_is_the_longest_prefix(library, budget):
    counter = token_counts.PrefixCounter(bpe.vocabulary(PATH))
    for text in ("it's thereabouts, ''s 'rex étude 'r", "incomprehensibilities of words", "a"):
        got = counter.longest_prefix(text, budget)
        assert len(got) == max(k for k in range(len(text) + 1) if length(library, text[:k]) <= budget)


def test_frames_keep_rows_and_other_columns(spark, library):
    rows = [(1, None, "a"), (1, None, "a"), (None, "Hi there", "b"), (3, "", None), (4, "long " * 40_000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Token_IDs string")
    out = bpe.encode(df, PATH, decoded="decoded")
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    got = out.collect()
    assert len(got) == 5
    for r in got:
        assert r["token_ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
    again = {r["decoded2"] for r in bpe.decode(out, PATH, decoded="decoded2").collect()}
    assert again == {r["decoded"] for r in got}
    n = token_counts.count_tokens(df, PATH, prefixes="p").collect()
    assert sorted(r["n_tokens"] for r in n) == sorted(len(r["token_ids"]) for r in got)
    for r in n:
        words = (r["text"] or "").split()
        assert len(r["p"]) == len(words) and (r["p"][-1] if words else 0) == r["n_tokens"]
        assert all(r["p"][k] == length(library, " ".join(words[: k + 1])) for k in range(min(3, len(words))))
    cut = token_counts.truncate(df, PATH, 3).collect()
    assert {r["truncated"] for r in cut if not r["text"]} == {""}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(df, PATH).count() == 0
    assert token_counts.count_tokens(df, PATH).count() == 0


def test_query_digests(spark, library, tmp_path):
    from lumenframe.llm.queries import op2_bpe, op8_token_counts

    spark.createDataFrame([(1, "Hi, there"), (2, None), (3, "word " * 3000)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op2_bpe(spark, str(tmp_path)).collect():
        text = {1: "Hi, there", 2: "", 3: "word " * 3000}[r["doc_id"]]
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    got = {r["doc_id"]: (r["n_bytes"], r["over_limit"]) for r in op8_token_counts(spark, str(tmp_path)).collect()}
    assert got == {1: (9, False), 2: (0, False), 3: (15000, True)}


def test_marks_that_are_younger_than_the_library(library):
    import unicodedata

    vocab = bpe.vocabulary(PATH)
    marks = [chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))]
    plain = library.normalizer.normalize_str
    for m in marks:
        for s in (f"a{m}\u0345", f"a\u0345{m}", f"a{m}\u0316", f"a\u0316{m}", f"e{m}\u0301{m}"):
            assert bpe.normalise(s) == plain(s)
    for m in marks[::17]:
        for s in (f"a{m}\u0345b", f"a\u0316{m}"):
            assert list(bpe.Encoder(vocab).encode(s)) == library.encode(s, add_special_tokens=False).ids
    assert bpe.normalise("\U00011935\U00011930") == plain("\U00011935\U00011930")


def test_words_within_a_budget(spark, library):
    from pyspark.sql import functions as F

    rows = [(1, "One two  three <|endoftext|>four incomprehensibilities"), (2, None), (3, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = token_counts.prefix_table(df, PATH)
    for budget in (0, 1, 3, 5, 50):
        got = {r["doc_id"]: r["w"] for r in table.select("doc_id", token_counts.words_within(F.col("prefix_tokens"), budget).alias("w")).collect()}
        words = ["one", "two", "three", "<|endoftext|>", "four", "incomprehensibilities"]
        assert got == {1: max(k for k in range(7) if length(library, " ".join(words[:k])) <= budget), 2: 0, 3: 0}


def test_counts_from_the_end_are_those_of_all_prefixes(library):
    import random

    counter = token_counts.PrefixCounter(bpe.vocabulary(PATH))
    draw = random.Random(5)
    pieces = ["".join(draw.choices("etaoinshrdluß", k=n)) for n in [*range(1, 40), token_counts.DEEP, token_counts.DEEP + 1, 400]]
    for piece in [*pieces, "a", "internationalisation", "été", "東京都"]:
        symbols = "".join([counter.vocab.byte_symbol[b] for b in piece.encode("utf-8")])
        assert counter.total_of(symbols) == counter.ending(symbols, len(symbols), *counter.last_tokens(symbols[:-1]))


def test_letters_alone_are_one_piece_and_tasks_share_a_counter():
    letters = [chr(c) * 2 for c in range(0x110000) if chr(c).isalpha()]
    assert all([m[0] for m in bpe.pieces_of(w)] == [w] for w in letters)
    assert token_counts.counter_of(PATH) is token_counts.counter_of(PATH)
