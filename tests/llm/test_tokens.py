import base64
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chorale.llm import queries, tokens

if not Path(tokens.VOCABULARY).exists():
    pytest.skip("no vocabulary files", allow_module_level=True)

DATA = "/root/testdata/sf0.001"
TEXTS = [None, "", " ", "a", "Hello, world's best!", "naïve café — 東京 🎤", "\r\n\n  \t x", "aaaaaaaaaaaaaaaaaaaaaaa", "=-" * 500, "<|endoftext|>", "hahaha" * 400, "e" * 20_000, "x y " * 5000, "12345678901234567890"]


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def vocabulary(request):
    return f"{tokens.VOCABULARIES}/{request.param}"


def encoding(path):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_tokenizer(spark, vocabulary):
    rnd = random.Random(1)
    texts = TEXTS + ["".join(rnd.choice("abné \n'st1,.") for _ in range(rnd.randint(1, 80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    count = tokens.token_counter(spark, vocabulary)
    enc = encoding(vocabulary)
    for i, n in df.select("i", count(F.col("text"))).collect():
        assert n == len(enc.encode_ordinary(texts[i] or "")), texts[i]


def test_symbols_equal_the_tokenizer(vocabulary):
    rnd = random.Random(2)
    pieces = ["".join(rnd.choice("abcesting ") for _ in range(rnd.randint(1, 40))) for _ in range(2000)]
    sym, n = tokens.merges(vocabulary).encode([p.encode() for p in pieces])
    core = encoding(vocabulary)._core_bpe
    at = 0
    for p, k in zip(pieces, n):
        assert sym[at : at + k].tolist() == core.encode_single_piece(p.encode())
        at += k


def test_memo_overflow_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    table, memo = tokens.merges(tokens.VOCABULARY), {}
    first = tokens.count_pieces(table, ["the", " cat"], memo).tolist()
    tokens.count_pieces(table, ["sat", " down", "now"], memo)
    assert tokens.count_pieces(table, ["the", " cat"], memo).tolist() == first


def test_budget_totals_add_up(spark):
    b = queries.p1_token_budget(spark, DATA).toPandas()
    results = spark.read.parquet(f"{DATA}/transcription_results.parquet").select("result_id").distinct().count()
    fine = b[b.level == "whisper_implementation+language+audio_type"]
    for level in ("whisper_implementation", "language", "audio_type", ""):
        assert b[b.level == level].tokens.sum() == fine.tokens.sum() and b[b.level == level].texts.sum() == results


def test_empty_table(spark):
    df = spark.createDataFrame([], "text string")
    assert df.select(tokens.token_counter(spark)(F.col("text"))).collect() == []
