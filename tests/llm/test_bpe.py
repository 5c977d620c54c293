import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from covergrid.llm import bpe

ODD = [
    "", " ", "\n", "a", "don't we'll I'VE 's", "x  y", "a\n\n\n  b\r\n c\t", "  x 　 y", "\u0085 a\x1c\x1d b \x0b\x0c", "２３ ½²ⅷ x3", "naïve Ünïcödé éé",
    "🙂🙂👩‍👩‍👧 x", "日本語のテキスト", "a" * 5000, "ab" * 300 + " " + "é" * 400, " " * 700 + "x", "<|endoftext|> <|startoftext|>", "﻿diff --git a/x b/x\n@@ -1,2 +3,4 @@\n-\tx\n+\ty\n", "123456789" * 40, "_" * 300, "​­́x", "Привет, мир",
]


@pytest.fixture(scope="module")
def oracle():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_odd_texts(spark, oracle):
    df = spark.createDataFrame([*enumerate(ODD), (99, None)], "words int, ids string")
    got = {r.words: r.ids for r in bpe.encode(df, "words", "ids").collect()}
    assert got.pop(99) == []
    assert got == {i: oracle(x) for i, x in enumerate(ODD)}


def test_random_texts(spark, oracle):
    rng = random.Random(5)
    alphabet = "abcABC  \n\t.,'’-_09éß日🙂 \r"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(300)]
    got = {r.i: r.ids for r in bpe.encode(spark.createDataFrame([*enumerate(texts)], "i int, t string"), "i", "t").collect()}
    assert got == {i: oracle(x) for i, x in enumerate(texts)}


def test_long_and_short_words_agree():
    ranks = bpe.load_ranks(bpe.default_path())
    rng = random.Random(1)
    for _ in range(300):
        w = "".join(rng.choice("abcdeilnorst") for _ in range(rng.randrange(2, 90))).encode()
        if w not in ranks:
            assert bpe.merge_word(ranks, w) == bpe._merge_long(ranks, w)


def test_table(spark, data, oracle):
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode(df, "doc_id", "text").collect()}
    assert got == {r.doc_id: oracle(r.text or "") for r in df.collect()}


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "i int, t string"), "i", "t").count() == 0
