import pytest
from pyspark.sql import functions as F

from outcomelens.llm import encoding

TEXTS = [None, "", " ", "\n\n  \t", "Hello world", "hello  world ", "It's we'll 'tis I'VE", "<|endoftext|> is text", "naïve café – “quotes” …", "日本語 テキスト １２３", "😀👩‍👩‍👧 emoji‍", "a b　c d",
         "x" * 50_000, "word " * 20_000, "1234567890" * 500, "tab\tand\rreturn\r\n", "\x00control\x1f\x85", "é é", "﻿bom", "¹²³½ Ⅷ", " lead", "trail ", "!!!???...", "  a  b   c    "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, "Hello world")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("pos", F.lit(2))


def expected():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{encoding.FOLDER}/byte_bpe_50k.json")
    tokenizer.encode_special_tokens = True
    return {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}


def test_ids_match_the_public_tokenizer(docs):
    rows = encoding.encode(docs).collect()
    assert len(rows) == len(TEXTS)
    assert {r.doc_id: list(r.ids) for r in rows} == expected()


def test_rare_words_take_the_shuffled_join(docs, monkeypatch):
    monkeypatch.setattr(encoding, "HOT", 3)
    assert {r.doc_id: list(r.ids) for r in encoding.encode(docs).collect()} == expected()


def test_round_trip(docs):
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(docs)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_every_distinct_word_is_encoded_once(docs):
    words = encoding.word_table(docs).collect()
    assert len({r.word for r in words}) == len(words) and sum(r.n for r in words) == encoding.pieces(docs).count()


def test_empty_table(docs):
    assert encoding.encode(docs.limit(0)).count() == 0


def test_words_without_limit_of_ids(spark, monkeypatch):
    """A word of more than 2 ** 20 tokens, and texts whose every word is too long to be looked up at once."""
    long = "".join(chr(0x4E00 + k * 7 % 20000) for k in range(400_000))
    rows = [(1, "see " + long + " end"), (2, "q" * 60), (3, "of " + "z" * 40 + " of " + "y" * 50 + "!")]
    found = {r.doc_id: list(r.ids) for r in encoding.encode(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{encoding.FOLDER}/byte_bpe_50k.json")
    assert len(found[1]) > 1 << 20
    assert found == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in rows}


def test_texts_of_one_document(spark):
    rows = [(1, "one text"), (1, "other text"), (1, "one text"), (2, None), (2, None)]
    found = encoding.encode(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 2]
