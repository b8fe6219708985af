import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from carequeue.llm import token_counts
from tests.conftest import SMALL

PATH = public_tokenizers.path(token_counts.MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "a  b ", "<s> </s><unk>", "▁x ▁", "a\x00b\r\n", "<0x41>", "中文é😀ﬁ", "a" * 3000, " " * 100, "- " * 50 + "=" * 333]


@pytest.fixture(scope="module")
def counter():
    return token_counts.transducer(PATH)


def expected(text):
    return len(LIBRARY.encode(text or ""))


def test_documents_equal_the_library(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op9_token_counts(spark, SMALL).collect()}
    for row in rows:
        n = expected(row.text)
        assert found[row.doc_id] == (len((row.text or "").encode()), n, n > 4096)


@pytest.mark.parametrize("chunk", [1, 3, 7, 65_536])
def test_odd_and_random_texts_in_chunks_of_any_size(counter, chunk):
    draw = random.Random(chunk)
    letters = " ▁\n-=ab cdeéteionrs<>中😀\t#.,!"
    texts = ODD + ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(300)]
    assert [counter.count(text, chunk) for text in texts] == [expected(text) for text in texts]


def test_caches_that_start_afresh_change_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 5)
    monkeypatch.setattr(token_counts, "WORDS", 3)
    fresh = token_counts.Transducer(PATH)
    text = "The quick brown fox jumps over the lazy dog, again and again."
    assert fresh.count(text) == expected(text)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_tokens", F.lit(0))
    found = token_counts.count_tokens(docs).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in found) == sorted((i or -1, expected(t)) for i, t in rows)
    assert token_counts.count_tokens(docs.limit(0)).collect() == []


def test_letters_and_stops_are_counted_apart():
    fresh = token_counts.Transducer(PATH)
    texts = ["sure.\nSure, (sure) sure; été. 1½ ²a ½", "▁▁ a▁.b  ", "", "été"]
    assert [fresh.count(text) for text in texts] == [expected(text) for text in texts]
    assert set(fresh.counted) >= {"▁sure", "Sure", ".\n", ",", "sure", "▁été"}
    assert not any("sure" in unit and unit.strip("▁") != "sure" for unit in fresh.counted)
    for text in ("▁a▁▁b.c▁", "▁²é½▁"):
        assert "".join(fresh.pieces.unit.findall(text)) == text


def test_what_a_piece_holds_beside_a_letter_stays_with_letters():
    unit = token_counts.unit_pattern(["▁a", "b.c", "12"])
    assert unit.findall("▁ab.cd,▁12a▁-,") == ["▁ab.cd", ",", "▁12", "a", "▁-,"]
    assert token_counts.unit_pattern(["b.", ".,", ",]"]).findall("▁ab.,]12") == ["▁ab.,]", "12"]
