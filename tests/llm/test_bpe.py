import gc
import hashlib
import weakref

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from carequeue.llm import bpe, shared
from tests.conftest import SMALL

PATH = public_tokenizers.path(bpe.RANKS)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={}
)
ODD = ["", "a", " ", "  x \n\n y", "é😀 naïve", "<|endoftext|>", "x" * 5000, "ab" * 300 + "!" * 700, "\x00　ab'll 12345"]


def sha(data):
    return hashlib.sha256(data).hexdigest()


def expected(text):
    ids = LIBRARY.encode_ordinary(text or "")
    return len(ids), sha(",".join(map(str, ids)).encode()), sha((text or "").encode())


def test_documents_equal_the_library(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in bpe.op3_bpe(spark, SMALL).collect()}
    assert found == {r.doc_id: expected(r.text) for r in rows}


def test_odd_texts(spark):
    rows = [(i, text) for i, text in enumerate(ODD)] + [(None, None), (None, "again"), (None, "again")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("decoded", F.lit(2))
    found = bpe.encode_decode(docs).collect()
    assert sorted((r.doc_id or -1, list(r.ids), bytes(r.decoded)) for r in found) == sorted(
        (i or -1, LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows
    )
    assert bpe.encode_decode(docs.limit(0)).collect() == []


def test_groups_keep_every_text():
    texts = ["a" * 5, None, "b" * 9, "", "c"]
    assert [x for _, part in bpe.groups(texts, 6) for x in part] == [t or "" for t in texts]
    assert [begin for begin, _ in bpe.groups(texts, 6)] == [0, 3]
    assert list(bpe.groups([], 6)) == []


def test_words_are_learned_anew_when_too_many_are_known():
    own = bpe.Codec(PATH)
    texts = ["one two three " + "ab" * 100, "three four", "", "one four \n"]
    expected_ids = [LIBRARY.encode_ordinary(text) for text in texts]
    words, bpe.WORDS = bpe.WORDS, 4
    try:
        for _ in range(3):
            for text, ids in zip(texts, expected_ids):
                found, decoded = own.round_trip([text])
                assert found[0].tolist() == ids and decoded == [text.encode()]
    finally:
        bpe.WORDS = words
    found, decoded = own.round_trip(texts)
    assert [x.tolist() for x in found] == expected_ids and decoded == [text.encode() for text in texts]


def test_a_worker_keeps_the_model_of_one_operator_at_a_time():
    own = bpe.codec(PATH, public_tokenizers.PATTERN)
    assert bpe.codec(PATH, public_tokenizers.PATTERN) is own
    gone = weakref.ref(own)
    del own
    shared.held(dict)
    gc.collect()
    assert gone() is None
    shared.let_go()
    assert not shared._held


def test_the_words_of_texts_are_not_held_beside_their_numbers():
    own = bpe.Codec(PATH)
    texts = ["one two three " * 2000] * 20
    own.round_trip(texts[:1])
    assert "merges" not in vars(own)
    found, decoded = own.round_trip(texts)
    assert [x.tolist() for x in found] == [LIBRARY.encode_ordinary(t) for t in texts] and decoded == [t.encode() for t in texts]
    own.round_trip(["ab" * 300])
    assert "merges" in vars(own)
