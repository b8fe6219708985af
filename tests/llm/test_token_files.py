import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carequeue.llm import token_files
from tests.conftest import SMALL

PATH = public_tokenizers.path(token_files.TOKENIZER)
SCHEMA = "doc_id bigint, text string"
ODD = [
    "", " ", "  A  b\n\nC ", "<|startoftext|>x <|endoftext|> y<|endoftext|>", "é ÉTÉ ΣΑΣ ΟΔΟΣ", "can't I'LL 12345", "a\tb\r\nc d e",
    "😀" * 50, "word" * 3000, "\x00 .,;!?", "İstanbul ﬁ", "́ ́x",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, rows):
    found, start = [], 0
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        found.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return found


def test_given_documents(spark, library):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect())
    found = sorted(tuple(r) for r in token_files.op4_token_files(spark, SMALL).collect())
    assert found == expected(library, rows)


def test_odd_texts_equal_the_library_in_any_company(library):
    coder = token_files.WordEncoder(PATH)
    for texts in (ODD, ODD[::-1], [x + y for x in ODD for y in ODD[:4]]):
        assert [own.tolist() for own in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_are_ordered_indexed_and_searched(spark, tmp_path, library):
    rows = [(i, f"text {i % 7}") for i in range(500, 0, -1)] + [(None, None), (None, "x"), (7, "text 0"), (7, "more")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("file", F.lit("f")).withColumn("offset", F.lit(1))
    folder = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, folder)
    found = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, None, *sorted(x for x, _ in rows if x is not None)]
    assert [r.start for r in found] == np.cumsum([0, *(len(r.ids) for r in found[:-1])]).tolist()
    wanted = token_files.find_tokens(spark, folder, [7, 3, 9999])
    assert sorted(r.doc_id for r in wanted.collect()) == [3, 7, 7, 7]
    assert "PushedFilters: [In(doc_id" in wanted._jdf.queryExecution().toString()
    files = sorted(tmp_path.glob("tokens/*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == len(rows)
    token_files.write_tokens(docs.limit(0), f"{tmp_path}/empty")
    assert token_files.read_tokens(spark, f"{tmp_path}/empty").collect() == []


def test_parts_are_learned_by_their_words(library):
    assert token_files._apart("ends.,;") == ("ends", ".,;") and token_files._apart("été!") == ("été", "!")
    for part in ("", "plain", "12", "été", "a_b.", "...", "a.b.", "(x)"):
        assert token_files._apart(part) == (part,)
    coder = token_files.WordEncoder(PATH)
    for texts in (["one two. two", ""], ["two.. one, \n3 (é) été."], [""], ["one"]):
        assert [own.tolist() for own in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert coder.single.keys() >= {"one", "two", ".", "..", ",", "été", "(é)"} and "two." not in coder.single
    assert len(coder.sizes) == len(coder.starts) == len(coder.numbers) and coder.sizes.sum() == len(coder.ids)


def test_words_of_letters_need_only_the_model(library):
    coder = token_files.WordEncoder(PATH)
    sent = []

    class Watched:
        def __getattr__(self, name):
            return getattr(library, name)

        def encode_batch_fast(self, texts, **given):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **given)

    coder.tokenizer = Watched()
    texts = ["Plain, été ÉTÉ! Straße&&& слово.) ΣΑΣ", None, "12 it's 漢字 (x) Straße... ", "<|x été"]
    found = coder.lists(pa.array(["", *texts])[1:], 7)
    assert found.to_pylist() == [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in texts]
    assert sorted(sent) == sorted(["", ",", "!", "&&&", ".)", "...", "12", "it's", "漢字", "(x)"])


def test_marks_that_normalizing_composes_or_leaves(library):
    odd = ["H̱", "T̈x W̊. Y̊ J̌", "Ĥ̱", "क़. क़&", "İ. aİ!", "ŉ.", "á. 각."]
    coder = token_files.WordEncoder(PATH)
    assert [own.tolist() for own in coder.encode(odd)] == [library.encode(t, add_special_tokens=False).ids for t in odd]


def test_remembered_parts_are_bounded(library, monkeypatch):
    for name, most in (("WORDS", 3), ("IDS", 5)):
        coder = token_files.WordEncoder(PATH)
        with monkeypatch.context() as patch:
            patch.setattr(token_files, name, most)
            for texts in (["one two three four"], ["x" * 50, "one"], ["four <|x", "five"], ["five. one"]):
                assert [own.tolist() for own in coder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert "two" not in coder.numbers and len(coder.ids) == coder.sizes.sum()


def test_groups_are_cut_by_size():
    texts = pa.array(["skipped", "éé", None, "ccc", "", "dddd", "e"])[1:]
    assert [part.to_pylist() for part in token_files._groups(texts, 3)] == [["éé"], [None, "ccc", "", "dddd"], ["e"]]
    assert [len(part) for part in token_files._groups(texts, 100)] == [6] and list(token_files._groups(texts[:0], 3)) == []
