import hashlib
import json
import os
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carequeue.llm import alignment
from tests.conftest import SMALL

ODD = [
    None, "", " ", "a", "  two  spaces ", "line\nend \n and\ttab\n", "é😀 naïve", "<|endoftext|> <s>a</s> <unk> <0x41>", "x" * 5000,
    "▁a b", "a ▁b", "nul\x00 here", "a b  c", "ab'll 12345", "\x1c a \x1c", "a ́b é", "あいう えお", "trailing ",
]


def byte_of_letter():
    plain = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    table, extra = {}, 256
    for byte in range(256):
        if byte in plain:
            table[chr(byte)] = byte
        else:
            table[chr(extra)] = byte
            extra += 1
    return table


@pytest.fixture(scope="module")
def plain():
    """Links and groups of whole texts, as the libraries cut them."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = Tokenizer.from_file(path)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_of_letter()
    with open(path) as lines:
        a_bytes = {k: bytes(letters[c] for c in token) for token, k in json.load(lines)["model"]["vocab"].items() if k != 50256}

    def b_bytes(k):
        piece = second.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(k) else piece.replace("▁", " ").encode()

    def cut(text):
        if not text:
            return None
        a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
        spelled = (" " + text).encode()
        if b"".join(a_bytes[k] for k in a) != spelled or b"".join(map(b_bytes, b)) != spelled:
            return None

        def ends(ids, of):
            at, found = 0, {}
            for place, k in enumerate(ids):
                at += len(of(k))
                found[at] = place
            return found

        a_ends, b_ends = ends(a, a_bytes.__getitem__), ends(b, b_bytes)
        both = sorted(a_ends.keys() & b_ends.keys())
        links = [(a[a_ends[at]], b[b_ends[at]]) for at in both]
        groups, i, j = [], 0, 0
        for at in both:
            groups.append(f"{','.join(map(str, a[i : a_ends[at] + 1]))}|{','.join(map(str, b[j : b_ends[at] + 1]))}")
            i, j = a_ends[at] + 1, b_ends[at] + 1
        return len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    return cut


def expected(rows, cut):
    found = [(key, cut(text)) for key, text in rows]
    counts = Counter(link for _, own in found if own for link in own[2])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for key, own in found:
        if own is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, links, sha = own
        best = sum(counts[link] == most[link[1]] for link in links)
        out.append((key, n_a, n_b, len(links), len(links), best, sum(counts[link] for link in links), sha))
    return sorted(out, key=repr)


def test_documents_equal_the_libraries(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, alignment.op12_align(spark, SMALL).collect()), key=repr) == expected(rows, plain)


def test_odd_texts(spark, plain):
    rows = [*enumerate(ODD), (3, "a"), (None, "a b"), (None, "a b"), (None, None), (4, "another under one id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("copies", F.lit("x")).withColumn("digest", F.lit(1))
    assert sorted(map(tuple, alignment.align(docs).collect()), key=repr) == expected(rows, plain)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.align(docs).collect() == []


def test_pair_counts_name_the_ids_and_the_most_frequent(spark, plain):
    rows = [(1, "the cat and the dog"), (2, "the cat"), (3, "the cat"), (4, "unusualness")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    counts = Counter(link for _, text in rows for link in plain(text)[2])
    most = {b: max(n for (_, other), n in counts.items() if other == b) for _, b in counts}
    found = {(r.a_id, r.b_id): (r["count"], r.best) for r in alignment.pair_counts(alignment.aligned_texts(docs)).collect()}
    assert found == {link: (n, n == most[link[1]]) for link, n in counts.items()}


def test_many_words_are_learned_anew(plain):
    own = alignment.Aligner(public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE))
    texts = ["one two  three\nfour", "five six", "one six ▁"]
    first = [x[:3] for x in own.align(texts)]
    alignment_words, alignment.WORDS = alignment.WORDS, 2
    try:
        assert [x[:3] for x in own.align(texts)] == first
    finally:
        alignment.WORDS = alignment_words
    assert first[2] == (0, 0, "")


def test_groups_of_texts():
    texts = ["a" * 5, "", "b" * 9, "", "c"]
    ranges = list(alignment._groups(texts, 6))
    assert [k for begin, end in ranges for k in range(begin, end)] == list(range(5))
    assert list(alignment._groups([], 6)) == []
