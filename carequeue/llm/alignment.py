"""Cross-tokenizer alignment: every distinct text is cut by two tokenizers once, and their tokens linked where both end."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carequeue.llm.shared import held, table, written

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that are aligned together, words a worker process remembers, and words encoded together.
GROUP_CHARS = 1_000_000
WORDS = 300_000
BATCH = 2000
#: How the second tokenizer writes a space.
SPACE = "▁"
# A single space between two visible characters: neither tokenizer lets a token reach over its left side.
_CUT = re.compile(rf" (?<=[^\s{SPACE}] )(?=[^\s{SPACE}])")
# Words that are encoded alone: a space before or after them could join theirs.
_ODD_ENDS = re.compile(rf"^\s|\s$|{SPACE}|^$")

ALIGNED = (
    "digest binary, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<int>"
)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [byte for byte in range(256) if byte not in set(plain)]
    return {chr(byte): byte for byte in plain} | {chr(256 + k): byte for k, byte in enumerate(moved)}


class Aligner:
    """Both tokenizers, the bytes of their tokens, and what each word met so far gives.

    A word is what stands between two cuts, with the space before it. Pairs are numbered: tokens that end together at
    one byte are suffixes of each other, so the vocabularies alone bound the pairs there can be.
    """

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes, self.b_bytes = self._a_bytes(a_path), self._b_bytes()
        if any(b" " in token.lstrip(b" ") for token in self.b_bytes):
            raise ValueError("a token of the second tokenizer reaches over a space between words")
        self.a_sizes, self.b_sizes = (np.array([len(token) for token in own]) for own in (self.a_bytes, self.b_bytes))
        # Each id as text, followed by a comma or by what ends its side of a group.
        self.texts = [f"{k}{end}" for own, last in ((self.a_bytes, "|"), (self.b_bytes, ";")) for k in range(len(own)) for end in ("," + last)]
        self.codes = self._possible_pairs()
        self.known: dict[str, tuple[str, bytes, int, int] | None] = {}
        self.older: dict[str, tuple[str, bytes, int, int] | None] = {}

    def _a_bytes(self, path: str) -> list[bytes]:
        with open(path, encoding="utf-8") as lines:
            model = json.load(lines)
        letters = _byte_letters()
        found = [b""] * self.a.get_vocab_size()
        for token, number in model["model"]["vocab"].items():
            found[number] = bytes(letters[letter] for letter in token) if set(token) <= set(letters) else token.encode()
        for added in model["added_tokens"]:
            found[added["id"]] = added["content"].encode()
        return found

    def _b_bytes(self) -> list[bytes]:
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        return [
            bytes([int(piece[3:-1], 16)]) if self.b.is_byte(k) else piece.replace(SPACE, " ").encode()
            for k, piece in enumerate(pieces)
        ]

    def _possible_pairs(self) -> np.ndarray:
        """Sorted codes (first id times the second vocabulary's size, plus second id) of all tokens that can end together."""
        size, codes = len(self.b_bytes), set()
        of_a, of_b = {}, {}
        for held, tokens in ((of_a, self.a_bytes), (of_b, self.b_bytes)):
            for number, token in enumerate(tokens):
                held.setdefault(token, []).append(number)
        for number, token in enumerate(self.a_bytes):
            codes.update(number * size + b for cut in range(len(token)) for b in of_b.get(token[cut:], ()))
        for number, token in enumerate(self.b_bytes):
            codes.update(a * size + number for cut in range(len(token)) for a in of_a.get(token[cut:], ()))
        return np.array(sorted(codes), np.int64)

    def _encoded(self, words: list[str]) -> list[tuple[str, bytes, int, int] | None]:
        """Groups as text, the pairs' numbers and the numbers of tokens of each word; None if the tokens do not spell it.

        Words are encoded in one text, since no token reaches over a cut; if it is not spelled, each word alone.
        """
        text = " ".join(words)
        a = np.array(self.a.encode(" " + text, add_special_tokens=False).ids, np.int64)
        b = np.array(self.b.encode(text), np.int64)
        spelled = (" " + text).encode()
        if any(b"".join([of[k] for k in ids.tolist()]) != spelled for of, ids in ((self.a_bytes, a), (self.b_bytes, b))):
            return [None] if len(words) == 1 else [self._encoded([word])[0] for word in words]
        ends = np.cumsum([len(word.encode()) + 1 for word in words])
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_last, b_last = np.searchsorted(a_ends, both), np.searchsorted(b_ends, both)
        pairs = np.searchsorted(self.codes, a[a_last] * len(self.b_bytes) + b[b_last]).astype(np.int32)
        # All ids as text in the order of the groups: a group's first ids, then its second ids, each with what follows it.
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.concatenate(([0], b_last + 1))[a_group]] = 2 * a + np.isin(np.arange(len(a)), a_last)
        order[np.arange(len(b)) + a_last[b_group] + 1] = 2 * (len(self.a_bytes) + b) + np.isin(np.arange(len(b)), b_last)
        texts = [self.texts[k] for k in order.tolist()]
        last = np.searchsorted(both, ends)
        bounds = [np.concatenate(([0], own)).tolist() for own in (last + 1, a_last[last] + 1, b_last[last] + 1)]
        return [
            ("".join(texts[a0 + b0 : a1 + b1]), pairs[g0:g1].tobytes(), a1 - a0, b1 - b0)
            for (g0, a0, b0), (g1, a1, b1) in zip(zip(*bounds), list(zip(*bounds))[1:])
        ]

    def learn(self, words: set[str]) -> None:
        """Have all the words in `known`. When it is full it becomes the older half, from which words met again come back."""
        if len(self.known) + len(words) > WORDS // 2:
            self.older, self.known = self.known, {}
        for word in words & self.older.keys():
            self.known[word] = self.older[word]
        new = [word for word in words if word not in self.known]
        odd = [word for word in new if _ODD_ENDS.search(word)]
        plain = [word for word in new if not _ODD_ENDS.search(word)] if odd else new
        for begin in range(0, len(plain), BATCH):
            part = plain[begin : begin + BATCH]
            self.known.update(zip(part, self._encoded(part), strict=True))
        for word in odd:
            self.known[word] = self._encoded([word])[0]

    def align(self, texts: list[str]) -> Iterator[tuple[int, int, str, np.ndarray]]:
        """For each text the numbers of tokens, its groups as text and its pairs' numbers."""
        split = [_CUT.split(text) if text else [] for text in texts]
        self.learn({word for words in split for word in words})
        none = np.zeros(0, np.int32)
        for words in split:
            found = [self.known[word] for word in words]
            if not found or None in found:
                yield 0, 0, "", none
                continue
            groups, pairs, n_a, n_b = zip(*found)
            yield sum(n_a), sum(n_b), "".join(groups)[:-1], np.frombuffer(b"".join(pairs), np.int32)


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner for all tasks of a worker process."""
    return held(Aligner, a_path, b_path)


def _groups(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of together up to about `size` characters, one text at least."""
    begin = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > size:
            yield begin, k
            begin, held = k, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


def _paths(a_path: str | None, b_path: str | None) -> tuple[str, str]:
    return a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE)


def aligned_texts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row for each distinct text of docs (text): its SHA-256, how many rows have it, and its alignment.

    `pairs` numbers the token pairs that end together, in the order of the text (see `pair_counts` for their ids).
    Rows are shuffled by their full text, of which each task has already folded its own copies, so a text that a
    third of the rows share is one row per task before it meets itself. Null is the empty text. Memory is bounded by a
    group of texts, or the longest one, and the remembered words.
    """
    places = _paths(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*places)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for begin, end in _groups(texts, GROUP_CHARS):
                sizes, shas, pairs = [], [], []
                for n_a, n_b, groups, links in own.align(texts[begin:end]):
                    sizes.append((n_a, n_b, len(links)))
                    shas.append(hashlib.sha256(groups.encode()).hexdigest() if len(links) else "")
                    pairs.append(links)
                n_a, n_b, n_links = (pa.array(column, pa.int64()) for column in zip(*sizes))
                ends = np.cumsum([0, *(len(links) for links in pairs)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([hashlib.sha256(text.encode()).digest() for text in texts[begin:end]], pa.binary()),
                        batch.column(1).slice(begin, end - begin),
                        n_a,
                        n_b,
                        n_links,
                        n_links,
                        pa.array(shas, pa.string()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(pairs))),
                    ],
                    [name.split()[0] for name in ALIGNED.split(", ")],
                )

    texts = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))
    return texts.mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(pair, a_id, b_id, count, best) from aligned texts: each linked pair of ids, how many links of all rows hold it, and
    whether no other pair of its b_id has more. No more rows than the vocabularies have tokens ending in one another."""
    places = _paths(a_path, b_path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*places)
        sums = np.zeros(len(own.codes), np.int64)
        for batch in batches:
            lists, copies = batch.column(0), batch.column(1).to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            np.add.at(sums, lists.flatten().to_numpy(), np.repeat(copies, sizes))
        met = np.flatnonzero(sums)
        a_ids, b_ids = np.divmod(own.codes[met], len(own.b_bytes))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (met.astype(np.int32), a_ids.astype(np.int32), b_ids.astype(np.int32), sums[met])],
            ["pair", "a_id", "b_id", "count"],
        )

    found = (
        aligned.select("pairs", "copies")
        .mapInArrow(count, "pair int, a_id int, b_id int, count bigint")
        .groupBy("pair", "a_id", "b_id")
        .agg(F.sum("count").alias("count"))
    )
    most = found.groupBy("b_id").agg(F.max("count").alias("most"))
    return found.join(most, "b_id").select("pair", "a_id", "b_id", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs (doc_id, text).

    The first tokenizer encodes a space and the text, the second the text, to which it adds the space; special tokens
    are plain text. Tokens end together where both cut the same bytes, which makes groups and one link at the end of each.
    n_best counts the links whose pair no other pair of its second id outnumbers in the whole corpus, ties included;
    count_sum adds the pairs' counts. Null and empty texts, and texts that the tokens do not spell, have zeros and ''.
    Repeated rows stay and count each; other columns are ignored; an empty table gives an empty result.

    Both vocabularies must be readable at their paths on every executor. The pair counts come to the driver and go to
    the executors: their number is bounded by the vocabularies, whatever the corpus.
    """
    places = _paths(a_path, b_path)
    aligned = written(aligned_texts(docs, *places))
    spark = docs.sparkSession
    found = pair_counts(aligned, *places).select("pair", "count", "best").toArrow()
    counts = spark.sparkContext.broadcast(tuple(found[name].to_numpy() for name in ("pair", "count", "best")))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, own_count, own_best = counts.value
        top = int(met.max(initial=-1)) + 1
        count, best = np.zeros(top, np.int64), np.zeros(top, np.int64)
        count[met], best[met] = own_count, own_best
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets, pairs = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            offsets = offsets - offsets[0]
            sums = [np.concatenate(([0], np.cumsum(of[pairs])))[offsets] for of in (best, count)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(np.diff(x)) for x in sums)], [*batch.schema.names[:-1], "n_best", "count_sum"]
            )

    measures = aligned.select("digest", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs").mapInArrow(
        weigh,
        "digest binary, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint",
    )
    marked = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    return marked.join(measures, "digest").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


def op12_align(spark: SparkSession, folder: str) -> DataFrame:
    """Alignment of all documents."""
    return align(table(spark, folder, "documents"))
