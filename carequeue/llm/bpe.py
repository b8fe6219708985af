"""Byte-level BPE, encoded and decoded by DuckDB queries inside each task."""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property
from itertools import count, islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm.shared import give_back, held, table

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters of text whose words are encoded together, and words in one query.
GROUP_CHARS = 4_000_000
QUERY_WORDS = 50_000
#: Words that a worker process remembers before it starts afresh, and rows that become Python texts together.
WORDS = 400_000
ROWS = 1000
#: Words of more bytes are contracted outside the recursion, whose rows grow with the square of a word's length.
RECURSIVE_BYTES = 128
DUCKDB_MEMORY = "600MB"
#: Left id times this plus right id numbers a pair; the same in the query.
PAIR = 1 << 20

# Each round lays out the neighbouring tokens of each word with their positions, joins them to the merge table, and
# contracts the word's leftmost pair of least rank; words without a pair take no part in the next round.
CONTRACT = """
WITH RECURSIVE tokens(round, word, ids) AS (
    SELECT 0, word, ids FROM symbols
    UNION ALL
    (WITH pairs AS (
        SELECT word, unnest(ids[:-2])::BIGINT * 1048576 + unnest(ids[2:]) AS pair, unnest(range(len(ids) - 1)) AS pos
        FROM tokens
    ), best AS (
        SELECT word, min(merged::BIGINT * 65536 + pos) AS least FROM pairs JOIN merges USING (pair) GROUP BY word
    )
    SELECT round + 1, word, ids[:least % 65536] || [(least // 65536)::INTEGER] || ids[least % 65536 + 3:]
    FROM tokens JOIN best USING (word))
)
SELECT word, arg_max(ids, round) AS ids FROM tokens GROUP BY word ORDER BY word
"""

DECODE = """
SELECT word, unhex(string_agg(hex, '' ORDER BY pos)) AS bytes
FROM spelled JOIN vocabulary USING (id) GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """A vocabulary in DuckDB: tokens by id, and the merge table of (pair, id of both joined), pair = left id * PAIR + right id."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.find = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([byte])] for byte in range(256)], np.int32)
        self._forget()
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": ""})
        pairs = np.array(list(self._joined()), np.int64)
        self._keep("merges", {"pair": pairs[:, 0], "merged": pairs[:, 1].astype(np.int32)})
        self._keep(
            "vocabulary", {"id": pa.array(self.tokens, pa.int32()), "hex": [token.hex() for token in self.tokens.values()]}
        )

    def _joined(self) -> Iterator[tuple[int, int]]:
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    yield left * PAIR + right, rank

    @cached_property
    def merges(self) -> dict[int, int]:
        """The merge table for long words, made when the first is met."""
        return dict(self._joined())

    def _keep(self, name: str, columns: dict) -> None:
        given = pa.table(columns)
        self.base.register("given", given)
        self.base.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.base.unregister("given")

    def _query(self, sql: str, name: str, columns: dict) -> pa.Table:
        self._keep(name, columns)
        return self.base.sql(sql).to_arrow_table()

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in turn, and how many each has; a word that is a token is that token."""
        sizes, parts = np.ones(len(words), np.int64), []
        ranks = np.fromiter((self.ranks.get(word, -1) for word in words), np.int64, len(words))
        open_ = np.flatnonzero(ranks < 0)
        long = np.fromiter((len(words[k]) > RECURSIVE_BYTES for k in open_.tolist()), bool, len(open_))
        for k in open_[long].tolist():
            ids = np.array(self._contract_long(words[k]), np.int64)
            sizes[k] = len(ids)
            parts.append((np.array([k]), ids))
        split = open_[~long]
        for begin in range(0, len(split), QUERY_WORDS):
            part = split[begin : begin + QUERY_WORDS]
            own = [words[k] for k in part.tolist()]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(self.single[np.frombuffer(b"".join(own), np.uint8)]))
            found = self._query(CONTRACT, "symbols", {"word": np.arange(len(part), dtype=np.int32), "ids": lists})["ids"]
            found = found.combine_chunks()
            sizes[part] = np.diff(found.offsets.to_numpy())
            parts.append((part, found.flatten().to_numpy()))
        starts = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.int32)
        flat[starts[ranks >= 0]] = ranks[ranks >= 0]
        for of, ids in parts:
            flat[_spread(starts[of], sizes[of])] = ids
        return flat, sizes

    def _contract_long(self, word: bytes) -> list[int]:
        """The same contraction for one long word, its pairs in a heap by rank and place."""
        ids = [self.ranks[bytes([byte])] for byte in word]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(rank, i, i + 1) for i in range(len(ids) - 1) if (rank := self.merges.get(ids[i] * PAIR + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, j = heapq.heappop(heap)
            if ids[i] < 0 or after[i] != j or self.merges.get(ids[i] * PAIR + ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = rank, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (next_rank := self.merges.get(ids[a] * PAIR + ids[b])) is not None:
                    heapq.heappush(heap, (next_rank, a, b))
        return [i for i in ids if i >= 0]

    def decode_words(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes that each word's ids spell; every word has ids."""
        if not len(flat):
            return []
        word = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self._query(DECODE, "spelled", {"word": word, "pos": pos, "id": flat})["bytes"].to_pylist()

    def learn(self, new: list[str]) -> None:
        """Encode and decode words that have just been numbered."""
        flat, sizes = self.encode_words([word.encode() for word in new])
        self.spelled += self.decode_words(flat, sizes)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, flat))

    def _forget(self) -> None:
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.spelled: list[bytes] = []
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def round_trip(self, texts: list[str]) -> tuple[list[np.ndarray], list[bytes]]:
        """Ids of each text and the bytes they spell. A word is encoded and decoded when the process first meets it."""
        if len(self.numbers) > WORDS:
            self._forget()
        known, places = len(self.numbers), []
        for text in texts:
            words = self.find(text)
            places.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        if len(self.numbers) > known:
            self.learn(list(islice(self.numbers, known, None)))
        ids = [self.flat[_spread(self.starts[at], self.sizes[at])] for at in places]
        decoded = [b"".join(map(self.spelled.__getitem__, at.tolist())) for at in places]
        return ids, decoded


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of runs that begin at the starts, in turn."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def codec(path: str, pattern: str) -> Codec:
    """One codec for all tasks of a worker process."""
    return held(Codec, path, pattern)


def groups(texts: list[str | None], size: int) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of together up to about `size` characters, each group with its first place; null is empty."""
    begin, held = 0, 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held > size or k == len(texts) - 1:
            yield begin, [own or "" for own in texts[begin : k + 1]]
            begin, held = k + 1, 0


def encode_decode(
    docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN
) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) for every row of docs (doc_id, text; other columns are ignored).

    Each match of the pattern is encoded separately, without special tokens. Null and empty texts have no ids and
    decode to nothing; repeated rows stay. The vocabulary file must be readable at `path` on every executor; the
    default is the multilingual vocabulary of the installed tokenizer files. Memory is bounded by a group of texts
    (or the longest text) and the remembered words. There is no shuffle and nothing is kept between tasks but these
    and the vocabulary.
    """
    place = path or public_tokenizers.path(RANKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(place, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                rows = batch.slice(start, ROWS)
                for begin, texts in groups(rows.column(1).to_pylist(), GROUP_CHARS):
                    ids, decoded = coder.round_trip(texts)
                    ends = np.concatenate(([0], np.cumsum([len(own) for own in ids]))).astype(np.int32)
                    values = np.concatenate([np.zeros(0, np.int32), *ids])
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column(0).slice(begin, len(texts)),
                            pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
                            pa.array(decoded, pa.binary()),
                        ],
                        ["doc_id", "ids", "decoded"],
                    )
        # The worker waits with the words it remembers, but not with what the texts took.
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """Number of tokens and SHA-256 of the ids, as decimals joined by commas, and of the decoded bytes."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Round trip of all documents through the multilingual vocabulary."""
    return digests(encode_decode(table(spark, folder, "documents")))
