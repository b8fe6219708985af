"""Token ids of documents in ORC files, written in order of document and read back by stripe."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carequeue.llm.shared import give_back, held, shared_folder, table

TOKENIZER = "word_bpe_49k.json"
END = 1
#: Text, in bytes, that is encoded together, and the parts with their words, and the parts' ids, that a worker process remembers.
GROUP_BYTES = 2_000_000
WORDS = 800_000
IDS = 8_000_000
BATCH = 50
#: Texts that are not taken apart: what looks like a special token, and letters whose capitals compose with other marks.
WHOLE = r"<\||[HJTWY]\p{M}"
#: ASCII signs that no token shares with a letter or digit before them.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Ends of words that signs are cut from: the tokenizer turns some other letters into one and a mark, which joins the signs.
ALONE = "[0-9A-Za-z\u00c0-\u012f\u0131-\u024f\u0370-\u052f]$"
#: Latin, Greek and Cyrillic letters, none of which compose with each other.
LETTERS = [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x370, 0x530)]

#: Rows of a file, whose offsets count from its start.
FILE_SCHEMA = "file int, doc_id bigint, offset bigint, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
}


def _cut(parts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """The words of parts, or parts as they are, the signs after words, and which parts have such."""
    words = pc.utf8_rtrim(parts, characters=SIGNS)
    alone = pc.and_(pc.utf8_is_alnum(words), pc.match_substring_regex(words, ALONE))
    cut = pc.and_(alone, pc.not_equal(pc.binary_length(words), pc.binary_length(parts)))
    signs = pc.replace_substring_regex(parts.filter(cut), f"[^{re.escape(SIGNS)}]+", "")
    return pc.if_else(cut, words, parts), signs, cut.to_numpy(zero_copy_only=False)


def _apart(part: str) -> tuple[str, ...]:
    """A word and the signs after it, or the part as it is."""
    words, signs, _ = _cut(pa.array([part]))
    return (*words.to_pylist(), *signs.to_pylist())


def _gathered(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ids that begin at starts, in turn."""
    shift = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return ids[shift + np.arange(len(shift))]


class Runs:
    """Runs of ids of different strings, which are numbered when first met."""

    def __init__(self):
        self.numbers: dict[str, int] = defaultdict(count().__next__)
        self.starts, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def places(self, strings: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of strings; `learn` gives ids of those not met before, and where each one's start, and how many."""
        known, coded = len(self.numbers), strings.dictionary_encode()
        different = coded.dictionary.to_numpy(zero_copy_only=False)
        places = np.fromiter(map(self.numbers.__getitem__, different), np.int64, len(different))
        if len(self.numbers) > known:
            ids, starts, sizes = learn(coded.dictionary.filter(pa.array(places >= known)))
            self.starts = np.append(self.starts, len(self.ids) + starts)
            self.sizes = np.append(self.sizes, sizes)
            self.ids = np.append(self.ids, ids)
        return places[coded.indices.to_numpy()]


class WordEncoder(Runs):
    """Encodes texts by their parts between spaces and line ends, each part once.

    The tokenizer drops white space, lowers case and lets no token span white space, or a word and the signs after
    it, so a text's ids are its parts' ids in turn. Parts are told apart in columns, and learned when first met: words
    of letters from the tokenizer's model, others through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: What the model is given for a letter, of those that stay one letter.
        self.letters: dict[int, str] = {}
        for letter in map(chr, LETTERS):
            normal = self.tokenizer.normalizer.normalize_str(letter)
            if letter.isalpha() and len(normal) == 1 and normal.isalpha():
                self.letters[ord(letter)] = "".join(piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal))
        self.lettered = f"^[{''.join(map(chr, self.letters))}]+$"
        self._forget()

    def _forget(self) -> None:
        super().__init__()
        self.words = Runs()

    @property
    def single(self) -> dict[str, int]:
        """The words and runs of signs that have been met."""
        return self.words.numbers

    def _learn_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words and of runs of signs."""
        texts, model, ids, sizes = words.to_numpy(zero_copy_only=False), self.tokenizer.model, [], []
        lettered = pc.match_substring_regex(words, self.lettered).to_numpy(zero_copy_only=False)
        for word in texts[lettered]:
            own = [token.id for token in model.tokenize(word if word.isascii() else word.translate(self.letters))]
            ids += own
            sizes.append(len(own))
        others = texts[~lettered].tolist()
        for begin in range(0, len(others), BATCH):
            for one in self.tokenizer.encode_batch_fast(others[begin : begin + BATCH], add_special_tokens=False):
                own = one.ids
                ids += own
                sizes.append(len(own))
        found = np.empty(len(texts), np.int64)
        found[np.argsort(~lettered, kind="stable")] = np.arange(len(texts))
        sizes = np.array(sizes, np.int64)
        return np.array(ids, np.int32), (np.cumsum(sizes) - sizes)[found], sizes[found]

    def _learn(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts."""
        words, signs, cut = _cut(parts)
        places = self.words.places(pa.concat_arrays([words, signs]), self._learn_words)
        # The signs of a part follow its word.
        places = np.insert(places[: len(parts)], np.flatnonzero(cut) + 1, places[len(parts) :])
        firsts = np.cumsum(1 + cut) - 1 - cut
        sizes = self.words.sizes[places]
        ids = _gathered(self.words.ids, self.words.starts[places], sizes)
        sizes = np.add.reduceat(sizes, firsts)
        return ids, np.cumsum(sizes) - sizes, sizes

    def lists(self, texts: pa.Array, *more: int) -> pa.ListArray:
        """Ids of each text, without special tokens added, and then `more`; null is empty."""
        if len(self.numbers) + len(self.single) > WORDS or len(self.ids) > IDS:
            self._forget()
            give_back()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, WHOLE)
        # Lowering ASCII letters is the tokenizer's own first step.
        plain = pc.ascii_lower(pc.if_else(whole, "", texts))
        split = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        sizes = split.value_lengths().to_numpy().astype(np.int64)
        firsts = np.cumsum(sizes) - sizes
        places = self.places(split.flatten(), self._learn)
        # Whole texts, which have one empty part, and what follows each text are numbered after the parts, for this call.
        own = [self.tokenizer.encode(text, add_special_tokens=False).ids for text in texts.filter(whole).to_pylist()]
        places[firsts[whole.to_numpy(zero_copy_only=False)]] = len(self.sizes) + np.arange(len(own))
        if more:
            places = np.insert(places, firsts + sizes, len(self.sizes) + len(own))
            firsts = firsts + np.arange(len(firsts))
        extra = [*own, more]
        extra_sizes = np.array(list(map(len, extra)), np.int64)
        ids = np.append(self.ids, np.array(list(chain.from_iterable(extra)), np.int32))
        starts = np.append(self.starts, len(self.ids) + np.cumsum(extra_sizes) - extra_sizes)[places]
        sizes = np.append(self.sizes, extra_sizes)[places]
        ends = np.cumsum(np.add.reduceat(sizes, firsts))
        return pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), _gathered(ids, starts, sizes))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without special tokens added."""
        lists = self.lists(pa.array(texts, pa.string()))
        return np.split(lists.values.to_numpy(), lists.offsets.to_numpy()[1:-1])


def encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a worker process."""
    return held(WordEncoder, path)


def _groups(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in runs, each with the text that makes it larger than so many bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    begin = held = 0
    while begin < len(texts):
        stop = min(int(np.searchsorted(ends, held + size, side="right")) + 1, len(texts))
        yield texts.slice(begin, stop - begin)
        begin, held = stop, int(ends[stop - 1])


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end: int = END) -> None:
    """Write (file, doc_id, offset, ids) of every row of docs (doc_id, text) as ORC files to a new folder.

    Rows are dealt by ranges of doc_id, so the files are in ascending order and each is sorted (repeated ids by their
    text; rows without id come first). ids ends with `end`; null and empty texts have just that. offset is the number
    of ids before the document in its file, a running sum of the writing task. Integers are run-length encoded; each
    stripe has row indexes and a Bloom filter on doc_id, so a reader takes stripes in parallel and skips those that
    can't hold a wanted id. Only texts are shuffled, once; a task holds a group of texts.
    """
    place = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(place)
        number, offset = TaskContext.get().partitionId(), 0
        for batch in batches:
            begin = 0
            for texts in _groups(batch.column(1), GROUP_BYTES):
                ids = coder.lists(texts, end)
                ends = ids.offsets.to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(ids), number, np.int32)),
                        batch.column(0).slice(begin, len(ids)),
                        pa.array(offset + ends[:-1]),
                        ids,
                    ],
                    ["file", "doc_id", "offset", "ids"],
                )
                offset += int(ends[-1])
                begin += len(ids)

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Both sort by the same columns; the hash only splits rows that share an id.
    dealt = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = dealt.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(run, FILE_SCHEMA).write.options(**ORC_OPTIONS).orc(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids) from the files of write_tokens: start is the number of ids of all documents before.

    Files' totals, a row each, are summed in the files' order; nothing else but the files' rows is read.
    """
    stored = spark.read.schema(FILE_SCHEMA).orc(folder)
    totals = stored.groupBy("file").agg(F.max(F.col("offset") + F.size("ids")).alias("total"))
    # The window has no partitions: a row for each file.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    # As many rows as files, which write_tokens bounds by the number of shuffle partitions: ids stay where they are.
    return stored.join(F.broadcast(before), "file").select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "ids")


def find_tokens(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the wanted documents: stripes and row groups are skipped by index and Bloom filter."""
    return spark.read.schema(FILE_SCHEMA).orc(folder).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """Tokens with `ids` replaced by n_tokens and ids_crc32, the CRC-32 of the ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            data = lists.values.to_numpy().astype("<u4").tobytes()
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.select("doc_id", "start", "ids").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents' token ids, written to files in the shared folder and read back."""
    place = shared_folder(spark)
    write_tokens(table(spark, folder, "documents"), place)
    return checksums(read_tokens(spark, place))
