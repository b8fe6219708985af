"""Token counts by a finite-state transducer compiled from a piece vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm.shared import held, table

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"
#: Characters in a chunk of a text.
CHUNK = 65_536
#: States and units that a worker process keeps before it starts afresh, and the longest unit kept.
STATES = 120_000
WORDS = 400_000
WORD_CHARS = 64

_START = re.compile(f"(?<=[^{SPACE}]){SPACE}")


def unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Units that can be counted one by one, as no piece goes on from one to the next: the shorter, the fewer there are.

    A unit is a run of letters, or of other characters, with the spaces before it. What some piece holds beside a letter
    counts as a letter; numerals like ½, word characters to a pattern, are none.
    """
    pairs = {piece[i : i + 2] for piece in pieces for i in range(len(piece) - 1) if SPACE not in piece[i : i + 2]}
    letters = {char for pair in pairs for char in pair if char.isalpha()}
    others = {char for pair in pairs for char in pair} - letters
    while found := {char for pair in pairs for char in pair if char in others and not letters.isdisjoint(pair)}:
        letters, others = letters | found, others - found
    marks = re.escape("".join(sorted(char for char in letters if not char.isalpha())))
    numerals = re.escape("".join(sorted(char for char in others if char.isalnum() and not char.isdecimal())))
    run = rf"(?:[^\W\d_{numerals}]++|[{marks}]++)++" if marks else rf"[^\W\d_{numerals}]++"
    return re.compile(rf"{SPACE}*+(?:{run}|(?:(?![{SPACE}{marks}])[\W\d_{numerals}])++|(?<={SPACE}))")


class Pieces:
    """The vocabulary: which neighbouring pieces stay apart, and which strings begin a longer piece."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.begun = {piece[:n] for piece in self.score for n in range(1, len(piece))}
        if any(SPACE in piece.lstrip(SPACE) for piece in self.score):
            raise ValueError("A piece goes on over a space, so words can't be counted one by one")
        self.unit = unit_pattern(self.score)
        self.reached = {piece for piece in self.score if self.merged(piece) == [piece]}
        self.apart: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: neighbours that make the best piece are joined, the leftmost first."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: str, right: str) -> bool:
        """Whether left and right are the pieces of the text that both make."""
        key = (left, right)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > 2_000_000:
                self.apart.clear()
            found = self.apart[key] = left + right not in self.reached and self.merged(left + right) == [left, right]
        return found


class State(dict):
    """Transitions by character: the next state and the change of the number of tokens.

    What a state must know of the text before it: the longest end of it that begins a piece, and, for each place in
    that end, the piece that stops there and by how many tokens the text up to there has more than the whole.
    """

    __slots__ = ("end", "last", "more", "owner")

    def __init__(self, owner: Transducer, end: str, last: tuple, more: tuple):
        self.owner, self.end, self.last, self.more = owner, end, last, more

    def __missing__(self, char: str) -> tuple[State, int]:
        found = self[char] = self.owner.step(self, char)
        return found


class Counts(dict):
    """Tokens of units by text: counted when first met, and kept unless long."""

    __slots__ = ("owner",)

    def __init__(self, owner: Transducer):
        self.owner = owner

    def __missing__(self, unit: str) -> int:
        found = self.owner.count_word(unit)
        if len(unit) <= WORD_CHARS:
            if len(self) >= WORDS:
                self.clear()
            self[unit] = found
        return found


class Transducer:
    """Counts tokens: deterministic, its states and annotated transitions compiled when first met.

    A sequence of pieces is what merging gives if and only if each two neighbours stay apart, so the last piece of
    every beginning of a word is determined by the pieces before it, of which only those within a piece's length
    matter: finitely many states. Characters without a piece are counted as their bytes.
    """

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.counted = Counts(self)
        self._restart()

    def _restart(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state("", (None,), (0,))

    def _state(self, end: str, last: tuple, more: tuple) -> State:
        key = (end, last, more)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, end, last, more)
        return found

    def step(self, state: State, char: str) -> tuple[State, int]:
        """The transition from a state by a character."""
        pieces, text = self.pieces, state.end + char
        for n in range(len(text), 0, -1):
            piece = text[-n:]
            if piece not in pieces.reached and n > 1:
                continue
            before = state.last[n - 1]
            if before is None or pieces.stay_apart(before, piece):
                break
        else:
            raise ValueError(f"No piece ends at {text!r}")
        weight = 1 if piece in pieces.score else len(piece.encode())
        change = state.more[n - 1] + weight
        keep = next((k for k in range(len(text), 0, -1) if text[-k:] in pieces.begun), 0)
        last = (piece, *state.last[:keep])
        more = (0, *(own - change for own in state.more[:keep]))
        return self._state(text[len(text) - keep :], last, more), change

    def count_word(self, word: str) -> int:
        """Tokens of one word with its spaces before it, or of another unit."""
        state, total = self.start, 0
        for char in word:
            state, change = state[char]
            total += change
        if len(self.states) > STATES:
            self._restart()
        return total

    def count_words(self, text: str) -> int:
        """Tokens of text that begins with a space."""
        return sum(map(self.counted.__getitem__, self.pieces.unit.findall(text)))

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | str:
        """What a chunk does to any state that it is entered with.

        Each space after another character leads to one and the same state, so the map is constant from the first of
        them on: the text up to it (which depends on the state entered with), the tokens of the whole words, and the
        text from the last of them on, which is the state left with. Without one the chunk's text stands for its map.
        """
        first = _START.search(chunk)
        if first is None:
            return chunk
        last = first.start()
        for last in (found.start() for found in _START.finditer(chunk, last)):
            pass
        return chunk[: first.start()], self.count_words(chunk[first.start() : last]), chunk[last:]

    def compose(self, left: tuple | str, right: tuple | str) -> tuple | str:
        """The map of two neighbouring chunks; associative."""
        if isinstance(left, str):
            return left + right if isinstance(right, str) else self._opened(left + right[0], right)
        if isinstance(right, str):
            return left[0], left[1], left[2] + right
        return left[0], left[1] + self.count_words(left[2] + right[0]) + right[1], right[2]

    def _opened(self, text: str, right: tuple) -> tuple:
        """A chunk without a known start of a word, before one that has it."""
        first = _START.search(text)
        if first is None:
            return text, right[1], right[2]
        return text[: first.start()], self.count_words(text[first.start() :]) + right[1], right[2]

    def scan(self, maps: list) -> tuple | str:
        """All maps composed, neighbours two by two in each round as a parallel prefix scan does."""
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        if len(text) <= chunk:
            return self.count_words(text)
        whole = self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)])
        if isinstance(whole, str):
            return self.count_words(whole)
        return self.count_words(whole[0]) + whole[1] + self.count_words(whole[2])


def transducer(path: str) -> Transducer:
    """One transducer for all tasks of a worker process."""
    return held(Transducer, path)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text; other columns are ignored).

    Counts as the sentencepiece library gives them for the whole text, without begin and end tokens. Null and empty
    texts have none; repeated rows stay. The model must be readable at `path` on every executor. There is no shuffle;
    memory is bounded by a batch of texts and by the caches of states and words.
    """
    place = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = transducer(place)
        for batch in batches:
            counts = [counter.count(text or "") for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.array(counts, np.int64))], ["doc_id", "n_bytes", "n_tokens"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    found = sized.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, folder, "documents"))
