"""N-gram Jaccard join: a blocked sparse product of the incidence of documents and their shingles.

Only blocks that can hold a link are multiplied. Two sets of together S shingles that link differ in at most
S (100 - p) / (100 + p) of them, p being the least similarity in percent. So if the columns (shingles) are cut into more
ranges than that, both rows agree wholly in one range at least: rows meet in a block if they do in a range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm.components import connected_components
from carequeue.llm.shared import checkpointed, table, written

WIDTH = 4
PERCENT = 85
#: Bytes of text that are cut into shingles together, and words and sets that a task remembers.
GROUP_BYTES = 4_000_000
WORDS = 500_000
SETS = 1_000_000
#: Rows on either side of a block of the product, their shingles, and columns that are multiplied together.
BLOCK_ROWS = 2048
BLOCK_SHINGLES = 1_000_000
COLUMNS = 1024
#: Columns with at most so many pairs of rows are added up pair by pair, so many pairs at a time.
FEW_PAIRS = 64
PAIRS = 2_000_000

#: Blocks that a group is dealt to, beyond which its rows are connected by first blocks before all others are multiplied.
FEW_BLOCKS = 16
#: Bits that tell tasks which texts to cut again (2 MB).
MARK_BITS = 1 << 24

_GOLDEN = 0x9E3779B97F4A7C15
_ODD = np.uint64(_GOLDEN)
_HALF = np.uint64(32)


def _mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    values = values + np.uint64(salt * _GOLDEN % 2**64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(factor)
    return values ^ (values >> np.uint64(33))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


class Shingler:
    """Texts to sorted arrays of their distinct shingles, as 64-bit hashes; the hashes of words are remembered."""

    def __init__(self, width: int):
        self.width = width
        self.hashes = _Hashes()

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self.hashes) > WORDS:
            self.hashes.clear()
        return [self._set(text.lower().split()) for text in texts]

    def _set(self, words: list[bytes]) -> np.ndarray:
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, n)
        width = min(n, self.width)
        joined = hashes[: n - width + 1]
        for k in range(1, width):
            joined = joined * _ODD + hashes[k : n - width + 1 + k]
        return np.unique(_mixed(joined, width))


def _bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least sizes of the bands of set sizes, and for each band the ranges its columns are cut into and how many of these
    may be empty: with more, rows could agree in empty ranges alone."""
    least = [1]
    while least[-1] < 1 << 40:
        least.append(max(least[-1] + 1, least[-1] * 8 // 5))
    most = np.array(least[1:], np.int64) - 1
    differing = 2 * most * (100 - percent) // (100 + percent)
    spare = 1 + (differing + 1) // 8
    return np.array(least[:-1], np.int64), np.where(differing > 0, differing + 1 + spare, 0), spare


def range_keys(sets: list[np.ndarray], percent: int = PERCENT) -> list[np.ndarray]:
    """For each set a key for each range of its columns; sets that can link, and are not equal, share at least one.

    Sets of a band of sizes are cut alike, once with their own band and once with the next if they may link to its sets.
    The larger set's band bounds what the two differ in. A range that is empty has no key, unless so many of a row's
    ranges are that a link may agree in no other.
    """
    least, cuts, spare = _bands(percent)
    sizes = np.array([len(own) for own in sets], np.int64)
    keys: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in sets]
    bands = np.searchsorted(least, sizes, side="right") - 1
    rows = np.flatnonzero(sizes)
    while len(rows):
        cut = rows[cuts[bands[rows]] > 0]
        if len(cut):
            _add_keys(keys, [sets[k] for k in cut], cut, bands[cut], cuts, spare)
        bands = bands + 1
        rows = rows[percent * least[bands[rows]] <= 100 * sizes[rows]]
    return [np.concatenate(own) for own in keys]


def least_keys(sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many keys a set of each size shares at least with any set that it links to and does not equal.

    A link of S shingles in both sets agrees in all ranges but those that its differences may touch; of these ranges the
    spare ones may be empty. S is most where the other set is as large as the link and the band allow.
    """
    least, cuts, spare = _bands(percent)
    bands = np.searchsorted(least, sizes, side="right") - 1
    found = np.full(len(sizes), np.iinfo(np.int32).max, np.int64)
    open_ = sizes > 0
    while open_.any():
        most = np.minimum(100 * sizes // percent, least[bands + 1] - 1)
        needed = cuts[bands] - spare[bands] - (sizes + most) * (100 - percent) // (100 + percent)
        found = np.where(open_ & (cuts[bands] > 0), np.minimum(found, needed), found)
        bands = bands + 1
        open_ &= percent * least[bands] <= 100 * sizes
    return np.maximum(found, 1)


def _add_keys(keys: list, sets: list[np.ndarray], rows: np.ndarray, bands: np.ndarray, cuts: np.ndarray, spare: np.ndarray) -> None:
    sizes = np.array([len(own) for own in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(rows)), sizes)
    n = cuts[bands].astype(np.uint64)
    # Sets are sorted, so the shingles of one range stand together.
    part = ((flat >> _HALF) * n[row]) >> _HALF
    starts = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
    sums = np.add.reduceat(_mixed(flat, 1), starts)
    owner, part = row[starts], part[starts]
    found = _key(sums, bands[owner], part)
    ends = np.cumsum(np.bincount(owner, minlength=len(rows)))
    for k, (begin, end) in enumerate(zip([0, *ends[:-1]], ends)):
        keys[rows[k]].append(found[begin:end])
        if n[k] - (end - begin) > spare[bands[k]]:
            empty = np.setdiff1d(np.arange(int(n[k]), dtype=np.uint64), part[begin:end])
            keys[rows[k]].append(_key(np.zeros(len(empty), np.uint64), np.full(len(empty), bands[k]), empty))


def _key(sums: np.ndarray, band: np.ndarray, part: np.ndarray) -> np.ndarray:
    return _mixed(sums ^ _mixed((band.astype(np.uint64) << _HALF) + part, 2), 3)


def _grouped(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    begin = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, k
            begin, held = k, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def _digests(sets: list[np.ndarray]) -> tuple[list[int], list[int], list[int]]:
    """Size and 128 bits of each set, the same for equal sets."""
    high = [int(np.bitwise_xor.reduce(_mixed(own, 4)).view(np.int64)) if len(own) else 0 for own in sets]
    low = [int(_mixed(own, 5).sum(dtype=np.uint64).view(np.int64)) if len(own) else 0 for own in sets]
    return [len(own) for own in sets], high, low


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)))


def _shingled(batches: Iterator[pa.RecordBatch], width: int, beside: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """For groups of rows the first `beside` columns and the shingles of the binary text in the next."""
    own = Shingler(width)
    for batch in batches:
        texts = [text or b"" for text in batch.column(beside).to_pylist()]
        for begin, end in _grouped([len(text) for text in texts], GROUP_BYTES):
            yield [batch.column(k).slice(begin, end - begin) for k in range(beside)], own.sets(texts[begin:end])


def marked(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, mark, n, high, low, needed, keys) for every row: hash of its text, its set's size and digest, and its ranges'
    keys, of which it shares the needed number at least with any set it links to.

    The keys of a set that a task has met before are left out: copies of a text are one row per task where keys meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple] = set()
        for beside, sets in _shingled(batches, width, 2):
            digests = _digests(sets)
            keys = [np.zeros(0, np.uint64)] * len(sets)
            if len(met) > SETS:
                met.clear()
            new = []
            for k, digest in enumerate(zip(*digests)):
                if digest not in met:
                    met.add(digest)
                    new.append(k)
            for k, found in zip(new, range_keys([sets[k] for k in new], percent)):
                keys[k] = found
            needed = least_keys(np.array(digests[0], np.int64), percent)
            columns = [*beside, *(pa.array(values, pa.int64()) for values in (*digests, needed)), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "n", "high", "low", "needed", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {kind}, mark bigint, n bigint, high bigint, low bigint, needed bigint, keys array<bigint>"
    )


def shared_keys(rows: DataFrame) -> DataFrame:
    """The distinct (key, low) of keys that several `low` have; rows are shuffled by key and read in its order.

    A key is held once in each set, so even one that all documents share is but one of many keys of each, and its rows
    pass through a task without being kept.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        matched = np.zeros(0, bool)
        for batch in batches:
            key, low = (np.concatenate((held, batch.column(k).to_numpy())) for k, held in enumerate(last))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (low[1:] != low[:-1])))[: len(key)]
            key, low = key[new], low[new]
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            after, before = np.concatenate((same, [False])), np.concatenate((matched if len(matched) else [False], same))
            take = (before | after)[:-1]
            last, matched = (key[-1:], low[-1:]), before[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][take]), pa.array(low[:-1][take])], ["key", "low"])
        if len(matched) and matched[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in last], ["key", "low"])

    return rows.select("key", "low").repartition("key").sortWithinPartitions("key", "low").mapInArrow(scan, "key bigint, low bigint")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Product of two blocks of the incidence: shingles that each left row shares with each right row."""
    sizes = [len(own) for own in left], [len(own) for own in right]
    rows = [np.repeat(np.arange(len(own)), own) for own in sizes]
    _, column = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    columns = column[: sum(sizes[0])], column[sum(sizes[0]) :]
    total = int(column.max(initial=-1)) + 1
    counts = [np.bincount(own, minlength=total) for own in columns]
    pairs = counts[0] * counts[1]
    out = np.zeros(len(left) * len(right), np.int64)
    entries = []
    for own, row in zip(columns, rows):
        order = np.argsort(own, kind="stable")
        entries.append(row[order])
    starts = [np.cumsum(own) - own for own in counts]

    few = np.flatnonzero((pairs > 0) & (pairs <= FEW_PAIRS))
    step = max(1, PAIRS // max(1, FEW_PAIRS))
    for begin in range(0, len(few), step):
        some = few[begin : begin + step]
        n = pairs[some]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(counts[1][some], n)
        a = entries[0][np.repeat(starts[0][some], n) + at // wide]
        b = entries[1][np.repeat(starts[1][some], n) + at % wide]
        out += np.bincount(a * len(right) + b, minlength=len(out))

    out = out.reshape(len(left), len(right))
    many = np.flatnonzero(pairs > FEW_PAIRS)
    for begin in range(0, len(many), COLUMNS):
        some = many[begin : begin + COLUMNS]
        sides = []
        for side, n_rows in enumerate((len(left), len(right))):
            n = counts[side][some]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            dense = np.zeros((n_rows, len(some)), np.float32)
            dense[entries[side][np.repeat(starts[side][some], n) + at], np.repeat(np.arange(len(some)), n)] = 1
            sides.append(dense)
        out += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    return out


def _stars(mask: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the mask connects: each row to the smallest one it reaches."""
    none = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        new_a = np.minimum(a, np.where(mask, b[None, :], none).min(axis=1, initial=none))
        new_b = np.minimum(b, np.where(mask, new_a[:, None], none).min(axis=0, initial=none))
        if (new_a == a).all() and (new_b == b).all():
            nodes, least = np.concatenate((left, right)), np.concatenate((a, b))
            return nodes[nodes != least], least[nodes != least]
        a, b = new_a, new_b


def block_links(
    left_ids: np.ndarray, left: list[np.ndarray], right_ids: np.ndarray, right: list[np.ndarray], percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the rows of two blocks whose overlap reaches the bound that their sizes set."""
    sizes = [np.array([len(own) for own in side], np.int64) for side in (left, right)]
    # A row links only if a row of the other block is of like size.
    for mine, other in ((0, 1), (1, 0)):
        order = np.sort(sizes[other])
        at = np.searchsorted(order, -(-percent * sizes[mine] // 100))
        near = (at < len(order)) & (percent * order[np.minimum(at, len(order) - 1)] <= 100 * sizes[mine])
        kept = np.flatnonzero(near)
        if mine == 0:
            left_ids, left = left_ids[kept], [left[k] for k in kept]
        else:
            right_ids, right = right_ids[kept], [right[k] for k in kept]
        sizes[mine] = sizes[mine][kept]
        if not len(kept):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mask = (100 + percent) * overlaps(left, right) >= percent * (sizes[0][:, None] + sizes[1][None, :])
    return _stars(mask & (left_ids[:, None] != right_ids[None, :]), left_ids, right_ids)


def _products(rows: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) from the rows (key, a, b, side, id, shingles) of blocks: side 1 is a left row, 2 a right one, 0 both.

    Blocks are shuffled whole and read in their order; one block at a time is held, with bounded rows and shingles
    (or one large set on a side).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        block = None

        def links() -> pa.RecordBatch:
            sides = [[row for row in held if row[0] in (0, side)] for side in (1, 2)]
            ids = [np.array([row[1] for row in side], np.int64) for side in sides]
            values = [[np.frombuffer(row[2], np.uint64) for row in side] for side in sides]
            u, v = block_links(ids[0], values[0], ids[1], values[1], percent) if sides[0] and sides[1] else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for name, side, own, values in zip(names, *(batch.column(k).to_pylist() for k in range(3, 6))):
                if name != block:
                    if held:
                        yield links()
                    held, block = [], name
                held.append((side, own, values))
        if held:
            yield links()

    dealt = rows.select("key", "a", "b", "side", "id", "shingles").repartition("key", "a", "b")
    return dealt.sortWithinPartitions("key", "a", "b").mapInArrow(run, "u bigint, v bigint")


def _blocks_of(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _dealt(number: Column) -> Column:
    return F.pmod(F.xxhash64("id", "key"), number).cast("int")


def _told_apart(members: DataFrame) -> DataFrame:
    """Members (key, id, ...) without the keys that have the same members as another."""
    same = members.groupBy("key").agg(
        F.count("*").alias("rows"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")
    )
    kept = same.where("rows > 1").groupBy("rows", "x", "y").agg(F.min("key").alias("key"))
    return members.join(kept.select("key"), "key", "left_semi")


def first_blocks(members: DataFrame) -> DataFrame:
    """Blocks of two of each row's keys, the least and the greatest; keys with many rows are dealt to several blocks.

    Most links show here, and rows of a large group of near copies are dealt anew under each key, so they join up.
    """
    own = members.groupBy("id", "n").agg(F.array_distinct(F.array(F.min("key"), F.max("key"))).alias("keys"))
    chosen = _told_apart(own.select("id", "n", F.explode("keys").alias("key")))
    sizes = chosen.groupBy("key").agg(_blocks_of(F.count("*"), F.sum("n")).alias("blocks"))
    dealt = chosen.join(sizes, "key")
    return dealt.select("key", _dealt(F.col("blocks")).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side"), "id")


def _dealt_sizes(members: DataFrame) -> DataFrame:
    """(key, group, top, lefts, rights, square, cost): the commonest label of each key, the blocks that the rows outside it and
    all rows are dealt to, whether all rows by all rows send out no more, and the rows that go out."""
    counts = members.groupBy("group", "key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    sizes = counts.groupBy("group", "key").agg(
        F.max(F.struct("rows", "shingles", "label")).alias("top"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles")
    )
    rest = F.col("rows") - F.col("top.rows")
    dealt = sizes.withColumns(
        {
            "lefts": _blocks_of(rest, F.col("shingles") - F.col("top.shingles")),
            "rights": _blocks_of(F.col("rows"), F.col("shingles")),
        }
    )
    oblong, square = F.col("rows") * F.col("lefts") + rest * F.col("rights"), F.col("rows") * F.col("rights")
    return dealt.select(
        "key",
        "group",
        F.col("top.label").alias("top"),
        "lefts",
        "rights",
        (square <= oblong).alias("square"),
        F.least(square, oblong).alias("cost"),
    )


def other_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks for all pairs of rows that share a key and are not yet connected; labels are (id, group, label).

    Of each key with rows of several labels the rows outside its commonest label are multiplied by all its rows: two
    rows of different labels are never both of the commonest; or all rows by all, each pair of blocks once, where that
    sends out fewer. Keys whose rows are all connected have no block. Where
    they would send out more rows than multiplying the rows of all such keys of a group at once, as in a group of many
    near copies, which share most keys, the group takes the place of its keys.
    """
    named = checkpointed(members.join(labels, "id"))
    mixed = named.groupBy("key").agg((F.min("label") != F.max("label")).alias("mixed")).where("mixed")
    open_ = checkpointed(_told_apart(named.join(mixed.select("key"), "key", "left_semi")))
    at_once = open_.withColumn("key", F.xxhash64("group")).dropDuplicates(["key", "id"])
    by_key, by_group = checkpointed(_dealt_sizes(open_)), checkpointed(_dealt_sizes(at_once))
    costs = by_key.groupBy("group").agg(F.sum("cost").alias("by_keys"))
    cheaper = by_group.join(costs, "group").where("cost < by_keys").select("group")
    chosen = [
        open_.join(by_key.join(cheaper, "group", "left_anti").drop("group"), "key"),
        at_once.join(by_group.join(cheaper, "group", "left_semi").drop("group"), "key"),
    ]
    dealt = checkpointed(chosen[0].unionByName(chosen[1]))
    every_left, every_right = (F.sequence(F.lit(0), F.col(n) - 1) for n in ("lefts", "rights"))
    oblong = dealt.where("NOT square")
    left = oblong.where("label <> top").select("key", _dealt(F.col("lefts")).alias("a"), F.explode(every_right).alias("b"), F.lit(1).alias("side"), "id")
    right = oblong.select("key", F.explode(every_left).alias("a"), _dealt(F.col("rights")).alias("b"), F.lit(2).alias("side"), "id")
    pairs = dealt.where("square").select("key", "id", _dealt(F.col("rights")).alias("own"), F.explode(every_right).alias("other"))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    square = pairs.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), "id")
    return left.union(right).union(square)


def live_members(members: DataFrame) -> DataFrame:
    """Members (key, id, n, needed) of the sets that share as many keys as a link needs, and of keys that several such sets have."""
    enough = members.groupBy("id").agg((F.count("*") >= F.min("needed")).alias("enough")).where("enough")
    members = members.join(enough.select("id"), "id", "left_semi")
    several = members.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1")
    return checkpointed(members.join(several.select("key"), "key", "left_semi"))


def gathered(members: DataFrame) -> DataFrame:
    """(id, group, blocks) of the live sets: those that keys hold together, and how many blocks of the product the group is.

    Sets of different groups have no key in common. Most groups are a few near copies and become a block each, to which
    every set goes once; larger groups are multiplied key by key.
    """
    first = members.groupBy("key").agg(F.min("id").alias("v"))
    groups = connected_components(members.join(first, "key").select(F.col("id").alias("u"), "v"))
    placed = checkpointed(members.groupBy("id").agg(F.min("n").alias("n")).join(groups.withColumnRenamed("node", "id"), "id"))
    sizes = placed.groupBy("component").agg(_blocks_of(F.count("*"), F.sum("n")).alias("blocks"))
    return placed.join(sizes, "component").select("id", F.col("component").alias("group"), "blocks")


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The wanted sets (mark, n, high, low, ...) with their shingles: the texts with their marks are cut anew.

    Which texts to cut a task sees in a bitmap of the marks, of a fixed size: it may let others pass, which find no
    wanted set of their digest. So no text is shuffled. Copies of a text are cut once in a task.
    """
    bits = wanted.select(F.pmod("mark", F.lit(MARK_BITS)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")
    )
    found = bits.toArrow()
    words = np.zeros(MARK_BITS // 64, np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    marks = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()

        def passing() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy()
                bit = own % MARK_BITS
                take = []
                for k in np.flatnonzero(marks.value[bit >> 6] >> (bit & 63) & 1).tolist():
                    if own[k] not in met:
                        met.add(own[k])
                        take.append(k)
                yield batch.take(pa.array(take, pa.int64())).select([1])

        for _, sets in _shingled(passing(), width, 0):
            columns = [*(pa.array(x, pa.int64()) for x in _digests(sets)), pa.array([own.tobytes() for own in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["n", "high", "low", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    cut = texts.mapInArrow(run, "n bigint, high bigint, low bigint, shingles binary")
    return cut.join(wanted.drop("mark"), ["n", "high", "low"]).dropDuplicates(["n", "high", "low"])


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text; other columns are ignored).

    Two rows link if their sets of distinct shingles of `width` lower-cased words overlap in `percent` of their union.
    component_id is the smallest doc_id that links reach. Rows with equal sets are one row of the product, so copies are
    never paired. A text of fewer words is one shingle; null and blank texts have none, link to nothing and are
    their own component. Repeated rows stay and get the same component; a row without doc_id takes part, keeps its null and
    never names a component. Long texts are whole sets: one may exceed the bound of a block. An empty table gives an
    empty result. Shingles are told by 64 bits and sets by 128.
    """
    marks = written(marked(docs, width, percent))
    one = marks.where("n > 0").groupBy("n", "high", "low", "needed").agg(F.min("doc_id").alias("doc_id"), F.min("mark").alias("mark"))
    # Numbered in the order in which they are written, which stays.
    classes = written(one.withColumn("id", F.monotonically_increasing_id()))
    keys = marks.where("n > 0").select("low", F.explode("keys").alias("key"))
    named = classes.select("low", "id", "n", "needed")
    members = live_members(checkpointed(shared_keys(keys).join(named, "low").select("key", "id", "n", "needed")))
    groups = checkpointed(gathered(members))
    wanted = classes.join(groups, "id").select("mark", "n", "high", "low", "id", "group", "blocks")
    sets = written(_sets(docs, wanted, width).select("id", "group", "blocks", "shingles"))
    none = F.lit(0)
    whole = sets.where("blocks = 1").select(F.col("group").alias("key"), none.alias("a"), none.alias("b"), none.alias("side"), "id", "shingles")
    links = _products(whole, percent)
    if not groups.where("blocks > 1").isEmpty():
        links = links.union(_large_links(members, groups.where("blocks > 1"), sets.where("blocks > 1"), percent))
    linked = connected_components(links)
    grouped = checkpointed(classes.join(linked.withColumnRenamed("node", "id"), "id").select("n", "high", "low", "doc_id", "component"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("least"))
    found = marks.select("doc_id", "n", "high", "low")
    alone = classes.join(linked.select(F.col("node").alias("id")), "id", "left_anti").select("n", "high", "low", F.col("doc_id").alias("least"))
    named = grouped.join(least, "component").select("n", "high", "low", "least").union(alone)
    return found.join(named, ["n", "high", "low"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def _large_links(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links inside groups that are too large for a block: those of very many rows are connected by first blocks where they
    can be, then all are multiplied but for what is connected already."""
    members = checkpointed(members.join(groups.select("id"), "id", "left_semi"))
    sets, many = sets.select("id", "shingles"), groups.where(F.col("blocks") > FEW_BLOCKS)
    if many.isEmpty():
        labels = groups.select("id", "group", F.col("id").alias("label"))
        return _products(other_blocks(members, labels).join(sets, "id"), percent)
    first = first_blocks(members.join(many.select("id"), "id", "left_semi"))
    links = checkpointed(_products(first.join(sets, "id"), percent))
    near = connected_components(links).select(F.col("node").alias("id"), F.col("component"))
    labels = groups.join(near, "id", "left").select("id", "group", F.coalesce("component", "id").alias("label"))
    return links.union(_products(other_blocks(members, labels).join(sets, "id"), percent))


def op13_similar(spark: SparkSession, folder: str) -> DataFrame:
    """Components of all documents."""
    return similar_documents(table(spark, folder, "documents"))
