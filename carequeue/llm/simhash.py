"""SimHash near-duplicates: fingerprints of word shingles, compared exactly tile by tile."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm.components import connected_components
from carequeue.llm.shared import checkpointed, let_go, matching, table

WIDTH = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile, a task compares two: at least so many, and this many times the square root of those of the
#: same population count. So both a task's tiles and the copies of a fingerprint grow with the square root.
TILE_ROWS, TILE_ROOTS = 4096, 64
#: Hashes whose bits are counted together, and rows of the two blocks that are compared together.
HASHES = 65536
BLOCK = (512, 2048)
#: Links held before they are reduced to a forest.
LINKS = 1 << 20


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """SimHash of one text as an unsigned number: a bit is set if more than half the shingles' hashes have it."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    n, counts = len(words) - width + 1, np.zeros(64, np.int64)
    for begin in range(0, n, HASHES):
        last = min(n, begin + HASHES)
        hashes = np.array(
            [digest(joined[a:b], seed) for a, b in zip(starts[begin:last], ends[begin + width - 1 : last + width - 1])],
            dtype="<u8",
        )
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, mark, print) for every row of docs; print holds the 64 bits as a bigint, mark a hash of the text. A null text is an empty one."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            found = [fingerprint(text or b"", width) for text in batch.column(2).to_pylist()]
            values = pa.array(np.array(found, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], ["doc_id", "mark", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", _mark().alias("mark"), F.col("text").cast("binary").alias("text")).mapInArrow(
        prints, f"doc_id {kind}, mark bigint, print bigint"
    )


def _mark() -> Column:
    return F.xxhash64("text")


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links reach."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        open_ = a != b
        if not open_.any():
            break
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]
    return label


def _parts(values: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts."""
    return np.bitwise_count(values.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = _parts(values)
    order = np.lexsort(parts.T[::-1])
    return values[order], parts[order]


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of distinct fingerprints, or inside one, reduced to a spanning forest.

    Blocks whose population counts, taken over four parts of the bits, differ by more than the radius are skipped:
    each differing bit changes one part's count by one. All other pairs are compared by exclusive-or and bit count.
    """
    left, left_parts = _sorted(left)
    right_, right_parts = (left, left_parts) if right is None else _sorted(right)
    nodes, shift = (left, 0) if right is None else (np.concatenate([left, right_]), len(left))
    label, held, found = np.arange(len(nodes)), 0, []
    bounds = [
        (b, right_parts[b : b + BLOCK[1]].min(axis=0), right_parts[b : b + BLOCK[1]].max(axis=0))
        for b in range(0, len(right_), BLOCK[1])
    ]
    for a in range(0, len(left), BLOCK[0]):
        block = left[a : a + BLOCK[0], None]
        low, high = left_parts[a : a + BLOCK[0]].min(axis=0), left_parts[a : a + BLOCK[0]].max(axis=0)
        for b, least, most in bounds:
            if right is None and b + BLOCK[1] <= a:
                continue
            if np.maximum(0, np.maximum(least - high, low - most)).sum() > radius:
                continue
            i, j = np.nonzero(np.bitwise_count(block ^ right_[None, b : b + BLOCK[1]]) <= radius)
            if len(i):
                i, j = i + a, j + b + shift
                apart = label[i] != label[j]
                found.append((i[apart], j[apart]))
                held += len(found[-1][0])
            if held > LINKS:
                label = _merged(label, found)
                held, found = 0, []
    label = _merged(label, found)
    linked = np.nonzero(label != np.arange(len(nodes)))[0]
    return nodes[linked], nodes[label[linked]]


def _merged(label: np.ndarray, found: list) -> np.ndarray:
    own = np.arange(len(label))
    left = np.concatenate([own, *(x[0] for x in found)])
    right = np.concatenate([label, *(x[1] for x in found)])
    return _forest(len(label), left, right)


def _tiles_per_count(prints: DataFrame, tile_rows: int | None) -> list[int]:
    """Tiles for each of the 65 population counts."""
    rows = prints.groupBy(F.bit_count("print").alias("p")).count().collect()
    tiles = [1] * 65
    for p, n in rows:
        tiles[p] = math.ceil(n / (tile_rows or max(TILE_ROWS, TILE_ROOTS * math.sqrt(n))))
    return tiles


def links(prints: DataFrame, radius: int = RADIUS, tile_rows: int | None = None) -> DataFrame:
    """Links (u, v) that connect all fingerprints `print` at most radius bits apart; prints must be distinct.

    Tiles hold fingerprints of one population count, a count with many of them has several tiles. A fingerprint goes
    to each pair of its own tile and one whose count is within the radius, so a pair meets in one task and each task
    holds two tiles. A task returns a spanning forest of its links: never more rows than it was given.
    """
    tiles = F.array(*(F.lit(n) for n in _tiles_per_count(prints, tile_rows)))

    def of(p: Column) -> Column:
        return F.get(tiles, p)

    homes = prints.select("print", F.bit_count("print").alias("p")).select(
        "print", "p", F.pmod(F.xxhash64("print"), of(F.col("p"))).cast("int").alias("s")
    )
    meets = homes.withColumn(
        "q", F.explode(F.sequence(F.greatest(F.col("p") - radius, F.lit(0)), F.least(F.col("p") + radius, F.lit(64))))
    ).withColumn("t", F.explode(F.sequence(F.lit(0), of(F.col("q")) - 1)))
    home, other = F.struct("p", "s"), F.struct(F.col("q").alias("p"), F.col("t").alias("s"))
    paired = meets.select(
        F.least(home, other).alias("first"), F.greatest(home, other).alias("second"), "print", (home <= other).alias("near")
    )

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        values = rows["print"].to_numpy().view(np.uint64)
        near = rows["near"].to_numpy()
        same = key[0] == key[1]
        u, v = tile_links(values if same else values[near], None if same else values[~near], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    keyed = paired.select(
        F.concat_ws(":", "first.p", "first.s").alias("a"), F.concat_ws(":", "second.p", "second.s").alias("b"), "print", "near"
    )
    return keyed.groupBy("a", "b").applyInArrow(
        lambda key, rows: compare((key[0].as_py(), key[1].as_py()), rows), "u bigint, v bigint"
    )


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tile_rows: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text; other columns are ignored).

    Texts with equal fingerprints are one class, so copies are compared once. component_id is the smallest doc_id
    that links of at most `radius` bits reach. Null and blank texts have the fingerprint zero and link like any other;
    texts of up to `width` words are one shingle. Repeated rows stay and get the same component. A row without
    doc_id takes part, keeps its null and never names a component (null only if no member has an id). An empty table
    gives an empty result.
    """
    prints, linked = _linked(docs, width, radius, tile_rows)
    least = linked.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "component").select("print", "component_id")
    return prints.join(named, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _linked(docs: DataFrame, width: int, radius: int, tile_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (print, first_id, component) of each distinct one."""
    prints = checkpointed(fingerprints(docs, width))
    classes = checkpointed(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    found = connected_components(links(classes.select("print"), radius, tile_rows))
    linked = classes.join(found, F.col("print") == F.col("node"), "left").select(
        "print", "first_id", F.coalesce("component", "print").alias("component")
    )
    return prints, linked


def one_of_each(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """Docs with one row of each group of near-duplicates: that of the least id, and of its texts the least by hash.

    A row without id stays if its group has none with one. Of rows that repeat that id and its text one stays; of other
    texts under that id, those of other groups stay too.
    """
    prints, linked = _linked(docs, width, radius)
    # The least row of each fingerprint first, so that a group of many copies is folded before it meets in one task.
    named = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark")
    least = prints.groupBy("print").agg(F.min(named).alias("first"))
    kept = least.join(linked, "print").groupBy("component").agg(F.min("first").alias("first"))
    found = matching(docs, kept.select(F.struct("first.doc_id", "first.mark").alias("key")), "left_semi")
    return found.withColumn("_mark", _mark()).dropDuplicates(["doc_id", "_mark"]).select(docs.columns)


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicates of all documents."""
    return near_duplicates(table(spark, folder, "documents"))
