"""Merkle manifest of documents: leaves get their places from ranks in doc_id bitmaps, trees grow by keyed slot arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from carequeue.llm.shared import checkpointed, table, written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that make one node of the next level.
ARITY = 8
#: A bitmap word holds 64 values; so many bits of the word's number are left to each directory above it, the rest to the top one.
#: A directory is counted up in one task, so it has at most two to the sixteenth entries.
DIRECTORIES = (10, 16, 16)
PATH_COLUMNS = ("lang", "pos", "subroot", "root", "path")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(column: Column) -> Column:
    value = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(_field(F.col(name)) for name in FIELDS[:-1]), _field(text)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered) for every row: its leaf, and the leaf after its text was lower-cased (A-Z) where the
    crc32 of its doc_id is divisible by three; elsewhere, and without doc_id or text, both are equal."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column: leaves are placed by bitmaps of it")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select(*FIELDS).select(
        "lang",
        F.col("doc_id").cast("bigint").alias("doc_id"),
        _leaf(F.col("text")).alias("leaf"),
        F.when(changed, _leaf(F.translate("text", UPPER, LOWER))).otherwise(_leaf(F.col("text"))).alias("tampered"),
    )


def _matched(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names, null equal to null; the right side's copies of them go."""
    other = right.withColumnsRenamed({name: f"_{name}" for name in names})
    same = reduce(Column.__and__, (F.col(name).eqNullSafe(F.col(f"_{name}")) for name in names))
    return left.join(other, same, how).drop(*(f"_{name}" for name in names))


def _place(value: str) -> Column:
    return F.col(value).bitwiseAND(F.lit(63)).cast("int")


def _bit(value: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), _place(value))


def _bits_below(value: str) -> Column:
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), _place(value)))


def _counted_up(sizes: DataFrame, by: list[str], bits: tuple[int, ...]) -> DataFrame:
    """From (by, key, n), `before` beside each key: the sum of n over the smaller keys of its group.

    Each directory counts up the keys that share their upper bits and adds what its own entry in the next directory has
    before it. So no directory grows with the group, and every group may have any number of keys. A null key is the least.
    """
    if not bits:
        return sizes.withColumn("before", _running(Window.partitionBy(*by).orderBy("key")))
    parts = sizes.withColumn("above", F.shiftright("key", bits[0]))
    upper = parts.groupBy(*by, F.col("above").alias("key")).agg(F.sum("n").alias("n"))
    starts = _counted_up(upper, by, bits[1:]).select(*by, F.col("key").alias("above"), F.col("before").alias("start"))
    within = parts.withColumn("before", _running(Window.partitionBy(*by, "above").orderBy("key")))
    placed = _matched(within, starts, [*by, "above"])
    return placed.withColumn("before", F.col("before") + F.col("start")).drop("above", "start")


def _running(window) -> Column:
    return F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def ranked(rows: DataFrame, by: list[str], value: str, weight: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows with `rank`, the number (or weight) of rows of the same `by` whose bigint value is smaller, and `total`, that of all;
    and the (by, value) that more than one row (or unit of weight) has, None if there are none. Null is the smallest value.

    Each group's values are a bitmap of 64-bit words, made by a grouped bit-or that each task begins on its own rows;
    words without a value are not stored. A rank is the directory's count before the word plus the bits below in it.
    Values that rows share are one bit; what they count beyond it is kept beside the word.
    """
    units = F.col(weight) if weight else F.lit(1)
    rows = rows.withColumn("key", F.shiftright(value, 6))
    words = checkpointed(rows.groupBy(*by, "key").agg(F.bit_or(_bit(value)).alias("bits"), F.sum(units).alias("n")))
    totals = words.groupBy(*by).agg(F.sum("n").alias("total"))
    index = _matched(_counted_up(words, by, DIRECTORIES), totals, by)
    crowded = words.where(F.col("n") > F.coalesce(F.bit_count("bits"), F.lit(1)))
    repeated = None
    if crowded.limit(1).count():
        inside = _matched(rows, crowded.select(*by, "key"), [*by, "key"])
        counts = inside.groupBy(*by, "key", value).agg(F.sum(units).alias("n")).where("n > 1")
        repeated = checkpointed(counts).drop("n")
        more = F.collect_list(F.struct(_place(value).alias("place"), (F.col("n") - 1).alias("more")))
        index = _matched(index, counts.groupBy(*by, "key").agg(more.alias("more")), [*by, "key"], "left")
    below = F.bit_count(F.coalesce(F.col("bits").bitwiseAND(_bits_below(value)), F.lit(0)))
    rank = F.col("before") + below
    if repeated is not None:
        shared = F.filter("more", lambda x: x["place"] < _place(value))
        rank += F.coalesce(F.aggregate(shared, F.lit(0).cast("bigint"), lambda n, x: n + x["more"]), F.lit(0))
        repeated = repeated.drop("key")
    found = _matched(rows, index.drop("n"), [*by, "key"]).withColumn("rank", rank)
    return found.drop("key", "bits", "before", "more"), repeated


def placed(marks: DataFrame) -> DataFrame:
    """Leaves with their place `pos` among the `total` of their language, by doc_id; those that share a doc_id by leaf.

    Rows without doc_id come first. Leaves under one doc_id are ranked by bitmaps too, of their hashes' first sixty bits;
    the few distinct ones that agree in those are told by a window, and equal rows are counted and laid out again.
    """
    found, repeated = ranked(marks, ["lang"], "doc_id")
    kept = ["lang", "doc_id", "leaf", "tampered", "total"]
    if repeated is None:
        return found.select(*kept, F.col("rank").alias("pos"))
    alone = _matched(found, repeated, ["lang", "doc_id"], "left_anti").select(*kept, F.col("rank").alias("pos"))
    shared = _matched(found, repeated, ["lang", "doc_id"]).groupBy(*kept, F.col("rank").alias("first")).agg(F.count("*").alias("n"))
    shared = checkpointed(shared).withColumn("head", F.conv(F.substring("leaf", 1, 15), 16, 10).cast("bigint"))
    inner, _ = ranked(shared.withColumnRenamed("total", "of"), ["lang", "doc_id"], "head", "n")
    equal = _running(Window.partitionBy("lang", "doc_id", "head").orderBy("leaf", "tampered"))
    start = inner.withColumn("start", F.col("first") + F.col("rank") + equal)
    laid = start.withColumn("pos", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)))
    return alone.union(laid.select("lang", "doc_id", "leaf", "tampered", F.col("of").alias("total"), "pos"))


def _grown(nodes: DataFrame, *beside: str) -> tuple[list[DataFrame], DataFrame]:
    """From (lang, pos, total, hash, beside) the runs of each level, lowest first, and (lang, level, hash) of each top.

    A run is the slot array of the nodes that make one node above, keyed by its place there. Groups end at their own level.
    """
    most = nodes.agg(F.max("total")).first()[0] or 0
    levels, tops = [], [nodes.where("total = 1").select("lang", F.lit(0).alias("level"), "hash")]
    while most > 1:
        slot = F.struct(F.pmod("pos", F.lit(ARITY)).alias("slot"), "hash", *(beside if not levels else ()))
        runs = written(
            nodes.where("total > 1")
            .groupBy("lang", F.floor(F.col("pos") / ARITY).alias("pos"), F.ceil(F.col("total") / ARITY).alias("total"))
            .agg(F.array_sort(F.collect_list(slot)).alias("slots"))
        )
        levels.append(runs)
        nodes = runs.select("lang", "pos", "total", F.sha2(F.array_join("slots.hash", ""), 256).alias("hash"))
        tops.append(nodes.where("total = 1").select("lang", F.lit(len(levels)).alias("level"), "hash"))
        most = -(-most // ARITY)
    return levels, reduce(DataFrame.union, tops)


def _in_order(frame: DataFrame, key: str) -> DataFrame:
    """The frame with `pos`, its rows' places in the order of the key: sorted by ranges, counted within and over them."""
    ordered = written(frame.orderBy(key).withColumn("at", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    starts = parts.withColumn("start", _running(Window.orderBy("part"))).drop("n")
    inside = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.join(starts, "part").withColumn("pos", inside + F.col("start")).drop("at", "part", "start")


def _slots_with_paths(runs: DataFrame, above: DataFrame) -> DataFrame:
    """Each slot of the runs, with the path of its run below its own siblings: (left of it, right of it), lowest first."""
    both = _matched(runs.drop("total").withColumnRenamed("pos", "run"), above.withColumnRenamed("pos", "run"), ["lang", "run"])
    hashes = F.col("slots.hash")
    each = both.select("*", F.posexplode("slots").alias("place", "own"))
    left = F.array_join(F.slice(hashes, F.lit(1), F.col("place")), "")
    right = F.array_join(F.slice(hashes, F.col("place") + 2, F.lit(ARITY)), "")
    path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path")
    return each.withColumn("path", path).withColumn("pos", F.col("run") * ARITY + F.col("place"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs (the five FIELDS).

    Per language eight neighbouring nodes make one until one is left, its subroot; subroots in the order of their language
    (null first, bytewise) make the root alike. A proof is the path of siblings from leaf to root; folded_root is what
    it gives with the leaf of the tampered row. Every null field has its own mark, so null and empty texts differ.
    Rows without doc_id are the first leaves of their language; rows that share a doc_id are ordered by their leaves, and
    equal rows have neighbouring equal leaves. Long texts are only hashed. Other columns are ignored; an empty table gives an
    empty result.

    No leaf is sorted and no group meets in one task: counts are joined by bitmap word, nodes by run, and paths are
    handed down from the root, so that each level moves an eighth of what the level below does.
    """
    nodes = written(placed(written(leaves(docs))).withColumnRenamed("leaf", "hash"))
    levels, tops = _grown(nodes, "doc_id", "tampered")
    starts = _from_root(tops)
    paths = None
    for level in range(len(levels), 0, -1):
        ended = starts.where(F.col("level") == level).select(*PATH_COLUMNS)
        paths = _slots_with_paths(levels[level - 1], ended if paths is None else paths.select(*PATH_COLUMNS).union(ended))
    result = ["doc_id", "hash", "tampered", "subroot", "root", "path"]
    found = _matched(nodes.where("total = 1").drop("pos"), starts.where("level = 0"), ["lang"]).select(*result)
    if paths is not None:
        found = paths.select("own.doc_id", "own.hash", "own.tampered", "subroot", "root", "path").union(found)
    return _proved(found.withColumnRenamed("hash", "leaf"))


def _from_root(tops: DataFrame) -> DataFrame:
    """Each language's top (level, subroot) as a place to go down from: pos 0, and the path from there to the root."""
    subroots = _in_order(tops.withColumnRenamed("hash", "subroot"), "lang")
    total = F.lit(subroots.count()).cast("bigint")
    levels, roots = _grown(subroots.select(F.lit("").alias("lang"), "pos", total.alias("total"), F.col("subroot").alias("hash")))
    none = F.array().cast("array<struct<left:string,right:string>>")
    first = F.lit(0).cast("bigint").alias("pos")
    above = roots.select("lang", first, F.lit("").alias("subroot"), F.col("hash").alias("root"), none.alias("path"))
    for runs in reversed(levels):
        above = _slots_with_paths(runs, above).select(*PATH_COLUMNS)
    return checkpointed(subroots.join(above.drop("lang", "subroot"), "pos").withColumn("pos", first))


def _proved(found: DataFrame) -> DataFrame:
    siblings = F.array_join(F.flatten(F.transform("path", lambda step: F.array(step["left"], step["right"]))), "")
    folded = F.aggregate("path", F.col("tampered"), lambda own, step: F.sha2(F.concat(step["left"], own, step["right"]), 256))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root")
    )


def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of all documents."""
    return manifest(table(spark, folder, "documents"))


_SQL_FIELDS = " || ".join(
    f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({name}::VARCHAR) || ':' || {name}::VARCHAR END" for name in FIELDS[:-1]
)
_SQL_TEXT = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}) || ':' || {0} END"

#: Ranks by a window, levels by recursion, proofs by a second recursion along each leaf's way up.
ORACLE = f"""
WITH RECURSIVE marked AS (
    SELECT row_number() OVER () AS row_id, doc_id, lang, sha256({_SQL_FIELDS} || {_SQL_TEXT.format("text")}) AS leaf,
        sha256({_SQL_FIELDS} || {_SQL_TEXT.format(f"translate(text, '{UPPER}', '{LOWER}')")}) AS lowered,
        xor(list_reduce(range(0, 8 * strlen(doc_id::VARCHAR)), lambda c, i:
            CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END) % 2 = 1
                THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END) // 2, 3988292384)
                ELSE xor(c, CASE WHEN i % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, i // 8 + 1, 1)) ELSE 0 END) // 2 END,
            4294967295::BIGINT), 4294967295::BIGINT) AS crc
    FROM documents
), leaves AS (
    SELECT row_id, doc_id, lang, leaf, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS tampered,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS total
    FROM marked
), tree(lang, level, pos, total, hash) AS (
    SELECT lang, 0, pos, total, leaf FROM leaves
    UNION ALL
    SELECT lang, level + 1, pos // 8, (total + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos))
    FROM tree WHERE total > 1 GROUP BY lang, level, pos // 8, total
), runs AS (
    SELECT lang, level, pos // 8 AS run, list(hash ORDER BY pos) AS hashes FROM tree WHERE total > 1 GROUP BY lang, level, pos // 8
), subroots AS (
    SELECT lang, hash, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1
), top(level, pos, total, hash) AS (
    SELECT 0, pos, total, hash FROM subroots
    UNION ALL
    SELECT level + 1, pos // 8, (total + 7) // 8, sha256(string_agg(hash, '' ORDER BY pos))
    FROM top WHERE total > 1 GROUP BY level, pos // 8, total
), top_runs AS (
    SELECT level, pos // 8 AS run, list(hash ORDER BY pos) AS hashes FROM top WHERE total > 1 GROUP BY level, pos // 8
), climbed(row_id, lang, level, pos, proof, folded) AS (
    SELECT row_id, lang, 0, pos, '', tampered FROM leaves
    UNION ALL
    SELECT row_id, c.lang, c.level + 1, run,
        proof || array_to_string(hashes[:pos % 8], '') || array_to_string(hashes[pos % 8 + 2:], ''),
        sha256(array_to_string(hashes[:pos % 8], '') || folded || array_to_string(hashes[pos % 8 + 2:], ''))
    FROM climbed c JOIN runs r ON c.lang IS NOT DISTINCT FROM r.lang AND c.level = r.level AND c.pos // 8 = r.run
), at_subroot AS (
    SELECT row_id, s.hash AS subroot, s.pos, proof, folded
    FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY level DESC) AS back FROM climbed) c
    JOIN subroots s ON c.lang IS NOT DISTINCT FROM s.lang WHERE back = 1
), finished(row_id, level, pos, subroot, proof, folded) AS (
    SELECT row_id, 0, pos, subroot, proof, folded FROM at_subroot
    UNION ALL
    SELECT row_id, f.level + 1, run, subroot,
        proof || array_to_string(hashes[:pos % 8], '') || array_to_string(hashes[pos % 8 + 2:], ''),
        sha256(array_to_string(hashes[:pos % 8], '') || folded || array_to_string(hashes[pos % 8 + 2:], ''))
    FROM finished f JOIN top_runs r ON f.level = r.level AND f.pos // 8 = r.run
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY level DESC) AS back FROM finished) JOIN leaves USING (row_id)
CROSS JOIN (SELECT hash AS root FROM top WHERE total = 1) WHERE back = 1
"""
