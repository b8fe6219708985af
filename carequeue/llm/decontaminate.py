"""Benchmark decontamination by a prefix-filtered join of word shingles, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm.shared import checkpointed, matching, row_key, table, written

#: Words of a window, and of the shingles it is found by; a shorter item is one window.
WINDOW = 13
SHINGLE = 5
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Bits of the filter that documents' shingles pass before they are joined: half a megabyte, whatever the input.
FILTER_BITS = 1 << 22

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters a to z in either case, and characters beyond ASCII; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN_WORDS)
    return F.filter(parts, lambda word: word != "")


def _shingle(own: Column, at: Column, width: int) -> Column:
    return F.xxhash64(F.lit(width), *(F.get(own, at + i) for i in range(width)))


def _places(n: Column, width: int) -> Column:
    """Places 0 to n - width; none if there are fewer words."""
    return F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, window: int, shingle: int, unnamed: bool = False) -> DataFrame:
    """(item_id, own, n, width): the distinct windows of each item, of those without id too if unnamed, and the width of their shingles."""
    items = benchmark.where(F.lit(unnamed) | F.col("item_id").isNotNull()).select("item_id", F.explode(F.array(words(F.col("text")))).alias("all_words"))
    sized = items.withColumn("n", F.least(F.size("all_words"), F.lit(window))).where("n > 0")
    starts = F.sequence(F.lit(0), F.size("all_words") - F.col("n"))
    return (
        sized.withColumn("start", F.explode(starts))
        .select("item_id", F.expr("slice(all_words, start + 1, n)").alias("own"), "n", F.least("n", F.lit(shingle)).alias("width"))
        .distinct()
    )


def window_shingles(windows: DataFrame, widths: list[int]) -> DataFrame:
    """Every shingle of every window: its hash and its offset in the window."""

    def of(width: int) -> Column:
        return F.transform(
            _places(F.col("n"), width), lambda i: F.struct(i.alias("offset"), _shingle(F.col("own"), i, width).alias("hash"))
        )

    found = F.lit(None).cast("array<struct<offset:int,hash:bigint>>")
    for width in widths:
        found = F.when(F.col("width") == width, of(width)).otherwise(found)
    return windows.withColumn("shingle", F.explode(found)).select("*", "shingle.offset", "shingle.hash").drop("shingle")


def _filter_words(hashes: DataFrame, bits: int) -> DataFrame:
    """One row: the filter as an array of bits / 64 numbers."""
    place = F.pmod(F.col("hash"), F.lit(bits))
    marks = hashes.groupBy(F.shiftright(place, 6).alias("id")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(hash, {bits}) % 64 as int))")).alias("mark")
    )
    dense = hashes.sparkSession.range(bits // 64).join(marks, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("mark", F.lit(0)).alias("mark"))))
    return dense.agg(F.transform(ordered, lambda x: x["mark"]).alias("marks"))


def _document_shingles(docs: DataFrame, hashes: DataFrame, widths: list[int], window: int, bits: int) -> DataFrame:
    """Per document its number of words and those of its shingles that may be some item's, each with the words around."""
    marks = _filter_words(hashes, bits).scalar()
    split = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(F.array(words(F.col("text")))).alias("all_words")
    ).select("*", F.size("all_words").alias("n_words"), marks.alias("marks"))
    own, n = F.col("all_words"), F.col("n_words")

    def maybe(at: Column, width: int) -> Column:
        place = F.pmod(_shingle(own, at, width), F.lit(bits))
        mark = F.get(F.col("marks"), F.shiftright(place, 6).cast("int"))
        return F.getbit(mark, (place % 64).cast("int")) == 1

    def around(at: Column, width: int) -> Column:
        first = F.greatest(at - (window - width), F.lit(0))
        return F.struct(
            at.alias("at"),
            _shingle(own, at, width).alias("hash"),
            first.alias("first"),
            F.slice(own, first + 1, 2 * window - width).alias("around"),
        )

    def near(width: int) -> Column:
        return F.transform(F.filter(_places(n, width), lambda at: maybe(at, width)), lambda at: around(at, width))

    found = F.array().cast("array<struct<at:int,hash:bigint,first:int,around:array<string>>>")
    for width in widths:
        found = F.concat(found, near(width))
    return split.select("row", "doc_id", "n_words", found.alias("shingles"))


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, bits: int = FILTER_BITS, unnamed: bool = False):
    """Documents (row, doc_id, n_words) and occurrences (row, item_id, start, n) of the items' windows in them.

    A window can only occur where all its shingles do, so one of them, the rarest over all documents, is enough to
    find it (the prefix of a set join at full containment). Its place in the document gives the window's start, which
    must lie within the document; then the words of document and window are compared.
    """
    windows = checkpointed(item_windows(benchmark, window, shingle, unnamed))
    widths = sorted(row.width for row in windows.select("width").distinct().collect())
    shingles = checkpointed(window_shingles(windows, widths))
    split = written(_document_shingles(docs, shingles.select("hash"), widths, window, bits))
    near = split.select("row", "n_words", F.explode("shingles").alias("s")).select(
        "row", "n_words", "s.at", "s.hash", "s.first", "s.around"
    )
    counts = near.groupBy("hash").agg(F.count("*").alias("count"))
    rarest = (
        shingles.join(counts, "hash")
        .groupBy("item_id", "own", "n", "width")
        .agg(F.min(F.struct("count", "hash", "offset")).alias("prefix"))
        .select("item_id", "own", "n", "prefix.hash", "prefix.offset")
    )
    # Windows with a shingle that no document has are gone already.
    whole = F.slice("around", F.col("start") - F.col("first") + 1, F.col("n"))
    found = (
        near.join(rarest, "hash")
        .withColumn("start", F.col("at") - F.col("offset"))
        .where("start >= 0 and start + n <= n_words")
        .where(whole == F.col("own"))
        .select("row", "item_id", "start", "n")
    )
    return split.select("row", "doc_id", "n_words"), found


def contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, share: int = SHARE, unnamed: bool = False
) -> DataFrame:
    """(row, doc_id, n_words, n_hit, n_items, items, contaminated) for every row of docs (doc_id, text).

    A document word is hit if it lies in an occurrence of a window: `window` consecutive words of an item, or all of
    a shorter item. contaminated: at least one word in `share` is hit. Null and wordless texts have no words and are
    clean; items without words take no part, repeated items count once; items without id take part only if unnamed,
    count as one and are not in items; repeated documents and those without id
    stay, each judged by its own text. Empty tables give clean or no rows. Other columns are ignored.
    """
    rows, found = occurrences(docs, benchmark, window, shingle, unnamed=unnamed)
    span = F.struct("start", (F.col("start") + F.col("n")).alias("stop"))
    hits = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        F.max(F.col("item_id").isNull().cast("int")).alias("n_unnamed"),
        F.array_sort(F.collect_set(span)).alias("spans"),
    )
    # Sorted spans: each adds the words after the last stop.
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("stop")),
        lambda done, x: F.struct(
            (done["hit"] + F.greatest(x["stop"] - F.greatest(x["start"], done["stop"]), F.lit(0))).alias("hit"),
            F.greatest(x["stop"], done["stop"]).alias("stop"),
        ),
        lambda done: done["hit"],
    )
    hit = hits.select("row", "items", "n_unnamed", union.alias("n_hit"))
    joined = rows.join(hit, "row", "left").select(
        "row",
        "doc_id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_unnamed", F.lit(0)).alias("n_unnamed"),
    )
    return joined.select(
        "row",
        "doc_id",
        "n_words",
        "n_hit",
        (F.size("items") + F.col("n_unnamed")).cast("bigint").alias("n_items"),
        "items",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Docs without the contaminated ones, each row judged by its own text, whatever its id and whether others share it."""
    keyed = docs.select(row_key(docs).alias("doc_id"), "text")
    bad = contamination(keyed, benchmark, unnamed=True).where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    return matching(docs, bad, "left_anti")


def op2_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Contamination of all documents by all benchmark items, those without id too, as in ORACLE."""
    found = contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), unnamed=True)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


ORACLE = r"""
WITH split_docs AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM documents
), items AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, list_slice(w, i + 1, i + least(len(w), 13)) AS own
    FROM (SELECT *, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
    SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS own
    FROM (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM split_docs, sizes WHERE len(w) >= n)
), found AS (SELECT doc_id, item_id, i, n FROM places JOIN windows USING (n, own)
), words_hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
), items_hit AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM split_docs LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
