import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from carequeue.llm import ngram_join
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, text string"


def plain_set(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def plain(rows, percent=85):
    """Sizes and components of all rows by comparing all distinct sets."""
    sets = [plain_set(text) for _, text in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    first = {}
    for i, own in enumerate(sets):
        if own and own in first:
            group[root(i)] = root(first[own])
        first.setdefault(own, i)
    distinct = [i for own, i in first.items() if own]
    for a, i in enumerate(distinct):
        for j in distinct[:a]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(
        ((key, len(own), least.get(root(i)) if own else key) for i, ((key, _), own) in enumerate(zip(rows, sets))), key=repr
    )


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("x")).withColumn("key", F.lit(1)).withColumn("id", F.lit(1))
    return sorted(map(tuple, ngram_join.similar_documents(docs, **options).collect()), key=repr)


def copies(seed, groups, size, edits):
    """Groups of texts, each a base text with so many words changed at random."""
    chance, texts = random.Random(seed), []
    for g in range(groups):
        base = [f"w{chance.randrange(3000)}" for _ in range(chance.choice([3, 5, 9, 14, 30, 80, 200]))]
        for _ in range(size):
            words = list(base)
            for _ in range(chance.randint(0, edits)):
                words[chance.randrange(len(words))] = f"x{chance.randrange(3000)}"
            if chance.random() < 0.3:
                words = words[: max(1, int(len(words) * chance.uniform(0.8, 1)))]
            texts.append(" ".join(words))
    chance.shuffle(texts)
    return texts


def test_documents_equal_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngram_join.op13_similar(spark, SMALL).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize(("block_rows", "few_blocks"), [(512, 16), (3, 16), (3, 2)])
def test_groups_of_near_copies(spark, monkeypatch, block_rows, few_blocks):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(ngram_join, "FEW_BLOCKS", few_blocks)
    rows = list(enumerate(copies(block_rows, 25, 14, 4)))
    assert found(spark, rows) == plain(rows)


def test_another_threshold(spark):
    rows = list(enumerate(copies(7, 20, 6, 6)))
    assert found(spark, rows, percent=60) == plain(rows, 60)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 9000} v{i}" for i in range(40_000))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "A  b"), (9, "a b"), (None, "a b"), (5, "a b c d"), (6, "A b c\td"), (7, long),
        (8, long + " more"), (None, "alone here"), (None, None), (10, "é É x y"), (11, "É É x y"), (3, "other text under id three now"),
        (12, "a\x00b \x1c c d e"), (13, "x x x x x x x x"), (14, "x x x x"),
    ]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:3]) == plain(rows[:3])


def test_empty_table(spark):
    assert found(spark, []) == []


def test_linked_sets_share_a_key():
    chance = random.Random(3)
    shingler = ngram_join.Shingler(1)
    for _ in range(400):
        size = chance.choice([6, 7, 8, 9, 13, 14, 22, 23, 60, 200])
        base = chance.sample(range(10_000), size)
        most = int(size * 0.16)
        other = base[chance.randint(0, most) :] + chance.sample(range(20_000, 30_000), chance.randint(0, most))
        a, b = shingler.sets([" ".join(map(str, x)).encode() for x in (base, other)])
        both = len(np.intersect1d(a, b))
        if 185 * both >= 85 * (len(a) + len(b)) and len(a) + len(b) > 2 * both:
            keys = ngram_join.range_keys([a, b])
            shared = len(np.intersect1d(*keys))
            assert shared >= max(1, *ngram_join.least_keys(np.array([len(a), len(b)])))


def test_sets_with_many_empty_ranges_share_a_key():
    # All shingles in the lowest range: whatever else agrees is empty.
    sets = [np.sort(np.array(x, np.uint64)) for x in ([1, 2, 3, 4, 5, 6, 7, 8], [1, 2, 3, 4, 5, 6, 7])]
    assert len(np.intersect1d(*ngram_join.range_keys(sets)))


def test_overlaps_of_sparse_and_dense_columns(monkeypatch):
    chance = np.random.default_rng(5)
    sets = [np.unique(chance.integers(0, 60, 30)).astype(np.uint64) for _ in range(40)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[15:]] for a in sets[:20]]
    for few, pairs, columns in ((64, 2_000_000, 1024), (0, 64, 7), (10**6, 64, 7), (150, 300, 3)):
        monkeypatch.setattr(ngram_join, "FEW_PAIRS", few)
        monkeypatch.setattr(ngram_join, "PAIRS", pairs)
        monkeypatch.setattr(ngram_join, "COLUMNS", columns)
        assert ngram_join.overlaps(sets[:20], sets[15:]).tolist() == expected


def test_shared_keys_over_batches(spark):
    rows = [(k % 50, k % 7) for k in range(3000)] + [(100, 1)] * 40 + [(101, 1), (101, 1), (101, 2), (102, 5)]
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = sorted(map(tuple, ngram_join.shared_keys(spark.createDataFrame(rows, "key bigint, low bigint")).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    several = {k for k, _ in rows if len({low for key, low in rows if key == k}) > 1}
    assert got == sorted({row for row in rows if row[0] in several})
