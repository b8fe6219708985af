import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from carequeue.llm import simhash
from carequeue.llm.components import connected_components
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, text string"


def plain_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = list(prints)
    group = {i: i for i in ids}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: root(i) for i in ids}


def test_fingerprints_equal_the_plain_ones_and_sparks_hash(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    for row in rows[:60]:
        assert simhash.fingerprint((row.text or "").encode()) == plain_print(row.text)
    assert spark.range(1).select(F.xxhash64(F.lit("één"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("één", 42)


def test_components_of_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    prints = {r.doc_id: plain_print(r.text) for r in docs.select("doc_id", "text").collect()}
    expected = plain_components(prints)
    found = simhash.near_duplicates(docs, tile_rows=16).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{p:016x}" for i, p in prints.items()}


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(70_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (5, "A  B"), (None, "a b"), (6, long), (None, "alone here")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("print", F.lit("x")).withColumn("component", F.lit(None))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, r.fingerprint): r.component_id for r in found}
    assert [by[i, "0" * 16] for i in (1, 2, 3)] == [1, 1, 1]
    two = f"{plain_print('a b'):016x}"
    assert [by[i, two] for i in (4, 5, None)] == [4, 4, 4]
    assert by[None, f"{plain_print('alone here'):016x}"] is None
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6]
    assert [r.text for r in kept.collect() if r.doc_id is None] == ["alone here"]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_other_texts_under_one_id_stay(spark):
    unique, copied, other = (" ".join(f"{name}{i}" for i in range(60)) for name in ("u", "c", "o"))
    rows = [(1, copied), (2, copied), (2, unique), (3, other), (3, unique + " end"), (3, other)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA))
    near = plain_components({i: plain_print(text) for i, text in enumerate((unique, unique + " end"))})
    expected = [(1, copied), (2, unique), (3, other)] + ([] if len(set(near.values())) == 1 else [(3, unique + " end")])
    assert sorted(map(tuple, kept.collect())) == sorted(expected)


@pytest.mark.parametrize("same", [True, False])
def test_tiles_link_what_all_pairs_link(same):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    values = np.unique(np.concatenate([base, near, near ^ np.uint64(6)]))
    half = rng.permutation(len(values)) < len(values) // 2
    left, right = (values, None) if same else (values[half], values[~half])
    u, v = simhash.tile_links(left, right)
    other = left if same else right
    pairs = [(int(a), int(b)) for a in left for b in other if a != b and int(a ^ b).bit_count() <= 4]
    assert len(u) < len(values)

    def classes(links):
        label = {int(x): int(x) for x in values}
        while True:
            before = dict(label)
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
            if before == label:
                return label

    assert classes(list(zip(u.tolist(), v.tolist()))) == classes(pairs)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "u bigint, v bigint")).collect()}
    assert found == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
