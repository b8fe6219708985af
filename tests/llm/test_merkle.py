import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from carequeue.llm import merkle
from tests.conftest import SMALL

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Top, and for each node the list of (left, right) siblings on its way up."""
    paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for begin in range(0, len(nodes), 8):
            run = nodes[begin : begin + 8]
            for place in range(len(run)):
                for k in groups[begin + place]:
                    paths[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
            above.append(sha(*run))
            held.append([k for own in groups[begin : begin + 8] for k in own])
        nodes, groups = above, held
    return nodes[0], paths


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    order = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    found, tops = [], []
    for lang in order:
        own = sorted(
            ((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"]), r) for r in rows if r["lang"] == lang),
            key=lambda x: x[:3],
        )
        top, paths = plain_tree([x[2] for x in own])
        tops.append(top)
        found.append([(x[3], x[2], path) for x, path in zip(own, paths)])
    root, above = plain_tree(tops) if tops else (None, [])
    out = []
    for own, subroot, upper in zip(found, tops, above):
        for row, leaf, path in own:
            tampers = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0
            folded = plain_leaf(row, lowered(row["text"])) if tampers else leaf
            for left, right in path + upper:
                folded = sha(left, folded, right)
            proof = sha(*(left + right for left, right in path + upper))
            out.append((row["doc_id"], leaf, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def check(spark, rows):
    names = [column.split()[0] for column in SCHEMA.split(", ")]
    docs = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMA)
    clashing = docs.withColumn("leaf", F.lit(1)).withColumn("pos", F.lit("x")).withColumn("bits", F.lit(2))
    whole = [{n: r.get(n) for n in names} for r in rows]
    assert sorted(map(tuple, merkle.manifest(clashing).collect()), key=repr) == plain(whole)


def doc(key, text="Text", lang="en", source="s", n_chars=4):
    return {"doc_id": key, "text": text, "lang": lang, "source": source, "n_chars": n_chars}


def test_documents_equal_the_plain_manifest(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, merkle.op11_merkle(spark, SMALL).collect()), key=repr) == plain(rows)


def test_documents_equal_the_sql(spark):
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    found = base.sql(merkle.ORACLE)
    assert found.columns == merkle.op11_merkle(spark, SMALL).columns
    assert sorted(found.fetchall(), key=repr) == sorted(map(tuple, merkle.op11_merkle(spark, SMALL).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 8, 65])
def test_sizes_of_one_language(spark, size):
    check(spark, [doc(7 * k - 20, f"Text {k}") for k in range(size)])


def test_many_languages_of_odd_names(spark):
    langs = [None, "", "a", "Z", "é", "zz", "😀", "－", "a b", *(f"l{k}" for k in range(12))]
    check(spark, [doc(k, f"T{k}", lang) for k, lang in enumerate(langs)] + [doc(100 + k, "More", "é") for k in range(10)])


def test_nulls_ties_and_repeated_rows(spark):
    rows = [doc(k, text) for k in (0, 3, None, -(2**63), 2**63 - 1, 70, 64) for text in ("A", "B", None, "")]
    rows += [doc(3, "A")] * 30 + [doc(None, "A")] * 9 + [doc(None, None, None, None, None)] * 3
    rows += [doc(1 << 40, "LONG " * 50_000), doc(5, "É ÀB", source=None), doc(6, "x", n_chars=None)]
    check(spark, rows)


def test_leaves_that_agree_in_their_first_bits(spark):
    schema = "lang string, doc_id bigint, leaf string, tampered string"
    rows = [("en", 1, "a" * 15 + tail * 49, "t") for tail in "cab"] * 2 + [("en", 0, "f" * 64, "t"), ("en", 2, "0" * 64, "t")]
    found = merkle.placed(spark.createDataFrame(rows, schema)).orderBy("pos").collect()
    assert [r.pos for r in found] == list(range(8)) and {r.total for r in found} == {8}
    assert [r.leaf[15] for r in found] == list("faabbcc0")


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(TypeError):
        merkle.manifest(spark.createDataFrame([("x", "t", "en", "s", 1)], SCHEMA.replace("doc_id bigint", "doc_id string")))
