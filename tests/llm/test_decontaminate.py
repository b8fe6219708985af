import hashlib
import re

import duckdb
from pyspark.sql import functions as F

from carequeue.llm import decontaminate
from tests.conftest import SMALL

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def split(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = split(text)
        if w and item is not None:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def digest(frame):
    return sorted(
        (
            (r.doc_id, r.n_words, r.n_hit, r.n_items, hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated)
            for r in frame.collect()
        ),
        key=str,
    )


def test_given_documents(spark):
    pairs = [[tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id"))]
    found = sorted((tuple(r) for r in decontaminate.op2_decontaminate(spark, SMALL).collect()), key=str)
    assert found == plain(*pairs)
    assert any(row[5] for row in found)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    items = [(1, long), (1, long), (2, "Short one"), (3, None), (4, " .,"), (None, "lonely"), (5, "Short"), (6, "x " * 30), (7, "été ÀB")]
    docs = [
        (1, "before " + long + " after " * 300),
        (1, "before " + long),
        (2, None),
        (3, ""),
        (4, "a short,ONE b lonely"),
        (None, "short one"),
        (5, "x " * 14 + "y " + "x " * 40),
        (6, " ".join(f"w{i}" for i in range(12))),
        (7, "w5 " * 20_000),
        (8, "ÉTÉ été àb été Àb"),
        (9, long + " " + long),
    ]
    frame = spark.createDataFrame(docs, DOCS).withColumn("row", F.lit(1)).withColumn("hash", F.lit("h"))
    bench = spark.createDataFrame(items, ITEMS).withColumn("n", F.lit(2))
    assert digest(decontaminate.contamination(frame, bench)) == plain(docs, items)
    kept = decontaminate.clean_documents(frame, bench)
    assert kept.columns == frame.columns
    clean = [(row[0], text) for row, (_, text) in zip(plain_rows(docs, items), docs) if not row[5]]
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted((key or 0, text or "") for key, text in clean)


def plain_rows(docs, items):
    """The plain result of each row by itself, in order."""
    return [plain([row], items)[0] for row in docs]


def test_rows_without_id_or_under_a_shared_one_are_judged_by_their_text(spark):
    item = " ".join(f"b{i}" for i in range(20))
    docs = [(None, item), (None, item), (1, item), (1, "clean words only"), (None, "clean too"), (2, item), (None, None)]
    kept = decontaminate.clean_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], ITEMS))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, "clean too"), (1, "clean words only")]


def test_items_without_id_hit_words_as_in_the_sql(spark, tmp_path):
    docs = [(1, "one two three four"), (2, "one five"), (3, "six")]
    items = [(None, "one two"), (None, "five"), (7, "four"), (None, None)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted(tuple(r) for r in decontaminate.op2_decontaminate(spark, str(tmp_path)).collect())
    with duckdb.connect() as own:
        for name in ("documents", "benchmark"):
            own.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
        assert found == sorted(own.execute(decontaminate.ORACLE).fetchall())
    assert [row[2:4] for row in found] == [(3, 2), (1, 1), (0, 0)]
    kept = decontaminate.clean_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert [r.doc_id for r in kept.collect()] == [3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], DOCS)
    none, nothing = spark.createDataFrame([], ITEMS), spark.createDataFrame([], DOCS)
    assert digest(decontaminate.contamination(docs, none)) == plain([(1, "some words")], [])
    assert decontaminate.contamination(nothing, none).collect() == []
    assert decontaminate.contamination(nothing, spark.createDataFrame([(1, "a b")], ITEMS)).collect() == []
