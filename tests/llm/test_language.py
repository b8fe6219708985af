from pyspark.sql import functions as F

from carequeue.llm import language
from tests.conftest import SMALL

SCHEMA = "row_id bigint, text string, declared string, host string"
ENGLISH = "the quick brown fox jumps over the lazy dog and runs away from all of this"
GERMAN = "der schnelle braune fuchs springt über den faulen hund und läuft davon weg"


def rows():
    out = [(i, f"{ENGLISH} {i}", "en", "a.example.com") for i in range(60)]
    return out + [(100 + i, f"{GERMAN} {i}", "de", "b.example.de") for i in range(60)]


def test_given_documents_and_pages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = language.op8_language(spark, SMALL).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == docs.count()
    assert sum(r.language == r.lang for r in found) >= 0.97 * len(found)
    assert sum(r.rejected for r in found) <= 0.01 * len(found)
    pages = language.language_of_pages(spark, SMALL).collect()
    assert len(pages) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert not any(r.rejected for r in pages)


def test_evidence_is_fused(spark):
    odd = [
        (900, ENGLISH, "de", "b.example.de"),  # a long text outweighs a false declaration
        (901, "ok", "de", "b.example.de"),  # a short one does not
        (902, "ok", None, "a.example.com"),
        (903, "ok", None, "new.example.de"),  # an unseen host has its suffix's prior
    ]
    found = {r.row_id: r for r in language.identify(spark.createDataFrame(rows() + odd, SCHEMA)).collect()}
    assert [found[i].language for i in (0, 100, 900, 901, 902, 903)] == ["en", "de", "en", "de", "en", "de"]
    assert found[0].probability > 0.99


def test_odd_rows(spark):
    odd = [(900, None, "en", "x"), (901, "", None, None), (902, "123 !!", "de", ""), (None, ENGLISH, None, None), (None, ENGLISH, None, None), (903, "wörter " * 50_000, "de", "b.example.de")]
    docs = spark.createDataFrame(rows() + odd, SCHEMA).withColumn("likelihood", F.lit(1)).withColumn("language", F.lit("q"))
    found = language.identify(docs).collect()
    by = {r.row_id: r for r in found}
    assert len(found) == 126
    for i in (900, 901, 902):
        assert (by[i].language, by[i].probability, by[i].rejected) == ("und", None, True)
    assert [r.language for r in found if r.row_id is None] == ["en", "en"] and by[903].language == "de"
    none = docs.limit(0)
    assert language.identify(none).collect() == []
    untold = spark.createDataFrame([(1, ENGLISH, None, None)], SCHEMA)
    assert [(r.language, r.rejected) for r in language.identify(untold).collect()] == [("und", True)]


def test_a_language_of_few_rows_is_learned_from_a_large_table(spark):
    many = spark.range(60_000).selectExpr("id AS row_id", f"concat('{ENGLISH} ', id) AS text", "'en' AS declared", "'a.example.com' AS host")
    few = spark.createDataFrame([(-1, GERMAN, "de", "b.example.de")], SCHEMA)
    model = language.train(many.union(few), ["de", "en"])
    places = language._trigrams(GERMAN)
    assert model[places, 0].sum() > model[places, 1].sum() + 100


def test_stage_keeps_rows_if_no_language_is_declared(spark):
    docs = spark.createDataFrame([(1, ENGLISH, None), (2, "12 ..", None), (3, "ж", None), (4, None, None)], "doc_id bigint, text string, lang string")
    assert sorted(r.doc_id for r in language.known_language(docs).collect()) == [1, 3]


def test_stage_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame(
        [(1, ENGLISH, "en", "s", 10), (2, "...", "en", "s", 3), (None, "??", None, "s", 2), (3, ENGLISH, "en", "s", 1), (3, ENGLISH, "en", "s", 1)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    kept = language.known_language(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [1, 3, 3]
    both = docs.union(spark.createDataFrame([(1, "12 !", "en", "s", 4), (None, ENGLISH, "en", "s", 9)], docs.schema))
    assert sorted((r.doc_id or 0, r.text) for r in language.known_language(both).collect()) == [(0, ENGLISH), (1, ENGLISH), (3, ENGLISH), (3, ENGLISH)]
