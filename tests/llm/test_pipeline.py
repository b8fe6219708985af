import hashlib
import re

import public_tokenizers
import tiktoken

import corpus_pipeline
from carequeue.llm import bpe
from carequeue.llm.shared import written
from tests.conftest import SMALL
from tests.llm.test_decontaminate import plain as contamination
from tests.llm.test_secrets import PLAIN
from tests.llm.test_simhash import plain_components, plain_print

LIBRARY = tiktoken.Encoding(
    "own",
    pat_str=public_tokenizers.PATTERN,
    mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.RANKS)),
    special_tokens={},
)


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], SMALL)))
        if name != "bpe_round_trip":
            assert seen[-1].columns == docs.columns, name
    texts = [{r.doc_id: r.text for r in frame.select("doc_id", "text").collect()} for frame in seen[:-1]]
    assert len(texts[1]) >= 0.99 * len(texts[0])
    groups = plain_components({i: plain_print(t) for i, t in texts[1].items()})
    assert set(texts[2]) == set(groups.values())
    clean = {row[0] for row in contamination(list(texts[2].items()), items) if not row[5]}
    assert set(texts[3]) == clean < set(texts[2])
    assert set(texts[4]) == clean
    for i, text in texts[4].items():
        assert text == texts[3][i] or "<secret>" in text
        for pattern, group, least in PLAIN.values():
            assert all(len(m[group]) < least for m in pattern.finditer(text))
    for r in seen[-1].collect():
        ids = LIBRARY.encode_ordinary(texts[4][r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[4][r.doc_id].encode()).hexdigest()
    # Language is judged, not the declared one: a wordless text has none.
    assert all(re.search(r"[^\W\d_]", t) for t in texts[1].values())


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    english = "the quick brown fox jumps over the lazy dog number"
    rows = [(i, f"{english} {i} " + " ".join(hashlib.sha256(bytes([i])).hexdigest()[:16]), "en", "s", 1) for i in range(8)]
    rows += [(8, None, None, None, None), (9, "", "en", "s", 0), (None, None, None, None, None), (None, english, None, "s", 2), (0, *rows[0][1:])]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # Of the rows without id the one without text goes and the one with text stays.
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in found) == [-1, *range(8)]
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
