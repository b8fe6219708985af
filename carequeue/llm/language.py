"""Language identification: text likelihoods fused with declared language, address suffix and host priors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from carequeue.llm.shared import checkpointed, let_go, matching, row_key, table

#: Byte trigrams are hashed to so many places; the weight of the prior of each place.
PLACES = 1 << 16
SMOOTHING = 0.1
#: Neighbouring trigrams say the same twice: a text counts as a share of its trigrams, and as no more than so many.
SHARE, MOST = 0.25, 400.0
#: Weight of the prior of a declared language, of an address suffix and of a host, in rows.
STRENGTH = 20.0
#: A row is rejected if its language has less probability than this, or if it has no letters.
LEAST = 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def _trigrams(text: str) -> np.ndarray:
    """Places of the byte trigrams of a text in lower case."""
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.zeros(0, np.uint32)
    return (data[:-2] * 0x9E5 ^ data[1:-1] * 0x6B1 ^ data[2:]) & (PLACES - 1)


def train(docs: DataFrame, languages: list[str]) -> np.ndarray:
    """Log-likelihoods of trigrams, places x languages, from all rows by their declared language.

    Trigrams are counted by tasks and summed by place and language, so at most places x languages numbers come back.
    """
    number = {language: k for k, language in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        counts = np.zeros((len(languages), PLACES), np.int64)
        for batch in batches:
            for declared, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[number[declared]] += np.bincount(_trigrams(text), minlength=PLACES)
        language, place = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(language.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(counts[language, place])],
            ["language", "place", "n"],
        )

    told = docs.where(F.col("declared").isin(languages) & F.col("text").isNotNull()).select("declared", "text")
    found = told.mapInArrow(run, "language int, place int, n bigint").groupBy("language", "place").agg(F.sum("n").alias("n"))
    counts = np.zeros((PLACES, len(languages)))
    rows_found = found.toArrow()
    counts[rows_found["place"].to_numpy(), rows_found["language"].to_numpy()] = rows_found["n"].to_numpy()
    return np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * PLACES)).astype(np.float32)


def _text_likelihoods(docs: DataFrame, model: np.ndarray, columns: list[str]) -> DataFrame:
    """The columns and `likelihood`: the log-likelihood of the text by language, less the best; null without letters."""
    likelihood = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = likelihood.value
        for batch in batches:
            found = []
            for text in batch.column(len(columns)).to_pylist():
                if not text or not _LETTER.search(text):
                    found.append(None)
                    continue
                places = _trigrams(text)
                weight = min(SHARE * len(places), MOST) / len(places)
                sums = own[places].sum(axis=0, dtype=np.float64) * weight
                found.append((sums - sums.max()).tolist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.list_(pa.float64()))], [*columns, "likelihood"]
            )

    schema = docs.select(*columns).schema.add("likelihood", ArrayType(DoubleType()))
    return docs.select(*columns, "text").mapInArrow(run, schema)


def _sums(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Probability mass of each language, by keys."""
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.get("share", F.lit(k))) for k in range(n))).alias("mass"))


def _smoothed(mass: Column, prior: Column, strength: float) -> Column:
    """Shares of the masses, drawn to the prior as by so many rows."""
    total = F.aggregate(mass, F.lit(0.0), lambda done, x: done + x)
    return F.transform(F.arrays_zip(mass.alias("m"), prior.alias("p")), lambda x: (x["m"] + x["p"] * strength) / (total + strength))


def _declared(docs: DataFrame) -> list[str]:
    declared = docs.where("declared is not null and declared <> ''").select("declared").distinct().orderBy("declared")
    return [row.declared for row in declared.collect()]


def identify(docs: DataFrame, languages: list[str] | None = None, least: float = LEAST) -> DataFrame:
    """(row_id, language, probability, text_language, rejected) for every row of docs (row_id, text, declared, host).

    Bayes' rule over three kinds of evidence: the text's trigrams; the declared language, by how often texts that
    read as each language are declared so; and the host's prior, which is drawn to that of its address suffix (what
    follows the last dot), which is drawn to that of all rows. The last three are sums over all rows of what the texts
    alone say. Null evidence counts as a value of its own. languages: those declared at least once if not given (a
    declared language is an identifier from a small set). Texts without letters have no language and are rejected,
    like rows whose best language has less than the least probability. Repeated rows stay.
    """
    if languages is None:
        languages = _declared(docs)
    kind = docs.schema["row_id"].dataType.simpleString()
    schema = f"row_id {kind}, language string, probability double, text_language string, rejected boolean"
    if not languages:
        none = F.lit(None)
        return docs.select("row_id", F.lit(UNKNOWN).alias("language"), none.cast("double").alias("probability"), none.cast("string").alias("text_language"), F.lit(True).alias("rejected")).to(docs.sparkSession.createDataFrame([], schema).schema)
    n = len(languages)
    model = train(docs, languages)
    evidence = docs.select(
        "row_id",
        F.coalesce("declared", F.lit("")).alias("declared"),
        F.coalesce("host", F.lit("")).alias("host"),
        F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise("").alias("suffix"),
        "text",
    )
    rows = checkpointed(_text_likelihoods(evidence, model, ["row_id", "declared", "host", "suffix"]))
    weights = F.transform("likelihood", F.exp)
    total = F.aggregate(weights, F.lit(0.0), lambda done, x: done + x)
    read = rows.where("likelihood is not null").withColumn("share", F.transform(weights, lambda x: x / total))
    # One row for each host, suffix and declared language; everything else is summed from these.
    cells = checkpointed(_sums(read, ["declared", "host", "suffix"], n).withColumnRenamed("mass", "share"))
    even = F.array(*(F.lit(1.0 / n) for _ in range(n)))
    whole = cells.agg(F.array(*(F.coalesce(F.sum(F.get("share", F.lit(k))), F.lit(0.0)) for k in range(n))).alias("mass"))
    overall = whole.select(_smoothed(F.col("mass"), even, STRENGTH).alias("prior"))
    suffixes = (
        _sums(cells, ["suffix"], n)
        .withColumn("overall", overall.scalar())
        .select("suffix", _smoothed(F.col("mass"), F.col("overall"), STRENGTH).alias("suffix_prior"))
    )
    hosts = (
        _sums(cells, ["host", "suffix"], n)
        .join(suffixes, "suffix")
        .select("host", _smoothed(F.col("mass"), F.col("suffix_prior"), STRENGTH).alias("host_prior"))
    )
    # P(declared | language): the same total for each language, drawn to how often the declaration occurs at all.
    totals = whole.select("mass").scalar()
    every = cells.agg(F.sum(F.aggregate("share", F.lit(0.0), lambda done, x: done + x))).scalar()
    declared = _sums(cells, ["declared"], n)
    often = F.aggregate("mass", F.lit(0.0), lambda done, x: done + x)
    declarations = declared.withColumn("often", often / every).withColumn("totals", totals).select(
        "declared",
        F.transform(
            F.arrays_zip(F.col("mass").alias("m"), F.col("totals").alias("t")),
            lambda x: (x["m"] + F.col("often") * STRENGTH) / (x["t"] + STRENGTH),
        ).alias("told"),
    )
    fused = (
        rows.join(hosts, "host", "left")
        .join(declarations, "declared", "left")
        .withColumn(
            "log",
            F.transform(
                F.arrays_zip("likelihood", "host_prior", "told"),
                lambda x: x["likelihood"] + F.log(x["host_prior"]) + F.log(x["told"]),
            ),
        )
    )
    best, text_best = F.array_position("log", F.array_max("log")), F.array_position("likelihood", F.array_max("likelihood"))
    mass = F.aggregate("log", F.lit(0.0), lambda done, x: done + F.exp(x - F.array_max("log")))
    names = reduce(lambda done, name: [*done, F.lit(name)], languages, [])
    probability = F.lit(1.0) / mass
    known = F.col("log").isNotNull()
    return fused.select(
        "row_id",
        F.when(known, F.get(F.array(*names), (best - 1).cast("int"))).otherwise(UNKNOWN).alias("language"),
        F.when(known, probability).alias("probability"),
        F.when(known, F.get(F.array(*names), (text_best - 1).cast("int"))).alias("text_language"),
        F.when(known, probability < least).otherwise(True).alias("rejected"),
    )


def of_documents(docs: DataFrame) -> DataFrame:
    """Rows (row_id, text, declared, host) of documents: `lang` is what is declared, `source` the host; missing columns are null."""
    have = set(docs.columns)
    column = lambda name: (F.col(name) if name in have else F.lit(None)).cast("string")
    return docs.select(F.col("doc_id").alias("row_id"), "text", column("lang").alias("declared"), column("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Rows (row_id, text, declared, host) of raw pages: the lang attribute of the html tag, the url's host, the text between tags."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]+)", 1)
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z]+://([^/:?#]+)", 1)
    return pages.select(F.col("page_id").alias("row_id"), bare.alias("text"), F.lower(declared).alias("declared"), F.lower(host).alias("host"))


def known_language(docs: DataFrame) -> DataFrame:
    """Docs without those that are rejected, each row judged by its own text, declaration and host, whatever its id.

    Without any declared language there is nothing to judge by: only rows without letters go.
    """
    beside = ("lang", "source")
    rows = of_documents(docs.withColumn("doc_id", row_key(docs, *beside)))
    languages = _declared(rows)
    lettered = rows.where(F.regexp_like("text", F.lit(r"\p{L}")))
    judged = identify(rows, languages).where("not rejected") if languages else lettered
    return matching(docs, judged.select(F.col("row_id").alias("key")).distinct(), "left_semi", *beside)


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents."""
    return identify(of_documents(table(spark, folder, "documents"))).withColumnRenamed("row_id", "doc_id")


def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all pages, from markup, address and text."""
    return identify(of_pages(table(spark, folder, "pages"))).withColumnRenamed("row_id", "page_id")
