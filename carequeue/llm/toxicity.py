"""Toxicity by non-negative positive-unlabelled learning over words and beginnings of words."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.llm.shared import table

#: Training rows, chosen by a hash of their id: confirmed toxic documents, and documents taken without a label.
POSITIVES = 6_000
UNLABELLED = 12_000
#: Features are hashed to so many places; a kept one is in this many toxic examples, in this share of them, and so much
#: more frequent there.
PLACES = 1 << 22
LEAST_DOCUMENTS = 5
LEAST_SHARE = 0.01
LEAST_LIFT = 4.0
PREFIXES = (4, 5)
THRESHOLD = 0.3
STEPS = 400
RATE = 0.05
RIDGE = 1e-4
WORDS = 300_000

_WORD = re.compile(r"\w+")


def _places(word: str) -> list[int]:
    parts = [word, *("^" + word[:n] for n in PREFIXES if len(word) > n)]
    return [zlib.crc32(part.encode()) & (PLACES - 1) for part in parts]


def features(text: str) -> np.ndarray:
    """Places of the words of a text and of their beginnings, each once."""
    found = {place for word in set(_WORD.findall(text.lower())) for place in _places(word)}
    return np.fromiter(found, np.int32, len(found))


@dataclass(frozen=True)
class Model:
    """A bias and the weights of the features that count."""

    bias: float
    weights: dict[int, float]

    def scores(self, texts: Iterable[str]) -> Iterator[float]:
        """Probability of each text. Each feature counts once in a text."""
        known: dict[str, tuple[int, ...]] = {}
        weights = self.weights
        for text in texts:
            if len(known) > WORDS:
                known.clear()
            found: set[int] = set()
            for word in set(_WORD.findall(text.lower())):
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple(place for place in _places(word) if place in weights)
                if own:
                    found.update(own)
            margin = self.bias + sum(weights[place] for place in sorted(found))
            yield float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


class _Rows:
    """Rows of a 0/1 matrix by their places."""

    def __init__(self, rows: list[np.ndarray], columns: np.ndarray):
        kept = [np.searchsorted(columns, row[np.isin(row, columns, assume_unique=True)]) for row in rows]
        self.n, self.m = len(rows), len(columns)
        self.row = np.repeat(np.arange(self.n), [len(row) for row in kept])
        self.column = np.concatenate([np.zeros(0, np.int64), *kept]).astype(np.int64)

    def margins(self, weights: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.row, weights[self.column], self.n)

    def pulled(self, slopes: np.ndarray) -> np.ndarray:
        """Gradient of the weights and of the bias, last, for the rows' slopes."""
        return np.append(np.bincount(self.column, slopes[self.row], self.m), slopes.sum())


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _loss(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, -z)


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Linear classifier of least non-negative positive-unlabelled risk, by Adam steps over the whole sample.

    With class prior p the risk is p E+[l(g)] + max(0, Eu[l(-g)] - p E+[l(-g)]), l logistic. Where the bracket is
    negative, steps go up it, so that the unlabelled toxic texts are not learned as harmless.
    """
    if not positive or not unlabelled:
        return Model(-500.0, {})
    counts = [np.bincount(np.concatenate(rows), minlength=PLACES) if rows else None for rows in (positive, unlabelled)]
    lift = (counts[0] / len(positive)) / ((counts[1] + 1) / len(unlabelled))
    columns = np.nonzero((counts[0] >= max(LEAST_DOCUMENTS, LEAST_SHARE * len(positive))) & (lift >= LEAST_LIFT))[0]
    p, u = _Rows(positive, columns), _Rows(unlabelled, columns)
    at = np.zeros(len(columns) + 1)
    at[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, STEPS + 1):
        zp, zu = p.margins(at[:-1], at[-1]), u.margins(at[:-1], at[-1])
        harmless = _loss(-zu).mean() - prior * _loss(-zp).mean()
        pull_harmless = u.pulled(_sigmoid(zu) / u.n) - prior * p.pulled(_sigmoid(zp) / p.n)
        gradient = prior * p.pulled(-_sigmoid(-zp) / p.n) + pull_harmless if harmless >= 0 else -pull_harmless
        gradient = gradient + RIDGE * np.append(at[:-1], 0)
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        at = at - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(float(at[-1]), dict(zip(columns.tolist(), at[:-1].tolist())))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learned from; not those without id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _chosen(ids: DataFrame, n: int) -> DataFrame:
    """At most n ids, those of least hash: a filter on the hash leaves about half as many again, then they are ordered."""
    total = max(ids.count(), 1)
    share = min(1_000_000, int(1_500_000 * n / total) + 1)
    hashed = ids.select("doc_id", F.xxhash64("doc_id").alias("hash")).where(F.pmod("hash", F.lit(1_000_000)) < share)
    return hashed.orderBy(F.pmod("hash", F.lit(1_000_000)), "doc_id").limit(n).select("doc_id")


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learn from bounded samples: at most `positives` toxic and `unlabelled` other documents' features come to the driver.

    Labels of held-out rows take no part. The class prior is the toxic share of the other labelled rows. A document is
    toxic if any of its labels says so; null labels and labels without a document are left out.
    """
    told = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    prior = told.agg(F.avg("toxic")).first()[0] or 0.0
    toxic = _chosen(told.where("toxic = 1"), positives).withColumn("toxic", F.lit(1))
    others = _chosen(docs.where("doc_id is not null").where(~held_out()).select("doc_id"), unlabelled).withColumn("toxic", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [features(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.list_(pa.int32()))], ["toxic", "places"])

    # The sample's size has a bound, so it may be broadcast and the texts stay where they are.
    sample = docs.select("doc_id", "text").join(F.broadcast(toxic.union(others)), "doc_id").select("toxic", "text")
    found = sample.mapInArrow(run, "toxic int, places array<int>").toArrow()
    rows = [np.asarray(own.values) for own in found["places"]]
    marks = found["toxic"].to_numpy() == 1
    if not 0 < prior < 1:
        return Model(-500.0, {})
    return fit([r for r, t in zip(rows, marks) if t], [r for r, t in zip(rows, marks) if not t], prior)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text); labels (doc_id, toxic) teach.

    Only the text is an input of the score. Null and empty texts get the score of a text without words. Repeated rows
    and rows without id are scored like others. Without toxic and other examples every score is about 0. Other columns
    are ignored.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = list(model.scores(text or "" for text in batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of all documents."""
    return score_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
