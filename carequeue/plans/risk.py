"""No-show risk: features, imputation, a distributed logistic regression and its evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carequeue.functions.expressions import LAG, flag, ratio, risk_bucket, round_to, status
from carequeue.operators.ordered import running_totals
from carequeue.operators.selection import cut_texts
from carequeue.operators.settle import settled, stored
from carequeue.params import Settings
from carequeue.plans.actions import top
from carequeue.plans.linked import linked
from carequeue.plans.views import zip_friction

TARGET = "no_show_target"
PROBABILITY = "predicted_no_show_probability"
# Features, statuses that take part, hold-out share and iterations.
NUMERIC = [
    "days_from_referral_to_appointment",
    "days_from_scheduled_to_appointment",
    "prior_no_show_count",
    "zip_access_friction_score",
]
CATEGORICAL = [
    "appointment_type",
    "visit_mode",
    "insurance_type",
    "age_group",
    "transportation_risk_flag",
    "clinic_id",
    "referral_priority",
]
OUTCOMES = ["completed", "no_show", "canceled", "rescheduled"]
TEST_SHARE = 0.25
MAX_ITERATIONS = 1000
#: What decides whether a row is held out; rows without an id share one.
ID_HASH = "md5(coalesce(CAST(appointment_id AS STRING), ''))"
TOP_RISKS = 50
MODEL_NOTE = (
    "For operational outreach prioritization only. "
    "Not for diagnosis, treatment, eligibility, or clinical decision-making."
)


class NoTrainingData(ValueError):
    """There are no appointments to learn from."""


def feature_table(
    mart, settings: Settings = Settings(), friction: DataFrame | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per appointment with an outcome: the target and eleven features, or those of them named.

    ZIP codes are only scored if their score is among the features.
    """
    listed = ", ".join(f"'{name}'" for name in OUTCOMES)
    features = [*NUMERIC, *CATEGORICAL] if columns is None else columns
    scored, scores = "zip_access_friction_score" in features, None
    if scored:
        friction = zip_friction(mart, settings) if friction is None else friction
        scores = friction.selectExpr("zip_code", "access_friction_score AS zip_access_friction_score")
    rows = linked(
        _Outcomes(mart, scores, f"appointment_status IN ({listed})"),
        appointment=[
            "appointment_id",
            "appointment_status",
            "appointment_date",
            "appointment_scheduled_date",
            "appointment_type",
            "visit_mode",
            "clinic_id",
        ],
        referral=["referral_created_date", "referral_priority"],
        patient=[
            "prior_no_show_count",
            "insurance_type",
            "age_group",
            "transportation_risk_flag",
            *(["zip_access_friction_score"] if scored else []),
        ],
    )
    found = rows.selectExpr(
        "appointment_id",
        f"{status('no_show')} AS {TARGET}",
        f"CAST({LAG} AS BIGINT) AS days_from_referral_to_appointment",
        "CAST(datediff(appointment_date, appointment_scheduled_date) AS BIGINT) AS days_from_scheduled_to_appointment",
        "prior_no_show_count",
        "appointment_type",
        "visit_mode",
        "insurance_type",
        "age_group",
        "transportation_risk_flag",
        *(["zip_access_friction_score"] if scored else []),
        "clinic_id",
        "referral_priority",
    )
    return found if columns is None else found.select("appointment_id", TARGET, *columns)


class _Outcomes:
    """A mart limited to some appointments, whose patients carry their ZIP's friction score."""

    def __init__(self, mart, scores: DataFrame | None, rows: str):
        self.mart, self.scores, self.rows = mart, scores, rows
        self.patient_from_referral = mart.patient_from_referral

    def table(self, role: str, *columns: str) -> DataFrame:
        if role == "appointment":
            return self.mart.table(role, *columns).where(self.rows)
        if role != "patient" or self.scores is None:
            return self.mart.table(role, *columns)
        own = [name for name in columns if name != "zip_access_friction_score"]
        return (
            self.mart.table(role, *dict.fromkeys([*own, "zip_code"]))
            .join(self.scores, "zip_code", "left")
            .select(*columns)
        )


def fill_values(features: DataFrame) -> DataFrame:
    """One row: the median of each numeric feature and the most frequent value of each other one.

    Every feature is first counted by value in one aggregate over grouping sets, combined on the
    map side; only those counts, as many as there are different values, are looked at afterwards.
    Ties between most frequent values go to the smallest.
    """
    columns = [*NUMERIC, *CATEGORICAL]
    sets = ", ".join(f"({name})" for name in columns)
    counted = f"""SELECT {', '.join(columns)}, grouping_id({', '.join(columns)}) AS _set, count(*) AS _rows
                  FROM {{features}} GROUP BY GROUPING SETS ({sets})"""
    features = _typed(features)
    picks = []
    for i, name in enumerate(columns):
        only = f"_set = {2 ** len(columns) - 1 - 2 ** (len(columns) - 1 - i)} AND {name} IS NOT NULL"
        if name in NUMERIC:
            picks.append(f"percentile({name}, 0.5D, CASE WHEN {only} THEN _rows END) AS {name}")
        else:
            picks.append(f"min_by({name}, struct(-_rows, {name})) FILTER (WHERE {only}) AS {name}")
    return features.sparkSession.sql(f"SELECT {', '.join(picks)} FROM ({counted})", features=features)


def impute(features: DataFrame, fill: DataFrame | None = None) -> DataFrame:
    """Features with missing numbers set to the median and missing categories to the commonest.

    ``fill`` is the row of values to use, by default those of the features themselves.
    """
    values = (fill if fill is not None else fill_values(features)).first().asDict()
    return _typed(features).fillna({name: value for name, value in values.items() if value is not None})


def _typed(features: DataFrame) -> DataFrame:
    """Numbers as doubles and categories as text, so that any fill value fits its column."""
    types = dict.fromkeys(NUMERIC, "DOUBLE") | dict.fromkeys(CATEGORICAL, "STRING")
    return features.selectExpr(
        *[f"CAST({name} AS {types[name]}) AS {name}" if name in types else name for name in features.columns]
    )


def hold_out_sizes(rows: dict[int, int], share: float = TEST_SHARE) -> dict[int, int]:
    """Hold-out rows of each class: the share of all rows, rounded up, in proportion to the classes.

    Each class gets the whole part of its share; rows left over go to the largest remainders, the smaller class first.
    """
    total = sum(rows.values())
    taken = math.ceil(share * total)
    sizes = {key: n * taken // total for key, n in rows.items()}
    by_remainder = sorted(rows, key=lambda key: (-(rows[key] * taken % total), key))
    for key in by_remainder[: taken - sum(sizes.values())]:
        sizes[key] += 1
    return sizes


def hold_out(features: DataFrame, share: float = TEST_SHARE) -> str:
    """The test, as SQL text, that a row of ``features`` is in the stratified hold-out part.

    Of each class the rows with the least hashes of their id are held out, as many as its share: the same rows in every
    run, whatever the partitions. The features are read a few times over, so they should be stored; see ``cut_texts``.
    """
    counts = {row[TARGET]: row.n for row in features.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return "FALSE"
    cuts = cut_texts(features, TARGET, ID_HASH, hold_out_sizes(counts, share))
    below = " ".join(f"WHEN {key} THEN {ID_HASH} < '{cut}'" for key, cut in sorted(cuts.items()))
    return f"(CASE {TARGET} {below} END)"


def split_counts(features: DataFrame) -> DataFrame:
    """Rows per class in the training and the hold-out part."""
    return features.sparkSession.sql(
        f"""SELECT CASE WHEN {hold_out(features)} THEN 'test' ELSE 'train' END AS split, {TARGET},
                   count(*) AS row_count
            FROM {{features}} GROUP BY 1, 2""",
        features=features,
    )


@dataclass(frozen=True)
class RiskModel:
    """A fitted pipeline and the row of values that missing features get."""

    pipeline: PipelineModel
    fill: DataFrame
    #: The features it was trained on, and those filled in, with their vectors and whether they were held out, as written on the way.
    features: DataFrame | None = None
    rows: DataFrame | None = None

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        self.fill.write.mode("overwrite").parquet(f"{path}/fill")

    @staticmethod
    def load(spark: SparkSession, path: str) -> RiskModel:
        return RiskModel(PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/fill"))


def training_part(features: DataFrame, model: RiskModel | None = None) -> tuple[DataFrame, DataFrame]:
    """The imputed rows that models learn from, and the row of values that were filled in, taken from them alone.

    ``features`` should be stored: training rows are not written again but filled in whenever they are read. Those a
    ``model`` has learned from are at hand.
    """
    if model is not None and model.features is features:
        return model.rows.where("NOT _held_out").select(*features.columns), model.fill
    part = features.where(f"NOT {hold_out(features)}")
    fill = settled(fill_values(part))
    return impute(part, fill), fill


def class_weights(learn: DataFrame) -> DataFrame:
    """Rows of each class, and the weight that makes all classes count the same in sum."""
    return learn.sparkSession.sql(
        f"""SELECT {TARGET}, row_count, total / (classes * CAST(row_count AS DOUBLE)) AS class_weight
            FROM (SELECT *, (SELECT sum(row_count) FROM {{counts}}) AS total, (SELECT count(*) FROM {{counts}}) AS classes
                  FROM {{counts}})""",
        counts=settled(learn.groupBy(TARGET).agg(F.count(F.lit(1)).alias("row_count"))),
    )


def scaling(learn: DataFrame) -> DataFrame:
    """Mean and population deviation of each numeric feature."""
    measures = ", ".join(f"avg({name}) AS {name}_mean, stddev_pop({name}) AS {name}_deviation" for name in NUMERIC)
    stacked = ", ".join(f"'{name}', {name}_mean, {name}_deviation" for name in NUMERIC)
    return learn.sparkSession.sql(
        f"SELECT stack({len(NUMERIC)}, {stacked}) AS (feature, mean, deviation) FROM (SELECT {measures} FROM {{learn}})",
        learn=learn,
    )


def _weight(classes: Sequence) -> str:
    return "CASE " + " ".join(f"WHEN {TARGET} = {row[TARGET]} THEN {row.class_weight!r}D" for row in classes) + " END"


def train(features: DataFrame) -> RiskModel:
    """Impute, scale, one-hot encode and fit a class-balanced logistic regression on the training part of stored features.

    Rows are filled in and written once, and encoded as vectors and written once, all of them: the fit reads vectors
    alone, and scores of the same rows need not encode them again.
    """
    held_out = hold_out(features)
    fill = settled(fill_values(features.where(f"NOT {held_out}")))
    filled = stored(impute(features.selectExpr("*", f"{held_out} AS _held_out"), fill))
    learn = filled.where("NOT _held_out")
    # Two classes and four numeric features, so as many rows.
    classes = class_weights(learn).collect()
    if not classes:
        raise NoTrainingData("No appointment data found: load appointments before training")
    total = sum(row.row_count for row in classes)
    scaled = ", ".join(
        f"({row.feature} - {row.mean!r}D) / {row.deviation or 1.0!r}D AS _{row.feature}_scaled" for row in scaling(learn).collect()
    )
    stages = [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        StringIndexer(inputCols=CATEGORICAL, outputCols=[f"_{c}_index" for c in CATEGORICAL], handleInvalid="keep"),
        # The index kept for unseen values is the dropped one: an unseen value encodes as zeros.
        OneHotEncoder(
            inputCols=[f"_{c}_index" for c in CATEGORICAL],
            outputCols=[f"_{c}_hot" for c in CATEGORICAL],
            dropLast=True,
        ),
        VectorAssembler(inputCols=[*[f"_{n}_scaled" for n in NUMERIC], *[f"_{c}_hot" for c in CATEGORICAL]], outputCol="features"),
    ]
    regression = LogisticRegression(
        labelCol=TARGET,
        weightCol="_weight",
        maxIter=MAX_ITERATIONS,
        regParam=1.0 / total,
        standardization=False,
    )
    encoding = Pipeline(stages=stages).fit(learn)
    rows = stored(encoding.transform(filled).select(*filled.columns, "features"))
    fitted = regression.fit(rows.where("NOT _held_out").selectExpr("features", TARGET, f"{_weight(classes)} AS _weight"))
    return RiskModel(PipelineModel([*encoding.stages, fitted]), fill, features, rows)


def scored(model: RiskModel, features: DataFrame) -> DataFrame:
    """The rows filled in, with their probability; those the model was trained on are encoded already."""
    if model.features is features:
        rows = model.pipeline.stages[-1].transform(model.rows)
    else:
        rows = model.pipeline.transform(impute(features, model.fill))
    return rows.select(*features.columns, vector_to_array("probability")[1].alias(PROBABILITY))


def score(model: RiskModel, features: DataFrame) -> DataFrame:
    """(appointment, target, probability, bucket) of every row, training rows included."""
    return scored(model, features).selectExpr(
        "appointment_id", TARGET, PROBABILITY, f"{risk_bucket(PROBABILITY)} AS risk_bucket"
    )


def coefficients(model: RiskModel) -> DataFrame:
    """(feature, value, coefficient) of the fitted model: one row for the intercept, each numeric feature, and each value of
    the others. As many rows as the dimensions have values."""
    _, indexer, _, _, regression = model.pipeline.stages
    names = [(name, None) for name in NUMERIC]
    names += [(name, value) for name, values in zip(CATEGORICAL, indexer.labelsArray, strict=True) for value in values]
    rows = [("intercept", None, float(regression.intercept))]
    rows += [(*name, float(own)) for name, own in zip(names, regression.coefficients, strict=True)]
    return stored(model.fill.sparkSession.createDataFrame(rows, "feature string, value string, coefficient double"))


def encoded(rows: DataFrame, scaling_of: DataFrame) -> DataFrame:
    """Rows laid out as (feature, value, x) beside their other columns: what each coefficient is multiplied by."""
    moments = {row.feature: row for row in scaling_of.collect()}
    cells = ["struct('intercept' AS feature, CAST(NULL AS STRING) AS value, 1D AS x)"]
    cells += [f"struct('{n}' AS feature, CAST(NULL AS STRING) AS value, ({n} - {moments[n].mean!r}D) / {moments[n].deviation or 1.0!r}D AS x)" for n in NUMERIC]
    cells += [f"struct('{name}' AS feature, {name} AS value, CASE WHEN {name} IS NOT NULL THEN 1D END AS x)" for name in CATEGORICAL]
    others = [name for name in rows.columns if name not in (*NUMERIC, *CATEGORICAL)]
    return rows.selectExpr(*others, f"inline(array({', '.join(cells)}))").where("x IS NOT NULL")


def optimality(model: RiskModel, features: DataFrame) -> DataFrame:
    """(feature, value, coefficient, residual): how far each coefficient is from where the loss is least.

    The loss, a weighted mean over the training rows and a penalty on all coefficients but the intercept, is strictly
    convex. So the fit is the best one if and only if its gradient, sum of w (p - y) x over sum of w, plus the
    penalty's slope is zero for every coefficient. One grouped aggregate over the encoded rows, combined on the map side.
    """
    learn, _ = training_part(features, model)
    weight = _weight(class_weights(learn).collect())
    if model.features is features:
        probability = model.pipeline.stages[-1].transform(model.rows.where("NOT _held_out"))
    else:
        probability = model.pipeline.transform(learn)
    probability = probability.select(TARGET, *NUMERIC, *CATEGORICAL, vector_to_array("probability")[1].alias("_p"))
    errors = probability.selectExpr("*", f"{weight} AS _w").selectExpr("*", f"_w * (_p - {TARGET}) AS _error")
    slopes = encoded(errors.drop("_p", "_w", TARGET), scaling(learn)).groupBy("feature", "value").agg(F.sum(F.expr("_error * x")).alias("slope"))
    regression = model.pipeline.stages[-1]
    return features.sparkSession.sql(
        f"""SELECT c.feature, c.value, coefficient,
                   abs(slope / (SELECT sum(_w) FROM {{errors}})
                       + CASE WHEN c.feature = 'intercept' THEN 0D ELSE {regression.getRegParam()!r}D * coefficient END) AS residual
            FROM {{fitted}} c LEFT JOIN {{slopes}} s ON c.feature = s.feature AND c.value <=> s.value""",
        fitted=coefficients(model),
        slopes=slopes,
        errors=errors,
    )


def predictions(scored: DataFrame) -> DataFrame:
    return scored.select("appointment_id", PROBABILITY, "risk_bucket")


def classification_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1 and confusion counts in one row; 0 instead of 0/0."""
    hit = f"{PROBABILITY} > {float(threshold)!r}D"
    cells = {
        "true_negatives": f"{TARGET} = 0 AND NOT {hit}",
        "false_positives": f"{TARGET} = 0 AND {hit}",
        "false_negatives": f"{TARGET} = 1 AND NOT {hit}",
        "true_positives": f"{TARGET} = 1 AND {hit}",
    }
    counts = scored.selectExpr(*[f"coalesce(sum({flag(test)}), 0L) AS {name}" for name, test in cells.items()])
    correct, everything = "(true_positives + true_negatives)", " + ".join(cells)
    measures = {
        "accuracy": (correct, f"({everything})"),
        "precision": ("true_positives", "(true_positives + false_positives)"),
        "recall": ("true_positives", "(true_positives + false_negatives)"),
        "f1": ("(2 * true_positives)", "(2 * true_positives + false_positives + false_negatives)"),
    }
    return counts.selectExpr(
        *[f"coalesce({round_to(ratio(*parts), 4)}, 0D) AS {name}" for name, parts in measures.items()], *cells
    )


def area_under_curve(scored: DataFrame) -> DataFrame:
    """One row: the exact area under the ROC curve, null if a class is missing.

    The share of pairs of a positive and a negative row that the scores order rightly, equal scores counting half. Rows
    are first counted by score; a score's positives then beat the negatives below it, a running total.
    """
    counted = scored.groupBy(PROBABILITY).agg(
        F.count_if(F.col(TARGET) == 1).alias("positives"), F.count_if(F.col(TARGET) == 0).alias("negatives")
    )
    return scored.sparkSession.sql(
        """SELECT sum(positives * (negatives_before + negatives / 2D))
                  / nullif(CAST(sum(positives) AS DOUBLE) * sum(negatives), 0D) AS roc_auc FROM {counted}""",
        counted=running_totals(counted, [PROBABILITY], ["negatives"]),
    )


def roc_auc(scored: DataFrame) -> float | None:
    """The area under the ROC curve as a number."""
    return area_under_curve(scored).first().roc_auc


def metrics_document(scored: DataFrame) -> DataFrame:
    """The hold-out metrics in one nested row, for the JSON sink."""
    held_out = scored.where(hold_out(scored))
    area = roc_auc(held_out)
    return classification_metrics(held_out).selectExpr(
        "accuracy",
        "precision",
        "recall",
        "f1",
        "CAST(NULL AS DOUBLE) AS roc_auc" if area is None else f"{round(area, 4)!r}D AS roc_auc",
        "array(array(true_negatives, false_positives), array(false_negatives, true_positives)) AS confusion_matrix",
        f"'{MODEL_NOTE}' AS model_note",
    )


def bucket_summary(scored: DataFrame) -> DataFrame:
    """Appointments per risk bucket."""
    return scored.groupBy("risk_bucket").agg(F.count(F.lit(1)).alias("appointment_count"))


def score_histogram(scored: DataFrame, bins: int = 20) -> DataFrame:
    """Appointments per probability bin and bucket."""
    return scored.sparkSession.sql(
        f"""SELECT least(CAST(floor({PROBABILITY} * {int(bins)}) AS INT), {int(bins) - 1}) AS bin, risk_bucket,
                   count(*) AS appointment_count
            FROM {{rows}} GROUP BY 1, 2""",
        rows=scored,
    )


def top_risks(scored: DataFrame, rows: int = TOP_RISKS) -> DataFrame:
    """The appointments most likely to be missed."""
    return top(predictions(scored), rows, (PROBABILITY, False), ("appointment_id", True))
