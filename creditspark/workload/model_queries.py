"""Imputation, scaling, model fits and explanations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from creditspark import schema
from creditspark.models import boosting, explain, preprocessing, sicr, training
from creditspark.operators import sampling
from creditspark.plans.loans import model_rows
from creditspark.scale import scratch_dir
from creditspark.sources import read_table, write_table
from creditspark.workload import tables as t
from creditspark.workload.cleaning_queries import ID, LOAN_MONTH
from creditspark.workload.registry import query

FEATURES = schema.ORIGINATION_FEATURES + schema.BEHAVIOUR_FEATURES
#: Training rows of the registered tree fits at most, an exact sample by key; parameters are the library's defaults.
TREE_ROWS = 30_000
OPTIONS = {k: {"max_rows": TREE_ROWS, "keys": ID} for k in ("gbt", "random_forest")} | {"logistic": {}}
_kept: dict[tuple, object] = {}


def _once(spark, sf, name, make):
    """A stored table or a fit that several queries of a session share."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget():
    """Fit anew from here on."""
    _kept.clear()


def rows(spark, sf):
    """The modelling table, written once per session and read back by part."""
    def make():
        path = f"{scratch_dir(spark)}/dataset-{uuid.uuid4().hex}"
        split = model_rows(t.dataset(spark, sf, with_macro=False)).filter(F.col("split").isNotNull())
        write_table(split, path, partition_by=["split"], gather=False)  # three values
        return path

    return read_table(spark, _once(spark, sf, "rows", make))


def parts(spark, sf):
    data = rows(spark, sf)
    return [data.filter(F.col("split") == s) for s in ("train", "validation", "test")]


def fitted(spark, sf, kind):
    train, validation, _test = parts(spark, sf)
    return _once(spark, sf, kind, lambda: training.fit_calibrated(train, validation, FEATURES, kind, **OPTIONS[kind]))


IMPUTED = ["credit_score", "original_ltv", "original_dti", "estimated_loan_to_value_eltv", "dpd_numerico"]
TRAIN = "(SELECT * FROM panel WHERE vintage_year BETWEEN 2016 AND 2020)"


def _typed(spark, sf):
    return t.panel(spark, sf).withColumn(
        "dpd_numerico", F.expr("try_cast(current_loan_delinquency_status AS double)"))


TYPED = "SELECT *, TRY_CAST(current_loan_delinquency_status AS DOUBLE) AS dpd_numerico FROM panel"


def _train(df):
    return df.filter(F.col("vintage_year").isin(schema.TRAIN_VINTAGES))


@query("impute_median", f"""
SELECT {LOAN_MONTH}, {', '.join(
    f'coalesce({c}, (SELECT median({c}) FROM typed WHERE vintage_year BETWEEN 2016 AND 2020)) AS {c}' for c in IMPUTED)}
FROM typed""", typed=TYPED)
def _(spark, sf):
    df = _typed(spark, sf)
    medians = preprocessing.fit_medians(_train(df), IMPUTED)
    return preprocessing.impute(df, medians).select(*ID, *IMPUTED)


SCALED = ["credit_score", "original_upb", "current_actual_upb", "loan_age"]


@query("standardize", f"""
SELECT {LOAN_MONTH}, {', '.join(
    f'round(({c} - (SELECT avg({c}) FROM {TRAIN})) / (SELECT stddev_pop({c}) FROM {TRAIN}), 6) AS z_{c}' for c in SCALED)}
FROM panel""")
def _(spark, sf):
    df = t.panel(spark, sf)
    stats = preprocessing.fit_scaler(_train(df), {c: F.col(c).cast("double") for c in SCALED})
    scaled = preprocessing.standardize(df, stats)
    return scaled.select(*ID, *[F.round(f"z_{c}", 6).alias(f"z_{c}") for c in SCALED])


def _fit_and_score(kind):
    def run(spark, sf):
        model = fitted(spark, sf, kind)
        return training.score(model, parts(spark, sf)[2], raw="pd_raw").select(*ID, "label", "pd_raw", "pd")

    return run


query("train_logistic")(_fit_and_score("logistic"))
query("train_gbt")(_fit_and_score("gbt"))
query("train_random_forest")(_fit_and_score("random_forest"))


#: Trees of the registered second-order fit, which reads all training rows once per level.
SECOND_ORDER_TREES = 25


@query("train_boosted")
def _(spark, sf):
    train, _validation, test = parts(spark, sf)
    model = _once(spark, sf, "boosted", lambda: boosting.fit_boosted(train, FEATURES, keys=ID, trees=SECOND_ORDER_TREES))
    return model.score(test.select(*ID, "label", *[c for c in FEATURES if c not in ID])).select(*ID, "label", "pd")


EDGES = {"credit_score": [620, 660, 700, 740, 780], "original_ltv": [60, 70, 80, 90], "original_dti": [20, 30, 40, 50], "loan_age": [6, 12, 24, 48]}


@query("boosting_root_splits", """
SELECT variable, arg_min(split, (-round(gain, 9), split)) AS split, round(max(gain), 6) AS gain
FROM (SELECT *, 0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain FROM sides)
WHERE hl >= 1 AND h - hl >= 1 GROUP BY 1""",
       labelled_rows=f"SELECT * FROM ({TYPED}) WHERE dpd_numerico IS NOT NULL",
       values_long="\nUNION ALL ".join(
           f"SELECT '{c}' AS variable, CAST(split AS DOUBLE) AS split, coalesce(CAST({c} AS DOUBLE), -999) AS x, CASE WHEN dpd_numerico >= 1 THEN 1 ELSE 0 END AS y "
           f"FROM labelled_rows, unnest({e}) AS u(split)" for c, e in EDGES.items()),
       sides="""
SELECT variable, split, sum(0.5 - y) AS g, sum(0.25) AS h, coalesce(sum(0.5 - y) FILTER (x <= split), 0) AS gl,
  coalesce(sum(0.25) FILTER (x <= split), 0) AS hl
FROM (SELECT variable, split, x, CAST(y AS DOUBLE) AS y FROM values_long) GROUP BY 1, 2""")
def _(spark, sf):
    rows = _typed(spark, sf).withColumn("late", (F.col("dpd_numerico") >= 1).cast("int"))
    return boosting.root_splits(rows, list(EDGES), list(EDGES.values()), "late").withColumn("gain", F.round("gain", 6))


@query("score_calibrated")
def _(spark, sf):
    path = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    training.save_model(fitted(spark, sf, "logistic"), path)
    scored = training.score(training.load_model(path), rows(spark, sf))
    return scored.select(*ID, "split", "label", "pd")


@query("train_evaluate")
def _(spark, sf):
    models = {k: fitted(spark, sf, k) for k in training.KINDS}
    return training.comparison(training.scored_parts(models, rows(spark, sf), FEATURES))


@query("origination_pd")
def _(spark, sf):
    data = rows(spark, sf)
    return training.score(sicr.fit_origination_model(data), data, "pd_origination").select(
        *ID, "split", "pd_origination")


def _explained(spark, sf, n=5_000):
    sample = sampling.stratified_sample(parts(spark, sf)[2], n, ID, ["label"])
    return fitted(spark, sf, "gbt"), sample, f"{scratch_dir(spark)}/trees-{uuid.uuid4().hex}"


@query("gain_importance")
def _(spark, sf):
    return explain.gain_importance(fitted(spark, sf, "gbt"))


@query("top_features")
def _(spark, sf):
    return explain.top_features(explain.gain_importance(fitted(spark, sf, "gbt")), "gain")


# The same tables on given values, so that they have SQL: scores by given coefficients, contributions, their order.
GIVEN = {"credit_score": -0.01, "original_ltv": 0.02, "original_dti": 0.015, "original_interest_rate": 0.3}
_MEANS = ", ".join(f"avg({c}) AS m_{c}" for c in GIVEN)
_PARTS = ", ".join(f"{w} * (coalesce(o.{c}, m_{c}) - m_{c}) AS {c}" for c, w in GIVEN.items())
LINEAR = f"SELECT o.loan_sequence_number, {_PARTS} FROM orig o, (SELECT {_MEANS} FROM orig) m"
LINEAR_LONG = "\nUNION ALL ".join(f"SELECT loan_sequence_number, '{c}' AS variable, {c} AS contribution FROM linear" for c in GIVEN)


def _linear(spark, sf):
    loans = t.origination(spark, sf).select("loan_sequence_number", *GIVEN)
    means = loans.agg(*[F.avg(c).alias(c) for c in GIVEN]).first()
    return loans.select("loan_sequence_number", F.array(*[
        F.lit(w) * (F.coalesce(F.col(c).cast("double"), F.lit(means[c])) - F.lit(means[c])) for c, w in GIVEN.items()]).alias("shap"))


@query("given_importance", """
SELECT variable, round(avg(abs(contribution)), 6) AS mean_abs_shap FROM linear_long GROUP BY 1
ORDER BY avg(abs(contribution)) DESC, variable LIMIT 3""", linear=LINEAR, linear_long=LINEAR_LONG)
def _(spark, sf):
    table = explain.shap_importance(_linear(spark, sf), list(GIVEN))
    return explain.top_features(table, "mean_abs_shap", 3).withColumn("mean_abs_shap", F.round("mean_abs_shap", 6))


@query("given_explanation", f"""
SELECT which, l.loan_sequence_number, variable, round(contribution, 6) AS contribution
FROM linear_long l JOIN (
  SELECT 'highest' AS which, arg_max(loan_sequence_number, (s, loan_sequence_number)) AS loan_sequence_number FROM totals UNION ALL
  SELECT 'lowest', arg_min(loan_sequence_number, (s, loan_sequence_number)) FROM totals) e USING (loan_sequence_number)""",
       linear=LINEAR, linear_long=LINEAR_LONG,
       totals=f"SELECT loan_sequence_number, round({' + '.join(GIVEN)}, 9) AS s FROM linear")
def _(spark, sf):
    rows = _linear(spark, sf)
    total = rows.withColumn("pd", F.round(sum(F.col("shap")[i] for i in range(len(GIVEN))), 9))
    ends = explain.extreme_loans(total, ["loan_sequence_number"])
    chosen = rows.join(F.broadcast(ends.select("which", "loan_sequence_number")), "loan_sequence_number")
    out = explain.contribution_rows(chosen, list(GIVEN), ["which", "loan_sequence_number"])
    return out.withColumn("contribution", F.round("contribution", 6))


@query("shap_importance")
def _(spark, sf):
    model, sample, path = _explained(spark, sf)
    return explain.shap_importance(
        explain.shap_values(model, sample, path), explain.input_names(model))


@query("loan_explanation")
def _(spark, sf):
    model, sample, path = _explained(spark, sf)
    ends = explain.extreme_loans(training.score(model, sample), ID)
    chosen = sample.join(F.broadcast(ends.select("which", *ID)), ID)
    values = explain.shap_values(model, chosen, path, keep=["which", *ID])
    return explain.contribution_rows(values, explain.input_names(model), ["which", *ID])
