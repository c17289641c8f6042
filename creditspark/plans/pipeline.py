"""The whole run, stage by stage, over tables on shared storage.

Every stage is a function from tables to a table; `run` writes each result to a new
path, so a later stage starts from stored rows and a lost executor costs only its
own tasks.  With `reuse`, a stage whose result exists is read back instead.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark import schema
from creditspark.functions.cleaning import missing_features
from creditspark.models import explain, scenarios, sicr, training
from creditspark.models.preprocessing import fit_levels
from creditspark.operators import curves, history, sampling, transitions, validation
from creditspark.plans import loans
from creditspark.sources import read_csv_table, read_origination, read_performance, read_table, write_csv, write_table


@dataclass
class Store:
    """Where the stages keep their tables, result files and models."""

    spark: SparkSession
    root: str
    reuse: bool = False
    written: list[str] = field(default_factory=list)

    def _exists(self, path: str) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def table(self, name: str, build: Callable[[], DataFrame], **options) -> DataFrame:
        path = f"{self.root}/data/{name}"
        if not (self.reuse and self._exists(path)):
            write_table(build(), path, **options)
            self.written.append(path)
        return read_table(self.spark, path)

    def result(self, name: str, df: DataFrame) -> DataFrame:
        """The stored table, so that no action computes it again."""
        path = f"{self.root}/tables/{name}"
        if not (self.reuse and self._exists(path)):
            write_csv(df, path)
            self.written.append(path)
        return read_csv_table(self.spark, path, df.schema)

    def model(self, name: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        """A model counts as stored once its marker, written after all its stages, is there."""
        path, marker = f"{self.root}/models/{name}", f"{self.root}/models/{name}-stored"
        if not (self.reuse and self._exists(marker)):
            training.save_model(fit(), path, overwrite=self.reuse)
            write_csv(self.spark.createDataFrame([(name,)], "model string"), marker)
            self.written.append(path)
        return training.load_model(path)


def run(
    spark: SparkSession, raw_root: str, out_root: str, macro_series: DataFrame | None = None,
    kinds: tuple[str, ...] = training.KINDS, options: dict[str, dict] | None = None,
    reuse: bool = False, least_curve: int = 100, least_scenario: int = 50, least_backtest: int = 100,
    sample_rows: int = 5_000,
) -> dict[str, DataFrame]:
    """Ingest, label, build features, train, assess, project, validate and explain."""
    from creditspark.operators.macro import macro_monthly

    store, options = Store(spark, out_root, reuse), options or {}
    by_loan = {"sort_by": [schema.LOAN]}
    origination = loans.prepare_origination(
        store.table("orig_all", lambda: read_origination(spark, raw_root), **by_loan))
    performance = loans.prepare_performance(
        store.table("svcg_all", lambda: read_performance(spark, raw_root), **by_loan))
    macro = None
    if macro_series is not None:
        macro = store.table("macro_monthly", lambda: macro_monthly(macro_series))

    panel = store.table("panel_con_default", lambda: loans.labelled_panel(
        performance, origination, rolling=True), sort_by=[schema.LOAN, schema.MONTH])
    levels = fit_levels(
        origination.join(performance.select(schema.LOAN), schema.LOAN, "left_semi"),
        [c for c in schema.CATEGORICAL if c in origination.columns])
    data = loans.model_rows(
        store.table("dataset_modelado", lambda: loans.feature_dataset(panel, macro, levels)))
    absent = missing_features(data, schema.MODEL_FEATURES)
    features = [c for c in schema.MODEL_FEATURES if c not in absent]
    results: dict[str, DataFrame] = {}

    # Models and their comparison.
    train, valid, test = (data.filter(F.col("split") == s) for s in ("train", "validation", "test"))
    models = {
        k: store.model(k, lambda k=k: training.fit_calibrated(train, valid, features, k, **options.get(k, {})))
        for k in kinds
    }
    scored = store.table("scored_models", lambda: training.scored_parts(
        models, data, features, parts=("train", "validation", "test")), partition_by=["model", "split"])
    results["resultados_modelos"] = training.comparison(scored)

    # Significant increase in credit risk, written beside the dataset it extends.
    main = models["gbt"] if "gbt" in models else models[kinds[0]]
    origination_model = store.model("pd_origination", lambda: sicr.fit_origination_model(data))
    assessed = store.table("dataset_sicr", lambda: sicr.assess(training.score(
        main, training.score(origination_model, data, "pd_origination"), "pd_current")))
    results["sicr_stages"] = sicr.stage_reclassification(assessed)
    results["pd_summary"] = sicr.pd_summary(assessed)

    # Lifetime curve and scenarios.
    marginal = curves.marginal_pd_by_age(assessed, "pd_current", least=least_curve)
    curve = curves.cumulative_pd(marginal)
    results["curva_pd_lifetime"] = curve
    if macro is not None:
        outcome = scenarios.scenario_pd(test, lambda df: training.score(main, df), least=least_scenario)
        results["ecl_by_scenario"] = outcome

    # Validation.
    checked = scored.filter(F.col("split").isin("train", "test"))
    results["validacion_metricas"] = validation.validation_report(
        checked, "label", "pd", F.col("split") == "train", ["model"])
    results["validacion_backtesting"] = validation.backtest_deciles(
        scored.filter(F.col("split") == "test"), "label", "pd", ["model"])
    moved = store.table("stage_moves", lambda: transitions.transition_counts(
        history.stage_after(panel, 3, "stage_q3"), "stage_q3", F.year(schema.MONTH)), partition_by=())
    matrix = transitions.stage_matrix(moved, "stage_q3")
    results["transition_matrix_observed"] = transitions.pivot_matrix(matrix, "ifrs9_stage", "stage_q3", "prob")
    results["transition_key_rates"] = transitions.key_rates(matrix, "stage_q3")
    results["cure_rates"] = transitions.cure_rate_yearly(moved, "stage_q3", F.col("year"))
    results["stage_psi"] = transitions.stage_psi(moved)
    results["lifetime_pd_backtest_by_vintage"] = curves.lifetime_backtest(panel, curve, least=least_backtest)

    # Explanations of the boosted model.
    if "gbt" in models:
        keys = [schema.LOAN, schema.MONTH]
        sample = sampling.stratified_sample(test, sample_rows, keys, ["label"])
        names = explain.input_names(models["gbt"])
        results["importancia_gain"] = explain.gain_importance(models["gbt"])
        trees = f"{out_root}/models/gbt_trees"
        results["importancia_shap"] = explain.shap_importance(
            explain.shap_values(models["gbt"], sample, trees), names)
        ends = explain.extreme_loans(training.score(models["gbt"], sample), keys)
        chosen = sample.join(F.broadcast(ends.select("which", *keys)), keys)  # two rows
        results["explicacion_prestamos"] = explain.contribution_rows(
            explain.shap_values(models["gbt"], chosen, trees, keep=["which", *keys]), names, ["which", *keys])

    return {name: store.result(name, df) for name, df in results.items()}
