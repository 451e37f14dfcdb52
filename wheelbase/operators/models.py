"""Group-held-out models of the target: folds, Elastic Net, Random Forest, metrics, importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wheelbase import vocab
from wheelbase.operators import linear

LABEL = "target_log_sales"
# Estimator settings.
ELASTIC_NET = {"regParam": 0.1, "elasticNetParam": 0.5, "maxIter": 200}
FOREST = {"numTrees": 70, "maxDepth": 10, "minInstancesPerNode": 2, "seed": 19191}
NET_PENALTY = (ELASTIC_NET["regParam"], ELASTIC_NET["elasticNetParam"])
METRICS = ("rmse", "mae", "r2")
# Rows that one task of a forest's passes takes before they are spread further, up to one task a core.
ROWS_PER_TASK = 20_000
# Fits that run at the same time: while one waits for its last tasks or for the driver, the cores work on another.
AT_ONCE = 3


def grouped_folds(df: DataFrame, group: str, k: int, method: str = "xxhash64") -> DataFrame:
    """Fold number from a hash of the group, so no group is in two folds.

    ``md5`` gives the same folds in any engine: the first eight hex digits modulo ``k``.
    """
    if method == "md5":
        number = F.conv(F.substring(F.md5(F.col(group)), 1, 8), 16, 10).cast("bigint")
    else:
        number = F.xxhash64(group)
    return df.withColumn("fold", F.pmod(number, F.lit(k)).cast("int"))


def spread(data: DataFrame) -> DataFrame:
    """Rows for an iterative fit, in at least as many parts as keep all cores busy.

    A stored table has as few parts as its size in bytes asks for, but a forest passes over every row of a part for all trees and levels.
    """
    wanted = min(data.sparkSession.sparkContext.defaultParallelism, -(-data.count() // ROWS_PER_TASK))
    return data.repartition(wanted) if data._jdf.queryExecution().toRdd().getNumPartitions() < wanted else data


def linear_model() -> LinearRegression:
    return LinearRegression(featuresCol="scaled", labelCol=LABEL, **ELASTIC_NET)


def forest_model(**settings) -> RandomForestRegressor:
    return RandomForestRegressor(featuresCol="assembled", labelCol=LABEL, **{**FOREST, **settings})


@dataclass(frozen=True)
class ModelSpec:
    """A named model over the controls and, optionally, the features."""

    name: str
    estimator: Callable[[], Estimator]
    features: tuple[str, ...] = field(default_factory=tuple)
    scaled: bool = False
    # Penalty and mix of a linear model, which is then fitted from sums; None fits the estimator on the rows.
    penalty: tuple[float, float] | None = None


def default_specs(features: Sequence[str], forest: Callable[[], Estimator] = forest_model) -> list[ModelSpec]:
    return [
        ModelSpec("baseline_elastic_net", linear_model, (), True, NET_PENALTY),
        ModelSpec("full_elastic_net", linear_model, tuple(features), True, NET_PENALTY),
        ModelSpec("full_random_forest", forest, tuple(features), False),
    ]


def stages_for(spec: ModelSpec, impute_in_fold: bool = False) -> Pipeline:
    """Index and one-hot the categories, assemble, scale by deviation only (keeps vectors sparse), fit."""
    categories = list(vocab.CATEGORICAL_CONTROLS)
    numbers = [*vocab.NUMERIC_CONTROLS, *spec.features]
    steps: list = []
    if impute_in_fold:
        # Medians are learned from the training rows of each fold only.
        filled = [f"{c}_filled" for c in numbers]
        steps.append(Imputer(strategy="median", inputCols=numbers, outputCols=filled))
        numbers = filled
    codes = [f"{c}_code" for c in categories]
    hots = [f"{c}_hot" for c in categories]
    steps += [
        StringIndexer(inputCols=categories, outputCols=codes, handleInvalid="keep"),
        OneHotEncoder(inputCols=codes, outputCols=hots, handleInvalid="keep"),
        VectorAssembler(inputCols=hots + numbers, outputCol="assembled", handleInvalid="keep"),
    ]
    if spec.scaled:
        steps.append(StandardScaler(inputCol="assembled", outputCol="scaled", withMean=False, withStd=True))
    estimator = spec.estimator()
    if estimator.hasParam("cacheNodeIds"):
        # The node of a row is kept from level to level; else every pass walks all trees from their roots for every row. The fit is the same.
        estimator.set(estimator.getParam("cacheNodeIds"), True)
    return Pipeline(stages=[*steps, estimator])


def predicted(fitted: PipelineModel, data: DataFrame) -> DataFrame:
    """``fitted.transform`` with the assembled vectors unpacked first: a tree looks up one value a level, and a packed vector is searched for each."""
    *before, last = fitted.stages
    ready = PipelineModel(before).transform(data)
    column = last.getFeaturesCol()
    return last.transform(ready.withColumn(column, array_to_vector(vector_to_array(column))))


def regression_metrics(predictions: DataFrame, keys: Sequence[str], label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """rmse, mae and r2 per key in one aggregate."""
    y, e = F.col(label), F.col(label) - F.col(prediction)
    sums = predictions.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"),
        F.var_pop(y).alias("_var"),
    )
    explained = 1 - F.try_divide(F.col("_sse"), F.col("n_rows") * F.col("_var"))
    return sums.select(*keys, "n_rows", "rmse", "mae", explained.alias("r2"))


def _linear_metrics(data: DataFrame, specs: Sequence[ModelSpec], folds: Sequence[int]) -> list | None:
    """(model, fold, part, rmse, mae, r2) rows of the linear models from sums of products, or None if the design is too wide."""
    features = list(dict.fromkeys(f for spec in specs for f in spec.features))
    numbers = [*vocab.NUMERIC_CONTROLS, *features]
    made = linear.design(data, vocab.CATEGORICAL_CONTROLS, numbers, LABEL)
    if made is None:
        return None
    by_fold = linear.fold_sums(made)
    total = sum(by_fold.values())
    fits = []
    for spec in specs:
        used = [*range(made.levels), *[made.levels + numbers.index(c) for c in (*vocab.NUMERIC_CONTROLS, *spec.features)]]
        fits += [(spec.name, fold, *linear.elastic_net(total - by_fold[fold], used, *spec.penalty)) for fold in folds]
    return linear.metrics_of(linear.error_sums(made, fits)).collect()


def cross_validate(
    folded: DataFrame, specs: Sequence[ModelSpec], k: int, digits: int = 6, impute_in_fold: bool = False
) -> DataFrame:
    """Long metrics ``(model, fold, metric, value)`` for training and test rows of every fold.

    All linear models share two passes over the rows (sums of products, errors). With medians learned inside the folds, or a design
    wider than the sums allow, they are fitted like the forest; the driver only goes over models and folds then, AT_ONCE at a time.
    """
    data = spread(folded).persist(StorageLevel.MEMORY_AND_DISK)
    present = [row.fold for row in data.select("fold").distinct().orderBy("fold").collect() if 0 <= row.fold < k]
    measured: list[tuple] = []

    def add(model: str, fold: int, row) -> None:
        measured.extend((model, fold, f"{row.part}_{m}", None if row[m] is None else round(float(row[m]), digits)) for m in METRICS)

    from_sums = [] if impute_in_fold else [s for s in specs if s.penalty]
    rows = _linear_metrics(data, from_sums, present) if from_sums else []
    for row in rows or []:
        add(row.model, row.fold, row)

    def one(task: tuple[ModelSpec, int]) -> list:
        spec, fold = task
        fitted = stages_for(spec, impute_in_fold).fit(data.filter(F.col("fold") != fold))
        part = F.when(F.col("fold") == fold, "test").otherwise("train").alias("part")
        return regression_metrics(predicted(fitted, data).select(part, LABEL, "prediction"), ["part"]).collect()

    tasks = [(spec, fold) for spec in specs if rows is None or spec not in from_sums for fold in present]
    with ThreadPool(AT_ONCE) as pool:
        for (spec, fold), found in zip(tasks, pool.imap(inheritable_thread_target(folded.sparkSession)(one), tasks)):
            for row in found:
                add(spec.name, fold, row)
    data.unpersist()
    return folded.sparkSession.createDataFrame(measured, "model string, fold int, metric string, value double")


def fold_mean(metrics: DataFrame) -> DataFrame:
    """Means over folds; the plain rmse, mae and r2 are the test means."""
    mean = lambda name: F.round(F.avg(F.when(F.col("metric") == name, F.col("value"))), 6)
    columns = [f"{part}_{m}" for part in ("train", "test") for m in METRICS]
    means = metrics.groupBy("model").agg(*[mean(c).alias(c) for c in columns])
    return means.select("model", *columns, *[F.col(f"test_{m}").alias(m) for m in METRICS])


def incremental_r2(metrics: DataFrame) -> DataFrame:
    """Mean test R² of the full models minus that of the control-only Elastic Net."""
    mean = lambda model: F.avg(F.when((F.col("model") == model) & (F.col("metric") == "test_r2"), F.col("value")))
    base = F.round(mean("baseline_elastic_net"), 6)
    return metrics.agg(
        F.round(F.round(mean("full_elastic_net"), 6) - base, 6).alias("elastic_net"),
        F.round(F.round(mean("full_random_forest"), 6) - base, 6).alias("random_forest"),
    )


def forest_diagnostics(metrics: DataFrame, model: str = "full_random_forest") -> DataFrame:
    """Train and test metrics of the forest per fold."""
    names = [f"{part}_{m}" for m in METRICS for part in ("train", "test")]
    return metrics.filter(F.col("model") == model).groupBy("fold").pivot("metric", names).agg(F.first("value")).orderBy("fold")


def base_names() -> Column:
    """One-hot columns carry their control's name as prefix; numbers keep their own."""
    name = F.regexp_replace("name", "_filled$", "")
    chain = name
    for control in vocab.CATEGORICAL_CONTROLS:
        chain = F.when(name.startswith(f"{control}_hot"), control).otherwise(chain)
    return chain


def fitted_weights(model: PipelineModel, transformed: DataFrame, column: str) -> DataFrame:
    """Coefficients or impurity importances by base name, one-hot columns summed to their control."""
    groups = transformed.schema["assembled"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for attributes in groups.values() for a in attributes}
    last = model.stages[-1]
    vector = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    rows = [(names[i], float(value)) for i, value in enumerate(vector.toArray())]
    frame = transformed.sparkSession.createDataFrame(rows, "name string, weight double")
    return frame.groupBy(base_names().alias("feature_name")).agg(F.sum("weight").alias(column))


def feature_importance(analysis: DataFrame, features: Sequence[str], forest: Callable[[], Estimator] = forest_model) -> DataFrame:
    """Full-data fits of both full models: (feature_name, elastic_net_coefficient, random_forest_importance)."""
    data = spread(analysis).persist(StorageLevel.MEMORY_AND_DISK)
    weights = []
    _, linear, trees = default_specs(features, forest)
    for spec, column in ((linear, "elastic_net_coefficient"), (trees, "random_forest_importance")):
        fitted = stages_for(spec).fit(data)
        weights.append(fitted_weights(fitted, fitted.transform(data), column))
    data.unpersist()
    return weights[0].join(weights[1], "feature_name", "full")


def importance_table(selected: DataFrame, quality: DataFrame, importance: DataFrame) -> DataFrame:
    """Selected features and all controls with their weights (0.0 when absent), for display by importance."""
    described = selected.select("feature_name").join(
        quality.select("feature_name", "group_name", "parameter_name", "parameter_type"), "feature_name", "left"
    )
    names = [*vocab.CATEGORICAL_CONTROLS, *vocab.NUMERIC_CONTROLS]
    controls = selected.sparkSession.createDataFrame([(n,) for n in names], "feature_name string").select(
        "feature_name",
        F.lit("control").alias("group_name"),
        F.col("feature_name").alias("parameter_name"),
        F.lit("control").alias("parameter_type"),
    )
    weighed = described.unionByName(controls).join(importance, "feature_name", "left")
    return weighed.fillna(0.0, ["elastic_net_coefficient", "random_forest_importance"])
