"""Predictive utility with estimators of ``pyspark.ml``: features fitted on one arm, arms, scores, and evaluation loops.

Loops run over evaluators, seeds and targets on the driver, as the fits themselves are distributed; what they collect is one
row of scores per fit.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.contracts import GateError
from tallyframe.functions.expressions import ratio
from tallyframe.operators.preprocess import category_codes, fit_min_max, fit_standard, ordinal
from tallyframe.operators.utility import class_metrics, class_support, ranking_scores, regression_scores
from tallyframe.sources.working import working

CARDINALITY = 256


class Features:
    """Features fitted on one table: standardised numbers (population deviation, 0 for a constant) and one-hot categories, unknown ones all 0."""

    def __init__(self, train: DataFrame, numeric: list[str], categorical: list[str], datetime: list[str] = (), cap: int = CARDINALITY):
        self.numeric, self.datetime, self.categorical = list(numeric), list(datetime), {}
        self.scaling = fit_standard(self._numbers(train), [*numeric, *datetime]).columns
        for c in categorical:
            seen = [r[0] for r in train.where(F.col(c).isNotNull()).select(F.col(c).cast("string").alias("v")).distinct().orderBy("v").limit(cap + 1).collect()]
            if len(seen) > cap:
                raise GateError("cardinality_limit", c)
            self.categorical[c] = seen

    def _numbers(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")).cast("double") * 1000 for c in self.datetime}) if self.datetime else df

    def apply(self, df: DataFrame, label: Column, *keep: str) -> DataFrame:
        scaled = {c: F.coalesce(ratio(F.col(c) - F.lit(a), F.lit(b)), F.lit(0.0)) for c, (a, b) in self.scaling.items()}
        hot = {(c, v): F.when(F.col(c).cast("string") == v, 1.0).otherwise(0.0) for c, values in self.categorical.items() for v in values}
        made = [x.alias(f"_f{i}") for i, x in enumerate([*scaled.values(), *hot.values()])]
        flat = self._numbers(df).select(*keep, label.alias("label"), *made)
        return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(made))], outputCol="features").transform(flat).select(*keep, "label", "features")


def _gbt(seed: int) -> object:
    return OneVsRest(classifier=GBTClassifier(maxIter=50, seed=seed))


class Perceptron:
    """A network with hidden layers, as wide at its ends as the features and the labels it is fitted on."""

    def __init__(self, hidden: list[int], seed: int):
        self.hidden, self.seed = list(hidden), seed

    def fit(self, rows: DataFrame) -> object:
        size, classes = rows.select(F.size(vector_to_array("features"))).first()[0], int(rows.agg(F.max("label")).first()[0]) + 1
        return MultilayerPerceptronClassifier(layers=[size, *self.hidden, max(classes, 2)], seed=self.seed).fit(rows)


#: Estimators by task and name, each made from a seed.
EVALUATORS: dict[str, dict[str, Callable[[int], object]]] = {
    "classification": {
        "logistic-regression": lambda seed: LogisticRegression(maxIter=100),
        "random-forest": lambda seed: RandomForestClassifier(numTrees=200, seed=seed),
        "gradient-boosting": _gbt,
        "decision-tree": lambda seed: DecisionTreeClassifier(maxDepth=28, seed=seed),
        "perceptron": lambda seed: Perceptron([64, 32], seed),
    },
    "regression": {
        "linear-regression": lambda seed: LinearRegression(solver="normal"),
        "ridge": lambda seed: LinearRegression(regParam=1.0, elasticNetParam=0.0, solver="normal"),
        "random-forest": lambda seed: RandomForestRegressor(numTrees=200, seed=seed),
        "gradient-boosting": lambda seed: GBTRegressor(maxIter=50, seed=seed),
        "decision-tree": lambda seed: DecisionTreeRegressor(maxDepth=28, seed=seed),
    },
}


def dummy_predictions(train: DataFrame, test: DataFrame, target: str, task: str) -> DataFrame:
    """(label, prediction): the most frequent train class (the least of those as frequent), or the train mean."""
    counts = train.where(F.col(target).isNotNull()).groupBy(F.col(target).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    value = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("prediction")) if task == "classification" else train.agg(F.avg(target).alias("prediction"))
    return test.select(F.col(target).alias("label")).join(F.broadcast(value))  # one row


def codes_of(train: DataFrame, test: DataFrame, target: str) -> list:
    """The labels of train and test rows, sorted: those of one declared target column."""
    both = train.select(F.col(target).cast("string").alias("v")).unionByName(test.select(F.col(target).cast("string").alias("v")))
    found = [r[0] for r in both.where("v is not null").distinct().orderBy("v").limit(CARDINALITY + 1).collect()]
    if len(found) > CARDINALITY:
        raise GateError("cardinality_limit", target)
    return found


def predictions(estimator: object, train: DataFrame, test: DataFrame, features: Features, target: str, task: str, labels: list) -> DataFrame:
    """(label, prediction, scores): the label and prediction of each test row, for classes as text with a score per class."""
    code = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(target).cast("string")) - 1 if labels else F.col(target)
    model = estimator.fit(features.apply(train, code.cast("double")).where("label is not null"))
    out = model.transform(features.apply(test, code.cast("double")).where("label is not null"))
    if task == "regression":
        return out.select("label", "prediction")
    known = F.array(*[F.lit(v) for v in labels])
    scores = vector_to_array("probability") if "probability" in out.columns else vector_to_array("rawPrediction") if "rawPrediction" in out.columns else F.lit(None).cast("array<double>")
    return out.select(F.get(known, F.col("label").cast("int")).alias("label"), F.get(known, F.col("prediction").cast("int")).alias("prediction"), scores.alias("scores"))


def scores_of(told: DataFrame, task: str, labels: list, positive: object = None) -> dict[str, float | None]:
    """Every score of one table of predictions; one that is undefined is None."""
    if task == "regression":
        r = regression_scores(told, "label", "prediction").first()
        return {"rmse": r.rmse, "mae": r.mae, "r2": r.r2}
    m = class_metrics(told, "label", "prediction")
    r = m.agg(F.sum("f1").alias("f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced"), F.count_if(F.col("support") > 0).alias("seen")).first()
    out = {"macro-f1": r.f1 / len(labels) if r.f1 is not None and labels else None, "balanced-accuracy": r.balanced, "roc-auc": None, "pr-auc": None}
    if r.seen >= 2 and "scores" in told.columns:
        chosen = [positive if positive is not None else labels[-1]] if len(labels) == 2 else labels
        each = [ranking_scores(told.withColumn("_s", F.get("scores", F.lit(labels.index(v)))), F.col("label") == F.lit(v), "_s").first() for v in chosen if v in labels]
        for name, values in (("roc-auc", [x.roc_auc for x in each]), ("pr-auc", [x.average_precision for x in each])):
            out[name] = sum(values) / len(values) if values and None not in values else None
    return out


RUNS = T.StructType([T.StructField(c, T.StringType()) for c in ("target", "task", "evaluator")] + [T.StructField("seed", T.LongType())] + [T.StructField(c, T.StringType()) for c in ("arm", "metric", "state", "reason_code")] + [T.StructField("value", T.DoubleType())])

PRIMARY = {"classification": "macro-f1", "regression": "rmse"}
GLOBAL = {"classification": "balanced-accuracy", "regression": "rmse"}


def local_evaluation(arms: dict[str, DataFrame], target: str, task: str, numeric: list[str], categorical: list[str], *, evaluators: list[str], seeds: list[int], positive: object = None, datetime: list[str] = ()) -> DataFrame:
    """(target, task, evaluator, seed, arm, metric, state, reason_code, value) of the arms dummy, trtr and tstr.

    ``arms`` has train, synthetic and test. Features are fitted on the train arm; the test arm is only scored. Classes on
    one side only leave the synthetic arm without support.
    """
    train, synthetic, test = (working(arms[a], a) for a in ("train", "synthetic", "test"))
    spark = train.sparkSession
    labels = codes_of(train, test, target) if task == "classification" else []
    features = Features(train, numeric, categorical, datetime)
    reason = None
    if task == "classification":
        lacks = {r.state for r in class_support(train, test, target).collect()}
        short = class_support(train, synthetic, target).where("state = 'train_only'").limit(1).count()
        reason = "real_train_target_support_incomplete" if "test_only" in lacks else "insufficient_target_support" if short else None
    rows = []

    def add(evaluator: str, seed: int, arm: str, found: dict[str, float | None] | None) -> None:
        names = ("macro-f1", "balanced-accuracy", "roc-auc", "pr-auc") if task == "classification" else ("rmse", "mae", "r2")
        for name in names:
            value = None if found is None else found[name]
            state = "insufficient_support" if found is None else "computed" if value is not None else "mathematically_undefined"
            rows.append((target, task, evaluator, seed, arm, name, state, reason if found is None else None if value is not None else "undefined_score", None if value is None else float(value)))

    kind = "string" if task == "classification" else "double"
    constant = dummy_predictions(train, test, target, task).select(F.col("label").cast(kind).alias("label"), F.col("prediction").cast(kind).alias("prediction"))
    dummy = scores_of(constant.withColumn("scores", F.array_repeat(F.lit(0.0), len(labels))) if labels else constant, task, labels, positive)  # one score for all rows: they tie
    for name, seed in product(evaluators, seeds):
        make = EVALUATORS[task][name]
        add(name, seed, "dummy", dummy)
        add(name, seed, "trtr", scores_of(predictions(make(seed), train, test, features, target, task, labels), task, labels, positive))
        add(name, seed, "tstr", None if reason else scores_of(predictions(make(seed), synthetic, test, features, target, task, labels), task, labels, positive))
    return spark.createDataFrame(rows, RUNS)


def global_evaluation(reference: DataFrame, synthetic: DataFrame, test: DataFrame, numeric: list[str], categorical: list[str], *, evaluators: dict[str, list[str]], seeds: list[int], scorer: Callable[..., float | None] | None = None) -> DataFrame:
    """(target, task, evaluator, seed, arm, metric, state, reason_code, value): every column as the target of all others, fitted on the reference and on the synthetic arm.

    Categories are ordinal codes of the reference's sorted ones, -1 where unknown. A synthetic target of one value has no support.
    ``scorer`` (train, test, target, task, evaluator, seed, arm) -> value takes the place of the fits here.
    """
    rows, spark = [], reference.sparkSession
    coded = {}
    for c in categorical:
        codes = category_codes(reference, c)
        coded[c] = codes
    frames = {}
    for name, df in (("reference", reference), ("synthetic", synthetic), ("test", test)):
        for c, codes in coded.items():
            df = ordinal(df, codes, c)
        frames[name] = working(df, "frame")
    for target in [*numeric, *categorical]:
        task = "classification" if target in categorical else "regression"
        inputs = [*[c for c in numeric if c != target], *[f"{c}_code" for c in categorical if c != target]]
        labels = codes_of(frames["reference"], frames["test"], target) if task == "classification" else []
        for arm in ("reference", "synthetic"):
            constant = frames[arm].select(target).distinct().limit(2).count() < 2
            features = Features(frames["reference"], inputs, [])
            for name, seed in product(evaluators[task], seeds):
                if scorer is not None and not constant:
                    value = scorer(frames[arm], frames["test"], target, task, name, seed, arm)
                else:
                    value = None if constant else scores_of(predictions(EVALUATORS[task][name](seed), frames[arm], frames["test"], features, target, task, labels), task, labels)[GLOBAL[task]]
                state = "insufficient_support" if constant else "computed" if value is not None else "mathematically_undefined"
                rows.append((target, task, name, seed, arm, GLOBAL[task], state, "constant_target" if constant else None, None if value is None else float(value)))
    return spark.createDataFrame(rows, RUNS)


def global_ratios(runs: DataFrame) -> DataFrame:
    """(target, task, evaluator, seed, value): the ratio of both arms of each run; both have to name the same predictors."""
    keys = ["target", "task", "evaluator", "seed"]
    a, b = (runs.where(F.col("arm") == arm).select(*keys, F.col("value").alias(arm)) for arm in ("reference", "synthetic"))
    joined = a.join(b, keys, "full_outer")
    if joined.where(F.col("reference").isNull() & F.col("synthetic").isNull()).limit(1).count() and a.count() != b.count():
        raise GateError("predictor_set_mismatch")
    classes = F.col("task") == "classification"
    return joined.select(*keys, F.when(classes, ratio(F.col("synthetic"), F.col("reference"))).otherwise(ratio(F.col("reference"), F.col("synthetic"))).alias("value"))


def detection_score(real: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str], *, key: str, folds: int = 3, seed: int = 0) -> DataFrame:
    """(roc_auc, score): how well a logistic regression tells the arms apart on held-out folds, and 2 * (1 - max(AUC, 1 - AUC)).

    Folds come from a seeded hash of the key. Out-of-fold scores are ranked together.
    """
    rows = real.withColumn("_arm", F.lit(0.0)).unionByName(synthetic.withColumn("_arm", F.lit(1.0)))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.col("_arm")), F.lit(folds)))
    rows = working(rows, "folds")
    told = None
    for k in range(folds):
        train, test = rows.where(F.col("_fold") != k), rows.where(F.col("_fold") == k)
        features = Features(train, numeric, categorical)
        model = LogisticRegression(maxIter=100, regParam=1e-6).fit(features.apply(train, F.col("_arm")))
        here = model.transform(features.apply(test, F.col("_arm"))).select("label", F.round(F.get(vector_to_array("probability"), F.lit(1)), 12).alias("s"))
        told = here if told is None else told.unionByName(here)
    auc = ranking_scores(told, F.col("label") == 1.0, "s").select("roc_auc")
    return auc.withColumn("score", 2 * (1 - F.greatest(F.col("roc_auc"), 1 - F.col("roc_auc"))))


def grid_search(train: DataFrame, validation: DataFrame, test: DataFrame, target: str, task: str, numeric: list[str], categorical: list[str], make: Callable[[dict], object], grid: dict[str, list], metric: str, *, greatest: bool | None = None) -> DataFrame:
    """(parameters, validation, test): every point of a grid scored on the validation rows; the best one, fitted on train and validation rows together, on the test rows."""
    labels = codes_of(train.unionByName(validation), test, target) if task == "classification" else []
    up = greatest if greatest is not None else metric not in ("rmse", "mae")
    features, rows = Features(train, numeric, categorical), []
    for values in product(*grid.values()):
        point = dict(zip(grid, values))
        rows.append((point, scores_of(predictions(make(point), train, validation, features, target, task, labels), task, labels)[metric]))
    scored = [i for i, (_, v) in enumerate(rows) if v is not None]
    if not scored:
        raise GateError("undefined_score", metric)
    best = min(scored, key=lambda i: (-rows[i][1] if up else rows[i][1], i))
    both = train.unionByName(validation)
    final = scores_of(predictions(make(rows[best][0]), both, test, Features(both, numeric, categorical), target, task, labels), task, labels)[metric]
    return train.sparkSession.createDataFrame([(str(sorted(p.items())), v, final if i == best else None) for i, (p, v) in enumerate(rows)], "parameters string, validation double, test double")


def mle_features(df: DataFrame, train: DataFrame, numeric: list[str], *, low: float = 0.01, log_from: float = 1000.0, width: float = 5.0) -> DataFrame:
    """Numbers for the predictors of the efficacy test, by the train ranges: logarithms of wide positive columns, others scaled to [0, ``width``]."""
    ends = fit_min_max(train, numeric).columns
    out = {}
    for c in numeric:
        a, span = ends[c]
        wide = a is not None and a >= 0 and a + span >= log_from
        out[c] = F.ln(F.greatest(F.col(c).cast("double"), F.lit(low))) if wide else ratio(F.col(c) - F.lit(a), F.lit(span)) * width
    return df.withColumns(out)


def regression_target(c: Column, low: float = 1.0, high: float = 20000.0) -> Column:
    """The logarithm of a regression target clipped to the range that the efficacy test uses."""
    return F.ln(F.least(F.greatest(c.cast("double"), F.lit(low)), F.lit(high)))


def report_metrics(told: DataFrame, task: str, *, target_std: float = 1.0, labels: list | None = None) -> DataFrame:
    """(metric, value, score): accuracy, macro F1 and, of two ``labels`` with a column ``scores``, the ROC AUC of the second; or RMSE in
    the target's own units and R2. ``score`` is larger for better."""
    if task == "regression":
        r = regression_scores(told, "label", "prediction")
        made = [("rmse", F.col("rmse") * F.lit(target_std), -F.col("rmse") * F.lit(target_std)), ("r2", F.col("r2"), F.col("r2"))]
    else:
        m = class_metrics(told, "label", "prediction")
        r = m.agg(ratio(F.sum("hit"), F.sum("support")).alias("acc"), F.avg("f1").alias("f1"))
        made = [("acc", F.col("acc"), F.col("acc")), ("f1", F.col("f1"), F.col("f1"))]
        if labels is not None and len(labels) == 2 and "scores" in told.columns:
            r = r.join(ranking_scores(told.withColumn("_s", F.get("scores", F.lit(1))), F.col("label") == F.lit(labels[1]), "_s").select("roc_auc"))  # single rows
            made.append(("roc_auc", F.col("roc_auc"), F.col("roc_auc")))
    return r.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value"), s.alias("score")) for n, v, s in made])).alias("x")).select("x.*")


def simple_models(real: DataFrame, synthetic: DataFrame, test: DataFrame, target: str, task: str, numeric: list[str], categorical: list[str], *, kind: str, evaluators: list[str], seed: int = 0) -> DataFrame:
    """(evaluator, metric, value) of models fitted on the ``real``, the ``synthetic`` or the ``merged`` rows."""
    train = {"real": lambda: real, "synthetic": lambda: synthetic, "merged": lambda: real.unionByName(synthetic)}[kind]()
    labels = codes_of(real, test, target) if task == "classification" else []
    features, rows = Features(train, numeric, categorical), []
    for name in evaluators:
        for metric, value in scores_of(predictions(EVALUATORS[task][name](seed), train, test, features, target, task, labels), task, labels).items():
            rows.append((name, metric, None if value is None else float(value)))
    return real.sparkSession.createDataFrame(rows, "evaluator string, metric string, value double")


def delta_presence(real: DataFrame, synthetic: DataFrame, numeric: list[str], *, clusters: tuple[int, ...] = (2, 5, 10, 15), seed: int = 0) -> DataFrame:
    """(k, cluster, n_real, n_synthetic, ratio) of the clusters that both arms share; the measure is the greatest ratio."""
    from pyspark.ml.clustering import KMeans

    features = Features(real, numeric, [])
    a, b = (working(features.apply(df, F.lit(0.0)).select("features"), "features") for df in (real, synthetic))
    made = None
    for k in clusters:
        model = KMeans(k=k, seed=seed).fit(a)
        count = lambda df, name, model=model: model.transform(df).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias(name))
        here = count(a, "n_real").join(count(b, "n_synthetic"), "cluster").select(F.lit(k).alias("k"), "cluster", "n_real", "n_synthetic", (F.col("n_real") / (F.col("n_synthetic") + F.lit(1e-8))).alias("ratio"))
        made = here if made is None else made.unionByName(here)
    return made


def alpha_beta(real: DataFrame, synthetic: DataFrame, key: str, numeric: list[str], points: int = 30) -> DataFrame:
    """(alpha_precision, beta_recall) integrated over a grid: how evenly each arm fills the balls that hold a share of the other.

    Precision: the share of synthetic rows within the radius about the real centre that holds a share alpha of real rows,
    against alpha. Recall: the share of real rows whose nearest synthetic row lies in the synthetic ball of share beta and
    is no farther than their own nearest real row. Distances are scaled by the real ranges.
    """
    from tallyframe.operators.distance import nearest
    from tallyframe.operators.metric import ranges
    from tallyframe.operators.stats import quantiles

    scales = [x or 1.0 for x in ranges(real, numeric)]

    def centred(df: DataFrame, of: DataFrame) -> DataFrame:
        row = of.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(numeric)]).first()
        d = sum((F.pow((F.col(c).cast("double") - F.lit(float(row[f"m{i}"]))) / F.lit(s), F.lit(2.0)) for i, (c, s) in enumerate(zip(numeric, scales))), F.lit(0.0))
        return df.withColumn("_d", F.sqrt(d))

    grid = {f"a{i}": i / (points - 1) for i in range(points)}
    radii = quantiles(centred(real, real), "_d", grid)
    near = centred(synthetic, real).select("_d").join(F.broadcast(radii))
    precise = near.agg(*[F.avg((F.col("_d") <= F.col(k)).cast("double")).alias(k) for k in grid])
    own = nearest(real, real, key, numeric, [], kind="l2", skip_equal_key=True).select(key, F.get("distances", F.lit(0)).alias("_own"))
    cross = nearest(real, synthetic, key, numeric, [], kind="l2").select(key, F.get("distances", F.lit(0)).alias("_cross"), F.get("neighbours", F.lit(0)).alias("_s"))
    fake = centred(synthetic, synthetic).select(F.col(key).alias("_s"), F.col("_d").alias("_sd"))
    fake_radii = quantiles(fake, "_sd", grid)
    told = cross.join(own, key).join(fake, "_s").join(F.broadcast(fake_radii))
    recalled = told.agg(*[F.avg(((F.col("_sd") <= F.col(k)) & (F.col("_cross") <= F.col("_own"))).cast("double")).alias(k) for k in grid])
    area = lambda: F.lit(1.0) - 2 * sum((F.abs(F.col(k) - F.lit(a)) for k, a in grid.items()), F.lit(0.0)) / F.lit(points)
    return precise.select(area().alias("alpha_precision")).join(recalled.select(area().alias("beta_recall")))  # single rows
