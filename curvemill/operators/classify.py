"""Training, calibration, scoring and explanation of the class model on the 23 features, with MLlib."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel, Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvemill import constants as K
from curvemill.operators import catalogue as cat
from curvemill.operators import evaluate as ev
from curvemill.operators import isotonic
from curvemill.operators.clean import inf_to_null
from curvemill.session import materialize


def class_index(classes: list[str], label: str = "label") -> Column:
    """Position in the class list; by order, not by frequency."""
    return (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (classes x n_class)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    w = n.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row
    return df.join(w, label)  # a few rows, but their number is the data's: AQE picks the join


def _stages(names: list[str]):
    flags = ", ".join(f"CAST({n} IS NULL AS DOUBLE) AS {n}_missing" for n in names)
    return [
        SQLTransformer(statement=f"SELECT *, {flags} FROM __THIS__"),
        Imputer(strategy="median", inputCols=names, outputCols=[f"{n}_filled" for n in names]),
        VectorAssembler(inputCols=[f"{n}_filled" for n in names] + [f"{n}_missing" for n in names], outputCol="features"),
    ]


def train(df: DataFrame, classes: list[str], seed: int = 0, trees: int = 20, depth: int = 5, boosted: bool = False,
          names: list[str] = K.FEATURE_NAMES) -> PipelineModel:
    """Imputation with missing-value flags, then a class-balanced tree ensemble."""
    x = balanced_weights(inf_to_null(df, names).where(F.col("label").isin(classes)))
    x = x.select(*names, class_index(classes).alias("y"), "weight")
    if boosted:
        est = OneVsRest(classifier=GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed), labelCol="y", featuresCol="features", weightCol="weight")
    else:
        est = RandomForestClassifier(labelCol="y", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_stages(names), est]).fit(x)


def _probabilities(model: PipelineModel, df: DataFrame, names: list[str]) -> DataFrame:
    """Rows with ``p``, the class probabilities of a forest, or those of one boosted model for each class, made to sum to 1."""
    keep, out = df.columns, model.transform(inf_to_null(df, names))
    if "probability" in out.columns:
        return out.select(*keep, vector_to_array("probability").alias("p"))
    # a boosted model's margin m has the probability 1 / (1 + exp(-2 m))
    each = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (1.0 + F.exp(m * -2.0)))
    out = out.select(*keep, each.alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("p", F.transform("p", lambda x: x / total))


def score(model: PipelineModel, df: DataFrame, classes: list[str], names: list[str] = K.FEATURE_NAMES) -> DataFrame:
    """Add the probability array ``p`` and label, confidence, map. Row columns are kept. ``model`` is a forest or a boosted one."""
    return ev.predict(_probabilities(model, df, names), classes)


# -- calibration -----------------------------------------------------------------------------------------------

class Calibrator(NamedTuple):
    """``parts``, one for each class: slope and intercept (sigmoid), or knots and values of a rising line (isotonic)."""
    method: str
    parts: list


def _fit_calibrator(scored: DataFrame, method: str, k: int) -> Calibrator:
    parts = []
    for c in range(k):
        x = scored.select(F.col("p")[c].alias("x"), (F.col("y") == c).cast("double").alias("z"))
        if method == "sigmoid":
            m = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="v"),
                                 LogisticRegression(featuresCol="v", labelCol="z", maxIter=30)]).fit(x).stages[-1]
            parts.append((float(m.coefficients[0]), float(m.intercept)))
        else:
            parts.append(isotonic.knots(isotonic.fit(x)))
    return Calibrator(method, parts)


def apply_calibrator(cal: Calibrator | None, scored: DataFrame) -> DataFrame:
    """Calibrate each class's score, then renormalise; a row of zeros becomes uniform."""
    if cal is None:
        return scored
    k = len(cal.parts)
    if cal.method == "sigmoid":
        cols = [1.0 / (1.0 + F.exp(-(F.col("p")[c] * a + b))) for c, (a, b) in enumerate(cal.parts)]
    else:
        cols = [isotonic.interpolate(F.col("p")[c], x, v) for c, (x, v) in enumerate(cal.parts)]
    x = scored.withColumns({f"_q{c}": q for c, q in enumerate(cols)})
    cols = [F.col(f"_q{c}") for c in range(k)]
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    x = x.withColumn("_t", total)
    p = F.array(*[F.when(F.col("_t") > 0, c / F.when(F.col("_t") > 0, F.col("_t"))).otherwise(F.lit(1.0 / k)) for c in cols])
    return x.withColumn("p", p).drop("_t", *[f"_q{c}" for c in range(k)])


def _loss(df: DataFrame) -> float:
    return ev.log_loss(df, "p", "y").first()["log_loss"]


def best_calibrator(scored: DataFrame, key: str, classes: list[str], seed: int = 0) -> Calibrator | None:
    """Sigmoid or isotonic, whichever has the lower log-loss on an inner 60/40 split, refitted on all."""
    k = len(classes)
    parts = materialize(cat.stratified_split(scored, key, "y", {"fit": 0.6, "check": 0.4}, seed))
    a, b = parts.where(F.col("split") == "fit"), parts.where(F.col("split") == "check")
    losses = {}
    for method in ("sigmoid", "isotonic"):
        losses[method] = _loss(apply_calibrator(_fit_calibrator(a, method, k), b))
    best = min(losses, key=losses.get)
    return _fit_calibrator(parts, best, k)


class Trained(NamedTuple):
    model: PipelineModel
    calibrator: Calibrator | None
    test: DataFrame
    loss_raw: float
    loss_calibrated: float


def train_calibrated(df: DataFrame, classes: list[str], key: str, seed: int = 0, **options) -> Trained:
    """60/20/20 split; the calibrator is dropped again if it makes the held-out log-loss worse."""
    parts = cat.stratified_split(df.where(F.col("label").isin(classes)), key, "label", {"train": 0.6, "cal": 0.2, "test": 0.2}, seed)
    parts = materialize(parts)
    model = train(parts.where(F.col("split") == "train"), classes, seed, **options)

    def scored(name):
        x = score(model, parts.where(F.col("split") == name).drop("split"), classes)
        return materialize(x.withColumn("y", class_index(classes).cast("int")))

    test = scored("test")
    raw = _loss(test)
    cal = best_calibrator(scored("cal"), key, classes, seed)
    held = apply_calibrator(cal, test)
    loss = _loss(held)
    if loss > raw:
        return Trained(model, None, test, raw, raw)
    names = ["label", "confidence", "probabilities", "y_pred"]
    return Trained(model, cal, ev.predict(held.drop(*names), classes), raw, loss)


# -- explanation -------------------------------------------------------------------------------------------------

def medians(model: PipelineModel, names: list[str] = K.FEATURE_NAMES) -> dict[str, float]:
    row = model.stages[1].surrogateDF.first()
    return {n: row[n] for n in names}


def drivers(model: PipelineModel, df: DataFrame, key: str, classes: list[str], top: int = 4, names: list[str] = K.FEATURE_NAMES) -> DataFrame:
    """Per row the features that moved the reported label most: the change of its probability when one
    feature is set to its training median. ``(key, drivers array<struct<name, value>>)``."""
    med = medians(model, names)
    base = score(model, df.select(key, *names), classes)
    x = base.select(key, *names, "y_pred", F.element_at("p", F.col("y_pred") + 1).alias("_p0"))
    x = x.withColumn("_j", F.explode(F.array(*[F.lit(i) for i in range(len(names))])))
    x = x.withColumns({n: F.when(F.col("_j") == i, F.lit(float(med[n]))).otherwise(F.col(n)) for i, n in enumerate(names)})
    out = _probabilities(model, x, names).select(key, "_j", (F.col("_p0") - F.element_at("p", F.col("y_pred") + 1)).alias("v"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_j") + 1)
    g = out.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.abs("v")).alias("o"), F.col("_j").alias("j"), name.alias("name"), F.col("v").alias("value")))).alias("_d"))
    return g.select(key, F.transform(F.slice("_d", 1, top), lambda d: F.struct(d["name"].alias("name"), d["value"].alias("value"))).alias("drivers"))


def importances(model: PipelineModel, spark, names: list[str] = K.FEATURE_NAMES) -> DataFrame:
    """Features by importance, the missing-value flag counted with its feature; of a boosted model the mean over its classes."""
    last = model.stages[-1]
    each = [m.featureImportances for m in (last.models if hasattr(last, "models") else [last])]
    rows = [(n, sum(float(v[i] + v[i + len(names)]) for v in each) / len(each)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


# -- persistence ---------------------------------------------------------------------------------------------------

_CALIBRATION = "class int, method string, x array<double>, v array<double>"


def save(model: PipelineModel, path: str, classes: list[str], spark, names: list[str] = K.FEATURE_NAMES, calibrator: Calibrator | None = None) -> None:
    """Model, names and calibrator below ``path``."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(names, classes)], "features array<string>, classes array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
    parts = []
    if calibrator is not None:
        parts = [(c, calibrator.method, *(([a], [b]) if calibrator.method == "sigmoid" else (a, b))) for c, (a, b) in enumerate(calibrator.parts)]
    spark.createDataFrame(parts, _CALIBRATION).coalesce(1).write.mode("overwrite").parquet(f"{path}/calibrator")


def load(path: str, spark) -> tuple[PipelineModel, list[str], list[str]]:
    row = spark.read.parquet(f"{path}/names").first()
    return PipelineModel.load(f"{path}/model"), list(row["features"]), list(row["classes"])


def load_calibrator(path: str, spark) -> Calibrator | None:
    """The calibrator saved with a model; None if it had none."""
    rows = spark.read.schema(_CALIBRATION).parquet(f"{path}/calibrator").orderBy("class").collect()
    if not rows:
        return None
    method = rows[0]["method"]
    return Calibrator(method, [(r["x"][0], r["v"][0]) if method == "sigmoid" else (list(r["x"]), list(r["v"])) for r in rows])


def check_schema(features: list[str], expected: list[str] = K.FEATURE_NAMES) -> None:
    """Refuse a model whose features are not the code's, in order."""
    if list(features) != list(expected):
        raise ValueError(f"model has {len(features)} features, the code {len(expected)}; first difference: "
                         f"{next((a, b) for a, b in zip([*features, None], [*expected, None]) if a != b)}")


def compare_schemas(models: DataFrame, table: DataFrame, expected: list[str] = K.FEATURE_NAMES) -> DataFrame:
    """A row for each row of ``models(model, features)``, the saved names: ``model, features`` (how many), ``missing`` (features of ``table`` that the model has not),
    ``extra`` (its names that the table has not) and ``accepted``: none of both, and the same order. The table's features are its columns in ``expected``, in that order."""
    have = table.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(n) for n in expected if n in table.columns])).alias("at", "name"))
    named = models.select("model", F.posexplode("features").alias("model_at", "name"))
    both = models.select("model").crossJoin(F.broadcast(have)).join(named, ["model", "name"], "full_outer")
    return both.groupBy("model").agg(
        F.count("model_at").cast("int").alias("features"), F.array_sort(F.collect_list(F.when(F.col("model_at").isNull(), F.col("name")))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("at").isNull(), F.col("name")))).alias("extra"), F.coalesce(F.every(F.col("at").eqNullSafe(F.col("model_at"))), F.lit(False)).alias("accepted"))


# -- regimes ---------------------------------------------------------------------------------------------------------

def evaluate_on(model: PipelineModel, df: DataFrame, classes: list[str]) -> DataFrame:
    """One row: accuracy, macro_f1, ci_low, ci_high, n."""
    s = score(model, df.where(F.col("label").isin(classes)).withColumn("y", class_index(classes).cast("int")), classes)
    r = ev.classification_report(s, len(classes), "y", "y_pred")
    return r.agg(*[F.first(c).alias(c) for c in ("accuracy", "macro_f1", "ci_low", "ci_high")], F.sum("support").alias("n"))


def self_test(df: DataFrame, classes: list[str], key: str, seed: int = 0, **options) -> DataFrame:
    parts = materialize(cat.stratified_split(df.where(F.col("label").isin(classes)), key, "label", {"train": 0.75, "test": 0.25}, seed))
    return evaluate_on(train(parts.where(F.col("split") == "train"), classes, seed, **options), parts.where(F.col("split") == "test"), classes)


def domain_gap(train_set: DataFrame, real: DataFrame, classes: list[str], key: str, threshold: float = 0.30, **options) -> DataFrame:
    """Self-test accuracy minus accuracy on real data, and whether it is within the threshold."""
    cat.assert_disjoint(train_set, real)
    own = self_test(train_set, classes, key, **options).select(F.col("accuracy").alias("self_accuracy"), F.col("macro_f1").alias("self_f1"))
    cross = evaluate_on(train(train_set, classes, **options), real, classes)
    x = own.join(F.broadcast(cross))  # one row each
    gap = F.col("self_accuracy") - F.col("accuracy")
    return x.select("self_accuracy", "self_f1", "accuracy", "macro_f1", "ci_low", "ci_high", "n", gap.alias("gap"), (gap <= threshold).alias("passed"))


def compare_regimes(synthetic: DataFrame, injected: DataFrame, real: DataFrame, classes: list[str], key: str, test_fraction: float = 0.35, **options) -> DataFrame:
    """Accuracy and macro F1 of six training regimes on real stars held out as whole stars."""
    split = materialize(cat.group_split(real, test_fraction))
    real_train, real_test = (split.where(F.col("split") == s).drop("split") for s in ("train", "test"))
    cat.assert_disjoint(real_train, real_test)
    cols = ["label", key, *K.FEATURE_NAMES]
    # the variable class has no injected counterpart and comes from the real training half
    mixed = injected.where(F.col("label") != "variable").select(*cols).unionByName(real_train.where(F.col("label") == "variable").select(*cols))
    both = mixed.unionByName(real_train.where(F.col("label") != "variable").select(*cols))
    rows = [
        ("made, own", self_test(synthetic, classes, key, **options)),
        ("made, on real", evaluate_on(train(synthetic, classes, **options), real_test, classes)),
        ("planted, own", self_test(mixed, classes, key, **options)),
        ("planted, on real", evaluate_on(train(mixed, classes, **options), real_test, classes)),
        ("real, on real", evaluate_on(train(real_train, classes, **options), real_test, classes)),
        ("planted and real, on real", evaluate_on(train(both, classes, **options), real_test, classes)),
    ]
    out = None
    for i, (name, r) in enumerate(rows):
        r = r.select(F.lit(i).alias("place"), F.lit(name).alias("regime"), "accuracy", "macro_f1", "n")
        out = r if out is None else out.unionByName(r)
    return out.orderBy("place")


def regime_gaps(table: DataFrame) -> DataFrame:
    """Domain gaps, the part closed by injection, and the change of real accuracy with its interval."""
    from curvemill.functions import columns as C

    def acc(name):
        return F.max(F.when(F.col("regime") == name, F.col("accuracy")))
    x = table.agg((acc("made, own") - acc("made, on real")).alias("gap_synthetic"), (acc("planted, own") - acc("planted, on real")).alias("gap_injected"),
                  acc("made, on real").alias("_a"), acc("planted, on real").alias("_b"), F.max(F.when(F.col("regime") == "real, on real", F.col("n"))).alias("n"))
    d, lo, hi, sig = C.accuracy_difference("_a", "_b", "n")
    return x.select("gap_synthetic", "gap_injected", (F.col("gap_synthetic") - F.col("gap_injected")).alias("gap_closed"), d.alias("change"), lo.alias("low"), hi.alias("high"), sig.alias("distinguishable"))


def production_set(injected: DataFrame, real: DataFrame, test_fraction: float = 0.30) -> tuple[DataFrame, DataFrame]:
    """(training rows, held-out real rows), no star on both sides; refuses to return an overlap."""
    split = cat.group_split(real, test_fraction)
    cols = [*K.FEATURE_NAMES, "label", "target"]
    train_rows = injected.select(*cols).unionByName(split.where(F.col("split") == "train").select(*cols))
    held = split.where(F.col("split") == "test").select(*cols)
    cat.assert_disjoint(train_rows, held)
    return train_rows, held
