"""Text classifiers on labelled mentions, with pyspark.ml."""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import workdir
from .features import DampedCounts
from .metrics import summary, temperature

VOCABULARY = 10_000


def balanced(rows: DataFrame, label: str) -> DataFrame:
    """rows with weight: all rows over classes times the class's rows. Labels are few, so their counts are broadcast."""
    c = rows.groupBy(F.col(label).alias("b_label")).agg(F.count("*").alias("b_n"))
    total = c.agg(F.sum("b_n").alias("b_all"), F.count("*").alias("b_k"))
    c = c.crossJoin(F.broadcast(total)).select("b_label", (F.col("b_all") / (F.col("b_k") * F.col("b_n"))).alias("weight"))
    return rows.join(c, F.col(label).eqNullSafe(F.col("b_label"))).drop("b_label")


def _text_stages(text: str, vocabulary: int, pairs: bool, damped: bool) -> list:
    """From words, and word pairs, to normalised weights by rarity in the column features; the vocabulary's parts are equal."""
    stages = [RegexTokenizer(inputCol=text, outputCol="m_words", pattern=r"\W+", minTokenLength=2)]
    kinds = ("words", "pairs") if pairs else ("words",)
    stages += [NGram(n=2, inputCol="m_words", outputCol="m_pairs")] if pairs else []
    stages += [CountVectorizer(inputCol=f"m_{k}", outputCol=f"m_{k}_n", vocabSize=vocabulary // len(kinds)) for k in kinds]
    stages += [VectorAssembler(inputCols=[f"m_{k}_n" for k in kinds], outputCol="m_n")]
    stages += [DampedCounts(inputCol="m_n", outputCol="m_tf")] if damped else []
    return [*stages, IDF(inputCol="m_tf" if damped else "m_n", outputCol="m_idf"), Normalizer(inputCol="m_idf", outputCol="features")]


def _solver(kind: str, weight: str | None, iterations: int, reg: float):
    used = {"weightCol": weight} if weight else {}
    if kind == "logistic":
        return LogisticRegression(labelCol="m_label", maxIter=iterations, regParam=reg, **used)
    if kind == "svm":
        return OneVsRest(classifier=LinearSVC(maxIter=iterations, regParam=reg), labelCol="m_label", **used)
    raise ValueError(f"no solver {kind}")


def tfidf_classifier(train: DataFrame, text: str, label: str, *, kind: str = "logistic", vocabulary: int = VOCABULARY, weight: str | None = "weight", iterations: int = 50, reg: float = 0.001, pairs: bool = True, damped: bool = False) -> PipelineModel:
    """Word and word-pair frequencies (damped: 1 + ln of them), weighted by rarity, normalised; then a logistic regression or linear SVMs, one against the rest."""
    index = StringIndexer(inputCol=label, outputCol="m_label", handleInvalid="keep", stringOrderType="alphabetAsc")
    stages = [*_text_stages(text, vocabulary, pairs, damped), index, _solver(kind, weight, iterations, reg)]
    return Pipeline(stages=stages).fit(train.withColumn(text, F.coalesce(text, F.lit(""))))


def mlp_classifier(train: DataFrame, text: str, label: str, *, vocabulary: int = VOCABULARY, hidden: int = 64, iterations: int = 50) -> PipelineModel:
    """The same features to a network with one hidden layer; its input is as wide as the vocabulary that was found."""
    train = train.withColumn(text, F.coalesce(text, F.lit("")))
    words = RegexTokenizer(inputCol=text, outputCol="m_words", pattern=r"\W+", minTokenLength=2)
    counts = CountVectorizer(inputCol="m_words", outputCol="m_n", vocabSize=vocabulary)
    index = StringIndexer(inputCol=label, outputCol="m_label", handleInvalid="keep", stringOrderType="alphabetAsc")
    found = Pipeline(stages=[words, counts, IDF(inputCol="m_n", outputCol="m_idf"), Normalizer(inputCol="m_idf", outputCol="features"), index]).fit(train)
    width = len(next(s for s in found.stages if hasattr(s, "vocabulary")).vocabulary)
    classes = len(found.stages[-1].labels) + 1
    network = MultilayerPerceptronClassifier(labelCol="m_label", layers=[width, hidden, classes], maxIter=iterations, seed=7)
    return PipelineModel([*found.stages, network.fit(found.transform(train))])


def platt(rows: DataFrame, truth: str, logit: str) -> tuple[float, float]:
    """Slope and intercept of a logistic regression of the truth on one logit, hardly regularised."""
    x = VectorAssembler(inputCols=["p_z"], outputCol="features").transform(rows.select(F.col(truth).cast("double").alias("label"), F.col(logit).cast("double").alias("p_z")))
    m = LogisticRegression(regParam=1e-9, maxIter=1000, tol=1e-10).fit(x)
    return float(m.coefficients[0]), float(m.intercept)


#: Temperatures that are tried.
TEMPERATURES = tuple([round(0.05 * i, 2) for i in range(1, 20)] + [1 + 0.25 * i for i in range(17)] + [5.5 + 0.5 * i for i in range(14)])


def best_temperature(rows: DataFrame, truth: str, logit: str) -> tuple[float, float]:
    """The temperature of least negative log-likelihood, and that; the lower one among equals."""
    r = temperature(rows, truth, logit, list(TEMPERATURES)).orderBy("nll", "temperature").first()
    return r["temperature"], r["nll"]


def stacked(train: DataFrame, inputs: list[str], label: str) -> PipelineModel:
    """A logistic regression on other models' probabilities and features, each scaled to mean 0 and deviation 1."""
    stages = [VectorAssembler(inputCols=inputs, outputCol="s_x", handleInvalid="keep"), StandardScaler(inputCol="s_x", outputCol="features", withMean=True), LogisticRegression(labelCol=label, maxIter=200)]
    return Pipeline(stages=stages).fit(train)


def experiment(train: DataFrame, test: DataFrame, text: str, label: str, labels: list[str], **settings) -> DataFrame:
    """One row: the settings and accuracy, macro_f1, weighted_f1 on test of a classifier fitted to train."""
    model = tfidf_classifier(balanced(train, label), text, label, **settings)
    scores = summary(predicted(model, test, text), label, "predicted_label", labels)
    return scores.withColumns({f"s_{k}": F.lit(str(v)) for k, v in settings.items()})


#: Settings that decide features; the others decide a fit.
FEATURES = ("vocabulary", "pairs", "damped")


def sweep(train: DataFrame, test: DataFrame, text: str, label: str, labels: list[str], grid: list[dict], *, folder: str | None = None, parallel: int = 4) -> DataFrame:
    """A row for each setting of the grid, as experiment() gives it, in order.

    Features are made once for each distinct choice of FEATURES and written to folder (the shared one, if not given); the fits of the grid read
    them side by side, each from a thread of its own in a scheduler pool of its own, so that small fits fill the cluster together."""
    spark = train.sparkSession
    folder = folder or workdir(spark)
    index = StringIndexer(inputCol=label, outputCol="m_label", handleInvalid="keep", stringOrderType="alphabetAsc")
    made: dict[tuple, tuple] = {}
    for settings in grid:
        key = tuple((k, settings[k]) for k in FEATURES if k in settings)
        if key in made:
            continue
        chosen = {"vocabulary": VOCABULARY, "pairs": True, "damped": False} | dict(key)
        rows = balanced(train, label).withColumn(text, F.coalesce(text, F.lit("")))
        model = Pipeline(stages=[*_text_stages(text, **chosen), index]).fit(rows)
        blind = PipelineModel(model.stages[:-1])
        at = f"{folder}/features-{len(made)}-{uuid.uuid4().hex}"
        model.transform(rows).select("features", "m_label", "weight").write.parquet(f"{at}/train")
        blind.transform(test.withColumn(text, F.coalesce(text, F.lit("")))).select("features", F.col(label).alias("y")).write.parquet(f"{at}/test")
        made[key] = at, model.stages[-1].labels

    def fit(i: int) -> dict:
        settings = grid[i]
        at, names = made[tuple((k, settings[k]) for k in FEATURES if k in settings)]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sweep-{i}")
        rest = {"kind": "logistic", "weight": "weight", "iterations": 50, "reg": 0.001} | {k: v for k, v in settings.items() if k not in FEATURES}
        model = _solver(**rest).fit(spark.read.parquet(f"{at}/train"))
        said = F.try_element_at(F.array(*[F.lit(x) for x in names]), F.col("prediction").cast("int") + 1)
        return summary(model.transform(spark.read.parquet(f"{at}/test")).withColumn("said", said), "y", "said", labels).first().asDict()

    with ThreadPool(min(parallel, len(grid))) as pool:
        scores = pool.map(fit, range(len(grid)))
    names = list(dict.fromkeys(k for s in grid for k in s))
    rows = [(*[r[c] for c in ("accuracy", "macro_f1", "weighted_f1")], *[str(s[k]) if k in s else None for k in names]) for r, s in zip(scores, grid, strict=True)]
    return spark.createDataFrame(rows, "accuracy double, macro_f1 double, weighted_f1 double" + "".join(f", s_{k} string" for k in names))


def predicted(model: PipelineModel, rows: DataFrame, text: str) -> DataFrame:
    """rows with predicted_label."""
    indexer = next(s for s in model.stages if hasattr(s, "labels"))
    names = F.array(*[F.lit(x) for x in indexer.labels])
    blind = PipelineModel([s for s in model.stages if s is not indexer])
    out = blind.transform(rows.withColumn(text, F.coalesce(text, F.lit(""))))
    return out.withColumn("predicted_label", F.try_element_at(names, F.col("prediction").cast("int") + 1)).select(*rows.columns, "predicted_label")


def hybrid(rule: Column, model_label: Column, confidence: Column, threshold: float, default: str) -> Column:
    """The rule's label if there is one, else the model's if it is sure enough, else the default."""
    return F.coalesce(rule, F.when(confidence >= threshold, model_label), F.lit(default))


def two_stage(rows: DataFrame, label: str, confidence: str) -> DataFrame:
    """rows with stage1 (explicit_density or unclear_or_no_evidence), stage2 (the class where explicit) and a positive weight."""
    explicit = F.coalesce(F.col(label).isin("solid", "part_solid", "ground_glass", "calcified"), F.lit(False))
    return rows.select("*", F.when(explicit, "explicit_density").otherwise("unclear_or_no_evidence").alias("stage1"), F.when(explicit, F.col(label)).alias("stage2"), F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(1e-6)).alias("stage_weight"))
