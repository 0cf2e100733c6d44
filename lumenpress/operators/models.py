"""Trained models on Spark ML: text classifiers, topics, matrix factorisation. They stand in for models of other libraries."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, NaiveBayes
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, NGram
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _features(features: int) -> list:
    return [NGram(n=2, inputCol="tokens", outputCol="pairs"), HashingTF(inputCol="tokens", outputCol="tf1", numFeatures=features), HashingTF(inputCol="pairs", outputCol="tf2", numFeatures=features), IDF(inputCol="tf1", outputCol="f1"), IDF(inputCol="tf2", outputCol="f2")]


def naive_bayes(train: DataFrame, features: int = 1 << 14):
    """Multinomial naive Bayes with smoothing 0.1 on TF-IDF of words and word pairs; train: tokens, label (double)."""
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[*_features(features), VectorAssembler(inputCols=["f1", "f2"], outputCol="features"), NaiveBayes(smoothing=0.1)]).fit(train)


def linear_svc(train: DataFrame, features: int = 1 << 14):
    """A linear support-vector classifier on the same features (margins, not calibrated)."""
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[*_features(features), VectorAssembler(inputCols=["f1", "f2"], outputCol="features"), LinearSVC(maxIter=20, regParam=0.01)]).fit(train)


def calibrated_svc(train: DataFrame, features: int = 1 << 14) -> PipelineModel:
    """The support-vector classifier with probabilities: fitted on four fifths of train (id, tokens, label), its margins calibrated on the rest."""
    rest = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(5)) == 0
    svc = linear_svc(train.filter(~rest), features)
    platt = LogisticRegression(featuresCol="rawPrediction", labelCol="label", predictionCol="calibrated", probabilityCol="chances", rawPredictionCol="calibrated_raw")
    return PipelineModel([svc, platt.fit(svc.transform(train.filter(rest)).select("rawPrediction", "label"))])


def held_out(docs: DataFrame, folds: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out rows, by a hash of their ids."""
    out = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(folds)) == 0
    return docs.filter(~out), docs.filter(out)


def stored(model: PipelineModel, path: str) -> PipelineModel:
    """The model, written and loaded again."""
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def ensemble(scored: DataFrame, sure: float = 0.85) -> DataFrame:
    """The support-vector label if its confidence is high, the common label if both agree, else review.

    scored: id, svm, svm_confidence, nb.
    """
    choice = F.when(F.col("svm_confidence") >= sure, F.col("svm")).when(F.col("svm") == F.col("nb"), F.col("svm"))
    return scored.select("id", choice.alias("label"), choice.isNull().alias("review"))


def topics(docs: DataFrame, k: int = 20, iterations: int = 15, least_docs: int = 5, most_share: float = 0.5, seed: int = 42):
    """LDA topics of docs (id, tokens); terms in fewer or more documents than the bounds are left out."""
    n = docs.count()
    cv = CountVectorizer(inputCol="tokens", outputCol="features", minDF=min(least_docs, n), maxDF=max(1.0, most_share * n), vocabSize=1 << 14).fit(docs)
    model = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online").fit(cv.transform(docs))
    words = cv.vocabulary
    return model.describeTopics(10).select("topic", F.posexplode("termIndices").alias("place", "i"), "termWeights").select("topic", "place", F.element_at(F.lit(words), F.col("i") + 1).alias("term"), F.element_at("termWeights", F.col("place") + 1).alias("weight"))


def factorise(ratings: DataFrame, rank: int = 50, iterations: int = 10, seed: int = 42):
    """Matrix factorisation of (user_id, article_id, rating) by alternating least squares."""
    r = ratings.select(F.col("user_id").cast("int").alias("user"), F.col("article_id").cast("int").alias("item"), F.col("rating").cast("float").alias("rating"))
    return ALS(rank=rank, maxIter=iterations, regParam=0.1, seed=seed, coldStartStrategy="drop").fit(r)


def evaluate(ratings: DataFrame, folds: int = 3, rank: int = 10, seed: int = 42) -> list[tuple[int, float, float]]:
    """(fold, rmse, mae) of the factorisation on held-out ratings; folds by a hash of user and article."""
    fold = F.pmod(F.xxhash64("user_id", "article_id", F.lit(seed)), F.lit(folds))
    d, out = ratings.withColumn("fold", fold), []
    for k in range(folds):
        model = factorise(d.filter(F.col("fold") != k), rank)
        test = model.transform(d.filter(F.col("fold") == k).select(F.col("user_id").cast("int").alias("user"), F.col("article_id").cast("int").alias("item"), F.col("rating").cast("float").alias("rating")))
        out.append((k, *(RegressionEvaluator(metricName=m, labelCol="rating").evaluate(test) for m in ("rmse", "mae"))))
    return out


# The least probability of a label, and seeds of the orders of chains.
LABEL_FROM, CHAIN_SEEDS = 0.40, (11, 23, 37, 41, 53)


class MultiLabel:
    """Single models of labels, and chains in which each model also sees the labels before it; probabilities are averaged."""

    def __init__(self, base: PipelineModel, single: dict[str, LogisticRegression], chains: list[tuple[list[str], dict[str, LogisticRegression]]], least: float):
        self.base, self.single, self.chains, self.least = base, single, chains, least

    def transform(self, docs: DataFrame) -> DataFrame:
        """docs (tokens, ...) with labels: (label, confidence) from ``least`` on, the surest first."""
        from pyspark.ml.functions import vector_to_array

        d = self.base.transform(docs)
        chance = lambda k: vector_to_array(f"{k}_p")[1]
        sums = {n: F.lit(0.0) for n in self.single}
        for n, m in self.single.items():
            d = m.transform(d)
        for k, (order, models) in enumerate(self.chains):
            for n in order:
                d = _assembled(d, k, order[: order.index(n)], [f"c{k}_{x}_y" for x in order[: order.index(n)]])
                d = models[n].transform(d).drop(f"x{k}")
                sums[n] = sums[n] + chance(f"c{k}_{n}")
        both = {n: (chance(f"s_{n}") + sums[n] / len(self.chains)) / 2 if self.chains else chance(f"s_{n}") for n in self.single}
        found = F.array(*(F.struct((-both[n]).alias("back"), F.lit(n).alias("label")) for n in both))
        labels = F.transform(F.filter(F.array_sort(found), lambda x: -x["back"] >= self.least), lambda x: F.struct(x["label"].alias("label"), (-x["back"]).alias("confidence")))
        return d.select(*docs.columns, labels.alias("labels"))


def _assembled(d: DataFrame, k: int, before: list[str], columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=["features", *columns], outputCol=f"x{k}").transform(d)


def multilabel(train: DataFrame, names: list[str], features: int = 1 << 14, seeds: tuple[int, ...] = CHAIN_SEEDS, least: float = LABEL_FROM) -> MultiLabel:
    """Binary relevance and chains of logistic models on TF-IDF; train: tokens, and a column of 0.0 or 1.0 for each label.

    A chain's order is drawn from its seed; in training a model sees the true labels before it, later the predicted ones.
    A label that training rows all have, or none has, is predicted as such.
    """
    import random

    from pyspark.ml.feature import VectorAssembler

    base = Pipeline(stages=[*_features(features), VectorAssembler(inputCols=["f1", "f2"], outputCol="features")]).fit(train)
    rows = base.transform(train).select("features", *names).cache()
    fit = lambda d, n, x, out: LogisticRegression(featuresCol=x, labelCol=n, probabilityCol=f"{out}_p", predictionCol=f"{out}_y", rawPredictionCol=f"{out}_r", regParam=0.001, maxIter=40, family="binomial").fit(d)
    single = {n: fit(rows, n, "features", f"s_{n}") for n in names}
    chains = []
    for k, seed in enumerate(seeds):
        order = random.Random(seed).sample(names, len(names))
        chains.append((order, {n: fit(_assembled(rows, k, order[:i], order[:i]), n, f"x{k}", f"c{k}_{n}") for i, n in enumerate(order)}))
    rows.unpersist()
    return MultiLabel(base, single, chains, least)
