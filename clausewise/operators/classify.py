"""Clause classifiers: naive Bayes as tables, TF-IDF logistic regression, any scorer."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions import text
from clausewise.functions.probabilities import argmax_label
from clausewise.operators.ordering import lookup_skew_safe, materialize


# --- naive Bayes ------------------------------------------------------------------

@dataclass(frozen=True)
class NaiveBayesTables:
    """A fitted model as DataFrames, so it can be written, read and joined."""

    classes: DataFrame  # label, docs, tokens
    tokens: DataFrame   # token, total, c_<label> ...
    labels: tuple[str, ...]
    alpha: float = 1.0

    def settings(self) -> DataFrame:
        """One row: a struct of everything but the token counts."""
        per_class = []
        for i, l in enumerate(self.labels):
            per_class += [
                F.coalesce(F.sum(F.when(F.col("label") == l, F.col("docs"))), F.lit(0)).alias(f"d{i}"),
                F.coalesce(F.sum(F.when(F.col("label") == l, F.col("tokens"))), F.lit(0)).alias(f"t{i}")]
        vocab = self.tokens.agg(F.count(F.lit(1)).alias("v"))
        return self.classes.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), *per_class).withColumn(
            "v", vocab.scalar()).select(F.struct("*").alias("s"))

    def write(self, path: str) -> None:
        self.classes.write.mode("overwrite").parquet(f"{path}/classes")
        self.tokens.write.mode("overwrite").parquet(f"{path}/tokens")
        meta = self.classes.sparkSession.createDataFrame(
            [(list(self.labels), float(self.alpha))], "labels array<string>, alpha double")
        meta.write.mode("overwrite").json(f"{path}/settings")

    @staticmethod
    def read(spark, path: str) -> "NaiveBayesTables":
        meta = spark.read.schema("labels array<string>, alpha double").json(
            f"{path}/settings").first()
        return NaiveBayesTables(spark.read.parquet(f"{path}/classes"),
                                spark.read.parquet(f"{path}/tokens"),
                                tuple(meta["labels"]), meta["alpha"])


def nb_fit(examples: DataFrame, labels=lexicon.LEVELS, alpha: float = 1.0) -> NaiveBayesTables:
    """Document, token and per-token counts by class; texts without tokens ignored.

    Like any fit this runs at once: the two count tables are materialized, since each
    prediction reads them several times.
    """
    labels = tuple(labels)
    rows = examples.where(F.col("label").isin(list(labels))).select(
        "label", text.tokenize("text").alias("_t"))
    classes = rows.where(F.size("_t") > 0).groupBy("label").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("_t")).alias("tokens"))
    each = text.unfold(rows, "_t", "_pos", "token")
    tokens = each.groupBy("token").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("label") == l).alias(f"c_{l}") for l in labels])
    return NaiveBayesTables(materialize(classes), materialize(tokens), labels, alpha)


def nb_predict(docs: DataFrame, model: NaiveBayesTables, keys: list[str],
               text_col: str = "text") -> DataFrame:
    """``keys`` + probabilities MAP, predicted_label, confidence.

    Tokens the model never saw still count (with alpha), and a text without tokens
    gets the class priors. The first key must identify the text.
    """
    labels, alpha = model.labels, float(model.alpha)
    counts = [f"c_{l}" for l in labels]
    tokens = docs.select(*keys, F.posexplode_outer(text.tokenize(text_col)).alias("_p", "token"))
    met = lookup_skew_safe(tokens, model.tokens, "token", "total", keys[0], counts)
    seen = F.col("token").isNotNull()
    sums = met.groupBy(*keys).agg(
        F.count("token").alias("_len"),
        *[F.coalesce(F.sum(F.when(seen, F.log(F.coalesce(F.col(c), F.lit(0)) + alpha))), F.lit(0.0))
          .alias(f"_l{i}") for i, c in enumerate(counts)])
    step = sums.withColumn("_m", model.settings().scalar())
    vocab = F.greatest(F.col("_m.v"), F.lit(1))
    score = [
        F.log((F.col(f"_m.d{i}") + alpha) / (F.col("_m.n") + alpha * len(labels)))
        + F.col(f"_l{i}") - F.col("_len") * F.log(F.col(f"_m.t{i}") + alpha * vocab)
        for i in range(len(labels))]
    # Arrays keep the softmax short: a filter on the label is pushed into these
    # projections by substitution, which must not multiply their size.
    step = step.select(*keys, F.array(*score).alias("_s"))
    step = step.withColumn("_e", F.transform("_s", lambda x: F.exp(x - F.array_max("_s"))))
    total = F.aggregate("_e", F.lit(0.0), lambda acc, x: acc + x)
    step = step.select(*keys, F.map_from_arrays(
        lexicon.strings(labels), F.transform("_e", lambda x: x / total)).alias("probabilities"),
        F.get(lexicon.strings(labels), F.array_position("_e", F.array_max("_e")).cast("int") - 1)
        .alias("predicted_label"))
    return step.withColumn("confidence", F.element_at("probabilities", F.col("predicted_label")))


def model_signal(docs: DataFrame, model: NaiveBayesTables, text_col: str = "policy_text",
                 key: str = "doc_id", max_score: float = 5.0) -> DataFrame:
    """Share of labels seen among a document's clauses plus its mean confidence.

    ``label_distribution`` counts the clauses of each label; it is empty for a document
    without clauses.
    """
    clauses = text.explode_clauses(
        text.with_clauses(docs.select(key, text_col), text_col, "clauses").drop(text_col))
    pred = nb_predict(clauses, model, [key, "clause_index"], "clause")
    stats = pred.groupBy(key).agg(
        F.count_distinct(F.when(F.col("predicted_label").isin(list(model.labels)),
                                F.col("predicted_label"))).alias("labels_represented"),
        F.avg("confidence").alias("_c"),
        F.create_map(*[x for l in model.labels for x in (
            F.lit(l), F.count_if(F.col("predicted_label") == l))]).alias("_d"))
    part = (F.least(F.lit(3.0), F.col("labels_represented")) / 3.0 * 3.0
            + F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("_c") * 2.0)))
    scored = stats.withColumn("_s", part)
    out = docs.select(key).join(scored, key, "left")
    return out.select(
        key, F.coalesce(F.round("_s", 2), F.lit(0.0)).alias("score"),
        F.lit(max_score).alias("max_score"),
        F.coalesce(F.col("_s") >= 2.5, F.lit(False)).alias("passed"),
        F.coalesce("labels_represented", F.lit(0)).alias("labels_represented"),
        F.round("_c", 6).alias("avg_confidence"),
        F.coalesce("_d", F.create_map().cast("map<string,bigint>")).alias("label_distribution"))


# --- TF-IDF and logistic regression ------------------------------------------------

def class_weights(examples: DataFrame, labels=lexicon.LEVELS) -> DataFrame:
    """Balanced weight per label: total / (classes * max(count, 1)); all labels listed."""
    labels = list(labels)
    kept = examples.where(F.col("label").isin(labels))
    one = kept.agg(F.count(F.lit(1)).alias("total"),
                   *[F.count_if(F.col("label") == l).alias(l) for l in labels])
    rows = one.select(F.explode(F.array(*[
        F.struct(F.lit(l).alias("label"), F.col(l).alias("rows"),
                 (F.col("total") / (len(labels) * F.greatest(F.col(l), F.lit(1)))).alias("weight"))
        for l in labels])).alias("w"))
    return rows.select("w.*")


def tfidf_logreg(labels=lexicon.LEVELS, max_features: int = 20_000, ngram_max: int = 2,
                 min_df: int = 2, max_df: float = 0.95, c: float = 1.0, max_iter: int = 1000):
    """Fit function for a class-balanced multinomial regression on TF-IDF n-grams."""
    def fit(examples: DataFrame) -> "LogRegModel":
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer

        order = list(labels)
        rows = examples.where(F.col("label").isin(order) & (F.trim("text") != ""))
        w = class_weights(rows, order)
        weight = F.create_map(*[x for r in w.collect() for x in (F.lit(r["label"]), F.lit(r["weight"]))])
        index = F.array_position(lexicon.strings(order), F.col("label")) - 1
        rows = rows.select("text", index.cast("double").alias("label_index"),
                           F.element_at(weight, F.col("label")).alias("weight"))
        stages = [RegexTokenizer(inputCol="text", outputCol="g1", gaps=False, toLowercase=True,
                                 pattern=r"(?U)\b[a-zA-Z0-9][a-zA-Z0-9']+\b")]
        for n in range(2, ngram_max + 1):
            stages.append(NGram(n=n, inputCol="g1", outputCol=f"g{n}"))
        prep = Pipeline(stages=stages).fit(rows)
        grams = _join_grams(prep.transform(rows), ngram_max)
        counter = CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=max_features,
                                  minDF=float(min_df), maxDF=max_df).fit(grams)
        tf = counter.transform(grams)
        docs = tf.count()
        df = _document_frequencies(tf, len(counter.vocabulary))
        idf = [float(_smooth_idf(docs, n)) for n in df]
        total = rows.agg(F.sum("weight")).first()[0]
        regression = LogisticRegression(
            featuresCol="features", labelCol="label_index", weightCol="weight",
            family="multinomial", standardization=False, regParam=1.0 / (c * total),
            maxIter=max_iter)
        return LogRegModel(prep, counter, idf, regression.fit(_tfidf(tf, idf)), order, ngram_max)

    return fit


def _smooth_idf(docs: int, df: float) -> float:
    import math

    return math.log((1 + docs) / (1 + df)) + 1


def _join_grams(df: DataFrame, ngram_max: int) -> DataFrame:
    return df.withColumn("grams", F.concat(*[F.col(f"g{n}") for n in range(1, ngram_max + 1)]))


def _document_frequencies(tf: DataFrame, size: int) -> list[int]:
    """Rows per vocabulary entry; at most ``max_features`` numbers come back."""
    from pyspark.ml.functions import vector_to_array  # noqa: F401  (kept lazy)
    from pyspark.ml.stat import Summarizer

    row = tf.select(Summarizer.metrics("numNonZeros").summary(F.col("tf")).alias("s")).first()
    return [int(x) for x in row["s"]["numNonZeros"].toArray()] if size else []


def _tfidf(tf: DataFrame, idf: list[float]) -> DataFrame:
    """Sublinear term frequency x idf, L2-normalized, as sparse vectors."""
    import numpy as np
    from pyspark.ml.feature import ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT

    @F.udf(VectorUDT())
    def sublinear(v):
        return SparseVector(v.size, v.indices, 1.0 + np.log(v.values))

    scaled = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="sub",
                                outputCol="scaled").transform(tf.withColumn("sub", sublinear("tf")))
    return Normalizer(p=2.0, inputCol="scaled", outputCol="features").transform(scaled)


@dataclass
class LogRegModel:
    prep: object
    counter: object
    idf: list
    model: object
    labels: list
    ngram_max: int

    def predict(self, docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        rows = docs.select(*keys, F.col(text_col).alias("text"))
        grams = _join_grams(self.prep.transform(rows), self.ngram_max)
        out = self.model.transform(_tfidf(self.counter.transform(grams), self.idf))
        p = vector_to_array("probability")
        pairs = []
        for i, l in enumerate(self.labels):
            pairs += [F.lit(l), F.coalesce(F.get(p, F.lit(i)), F.lit(0.0))]
        out = out.select(*keys, F.create_map(*pairs).alias("probabilities"))
        out = out.withColumn("predicted_label", argmax_label("probabilities", self.labels))
        return out.withColumn("confidence", F.element_at("probabilities", F.col("predicted_label")))


# --- any other scorer ----------------------------------------------------------------

def score_with(docs: DataFrame, make_scorer: Callable[[], Callable], keys: list[str],
               text_col: str = "text", labels=lexicon.LEVELS) -> DataFrame:
    """Label probabilities from a user function on Arrow batches.

    ``make_scorer`` runs once per task and returns ``Series of text -> DataFrame with
    one column per label``; rows are renormalized, and spread evenly without mass.
    """
    order = list(labels)

    @F.pandas_udf(", ".join(f"`{l}` double" for l in order))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            p = scorer(batch).reindex(columns=order).fillna(0.0).astype("float64")
            mass = p.sum(axis=1)
            out = p.div(mass.where(mass > 0, 1.0), axis=0)
            out[mass <= 0] = 1.0 / max(len(order), 1)
            yield out.reset_index(drop=True)

    scored = docs.select(*keys, score(F.col(text_col)).alias("_p"))
    pairs = []
    for l in order:
        pairs += [F.lit(l), F.col("_p")[l]]
    out = scored.select(*keys, F.create_map(*pairs).alias("probabilities"))
    out = out.withColumn("predicted_label", argmax_label("probabilities", order))
    return out.withColumn("confidence", F.element_at("probabilities", F.col("predicted_label")))


# Names a model may be asked for by.
MODEL_ALIASES = {
    "naive_bayes": "naive_bayes", "nb": "naive_bayes",
    "logreg_tfidf": "logreg_tfidf", "logistic_regression": "logreg_tfidf",
    "lr_tfidf": "logreg_tfidf",
}


def train_classifier(examples: DataFrame, model_type: str = "naive_bayes",
                     labels=lexicon.LEVELS, scorers: dict | None = None, **options):
    """Returns predict(docs, keys, text_col) for a named model.

    ``scorers`` adds names of one's own: each maps to a ``make_scorer`` for
    :func:`score_with` (for example an ONNX transformer loaded on the worker).
    """
    name = model_type.strip().lower()
    if scorers and name in scorers:
        make = scorers[name]
        return lambda docs, keys, text_col="text": score_with(docs, make, keys, text_col, labels)
    kind = MODEL_ALIASES.get(name)
    if kind == "naive_bayes":
        model = nb_fit(examples, labels, **options)
        return lambda docs, keys, text_col="text": nb_predict(docs, model, keys, text_col)
    if kind == "logreg_tfidf":
        fitted = tfidf_logreg(labels, **options)(examples)
        return fitted.predict
    raise ValueError(f"Unsupported model_type '{model_type}'")
