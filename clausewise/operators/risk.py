"""Beta-posterior risk from predicted labels and confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions import scoring
from clausewise.operators.ordering import top_k


def read_priors(spark, path: str | None, defaults=None) -> dict:
    """Per-level (alpha, beta) from a JSON object; invalid values keep the default."""
    defaults = dict(defaults or lexicon.BETA_PRIORS)
    if path is None:
        return defaults
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "map<string,map<string,string>>").alias("m"))
    fields = []
    for level, (a, b) in defaults.items():
        at = lambda name: F.try_element_at(F.try_element_at("m", F.lit(level)), F.lit(name))
        fields.append(F.struct(scoring.positive_or_default(at("alpha"), a).alias("alpha"),
                               scoring.positive_or_default(at("beta"), b).alias("beta")).alias(level))
    row = parsed.select(*fields).first()
    return {l: (row[l]["alpha"], row[l]["beta"]) for l in defaults}


def _level(key: str):
    return F.coalesce(F.lower(F.trim(F.col(key))), F.lit(""))


def beta_posterior(predictions: DataFrame, priors=None, key: str = "predicted_label") -> DataFrame:
    """Posterior per level; ``key='actual_label'`` counts each row with confidence 1.

    Levels without rows keep their prior. One aggregation, one row out per level.
    """
    priors = dict(priors or lexicon.BETA_PRIORS)
    conf = F.lit(1.0) if key == "actual_label" else scoring.bounded_probability("confidence")
    rows = predictions.select(_level(key).alias("level"), conf.alias("c"))
    sums = rows.groupBy("level").agg(
        F.sum("c").alias("_c"), F.count(F.lit(1)).alias("evidence_count"))
    spark = predictions.sparkSession
    dim = spark.createDataFrame(
        [(l, float(a), float(b), list(lexicon.LEVEL_INDICATORS.get(l, ())))
         for l, (a, b) in priors.items()],
        "level string, prior_alpha double, prior_beta double, indicators array<string>")
    n = F.coalesce("evidence_count", F.lit(0))
    got = F.coalesce("_c", F.lit(0.0))
    out = dim.join(sums, "level", "left").select(
        "level", "indicators", "prior_alpha", "prior_beta",
        (F.col("prior_alpha") + got).alias("_a"), (F.col("prior_beta") + n - got).alias("_b"),
        n.alias("evidence_count"))
    lower, upper = scoring.beta_interval("_a", "_b")
    return out.select(
        "level", "indicators", "prior_alpha", "prior_beta",
        F.round("_a", 6).alias("alpha"), F.round("_b", 6).alias("beta"),
        scoring.beta_mean("_a", "_b").alias("_mean"),
        F.round(scoring.beta_mean("_a", "_b"), 6).alias("mean"),
        F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"), "evidence_count")


def overall_risk(posterior: DataFrame) -> DataFrame:
    """Evidence-weighted mean; without evidence, the mean of the level means."""
    n = F.sum("evidence_count")
    weighted = F.sum(F.col("_mean") * F.col("evidence_count")) / n
    plain = F.avg(scoring.beta_mean("alpha", "beta"))
    return posterior.agg(
        F.round(F.when(n > 0, weighted).otherwise(plain), 6).alias("posterior_mean"),
        n.alias("evidence_count"))


def top_contributors(predictions: DataFrame, k: int = 5, key: str = "predicted_label",
                     seq: str = "example_id", levels=lexicon.LEVELS) -> DataFrame:
    """k most confident rows per level by rounded confidence, input order on ties."""
    conf = F.lit(1.0) if key == "actual_label" else scoring.bounded_probability("confidence")
    rows = predictions.withColumn("level", _level(key)).where(F.col("level").isin(list(levels)))
    rows = rows.withColumn("confidence", F.round(conf, 6)).drop("probabilities", "text")
    return top_k(rows, ["level"], [F.col("confidence").desc(), F.col(seq)], max(k, 1))


def prior_drift(predictions: DataFrame, priors=None, gap: float = 0.4) -> DataFrame:
    """Prior mean against the observed label rate; flagged beyond ``gap``."""
    priors = dict(priors or lexicon.BETA_PRIORS)
    labels = predictions.select(_level("actual_label").alias("level"))
    one = labels.agg(*[F.count_if(F.col("level") == l).alias(l) for l in priors])
    total = sum((F.col(l) for l in list(priors)[1:]), F.col(list(priors)[0]))
    rows = one.where(total > 0).select(F.explode(F.array(*[
        F.struct(F.lit(l).alias("level"), F.lit(a / (a + b) if a + b > 0 else None).alias("prior_mean"),
                 (F.col(l) / total).alias("empirical")) for l, (a, b) in priors.items()])).alias("d"))
    rows = rows.select("d.*").where(F.col("prior_mean").isNotNull())
    return rows.select("level", F.round("prior_mean", 6).alias("prior_mean"),
                       F.round("empirical", 6).alias("empirical"),
                       (F.abs(F.col("prior_mean") - F.col("empirical")) > gap).alias("drifted"))
