"""Roll-ups of model introspection results: layers, attention heads, top labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def layer_activation(results: DataFrame) -> DataFrame:
    rows = results.select(F.explode("layer_activation").alias("l")).select("l.*")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return rows.groupBy("layer").agg(mean("mean_norm"), mean("max_norm"), mean("mean_abs"))


def attention_by_head(results: DataFrame) -> DataFrame:
    rows = results.select(F.explode("attention").alias("a")).select("a.*")
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return rows.groupBy("layer", "head").agg(mean("mean"), mean("max"), mean("entropy"))


def clause_summary(results: DataFrame) -> DataFrame:
    """Clauses and mean token count per top label."""
    return results.groupBy("top_label").agg(
        F.count(F.lit(1)).alias("clauses"), F.round(F.avg("token_count"), 6).alias("avg_token_count"))
