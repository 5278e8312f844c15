"""Control metrics: specs from controls, observation scoring, level and scenario scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions import scoring, text


def build_metric_specs(controls: DataFrame) -> DataFrame:
    """One metric per control with an id; level from wording, weight from confidence."""
    control_id = text.strip("normalized_id")
    typed = controls.where(control_id != "").select(
        control_id.alias("control_id"),
        F.coalesce(text.blank_to_null("regulation"), F.lit("unknown")).alias("regulation"),
        text.classify_level("title", "text").alias("level"),
        text.metric_name("regulation", "native_id", "title").alias("metric_name"),
        F.coalesce("parser_confidence", F.lit(0.8)).alias("_confidence"),
        *[c for c in ("native_id", "chapter", "section", "seq") if c in controls.columns],
    )
    formula = required = None
    for level in lexicon.LEVELS:
        f = F.lit(lexicon.LEVEL_FORMULAS[level])
        r = lexicon.strings(lexicon.LEVEL_REQUIRED_FIELDS[level])
        hit = F.col("level") == level
        formula = F.when(hit, f) if formula is None else formula.when(hit, f)
        required = F.when(hit, r) if required is None else required.when(hit, r)
    key = F.concat_ws("|", "control_id", "level")
    extra = []
    for name in ("native_id", "chapter", "section"):
        extra += [F.lit(name), F.coalesce(F.col(name), F.lit("")) if name in typed.columns
                  else F.lit("")]
    return typed.select(
        F.concat(F.lit("metric::"), F.substring(text.stable_hash(key), 1, 16)).alias("metric_id"),
        "control_id", "regulation", "level", "metric_name",
        formula.alias("formula"),
        required.alias("required_fields"),
        F.lit(lexicon.NORMALIZATION_RULE).alias("normalization_rule"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.1), F.col("_confidence"))).alias(
            "confidence_weight"),
        F.lit(lexicon.MISSING_DATA_RULE).alias("missing_data_handling"),
        F.lit("active").alias("status"),
        F.create_map(*extra).alias("metadata"),
    )


def metric_coverage(controls: DataFrame, specs: DataFrame,
                    levels=lexicon.LEVELS) -> DataFrame:
    """One row: distinct controls, mapped, unmapped, active/deferred, count per level.

    The unmapped ids themselves are :func:`missing_controls`, a table, because the
    list grows with the data. A level outside ``levels`` fails the query.
    """
    ids = controls.select(text.strip("normalized_id").alias("control_id")).where(
        F.col("control_id") != "").distinct()
    unknown = F.count_if(~F.col("level").isin(list(levels)))
    s = specs.agg(
        F.count_distinct("control_id").alias("mapped_controls"),
        F.count_if(F.col("status") == "active").alias("active_metric_count"),
        F.count_if(F.col("status") != "active").alias("deferred_metric_count"),
        *[F.count_if(F.col("level") == l).alias(f"level_{l}") for l in levels],
        F.when(unknown > 0, F.raise_error(F.lit("metric specs with unsupported levels")))
        .alias("_guard"),
    )
    guard = F.coalesce(F.col("_guard").cast("string"), F.lit(""))
    c = ids.agg(F.count(F.lit(1)).alias("total_controls"))
    m = missing_controls(controls, specs).agg(F.count(F.lit(1)).alias("missing_count"))
    return (s.withColumn("total_controls", c.scalar())
            .withColumn("missing_controls", m.scalar())
            .where(guard == "").drop("_guard"))


def missing_controls(controls: DataFrame, specs: DataFrame) -> DataFrame:
    ids = controls.select(text.strip("normalized_id").alias("control_id")).where(
        F.col("control_id") != "").distinct()
    return ids.join(specs.select("control_id"), "control_id", "left_anti")


def score_observations(observations: DataFrame, specs: DataFrame, order: str = "seq") -> DataFrame:
    """Scored observation rows; observations without a spec are dropped.

    Of specs that repeat a metric id the last one counts, by the ``order`` column where
    there is one and else by control id and weight.

    ``_adjusted`` is the unrounded score the summaries average. Works on a
    streaming ``observations`` too: the join is stream-static and stateless.
    """
    values = ["control_id", "confidence_weight"]
    by = [c for c in (order, *values) if c in specs.columns]
    dim = specs.groupBy("metric_id").agg(
        F.max_by(F.struct(*values), F.struct(*by)).alias("_s")).select("metric_id", "_s.*")
    raw = 1.0 - F.col("failure_count") / F.greatest("total_checks", F.lit(1))
    adjusted = scoring.clamp01(
        scoring.clamp01("_raw") * (1.0 - scoring.missing_penalty("missing_fields"))
        * F.col("observed_confidence") * F.col("confidence_weight"))
    return (
        observations.join(dim, "metric_id")
        .withColumn("_raw", raw)
        .withColumn("_adjusted", adjusted)
        .withColumn("_risk", scoring.clamp01(1.0 - F.col("_adjusted")))
        .select(
            "scenario", "level", "entity_id", "metric_id", "control_id",
            "total_checks", "failure_count", "missing_fields",
            F.round("_raw", 6).alias("raw_score"),
            F.round(scoring.clamp01("_raw"), 6).alias("normalized_score"),
            F.round("_adjusted", 6).alias("confidence_adjusted_score"),
            F.round("_risk", 6).alias("risk_score"),
            scoring.risk_band("_risk").alias("risk_band"),
            "_adjusted",
        )
    )


def level_summary(scored: DataFrame) -> DataFrame:
    mean = F.avg("_adjusted")
    return (
        scored.groupBy("scenario", "level")
        .agg(F.count(F.lit(1)).alias("sample_size"), mean.alias("_mean"))
        .withColumn("_risk", scoring.clamp01(1.0 - F.col("_mean")))
        .select("scenario", "level", "sample_size",
                F.round("_mean", 6).alias("compliance_score"),
                F.round("_risk", 6).alias("risk_score"),
                scoring.risk_band("_risk").alias("risk_band"))
    )


def scenario_composite(levels: DataFrame, weights=None) -> DataFrame:
    """Weighted mean of the rounded level scores over the levels present."""
    weights = weights or lexicon.LEVEL_WEIGHTS
    w = None
    for level, value in weights.items():
        hit = F.col("level") == level
        w = F.when(hit, F.lit(float(value))) if w is None else w.when(hit, F.lit(float(value)))
    return (
        levels.withColumn("_w", w).where(F.col("_w").isNotNull())
        .groupBy("scenario")
        .agg(F.sum(F.col("compliance_score") * F.col("_w")).alias("_s"),
             F.sum("_w").alias("_t"))
        .where(F.col("_t") > 0)
        .withColumn("_mean", F.col("_s") / F.col("_t"))
        .withColumn("_risk", scoring.clamp01(1.0 - F.col("_mean")))
        .select("scenario", F.lit("weighted_sum_v1").alias("composite_method"),
                F.round("_mean", 6).alias("compliance_score"),
                F.round("_risk", 6).alias("risk_score"),
                scoring.risk_band("_risk").alias("risk_band"))
    )


def risk_band_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy(F.coalesce("risk_band", F.lit("unknown")).alias("risk_band")).agg(
        F.count(F.lit(1)).alias("rows"))


def link_claims(observations: DataFrame, claims: DataFrame, seed: str = "42") -> DataFrame:
    """Attach one policy claim to each observation and adjust its failure rate.

    A claim of the same (scenario, metric) wins; otherwise one of the same
    (scenario, level); otherwise none. Among several the pick is by hash of the
    observation, modulo the number of candidates. Level pools can be huge, so the
    claims are ranked once and joined on (pool, position): no pool is collected.
    """
    from clausewise.operators.ordering import rank_by_hash

    keyed = claims.withColumn("_h", F.md5(F.concat_ws("|", F.lit(seed), F.col("claim_id"))))
    fields = ["claim_id", "compliance_status"]

    def pool(group):
        ranked = rank_by_hash(keyed.select(*group, "_h", *fields), group, "_h", "claim_id",
                              out="_pos", count_out="_n")
        return ranked.drop("_h")

    by_metric, by_level = pool(["scenario", "metric_id"]), pool(["scenario", "level"])
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("observation_id"))),
                              1, 8), 16, 10).cast("bigint")
    obs = observations.withColumn("_draw", draw)

    def attach(df, ranked, group, tag):
        sizes = ranked.groupBy(*group).agg(F.max("_n").alias(f"_{tag}_n"))
        df = df.join(sizes, group, "left").withColumn(
            f"_{tag}_pos", F.col("_draw") % F.col(f"_{tag}_n") + 1)
        right = ranked.select(*group, F.col("_pos").alias(f"_{tag}_pos"),
                              F.struct(*fields).alias(f"_{tag}"))
        return df.join(right, [*group, f"_{tag}_pos"], "left")

    linked = attach(obs, by_metric, ["scenario", "metric_id"], "metric")
    linked = attach(linked, by_level, ["scenario", "level"], "level")
    pick = F.coalesce("_metric", "_level")
    return linked.select(
        *observations.columns,
        pick["claim_id"].alias("claim_id"),
        pick["compliance_status"].alias("compliance_status"),
        F.when(F.col("_metric").isNotNull(), "metric").when(F.col("_level").isNotNull(), "level")
        .otherwise("none").alias("link"),
    ).withColumn("adjusted_rate",
                 scoring.claim_adjusted_rate("base_failure_rate", "compliance_status"))
