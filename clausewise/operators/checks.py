"""Policy checks by wording, schema alignment, and the combined policy/schema score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions import records, scoring, text


def matched_checks(lowered: Column, specs=lexicon.CHECK_SPECS) -> Column:
    """Per check, the keywords found in lower-cased text, as an array of structs.

    Plain CASE expressions over constants: the whole lookup is generated code and
    the contains-join with the check table becomes a map-side expansion.
    """
    return F.array(*[
        F.struct(
            F.lit(seq).alias("check_seq"),
            F.lit(check_id).alias("check_id"),
            F.lit(title).alias("check_title"),
            F.lit(float(weight)).alias("weight"),
            F.lit(len(keywords)).alias("n_keywords"),
            F.array_compact(F.array(*[
                F.when(F.contains(lowered, F.lit(k)), F.lit(k)) for k in keywords
            ])).alias("matched"),
        )
        for seq, (check_id, title, weight, keywords) in enumerate(specs)
    ])


def policy_check_scores(docs: DataFrame, text_col: str = "policy_text", key: str = "doc_id",
                        specs=lexicon.CHECK_SPECS, evidence_per_check: int = 3) -> DataFrame:
    """Every (document, check): coverage-weighted score and first evidence clauses.

    Matching reads the whole normalized text. Nothing is shuffled: clauses, checks
    and evidence are worked out inside the document row, which is then unfolded.
    """
    low = docs.select(key, text_col).withColumn(
        "_low", F.lower(text.normalize_space(text_col)))
    rows = low.withColumn("_checks", matched_checks(F.col("_low"), specs))
    rows = text.with_clauses(rows, text_col, "_clauses")
    exploded = text.unfold_structs(rows, "_checks", key, "_clauses")
    hits = F.filter(
        "_clauses",
        lambda c: F.exists(F.col("matched"), lambda k: F.contains(F.lower(c), k)))
    coverage = F.least(F.lit(1.0), F.size("matched")
                       / F.greatest(F.lit(2.0), F.col("n_keywords") * F.lit(0.35)))
    return (
        exploded
        .withColumn("evidence", F.when(F.size("matched") > 0,
                                       F.slice(hits, 1, evidence_per_check))
                    .otherwise(F.array().cast("array<string>")))
        .withColumn("_score", F.when(F.size("matched") > 0, F.col("weight") * coverage)
                    .otherwise(0.0))
        .select(
            key, "check_id", F.col("check_title").alias("title"),
            F.round("_score", 2).alias("score"),
            F.round("weight", 2).alias("max_score"),
            (F.col("_score") >= F.col("weight") * 0.4).alias("passed"),
            (F.col("_score") > 0).alias("present"),
            F.col("matched").alias("matched_keywords"),
            "evidence",
        )
    )


def classify_schema(schemas: DataFrame, ddl_col: str = "schema_text",
                    key: str = "doc_id") -> DataFrame:
    """Field names per schema, and those that look personal or sensitive."""
    return (
        schemas.select(key, records.schema_fields(ddl_col).alias("fields"),
                       records.table_names(ddl_col).alias("tables"))
        .withColumn("pii_fields", records.pii_fields("fields"))
        .withColumn("sensitive_fields", records.sensitive_fields("fields"))
    )


# Alignment penalties (field kind, missing check, points, wording).
_ALIGNMENT_RULES = (
    ("pii", "user_rights", 4.0,
     "PII fields detected but user rights disclosures are weak."),
    ("pii", "security_safeguards", 4.0,
     "PII fields detected but security safeguards are weak."),
    ("pii", "third_party_sharing", 2.0,
     "PII fields detected but third-party sharing disclosures are weak."),
    ("pii", "data_retention", 2.0,
     "PII fields detected but retention details are weak."),
    ("sensitive", "security_safeguards", 3.0,
     "Sensitive fields detected but security language is insufficient."),
)
_SENSITIVE_WORDING = (
    2.0, "Sensitive fields detected but no explicit sensitive-data policy language found.")


def schema_alignment(docs: DataFrame, schemas: DataFrame, key: str = "doc_id",
                     text_col: str = "policy_text", ddl_col: str = "schema_text",
                     specs=lexicon.CHECK_SPECS, max_score: float = 15.0) -> DataFrame:
    """Points left after penalties for fields the policy text does not cover."""
    low = docs.select(key, F.lower(text.normalize_space(text_col)).alias("_low"))
    keywords = {check_id: kws for check_id, _, _, kws in specs}
    needed = dict.fromkeys(check for _, check, _, _ in _ALIGNMENT_RULES)
    presence = low.select(
        key,
        *[text.contains_any("_low", keywords[c]).alias(f"_has_{c}") for c in needed],
        text.contains_any("_low", ("sensitive", "special category")).alias("_has_wording"),
    )
    fields = classify_schema(schemas, ddl_col, key).select(
        key, F.size("fields").alias("fields_count"),
        F.size("pii_fields").alias("pii_fields_count"),
        F.size("sensitive_fields").alias("sensitive_fields_count"))
    joined = presence.join(fields, key)
    rules = [
        ((F.col(f"{kind}_fields_count") > 0) & ~F.col(f"_has_{check}"), points, wording)
        for kind, check, points, wording in _ALIGNMENT_RULES
    ]
    rules.append(((F.col("sensitive_fields_count") > 0) & ~F.col("_has_wording"),
                  *_SENSITIVE_WORDING))
    penalty = F.lit(0.0)
    for hit, points, _ in rules:
        penalty = penalty + F.when(hit, points).otherwise(0.0)
    return (
        joined.withColumn("_score", F.greatest(F.lit(0.0), F.lit(max_score) - penalty))
        .withColumn("details", F.array_compact(F.array(*[
            F.when(hit, F.lit(wording)) for hit, _, wording in rules])))
        .select(key, F.round("_score", 2).alias("score"),
                F.lit(max_score).alias("max_score"),
                (F.col("_score") >= max_score * 0.6).alias("passed"),
                "fields_count", "pii_fields_count", "sensitive_fields_count", "details")
    )


def policy_schema_score(docs: DataFrame, schemas: DataFrame, signal: DataFrame | None = None,
                        key: str = "doc_id", text_col: str = "policy_text",
                        ddl_col: str = "schema_text", specs=lexicon.CHECK_SPECS) -> DataFrame:
    """Check scores + schema alignment (+ model signal), 0-100, graded.

    ``signal`` is :func:`clausewise.operators.classify.model_signal`; without it the
    model part counts 0.
    """
    checks = policy_check_scores(docs, text_col, key, specs).groupBy(key).agg(
        F.sum("score").alias("check_points"), F.count_if("passed").alias("checks_passed"))
    aligned = schema_alignment(docs, schemas, key, text_col, ddl_col, specs).select(
        key, F.col("score").alias("alignment_points"), "pii_fields_count",
        "sensitive_fields_count", "fields_count")
    joined = checks.join(aligned, key)
    if signal is not None:
        joined = joined.join(signal.select(key, F.col("score").alias("_signal")), key, "left")
        joined = joined.withColumn("signal_points", F.coalesce("_signal", F.lit(0.0))).drop(
            "_signal")
    else:
        joined = joined.withColumn("signal_points", F.lit(0.0))
    total = F.col("check_points") + F.col("alignment_points") + F.col("signal_points")
    return (
        joined.withColumn("overall_score",
                          F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(total, 2))))
        .withColumn("check_points", F.round("check_points", 2))
        .withColumn("grade", scoring.grade("overall_score"))
        .withColumn("status", scoring.status("overall_score"))
    )


def band_score_summary(scored: DataFrame, band: str = "compliance_band",
                       score: str = "overall_score", within: str = "within_target_band",
                       bands=lexicon.BANDS) -> DataFrame:
    """Per band: rows, rows in target, min / mean / max score; empty bands kept."""
    spark = scored.sparkSession
    dim = spark.createDataFrame([(b, i) for i, b in enumerate(bands)], "band string, seq int")
    stats = scored.groupBy(F.col(band).alias("band")).agg(
        F.count(score).alias("_n"), F.count_if(F.col(within) & F.col(score).isNotNull()).alias("_hit"),
        F.round(F.min(score), 4).alias("minimum"), F.round(F.avg(score), 4).alias("mean"),
        F.round(F.max(score), 4).alias("maximum"))
    return dim.join(stats, "band", "left").select(
        "band", F.coalesce("_n", F.lit(0)).alias("count"),
        F.coalesce("_hit", F.lit(0)).alias("in_target_band"), "minimum", "mean", "maximum")
