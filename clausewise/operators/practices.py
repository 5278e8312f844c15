"""Sentences with practice annotations turned into single-label clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.functions import text
from clausewise.operators.ordering import guard_unions


def practice_sentences(documents: DataFrame, include_synthetic: bool = False) -> DataFrame:
    """Every sentence with its mapped labels and the ``reason`` it is dropped for.

    Annotations are judged inside the sentence row. ``reason`` is null for kept rows.
    """
    docs = documents
    if not include_synthetic:
        docs = docs.where(~F.coalesce("contains_synthetic", F.lit(False)))
    pid = F.coalesce(text.blank_to_null(F.col("policy_id").cast("string")), F.lit("unknown"))
    head = docs.select(
        pid.alias("policy_id"), F.coalesce(text.strip("policy_name"), F.lit("")).alias("policy_name"),
        F.coalesce(text.blank_to_null("policy_type"), F.lit("unknown")).alias("policy_type"),
        F.coalesce("contains_synthetic", F.lit(False)).alias("contains_synthetic"), "segments")
    seg = text.unfold(head, "segments", "_s", "segment").select(
        "policy_id", "policy_name", "policy_type", "contains_synthetic",
        F.coalesce("segment.segment_id", F.lit(-1)).alias("segment_id"),
        F.col("segment.sentences").alias("sentences"))
    rows = text.unfold(seg, "sentences", "sentence_index", "sentence")
    judged = rows.withColumn("text", text.normalize_space(
        F.coalesce("sentence.sentence_text", F.lit("")))).withColumn(
        "_a", F.transform(F.coalesce("sentence.annotations", F.expr(
            "cast(array() as array<struct<practice:string,modality:string>>)")),
            lambda a: F.struct(
                text.strip(F.coalesce(a["practice"], F.lit(""))).alias("practice"),
                (F.upper(text.strip(F.coalesce(a["modality"], F.lit("")))) == "PERFORMED")
                .alias("performed"))))
    judged = judged.withColumn("_m", F.filter(
        F.transform("_a", lambda a: F.struct(
            a["practice"].alias("practice"), a["performed"].alias("performed"),
            text.map_practice(a["practice"]).alias("label"))),
        lambda a: a["performed"] & a["label"].isNotNull()))
    labels = F.array_distinct(F.transform("_m", lambda a: a["label"]))
    reason = (F.when(F.col("text") == "", "empty_sentence")
              .when(F.size("_a") == 0, "no_sentence_annotations")
              .when(F.size("_m") == 0, "no_mapped_performed_annotations")
              .when(F.size("labels") != 1, "ambiguous_multi_label_sentence"))
    out = judged.withColumn("labels", labels).select(
        "policy_id", "policy_name", "policy_type", "contains_synthetic", "segment_id",
        "sentence_index", "text", "labels",
        F.array_sort(F.array_distinct(F.transform("_m", lambda a: a["practice"]))).alias("practices"),
        F.size("_a").alias("annotations"),
        F.size(F.filter("_a", lambda a: a["performed"])).alias("performed"),
        F.size("_m").alias("mapped"), reason.alias("reason"))
    return out


def practice_examples(sentences: DataFrame, namespace: str = "practice") -> DataFrame:
    kept = sentences.where(F.col("reason").isNull())
    return kept.select(
        F.concat(F.lit(f"{namespace}::"), F.col("policy_id"), F.lit("::"), F.col("segment_id"),
                 F.format_string("::%04d", F.col("sentence_index"))).alias("example_id"),
        "text", F.element_at("labels", 1).alias("label"),
        F.concat(F.lit(f"{namespace}::"), F.col("policy_id")).alias("policy_uid"),
        F.element_at("practices", 1).alias("category"), F.lit(namespace).alias("source"),
        "policy_name", "policy_type", "contains_synthetic", "practices", "segment_id",
        "sentence_index")


def practice_stats(documents: DataFrame, include_synthetic: bool = False) -> DataFrame:
    """All counters as (kind, name, n): annotations, drops, labels, practices, policies."""
    s = practice_sentences(documents, include_synthetic)
    told = (F.col("reason").isNull()) | ~F.col("reason").isin(
        "empty_sentence", "no_sentence_annotations")
    when = lambda c: F.coalesce(F.sum(F.when(told, F.col(c))), F.lit(0))
    totals = s.agg(
        when("annotations").alias("total_annotations"), when("performed").alias("performed_annotations"),
        (when("annotations") - when("performed")).alias("not_performed_annotations"),
        when("mapped").alias("mapped_performed_annotations"),
        (when("performed") - when("mapped")).alias("unmapped_performed_annotations"))
    unpivoted = totals.select(F.explode(F.array(*[
        F.struct(F.lit("annotations").alias("kind"), F.lit(c).alias("name"), F.col(c).alias("n"))
        for c in totals.columns])).alias("x")).select("x.*")
    kept = F.col("reason").isNull()
    # One row per counted thing, so a single aggregation yields every counter.
    things = F.array(
        F.when(~kept, F.struct(F.lit("dropped").alias("kind"), F.col("reason").alias("name"))),
        F.when(kept, F.struct(F.lit("label").alias("kind"), F.element_at("labels", 1).alias("name"))))
    practices = F.when(kept, F.transform("practices", lambda p: F.struct(
        F.lit("practice").alias("kind"), p.alias("name"))))
    every = F.concat(F.array_compact(things), F.coalesce(practices, F.expr(
        "cast(array() as array<struct<kind:string,name:string>>)")))
    counted = s.select(F.explode(every).alias("x")).select("x.*").groupBy("kind", "name").agg(
        F.count(F.lit(1)).alias("n"))
    policy_kind = F.coalesce(text.blank_to_null("policy_type"), F.lit("unknown"))
    synthetic = F.coalesce("contains_synthetic", F.lit(False))
    policies = documents.select(F.explode(F.array_compact(F.array(
        F.struct(F.lit("policy_type").alias("kind"), policy_kind.alias("name")),
        F.struct(F.lit("policies").alias("kind"), F.lit("seen").alias("name")),
        F.struct(F.lit("policies").alias("kind"),
                 F.when(synthetic & F.lit(not include_synthetic), "synthetic_skipped")
                 .otherwise("used").alias("name"))))).alias("x")).select("x.*").groupBy(
        "kind", "name").agg(F.count(F.lit(1)).alias("n"))
    return unpivoted.where("n > 0").transform(guard_unions).unionByName(counted).transform(guard_unions).unionByName(policies)
