"""Annotated policies rolled up to one row per policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.functions import records, scoring, text


def annotation_rollup(annotations: DataFrame) -> DataFrame:
    """Per policy: rows, distinct ids, segments and categories, first date and URL."""
    file_uid = (F.col("file_policy_uid") if "file_policy_uid" in annotations.columns
                else F.lit(None).cast("string"))
    uid = F.coalesce(file_uid, text.blank_to_null("policy_uid"))
    url, date = records.url_date_pair("c7", "c8")
    rows = annotations.select(
        uid.alias("policy_uid"), text.strip("annotation_id").alias("a"),
        records.safe_int("segment_id").alias("s"), text.blank_to_null("category").alias("c"),
        records.parse_date(date).alias("d"), url.alias("u")).where(F.col("policy_uid").isNotNull())
    return rows.groupBy("policy_uid").agg(
        F.count(F.lit(1)).alias("annotation_rows"),
        F.count_distinct("a").alias("unique_annotation_ids"),
        F.count_distinct("s").alias("unique_segments"),
        F.count_distinct("c").alias("unique_categories"),
        F.min("d").alias("annotation_date"), F.min("u").alias("annotation_url"))


def top_sector(sectors) -> Column:
    """Most frequent part before ``:`` in a list; alphabetical on a tie."""
    tops = F.filter(F.transform(text.col(sectors), lambda s: text.strip(
        F.split_part(s, F.lit(":"), F.lit(1)))), lambda s: s != "")
    best = F.array_min(F.transform(F.array_distinct(tops), lambda n: F.struct(
        (-F.size(F.filter(tops, lambda t: t == n))).alias("neg"), n.alias("name"))))
    return best["name"]


def mode_tiebreak(rows: DataFrame, group: str, value: str, out: str = "mode") -> DataFrame:
    """Most frequent value per group, smallest on a tie, for values kept as rows."""
    counts = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(value).alias("v")))
    return counts.groupBy(group).agg(best.alias("b")).select(group, F.col("b.v").alias(out))


def policy_flat(rollup: DataFrame, policies: DataFrame, sites: DataFrame, source: str,
                country: str = "US", sort: bool = True) -> DataFrame:
    """All policies of three tables in one row each; undated ones are dropped."""
    joined = policies.join(sites, "policy_uid", "full").join(rollup, "policy_uid", "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    collected = records.parse_date("collection_date")
    made = joined.select(
        day(F.coalesce(collected, F.col("annotation_date"))).alias("event_date"),
        F.lit(country).alias("country"),
        F.coalesce(top_sector("sectors"), F.lit("Unknown")).alias("sector"),
        zero("annotation_rows").alias("records_affected"),
        scoring.lag_hours(collected, records.parse_date("last_updated_date"))
        .alias("detection_to_response_hours"),
        scoring.annotation_severity(zero("annotation_rows"), zero("unique_categories"))
        .alias("severity"),
        F.lit(source).alias("source"), "policy_uid",
        F.coalesce(text.blank_to_null("policy_url"), F.col("annotation_url")).alias("policy_url"),
        "site_url", "site_name", day(records.parse_date("site_check_date")).alias("site_check_date"),
        *[zero(c).alias(c) for c in ("annotation_rows", "unique_annotation_ids",
                                     "unique_segments", "unique_categories")])
    dated = made.where(F.col("event_date").isNotNull())
    return dated.orderBy(records.uid_sort_key("policy_uid")) if sort else dated
