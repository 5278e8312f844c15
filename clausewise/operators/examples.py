"""Labelled clauses from the corpora, with ids, categories and open metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise import lexicon
from clausewise.functions import records, text
from clausewise.operators.ordering import position, row_index


def _get(record: str, *names: str, default: str = "") -> Column:
    """First name that is a key of the record, else ``default``.

    A key holding null reads as the text ``None``, as the corpora's loaders had it.
    """
    expr = F.lit(default)
    for n in reversed(names):
        expr = F.when(F.map_contains_key(record, n),
                      F.coalesce(F.element_at(record, n), F.lit("None"))).otherwise(expr)
    return text.strip(expr)


def _rest(record: str, used: list[str]) -> Column:
    return F.map_filter(record, lambda k, v: ~k.isin(used))


def labeled_examples(rows: DataFrame, source: str, labels=lexicon.LEVELS,
                     index: str = "row_index") -> DataFrame:
    """From ``record`` maps with a dense ``row_index``; invalid rows dropped."""
    fallback = F.format_string("manual::%06d", F.col(index))
    uid = F.coalesce(text.blank_to_null(_get("record", "policy_uid", default="manual")),
                     F.lit("manual"))
    category = F.coalesce(text.blank_to_null(_get("record", "category", default="manual")),
                          F.lit("manual"))
    used = ["example_id", "text", "label", "source", "policy_uid", "category"]
    made = rows.select(
        F.coalesce(text.blank_to_null(_get("record", "example_id")), fallback).alias("example_id"),
        _get("record", "text").alias("text"), F.lower(_get("record", "label")).alias("label"),
        F.lit(source).alias("source"), uid.alias("policy_uid"), category.alias("category"),
        _rest("record", used).alias("metadata"))
    return valid_examples(made, labels)


def valid_examples(examples: DataFrame, labels=lexicon.LEVELS) -> DataFrame:
    return examples.where((F.col("text") != "") & F.col("label").isin(list(labels)))


def example_drops(examples: DataFrame, labels=lexicon.LEVELS) -> DataFrame:
    """How many rows :func:`valid_examples` keeps and drops, and why."""
    empty = F.col("text") == ""
    bad = ~F.col("label").isin(list(labels))
    return examples.agg(F.count(F.lit(1)).alias("rows"), F.count_if(empty).alias("dropped_empty"),
                        F.count_if(~empty & bad).alias("dropped_invalid_label"),
                        F.count_if(~empty & ~bad).alias("kept"))


def annotation_examples(annotations: DataFrame, source: str, namespace: str = "annotated",
                        index: str = "row_index") -> DataFrame:
    """Selected texts of each annotation as one clause; the category if there are none.

    An annotation without an id is numbered among the rows that are kept, in file order;
    an ``index`` column takes the place of that number.
    """
    rows = annotations.where("fields >= 7") if "fields" in annotations.columns else annotations
    label = text.map_category("category")
    file_uid = F.col("file_policy_uid") if "file_policy_uid" in rows.columns else F.lit(None)
    uid = F.coalesce(text.blank_to_null("policy_uid"), file_uid.cast("string"), F.lit("unknown"))
    joined = F.array_join(records.selected_texts("payload"), " ")
    clause = text.normalize_space(F.coalesce(F.nullif(joined, F.lit("")), F.col("category")))
    rows = rows.where((clause != "") & label.isNotNull())
    if index not in rows.columns:
        rows = position(rows, "seq", out=index) if "seq" in rows.columns else rows.withColumn(index, F.lit(0))
    suffix = F.coalesce(text.blank_to_null("annotation_id"), F.format_string("%06d", F.col(index)))
    segment = records.safe_int("segment_id").cast("string")
    return rows.select(
        F.concat_ws("::", F.lit(namespace), uid, suffix).alias("example_id"),
        clause.alias("text"), label.alias("label"), F.lit(source).alias("source"),
        uid.alias("policy_uid"), text.strip("category").alias("category"),
        F.create_map(F.lit("annotation_id"), F.col("annotation_id"), F.lit("segment_id"), segment)
        .alias("metadata"))


def mixed_examples(rows: DataFrame, source: str, namespace: str = "mixed",
                   labels=lexicon.LEVELS, order_by: str = "seq", kind: str = "kind") -> DataFrame:
    """From records with aliases; an explicit level wins over the category's.

    Rows without an id are numbered among the rows that are kept: by ``order_by``, a
    unique number or a file position (then ``kind`` comes before it, where there is one).
    """
    order = list(labels)
    category = _get("record", "category", "category_name")
    stated = F.lower(_get("record", "label", "level"))
    label = F.when(stated.isin(order), stated).otherwise(text.map_category_ci(category))
    uid = F.coalesce(text.blank_to_null(_get("record", "policy_uid", "policy_id")),
                     text.uid_from_filename("file_name"), F.lit("unknown"))
    used = ["example_id", "text", "clause_text", "label", "level", "source", "policy_uid",
            "policy_id", "category", "category_name"]
    meta = F.map_concat(F.map_filter(_rest("record", used), lambda k, v: k != "input_file"),
                        F.create_map(F.lit("input_file"), F.col("file_name")))
    extra = [c for c in (order_by, kind) if c in rows.columns]
    made = rows.select(
        *extra, text.blank_to_null(_get("record", "example_id")).alias("_stated"),
        text.normalize_space(_get("record", "text", "clause_text")).alias("text"),
        label.alias("label"), F.lit(source).alias("source"), uid.alias("policy_uid"),
        F.coalesce(text.blank_to_null(category), F.lit("unknown")).alias("category"),
        meta.alias("metadata"))
    kept = valid_examples(made, order)
    if isinstance(kept.schema[order_by].dataType, T.StructType):
        kept = position(kept, order_by, kind if kind in extra else None, "_index")
    else:
        kept = row_index(kept, order_by, "_index")
    made_id = F.concat_ws("::", F.lit(namespace), "policy_uid", F.format_string("%06d", F.col("_index")))
    return kept.withColumn("example_id", F.coalesce("_stated", made_id)).select(
        "example_id", "text", "label", "source", "policy_uid", "category", "metadata")


def limit_examples(examples: DataFrame, n: int, order: str = "seq") -> DataFrame:
    return examples.orderBy(order).limit(n)
