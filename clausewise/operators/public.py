"""Public incident tables mapped to the canonical columns, with quality flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions import records


def map_public_rows(rows: DataFrame, source: str, index: str = "source_row_index",
                    aliases=None, required=lexicon.PUBLIC_REQUIRED_FIELDS) -> DataFrame:
    """Resolve aliases against the schema, or against a ``record`` MAP column."""
    aliases = aliases or lexicon.PUBLIC_FIELD_ALIASES
    if "record" in rows.columns and rows.schema["record"].dataType.typeName() == "map":
        lowered = F.transform_keys("record", lambda k, v: F.lower(k))
        rows = rows.withColumn("_record", lowered)
        picked = {t: records.pick_alias_map("_record", names) for t, names in aliases.items()}
    else:
        picked = {t: records.pick_alias(rows.columns, names).cast("string")
                  for t, names in aliases.items()}
    picked["records_affected"] = records.to_int(picked["records_affected"])
    picked["detection_to_response_hours"] = records.to_float(
        picked["detection_to_response_hours"])
    mapped = rows.select(F.lit(source).alias("source"),
                         F.col(index).cast("bigint").alias("source_row_index"),
                         *[c.alias(t) for t, c in picked.items()])
    return (mapped.withColumn("dq_missing_required_fields", records.missing_fields(required))
            .withColumn("dq_valid", F.size("dq_missing_required_fields") == 0))


def public_mapping_summary(mapped: DataFrame) -> DataFrame:
    valid = F.count_if("dq_valid")
    return mapped.agg(F.count(F.lit(1)).alias("input_rows"), valid.alias("valid_rows"),
                      F.count_if(~F.col("dq_valid")).alias("invalid_rows"))
