"""Sinks: JSON lines, CSV, manifests, append-only history, partitions, keyed upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from clausewise.operators.ordering import guard_unions


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").csv(path, header=True, escape='"')


def write_manifest(df: DataFrame, path: str) -> None:
    """One summary row as a single JSON file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def write_by_regulation(df: DataFrame, path: str) -> None:
    """Partitions by regulation, which together are the all-rows set; stale ones go."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy("regulation").parquet(path))


def upsert(target: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Target rows without a newer version, plus the batch (last one per key)."""
    if "seq" in batch.columns:
        newest = F.max_by(F.struct(*batch.columns), "seq").alias("r")
        batch = batch.groupBy(key).agg(newest).select("r.*").drop("seq")
    else:
        batch = batch.dropDuplicates([key])
    return target.join(batch.select(key), key, "left_anti").transform(guard_unions).unionByName(batch)


def replace_collection(target: DataFrame, batch: DataFrame,
                       collection: str = "regulation") -> DataFrame:
    """Drop every collection the batch carries, then add the batch."""
    names = batch.select(collection).distinct()
    return target.join(names, collection, "left_anti").transform(guard_unions).unionByName(batch)
