"""Readers for the file layouts the operators start from."""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise import lexicon
from clausewise.functions import text
from clausewise.operators.ordering import guard_unions, position

RECORD = "map<string,string>"


def file_order() -> Column:
    """Sort key that puts rows of a scan in file and line order."""
    return F.struct(F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def read_jsonl(spark: SparkSession, path: str, schema) -> DataFrame:
    """One object per line; blank lines skipped, a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_records(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.jsonl") -> DataFrame:
    """JSON lines as (record MAP, file_name, seq): keeps which keys a row has."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    lines = reader.text(path).select("value", F.col("_metadata.file_name").alias("file_name"),
                                     file_order().alias("seq"))
    parsed = F.from_json("value", RECORD, {"mode": "FAILFAST"})
    return lines.where(F.trim("value") != "").select(parsed.alias("record"), "file_name", "seq")


def read_csv_header(spark: SparkSession, path) -> DataFrame:
    """CSV with a header; every value stays a string."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"',
                          quote='"')


def _arity(names: list[str]) -> Column:
    """Fields of a line: all of the schema's unless it was short, then those between the
    separators outside quotes. Never fewer than were read (and the reader wants a query on
    the corrupt-record column to name others too)."""
    bare = F.regexp_replace("_bad", r'"(?:[^"]|"")*"', "")
    filled = F.size(F.array_compact(F.array(*names)))
    return F.greatest(filled, F.when(F.col("_bad").isNull(), len(names)).otherwise(F.size(F.split(bare, ","))))


def read_annotations(spark: SparkSession, folder: str, min_fields: int = 6, glob: str = "*.csv") -> DataFrame:
    """Headerless annotation files; rows with too few fields are left out.

    An empty field still counts. Short rows are told apart by the corrupt-record
    column, whose separators outside quotes are counted.
    """
    names = [f"c{i}" for i in range(9)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_bad"]])
    raw = spark.read.csv(folder, schema=schema, multiLine=True, quote='"', escape='"',
                         columnNameOfCorruptRecord="_bad", pathGlobFilter=glob)
    arity = _arity(names)
    uid = text.uid_from_filename(F.col("_metadata.file_name"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = raw.select(
        *[blank(n).alias(n) for n in names], arity.alias("_arity"),
        uid.alias("file_policy_uid"), F.col("_metadata.file_name").alias("file_name"),
        file_order().alias("seq"))
    return rows.where(F.col("_arity") >= min_fields).select(
        text.strip("c0").alias("annotation_id"), F.col("c1").alias("batch"),
        F.col("c2").alias("annotator"), text.strip("c3").alias("policy_uid"),
        text.strip("c4").alias("segment_id"), text.strip("c5").alias("category"),
        F.col("c6").alias("payload"), F.col("c7").alias("c7"), F.col("c8").alias("c8"),
        F.col("_arity").alias("fields"), "file_policy_uid", "file_name", "seq")


def read_policy_meta(spark: SparkSession, path: str) -> DataFrame:
    """policy_uid, policy_url, collection_date, last_updated_date; last row wins."""
    names = ["policy_uid", "policy_url", "collection_date", "last_updated_date"]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in names),
                         enforceSchema=True, multiLine=True, escape='"')
    rows = raw.select(*[text.blank_to_null(n).alias(n) for n in names], file_order().alias("seq"))
    last = F.max_by(F.struct(*names[1:]), "seq").alias("r")
    return rows.where(F.col("policy_uid").isNotNull()).groupBy("policy_uid").agg(last).select(
        "policy_uid", "r.*")


def read_site_meta(spark: SparkSession, path: str) -> DataFrame:
    """Site table whose columns from the eighth on are a list of sectors, as many as the
    widest line has (separators inside quotes only make the schema wider). A line of fewer
    than five fields is left out, an empty fifth one counts."""
    width = spark.read.text(path).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 0
    names = [f"c{i}" for i in range(max(8, width))]
    raw = spark.read.csv(path, header=True, schema=", ".join(f"{n} string" for n in [*names, "_bad"]),
                         enforceSchema=True, multiLine=True, escape='"', columnNameOfCorruptRecord="_bad")
    sectors = F.array_compact(F.array(*[text.blank_to_null(n) for n in names[7:]]))
    rows = raw.select(
        text.blank_to_null("c3").alias("policy_uid"), text.blank_to_null("c1").alias("site_url"),
        text.blank_to_null("c2").alias("site_name"),
        text.blank_to_null("c4").alias("site_check_date"), sectors.alias("sectors"),
        _arity(names).alias("_arity"), file_order().alias("seq"))
    last = F.max_by(F.struct("site_url", "site_name", "site_check_date", "sectors"), "seq")
    return rows.where(F.col("policy_uid").isNotNull() & (F.col("_arity") >= 5)).groupBy("policy_uid").agg(
        last.alias("r")).select("policy_uid", "r.*")


def read_mixed_clause_dir(spark: SparkSession, root: str, jsonl: str = "*.jsonl") -> DataFrame:
    """All ``*.jsonl`` (or another pattern) then all ``*.csv`` below a folder, as record maps.

    CSV files may differ in their headers, so files are read per distinct header.
    """
    parts = []
    if _has_files(spark, root, jsonl.lstrip("*")):
        parts.append(read_records(spark, root, recursive=True, glob=jsonl).withColumn("kind", F.lit(0)))
    if _has_files(spark, root, ".csv"):
        lines = (spark.read.option("recursiveFileLookup", "true")
                 .option("pathGlobFilter", "*.csv").text(root)
                 .select("value", F.col("_metadata.file_path").alias("path"),
                         file_order().alias("seq")))
        heads = lines.groupBy("path").agg(F.min_by("value", "seq").alias("head"))
        for row in heads.groupBy("head").agg(F.collect_list("path").alias("paths")).collect():
            rows = read_csv_header(spark, row["paths"])
            pairs = []
            for c in rows.columns:
                if c.strip():
                    pairs += [F.lit(c.strip()), F.col(f"`{c}`")]
            parts.append(rows.select(
                F.create_map(*pairs).alias("record"),
                F.col("_metadata.file_name").alias("file_name"), file_order().alias("seq"),
                F.lit(1).alias("kind")))
    if not parts:
        return spark.createDataFrame(
            [], f"record {RECORD}, file_name string, "
                "seq struct<path:string,block:bigint,row:bigint>, kind int")
    out = parts[0]
    for p in parts[1:]:
        out = out.transform(guard_unions).unionByName(p)
    return out


def _file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path in its terms."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def _has_files(spark: SparkSession, root: str, suffix: str) -> bool:
    """Whether a folder, which must exist, has such a file at any depth."""
    system, path = _file_system(spark, root)
    if system.getFileStatus(path).isFile():
        return path.getName().endswith(suffix)
    files = system.listFiles(path, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(suffix):
            return True
    return False


def read_public(spark: SparkSession, path: str | None) -> DataFrame:
    """Incident rows as a ``record`` MAP by file suffix. No path and any other suffix give
    an empty table; a path that does not exist is an error, on any file system."""
    empty = f"record {RECORD}, source_row_index bigint"
    if path is None:
        return spark.createDataFrame([], empty)
    system, found = _file_system(spark, path)
    if not system.exists(found):
        raise FileNotFoundError(path)
    if path.lower().endswith(".jsonl"):
        rows = read_records(spark, path).select("record", "seq")
    elif path.lower().endswith(".csv"):
        raw = read_csv_header(spark, path)
        pairs = []
        for c in raw.columns:
            pairs += [F.lit(c), F.coalesce(F.col(f"`{c}`"), F.lit(""))]
        rows = raw.select(F.create_map(*pairs).alias("record"), file_order().alias("seq"))
    else:
        return spark.createDataFrame([], empty)
    return position(rows, "seq", out="source_row_index").select(
        "record", F.col("source_row_index").cast("bigint").alias("source_row_index"))


def resolve_input_set(root: str, name: str, choices=None, source_dir: str | None = None) -> str:
    """Sub-directory of a named input set; unknown names are an error.

    Whether a folder exists is asked of the file system of the active session.
    """
    if source_dir is not None:
        return source_dir
    choices = lexicon.ANNOTATION_INPUT_SETS if choices is None else choices
    if name not in choices:
        raise ValueError(f"Unsupported input set '{name}'. Choose one of: "
                         + ", ".join(sorted(choices)))
    folder = "/".join([root.rstrip("/"), *[p for p in choices[name].split("/") if p not in ("", ".")]])
    if name == "normalized":
        system, path = _file_system(SparkSession.getActiveSession(), folder)
        if not system.exists(path):
            return root
    return folder


PRACTICE_SCHEMA = (
    "policy_id string, policy_name string, policy_type string, contains_synthetic boolean, "
    "segments array<struct<segment_id:int, segment_text:string, sentences:array<struct<"
    "sentence_text:string, annotations:array<struct<practice:string, modality:string>>>>>>")


def read_practice_docs(spark: SparkSession, path: str) -> DataFrame:
    """Nested practice documents from JSON lines, or from a folder of YAML files."""
    if not _has_files(spark, path, ".yml"):
        return spark.read.schema(PRACTICE_SCHEMA).option("mode", "FAILFAST").json(path)
    files = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.yml")
             .text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("f")))

    @F.pandas_udf("string")
    def to_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import json

        import yaml

        for batch in batches:
            yield batch.map(lambda t: json.dumps(yaml.safe_load(t)))

    parsed = F.from_json(to_json("value"), PRACTICE_SCHEMA, {"mode": "FAILFAST"})
    return files.select(parsed.alias("d"), F.col("f").alias("input_file")).select("d.*", "input_file")


def read_text_any_encoding(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text): UTF-8, else UTF-16, else Latin-1; blank files left out."""
    raw = spark.read.format("binaryFile").load(folder).select(
        F.col("_metadata.file_name").alias("file_name"), "content")
    plain = F.is_valid_utf8(F.col("content").cast("string"))

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(data):
            if data is None:
                return None
            try:
                found = data.decode("utf-16")
                if found.strip():
                    return found
            except UnicodeDecodeError:
                pass
            return data.decode("latin-1")

        for batch in batches:
            yield batch.map(one)

    # Only files that are not UTF-8 travel to Python.
    other = decode(F.when(~plain, F.col("content")))
    out = raw.select("file_name", F.when(plain, F.col("content").cast("string"))
                     .otherwise(other).alias("text"))
    return out.where(text.strip("text") != "")
