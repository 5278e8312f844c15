"""What the operators of this folder share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewise.operators.ordering import materialize, reach_workers, release

__all__ = ["materialize", "release", "reach_workers", "documents", "whole_text", "row_keys", "whole_rows", "lookup",
           "map_texts", "WordTable", "WHITE"]

#: White space of every word and line rule here, as a regular expression class's content.
WHITE = r"\x20\x09-\x0D"
NO_ID = -(2 ** 63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_keys(docs: DataFrame) -> DataFrame:
    """``_id`` and ``_h``: rows that agree in both agree in doc_id and text.

    A null doc_id and a null text get keys too, so decisions can be joined back to rows
    by equality; rows that repeat an id and a text get the same decisions.
    """
    return (docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
            .withColumn("_h", F.xxhash64(whole_text())))


def whole_rows(docs: DataFrame) -> DataFrame:
    """``_id``, ``_h`` and the whole row as ``_row``, so that no column's name can clash;
    ``select("_row.*")`` gives the input's rows back."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"),
                       F.xxhash64(whole_text()).alias("_h"))


def lookup(rows: DataFrame, table: DataFrame, on: list[str], limit: int = 50_000, salts: int = 64) -> DataFrame:
    """Left join of a small materialized table with one row per key.

    Up to ``limit`` counted rows it is broadcast; beyond, every key is repeated under
    ``salts`` salts, so that a key that holds a third of the rows is dealt to as many tasks.
    """
    if table.count() <= limit:
        return rows.join(F.broadcast(table), on, "left")
    salted = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "_h"), F.lit(salts)).cast("int"))
    return rows.join(salted, [*on, "_salt"], "left").drop("_salt")


def map_texts(df: DataFrame, fn, schema: str, chars: int, texts: tuple[str, ...] = ("_text",)) -> DataFrame:
    """``fn`` over portions of about ``chars`` bytes of text, a longer row for itself.

    ``fn`` takes a dict of columns (the texts as lists, the others as Arrow arrays) and
    yields pandas frames of ``schema``. Only one portion's texts are Python objects at a
    time, however many rows an Arrow batch has.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int64)
            for c in texts:
                size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.diff(np.cumsum(size) // chars, prepend=0)).tolist()
            for a, b in zip([0, *cut], [*cut, batch.num_rows]):
                if b > a:
                    part = batch.slice(a, b - a)
                    columns = {c: part.column(c).to_pylist() if c in texts else part.column(c)
                               for c in batch.schema.names}
                    for frame in fn(columns):
                        yield pa.RecordBatch.from_pandas(frame, schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)


class WordTable:
    """Distinct word -> what it is encoded to, for the tasks of one Python worker.

    Two generations of at most ``limit`` words each: a full young one becomes the old one,
    and what is asked for again moves back. Memory is bounded and no result depends on
    what is still there.
    """

    def __init__(self, encode, limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: list) -> list:
        out = list(map(self.young.get, words))
        if None in out:
            young, unknown = self.young, []
            lacking = [i for i, v in enumerate(out) if v is None]
            for w in {words[i] for i in lacking}:
                value = self.old.get(w)
                if value is None:
                    unknown.append(w)
                else:
                    young[w] = value
            if unknown:
                young.update(zip(unknown, self.encode(unknown)))
            for i in lacking:
                out[i] = young[words[i]]
            if len(young) > self.limit:
                self.old, self.young = young, {}
        return out
