"""Exact dedup of incoming batches against immutable snapshots.

A snapshot keeps its exact buckets (digest, number of rows, largest doc_id) and, per shard
of the digest space, a static binary fuse filter over its digests. A new batch is first
grouped by digest on its own; its distinct digests are screened by the filters of all
earlier snapshots, shard by shard; only positives are joined with the exact buckets. Rows
whose digest occurs more than once are then compared byte for byte, by grouping on the
whole text, which collapses copies before the shuffle. The batch becomes a snapshot itself.

Null text counts as empty; null ids are one lowest id; rows that repeat id and text share
one decision; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import materialize, release, row_keys, whole_rows, whole_text
from clausewise.llm.line_dedup import batches_of
from clausewise.operators.ordering import lookup_skew_safe

KEYS_PER_SHARD = 200_000


# --- the filter --------------------------------------------------------------------

def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2 ** 64)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """Three slots of each hash, in three neighbouring segments; shape (3, n)."""
    first = (h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)
    low = np.uint64(segment - 1)
    parts = (h & low, (h >> np.uint64(18)) & low, _mix(h, 7) & low)
    return np.stack([(first + np.uint64(i)) * np.uint64(segment) + p for i, p in enumerate(parts)]).astype(np.int64)


def build_filter(keys: np.ndarray) -> bytes:
    """Binary fuse filter of distinct 64-bit keys: header (seed, segment, segments), bytes.

    Peeling runs in rounds over whole arrays: keys that own a slot alone are taken off
    until none is left; fingerprints are then set in reverse order.
    """
    n = max(1, len(keys))
    segment = 1 << max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25)))
    segments = max(1, int(np.ceil(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) / segment)) - 1) + 1
    for seed in range(100):
        h = _mix(keys, seed)
        slots = _slots(h, segment, segments)
        size = (segments + 2) * segment
        count, xored = np.zeros(size, np.int64), np.zeros(size, np.int64)
        ids = np.arange(len(keys))
        for s in slots:
            np.add.at(count, s, 1)
            np.bitwise_xor.at(xored, s, ids)
        rounds, left, look = [], len(keys), np.flatnonzero(count == 1)
        while len(look):
            taken, at = np.unique(xored[look], return_index=True)
            own = look[at]
            rounds.append((taken, own))
            left -= len(taken)
            touched = slots[:, taken]
            for s in touched:
                np.subtract.at(count, s, 1)
                np.bitwise_xor.at(xored, s, taken)
            touched = np.unique(touched)
            look = touched[count[touched] == 1]
        if not left:
            table = np.zeros(size, np.uint8)
            prints = (h ^ (h >> np.uint64(32))).astype(np.uint8)
            for taken, own in reversed(rounds):
                table[own] = 0
                table[own] = prints[taken] ^ table[slots[0, taken]] ^ table[slots[1, taken]] ^ table[slots[2, taken]]
            return np.array([seed, segment, segments], "<i8").tobytes() + table.tobytes()
    raise ValueError("the keys of a filter must be distinct")


def in_filter(blob: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, segments = (int(x) for x in np.frombuffer(blob, "<i8", 3))
    table = np.frombuffer(blob, np.uint8, offset=24)
    h = _mix(keys, seed)
    s = _slots(h, segment, segments)
    return (h ^ (h >> np.uint64(32))).astype(np.uint8) == table[s[0]] ^ table[s[1]] ^ table[s[2]]


def _keys(digests: pd.Series) -> np.ndarray:
    return np.array([int(d[8:24], 16) for d in digests], np.uint64)


# --- snapshots ----------------------------------------------------------------------

class Snapshots:
    """Immutable snapshots; ``add`` screens a batch against them and appends it as one."""

    def __init__(self, keys_per_shard: int = KEYS_PER_SHARD):
        self.keys_per_shard = keys_per_shard
        self.buckets: list[DataFrame] = []
        self.filters: list[tuple[DataFrame, int]] = []
        self.spanning: list[DataFrame] = []

    @staticmethod
    def _shard(n: int):
        return F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")

    def _build(self, groups: DataFrame) -> tuple[DataFrame, int]:
        shards = max(1, -(-groups.count() // self.keys_per_shard))

        def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": [key[0]], "filter": [build_filter(np.unique(_keys(pdf["digest"])))]})

        made = groups.select("digest", self._shard(shards).alias("shard")).groupBy("shard").applyInPandas(
            build, "shard int, filter binary")
        return materialize(made), shards

    @staticmethod
    def _screen(groups: DataFrame, filters: DataFrame) -> DataFrame:
        def screen(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return left[["digest"]].iloc[:0]
            return left.loc[in_filter(right["filter"].iloc[0], _keys(left["digest"])), ["digest"]]

        return groups.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(screen, "digest string")

    def add(self, digests: DataFrame, last: bool = False) -> None:
        """``digests``: rows (digest, _id) of a batch. The ``last`` needs no filter."""
        groups = materialize(digests.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.max("_id").alias("largest")))
        for (filters, shards), bucket in zip(self.filters, self.buckets):
            maybe = self._screen(groups.select("digest", self._shard(shards).alias("shard")), filters)
            self.spanning.append(materialize(bucket.join(maybe, "digest", "left_semi").select("digest")))
        self.buckets.append(groups)
        if not last:
            self.filters.append(self._build(groups))

    def repeated(self) -> DataFrame:
        """Digests held by two rows or more, with their number of rows."""
        every = reduce(DataFrame.unionByName, self.buckets)
        inside = every.where("n > 1")
        if not self.spanning:
            return inside.select("digest", "n")
        across = reduce(DataFrame.unionByName, self.spanning).distinct()
        return (every.join(across, "digest", "left_semi").groupBy("digest").agg(F.sum("n").alias("n"))
                .unionByName(inside.join(across, "digest", "left_anti").select("digest", "n")))


def exact_dedup(docs: DataFrame, batches: int = 2, keys_per_shard: int = KEYS_PER_SHARD) -> DataFrame:
    """One row per input row: doc_id, _id, _h, keep_id, group_size, kept, text_sha256.

    Of rows with the same text the one with the largest doc_id is kept.
    """
    digests = row_keys(docs).select("doc_id", "_id", "_h", F.sha2(whole_text(), 256).alias("digest"))
    snapshots = Snapshots(keys_per_shard)
    parts = batches_of(docs.select("doc_id", "text"), batches)[::-1]
    for i, part in enumerate(parts):
        snapshots.add(row_keys(part).select("_id", F.sha2(whole_text(), 256).alias("digest")),
                      last=i + 1 == len(parts))
    repeated = materialize(snapshots.repeated())
    # Byte check: rows of repeated digests only, by id first, as an id holds few rows.
    members = materialize(lookup_skew_safe(digests, repeated, "digest", "n", "_id", ["n"])
                          .where("n is not null").select("_id", "_h").distinct())
    texts = (row_keys(docs).select("_id", "_h", whole_text().alias("_text"))
             .join(members, ["_id", "_h"], "left_semi"))
    bytewise = (texts.groupBy("_text").agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("largest"),
                                           F.max("_h").alias("_h"))
                .select(F.concat(F.sha2("_text", 256), F.lit(":"), F.col("_h").cast("string")).alias("text_key"),
                        "n", "largest"))
    bytewise = materialize(bytewise)
    release(docs.sparkSession)
    rows = digests.withColumn("text_key", F.concat("digest", F.lit(":"), F.col("_h").cast("string")))
    out = lookup_skew_safe(rows, bytewise, "text_key", "n", "_id", ["n", "largest"])
    keep = F.coalesce(F.col("largest"), F.col("_id"))
    return out.select("doc_id", "_id", "_h", keep.alias("keep_id"),
                      F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("group_size"),
                      (keep == F.col("_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, batches: int = 2) -> DataFrame:
    """The input's rows and columns without the copies that go."""
    gone = exact_dedup(docs, batches).where(~F.col("kept")).select("_id", "_h").distinct()
    return whole_rows(docs).join(gone, ["_id", "_h"], "left_anti").select("_row.*")
