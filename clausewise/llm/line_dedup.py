"""Line dedup by levelled sorted runs of line hashes.

Documents arrive in batches. A batch's distinct line hashes are merge-joined with the runs
there are: those in no run (anti join) are fresh and carry the batch's largest doc_id as
their holder, the others only add their count. The batch becomes a run of its own, sorted
by hash; when a level has ``fanout`` runs they are merged into one of the next level.
Batches come from large ids to small, so the first run that has a line names its largest
holder. After the last batch one compaction gives the lines to drop. All of it is DataFrame
functions.

A line's key is the line without the white space at its ends, A-Z lower-cased. Null and
empty text are one empty line; null ids sort before all others; repeated rows count as one
document per id; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import materialize, row_keys, whole_rows, whole_text
from clausewise.operators.ordering import lookup_skew_safe

ENDS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """lower() is the same on plain ASCII and much faster than translate()."""
    line = F.btrim(line, F.lit(ENDS))
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(
        F.translate(line, UPPER, LOWER))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """_id, _h and per line the 128-bit hash of its key; null for keys that are too short."""
    k = row_keys(docs).select("_id", "_h", F.split(whole_text(), "\n").alias("_lines"))
    keys = F.transform("_lines", lambda x: F.when(F.length(x) >= min_chars, key_of(x)))
    return k.select("_id", "_h", F.transform(keys, lambda x: F.when(
        F.length(x) >= min_chars, F.unhex(F.md5(x)))).alias("_keys"))


class LineRuns:
    """Levels of runs (key, n_docs, holder). ``add`` takes a batch in, ``compact`` merges all."""

    def __init__(self, min_chars: int = 40, fanout: int = 4):
        self.min_chars, self.fanout = min_chars, fanout
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, runs).groupBy("key").agg(
            F.sum("n_docs").alias("n_docs"), F.max("holder").alias("holder"))

    @staticmethod
    def _sorted(run: DataFrame) -> DataFrame:
        return materialize(run.repartition("key").sortWithinPartitions("key"))

    def add(self, lines: DataFrame) -> None:
        """``lines``: rows of hashed_lines(). One row per document and key counts."""
        each = lines.select("_id", F.explode(F.array_distinct(F.array_compact("_keys"))).alias("key"))
        once = each.distinct() if self._ids_repeat(lines) else each
        mine = once.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("_id").alias("holder"))
        if runs := self.runs():
            mine = materialize(mine)
            known = reduce(DataFrame.unionByName, [r.select("key") for r in runs])
            fresh = mine.hint("merge").join(known, "key", "left_anti")
            seen = mine.hint("merge").join(known, "key", "left_semi").withColumn(
                "holder", F.lit(None).cast("long"))
            mine = fresh.unionByName(seen)
        self.levels[0].append(self._sorted(mine))
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._sorted(self._merge(level)))
                level.clear()

    @staticmethod
    def _ids_repeat(lines: DataFrame) -> bool:
        ids = lines.select("_id")
        return not ids.groupBy("_id").count().where("count > 1").isEmpty()

    def compact(self) -> DataFrame:
        return self._merge(self.runs())


def batches_of(docs: DataFrame, n: int) -> list[DataFrame]:
    """Ranges of doc_id of equal width, the largest ids first; null ids are in the last."""
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if lo is None:
        return [docs]
    cuts = sorted({lo + (hi - lo + 1) * i // n for i in range(1, n)} - {lo}, reverse=True)
    edges = [None, *cuts, None]
    out = []
    for above, below in zip(edges, edges[1:]):
        keep = F.lit(True) if above is None else F.col("doc_id") < above
        if below is not None:
            keep = keep & (F.col("doc_id") >= below)
        elif above is not None:
            keep = keep | F.col("doc_id").isNull()
        out.append(docs.where(keep))
    return out


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 3,
               fanout: int = 2) -> DataFrame:
    """Every row with n_lines, n_dropped and its text without the dropped lines.

    Columns: those of the input, text replaced, and n_lines, n_dropped (which replace
    columns of those names). Lines found in at
    least ``min_docs`` documents stay only in the largest doc_id that holds them.
    """
    runs = LineRuns(min_chars, fanout)
    for part in batches_of(docs.select("doc_id", "text"), batches):
        runs.add(hashed_lines(part, min_chars))
    common = materialize(runs.compact().where(F.col("n_docs") >= min_docs))
    every = hashed_lines(docs, min_chars).select("_id", "_h", F.posexplode("_keys").alias("pos", "key"))
    found = lookup_skew_safe(every.where("key is not null"), common, "key", "n_docs", "_id", ["holder"])
    drops = (found.where("holder is not null and holder <> _id").groupBy("_id", "_h")
             .agg(F.collect_set("pos").alias("_drop")))  # at most the lines of one document
    d = whole_rows(docs).join(drops, ["_id", "_h"], "left").withColumn(
        "_lines", F.split(F.coalesce(F.col("_row.text"), F.lit("")), "\n"))
    last = F.size("_lines") - 1
    stay = F.array_except(F.sequence(F.lit(0), last), "_drop")
    d = d.withColumn("_stay", F.when(F.col("_drop").isNotNull(), stay))
    text = F.when(F.col("_stay").isNull(), F.col("_row.text")).otherwise(
        F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n"))
    keep = [text.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c)
            for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return d.select(*keep, F.size("_lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
