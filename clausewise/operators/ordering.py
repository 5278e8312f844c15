"""Exact ranks, indexes, running sums and lookups that no single hot group can stall.

Window functions put a whole group into one task. The helpers here get the same
numbers from two levels: a small table of block totals, then a window inside each
block. Blocks are cut by value (hash prefix, key range, line range), so a retried
task cuts them the same way.
"""

from __future__ import annotations

import gc
import os
import re
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _offsets(blocks: DataFrame, group: list[str], block: str, size: str) -> DataFrame:
    """Exclusive running total of ``size`` over the blocks of each group."""
    w = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0)))
    w = w.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_offset", F.coalesce(F.sum(size).over(w), F.lit(0))).drop(size)


def rank_by_hash(df: DataFrame, group: list[str], hash_col: str, tie: str,
                 out: str = "rank", count_out: str | None = None,
                 prefix_chars: int = 3) -> DataFrame:
    """1-based row number per group in order of a hex hash, then ``tie``.

    A group is cut into 16**prefix_chars blocks by hash prefix; block totals are
    groups x 4096 rows at most, whatever the number of rows.
    """
    df = df.withColumn("_block", F.substring(hash_col, 1, prefix_chars))
    sizes = df.groupBy(*group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(sizes, group, "_block", "_n")
    if count_out:
        totals = sizes.groupBy(*group).agg(F.sum("_n").alias(count_out))
        offsets = offsets.join(totals, group)
    w = Window.partitionBy(*group, "_block").orderBy(hash_col, tie)
    ranked = df.withColumn("_in_block", F.row_number().over(w))
    return (ranked.join(offsets, [*group, "_block"])
            .withColumn(out, F.col("_offset") + F.col("_in_block"))
            .drop("_block", "_offset", "_in_block"))


class OrderedBlocks:
    """Rows in total order, cut into blocks of about ``block_rows`` by sampled keys.

    The key is the whole of ``order``, so a tie in its first column is cut by the next ones,
    and an outlier takes no more room than any other key. Blocks that come out larger than
    twice the bound are cut again, from samples of their own. ``rows`` has the input's
    columns, ``_key``, ``_path`` (the block, comparable) and ``_at`` (place in its task);
    what is added up over all blocks is one row for each.
    """

    def __init__(self, df: DataFrame, order: list, block_rows: int = 1_000_000, blocks: int | None = None, rounds: int = 3):
        keyed = materialize(df.withColumn("_key", F.struct(*order)))
        n = keyed.count()
        blocks = blocks or max(1, -(-n // block_rows))
        self.rows = self._cut(keyed, [], blocks)
        for k in range(rounds + 1):
            self.sizes = materialize(self.rows.groupBy("_path").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")))
            over = self.sizes.where(F.col("_n") > 2 * block_rows)
            large, many = self.sizes.agg(F.coalesce(F.sum(F.when(F.col("_n") > 2 * block_rows, F.col("_n"))), F.lit(0)),
                                         F.count_if(F.col("_n") > 2 * block_rows)).first()
            if not large or k == rounds:
                break
            marked = self._with(over.select("_path", F.lit(1).alias("_over")), "left")
            again = self._cut(marked.where("_over = 1").drop("_over", "_at"), ["_path"], -(-large // block_rows) + many)
            self.rows = marked.where("_over is null").drop("_over").transform(guard_unions).unionByName(again)

    def _with(self, table: DataFrame, how: str = "inner") -> DataFrame:
        """The rows with a table of one row per block, which is sent along up to 50,000 blocks."""
        few = self.sizes.count() <= 50_000
        return self.rows.join(F.broadcast(table) if few else table, "_path", how)

    @staticmethod
    def _cut(df: DataFrame, lead: list[str], blocks: int) -> DataFrame:
        """Each task's number and each row's place in it are read off the sorted task."""
        place = df.repartitionByRange(blocks, *lead, "_key").sortWithinPartitions(*lead, "_key").withColumn(
            "_id", F.monotonically_increasing_id())
        path = F.array(F.shiftright("_id", 33))
        out = place.withColumns({"_path": F.concat(F.col("_path"), path) if lead else path,
                                 "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id")
        return materialize(out)

    def positions(self, out: str) -> DataFrame:
        """The rows with their 0-based place in the whole order."""
        before = Window.orderBy("_path").rowsBetween(Window.unboundedPreceding, -1)
        offsets = self.sizes.select("_path", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
        return self._with(offsets).withColumn(out, F.col("_offset") + F.col("_at") - F.col("_first")).drop(
            "_key", "_path", "_at", "_first", "_offset")

    def previous(self, values: list[str], out: str) -> DataFrame:
        """The rows with ``out``: a struct of the row before in the whole order, null for the
        first. A block's last row is carried over to the next one's first."""
        told = F.struct(*values)
        inside = Window.partitionBy("_path").orderBy("_at")
        edges = self.rows.groupBy("_path").agg(F.max_by(told, "_at").alias("_edge"))
        edges = edges.withColumn("_edge", F.lag("_edge").over(Window.orderBy("_path")))
        local = self._with(edges, "left").withColumn("_lag", F.lag(told).over(inside))
        return local.withColumn(out, F.coalesce("_lag", "_edge")).drop(
            "_key", "_path", "_at", "_lag", "_edge")


def row_index(df: DataFrame, key: str, out: str = "row_index", blocks: int | None = None,
              rows_per_block: int = 1_000_000) -> DataFrame:
    """0-based position of each row in order of a unique key."""
    return OrderedBlocks(df, [F.col(key)], rows_per_block, blocks).positions(out).withColumn(
        out, F.col(out).cast("bigint"))


def position(df: DataFrame, seq: str = "seq", first: str | None = None, out: str = "row_index") -> DataFrame:
    """0-based position of each row in file order: by ``first`` where given, then path,
    block and row of ``seq``.

    A window stays inside one block of one file; what is added up over all blocks is one
    number for each.
    """
    s, lead = F.col(seq), [F.col(first)] if first else [F.lit(0)]
    blocks = [lead[0].alias("_lead"), s["path"].alias("_path"), s["block"].alias("_block")]
    names = ["_lead", "_path", "_block"]
    d = df.select("*", *blocks)
    sizes = d.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*names, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*names).orderBy(s["row"]))
    return (d.withColumn("_in", inside).join(offsets, names)
            .withColumn(out, F.col("_offset") + F.col("_in") - 1).drop(*names, "_in", "_offset"))


def by_length(df: DataFrame, group: list[str], order: str, block_rows: int, run) -> DataFrame:
    """``run(rows, cut)`` over the groups that lie in one block, with ``cut`` False, and over
    those of several blocks, with ``cut`` True; rows without a group or a place are left out.

    Which groups are long is read off the order column first. There are at most as many as
    blocks, and only their rows need a summary of each block joined back.
    """
    df = df.where(" and ".join(f"`{c}` is not null" for c in [*group, order]))
    long = materialize(df.where(F.floor(F.col(order) / block_rows) != 0).select(*group).distinct())
    if long.isEmpty():
        return run(df, False)
    whole, parted = df.join(long, group, "left_anti"), df.join(long, group, "left_semi")
    return run(whole, False).transform(guard_unions).unionByName(run(parted, True))


def running_count(df: DataFrame, group: list[str], order: str, counts: dict[str, str],
                  block_rows: int = 50_000, cut: bool = True) -> DataFrame:
    """Running number of true flags per group in order of an integer column.

    ``counts`` maps flag columns to output columns. Groups longer than
    ``block_rows`` order steps are cut into blocks, so one huge document is spread
    over many tasks; all flags share the one pass. Without ``cut`` each group lies in one
    block (:func:`by_length`).
    """
    flags = list(counts)
    if not cut:
        w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(F.col(f).cast("long")).over(w).alias(counts[f]) for f in flags])
    df = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    sizes = df.groupBy(*group, "_block").agg(*[
        F.sum(F.col(f).cast("long")).alias(f"_n{i}") for i, f in enumerate(flags)])
    before = (Window.partitionBy(*group).orderBy("_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*group, "_block", *[
        F.coalesce(F.sum(f"_n{i}").over(before), F.lit(0)).alias(f"_o{i}")
        for i in range(len(flags))])
    w = (Window.partitionBy(*group, "_block").orderBy(order)
         .rowsBetween(Window.unboundedPreceding, 0))
    inside = df.select("*", *[F.sum(F.col(f).cast("long")).over(w).alias(f"_i{i}")
                              for i, f in enumerate(flags)])
    joined = inside.join(offsets, [*group, "_block"])
    keep = [c for c in df.columns if c != "_block"]
    return joined.select(*keep, *[(F.col(f"_o{i}") + F.col(f"_i{i}")).alias(counts[f])
                                  for i, f in enumerate(flags)])


def in_blocks(df: DataFrame, group: list[str], order: str, block_rows: int = 50_000) -> DataFrame:
    """Rows dealt by group and, in long groups, by range of an integer order: one shuffle,
    after which ``scan_last`` moves nothing but one row per block."""
    df = df.withColumn("_block", F.floor(F.col(order) / block_rows))
    return df.repartition(*group, "_block")


def scan_last(df: DataFrame, group: list[str], order: str, states: dict[str, Column],
              before: tuple[str, ...] = (), cut: bool = True) -> DataFrame:
    """Add, per row of ``in_blocks``, the latest non-null value of each state up to the row;
    for those named in ``before``, up to the row in front of it.

    "The latest of two" is associative, so a block is summed up by its last values, and the
    blocks' summaries are composed in order; all states share the one pass. Without ``cut``
    each group lies in one block (:func:`by_length`), so nothing is carried over.
    """
    names = list(states)
    df = df.withColumns({f"_x{i}": states[n] for i, n in enumerate(names)})
    inside = Window.partitionBy(*group, "_block").orderBy(order)
    upto = lambda n: inside.rowsBetween(Window.unboundedPreceding, -1 if n in before else 0)
    keep = [c for c in df.columns if c not in {f"_x{i}" for i in range(len(names))}]
    if not cut:
        return df.select(*keep, *[F.last(f"_x{i}", ignorenulls=True).over(upto(n)).alias(n) for i, n in enumerate(names)])
    ends = df.groupBy(*group, "_block").agg(*[
        F.max_by(f"_x{i}", F.when(F.col(f"_x{i}").isNotNull(), F.col(order))).alias(f"_e{i}") for i in range(len(names))])
    earlier = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*group, "_block", *[
        F.last(f"_e{i}", ignorenulls=True).over(earlier).alias(f"_c{i}") for i in range(len(names))])
    rows = df.select("*", *[F.last(f"_x{i}", ignorenulls=True).over(upto(n)).alias(f"_l{i}") for i, n in enumerate(names)])
    return rows.join(carried, [*group, "_block"]).select(
        *keep, *[F.coalesce(f"_l{i}", f"_c{i}").alias(n) for i, n in enumerate(names)])


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int,
          out: str = "rank") -> DataFrame:
    """Best k rows per group. The rank filter is pushed below the shuffle (window
    group limit), so each task sends on at most k rows per group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def lookup_skew_safe(rows: DataFrame, table: DataFrame, key: str, weight: str,
                     spread: str, values: list[str], share: int = 1000) -> DataFrame:
    """Left lookup of ``table`` values by ``key`` where a few keys hold most rows.

    Keys holding at least 1/share of the table's total weight number at most
    ``share`` by arithmetic, so that part is broadcast with a proven bound. Their
    rows then join the rest under a spread-out key that matches nothing, so no
    task gets a hot key; the rest is an ordinary equi-join left to AQE.
    """
    total = table.agg(F.sum(weight).alias("t"))
    marked = table.withColumn("_total", total.scalar())
    is_heavy = F.col(weight) * share >= F.col("_total")
    heavy = marked.where(is_heavy).select(
        F.col(key).alias("_heavy_key"), *[F.col(v).alias(f"_h_{v}") for v in values])
    light = marked.where(~is_heavy).select(
        F.col(key).alias("_light_key"), *[F.col(v).alias(f"_l_{v}") for v in values])
    step = rows.join(F.broadcast(heavy), rows[key] == F.col("_heavy_key"), "left")
    step = step.withColumn(
        "_join_key",
        F.when(F.col("_heavy_key").isNull(), F.col(key)).otherwise(
            F.concat(F.lit("\u0000"), F.col(spread).cast("string"))))
    step = step.join(light, F.col("_join_key") == F.col("_light_key"), "left")
    out = rows.columns
    return step.select(*out, *[F.coalesce(f"_h_{v}", f"_l_{v}").alias(v) for v in values])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer splits than cores one partition per core, by key.

    A table of many files is returned as it is; only a small one is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def reach_workers(spark) -> None:
    """Lets Python workers import this package from where the driver did, if nothing has
    installed it for them; tasks call its functions by name."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def shared_folder(spark) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where none is set a folder of our own stands in for it in local mode, as in tests; on a
    cluster a folder of one machine would not be seen by the others, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("Set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, for a table several branches read.

    Uses the session's reliable checkpoint folder, so lost executors cost nothing.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark) -> None:
    """Frees the shuffle files behind tables that have been materialized.

    Spark drops a shuffle's files when the driver's garbage is collected, which a job that
    works in rounds does not see happen in time.
    """
    gc.collect()
    time.sleep(0.3)  # Python's references in the JVM are dropped by a thread of their own
    spark.sparkContext._jvm.System.gc()


def guard_unions(df: DataFrame) -> DataFrame:
    """The table itself, with the session kept from trusting a union's partitioning.

    Spark 4.1 lets a union of equally partitioned inputs claim their partitioning;
    when adaptive execution then joins above it, a later grouping by those keys can
    miss its shuffle and return a key twice. Plans read the setting when they run.
    """
    key = "spark.sql.unionOutputPartitioning"
    try:
        if df.sparkSession.conf.get(key) == "true":
            df.sparkSession.conf.set(key, "false")
    except Exception:  # an earlier version without the setting
        pass
    return df
