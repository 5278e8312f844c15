"""Leak-free splits of labelled clauses by policy, with summaries and guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.operators.ordering import guard_unions, rank_by_hash

SPLITS = ("train", "validation", "test")


def dominant_labels(examples: DataFrame, seq: str = "example_id") -> DataFrame:
    """Most frequent label per policy; the one seen first on a tie."""
    counts = examples.groupBy("policy_uid", "label").agg(
        F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("first"), F.col("label")))
    return counts.groupBy("policy_uid").agg(best.alias("b")).select(
        "policy_uid", F.col("b.label").alias("dominant_label"))


def split_policies(examples: DataFrame, seed: int = 42, train_ratio: float = 0.8,
                   validation_ratio: float = 0.1, labels=lexicon.LEVELS,
                   seq: str = "example_id") -> DataFrame:
    """(policy_uid, split), stratified by dominant label.

    Policies of a stratum are ordered by md5(seed|policy) and cut by share. The rank
    is built from hash blocks, so a stratum holding most policies is no single task.
    """
    dom = dominant_labels(examples, seq)
    bucket = F.when(F.col("dominant_label").isin(list(labels)), F.col("dominant_label")).otherwise(
        "other")
    hashed = dom.select("policy_uid", bucket.alias("bucket"),
                        F.md5(F.concat_ws("|", F.lit(str(seed)), "policy_uid")).alias("_h"))
    ranked = rank_by_hash(hashed, ["bucket"], "_h", "policy_uid", out="_r", count_out="_n")
    n = F.col("_n")
    train = F.greatest(F.lit(1), F.floor(n * train_ratio))
    wish = F.when(n >= 3, F.greatest(F.lit(1), F.floor(n * validation_ratio))).otherwise(0)
    val = F.when(train + wish >= n, F.greatest(F.lit(0), n - train - 1)).otherwise(wish)
    split = (F.when(F.col("_r") <= train, "train")
             .when(F.col("_r") <= train + val, "validation").otherwise("test"))
    assigned = ranked.select("policy_uid", split.alias("split"))
    # Without any test policy the smallest validation policy moves over.
    stats = assigned.agg(F.struct(
        F.count_if(F.col("split") == "test").alias("tests"),
        F.min(F.when(F.col("split") == "validation", F.col("policy_uid"))).alias("first")
    ).alias("s")).scalar()
    moved = assigned.withColumn("_s", stats)
    return moved.select(
        "policy_uid",
        F.when((F.col("_s.tests") == 0) & (F.col("policy_uid") == F.col("_s.first")), "test")
        .otherwise(F.col("split")).alias("split"))


def ensure_label_coverage(examples: DataFrame, assigned: DataFrame, labels=lexicon.LEVELS,
                          minimum_train_policies: int = 2) -> DataFrame:
    """Move train policies so that validation and test see every label.

    At most two splits x labels moves, each decided on one small aggregate (labels per
    split, smallest train policy per label). Missing labels are worked out once per
    split, before its moves.
    """
    pairs = examples.select("policy_uid", "label").where(
        F.col("label").isin(list(labels))).distinct().join(assigned, "policy_uid")
    present = {(r["split"], r["label"]) for r in pairs.select("split", "label").distinct().collect()}
    moves: dict[str, str] = {}
    train_left = None
    for split in ("validation", "test"):
        for label in [l for l in labels if (split, l) not in present]:
            if train_left is None:
                train_left = assigned.where("split = 'train'").count()
            pool = pairs.where((F.col("split") == "train") & (F.col("label") == label)
                               & ~F.col("policy_uid").isin(list(moves)))
            found = pool.agg(F.min("policy_uid").alias("p")).first()["p"]
            if found is None or train_left <= minimum_train_policies:
                continue
            moves[found] = split
            train_left -= 1
    if not moves:
        return assigned
    target = F.create_map(*[x for k, v in moves.items() for x in (F.lit(k), F.lit(v))])
    return assigned.withColumn("split", F.coalesce(F.try_element_at(target, "policy_uid"), "split"))


def apply_split(examples: DataFrame, assigned: DataFrame) -> DataFrame:
    return examples.join(assigned, "policy_uid")


def namespace_ids(examples: DataFrame, namespace: str) -> DataFrame:
    """Prefix example and policy ids; the originals go into ``metadata``."""
    originals = F.create_map(F.lit("raw_example_id"), F.col("example_id"),
                             F.lit("raw_policy_uid"), F.col("policy_uid"))
    meta = (F.map_concat(F.map_filter("metadata", lambda k, v: ~k.isin(
        "raw_example_id", "raw_policy_uid")), originals)
            if "metadata" in examples.columns else originals)
    prefix = lambda c: F.concat(F.lit(f"{namespace}::"), F.col(c))
    return (examples.withColumn("metadata", meta)
            .withColumn("example_id", prefix("example_id"))
            .withColumn("policy_uid", prefix("policy_uid")))


def append_auxiliary(split_examples: DataFrame, auxiliary: DataFrame,
                     namespace: str) -> DataFrame:
    """Auxiliary rows, namespaced, into the training split only."""
    aux = namespace_ids(auxiliary, namespace).withColumn("split", F.lit("train"))
    return split_examples.transform(guard_unions).unionByName(aux, allowMissingColumns=True)


def split_summary(split_examples: DataFrame, labels=lexicon.LEVELS) -> DataFrame:
    """Rows, policies and label counts per split; all splits listed."""
    spark = split_examples.sparkSession
    stats = split_examples.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("policy_uid").alias("unique_policies"),
        *[F.count_if(F.col("label") == l).alias(f"n_{l}") for l in labels])
    dim = spark.createDataFrame([(s,) for s in SPLITS], "split string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return dim.join(stats, "split", "left").select(
        "split", *[zero(c) for c in stats.columns if c != "split"])


def class_distribution(split_examples: DataFrame) -> DataFrame:
    return split_examples.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def policy_overlap(split_examples: DataFrame) -> DataFrame:
    """Policies shared by each pair of splits, as one row."""
    flags = split_examples.groupBy("policy_uid").agg(*[
        F.bool_or(F.col("split") == s).alias(s) for s in SPLITS])
    return flags.agg(
        F.count_if(F.col("train") & F.col("validation")).alias("train_validation"),
        F.count_if(F.col("train") & F.col("test")).alias("train_test"),
        F.count_if(F.col("validation") & F.col("test")).alias("validation_test"))


def assert_no_leakage(split_examples: DataFrame) -> DataFrame:
    """The rows themselves; the query fails if a policy sits in two splits."""
    overlap = policy_overlap(split_examples)
    leaked = F.col("train_validation") + F.col("train_test") + F.col("validation_test")
    guard = overlap.select(F.when(leaked > 0, F.raise_error(F.lit(
        "policy leakage across splits")).cast("boolean")).otherwise(F.lit(True)).alias("ok"))
    return split_examples.where(guard.scalar())


def sorted_distinct(df: DataFrame, group: list[str], value: str, out: str) -> DataFrame:
    return df.groupBy(*group).agg(F.array_sort(F.collect_set(value)).alias(out))
