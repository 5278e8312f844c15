"""Quality gates: check rows from run tables, acceptance, alignment of extracted files.

Every check is one row (name, required, passed, details). A run passes when all
required checks do; advisory ones never block. Bad rows are counted where they are;
only counts and the first few ids leave the executors.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.operators.ordering import OrderedBlocks, guard_unions


def check_row(stats: DataFrame, name: str, passed: Column, details: Column,
              required: bool = True) -> DataFrame:
    """One check from a one-row table of numbers; details as a JSON string."""
    return stats.select(F.lit(name).alias("name"), F.lit(required).alias("required"),
                        F.coalesce(passed, F.lit(False)).alias("passed"),
                        F.to_json(details).alias("details"))


def in_unit_interval(c) -> Column:
    v = (F.col(c) if isinstance(c, str) else c).try_cast("double")
    return F.coalesce((v >= 0) & (v <= 1), F.lit(False))


def leakage_check(overlap: DataFrame) -> DataFrame:
    names = ("train_validation", "train_test", "validation_test")
    ok = F.lit(True)
    for n in names:
        ok = ok & (F.coalesce(F.col(n), F.lit(1)) == 0)
    return check_row(overlap, "policy_leakage_protection", ok, F.struct(
        *[F.coalesce(F.col(n), F.lit(-1)).alias(n) for n in names]))


def metric_range_check(metrics: DataFrame, name: str = "core_metrics_in_range") -> DataFrame:
    """Accuracy and macro F1 of validation and test within [0, 1]; both splits present."""
    bad = ~(in_unit_interval("accuracy") & in_unit_interval("macro_f1"))
    wanted = F.col("split").isin("validation", "test")
    stats = metrics.where(wanted).agg(F.count_if(bad).alias("out_of_range"),
                                      F.count_distinct("split").alias("splits"))
    return check_row(stats, name, (F.col("out_of_range") == 0) & (F.col("splits") == 2),
                     F.struct("out_of_range", "splits"))


def count_check(predictions: DataFrame, expected: DataFrame) -> DataFrame:
    """Prediction rows per split against the manifest's; a split it omits is not judged."""
    actual = predictions.groupBy("split").agg(F.count(F.lit(1)).alias("actual"))
    wanted = expected.where(F.col("split").isin("validation", "test"))
    both = wanted.join(actual, "split", "left").select(
        "split", F.col("rows").alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    off = (F.col("expected") >= 0) & (F.col("expected") != F.col("actual"))
    stats = both.agg(F.count_if(off).alias("mismatched_splits"), F.sum("actual").alias("rows"))
    return check_row(stats, "prediction_counts_match_manifest", F.col("mismatched_splits") == 0,
                     F.struct("mismatched_splits", "rows"))


# Keys every prediction row must carry.
PREDICTION_KEYS = ("example_id", "policy_uid", "actual_label", "predicted_label", "confidence")


def prediction_schema_check(records: DataFrame, labels=lexicon.LEVELS,
                            keys=PREDICTION_KEYS) -> DataFrame:
    """Rows given as ``record`` MAPs: required keys present, labels in the vocabulary."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | ~F.map_contains_key("record", k)
    label = lambda k: F.lower(F.trim(F.coalesce(F.try_element_at("record", F.lit(k)), F.lit(""))))
    wrong = ~missing & ~(label("actual_label").isin(list(labels))
                         & label("predicted_label").isin(list(labels)))
    rows = records.select(missing.alias("m"), wrong.alias("w"),
                          F.coalesce(F.try_element_at("record", F.lit("example_id")), F.lit("row"))
                          .alias("id"))
    stats = rows.agg(F.count(F.lit(1)).alias("rows_checked"), F.count_if("m").alias("missing"),
                     F.count_if("w").alias("invalid_label_rows"))
    first = rows.where("m").orderBy("id").limit(10).agg(
        F.array_sort(F.collect_list("id")).alias("ids"))
    stats = stats.withColumn("missing_field_rows", first.scalar())
    return check_row(stats, "prediction_row_schema",
                     (F.col("missing") == 0) & (F.col("invalid_label_rows") == 0),
                     F.struct("rows_checked", "missing_field_rows", "invalid_label_rows"))


def probability_mass_check(predictions: DataFrame, labels=lexicon.LEVELS,
                           tolerance: float = 0.01) -> DataFrame:
    """Each value in [0, 1] and each sum within ``tolerance`` of 1.

    A bad value counts on top of a bad sum; without any probabilities it passes.
    """
    values = F.filter(F.array(*[F.try_element_at("probabilities", F.lit(l)) for l in labels]),
                      lambda v: v.isNotNull())
    has = F.col("probabilities").isNotNull()
    rows = predictions.select(has.alias("has"), F.coalesce(
        F.when(has, values), F.array().cast("array<double>")).alias("v"))
    good = F.filter("v", lambda v: (v >= 0) & (v <= 1))
    rows = rows.select("has", (F.size("v") - F.size(good)).alias("bad_values"),
                       F.size(good).alias("n"),
                       F.abs(F.aggregate(good, F.lit(0.0), lambda a, x: a + x) - 1).alias("delta"))
    usable = F.col("has") & (F.col("n") > 0)
    stats = rows.agg(
        F.count_if(usable).alias("rows_with_probabilities"),
        (F.coalesce(F.sum("bad_values"), F.lit(0)) + F.count_if(F.col("has") & (F.col("n") == 0))
         + F.count_if(usable & (F.col("delta") > tolerance))).alias("invalid_rows"),
        F.count_if(~F.col("has")).alias("rows_without_probabilities"),
        F.round(F.coalesce(F.max(F.when(usable, F.col("delta"))), F.lit(0.0)), 6).alias("max_delta"))
    ok = (F.col("rows_with_probabilities") == 0) | (F.col("invalid_rows") == 0)
    return check_row(stats, "prediction_probability_mass", ok, F.struct(
        "rows_with_probabilities", "invalid_rows", "rows_without_probabilities"), required=False)


def timestamp_check(manifest: DataFrame) -> DataFrame:
    ok = (F.coalesce("executed_at", F.lit("")) != "") & F.col("executed_at").endswith("Z")
    return check_row(manifest, "manifest_timestamp_utc", ok, F.struct("executed_at"), False)


def ece_check(summary: DataFrame, threshold: float = 0.20) -> DataFrame:
    top = summary.where("target = 'top_label'").agg(F.max("ece").alias("ece"))
    return check_row(top, "calibration_ece_target", F.col("ece") <= threshold,
                     F.struct(F.col("ece").cast("string").alias("ece")), False)


def bootstrap_interval_check(intervals: DataFrame) -> DataFrame:
    rows = intervals.where(F.col("lower").isNotNull() & F.col("upper").isNotNull())
    bad = ((F.col("lower") > F.col("upper"))
           | (F.col("mean").isNotNull() & ~F.col("mean").between(F.col("lower"), F.col("upper")))
           | (F.col("lower") < 0) | (F.col("upper") > 1))
    stats = rows.agg(F.count(F.lit(1)).alias("metrics_checked"),
                     F.count_if(bad).alias("invalid_intervals"))
    return check_row(stats, "bootstrap_intervals_valid", F.col("invalid_intervals") == 0,
                     F.struct("metrics_checked", "invalid_intervals"), False)


def threshold_check(sweep: DataFrame) -> DataFrame:
    bad = sum((F.when(~in_unit_interval(c), 1).otherwise(0) for c in ("recall", "f1")),
              F.when(~in_unit_interval("precision"), 1).otherwise(0))
    stats = sweep.agg(F.count(F.lit(1)).alias("points_checked"),
                      F.coalesce(F.sum(bad), F.lit(0)).alias("invalid_points"))
    return check_row(stats, "threshold_sweep_valid",
                     (F.col("invalid_points") == 0) & (F.col("points_checked") > 0),
                     F.struct("points_checked", "invalid_points"), False)


def bayesian_evidence_check(posterior: DataFrame, contributors: DataFrame, required: bool = False,
                            name: str = "bayesian_evidence_available") -> DataFrame:
    n = contributors.agg(F.count(F.lit(1)).alias("n"))
    stats = posterior.agg(F.coalesce(F.sum("evidence_count"), F.lit(0)).alias("total_evidence"))
    stats = stats.withColumn("contributors", n.scalar())
    return check_row(stats, name, (F.col("total_evidence") > 0) & (F.col("contributors") > 0),
                     F.struct("total_evidence", "contributors"), required)


def source_check(manifest: DataFrame, word: str, required: bool, name: str) -> DataFrame:
    """Does the run's data source mention a corpus?"""
    return check_row(manifest, name, F.lower(F.coalesce("source", F.lit(""))).contains(word.lower()),
                     F.struct("source"), required)


def class_balance_check(distribution: DataFrame, labels=lexicon.LEVELS,
                        minimum: float = 0.05) -> DataFrame:
    """Smallest class fraction at least ``minimum``; a label without rows counts as 0."""
    stats = distribution.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(F.when(F.col("label") == l, F.col("rows"))), F.lit(0)).alias(l)
          for l in labels])
    least = F.least(*[F.col(l) for l in labels]) / F.col("total")
    return check_row(stats, "class_balance_distribution",
                     (F.col("total") > 0) & (F.round(least, 6) >= minimum),
                     F.struct("total", *labels), False)


def presence_check(files: DataFrame, expected, name: str = "expected_artifacts_present") -> DataFrame:
    """Expected outputs that the (key) table lists; the rest are missing."""
    wanted = files.sparkSession.createDataFrame([(k,) for k in expected], "key string")
    missing = wanted.join(files.select("key").distinct(), "key", "left_anti")
    stats = missing.agg(F.array_sort(F.collect_list("key")).alias("missing"))
    return check_row(stats, name, F.size("missing") == 0, F.struct("missing"))


def overall(checks: DataFrame) -> DataFrame:
    """passed: every required check; failed ones by kind."""
    return checks.agg(
        F.coalesce(F.every(F.when(F.col("required"), F.col("passed"))), F.lit(True)).alias("passed"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col("required") & ~F.col("passed")).alias("failed_required"),
        F.count_if(~F.col("required") & ~F.col("passed")).alias("failed_advisory"))


def union_checks(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.transform(guard_unions).unionByName(p)
    return out


def run_validation(run: dict[str, DataFrame], labels=lexicon.LEVELS, require_bayesian: bool = False,
                   require_corpus: bool = False, corpus: str = "mixed",
                   corpus_advisory: bool = True, ece_threshold: float = 0.20) -> DataFrame:
    """All checks a run's tables allow; missing optional tables skip their checks.

    Tables: manifest (one row: source, executed_at), overlap, metrics, expected
    (split, rows), predictions, records, distribution; optional files, calibration,
    intervals, sweep, posterior, contributors.
    """
    parts = []
    if "files" in run:
        wanted = ["dataset_manifest", "classifier_metrics", "validation_predictions",
                  "test_predictions"] + (["bayesian_test"] if require_bayesian else [])
        parts.append(presence_check(run["files"], wanted))
    parts += [leakage_check(run["overlap"]), metric_range_check(run["metrics"]),
              count_check(run["predictions"], run["expected"]),
              prediction_schema_check(run["records"], labels),
              probability_mass_check(run["predictions"], labels),
              timestamp_check(run["manifest"])]
    if "calibration" in run:
        parts.append(ece_check(run["calibration"], ece_threshold))
    if "intervals" in run:
        parts.append(bootstrap_interval_check(run["intervals"]))
    if "sweep" in run:
        parts.append(threshold_check(run["sweep"]))
    if "posterior" in run:
        parts.append(bayesian_evidence_check(run["posterior"], run["contributors"],
                                             require_bayesian))
    elif require_bayesian:
        parts.append(check_row(run["manifest"], "bayesian_evidence_available", F.lit(False),
                               F.struct(F.lit("bayesian_payload_missing").alias("reason"))))
    if require_corpus:
        parts.append(source_check(run["manifest"], corpus, True, "corpus_source_required"))
    elif corpus_advisory:
        parts.append(source_check(run["manifest"], corpus, False, "corpus_source_advisory"))
    parts.append(class_balance_check(run["distribution"], labels))
    return union_checks(parts)


def acceptance(run: dict[str, DataFrame], model_type: str | None = "transformer",
               surface: str | None = "bayesian_posterior", require_corpus: bool = False,
               corpus: str = "mixed", corpus_advisory: bool = True) -> DataFrame:
    """Checks before a run is frozen; ``manifest`` also holds model_type,
    primary_metric_surface and bayesian_primary_score."""
    m = run["manifest"]
    same = lambda c, v: F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))) == v
    parts = [leakage_check(run["overlap"]),
             metric_range_check(run["metrics"], "classifier_metrics_in_range")]
    if model_type:
        parts.append(check_row(m, "model_type_required", same("model_type", model_type),
                               F.struct("model_type")))
    if require_corpus:
        parts.append(source_check(m, corpus, True, "corpus_source_required"))
    elif corpus_advisory:
        parts.append(source_check(m, corpus, False, "corpus_source_advisory"))
    if surface:
        parts.append(check_row(m, "bayesian_primary_surface", same("primary_metric_surface", surface),
                               F.struct("primary_metric_surface")))
        parts.append(check_row(m, "bayesian_primary_score_in_range",
                               in_unit_interval("bayesian_primary_score"),
                               F.struct(F.col("bayesian_primary_score").cast("string").alias("score"))))
        parts.append(bayesian_evidence_check(run["posterior"], run["contributors"], True,
                                             "bayesian_outputs_have_evidence"))
    parts.append(presence_check(run["files"], (
        "dataset_manifest", "classifier_metrics", "run_manifest", "validation_predictions",
        "test_predictions")))
    return union_checks(parts)


def metrics_shape_check(cells: DataFrame, labels=lexicon.LEVELS,
                        splits=("validation", "test")) -> DataFrame:
    """Missing (split, metric, label) cells of a long metrics table."""
    spark = cells.sparkSession
    whole = ("accuracy", "macro_precision", "macro_recall", "macro_f1")
    grid = [(s, m, "") for s in splits for m in whole] + [
        (s, m, l) for s in splits for m in ("per_class", "confusion") for l in labels]
    wanted = spark.createDataFrame(grid, "split string, metric string, label string")
    return wanted.join(cells.select("split", "metric", F.coalesce("label", F.lit("")).alias("label"))
                       .distinct(), ["split", "metric", "label"], "left_anti")


# --- runs against each other ---------------------------------------------------------

_RUN_METRICS = ("test_macro_f1", "test_accuracy", "bayesian_primary_score", "calibration_test_ece")


def leaderboard(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Runs ranked by macro F1, then accuracy; a missing metric ranks as -1."""
    return _ranked(runs, [-F.coalesce("test_macro_f1", F.lit(-1.0)), -F.coalesce("test_accuracy", F.lit(-1.0)), F.col(seq)])


def _ranked(runs: DataFrame, order: list[Column], block_rows: int = 1_000_000) -> DataFrame:
    """1-based ``rank`` of all rows in a total order, counted by blocks."""
    names = [c.alias(f"k{i}") for i, c in enumerate(order)]
    placed = OrderedBlocks(runs, names, block_rows).positions("rank")
    return placed.withColumn("rank", (F.col("rank") + 1).cast("int"))


def baseline_deltas(runs: DataFrame) -> DataFrame:
    """Difference of each metric to the one baseline run; null when either is missing."""
    base = runs.where("is_baseline").agg(*[F.first(m, ignorenulls=True).alias(m)
                                           for m in _RUN_METRICS])
    one = base.select(F.struct(*_RUN_METRICS).alias("b"))
    with_base = runs.where(~F.col("is_baseline")).withColumn("_b", one.scalar())
    return with_base.select("name", *[
        F.round(F.col(m) - F.col(f"_b.{m}"), 6).alias(f"delta_{m}") for m in _RUN_METRICS])


def compare_runs(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Validated runs against the one baseline, as a ranked table.

    ``runs``: artifact_dir, is_baseline, validation_passed, the four metrics and ``seq``.
    One row per run: name (last part of its folder), rank by macro F1 and accuracy (ties in
    ``seq`` order, the baseline first), and per metric the difference to the baseline, null
    for the baseline itself and where either side lacks it.
    """
    base = runs.where("is_baseline").agg(*[F.max(m).alias(m) for m in _RUN_METRICS]).select(F.struct(*_RUN_METRICS).alias("b"))
    order = [-F.coalesce("test_macro_f1", F.lit(-1.0)), -F.coalesce("test_accuracy", F.lit(-1.0)), ~F.col("is_baseline"), F.col(seq)]
    ranked = _ranked(runs.withColumn("_b", base.scalar()), order)
    delta = lambda m: F.when(~F.col("is_baseline"), F.round(F.col(m) - F.col(f"_b.{m}"), 6)).alias(f"delta_{m}")
    return ranked.select(
        "artifact_dir", F.regexp_extract("artifact_dir", r"([^/]*)/*$", 1).alias("name"), "is_baseline",
        F.coalesce("validation_passed", F.lit(False)).alias("validation_passed"), "rank", *_RUN_METRICS,
        *[delta(m) for m in _RUN_METRICS])


def registry_rank(runs: DataFrame, seq: str = "seq") -> DataFrame:
    """Runs with both main metrics first, then by F1 and accuracy, as a ``rank`` column;
    ties keep their order in ``seq``."""
    lacks = (F.col("test_macro_f1").isNull() | F.col("test_accuracy").isNull()).cast("int")
    return _ranked(runs, [lacks, *[-F.coalesce(m, F.lit(-1.0)) for m in ("test_macro_f1", "test_accuracy")], F.col(seq)])


def run_trend(runs: DataFrame, series: str = "model_type", metric: str = "test_macro_f1",
              block_rows: int = 1_000_000) -> DataFrame:
    """Change of a metric from run to run of a series, by execution time."""
    order = [F.col(c) for c in dict.fromkeys((series, "executed_at", "name"))]
    placed = OrderedBlocks(runs, order, block_rows).previous([series, metric], "_before")
    same = F.col(f"_before.`{series}`").eqNullSafe(F.col(series))
    return placed.withColumn("change", F.when(same, F.round(F.col(metric) - F.col(f"_before.`{metric}`"), 6))).drop("_before")


# --- extracted files -----------------------------------------------------------------

# What native ids look like per regulation family.
ID_PATTERNS = {
    "gdpr": r"^Article ",
    "iso": r"^(?:[1-9]\d*|A)(?:\.[0-9]+|\.[a-z])*$",
    "nistpf": r"^[A-Z]{2}\.[A-Z]{2}-P\d+$",
}


def duplicate_counts(df: DataFrame, ids: list[str], group: str = "regulation") -> DataFrame:
    return df.groupBy(group).agg(*[
        (F.count(i) - F.count_distinct(i)).alias(f"duplicate_{i}") for i in ids])


def dangling_chunks(chunks: DataFrame, controls: DataFrame) -> DataFrame:
    keys = controls.select(F.col("normalized_id").alias("control_id"))
    return chunks.join(keys, "control_id", "left_anti")


def id_differences(controls: DataFrame, expected: DataFrame) -> DataFrame:
    """(regulation, native_id, side): ids missing from, or extra to, the expected list."""
    have = controls.select("regulation", "native_id").where(F.trim("native_id") != "").distinct()
    want = expected.select("regulation", "native_id").where(F.trim("native_id") != "").distinct()
    both = ["regulation", "native_id"]
    return want.join(have, both, "left_anti").withColumn("side", F.lit("missing")).transform(guard_unions).unionByName(
        have.join(want, both, "left_anti").withColumn("side", F.lit("extra")))


def id_algebra(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many distinct ids are on both sides, only left, only right."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    both = l.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"),
                    F.count_if(F.col("_r").isNull()).alias("only_left"),
                    F.count_if(F.col("_l").isNull()).alias("only_right"))


def asked_bits(keys: DataFrame, column: str, most: int = 1 << 28) -> tuple[np.ndarray, int]:
    """A bitmap of hashes: 64 bits for each of them, ``most`` together (32 MB)."""
    bits = 1 << 16
    n = keys.count()
    while bits < min(64 * n, most):
        bits *= 2

    def block(key, pdf: pd.DataFrame) -> pd.DataFrame:
        part = np.zeros(1 << 16, bool)
        part[pdf["bit"].to_numpy() & 0xFFFF] = True
        return pd.DataFrame({"block": [key[0]], "part": [np.packbits(part).tobytes()]})

    at = F.pmod(column, F.lit(bits))
    blocks = keys.select(at.alias("bit"), F.floor(at / (1 << 16)).cast("int").alias("block")).groupBy("block").applyInPandas(
        block, "block int, part binary").collect()  # at most 4096 of 8192 bytes
    out = np.zeros((bits >> 16, 1 << 13), np.uint8)
    for r in blocks:
        out[r["block"]] = np.frombuffer(r["part"], np.uint8)
    return out.reshape(-1), bits


def asked_only(rows: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """The rows' lists ``column`` of hashes, one in a row as ``name``, without most of those that
    ``keys`` (a column ``name``) does not have; what passes by chance joins nothing."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from clausewise.operators.ordering import reach_workers
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    reach_workers(rows.sparkSession)
    bitmap, bits = asked_bits(keys, name)
    held = rows.sparkSession.sparkContext.broadcast(bitmap)
    kept = [f for f in rows.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(name, T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            lists = batch.column(column)
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bit = flat & (bits - 1)
            hit = (held.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1
            row = pa.array(np.repeat(np.arange(batch.num_rows), size)[hit])
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name).take(row) for f in kept], pa.array(flat[hit])], schema=arrow)

    return rows.mapInArrow(run, schema)


#: Characters of short probes that every task holds.
BROADCAST_CHARS = 16_000_000


def source_match_rate(controls: DataFrame, sources: DataFrame, sample: int | None = None,
                      probe_chars: int | None = None, words: int = 8, salts: int = 16) -> DataFrame:
    """Of the controls of each regulation, how many occur in one of its source texts.

    All controls with their whole texts; ``sample`` takes the first so many of each
    regulation, ``probe_chars`` the start of each text. A longer probe meets the texts that
    have one of its inner runs of ``words`` words, which stand in them as whole words; a
    shorter one meets all texts of its regulation. Probes come to the texts, in lists of
    limited length; what goes back is a hash. Equal probes and equal texts are tested once.
    """
    from clausewise.functions.text import normalize_space
    from clausewise.operators.ordering import materialize, release, top_k

    rows = controls.select("regulation", "seq", normalize_space("text").alias("probe"))
    if sample is not None:
        rows = top_k(rows, ["regulation"], [F.col("seq")], sample)
    if probe_chars is not None:
        rows = rows.withColumn("probe", F.substring("probe", 1, probe_chars))
    probes = materialize(rows.groupBy("regulation", "probe").agg(F.count(F.lit(1)).alias("n")).withColumn("_probe", F.sha1("probe")))
    whole = sources.select("regulation", normalize_space("source_text").alias("_whole")).distinct()
    whole = materialize(whole.withColumn("_text", F.sha1("_whole")))
    release(controls.sparkSession)  # what was shuffled for both is read no more

    def runs(first: Column, last: Column) -> Column:
        return F.when(last >= first, F.array_distinct(F.transform(
            F.sequence(first, last), lambda i: F.xxhash64("regulation", F.slice("_w", i, F.lit(words))))))

    split = probes.withColumn("_w", F.split("probe", " "))
    keyed = materialize(split.select("regulation", "probe", "_probe", F.array_min(
        runs(F.lit(2), F.size("_w") - words)).alias("_key")))
    # Of a text's runs only those that some probe asks for are moved.
    each = whole.withColumn("_w", F.split("_whole", " ")).select("regulation", "_text", F.coalesce(
        runs(F.lit(1), F.size("_w") - words + 1), F.array().cast("array<bigint>")).alias("_keys"))
    held = asked_only(each, keyed.where("_key is not null").select("_key"), "_keys", "_key")
    asked = F.collect_list(F.struct("_probe", "probe")).alias("_asked")
    # Longer probes: those that share a run with a text, dealt to several lists a text.
    met = keyed.join(held, ["regulation", "_key"]).groupBy(
        "regulation", "_text", F.pmod(F.xxhash64("_probe"), F.lit(64)).alias("_list")).agg(asked)
    met = met.join(whole, ["regulation", "_text"])
    # Shorter ones: lists of them go to every text, where it lies if they are few; else a
    # regulation's texts are dealt by a salt.
    few = keyed.where("_key is null and probe <> ''")
    chars = few.agg(F.coalesce(F.sum(F.length("probe")), F.lit(0))).first()[0]
    lists = few.groupBy("regulation", F.pmod(F.xxhash64("_probe"), F.lit(64)).alias("_list")).agg(asked)
    if chars <= BROADCAST_CHARS:
        short = whole.join(F.broadcast(lists), "regulation")
    else:
        lists = lists.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        short = whole.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(salts)).cast("int")).join(lists, ["regulation", "_salt"])
    held_in = lambda d: d.select("regulation", F.explode(F.filter(
        "_asked", lambda p: F.contains(F.col("_whole"), p["probe"]))["_probe"]).alias("_probe"))
    hit = held_in(met).transform(guard_unions).unionByName(held_in(short)).distinct().withColumn("_hit", F.lit(1))
    return probes.join(hit, ["regulation", "_probe"], "left").groupBy("regulation").agg(
        F.sum("n").alias("sampled"), F.sum(F.when(F.col("_hit") == 1, F.col("n")).otherwise(0)).alias("source_matches"))


def count_reconciliation(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected rows per group against counted rows."""
    counted = actual.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    return expected.join(counted, key, "full").select(
        key, "expected", F.coalesce("actual", F.lit(0)).alias("actual"),
        F.coalesce(F.col("expected") == F.coalesce("actual", F.lit(0)), F.lit(False)).alias("ok"))


def alignment_check(controls: DataFrame, chunks: DataFrame, expected: DataFrame,
                    patterns=None) -> DataFrame:
    """Per regulation: duplicates, dangling chunks, metadata and id problems, verdict.

    Repeated normalized ids are reported but do not gate.
    """
    patterns = patterns or ID_PATTERNS
    dup_c = duplicate_counts(controls, ["record_id", "normalized_id"])
    dup_k = duplicate_counts(chunks, ["chunk_id"])
    lost = dangling_chunks(chunks, controls).groupBy("regulation").agg(
        F.count(F.lit(1)).alias("missing_chunk_refs"))
    meta = F.lower(F.coalesce(F.try_element_at("metadata", F.lit("regulation")), F.lit("")))
    off = chunks.groupBy("regulation").agg(
        F.count_if(meta != F.lower("regulation")).alias("metadata_mismatch"))
    family = F.lower("regulation")
    pattern_ok = F.lit(True)
    for prefix, p in patterns.items():
        pattern_ok = pattern_ok & (~family.startswith(prefix) | F.col("native_id").rlike(p))
    ids = controls.groupBy("regulation").agg(F.every(pattern_ok).alias("id_pattern_ok"))
    diff = id_differences(controls.join(expected.select("regulation").distinct(), "regulation",
                                        "left_semi"), expected).groupBy("regulation").agg(
        F.count_if(F.col("side") == "missing").alias("missing_ids"),
        F.count_if(F.col("side") == "extra").alias("extra_ids"))
    out = dup_c
    for part in (dup_k, lost, off, ids, diff):
        out = out.join(part, "regulation", "left")
    zeros = ["duplicate_chunk_id", "missing_chunk_refs", "metadata_mismatch", "missing_ids",
             "extra_ids"]
    out = out.na.fill(0, zeros)
    gate = ["duplicate_record_id", *zeros]
    ok = F.col("id_pattern_ok")
    for c in gate:
        ok = ok & (F.col(c) == 0)
    return out.withColumn("ok", ok)
