"""Classifier reports: confusion, metrics, calibration, threshold sweep, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions.probabilities import (
    argmax_label, probabilities_or_fallback, renormalize_with_flags,
)


def prediction_table(scored: DataFrame, labels=lexicon.LEVELS, digits: int = 6) -> DataFrame:
    """Renormalized predictions with diagnostics flags; values rounded like reports."""
    fixed, renormalized, uniform = renormalize_with_flags("probabilities", labels)
    step = scored.withColumn("_f", fixed).withColumn("renormalized", renormalized).withColumn(
        "uniform_fallback", uniform)
    conf = F.coalesce(F.try_element_at("_f", F.col("predicted_label")), F.lit(0.0))
    return (step.withColumn("confidence", F.round(conf, digits))
            .withColumn("probabilities", F.transform_values("_f", lambda k, v: F.round(v, digits)))
            .drop("_f"))


def probability_diagnostics(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.count_if("renormalized").alias("renormalized_rows"),
                           F.count_if("uniform_fallback").alias("uniform_fallback_rows"))


def confusion(predictions: DataFrame, labels=lexicon.LEVELS, group: list[str] = ()) -> DataFrame:
    """Every (actual, predicted) cell over ``labels`` with its row count."""
    order = list(labels)
    cells = [F.struct(F.lit(a).alias("actual_label"), F.lit(p).alias("predicted_label"),
                      F.count_if((F.col("actual_label") == a) & (F.col("predicted_label") == p))
                      .alias("n"))
             for a in order for p in order]
    wide = predictions.groupBy(*group).agg(F.array(*cells).alias("c"))
    return wide.select(*group, F.explode("c").alias("c")).select(*group, "c.*")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def per_class_metrics(cells: DataFrame, labels=lexicon.LEVELS, group: list[str] = ()) -> DataFrame:
    """Precision, recall, F1, support per label, from confusion cells only."""
    a, p, n = F.col("actual_label"), F.col("predicted_label"), F.col("n")
    none = F.lit(0).cast("bigint")

    def part(label, tp, fp, fn):
        return F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))

    # A cell counts for its actual and its predicted label; zeros keep every label.
    parts = F.array(
        part(a, F.when(a == p, n).otherwise(none), none, F.when(a != p, n).otherwise(none)),
        part(p, none, F.when(a != p, n).otherwise(none), none),
        *[part(F.lit(l), none, none, none) for l in labels])
    flat = cells.select(*group, F.explode(parts).alias("m")).select(*group, "m.*").groupBy(
        *group, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision = _ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    step = flat.withColumn("precision", precision).withColumn("recall", recall)
    f1 = _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return step.withColumn("f1", f1).withColumn("support", F.col("tp") + F.col("fn"))


def classification_metrics(predictions: DataFrame, labels=lexicon.LEVELS,
                           in_vocabulary_only: bool = False, group: list[str] = ()) -> DataFrame:
    """One row per group: rows, accuracy, macro P/R/F1, support-weighted F1.

    Accuracy is over all rows. By default any equal pair counts as correct; with
    ``in_vocabulary_only`` only pairs inside ``labels`` do. The predictions are read
    once: everything else is arithmetic on the label grid.
    """
    order = list(labels)
    same = F.col("actual_label") == F.col("predicted_label")
    if in_vocabulary_only:
        same = same & F.col("actual_label").isin(order)
    cells = predictions.groupBy(*group, "actual_label", "predicted_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(same).alias("_ok"))
    base = cells.groupBy(*group).agg(F.sum("n").alias("rows"), F.sum("_ok").alias("_correct"))
    inside = cells.where(F.col("actual_label").isin(order) & F.col("predicted_label").isin(order))
    m = per_class_metrics(inside, order, list(group))
    macro = m.groupBy(*group).agg(
        F.avg("precision").alias("_mp"), F.avg("recall").alias("_mr"), F.avg("f1").alias("_mf"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("_wf"))
    if group:
        joined = base.join(macro, list(group), "left")
    else:
        joined = base.withColumn("_x", macro.select(F.struct("*").alias("s")).scalar()).select(
            "rows", "_correct", "_x.*")
    out = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6)
    return joined.select(
        *group, F.coalesce("rows", F.lit(0)).alias("rows"),
        F.round(F.coalesce(_ratio(F.col("_correct"), F.col("rows")), F.lit(0.0)), 6).alias("accuracy"),
        out("_mp").alias("macro_precision"), out("_mr").alias("macro_recall"),
        out("_mf").alias("macro_f1"), out("_wf").alias("weighted_f1"))


def _with_probabilities(predictions: DataFrame, labels) -> DataFrame:
    if "probabilities" not in predictions.columns:
        predictions = predictions.withColumn(
            "probabilities", F.lit(None).cast("map<string,double>"))
    p = probabilities_or_fallback("probabilities", "predicted_label", "confidence", labels)
    return predictions.withColumn("_p", p)


def calibration(predictions: DataFrame, labels=lexicon.LEVELS, bins: int = 10,
                group: list[str] = ()) -> DataFrame:
    """Reliability bins for the top label and for each label; empty bins as zeros.

    Aggregates to targets x bins in one pass; ECE and Brier follow from the bins
    (:func:`calibration_summary`).
    """
    order, bins = list(labels), max(1, bins)
    rows = _with_probabilities(predictions, order)
    predicted = F.when(F.col("predicted_label").isin(order), F.col("predicted_label")).otherwise(
        argmax_label("_p", order))
    rows = rows.withColumn("_pred", predicted)
    views = [F.struct(F.lit("top_label").alias("target"),
                      F.element_at("_p", F.col("_pred")).alias("conf"),
                      (F.col("_pred") == F.col("actual_label")).cast("double").alias("hit"))]
    views += [F.struct(F.lit(l).alias("target"), F.element_at("_p", F.lit(l)).alias("conf"),
                       (F.col("actual_label") == l).cast("double").alias("hit")) for l in order]
    flat = rows.select(*group, F.explode(F.array(*views)).alias("v")).select(*group, "v.*")
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf")))
    binned = flat.withColumn("conf", conf).withColumn(
        "bin_index", F.least(F.lit(bins - 1), F.floor(F.col("conf") * bins)).cast("int"))
    binned = binned.withColumn("hit", F.coalesce("hit", F.lit(0.0)))
    sums = binned.groupBy(*group, "target", "bin_index").agg(
        F.count(F.lit(1)).alias("count"), F.sum("conf").alias("_c"), F.sum("hit").alias("_h"),
        F.sum((F.col("hit") - F.col("conf")) ** 2).alias("_e"))
    grid = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin_index")
    targets = F.explode(F.array(*[F.lit(t) for t in ["top_label", *order]])).alias("target")
    if group:
        base = sums.select(*group).distinct().select(*group, targets).select("*", grid)
    else:
        base = sums.sparkSession.range(1).select(targets).select("*", grid)
    full = base.join(sums, [*group, "target", "bin_index"], "left")
    n = F.coalesce("count", F.lit(0))
    return full.select(
        *group, "target", "bin_index",
        F.round(F.col("bin_index") / bins, 6).alias("lower"),
        F.round((F.col("bin_index") + 1) / bins, 6).alias("upper"),
        n.alias("count"),
        F.coalesce(F.col("_c") / F.col("count"), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.col("_h") / F.col("count"), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.col("_h") / F.col("count") - F.col("_c") / F.col("count"), F.lit(0.0)).alias("gap"),
        F.coalesce("_e", F.lit(0.0)).alias("squared_error"))


def calibration_summary(bins: DataFrame, group: list[str] = ()) -> DataFrame:
    """Rows, expected calibration error and Brier score per target."""
    n = F.greatest(F.sum("count"), F.lit(1))
    return bins.groupBy(*group, "target").agg(
        F.sum("count").alias("num_rows"),
        F.round(F.sum(F.col("count") * F.abs("gap")) / n, 6).alias("ece"),
        F.round(F.sum("squared_error") / n, 6).alias("brier"))


def macro_ece(summary: DataFrame, group: list[str] = ()) -> DataFrame:
    """Mean of the rounded per-label errors (the top-label view is left out)."""
    return summary.where("target <> 'top_label'").groupBy(*group).agg(
        F.round(F.avg("ece"), 6).alias("macro_ece"))


def default_thresholds() -> list[float]:
    return [round(0.10 + 0.05 * i, 4) for i in range(18)]


def threshold_sweep(predictions: DataFrame, focus=("user", "system"), labels=lexicon.LEVELS,
                    thresholds=None) -> DataFrame:
    """Precision / recall / F1 of one label against the rest at each threshold.

    Each score is put once into the interval between two thresholds; a reverse
    running sum over the intervals gives every threshold. Rows are never multiplied
    by thresholds.
    """
    cuts = sorted(round(float(t), 4) for t in (thresholds or default_thresholds()))
    focus = [l for l in focus if l in labels]
    rows = _with_probabilities(predictions, labels)
    level = lambda s: sum((F.when(s >= t, 1).otherwise(0) for t in cuts[1:]),
                          F.when(s >= cuts[0], 1).otherwise(0))
    views = F.array(*[F.struct(
        F.lit(l).alias("label"), level(F.element_at("_p", F.lit(l))).alias("passed"),
        (F.col("actual_label") == l).alias("pos")) for l in focus])
    flat = rows.select(F.explode(views).alias("v")).select("v.*")
    counts = flat.groupBy("label", "passed").agg(
        F.count_if("pos").alias("pos"), F.count_if(~F.coalesce("pos", F.lit(False))).alias("neg"))
    points = F.array(*[F.struct(F.lit(i).alias("passed"), F.lit(t).alias("threshold"))
                       for i, t in enumerate([None, *cuts])])
    spark = predictions.sparkSession
    grid = spark.range(1).select(F.explode(lexicon.strings(focus)).alias("label"),
                                 F.expr("1").alias("_o")).select(
        "label", F.explode(points).alias("g")).select(
        "label", "g.passed", F.col("g.threshold").cast("double").alias("threshold"))
    full = grid.join(counts, ["label", "passed"], "left").na.fill(0, ["pos", "neg"])
    above = Window.partitionBy("label").orderBy(F.col("passed").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    everything = Window.partitionBy("label")
    step = full.select(
        "label", "threshold", F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"), F.sum("pos").over(everything).alias("_p"),
        F.sum("neg").over(everything).alias("_n")).where(F.col("threshold").isNotNull())
    step = step.withColumn("fn", F.col("_p") - F.col("tp")).withColumn(
        "tn", F.col("_n") - F.col("fp"))
    step = step.withColumn("_pr", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn(
        "_re", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = _ratio(2 * F.col("_pr") * F.col("_re"), F.col("_pr") + F.col("_re"))
    return step.select(
        "label", "threshold", F.round("_pr", 6).alias("precision"),
        F.round("_re", 6).alias("recall"), F.round(f1, 6).alias("f1"),
        (F.col("tp") + F.col("fn")).alias("support_positive"),
        (F.col("tp") + F.col("fp")).alias("predicted_positive"), "tp", "fp", "fn", "tn")


def _log_factorial(n):
    """Natural logarithm of n!: summed below 32, by Stirling's series from there on."""
    import numpy as np

    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 33)))])
    x = np.maximum(n, 32) + 1.0
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x ** 3) + 1 / (1260 * x ** 5)
    return np.where(n <= 32, table[np.minimum(n, 32).astype(int)], series)


def binomial_quantile(n: int, p: float, u: float) -> int:
    """Fewest successes of n whose distribution function reaches u. Only numbers within
    twelve standard deviations are looked at; outside them lies nothing that a u of 52 bits
    can tell."""
    import numpy as np

    if n <= 0 or p <= 0:
        return 0
    if p >= 1:
        return n
    reach = 12 * (n * p * (1 - p)) ** 0.5 + 40
    k = np.arange(max(0, int(n * p - reach)), min(n, int(n * p + reach) + 1) + 1, dtype=np.float64)
    mass = np.exp(_log_factorial(np.float64(n)) - _log_factorial(k) - _log_factorial(n - k) + k * np.log(p) + (n - k) * np.log1p(-p))
    return int(k[min(int(np.searchsorted(np.cumsum(mass), u)), len(k) - 1)])


def uniform_draw(*parts) -> float:
    """A number in [0, 1) of 52 bits that belongs to its counters: part of their md5."""
    import hashlib

    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 2.0 ** 52


def bootstrap_ci(predictions: DataFrame, labels=lexicon.LEVELS, resamples: int = 1000,
                 seed: int = 42) -> DataFrame:
    """Percentile intervals of accuracy and F1 under label-stratified resampling.

    Within an actual label, drawing rows with replacement is a multinomial draw over that
    label's predicted cells. So the predictions are read once for their confusion cells, and
    each resample is a draw on at most K x (K+1) numbers, whatever the number of rows: cell
    by cell a binomial share of what is left, by inverse distribution of a number that is
    part of md5("seed:resample:actual:predicted"). Any engine can repeat the draws.
    """
    import numpy as np
    import pandas as pd

    order = list(labels)
    k = len(order)
    inside = F.col("actual_label").isin(order)
    actual = F.when(inside, F.col("actual_label")).otherwise("")
    predicted = F.when(F.col("predicted_label").isin(order), F.col("predicted_label")).otherwise("")
    cells = predictions.groupBy(actual.alias("a"), predicted.alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    names_of = [*order, ""]
    position = {l: i for i, l in enumerate(names_of)}
    packed = cells.agg(F.collect_list(F.struct("a", "p", "n")).alias("c"))

    names = ["accuracy", "macro_f1", "weighted_f1", *[f"f1_{l}" for l in order]]

    def metrics(grid: np.ndarray) -> list[float]:
        g = grid[:k, :k].astype(float)
        tp, support, called = np.diag(g), grid[:k].sum(axis=1).astype(float), grid[:, :k].sum(axis=0).astype(float)
        f1 = np.where(support + called > 0, 2 * tp / np.maximum(support + called, 1), 0.0)
        weight = support.sum()
        return [tp.sum() / max(grid.sum(), 1), f1.mean() if k else 0.0,
                float((f1 * support).sum() / weight) if weight > 0 else 0.0, *f1]

    def resampled(row: np.ndarray, resample: int, label: str) -> list[int]:
        out, left = [], int(row.sum())
        for j, c in enumerate(row):
            rest = int(row[j:].sum())
            out.append(binomial_quantile(left, c / rest if rest else 0.0, uniform_draw(seed, resample, label, names_of[j])))
            left -= out[-1]
        return out

    def draw(batches):
        for pdf in batches:
            out = []
            for resample, c in zip(pdf["id"], pdf["cells"]):
                grid = np.zeros((k + 1, k + 1), dtype=np.int64)
                for cell in c:
                    grid[position[cell["a"]], position[cell["p"]]] += cell["n"]
                if resample >= 0:
                    grid = np.array([resampled(row, int(resample), l) for row, l in zip(grid, names_of)])
                out.append([resample, *metrics(grid)])
            yield pd.DataFrame(out, columns=["id", *names])

    spark = predictions.sparkSession
    # Resample -1 is the data itself: the baseline.
    ids = spark.range(-1, max(1, resamples)).withColumn("cells", packed.scalar())
    series = ids.mapInPandas(draw, "id bigint, " + ", ".join(f"`{n}` double" for n in names))
    long = series.select("id", F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])).alias("m")
    ).select("id", "m.*")
    sample = F.when(F.col("id") >= 0, F.col("value"))
    ends = F.percentile(sample, F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(
        F.round(F.max(F.when(F.col("id") < 0, F.col("value"))), 6).alias("baseline"),
        F.round(F.avg(sample), 6).alias("mean"), ends.alias("e")).select(
        "metric", "baseline", "mean", F.round(F.col("e")[0], 6).alias("lower"),
        F.round(F.col("e")[1], 6).alias("upper"))


def band_accuracy(scored: DataFrame, label: str = "label", score: str = "score",
                  band: str = "band", group: list[str] = ()) -> DataFrame:
    """Mean confidence, three-way and two-way band accuracy; null without mapped rows."""
    from clausewise.functions.scoring import binary_band, normalize_band

    rows = scored.where(F.col(score).isNotNull()).withColumn("_pred", normalize_band(label))
    truth = F.lower(F.col(band))
    tri = F.col("_pred").isNotNull()
    both = tri & binary_band(truth).isNotNull()
    hit_tri = F.count_if(tri & (F.col("_pred") == truth))
    hit_bin = F.count_if(both & (binary_band("_pred") == binary_band(truth)))
    n_tri, n_bin = F.count_if(tri), F.count_if(both)
    return rows.groupBy(*group).agg(
        F.round(F.avg(score), 6).alias("average_confidence"),
        F.round(F.when(n_tri > 0, hit_tri / n_tri), 6).alias("tri_label_accuracy"),
        F.round(F.when(n_bin > 0, hit_bin / n_bin), 6).alias("binary_accuracy"),
        n_tri.alias("tri_samples"), n_bin.alias("binary_samples"))
