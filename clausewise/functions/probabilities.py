"""Label-probability maps: clipping, renormalizing, fallbacks, vector summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausewise.functions.text import col


def _values(m: Column, labels, clip: bool) -> list[Column]:
    out = []
    for label in labels:
        v = F.coalesce(F.element_at(m, F.lit(label)), F.lit(0.0))
        out.append(F.greatest(F.lit(0.0), v) if clip else v)
    return out


def _sum(cols) -> Column:
    total = F.lit(0.0)
    for c in cols:
        total = total + c
    return total


def as_map(labels, cols) -> Column:
    pairs = []
    for label, c in zip(labels, cols):
        pairs += [F.lit(label), c]
    return F.create_map(*pairs)


def probabilities_or_fallback(m, predicted, confidence, labels) -> Column:
    """Clipped, renormalized map; without mass, spread by the stated confidence."""
    labels = list(labels)
    vals = _values(col(m), labels, clip=True)
    total = _sum(vals)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(col(confidence), F.lit(0.0))))
    others = max(len(labels) - 1, 1)
    pred = F.coalesce(col(predicted), F.lit(""))
    spread = [
        F.when(pred == label, conf).otherwise(F.greatest(F.lit(0.0), 1.0 - conf) / others)
        for label in labels
    ]
    uniform = [F.lit(1.0 / max(len(labels), 1)) for _ in labels]
    return (
        F.when(total > 0, as_map(labels, [v / total for v in vals]))
        .when(pred.isin(labels), as_map(labels, spread))
        .otherwise(as_map(labels, uniform))
    )


def renormalize_with_flags(m, labels, tolerance: float = 1e-6) -> tuple[Column, Column, Column]:
    """(map, was renormalized, fell back to uniform)."""
    labels = list(labels)
    vals = _values(col(m), labels, clip=False)
    total = _sum(vals)
    has_mass = total > 0
    fixed = F.when(has_mass, as_map(labels, [v / total for v in vals])).otherwise(
        as_map(labels, [F.lit(1.0 / max(len(labels), 1)) for _ in labels]))
    return fixed, has_mass & (F.abs(total - 1.0) > tolerance), ~has_mass


def argmax_label(m, labels) -> Column:
    """Label with the largest value; the first one on a tie."""
    labels = list(labels)
    best = F.array_max(F.array(*[
        F.struct(F.coalesce(F.element_at(col(m), F.lit(l)), F.lit(float("-inf"))).alias("v"),
                 F.lit(-i).alias("i"), F.lit(l).alias("label"))
        for i, l in enumerate(labels)
    ]))
    return best["label"]


def attention_entropy(arr) -> Column:
    return -F.aggregate(col(arr), F.lit(0.0),
                        lambda acc, p: acc + p.cast("double") * F.log(p.cast("double") + 1e-12))


def l2_norm(arr) -> Column:
    return F.sqrt(F.aggregate(col(arr), F.lit(0.0),
                              lambda acc, x: acc + x.cast("double") * x.cast("double")))


def mean_abs(arr) -> Column:
    total = F.aggregate(col(arr), F.lit(0.0), lambda acc, x: acc + F.abs(x.cast("double")))
    return total / F.size(col(arr))


def mean_value(arr) -> Column:
    total = F.aggregate(col(arr), F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return total / F.size(col(arr))


def sigmoid(c) -> Column:
    return 1.0 / (1.0 + F.exp(-col(c)))
