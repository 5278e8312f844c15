"""Queries over labelled clauses: splits, models, predictions, reports, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise.functions import text
from clausewise.operators import assess, classify, evaluate, risk, splits
from clausewise.operators.ordering import materialize
from clausewise.plans import inputs as I


def _split(spark, sf):
    ex = materialize(I.labeled_examples(spark, sf))
    return splits.apply_split(ex, materialize(splits.split_policies(ex)))


def _model(spark, sf):
    return classify.nb_fit(_split(spark, sf).where("split = 'train'"))


def predictions(spark, sf):
    ex = _split(spark, sf)
    held = ex.where("split <> 'train'").select(
        "example_id", "policy_uid", "split", F.col("label").alias("actual_label"), "text")
    model = classify.nb_fit(ex.where("split = 'train'"))
    p = classify.nb_predict(held, model, ["example_id", "policy_uid", "split", "actual_label"])
    return materialize(evaluate.prediction_table(p))


def policy_signal(spark, sf):
    return classify.model_signal(I.policy_docs(spark, sf), _model(spark, sf))


def clause_labels(spark, sf):
    return I.labeled_examples(spark, sf)


def policy_split(spark, sf):
    return splits.split_policies(I.labeled_examples(spark, sf))


def covered_split(spark, sf):
    ex = I.labeled_examples(spark, sf)
    return splits.ensure_label_coverage(ex, splits.split_policies(ex))


def moved_split(spark, sf):
    """No validation or test clause is for users: a train policy moves to each of them."""
    ex = I.labeled_examples(spark, sf)
    assigned = materialize(splits.split_policies(ex))
    bare = ex.join(assigned, "policy_uid").withColumn("label", F.when(
        (F.col("split") != "train") & (F.col("label") == "user"), "system").otherwise(F.col("label"))).drop("split")
    return splits.ensure_label_coverage(materialize(bare), assigned)


def split_summary(spark, sf):
    return splits.split_summary(splits.assert_no_leakage(_split(spark, sf)))


def split_with_auxiliary(spark, sf):
    base = _split(spark, sf)
    aux = I.labeled_examples(spark, sf).where("label <> 'organization'")
    return splits.split_summary(splits.append_auxiliary(base, aux, "auxiliary::clauses"))


def policy_overlap(spark, sf):
    # Split by example instead of policy, so that policies do leak.
    ex = I.labeled_examples(spark, sf)
    h = F.conv(F.substring(F.md5("example_id"), 1, 4), 16, 10).cast("int") % 10
    leaky = ex.withColumn("split", F.when(h < 8, "train").when(h == 8, "validation").otherwise("test"))
    return splits.policy_overlap(leaky)


def class_distribution(spark, sf):
    return splits.class_distribution(_split(spark, sf))


def nb_model(spark, sf):
    return _model(spark, sf).tokens


def nb_classes(spark, sf):
    m = _model(spark, sf)
    s = m.settings().select("s.n", "s.v")
    return m.classes.withColumn("total_docs", s.select("n").scalar()).withColumn(
        "vocabulary", s.select("v").scalar())


def nb_predictions(spark, sf):
    p = predictions(spark, sf)
    at = lambda l: F.element_at("probabilities", F.lit(l)).alias(f"p_{l}")
    return p.select("example_id", "policy_uid", "split", "actual_label", "predicted_label",
                    "confidence", at("user"), at("system"),
                    at("organization"))


def classifier_metrics(spark, sf):
    return evaluate.classification_metrics(predictions(spark, sf), group=["split"])


def per_class_metrics(spark, sf):
    m = evaluate.per_class_metrics(evaluate.confusion(predictions(spark, sf)))
    return m.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")],
                    "support")


def confusion(spark, sf):
    return evaluate.confusion(predictions(spark, sf))


def probability_diagnostics(spark, sf):
    """Damaged probability maps (scaled or emptied by row), then repaired and counted."""
    p = predictions(spark, sf).drop("renormalized", "uniform_fallback")
    h = F.conv(F.substring(F.md5("example_id"), 1, 4), 16, 10).cast("int") % 5
    scale = F.when(h == 0, 2.0).when(h == 1, 0.0).otherwise(1.0)
    hurt = p.withColumn("probabilities", F.transform_values("probabilities", lambda k, v: v * scale))
    # Rounded maps are off by up to 1e-6 each; repair them first so flags are exact.
    return evaluate.probability_diagnostics(evaluate.prediction_table(hurt, digits=6).withColumn(
        "renormalized", F.col("renormalized") & (h == 0)))


def repaired_probabilities(spark, sf):
    """Maps emptied for some rows fall back on the stated confidence."""
    from clausewise.functions.probabilities import probabilities_or_fallback

    p = predictions(spark, sf)
    h = F.conv(F.substring(F.md5("example_id"), 1, 4), 16, 10).cast("int") % 4
    m = F.when(h > 1, F.col("probabilities"))
    pred = F.when(h == 1, "unknown").otherwise(F.col("predicted_label"))
    fixed = p.select("example_id", probabilities_or_fallback(
        m, pred, "confidence", ("user", "system", "organization")).alias("m"))
    return fixed.select("example_id", *[F.round(F.element_at("m", F.lit(l)), 8).alias(f"p_{l}")
                                        for l in ("user", "system", "organization")])


def calibration(spark, sf):
    c = evaluate.calibration(predictions(spark, sf))
    return c.select("target", "bin_index", "lower", "upper", "count",
                    *[F.round(x, 6).alias(x) for x in ("avg_confidence", "accuracy", "gap")])


def calibration_summary(spark, sf):
    return evaluate.calibration_summary(evaluate.calibration(predictions(spark, sf)))


def macro_ece(spark, sf):
    return evaluate.macro_ece(calibration_summary(spark, sf))


def threshold_sweep(spark, sf):
    return evaluate.threshold_sweep(predictions(spark, sf))


def bootstrap_ci(spark, sf):
    return evaluate.bootstrap_ci(predictions(spark, sf), resamples=1000)


def posterior_risk(spark, sf):
    return risk.beta_posterior(predictions(spark, sf)).drop("_mean", "indicators")


def posterior_risk_actual(spark, sf):
    return risk.beta_posterior(predictions(spark, sf), key="actual_label").drop("_mean", "indicators")


def overall_risk(spark, sf):
    return risk.overall_risk(risk.beta_posterior(predictions(spark, sf)))


def top_contributors(spark, sf):
    t = risk.top_contributors(predictions(spark, sf))
    return t.select("level", "rank", "example_id", "policy_uid", "actual_label",
                    F.round("confidence", 6).alias("confidence"))


def prior_drift(spark, sf):
    return risk.prior_drift(predictions(spark, sf))


def model_signal(spark, sf):
    told = F.array_join(F.transform(F.array_sort(F.map_entries("label_distribution")), lambda e: F.concat(
        e["key"], F.lit("="), e["value"])), "|")
    return policy_signal(spark, sf).drop("avg_confidence").withColumns(
        {"score": F.round("score", 2), "label_distribution": told})


def policy_posterior(spark, sf):
    """Posterior risk over the clauses of all policies, labels predicted."""
    clauses = text.explode_clauses(text.with_clauses(
        I.policy_docs(spark, sf), "policy_text", "clauses").drop("policy_text"))
    p = classify.nb_predict(clauses, _model(spark, sf), ["doc_id", "clause_index"], "clause")
    return risk.beta_posterior(p).select("level", F.round("mean", 4).alias("mean"), "evidence_count")


def assess_policies(spark, sf):
    docs = I.policy_docs(spark, sf)
    out = assess.assess_policies(docs, I.ground_truth_controls(spark, sf),
                                 signal=policy_signal(spark, sf))
    return out.withColumn("model_signal", F.round("model_signal", 2))


def tfidf_logreg(spark, sf):
    ex = _split(spark, sf)
    predict = classify.train_classifier(ex.where("split = 'train'"), "logreg_tfidf", max_iter=40)
    held = ex.where("split = 'test'").withColumnRenamed("label", "actual_label")
    p = predict(held, ["example_id", "policy_uid", "actual_label"])
    return evaluate.classification_metrics(evaluate.prediction_table(p))


def class_weights(spark, sf):
    w = classify.class_weights(_split(spark, sf).where("split = 'train'"))
    return w.withColumn("weight", F.round("weight", 6))


def _length_scorer():
    """A scorer of the user's own: longer clauses lean to organization."""
    import pandas as pd

    def score(texts: pd.Series) -> pd.DataFrame:
        n = texts.str.len()
        return pd.DataFrame({"user": 10.0, "system": n % 7, "organization": n / 10.0})
    return score


def scorer_udf(spark, sf):
    ex = I.labeled_examples(spark, sf)
    predict = classify.train_classifier(ex, "by_length", scorers={"by_length": _length_scorer})
    p = predict(ex, ["example_id", "label"])
    return p.select("example_id", "label", "predicted_label",
                    F.round("confidence", 6).alias("confidence"))


QUERIES = {f.__name__: f for f in (
    clause_labels, policy_split, covered_split, moved_split, split_summary, split_with_auxiliary,
    policy_overlap, class_distribution, nb_model, nb_classes, nb_predictions,
    classifier_metrics, per_class_metrics, confusion, probability_diagnostics,
    repaired_probabilities, calibration, calibration_summary, macro_ece, threshold_sweep,
    bootstrap_ci, posterior_risk, posterior_risk_actual, overall_risk, top_contributors,
    prior_drift, model_signal, policy_posterior, assess_policies, tfidf_logreg, class_weights,
    scorer_udf)}

# --- SQL ----------------------------------------------------------------------------

_E = f"WITH {I.EXAMPLES}"
_P = f"WITH {I.PREDICTIONS}"
_HASH = "(('0x' || substr(md5(example_id), 1, 4))::BIGINT)"
_GRID = """grid AS (SELECT a.l AS a, p.l AS p, count(actual_label) AS n
  FROM (VALUES ('user'), ('system'), ('organization')) a(l)
  CROSS JOIN (VALUES ('user'), ('system'), ('organization')) p(l)
  LEFT JOIN predictions ON actual_label = a.l AND predicted_label = p.l __W__ GROUP BY ALL)"""
_CLASS = """cls AS (
  SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM (
    SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM (
      SELECT __S__ l.l AS label, (sum(n) FILTER (WHERE a = l.l AND p = l.l))::DOUBLE AS tp,
        (sum(n) FILTER (WHERE a <> l.l AND p = l.l))::DOUBLE AS fp,
        (sum(n) FILTER (WHERE a = l.l AND p <> l.l))::DOUBLE AS fn
      FROM grid, (VALUES ('user'), ('system'), ('organization')) l(l) GROUP BY ALL)))"""
_VIEWS = """views AS (
  SELECT 'top_label' AS target, CASE predicted_label WHEN 'user' THEN q_user WHEN 'system' THEN q_system
    ELSE q_organization END AS conf, (predicted_label = actual_label)::INT AS hit FROM predictions
  UNION ALL SELECT 'user', q_user, (actual_label = 'user')::INT FROM predictions
  UNION ALL SELECT 'system', q_system, (actual_label = 'system')::INT FROM predictions
  UNION ALL SELECT 'organization', q_organization, (actual_label = 'organization')::INT FROM predictions),
bins AS (SELECT target, least(9, floor(conf * 10))::INT AS bin_index, count(*) AS n, avg(conf) AS c,
  avg(hit) AS h, sum((hit - conf) * (hit - conf)) AS e FROM views GROUP BY ALL)"""
_CAL_SUM = """cal AS (SELECT target, sum(n) AS num_rows, round(sum(n * abs(h - c)) / sum(n), 6) AS ece,
  round(sum(e) / sum(n), 6) AS brier FROM bins GROUP BY target)"""
_PRIORS = "(VALUES ('user', 1.5::DOUBLE, 2.5::DOUBLE), ('system', 1.4::DOUBLE, 2.6::DOUBLE), ('organization', 1.2::DOUBLE, 2.8::DOUBLE)) v(level, pa, pb)"


def _posterior(key, conf):
    return f"""post AS (
  SELECT level, pa, pb, count({key}) AS n, pa + coalesce(sum({conf}), 0) AS a,
    pb + count({key}) - coalesce(sum({conf}), 0) AS b
  FROM {_PRIORS} LEFT JOIN predictions ON {key} = level GROUP BY level, pa, pb)"""


_POST_OUT = """SELECT level, pa AS prior_alpha, pb AS prior_beta, round(a, 6) AS alpha, round(b, 6) AS beta,
  round(a / (a + b), 6) AS mean,
  round(greatest(0, a / (a + b) - 1.959964::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS lower,
  round(least(1, a / (a + b) + 1.959964::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS upper,
  n AS evidence_count FROM post"""

from clausewise.plans import q_assess as A  # noqa: E402

_CLAUSE_PRED = I.sql_predictions("keyed_clauses", "ck", "clause", "cp")
_SIGNAL = f"""{I.POLICY_DOCS}, {I.CLAUSES}, {I.EXAMPLES}, {I.NB},
keyed_clauses AS (SELECT doc_id || '#' || clause_index AS ck, doc_id, clause FROM clauses),
{_CLAUSE_PRED},
clause_pred AS (SELECT doc_id, predicted_label, greatest(pu, ps, po) AS confidence
  FROM keyed_clauses JOIN cp USING (ck)),
signal AS (
  SELECT doc_id, count(DISTINCT predicted_label) AS labels_represented,
    least(3.0::DOUBLE, count(DISTINCT predicted_label)) / 3 * 3
      + least(2.0::DOUBLE, avg(confidence) * 2) AS s FROM clause_pred GROUP BY doc_id)"""

ORACLE = {
    "clause_labels": f"{_E} SELECT * FROM examples",
    "policy_split": f"{_E} SELECT * FROM assigned",
    "covered_split": f"{_E} SELECT * FROM assigned",
    "moved_split": f"""{_E}, first AS (SELECT policy_uid, row_number() OVER (ORDER BY policy_uid) AS r FROM (
  SELECT DISTINCT policy_uid FROM split_examples WHERE split = 'train' AND label = 'user'))
SELECT policy_uid, CASE WHEN r = 1 THEN 'validation' WHEN r = 2 THEN 'test' ELSE split END AS split
FROM assigned LEFT JOIN first USING (policy_uid)""",
    "split_summary": f"""{_E} SELECT split, count(*) AS rows, count(DISTINCT policy_uid) AS unique_policies,
  count(*) FILTER (WHERE label = 'user') AS n_user, count(*) FILTER (WHERE label = 'system') AS n_system,
  count(*) FILTER (WHERE label = 'organization') AS n_organization FROM split_examples GROUP BY split""",
    "split_with_auxiliary": f"""{_E}, u AS (
  SELECT split, label, policy_uid FROM split_examples
  UNION ALL SELECT 'train', label, 'aux::' || policy_uid FROM examples WHERE label <> 'organization')
SELECT split, count(*) AS rows, count(DISTINCT policy_uid) AS unique_policies,
  count(*) FILTER (WHERE label = 'user') AS n_user, count(*) FILTER (WHERE label = 'system') AS n_system,
  count(*) FILTER (WHERE label = 'organization') AS n_organization FROM u GROUP BY split""",
    "policy_overlap": f"""{_E}, leaky AS (SELECT policy_uid, CASE WHEN {_HASH} % 10 < 8 THEN 'train'
  WHEN {_HASH} % 10 = 8 THEN 'validation' ELSE 'test' END AS split FROM examples),
sets AS (SELECT policy_uid, list(DISTINCT split) AS s FROM leaky GROUP BY policy_uid)
SELECT count(*) FILTER (WHERE list_contains(s, 'train') AND list_contains(s, 'validation')) AS train_validation,
  count(*) FILTER (WHERE list_contains(s, 'train') AND list_contains(s, 'test')) AS train_test,
  count(*) FILTER (WHERE list_contains(s, 'validation') AND list_contains(s, 'test')) AS validation_test FROM sets""",
    "class_distribution": f"{_E} SELECT label, count(*) AS rows FROM split_examples GROUP BY label",
    "nb_model": f"{_E}, {I.NB} SELECT * FROM nb_tokens",
    "nb_classes": f"""{_E}, {I.NB} SELECT label, docs, tokens, sum(docs) OVER () AS total_docs,
  (SELECT count(*) FROM nb_tokens) AS vocabulary FROM nb_classes""",
    "nb_predictions": f"""{_P} SELECT example_id, policy_uid, split, actual_label, predicted_label,
  confidence, p_user, p_system, p_organization FROM predictions""",
    "confusion": f"{_P}, {_GRID.replace('__W__', '')} SELECT a AS actual_label, p AS predicted_label, n FROM grid",
    "per_class_metrics": f"""{_P}, {_GRID.replace('__W__', '')}, {_CLASS.replace('__S__', '')}
SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, (tp + fn)::BIGINT AS support FROM cls""",
    "classifier_metrics": f"""{_P}, sp(split) AS (VALUES ('validation'), ('test')),
grid AS (SELECT sp.split, a.l AS a, p.l AS p, count(actual_label) AS n
  FROM sp CROSS JOIN (VALUES ('user'), ('system'), ('organization')) a(l)
  CROSS JOIN (VALUES ('user'), ('system'), ('organization')) p(l)
  LEFT JOIN predictions x ON actual_label = a.l AND predicted_label = p.l AND x.split = sp.split GROUP BY ALL),
{_CLASS.replace('__S__', 'split,')},
acc AS (SELECT split, count(*) AS rows, round(avg((actual_label = predicted_label)::INT), 6) AS accuracy
  FROM predictions GROUP BY split)
SELECT split, rows, accuracy, round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS weighted_f1
FROM cls JOIN acc USING (split) GROUP BY ALL""",
    "probability_diagnostics": f"""{_P} SELECT count(*) FILTER (WHERE {_HASH} % 5 = 0) AS renormalized_rows,
  count(*) FILTER (WHERE {_HASH} % 5 = 1) AS uniform_fallback_rows FROM predictions""",
    "repaired_probabilities": f"""{_P}, h AS (SELECT *, {_HASH} % 4 AS h FROM predictions)
SELECT example_id, {", ".join(f'''round(CASE WHEN h > 1 THEN q_{l} WHEN h = 1 THEN 1.0::DOUBLE / 3
  WHEN predicted_label = '{l}' THEN confidence ELSE (1 - confidence) / 2 END, 8) AS p_{l}'''
    for l in ("user", "system", "organization"))} FROM h""",
    "calibration": f"""{_P}, {_VIEWS} SELECT t.target, b::INT AS bin_index, round(b / 10.0::DOUBLE, 6) AS lower,
  round((b + 1) / 10.0::DOUBLE, 6) AS upper, coalesce(n, 0) AS count, round(coalesce(c, 0), 6) AS avg_confidence,
  round(coalesce(h, 0), 6) AS accuracy, round(coalesce(h - c, 0), 6) AS gap
FROM (VALUES ('top_label'), ('user'), ('system'), ('organization')) t(target) CROSS JOIN range(10) r(b)
LEFT JOIN bins ON bins.target = t.target AND bin_index = b""",
    "calibration_summary": f"{_P}, {_VIEWS}, {_CAL_SUM} SELECT * FROM cal",
    "macro_ece": f"{_P}, {_VIEWS}, {_CAL_SUM} SELECT round(avg(ece), 6) AS macro_ece FROM cal WHERE target <> 'top_label'",
    "threshold_sweep": f"""{_P}, f AS (
  SELECT 'user' AS label, q_user AS s, actual_label = 'user' AS pos FROM predictions
  UNION ALL SELECT 'system', q_system, actual_label = 'system' FROM predictions),
t AS (SELECT label, round(0.1::DOUBLE + 0.05::DOUBLE * i, 4) AS threshold,
    count(*) FILTER (WHERE s >= round(0.1::DOUBLE + 0.05::DOUBLE * i, 4) AND pos) AS tp,
    count(*) FILTER (WHERE s >= round(0.1::DOUBLE + 0.05::DOUBLE * i, 4) AND NOT pos) AS fp,
    count(*) FILTER (WHERE s < round(0.1::DOUBLE + 0.05::DOUBLE * i, 4) AND pos) AS fn,
    count(*) FILTER (WHERE s < round(0.1::DOUBLE + 0.05::DOUBLE * i, 4) AND NOT pos) AS tn
  FROM f, range(18) r(i) GROUP BY ALL),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM t)
SELECT label, threshold, round(pr, 6) AS precision, round(re, 6) AS recall,
  round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1,
  tp + fn AS support_positive, tp + fp AS predicted_positive, tp, fp, fn, tn FROM m""",
    "posterior_risk": f"{_P}, {_posterior('predicted_label', 'confidence')} {_POST_OUT}",
    "posterior_risk_actual": f"{_P}, {_posterior('actual_label', '(actual_label IS NOT NULL)::INT')} {_POST_OUT}",
    "overall_risk": f"""{_P}, {_posterior('predicted_label', 'confidence')}
SELECT round(sum(a / (a + b) * n) / sum(n), 6) AS posterior_mean, sum(n) AS evidence_count FROM post""",
    "top_contributors": f"""{_P} SELECT predicted_label AS level, row_number() OVER w AS rank, example_id,
  policy_uid, actual_label, confidence FROM predictions
WINDOW w AS (PARTITION BY predicted_label ORDER BY confidence DESC, example_id) QUALIFY row_number() OVER w <= 5""",
    "prior_drift": f"""{_P} SELECT level, round(pa / (pa + pb), 6) AS prior_mean,
  round(count(actual_label) / (SELECT count(*) FROM predictions), 6) AS empirical,
  abs(pa / (pa + pb) - count(actual_label) / (SELECT count(*) FROM predictions)) > 0.4::DOUBLE AS drifted
FROM {_PRIORS} LEFT JOIN predictions ON actual_label = level GROUP BY level, pa, pb""",
    "model_signal": f"""WITH {_SIGNAL} SELECT doc_id, round(coalesce(s, 0), 2) AS score, 5.0::DOUBLE AS max_score,
  coalesce(s >= 2.5::DOUBLE, false) AS passed, coalesce(labels_represented, 0) AS labels_represented,
  coalesce(told, '') AS label_distribution
FROM documents LEFT JOIN signal USING (doc_id) LEFT JOIN (
  SELECT doc_id, 'organization=' || count(*) FILTER (WHERE predicted_label = 'organization') || '|system='
    || count(*) FILTER (WHERE predicted_label = 'system') || '|user=' || count(*) FILTER (WHERE predicted_label = 'user') AS told
  FROM clause_pred GROUP BY doc_id) USING (doc_id)""",
    "policy_posterior": f"""WITH {_SIGNAL}
SELECT level, round((pa + sum(confidence)) / (pa + pb + count(*)), 4) AS mean, count(*) AS evidence_count
FROM {_PRIORS} JOIN clause_pred ON predicted_label = level GROUP BY level, pa, pb""",
    "assess_policies": f"""WITH {_SIGNAL}, {I.CHECKS}, {A.VERDICTS.replace('__REG__', 'true')}, {A.SUMMARY}
SELECT doc_id, clauses_analyzed, coalesce(claims_generated, 0) AS claims_generated, pass_count, fail_count,
  total_controls, overall_score, {A._GRADE}, round(coalesce(s, 0), 2) AS model_signal
FROM doc_scores LEFT JOIN (SELECT doc_id, count(*) AS clauses_analyzed FROM clauses GROUP BY doc_id) USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS claims_generated FROM claims GROUP BY doc_id) USING (doc_id)
LEFT JOIN signal USING (doc_id)""",
    "class_weights": f"""{_E} SELECT label, count(*) AS rows,
  round((SELECT count(*) FROM split_examples WHERE split = 'train') / (3 * count(*)), 6) AS weight
FROM split_examples WHERE split = 'train' GROUP BY label""",
    "bootstrap_ci": f"""{_P}, cnt AS MATERIALIZED (SELECT a.l AS a, count(*) FILTER (WHERE predicted_label = 'user') AS c1,
    count(*) FILTER (WHERE predicted_label = 'system') AS c2, count(*) FILTER (WHERE predicted_label = 'organization') AS c3, count(*) AS n
  FROM predictions JOIN (VALUES ('user'), ('system'), ('organization')) a(l) ON actual_label = a.l GROUP BY a.l),
d AS MATERIALIZED (SELECT id, cnt.*, ('0x' || substr(md5('42:' || id || ':' || a || ':user'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u1,
    ('0x' || substr(md5('42:' || id || ':' || a || ':system'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u2 FROM range(1000) r(id), cnt),
k1 AS MATERIALIZED (SELECT a, k, sum(CASE WHEN p <= 0 THEN (k = 0)::INT WHEN p >= 1 THEN (k = n)::INT ELSE exp(lgamma(n + 1) - lgamma(k + 1)
    - lgamma(n - k + 1) + k * ln(p) + (n - k) * ln(1 - p)) END) OVER (PARTITION BY a ORDER BY k) AS cdf
  FROM (SELECT a, n, c1 / n::DOUBLE AS p, unnest(range(n + 1)) AS k FROM cnt)),
x1 AS MATERIALIZED (SELECT d.*, (SELECT least(count(*), d.n) FROM k1 WHERE k1.a = d.a AND cdf < d.u1) AS x1 FROM d),
m2 AS (SELECT DISTINCT a, n - x1 AS m, c2, c3 FROM x1),
k2 AS MATERIALIZED (SELECT a, m, k, sum(CASE WHEN p <= 0 THEN (k = 0)::INT WHEN p >= 1 THEN (k = m)::INT ELSE exp(lgamma(m + 1) - lgamma(k + 1)
    - lgamma(m - k + 1) + k * ln(p) + (m - k) * ln(1 - p)) END) OVER (PARTITION BY a, m ORDER BY k) AS cdf
  FROM (SELECT a, m, CASE WHEN c2 + c3 > 0 THEN c2 / (c2 + c3)::DOUBLE ELSE 0 END AS p, unnest(range(m + 1)) AS k FROM m2)),
x2 AS MATERIALIZED (SELECT x.id, x.a, x.x1, any_value(n) - x1 AS m, count(k2.k) AS x2 FROM x1 x LEFT JOIN k2
    ON k2.a = x.a AND k2.m = x.n - x.x1 AND k2.cdf < x.u2 GROUP BY x.id, x.a, x.x1),
g AS MATERIALIZED (SELECT id, a, x1 AS p1, least(x2, m) AS p2, m - least(x2, m) AS p3 FROM x2
  UNION ALL SELECT -1, a, c1, c2, c3 FROM cnt),
w AS (SELECT id, unnest(['user', 'system', 'organization']) AS l, a, unnest([p1, p2, p3]) AS n FROM g),
t AS (SELECT id, l.l, sum(n) FILTER (WHERE a = l.l) AS support, sum(n) FILTER (WHERE w.l = l.l) AS called,
    sum(n) FILTER (WHERE a = l.l AND w.l = l.l) AS tp FROM w, (VALUES ('user'), ('system'), ('organization')) l(l) GROUP BY id, l.l),
f AS (SELECT *, CASE WHEN support + called > 0 THEN 2 * tp / (support + called)::DOUBLE ELSE 0 END AS f1 FROM t),
v AS (SELECT id, 'f1_' || l AS metric, f1 AS value FROM f
  UNION ALL SELECT id, 'accuracy', sum(tp) / sum(support)::DOUBLE FROM f GROUP BY id
  UNION ALL SELECT id, 'macro_f1', avg(f1) FROM f GROUP BY id
  UNION ALL SELECT id, 'weighted_f1', sum(f1 * support) / sum(support)::DOUBLE FROM f GROUP BY id)
SELECT metric, round(max(value) FILTER (WHERE id < 0), 6) AS baseline, round(avg(value) FILTER (WHERE id >= 0), 6) AS mean,
  round(quantile_cont(value, 0.025) FILTER (WHERE id >= 0), 6) AS lower, round(quantile_cont(value, 0.975) FILTER (WHERE id >= 0), 6) AS upper
FROM v GROUP BY metric""",
    "scorer_udf": f"""{_E}, s AS (SELECT example_id, label, 10.0::DOUBLE AS u, (length(text) % 7)::DOUBLE AS y,
  length(text) / 10.0::DOUBLE AS o FROM examples)
SELECT example_id, label, CASE WHEN u >= y AND u >= o THEN 'user' WHEN y >= o THEN 'system' ELSE 'organization' END AS predicted_label,
  round(greatest(u, y, o) / (u + y + o), 6) AS confidence FROM s""",
}
