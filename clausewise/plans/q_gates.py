"""Queries over finished runs and extracted files: gates, rankings, reconciliations."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise.functions import scoring
from clausewise.operators import evaluate, gates, risk, splits
from clausewise.operators.ordering import guard_unions, materialize
from clausewise.plans import inputs as I
from clausewise.plans import q_classify as C
from clausewise.plans import q_structure as S


def _run(spark, sf):
    ex = C._split(spark, sf)
    p = C.predictions(spark, sf)
    record = F.create_map(
        F.lit("example_id"), F.col("example_id"), F.lit("policy_uid"), F.col("policy_uid"),
        F.lit("actual_label"), F.col("actual_label"), F.lit("predicted_label"),
        F.col("predicted_label"), F.lit("confidence"), F.col("confidence").cast("string"))
    h = F.conv(F.substring(F.md5("example_id"), 1, 4), 16, 10).cast("int")
    # Some rows lose a key or get an unknown label, so the schema check has work.
    record = F.map_filter(record, lambda k, v: ~((h % 101 == 0) & (k == "confidence")))
    record = F.transform_values(record, lambda k, v: F.when(
        (h % 97 == 0) & (k == "predicted_label"), "elsewhere").otherwise(v))
    hurt = p.withColumn("probabilities", F.when(h % 89 > 0, F.transform_values(
        "probabilities", lambda k, v: F.when(h % 83 == 0, v * 1.5).otherwise(v))))
    manifest = ex.agg(F.concat(F.lit("mixed::"), F.min("source")).alias("source"),
                      F.lit("2026-01-01T00:00:00Z").alias("executed_at"),
                      F.lit("transformer").alias("model_type"),
                      F.lit("bayesian_posterior").alias("primary_metric_surface"))
    posterior = risk.beta_posterior(p)
    manifest = manifest.withColumn("bayesian_primary_score", risk.overall_risk(posterior).select(
        "posterior_mean").scalar())
    files = ex.select(F.concat(F.col("split"), F.lit("_predictions")).alias("key")).transform(guard_unions).unionByName(
        ex.limit(1).select(F.explode(F.array(F.lit("dataset_manifest"), F.lit("run_manifest")))
                           .alias("key")))
    return {
        "manifest": manifest, "overlap": splits.policy_overlap(ex),
        "metrics": evaluate.classification_metrics(p, group=["split"]),
        "expected": splits.split_summary(ex).select("split", "rows"),
        "predictions": hurt, "records": p.select(record.alias("record")),
        "distribution": splits.class_distribution(ex), "files": files,
        "calibration": evaluate.calibration_summary(evaluate.calibration(p)),
        "sweep": evaluate.threshold_sweep(p), "posterior": posterior,
        "contributors": risk.top_contributors(p),
    }


def quality_gates(spark, sf):
    checks = gates.run_validation(_run(spark, sf), require_bayesian=True)
    return checks.where("name <> 'calibration_ece_target'").select("name", "required", "passed", "details")


def interval_check(spark, sf):
    """Bootstrap intervals, and the same with their ends swapped."""
    b = materialize(C.bootstrap_ci(spark, sf))
    swapped = b.withColumns({"lower": F.col("upper"), "upper": F.col("lower")})
    return gates.bootstrap_interval_check(guard_unions(b).unionByName(swapped))


def gate_verdict(spark, sf):
    return gates.overall(gates.run_validation(_run(spark, sf)))


def acceptance_gates(spark, sf):
    a = gates.acceptance(_run(spark, sf))
    return a.select("name", "required", "passed")


def runs(spark, sf):
    """Held-out policies as runs: their metrics, one baseline, some metrics missing."""
    m = evaluate.classification_metrics(C.predictions(spark, sf), group=["policy_uid"])
    first = m.agg(F.min("policy_uid").alias("p"))
    n = F.conv(F.substring(F.md5("policy_uid"), 1, 4), 16, 10).cast("int")
    miss = lambda c, k: F.when(n % k > 0, F.col(c))
    return m.select(
        F.col("policy_uid").alias("name"), F.col("policy_uid").alias("seq"),
        (F.col("policy_uid") == first.scalar()).alias("is_baseline"),
        miss("macro_f1", 7).alias("test_macro_f1"), miss("accuracy", 5).alias("test_accuracy"),
        F.col("macro_recall").alias("bayesian_primary_score"),
        miss("macro_precision", 4).alias("calibration_test_ece"),
        F.concat(F.lit("type-"), n % 3).alias("model_type"),
        F.concat(F.lit("2026-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))
        .alias("executed_at"))


def leaderboard(spark, sf):
    return gates.leaderboard(runs(spark, sf)).select("name", "rank", "test_macro_f1", "test_accuracy")


def baseline_deltas(spark, sf):
    return gates.baseline_deltas(materialize(runs(spark, sf)))


def registry_rank(spark, sf):
    return gates.registry_rank(runs(spark, sf)).select("name", "rank", "test_macro_f1", "test_accuracy")


def run_trend(spark, sf):
    return gates.run_trend(runs(spark, sf)).select("name", "model_type", "executed_at", "test_macro_f1", "change")


def metrics_shape(spark, sf):
    """Metric cells of the runs' labels; those a split lacks are reported."""
    p = C.predictions(spark, sf)
    cells = p.select("split", F.explode(F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.lit("").alias("label")),
        F.struct(F.lit("macro_f1").alias("metric"), F.lit("").alias("label")),
        F.struct(F.lit("per_class").alias("metric"), F.col("actual_label").alias("label")),
        F.struct(F.lit("confusion").alias("metric"), F.col("predicted_label").alias("label"))))
        .alias("c")).select("split", "c.*")
    return gates.metrics_shape_check(cells)


def band_eval(spark, sf):
    """Order priorities as free-form compliance labels against the status as the band."""
    o = I.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    label = I.pick(("Non-Compliant", "compliant", "PARTIAL_match", "low risk", "High", "violation?",
                    "positive", "unclear", " "), k)
    rows = o.select(label.alias("label"), (k % 100 / 100).alias("score"),
                    I.pick(("low", "High", "medium"), F.col("o_custkey")).alias("band"),
                    F.col("o_orderpriority").alias("model"))
    return evaluate.band_accuracy(rows, group=["model"])


def band_labels(spark, sf):
    o = I.table(spark, sf, "orders")
    label = I.pick(("Non-Compliant", "compliant", "PARTIAL_match", "low risk", "High", "violation?",
                    "positive", "unclear", " "), F.col("o_orderkey"))
    return o.select(label.alias("label")).groupBy(
        "label", scoring.normalize_band("label").alias("band"),
        scoring.binary_band("label").alias("binary")).agg(F.count(F.lit(1)).alias("rows"))


def _controls(spark, sf):
    """Parts as controls again, with repeated ids, plus chunks of their texts."""
    c = I.part_controls(spark, sf).where(F.trim("normalized_id") != "")
    k = F.col("partkey")
    native = F.when(F.col("regulation") == "GDPR", F.concat(F.lit("Article "), (k % 400).cast("string"))).when(
        F.col("regulation") == "NISTPF", F.concat(F.lit("ID.IM-P"), k.cast("string"))).otherwise(
        F.concat(F.lit("4."), k.cast("string")))
    c = c.select("regulation", native.alias("native_id"),
                 F.concat_ws("::", F.lower("regulation"), native).alias("normalized_id"),
                 "text", k.alias("seq"))
    return c.withColumn("record_id", F.sha1(F.concat_ws(":", "regulation", "native_id", "text")))


def _chunks(spark, sf):
    c = _controls(spark, sf)
    k = F.col("seq")
    meta = F.create_map(F.lit("regulation"), F.when(k % 53 == 0, "other").otherwise(F.lower("regulation")))
    return c.select(
        F.sha1(F.concat_ws(":", "normalized_id", F.lit("0"), "text")).alias("chunk_id"), "regulation",
        F.when(k % 41 == 0, F.lit("gone::1")).otherwise(F.col("normalized_id")).alias("control_id"),
        meta.alias("metadata"))


def _expected(spark, sf):
    c = _controls(spark, sf)
    return c.where("regulation <> 'GDPR'").select(
        "regulation", F.when(F.col("seq") % 61 == 0, F.concat("native_id", F.lit("0"))).otherwise(
            F.col("native_id")).alias("native_id"))


def alignment(spark, sf):
    return gates.alignment_check(_controls(spark, sf), _chunks(spark, sf), _expected(spark, sf))


def id_differences(spark, sf):
    return gates.id_differences(_controls(spark, sf).where("regulation <> 'GDPR'"), _expected(spark, sf))


def id_algebra(spark, sf):
    c = _chunks(spark, sf).select(F.col("control_id").alias("normalized_id"))
    return gates.id_algebra(_controls(spark, sf), c, "normalized_id")


def dangling_chunks(spark, sf):
    return gates.dangling_chunks(_chunks(spark, sf), _controls(spark, sf)).select("chunk_id", "control_id")


def source_matches(spark, sf):
    """Every document, and every benchmark passage, looked for whole in all texts of a source
    that its id names."""
    d = I.table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), "text")
    b = I.table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), "text")
    c = d.transform(guard_unions).unionByName(b).select(
        F.concat(F.lit("src"), F.col("seq") % 20).alias("regulation"), "seq", "text")
    sources = I.table(spark, sf, "documents").select(F.col("source").alias("regulation"), F.col("text").alias("source_text"))
    return gates.source_match_rate(c, sources)


def compare_runs(spark, sf):
    n = F.conv(F.substring(F.md5("name"), 1, 4), 16, 10).cast("int")
    r = runs(spark, sf)
    return gates.compare_runs(r.withColumn("artifact_dir", F.concat(F.lit("runs/a/"), "name")).withColumn(
        "validation_passed", F.when(n % 6 > 0, n % 2 == 0)))


def count_reconciliation(spark, sf):
    """Chunks per source as listed (with an error for one) and as counted."""
    d = I.table(spark, sf, "documents")
    n = F.substring("source", 4, 3).cast("int")
    listed = d.groupBy("source").agg((F.count(F.lit(1)) + F.max(F.when(n % 7 == 0, 1).otherwise(0)))
                                     .alias("expected"))
    return gates.count_reconciliation(listed, d.select("source"), "source")


def smallest_policy_per_label(spark, sf):
    ex = C._split(spark, sf)
    return ex.where("split = 'train'").groupBy("label").agg(F.min("policy_uid").alias("policy_uid"))


def policies_per_label(spark, sf):
    got = splits.sorted_distinct(I.labeled_examples(spark, sf), ["label"], "source", "sources")
    return got.withColumn("sources", F.concat_ws("|", "sources"))


QUERIES = {f.__name__: f for f in (
    quality_gates, interval_check, gate_verdict, acceptance_gates, leaderboard, baseline_deltas, compare_runs, registry_rank,
    run_trend, metrics_shape, band_eval, band_labels, alignment, id_differences, id_algebra,
    dangling_chunks, source_matches, count_reconciliation, smallest_policy_per_label,
    policies_per_label)}

# --- SQL ----------------------------------------------------------------------------

_H = "(('0x' || substr(md5(example_id), 1, 4))::BIGINT)"
_P = f"WITH {I.PREDICTIONS}"
_CHK = f"""{_P}, h AS (SELECT *, {_H} AS h FROM predictions),
dist AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = 'user') AS u, count(*) FILTER (WHERE label = 'system') AS s,
  count(*) FILTER (WHERE label = 'organization') AS o FROM split_examples),
bad_ids AS (SELECT example_id FROM h WHERE h % 101 = 0 ORDER BY example_id LIMIT 10),
checks(name, required, passed, details) AS (
  SELECT 'expected_artifacts_present', true, false, '{{"missing":["bayesian_test","classifier_metrics"]}}'
  UNION ALL SELECT 'policy_leakage_protection', true, true, '{{"train_validation":0,"train_test":0,"validation_test":0}}'
  UNION ALL SELECT 'core_metrics_in_range', true, true, '{{"out_of_range":0,"splits":2}}'
  UNION ALL SELECT 'prediction_counts_match_manifest', true, true, '{{"mismatched_splits":0,"rows":' || count(*) || '}}' FROM predictions
  UNION ALL SELECT 'prediction_row_schema', true, count(*) FILTER (WHERE h % 101 = 0 OR h % 97 = 0) = 0,
    '{{"rows_checked":' || count(*) || ',"missing_field_rows":[' || coalesce((SELECT string_agg('"' || example_id || '"', ',' ORDER BY example_id) FROM bad_ids), '')
    || '],"invalid_label_rows":' || count(*) FILTER (WHERE h % 97 = 0 AND h % 101 <> 0) || '}}' FROM h
  UNION ALL SELECT 'prediction_probability_mass', false, count(*) FILTER (WHERE h % 83 = 0 AND h % 89 > 0) = 0,
    '{{"rows_with_probabilities":' || count(*) FILTER (WHERE h % 89 > 0) || ',"invalid_rows":'
    || sum(CASE WHEN h % 83 = 0 AND h % 89 > 0 THEN (p_user * 1.5 > 1)::INT + (p_system * 1.5 > 1)::INT + (p_organization * 1.5 > 1)::INT
      + (abs(CASE WHEN p_user * 1.5 > 1 THEN 0 ELSE p_user * 1.5 END + CASE WHEN p_system * 1.5 > 1 THEN 0 ELSE p_system * 1.5 END
        + CASE WHEN p_organization * 1.5 > 1 THEN 0 ELSE p_organization * 1.5 END - 1) > 0.01)::INT ELSE 0 END)
    || ',"rows_without_probabilities":' || count(*) FILTER (WHERE h % 89 = 0) || '}}' FROM h
  UNION ALL SELECT 'manifest_timestamp_utc', false, true, '{{"executed_at":"2026-01-01T00:00:00Z"}}'
  UNION ALL SELECT 'threshold_sweep_valid', false, true, '{{"points_checked":36,"invalid_points":0}}'
  UNION ALL SELECT 'bayesian_evidence_available', true, true, '{{"total_evidence":' || count(*) || ',"contributors":'
    || (SELECT sum(least(n, 5)) FROM (SELECT count(*) AS n FROM predictions GROUP BY predicted_label)) || '}}' FROM predictions
  UNION ALL SELECT 'corpus_source_advisory', false, true, '{{"source":"mixed::' || min(source) || '"}}' FROM examples
  UNION ALL SELECT 'class_balance_distribution', false, least(u, s, o) / total >= 0.05, '{{"total":' || total || ',"user":' || u
    || ',"system":' || s || ',"organization":' || o || '}}' FROM dist)"""
_RUNS = f"""{_P}, lab(l) AS (VALUES ('user'), ('system'), ('organization')),
pol AS (SELECT policy_uid, count(*) AS rows, round(avg((actual_label = predicted_label)::INT), 6) AS accuracy FROM predictions GROUP BY 1),
pr AS (SELECT policy_uid, l, sum((actual_label = l AND predicted_label = l)::INT) AS tp, sum((actual_label <> l AND predicted_label = l)::INT) AS fp,
  sum((actual_label = l AND predicted_label <> l)::INT) AS fn FROM predictions, lab GROUP BY ALL),
pm AS (SELECT policy_uid, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM pr),
mm AS (SELECT policy_uid, round(avg(p), 6) AS mp, round(avg(r), 6) AS mr, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS mf
  FROM pm GROUP BY 1),
runs AS (SELECT policy_uid AS name, policy_uid = (SELECT min(policy_uid) FROM pol) AS is_baseline,
  CASE WHEN n % 7 > 0 THEN mf END AS test_macro_f1, CASE WHEN n % 5 > 0 THEN accuracy END AS test_accuracy,
  mr AS bayesian_primary_score, CASE WHEN n % 4 > 0 THEN mp END AS calibration_test_ece, 'type-' || (n % 3) AS model_type,
  '2026-01-' || lpad((n % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS executed_at
  FROM (SELECT *, ('0x' || substr(md5(policy_uid), 1, 4))::BIGINT AS n FROM pol JOIN mm USING (policy_uid)))"""
_LABELS = "['Non-Compliant', 'compliant', 'PARTIAL_match', 'low risk', 'High', 'violation?', 'positive', 'unclear', ' ']"
_BANDS = "['low', 'high', 'medium', 'low', 'high', 'low', 'high', NULL, NULL]"
_CTL = f"""WITH {I.PART_CONTROLS}, ctl0 AS (SELECT regulation, text, partkey AS seq,
  CASE regulation WHEN 'GDPR' THEN 'Article ' || (partkey % 400) WHEN 'NISTPF' THEN 'ID.IM-P' || partkey ELSE '4.' || partkey END AS native_id
  FROM part_controls WHERE trim(normalized_id) <> ''),
ctl AS (SELECT *, lower(regulation) || '::' || native_id AS normalized_id, sha1(regulation || ':' || native_id || ':' || text) AS record_id FROM ctl0),
chk AS (SELECT sha1(normalized_id || ':0:' || text) AS chunk_id, regulation, CASE WHEN seq % 41 = 0 THEN 'gone::1' ELSE normalized_id END AS control_id,
  seq % 53 = 0 AS off FROM ctl),
expct AS (SELECT DISTINCT regulation, CASE WHEN seq % 61 = 0 THEN native_id || '0' ELSE native_id END AS native_id FROM ctl WHERE regulation <> 'GDPR'),
have AS (SELECT DISTINCT regulation, native_id FROM ctl WHERE regulation <> 'GDPR'),
diff AS (SELECT regulation, native_id, 'missing' AS side FROM (SELECT * FROM expct EXCEPT SELECT * FROM have)
  UNION ALL SELECT regulation, native_id, 'extra' FROM (SELECT * FROM have EXCEPT SELECT * FROM expct))"""

ORACLE = {
    "quality_gates": f"{_CHK} SELECT * FROM checks",
    "interval_check": f"""WITH b AS ({C.ORACLE["bootstrap_ci"]})
SELECT 'bootstrap_intervals_valid' AS name, false AS required, count(*) FILTER (WHERE upper > lower) = 0 AS passed,
  '{{"metrics_checked":' || (2 * count(*)) || ',"invalid_intervals":' || count(*) FILTER (WHERE upper > lower) || '}}' AS details FROM b""",
    "gate_verdict": f"""{_CHK}, {C._VIEWS}, {C._CAL_SUM}, every_check AS (
  SELECT name, required AND name <> 'bayesian_evidence_available' AS required, passed FROM checks
  UNION ALL SELECT 'calibration_ece_target', false, ece <= 0.2 FROM cal WHERE target = 'top_label')
SELECT bool_and(passed) FILTER (WHERE required) AS passed, count(*) AS checks,
  count(*) FILTER (WHERE required AND NOT passed) AS failed_required,
  count(*) FILTER (WHERE NOT required AND NOT passed) AS failed_advisory FROM every_check""",
    "acceptance_gates": f"""{_P} SELECT name, name <> 'corpus_source_advisory' AS required,
  CASE WHEN name = 'expected_artifacts_present' THEN (SELECT count(DISTINCT split) FROM predictions) = 9
    WHEN name = 'corpus_source_advisory' THEN (SELECT min(source) IS NOT NULL FROM examples)
    ELSE (SELECT count(*) > 0 AND min(confidence) >= 0 AND max(confidence) <= 1 FROM predictions) END AS passed
FROM (VALUES ('policy_leakage_protection'), ('classifier_metrics_in_range'), ('model_type_required'), ('corpus_source_advisory'),
  ('bayesian_primary_surface'), ('bayesian_primary_score_in_range'), ('bayesian_outputs_have_evidence'), ('expected_artifacts_present')) c(name)""",
    "leaderboard": f"""{_RUNS} SELECT name, row_number() OVER (ORDER BY coalesce(test_macro_f1, -1) DESC,
  coalesce(test_accuracy, -1) DESC, name) AS rank, test_macro_f1, test_accuracy FROM runs""",
    "baseline_deltas": f"""{_RUNS} SELECT r.name, round(r.test_macro_f1 - b.test_macro_f1, 6) AS delta_test_macro_f1,
  round(r.test_accuracy - b.test_accuracy, 6) AS delta_test_accuracy,
  round(r.bayesian_primary_score - b.bayesian_primary_score, 6) AS delta_bayesian_primary_score,
  round(r.calibration_test_ece - b.calibration_test_ece, 6) AS delta_calibration_test_ece
FROM runs r, (SELECT * FROM runs WHERE is_baseline) b WHERE NOT r.is_baseline""",
    "registry_rank": f"""{_RUNS} SELECT name, test_macro_f1, test_accuracy, row_number() OVER (
  ORDER BY test_macro_f1 IS NULL OR test_accuracy IS NULL, coalesce(test_macro_f1, -1) DESC, coalesce(test_accuracy, -1) DESC, name)::INT AS rank
FROM runs""",
    "run_trend": f"""{_RUNS} SELECT name, model_type, executed_at, test_macro_f1,
  round(test_macro_f1 - lag(test_macro_f1) OVER (PARTITION BY model_type ORDER BY executed_at, name), 6) AS change FROM runs""",
    "metrics_shape": f"""{_P}, sp(split) AS (VALUES ('validation'), ('test')), lab(l) AS (VALUES ('user'), ('system'), ('organization'))
SELECT split, metric, '' AS label FROM sp, (VALUES ('macro_precision'), ('macro_recall')) m(metric)
UNION ALL SELECT split, 'per_class', l FROM sp, lab WHERE (split, l) NOT IN (SELECT (split, actual_label) FROM predictions)
UNION ALL SELECT split, 'confusion', l FROM sp, lab WHERE (split, l) NOT IN (SELECT (split, predicted_label) FROM predictions)""",
    "band_labels": f"""SELECT {_LABELS}[o_orderkey % 9 + 1] AS label, {_BANDS}[o_orderkey % 9 + 1] AS band,
  (['non_compliant', 'compliant', 'compliant', 'non_compliant', 'compliant', 'non_compliant', 'compliant', NULL, NULL])[o_orderkey % 9 + 1] AS binary,
  count(*) AS rows FROM orders GROUP BY ALL""",
    "band_eval": f"""WITH b AS (SELECT o_orderpriority AS model, (o_orderkey % 100) / 100.0::DOUBLE AS score, {_BANDS}[o_orderkey % 9 + 1] AS pred,
  (['low', 'high', 'medium'])[o_custkey % 3 + 1] AS band FROM orders)
SELECT model, round(avg(score), 6) AS average_confidence,
  round(count(*) FILTER (WHERE pred = band) / count(pred), 6) AS tri_label_accuracy,
  round(count(*) FILTER (WHERE (pred = 'low') = (band = 'low')) / count(pred), 6) AS binary_accuracy,
  count(pred) AS tri_samples, count(pred) AS binary_samples FROM b GROUP BY model""",
    "alignment": f"""{_CTL}, a AS (SELECT regulation, count(*) - count(DISTINCT record_id) AS duplicate_record_id,
  count(*) - count(DISTINCT normalized_id) AS duplicate_normalized_id FROM ctl GROUP BY 1),
k AS (SELECT regulation, count(*) - count(DISTINCT chunk_id) AS duplicate_chunk_id,
  count(*) FILTER (WHERE control_id = 'gone::1') AS missing_chunk_refs, count(*) FILTER (WHERE off) AS metadata_mismatch FROM chk GROUP BY 1),
d AS (SELECT regulation, count(*) FILTER (WHERE side = 'missing') AS missing_ids, count(*) FILTER (WHERE side = 'extra') AS extra_ids FROM diff GROUP BY 1)
SELECT regulation, duplicate_record_id, duplicate_normalized_id, duplicate_chunk_id, missing_chunk_refs, metadata_mismatch,
  true AS id_pattern_ok, coalesce(missing_ids, 0) AS missing_ids, coalesce(extra_ids, 0) AS extra_ids,
  duplicate_record_id + duplicate_chunk_id + missing_chunk_refs + metadata_mismatch + coalesce(missing_ids, 0) + coalesce(extra_ids, 0) = 0 AS ok
FROM a JOIN k USING (regulation) LEFT JOIN d USING (regulation)""",
    "id_differences": f"{_CTL} SELECT * FROM diff",
    "id_algebra": f"""{_CTL} SELECT (SELECT count(*) FROM (SELECT normalized_id FROM ctl INTERSECT SELECT control_id FROM chk)) AS both,
  (SELECT count(*) FROM (SELECT normalized_id FROM ctl EXCEPT SELECT control_id FROM chk)) AS only_left,
  (SELECT count(*) FROM (SELECT control_id FROM chk EXCEPT SELECT normalized_id FROM ctl)) AS only_right""",
    "dangling_chunks": f"{_CTL} SELECT chunk_id, control_id FROM chk WHERE control_id NOT IN (SELECT normalized_id FROM ctl)",
    "source_matches": f"""WITH c AS MATERIALIZED (SELECT 'src' || (doc_id % 20) AS regulation, {I.sql_norm('text')} AS probe FROM documents
  UNION ALL SELECT 'src' || (item_id % 20), {I.sql_norm('text')} FROM benchmark),
w AS MATERIALIZED (SELECT DISTINCT source AS regulation, {I.sql_norm('text')} AS whole FROM documents),
p AS MATERIALIZED (SELECT regulation, probe, count(*) AS n FROM c GROUP BY ALL)
SELECT regulation, sum(n)::BIGINT AS sampled, coalesce(sum(n) FILTER (WHERE probe <> '' AND EXISTS (
  SELECT 1 FROM w WHERE w.regulation = p.regulation AND contains(w.whole, p.probe))), 0)::BIGINT AS source_matches FROM p GROUP BY regulation""",
    "compare_runs": f"""{_RUNS}, n AS (SELECT *, ('0x' || substr(md5(name), 1, 4))::BIGINT AS n FROM runs), b AS (SELECT * FROM runs WHERE is_baseline)
SELECT 'runs/a/' || n.name AS artifact_dir, n.name, n.is_baseline, CASE WHEN n.n % 6 > 0 THEN n.n % 2 = 0 ELSE false END AS validation_passed,
  row_number() OVER (ORDER BY coalesce(n.test_macro_f1, -1) DESC, coalesce(n.test_accuracy, -1) DESC, NOT n.is_baseline, n.name)::INT AS rank,
  n.test_macro_f1, n.test_accuracy, n.bayesian_primary_score, n.calibration_test_ece, {", ".join(
      f"CASE WHEN NOT n.is_baseline THEN round(n.{m} - b.{m}, 6) END AS delta_{m}" for m in gates._RUN_METRICS)} FROM n, b""",
    "count_reconciliation": """SELECT source, count(*) + (substr(source, 4)::INT % 7 = 0)::INT AS expected, count(*) AS actual,
  substr(source, 4)::INT % 7 <> 0 AS ok FROM documents GROUP BY source""",
    "smallest_policy_per_label": f"""WITH {I.EXAMPLES} SELECT label, min(policy_uid) AS policy_uid FROM split_examples
WHERE split = 'train' GROUP BY label""",
    "policies_per_label": f"""WITH {I.EXAMPLES} SELECT label, array_to_string(list_sort(list(DISTINCT source)), '|') AS sources
FROM examples GROUP BY label""",
}
