"""Queries over controls, observations and incident tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.operators import metrics, ordering, public
from clausewise.plans import inputs as I


def _scored(spark, sf):
    return metrics.score_observations(I.observations(spark, sf), I.observation_specs(spark, sf))


def scenario_composite(spark, sf):
    return metrics.scenario_composite(metrics.level_summary(_scored(spark, sf)))


def level_summary(spark, sf):
    return metrics.level_summary(_scored(spark, sf))


def metric_scores(spark, sf):
    return _scored(spark, sf).drop("_adjusted")


def risk_band_counts(spark, sf):
    return metrics.risk_band_counts(_scored(spark, sf))


def metric_specs(spark, sf):
    s = metrics.build_metric_specs(I.part_controls(spark, sf))
    return s.select("metric_id", "control_id", "regulation", "level", "metric_name", "formula",
                    F.concat_ws("|", "required_fields").alias("required_fields"),
                    F.round("confidence_weight", 6).alias("confidence_weight"), "status")


def metric_coverage(spark, sf):
    c = I.part_controls(spark, sf)
    # Controls of one regulation have no specs here, so that ids are missing.
    return metrics.metric_coverage(c, metrics.build_metric_specs(c).where("regulation <> 'NISTPF'"))


def public_mapping(spark, sf):
    rows = ordering.row_index(I.incident_rows(spark, sf), "order_key", "source_row_index")
    m = public.map_public_rows(rows, "orders")
    return m.withColumn("dq_missing_required_fields",
                        F.concat_ws("|", "dq_missing_required_fields"))


def public_summary(spark, sf):
    rows = I.incident_rows(spark, sf).withColumn("source_row_index", F.col("order_key"))
    return public.public_mapping_summary(public.map_public_rows(rows, "orders"))


def claim_links(spark, sf):
    o = I.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    claims = o.select(
        F.concat(F.lit("claim-"), k).alias("claim_id"),
        I.pick(("normal", "stressed", "adversarial"), F.col("o_custkey")).alias("scenario"),
        # Two thirds of the parts have claims of their own.
        F.concat(F.lit("metric-"), (k % 20000) * 3 + k % 2).alias("metric_id"),
        I.pick(("user", "system"), k).alias("level"),
        I.pick(("compliant", "partial", "noncompliant"), I.div(k, 7)).alias("compliance_status"))
    obs = I.observations(spark, sf).select(
        "observation_id", "scenario", "metric_id", "level",
        (F.col("failure_count") / F.col("total_checks")).alias("base_failure_rate"))
    linked = metrics.link_claims(obs, claims)
    return linked.withColumn("base_failure_rate", F.round("base_failure_rate", 6)).withColumn(
        "adjusted_rate", F.round("adjusted_rate", 6))


QUERIES = {
    "scenario_composite": scenario_composite, "level_summary": level_summary,
    "metric_scores": metric_scores, "risk_band_counts": risk_band_counts,
    "metric_specs": metric_specs, "metric_coverage": metric_coverage,
    "public_mapping": public_mapping, "public_summary": public_summary,
    "claim_links": claim_links,
}

_WITH_SCORED = f"WITH {I.PART_CONTROLS}, {I.OBSERVATIONS}, {I.SCORED}"


def _words(col, words):
    return "(" + " OR ".join(f"contains({col}, {I.quote(w)})" for w in words) + ")"


def _case(mapping):
    return "CASE level " + " ".join(
        f"WHEN {I.quote(k)} THEN {I.quote(v)}" for k, v in mapping.items()) + " END"


_SPECS = f"""WITH {I.PART_CONTROLS}, typed AS (
  SELECT trim(normalized_id) AS control_id, *, lower(title || ' ' || text) AS bag
  FROM part_controls WHERE trim(normalized_id) <> ''),
leveled AS (SELECT *, CASE WHEN {_words('bag', lexicon.USER_LEVEL_WORDS)} THEN 'user'
  WHEN {_words('bag', lexicon.SYSTEM_LEVEL_WORDS)} THEN 'system' ELSE 'organization' END AS level
  FROM typed)"""

ORACLE = {
    "scenario_composite": _WITH_SCORED + f"""
SELECT scenario, 'weighted_sum_v1' AS composite_method, round(s / t, 6) AS compliance_score,
  round(1.0::DOUBLE - s / t, 6) AS risk_score, {I.sql_band('1.0::DOUBLE - s / t')} AS risk_band
FROM (SELECT scenario, sum(compliance_score * w) AS s, sum(w) AS t FROM levels
  JOIN (VALUES ('user', 0.4::DOUBLE), ('system', 0.35::DOUBLE), ('organization', 0.25::DOUBLE)) v(level, w)
  USING (level) GROUP BY scenario)""",
    "level_summary": _WITH_SCORED + f"""
SELECT scenario, level, sample_size, compliance_score, round(1.0::DOUBLE - m, 6) AS risk_score,
  {I.sql_band('1.0::DOUBLE - m')} AS risk_band FROM levels""",
    "metric_scores": _WITH_SCORED + f"""
SELECT scenario, level, entity_id, metric_id, control_id, total_checks::INT AS total_checks,
  failure_count::INT AS failure_count, missing_fields::INT AS missing_fields,
  round(raw_, 6) AS raw_score, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, raw_)), 6) AS normalized_score,
  round(adjusted, 6) AS confidence_adjusted_score, round(risk, 6) AS risk_score,
  {I.sql_band('risk')} AS risk_band FROM scored""",
    "risk_band_counts": _WITH_SCORED + f"""
SELECT {I.sql_band('risk')} AS risk_band, count(*) AS rows FROM scored GROUP BY 1""",
    "metric_specs": _SPECS + f"""
SELECT 'metric::' || substr(sha1(control_id || '|' || level), 1, 16) AS metric_id, control_id,
  regulation, level, concat_ws(' | ', regulation, nullif(trim(native_id), ''), nullif(trim(title), '')) AS metric_name,
  {_case(lexicon.LEVEL_FORMULAS)} AS formula,
  {_case({k: '|'.join(v) for k, v in lexicon.LEVEL_REQUIRED_FIELDS.items()})} AS required_fields,
  round(least(1.0::DOUBLE, greatest(0.1::DOUBLE, parser_confidence)), 6) AS confidence_weight,
  'active' AS status FROM leveled""",
    "metric_coverage": _SPECS + """
SELECT (SELECT count(DISTINCT control_id) FROM leveled) AS total_controls,
  (SELECT count(DISTINCT control_id) FROM leveled WHERE control_id NOT IN
    (SELECT control_id FROM leveled WHERE regulation <> 'NISTPF')) AS missing_controls,
  count(DISTINCT control_id) AS mapped_controls, count(*) AS active_metric_count,
  0 AS deferred_metric_count,
  count(*) FILTER (WHERE level = 'user') AS level_user,
  count(*) FILTER (WHERE level = 'system') AS level_system,
  count(*) FILTER (WHERE level = 'organization') AS level_organization
FROM leveled WHERE regulation <> 'NISTPF'""",
    "public_mapping": f"""WITH {I.INCIDENTS}
SELECT 'orders' AS source, row_number() OVER (ORDER BY order_key) - 1 AS source_row_index,
  event_date, country, sector, records_affected, detection_to_response_hours, severity,
  concat_ws('|', CASE WHEN event_date = '' THEN 'event_date' END,
    CASE WHEN sector IS NULL THEN 'sector' END,
    CASE WHEN records_affected IS NULL THEN 'records_affected' END) AS dq_missing_required_fields,
  NOT (event_date = '' OR sector IS NULL OR records_affected IS NULL) AS dq_valid
FROM incidents""",
    "public_summary": f"""WITH {I.INCIDENTS}
SELECT count(*) AS input_rows,
  count(*) FILTER (WHERE event_date <> '' AND sector IS NOT NULL AND records_affected IS NOT NULL) AS valid_rows,
  count(*) FILTER (WHERE event_date = '' OR sector IS NULL OR records_affected IS NULL) AS invalid_rows
FROM incidents""",
    "claim_links": f"""WITH {I.PART_CONTROLS}, {I.OBSERVATIONS}, claims AS (
  SELECT 'claim-' || o_orderkey AS claim_id,
    {I.sql_pick(('normal', 'stressed', 'adversarial'), 'o_custkey')} AS scenario,
    'metric-' || ((o_orderkey % 20000) * 3 + o_orderkey % 2) AS metric_id,
    {I.sql_pick(('user', 'system'), 'o_orderkey')} AS level,
    {I.sql_pick(('compliant', 'partial', 'noncompliant'), 'o_orderkey // 7')} AS compliance_status
  FROM orders),
hashed AS (SELECT *, md5('42|' || claim_id) AS h FROM claims),
by_metric AS (SELECT *, row_number() OVER (PARTITION BY scenario, metric_id ORDER BY h, claim_id) AS pos,
  count(*) OVER (PARTITION BY scenario, metric_id) AS n FROM hashed),
by_level AS (SELECT *, row_number() OVER (PARTITION BY scenario, level ORDER BY h, claim_id) AS pos,
  count(*) OVER (PARTITION BY scenario, level) AS n FROM hashed),
obs AS (SELECT observation_id, scenario, metric_id, level,
  failure_count::DOUBLE / total_checks AS base_failure_rate,
  ('0x' || substr(md5('42|' || observation_id), 1, 8))::BIGINT AS draw FROM observations),
linked AS (
  SELECT o.*, coalesce(m.claim_id, l.claim_id) AS claim_id,
    coalesce(m.compliance_status, l.compliance_status) AS compliance_status,
    CASE WHEN m.claim_id IS NOT NULL THEN 'metric' WHEN l.claim_id IS NOT NULL THEN 'level' ELSE 'none' END AS link
  FROM obs o
  LEFT JOIN by_metric m ON o.scenario = m.scenario AND o.metric_id = m.metric_id AND m.pos = o.draw % m.n + 1
  LEFT JOIN by_level l ON o.scenario = l.scenario AND o.level = l.level AND l.pos = o.draw % l.n + 1)
SELECT observation_id, scenario, metric_id, level, round(base_failure_rate, 6) AS base_failure_rate,
  claim_id, compliance_status, link,
  round(CASE WHEN compliance_status IS NULL THEN base_failure_rate
    WHEN compliance_status = 'compliant' THEN least(base_failure_rate, 0.12::DOUBLE) * 0.65::DOUBLE
    WHEN compliance_status = 'partial' THEN greatest(base_failure_rate, 0.18::DOUBLE)
    ELSE greatest(base_failure_rate, 0.45::DOUBLE) END, 6) AS adjusted_rate FROM linked""",
}
