"""Queries over policy texts and schemas: clauses, checks, evidence, verdicts, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions import records, text
from clausewise.operators import assess, checks
from clausewise.plans import inputs as I


def clauses(spark, sf):
    return text.explode_clauses(
        text.with_clauses(I.policy_docs(spark, sf), "policy_text", "clauses").drop("policy_text"))


def check_scores(spark, sf):
    c = checks.policy_check_scores(I.policy_docs(spark, sf))
    return c.withColumn("matched_keywords", F.concat_ws("|", "matched_keywords")).drop("evidence")


def clause_evidence(spark, sf):
    c = checks.policy_check_scores(I.policy_docs(spark, sf))
    return text.unfold(c.select("doc_id", "check_id", "evidence"), "evidence", "item", "clause")


def schema_fields(spark, sf):
    c = checks.classify_schema(I.schema_docs(spark, sf))
    return c.select("doc_id", *[F.concat_ws("|", n).alias(n) for n in (
        "fields", "tables", "pii_fields", "sensitive_fields")])


def schema_alignment(spark, sf):
    a = checks.schema_alignment(I.policy_docs(spark, sf), I.schema_docs(spark, sf))
    return a.withColumn("details", F.concat_ws("|", "details"))


def policy_schema_score(spark, sf):
    return checks.policy_schema_score(I.policy_docs(spark, sf), I.schema_docs(spark, sf))


def _claims(spark, sf, regulations=None):
    return assess.claim_verdicts(I.policy_docs(spark, sf), I.ground_truth_controls(spark, sf),
                                 regulations)


def ranked_evidence(spark, sf):
    v = assess.verdict_rows(_claims(spark, sf))
    return v.select("doc_id", "clause_index", "check_id", "rank", "regulation", "control_id",
                    "score", "source")


#: Checks of one's own: words that the built-in ones lack, one inside another.
OWN_SPECS = (
    ("own_choice", "Choice", 10.0, ("opt in", "opt", "withdraw", "permission settings")),
    ("own_incident", "Incidents", 10.0, ("breach", "72 hours", "breach reports", "response team")),
    ("own_disposal", "Disposal", 5.0, ("disposal", "archive", "storage period", "retention")),
)


def ranked_evidence_parts(spark, sf):
    """Every part as a control, in blocks, against claims of one's own checks."""
    claims = assess.claims(I.policy_docs(spark, sf), specs=OWN_SPECS)
    parts = I.part_controls(spark, sf).withColumn("seq", F.col("partkey"))
    v = assess.verdict_rows(assess.with_verdicts(assess.rank_evidence(claims, parts)))
    return v.select("doc_id", "clause_index", "check_id", "rank", "regulation", "control_id", "control_title",
                    "score", "source", "compliant")


def verdicts(spark, sf):
    v = assess.verdict_rows(_claims(spark, sf), wording=True)
    return v.select("doc_id", "clause_index", "check_id", "rank", "regulation", "control_id",
                    "control_title", "compliant", "reason", "remediation_advice",
                    F.element_at("cited_clauses", 1).alias("cited_clause"))


def verdicts_one_regulation(spark, sf):
    v = assess.verdict_rows(_claims(spark, sf, ["GDPR"]))
    return v.select("doc_id", "clause_index", "check_id", "rank", "regulation", "control_id",
                    "compliant")


def running_verdicts(spark, sf):
    v = assess.running_verdicts(assess.verdict_rows(_claims(spark, sf)))
    return v.select("doc_id", "clause_index", "check_id", "rank", "regulation",
                    "regulation_pass", "regulation_fail")


def regulation_summary(spark, sf):
    totals = assess.control_totals(spark, I.ground_truth_controls(spark, sf))
    return assess.regulation_summary(I.policy_docs(spark, sf), _claims(spark, sf), totals)


def policy_score(spark, sf):
    return assess.policy_score(regulation_summary(spark, sf))


def available_regulations(spark, sf):
    return assess.available_regulations(spark, I.part_controls(spark, sf))


def control_rows(spark, sf):
    c = assess.prepare_controls(I.part_controls(spark, sf))
    return c.select("regulation", "control_id", "title", "requirement",
                    F.concat_ws(" ", F.array_sort("tokens")).alias("tokens"))


def assess_policies(spark, sf):
    from clausewise.plans import q_classify

    docs = I.policy_docs(spark, sf)
    return assess.assess_policies(docs, I.ground_truth_controls(spark, sf),
                                  signal=q_classify.policy_signal(spark, sf))


def assessment_reports(spark, sf):
    """The nested report of each policy, its parts told apart by digests."""
    from clausewise.operators import classify
    from clausewise.plans.q_classify import _length_scorer

    by_length = lambda c: classify.score_with(
        c.withColumn("clause", F.coalesce("clause", F.lit(""))), _length_scorer,
        ["doc_id", "clauses_total", "clause_index", "clause"], "clause").drop("probabilities")
    r = assess.assessment_report(I.policy_docs(spark, sf), I.ground_truth_controls(spark, sf), classify=by_length)
    verdict = lambda v: F.concat_ws(":", v["regulation"], v["control_id"], v["control_title"], v["compliant"].cast("string"),
                                    v["reason"], v["remediation_advice"])
    told = F.transform("claims", lambda c: F.concat_ws(
        ":", c["claim_index"].cast("string"), c["check_id"], c["check_title"], c["predicted_label"],
        F.round(c["confidence"] * 1000).cast("int").cast("string"), F.array_join(F.transform(c["regulation_verdicts"], verdict), ";")))
    regs = F.transform("regulation_summary", lambda x: F.concat_ws(":", x["regulation"], x["pass_count"].cast("string"),
                                                                   x["fail_count"].cast("string"), x["total_controls"].cast("string")))
    return r.select("doc_id", "summary.clauses_analyzed", "summary.claims_generated",
                    F.array_join("summary.regulations_evaluated", "|").alias("regulations_evaluated"), "overall_score", "grade", "status",
                    F.md5(F.array_join(told, "|")).alias("claims_md5"), F.array_join(regs, "|").alias("regulations"),
                    "model_signal", "posterior_risk.posterior_mean", "posterior_risk.evidence_count")


def band_score_summary(spark, sf):
    s = checks.policy_schema_score(I.policy_docs(spark, sf), I.schema_docs(spark, sf))
    band = I.pick(("low", "medium", "other"), F.col("doc_id"))
    s = s.withColumn("compliance_band", band).withColumn(
        "within_target_band",
        F.when(F.col("compliance_band") == "low", F.col("overall_score") < 40)
        .otherwise(F.col("overall_score").between(40, 70)))
    return checks.band_score_summary(s)


QUERIES = {
    "clauses": clauses, "check_scores": check_scores, "clause_evidence": clause_evidence,
    "schema_fields": schema_fields, "schema_alignment": schema_alignment,
    "policy_schema_score": policy_schema_score, "ranked_evidence": ranked_evidence,
    "ranked_evidence_parts": ranked_evidence_parts,
    "verdicts": verdicts, "verdicts_one_regulation": verdicts_one_regulation,
    "running_verdicts": running_verdicts, "regulation_summary": regulation_summary,
    "policy_score": policy_score, "available_regulations": available_regulations,
    "control_rows": control_rows, "assessment_reports": assessment_reports,
    "band_score_summary": band_score_summary,
}

# --- SQL ----------------------------------------------------------------------------

_DOCS = f"WITH {I.POLICY_DOCS}, {I.CLAUSES}, {I.CHECKS}"

_CHECK_SCORES = f"""lowered AS (SELECT doc_id, lower({I.sql_norm('policy_text')}) AS low FROM policy_docs),
check_hits AS (
  SELECT doc_id, check_id, check_title, weight::DOUBLE AS weight, keywords,
    list_filter(keywords, lambda k: contains(low, k)) AS matched FROM lowered, checks),
check_scores AS (
  SELECT *, CASE WHEN len(matched) = 0 THEN 0.0::DOUBLE ELSE weight * least(1.0::DOUBLE,
    len(matched) / greatest(2.0::DOUBLE, len(keywords) * 0.35::DOUBLE)) END AS raw_score
  FROM check_hits)"""

_FIELDS = f"""{I.SCHEMA_DOCS}, ddl_lines AS (
  SELECT doc_id, trim(trim(line), ',') AS raw FROM (
    SELECT doc_id, unnest(string_split(schema_text, chr(10))) AS line FROM schema_docs)),
ddl_names AS (
  SELECT doc_id, lower(coalesce(
    nullif(regexp_extract(raw, '^[`"\\[]?([A-Za-z_][A-Za-z0-9_]*)[`"\\]]?\\s+[A-Za-z]', 1), ''),
    regexp_extract(raw, '^[`"\\[]?([A-Za-z_][A-Za-z0-9_]*)[`"\\]]?\\s*:\\s*', 1))) AS field
  FROM ddl_lines
  WHERE NOT regexp_matches(lower(raw), '^(create table|primary key|foreign key|constraint|index|\\))')
  UNION ALL
  SELECT doc_id, lower(trim(unnest(regexp_extract_all(schema_text, '"([^"]+)"\\s*:', 1))))
  FROM schema_docs WHERE json_valid(schema_text)),
ddl_tables AS (
  SELECT doc_id, string_agg(trim(string_split(raw, ' ')[3], '"`()[]'), '|') AS tables
  FROM ddl_lines WHERE starts_with(lower(raw), 'create table ') GROUP BY doc_id),
field_lists AS (
  SELECT doc_id, list_sort(list(DISTINCT field) FILTER (WHERE field <> '')) AS fs FROM ddl_names GROUP BY doc_id),
schema_fields AS (
  SELECT doc_id, array_to_string(fs, '|') AS fields, coalesce(tables, '') AS tables,
    array_to_string(list_filter(fs, lambda f: len(list_filter({I.sql_list(lexicon.PII_PATTERNS)}, lambda p: contains(f, p))) > 0), '|') AS pii_fields,
    array_to_string(list_filter(fs, lambda f: len(list_filter({I.sql_list(lexicon.SENSITIVE_PATTERNS)}, lambda p: contains(f, p))) > 0), '|') AS sensitive_fields
  FROM field_lists LEFT JOIN ddl_tables USING (doc_id))"""

_ALIGN = """align AS (
  SELECT doc_id, n_fields, n_pii, n_sens,
    n_pii > 0 AND NOT has_rights AS r1, n_pii > 0 AND NOT has_sec AS r2,
    n_pii > 0 AND NOT has_share AS r3, n_pii > 0 AND NOT has_ret AS r4,
    n_sens > 0 AND NOT has_sec AS r5,
    n_sens > 0 AND NOT (contains(low, 'sensitive') OR contains(low, 'special category')) AS r6
  FROM (SELECT doc_id, len(string_split(fields, '|')) AS n_fields,
      CASE WHEN pii_fields = '' THEN 0 ELSE len(string_split(pii_fields, '|')) END AS n_pii,
      CASE WHEN sensitive_fields = '' THEN 0 ELSE len(string_split(sensitive_fields, '|')) END AS n_sens
    FROM schema_fields) f
  JOIN (SELECT doc_id, bool_or(check_id = 'user_rights' AND raw_score > 0) AS has_rights,
      bool_or(check_id = 'security_safeguards' AND raw_score > 0) AS has_sec,
      bool_or(check_id = 'third_party_sharing' AND raw_score > 0) AS has_share,
      bool_or(check_id = 'data_retention' AND raw_score > 0) AS has_ret
    FROM check_scores GROUP BY doc_id) p USING (doc_id)
  JOIN lowered USING (doc_id)),
aligned AS (
  SELECT *, greatest(0.0::DOUBLE, 15.0::DOUBLE - 4 * r1::INT - 4 * r2::INT - 2 * r3::INT - 2 * r4::INT
    - 3 * r5::INT - 2 * r6::INT) AS align_score FROM align)"""

_GRADE = """CASE WHEN overall_score >= 85 THEN 'A' WHEN overall_score >= 70 THEN 'B'
    WHEN overall_score >= 55 THEN 'C' WHEN overall_score >= 40 THEN 'D' ELSE 'F' END AS grade,
  CASE WHEN overall_score >= 85 THEN 'Compliant' WHEN overall_score >= 70 THEN 'Mostly Compliant'
    WHEN overall_score >= 55 THEN 'Needs Attention' ELSE 'High Compliance Risk' END AS status"""

_SCHEMA_SCORE = f"""totals AS (
  SELECT doc_id, sum(round(raw_score, 2)) AS cp,
    count(*) FILTER (WHERE raw_score >= weight * 0.4::DOUBLE) AS checks_passed
  FROM check_scores GROUP BY doc_id),
schema_score AS (
  SELECT doc_id, round(cp, 2) AS check_points, checks_passed, align_score AS alignment_points,
    n_pii AS pii_fields_count, n_sens AS sensitive_fields_count, n_fields AS fields_count,
    0.0::DOUBLE AS signal_points, least(100.0::DOUBLE, round(cp + align_score, 2)) AS overall_score
  FROM totals JOIN aligned USING (doc_id))"""

VERDICTS = f"""{I.CONTROLS}, {I.SIGNALS}, {I.GROUND_TRUTH}, claims AS (
  SELECT * FROM (
    SELECT doc_id, clause_index, clause, check_seq, check_id,
      list_filter(keywords, lambda k: contains(lower(clause), k)) AS matched,
      list_distinct(regexp_extract_all(lower(clause), '[a-z0-9]{{3,}}')) AS tokens
    FROM clauses, checks) WHERE len(matched) > 0),
candidates AS (
  SELECT check_id, regulation, control_id, title, requirement, 'legacy' AS source, seq FROM builtin
  UNION ALL
  SELECT c.check_id, regulation, control_id, title, requirement, 'ground_truth', 1000 + k
  FROM ground, checks c),
prepared AS (
  SELECT c.*, lower(requirement) AS req_low,
    list_distinct(regexp_extract_all(lower(c.control_id || ' ' || title || ' ' || requirement), '[a-z0-9]{{3,}}')) AS ctokens,
    coalesce(signals, []) AS signals
  FROM candidates c LEFT JOIN signals USING (control_id)),
scored_v AS (
  SELECT *, len(list_intersect(tokens, ctokens)) + 2 * overlap AS score FROM (
    SELECT cl.doc_id, clause_index, clause, check_seq, cl.check_id, matched, tokens, regulation,
      control_id, title, requirement, source, seq, signals, ctokens,
      len(list_filter(matched, lambda k: contains(req_low, k))) AS overlap
    FROM claims cl JOIN prepared p ON p.check_id = cl.check_id WHERE __REG__)),
v1 AS (SELECT * FROM scored_v WHERE score > 0 QUALIFY row_number() OVER (
  PARTITION BY doc_id, clause_index, check_id, regulation, control_id ORDER BY score DESC, seq) = 1),
v2 AS (SELECT * FROM v1 QUALIFY row_number() OVER (
  PARTITION BY doc_id, clause_index, check_id, regulation ORDER BY score DESC, control_id DESC) <= 5),
v3 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, clause_index, check_id
  ORDER BY score DESC, regulation DESC, control_id DESC) AS rank FROM v2),
verdicts AS (
  SELECT *, overlap >= 2 OR (overlap >= 1 AND
    len(list_filter(signals, lambda s: contains(lower(clause), s))) > 0) AS compliant
  FROM v3 WHERE rank <= 18)"""
_V = f"{_DOCS}, {VERDICTS.replace('__REG__', 'true')}"

SUMMARY = """reg_totals AS (
  SELECT regulation, greatest(sum(n), 1)::INT AS total_controls FROM (
    SELECT regulation, 1 AS n FROM builtin
    UNION ALL SELECT DISTINCT trim(reg), 0 FROM ground0 WHERE trim(reg) <> '') GROUP BY regulation),
summary AS (
  SELECT doc_id, regulation, sum(p) AS pass_count, sum(f) AS fail_count FROM (
    SELECT doc_id, regulation, compliant::INT AS p, (NOT compliant)::INT AS f FROM verdicts
    UNION ALL SELECT doc_id, regulation, 0, 0 FROM policy_docs, reg_totals)
  GROUP BY doc_id, regulation),
summary2 AS (
  SELECT doc_id, regulation, pass_count, fail_count, pass_count + fail_count AS total_evaluated,
    coalesce(total_controls, 0) AS total_controls,
    CASE WHEN pass_count + fail_count > 0 THEN round(pass_count / (pass_count + fail_count) * 100.0::DOUBLE, 2)
      ELSE 0.0::DOUBLE END AS compliance_pct
  FROM summary LEFT JOIN reg_totals USING (regulation)),
doc_scores AS (
  SELECT doc_id, sum(pass_count) AS pass_count, sum(fail_count) AS fail_count,
    sum(total_controls) AS total_controls,
    least(100.0::DOUBLE, round(sum(pass_count)::DOUBLE / sum(total_controls) * 100, 2)) AS overall_score
  FROM summary2 GROUP BY doc_id)"""

_REASON = """'Clause ' || CASE WHEN compliant THEN 'satisfies' ELSE 'does not satisfy' END || ' ' || control_id
  || ' (' || title || '). Evidence source=' || source || ', match_score=' || score || '.000, matched_keywords=['
  || array_to_string(list_transform(matched[1:4], lambda k: '''' || k || ''''), ', ')
  || '], control_requirement="' || trim(requirement[1:160]) || '", clause_excerpt="' || trim(clause[1:160]) || '".'"""
_ADVICE = """CASE WHEN compliant THEN 'Clause currently satisfies ' || control_id || '. Strengthen with explicit implementation details.'
    ELSE 'Add explicit language covering ' || control_id || ': ' || requirement END"""
_PRIORS = ", ".join(f"('{n}', {float(a)}::DOUBLE, {float(b)}::DOUBLE)" for n, (a, b) in lexicon.BETA_PRIORS.items())

ORACLE = {
    "assessment_reports": f"""{_V}, {SUMMARY},
sc AS (SELECT doc_id, clause_index, 10.0::DOUBLE AS u, (length(clause) % 7)::DOUBLE AS y, length(clause) / 10.0::DOUBLE AS o FROM clauses),
lab AS MATERIALIZED (SELECT doc_id, clause_index, CASE WHEN u >= y AND u >= o THEN 'user' WHEN y >= o THEN 'system' ELSE 'organization' END AS label,
  greatest(u, y, o) / (u + y + o) AS conf FROM sc),
sig AS (SELECT doc_id, count(*)::INT AS n, round(least(3.0::DOUBLE, count(DISTINCT label)) + least(2.0::DOUBLE, avg(conf) * 2), 2) AS model_signal
  FROM lab GROUP BY doc_id),
post AS (SELECT doc_id, round(sum((a + s) / (a + b + n) * n) / sum(n), 6) AS posterior_mean FROM (
  SELECT doc_id, label, count(*) AS n, sum(conf) AS s FROM lab GROUP BY ALL) JOIN (VALUES {_PRIORS}) p(label, a, b) USING (label) GROUP BY doc_id),
cv AS (SELECT doc_id, clause_index, check_id, string_agg(regulation || ':' || control_id || ':' || title || ':' || compliant || ':' || {_REASON} || ':' || {_ADVICE},
    ';' ORDER BY rank) AS v FROM verdicts GROUP BY ALL),
ct AS (SELECT cl.doc_id, count(*)::INT AS n, string_agg(concat_ws(':', cl.clause_index, cl.check_id, check_title, label, round(conf * 1000)::INT, coalesce(v, '')),
    '|' ORDER BY cl.clause_index, cl.check_seq) AS t
  FROM claims cl JOIN (SELECT check_id, check_title FROM checks) USING (check_id) JOIN lab USING (doc_id, clause_index)
  LEFT JOIN cv USING (doc_id, clause_index, check_id) GROUP BY cl.doc_id),
rs AS (SELECT doc_id, string_agg(regulation, '|' ORDER BY regulation) AS regs,
    string_agg(concat_ws(':', regulation, pass_count, fail_count, total_controls), '|' ORDER BY regulation) AS regulations FROM summary2 GROUP BY doc_id),
base AS (SELECT doc_id, sig.n AS clauses_analyzed, coalesce(ct.n, 0) AS claims_generated, regs AS regulations_evaluated, overall_score,
    md5(coalesce(t, '')) AS claims_md5, regulations, model_signal, posterior_mean, sig.n AS evidence_count
  FROM doc_scores JOIN sig USING (doc_id) JOIN post USING (doc_id) JOIN rs USING (doc_id) LEFT JOIN ct USING (doc_id))
SELECT *, {_GRADE} FROM base""",
    "clauses": f"WITH {I.POLICY_DOCS}, {I.CLAUSES} SELECT doc_id, clause_index, clause FROM clauses",
    "check_scores": f"""{_DOCS}, {_CHECK_SCORES}
SELECT doc_id, check_id, check_title AS title, round(raw_score, 2) AS score, weight AS max_score,
  raw_score >= weight * 0.4::DOUBLE AS passed, raw_score > 0 AS present,
  array_to_string(matched, '|') AS matched_keywords FROM check_scores""",
    "clause_evidence": f"""{_DOCS}, {_CHECK_SCORES}
SELECT doc_id, check_id, row_number() OVER (PARTITION BY doc_id, check_id ORDER BY clause_index) - 1 AS item, clause
FROM check_hits JOIN clauses USING (doc_id)
WHERE len(list_filter(matched, lambda k: contains(lower(clause), k))) > 0
QUALIFY row_number() OVER (PARTITION BY doc_id, check_id ORDER BY clause_index) <= 3""",
    "schema_fields": f"WITH {_FIELDS} SELECT * FROM schema_fields",
    "schema_alignment": f"""{_DOCS}, {_CHECK_SCORES}, {_FIELDS}, {_ALIGN}
SELECT doc_id, align_score AS score, 15.0::DOUBLE AS max_score, align_score >= 9 AS passed,
  n_fields AS fields_count, n_pii AS pii_fields_count, n_sens AS sensitive_fields_count,
  concat_ws('|', {", ".join(f"CASE WHEN r{i + 1} THEN {I.quote(w)} END" for i, w in enumerate(
      [r[3] for r in checks._ALIGNMENT_RULES] + [checks._SENSITIVE_WORDING[1]]))}) AS details
FROM aligned""",
    "policy_schema_score": f"""{_DOCS}, {_CHECK_SCORES}, {_FIELDS}, {_ALIGN}, {_SCHEMA_SCORE}
SELECT *, {_GRADE} FROM schema_score""",
    "band_score_summary": f"""{_DOCS}, {_CHECK_SCORES}, {_FIELDS}, {_ALIGN}, {_SCHEMA_SCORE},
banded AS (SELECT overall_score AS s, {I.sql_pick(('low', 'medium', 'other'), 'doc_id')} AS band FROM schema_score)
SELECT b.band, count(s) AS count,
  count(*) FILTER (WHERE CASE WHEN b.band = 'low' THEN s < 40 ELSE s BETWEEN 40 AND 70 END) AS in_target_band,
  round(min(s), 4) AS minimum, round(avg(s), 4) AS mean, round(max(s), 4) AS maximum
FROM (VALUES ('low'), ('medium'), ('high')) b(band) LEFT JOIN banded USING (band) GROUP BY b.band""",
    "ranked_evidence": f"""{_V}
SELECT doc_id, clause_index, check_id, rank, regulation, control_id, score::DOUBLE AS score, source FROM verdicts""",
    "ranked_evidence_parts": f"""WITH {I.POLICY_DOCS}, {I.CLAUSES}, {I.PART_CONTROLS}, {I.SIGNALS},
own(check_seq, check_id, keywords) AS (VALUES {I.sql_rows((i, c, list(k)) for i, (c, _, _, k) in enumerate(OWN_SPECS))}),
said AS (SELECT clause, check_id, list_filter(keywords, lambda k: contains(lower(clause), k)) AS matched,
    list_distinct(regexp_extract_all(lower(clause), '[a-z0-9]{{3,}}')) AS tokens
  FROM (SELECT DISTINCT clause FROM clauses), own),
parts AS (SELECT trim(regulation) AS regulation, native_id AS control_id,
    CASE WHEN title = '' THEN native_id ELSE title END AS title, text AS requirement, partkey,
    list_distinct(regexp_extract_all(lower(native_id || ' ' || CASE WHEN title = '' THEN native_id ELSE title END || ' ' || text), '[a-z0-9]{{3,}}')) AS ctokens
  FROM part_controls),
s0 AS (SELECT clause, check_id, p.* EXCLUDE (ctokens), tokens, ctokens, len(list_filter(matched, lambda k: contains(lower(requirement), k))) AS overlap
  FROM said, parts p WHERE len(matched) > 0),
s1 AS (SELECT * EXCLUDE (tokens, ctokens), len(list_intersect(tokens, ctokens)) + 2 * overlap AS score FROM s0),
s2 AS (SELECT * FROM s1 WHERE score > 0 QUALIFY row_number() OVER (
  PARTITION BY clause, check_id, regulation ORDER BY score DESC, control_id DESC, partkey) <= 5),
s3 AS (SELECT *, row_number() OVER (PARTITION BY clause, check_id ORDER BY score DESC, regulation DESC, control_id DESC) AS rank FROM s2)
SELECT doc_id, clause_index, check_id, rank, regulation, control_id, title AS control_title, score::DOUBLE AS score,
  'ground_truth' AS source, overlap >= 2 OR (overlap >= 1 AND
    len(list_filter(coalesce(signals, []), lambda x: contains(lower(clause), x))) > 0) AS compliant
FROM clauses JOIN s3 USING (clause) LEFT JOIN signals USING (control_id) WHERE rank <= 18""",
    "verdicts": f"""{_V}
SELECT doc_id, clause_index, check_id, rank, regulation, control_id, title AS control_title, compliant,
  'Clause ' || CASE WHEN compliant THEN 'satisfies' ELSE 'does not satisfy' END || ' ' || control_id
  || ' (' || title || '). Evidence source=' || source || ', match_score=' || score || '.000, matched_keywords=['
  || array_to_string(list_transform(matched[1:4], lambda k: '''' || k || ''''), ', ')
  || '], control_requirement="' || trim(requirement[1:160]) || '", clause_excerpt="' || trim(clause[1:160]) || '".' AS reason,
  CASE WHEN compliant THEN 'Clause currently satisfies ' || control_id || '. Strengthen with explicit implementation details.'
    ELSE 'Add explicit language covering ' || control_id || ': ' || requirement END AS remediation_advice,
  clause AS cited_clause FROM verdicts""",
    "verdicts_one_regulation": f"""{_DOCS}, {VERDICTS.replace('__REG__', "regulation = 'GDPR'")}
SELECT doc_id, clause_index, check_id, rank, regulation, control_id, compliant FROM verdicts""",
    "running_verdicts": f"""{_V}
SELECT doc_id, clause_index, check_id, rank, regulation,
  sum(compliant::INT) OVER w AS regulation_pass, sum((NOT compliant)::INT) OVER w AS regulation_fail
FROM verdicts WINDOW w AS (PARTITION BY doc_id, regulation ORDER BY clause_index, check_seq, rank
  ROWS UNBOUNDED PRECEDING)""",
    "regulation_summary": f"{_V}, {SUMMARY} SELECT * FROM summary2",
    "policy_score": f"{_V}, {SUMMARY} SELECT *, {_GRADE} FROM doc_scores",
    "available_regulations": f"""WITH {I.CONTROLS}, {I.PART_CONTROLS}
SELECT DISTINCT regulation FROM (SELECT regulation FROM builtin UNION SELECT trim(regulation) FROM part_controls)
WHERE regulation <> ''""",
    "control_rows": f"""WITH {I.PART_CONTROLS}
SELECT regulation, native_id AS control_id, CASE WHEN title = '' THEN native_id ELSE title END AS title,
  text AS requirement, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(native_id || ' ' ||
  CASE WHEN title = '' THEN native_id ELSE title END || ' ' || text), '[a-z0-9]{{3,}}'))), ' ') AS tokens
FROM part_controls""",
}
