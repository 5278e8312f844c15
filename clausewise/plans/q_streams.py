"""Streaming queries over the given tables, run to the end of their input."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausewise.functions import text
from clausewise.operators.ordering import reach_workers, shared_folder
from clausewise.plans import inputs as I
from clausewise.plans import q_assess as A
from clausewise.streaming import streams


def _folder(spark) -> str:
    """A new folder in the session's shared place."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _read(spark, sf, name):
    """A given table as a stream, whether it is a file or a folder of files.

    A stream reads a lone file only through a pattern. All files are one batch: they are in no
    order of time, and windows would drop what a later file has of them.
    """
    schema = spark.read.parquet(f"{sf}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}[.]parquet")


def _doc_stream(spark, sf):
    # A table of one file would be one task.
    docs = _read(spark, sf, "documents").select("doc_id", "text")
    return I.policy_texts(docs.repartition(spark.sparkContext.defaultParallelism, "doc_id"))


def stream_assess(spark, sf):
    events = streams.run_append(streams.stream_assess(_doc_stream(spark, sf)), _folder(spark))
    return events


def _by_length(clauses):
    """Labels of clauses from a scorer of one's own, inside the stream."""
    from clausewise.operators import classify
    from clausewise.plans.q_classify import _length_scorer

    return classify.score_with(clauses, _length_scorer, ["doc_id", "clauses_total", "clause_index", "clause"],
                               "clause").drop("probabilities")


def stream_events(spark, sf):
    """Clauses of each document arrive in three batches, the last ones first.

    A batch is as many files as there are tasks, and the stream goes on from its checkpoint.
    """
    reach_workers(spark)
    folder = _folder(spark)
    docs = _doc_stream(spark, sf)
    d = text.with_clauses(docs, "policy_text", "_c").drop("policy_text")
    clauses = d.select("doc_id", F.size("_c").alias("clauses_total"), F.posexplode_outer("_c").alias("clause_index", "clause"))
    parts = streams.run_append(clauses, f"{folder}/clauses")
    spark.createDataFrame([], parts.schema).write.parquet(f"{folder}/turns")
    live = spark.readStream.schema(parts.schema).parquet(f"{folder}/turns")
    with streams.with_state_store(spark):
        events = streams.stream_clause_events(live, _by_length)
        for turn in range(3):
            mine = parts.where(F.pmod(-F.coalesce("clause_index", F.lit(0)), F.lit(3)) == turn)
            mine.write.mode("append").parquet(f"{folder}/turns")
            out = streams.run_append(events, f"{folder}/events")
    return out


def stream_tallies(spark, sf):
    v = streams.stream_verdicts(_doc_stream(spark, sf))
    return streams.run_complete(streams.stream_tallies(v), _folder(spark))


def stream_window_tallies(spark, sf):
    e = _read(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("regulation"), (F.col("value") > 10).alias("compliant"))
    out = streams.run_append(streams.windowed_tallies(e, "ts", "1 hour", "10 minutes"),
                             _folder(spark))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_score(spark, sf):
    l = _read(spark, sf, "lineitem")
    checks = F.col("l_quantity").cast("int")
    obs = l.select(
        F.col("l_returnflag").alias("scenario"), F.col("l_linestatus").alias("level"),
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("entity_id"),
        F.concat(F.lit("metric-"), F.col("l_partkey")).alias("metric_id"),
        checks.alias("total_checks"),
        F.least(checks, F.round(F.col("l_discount") * 100).cast("int")).alias("failure_count"),
        F.round(F.col("l_tax") * 100).cast("int").alias("missing_fields"),
        F.lit(0.93713123).alias("observed_confidence"))
    return streams.run_append(streams.stream_score(obs, I.observation_specs(spark, sf)),
                              _folder(spark)).select(
        "scenario", "level", "entity_id", "metric_id", "control_id", "confidence_adjusted_score",
        "risk_band")


QUERIES = {f.__name__: f for f in (stream_assess, stream_events, stream_tallies, stream_window_tallies, stream_score)}

_NO_GROUND = A.VERDICTS.replace("__REG__", "source = 'legacy'")

ORACLE = {
    "stream_assess": f"""{A._DOCS}, {_NO_GROUND}
SELECT doc_id, clause_index, -1 AS check_seq, 0 AS rank, 'clause_start' AS event, 'read_claim' AS stage,
  NULL AS regulation, NULL AS control_id, NULL::BOOLEAN AS compliant, clause[1:140] AS note, clause FROM clauses
UNION ALL SELECT doc_id, clause_index, check_seq, 0, 'check_match', 'match_checks', NULL, NULL, NULL,
  array_to_string(matched, '|'), NULL FROM claims
UNION ALL SELECT doc_id, clause_index, check_seq, rank, 'verdict_complete', 'score_controls', regulation, control_id,
  compliant, source, NULL FROM verdicts""",
    "stream_events": f"""{A._DOCS}, {_NO_GROUND}, totals AS (SELECT count(*)::INT AS n, string_agg(DISTINCT regulation, '|' ORDER BY regulation) AS regs FROM builtin),
sizes AS (SELECT doc_id, count(*)::INT AS clauses_total FROM clauses GROUP BY doc_id),
sc AS (SELECT doc_id, clause_index, 10.0::DOUBLE AS u, (length(clause) % 7)::DOUBLE AS y, length(clause) / 10.0::DOUBLE AS o FROM clauses),
lab AS (SELECT doc_id, clause_index, CASE WHEN u >= y AND u >= o THEN 'user' WHEN y >= o THEN 'system' ELSE 'organization' END AS label,
  greatest(u, y, o) / (u + y + o) AS conf FROM sc),
sig AS (SELECT doc_id, round(least(3.0::DOUBLE, count(DISTINCT label)) + least(2.0::DOUBLE, avg(conf) * 2), 2) AS model_signal FROM lab GROUP BY doc_id),
ends AS (SELECT s.doc_id, count(*) FILTER (WHERE compliant)::INT AS p, count(*) FILTER (WHERE NOT compliant)::INT AS f
  FROM sizes s LEFT JOIN verdicts v ON v.doc_id = s.doc_id GROUP BY s.doc_id),
nclaims AS (SELECT doc_id, count(*)::INT AS n FROM claims GROUP BY doc_id),
fin AS (SELECT doc_id, p, f, coalesce(nclaims.n, 0) AS claims_generated, totals.n AS total_controls,
  least(100.0::DOUBLE, round(p / totals.n::DOUBLE * 100, 2)) AS overall_score, model_signal
  FROM ends JOIN sig USING (doc_id) LEFT JOIN nclaims USING (doc_id), totals),
run AS (SELECT *, (sum(compliant::INT) OVER w)::INT AS regulation_pass, (sum((NOT compliant)::INT) OVER w)::INT AS regulation_fail
  FROM verdicts WINDOW w AS (PARTITION BY doc_id, regulation ORDER BY clause_index, check_seq, rank ROWS UNBOUNDED PRECEDING)),
ev AS (
  SELECT doc_id, -1 AS o1, 0 AS o2, 0 AS o3, NULL::INT AS clause_index, 'start' AS event, 'read_claim' AS stage, 'local' AS evidence_source,
    regs AS note FROM sizes, totals
  UNION ALL BY NAME SELECT doc_id, clause_index AS o1, -2 AS o2, 0 AS o3, clause_index::INT AS clause_index, 'clause_start' AS event,
    'read_claim' AS stage, clause[1:140] AS note FROM clauses
  UNION ALL BY NAME SELECT doc_id, clause_index AS o1, -1 AS o2, 0 AS o3, clause_index::INT AS clause_index, 'classification_complete' AS event,
    'classify_claim' AS stage, label AS predicted_label, round(conf, 6) AS confidence FROM lab
  UNION ALL BY NAME SELECT doc_id, clause_index AS o1, check_seq AS o2, 0 AS o3, clause_index::INT AS clause_index, 'check_match' AS event,
    'match_checks' AS stage, check_id, check_title, array_to_string(matched, '|') AS note FROM claims JOIN (SELECT check_id, check_title FROM checks) USING (check_id)
  UNION ALL BY NAME SELECT doc_id, clause_index AS o1, check_seq AS o2, rank AS o3, clause_index::INT AS clause_index, 'verdict_complete' AS event,
    'score_controls' AS stage, check_id, check_title, regulation, control_id, title AS control_title, compliant, source AS evidence_source,
    score::DOUBLE AS evidence_score, regulation_pass, regulation_fail FROM run JOIN (SELECT check_id, check_title FROM checks) USING (check_id)
  UNION ALL BY NAME SELECT doc_id, 1000000000 AS o1, 0 AS o2, 0 AS o3, NULL::INT AS clause_index, 'complete' AS event, 'finalize' AS stage,
    claims_generated, p AS pass_count, f AS fail_count, total_controls, overall_score,
    CASE WHEN overall_score >= 85 THEN 'A' WHEN overall_score >= 70 THEN 'B' WHEN overall_score >= 55 THEN 'C' WHEN overall_score >= 40 THEN 'D' ELSE 'F' END AS grade,
    CASE WHEN overall_score >= 85 THEN 'Compliant' WHEN overall_score >= 70 THEN 'Mostly Compliant' WHEN overall_score >= 55 THEN 'Needs Attention'
      ELSE 'High Compliance Risk' END AS status, model_signal FROM fin)
SELECT ev.* EXCLUDE (o1, o2, o3), clauses_total, (row_number() OVER (PARTITION BY doc_id ORDER BY o1, o2, o3) - 1)::INT AS seq
FROM ev JOIN sizes USING (doc_id)""",
    "stream_tallies": f"""{A._DOCS}, {_NO_GROUND}
SELECT regulation, count(*) FILTER (WHERE compliant) AS pass_count,
  count(*) FILTER (WHERE NOT compliant) AS fail_count FROM verdicts GROUP BY regulation""",
    "stream_window_tallies": """WITH w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type AS regulation,
  count(*) FILTER (WHERE value > 10) AS pass_count, count(*) FILTER (WHERE NOT value > 10) AS fail_count
FROM events GROUP BY 1, 2)
SELECT * FROM w WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""",
    "stream_score": f"""WITH {I.PART_CONTROLS}, {I.OBSERVATIONS}, o AS (
  SELECT l_returnflag AS scenario, l_linestatus AS level, l_orderkey || '-' || l_linenumber AS entity_id,
    'metric-' || l_partkey AS metric_id, l_quantity::INT AS total, least(l_quantity::INT, round(l_discount * 100)::INT) AS failed,
    round(l_tax * 100)::INT AS missing FROM lineitem),
s AS (SELECT o.*, control_id, (1 - failed::DOUBLE / greatest(total, 1)) * (1 - least(0.4::DOUBLE, 0.05::DOUBLE * missing))
  * 0.93713123::DOUBLE * confidence_weight AS adj FROM o JOIN specs USING (metric_id))
SELECT scenario, level, entity_id, metric_id, control_id, round(adj, 6) AS confidence_adjusted_score,
  {I.sql_band('(1 - adj)')} AS risk_band FROM s""",
}
