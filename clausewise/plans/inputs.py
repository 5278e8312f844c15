"""Inputs derived from the given tables, as DataFrames and as matching SQL.

The tables hold no privacy wording, so policy texts, schemas, controls and corpora
are built from them row by row: every row of the source table yields rows here, and
the original text is always kept whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise import lexicon


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_rows(rows) -> str:
    """VALUES rows; strings quoted, numbers and nulls as they are, lists as lists."""
    def one(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, str):
            return quote(v)
        if isinstance(v, (list, tuple)):
            return sql_list(v)
        return repr(v)
    return ", ".join("(" + ", ".join(one(v) for v in r) + ")" for r in rows)


def pick(values, n: Column) -> Column:
    return F.element_at(lexicon.strings(values), (n % len(values) + 1).cast("int"))


def sql_pick(values, n: str) -> str:
    return f"({sql_list(values)})[(({n}) % {len(values)})::INT + 1]"


def div(c: Column, n: int) -> Column:
    return F.floor(c / n).cast("bigint")


# --- policies and schemas --------------------------------------------------------

PHRASES = (
    "We ask for your consent before processing personal data and you may withdraw it, with clear notice.",
    "You can access your account, correct mistakes and delete your information at any time.",
    "All records are protected with encryption, access control and other security safeguards.",
    "We retain records for the retention period and archive them under a deletion schedule.",
    "We share data with a vendor or processor under contract, and never sell to a third party.",
    "Data is collected for the purpose of delivering the service and where necessary for legitimate interest.",
    "In case of a breach we notify the supervisory authority within 72 hours and send a notification.",
    "Contact our data protection officer or privacy team to file a complaint.",
    "Our bakery opens early on weekends and sells fresh rye bread.",
    "We obtain and record consent as lawful processing requires, by opt in or opt-out.",
    "You have the right to be forgotten, the right of erasure and data portability.",
    "Passwords are stored with strong encryption and multi-factor checks secure each login.",
    "Information is kept no longer than necessary, then we delete after the storage period ends.",
    "An affiliate may receive limited data; third-party sharing and disclosure rules apply.",
    "This page explains why we collect information and the documented purpose of each use.",
    "An incident that may compromise accounts triggers our response team and unauthorized access review.",
    "For questions contact us by post; records demonstrate compliance with our duties.",
    "We give transparent notice and inform people about data processing purposes and practices.",
    "Portability requests are answered in a machine-readable format without undue delay.",
    "Special category data such as health details is treated as sensitive at all times.",
    "We encrypt data in transit and safeguard devices for authorised individuals only.",
    "The football season starts in autumn and tickets are limited.",
    "Permission settings let you opt out of tracking whenever you like.",
    "Rectify wrong entries through the portal, where access requests are logged.",
    "Transfers to third parties rest on a documented basis for every vendor.",
    "Breach reports communicate a high risk to people without undue delay.",
    "Nothing here",
    "Retention schedule and disposal methods follow the minimisation policy.",
)
SCHEMAS = (
    "CREATE TABLE users (\n  id BIGINT,\n  email VARCHAR(255),\n  phone TEXT,\n  created_at TIMESTAMP\n);",
    "CREATE TABLE patients (\n  patient_id INT,\n  full_name TEXT,\n  health_status TEXT,\n  salary_amount DECIMAL,\n  PRIMARY KEY (patient_id)\n);",
    "CREATE TABLE \"metrics\" (\n  metric_key INT,\n  amount DOUBLE,\n  index_position INT,\n  CONSTRAINT pk UNIQUE (metric_key)\n);",
    "customer:\n  ssn: string\n  `bank_code`: string\n  zip: int",
    "{\"profile\": {\"first_name\": \"A\", \"contact\": {\"Email\": \"x\"}}, \"tags\": [{\"religion\": 1}]}",
    "CREATE TABLE orders (\n  order_id INT,\n  device_id TEXT,\n  total DOUBLE\n);\nCREATE TABLE visits (\n  ip_address TEXT,\n  seen_at TIMESTAMP\n);",
)


def policy_texts(d: DataFrame) -> DataFrame:
    """Each text, whole, followed by four policy phrases chosen by its id."""
    i = F.col("doc_id")
    a, b, c = pick(PHRASES, i), pick(PHRASES, div(i, 28)), pick(PHRASES, i * 5 + 3)
    return d.select("doc_id", F.concat(
        "text", F.lit("\n\n"), a, F.lit(" "), b, F.lit("\n"), c, F.lit("\r\n"), F.upper(b)
    ).alias("policy_text"))


def policy_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausewise.operators.ordering import spread

    return policy_texts(spread(
        table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"))


POLICY_DOCS = f"""policy_docs AS (
  SELECT doc_id, text || chr(10) || chr(10) || {sql_pick(PHRASES, 'doc_id')} || ' '
    || {sql_pick(PHRASES, 'doc_id // 28')} || chr(10) || {sql_pick(PHRASES, 'doc_id * 5 + 3')}
    || chr(13) || chr(10) || upper({sql_pick(PHRASES, 'doc_id // 28')}) AS policy_text
  FROM documents)"""


def schema_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", pick(SCHEMAS, F.col("doc_id") + div(F.col("doc_id"), 6)).alias(
        "schema_text"))


def sql_schema_text() -> str:
    opts = ", ".join(quote(s).replace("\n", "' || chr(10) || '") for s in SCHEMAS)
    return f"([{opts}])[((doc_id + doc_id // 6) % {len(SCHEMAS)})::INT + 1]"


SCHEMA_DOCS = f"schema_docs AS (SELECT doc_id, {sql_schema_text()} AS schema_text FROM documents)"


def sql_norm(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def sql_clauses(source: str, text_col: str, key: str = "doc_id", out: str = "clauses",
                fallback: bool = True) -> str:
    """CTEs giving ``out``(key, clause_index, clause) from a relation of texts."""
    tail = f"""
  UNION ALL SELECT {key}, 0, {sql_norm(text_col)} FROM {source}
  WHERE {sql_norm(text_col)} <> '' AND {key} NOT IN (SELECT {key} FROM {out}_kept)""" \
        if fallback else ""
    return f"""{out}_parts AS (
  SELECT {key}, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM (
    SELECT {key}, string_split(replace(regexp_replace(trim({text_col}, ' ' || chr(10) || chr(13) || chr(9)),
      '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(13), ''), chr(10)) AS p FROM {source})),
{out}_norm AS (SELECT {key}, pos, {sql_norm('piece')} AS clause FROM {out}_parts),
{out}_kept AS (
  SELECT * FROM {out}_norm WHERE length(clause) >= 24
  QUALIFY row_number() OVER (PARTITION BY {key}, lower(clause) ORDER BY pos) = 1),
{out} AS (
  SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1 AS clause_index, clause
  FROM {out}_kept{tail})"""


CLAUSES = sql_clauses("policy_docs", "policy_text")

CHECKS = ("checks(check_seq, check_id, check_title, weight, keywords) AS (VALUES "
          + sql_rows((i, c, t, w, list(k)) for i, (c, t, w, k) in enumerate(lexicon.CHECK_SPECS))
          + ")")
CONTROLS = ("builtin(seq, check_id, regulation, control_id, title, requirement) AS (VALUES "
            + sql_rows((i, *row) for i, row in enumerate(lexicon.REGULATION_CONTROLS)) + ")")
SIGNALS = ("signals(control_id, signals) AS (VALUES "
           + sql_rows((k, list(v)) for k, v in lexicon.CONTROL_SIGNALS.items()) + ")")


# --- controls, observations, incidents ---------------------------------------------

CONTROL_REGULATIONS = ("GDPR", "NISTPF", "ISO27001")


def part_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a control; some ids blank, some titles missing."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    reg = pick(CONTROL_REGULATIONS, k)
    native = F.concat(F.col("p_type"), F.lit(" "), k.cast("string"))
    return p.select(
        F.when(k % 97 == 5, F.lit("  ")).otherwise(
            F.concat(F.lower(reg), F.lit("::"), F.regexp_replace(native, "[^A-Za-z0-9._-]+", "_"))
        ).alias("normalized_id"),
        reg.alias("regulation"), native.alias("native_id"),
        F.when(k % 11 == 3, F.lit("")).otherwise(F.col("p_name")).alias("title"),
        pick(PHRASES, k + div(k, 28)).alias("text"),
        (F.col("p_size") / 40.0).alias("parser_confidence"),
        k.alias("partkey"),
    )


PART_CONTROLS = f"""part_controls AS (
  SELECT CASE WHEN p_partkey % 97 = 5 THEN '  ' ELSE lower(reg) || '::' ||
      regexp_replace(native_id, '[^A-Za-z0-9._-]+', '_', 'g') END AS normalized_id,
    reg AS regulation, native_id,
    CASE WHEN p_partkey % 11 = 3 THEN '' ELSE p_name END AS title,
    {sql_pick(PHRASES, 'p_partkey + p_partkey // 28')} AS text,
    p_size / 40.0::DOUBLE AS parser_confidence, p_partkey AS partkey
  FROM (SELECT *, {sql_pick(CONTROL_REGULATIONS, 'p_partkey')} AS reg,
    p_type || ' ' || p_partkey AS native_id FROM part))"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as checks: part = metric, return flag = scenario, line number = level."""
    l = table(spark, sf_dir, "lineitem")
    scenario = (F.when(F.col("l_returnflag") == "A", "stressed")
                .when(F.col("l_returnflag") == "N", "normal").otherwise("adversarial"))
    level = F.element_at(lexicon.strings(lexicon.LEVELS), F.col("l_linenumber") % 3 + 1)
    limit = (F.when(F.col("l_returnflag") == "A", 0.065)
             .when(F.col("l_returnflag") == "N", 0.085).otherwise(0.045))
    return (
        l.select("l_partkey", scenario.alias("scenario"), level.alias("level"),
                 (F.col("l_discount") > limit).alias("failed"),
                 (F.col("l_tax") < 0.005).alias("missing"))
        .groupBy("l_partkey", "scenario", "level")
        .agg(F.count(F.lit(1)).cast("int").alias("total_checks"),
             F.count_if("failed").cast("int").alias("failure_count"),
             F.count_if("missing").cast("int").alias("missing_fields"))
        .select(F.concat_ws("|", "l_partkey", "scenario", "level").alias("observation_id"),
                "scenario", "level", F.col("l_partkey").cast("string").alias("entity_id"),
                F.concat(F.lit("metric-"), F.col("l_partkey")).alias("metric_id"),
                "total_checks", "failure_count", "missing_fields",
                F.lit(0.93713123).alias("observed_confidence"))
    )


def observation_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs for the metrics of :func:`observations`; blank controls have none."""
    c = part_controls(spark, sf_dir).where(F.trim("normalized_id") != "")
    return c.select(F.concat(F.lit("metric-"), F.col("partkey")).alias("metric_id"),
                    F.col("normalized_id").alias("control_id"),
                    F.least(F.lit(1.0), F.greatest(F.lit(0.8), F.col("parser_confidence")))
                    .alias("confidence_weight"))


OBSERVATIONS = """observations AS (
  SELECT l_partkey || '|' || scenario || '|' || level AS observation_id, scenario, level,
    l_partkey::VARCHAR AS entity_id, 'metric-' || l_partkey AS metric_id,
    count(*) AS total_checks, sum(failed) AS failure_count, sum(missing) AS missing_fields,
    0.93713123::DOUBLE AS observed_confidence
  FROM (SELECT l_partkey,
      CASE l_returnflag WHEN 'A' THEN 'stressed' WHEN 'N' THEN 'normal' ELSE 'adversarial' END AS scenario,
      (['user', 'system', 'organization'])[l_linenumber % 3 + 1] AS level,
      (l_discount > CASE l_returnflag WHEN 'A' THEN 0.065 WHEN 'N' THEN 0.085 ELSE 0.045 END)::INT AS failed,
      (l_tax < 0.005)::INT AS missing
    FROM lineitem) GROUP BY l_partkey, scenario, level),
specs AS (
  SELECT 'metric-' || partkey AS metric_id, normalized_id AS control_id,
    least(1.0::DOUBLE, greatest(0.8::DOUBLE, parser_confidence)) AS confidence_weight
  FROM part_controls WHERE trim(normalized_id) <> '')"""

SCORED = """scored0 AS (
  SELECT o.*, s.control_id, 1.0::DOUBLE - failure_count::DOUBLE / greatest(total_checks, 1) AS raw_,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE,
      (1.0::DOUBLE - failure_count::DOUBLE / greatest(total_checks, 1))
      * (1.0::DOUBLE - least(0.4::DOUBLE, 0.05::DOUBLE * greatest(missing_fields, 0)))
      * observed_confidence * confidence_weight)) AS adjusted
  FROM observations o JOIN specs s USING (metric_id)),
scored AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - adjusted)) AS risk FROM scored0),
levels AS (
  SELECT scenario, level, count(*) AS sample_size, avg(adjusted) AS m,
    round(avg(adjusted), 6) AS compliance_score FROM scored GROUP BY ALL)"""


def sql_band(x: str) -> str:
    return (f"CASE WHEN {x} >= 0.67::DOUBLE THEN 'high' WHEN {x} >= 0.34::DOUBLE THEN 'medium' "
            "ELSE 'low' END")


def incident_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as an incident table with alias headers, blanks and odd numbers."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("order_key"),
        F.when(k % 7 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias(
            "Incident_Date"),
        F.when(k % 5 == 0, "US").otherwise("DE").alias("jurisdiction"),
        F.when(k % 13 == 0, F.lit(None).cast("string")).otherwise(
            F.lower("o_orderpriority")).alias("Industry"),
        F.when(k % 17 == 0, "n/a").when(k % 19 == 0, "1.5").otherwise(
            F.format_number(F.col("o_custkey") * 37, 0)).alias("impacted_records"),
        F.when(k % 23 == 0, "soon").otherwise(
            F.concat(F.lit(" "), (k % 96).cast("string"), F.lit(".5 "))).alias("response_hours"),
        F.col("o_orderstatus").alias("criticality"),
    )


INCIDENTS = """incidents AS (
  SELECT o_orderkey AS order_key,
    CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS event_date,
    CASE WHEN o_orderkey % 5 = 0 THEN 'US' ELSE 'DE' END AS country,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE lower(o_orderpriority) END AS sector,
    CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN NULL ELSE o_custkey * 37 END AS records_affected,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE (o_orderkey % 96)::DOUBLE + 0.5::DOUBLE END AS detection_to_response_hours,
    o_orderstatus AS severity FROM orders)"""


# --- ground-truth controls for assessment -------------------------------------------

GROUND_TRUTH_REGULATIONS = ("GDPR", "NIST", "ISO_27701", "CCPA", "")


def ground_truth_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as extra controls: own ids, repeats of built-in ids, a blank text."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        pick(GROUND_TRUTH_REGULATIONS, k).alias("regulation"),
        F.when(k == 0, "Article 6").when(k == 2, "A.7.3.6").otherwise(F.lit("")).alias("native_id"),
        F.concat(F.lit("ctl-"), k.cast("string")).alias("control_id"),
        F.when(k % 4 == 1, "").otherwise(F.col("n_name")).alias("title"),
        F.when(k == 7, "").otherwise(pick(PHRASES, k + 2)).alias("text"),
        k.alias("seq"),
    )


GROUND_TRUTH = f"""ground0 AS (
  SELECT n_nationkey AS k, {sql_pick(GROUND_TRUTH_REGULATIONS, 'n_nationkey')} AS reg,
    CASE n_nationkey WHEN 0 THEN 'Article 6' WHEN 2 THEN 'A.7.3.6' ELSE 'ctl-' || n_nationkey END AS cid,
    CASE WHEN n_nationkey % 4 = 1 THEN '' ELSE n_name END AS t,
    CASE WHEN n_nationkey = 7 THEN '' ELSE {sql_pick(PHRASES, 'n_nationkey + 2')} END AS req
  FROM nation),
ground AS (
  SELECT k, CASE WHEN reg = '' THEN 'UNKNOWN' ELSE reg END AS regulation, cid AS control_id,
    CASE WHEN t = '' THEN cid ELSE t END AS title, req AS requirement
  FROM ground0 WHERE req <> '')"""


# --- labelled clauses and predictions ------------------------------------------------

def labeled_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clause of every labelled document, three documents to a policy."""
    from clausewise.functions import text
    from clausewise.operators.ordering import spread

    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    l = table(spark, sf_dir, "labels")
    label = (F.when(F.col("toxic") == 1, "system").when(F.col("quality") == 0, "user")
             .otherwise("organization"))
    rows = d.join(l.select("doc_id", label.alias("label")), "doc_id")
    clause = text.explode_clauses(text.with_clauses(rows, "text", "clauses").drop("text"))
    return clause.select(
        F.format_string("%08d-%05d", "doc_id", "clause_index").alias("example_id"),
        F.col("clause").alias("text"), "label", "source",
        F.concat(F.lit("policy-"), F.lpad(div(F.col("doc_id"), 3).cast("string"), 8, "0"))
        .alias("policy_uid"),
        F.element_at(lexicon.strings(CATEGORIES),
                     F.pmod(F.col("doc_id") + F.col("clause_index"), F.lit(len(CATEGORIES)))
                     .cast("int") + 1).alias("category"))


CATEGORIES = (
    "User Choice/Control", "Data Security", "First Party Collection/Use", "Do Not Track",
    "Third Party Sharing/Collection", "Tracking Tools", "Data Retention", "user requests",
    "Cookies And Tracking", "Opt Out Links", "Weather", " ", "Policy Change", "Other",
)

EXAMPLES = f"""labeled AS (
  SELECT doc_id, text, source, CASE WHEN toxic = 1 THEN 'system' WHEN quality = 0 THEN 'user'
    ELSE 'organization' END AS label FROM documents JOIN labels USING (doc_id)),
{sql_clauses('labeled', 'text', out='lc')},
examples AS (
  SELECT lpad(doc_id::VARCHAR, 8, '0') || '-' || lpad(clause_index::VARCHAR, 5, '0') AS example_id,
    clause AS text, label, source, 'policy-' || lpad((doc_id // 3)::VARCHAR, 8, '0') AS policy_uid,
    {sql_pick(CATEGORIES, 'doc_id + clause_index')} AS category
  FROM lc JOIN (SELECT doc_id, label, source FROM labeled) USING (doc_id)),
label_counts AS (SELECT policy_uid, label, count(*) AS n, min(example_id) AS first FROM examples GROUP BY ALL),
dominant AS (SELECT policy_uid, label FROM label_counts
  QUALIFY row_number() OVER (PARTITION BY policy_uid ORDER BY n DESC, first) = 1),
ranked_p AS (SELECT policy_uid, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || policy_uid), policy_uid) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM dominant),
sized_p AS (SELECT *, greatest(1, floor(n * 0.8::DOUBLE)) AS tr,
  CASE WHEN n >= 3 THEN greatest(1, floor(n * 0.1::DOUBLE)) ELSE 0 END AS wish FROM ranked_p),
assigned AS (SELECT policy_uid, CASE WHEN r <= tr THEN 'train'
    WHEN r <= tr + CASE WHEN tr + wish >= n THEN greatest(0, n - tr - 1) ELSE wish END THEN 'validation'
    ELSE 'test' END AS split FROM sized_p),
split_examples AS (SELECT e.*, split FROM examples e JOIN assigned USING (policy_uid))"""

NB = """train_tokens AS (
  SELECT example_id, label, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS token
  FROM split_examples WHERE split = 'train'),
nb_tokens AS (
  SELECT token, count(*) AS total, count(*) FILTER (WHERE label = 'user') AS c_user,
    count(*) FILTER (WHERE label = 'system') AS c_system,
    count(*) FILTER (WHERE label = 'organization') AS c_organization FROM train_tokens GROUP BY token),
nb_classes AS (SELECT label, count(DISTINCT example_id) AS docs, count(*) AS tokens FROM train_tokens GROUP BY label),
nb_prior AS (
  SELECT label, ln((docs + 1.0::DOUBLE) / (sum(docs) OVER () + 3.0::DOUBLE)) AS prior,
    ln(tokens + 1.0::DOUBLE * (SELECT count(*) FROM nb_tokens)) AS denom FROM nb_classes)"""


def sql_predictions(relation: str, key: str, text_col: str, out: str) -> str:
    """Naive Bayes predictions for a relation of texts; needs NB's CTEs."""
    return f"""{out}_tok AS (
  SELECT {key}, unnest(regexp_extract_all(lower({text_col}), '[a-z0-9]{{2,}}')) AS token FROM {relation}),
{out}_sum AS (
  SELECT {key}, count(*) AS len, sum(ln(coalesce(c_user, 0) + 1.0::DOUBLE)) AS lu,
    sum(ln(coalesce(c_system, 0) + 1.0::DOUBLE)) AS ls, sum(ln(coalesce(c_organization, 0) + 1.0::DOUBLE)) AS lo
  FROM {out}_tok LEFT JOIN nb_tokens USING (token) GROUP BY ALL),
{out}_score AS (
  SELECT {key}, pu.prior + coalesce(lu - len * pu.denom, 0) AS su, ps.prior + coalesce(ls - len * ps.denom, 0) AS ss,
    po.prior + coalesce(lo - len * po.denom, 0) AS so
  FROM {relation} LEFT JOIN {out}_sum USING ({key}),
    (SELECT * FROM nb_prior WHERE label = 'user') pu, (SELECT * FROM nb_prior WHERE label = 'system') ps,
    (SELECT * FROM nb_prior WHERE label = 'organization') po),
{out}_exp AS (SELECT {key}, exp(su - greatest(su, ss, so)) AS eu, exp(ss - greatest(su, ss, so)) AS es,
  exp(so - greatest(su, ss, so)) AS eo FROM {out}_score),
{out} AS (
  SELECT {key}, eu / (eu + es + eo) AS pu, es / (eu + es + eo) AS ps, eo / (eu + es + eo) AS po,
    CASE WHEN eu >= es AND eu >= eo THEN 'user' WHEN es >= eo THEN 'system' ELSE 'organization' END AS predicted_label
  FROM {out}_exp)"""


PREDICTIONS = f"""{EXAMPLES}, {NB}, held_out AS (SELECT * FROM split_examples WHERE split <> 'train'),
{sql_predictions('held_out', 'example_id', 'text', 'raw_pred')},
predictions AS (
  SELECT h.example_id, policy_uid, split, label AS actual_label, predicted_label,
    round(CASE predicted_label WHEN 'user' THEN pu WHEN 'system' THEN ps ELSE po END, 6) AS confidence,
    round(pu, 6) AS p_user, round(ps, 6) AS p_system, round(po, 6) AS p_organization,
    round(pu, 6) / (round(pu, 6) + round(ps, 6) + round(po, 6)) AS q_user,
    round(ps, 6) / (round(pu, 6) + round(ps, 6) + round(po, 6)) AS q_system,
    round(po, 6) / (round(pu, 6) + round(ps, 6) + round(po, 6)) AS q_organization
  FROM held_out h JOIN raw_pred USING (example_id))"""
