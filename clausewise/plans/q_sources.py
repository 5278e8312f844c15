"""Queries that write tables in the layouts the readers start from, and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.operators import classify, examples, practices, public, risk
from clausewise.operators.ordering import materialize
from clausewise.plans import inputs as I
from clausewise.plans import q_classify as C
from clausewise.plans.q_streams import _folder
from clausewise.sources import ledger, readers, writers
from clausewise.streaming import streams


def _field(c):
    """A CSV field in quotes."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def _lines(df, folder, *fields):
    """Lines of a hand-written CSV; null fields at the end are left out, so lines may be short."""
    df.select(F.concat_ws(",", *fields).alias("value")).write.text(folder)
    return folder


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


def jsonl_read(spark, sf):
    folder = _folder(spark)
    writers.write_jsonl(I.table(spark, sf, "documents").select("doc_id", "text", "source", "n_chars"), folder)
    d = readers.read_jsonl(spark, folder, "doc_id long, text string, source string, n_chars long")
    return d.select("doc_id", "source", "n_chars", F.md5("text").alias("text_md5"))


def csv_read(spark, sf):
    folder = _folder(spark)
    d = I.table(spark, sf, "documents")
    writers.write_csv(d.withColumn("text", F.concat(F.lit('"a", '), "text", F.lit('\n"z"'))), folder, ["source", "text", "doc_id"])
    return readers.read_csv_header(spark, folder).select("doc_id", "source", F.md5("text").alias("text_md5"))


def annotations_read(spark, sf):
    """Orders as annotation lines, one in seven with five fields only."""
    o = I.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    late = lambda c: F.when(k % 7 > 0, c)
    folder = _lines(o, _folder(spark), _field(k), F.lit("b"), F.concat(F.lit("ann"), k % 3), _field(F.col("o_custkey")), (k % 5).cast("string"),
                    late(_field(F.col("o_orderpriority"))), late(_field(F.concat(F.lit('{"x": "a,b", "n": '), k.cast("string"), F.lit("}")))),
                    late(F.lit("2/8/16")), late(F.when(k % 2 == 0, "").otherwise("http://x")))
    for_csv = folder + "-csv"
    spark.read.text(folder).write.option("compression", "none").format("text").save(for_csv)
    a = readers.read_annotations(spark, for_csv, min_fields=6, glob="*.txt")
    return a.select("annotation_id", "annotator", "policy_uid", "segment_id", "category", F.get_json_object("payload", "$.n").alias("n"),
                    F.coalesce("c8", F.lit("")).alias("c8"), "fields")


def site_meta_read(spark, sf):
    """Suppliers as sites with up to three sectors; one in four has four fields and is left out."""
    s = I.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    late = lambda c: F.when(k % 4 > 0, c)
    head = spark.createDataFrame([("id,url,name,policy,checked,a,b,sector",)], "value string")
    folder = _folder(spark)
    sectors = [F.when((k % 4 > 0) & (k % 3 >= i), F.concat(F.lit("sector "), (k + i).cast("string"))) for i in range(3)]
    lines = s.select(F.concat_ws(",", k.cast("string"), F.lit("http://x"), _field(F.col("s_name")), k.cast("string"), late(F.lit("2016-01-01")),
                                 late(F.lit("")), late(F.lit("y")), *sectors).alias("value"))
    head.coalesce(1).write.text(folder)
    lines.coalesce(1).write.mode("append").text(folder)
    both = folder + "-one"
    spark.read.text(folder).orderBy(~F.col("value").startswith("id,")).coalesce(1).write.text(both)
    r = readers.read_site_meta(spark, both)
    return r.select("policy_uid", "site_name", "site_check_date", F.array_join("sectors", "|").alias("sectors"))


def policy_meta_read(spark, sf):
    """Orders as dated versions of their customer's policy, in files in their order: the last
    line of the last file counts."""
    o = I.table(spark, sf, "orders")
    folder = _folder(spark)
    d = o.select(F.col("o_custkey").cast("string").alias("policy_uid"), F.concat(F.lit("u"), "o_orderkey").alias("policy_url"),
                 _day("o_orderdate").alias("collection_date"),
                 F.when(F.col("o_orderkey") % 3 > 0, _day("o_orderdate")).alias("last_updated_date"), "o_orderkey")
    d.orderBy("o_orderkey").drop("o_orderkey").write.csv(folder, header=True)
    return readers.read_policy_meta(spark, folder)


def public_read(spark, sf):
    """Orders as incident lines through the reader and the mapping."""
    o = I.table(spark, sf, "orders")
    path = _folder(spark) + ".jsonl"
    d = o.select(_day("o_orderdate").alias("incident_date"), F.col("o_orderpriority").alias("sector"),
                 (F.col("o_orderkey") % 1000).cast("string").alias("records"))
    writers.write_jsonl(d, path)
    m = public.map_public_rows(readers.read_public(spark, path), "i")
    return m.groupBy("event_date", "sector").agg(F.count(F.lit(1)).alias("rows"), F.sum("records_affected").cast("long").alias("records"))


def practice_docs_read(spark, sf):
    """Documents as nested practice documents; one in six is synthetic."""
    i = F.col("doc_id")
    sentence = F.array(F.struct(F.col("text").alias("sentence_text"), F.array(F.struct(
        F.when(i % 3 == 0, "Identifier_Cookie_or_similar_Tech_1stParty").when(i % 3 == 1, "Contact_E_Mail_1stParty").otherwise("unknown").alias("practice"),
        F.when(i % 5 == 0, "NOT_PERFORMED").otherwise("PERFORMED").alias("modality"))).alias("annotations")))
    d = I.table(spark, sf, "documents").select(
        i.cast("string").alias("policy_id"), F.lit("n").alias("policy_name"), F.col("source").alias("policy_type"),
        (i % 6 == 0).alias("contains_synthetic"),
        F.array(F.struct(F.lit(0).alias("segment_id"), F.lit("").alias("segment_text"), sentence.alias("sentences"))).alias("segments"))
    folder = _folder(spark)
    writers.write_jsonl(d, folder)
    s = practices.practice_sentences(readers.read_practice_docs(spark, folder))
    return practices.practice_examples(s).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def mixed_dir_read(spark, sf):
    """Documents as mixed clause files: JSON lines, and CSV files of two headers."""
    i, folder = F.col("doc_id"), _folder(spark)
    d = I.table(spark, sf, "documents").select(i, F.concat(F.lit("t"), i).alias("text"), F.when(i % 2 == 0, "Data Security").otherwise(
        "Opt out").alias("category"), F.col("source").alias("policy_uid"))
    d.where(i % 3 == 0).drop("doc_id").write.json(f"{folder}/a")
    d.where(i % 3 == 1).drop("doc_id").write.csv(f"{folder}/b", header=True)
    d.where(i % 3 == 2).select(F.col("text").alias("clause_text"), F.lit("user").alias("level")).write.csv(f"{folder}/c", header=True)
    rows = readers.read_mixed_clause_dir(spark, folder, jsonl="*.json")
    kept = examples.mixed_examples(rows, "mixed")
    return kept.select("text", "label", F.when(F.col("label") != "user", F.col("policy_uid")).alias("policy_uid"))


def by_regulation_read(spark, sf):
    """Parts by regulation; a second, smaller set replaces the first."""
    folder = _folder(spark)
    c = I.part_controls(spark, sf).select("regulation", "native_id", "text")
    writers.write_by_regulation(c, folder)
    writers.write_by_regulation(c.where("regulation <> 'GDPR'"), folder)
    return spark.read.parquet(folder).select("regulation", "native_id", "text")


def manifest_read(spark, sf):
    folder = _folder(spark)
    d = I.table(spark, sf, "documents")
    writers.write_manifest(d.agg(F.count(F.lit(1)).alias("rows"), F.max("doc_id").alias("last"), F.lit(None).cast("string").alias("note")), folder)
    r = spark.read.json(folder)
    return r.select("rows", "last", F.array_contains(F.array(*[F.lit(c) for c in r.columns]), "note").alias("keeps_nulls"))


def history_append(spark, sf):
    """Orders as finished runs: a stream appends them, starts again without its checkpoint,
    and a batch is tried twice more; each run is in the history once."""
    folder = _folder(spark)
    o = I.table(spark, sf, "orders").select(F.concat(F.lit("run-"), "o_orderkey").alias("name"), F.col("o_totalprice").alias("f1"))
    o.repartition(3).write.parquet(f"{folder}/in")
    live = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    for state in ("a", "b"):
        streams.stream_append_runs(live, f"{folder}/log", f"{folder}/{state}").awaitTermination()
    for _ in range(2):
        ledger.append_batch(o, f"{folder}/log", "runs", 1)
    return ledger.read_history(spark, f"{folder}/log", o.schema).select("name", "f1", "source")


def upserted_chunks(spark, sf):
    """Parts as chunks of a keyed table: changed, added, and the same batch once more."""
    folder = _folder(spark)
    k = F.col("p_partkey")
    p = I.table(spark, sf, "part").select(k.alias("k"), F.concat(F.lit("c"), k).alias("chunk_id"), F.col("p_name").alias("text"))
    table = ledger.BucketedTable(spark, folder, "chunk_id", 16)
    table.upsert(p.where("k % 4 > 0").drop("k"))
    changed = p.where("k % 5 = 0")
    batch = changed.select("chunk_id", F.concat(F.lit("old "), "text").alias("text"), F.lit(1).alias("seq")).unionByName(
        changed.select("chunk_id", F.concat(F.lit("new "), "text").alias("text"), F.lit(2).alias("seq")))
    for _ in range(2):
        table.upsert(batch, "chunks", 0)
    return ledger.BucketedTable(spark, folder).read().select(
        "chunk_id", "text", F.lit(table.manifest()["version"]).alias("version"))


def nb_model_read(spark, sf):
    """The naive Bayes tables written, read, and used."""
    folder = _folder(spark)
    C._model(spark, sf).write(folder)
    model = classify.NaiveBayesTables.read(spark, folder)
    return model.tokens.select("token", "total", *[F.col(f"c_{l}") for l in model.labels])


def priors_read(spark, sf):
    """Priors from a JSON object of label counts, one of them no number, under the posterior."""
    n = materialize(I.labeled_examples(spark, sf)).agg(
        F.count_if(F.col("label") == "user").alias("u"), F.count(F.lit(1)).alias("n"))
    folder = _folder(spark)
    n.select(F.format_string('{"user": {"alpha": %d, "beta": "%d"}, "system": {"alpha": "none", "beta": -1}, "other": {"alpha": 1}}',
                             "u", "n").alias("value")).coalesce(1).write.text(folder)
    p = risk.beta_posterior(C.predictions(spark, sf), risk.read_priors(spark, folder))
    return p.select("level", "prior_alpha", "prior_beta", "alpha", "beta", "mean", "evidence_count")


QUERIES = {f.__name__: f for f in (
    jsonl_read, csv_read, annotations_read, site_meta_read, policy_meta_read, public_read, practice_docs_read, mixed_dir_read,
    by_regulation_read, manifest_read, history_append, upserted_chunks, nb_model_read,
    priors_read)}

ORACLE = {
    "jsonl_read": "SELECT doc_id, source, n_chars, md5(text) AS text_md5 FROM documents",
    "csv_read": """SELECT doc_id::VARCHAR AS doc_id, source, md5('"a", ' || text || chr(10) || '"z"') AS text_md5 FROM documents""",
    "annotations_read": """SELECT o_orderkey::VARCHAR AS annotation_id, 'ann' || (o_orderkey % 3) AS annotator, o_custkey::VARCHAR AS policy_uid,
  (o_orderkey % 5)::VARCHAR AS segment_id, o_orderpriority AS category, o_orderkey::VARCHAR AS n,
  CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'http://x' END AS c8, 9 AS fields FROM orders WHERE o_orderkey % 7 > 0""",
    "site_meta_read": """SELECT s_suppkey::VARCHAR AS policy_uid, s_name AS site_name, '2016-01-01' AS site_check_date,
  array_to_string(['sector ' || (s_suppkey + i) FOR i IN range(s_suppkey % 3 + 1)], '|') AS sectors FROM supplier WHERE s_suppkey % 4 > 0""",
    "policy_meta_read": """SELECT o_custkey::VARCHAR AS policy_uid, 'u' || o_orderkey AS policy_url, o_orderdate::DATE::VARCHAR AS collection_date,
  CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE::VARCHAR END AS last_updated_date
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""",
    "public_read": """SELECT o_orderdate::DATE::VARCHAR AS event_date, o_orderpriority AS sector, count(*) AS rows, sum(o_orderkey % 1000)::BIGINT AS records
FROM orders GROUP BY ALL""",
    "practice_docs_read": """SELECT CASE doc_id % 3 WHEN 0 THEN 'system' ELSE 'organization' END AS label, count(*) AS rows FROM documents
WHERE doc_id % 6 <> 0 AND doc_id % 5 <> 0 AND doc_id % 3 < 2 AND trim(text) <> '' GROUP BY 1""",
    "mixed_dir_read": """SELECT 't' || doc_id AS text, CASE WHEN doc_id % 3 = 2 OR doc_id % 2 = 1 THEN 'user' ELSE 'system' END AS label,
  CASE WHEN doc_id % 3 < 2 AND doc_id % 2 = 0 THEN source END AS policy_uid FROM documents""",
    "by_regulation_read": f"WITH {I.PART_CONTROLS} SELECT regulation, native_id, text FROM part_controls WHERE regulation <> 'GDPR'",
    "manifest_read": "SELECT count(*) AS rows, max(doc_id) AS last, true AS keeps_nulls FROM documents",
    "history_append": "SELECT 'run-' || o_orderkey AS name, o_totalprice AS f1, 'runs' AS source FROM orders",
    "upserted_chunks": """SELECT 'c' || p_partkey AS chunk_id, CASE WHEN p_partkey % 5 = 0 THEN 'new ' ELSE '' END || p_name AS text, 2 AS version
FROM part WHERE p_partkey % 4 > 0 OR p_partkey % 5 = 0""",
}

ORACLE["nb_model_read"] = C.ORACLE["nb_model"]
_PRIORS = ", ".join(f"('{n}', {float(a)}::DOUBLE, {float(b)}::DOUBLE)" for n, (a, b) in lexicon.BETA_PRIORS.items())
ORACLE["priors_read"] = f"""{C._P}, e AS (SELECT count(*) FILTER (WHERE label = 'user')::DOUBLE AS u, count(*)::DOUBLE AS n FROM examples),
p AS (SELECT l AS level, CASE WHEN l = 'user' THEN u ELSE a END AS prior_alpha, CASE WHEN l = 'user' THEN n ELSE b END AS prior_beta
  FROM (VALUES {_PRIORS}) d(l, a, b), e),
s AS (SELECT predicted_label AS level, sum(confidence) AS c, count(*) AS evidence_count FROM predictions GROUP BY 1),
x AS (SELECT level, prior_alpha, prior_beta, prior_alpha + coalesce(c, 0) AS a, prior_beta + coalesce(evidence_count, 0) - coalesce(c, 0) AS b,
  coalesce(evidence_count, 0) AS evidence_count FROM p LEFT JOIN s USING (level))
SELECT level, prior_alpha, prior_beta, round(a, 6) AS alpha, round(b, 6) AS beta, round(a / (a + b), 6) AS mean, evidence_count FROM x"""
