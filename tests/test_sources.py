import json

import pytest
from pyspark.sql import functions as F

from clausewise.operators import annotations, examples, practices, public
from clausewise.sources import readers, writers


def put(path, body, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body.encode(encoding))
    return str(path)


def test_jsonl(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", '{"a": "é", "n": 1}\n\n{"a": "y", "n": 2}\n')
    df = readers.read_jsonl(spark, p, "a string, n int")
    assert df.count() == 2
    writers.write_jsonl(df, str(tmp_path / "out"))
    body = "".join(f.read_text() for f in (tmp_path / "out").glob("*.json"))
    assert "é" in body
    bad = put(tmp_path / "b.jsonl", '{"a": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, bad, "a string, n int").collect()


def test_annotated_policies(spark, tmp_path):
    put(tmp_path / "annotations" / "20_site.csv",
        '1,b,x,,0,Data Retention,"{""selectedText"": ""kept, long""}",http://u,2016-02-09\n'
        '2,b,x,9,1,,{},2/8/16,http://v\n3,b,x,9\n')
    put(tmp_path / "documentation" / "policies.csv",
        "uid,url,collected,updated\n20,,2016-02-08,2016-02-07\n,x,,\n20,http://last,2016-02-08,2016-02-07\n")
    put(tmp_path / "documentation" / "sites.csv",
        "a,b,c,d,e,f,g,h,i\n1,http://s,S,20,2016-01-01,y,n,Business: A,News\n")
    folder = readers.resolve_input_set(str(tmp_path), "annotations")
    rows = readers.read_annotations(spark, folder)
    assert rows.count() == 2 and rows.where("category = ''").count() == 1
    flat = annotations.policy_flat(
        annotations.annotation_rollup(rows),
        readers.read_policy_meta(spark, str(tmp_path / "documentation" / "policies.csv")),
        readers.read_site_meta(spark, str(tmp_path / "documentation" / "sites.csv")), "annotated")
    r = flat.collect()
    assert len(r) == 1 and r[0]["policy_uid"] == "20" and r[0]["sector"] == "Business"
    assert r[0]["event_date"] == "2016-02-08" and r[0]["detection_to_response_hours"] == 24.0
    assert r[0]["records_affected"] == 2 and r[0]["policy_url"] == "http://last"
    ex = examples.annotation_examples(rows, "annotated").collect()
    assert [e["text"] for e in ex] == ["kept, long"]
    with pytest.raises(ValueError):
        readers.resolve_input_set(str(tmp_path), "nope")


def test_mixed_directory(spark, tmp_path):
    put(tmp_path / "n" / "7_a.jsonl",
        '{"text": "t1", "category": "Data Security"}\n{"clause_text": "t2", "label": "User", "policy_uid": "p"}\n'
        '{"text": "t3", "category": "Weather"}\n{"text": "", "clause_text": "x", "label": "user"}\n')
    put(tmp_path / "n" / "b.csv", "text,category,policy_uid\nt4,Opt out,q\n")
    put(tmp_path / "n" / "sub" / "c.csv", "clause_text,level\nt5,system\n")
    rows = readers.read_mixed_clause_dir(spark, str(tmp_path / "n"))
    kept = examples.mixed_examples(rows, "mixed").collect()
    got = {r["text"]: (r["label"], r["policy_uid"]) for r in kept}
    assert got == {"t1": ("system", "7"), "t2": ("user", "p"), "t4": ("user", "q"), "t5": ("system", "c")}
    # Numbers go over the rows that are kept, JSON lines before CSV.
    assert {r["text"]: r["example_id"] for r in kept} == {
        "t1": "mixed::7::000000", "t2": "mixed::p::000001", "t4": "mixed::q::000002", "t5": "mixed::c::000003"}


def test_annotations_without_ids_are_numbered(spark, tmp_path):
    put(tmp_path / "x" / "9_site.csv", ",b,a,9,0,Data Security,{},u,d\nk7,b,a,9,1,Data Security,{},u,d\n"
        ",b,a,9,2,,{},u,d\n,b,a,9,3,Data Security,{},u,d\n")
    rows = readers.read_annotations(spark, str(tmp_path / "x"))
    ids = sorted(r["example_id"] for r in examples.annotation_examples(rows, "annotated").collect())
    assert ids == ["annotated::9::000000", "annotated::9::000002", "annotated::9::k7"]


def test_all_sectors_are_read(spark, tmp_path):
    p = put(tmp_path / "s.csv", "a,b,c,d,e,f,g,sector\n1,u,n,9,d,x,y," + ",".join(f"s{i}" for i in range(40)) + "\n")
    assert readers.read_site_meta(spark, p).first()["sectors"] == [f"s{i}" for i in range(40)]


def test_sites_need_five_fields(spark, tmp_path):
    p = put(tmp_path / "s.csv", "a,b,c,d,e,f,g,sector\n1,u,n,four\n1,u,n,five,\n1,\"u,v\",n,quoted\n1,u,n,eight,d,x,y,s\n1,u,n,nine,d,x,y,s,t\n")
    got = {r["policy_uid"]: r["sectors"] for r in readers.read_site_meta(spark, p).collect()}
    assert got == {"five": [], "eight": ["s"], "nine": ["s", "t"]}


def test_last_spec_of_a_metric_counts(spark):
    from clausewise.operators import metrics

    specs = spark.createDataFrame([("m", "first", 1.0, 0), ("m", "last", 0.5, 1)],
                                  "metric_id string, control_id string, confidence_weight double, seq int")
    seen = spark.createDataFrame([("s", "user", "e", "m", 10, 0, 0, 1.0)],
                                 "scenario string, level string, entity_id string, metric_id string, total_checks int, "
                                 "failure_count int, missing_fields int, observed_confidence double")
    got = metrics.score_observations(seen, specs).collect()
    assert [(r["control_id"], r["confidence_adjusted_score"]) for r in got] == [("last", 0.5)]


def test_labeled_and_public(spark, tmp_path):
    p = put(tmp_path / "l.jsonl", '{"text": " a ", "label": "USER", "extra": "1"}\n{"text": "", "label": "user"}\n'
            '{"text": "b", "label": "zzz"}\n')
    rows = readers.read_records(spark, p).withColumn("row_index", F.lit(0))
    got = examples.labeled_examples(rows, "l").collect()
    assert len(got) == 1 and got[0]["example_id"] == "manual::000000" and got[0]["metadata"] == {"extra": "1"}
    c = put(tmp_path / "i.csv", 'Date,Industry,records\n2020-01-01,Bank,"1,234"\n,,\n')
    m = public.map_public_rows(readers.read_public(spark, c), "i").orderBy("source_row_index").collect()
    assert m[0]["records_affected"] == 1234 and m[0]["dq_valid"] and not m[1]["dq_valid"]
    assert m[1]["dq_missing_required_fields"] == ["event_date", "sector", "records_affected"]
    with pytest.raises(FileNotFoundError):
        readers.read_public(spark, str(tmp_path / "none.csv"))
    assert readers.read_public(spark, None).count() == 0
    # The first alias present wins even when it is empty.
    j = put(tmp_path / "i.jsonl", '{"date": "", "incident_date": "2020-01-01", "sector": "s", "records": "3"}\n')
    assert readers.read_public(spark, f"file:{j}").count() == readers.read_public(spark, j).count() > 0
    one = public.map_public_rows(readers.read_public(spark, j), "i").first()
    assert one["event_date"] == "" and not one["dq_valid"]


def practice_doc(pid, synthetic, sentences):
    return {"policy_id": pid, "policy_name": "n", "policy_type": "t", "contains_synthetic": synthetic,
            "segments": [{"segment_id": 0, "segment_text": "", "sentences": [
                {"sentence_text": s, "annotations": [{"practice": p, "modality": m} for p, m in a]}
                for s, a in sentences]}]}


def test_practice_documents(spark, tmp_path):
    docs = [practice_doc(1, False, [
        ("We use cookies.", [("Identifier_Cookie_or_similar_Tech_1stParty", "PERFORMED")]),
        ("We collect mail.", [("Contact_E_Mail_1stParty", "PERFORMED")]),
        ("You may opt out.", [("Choice_opt_out", "PERFORMED")]),
        ("Both.", [("SSO", "PERFORMED"), ("Contact_x", "PERFORMED")]),
        ("Not done.", [("SSO", "NOT_PERFORMED")])]), practice_doc(2, True, [("S.", [("SSO", "PERFORMED")])])]
    p = put(tmp_path / "j" / "d.jsonl", "\n".join(map(json.dumps, docs)))
    put(tmp_path / "y" / "a.yml", json.dumps(docs[0]))  # JSON is YAML
    for source, seen in ((readers.read_practice_docs(spark, str(tmp_path / "j")), 2),
                         (readers.read_practice_docs(spark, str(tmp_path / "y")), 1)):
        kept = practices.practice_examples(practices.practice_sentences(source))
        assert sorted(r["label"] for r in kept.collect()) == ["organization", "system", "user"]
        stats = {(r["kind"], r["name"]): r["n"] for r in practices.practice_stats(source).collect()}
        assert stats[("policies", "seen")] == seen
        assert stats[("dropped", "ambiguous_multi_label_sentence")] == 1
        assert stats[("annotations", "not_performed_annotations")] == 1
    assert p


def test_any_encoding(spark, tmp_path):
    put(tmp_path / "t" / "a.txt", "grün")
    put(tmp_path / "t" / "b.txt", "grün!", "utf-16")
    put(tmp_path / "t" / "c.txt", "grün", "latin-1")
    put(tmp_path / "t" / "d.txt", "  \n")
    put(tmp_path / "t" / "e.txt", "ünn", "latin-1")
    got = {r["file_name"]: r["text"] for r in readers.read_text_any_encoding(spark, str(tmp_path / "t")).collect()}
    assert got["a.txt"] == "grün" and got["b.txt"] == "grün!" and got["e.txt"] == "ünn" and "d.txt" not in got
    assert "c.txt" in got  # four bytes also read as UTF-16, which comes first


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("GDPR", "c1", "x"), ("ISO", "c2", "y")], "regulation string, chunk_id string, text string")
    writers.write_csv(df, str(tmp_path / "c"), ["text", "chunk_id"])
    assert readers.read_csv_header(spark, str(tmp_path / "c")).columns == ["text", "chunk_id"]
    out = str(tmp_path / "r")
    writers.write_by_regulation(df, out)
    assert spark.read.parquet(out).count() == 2
    writers.write_by_regulation(df.where("regulation = 'ISO'"), out)
    assert [r["regulation"] for r in spark.read.parquet(out).collect()] == ["ISO"]
    batch = spark.createDataFrame([("GDPR", "c1", "new"), ("GDPR", "c3", "z")], df.schema)
    up = {r["chunk_id"]: r["text"] for r in writers.upsert(df, batch).collect()}
    assert up == {"c1": "new", "c2": "y", "c3": "z"}
    assert writers.replace_collection(df, batch).count() == 3
    log = str(tmp_path / "h")
    writers.append_history(df.limit(1), log)
    writers.append_history(df.limit(1), log)
    assert spark.read.json(log).count() == 2
    writers.write_manifest(df.agg(F.count(F.lit(1)).alias("rows")), str(tmp_path / "m"))
    assert len(list((tmp_path / "m").glob("*.json"))) == 1


def test_upsert_result_can_be_grouped_and_joined(spark):
    """Regression: equally partitioned union inputs must not yield a key twice."""
    d = spark.range(200).withColumnRenamed("id", "chunk_id").repartition(8, "chunk_id")
    target = d.where("chunk_id < 150").withColumn("text", F.lit("old"))
    batch = d.where("chunk_id >= 100").withColumn("text", F.lit("new"))
    up = writers.upsert(target, batch)
    per_key = up.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("rows"))
    out = d.join(per_key, "chunk_id").join(target.groupBy("chunk_id").count(), "chunk_id", "left")
    assert out.count() == 200 and out.select("rows").distinct().collect() == [(1,)]


def test_policy_versions_are_written_by_many_tasks(spark, monkeypatch):
    """The last line counts over several ordered files, none of which holds all lines."""
    from clausewise.plans import q_sources

    sf, seen = "/root/testdata/sf0.001", []
    read = q_sources.readers.read_policy_meta
    monkeypatch.setattr(q_sources.readers, "read_policy_meta", lambda s, folder: seen.append(folder) or read(s, folder))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["policy_uid"]: r["policy_url"] for r in q_sources.policy_meta_read(spark, sf).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last = spark.read.parquet(f"{sf}/orders.parquet").groupBy("o_custkey").agg({"o_orderkey": "max"}).collect()
    assert got == {str(r[0]): f"u{r[1]}" for r in last}
    assert spark.read.text(seen[0]).selectExpr("input_file_name()").distinct().count() > 1
