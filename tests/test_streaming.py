from pyspark.sql import functions as F

from clausewise.functions import text
from clausewise.operators import assess
from clausewise.plans import inputs as I
from clausewise.sources import ledger
from clausewise.streaming import streams

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, folder, files=4):
    df.repartition(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def rows(df):
    cols = sorted(df.columns)
    return sorted(str(tuple(r)) for r in df.select(*cols).collect())


def test_stream_equals_batch(spark, tmp_path):
    docs = I.policy_docs(spark, SF)
    live = stream_of(spark, docs, str(tmp_path / "in"))
    got = streams.run_append(streams.stream_assess(live), str(tmp_path / "a"))
    assert rows(got) == rows(streams.stream_assess(docs))
    tallies = streams.run_complete(streams.stream_tallies(streams.stream_verdicts(live)), str(tmp_path / "t"))
    assert rows(tallies) == rows(streams.stream_tallies(streams.stream_verdicts(docs)))


def test_complete_documents_and_history(spark, tmp_path):
    docs = I.policy_docs(spark, SF)
    live = stream_of(spark, docs, str(tmp_path / "in"), 2)
    streams.complete_per_batch(live, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch").distinct().count() == 2
    assert rows(got.drop("batch")) == rows(assess.assess_policies(docs))
    runs = spark.createDataFrame([("r1", 0.5), ("r2", 0.6)], "name string, f1 double")
    live_runs = stream_of(spark, runs, str(tmp_path / "runs"), 2)
    streams.stream_append_runs(live_runs, str(tmp_path / "log"), str(tmp_path / "log_state")).awaitTermination()
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_late_rows_are_dropped_after_the_delay(spark, tmp_path):
    first = spark.createDataFrame([("2024-01-01 00:05:00", "A", True), ("2024-01-01 05:00:00", "A", False)],
                                  "t string, regulation string, compliant boolean")
    late = spark.createDataFrame([("2024-01-01 00:10:00", "A", True), ("2024-01-01 09:00:00", "A", True)], first.schema)
    base = str(tmp_path / "in")
    first.coalesce(1).write.parquet(base)
    live = spark.readStream.schema(first.schema).parquet(base).withColumn("ts", F.to_timestamp("t"))
    agg = streams.windowed_tallies(live, "ts", "1 hour", "10 minutes")
    streams.run_append(agg, str(tmp_path / "o"))
    late.coalesce(1).write.mode("append").parquet(base)
    got = streams.run_append(agg, str(tmp_path / "o")).collect()
    assert [(r["pass_count"], r["fail_count"]) for r in sorted(got, key=lambda r: r["window_start"])] == [(1, 0), (0, 1)]


def test_streams_of_a_table_in_many_files(spark, tmp_path):
    """A table may be a folder of files, or have none of its rows yet."""
    from clausewise.plans import q_streams

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 12")
    for name, table in (("one", docs.coalesce(1)), ("many", docs.repartition(3)), ("none", docs.limit(0))):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
    (tmp_path / "file").mkdir()
    part = next((tmp_path / "one" / "documents.parquet").glob("part-*.parquet"))
    part.rename(tmp_path / "file" / "documents.parquet")
    for query in (q_streams.stream_tallies, q_streams.stream_assess, q_streams.stream_events):
        got = rows(query(spark, str(tmp_path / "many")))
        assert got and got == rows(query(spark, str(tmp_path / "file")))
    assert rows(q_streams.stream_tallies(spark, str(tmp_path / "none"))) == []


def labelled(clauses):
    from clausewise.operators import classify
    from clausewise.plans.q_classify import _length_scorer

    return classify.score_with(clauses, _length_scorer, ["doc_id", "clauses_total", "clause_index", "clause"], "clause").drop("probabilities")


def test_events_keep_state_over_batches(spark, tmp_path):
    """Clauses of a document in four batches, out of order; the events are those of the whole."""
    docs = I.policy_docs(spark, SF).where("doc_id < 12").unionByName(
        spark.createDataFrame([(900, ""), (901, "Too short")], "doc_id long, policy_text string"))
    d = text.with_clauses(docs, "policy_text", "_c").drop("policy_text")
    clauses = d.select("doc_id", F.size("_c").alias("clauses_total"), F.posexplode_outer("_c").alias("clause_index", "clause"))
    turned = clauses.withColumn("turn", F.pmod(F.coalesce("clause_index", F.lit(0)) * 7 + 3, F.lit(4)))
    for i in range(4):
        turned.where(F.col("turn") == i).drop("turn").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(clauses.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    whole = stream_of(spark, docs, str(tmp_path / "whole"), 1)
    with streams.with_state_store(spark):
        parts = streams.run_append(streams.stream_clause_events(live, labelled), str(tmp_path / "a"))
        once = streams.run_append(streams.stream_events(whole, labelled), str(tmp_path / "b"))
    assert rows(parts) == rows(once)
    by_doc = {}
    for r in parts.orderBy("doc_id", "seq").collect():
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert set(by_doc) == {r[0] for r in docs.select("doc_id").collect()}
    verdicts = {(r["doc_id"], r["clause_index"], r["check_id"], r["rank"]): r["compliant"]
                for r in assess.verdict_rows(assess.claim_verdicts(docs)).collect()}
    assert sum(r["event"] == "verdict_complete" for x in by_doc.values() for r in x) == len(verdicts) > 0
    reports = {r["doc_id"]: r for r in assess.assess_policies(docs).collect()}
    for doc, events in by_doc.items():
        assert [r["seq"] for r in events] == list(range(len(events)))
        assert [events[0]["event"], events[-1]["event"]] == ["start", "complete"]
        done = events[-1]
        for a, b in (("overall_score", "overall_score"), ("pass_count", "pass_count"), ("fail_count", "fail_count"),
                     ("claims_generated", "claims_generated"), ("clauses_total", "clauses_analyzed"), ("grade", "grade"),
                     ("status", "status"), ("total_controls", "total_controls")):
            assert done[a] == reports[doc][b], (doc, a)
        tally = {}
        for r in events:
            if r["event"] == "verdict_complete":
                t = tally.setdefault(r["regulation"], [0, 0])
                t[0 if r["compliant"] else 1] += 1
                assert [r["regulation_pass"], r["regulation_fail"]] == t
    assert [r["event"] for r in by_doc[900]] == ["start", "complete"]


def test_state_takes_a_row_for_each_check_not_for_each_event(spark):
    """Events reach the state as texts: a clause's rows are as many as its checks, one at least."""
    docs = I.policy_docs(spark, SF).where("doc_id < 12")
    clauses = assess.every_clause(docs)
    made = streams.clause_events(clauses, labelled)
    n_checks = assess.claims(docs).groupBy("doc_id", "clause_index").count()
    want = clauses.join(n_checks, ["doc_id", "clause_index"], "left").agg(F.sum(F.coalesce("count", F.lit(1)))).first()[0]
    got = made.agg(F.count(F.lit(1)), F.sum("events"), F.sum("claims"), F.count("label")).first()
    assert got[0] == want < got[1] and got[2] == assess.claims(docs).count() and got[3] == clauses.count()


def test_replayed_batches_change_nothing(spark, tmp_path):
    runs = spark.createDataFrame([(f"r{i}", i / 10) for i in range(6)], "name string, f1 double")
    live = stream_of(spark, runs, str(tmp_path / "runs"), 3)
    log = str(tmp_path / "log")
    streams.stream_append_runs(live, log, str(tmp_path / "s1")).awaitTermination()
    before = rows(ledger.read_history(spark, log, runs.schema))
    assert [r for r in before] == rows(runs.withColumns({"source": F.lit("runs"), "batch": F.lit(0)}).drop("batch").join(
        ledger.read_history(spark, log, runs.schema).select("name", "batch"), "name"))
    # The same stream from the start again: its checkpoint was lost, the ledger was not.
    streams.stream_append_runs(live, log, str(tmp_path / "s2")).awaitTermination()
    assert not ledger.append_batch(runs, log, "runs", 1)
    # An attempt that wrote its files and died before its entry.
    runs.write.json(f"{log}/source=runs/batch=7/attempt=dead")
    assert rows(ledger.read_history(spark, log, runs.schema)) == before
    assert ledger.append_batch(runs, log, "other", 1)
    assert ledger.read_history(spark, log, runs.schema).count() == 12


def test_upserts_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    table = ledger.BucketedTable(spark, path, "chunk_id", 16)
    first = spark.range(400).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("old").alias("text"))
    assert table.upsert(first)
    before = table.manifest()
    batch = spark.createDataFrame([("c7", "new", 1), ("c7", "newer", 2), ("x1", "added", 1)], "chunk_id string, text string, seq int")
    assert table.upsert(batch, "chunks", 3) and not table.upsert(batch, "chunks", 3) and not table.upsert(batch, "chunks", 2)
    after = table.manifest()
    changed = [b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)]
    assert 1 <= len(changed) <= 2 and after["version"] == before["version"] + 1
    got = {r["chunk_id"]: r["text"] for r in ledger.BucketedTable(spark, path).read().collect()}
    assert len(got) == 401 and got["c7"] == "newer" and got["x1"] == "added" and got["c8"] == "old"
    # A second writer's manifest took the number: the upsert starts again from it.
    real, taken = table.manifest, []

    def stale():
        if not taken:
            taken.append(1)
            return before
        return real()
    table.manifest = stale
    assert table.upsert(spark.createDataFrame([("c9", "late")], "chunk_id string, text string"))
    got = {r["chunk_id"]: r["text"] for r in ledger.BucketedTable(spark, path).read().collect()}
    assert got["c9"] == "late" and got["c7"] == "newer" and len(got) == 401


def test_stream_of_upserts(spark, tmp_path):
    rows_in = spark.range(90).select((F.col("id") % 30).cast("string").alias("chunk_id"), F.col("id").alias("v"))
    live = stream_of(spark, rows_in.where("v < 30"), str(tmp_path / "in"), 2)
    table = ledger.BucketedTable(spark, str(tmp_path / "t"), "chunk_id", 4)
    for state in ("a", "b"):  # the second time from a lost checkpoint
        streams.stream_upsert(live, table, str(tmp_path / state)).awaitTermination()
        assert table.read().count() == 30
    assert table.manifest()["version"] == 2
