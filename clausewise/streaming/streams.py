"""Structured Streaming forms: assessment events, tallies, run history, scoring."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from clausewise import lexicon
from clausewise.functions import scoring, text
from clausewise.operators import assess, metrics
from clausewise.sources.ledger import BucketedTable, append_batch
from clausewise.operators.ordering import guard_unions


def stream_verdicts(docs: DataFrame, regulations=None, text_col: str = "policy_text",
                    key: str = "doc_id") -> DataFrame:
    """Verdict rows of arriving documents. Stateless: all work is inside the row."""
    rows = assess.claim_verdicts(docs, None, regulations, text_col=text_col, key=key)
    return assess.verdict_rows(rows, key)


def stream_assess(docs: DataFrame, regulations=None, text_col: str = "policy_text",
                  key: str = "doc_id", note_chars: int = 140) -> DataFrame:
    """Event rows per document: clause_start, check_match, verdict_complete.

    A start carries its whole clause and, as its note, the first ``note_chars`` of it.
    Runs on a stream or a table. ``complete`` needs a whole document's verdicts; see
    :func:`complete_per_batch`.
    """
    clauses = text.explode_clauses(text.with_clauses(
        docs.select(key, text_col), text_col, "clauses").drop(text_col))
    claims = assess.with_verdicts(assess.rank_evidence(
        assess.claims_of_clauses(clauses, key), None, regulations, key=key))
    blank = F.lit(None).cast("string")
    starts = clauses.select(
        key, "clause_index", F.lit(-1).alias("check_seq"), F.lit(0).alias("rank"),
        F.lit("clause_start").alias("event"), F.lit("read_claim").alias("stage"),
        blank.alias("regulation"), blank.alias("control_id"),
        F.lit(None).cast("boolean").alias("compliant"),
        F.substring("clause", 1, note_chars).alias("note"), "clause")
    checked = F.array(F.struct(
        F.lit("check_match").alias("event"), F.lit("match_checks").alias("stage"),
        blank.alias("regulation"), blank.alias("control_id"),
        F.lit(None).cast("boolean").alias("compliant"),
        F.concat_ws("|", "matched").alias("note")))
    judged = F.transform("verdicts", lambda v: F.struct(
        F.lit("verdict_complete").alias("event"), F.lit("score_controls").alias("stage"),
        v["regulation"].alias("regulation"), v["control_id"].alias("control_id"),
        v["compliant"].alias("compliant"), v["source"].alias("note")))
    events = text.unfold(claims.select(key, "clause_index", "check_seq",
                                       F.concat(checked, judged).alias("_e")), "_e", "rank", "e")
    return starts.transform(guard_unions).unionByName(
        events.select(key, "clause_index", "check_seq", "rank", "e.*", blank.alias("clause")))


# --- events with state ---------------------------------------------------------------

_EVENT = ("event string, stage string, check_id string, check_title string, regulation string, control_id string, "
          "control_title string, compliant boolean, evidence_source string, evidence_score double, predicted_label string, "
          "confidence double, note string")
_TALLIES = "map<string,array<int>>"
#: What the state gives out: events of one row under the number of the first, with the passes
#: and fails per regulation before it; the last row of a document has its totals.
_GIVEN = ("seq int, clauses_total int, clause_index int, body string, before string, claims_generated int, pass_count int, "
          "fail_count int, total_controls int, labels_represented int, avg_confidence double")


def clause_events(clauses: DataFrame, classify: Callable[[DataFrame], DataFrame] | None = None, extra_controls=None,
                  regulations=None, key: str = "doc_id", specs=lexicon.CHECK_SPECS, note_chars: int = 140) -> DataFrame:
    """Unnumbered events of clauses: a clause's start, its label, its checks and verdicts.

    ``clauses``: key, clauses_total, clause_index (null: a document without clauses) and
    clause. ``classify`` adds predicted_label and confidence to them. Events are made in
    their clause's rows, so streams and tables are read once: a row for each matched check
    (``nth``, one row at least) has its events as one JSON text (``body``), how many they are,
    and what they add up to: claims, label, passes and fails of regulations (``tally``).
    """
    clauses = clauses.withColumn("clause", F.coalesce("clause", F.lit("")))
    c = classify(clauses) if classify else clauses.withColumns(
        {"predicted_label": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    rows = assess.claims_outer(c, specs)
    rows = assess.with_verdicts(assess.rank_evidence(rows, extra_controls, regulations, key=key))
    types = {f.name: f.dataType for f in _schema(_EVENT).fields}
    nothing = F.array().cast("array<struct<" + ",".join(f"{f}:{t.simpleString()}" for f, t in types.items()) + ">>")

    def event(name, stage, **fields):
        have = {"event": F.lit(name), "stage": F.lit(stage), **fields}
        return F.struct(*[have.get(f, F.lit(None)).cast(t).alias(f) for f, t in types.items()])

    opened = [event("clause_start", "read_claim", note=F.substring("clause", 1, note_chars))]
    if classify:
        opened.append(event("classification_complete", "classify_claim", predicted_label=F.col("predicted_label"),
                            confidence=F.round("confidence", 6)))
    # A clause is opened with its first check, or without any.
    first = (F.when(F.col("clause_index").isNull(), F.array(event("no_clauses", "read_claim")))
             .when(F.coalesce("_nth", F.lit(0)) > 0, nothing).otherwise(F.array(*opened)))
    checked = F.when(F.col("check_id").isNotNull(), F.array(event(
        "check_match", "match_checks", check_id=F.col("check_id"), check_title=F.col("check_title"),
        note=F.concat_ws("|", "matched")))).otherwise(nothing)
    judged = F.transform("verdicts", lambda v: event(
        "verdict_complete", "score_controls", check_id=F.col("check_id"), check_title=F.col("check_title"),
        regulation=v["regulation"], control_id=v["control_id"], control_title=v["control_title"], compliant=v["compliant"],
        evidence_source=v["source"], evidence_score=F.round(v["score"], 6)))
    met = F.array_distinct(F.transform("verdicts", lambda v: v["regulation"]))
    tally = F.map_from_arrays(met, F.transform(met, lambda r: F.array(*[F.size(F.filter(
        "verdicts", lambda v: (v["regulation"] == r) & (v["compliant"] == F.lit(ok)))) for ok in (True, False)])))
    labelled = F.coalesce("_nth", F.lit(0)) == 0 if classify else F.lit(False)
    out = rows.withColumn("_e", F.concat(first, checked, judged))
    return out.select(
        key, F.col("clauses_total").cast("int").alias("clauses_total"), F.col("clause_index").cast("int").alias("clause_index"),
        F.coalesce("_nth", F.lit(0)).alias("nth"), F.to_json("_e").alias("body"), F.size("_e").alias("events"),
        F.col("check_id").isNotNull().cast("int").alias("claims"), F.when(labelled, F.col("predicted_label")).alias("label"),
        F.when(labelled, F.round("confidence", 6)).alias("confidence"),
        F.when(F.size("verdicts") > 0, F.to_json(tally)).alias("tally"))


def _schema(ddl: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(ddl)


def _ddl(fields: str) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _schema(fields).fields)


class AssessmentState(StatefulProcessor):
    """What a document's assessment has come to, while its clauses arrive.

    One value per document: the next clause, events and claims so far, passes and fails per
    regulation, labels, and clauses that came before their turn. It is gone once the last
    clause has been judged; a document that arrives whole never writes it.
    """

    def __init__(self, key: str, totals: dict[str, int], provider: str = "local"):
        self.totals, self.provider = totals, provider
        self.row = Row(key, *_schema(_GIVEN).names)

    def init(self, handle) -> None:
        self.state = handle.getValueState("assessment", "body string")

    def handleInputRows(self, key, rows, timers):
        kept = self.state.get()
        s = json.loads(kept[0]) if kept else {
            "next": 0, "seq": 0, "claims": 0, "tally": {}, "labels": [], "sum": 0.0, "n": 0, "held": {}}
        total = 0
        for r in rows:
            total = r["clauses_total"]
            index = r["clause_index"]
            s["held"].setdefault(str(index or 0), []).append([
                r["nth"], index, r["body"], r["events"], r["claims"], r["label"], r["confidence"], r["tally"]])
        if not s["seq"]:
            yield self._given(key, s, total, None, [{"event": "start", "stage": "read_claim", "evidence_source": self.provider,
                                                     "note": "|".join(sorted(self.totals))}])
        while str(s["next"]) in s["held"]:
            for _, index, body, events, claims, label, confidence, tally in sorted(
                    s["held"].pop(str(s["next"])), key=lambda x: x[0]):
                if index is None:  # a document without clauses
                    continue
                before = json.dumps(s["tally"]) if tally else None
                yield self._given(key, s, total, index, body, events, before)
                s["claims"] += claims
                if label is not None:
                    s["labels"] = sorted({*s["labels"], label})
                    s["sum"], s["n"] = s["sum"] + confidence, s["n"] + 1
                for name, (passed, failed) in (json.loads(tally) if tally else {}).items():
                    so_far = s["tally"].get(name, [0, 0])
                    s["tally"][name] = [so_far[0] + passed, so_far[1] + failed]
            s["next"] += 1
        if s["next"] >= max(total, 1):
            passed, failed = (sum(t[i] for t in s["tally"].values()) for i in (0, 1))
            yield self._given(key, s, total, None, [{"event": "complete", "stage": "finalize"}], 1, None, s["claims"], passed, failed,
                              sum(self.totals.values()), *((len(s["labels"]), s["sum"] / s["n"]) if s["n"] else (None, None)))
            if kept:
                self.state.clear()
        else:
            self.state.update((json.dumps(s),))

    def close(self) -> None:
        pass

    def _given(self, key, s, total, index, body, events=1, before=None, *sums):
        first, s["seq"] = s["seq"], s["seq"] + events
        return self.row(key[0], first, total, index, body if isinstance(body, str) else json.dumps(body), before,
                        *(sums or [None] * 6))


def stream_events(docs: DataFrame, classify=None, extra_controls=None, regulations=None, text_col: str = "policy_text",
                  key: str = "doc_id", specs=lexicon.CHECK_SPECS) -> DataFrame:
    """All events of arriving documents, in order: start, clause_start, classification_complete,
    check_match, verdict_complete with running passes and fails, complete with the score."""
    clauses = assess.every_clause(docs, text_col, key)
    return stream_clause_events(clauses, classify, extra_controls, regulations, key, specs)


def stream_clause_events(clauses: DataFrame, classify=None, extra_controls=None, regulations=None,
                         key: str = "doc_id", specs=lexicon.CHECK_SPECS) -> DataFrame:
    """The same for clauses (key, clauses_total, clause_index, clause) that may arrive in any
    order and over many batches; a document's events wait for its next clause.

    Needs a state store with column families (``with_state_store``).
    """
    spark = clauses.sparkSession
    # A row per regulation; their number is that of the regulations, not of the data.
    totals = {r["regulation"]: r["total_controls"] for r in
              assess.control_totals(spark, extra_controls, regulations).collect()}
    events = clause_events(clauses, classify, extra_controls, regulations, key, specs)
    schema = f"`{key}` {clauses.schema[key].dataType.simpleString()}, {_GIVEN}"
    given = events.groupBy(key).transformWithState(
        AssessmentState(key, totals), outputStructType=schema, outputMode="Append", timeMode="None")
    # Events are read back from their texts once they have their numbers.
    made = F.from_json("body", f"array<struct<{_ddl(_EVENT)}>>")
    rows = given.withColumns({"_made": made, "_before": F.from_json("before", _TALLIES)})
    so_far = lambda i, ok: F.when(F.col("_v.event") == "verdict_complete", F.coalesce(
        F.get(F.try_element_at("_before", F.col("_v.regulation")), F.lit(i)), F.lit(0)) + F.size(F.filter(
            F.slice("_made", 1, F.col("_pos") + 1), lambda e: (e["regulation"] == F.col("_v.regulation")) & (e["compliant"] == F.lit(ok)))))
    flat = rows.select("*", F.posexplode("_made").alias("_pos", "_v"))
    counted = flat.select(
        key, (F.col("seq") + F.col("_pos")).alias("seq"), "clauses_total", "clause_index", "_v.*", so_far(0, True).alias("regulation_pass"),
        so_far(1, False).alias("regulation_fail"), "claims_generated", "pass_count", "fail_count", "total_controls",
        "labels_represented", "avg_confidence")
    done = F.col("event") == "complete"
    raw = F.when(F.col("total_controls") > 0, F.col("pass_count") / F.col("total_controls") * 100).otherwise(0.0)
    signal = F.round(F.least(F.lit(3.0), F.col("labels_represented"))
                     + F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.col("avg_confidence") * 2.0)), 2)
    scored = counted.withColumn("overall_score", F.when(done, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 2)))))
    return scored.withColumns({"grade": F.when(done, scoring.grade("overall_score")),
                               "status": F.when(done, scoring.status("overall_score")),
                               "model_signal": F.when(done, signal)}).drop("labels_represented", "avg_confidence")


class with_state_store:
    """For the time of a stream's run, the state store that operators with state need."""

    SETTING = "spark.sql.streaming.stateStore.providerClass"
    STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(self.SETTING, None)
        self.conf.set(self.SETTING, self.STORE)

    def __exit__(self, *_):
        self.conf.set(self.SETTING, self.before) if self.before else self.conf.unset(self.SETTING)


def complete_per_batch(docs: DataFrame, path: str, checkpoint: str, extra_controls=None,
                       regulations=None, **options):
    """Document scores of a stream, appended batch by batch.

    A document arrives whole in one row, so a micro-batch is assessed like a table.
    """
    def assess_batch(batch: DataFrame, _id: int) -> None:
        out = assess.assess_policies(batch, extra_controls, regulations)
        out.withColumn("batch", F.lit(_id)).write.mode("append").parquet(path)

    return docs.writeStream.foreachBatch(assess_batch).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_tallies(verdicts: DataFrame) -> DataFrame:
    """Passes and fails so far per regulation (complete or update mode)."""
    return verdicts.groupBy("regulation").agg(
        F.count_if("compliant").alias("pass_count"),
        F.count_if(~F.col("compliant")).alias("fail_count"))


def windowed_tallies(events: DataFrame, time: str, width: str, delay: str) -> DataFrame:
    """The same per time window; append mode emits a window once it is past the delay."""
    return (events.withWatermark(time, delay).groupBy(F.window(time, width), "regulation")
            .agg(F.count_if("compliant").alias("pass_count"),
                 F.count_if(~F.col("compliant")).alias("fail_count"))
            .select(F.col("window.start").alias("window_start"), "regulation", "pass_count",
                    "fail_count"))


def stream_score(observations: DataFrame, specs: DataFrame) -> DataFrame:
    """Arriving observations against static specs (stream-static join)."""
    return metrics.score_observations(observations, specs).drop("_adjusted")


def stream_append_runs(runs: DataFrame, path: str, checkpoint: str, source: str = "runs"):
    """Each finished run appended to the history once, however often its batch is tried."""
    return runs.writeStream.foreachBatch(lambda batch, number: append_batch(batch, path, source, number)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_upsert(rows: DataFrame, table: BucketedTable, checkpoint: str, source: str = "chunks"):
    """Arriving rows into a keyed table, each batch once."""
    return rows.writeStream.foreachBatch(lambda batch, number: table.upsert(batch, source, number)).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_append(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream to the end of its input into files, and read them back."""
    q = (stream.writeStream.format("parquet").outputMode("append")
         .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def run_complete(stream: DataFrame, folder: str) -> DataFrame:
    """The same for an aggregate: the last full result is kept, one folder per batch.

    Before the first batch the result is empty, and stays so without any input.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(-1)).write.parquet(f"{folder}/out/b=-1")
    q = (stream.writeStream.outputMode("complete")
         .foreachBatch(lambda b, i: b.withColumn("_batch", F.lit(i)).write.mode("overwrite")
                       .parquet(f"{folder}/out/b={i}"))
         .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(f"{folder}/out")
    last = out.agg(F.max("_batch").alias("m"))
    return out.where(F.col("_batch") == last.scalar()).drop("_batch", "b")
