"""Policies against a control lexicon: claims, ranked evidence, verdicts, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.functions import records, scoring, text
from clausewise.operators.checks import matched_checks
from clausewise.operators.ordering import guard_unions, lookup_skew_safe, materialize, top_k

# Controls that a claim's row meets at a time; more are dealt to several blocks.
CONTROL_BLOCK = 512
# Characters of all blocks up to which they are sent to every task.
BROADCAST_CHARS = 16_000_000


# --- controls -------------------------------------------------------------------

def _signals(control_id: Column) -> Column:
    pairs = []
    for k, v in lexicon.CONTROL_SIGNALS.items():
        pairs += [F.lit(k), lexicon.strings(v)]
    table = F.create_map(*pairs)
    return F.coalesce(F.try_element_at(table, control_id), F.array().cast("array<string>"))


def prepare_controls(rows: DataFrame, regulations=None) -> DataFrame:
    """External controls (loosely named columns) as evidence candidates.

    A column ``seq`` of whole numbers is the order of the source, which decides between
    equals; without one their content does.
    """
    wanted = {f.lower() for f in ("native_id", "control_id", "normalized_id", "title",
                                  "text", "requirement", "regulation")}
    have = {c.lower() for c in rows.columns}
    for name in wanted - have:
        rows = rows.withColumn(name, F.lit(None).cast("string"))
    picked = records.control_fields()
    out = rows.select(*[c.alias(n) for n, c in picked.items()], _source_order(rows).alias("seq")).where(
        F.col("requirement") != "")
    out = filter_regulations(out, regulations)
    return out.select(
        "*", F.lower("requirement").alias("req_low"),
        text.evidence_tokens(F.concat_ws(" ", "control_id", "title", "requirement")).alias(
            "tokens"),
        _signals(F.col("control_id")).alias("signals"),
        F.lit("ground_truth").alias("source"))


def _source_order(rows: DataFrame) -> Column:
    """Place of an external control among equals, behind the built-in ones."""
    if "seq" in rows.columns:
        return F.col("seq").cast("bigint") + 1_000_000
    return F.lit(1_000_000).cast("bigint")


def find_words(df: DataFrame, words: list[str], text_col: str = "req_low", out: str = "words") -> DataFrame:
    """Add ``out``: the words that occur anywhere in the text, found in one pass over it by
    an automaton of all words, however many there are."""
    from pyspark.sql import types as T

    words = sorted(set(words))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.StringType()))])

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            found = [sorted({w for _, w in automaton.iter(t)}) if t and words else []
                     for t in batch.column(text_col).to_pylist()]
            yield batch.append_column(out, pa.array(found, pa.list_(pa.string())))

    return df.mapInArrow(run, schema)


def filter_regulations(df: DataFrame, regulations=None) -> DataFrame:
    """Keep the selected regulations; an empty selection keeps everything."""
    chosen = [r.strip() for r in (regulations or []) if r.strip()]
    return df.where(F.col("regulation").isin(chosen)) if chosen else df


def builtin_controls(spark, regulations=None, controls=lexicon.REGULATION_CONTROLS) -> DataFrame:
    return filter_regulations(lexicon.control_table(spark, controls), regulations)


def available_regulations(spark, extra: DataFrame | None = None,
                          controls=lexicon.REGULATION_CONTROLS) -> DataFrame:
    names = lexicon.control_table(spark, controls).select("regulation")
    if extra is not None:
        names = names.transform(guard_unions).unionByName(extra.select(text.strip("regulation").alias("regulation"))
                                  .where(F.col("regulation") != ""))
    return names.distinct()


def control_totals(spark, extra: DataFrame | None = None, regulations=None,
                   controls=lexicon.REGULATION_CONTROLS) -> DataFrame:
    """Built-in controls per regulation; one only seen in ``extra`` counts as 1."""
    built_in = builtin_controls(spark, regulations, controls).select(
        "regulation", F.lit(1).alias("n"))
    rows = built_in
    if extra is not None:
        seen = filter_regulations(
            extra.select(text.strip("regulation").alias("regulation"))
            .where(F.col("regulation") != ""), regulations)
        rows = rows.transform(guard_unions).unionByName(seen.distinct().withColumn("n", F.lit(0)))
    return rows.groupBy("regulation").agg(
        F.greatest(F.sum("n"), F.lit(1)).cast("int").alias("total_controls"))


def _control_structs(controls, regulations, keywords) -> Column:
    """check_id -> candidate structs, all constants."""
    chosen = {r.strip() for r in (regulations or []) if r.strip()}
    by_check: dict[str, list[Column]] = {}
    for seq, (check, reg, cid, title, req) in enumerate(controls):
        if chosen and reg not in chosen:
            continue
        by_check.setdefault(check, []).append(F.struct(
            F.lit(reg).alias("regulation"), F.lit(cid).alias("control_id"),
            F.lit(title).alias("title"), F.lit(req).alias("requirement"),
            lexicon.strings([k for k in keywords if k in req.lower()]).alias("words"),
            text.evidence_tokens(F.lit(f"{cid} {title} {req}")).alias("tokens"),
            lexicon.strings(lexicon.CONTROL_SIGNALS.get(cid, ())).alias("signals"),
            F.lit("legacy").alias("source"), F.lit(seq).cast("bigint").alias("seq")))
    pairs = []
    for check, structs in by_check.items():
        pairs += [F.lit(check), F.array(*structs)]
    return F.create_map(*pairs) if pairs else None


_CANDIDATE = ("array<struct<regulation:string,control_id:string,title:string,"
              "requirement:string,words:array<string>,tokens:array<string>,"
              "signals:array<string>,source:string,seq:bigint>>")


# --- claims ---------------------------------------------------------------------

def claims(docs: DataFrame, text_col: str = "policy_text", key: str = "doc_id",
           specs=lexicon.CHECK_SPECS) -> DataFrame:
    """One row per (clause, check) with at least one matched keyword. Narrow."""
    rows = text.with_clauses(docs.select(key, text_col), text_col, "clauses").drop(text_col)
    clause = text.explode_clauses(rows)
    return claims_of_clauses(clause, key, specs)


def claims_of_clauses(clause: DataFrame, key: str = "doc_id",
                      specs=lexicon.CHECK_SPECS) -> DataFrame:
    low = clause.withColumn("_low", F.lower("clause"))
    any_word = text.contains_any(
        "_low", dict.fromkeys(k for _, _, _, kws in specs for k in kws))
    hit = low.where(any_word).withColumn("_tokens", text.evidence_tokens("clause"))
    matched = F.filter(matched_checks(F.col("_low"), specs), lambda c: F.size(c["matched"]) > 0)
    hit = hit.withColumn("_matched", matched)
    rows = text.unfold_structs(hit, "_matched", key, "clause_index", "clause", "_low",
                               "_tokens").drop("weight", "n_keywords")
    # The claims carry the words that they were looked through for.
    words = sorted({k for _, _, _, kws in specs for k in kws})
    return rows.withColumn("matched", F.col("matched").alias("matched", metadata={"keywords": words}))


def every_clause(docs: DataFrame, text_col: str = "policy_text", key: str = "doc_id") -> DataFrame:
    """key, clauses_total, clause_index, clause: all clauses, and one row of nulls for a
    document without any."""
    d = text.with_clauses(docs.select(key, text_col), text_col, "_c").drop(text_col)
    return d.select(key, F.size("_c").alias("clauses_total"), F.posexplode_outer("_c").alias("clause_index", "clause"))


def claims_outer(clauses: DataFrame, specs=lexicon.CHECK_SPECS) -> DataFrame:
    """The same rows per matched check, ``_nth`` of its clause; one with a null check where
    none matches. No row is lost, so what is counted per document needs no join back."""
    words = sorted({k for _, _, _, kws in specs for k in kws})
    c = clauses.withColumn("_low", F.lower("clause"))
    c = c.withColumn("_any", text.contains_any("_low", words) if words else F.lit(False))
    found = F.filter(matched_checks(F.col("_low"), specs), lambda m: F.size(m["matched"]) > 0)
    c = c.withColumns({"_found": F.when(F.col("_any"), found),
                       "_tokens": F.when(F.col("_any"), text.evidence_tokens("clause"))}).drop("_any")
    rows = c.select(*[x for x in c.columns if x != "_found"], F.posexplode_outer("_found").alias("_nth", "_m"))
    return rows.select(*[x for x in rows.columns if x != "_m"], *[F.col(f"_m.{f}").alias(f) for f in (
        "check_seq", "check_id", "check_title")], F.col("_m.matched").alias("matched", metadata={"keywords": words}))


def _keywords(claim_rows: DataFrame) -> list[str]:
    """The words behind ``matched``: what claims() noted, else those of the built-in checks."""
    noted = claim_rows.schema["matched"].metadata.get("keywords")
    return list(noted or sorted({k for _, _, _, kws in lexicon.CHECK_SPECS for k in kws}))


# --- ranking -----------------------------------------------------------------------
# What a claim keeps of any set of candidates is a bounded list: the best per control, at
# most ``per_regulation`` of a regulation, at most ``limit``. Two such lists merge into that
# of both sets, so blocks of controls can be met one by one, in any order.

def _scored(candidates: Column) -> Column:
    """Candidates with a point per shared token and two per matched keyword."""
    counted = F.transform(candidates, lambda c: F.struct(
        F.size(F.array_intersect(c["tokens"], F.col("_tokens"))).alias("shared"),
        F.size(F.array_intersect(c["words"], F.col("matched"))).alias("overlap"), c.alias("c")))
    return F.transform(F.filter(counted, lambda x: x["shared"] + x["overlap"] > 0), lambda x: F.struct(
        x["c"]["regulation"].alias("regulation"), x["c"]["control_id"].alias("control_id"),
        (-(x["shared"] + 2 * x["overlap"])).cast("double").alias("neg_score"), x["c"]["seq"].alias("seq"),
        x["c"]["title"].alias("title"), x["c"]["requirement"].alias("requirement"), x["c"]["source"].alias("source"),
        x["overlap"].alias("overlap"), x["c"]["signals"].alias("signals")))


def _kept(df: DataFrame, scored: Column, per_regulation: int, limit: int, out: str) -> DataFrame:
    """Add ``out``: the bounded list of scored candidates, best first.

    Each step compares an array with itself, so Catalyst keeps the steps apart and every
    array is computed once per row.
    """
    step = df.withColumn("_s", F.sort_array(scored))
    # Equal (regulation, control) neighbours: the best one comes first.
    best = F.filter("_s", lambda c, i: (i == 0) | (
        F.struct(c["regulation"], c["control_id"]) != F.struct(
            F.get(F.col("_s"), i - 1)["regulation"], F.get(F.col("_s"), i - 1)["control_id"])))
    step = step.withColumn("_d", F.sort_array(F.transform(best, lambda c: F.struct(
        (-c["neg_score"]).alias("score"), *[c[f].alias(f) for f in (
            "regulation", "control_id", "title", "requirement", "source", "overlap", "signals", "seq")])), asc=False))
    step = step.withColumn("_r", F.array_distinct(F.transform("_d", lambda c: c["regulation"])))
    few = F.flatten(F.transform("_r", lambda r: F.slice(
        F.filter(F.col("_d"), lambda c: c["regulation"] == r), 1, per_regulation)))
    return step.withColumn(out, F.slice(F.sort_array(few, asc=False), 1, limit)).drop("_s", "_d", "_r")


def _again(lists: Column) -> Column:
    """Lists of kept candidates as scored ones, to be merged."""
    return F.transform(F.flatten(lists), lambda c: F.struct(
        c["regulation"].alias("regulation"), c["control_id"].alias("control_id"), (-c["score"]).alias("neg_score"),
        *[c[f].alias(f) for f in ("seq", "title", "requirement", "source", "overlap", "signals")]))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("evidence", F.transform("evidence", lambda c: c.dropFields("seq")))


def regulation_cap(limit: int) -> int:
    """Most controls of one regulation a claim may be judged on."""
    return max(2, min(5, limit // 3 if limit > 0 else 2))


def told_apart(controls: DataFrame, asked: DataFrame, per_regulation: int) -> DataFrame:
    """The controls that some claim of ``asked`` (_tokens) may be judged on.

    Controls of one regulation with the same words and the same of the claims' tokens have
    the same score for every claim, and the order of ids decides between them. So each such
    class needs its last ``per_regulation`` ids: whatever else is in it has so many before it.
    """
    rows = materialize(controls.withColumn("_n", F.monotonically_increasing_id()))
    each = rows.select("_n", F.explode("tokens").alias("token"))
    known = asked.select(F.explode("_tokens").alias("token")).distinct()
    table = materialize(each.groupBy("token").agg(F.count(F.lit(1)).alias("uses")).join(known, "token", "left_semi"))
    met = lookup_skew_safe(each, table, "token", "uses", "_n", ["uses"]).where(F.col("uses").isNotNull())
    signs = met.groupBy("_n").agg(F.sort_array(F.collect_list("token")).alias("_signs"))
    classed = rows.join(signs, "_n", "left").withColumn("_signs", F.coalesce("_signs", F.array().cast("array<string>")))
    group = ["regulation", "_signs", "words"]
    once = classed.groupBy(*group, "control_id").agg(F.min_by("_n", F.struct("seq", "title", "requirement", "source")).alias("_n"))
    return rows.join(top_k(once, group, [F.col("control_id").desc()], per_regulation).select("_n"), "_n", "left_semi").drop("_n")


def control_blocks(extra_controls: DataFrame, keywords: list[str], regulations=None, block: int = CONTROL_BLOCK,
                   asked: DataFrame | None = None, per_regulation: int = 5) -> tuple[DataFrame, int, int]:
    """(block, controls) rows of about ``block`` external controls, the number of blocks and
    the characters in all of them. Equal controls count once, as the first of them; with
    ``asked``, only those that its claims tell apart are left."""
    same = ["regulation", "control_id", "title", "requirement"]
    prepared = prepare_controls(extra_controls, regulations)
    once = prepared.groupBy(*same).agg(F.min("seq").alias("seq"), *[
        F.any_value(c).alias(c) for c in ("req_low", "tokens", "signals", "source")])
    found = find_words(once, keywords).drop("req_low")
    if asked is not None:
        prepared = found = materialize(told_apart(found, asked, per_regulation))
    n, chars = prepared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("requirement")), F.lit(0))).first()
    blocks = max(1, -(-n // block))
    one = F.struct("regulation", "control_id", "title", "requirement", "words", "tokens", "signals", "source", "seq")
    dealt = found.groupBy(F.pmod(F.xxhash64(*same), F.lit(blocks)).cast("int").alias("_block")).agg(
        F.collect_list(one).cast(_CANDIDATE).alias("_extra"))
    return dealt, blocks, chars


def rank_evidence(claim_rows: DataFrame, extra_controls: DataFrame | None = None,
                  regulations=None, limit: int = 18, controls=lexicon.REGULATION_CONTROLS,
                  block: int = CONTROL_BLOCK, key: str = "doc_id") -> DataFrame:
    """Add ``evidence``: the best controls for each claim, best first.

    Built-in candidates come from a constant map by check; ``extra_controls`` are
    candidates for every claim and come in blocks. A single block is read into the rows and
    nothing is shuffled (streams too); with more, distinct claims meet each block of the
    controls that they tell apart (:func:`told_apart`) once, and their bounded lists are
    merged. Equals keep the order of the source.
    """
    cap, keywords = regulation_cap(limit), _keywords(claim_rows)
    built_in = _control_structs(controls, regulations, keywords)
    empty = F.array().cast(_CANDIDATE)
    candidates = empty if built_in is None else F.coalesce(
        F.try_element_at(built_in, F.col("check_id")).cast(_CANDIDATE), empty)
    if extra_controls is None:
        return _shown(_kept(claim_rows, _scored(candidates), cap, limit, "evidence"))
    dealt, blocks, chars = control_blocks(extra_controls, keywords, regulations, block)
    if blocks == 1:
        with_extra = claim_rows.withColumn("_extra", dealt.select("_extra").scalar())
        # A clause that matches no check has no candidates.
        some = F.when(F.col("check_id").isNotNull(), F.concat(candidates, F.coalesce(F.col("_extra"), empty))).otherwise(empty)
        both = _scored(some)
        return _shown(_kept(with_extra, both, cap, limit, "evidence").drop("_extra"))
    # Evidence hangs on the clause and the check alone; what many documents say is ranked once.
    same = [F.col("check_id").alias("_check"), F.md5("clause").alias("_clause")]
    claim_rows = claim_rows.select("*", *same)
    once = materialize(claim_rows.where("check_id is not null").groupBy("_check", "_clause").agg(
        *[F.any_value(c).alias(c) for c in ("check_id", "_tokens", "matched")]))
    dealt, blocks, chars = control_blocks(extra_controls, keywords, regulations, block, once, cap)
    dealt = materialize(dealt)
    each = once.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if chars <= BROADCAST_CHARS:
        met = each.join(F.broadcast(dealt), "_block")
    else:
        salts = 64
        met = each.withColumn("_salt", F.pmod(F.xxhash64("_clause"), F.lit(salts)).cast("int")).join(
            dealt.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["_block", "_salt"])
    met = met.withColumn("_own", F.when(F.col("_block") == 0, candidates).otherwise(empty))
    lists = _kept(met, _scored(F.concat("_own", "_extra")), cap, limit, "_list").groupBy("_check", "_clause").agg(
        F.collect_list("_list").alias("_lists"))
    merged = _kept(lists, _again(F.col("_lists")), cap, limit, "evidence").drop("_lists")
    joined = claim_rows.join(merged, ["_check", "_clause"], "left").drop("_check", "_clause")
    nothing = F.array().cast(merged.schema["evidence"].dataType)
    return _shown(joined.withColumn("evidence", F.coalesce("evidence", nothing)))


def with_verdicts(evidence_rows: DataFrame) -> DataFrame:
    """Add ``verdicts`` (same order as ``evidence``): pass, wording, advice.

    A clause satisfies a control when two matched keywords are in the requirement,
    or one is and the clause also carries a signal of that control.
    """
    def verdict(e):
        ok = (e["overlap"] >= 2) | ((e["overlap"] >= 1) & F.exists(
            e["signals"], lambda s: F.contains(F.col("_low"), s)))
        return F.struct(
            e["regulation"].alias("regulation"), e["control_id"].alias("control_id"),
            e["title"].alias("control_title"), ok.alias("compliant"),
            e["requirement"].alias("requirement"), e["source"].alias("source"),
            e["score"].alias("score"))

    return evidence_rows.withColumn("verdicts", F.transform("evidence", verdict)).drop(
        "evidence", "_tokens", "_low")


def claim_verdicts(docs: DataFrame, extra_controls: DataFrame | None = None, regulations=None,
                   limit: int = 18, text_col: str = "policy_text", key: str = "doc_id",
                   specs=lexicon.CHECK_SPECS, controls=lexicon.REGULATION_CONTROLS) -> DataFrame:
    """Claims of all documents with their verdict lists. One scan, no shuffle."""
    rows = claims(docs, text_col, key, specs)
    return with_verdicts(rank_evidence(rows, extra_controls, regulations, limit, controls,
                                       key=key))


def verdict_rows(claim_rows: DataFrame, key: str = "doc_id", wording: bool = False) -> DataFrame:
    """One row per verdict, ``rank`` 1-based in evidence order."""
    rows = text.unfold(claim_rows.select(
        key, "clause_index", "check_seq", "check_id", "clause", "matched", "verdicts"),
        "verdicts", "_pos", "v")
    flat = rows.select(key, "clause_index", "check_seq", "check_id",
                       (F.col("_pos") + 1).alias("rank"), "v.*", "clause", "matched")
    if wording:
        flat = (flat.withColumn("reason", text.verdict_reason(
                    "compliant", "control_id", "control_title", "source", "score", "matched",
                    "requirement", "clause"))
                .withColumn("cited_clauses", F.array("clause"))
                .withColumn("remediation_advice", text.remediation(
                    "compliant", "control_id", "requirement")))
    return flat.drop("clause", "matched", "requirement")


def running_verdicts(verdicts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Passes and fails so far per (document, regulation), in event order."""
    w = (Window.partitionBy(key, "regulation").orderBy("clause_index", "check_seq", "rank")
         .rowsBetween(Window.unboundedPreceding, 0))
    return verdicts.select(
        "*", F.sum(F.col("compliant").cast("int")).over(w).alias("regulation_pass"),
        F.sum((~F.col("compliant")).cast("int")).over(w).alias("regulation_fail"))


def regulation_summary(docs: DataFrame, claim_rows: DataFrame, totals: DataFrame,
                       key: str = "doc_id") -> DataFrame:
    """Per (document, regulation): pass, fail, evaluated, controls, percentage.

    Regulations a document never met appear with zeros; one met without any known
    control keeps its counts and has 0 controls.
    """
    met = text.unfold(claim_rows.select(key, "verdicts"), "verdicts", "_pos", "v").select(
        key, F.col("v.regulation").alias("regulation"),
        F.col("v.compliant").cast("int").alias("p"))
    counts = met.groupBy(key, "regulation").agg(
        F.sum("p").alias("pass_count"), F.sum(1 - F.col("p")).alias("fail_count"))
    names = totals.agg(F.collect_set("regulation").alias("r"))
    every = docs.select(key, F.explode(names.scalar()).alias("regulation"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    sums = every.join(counts, [key, "regulation"], "full").select(
        key, "regulation", zero("pass_count"), zero("fail_count"))
    evaluated = F.col("pass_count") + F.col("fail_count")
    return sums.join(totals, "regulation", "left").select(
        key, "regulation", "pass_count", "fail_count", evaluated.alias("total_evaluated"),
        F.coalesce("total_controls", F.lit(0)).alias("total_controls"),
        F.when(evaluated > 0, F.round(F.col("pass_count") / evaluated * 100.0, 2))
        .otherwise(0.0).alias("compliance_pct"))


def policy_score(summary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Passing verdicts over controls, in percent, capped at 100, graded."""
    total = F.sum("total_controls")
    raw = F.when(total > 0, F.sum("pass_count") / total * 100).otherwise(0.0)
    return (
        summary.groupBy(key)
        .agg(F.sum("pass_count").alias("pass_count"), F.sum("fail_count").alias("fail_count"),
             total.alias("total_controls"),
             F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 2))).alias(
                 "overall_score"))
        .withColumn("grade", scoring.grade("overall_score"))
        .withColumn("status", scoring.status("overall_score"))
    )


def _judged(docs: DataFrame, extra_controls, regulations, limit, text_col, key, classify=None) -> DataFrame:
    clauses = every_clause(docs, text_col, key)
    clauses = classify(clauses) if classify else clauses
    return with_verdicts(rank_evidence(claims_outer(clauses), extra_controls, regulations, limit, key=key))


def _summed(per_doc: DataFrame, totals: DataFrame, verdicts: str) -> DataFrame:
    """Add ``regulation_summary`` and the score of a document's verdicts, inside its row."""
    known = {r["regulation"]: r["total_controls"] for r in totals.collect()}  # a row per regulation
    table = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv]) if known else F.create_map().cast("map<string,int>")
    met = F.array_distinct(F.transform(verdicts, lambda v: v["regulation"]))
    names = F.array_sort(F.array_union(F.map_keys(table), met))
    n = lambda r, ok: F.size(F.filter(F.col(verdicts), lambda v: (v["regulation"] == r) & (v["compliant"] == F.lit(ok))))
    counted = F.transform(names, lambda r: F.struct(
        r.alias("regulation"), n(r, True).alias("p"), n(r, False).alias("f"),
        F.coalesce(F.try_element_at(table, r), F.lit(0)).alias("total_controls")))
    d = per_doc.withColumn("_counted", counted)
    d = d.withColumn("regulation_summary", F.transform("_counted", lambda c: F.struct(
        c["regulation"].alias("regulation"), c["p"].alias("pass_count"), c["f"].alias("fail_count"),
        (c["p"] + c["f"]).alias("total_evaluated"), c["total_controls"].alias("total_controls"),
        F.when(c["p"] + c["f"] > 0, F.round(c["p"] / (c["p"] + c["f"]) * 100.0, 2)).otherwise(0.0).alias("compliance_pct"))))
    total = lambda f: F.aggregate("_counted", F.lit(0).cast("bigint"), lambda a, c: a + c[f])
    d = d.withColumns({"pass_count": total("p"), "fail_count": total("f"), "total_controls": total("total_controls")})
    raw = F.when(F.col("total_controls") > 0, F.col("pass_count") / F.col("total_controls") * 100).otherwise(0.0)
    d = d.withColumn("overall_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(raw, 2))))
    return d.withColumns({"grade": scoring.grade("overall_score"), "status": scoring.status("overall_score")}).drop("_counted")


def assess_policies(docs: DataFrame, extra_controls: DataFrame | None = None, regulations=None,
                    signal: DataFrame | None = None, limit: int = 18,
                    text_col: str = "policy_text", key: str = "doc_id") -> DataFrame:
    """One report row per document: counts, score, grade, status (and model signal).

    One pass: clauses are split once, slim verdicts of a document are gathered once, and all
    sums are taken inside its row.
    """
    rows = _judged(docs, extra_controls, regulations, limit, text_col, key)
    slim = F.transform("verdicts", lambda v: F.struct(v["regulation"].alias("regulation"), v["compliant"].alias("compliant")))
    per_doc = rows.groupBy(key).agg(
        F.first("clauses_total").alias("clauses_analyzed"), F.count("check_id").alias("claims_generated"),
        F.flatten(F.collect_list(slim)).alias("_verdicts"))
    totals = control_totals(docs.sparkSession, extra_controls, regulations)
    out = _summed(per_doc, totals, "_verdicts").drop("_verdicts", "regulation_summary")
    if signal is not None:
        out = out.join(signal.select(key, F.col("score").alias("model_signal")), key, "left")
    return out


def assessment_report(docs: DataFrame, extra_controls: DataFrame | None = None, regulations=None, classify=None,
                      limit: int = 18, text_col: str = "policy_text", key: str = "doc_id", priors=None) -> DataFrame:
    """The whole report of each document, nested.

    Beside the score: ``summary`` (clauses, claims, regulations evaluated, provider of the
    evidence), ``claims`` in order with their label, confidence and worded verdicts,
    ``regulation_summary``, and, where ``classify`` labels clauses (it adds predicted_label
    and confidence to them), ``model_signal`` and ``posterior_risk``.
    """
    rows = _judged(docs, extra_controls, regulations, limit, text_col, key, classify)
    if not classify:
        rows = rows.withColumns({"predicted_label": F.lit("unknown"), "confidence": F.lit(0.0)})
    worded = F.transform("verdicts", lambda v: F.struct(
        v["regulation"].alias("regulation"), v["control_id"].alias("control_id"), v["control_title"].alias("control_title"),
        v["compliant"].alias("compliant"), text.verdict_reason(v["compliant"], v["control_id"], v["control_title"], v["source"],
                                                               v["score"], F.col("matched"), v["requirement"], F.col("clause")).alias("reason"),
        F.array("clause").alias("cited_clauses"), text.remediation(v["compliant"], v["control_id"], v["requirement"])
        .alias("remediation_advice")))
    claim = F.when(F.col("check_id").isNotNull(), F.struct(
        F.col("clause_index").alias("claim_index"), "check_seq", F.col("clause").alias("claim_text"), "check_id", "check_title",
        "predicted_label", F.col("confidence"), worded.alias("regulation_verdicts")))
    # A clause counts once for the labels, whatever checks it matches.
    once = F.when(F.coalesce("_nth", F.lit(0)).eqNullSafe(0) & F.col("clause_index").isNotNull(), F.struct(
        F.col("predicted_label").alias("label"), F.col("confidence").alias("confidence")))
    per_doc = rows.groupBy(key).agg(
        F.first("clauses_total").alias("_n"), F.sort_array(F.collect_list(claim)).alias("claims"), F.collect_list(once).alias("_labels"))
    per_doc = per_doc.withColumn("_verdicts", F.flatten(F.transform("claims", lambda c: c["regulation_verdicts"])))
    out = _summed(per_doc, control_totals(docs.sparkSession, extra_controls, regulations), "_verdicts")
    out = out.withColumn("summary", F.struct(
        F.col("_n").alias("clauses_analyzed"), F.size("claims").alias("claims_generated"),
        F.transform("regulation_summary", lambda r: r["regulation"]).alias("regulations_evaluated"), F.lit("local").alias("evidence_provider")))
    if classify:
        seen = F.array_distinct(F.transform("_labels", lambda x: x["label"]))
        mean = F.aggregate("_labels", F.lit(0.0), lambda a, x: a + x["confidence"]) / F.nullif(F.size("_labels"), F.lit(0))
        signal = F.round(F.least(F.lit(3.0), F.size(seen)) + F.greatest(F.lit(0.0), F.least(F.lit(2.0), mean * 2.0)), 2)
        out = out.withColumns({"model_signal": F.coalesce(signal, F.lit(0.0)), "posterior_risk": _posterior(dict(priors or lexicon.BETA_PRIORS))})
    return out.drop("_n", "_labels", "_verdicts")


def _posterior(priors: dict) -> Column:
    """Beta posterior of each level from a document's labelled clauses, and their mean by
    evidence; without any clause, the mean of the levels."""
    conf = lambda x: scoring.bounded_probability(x["confidence"])

    def level(name, a, b):
        mine = F.filter("_labels", lambda x: x["label"] == F.lit(name))
        got = F.aggregate(mine, F.lit(0.0), lambda acc, x: acc + conf(x))
        n = F.size(mine)
        return F.struct(F.lit(name).alias("level"), n.alias("evidence_count"), (F.lit(float(a)) + got).alias("alpha"),
                        (F.lit(float(b)) + n - got).alias("beta"))

    def finished(levels):
        out = F.transform(levels, lambda l: F.struct(
            l["level"].alias("level"), l["evidence_count"].alias("evidence_count"), F.round(l["alpha"], 6).alias("alpha"),
            F.round(l["beta"], 6).alias("beta"), scoring.beta_mean(l["alpha"], l["beta"]).alias("mean")))
        n = F.aggregate(levels, F.lit(0), lambda acc, l: acc + l["evidence_count"])
        weigh = lambda l, w: scoring.beta_mean(l["alpha"], l["beta"]) * w
        by = F.aggregate(levels, F.lit(0.0), lambda acc, l: acc + weigh(l, l["evidence_count"])) / F.nullif(n, F.lit(0))
        plain = F.aggregate(levels, F.lit(0.0), lambda acc, l: acc + weigh(l, F.lit(1.0))) / F.size(levels)
        return F.struct(out.alias("levels"), F.round(F.coalesce(by, plain), 6).alias("posterior_mean"), n.alias("evidence_count"))

    return F.transform(F.array(F.array(*[level(n, a, b) for n, (a, b) in priors.items()])), finished)[0]


def retrieve_with_fallback(claim_rows: DataFrame, hits: DataFrame, extra_controls=None,
                           regulations=None, limit: int = 18, key: str = "doc_id",
                           collection: DataFrame | None = None) -> DataFrame:
    """Evidence from vector-search ``hits`` of the clause; lexical candidates if none.

    ``hits`` holds (doc key, clause_index, regulation, control_id, title, requirement); without
    clause_index they are those of every clause of the document. With the searched
    ``collection`` (seq and these four, each seq once) hits hold its ``seq`` only; up to a block
    of controls is read into the rows, so hits are moved as numbers. They are filtered by
    regulation and re-ranked exactly like the lexical ones.
    """
    cap = regulation_cap(limit)
    by = [c for c in (key, "clause_index") if c in hits.columns]
    small = collection is not None and collection.limit(CONTROL_BLOCK + 1).count() <= CONTROL_BLOCK
    if collection is not None and not small:
        hits = hits.select(*by, "seq").join(collection, "seq")
    found = filter_regulations(collection if small else hits, regulations)
    found = find_words(found.withColumn("req_low", F.lower("requirement")), _keywords(claim_rows))
    cand = F.struct("regulation", "control_id", "title", "requirement", "words",
                    text.evidence_tokens(F.concat_ws(" ", "control_id", "title", "requirement"))
                    .alias("tokens"), _signals(F.col("control_id")).alias("signals"),
                    F.lit("vector").alias("source"),
                    (F.col("seq").cast("bigint") if "seq" in found.columns
                     else F.lit(0).cast("bigint")).alias("seq"))
    empty = F.array().cast(_CANDIDATE)
    if small:
        lists = hits.groupBy(*by).agg(F.collect_set(F.col("seq").cast("bigint")).alias("_seqs"))
        joined = claim_rows.join(lists, by, "left").withColumn("_all", found.agg(
            F.collect_list(cand).cast(_CANDIDATE).alias("_all")).scalar())
        joined = joined.withColumn("_hits", F.filter("_all", lambda c: F.array_contains("_seqs", c["seq"]))).drop("_seqs", "_all")
    else:
        lists = found.groupBy(*by).agg(F.array_sort(F.collect_list(cand)).cast(_CANDIDATE).alias("_hits"))
        joined = claim_rows.join(lists, by, "left")
    by_vector = _kept(joined, _scored(F.coalesce(F.col("_hits"), empty)), cap, limit, "evidence").drop("_hits")
    by_vector = _shown(by_vector).withColumnRenamed("evidence", "_vector")
    both = rank_evidence(by_vector, extra_controls, regulations, limit, key=key)
    return both.withColumn("evidence", F.when(F.size("_vector") > 0, F.col("_vector"))
                           .otherwise(F.col("evidence"))).drop("_vector")
