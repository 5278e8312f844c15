import re

from pyspark.sql import functions as F

from clausewise import lexicon
from clausewise.operators import assess, checks
from clausewise.plans import inputs as I

POLICY = ("Privacy\n\nWe ask for consent and give clear notice before processing personal data.\n"
          "You can access, correct or delete your data; erasure requests are handled quickly.\n"
          "Encryption, access control and other security safeguards protect all records.\n"
          "In a breach we notify the supervisory authority within 72 hours by notification.")


def docs(spark):
    rows = [(1, POLICY), (2, "The weather was pleasant throughout the whole long weekend."), (3, "")]
    rows += [(10 + i, " ".join(I.PHRASES[i:i + 3])) for i in range(0, 26, 2)]
    return spark.createDataFrame(rows, "doc_id int, policy_text string")


def ground(spark, n=8):
    rows = [("CCPA" if i % 2 else "GDPR", f"g{i}", f"T{i}", I.PHRASES[i % len(I.PHRASES)]) for i in range(n)]
    rows.append(("GDPR", "Article 6", "Again", "consent notice consent processing of personal data"))
    return spark.createDataFrame(rows, "regulation string, native_id string, title string, text string")


def brute_force(clause, check_id, matched, extra):
    """Evidence order worked out with plain sets, straight from the stated rule."""
    words = lambda s: {w for w in re.findall("[a-z0-9]+", s.lower()) if len(w) > 2}
    pool = [(r, c, t, q) for k, r, c, t, q in lexicon.REGULATION_CONTROLS if k == check_id] + extra
    best = {}
    for r, c, t, q in pool:
        score = len(words(clause) & words(f"{c} {t} {q}")) + 2 * sum(k in q.lower() for k in matched)
        if score > 0:
            best[(r, c)] = max(best.get((r, c), 0), score)
    order = sorted(((s, r, c) for (r, c), s in best.items()), reverse=True)
    kept = [x for i, x in enumerate(order) if sum(y[1] == x[1] for y in order[:i]) < 5]
    return kept[:18]


def test_evidence_matches_brute_force_in_both_forms(spark):
    extra = ground(spark, 30)
    plain = [tuple(r) for r in extra.collect()]
    rows = assess.claims(docs(spark))
    for block in (512, 7, 1):  # one block of controls, and several
        got = assess.rank_evidence(rows, extra, block=block).collect()
        assert got
        for r in got:
            want = brute_force(r["clause"], r["check_id"], r["matched"], plain)
            assert [(e["score"], e["regulation"], e["control_id"]) for e in r["evidence"]] == want


def test_verdicts_agree_between_forms(spark):
    rows = assess.claims(docs(spark))
    flat = lambda block: sorted(map(tuple, assess.verdict_rows(assess.with_verdicts(
        assess.rank_evidence(rows, ground(spark), block=block))).select(
        "doc_id", "clause_index", "check_id", "rank", "control_id", "compliant").collect()))
    assert flat(512) == flat(2)


def test_large_control_tables_take_the_claims_own_keywords(spark):
    """513 controls with ties and a repeated row, keywords that no built-in check has."""
    specs = (("own", "Own", 1.0, ("zebra crossing", "quilted")),)
    text = "The quilted maps show each zebra crossing of the whole town."
    rows = assess.claims(spark.createDataFrame([(1, text)], "doc_id int, policy_text string"), specs=specs)
    extra = [("GDPR", f"c{i % 5}", f"title {i}", ("a quilted zebra crossing " if i % 2 else "maps and ") + "rule" * (i % 7))
             for i in range(513)]
    d = spark.createDataFrame([*extra, extra[0], extra[1]], "regulation string, native_id string, title string, text string")
    few, many = ([[e.asDict() for e in r["evidence"]] for r in assess.rank_evidence(rows, d, block=block).collect()]
                 for block in (10 ** 6, 100))
    assert few == many and max(e["overlap"] for e in many[0]) == 2


def test_equals_keep_the_order_of_the_source(spark):
    """The same id and score twice: the first row of the source is the evidence."""
    rows = assess.claims(docs(spark))
    extra = [("GDPR", "same", f"title {chr(122 - i)}", "consent and notice", i) for i in range(20)]
    d = spark.createDataFrame(extra, "regulation string, native_id string, title string, text string, seq int")
    for block in (512, 3):
        for turn, first in ((F.col("seq"), "title z"), (-F.col("seq"), "title g")):
            got = assess.rank_evidence(rows, d.withColumn("seq", turn).repartition(7), block=block).collect()
            shown = {e["title"] for r in got for e in r["evidence"] if e["control_id"] == "same"}
            assert shown == {first}


def test_bounded_lists_merge(spark):
    """Lists of parts of the candidates, merged, are the list of all candidates."""
    import random

    r = random.Random(2)
    one = lambda: (r.choice("AB"), f"c{r.randint(0, 6)}", -float(r.randint(1, 4)), r.randint(0, 50), "t", "q", "s", 1, [])
    schema = ("array<struct<regulation:string,control_id:string,neg_score:double,seq:bigint,title:string,requirement:string,"
              "source:string,overlap:int,signals:array<string>>>")
    rows = [([one() for _ in range(r.randint(0, 12))], [one() for _ in range(r.randint(0, 12))]) for _ in range(200)]
    df = spark.createDataFrame(rows, f"a {schema}, b {schema}")
    for name, col in (("ka", F.col("a")), ("kb", F.col("b")), ("both", F.concat("a", "b"))):
        df = assess._kept(df, col, 2, 3, name)
    df = assess._kept(df, assess._again(F.array("ka", "kb")), 2, 3, "merged")
    for x in df.select("both", "merged").collect():
        assert x["both"] == x["merged"]


def test_automaton_finds_all_words(spark):
    words = ["a", "ab", "abc", "bc", "opt in", "é"]
    texts = ["xabcx", "opt  in opt in", "é", "", None, "zzz"]
    df = spark.createDataFrame([(t,) for t in texts], "req_low string")
    for t, found in assess.find_words(df, words).collect():
        assert found == sorted(w for w in words if t and w in t)
    assert all(f == [] for _, f in assess.find_words(df, []).collect())


def test_policy_scores_and_selection(spark):
    out = {r["doc_id"]: r for r in assess.assess_policies(docs(spark)).collect()}
    assert out[1]["overall_score"] > out[2]["overall_score"]
    assert out[2]["claims_generated"] == 0 and out[3]["clauses_analyzed"] == 0
    only = assess.verdict_rows(assess.claim_verdicts(docs(spark), regulations=["GDPR"]))
    assert {r["regulation"] for r in only.select("regulation").distinct().collect()} == {"GDPR"}


def test_controls_only_seen_outside_count_once(spark):
    totals = {r["regulation"]: r["total_controls"]
              for r in assess.control_totals(spark, ground(spark)).collect()}
    assert totals["CCPA"] == 1 and totals["GDPR"] == 12


def test_check_scores_keep_all_checks(spark):
    c = checks.policy_check_scores(docs(spark))
    counts = c.groupBy("doc_id").count().collect()
    assert all(r["count"] == 8 for r in counts)
    row = c.where("doc_id = 1 AND check_id = 'consent_transparency'").first()
    assert len(row["evidence"]) == 1 and row["matched_keywords"] == ["consent", "notice"]


def test_band_summary_keeps_empty_bands(spark):
    df = spark.createDataFrame([("low", 10.0, True), ("low", 20.0, False), ("odd", 1.0, True)],
                               "compliance_band string, overall_score double, within_target_band boolean")
    got = {r["band"]: r for r in checks.band_score_summary(df).collect()}
    assert got["low"]["mean"] == 15.0 and got["high"]["count"] == 0 and got["high"]["mean"] is None


def test_every_phrase_side_occurs(spark):
    d = spark.createDataFrame([(i, "x") for i in range(56)], "doc_id long, text string")
    v = assess.verdict_rows(assess.claim_verdicts(I.policy_texts(d)))
    assert {r[0] for r in v.select("compliant").distinct().collect()} == {True, False}
    assert v.select("check_id").distinct().count() == 8
    assert isinstance(v.select(F.max("rank")).first()[0], int)


def test_controls_that_no_claim_tells_apart_count_once(spark):
    """As many blocks for ten times the controls, and the lists of one block of all of them."""
    words = ["consent", "notice", "access", "records", "meadow", "quartz"]
    rows = assess.claims(docs(spark))
    asked = rows.select("check_id", "_tokens", "matched")

    def controls(n):
        return spark.createDataFrame([
            (("GDPR", "NIST")[i % 2], f"c{i if i % 3 else i // 9}", f"{words[i % 6]} {words[i // 6 % 6]} id{i}",
             f"{words[i // 36 % 6]} rule", (i * 7919) % n) for i in range(n)],
            "regulation string, native_id string, title string, text string, seq int")

    left = []
    for n in (2000, 20_000):
        keywords = assess._keywords(rows)
        dealt, blocks, _ = assess.control_blocks(controls(n), keywords, None, 16, asked, 5)
        left.append((blocks, dealt.select(F.explode("_extra")).count()))
    assert left[1][1] <= 1.2 * left[0][1] and left[1][0] <= 1.2 * left[0][0] + 1
    few, many = (sorted(str((r["doc_id"], r["clause_index"], r["check_id"], r["evidence"])) for r in assess.rank_evidence(
        rows, controls(2000), block=block).collect()) for block in (10 ** 6, 16))
    assert few == many
