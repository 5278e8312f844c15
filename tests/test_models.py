import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausewise.operators import classify, evaluate, gates, risk, splits

LABELS = ("user", "system", "organization")
PRED = [("user", "user", .92, .92, .04, .04), ("user", "system", .54, .38, .54, .08),
        ("system", "system", .88, .07, .88, .05), ("organization", "organization", .97, .02, .01, .97),
        ("organization", "user", .62, .62, .18, .20), ("system", "organization", .51, .19, .30, .51)]


def predictions(spark, times=1):
    rows = [(f"e{t}-{i}", "p", a, p, c, dict(zip(LABELS, q)))
            for t in range(times) for i, (a, p, c, *q) in enumerate(PRED)]
    return spark.createDataFrame(rows, "example_id string, policy_uid string, actual_label string, "
                                 "predicted_label string, confidence double, probabilities map<string,double>")


def examples(spark, n=60):
    rnd = random.Random(3)
    words = {"user": "choice opt delete", "system": "cookie encrypt log", "organization": "share retain vendor"}
    rows = []
    for i in range(n):
        l = LABELS[i % 3]
        t = " ".join(rnd.choice(words[l].split() + ["data", "we"]) for _ in range(6))
        rows.append((f"e{i:03d}", t, l, f"p{i // 3:02d}" if i % 2 else f"q{i // 3:02d}", "c"))
    return spark.createDataFrame(rows, "example_id string, text string, label string, policy_uid string, category string")


def test_metrics_on_known_predictions(spark):
    m = evaluate.classification_metrics(predictions(spark)).first()
    assert (m["rows"], m["accuracy"], m["macro_f1"], m["weighted_f1"]) == (6, .5, .5, .5)
    cells = evaluate.confusion(predictions(spark)).collect()
    assert len(cells) == 9 and sum(c["n"] for c in cells) == 6


def test_accuracy_variants_differ_outside_the_vocabulary(spark):
    odd = predictions(spark).unionByName(predictions(spark).limit(1).withColumn(
        "actual_label", F.lit("x")).withColumn("predicted_label", F.lit("x")))
    assert evaluate.classification_metrics(odd).first()["accuracy"] == round(4 / 7, 6)
    assert evaluate.classification_metrics(odd, in_vocabulary_only=True).first()["accuracy"] == round(3 / 7, 6)


def test_naive_bayes_against_plain_arithmetic(spark):
    ex = examples(spark)
    model = classify.nb_fit(ex)
    rows = ex.collect()
    tok = {l: Counter(w for r in rows if r["label"] == l for w in r["text"].split()) for l in LABELS}
    vocab = len(set().union(*tok.values()))
    docs = spark.createDataFrame([("a", "delete cookie unseenword"), ("b", "!!"), ("c", "share share data")],
                                 "k string, text string")
    for r in classify.nb_predict(docs, model, ["k"]).join(docs, "k").collect():
        words = [w for w in r["text"].split() if w.isalnum()]
        logs = {l: math.log(21 / 63) + sum(math.log((tok[l][w] + 1) / (sum(tok[l].values()) + vocab))
                                           for w in words) for l in LABELS}
        z = sum(math.exp(v) for v in logs.values())
        for l in LABELS:
            assert abs(r["probabilities"][l] - math.exp(logs[l]) / z) < 1e-9


def test_model_tables_round_trip(spark, tmp_path):
    model = classify.nb_fit(examples(spark))
    model.write(str(tmp_path / "m"))
    back = classify.NaiveBayesTables.read(spark, str(tmp_path / "m"))
    docs = spark.createDataFrame([("a", "delete cookie")], "k string, text string")
    assert classify.nb_predict(docs, model, ["k"]).first() == classify.nb_predict(docs, back, ["k"]).first()


def test_models_by_name(spark):
    with pytest.raises(ValueError):
        classify.train_classifier(examples(spark), "nope")
    predict = classify.train_classifier(examples(spark, 90), "lr_tfidf", max_iter=30)
    got = predict(examples(spark, 90), ["example_id", "label"])
    assert got.where("label = predicted_label").count() > 60
    assert got.where("abs(aggregate(map_values(probabilities), 0D, (a, x) -> a + x) - 1) > 1e-6").count() == 0


def test_calibration_and_sweep_by_hand(spark):
    bins = evaluate.calibration(predictions(spark)).where("target = 'top_label'").collect()
    assert sum(b["count"] for b in bins) == 6 and len(bins) == 10
    by = Counter(min(9, int(p[2] * 10)) for p in PRED)
    assert {b["bin_index"]: b["count"] for b in bins if b["count"]} == dict(by)
    for r in evaluate.threshold_sweep(predictions(spark)).collect():
        i = 3 + LABELS.index(r["label"])
        tp = sum(p[i] >= r["threshold"] and p[0] == r["label"] for p in PRED)
        fp = sum(p[i] >= r["threshold"] and p[0] != r["label"] for p in PRED)
        assert (r["tp"], r["fp"]) == (tp, fp)


def test_bootstrap_intervals(spark):
    got = {r["metric"]: r for r in evaluate.bootstrap_ci(predictions(spark, 20), resamples=400).collect()}
    assert got["accuracy"]["baseline"] == .5
    for r in got.values():
        assert 0 <= r["lower"] <= r["mean"] <= r["upper"] <= 1
        assert abs(r["mean"] - r["baseline"]) < .05
    # 120 rows at rate 1/2, drawn within labels: standard error sqrt(.25/120) = .0456.
    assert abs((got["accuracy"]["upper"] - got["accuracy"]["lower"]) - 2 * 1.96 * .0456) < .04
    again = {r["metric"]: r for r in evaluate.bootstrap_ci(predictions(spark, 20), resamples=400).collect()}
    assert got == again


def test_split_sizes_and_no_leak(spark):
    ex = examples(spark, 120)
    s = splits.apply_split(ex, splits.split_policies(ex))
    assert splits.policy_overlap(s).first() == (0, 0, 0)
    assert splits.assert_no_leakage(s).count() == 120
    bad = s.unionByName(s.where("split = 'train'").limit(1).withColumn("split", F.lit("test")))
    with pytest.raises(Exception):
        splits.assert_no_leakage(bad).count()
    aux = splits.append_auxiliary(s, ex.limit(4), "aux")
    n = {r["split"]: r["rows"] for r in splits.split_summary(aux).collect()}
    m = {r["split"]: r["rows"] for r in splits.split_summary(s).collect()}
    assert n["train"] == m["train"] + 4 and n["test"] == m["test"]


def test_coverage_moves_the_smallest_policy(spark):
    rows = [(f"e{i}", "t", l, p, "c") for i, (l, p) in enumerate(
        [("user", "a"), ("user", "b"), ("system", "c"), ("organization", "d"), ("organization", "e"), ("user", "f")])]
    ex = spark.createDataFrame(rows, "example_id string, text string, label string, policy_uid string, category string")
    assigned = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "train"), ("d", "train"),
                                      ("e", "validation"), ("f", "test")], "policy_uid string, split string")
    got = {r["policy_uid"]: r["split"] for r in splits.ensure_label_coverage(ex, assigned).collect()}
    assert got["a"] == "validation" and got["c"] == "validation"
    assert sum(v == "train" for v in got.values()) == 2


def test_posterior_and_priors(spark, tmp_path):
    post = {r["level"]: r for r in risk.beta_posterior(predictions(spark)).collect()}
    assert post["user"]["alpha"] == 1.5 + .92 + .62 and post["user"]["evidence_count"] == 2
    actual = {r["level"]: r for r in risk.beta_posterior(predictions(spark), key="actual_label").collect()}
    assert actual["system"]["alpha"] == 3.4 and actual["system"]["beta"] == 2.6
    f = tmp_path / "p.json"
    f.write_text('{"user": {"alpha": 3, "beta": -1}, "system": {"alpha": "x"}}')
    priors = risk.read_priors(spark, str(f))
    assert priors["user"] == (3.0, 2.5) and priors["system"] == (1.4, 2.6)
    none = risk.overall_risk(risk.beta_posterior(predictions(spark).limit(0))).first()
    assert none["evidence_count"] == 0 and 0 < none["posterior_mean"] < 1


def test_gates_block_only_when_required(spark):
    p = predictions(spark).withColumn("split", F.lit("test"))
    expected = spark.createDataFrame([("test", 7)], "split string, rows long")
    assert not gates.count_check(p, expected).first()["passed"]
    fine = gates.count_check(p, expected.withColumn("rows", F.lit(6)))
    manifest = spark.createDataFrame([("annotated::x", "2026-01-01T00:00:00Z")], "source string, executed_at string")
    advisory = gates.source_check(manifest, "mixed", False, "corpus_source_advisory")
    required = gates.source_check(manifest, "mixed", True, "corpus_source_required")
    assert gates.overall(gates.union_checks([fine, advisory])).first()["passed"]
    assert not gates.overall(gates.union_checks([fine, required])).first()["passed"]
    none = p.withColumn("probabilities", F.lit(None).cast("map<string,double>"))
    assert gates.probability_mass_check(none).first()["passed"]
    assert not gates.probability_mass_check(p.withColumn(
        "probabilities", F.transform_values("probabilities", lambda k, v: v * 2))).first()["passed"]


def test_source_matches_look_at_every_row_text_and_source(spark):
    text = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(30)]
    controls = [("a", i, t if i != 25 else t + " changed at its end") for i, t in enumerate(text)]
    controls += [("a", 30, "w3x7"), ("a", 31, ""), ("a", 32, None), ("a", 33, text[4]), ("b", 1, "lost")]
    sources = [("a", "before " + "  ".join(text[:20])), ("a", " ".join(text[20:]))]
    got = gates.source_match_rate(spark.createDataFrame(controls, "regulation string, seq int, text string"),
                                  spark.createDataFrame(sources, "regulation string, source_text string"))
    assert {tuple(r) for r in got.collect()} == {("a", 34, 31), ("b", 1, 0)}


def test_runs_that_no_probe_asks_for_are_not_moved(spark):
    from clausewise.operators import gates

    rows = spark.createDataFrame([(i, [i * 1000 + j for j in range(50)] if i else []) for i in range(40)], "id int, keys array<bigint>")
    asked = spark.createDataFrame([(7003,), (-5,), (39049,)], "key bigint")
    got = {tuple(r) for r in gates.asked_only(rows, asked, "keys", "key").collect()}
    assert {(7, 7003), (39, 39049)} <= got and len(got) < 20
    assert gates.asked_only(rows, asked.limit(0), "keys", "key").collect() == []


def test_many_short_probes_go_to_salted_texts(spark, monkeypatch):
    from clausewise.operators import gates

    controls = spark.createDataFrame([("a", i, f"w{i} x") for i in range(30)], "regulation string, seq int, text string")
    sources = spark.createDataFrame([("a", f"v w{i} xy") for i in range(20)] + [("b", "w25 x")], "regulation string, source_text string")
    for most in (gates.BROADCAST_CHARS, -1):
        monkeypatch.setattr(gates, "BROADCAST_CHARS", most)
        assert [tuple(r) for r in gates.source_match_rate(controls, sources).collect()] == [("a", 30, 20)]
