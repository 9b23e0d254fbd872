"""Scores, metrics, reports and answers on cases worked out by hand."""

import json
import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quoin.operators import answers as A
from quoin.operators import scoring as C
from quoin.streaming.resume import score_stream

EXCERPT = "The seller shall deliver goods within 30 days of the order."


def qa(spark, rows):
    items = [(i, "cat", neg, EXCERPT, p, ev, out, conf) for i, p, ev, neg, out, conf in rows]
    return spark.createDataFrame(items, "id string, category string, neg_type string, excerpt string, present boolean, evidence array<string>, output string, p_present double")


def said(present, *quotes):
    return json.dumps({"present": present, "evidence": list(quotes)})


def test_taxonomy(spark):
    rows = qa(spark, [
        ("right", True, ["seller shall deliver"], None, said(True, "seller shall deliver"), 0.9), ("ungrounded", True, ["seller shall deliver"], None, said(True, "buyer pays"), 0.7),
        ("fabricated", False, [], "same_contract", said(True, "goods within 30 days"), 0.6), ("absent", False, [], "other_contract", said(False), 0.2), ("unread", False, [], "other_contract", "hm", None),
    ])
    s = C.score_qa(rows)
    r = {x.id: x for x in s.collect()}
    assert r["right"].correct and not r["right"].hallucinated and r["right"].evidence_f1 == 1.0 and r["right"].conf_correct
    assert r["ungrounded"].ungrounded and r["ungrounded"].evidence_f1 == 0.0 and r["ungrounded"].n_ungrounded_quotes == 1
    assert r["fabricated"].fabricated and not r["fabricated"].ungrounded and r["fabricated"].evidence_f1 is None and not r["fabricated"].conf_correct
    assert r["absent"].correct and math.isclose(r["absent"].confidence, 0.8)
    assert r["unread"].pred_present is None and not r["unread"].correct and r["unread"].confidence is None
    m = s.agg(*C.qa_rates()).first()
    assert (m.hallucination_rate, m.fabricated_rate_same_contract, m.fabricated_rate_other_contract, m.missed_rate) == (0.4, 1.0, 0.0, 0.0)
    assert math.isclose(m.ungrounded_rate, 1 / 3) and m.evidence_f1 == 0.5 and math.isclose(m.fabricated_rate, 1 / 3)
    assert s.where("false").agg(*C.qa_rates()).first().hallucination_rate is None


def test_gold_answers_score_perfectly_and_yes_sayers_hallucinate(spark):
    gold = qa(spark, [(str(i), i % 2 == 0, ["goods within 30 days"] if i % 2 == 0 else [], "same_contract" if i % 2 else None, said(i % 2 == 0, "goods within 30 days"), 1.0 if i % 2 == 0 else 0.0) for i in range(10)])
    m = C.score_qa(gold).agg(*C.qa_rates()).first()
    assert m.presence_accuracy == 1 and m.hallucination_rate == 0 and m.evidence_f1 == 1
    bad = C.score_qa(gold.withColumn("output", F.lit(said(True, "made up words")))).agg(*C.qa_rates()).first()
    assert bad.hallucination_rate == 1 and bad.fabricated_rate == 1


def test_classification_items(spark):
    rows = spark.createDataFrame([("a", ["X", "Y"], "Y", "x", 0.5), ("b", ["X"], "X", "Y", 0.5), ("c", ["X"], "X", "gibberish", None)], "id string, labels array<string>, target_label string, output string, confidence double")
    r = {x.id: x for x in C.score_classification(rows, ["X", "Y"]).collect()}
    assert r["a"].correct and r["a"].y_true == "X" and not r["b"].correct and r["b"].y_true == "X" and r["c"].pred == "<invalid>" and not r["c"].valid


def test_calibration_by_hand(spark):
    mk = lambda rows: spark.createDataFrame(rows, "confidence double, conf_correct boolean")
    perfect, wrong = mk([(1.0, True), (0.0, False)]), mk([(0.9, False), (0.9, False)])
    assert C.ece(perfect, "confidence", "conf_correct").first().ece == 0 and math.isclose(C.ece(wrong, "confidence", "conf_correct").first().ece, 0.9)
    assert math.isnan(C.ece(wrong.where("false"), "confidence", "conf_correct").first().ece)
    assert C.auroc(perfect, "confidence", "conf_correct").first().auroc == 1 and C.auroc(wrong, "confidence", "conf_correct").first().auroc is None
    assert C.auroc(mk([(0.2, True), (0.8, False), (0.2, False)]), "confidence", "conf_correct").first().auroc == 0.25
    none = C.calibration(mk([(None, None)])).first()
    assert none.n_with_confidence == 0 and none.ece is None and none.brier is None and none.auroc is None
    assert math.isclose(C.calibration(mk([(0.5, True), (0.5, False), (None, None)])).first().brier, 0.25)


def test_macro_f1(spark):
    mk = lambda rows: C.macro_f1(spark.createDataFrame(rows, "y_true string, pred string")).first().macro_f1
    assert mk([("a", "a"), ("b", "b")]) == 1 and math.isclose(mk([("a", "a"), ("a", "b"), ("b", "b")]), 2 / 3) and mk([("a", "z")]) == 0


def test_missing_prediction_is_an_error_and_last_wins(spark):
    items = spark.createDataFrame([("a",), ("b",)], "id string")
    preds = spark.createDataFrame([("a", 0, "old"), ("a", 1, "new"), ("b", 2, "x"), ("z", 3, "none")], "id string, at int, output string")
    assert {(r.id, r.output) for r in C.with_predictions(items, preds, "at").collect()} == {("a", "new"), ("b", "x")}
    with pytest.raises(PySparkException, match="no prediction for item b"):
        C.with_predictions(items, preds.where("id = 'a'"), "at").collect()


def test_audit(spark):
    rows = spark.createDataFrame([("1", False, True, False, True), ("2", True, False, True, True), ("3", True, False, False, False), ("4", False, True, False, True)], "id string, gold_present boolean, fabricated boolean, ungrounded boolean, hallucinated boolean")
    audit = spark.createDataFrame([("1", "label_gap"), ("2", "scorer_artifact"), ("4", "confirmed")], "id string, verdict string")
    a = C.audited(rows, audit).agg(C.rate(F.col("hallucinated_audited")).alias("h"), C.rate(F.col("fabricated_audited"), ~F.col("gold_present")).alias("f")).first()
    assert (a.h, a.f) == (0.25, 0.5)
    with pytest.raises(PySparkException, match="no verdict for"):
        C.audited(rows, audit.where("id = '1'")).collect()


def test_bootstrap_covers_the_mean_and_repeats(spark):
    rows = spark.createDataFrame([(i, i % 4 == 0) for i in range(80)], "id long, ok boolean")
    a = C.bootstrap(rows, C.rate(F.col("ok")), "id", 100).first()
    assert a.lo < 0.25 < a.hi and a == C.bootstrap(rows.repartition(3), C.rate(F.col("ok")), "id", 100).first()


def test_comparison_keeps_order_and_dashes(spark):
    m = spark.createDataFrame([("base", "qa", "ece", 0.25, None, None), ("tuned", "classification", "accuracy", 0.8, 0.745, 0.855)], "run string, task string, metric string, value double, lo double, hi double")
    t = C.comparison(m, ["base", "tuned"]).orderBy("pos").collect()
    assert len(t) == 18 and t[0].tuned == "80.0% [74.5, 85.5]" and t[0].base == "–" and t[12].base == "0.250"


def test_answers(spark):
    rows = [(said(False), 0.12), ("prose", 0.3), (said(True, "30 days", "nope"), 0.95), (said(True), 0.9), (said(True), 0.4)]
    got = [r[0] for r in spark.createDataFrame(rows, "o string, p double").select(A.build_answer(F.lit(EXCERPT), F.col("o"), F.col("p"))).collect()]
    assert [(g.confidence, g.bucket) for g in got] == [(0.88, "medium"), (0.7, "medium"), (0.95, "high"), (0.9, "high"), (0.4, "low")]
    assert [q.verified for q in got[2].quotes] == [True, False] and not got[2].all_verified and got[0].all_verified and got[1].present is None
    err = A.request_error(F.col("t"), F.col("n"), 500, F.col("k"))
    rows = [("ok", 3, True), ("", 0, True), (None, 0, True), (" \n", 0, True), ("ok", 3, False), ("ok", 501, True), ("x" * 12001, 1, True), ("ok", 3, None)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, n int, k boolean").select(err).collect()] == [None, "length", "length", "blank", "unknown_type", "too_long", "length", "unknown_type"]


def test_logits(spark):
    df = spark.createDataFrame([([1.0, 2.0, 0.5], [5, 9, 2, 9], 3.0, 1.0)], "x array<double>, ids array<int>, y double, n double")
    r = df.select(A.log_softmax_max(F.col("x")), A.trimmed(F.col("ids"), F.lit(2)), A.trimmed(F.col("ids"), F.lit(7)), A.two_way_softmax(F.col("y"), F.col("n")), A.sequence_logprob(F.array(F.lit(-1.0), F.lit(-2.0), F.lit(-4.0)), F.lit(2))).first()
    assert math.isclose(r[0], -math.log(sum(math.exp(v - 2) for v in (1, 2, 0.5)))) and r[1] == [5, 9] and r[2] == [5, 9, 2, 9] and math.isclose(r[3], 1 / (1 + math.exp(-2))) and r[4] == -3


def test_stream_resumes_without_doubles(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    score = lambda df: df.select("id", F.reverse("prompt_text").alias("output"))
    for k, ids in enumerate(([1, 2], [2, 3])):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "prompt_text": f"p{i}"}) for i in ids))
        score_stream(spark, str(src), "id long, prompt_text string", out, str(tmp_path / "ck"), score).awaitTermination()
    assert sorted((r.id, r.output) for r in spark.read.parquet(out).collect()) == [(1, "1p"), (2, "2p"), (3, "3p")]
