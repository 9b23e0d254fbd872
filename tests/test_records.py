"""Demonstrations, reports, checks, the answer service and the command line."""

import hashlib
import json
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quoin import __main__ as cli
from quoin.operators import answers as A
from quoin.operators import fewshot as W
from quoin.operators import prompts as P
from quoin.operators import reports as R
from quoin.sources import io


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, f"c{i}", "Law", f"start {'pad ' * 400}quote {i} ends here", i % 2 == 0, [f"quote {i}"] if i % 2 == 0 else [], "of law") for i in range(8)]
    rows += [(20, "c20", "Law", "two quotes", True, ["two", "quotes"], None), (21, "c21", "Law", "x" * 460, True, ["x" * 460], None)]
    return spark.createDataFrame(rows, "id long, contract_id string, category string, excerpt string, present boolean, evidence array<string>, description string")


def test_qa_demonstrations(records):
    (row,) = W.qa_demos(records).collect()
    users, answers = row.demos[::2], [json.loads(m.content) for m in row.demos[1::2]]
    assert [a["present"] for a in answers] == [True, False, True] and all(len(a["evidence"]) == a["present"] for a in answers)
    assert len(set(row.contracts)) == 3 and not {"c20", "c21"} & set(row.contracts)
    for user, answer in zip(users, answers):
        assert user.role == "user" and "Category definition: of law" in user.content and len(user.content) < 1400 and all(q in user.content for q in answer["evidence"])
    with pytest.raises(PySparkException, match="too few demonstrations of Law"):
        W.qa_demos(records.where("id in (0, 1, 20, 21)")).collect()


def test_demonstrations_go_before_the_question(spark, records):
    qa = W.qa_demos(records)
    cls = W.classification_demos(spark.createDataFrame([(i, f"k{i}", "c" * (401 if i == 5 else 9), f"label {i % 4}") for i in range(12)], "id long, contract_id string, clause string, target_label string"), ["label 0"])
    prompt = F.array(P.message("system", F.lit("s")), P.message("user", F.col("task")))
    items = spark.createDataFrame([(1, "qa", "Law"), (2, "classification", None), (3, "qa", "Unknown")], "id long, task string, category string").withColumn("prompt", prompt)
    got = {r.id: [m.role for m in r.prompt] for r in W.with_demonstrations(items, qa, cls).collect()}
    assert got == {1: ["system", *["user", "assistant"] * 3, "user"], 2: ["system", *["user", "assistant"] * 3, "user"], 3: ["system", "user"]}
    assert W.demo_contracts(qa, cls).count() == 6 and A.leaks(W.demo_contracts(qa, cls), records, records).count() == 3


def test_check_examples(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "id string, ids array<int>, mask array<int>")
    good = ("a", [1, 2, 3, 4], [-100, -100, 3, 4])
    assert R.check_examples(rows(good, ("b", [1, 2], [-100, 2])), 5).first().asDict() == {"n": 2, "max_tokens": 4, "mean_tokens": 3.0}
    for bad, why in ((("x", [1, 2, 3, 4, 5], [-100, 2, 3, 4, 5]), "limit: x"), (("y", [1, 2, 3], [-100, 2, -100]), "answer: y"), (("z", [1, 2], [1, 2]), "answer: z"), (("w", [1], [-100]), "answer: w")):
        with pytest.raises(PySparkException, match=why):
            R.check_examples(rows(good, bad), 5).collect()


def test_card(spark):
    one = {"classification": {"accuracy": 0.5, "accuracy_ci95": [0.25, 0.75], "macro_f1": 0.1234}, "qa": {k: 0.25 for k in ("presence_accuracy", "missed_rate", "ece", "hallucination_rate", "hallucination_rate_audited", "fabricated_rate_audited")}}
    history = [{"loss": 2.0, "step": 1}, {"eval_loss": 1.5}, {"loss": 1.0, "step": 9}, {"eval_loss": 1.25}, {"train_runtime": 5400}]
    got = R.card_values({r: one for r in R.CARD_RUNS.values()}, history, {"repo_url": "r", "video_url": "v", "hub_repo": "h"}, 2_500_000, 100_000_000)
    assert len(got) == 33 and got["cls_acc_ft"] == "50.0% [25.0, 75.0]" and got["cls_f1_3shot"] == "0.123" and got["fab_audit_base"] == "25.0%"
    assert (got["trainable_params"], got["trainable_pct"], got["steps"], got["train_hours"], got["train_loss_last"], got["eval_losses"]) == ("2.5M", "2.50%", "9", "1.5", "1.000", "1.500 → 1.250")
    with pytest.raises(KeyError):
        R.card_values({"base": one}, history, {}, 1, 1)


def test_service(spark):
    rows = [(1, "Spain governs this contract", "Law"), (2, " ", "Law"), (3, "text", "Nope"), (4, None, "Law"), (5, "w " * 1301, "Law")]
    df = spark.createDataFrame(rows, "id long, text string, clause_type string")
    labels = spark.createDataFrame([("Law", "about law"), ("Term", "")], "label string, description string")
    tokens = F.size(F.array_remove(F.split("text", r"\s+"), ""))

    def scorer(prompts):
        assert all("about law" in p or "- Law\n- Term" in p for p in prompts)
        return [{"output": 'x {"present": true, "evidence": ["SPAIN governs", "France"]}' if "about" in p else "Answer: term", "seq_logprob": -0.05, "p_present": 0.8} for p in prompts]

    got = {r.id: r for r in A.respond(df, "ask", scorer, labels, tokens, "m", "no advice").collect()}
    assert {i: r.error for i, r in got.items()} == {1: None, 2: "blank", 3: "unknown_type", 4: "length", 5: "too_long"}
    a = got[1]
    assert (a.present, a.confidence, a.bucket, a.all_verified, [q.verified for q in a.quotes], a.model, a.disclaimer) == (True, 0.8, "medium", False, [True, False], "m", "no advice")
    assert got[2].present is None and "output" not in a.asDict() and "raw_output" not in a.asDict()
    c = {r.id: (r.error, r.label, r.bucket) for r in A.respond(df, "classify", scorer, labels, tokens, "m").collect()}
    assert c[1] == (None, "Term", "high") and c[3] == (None, "Term", "high") and c[5] == ("too_long", None, None)


def test_tokens_and_limits(spark):
    assert A.single_token(lambda t: [7], " true") == 7
    with pytest.raises(ValueError, match="2 tokens"):
        A.single_token(lambda t: [7, 8], " true")
    df = spark.createDataFrame([([1, 2, 3],), ([1, 9, 3],), ([1, 2],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(A.hit_limit(F.col("ids"), [9], 3)).collect()] == [True, False, False, False]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    (tmp_path / "b.toml").write_text("y = 2")
    assert io.load_config(str(tmp_path), "a") == {"x": 1} and io.load_config(str(tmp_path), "b.toml") == {"y": 2}
    with pytest.raises(FileNotFoundError):
        io.load_config(str(tmp_path), "c")
    assert io.read_meta(spark, str(tmp_path / "gone.json")) == {} and io.read_meta(spark, str(tmp_path / "a.json")) == {"x": 1}
    assert io.categories(spark).count() == 35
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/other.txt", "no")
        z.writestr("in/data.json", "[1]")
    url, digest = (tmp_path / "z.zip").as_uri(), hashlib.sha256((tmp_path / "z.zip").read_bytes()).hexdigest()
    at = [str(tmp_path / "cache" / "z.zip"), "data.json", str(tmp_path / "data.json")]
    assert open(io.fetch_member(url, *at, sha256=digest)).read() == "[1]" and not list(tmp_path.rglob("*.part"))
    (tmp_path / "z.zip").unlink()
    assert io.fetch_member(url, *at, sha256=digest) == at[2]  # what is there is used
    with pytest.raises(ValueError, match="digest"):
        io.fetch_member(url, *at, sha256="0")


def test_score_and_report_commands(spark, tmp_path):
    base, out = str(tmp_path), str(tmp_path / "out")
    spark.createDataFrame([(f"k{i}", ["Insurance"], "Insurance", "c") for i in range(4)], cli.ITEMS["classification"]).write.json(f"{base}/items/classification")
    spark.createDataFrame([(f"q{i}", "Law", None, "the law of Spain", True, ["law of Spain"], "c") for i in range(4)], cli.ITEMS["qa"]).write.json(f"{base}/items/qa")
    spark.createDataFrame([(f"k{i}", 0, "insurance" if i else "none", -0.1) for i in range(4)], cli.OUTPUTS["classification"]).write.json(f"{base}/said/classification")
    spark.createDataFrame([(f"q{i}", 0, '{"present": true, "evidence": ["law of Spain"]}', 0.9) for i in range(4)], cli.OUTPUTS["qa"]).write.json(f"{base}/said/qa")
    cli.main(["score", f"{base}/items", f"{base}/said", out, "one", "--n-boot", "20"], spark)
    told = io.read_metrics(spark, out, ["one"])["one"]
    assert told["classification"]["accuracy"] == 0.75 and told["qa"]["presence_accuracy_ci95"] == [1.0, 1.0] and told["meta"] == {}
    rows = [json.loads(x) for p in (tmp_path / "out" / "one_rows").glob("part*") for x in p.read_text().splitlines()]
    assert len(rows) == 8 and list(rows[0])[0] == "task"
    cli.main(["report", out, str(tmp_path / "r.md"), "one"], spark)
    lines = (tmp_path / "r.md").read_text().splitlines()
    assert lines[0] == "| Metric | one |" and lines[1] == "| --- | --- |" and len(lines) == 20 and any("75.0% [" in x for x in lines)
