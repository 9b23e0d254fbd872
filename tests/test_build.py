"""The whole build on a synthetic corpus, and a whole scored run."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quoin.operators import build as B
from quoin.operators import scoring as C

LABELS = ["Law", "Term", "Fee", "Title"]


@pytest.fixture(scope="module")
def records(spark):
    rnd = random.Random(9)
    contracts, spans = [], []
    for i in range(40):
        words, at, own = [], 0, []
        for k in range(120):
            if rnd.random() < 0.03:
                label = rnd.choice(LABELS)
                quote = f"the {label.lower()} clause number {rnd.randint(0, 99)} says this"
                own.append((f"c{i:02d}", at, at + len(quote), label))
                words.append(quote)
            else:
                words.append(f"w{rnd.randint(0, 999)}")
            at += len(words[-1]) + 1
        contracts.append((f"c{i:02d}", " ".join(words)))
        spans += own
    c = spark.createDataFrame(contracts, "contract_id string, text string")
    s = spark.createDataFrame(spans, "contract_id string, start int, end int, category string")
    d = spark.createDataFrame([("Law", "about law")], "category string, description string")
    cfg = B.Config(excluded=("Title",), window_tokens=30, sizes={"train": (20, 20), "val": (4, 4), "test": (4, 6)})
    return {x[0]: x[1] for x in contracts}, spans, B.build(c, s, d, LABELS, cfg).collect()


def test_build(records):
    texts, spans, rows = records
    assert {r.split for r in rows} == {"train", "val", "test"} and len({r.id for r in rows}) == len(rows)
    by = {}
    for r in rows:
        by.setdefault(r.contract_id, set()).add(r.split)
        assert r.prompt[0].role == "system" and r.completion[0].role == "assistant" and r.n_tokens <= 2048
        if r.task == "qa":
            inside = [(s, e) for c, s, e, k in spans if c == r.contract_id and k == r.category and texts[c][s:e] in r.excerpt]
            assert r.excerpt in texts[r.contract_id] and all(q in r.excerpt for q in r.evidence) and bool(r.evidence) == r.present
            assert json.loads(r.completion[0].content) == {"present": r.present, "evidence": r.evidence}
            if not r.present:
                assert r.neg_type and not inside
        else:
            assert r.target_label == r.labels[0] and "Title" not in r.labels and "- Title" not in r.prompt[1].content
    assert all(len(x) == 1 for x in by.values())
    train = [r for r in rows if r.split == "train" and r.task == "qa"]
    assert len(train) == 20 and sum(r.present for r in train) == 10


def test_score_run(spark, records):
    items = [(r.id, r.category, r.neg_type, r.excerpt, r.present, r.evidence) for r in records[2] if r.task == "qa"]
    items = spark.createDataFrame(items, "id string, category string, neg_type string, excerpt string, present boolean, evidence array<string>")
    right = items.select("id", F.lit(0).alias("at"), F.to_json(F.struct("present", "evidence")).alias("output"), F.when(F.col("present"), 1.0).otherwise(0.0).alias("p_present"))
    rows, m = C.score_run(items, right, "qa", "at", n_boot=20)
    m = {r.metric: r for r in m.collect()}
    assert m["presence_accuracy"].value == 1 and m["presence_accuracy"].lo == 1 and m["hallucination_rate"].hi == 0 and m["ece"].value == 0 and rows.count() == items.count()
    cls = [(r.id, r.labels, r.target_label) for r in records[2] if r.task == "classification"]
    cls = spark.createDataFrame(cls, "id string, labels array<string>, target_label string")
    said = cls.select("id", F.lit(0).alias("at"), F.concat(F.lit("Answer: "), "target_label").alias("output"), F.lit(0.9).alias("confidence"))
    m = {r.metric: r for r in C.score_run(cls, said, "classification", "at", LABELS, n_boot=20)[1].collect()}
    assert m["accuracy"].value == 1 and m["macro_f1"].lo == 1 and abs(m["ece"].value - 0.1) < 1e-9 and m["auroc"].value is None
