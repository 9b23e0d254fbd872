"""Corpora, windows, samples and splits."""

import collections
import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quoin.operators import prompts as P
from quoin.operators import sampling as S
from quoin.operators import spans as N
from quoin.sources import io


def test_nested_corpus_to_spans(spark, tmp_path):
    context = "Intro\t\ttext.  The law  of\n\n Spain governs. Rest "
    start = context.index("law")
    ask = lambda c, answers: {"question": f'Find "{c}" here. Details: What is {c}?', "answers": answers}
    law = {"text": "law  of\n\n Spain", "answer_start": start}
    doc = {"data": [
        {"title": "A", "paragraphs": [{"context": "old", "qas": []}]},
        {"title": "A", "paragraphs": [{"context": context, "qas": [ask("Law", [law, law]), ask("None", []), ask("Blank", [{"text": " ", "answer_start": 5}])]}, {"context": "ignored", "qas": []}]},
        {"title": "B", "paragraphs": [{"context": "plain", "qas": [ask("None", [])]}]},
    ]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    contracts, spans, about = N.parse_corpus(io.read_corpus(spark, str(tmp_path / "c.json")))
    texts = {r.contract_id: r.text for r in contracts.collect()}
    assert texts == {"A": "Intro text. The law of\nSpain governs. Rest ", "B": "plain"}
    (s,) = spans.collect()
    assert texts["A"][s.start : s.end] == "law of\nSpain" and s.category == "Law"
    assert {(r.category, r.description) for r in about.collect()} == {("Law", "What is Law?"), ("None", "What is None?"), ("Blank", "What is Blank?")}


@pytest.fixture(scope="module")
def toks(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(47))), (2, "  \n"), (3, "one"), (4, None)], "doc_id long, text string")
    return N.token_arrays(docs).cache()


def test_tokens_are_the_arrays_row_by_row(spark, toks):
    docs = spark.createDataFrame([(7, " a  bé\u3000c "), (8, "")], "doc_id long, text string")
    assert [tuple(r) for r in N.tokens(docs).collect()] == [(7, 0, 1, 2), (7, 1, 4, 6), (7, 2, 7, 8)]
    assert {r.doc_id: len(r.ts) for r in toks.collect()} == {1: 47, 2: 0, 3: 1, 4: 0}


def test_tiles_cover_without_overlap(toks):
    tiles = sorted(N.tiles(toks, 20).collect())
    assert [(t.doc_id, t.tile) for t in tiles] == [(1, 0), (1, 1), (1, 2), (3, 0)]
    assert tiles[0].ws == 0 and all(a.we < b.ws for a, b in zip(tiles[:3], tiles[1:3]))
    assert tiles[2].we == len(" ".join(f"w{i}" for i in range(47)))


def test_relation_and_windows(spark, toks):
    rel = N.relation(F.col("s"), F.col("e"), F.lit(10), F.lit(20))
    got = [r[0] for r in spark.createDataFrame([(0, 10), (20, 25), (10, 20), (12, 15), (5, 11), (19, 30), (0, 40)], "s int, e int").select(rel).collect()]
    assert got == [None, None, "full", "full", "partial", "partial", "partial"]
    spans = spark.createDataFrame([(1, 30, 45), (1, 0, 140), (1, 100, 104)], "doc_id long, start int, end int")
    placed = N.span_tokens(spans, toks)
    for draw in (0, 1, 5, 17):
        for r in placed.withColumn("t", N.positive_start(F.col("first"), F.col("last"), F.col("n_tokens"), 12, F.lit(draw))).collect():
            if r["last"] - r["first"] + 1 > 12:
                assert r.t is None
            else:
                assert r.t <= r["first"] and r.t + 12 > r["last"] and 0 <= r.t <= 35
    tiles = N.tiles(toks, 10)
    free = N.free_windows(tiles, spans.where("start = 30"), ["doc_id"]).collect()
    assert all(t.we <= 30 or t.ws >= 45 for t in free if t.doc_id == 1) and len(free) == tiles.count() - 1
    ev = {r.tile: (r.n_full, r.cut) for r in N.evidence_in_windows(tiles, spans.where("start <> 0"), ["doc_id"], ["doc_id", "tile"]).where("doc_id = 1").collect()}
    assert sum(n for n, _ in ev.values()) + sum(c for _, c in ev.values()) >= 2


def test_round_robin(spark):
    rows = [("big", i) for i in range(100)] + [("small", 1000 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "key string, item long")
    assert collections.Counter(r.key for r in S.balanced_sample(df, "key", "item", 10, "s").collect()) == {"big": 5, "small": 5}
    assert collections.Counter(r.key for r in S.balanced_sample(df, "key", "item", 30, "s").collect()) == {"big": 25, "small": 5}
    assert S.balanced_sample(df, "key", "item", 7, "s").collect() == S.balanced_sample(df.repartition(5), "key", "item", 7, "s").collect()


def test_few_shot_needs_enough(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "key string, item long")
    assert S.first_k(df, ["key"], "item", 2, "s").count() == 3
    with pytest.raises(PySparkException, match="too few rows in b"):
        S.require_k(df, ["key"], 2).collect()


def replayed(labels, shares, seed):
    """The split by its rule, everything counted anew for each item."""
    order = sorted(labels, key=lambda i: (hashlib.md5(f"{seed}-{i}".encode()).hexdigest(), i))
    out = {}
    total = collections.Counter(x for own in labels.values() for x in own)

    def lack(label, split):
        return shares[split] * total[label] - sum(label in labels[i] for i, s in out.items() if s == split)

    def room(split):
        return shares[split] * len(labels) - sum(s == split for s in out.values())

    while True:
        waiting = collections.Counter(x for i in order if i not in out for x in labels[i])
        if not waiting:
            break
        label = min(waiting, key=lambda x: (waiting[x], x))
        for i in order:
            if i not in out and label in labels[i]:
                out[i] = max(shares, key=lambda s: (lack(label, s), room(s)))
    for i in order:
        if i not in out:
            out[i] = max(shares, key=room)
    return out


@pytest.mark.parametrize("seed", ["7", "x"])
def test_stratified_split_follows_its_rule(spark, seed):
    rnd = random.Random(seed)
    topics = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    labels = {100 + i: rnd.sample(topics[: 1 + i % 6], rnd.randint(0, min(3, 1 + i % 6))) for i in range(90)}
    shares = {"one": 0.5, "two": 0.375, "three": 0.125}  # exact in binary, so counts are too
    df = spark.createDataFrame(list(labels.items()), "item_id long, labels array<string>")
    want = replayed(labels, shares, seed)
    for part in (df, df.repartition(4)):
        assert {r.item_id: r.split for r in S.stratified_split(part, list(shares.items()), seed).collect()} == want
    assert S.stratified_split(df.limit(0), list(shares.items()), seed).count() == 0


def test_ranks_of_hot_groups(spark):
    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"))
    got = S.ranked(df, ["g"], S.draw_key("s", "id"), ["id"]).collect()
    groups = collections.defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (hashlib.md5(f"s-{r.id}".encode()).hexdigest(), r.id)):
        groups[r.g].append(r.id)
    assert {(r.id, r._rank, r._size) for r in got} == {(i, k, len(ids)) for ids in groups.values() for k, i in enumerate(ids)}


def test_first_of_duplicates(spark):
    rows = [(1, "a", 5, None), (2, "a", 3, "x"), (3, "a", 3, "y"), (4, None, 9, "z"), (5, None, None, "n")]
    df = spark.createDataFrame(rows, "id long, k string, n long, v string")
    assert sorted(tuple(r) for r in S.first_of_duplicates(df, ["k"], ["n", "id"]).collect()) == [(2, "a", 3, "x"), (5, None, None, "n")]


def test_matched_negatives_are_negative(spark):
    held = {0: "ab", 1: "b", 2: "a", 3: "ab", 10: "", 11: "c", 12: "a", 13: "ab"}
    n_tiles = {0: 3, 1: 0, 2: 2, 3: 1, 10: 4, 11: 1, 12: 2, 13: 2}
    pos = spark.createDataFrame([(i, (0, 2, 3, 12)[i % 4], "a") for i in range(400)], "pos_id long, contract_id long, category string")
    tiles = spark.createDataFrame([(c, t) for c, n in n_tiles.items() for t in range(n)], "contract_id long, tile int")
    hard = spark.createDataFrame([(0, "a", 1), (0, "a", 2), (2, "a", 0)], "contract_id long, category string, tile int")
    cats = spark.createDataFrame([(c, k) for c, own in held.items() for k in own], "contract_id long, category string")
    out = S.matched_negatives(pos, tiles, hard, cats, "s").collect()
    assert sorted(r.pos_id for r in out) == list(range(400))
    home = {r.pos_id: r.contract_id for r in pos.collect()}
    seen = collections.Counter()
    for r in out:
        if r.neg_type == "same_contract":
            assert r.neg_contract_id == home[r.pos_id] and (r.neg_contract_id, r.tile) in {(0, 1), (0, 2), (2, 0)}
        else:
            assert "a" not in held[r.neg_contract_id] and r.tile < n_tiles[r.neg_contract_id]
            seen[r.neg_contract_id] += 1
    assert set(seen) == {10, 11} and min(seen.values()) > 0.4 * sum(seen.values())  # 1 has no tile
    assert {home[r.pos_id] for r in out if r.neg_type == "same_contract"} == {0, 2}


def test_ordinals(spark):
    from quoin.operators.scoring import ordinals

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(5)
    got = ordinals(df, "k", parts=16, sample=200).orderBy("k").collect()
    assert [r._j for r in got] == list(range(5000))
    assert ordinals(df.limit(0), "k").count() == 0


def test_prompts(spark):
    row = spark.range(1).select(
        P.qa_messages(F.lit("text"), F.lit("Law"), F.lit("")).alias("plain"), P.qa_messages(F.lit("text"), F.lit("Law"), F.lit("about")).alias("told"),
        P.qa_target(F.lit(False), F.array(F.lit("x"))).alias("absent"), P.qa_target(F.lit(True), F.array(F.lit('é"'))).alias("present"),
        P.with_demos(P.classification_messages(F.lit("c"), F.array(F.lit("A"), F.lit("B"))), P.turns(F.lit("u"), F.lit("a"))).alias("shot"),
    ).first()
    assert "definition" not in row.plain[1].content and "Category definition: about\n" in row.told[1].content
    assert json.loads(row.absent) == {"present": False, "evidence": []} and row.present.startswith('{"present"') and json.loads(row.present)["evidence"] == ['é"']
    assert [m.role for m in row.shot] == ["system", "user", "assistant", "user"] and "- A\n- B" in row.shot[3].content


def test_jsonl_and_digests(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "id long, t string")
    assert io.write_jsonl(df, str(tmp_path / "o")) == 2
    back = io.read_jsonl(spark, str(tmp_path / "o"), "id long, t string")
    assert sorted(back.collect()) == sorted(df.collect()) or {tuple(r) for r in back.collect()} == {(1, "é"), (2, None)}
    lines = "\n".join(p.read_text() for p in (tmp_path / "o").glob("part*"))
    assert '"t":null' in lines and "é" in lines
    a, b = io.value_digest(df, "a"), io.value_digest(df.repartition(2), "a")
    assert a.first() == b.first() and io.mismatches(a, b).count() == 0
    assert io.mismatches(a, io.value_digest(df.limit(1), "a")).count() == 1
    assert [r.id for r in io.read_jsonl(spark, str(tmp_path / "o"), "id long, t string", first=1, order="id").collect()] == [1]


def test_audit_and_metrics_files(spark, tmp_path):
    (tmp_path / "audit.json").write_text(json.dumps({"_about": "notes", "base": {"q1": {"flag": "f", "verdict": "label_gap", "note": "n"}}, "tuned": {}}))
    assert [tuple(r) for r in io.audit_table(spark, str(tmp_path / "audit.json")).collect()] == [("base", "q1", "f", "label_gap", "n")]
    io.write_json({"a": 1}, str(tmp_path / "m.json"))
    assert io.read_metrics(spark, str(tmp_path), ["m"]) == {"m": {"a": 1}} and io.read_metrics(spark, str(tmp_path), ["m", "gone"]) is None
    (tmp_path / ".env").write_text("A=1\n# no\n\nB = 2\n")
    assert io.load_env(str(tmp_path / ".env"), {"A": "set"}) == {"A": "set", "B": "2"}
    assert io.render("x $a", {"a": "1"}) == "x 1"
    with pytest.raises(KeyError):
        io.render("$gone", {})
    (tmp_path / "bin").write_bytes(b"abc")
    assert io.file_digests(spark, str(tmp_path / "bin")).first().sha256.startswith("ba7816bf")
