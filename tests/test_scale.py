"""Steps that read large tables: what they give for odd rows, and that texts stay where they are."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.operators import answers as A
from quoin.operators import grounding as G
from quoin.operators import reports as R
from quoin.operators import scoring as C
from quoin.plans.registry import ORACLES, QUERIES

DOCS = [
    (1, "The rent of no 4805 is due. Paid by 日本 and the tenant", "a"), (1, "rent of no 48 is due", "b"), (None, "the tenant pays the rent", "a"), (2, None, "a"), (3, "", "a"), (4, "Übel: the rent of no 48. The tenant", "c"),
]
QUOTES = [(7, "rent of no 48"), (7, "the tenant"), (8, "日本"), (9, None), (10, "no"), (11, "The tenant pays ... rent")]


def moved(df):
    """How often rows are dealt out anew, but for small sides that go to all workers."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange ") - plan.count("BroadcastExchange ")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, source string"), spark.createDataFrame(QUOTES, "item_id long, text string")


@pytest.mark.parametrize("block", [5, 10_000])
def test_quotes_are_grounded_row_by_row(spark, tables, block):
    docs, quotes = tables
    pairs = docs.crossJoin(quotes.withColumnRenamed("text", "q")).where(T.is_grounded(F.col("q"), T.fold(F.col("text")))).select("doc_id", "item_id")
    found = G.grounding_join(docs, quotes, block_chars=block)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, pairs.collect()), key=repr)
    assert pairs.count() == 6 and moved(found) == 0


@pytest.mark.parametrize("block", [5, 10_000])
def test_passages_stand_letter_by_letter(tables, block):
    docs, quotes = tables
    found = G.passages(docs, quotes, ["doc_id", "source"], block_chars=block)
    want = [(d, s, i, t.index(q), t.index(q) + len(q)) for d, t, s in DOCS for i, q in QUOTES if t is not None and q is not None and q in t]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    assert moved(found) == 0


def test_bytes_fold_like_columns(spark):
    rnd = random.Random(5)
    odd = "ßẞſŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆİKIıÅéΣς日Ⅷ٣ aZ0. \n"
    texts = [odd, "", " ", *("".join(rnd.choices(odd, k=rnd.randint(1, 30))) for _ in range(300))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.fold(F.col("t")).alias("f")).collect()
    assert [r.f for r in got] == [T.fold_bytes(r.t.encode()).decode() for r in got]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Passages that begin or end inside numbers and words, or hold few letters."""
    at = tmp_path_factory.mktemp("tables")
    filler = " ".join(f"w{i}" for i in range(130))
    bench = ["the rent of no. 48", "5 is. The rent", "日本. 語", "enant pays. All of the rent that is owed by en", "x. y"]
    docs = [(i, f"{filler if i % 2 else ''} {i}{bench[i % 5]}{i} {filler} {bench[(i + 1) % 5]}05", f"src{i % 3}", "en", i) for i in range(20)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["positive_windows", "matched_negatives", "clause_items", "corpus_parse", "evidence_in_window", "free_windows", "qa_positive_windows", "crop_around"])
def test_passages_that_cut_numbers(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, folder)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name]})").fetchall()
    assert want and sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_records_of_passages_that_cut_numbers(spark, folder):
    rows = QUERIES["record_build"](spark, folder).collect()
    assert len({r.id for r in rows}) == len(rows) and {r.category for r in rows if r.task == "qa"}


def drawn(n, n_boot, seed="b"):
    return [[int(hashlib.md5(f"{seed}-{b}-{i}".encode()).hexdigest()[:8], 16) % n for i in range(n)] for b in range(n_boot)]


@pytest.mark.parametrize("most", [1, 4096])
def test_replicates_follow_their_rule(spark, monkeypatch, most):
    monkeypatch.setattr(C, "KINDS", most)
    monkeypatch.setattr(C, "STRETCH", 16)
    values = [None if i % 7 == 3 else float(i % 3) for i in range(50)]
    rows = spark.createDataFrame([(i, v, i % 2 == 0) for i, v in enumerate(values)], "id long, v double, even boolean").repartition(3)
    got = {}
    for r in C.replicates(rows, "id", 4).collect():
        got.setdefault(r.b, []).append((r.v, r.even))
    assert {b: sorted(x, key=repr) for b, x in got.items()} == {b: sorted(((values[j], j % 2 == 0) for j in js), key=repr) for b, js in enumerate(drawn(50, 4))}
    assert C.replicates(rows.limit(0), "id", 4).count() == 0


def test_intervals_score_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def costly(i):
        seen.add(1)
        return i % 5 == 0

    rows = spark.range(200).select("id", costly("id").alias("hallucinated_audited"), (F.col("id") % 4 == 0).alias("fabricated_audited"), (F.col("id") % 2 == 0).alias("gold_present"))
    assert {r.metric: r.value for r in R.audited_intervals(rows, n_boot=20).collect()} == {"hallucination_rate_audited": 0.2, "fabricated_rate_audited": 0.0}
    assert seen.value == 200


def test_answers_stand_beside_their_requests(spark):
    rows = [(1, "first text", "Law"), (1, "other and longer text", "Law"), (None, "third", "Law"), (2, "x", "Nope"), (3, None, "Law"), *((10 + i, "y " * (i % 90 + 1), "Law") for i in range(200))]
    df = spark.createDataFrame(rows, "id long, text string, clause_type string")
    labels = df.select(F.col("clause_type").alias("label")).distinct().where("label <> 'Nope'").withColumn("description", F.lit(""))
    tokens = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    out = A.respond(df, "ask", lambda prompts: [{"output": '{"present": true, "evidence": []}', "p_present": len(p) / 1e4} for p in prompts], labels, tokens, "m")
    assert moved(out) == 0
    got = out.collect()
    base = next(r.confidence for r in got if r.id is None) - len("third") / 1e4
    for i, text in [(1, "first text"), (1, "other and longer text"), *((10 + i, "y " * (i % 90 + 1)) for i in range(200))]:
        assert any(r.id == i and abs(r.confidence - base - len(text) / 1e4) < 1e-9 for r in got)
    assert len(got) == len(rows) and {r.error for r in got} == {None, "unknown_type", "length"}
