"""Queries over scored predictions: rates, calibration, intervals, audits, reports, answers, inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import sampling as S
from ..operators import scoring as C
from ..sources import io
from .base import big, draw, folded, query, r6, read
from .items import CLS_SQL, QA_SQL, classification_rows, qa_items


def _scored(spark, sf_dir):
    return C.score_qa(qa_items(spark, sf_dir))


@query(f"{QA_SQL} SELECT id, category, neg_type, gold_present, pred_present, correct, valid, fabricated, ungrounded, hallucinated, n_quotes::BIGINT AS n_quotes, n_ungrounded_quotes::BIGINT AS n_ungrounded_quotes, evidence_f1, round(confidence, 6) AS confidence, conf_correct FROM scored")
def qa_rows(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.withColumn("confidence", r6("confidence")).withColumn("n_quotes", big("n_quotes")).withColumn("n_ungrounded_quotes", big("n_ungrounded_quotes"))


def _rate(x: str, where: str = "true") -> str:
    return f"round(avg(CASE WHEN {where} THEN ({x})::INT::DOUBLE END), 6)"


_RATES = ", ".join(f"{e} AS {k}" for k, e in {
    "presence_accuracy": _rate("correct"), "hallucination_rate": _rate("hallucinated"), "fabricated_rate": _rate("fabricated", "NOT gold_present"), "ungrounded_rate": _rate("ungrounded", "yes AND n_quotes > 0"), "missed_rate": _rate("NOT yes", "gold_present"),
    "present_without_quote_rate": _rate("n_quotes = 0", "yes"), "evidence_f1": "round(avg(evidence_f1), 6)", "format_valid_rate": _rate("valid"), "fabricated_rate_same_contract": _rate("fabricated", "neg_type = 'same_contract'"), "fabricated_rate_other_contract": _rate("fabricated", "neg_type = 'other_contract'"),
}.items())


@query(f"{QA_SQL} SELECT {_RATES} FROM scored")
def qa_rates(spark, sf_dir):
    rates = _scored(spark, sf_dir).agg(*C.qa_rates())
    return rates.select(*(r6(c).alias(c) for c in rates.columns))


@query(f"{CLS_SQL} SELECT round(avg(correct::INT::DOUBLE), 6) AS accuracy, round(avg(valid::INT::DOUBLE), 6) AS format_valid_rate FROM cls")
def cls_metrics(spark, sf_dir):
    return classification_rows(spark, sf_dir).agg(*C.classification_rates()).select(r6("accuracy").alias("accuracy"), r6("format_valid_rate").alias("format_valid_rate"))


_F1 = "side AS (SELECT y_true AS label, correct::INT AS tp, (NOT correct)::INT AS fn, 0 AS fp, 1 AS seen FROM cls UNION ALL SELECT pred, 0, 0, 1, 0 FROM cls WHERE NOT correct), per AS (SELECT label, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp FROM side GROUP BY label HAVING sum(seen) > 0)"


@query(f"{CLS_SQL}, {_F1} SELECT round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM per")
def macro_f1(spark, sf_dir):
    return C.macro_f1(classification_rows(spark, sf_dir)).select(r6("macro_f1").alias("macro_f1"))


_BINS = "bins AS (SELECT least(floor(confidence * 10)::INT, 9) AS bin, count(*) AS n, avg(correct::INT::DOUBLE) AS accuracy, avg(confidence) AS mean_confidence FROM cls GROUP BY 1)"


@query(f"{CLS_SQL}, {_BINS} SELECT bin, n::BIGINT AS n, round(accuracy, 6) AS accuracy, round(mean_confidence, 6) AS mean_confidence FROM bins")
def calibration_bins(spark, sf_dir):
    b = C.reliability_bins(classification_rows(spark, sf_dir), "confidence", "correct")
    return b.select("bin", "n", r6("accuracy").alias("accuracy"), r6("mean_confidence").alias("mean_confidence"))


@query(f"{CLS_SQL}, {_BINS} SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM bins")
def ece(spark, sf_dir):
    return C.ece(classification_rows(spark, sf_dir), "confidence", "correct").select(r6("ece").alias("ece"))


@query(f"{CLS_SQL} SELECT round(avg(pow(confidence - correct::INT, 2)), 6) AS brier FROM cls")
def brier(spark, sf_dir):
    return classification_rows(spark, sf_dir).agg(r6(C.brier(F.col("confidence"), F.col("correct"))).alias("brier"))


@query(f"{CLS_SQL} SELECT round(sum(CASE WHEN a.confidence > b.confidence THEN 1.0::DOUBLE WHEN a.confidence = b.confidence THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auroc FROM cls a JOIN cls b ON a.correct AND NOT b.correct")
def auroc(spark, sf_dir):
    return C.auroc(classification_rows(spark, sf_dir), "confidence", "correct").select(r6("auroc").alias("auroc"))


@query(f"""{QA_SQL}, cc AS (SELECT confidence AS c, conf_correct::INT AS k FROM scored WHERE confidence IS NOT NULL), bb AS (SELECT count(*) AS n, avg(k::DOUBLE) AS a, avg(c) AS m FROM cc GROUP BY least(floor(c * 10)::INT, 9))
SELECT count(*)::BIGINT AS n_with_confidence, round(avg(c), 6) AS mean_confidence, round(avg(pow(c - k, 2)), 6) AS brier, (SELECT round(sum(n * abs(a - m)) / sum(n), 6) FROM bb) AS ece,
(SELECT round(avg(CASE WHEN x.c > y.c THEN 1.0::DOUBLE WHEN x.c = y.c THEN 0.5::DOUBLE ELSE 0 END), 6) FROM cc x JOIN cc y ON x.k = 1 AND y.k = 0) AS auroc FROM cc""")
def calibration(spark, sf_dir):
    c = C.calibration(_scored(spark, sf_dir))
    return c.select("n_with_confidence", *(r6(x).alias(x) for x in ("mean_confidence", "brier", "ece", "auroc")))


_BOOT = 1000


@query(f"""{CLS_SQL}, num AS (SELECT row_number() OVER (ORDER BY id) - 1 AS j, correct FROM cls), sz AS (SELECT count(*) AS n FROM num),
dr AS (SELECT b.range AS b, {draw("'b-' || b.range::VARCHAR || '-' || i.range::VARCHAR")} % (SELECT n FROM sz) AS j FROM range({_BOOT}) b, range((SELECT n FROM sz)) i),
v AS (SELECT b, avg(correct::INT::DOUBLE) AS v FROM dr JOIN num USING (j) GROUP BY b), rk AS (SELECT v, row_number() OVER (ORDER BY v) AS r, count(*) OVER () AS m FROM v)
SELECT round(max(v) FILTER (r = floor(0.025::DOUBLE * m) + 1), 6) AS lo, round(max(v) FILTER (r = floor(0.975::DOUBLE * m)), 6) AS hi FROM rk""")
def bootstrap_ci(spark, sf_dir):
    ci = C.bootstrap(classification_rows(spark, sf_dir).select("id", "correct"), C.rate(F.col("correct")), "id", _BOOT)
    return ci.select(r6("lo").alias("lo"), r6("hi").alias("hi"))


_VERDICT = "CASE id % 3 WHEN 0 THEN 'label_gap' WHEN 1 THEN 'scorer_artifact' ELSE 'confirmed' END"


def _audited(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("run", F.lit("r"))
    verdicts = s.where("hallucinated").select("id", F.expr(_VERDICT).alias("verdict"))
    return C.audited(s, verdicts)


_AUDIT_SQL = f"au AS (SELECT *, fabricated AND {_VERDICT} <> 'label_gap' AS fa, ungrounded AND {_VERDICT} <> 'scorer_artifact' AS ua FROM scored)"


@query(f"{QA_SQL}, {_AUDIT_SQL} SELECT {_rate('fa OR ua')} AS hallucination_rate_audited, {_rate('fa', 'NOT gold_present')} AS fabricated_rate_audited FROM au")
def audited_rates(spark, sf_dir):
    a = _audited(spark, sf_dir)
    return a.agg(r6(C.rate(F.col("hallucinated_audited"))).alias("hallucination_rate_audited"), r6(C.rate(F.col("fabricated_audited"), ~F.col("gold_present"))).alias("fabricated_rate_audited"))


def _table_sql() -> str:
    value = {"accuracy": "(SELECT avg(correct::INT::DOUBLE) FROM cls WHERE id % 2 = {r})", "fabricated_rate": "(SELECT avg(CASE WHEN NOT correct THEN (pred = 'en')::INT::DOUBLE END) FROM cls WHERE id % 2 = {r})", "brier": "(SELECT avg(pow(confidence - correct::INT, 2)) FROM cls WHERE id % 2 = {r})"}
    rows = []
    for i, (task, metric, kind) in enumerate(C.TABLE):
        known = metric if (task, metric) in (("classification", "accuracy"), ("qa", "fabricated_rate"), ("qa", "brier")) else None
        fmt = "printf('%.1f%%', 100 * {})" if kind == "pct" else "printf('%.3f', {})"
        cols = [fmt.format(value[known].format(r=r)) + (" || ' [0.0, 100.0]'" if known == "accuracy" else "") if known else "'–'" for r in (0, 1)]
        rows.append(f"SELECT {i}::INT AS pos, '{task}' AS task, '{metric}' AS metric, {cols[0]} AS base, {cols[1]} AS tuned")
    return f"{CLS_SQL} " + " UNION ALL ".join(rows)


@query(_table_sql())
def comparison_pivot(spark, sf_dir):
    rows = classification_rows(spark, sf_dir).withColumn("run", F.when(F.col("id") % 2 == 0, "base").otherwise("tuned"))
    m = rows.groupBy("run").agg(C.rate(F.col("correct")).alias("accuracy"), C.rate(F.col("pred") == "en", ~F.col("correct")).alias("fabricated_rate"), C.brier(F.col("confidence"), F.col("correct")).alias("brier"))
    task = F.when(F.col("metric") == "accuracy", "classification").otherwise("qa")
    pct = F.col("metric") == "accuracy"
    long = m.unpivot("run", ["accuracy", "fabricated_rate", "brier"], "metric", "value").select("run", task.alias("task"), "metric", "value", F.when(pct, 0.0).alias("lo"), F.when(pct, 1.0).alias("hi"))
    return C.comparison(long, ["base", "tuned"])


@query(f"{QA_SQL} SELECT id, pred_present AS present, round(CASE WHEN coalesce(pred_present, pp > 0.5) THEN pp ELSE 1 - pp END, 4) AS confidence, CASE WHEN (CASE WHEN coalesce(pred_present, pp > 0.5) THEN pp ELSE 1 - pp END) >= 0.9 THEN 'high' WHEN (CASE WHEN coalesce(pred_present, pp > 0.5) THEN pp ELSE 1 - pp END) >= 0.7 THEN 'medium' ELSE 'low' END AS bucket, NOT ungrounded AS all_verified, valid FROM (SELECT *, coalesce(p, 0.25::DOUBLE) AS pp FROM scored)")
def answer_build(spark, sf_dir):
    a = qa_items(spark, sf_dir).withColumn("a", A.build_answer(F.col("excerpt"), F.col("output"), F.coalesce("p_present", F.lit(0.25))))
    return a.select("id", "a.present", "a.confidence", "a.bucket", "a.all_verified", "a.valid")


@query(f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Insurance' WHEN 1 THEN 'License Grant' END AS label, CASE WHEN p >= 0.9 THEN 'high' WHEN p >= 0.7 THEN 'medium' ELSE 'low' END AS bucket, round(p, 4) AS confidence, doc_id % 3 = 0 AS valid FROM (SELECT doc_id, exp(-({draw("'lp-' || doc_id::VARCHAR")} % 1000) / 1000.0::DOUBLE) AS p FROM labels)""")
def classification_answers(spark, sf_dir):
    out = F.when(F.col("doc_id") % 3 == 0, "Label: insurance").when(F.col("doc_id") % 3 == 1, "a license grant, or License").otherwise("none")
    d = read(spark, sf_dir, "labels").withColumn("a", A.build_classification(out, -(S.draw_number("lp", "doc_id") % 1000) / 1000.0, ["License", "License Grant", "Insurance"]))
    return d.select("doc_id", "a.label", "a.bucket", "a.confidence", "a.valid")


@query("""SELECT doc_id, CASE WHEN n_chars > 12000 OR length(text) < 1 THEN 'length' WHEN source = 'src3' THEN 'unknown_type' WHEN len(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) > 1300 THEN 'too_long' END AS error FROM documents""")
def request_validation(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    n = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    return d.select("doc_id", A.request_error(F.col("text"), n, A.MAX_EXCERPT_TOKENS, F.col("source") != "src3").alias("error"))


@query("SELECT doc_id AS id, n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def resume_todo(spark, sf_dir):
    return A.todo(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars"), read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id AS contract_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1")
def leakage_check(spark, sf_dir):
    demos = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("contract_id"))
    return A.leaks(demos, read(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("contract_id")))


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT vec_id, (i - 1) // 8 AS step, max(x) AS m, i FROM x GROUP BY vec_id, (i - 1) // 8, i), t AS (SELECT vec_id, (i - 1) // 8 AS step, max(x) AS m FROM x GROUP BY 1, 2),
l AS (SELECT x.vec_id, t.step, -ln(sum(exp(x.x - t.m))) AS lp FROM x JOIN t ON x.vec_id = t.vec_id AND (x.i - 1) // 8 = t.step GROUP BY x.vec_id, t.step)
SELECT vec_id, round(sum(lp) FILTER (step < vec_id % 8 + 1), 6) AS seq_logprob, round(exp(sum(lp) FILTER (step < vec_id % 8 + 1)), 6) AS confidence FROM l GROUP BY vec_id""")
def seq_logprob(spark, sf_dir):
    """Eight steps of eight logits; the first vec_id mod 8 + 1 steps count."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: A.log_softmax_max(F.slice("e", i * 8 + 1, F.lit(8))))
    lp = A.sequence_logprob(steps, (F.col("vec_id") % 8 + 1).cast("int"))
    return e.select("vec_id", lp.alias("lp")).select("vec_id", r6("lp").alias("seq_logprob"), r6(F.exp("lp")).alias("confidence"))


@query("SELECT vec_id, round(1 / (1 + exp(embedding[2]::DOUBLE - embedding[1]::DOUBLE)), 6) AS p_present FROM embeddings")
def two_way_softmax(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return read(spark, sf_dir, "embeddings").select("vec_id", r6(A.two_way_softmax(F.get(e, 0), F.get(e, 1))).alias("p_present"))


@query("SELECT vec_id, coalesce(nullif(list_position(list_transform(embedding, lambda x: abs(floor(x * 10)::INT) % 7), 3), 0) - 1, 64)::BIGINT AS n_new FROM embeddings")
def trimmed_ids(spark, sf_dir):
    ids = F.transform("embedding", lambda x: F.abs(F.floor(x * 10).cast("int")) % 7)
    return read(spark, sf_dir, "embeddings").select("vec_id", big(F.size(A.trimmed(ids, F.lit(3)))).alias("n_new"))


def _reverse_scorer(prompts):
    return [{"output": p[::-1], "n_new_tokens": len(p), "seq_logprob": -len(p) / 10, "p_present": (len(p) % 10) / 10} for p in prompts]


@query("SELECT item_id AS id, reverse(text) AS output, length(text)::BIGINT AS n_new_tokens, round(-length(text) / 10.0::DOUBLE, 6) AS seq_logprob, round((length(text) % 10) / 10.0::DOUBLE, 6) AS p_present FROM benchmark")
def batch_inference(spark, sf_dir):
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt_text"), F.length("text").alias("n_tokens"))
    p = A.predict(items, _reverse_scorer)
    return p.withColumn("seq_logprob", r6("seq_logprob")).withColumn("p_present", r6("p_present"))


@query("SELECT l.doc_id AS id, d.source, CASE WHEN l.doc_id % 4 = 0 THEN 'again' ELSE 'first' END AS output FROM labels l JOIN documents d USING (doc_id)")
def last_prediction_wins(spark, sf_dir):
    ids = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    preds = ids.select("id", F.lit(0).alias("at"), F.lit("first").alias("output")).union(ids.where("id % 4 = 0").select("id", F.lit(1), F.lit("again"))).union(spark.createDataFrame([(-1, 0, "no item")], "id long, at int, output string"))
    items = ids.join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return C.with_predictions(items, preds, "at").select("id", "source", "output")


@query("SELECT 'b' AS name UNION ALL SELECT 'missing'")
def digest_mismatches(spark, sf_dir):
    tables = {k: read(spark, sf_dir, t) for k, t in (("a", "region"), ("b", "nation"))}
    built = None
    for k, t in tables.items():
        one = io.value_digest(t, k)
        built = one if built is None else built.union(one)
    odd = io.value_digest(tables["b"].limit(3), "b")
    expected = built.where("name = 'a'").union(odd).union(spark.createDataFrame([("missing", "0:0")], "name string, digest string"))
    return io.mismatches(expected, built)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    from ..functions.parsing import first_json_object

    e = read(spark, sf_dir, "events").select("event_id", first_json_object(F.concat(F.lit("row {x: "), F.col("props"), F.lit(" end"))).alias("v"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "long").alias("k"))


@query("SELECT d.doc_id, coalesce('from ' || l.n::VARCHAR, '') AS description FROM documents d LEFT JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY source HAVING count(*) > 8) l USING (source)")
def description_lookup(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    about = d.where("lang = 'fr'").groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 8").select("source", F.concat(F.lit("from "), F.col("n").cast("string")).alias("about"))
    return d.join(about, "source", "left").select("doc_id", F.coalesce("about", F.lit("")).alias("description"))


@query(f"{QA_SQL} SELECT task, count(*)::BIGINT AS n, count(confidence)::BIGINT AS n_confidence FROM (SELECT 'classification' AS task, CASE WHEN doc_id % 2 = 0 THEN 0.5 END AS confidence FROM labels UNION ALL SELECT 'qa', confidence FROM scored) GROUP BY task")
def all_rows_union(spark, sf_dir):
    cls = read(spark, sf_dir, "labels").select(F.lit("classification").alias("task"), F.when(F.col("doc_id") % 2 == 0, 0.5).alias("confidence"), F.col("toxic").alias("extra"))
    both = cls.unionByName(_scored(spark, sf_dir).withColumn("task", F.lit("qa")), allowMissingColumns=True)
    return both.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count("confidence").alias("n_confidence"))
