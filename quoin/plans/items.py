"""Evaluation items and model outputs made from the labelled documents, in the forms that outputs take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import draw_number
from .base import draw, folded, found, read

LABELS = ["Governing Law", "License", "License Grant", "Audit Rights", "Insurance"]


def qa_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, category, neg_type, excerpt, present, evidence, output, p_present; seven kinds of output by id."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumnRenamed("doc_id", "id")
    present, quote = F.col("quality") == 1, F.substring("text", 11, 60)
    d = d.select("id", F.col("source").alias("category"), F.when(~present, F.when(F.col("id") % 2 == 0, "same_contract").otherwise("other_contract")).alias("neg_type"), F.col("text").alias("excerpt"), present.alias("present"), F.when(present, F.array(quote)).otherwise(F.array().cast("array<string>")).alias("evidence"), quote.alias("_q"))
    said = F.when(draw_number("said", "id") % 4 != 0, F.col("present")).otherwise(~F.col("present"))
    shown = F.when(draw_number("quote", "id") % 5 == 0, F.lit("zzqx wwvk yyqj")).otherwise(F.col("_q"))
    listed = F.to_json(F.struct(said.alias("present"), F.array(shown).alias("evidence")))
    string = F.to_json(F.struct(said.alias("present"), shown.alias("evidence")))
    kind = F.col("id") % 7
    flag = F.when(said, "true").otherwise("false")
    output = (
        F.when(kind == 0, listed).when(kind == 1, F.concat(F.lit("```json\n"), listed, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("Sure, {see} below: "), listed, F.lit(" done"))).when(kind == 3, string)
        .when(kind == 4, F.concat(F.lit('{"present": '), flag, F.lit(', "evid'))).when(kind == 5, F.lit("I cannot tell")).otherwise(F.concat(F.lit('{"present": '), flag, F.lit(', "evidence": null}')))
    )
    p = F.when(F.col("id") % 11 != 0, draw_number("p", "id") / 4294967296.0)
    return d.select("id", "category", "neg_type", "excerpt", "present", "evidence", output.alias("output"), p.alias("p_present"))


#: The same items scored, from the rules that made their outputs.
QA_SQL = f"""WITH base AS (SELECT d.doc_id AS id, d.source AS category, l.quality = 1 AS present, d.text AS excerpt, substr(d.text, 11, 60) AS q0, d.doc_id % 7 AS kind,
 {draw("'said-' || d.doc_id::VARCHAR")} % 4 <> 0 AS agrees, {draw("'quote-' || d.doc_id::VARCHAR")} % 5 = 0 AS bad,
 CASE WHEN d.doc_id % 11 <> 0 THEN {draw("'p-' || d.doc_id::VARCHAR")} / 4294967296.0::DOUBLE END AS p FROM documents d JOIN labels l USING (doc_id)),
told AS (SELECT *, CASE WHEN agrees THEN present ELSE NOT present END AS said, CASE WHEN bad THEN 'zzqx wwvk yyqj' ELSE q0 END AS q FROM base),
quoted AS (SELECT *, CASE WHEN kind = 5 THEN NULL ELSE said END AS pred_present, said AND kind IN (0, 1, 2, 3) AND regexp_matches(q, '[^ \\n]') AS has_quote, {folded('q')} AS fq, {folded('excerpt')} AS h FROM told),
flags AS (SELECT *, coalesce(pred_present, false) AS yes, has_quote::INT AS n_quotes, has_quote AND NOT (length(fq) >= 3 AND {found('fq', 'h')}) AS ungrounded FROM quoted),
scored AS (SELECT id, category, CASE WHEN present THEN NULL WHEN id % 2 = 0 THEN 'same_contract' ELSE 'other_contract' END AS neg_type, present AS gold_present, pred_present, pred_present IS NOT DISTINCT FROM present AS correct,
 kind IN (0, 1, 2, 6) AS valid, yes AND NOT present AS fabricated, ungrounded, (yes AND NOT present) OR ungrounded AS hallucinated, n_quotes, ungrounded::INT AS n_ungrounded_quotes,
 CASE WHEN yes AND present THEN CASE WHEN has_quote AND NOT bad OR (NOT has_quote AND {folded('q0')} = '') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS evidence_f1,
 greatest(p, 1 - p) AS confidence, CASE WHEN p IS NOT NULL THEN (p > 0.5) = present END AS conf_correct, yes, h, p FROM flags)"""


def classification_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y_true, pred, correct, valid, confidence: drawn predictions of the language of labelled documents."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    guess = F.get(F.lit(["en", "de", "fr", "es", "<invalid>"]), (draw_number("guess", "doc_id") % 5).cast("int"))
    pred = F.when(draw_number("hit", "doc_id") % 3 != 0, F.col("lang")).otherwise(guess)
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("y_true"), pred.alias("pred"), (pred == F.col("lang")).alias("correct"), (pred != "<invalid>").alias("valid"), (draw_number("conf", "doc_id") / 4294967296.0).alias("confidence"))


CLS_SQL = f"""WITH g AS (SELECT d.doc_id AS id, d.lang AS y_true, CASE WHEN {draw("'hit-' || d.doc_id::VARCHAR")} % 3 <> 0 THEN d.lang ELSE list_extract(['en', 'de', 'fr', 'es', '<invalid>'], ({draw("'guess-' || d.doc_id::VARCHAR")} % 5)::INT + 1) END AS pred,
 {draw("'conf-' || d.doc_id::VARCHAR")} / 4294967296.0::DOUBLE AS confidence FROM documents d JOIN labels l USING (doc_id)),
cls AS (SELECT *, pred = y_true AS correct, pred <> '<invalid>' AS valid FROM g)"""
