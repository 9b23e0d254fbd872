"""Queries over sources, sinks, the build, demonstrations, scored runs and the answer service."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import build as B
from ..operators import fewshot as W
from ..operators import prompts as P
from ..operators import reports as R
from ..operators import scoring as C
from ..sources import io
from ..streaming.resume import score_stream
from .base import SPANS_SQL, TOKENS_SQL, big, draw, folded, query, r6, read, spans
from .items import CLS_SQL, LABELS, QA_SQL, classification_rows, qa_items
from .scoring_queries import _AUDIT_SQL, _audited, _rate


def _place(spark, name: str) -> str:
    """A new folder where sinks are tried: in spark.checkpoint.dir, or a local one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quoin-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


@query("""SELECT doc_id, item_id, lang, n FROM (SELECT d.doc_id, d.doc_id % 10 AS item_id, CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.lang || 'é“' END AS lang, d.n_chars AS n FROM documents d) ORDER BY doc_id LIMIT 200""")
def jsonl_first_rows(spark, sf_dir):
    """Rows written as JSON lines with their nulls, read back with a schema; the first by id."""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 10).alias("item_id"), F.when(F.col("doc_id") % 4 != 0, F.concat("lang", F.lit("é“"))).alias("lang"), F.col("n_chars").cast("long").alias("n"))
    path = _place(spark, "jsonl")
    io.write_jsonl(rows, path)
    return io.read_jsonl(spark, path, "doc_id long, item_id long, lang string, n long", first=200, order="doc_id")


@query("SELECT name, sha256(text) AS sha256 FROM (SELECT 'item ' || item_id || '.txt' AS name, text FROM benchmark)")
def file_digest(spark, sf_dir):
    """Digests of files, one for each item, against those of their texts."""
    path = _place(spark, "files")
    b = read(spark, sf_dir, "benchmark").select("item_id", "text")
    b.write.partitionBy("item_id").option("lineSep", "\u0001").text(path)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    whole = found.select(F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(".txt")).alias("name"), F.expr("substring(content, 1, length(content) - 1)").alias("content"))
    return whole.select("name", F.sha2("content", 256).alias("sha256"))


@query("SELECT source AS run, doc_id::VARCHAR AS id, 'f' || (doc_id % 3) AS flag, CASE WHEN doc_id % 2 = 0 THEN 'label_gap' ELSE 'confirmed' END AS verdict, NULL::VARCHAR AS note FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
def audit_read(spark, sf_dir):
    """Verdicts by run from one JSON map, whose other keys aren't runs."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")
    one = F.struct(F.concat(F.lit("f"), F.col("doc_id") % 3).alias("flag"), F.when(F.col("doc_id") % 2 == 0, "label_gap").otherwise("confirmed").alias("verdict"), F.lit(None).cast("string").alias("note"))
    runs = d.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.col("doc_id").cast("string"), one))).alias("m"))
    lines = runs.select(F.concat(F.lit('"'), F.col("source"), F.lit('": '), F.to_json("m", {"ignoreNullFields": "false"})).alias("part"))
    whole = lines.agg(F.concat(F.lit('{"_about": "notes", '), F.array_join(F.array_sort(F.collect_list("part")), ", "), F.lit("}")).alias("value"))
    path = _place(spark, "audit")
    whole.coalesce(1).write.text(path)
    return io.audit_table(spark, path)


@query("SELECT doc_id AS id, lang || '!' AS output FROM documents")
def stream_resume(spark, sf_dir):
    """Items scored as their files arrive, twice over: what is there already is left alone."""
    base = _place(spark, "stream")
    items = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang")
    items.where("id % 2 = 0").write.json(f"{base}/in")
    for _ in range(2):
        score_stream(spark, f"{base}/in", "id long, lang string", f"{base}/out", f"{base}/state", lambda b: b.select("id", F.concat("lang", F.lit("!")).alias("output"))).awaitTermination()
        items.where("id % 3 <> 0 or id % 2 <> 0").write.mode("append").json(f"{base}/in")
    score_stream(spark, f"{base}/in", "id long, lang string", f"{base}/out", f"{base}/state", lambda b: b.select("id", F.concat("lang", F.lit("!")).alias("output"))).awaitTermination()
    return spark.read.parquet(f"{base}/out")


_LABEL = f"list_extract([{', '.join(repr(x) for x in LABELS)}], (doc_id % {len(LABELS)})::INT + 1)"


@query(f"""WITH x AS (SELECT doc_id AS id, {_LABEL} AS gold, CASE WHEN doc_id % 6 = 5 THEN NULL WHEN doc_id % 7 = 0 THEN 'Insurance' ELSE {_LABEL} END AS pred, doc_id % 6 < 4 AS valid FROM labels)
SELECT id, coalesce(pred, '<invalid>') AS pred, coalesce(pred = gold, false) AS correct, CASE WHEN pred = gold THEN pred ELSE gold END AS y_true, valid FROM x""")
def classification_scored(spark, sf_dir):
    """Outputs in the forms that models give, scored against gold labels."""
    gold = F.get(F.lit(LABELS), (F.col("doc_id") % len(LABELS)).cast("int"))
    name, kind = F.when(F.col("doc_id") % 7 == 0, "Insurance").otherwise(gold), F.col("doc_id") % 6
    out = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit(" LABEL: "), F.lower(name))).when(kind == 2, F.concat(F.lit("'"), name, F.lit("'"))).when(kind == 3, F.concat(F.lit("`"), name, F.lit("`."))).when(kind == 4, F.concat(F.lit("That reads like "), name, F.lit(" to me"))).otherwise("none of these")
    rows = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.array(gold).alias("labels"), gold.alias("target_label"), out.alias("output"), F.lit(0.5).alias("confidence"))
    return C.score_classification(rows, LABELS).select("id", "pred", "correct", "y_true", "valid")


@query(f"""{CLS_SQL}, m AS (SELECT id % 2 AS run, round(avg(correct::INT::DOUBLE), 6) AS acc, round(avg(pow(confidence - correct::INT, 2)), 6) AS br FROM cls GROUP BY 1)
SELECT 'tuned' AS run, 'classification' AS task, 'accuracy' AS metric, printf('%+.1f pts', 100 * ((SELECT acc FROM m WHERE run = 1) - (SELECT acc FROM m WHERE run = 0))) AS shown
UNION ALL SELECT 'tuned', 'qa', 'brier', printf('%+.3f', (SELECT br FROM m WHERE run = 1) - (SELECT br FROM m WHERE run = 0))""")
def run_differences(spark, sf_dir):
    rows = classification_rows(spark, sf_dir).withColumn("run", F.when(F.col("id") % 2 == 0, "base").otherwise("tuned"))
    m = rows.groupBy("run").agg(r6(C.rate(F.col("correct"))).alias("accuracy"), r6(C.brier(F.col("confidence"), F.col("correct"))).alias("brier")).unpivot("run", ["accuracy", "brier"], "metric", "value")
    m = m.withColumn("task", F.when(F.col("metric") == "accuracy", "classification").otherwise("qa"))
    return R.differences(m, "base").select("run", "task", "metric", "shown")


_BOOT = 1000


@query(f"""{QA_SQL}, {_AUDIT_SQL}, num AS (SELECT row_number() OVER (ORDER BY id) - 1 AS j, fa, fa OR ua AS ha, gold_present FROM au), sz AS (SELECT count(*) AS n FROM num),
dr AS (SELECT b.range AS b, {draw("'b-' || b.range::VARCHAR || '-' || i.range::VARCHAR")} % (SELECT n FROM sz) AS j FROM range({_BOOT}) b, range((SELECT n FROM sz)) i),
v AS (SELECT b, avg(ha::INT::DOUBLE) AS h, avg(CASE WHEN NOT gold_present THEN fa::INT::DOUBLE END) AS f FROM dr JOIN num USING (j) GROUP BY b),
w AS (SELECT 'hallucination_rate_audited' AS metric, h AS v FROM v UNION ALL SELECT 'fabricated_rate_audited', f FROM v WHERE f IS NOT NULL), rk AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) AS r, count(*) OVER (PARTITION BY metric) AS m FROM w),
p AS (SELECT 'hallucination_rate_audited' AS metric, {_rate('fa OR ua')} AS value FROM au UNION ALL SELECT 'fabricated_rate_audited', {_rate('fa', 'NOT gold_present')} FROM au)
SELECT metric, value, round(max(v) FILTER (r = floor(0.025::DOUBLE * m) + 1), 6) AS lo, round(max(v) FILTER (r = floor(0.975::DOUBLE * m)), 6) AS hi FROM rk JOIN p USING (metric) GROUP BY metric, value""")
def audited_intervals(spark, sf_dir):
    a = R.audited_intervals(_audited(spark, sf_dir), n_boot=_BOOT)
    return a.select("metric", *(r6(c).alias(c) for c in ("value", "lo", "hi")))


@query(f"""WITH {SPANS_SQL}, n AS (SELECT category, count(*) AS n FROM spans GROUP BY category), u AS (SELECT DISTINCT doc_id, "start", "end", category, text FROM spans)
SELECT doc_id AS contract_id, "start"::BIGINT AS span_start, md5(left(substr(max(u.text), "start" + 1, "end" - "start"), 60)) AS clause_digest, string_agg(category, ',' ORDER BY n, category) AS labels FROM u JOIN n USING (category) WHERE "end" - "start" >= 40 GROUP BY doc_id, "start", "end" """)
def clause_items(spark, sf_dir):
    """Classification items of the passages found in documents: long enough, cut at the limit, labels from the rarest on."""
    own = spans(spark, sf_dir).select(F.col("doc_id").alias("contract_id"), "start", "end", "category")
    contracts = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("contract_id"), "text")
    rarity = own.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    items = B.classification_items(contracts, own, rarity, B.Config(min_clause_chars=40, max_clause_chars=60))
    return items.select("contract_id", big("start").alias("span_start"), F.md5("clause").alias("clause_digest"), F.array_join("labels", ",").alias("labels"))


_QW = 120
_POS_SQL = f"""WITH {SPANS_SQL}, {TOKENS_SQL}, s AS (SELECT DISTINCT doc_id, category, "start", "end", text FROM spans),
st AS (SELECT s.doc_id, category, s."start", s."end", min(CASE WHEN te > s."start" THEN idx END) AS f, max(CASE WHEN ts < s."end" THEN idx END) AS l, max(idx) + 1 AS n FROM s JOIN tokens t ON s.doc_id = t.doc_id GROUP BY ALL),
lim AS (SELECT *, greatest(f, l) AS l2, greatest(0, greatest(f, l) + 1 - {_QW}) AS lo FROM st),
pos AS (SELECT *, CASE WHEN l2 - f + 1 <= {_QW} THEN lo + {draw("'42-' || doc_id::VARCHAR || '-' || category || '-' || \"start\"::VARCHAR")} % (greatest(lo, least(f, greatest(0, n - {_QW}))) - lo + 1) END AS first_token FROM lim),
win AS (SELECT p.doc_id, p.category, p."start", p."end", min(ts) AS ws, max(te) AS we FROM pos p LEFT JOIN tokens t ON t.doc_id = p.doc_id AND t.idx >= p.first_token AND t.idx < p.first_token + {_QW} GROUP BY ALL),
met AS (SELECT w.doc_id, w.category, w."start", w."end", w.ws, w.we, o."start" AS os, o."end" AS oe, o.text FROM win w LEFT JOIN s o ON o.doc_id = w.doc_id AND o.category = w.category AND o."start" < w.we AND o."end" > w.ws),
q AS (SELECT doc_id, category, "start", "end", ws, we, coalesce(bool_or(NOT (os >= ws AND oe <= we)), false) AS cut, coalesce(list(substr(text, os + 1, oe - os) ORDER BY os, oe) FILTER (os >= ws AND oe <= we), []) AS ev FROM met GROUP BY ALL),
d AS (SELECT *, list_filter(ev, lambda x, i: list_position(ev, x) = i) AS evidence FROM q),
e AS (SELECT *, CASE WHEN ws IS NULL THEN 'span_too_long' WHEN cut THEN 'cut_by_window_edge' WHEN coalesce(list_sum(list_transform(evidence, lambda x: length(x))), 0) > 1500 THEN 'evidence_too_long' END AS early FROM d),
r AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY doc_id, category, evidence, early IS NULL ORDER BY "start", "end") > 1 THEN 'duplicate' END) AS reason FROM e)"""


@query(f"""{_POS_SQL} SELECT doc_id AS contract_id, category, "start"::BIGINT AS span_start, "end"::BIGINT AS span_end, ws::BIGINT AS ws, we::BIGINT AS we, array_to_string(evidence, '|') AS evidence, reason FROM r""")
def qa_positive_windows(spark, sf_dir):
    """A window around each passage with its evidence, and why it isn't used."""
    own = spans(spark, sf_dir).select(F.col("doc_id").alias("contract_id"), "start", "end", "category").distinct()
    contracts = read(spark, sf_dir, "documents").join(own.select(F.col("contract_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("contract_id"), "text")
    from ..operators import spans as N

    p = B.qa_positives(contracts, own, N.token_arrays(contracts, "contract_id"), B.Config(window_tokens=_QW))
    return p.select("contract_id", "category", big("start").alias("span_start"), big("end").alias("span_end"), big("ws").alias("ws"), big("we").alias("we"), F.array_join("evidence", "|").alias("evidence"), "reason")


@query()
def record_build(spark, sf_dir):
    """Records of all splits from the passages found in documents; what they hold follows seeds and drawn orders."""
    own = spans(spark, sf_dir).select(F.col("doc_id").cast("string").alias("contract_id"), "start", "end", "category").distinct()
    contracts = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("contract_id"), "text").join(own.select("contract_id").distinct(), "contract_id", "left_semi")
    labels = sorted(r.category for r in own.select("category").distinct().collect())  # the short list of sources
    about = spark.createDataFrame([(x, f"from {x}") for x in labels], "category string, description string")
    cfg = B.Config(excluded=(labels[-1],) if len(labels) > 2 else (), window_tokens=_QW, sizes={"train": (40, 40), "val": (10, 10), "test": (10, 10)})
    r = B.build(contracts, own, about, labels, cfg)
    return r.select("split", "id", "task", "contract_id", "category", "target_label", "present", "neg_type", big("n_tokens").alias("n_tokens"), "pos")


@query("""WITH f AS (SELECT CASE doc_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS file, CASE WHEN toxic = 1 THEN 'classification' ELSE 'qa' END AS task, quality = 1 AS present, CASE WHEN toxic = 0 AND quality = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'same_contract' ELSE 'other_contract' END END AS neg,
 d.source, d.lang, d.n_chars FROM documents d JOIN labels l USING (doc_id))
SELECT file, count(*)::BIGINT AS n, count(*) FILTER (task = 'classification')::BIGINT AS n_classification, count(*) FILTER (task = 'qa')::BIGINT AS n_qa, count(*) FILTER (task = 'qa' AND present)::BIGINT AS n_present, count(*) FILTER (task = 'qa' AND NOT present)::BIGINT AS n_absent,
 count(*) FILTER (neg = 'same_contract')::BIGINT AS n_same_contract, count(*) FILTER (neg = 'other_contract')::BIGINT AS n_other_contract, max(n_chars)::BIGINT AS max_tokens, count(DISTINCT CASE WHEN task = 'qa' THEN source ELSE lang END)::BIGINT AS n_categories FROM f GROUP BY file""")
def build_stats(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    qa = F.col("toxic") != 1
    file = F.when(F.col("doc_id") % 10 == 0, "val").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    neg = F.when(qa & (F.col("quality") == 0), F.when(F.col("doc_id") % 2 == 0, "same_contract").otherwise("other_contract"))
    return R.build_stats(d.select(file.alias("file"), F.when(qa, "qa").otherwise("classification").alias("task"), (F.col("quality") == 1).alias("present"), neg.alias("neg_type"), F.col("n_chars").alias("n_tokens"), F.when(qa, F.col("source")).alias("category"), F.when(~qa, F.col("lang")).alias("target_label")))


@query("SELECT count(*)::BIGINT AS n, max(k)::BIGINT AS max_tokens, round(avg(k), 6) AS mean_tokens FROM (SELECT length(text) - length(replace(text, ' ', '')) + 2 AS k FROM benchmark)")
def checked_examples(spark, sf_dir):
    """Training examples whose mask leaves the prompt out and trains the answer to its end."""
    b = read(spark, sf_dir, "benchmark")
    n = F.size(F.split("text", " ")) + 1
    ids = F.sequence(F.lit(1), n)
    examples = b.select(F.col("item_id").alias("id"), ids.alias("ids"), F.transform(ids, lambda i: F.when(i < n, -100).otherwise(i)).alias("mask"))
    return R.check_examples(examples, 100_000).withColumn("mean_tokens", r6("mean_tokens"))


def _records(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    present, quote = F.col("quality") == 1, F.expr("substring(text, 1, doc_id % 600 + 1)")
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("contract_id"), F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("category"), F.col("text").alias("excerpt"), present.alias("present"), F.when(present, F.array(quote)).otherwise(F.array().cast("array<string>")).alias("evidence"), F.concat(F.lit("in "), F.col("lang")).alias("description"))


@query(f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS lang, quality = 1 AS present FROM documents d JOIN labels l USING (doc_id) WHERE quality = 0 OR least(doc_id % 600 + 1, length(text)) <= {W.QUOTE_CHARS}),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, present ORDER BY md5('0-' || md5('0-' || lang || '-' || doc_id::VARCHAR)), md5('0-' || lang || '-' || doc_id::VARCHAR)) AS rank FROM r),
p AS (SELECT lang, doc_id, CASE WHEN present THEN (rank - 1) * 2 ELSE 1 END AS place FROM k WHERE rank <= CASE WHEN present THEN 2 ELSE 1 END)
SELECT lang AS category, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS contracts, 6::BIGINT AS n_messages FROM p GROUP BY lang""")
def qa_demonstrations(spark, sf_dir):
    """Present, absent, present: the records that each category's demonstrations come from."""
    d = W.qa_demos(_records(spark, sf_dir))
    return d.select("category", F.array_join(F.transform("contracts", lambda c: c.cast("string")), ",").alias("contracts"), big(F.size("demos")).alias("n_messages"))


_CLS_KEY = "md5('0-classification-' || doc_id::VARCHAR)"


@query(f"""WITH f AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_CLS_KEY}, doc_id) AS r FROM documents WHERE length(text) <= {W.CLAUSE_CHARS}), t AS (SELECT doc_id, {_CLS_KEY} AS k FROM f WHERE r = 1 ORDER BY k, doc_id LIMIT 3)
SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY k, doc_id) AS contracts, (2 * count(*))::BIGINT AS n_messages FROM t""")
def classification_demonstrations(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("contract_id"), F.col("text").alias("clause"), F.col("source").alias("target_label"))
    out = W.classification_demos(d, LABELS)
    return out.select(F.array_join(F.transform("contracts", lambda c: c.cast("string")), ",").alias("contracts"), big(F.size("demos")).alias("n_messages"))


@query("SELECT contract_id FROM (SELECT doc_id AS contract_id FROM documents WHERE lang = 'fr') INTERSECT (SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0)")
def leaks_of_several_sets(spark, sf_dir):
    of = lambda d: d.select(F.col("doc_id").alias("contract_id"))
    labels = read(spark, sf_dir, "labels")
    return A.leaks(of(read(spark, sf_dir, "documents").where("lang = 'fr'")), of(labels.where("toxic = 1")), of(labels.where("quality = 0")))


@query("""SELECT vec_id, NOT list_has_any(list_transform(embedding, lambda x: abs(floor(x * 40)::INT)), [3, 5]) AS hit FROM embeddings""")
def hit_limits(spark, sf_dir):
    ids = F.transform("embedding", lambda x: F.abs(F.floor(x * 40).cast("int")))
    return read(spark, sf_dir, "embeddings").select("vec_id", A.hit_limit(ids, [3, 5], 64).alias("hit"))


def _service_scorer(prompts):
    return [{"output": json.dumps({"present": True, "evidence": ["zzqx not there"]}), "n_new_tokens": 1, "seq_logprob": -0.1, "p_present": 0.75} for _ in prompts]


@query(f"""WITH r AS (SELECT doc_id AS id, CASE WHEN length(text) > 12000 OR length(text) < 1 THEN 'length' WHEN {folded('text')} = '' AND trim(text) = '' THEN 'blank' WHEN source = 'src3' THEN 'unknown_type' WHEN len(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) > 1300 THEN 'too_long' END AS error FROM documents)
SELECT id, error, CASE WHEN error IS NULL THEN true END AS present, CASE WHEN error IS NULL THEN 0.75::DOUBLE END AS confidence, CASE WHEN error IS NULL THEN 'medium' END AS bucket, CASE WHEN error IS NULL THEN false END AS all_verified, 'm' AS model FROM r""")
def ask_service(spark, sf_dir):
    """Requests validated, scored in batches, and answered without their raw output."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("clause_type"))
    known = d.select(F.col("clause_type").alias("label")).distinct().where("label <> 'src3'").withColumn("description", F.lit(""))
    tokens = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    return A.respond(d, "ask", _service_scorer, known, tokens, "m").select("id", "error", "present", "confidence", "bucket", "all_verified", "model")
