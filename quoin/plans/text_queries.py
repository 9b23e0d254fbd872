"""Queries over text: grounding, token F1, white space, offsets, parsing, prompts, display."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.parsing import parse_label, parse_qa
from ..operators import prompts as P
from ..operators import sampling as S
from ..operators import spans as N
from ..operators.grounding import grounding_join
from .base import SPANS_SQL, TOKENS_SQL, WS, big, draw, folded, found, normalized, query, r6, read, remapped_sql, spans
from .items import LABELS, qa_items, QA_SQL


@query(f"""WITH d AS (SELECT doc_id, {folded('text')} AS h FROM documents), b AS (SELECT item_id, {folded('text')} AS f FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON {found('f', 'h')} WHERE length(f) >= 3""")
def grounded_quotes(spark, sf_dir):
    return grounding_join(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_VARIANTS = {
    "upper": ("upper(text)", "text"), "number_cut": ("text || ' no 48'", "text || ' no 4805'"), "number_whole": ("text || ' no 48'", "text || ' (no. 48)'"),
    "ellipsis": ("substr(text, 1, 20) || ' ... ' || substr(text, 40, 30)", "text"), "changed": ("replace(text, 'th', 'zz')", "text"), "blank": ("' . '", "text"),
}


@query(" UNION ALL ".join(
    f"SELECT item_id, '{k}' AS variant, " + (
        f"{found(folded('substr(text, 1, 20)'), folded('text'))} AND {found(folded('substr(text, 40, 30)'), folded('text'))}" if k == "ellipsis" else "false" if k == "blank" else found(folded(q), folded(e))
    ) + " AS grounded FROM benchmark" for k, (q, e) in _VARIANTS.items()
))
def grounding_altered(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    rows = [F.struct(F.lit(k).alias("variant"), F.expr(q).alias("q"), F.expr(e).alias("e")) for k, (q, e) in _VARIANTS.items()]
    return b.select("item_id", F.explode(F.array(*rows)).alias("v")).select("item_id", "v.variant", T.is_grounded(F.col("v.q"), T.fold(F.col("v.e"))).alias("grounded"))


@query(f"""WITH g0 AS (SELECT item_id, text, {folded('text')} AS g FROM benchmark), p AS (SELECT doc_id, item_id, {folded("d.text")} AS a, g FROM documents d JOIN g0 b ON {found('g', folded('d.text'))} WHERE length(g) >= 3),
ca AS (SELECT doc_id, item_id, w, count(*) AS n FROM (SELECT doc_id, item_id, unnest(string_split(a, ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
cg AS (SELECT doc_id, item_id, w, count(*) AS n FROM (SELECT doc_id, item_id, unnest(string_split(g, ' ')) AS w FROM p) WHERE w <> '' GROUP BY ALL),
o AS (SELECT doc_id, item_id, sum(least(ca.n, cg.n)) AS shared FROM ca JOIN cg USING (doc_id, item_id, w) GROUP BY ALL),
na AS (SELECT doc_id, item_id, sum(n) AS n FROM ca GROUP BY ALL), ng AS (SELECT doc_id, item_id, sum(n) AS n FROM cg GROUP BY ALL)
SELECT doc_id, item_id, round(2.0::DOUBLE * shared / (na.n + ng.n), 6)::DOUBLE AS f1 FROM o JOIN na USING (doc_id, item_id) JOIN ng USING (doc_id, item_id)""")
def token_f1_pairs(spark, sf_dir):
    """F1 of whole documents and the passages grounded in them."""
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    pairs = grounding_join(d, b).join(d.select("doc_id", F.col("text").alias("a")), "doc_id").join(b.select("item_id", "text"), "item_id")
    return pairs.select("doc_id", "item_id", r6(T.token_f1(F.col("a"), F.col("text"))).alias("f1"))


_RAW = "replace(replace(text, '. ', '.' || chr(9) || chr(160) || ' '), chr(10), ' ' || chr(10) || chr(11))"


@query(f"SELECT doc_id, length(t)::BIGINT AS n_chars_after, md5(t) AS digest FROM (SELECT doc_id, {normalized(_RAW)} AS t FROM documents)")
def ws_normalize(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", T.normalize_ws(F.expr(_RAW)).alias("t"))
    return d.select("doc_id", big(F.length("t")).alias("n_chars_after"), F.md5("t").alias("digest"))


@query(remapped_sql(_RAW.replace("text", "{}"), "", """SELECT doc_id, item_id, s::BIGINT AS span_start, e2::BIGINT AS span_end, substr(norm, s + 1, e2 - s) AS quoted FROM f"""))
def span_remap(spark, sf_dir):
    d, b = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    j = grounding_join(d, b).join(d.select("doc_id", F.col("text").alias("t0"), F.expr(_RAW).alias("raw")), "doc_id").join(b.select("item_id", F.col("text").alias("b0"), F.expr(_RAW).alias("q")), "item_id")
    j = j.where(F.contains("t0", F.col("b0")) & F.contains("raw", F.col("q"))).withColumn("at", F.instr("raw", F.col("q")) - 1).withColumn("norm", T.normalize_ws(F.col("raw")))
    j = j.withColumn("s0", T.remap(F.col("raw"), F.col("at"))).withColumn("e0", T.remap(F.col("raw"), F.col("at") + F.length("q")))
    s, e = T.shrink(F.col("norm"), F.col("s0"), F.col("e0"))
    return j.withColumn("s", s).withColumn("e", e).select("doc_id", "item_id", big("s").alias("span_start"), big("e").alias("span_end"), N.quote(F.col("norm"), F.col("s"), F.col("e")).alias("quoted"))


@query(f"WITH {TOKENS_SQL} SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(ts)::BIGINT AS sum_start, sum(te)::BIGINT AS sum_end FROM tokens GROUP BY doc_id")
def token_offsets(spark, sf_dir):
    return N.tokens(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), big(F.sum("ts")).alias("sum_start"), big(F.sum("te")).alias("sum_end"))


@query(f"{QA_SQL} SELECT id, pred_present, n_quotes::BIGINT AS n_quotes, valid FROM scored")
def parse_qa_outputs(spark, sf_dir):
    p = qa_items(spark, sf_dir).withColumn("p", parse_qa(F.col("output")))
    return p.select("id", F.col("p.present").alias("pred_present"), big(F.size("p.evidence")).alias("n_quotes"), F.col("p.valid").alias("valid"))


_LABEL_SQL = ", ".join(f"'{x}'" for x in LABELS)


@query(f"""SELECT doc_id, l AS label, doc_id % 6 < 4 AS valid FROM (SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN NULL ELSE list_extract([{_LABEL_SQL}], (doc_id % {len(LABELS)})::INT + 1) END AS l FROM labels)""")
def parse_label_outputs(spark, sf_dir):
    """Bare, prefixed, quoted and starred labels are valid; a sentence gives the longest label it holds; junk none."""
    name = F.get(F.lit(LABELS), (F.col("doc_id") % len(LABELS)).cast("int"))
    kind = F.col("doc_id") % 6
    sentence = F.concat(F.lit("I think it is "), name, F.when(F.col("doc_id") % len(LABELS) == 2, F.lit(f" or {LABELS[1]}")).otherwise(""), F.lit(" here"))
    out = F.when(kind == 0, name).when(kind == 1, F.concat(F.lit("  Answer: "), F.upper(name), F.lit("\n"))).when(kind == 2, F.concat(F.lit('"'), name, F.lit('."'))).when(kind == 3, F.concat(F.lit("**"), name, F.lit("**"))).when(kind == 4, sentence).otherwise("no idea")
    d = read(spark, sf_dir, "labels").select("doc_id", parse_label(out, LABELS).alias("p"))
    return d.select("doc_id", "p.label", "p.valid")


@query("""WITH m AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations),
t AS (SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY r) FILTER (r < n) AS body, max(text) FILTER (r = n) AS completion, string_agg(text, '' ORDER BY r) AS all_text, max(n) AS n FROM m GROUP BY conv_id)
SELECT conv_id, md5(coalesce(body, '') || '<|assistant|>' || chr(10)) AS prompt_digest, md5(completion) AS completion_digest, n::BIGINT AS n_messages,
 (len(list_filter(string_split_regex(all_text, '[ \\n]+'), lambda x: x <> '')) + 32)::BIGINT AS n_tokens FROM t""")
def chat_prompts(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    c = c.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("m"))
    prompt, last = F.slice("m", F.lit(1), F.size("m") - 1), F.slice("m", -1, 1)
    return c.select("conv_id", F.md5(P.chat_text(prompt)).alias("prompt_digest"), F.md5(F.get(last, 0)["content"]).alias("completion_digest"), big(F.size("m")).alias("n_messages"), big(P.count_tokens(prompt, last)).alias("n_tokens"))


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_ASK = f"{_q(P.ASK[0])} || d.text || {_q(P.ASK[1])} || d.source || {_q(P.ASK[2])} || CASE WHEN d.doc_id % 2 = 0 THEN 'Category definition: from ' || d.lang || chr(10) ELSE '' END || {_q(P.ASK[3])}"
_CLS = f"{_q(P.CLASSIFY[0])} || '- ' || {' || chr(10) || ' .join(_q(x) if i == 0 else _q('- ' + x) for i, x in enumerate(LABELS))} || {_q(P.CLASSIFY[1])} || d.text || {_q(P.CLASSIFY[2])}"


@query(f"""SELECT d.doc_id, md5({_q(P.SYSTEM)} || CASE WHEN l.toxic = 1 THEN {_CLS} ELSE {_ASK} END) AS prompt_digest, CASE WHEN l.toxic = 1 THEN d.lang ELSE '{{"present":' || CASE WHEN l.quality = 1 THEN 'true' ELSE 'false' END || ',"evidence":[' || CASE WHEN l.quality = 1 THEN '"q"' ELSE '' END || ']}}' END AS completion FROM documents d JOIN labels l USING (doc_id)""")
def record_prompts(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("excerpt", F.col("text"))
    about = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("from "), F.col("lang"))).otherwise("")
    task = F.when(F.col("toxic") == 1, "classification").otherwise("qa")
    target = P.qa_target(F.col("quality") == 1, F.array(F.lit("q")))
    prompt, completion = P.attach(task, P.classification_messages(F.col("excerpt"), F.lit(LABELS)), P.qa_messages(F.col("excerpt"), F.col("source"), about), F.col("lang"), target)
    d = d.withColumn("p", prompt).withColumn("c", completion)
    return d.select("doc_id", F.md5(F.array_join(F.transform("p", lambda m: m["content"]), "")).alias("prompt_digest"), F.get("c", 0)["content"].alias("completion"))


def _crop_sql(width: int) -> str:
    return f"""WITH {SPANS_SQL}, a AS (SELECT doc_id, item_id, text, n, s, q, greatest(0, least(s - (({width} - q) // 2), n - {width})) AS st FROM (SELECT doc_id, item_id, text, length(text) AS n, "start" AS s, "end" - "start" AS q FROM spans)),
b AS (SELECT *, least(n, st + {width}) AS en, strpos(substr(text, st + 1), ' ') AS sp FROM a),
c AS (SELECT *, CASE WHEN st > 0 AND sp > 0 AND st + sp <= s THEN st + sp ELSE st END AS st2 FROM b),
e AS (SELECT *, strpos(reverse(substr(text, st2 + 1, en - st2)), ' ') AS bk FROM c)
SELECT doc_id, item_id, CASE WHEN n <= {width} THEN text ELSE substr(text, st2 + 1, CASE WHEN en < n AND bk > 0 AND en - bk >= s + q THEN en - bk ELSE en END - st2) END AS cropped FROM e"""


@query(_crop_sql(400))
def crop_around(spark, sf_dir):
    s = spans(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return s.select("doc_id", "item_id", T.crop_around(F.col("text"), N.quote(F.col("text"), F.col("start"), F.col("end")), 400).alias("cropped"))


@query(f"""WITH u AS (SELECT conv_id, text, md5('demo-' || conv_id::VARCHAR) AS k FROM conversations WHERE turn = 0 AND role = 'user'), a AS (SELECT conv_id, text FROM conversations WHERE turn = 1 AND role = 'assistant'),
demo AS (SELECT string_agg('<|user|>' || chr(10) || u.text || chr(10) || '<|assistant|>' || chr(10) || a.text || chr(10), '' ORDER BY k, conv_id) AS d FROM (SELECT * FROM (SELECT u.*, row_number() OVER (ORDER BY k, u.conv_id) AS r FROM u JOIN a USING (conv_id)) WHERE r <= 3) u JOIN a USING (conv_id))
SELECT b.item_id, md5('<|system|>' || chr(10) || 'be exact' || chr(10) || d || '<|user|>' || chr(10) || b.text || chr(10) || '<|assistant|>' || chr(10)) AS prompt_digest FROM benchmark b, demo""")
def few_shot_messages(spark, sf_dir):
    c = read(spark, sf_dir, "conversations")
    pairs = c.where("turn = 0 and role = 'user'").select("conv_id", F.col("text").alias("u")).join(c.where("turn = 1 and role = 'assistant'").select("conv_id", F.col("text").alias("a")), "conv_id")
    three = pairs.withColumn("k", S.draw_key("demo", "conv_id")).orderBy("k", "conv_id").limit(3)
    demos = three.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "conv_id", "u", "a"))), lambda x: P.turns(x["u"], x["a"]))).alias("demos"))
    items = read(spark, sf_dir, "benchmark").withColumn("p", F.array(P.message("system", F.lit("be exact")), P.message("user", F.col("text"))))
    return items.join(F.broadcast(demos)).select("item_id", F.md5(P.chat_text(P.with_demos(F.col("p"), F.col("demos")))).alias("prompt_digest"))


@query(f"""WITH p AS (SELECT doc_id, {draw("'p-' || doc_id::VARCHAR")} / 4294967296.0::DOUBLE AS p FROM labels)
SELECT doc_id, CASE WHEN p >= 0.9 THEN 'high' WHEN p >= 0.7 THEN 'medium' ELSE 'low' END AS bucket, CASE WHEN p >= 0.995 THEN '>99%' WHEN p < 0.005 THEN '<1%' ELSE printf('%.0f%%', 100 * p) END AS shown, printf('%.1f%%', 100 * p) AS pct FROM p""")
def confidence_strings(spark, sf_dir):
    d = read(spark, sf_dir, "labels").withColumn("p", S.draw_number("p", "doc_id") / 4294967296.0)
    return d.select("doc_id", T.confidence_bucket(F.col("p")).alias("bucket"), T.shown_confidence(F.col("p")).alias("shown"), T.percent(F.col("p")).alias("pct"))
