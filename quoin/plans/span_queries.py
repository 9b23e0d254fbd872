"""Queries over spans, tokens and windows, and the samples drawn from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sampling as S
from ..operators import spans as N
from ..operators.grounding import passages
from ..sources.io import cut
from .base import SPANS_SQL, TOKENS_SQL, big, draw, query, read, remapped_sql, spans

W = 50


@query(f"WITH {TOKENS_SQL} SELECT doc_id, (idx // {W})::INT AS tile, min(ts)::INT AS ws, max(te)::INT AS we FROM tokens GROUP BY doc_id, idx // {W}")
def doc_tiles(spark, sf_dir):
    return N.tiles(N.token_arrays(read(spark, sf_dir, "documents")), W)


_PLACED = f"""{SPANS_SQL}, {TOKENS_SQL}, st AS (SELECT s.doc_id, s.item_id, min(CASE WHEN te > s."start" THEN idx END) AS f, max(CASE WHEN ts < s."end" THEN idx END) AS l, max(idx) + 1 AS n FROM spans s JOIN tokens t ON s.doc_id = t.doc_id GROUP BY s.doc_id, s.item_id),
lim AS (SELECT doc_id, item_id, f, greatest(f, l) AS l, n, greatest(0, greatest(f, l) + 1 - {W}) AS lo FROM st),
pos AS (SELECT doc_id, item_id, f, l, CASE WHEN l - f + 1 <= {W} THEN lo + {draw("'w-' || doc_id::VARCHAR || '-' || item_id::VARCHAR")} % (greatest(lo, least(f, greatest(0, n - {W}))) - lo + 1) END AS first_token FROM lim)"""


def _positives(spark, sf_dir):
    """Spans of documents with the window drawn around them: first_token, ws, we; and the spans."""
    docs = read(spark, sf_dir, "documents")
    own = spans(spark, sf_dir)
    placed = N.span_tokens(own, N.token_arrays(docs.join(own.select("doc_id").distinct(), "doc_id", "left_semi")))
    start = N.positive_start(F.col("first"), F.col("last"), F.col("n_tokens"), W, S.draw_number("w", "doc_id", "item_id"))
    placed = placed.withColumn("first_token", start)
    ws, we = N.window_edges(F.col("first_token"), W)
    return placed.withColumn("ws", ws).withColumn("we", we).drop("ts", "te"), own


@query(f"WITH {_PLACED} SELECT doc_id, item_id, f::BIGINT AS first, l::BIGINT AS last, first_token::BIGINT AS first_token FROM pos")
def positive_windows(spark, sf_dir):
    p, _ = _positives(spark, sf_dir)
    return p.select("doc_id", "item_id", big("first").alias("first"), big("last").alias("last"), big("first_token").alias("first_token"))


_WINDOWS = f"""{_PLACED}, win AS (SELECT p.doc_id, p.item_id, min(ts) AS ws, max(te) AS we FROM pos p JOIN tokens t ON t.doc_id = p.doc_id AND t.idx >= p.first_token AND t.idx < p.first_token + {W} GROUP BY p.doc_id, p.item_id)"""


@query(f"""WITH {_WINDOWS} SELECT w.doc_id, w.item_id, count(*) FILTER (s."start" >= ws AND s."end" <= we)::BIGINT AS n_full, coalesce(bool_or(NOT (s."start" >= ws AND s."end" <= we)), false) AS cut, min(s."start") FILTER (s."start" >= ws AND s."end" <= we)::BIGINT AS first_full
FROM win w LEFT JOIN spans s ON s.doc_id = w.doc_id AND s."start" < we AND s."end" > ws GROUP BY w.doc_id, w.item_id""")
def evidence_in_window(spark, sf_dir):
    p, own = _positives(spark, sf_dir)
    windows = p.where("ws is not null").select("doc_id", "item_id", "ws", "we")
    met = N.evidence_in_windows(windows, own.select("doc_id", "start", "end"), ["doc_id"], ["doc_id", "item_id"])
    return met.select("doc_id", "item_id", "n_full", "cut", big("first_full").alias("first_full"))


_TILES = f"{SPANS_SQL}, {TOKENS_SQL}, tiles AS (SELECT doc_id, (idx // {W})::INT AS tile, min(ts) AS ws, max(te) AS we FROM tokens GROUP BY doc_id, idx // {W})"


@query(f"""WITH {_TILES} SELECT t.doc_id, count(*)::BIGINT AS n_free, min(tile)::BIGINT AS first_free, max(tile)::BIGINT AS last_free FROM tiles t
WHERE EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = t.doc_id) AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = t.doc_id AND s."start" < t.we AND s."end" > t.ws) GROUP BY t.doc_id""")
def free_windows(spark, sf_dir):
    own = spans(spark, sf_dir).select("doc_id", "start", "end")
    docs = read(spark, sf_dir, "documents").join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    free = N.free_windows(N.tiles(N.token_arrays(docs), W), own, ["doc_id"])
    return free.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_free"), big(F.min("tile")).alias("first_free"), big(F.max("tile")).alias("last_free"))


@query(f"""WITH {_TILES}, cat AS (SELECT DISTINCT doc_id, category FROM spans),
pos AS (SELECT doc_id * 1000 + item_id AS pos_id, doc_id, category FROM spans),
hard AS (SELECT c.doc_id, c.category, tile, row_number() OVER (PARTITION BY c.doc_id, c.category ORDER BY md5('neg-' || tile::VARCHAR), tile) - 1 AS k, count(*) OVER (PARTITION BY c.doc_id, c.category) AS n FROM tiles t JOIN cat c USING (doc_id)
 WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = t.doc_id AND s.category = c.category AND s."start" < t.we AND s."end" > t.ws)),
holders AS (SELECT DISTINCT doc_id FROM spans), cats AS (SELECT DISTINCT category FROM spans),
easy AS (SELECT h.doc_id, k.category, tile FROM tiles t JOIN holders h USING (doc_id), cats k WHERE NOT EXISTS (SELECT 1 FROM cat c WHERE c.doc_id = h.doc_id AND c.category = k.category)),
own AS (SELECT category, doc_id, row_number() OVER (PARTITION BY category ORDER BY md5('neg-' || doc_id::VARCHAR), doc_id) - 1 AS k, count(*) OVER (PARTITION BY category) AS n FROM (SELECT DISTINCT category, doc_id FROM easy)),
et AS (SELECT category, doc_id, tile, row_number() OVER (PARTITION BY category, doc_id ORDER BY tile) - 1 AS t, count(*) OVER (PARTITION BY category, doc_id) AS n FROM easy),
p AS (SELECT pos.*, coalesce((SELECT max(n) FROM hard h WHERE h.doc_id = pos.doc_id AND h.category = pos.category), 0) AS nh, coalesce((SELECT max(n) FROM own o WHERE o.category = pos.category), 0) AS ne, {draw("'neg-coin-' || pos_id::VARCHAR")} < 2147483648 AS coin, {draw("'neg-' || pos_id::VARCHAR")} AS dr, {draw("'neg-tile-' || pos_id::VARCHAR")} AS td FROM pos),
q AS (SELECT *, CASE WHEN nh > 0 AND (coin OR ne = 0) THEN 'same_contract' WHEN ne > 0 THEN 'other_contract' END AS neg_type FROM p)
SELECT pos_id, q.category, neg_type, h.doc_id AS neg_contract_id, h.tile::BIGINT AS tile FROM q JOIN hard h ON neg_type = 'same_contract' AND h.doc_id = q.doc_id AND h.category = q.category AND h.k = dr % nh
UNION ALL SELECT pos_id, q.category, neg_type, o.doc_id, et.tile::BIGINT FROM q JOIN own o ON neg_type = 'other_contract' AND o.category = q.category AND o.k = dr % ne JOIN et ON et.category = q.category AND et.doc_id = o.doc_id AND et.t = td % et.n""")
def matched_negatives(spark, sf_dir):
    own = spans(spark, sf_dir)
    docs = read(spark, sf_dir, "documents").join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    tiles = N.tiles(N.token_arrays(docs), W)
    cats = own.select("doc_id", "category").distinct()
    hard = N.free_windows(tiles.join(cats, "doc_id"), own.select("doc_id", "category", "start", "end"), ["doc_id", "category"])
    contract = lambda d, *c: d.select(F.col("doc_id").alias("contract_id"), *c)
    pos = contract(own.withColumn("pos_id", F.col("doc_id") * 1000 + F.col("item_id")), "pos_id", "category")
    out = S.matched_negatives(pos, contract(tiles, "tile"), contract(hard, "category", "tile"), contract(cats, "category"), "neg")
    return out.select("pos_id", "category", "neg_type", "neg_contract_id", big("tile").alias("tile"))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('bal-' || doc_id::VARCHAR), doc_id) AS r FROM documents) ORDER BY r, md5('bal-' || source), source LIMIT 50""")
def balanced_sample(spark, sf_dir):
    return S.balanced_sample(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 50, "bal")


@query("""SELECT source, good, doc_id, rank::BIGINT AS rank FROM (SELECT d.source, l.quality = 1 AS good, d.doc_id, row_number() OVER (PARTITION BY d.source, l.quality = 1 ORDER BY md5('fs-' || d.doc_id::VARCHAR), d.doc_id) AS rank FROM documents d JOIN labels l USING (doc_id))
WHERE rank <= CASE WHEN good THEN 2 ELSE 1 END""")
def fewshot_pick(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").select("source", (F.col("quality") == 1).alias("good"), "doc_id")
    return S.first_k(d, ["source", "good"], "doc_id", 2, "fs").where("good or rank = 1").select("source", "good", "doc_id", big("rank").alias("rank"))


@query("""SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('dl-' || doc_id::VARCHAR), doc_id) AS r FROM documents) WHERE r = 1 ORDER BY md5('dl-' || doc_id::VARCHAR), doc_id LIMIT 3""")
def distinct_label_k(spark, sf_dir):
    return S.distinct_labels(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 3, "dl")


SPLITS = [("train", 0.8), ("val", 0.1), ("test", 0.1)]


@query()
def stratified_split(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    toxic = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>"))
    return S.stratified_split(d.select(F.col("doc_id").alias("item_id"), F.concat(F.array("lang"), toxic).alias("labels")), SPLITS, "42")


@query("""SELECT doc_id, CASE WHEN share <= 0.8 THEN 'train' WHEN share <= 0.9 THEN 'val' ELSE 'test' END AS split FROM (SELECT doc_id, (row_number() OVER (PARTITION BY lang ORDER BY md5('42-' || doc_id::VARCHAR), doc_id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY lang) AS share FROM documents)""")
def ranked_split(spark, sf_dir):
    d = S.split_by_rank(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", SPLITS, "42")
    return d.select("doc_id", "split")


@query("""WITH s AS (SELECT d.doc_id, 0 AS s, 10 AS e, unnest([d.lang, d.source, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE 'clean' END]) AS category FROM documents d JOIN labels l USING (doc_id)), n AS (SELECT category, count(*) AS n FROM s GROUP BY category)
SELECT doc_id, string_agg(category, ',' ORDER BY n, category) AS labels, arg_min(category, struct_pack(n := n, c := category)) AS target FROM s JOIN n USING (category) GROUP BY doc_id""")
def rarest_label(spark, sf_dir):
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id")
    kinds = F.array("lang", "source", F.when(F.col("toxic") == 1, "toxic").otherwise("clean"))
    s = d.select("doc_id", F.lit(0).alias("start"), F.lit(10).alias("end"), F.explode(kinds).alias("category"))
    rarity = s.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return N.multi_label(s, rarity).select("doc_id", F.array_join("labels", ",").alias("labels"), "target")


@query("""SELECT split, lang, count(*)::BIGINT AS n, max(n_chars)::BIGINT AS longest, count(DISTINCT source)::BIGINT AS n_sources FROM (SELECT *, CASE doc_id % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY split, lang""")
def label_counts(spark, sf_dir):
    split = F.when(F.col("doc_id") % 10 == 0, "val").when(F.col("doc_id") % 10 == 1, "test").otherwise("train")
    return read(spark, sf_dir, "documents").groupBy(split.alias("split"), "lang").agg(F.count(F.lit(1)).alias("n"), big(F.max("n_chars")).alias("longest"), F.countDistinct("source").alias("n_sources"))


@query("""WITH d AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS dup FROM documents),
r AS (SELECT CASE WHEN n > 6000 THEN 'span_too_long' WHEN doc_id % 5 = 0 THEN 'cut_by_window_edge' WHEN n > 1500 THEN 'evidence_too_long' WHEN dup THEN 'duplicate' ELSE 'used' END AS reason FROM d) SELECT reason, count(*)::BIGINT AS n FROM r GROUP BY reason""")
def skip_reasons(spark, sf_dir):
    from pyspark.sql import Window

    dup = F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id")) > 1
    d = read(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), dup.alias("dup"))
    why = N.skip_reason(F.col("n") > 6000, F.col("doc_id") % 5 == 0, F.col("n"), F.col("dup"))
    return d.select(F.coalesce(why, F.lit("used")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, length(text)::BIGINT AS n, md5(left(text, 1500)) AS kept FROM documents WHERE length(text) >= 100""")
def clause_filter(spark, sf_dir):
    d = read(spark, sf_dir, "documents").where(F.length("text") >= 100)
    return d.select("doc_id", big(F.length("text")).alias("n"), F.md5(F.left("text", F.lit(1500))).alias("kept"))


@query("""WITH t AS (SELECT conv_id, sum(length(text)) AS chars, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id) SELECT conv_id, chars::BIGINT AS chars FROM t WHERE chars <= 1500""")
def evidence_length_filter(spark, sf_dir):
    e = read(spark, sf_dir, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.collect_list("text").alias("evidence"))
    total = F.aggregate("evidence", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return e.select("conv_id", total.alias("chars")).where("chars <= 1500")


@query("""SELECT doc_id, id FROM (SELECT doc_id, n_chars, 'eval-' || lang || '-' || lpad((row_number() OVER (PARTITION BY lang ORDER BY md5('id-' || doc_id::VARCHAR), doc_id) - 1)::VARCHAR, 5, '0') AS id FROM documents) WHERE n_chars <= 5000""")
def id_assign(spark, sf_dir):
    d = S.with_ids(read(spark, sf_dir, "documents"), F.concat(F.lit("eval-"), F.col("lang")), ["lang"], S.draw_key("id", "doc_id"), ["doc_id"])
    return d.where("n_chars <= 5000").select("doc_id", "id")


@query("""SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) AS r FROM documents) WHERE r = 1""")
def first_of_duplicates(spark, sf_dir):
    return S.first_of_duplicates(read(spark, sf_dir, "documents"), ["source", "lang"], ["n_chars", "doc_id"]).select("source", "lang", "doc_id")


_MESSY = "replace({}, '. ', '. ' || chr(9) || ' ')"


@query(remapped_sql(_MESSY, "d.source AS category, ", """SELECT DISTINCT doc_id, category, 'from ' || category AS description, s::BIGINT AS span_start, e2::BIGINT AS span_end, substr(norm, s + 1, e2 - s) AS quoted, true AS is_normal FROM f WHERE e2 > s"""))
def corpus_parse(spark, sf_dir):
    """Documents as one nested corpus with messy white space, parsed back to spans."""
    docs, b = read(spark, sf_dir, "documents").withColumnRenamed("source", "category"), read(spark, sf_dir, "benchmark")
    messy = F.replace("text", F.lit(". "), F.lit(". \t "))
    s = passages(docs, b, ["doc_id", "category", "text"]).select("doc_id", "category", "item_id", messy.alias("raw"))
    s = s.join(b.select("item_id", messy.alias("q")), "item_id").where(F.contains("raw", F.col("q")))
    qa = F.struct(F.concat(F.lit('Highlight "'), F.col("category"), F.lit('". Details: from '), F.col("category")).alias("question"), F.array(F.struct(F.col("q").alias("text"), (F.instr("raw", F.col("q")) - 1).alias("answer_start"))).alias("answers"))
    docs = s.groupBy("doc_id", "raw").agg(F.collect_list(qa).alias("qas"))
    data = docs.select(F.array(F.struct(F.col("doc_id").cast("string").alias("title"), F.array(F.struct(F.col("raw").alias("context"), "qas")).alias("paragraphs"))).alias("data"))
    contracts, found, about = N.parse_corpus(cut(data))  # it names the corpus several times
    out = found.join(contracts, "contract_id").join(about, "category")
    return out.select(F.col("contract_id").cast("long").alias("doc_id"), "category", "description", big("start").alias("span_start"), big("end").alias("span_end"), N.quote(F.col("text"), F.col("start"), F.col("end")).alias("quoted"), T.normalize_ws(F.col("text")).eqNullSafe(F.col("text")).alias("is_normal"))
