"""From annotated contracts to chat records: splits, windows, positives, negatives, prompts, ids."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import cut
from . import prompts as P
from . import sampling as S
from . import spans as N


@dataclass(frozen=True)
class Config:
    """Knobs that change what is built."""

    excluded: tuple[str, ...] = ()
    fractions: tuple[tuple[str, float], ...] = (("train", 0.8), ("val", 0.1), ("test", 0.1))
    seed: str = "42"
    window_tokens: int = 1200
    max_evidence_chars: int = 1500
    hard_negative_ratio: float = 0.5
    min_clause_chars: int = 15
    max_clause_chars: int = 1500
    max_tokens: int = 2048
    #: split -> (classification items, QA items)
    sizes: dict[str, tuple[int, int]] = field(default_factory=lambda: {"train": (1500, 1500), "val": (100, 50), "test": (200, 200)})
    present_ratio: float = 0.5


def classification_items(contracts: DataFrame, spans: DataFrame, rarity: DataFrame, cfg: Config) -> DataFrame:
    """contract_id, clause, labels, target: one item for each distinct range long enough, its text cut to the limit."""
    ranges = N.multi_label(spans, rarity, "contract_id").join(contracts, "contract_id")
    clause = N.quote(F.col("text"), F.col("start"), F.col("end"))
    long = ranges.withColumn("clause", clause).where(F.length("clause") >= cfg.min_clause_chars)
    return long.select("contract_id", "start", "end", F.left("clause", F.lit(cfg.max_clause_chars)).alias("clause"), "labels", "target")


def qa_positives(contracts: DataFrame, spans: DataFrame, toks: DataFrame, cfg: Config) -> DataFrame:
    """A window around each span with its evidence and ``reason``, null where the positive is used.

    Reasons in order: span_too_long, cut_by_window_edge, evidence_too_long, duplicate (category and evidence seen before).
    """
    placed = N.span_tokens(spans, toks, "contract_id")
    draw = S.draw_number(cfg.seed, "contract_id", "category", "start")
    placed = placed.withColumn("first_token", N.positive_start(F.col("first"), F.col("last"), F.col("n_tokens"), cfg.window_tokens, draw))
    keys = ["contract_id", "category", "start", "end"]
    ws, we = N.window_edges(F.col("first_token"), cfg.window_tokens)
    windows = placed.select(*keys, ws.alias("ws"), we.alias("we"))
    same = spans.select(F.col("contract_id").alias("_c"), F.col("category").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = windows.join(same, (F.col("contract_id") == F.col("_c")) & (F.col("category") == F.col("_k")) & (F.col("_s") < F.col("we")) & (F.col("_e") > F.col("ws")), "left")
    met = met.join(contracts, "contract_id").withColumn("rel", N.relation(F.col("_s"), F.col("_e"), F.col("ws"), F.col("we")))
    full = F.when(F.col("rel") == "full", F.struct("_s", "_e", N.quote(F.col("text"), F.col("_s"), F.col("_e")).alias("q")))
    rows = met.groupBy(*keys, "ws", "we").agg(F.array_sort(F.collect_list(full)).alias("f"), F.coalesce(F.bool_or(F.col("rel") == "partial"), F.lit(False)).alias("cut"))
    rows = rows.withColumn("evidence", F.array_distinct(F.transform("f", lambda x: x["q"]))).withColumn("chars", F.aggregate("evidence", F.lit(0), lambda a, q: a + F.length(q)))
    early = N.skip_reason(F.col("ws").isNull(), F.col("cut"), F.col("chars"), F.lit(False), cfg.max_evidence_chars)
    rows = rows.withColumn("early", early)
    # a duplicate is one of a positive that passed the other tests
    again = F.row_number().over(Window.partitionBy("contract_id", "category", "evidence", F.col("early").isNull()).orderBy("start", "end")) > 1
    return rows.withColumn("reason", F.coalesce("early", F.when(again, "duplicate"))).drop("f", "early")


def qa_set(positives: DataFrame, spans: DataFrame, tiles: DataFrame, cfg: Config, n: int, seed: str) -> DataFrame:
    """contract_id, category, ws, we, present, evidence, neg_type of one split: balanced positives and matched negatives."""
    n_pos = round(n * cfg.present_ratio)  # half to even
    used = positives.where("reason is null").withColumn("pos_id", F.concat_ws("/", "contract_id", "category", F.col("start").cast("string"), F.col("end").cast("string")))
    picked = cut(S.balanced_sample(used, "category", "pos_id", n_pos, seed))
    cats = spans.select("contract_id", "category").distinct()
    hard = cut(N.free_windows(tiles.join(cats, "contract_id"), spans, ["contract_id", "category"]).select("contract_id", "category", "tile"))
    negatives = S.matched_negatives(picked.select("pos_id", "contract_id", "category"), tiles.select("contract_id", "tile"), hard, cats, seed, cfg.hard_negative_ratio)
    negatives = negatives.orderBy(S.draw_key(seed, "pos_id")).limit(n - n_pos).withColumnRenamed("neg_contract_id", "contract_id").join(tiles, ["contract_id", "tile"])
    none = F.array().cast("array<string>")
    a = picked.select("contract_id", "category", "ws", "we", F.lit(True).alias("present"), "evidence", F.lit(None).cast("string").alias("neg_type"))
    return a.unionByName(negatives.select("contract_id", "category", "ws", "we", F.lit(False).alias("present"), none.alias("evidence"), "neg_type"))


def build(contracts: DataFrame, spans: DataFrame, descriptions: DataFrame, labels: list[str], cfg: Config = Config()) -> DataFrame:
    """All records of all splits: split, id, task, contract_id, prompt, completion, n_tokens and the fields that scoring
    needs. Over-long records are dropped after ids are given, so ids may have gaps; ``pos`` is the shuffled place."""
    kept = [x for x in labels if x not in set(cfg.excluded)]
    rarity = spans.groupBy("category").agg(F.count(F.lit(1)).alias("n"))  # over all spans, excluded ones too
    own = spans.where(F.col("category").isin(kept))
    sets = contracts.select("contract_id").join(own.groupBy("contract_id").agg(F.collect_set("category").alias("labels")), "contract_id", "left")
    sets = sets.select(F.col("contract_id").alias("item_id"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    splits = S.stratified_split(sets, list(cfg.fractions), cfg.seed).withColumnRenamed("item_id", "contract_id")
    toks = N.token_arrays(contracts, "contract_id")
    tiles = N.tiles(toks, cfg.window_tokens, "contract_id")
    # each is named several times below: written, so that neither plans nor work multiply
    splits, tiles = cut(splits), cut(tiles)
    items = cut(classification_items(contracts, own, rarity, cfg))
    positives = cut(qa_positives(contracts, own, toks, cfg))
    out = None
    for split, (n_cls, n_qa) in cfg.sizes.items():
        part = splits.where(F.col("split") == split).select("contract_id")
        inside = lambda df: df.join(part, "contract_id", "left_semi")
        seed = f"{cfg.seed}-{split}"
        cls = S.balanced_sample(inside(items).withColumn("item", F.concat_ws("/", "contract_id", F.col("start").cast("string"), F.col("end").cast("string"))), "target", "item", n_cls, seed)
        cls = cls.select(F.lit("classification").alias("task"), "contract_id", "clause", "labels", F.col("target").alias("target_label"))
        qa = qa_set(inside(positives), inside(own), inside(tiles), cfg, n_qa, seed).join(contracts, "contract_id").join(descriptions, "category", "left")
        qa = qa.select(F.lit("qa").alias("task"), "contract_id", "category", N.quote(F.col("text"), F.col("ws"), F.col("we")).alias("excerpt"), "present", "evidence", "neg_type", "description")
        both = cls.unionByName(qa, allowMissingColumns=True).withColumn("split", F.lit(split))
        both = cut(both)
        out = both if out is None else out.unionByName(both)
    verbatim = F.forall(F.coalesce("evidence", F.array().cast("array<string>")), lambda q: F.contains(F.col("excerpt"), q))
    out = out.withColumn("present", F.when(verbatim, F.col("present")).otherwise(F.raise_error(F.lit("evidence isn't in its excerpt")).cast("boolean")))
    prompt, completion = P.attach(F.col("task"), P.classification_messages(F.col("clause"), F.lit(kept)), P.qa_messages(F.col("excerpt"), F.col("category"), F.coalesce("description", F.lit(""))), F.col("target_label"), P.qa_target(F.col("present"), F.col("evidence")))
    out = out.withColumn("prompt", prompt).withColumn("completion", completion).withColumn("n_tokens", P.count_tokens(F.col("prompt"), F.col("completion")))
    key = F.md5(P.contents(F.col("prompt"), F.col("completion")))
    out = S.with_ids(cut(out.withColumn("key", key)), F.concat_ws("-", "split", "task"), ["split", "task"], F.col("key"), ["contract_id"]).drop("key").where(F.col("n_tokens") <= cfg.max_tokens)
    return S.ranked(cut(out), ["split"], S.draw_key(cfg.seed, "id"), ["id"]).withColumnRenamed("_rank", "pos").drop("description", "_size")
