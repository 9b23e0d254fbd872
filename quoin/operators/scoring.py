"""Scoring of predictions: per-item rows, rates, calibration, bootstrap intervals, audits and the comparison table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.parsing import parse_label, parse_qa
from ..functions.text import fold, is_grounded, shown, token_f1
from ..sources.io import cut

INVALID = "<invalid>"
BINS = 10
#: Draws that are counted together, and the kinds of rows that are counted.
STRETCH, KINDS = 65_536, 4_096


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows that share a key the last."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def with_predictions(items: DataFrame, predictions: DataFrame, order: str) -> DataFrame:
    """Items with their predictions (columns of both, ``id`` once); the last prediction of an id counts, one without an
    item is ignored, and an item without one is an error."""
    joined = items.join(last_by(predictions, "id", order).withColumn("_met", F.lit(1)), "id", "left")
    checked = F.when(F.col("_met").isNull(), F.raise_error(F.concat(F.lit("no prediction for item "), F.col("id").cast("string")))).otherwise(F.lit(1))
    return joined.withColumn("_met", checked).where("_met = 1").drop("_met")


def score_classification(rows: DataFrame, labels: list[str]) -> DataFrame:
    """From id, labels (gold), target_label, output, confidence: gold, pred, y_true, correct, valid, confidence."""
    p = rows.withColumn("_p", parse_label(F.col("output"), labels))
    correct = F.coalesce(F.array_contains("labels", F.col("_p.label")), F.lit(False))
    return p.select(
        "id", F.col("labels").alias("gold"), F.coalesce("_p.label", F.lit(INVALID)).alias("pred"),
        F.when(correct, F.col("_p.label")).otherwise(F.col("target_label")).alias("y_true"), correct.alias("correct"), F.col("_p.valid").alias("valid"), "confidence",
    )


def score_qa(rows: DataFrame) -> DataFrame:
    """From id, category, neg_type, excerpt, present, evidence, output, p_present: the fifteen scored columns.

    An answer that can't be read is neither present nor absent, so it is never correct.
    """
    r = rows.withColumn("_p", parse_qa(F.col("output"))).withColumn("_h", fold(F.col("excerpt")))
    quotes = F.col("_p.evidence")
    r = r.withColumn("_bad", F.size(F.filter(quotes, lambda q: ~is_grounded(q, F.col("_h")))))
    said = F.coalesce(F.col("_p.present"), F.lit(False))
    ungrounded, fabricated = said & (F.col("_bad") > 0), said & ~F.col("present")
    p = F.col("p_present")
    return r.select(
        "id", "category", "neg_type", F.col("present").alias("gold_present"), F.col("_p.present").alias("pred_present"), F.col("_p.present").eqNullSafe(F.col("present")).alias("correct"),
        F.col("_p.valid").alias("valid"), fabricated.alias("fabricated"), ungrounded.alias("ungrounded"), (fabricated | ungrounded).alias("hallucinated"),
        F.size(quotes).alias("n_quotes"), F.col("_bad").alias("n_ungrounded_quotes"),
        F.when(said & F.col("present"), token_f1(F.array_join(quotes, " "), F.array_join("evidence", " "))).alias("evidence_f1"),
        F.when(p.isNotNull(), F.greatest(p, 1 - p)).alias("confidence"), F.when(p.isNotNull(), (p > 0.5) == F.col("present")).alias("conf_correct"),
    )


def rate(flag: Column, among: Column | None = None) -> Column:
    """The mean of a flag, over the rows where ``among`` holds; null if there are none."""
    x = flag.cast("double")
    return F.avg(x if among is None else F.when(among, x))


def qa_rates() -> list[Column]:
    said, gold, quoted = F.coalesce(F.col("pred_present"), F.lit(False)), F.col("gold_present"), F.col("n_quotes") > 0
    by = {f"fabricated_rate_{k}": rate(F.col("fabricated"), ~gold & (F.col("neg_type") == k)) for k in ("same_contract", "other_contract")}
    named = {
        "presence_accuracy": rate(F.col("correct")), "hallucination_rate": rate(F.col("hallucinated")), "fabricated_rate": rate(F.col("fabricated"), ~gold), "ungrounded_rate": rate(F.col("ungrounded"), said & quoted),
        "missed_rate": rate(~said, gold), "present_without_quote_rate": rate(~quoted, said), "evidence_f1": F.avg(F.when(said & gold, F.col("evidence_f1"))), "format_valid_rate": rate(F.col("valid")),
    }
    return [c.alias(k) for k, c in {**named, **by}.items()]


def classification_rates() -> list[Column]:
    return [rate(F.col("correct")).alias("accuracy"), rate(F.col("valid")).alias("format_valid_rate")]


def macro_f1(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean F1 over the labels that occur in ``y_true``."""
    by = by or []
    hit = F.col("y_true") == F.col("pred")
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), hit.cast("int").alias("tp"), (~hit).cast("int").alias("fn"), F.lit(0).alias("fp"), F.lit(1).alias("seen")),
        F.struct(F.col("pred").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("fn"), (~hit).cast("int").alias("fp"), F.lit(0).alias("seen")),
    )
    per = rows.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.label").agg(*(F.sum(f"s.{c}").alias(c) for c in ("tp", "fn", "fp", "seen"))).where("seen > 0")
    return per.groupBy(*by).agg(F.avg(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("macro_f1"))


def reliability_bins(rows: DataFrame, confidence: str, correct: str, bins: int = BINS) -> DataFrame:
    """bin, n, accuracy, mean_confidence of the bins that have rows; null confidences are left out."""
    scored = rows.where(F.col(confidence).isNotNull())
    at = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), rate(F.col(correct)).alias("accuracy"), F.avg(confidence).alias("mean_confidence"))


def ece(rows: DataFrame, confidence: str, correct: str, bins: int = BINS) -> DataFrame:
    """Expected calibration error; NaN without rows."""
    gap = F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")
    return reliability_bins(rows, confidence, correct, bins).agg(F.coalesce(gap, F.lit(float("nan"))).alias("ece"))


def brier(confidence: Column, correct: Column) -> Column:
    """Mean squared error of confidences, an aggregate; NaN without rows."""
    return F.coalesce(F.avg(F.pow(confidence - correct.cast("double"), F.lit(2))), F.lit(float("nan")))


def auroc(rows: DataFrame, confidence: str, correct: str) -> DataFrame:
    """Chance that a correct row has more confidence than a wrong one, ties half; null if a class is empty.

    Rows are summed up by confidence first, and the running sum goes by ranges of ``BUCKETS`` parts of the unit interval,
    so no task gets all confidences.
    """
    buckets = 1024
    per = rows.where(F.col(confidence).isNotNull()).groupBy(F.col(confidence).alias("p")).agg(F.sum(F.col(correct).cast("long")).alias("pos"), F.sum((~F.col(correct)).cast("long")).alias("neg"))
    per = per.withColumn("bucket", F.floor(F.col("p") * buckets))
    totals = per.groupBy("bucket").agg(F.sum("neg").alias("own"))
    before = totals.withColumn("base", F.coalesce(F.sum("own").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("bucket", "base")
    inside = Window.partitionBy("bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    lower = per.join(F.broadcast(before), "bucket").withColumn("lo", F.col("base") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    wins, pairs = F.sum(F.col("pos") * (F.col("lo") + F.lit(0.5) * F.col("neg"))), (F.sum("pos") * F.sum("neg")).cast("double")
    return lower.agg(F.when(pairs > 0, wins / pairs).alias("auroc"))


def calibration(rows: DataFrame, confidence: str = "confidence", correct: str = "conf_correct", bins: int = BINS) -> DataFrame:
    """n_with_confidence, mean_confidence, ece, brier, auroc in one row; the last three are null when nothing is scored."""
    scored = rows.where(F.col(confidence).isNotNull())
    whole = scored.agg(F.count(F.lit(1)).alias("n_with_confidence"), F.avg(confidence).alias("mean_confidence"), F.when(F.count(F.lit(1)) > 0, brier(F.col(confidence), F.col(correct))).alias("brier"))
    e = ece(scored, confidence, correct, bins).select(F.when(~F.isnan("ece"), F.col("ece")).alias("ece"))
    return whole.join(e).join(auroc(scored, confidence, correct))


def ordinals(rows: DataFrame, order: str, parts: int = 64, sample: int = 4096) -> DataFrame:
    """``rows`` with ``_j``: the place of a row by ``order``, from 0. Edges of ``parts`` ranges come from a bounded sample;
    rows are numbered in their range, and the sizes of the ranges before are added, so no task numbers all rows."""
    some = sorted(r[0] for r in rows.where(F.col(order).isNotNull()).select(order).orderBy(F.xxhash64(order)).limit(sample).collect())
    edges = sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []
    part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order))) if edges else F.lit(0)
    own = rows.withColumn("_part", F.when(F.col(order).isNull(), -1).otherwise(part))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    sizes = own.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a range
    return own.withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("_j", (F.col("_before") + F.col("_inside")).cast("long")).select("_j", *rows.columns)


def _draws(n: int, n_boot: int, seed: str, kind: np.ndarray, n_kinds: int):
    """A function for ``mapInArrow``: of each number of a stretch of draws the replicate, the kinds drawn and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, names = -1, []
        for batch in batches:
            for one in batch.column(0).to_pylist():
                stretch, b = divmod(one, n_boot)
                if stretch != at:
                    at, names = stretch, [b"%d" % i for i in range(stretch * STRETCH, min(n, (stretch + 1) * STRETCH))]
                head = f"{seed}-{b}-".encode()
                digests = b"".join([hashlib.md5(head + i, usedforsecurity=False).digest() for i in names])
                times = np.bincount(kind[np.frombuffer(digests, ">u4")[::4] % n], minlength=n_kinds)
                own = np.flatnonzero(times)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), b), pa.int32()), pa.array(own, pa.int32()), pa.array(times[own], pa.int32())], names=["b", "_k", "_times"])

    return run


def replicates(rows: DataFrame, order: str, n_boot: int, seed: str = "b") -> DataFrame:
    """``rows`` without ``order``, drawn with replacement, as many as there are, ``n_boot`` times (column ``b``).

    Draw i of replicate b takes row md5(seed-b-i) mod n. Rows are worked out once. Those alike but for ``order`` are a kind;
    the kinds of all rows, two bytes a row, go to the workers, which count the kinds in stretches of draws, so no draw is
    shuffled; counted kinds become rows again where they are summed up. With over KINDS kinds the draws are joined to the rows.
    """
    rows = cut(rows)
    spark, columns = rows.sparkSession, [c for c in rows.columns if c != order]
    numbered, n = ordinals(rows, order), rows.count()
    kinds = rows.select(*columns).distinct().limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        draws = spark.range(n_boot * n).select(F.floor(F.col("id") / max(n, 1)).cast("int").alias("b"), (F.col("id") % max(n, 1)).alias("_i"))
        number = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col("b").cast("string"), F.col("_i").cast("string"))), 1, 8), 16, 10).cast("long")
        return draws.withColumn("_j", number % max(n, 1)).join(numbered, "_j").select("b", *columns)
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(kinds)], StructType([StructField("_k", IntegerType()), *(rows.schema[c] for c in columns)]))
    same = F.lit(True)
    for c in columns:
        same = same & numbered[c].eqNullSafe(table[c])
    of = numbered.join(F.broadcast(table), same).select("_j", F.col("_k").cast("short").alias("_k"))
    parts = of.groupBy(F.floor(F.col("_j") / STRETCH).alias("_at")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_k"))), lambda x: x["_k"]).alias("k"))
    told = parts.toArrow().sort_by("_at").column("k")
    kind = np.concatenate([c.flatten().to_numpy() for c in told.chunks]) if n else np.zeros(0, np.int16)
    stretches = -(-n // STRETCH) * n_boot
    numbers = spark.range(0, stretches, 1, max(1, min(stretches, max(spark.sparkContext.defaultParallelism * 4, stretches // 256))))
    sent = spark.sparkContext.broadcast(kind)
    run = lambda batches: _draws(n, n_boot, seed, sent.value, len(kinds))(batches)
    drawn = numbers.mapInArrow(run, "b int, _k int, _times int").join(F.broadcast(table), "_k")
    return drawn.select("b", *columns, F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_one")).drop("_one")


def interval(values: DataFrame, value: str, alpha: float = 0.05) -> DataFrame:
    """lo, hi: the sorted replicate values at places int(alpha/2 * m) and int((1 - alpha/2) * m) - 1; nulls don't count."""
    ranked = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.orderBy("v"))).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy()))
    at = lambda r: F.max(F.when(F.col("r") == r, F.col("v")))
    return ranked.agg(at(F.floor(F.lit(alpha / 2) * F.col("m")) + 1).alias("lo"), at(F.floor(F.lit(1 - alpha / 2) * F.col("m"))).alias("hi"))


def bootstrap(rows: DataFrame, aggregate: Column, order: str, n_boot: int = 1000, alpha: float = 0.05, seed: str = "b") -> DataFrame:
    return interval(replicates(rows, order, n_boot, seed).groupBy("b").agg(aggregate.alias("v")), "v", alpha)


def audited(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Scored rows with audited flags: ``label_gap`` voids fabricated, ``scorer_artifact`` ungrounded. A flagged row
    without a verdict is an error."""
    joined = rows.join(audit.select("id", "verdict"), "id", "left")
    known = F.when(F.col("hallucinated") & F.col("verdict").isNull(), F.raise_error(F.concat(F.lit("no verdict for "), F.col("id").cast("string")))).otherwise(F.lit(True))
    joined = joined.withColumn("_ok", known).where("_ok").drop("_ok")
    fab = F.col("fabricated") & ~F.col("verdict").eqNullSafe(F.lit("label_gap"))
    ung = F.col("ungrounded") & ~F.col("verdict").eqNullSafe(F.lit("scorer_artifact"))
    return joined.withColumn("fabricated_audited", fab).withColumn("ungrounded_audited", ung).withColumn("hallucinated_audited", fab | ung)


# The rows of the comparison table (task, metric, shown as).
TABLE = [
    ("classification", "accuracy", "pct"), ("classification", "macro_f1", "num"), ("qa", "presence_accuracy", "pct"), ("qa", "hallucination_rate", "pct"), ("qa", "hallucination_rate_audited", "pct"),
    ("qa", "fabricated_rate", "pct"), ("qa", "fabricated_rate_same_contract", "pct"), ("qa", "fabricated_rate_other_contract", "pct"), ("qa", "fabricated_rate_audited", "pct"), ("qa", "ungrounded_rate", "pct"),
    ("qa", "missed_rate", "pct"), ("qa", "evidence_f1", "num"), ("qa", "ece", "num"), ("qa", "brier", "num"), ("qa", "auroc", "num"), ("classification", "ece", "num"), ("classification", "format_valid_rate", "pct"), ("qa", "format_valid_rate", "pct"),
]


def comparison(metrics: DataFrame, runs: list[str]) -> DataFrame:
    """pos, task, metric and a column of shown figures for each run, from (run, task, metric, value, lo, hi)."""
    spark = metrics.sparkSession
    spec = spark.createDataFrame([(i, *row) for i, row in enumerate(TABLE)], "pos int, task string, metric string, kind string")
    told = metrics.join(F.broadcast(spec.select("task", "metric", "kind")), ["task", "metric"]).withColumn("shown", shown(F.col("value"), F.col("kind"), F.col("lo"), F.col("hi")))
    wide = told.groupBy("task", "metric").pivot("run", runs).agg(F.first("shown"))
    return spec.join(wide, ["task", "metric"], "left").select("pos", "task", "metric", *(F.coalesce(F.col(f"`{r}`"), F.lit("–")).alias(r) for r in runs))


def score_run(items: DataFrame, predictions: DataFrame, task: str, order: str, labels: list[str] | None = None, n_boot: int = 1000, bins: int = BINS) -> tuple[DataFrame, DataFrame]:
    """Scored rows of a run, and its metrics as (task, metric, value, lo, hi); intervals for the headline rates."""
    joined = with_predictions(items, predictions, order)
    if task == "classification":
        rows = score_classification(joined, labels or [])
        wide = rows.agg(*classification_rates()).join(macro_f1(rows)).join(calibration(rows, "confidence", "correct", bins))
        drawn = replicates(rows.select("id", "y_true", "pred", "correct"), "id", n_boot)
        intervals = {"accuracy": interval(drawn.groupBy("b").agg(rate(F.col("correct")).alias("v")), "v"), "macro_f1": interval(macro_f1(drawn, ["b"]), "macro_f1")}
    else:
        rows = score_qa(joined)
        wide = rows.agg(*qa_rates()).join(calibration(rows, bins=bins))
        flags = rows.select("id", "correct", "hallucinated", "fabricated", "gold_present")
        rates = {"presence_accuracy": rate(F.col("correct")), "hallucination_rate": rate(F.col("hallucinated")), "fabricated_rate": rate(F.col("fabricated"), ~F.col("gold_present"))}
        per = replicates(flags, "id", n_boot).groupBy("b").agg(*(c.alias(k) for k, c in rates.items()))
        intervals = {k: interval(per, k) for k in rates}
    wide = wide.select(*(F.col(c).cast("double").alias(c) for c in wide.columns))
    told = None
    for metric, ci in intervals.items():
        one = ci.select(F.lit(metric).alias("metric"), "lo", "hi")
        told = one if told is None else told.unionByName(one)
    long = wide.withColumn("task", F.lit(task)).unpivot("task", [c for c in wide.columns], "metric", "value")
    return rows, long.join(F.broadcast(told), "metric", "left").select("task", "metric", "value", "lo", "hi")
