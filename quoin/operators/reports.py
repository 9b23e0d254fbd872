"""What runs and builds report: audited intervals, differences, Markdown, statistics, checks of training examples."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import cut
from . import scoring as C


def audited_rates() -> dict[str, Column]:
    """The rates that an audit changes, over rows as ``scoring.audited`` gives them."""
    return {"hallucination_rate_audited": C.rate(F.col("hallucinated_audited")), "fabricated_rate_audited": C.rate(F.col("fabricated_audited"), ~F.col("gold_present"))}


def audited_intervals(rows: DataFrame, order: str = "id", n_boot: int = 1000, seed: str = "b") -> DataFrame:
    """metric, value, lo, hi of the audited rates."""
    # both are named for each rate: written, so that rows are scored and draws made once
    flags = cut(rows.select(order, "hallucinated_audited", "fabricated_audited", "gold_present"))
    per = cut(C.replicates(flags, order, n_boot, seed).groupBy("b").agg(*(c.alias(k) for k, c in audited_rates().items())))
    whole = flags.agg(*(c.alias(k) for k, c in audited_rates().items()))
    out = None
    for name in audited_rates():
        one = whole.select(F.lit(name).alias("metric"), F.col(name).alias("value")).crossJoin(C.interval(per, name))  # a row each
        out = one if out is None else out.unionByName(one)
    return out


def differences(metrics: DataFrame, base: str) -> DataFrame:
    """run, task, metric, difference to the run ``base`` and how it is shown: points of percents, else three decimals."""
    kinds = metrics.sparkSession.createDataFrame(C.TABLE, "task string, metric string, kind string")
    first = metrics.where(F.col("run") == base).select("task", "metric", F.col("value").alias("_base"))
    met = metrics.where(F.col("run") != base).join(first, ["task", "metric"]).join(F.broadcast(kinds), ["task", "metric"], "left")
    by = F.col("value") - F.col("_base")
    shown = F.when(F.col("kind") == "pct", F.format_string("%+.1f pts", 100 * by)).otherwise(F.format_string("%+.3f", by))
    return met.select("run", "task", "metric", by.alias("difference"), F.when(by.isNotNull(), shown).alias("shown"))


def markdown(table: DataFrame, runs: list[str], names: dict[str, str] | None = None, note: str = "") -> str:
    """The comparison (``scoring.comparison``, at most as many rows as its fixed table) as a Markdown table."""
    row = lambda cells: f"| {' | '.join(cells)} |"
    titled = lambda r: f"{r.task}: {r.metric.replace('_', ' ')}"
    head = [row(["Metric", *((names or {}).get(r, r) for r in runs)]), row(["---"] * (1 + len(runs)))]
    body = [row([titled(r), *(r[x] for x in runs)]) for r in table.orderBy("pos").collect()]
    return "\n".join([*head, *body, *(["", note] if note else [])])


def write_run(rows: dict[str, DataFrame], metrics: DataFrame, folder: str, run: str, meta: dict | None = None) -> DataFrame:
    """Writes a run's rows (all tasks, in the order given, as JSON lines) and its metrics with their intervals and ``meta``
    (a small JSON text); returns the rows."""
    both = None
    for i, (task, part) in enumerate(rows.items()):
        one = part.select(F.lit(i).alias("_task"), F.lit(task).alias("task"), *part.columns)
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    both.orderBy("_task", "id").drop("_task").write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{run}_rows")
    told: dict = {"meta": meta or {}}
    for r in metrics.collect():  # a row a metric
        told.setdefault(r.task, {})[r.metric] = r.value
        if r.lo is not None:
            told[r.task][f"{r.metric}_ci95"] = [r.lo, r.hi]
    metrics.sparkSession.createDataFrame([(json.dumps(told, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{run}.json")
    return both.drop("_task")


def build_stats(records: DataFrame) -> DataFrame:
    """A row a file (column ``file``): n, max_tokens, n_categories, and counts by task, presence and kind of negative."""
    count = lambda c: F.count(F.when(c, 1))
    qa = F.col("task") == "qa"
    return records.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), count(F.col("task") == "classification").alias("n_classification"), count(qa).alias("n_qa"), count(qa & F.col("present")).alias("n_present"), count(qa & ~F.col("present")).alias("n_absent"),
        count(F.col("neg_type") == "same_contract").alias("n_same_contract"), count(F.col("neg_type") == "other_contract").alias("n_other_contract"),
        F.coalesce(F.max("n_tokens"), F.lit(0)).cast("long").alias("max_tokens"), F.countDistinct(F.coalesce("category", "target_label")).alias("n_categories"),
    )


def check_examples(examples: DataFrame, limit: int, ignored: int = -100) -> DataFrame:
    """n, max_tokens, mean_tokens of training examples (id, ids, mask), in one row. An example that reaches ``limit``, and a
    mask that isn't ``ignored`` first and trained to the end, are errors."""
    first = F.array_position(F.transform("mask", lambda m: m != ignored), F.lit(True)).cast("int")
    tail = F.slice("mask", first, F.greatest(F.size("mask") - first + 1, F.lit(0)))
    laid = (F.size("mask") == F.size("ids")) & (first > 1) & ~F.exists(tail, lambda m: m == ignored)
    fail = lambda text: F.raise_error(F.concat(F.lit(text), F.col("id").cast("string"))).cast("int")
    n = F.when(F.size("ids") >= limit, fail("cut at the limit: ")).when(~F.coalesce(laid, F.lit(False)), fail("mask isn't prompt, then answer: ")).otherwise(F.size("ids"))
    return examples.select(n.alias("n")).agg(F.count(F.lit(1)).alias("n"), F.max("n").cast("long").alias("max_tokens"), F.avg("n").alias("mean_tokens"))


# Names on a model card by run, and the figures shown: name, task, metric, how.
CARD_RUNS = {"base": "base", "ft": "finetuned", "3shot": "base_3shot"}
CARD_FIGURES = [
    ("cls_acc", "classification", "accuracy", "ci"), ("cls_f1", "classification", "macro_f1", "num"), ("qa_acc", "qa", "presence_accuracy", "ci"), ("missed", "qa", "missed_rate", "pct"), ("ece", "qa", "ece", "num"),
    ("hall", "qa", "hallucination_rate", "ci"), ("hall_audit", "qa", "hallucination_rate_audited", "ci"), ("fab_audit", "qa", "fabricated_rate_audited", "pct"),
]


def card_values(metrics: dict[str, dict], history: list[dict], links: dict[str, str], n_trained: int, n_all: int) -> dict[str, str]:
    """The text of every name on a model card, from metrics of all runs (by run, task, metric, and ``_ci95``), the training
    log and links; a figure that is missing is an error, but for audited ones of runs without an audit of fabricated text."""

    def told(run: str, task: str, metric: str, how: str) -> str:
        value = metrics[run][task][metric]
        if how == "num":
            return f"{value:.3f}"
        ends = metrics[run][task].get(f"{metric}_ci95") if how == "ci" else None
        return f"{100 * value:.1f}%" + (f" [{100 * ends[0]:.1f}, {100 * ends[1]:.1f}]" if ends else "")

    out = dict(links)
    for short, run in CARD_RUNS.items():
        out |= {f"{name}_{short}": told(run, task, metric, how) for name, task, metric, how in CARD_FIGURES if not (name == "fab_audit" and short == "3shot")}
    losses = [h["loss"] for h in history if "loss" in h]
    (summary,) = [h for h in history if "train_runtime" in h]
    steps = summary.get("step") or max(h.get("step", 0) for h in history)
    return out | {
        "trainable_params": f"{n_trained / 1e6:.1f}M", "trainable_pct": f"{100 * n_trained / n_all:.2f}%", "steps": str(steps), "train_hours": f"{summary['train_runtime'] / 3600:.1f}",
        "train_loss_first": f"{losses[0]:.3f}", "train_loss_last": f"{losses[-1]:.3f}", "eval_losses": " → ".join(f"{h['eval_loss']:.3f}" for h in history if "eval_loss" in h),
    }
