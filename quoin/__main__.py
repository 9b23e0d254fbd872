"""Commands: ``python -m quoin download|build|score|report|card|check``, each with ``--help``. Paths are Spark's where rows
are read or written, and local where the name says so."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import build as B
from .operators import reports as R
from .operators import scoring as C
from .operators import spans as N
from .sources import io

ITEMS = {
    "classification": "id string, labels array<string>, target_label string, contract_id string",
    "qa": "id string, category string, neg_type string, excerpt string, present boolean, evidence array<string>, contract_id string",
}
OUTPUTS = {"classification": "id string, at long, output string, seq_logprob double", "qa": "id string, at long, output string, p_present double"}


def _build(spark: SparkSession, args: argparse.Namespace) -> None:
    contracts, spans, about = N.parse_corpus(io.read_corpus(spark, args.corpus))
    known = io.load_config(args.settings, "data") if args.settings else {}
    cfg = B.Config(excluded=tuple(known.get("excluded", ())), seed=str(known.get("seed", "42")))
    labels = sorted(r.category for r in about.select("category").collect())  # the short list of clause types
    records = B.build(contracts, spans, about, labels, cfg).persist()
    for split in cfg.sizes:
        print(split, io.write_jsonl(records.where(records.split == split), f"{args.out}/{split}"))
    R.build_stats(records.withColumnRenamed("split", "file")).coalesce(1).write.mode("overwrite").json(f"{args.out}/stats")
    records.unpersist()


def _score(spark: SparkSession, args: argparse.Namespace) -> None:
    from pyspark.sql import functions as F

    labels = [r.label for r in io.categories(spark, args.categories).orderBy("pos").collect()]
    rows, metrics = {}, None
    for task, schema in ITEMS.items():
        items = io.read_jsonl(spark, f"{args.items}/{task}", schema)
        said = io.read_jsonl(spark, f"{args.predictions}/{task}", OUTPUTS[task])
        if task == "classification":
            said = said.withColumn("confidence", F.exp("seq_logprob"))
        rows[task], one = C.score_run(items, said, task, "at", labels, args.n_boot)
        if task == "qa" and args.audit:
            verdicts = io.audit_table(spark, args.audit).where(F.col("run") == args.run)
            if not verdicts.isEmpty():
                rows[task] = C.audited(rows[task], verdicts)
                one = one.unionByName(R.audited_intervals(rows[task], n_boot=args.n_boot).withColumn("task", F.lit(task)))
        metrics = one if metrics is None else metrics.unionByName(one)
    R.write_run(rows, metrics, args.out, args.run, io.read_meta(spark, f"{args.predictions}/meta.json"))


def _report(spark: SparkSession, args: argparse.Namespace) -> None:
    found = io.read_metrics(spark, args.metrics, args.runs)
    if found is None:
        raise SystemExit(f"no metrics of {', '.join(args.runs)} in {args.metrics}")
    rows = [(run, task, k, float(v), *(told.get(f"{k}_ci95") or (None, None))) for run, by in found.items() for task, told in by.items() if task != "meta" for k, v in told.items() if isinstance(v, (int, float))]
    metrics = spark.createDataFrame(rows, "run string, task string, metric string, value double, lo double, hi double")
    text = R.markdown(C.comparison(metrics, args.runs), args.runs)
    Path(args.local_out).write_text(text + "\n", encoding="utf-8")
    print(text)


def _card(spark: SparkSession, args: argparse.Namespace) -> None:
    found = io.read_metrics(spark, args.metrics, list(R.CARD_RUNS.values()))
    if found is None:
        raise SystemExit("metrics of all runs are needed for a card")
    told = json.loads(Path(args.local_training).read_text(encoding="utf-8"))
    values = R.card_values(found, told["history"], told["links"], told["n_trained"], told["n_all"])
    Path(args.local_out).write_text(io.render(Path(args.local_template).read_text(encoding="utf-8"), values), encoding="utf-8")


def _download(spark: SparkSession | None, args: argparse.Namespace) -> None:
    print(io.fetch_member(args.url, args.local_archive, args.member, args.local_target, args.sha256, args.force))


def _check(spark: SparkSession, args: argparse.Namespace) -> None:
    examples = io.read_jsonl(spark, args.examples, "id string, ids array<int>, mask array<int>")
    print(R.check_examples(examples, args.limit).first().asDict())


COMMANDS = {
    "download": (_download, {"url": {}, "local_archive": {}, "member": {}, "local_target": {}, "--sha256": {}, "--force": {"action": "store_true"}}),
    "build": (_build, {"corpus": {}, "out": {}, "--settings": {"help": "local folder of settings"}}),
    "score": (_score, {"items": {}, "predictions": {}, "out": {}, "run": {}, "--categories": {"help": "local JSON file"}, "--audit": {}, "--n-boot": {"type": int, "default": 1000}}),
    "report": (_report, {"metrics": {}, "local_out": {}, "runs": {"nargs": "+"}}),
    "card": (_card, {"metrics": {}, "local_template": {}, "local_training": {}, "local_out": {}}),
    "check": (_check, {"examples": {}, "--limit": {"type": int, "default": 2048}}),
}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m quoin")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        one = commands.add_parser(name)
        for option, how in options.items():
            one.add_argument(option, **how)
    args = parser.parse_args(argv)
    if spark is None and args.command != "download":
        spark = SparkSession.builder.appName(f"quoin-{args.command}").getOrCreate()
    COMMANDS[args.command][0](spark, args)


if __name__ == "__main__":
    main()
