"""Demonstrations for prompts: chosen from training records, cropped, and put before what is asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import crop_around
from . import prompts as P
from . import sampling as S

# How long a demonstration may be, in characters, and whether the clause is there in each of its turns.
CROP_CHARS = 1000
QUOTE_CHARS = 450
CLAUSE_CHARS = 400
PATTERN = (True, False, True)


def eligible(task: Column, present: Column, evidence: Column, clause: Column) -> Column:
    """Whether a record can be a demonstration: a present clause with one short quote, an absent one, a short clause."""
    quote = F.get(evidence, 0)
    qa = F.when(present, (F.size(evidence) == 1) & (F.length(quote) <= QUOTE_CHARS)).otherwise(present.isNotNull())
    return F.coalesce(F.when(task == "qa", qa).otherwise(F.length(clause) <= CLAUSE_CHARS), F.lit(False))


def qa_demos(records: DataFrame, seed: str = "0") -> DataFrame:
    """category, demos (messages), contracts: for each category as many turns as PATTERN has, drawn without replacement.

    A category whose records are too few is an error. ``records`` has id, contract_id, category, excerpt, present, evidence
    and description.
    """
    some = records.where(eligible(F.lit("qa"), F.col("present"), F.col("evidence"), F.lit(None).cast("string")))
    order = S.draw_key(seed, "category", "id")
    places = {side: [i for i, want in enumerate(PATTERN) if want == side] for side in (True, False)}
    drawn = S.first_k(some.withColumn("_draw", order), ["category", "present"], "_draw", max(map(len, places.values())), seed)
    at = F.when(F.col("present"), F.get(F.array(*map(F.lit, places[True])), F.col("rank") - 1)).otherwise(F.get(F.array(*map(F.lit, places[False])), F.col("rank") - 1))
    quote = F.when(F.col("present"), F.get("evidence", 0))
    asked = P.qa_messages(crop_around(F.col("excerpt"), quote, CROP_CHARS), F.col("category"), F.coalesce("description", F.lit("")))
    turns = P.turns(F.get(asked, 1)["content"], P.qa_target(F.col("present"), F.col("evidence")))
    rows = drawn.withColumn("at", at).where("at is not null").select("category", F.struct("at", turns.alias("turns"), "contract_id").alias("x"))
    sets = records.select("category").distinct().join(rows.groupBy("category").agg(F.array_sort(F.collect_list("x")).alias("x")), "category", "left")
    full = F.when(F.coalesce(F.size("x"), F.lit(0)) == len(PATTERN), F.col("x")).otherwise(F.raise_error(F.concat(F.lit("too few demonstrations of "), F.col("category"))).cast(dict(sets.dtypes)["x"]))
    sets = sets.withColumn("x", full)
    return sets.select("category", F.flatten(F.transform("x", lambda r: r["turns"])).alias("demos"), F.array_distinct(F.transform("x", lambda r: r["contract_id"])).alias("contracts"))


def classification_demos(records: DataFrame, labels: list[str], seed: str = "0") -> DataFrame:
    """demos, contracts in one row: clauses of as many different labels as PATTERN has. ``records`` has id, contract_id,
    clause and target_label."""
    short = records.where(F.length("clause") <= CLAUSE_CHARS)
    three = S.distinct_labels(short.select("id", "contract_id", "clause", "target_label"), "target_label", "id", len(PATTERN), f"{seed}-classification")
    asked = P.classification_messages(F.col("clause"), F.lit(labels))
    turns = P.turns(F.get(asked, 1)["content"], F.col("target_label"))
    rows = three.select(F.struct(S.draw_key(f"{seed}-classification", "id").alias("draw"), "id", turns.alias("turns"), "contract_id").alias("x"))
    return rows.agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.flatten(F.transform("x", lambda r: r["turns"])).alias("demos"), F.array_distinct(F.transform("x", lambda r: r["contract_id"])).alias("contracts"))


def with_demonstrations(items: DataFrame, qa: DataFrame, classification: DataFrame) -> DataFrame:
    """``items`` (task, category, prompt) with the demonstrations of their task and category in ``prompt``."""
    both = qa.select(F.lit("qa").alias("_t"), F.col("category").alias("_c"), "demos").unionByName(classification.select(F.lit("classification").alias("_t"), F.lit(None).cast("string").alias("_c"), "demos"))
    met = items.join(both, (F.col("task") == F.col("_t")) & F.when(F.col("task") == "qa", F.col("category")).eqNullSafe(F.col("_c")), "left")
    return met.withColumn("prompt", F.when(F.col("demos").isNull(), F.col("prompt")).otherwise(P.with_demos(F.col("prompt"), F.col("demos")))).select(*items.columns)


def demo_contracts(qa: DataFrame, classification: DataFrame) -> DataFrame:
    """contract_id of everything that a demonstration comes from."""
    return qa.select(F.explode("contracts").alias("contract_id")).union(classification.select(F.explode("contracts"))).distinct()
