"""Batch inference and the answer service as DataFrame functions: requests in, answers out, a pluggable scorer between."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import parse_label, parse_qa
from ..functions.text import confidence_bucket, fold, is_grounded, let, strip_ws
from . import prompts as P

MAX_CHARS = 12_000
MAX_EXCERPT_TOKENS = 1_300
MAX_CLAUSE_TOKENS = 500


def todo(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a prediction yet."""
    return items.join(done.select("id"), "id", "left_anti")


def evaluation_contracts(sets: list[DataFrame]) -> DataFrame:
    """contract_id of all evaluation sets, each once."""
    out = sets[0].select("contract_id")
    for more in sets[1:]:
        out = out.union(more.select("contract_id"))
    return out.distinct()


def leaks(demos: DataFrame, *sets: DataFrame) -> DataFrame:
    """Contracts that demonstrations share with any of the evaluation sets; must be empty."""
    return demos.select("contract_id").intersect(evaluation_contracts(list(sets)))


_OUTPUTS = (("output", pa.string()), ("n_new_tokens", pa.int64()), ("seq_logprob", pa.float64()), ("p_present", pa.float64()))


def predict(items: DataFrame, scorer: Callable[[list[str]], list[dict]], size: str = "n_tokens", partitions: int = 8, batch: int = 16) -> DataFrame:
    """id, output, n_new_tokens, seq_logprob, p_present for items (id, prompt_text, size), in batches of similar length.

    ``scorer`` gets the prompts of a batch and gives a dict for each; it is made once a worker if it caches itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            for at in range(0, data.num_rows, batch):
                part = data.slice(at, batch)
                out = scorer(part.column(1).to_pylist())
                cols = [pa.array([o.get(k) for o in out], t) for k, t in _OUTPUTS]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["id", *(k for k, _ in _OUTPUTS)])

    ordered = items.repartitionByRange(partitions, size).sortWithinPartitions(size).select("id", "prompt_text")
    return ordered.mapInArrow(run, f"id {dict(items.dtypes)['id']}, output string, n_new_tokens long, seq_logprob double, p_present double")


def _beside(rows: DataFrame, scorer: Callable[[list[str]], list[dict]], batch: int = 16) -> DataFrame:
    """``rows`` (prompt_text, n_tokens last) with the outputs of the scorer in place of these two; rows without a prompt have
    none. Batches are of similar length among the rows that lie together, so nothing moves."""
    keep = rows.columns[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            prompts, sizes = data.column(len(keep)), data.column(len(keep) + 1).to_pylist()
            order = sorted((i for i, n in enumerate(prompts.is_valid().to_pylist()) if n), key=lambda i: sizes[i])
            out: list[dict] = [{}] * data.num_rows
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                for i, o in zip(own, scorer([prompts[i].as_py() for i in own]), strict=True):
                    out[i] = o
            cols = [pa.array([o.get(k) for o in out], t) for k, t in _OUTPUTS]
            yield pa.RecordBatch.from_arrays([*data.columns[: len(keep)], *cols], names=[*keep, *(k for k, _ in _OUTPUTS)])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kinds}, output string, n_new_tokens long, seq_logprob double, p_present double")


def log_softmax_max(logits: Column) -> Column:
    """Log-probability of the most likely output of a step."""
    top = F.array_max(logits)
    return -F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - top).cast("double"))))


def sequence_logprob(steps: Column, end: Column) -> Column:
    """Sum of log-probabilities of steps up to and including the first ``end`` of them."""
    return F.aggregate(F.slice(steps, F.lit(1), end), F.lit(0.0), lambda a, x: a + x)


def trimmed(ids: Column, end_id: Column) -> Column:
    """Generated ids up to the first end token; all if there is none."""
    at = F.array_position(ids, end_id).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at - 1)).otherwise(ids)


def hit_limit(ids: Column, end_ids: list[int], most: int) -> Column:
    """Whether an output stopped for want of room: ``most`` ids were made and the last isn't an end token."""
    n = F.size(ids)
    first_end = F.size(F.filter(F.transform(ids, lambda x, i: F.when(x.isin(end_ids), i)), lambda i: i.isNotNull()))
    return (n >= most) & (first_end == 0)


def single_token(encode: Callable[[str], list[int]], text: str) -> int:
    """The one token of a text that a probability is read from; any other number of tokens is an error."""
    ids = encode(text)
    if len(ids) != 1:
        raise ValueError(f"{text!r} has {len(ids)} tokens and not one: {ids}")
    return ids[0]


def two_way_softmax(yes: Column, no: Column) -> Column:
    return 1 / (1 + F.exp(no - yes))


def request_error(text: Column, tokens: Column, most_tokens: int, known: Column | None = None) -> Column:
    """Why a request can't be answered, null if it can; text is never cut to fit."""
    out = F.when(text.isNull() | (F.length(text) < 1) | (F.length(text) > MAX_CHARS), "length").when(F.length(strip_ws(text)) == 0, "blank")
    if known is not None:
        out = out.when(~F.coalesce(known, F.lit(False)), "unknown_type")
    return out.when(tokens > most_tokens, "too_long")


def build_answer(excerpt: Column, output: Column, p_present: Column) -> Column:
    """struct<present, confidence, bucket, p_present, quotes, all_verified, valid>; the decision is the generated one, or
    else the probability's, and the bucket is chosen before rounding."""

    def answer(r: Column) -> Column:
        parsed, p = r["parsed"], r["p"]
        confidence = F.when(F.coalesce(parsed["present"], p > 0.5), p).otherwise(1 - p)
        quotes = F.transform(parsed["evidence"], lambda q: F.struct(q.alias("text"), is_grounded(q, r["haystack"]).alias("verified")))
        return F.struct(
            parsed["present"].alias("present"), F.round(confidence, 4).alias("confidence"), confidence_bucket(confidence).alias("bucket"), F.round(p, 4).alias("p_present"), quotes.alias("quotes"), parsed["valid"].alias("valid"),
        )

    def checked(a: Column) -> Column:
        return F.struct(*(a[c].alias(c) for c in ("present", "confidence", "bucket", "p_present", "quotes")), F.forall(a["quotes"], lambda q: q["verified"]).alias("all_verified"), a["valid"].alias("valid"))

    return let(let(F.struct(parse_qa(output).alias("parsed"), fold(excerpt).alias("haystack"), p_present.alias("p")), answer), checked)


def build_classification(output: Column, seq_logprob: Column, labels: list[str]) -> Column:
    """struct<label, confidence, bucket, valid>."""

    def answer(r: Column) -> Column:
        return F.struct(r["parsed"]["label"].alias("label"), F.round(r["p"], 4).alias("confidence"), confidence_bucket(r["p"]).alias("bucket"), r["parsed"]["valid"].alias("valid"))

    return let(F.struct(parse_label(output, labels).alias("parsed"), F.exp(seq_logprob).alias("p")), answer)


def respond(requests: DataFrame, task: str, scorer: Callable[[list[str]], list[dict]], labels: DataFrame, tokens: Column, model: str, disclaimer: str = "") -> DataFrame:
    """id, error, the fields of an answer, model, disclaimer for every request (id, text, and clause_type when asking).

    ``task`` is ``ask`` or ``classify``; ``labels`` has label and description, ``tokens`` counts a text's tokens. A request
    with an error isn't scored and has no answer; the raw output stays inside. One pass scores all good requests.
    """
    ask = task == "ask"
    known = labels.select("label", "description").collect()  # the fixed, short list of a service
    names = sorted(r.label for r in known)
    table = requests.sparkSession.createDataFrame(known, "_l string, description string")
    # texts stay where they are: the list comes to them, and outputs are put beside them
    met = requests.join(F.broadcast(table), F.col("clause_type") == F.col("_l"), "left") if ask else requests
    most = MAX_EXCERPT_TOKENS if ask else MAX_CLAUSE_TOKENS
    met = met.withColumn("error", request_error(F.col("text"), tokens, most, F.col("_l").isNotNull() if ask else None))
    prompt = P.qa_messages(F.col("text"), F.col("clause_type"), F.coalesce("description", F.lit(""))) if ask else P.classification_messages(F.col("text"), F.lit(names))
    good = F.col("error").isNull()
    out = _beside(met.select("id", "text", "error", F.when(good, P.chat_text(prompt)).alias("prompt_text"), F.when(good, tokens).alias("n_tokens")), scorer)
    answer = build_answer(F.col("text"), F.col("output"), F.col("p_present")) if ask else build_classification(F.col("output"), F.col("seq_logprob"), names)
    fields = ("present", "confidence", "bucket", "p_present", "quotes", "all_verified", "valid") if ask else ("label", "confidence", "bucket", "valid")
    out = out.withColumn("a", F.when(F.col("error").isNull(), answer))
    return out.select("id", "error", *(F.col(f"a.{f}").alias(f) for f in fields), F.lit(model).alias("model"), F.lit(disclaimer).alias("disclaimer"))
