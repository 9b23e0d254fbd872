"""Chat records: message lists, targets, few-shot splices, templates and token counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the prompts.
SYSTEM = (
    "You are a contract analysis assistant. You answer strictly from the contract text provided. If the text does not "
    "contain what is asked, say so. Never invent clauses or quote text that is not in the contract."
)
CLASSIFY = ("Classify the following contract clause into exactly one clause type.\n\nClause types:\n", '\n\nClause:\n"""\n', '\n"""\n\nAnswer with the clause type name only.')
ASK = (
    'Contract excerpt:\n"""\n', '\n"""\n\nQuestion: Does this excerpt contain a "', '" clause? If yes, quote the relevant text verbatim.\n',
    '\nRespond with JSON only: {"present": true|false, "evidence": ["<verbatim quote>", ...]}. Use an empty evidence list when the clause is not present.',
)
#: Tokens that a chat template adds to a record.
TEMPLATE_TOKENS = 32


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _messages(user: Column) -> Column:
    return F.array(message("system", F.lit(SYSTEM)), message("user", user))


def classification_messages(clause: Column, labels: Column) -> Column:
    listed = F.array_join(F.transform(labels, lambda x: F.concat(F.lit("- "), x)), "\n")
    return _messages(F.concat(F.lit(CLASSIFY[0]), listed, F.lit(CLASSIFY[1]), clause, F.lit(CLASSIFY[2])))


def qa_messages(excerpt: Column, category: Column, description: Column) -> Column:
    detail = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("Category definition: "), description, F.lit("\n"))).otherwise("")
    return _messages(F.concat(F.lit(ASK[0]), excerpt, F.lit(ASK[1]), category, F.lit(ASK[2]), detail, F.lit(ASK[3])))


def qa_target(present: Column, evidence: Column) -> Column:
    """JSON with ``present`` first; the evidence of absent clauses is emptied."""
    none = F.array().cast("array<string>")
    return F.to_json(F.struct(present.alias("present"), F.when(present, F.coalesce(evidence, none)).otherwise(none).alias("evidence")))


def attach(task: Column, classification: Column, qa: Column, label: Column, target: Column) -> tuple[Column, Column]:
    """The prompt and the completion of a record of either task."""
    is_label = task == "classification"
    return F.when(is_label, classification).otherwise(qa), F.array(message("assistant", F.when(is_label, label).otherwise(target)))


def with_demos(prompt: Column, demos: Column) -> Column:
    """Demonstrations right after the system message."""
    return F.concat(F.slice(prompt, 1, 1), demos, F.slice(prompt, F.lit(2), F.greatest(F.size(prompt) - 1, F.lit(0))))


def turns(user: Column, answer: Column) -> Column:
    return F.array(message("user", user), message("assistant", answer))


def chat_text(messages: Column) -> Column:
    """Messages as text: a marker line with the role before each, and the assistant's marker at the end."""
    body = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n")))
    return F.concat(F.array_join(body, ""), F.lit("<|assistant|>\n"))


def contents(prompt: Column, completion: Column) -> Column:
    """All contents of a record without separators, as its tokens are counted."""
    return F.array_join(F.transform(F.concat(prompt, completion), lambda m: m["content"]), "")


def count_tokens(prompt: Column, completion: Column, tokens: Column | None = None) -> Column:
    """Tokens of a record and its template; ``tokens`` counts other than by white space."""
    counted = tokens if tokens is not None else F.size(F.array_remove(F.split(contents(prompt, completion), r"\s+"), ""))
    return counted + TEMPLATE_TOKENS
