"""Annotated corpora: nested JSON to tables, tokens, windows, and how spans lie in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_ws, remap, shrink

WINDOW_TOKENS = 1200


def parse_corpus(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """contracts, spans and descriptions from rows that hold a nested question-answering corpus (column ``data``).

    Only the first paragraph of a title counts. A title that repeats is taken the last time it appears. Spans are mapped
    to normalised text, those left empty go, and equal ones are kept once.
    """
    titles = raw.select(F.posexplode("data").alias("pos", "d")).select("pos", F.col("d.title").alias("contract_id"), F.get("d.paragraphs", F.lit(0)).alias("p"))
    base = titles.select("pos", "contract_id", F.col("p.context").alias("raw"), "p.qas").withColumn("text", normalize_ws(F.col("raw")))
    last = base.withColumn("_n", F.row_number().over(Window.partitionBy("contract_id").orderBy(F.desc("pos")))).where("_n = 1").drop("_n")
    contracts = last.select("contract_id", "text")
    asked = base.select("pos", "contract_id", F.posexplode("qas").alias("q_pos", "qa")).withColumn("category", F.regexp_extract("qa.question", '"([^"]+)"', 1))
    first = F.min_by(F.element_at(F.split("qa.question", "Details:", 2), 2), F.struct("pos", "q_pos"))
    descriptions = asked.groupBy("category").agg(F.btrim(first).alias("description"))
    answers = last.select("contract_id", "raw", "text", F.explode("qas").alias("qa")).select("contract_id", "raw", "text", F.regexp_extract("qa.question", '"([^"]+)"', 1).alias("category"), F.explode("qa.answers").alias("a"))
    start = remap(F.col("raw"), F.col("a.answer_start"))
    end = remap(F.col("raw"), F.col("a.answer_start") + F.length("a.text"))
    placed = answers.withColumn("_s", start).withColumn("_e", end)
    s, e = shrink(F.col("text"), F.col("_s"), F.col("_e"))
    spans = placed.select("contract_id", s.alias("start"), e.alias("end"), "category").where(F.col("end") > F.col("start")).distinct()
    return contracts, spans, descriptions


def quote(text: Column, start: Column, end: Column) -> Column:
    """The characters of a half-open range."""
    return F.substring(text, start + 1, end - start)


def token_arrays(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ts, te: the character offsets of a text's white-space tokens, half open, as two arrays a row. Linear in the
    text; null text has no tokens."""
    import re

    find = re.compile(r"[^\s]+").finditer
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                edges = [[m.span() for m in find(t or "")] for t in part.column(1).to_pylist()]
                cols = [pa.array([[e[i] for e in own] for own in edges], pa.list_(pa.int32())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[key, "ts", "te"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, ts array<int>, te array<int>")


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, idx, ts, te of every white-space token of a text, a row each."""
    rows = token_arrays(docs, key, text).select(key, F.posexplode(F.arrays_zip("ts", "te")).alias("idx", "x"))
    return rows.select(key, "idx", "x.ts", "x.te")


def tiles(arrays: DataFrame, width: int = WINDOW_TOKENS, key: str = "doc_id") -> DataFrame:
    """key, tile, ws, we from ``token_arrays``: windows of ``width`` tokens side by side, the last one shorter; none for
    texts without tokens."""
    n = F.size("ts")
    of = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda t: F.struct(t.alias("tile"), F.get("ts", t * width).alias("ws"), F.get("te", F.least((t + 1) * width, n) - 1).alias("we")))
    return arrays.where(n > 0).select(key, F.explode(of).alias("x")).select(key, "x.tile", "x.ws", "x.we")


def span_tokens(spans: DataFrame, arrays: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans with the first token that ends after their start, the last that starts before their end, the number of tokens,
    and the token arrays ``ts`` and ``te`` of their text; a row a span."""
    met = spans.join(arrays, key).where(F.size("ts") > 0)
    first = F.size(F.filter("te", lambda e: e <= F.col("start")))
    last = F.size(F.filter("ts", lambda s: s < F.col("end"))) - 1
    n = F.size("ts")
    out = met.select(*spans.columns, F.when(first < n, first).alias("first"), F.when(last >= 0, last).alias("last"), n.alias("n_tokens"), "ts", "te")
    return out.withColumn("last", F.greatest("first", "last"))


def window_edges(first_token: Column, width: int) -> tuple[Column, Column]:
    """Start and end of a window of ``width`` tokens from ``first_token``, by the arrays ``ts`` and ``te`` of the row; null for
    null."""
    last = F.when(first_token.isNotNull(), F.least(first_token + width, F.size("te")) - 1)
    return F.get("ts", first_token), F.get("te", last)


def positive_start(first: Column, last: Column, n: Column, width: int, draw: Column) -> Column:
    """The first token of a window of ``width`` tokens around a span; null if the span is longer. ``draw`` picks it."""
    lo = F.greatest(F.lit(0), last + 1 - width)
    hi = F.greatest(lo, F.least(first, F.greatest(F.lit(0), n - width)))
    return F.when(last - first + 1 <= width, lo + F.pmod(draw, hi - lo + 1)).cast("int")


def relation(start: Column, end: Column, ws: Column, we: Column) -> Column:
    """How a span lies in a window: null if apart (touching counts as apart), ``full`` or ``partial``."""
    return F.when((end <= ws) | (start >= we), None).when((start >= ws) & (end <= we), "full").otherwise("partial")


def _touching(on: list[str]) -> Column:
    """Window w and span s agree in the columns ``on`` and overlap."""
    out = (F.col("s.start") < F.col("w.we")) & (F.col("s.end") > F.col("w.ws"))
    for c in on:
        out = out & (F.col(f"w.{c}") == F.col(f"s.{c}"))
    return out


def evidence_in_windows(windows: DataFrame, spans: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns of windows with n_full, cut (whether an edge cuts a span) and first_full; an interval join."""
    met = windows.alias("w").join(spans.alias("s"), _touching(on), "left")
    rel = relation(F.col("s.start"), F.col("s.end"), F.col("w.ws"), F.col("w.we"))
    met = met.select(*(F.col(f"w.{c}") for c in keep), rel.alias("rel"), F.col("s.start").alias("_s"))
    full = F.col("rel") == "full"
    return met.groupBy(*keep).agg(F.count(F.when(full, 1)).alias("n_full"), F.coalesce(F.bool_or(F.col("rel") == "partial"), F.lit(False)).alias("cut"), F.min(F.when(full, F.col("_s"))).alias("first_full"))


def free_windows(windows: DataFrame, spans: DataFrame, on: list[str]) -> DataFrame:
    """Windows that no span touches: an anti join on a range."""
    return windows.alias("w").join(spans.alias("s"), _touching(on), "left_anti")


def multi_label(spans: DataFrame, rarity: DataFrame, key: str = "doc_id", label: str = "category") -> DataFrame:
    """One row for each range: its labels from the rarest on (ties by name), the first of them as the target."""
    ranked = spans.join(rarity, label).groupBy(key, "start", "end").agg(F.array_sort(F.collect_set(F.struct("n", label))).alias("_l"))
    labels = F.transform("_l", lambda x: x[label])
    return ranked.select(key, "start", "end", labels.alias("labels"), F.get(labels, 0).alias("target"))


def skip_reason(too_long: Column, cut: Column, evidence_chars: Column, duplicate: Column, most: int = 1500) -> Column:
    """Why a positive isn't used; the first reason counts, null if none does."""
    return F.when(too_long, "span_too_long").when(cut, "cut_by_window_edge").when(evidence_chars > most, "evidence_too_long").when(duplicate, "duplicate")
