"""Registration of queries, and the pieces of SQL that several oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def draw(text: str) -> str:
    """SQL of a number drawn from a text expression."""
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


def folded(text: str) -> str:
    return f"trim(regexp_replace(replace(lower({text}), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))"


def found(fragment: str, haystack: str) -> str:
    """SQL of whether folded text holds a folded fragment, numbers at its edges whole."""
    return f"(contains({haystack}, {fragment}) AND regexp_matches({haystack}, CASE WHEN regexp_matches({fragment}, '^[0-9]') THEN '(^|[^0-9])' ELSE '' END || {fragment} || CASE WHEN regexp_matches({fragment}, '[0-9]$') THEN '($|[^0-9])' ELSE '' END))"


def normalized(text: str) -> str:
    no_newline = WS.replace(r"\t-\r", r"\t\x0b-\r")
    return f"regexp_replace(regexp_replace({text}, '[{WS}]*\\n[{WS}]*', chr(10), 'g'), '[{no_newline}]+', ' ', 'g')"


def _mapped(p: str) -> str:
    ws = f"regexp_matches(substr(raw, {p}::INT, 1), '^[{WS}]$') AND regexp_matches(substr(raw, {p}::INT + 1, 1), '^[{WS}]$')"
    return f"(length(regexp_replace(substr(raw, 1, {p}::INT), '[{WS}]+', ' ', 'g')) - CASE WHEN {p} > 0 AND {ws} THEN 1 ELSE 0 END)"


def remapped_sql(messy: str, columns: str, select: str) -> str:
    """SQL over ``f``: benchmark passages in documents made messy (``messy`` of a text), with the ends s and e2 of where they
    lie in the normalised text ``norm``; ``columns`` of documents come along."""
    names = "".join(f"{c.split(' AS ')[-1].strip()}, " for c in columns.split(",") if c.strip())
    return f"""WITH r AS (SELECT d.doc_id, b.item_id, {columns}{messy.format('d.text')} AS raw, {messy.format('b.text')} AS q FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
h AS (SELECT *, strpos(raw, q) - 1 AS s FROM r WHERE contains(raw, q)),
m AS (SELECT doc_id, item_id, {names}{normalized('raw')} AS norm, {_mapped('s')} AS s, {_mapped('(s + length(q))')} AS e FROM h),
c AS (SELECT doc_id, item_id, {names}norm, s + CASE WHEN s < e AND regexp_matches(substr(norm, s + 1, 1), '^[{WS}]$') THEN 1 ELSE 0 END AS s, e FROM m),
f AS (SELECT *, e - CASE WHEN s < e AND regexp_matches(substr(norm, e, 1), '^[{WS}]$') THEN 1 ELSE 0 END AS e2 FROM c) {select}"""


#: Passages of the benchmark where they stand in documents: spans with the source as category.
SPANS_SQL = """hits AS (SELECT d.doc_id, b.item_id, d.source AS category, (strpos(d.text, b.text) - 1)::INT AS s, length(b.text) AS n, d.text FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
spans AS (SELECT doc_id, item_id, category, s AS "start", (s + n)::INT AS "end", text FROM hits)"""
#: White-space tokens of the documents that have spans.
TOKENS_SQL = """pieces AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS w, generate_subscripts(string_split_regex(text, '[ \\n]'), 1) AS i FROM documents),
placed AS (SELECT doc_id, i, w, (sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(w) - 1)::INT AS ts FROM pieces),
tokens AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS idx, ts, (ts + length(w))::INT AS te FROM placed WHERE length(w) > 0)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, category, start, end of benchmark passages that stand in documents word for word. Kept on disk, as
    queries name it several times and finding it takes a pass over all texts."""
    from pyspark import StorageLevel

    from ..operators.grounding import passages

    docs = read(spark, sf_dir, "documents").withColumnRenamed("source", "category")
    return passages(docs, read(spark, sf_dir, "benchmark"), ["doc_id", "category"]).select("doc_id", "item_id", "category", "start", "end").persist(StorageLevel.DISK_ONLY)
