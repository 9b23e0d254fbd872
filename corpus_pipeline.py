"""A corpus pipeline of the training-data operators: each stage is written as Parquet and read again by the next.

Every stage decides by row: ids may be null or repeat, rows may be equal, tables empty, texts null, empty or very long, and
other columns have any names but ``__file``, ``__at`` and the like. No stage shuffles texts: language ID, decontamination
and encoding go over them once, line dedup and near-dedup write them in place and bring marks to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm import bpe, decontam, langid, linededup, simhash
from quoin.llm.common import delete, fresh_path, placed, scratch, table, without
from quoin.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can't be told (null or empty text, no letter) go, and no others."""
    return docs.where(langid.predictor(docs)(F.col("text"))["lang_pred"] != langid.UNKNOWN)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, but for the largest id; ``n_chars`` follows the text. All rows stay. Rows that
    share an id are one document, and a null id is one that is smaller than any other."""
    found = linededup.without_shared_lines(docs)
    changed = {"text": F.when(F.col("__n_dropped") > 0, F.col("__text")).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        n = F.length("__text").cast(dict(docs.dtypes)["n_chars"])
        changed["n_chars"] = F.when(F.col("__n_dropped") > 0, n).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*(changed.get(c, F.col(f"`{c}`")) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that with the smallest id (null ids last; of rows that repeat the id
    the first). Rows without words are a group of their own."""
    rows = placed(docs)
    return without(rows, lambda: simhash.copies(rows)).select(*(f"`{c}`" for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go, and no others; null and empty texts hold none."""
    find = decontam.hits(table(spark, sf_dir, "benchmark"), spark)
    return docs.where(F.size(find(F.col("text"))["hit"]) == 0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encode_digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", encoding),
]

#: SQL can express neither the language models nor the merges of the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage leaves behind is deleted when its successor is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        path = fresh_path(spark, f"stage{i}")
        with scratch():
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
