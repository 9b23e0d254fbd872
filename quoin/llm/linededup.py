"""Lines that many documents share: drop them everywhere but in the largest document that holds them.

Lines are exploded as 128-bit hashes of their normalised form, distinct documents are counted for each hash, lines
over the threshold go, and each document is put together again by position.

Rows are first written in place (``common.placed``), and the lines of a file are numbered through. What the threshold
dooms is then a set of line numbers, which goes back to its file as a bitmap, and each text is put together from the lines
that aren't marked there.

Scale: texts are written once and never shuffled; hashes of lines and bitmaps are. Partial sums come first, so a line in a
third of all documents costs one row a task. The shared lines are written before hash rows meet them: Spark then knows
their size, broadcasts them if they are few, and else can split a skewed key, which it can't while one side comes straight
from an aggregate.

Edge cases: null or empty text is one empty line; rows that share a doc_id are one document; a null doc_id counts as
one document that is smaller than any other.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, id_and_text, marked, placed, scratch, with_marks, written_marks

MIN_CHARS = 20
MIN_DOCS = 3
NO_ID = -(1 << 63)
_TWO = struct.Struct("<qq")


def line_key(line: bytes) -> bytes:
    """A line without ASCII white space at its ends, A-Z lower-cased (UTF-8)."""
    return line.strip(BLANKS).lower()


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> tuple[int, int] | None:
    """128 bits of hash of a line's key as two numbers, or None if the key is short."""
    key = line_key(line)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return _TWO.unpack_from(hashlib.sha256(key).digest())


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written in place, with ``__line``: how many lines the rows before it in its file have."""

    @F.arrow_udf("long")
    def before(sizes: Iterator[pa.Array]) -> Iterator[pa.Array]:
        total = 0  # a task's rows come in order, in one iterator
        for batch in sizes:
            n = batch.to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.array(total + np.cumsum(n) - n)
            total += int(n.sum())

    return placed(docs.withColumn("__line", before(F.size(_lines(F.col("text"))).cast("long"))), "lines")


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def shared_lines(rows: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """__file, __mark: numbers, in their files, of the lines that go from ``rows`` (as ``numbered`` gives them)."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "doc_id", "__file", "__mark"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for i, text, file, line in zip(*(c.to_pylist() for c in part.columns)):
                    own = NO_ID if i is None else i
                    rows += [(*h, own, file, n) for n, x in enumerate((text or "").encode().split(b"\n"), line) if (h := line_hash(x, min_chars)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=names)

    lines = cut(id_and_text(rows, keep=("__file", "__line")).mapInArrow(keys, "k1 long, k2 long, doc_id long, __file int, __mark long"), "line-hashes")
    counts = lines.groupBy("k1", "k2").agg(F.countDistinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
    common = cut(counts.where(F.col("n") >= min_docs).select("k1", "k2", "keeper"), "common-lines")
    return lines.join(common, ["k1", "k2"]).where("doc_id < keeper").select("__file", "__mark")


def without_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Every row of ``docs`` as it is, with __text (the text of the lines that stay), __n_lines (before), __n_dropped."""
    rows = numbered(docs)
    with scratch():
        marks = written_marks(shared_lines(rows, min_chars, min_docs))
    found = with_marks(rows, marks)
    lines = _lines(F.col("text"))
    stay = F.filter(lines, lambda _, i: ~marked(F.col("__marks"), F.col("__line") + i))
    found = found.withColumn("__n_lines", F.size(lines).cast("long")).withColumn("__kept", F.when(F.col("__marks").isNotNull(), stay))
    found = found.withColumn("__text", F.coalesce(F.array_join("__kept", "\n"), F.col("text").cast("string"), F.lit("")))
    found = found.withColumn("__n_dropped", F.col("__n_lines") - F.coalesce(F.size("__kept"), F.col("__n_lines")))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns), "__text", "__n_lines", "__n_dropped")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, kept_text, n_lines (before), n_dropped for every row of ``docs``."""
    found = without_shared_lines(id_and_text(docs), min_chars, min_docs)
    return found.select("doc_id", F.col("__text").alias("kept_text"), F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"))
