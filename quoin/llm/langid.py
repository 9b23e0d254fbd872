"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts of order 0 to 3 with counts from a bounded sample of its texts. A byte seen
in the longest known context is coded there; otherwise an escape is coded and the next shorter context tried, with the
bytes already ruled out excluded. The statistics are frozen before scoring, so the code length of a byte hangs on the
three bytes before it alone. Every context of the sample is kept: hashed tables hold, by order, the code lengths of the
bytes seen after a context, and the cost of the escape from it with what exclusion gives back. A text's exact code length
is a sum of such entries. The language with the shortest code wins.

Scale: scoring is one pass without shuffle. Counts come before ranks in sampling, so what is ranked is some more than the
sample, however large the corpus. The sample is ``sample_rows`` texts of each language, and there are at most
``max_languages`` labels: with more, learning stops with an error, since labels of such a number aren't languages and
tables would grow with them. Languages are learned and scored ``_TOGETHER`` at a time; what is broadcast has, for each
of these blocks, a row of that many numbers for each distinct run of four bytes in its sample.

Edge cases: null text or text without a letter is ``und`` with score 0, and so is everything when nothing can be
learned. Equal code lengths go to the language first in order of name. A null doc_id counts as remainder 0. Rows that
repeat an id are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, remainder, small_batches

UNKNOWN = "und"
ORDER = 3
SAMPLE_ROWS = 1_000
MAX_LANGUAGES = 128
_TOGETHER = 8
_BROADCAST_IDS = 200_000
_PIECE = 1 << 18
_PAD = b" " * ORDER


class Places:
    """Numbers (32 bits) and their places in a sorted list, by a hash table with open addresses."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys.astype(np.uint32)
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._hash(self.keys)
        while len(left):
            free = np.flatnonzero(self.slots[at] < 0)
            _, first = np.unique(at[free], return_index=True)
            taken = free[first]
            self.slots[at[taken]] = left[taken]
            stay = np.ones(len(left), bool)
            stay[taken] = False
            left, at = left[stay], (at[stay] + 1) & (len(self.slots) - 1)

    def _hash(self, x: np.ndarray) -> np.ndarray:
        return ((x * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int32)

    def find(self, x: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that aren't there."""
        if not len(self.keys):
            return np.full(len(x), -1, np.int32)
        at = self._hash(x)
        out = self.slots[at]
        off = np.flatnonzero((out >= 0) & (self.keys[out] != x))
        while len(off):
            at_off = (at[off] + 1) & (len(self.slots) - 1)
            at[off] = at_off
            out[off] = found = self.slots[at_off]
            off = off[(found >= 0) & (self.keys[found] != x[off])]
        return out


class Trees:
    """Code lengths in bits of some languages: ``cost[k]`` has a row for each context of order k with a byte seen after it,
    ``escape[k]`` one for each context of order k, each with a column for each language."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> None:
        """From counts ``n`` of four bytes ``gram`` in the language number ``lang``."""
        self.langs, size = langs, len(langs)
        self.grams: dict[int, Places] = {}
        self.contexts: dict[int, Places] = {}
        self.cost: dict[int, np.ndarray] = {}
        self.escape: dict[int, np.ndarray] = {}
        counts = np.zeros((256, size))
        np.add.at(counts, (gram & 255, lang), n)
        total, kinds = counts.sum(0), (counts > 0).sum(0)
        rest = np.maximum(256 - kinds, 1) / 256
        known = np.where(kinds < 256, counts / np.maximum(total + kinds, 1), counts / np.maximum(total, 1))
        p = np.where(counts > 0, known, kinds / np.maximum(total + kinds, 1) / rest / 256)
        p = np.where(total > 0, p, 1 / 256)
        self.cost[0] = -np.log2(p).astype(np.float32)
        below, below_keys = p, np.arange(256)
        for k in range(1, ORDER + 1):
            keys, at = np.unique(gram & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            counts = np.zeros((len(keys), size))
            np.add.at(counts, (at, lang), n)
            shorter = below[np.searchsorted(below_keys, keys & ((1 << 8 * k) - 1))]
            starts = np.flatnonzero(np.r_[True, (keys[1:] >> 8) != (keys[:-1] >> 8)]) if len(keys) else np.zeros(0, np.int64)
            add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros((0, size))  # noqa: E731, B023
            total, kinds = add(counts), add((counts > 0).astype(float))
            # what the shorter context leaves for bytes that weren't seen here; never 0 in UTF-8, where no byte is 0xFF
            rest = np.where(kinds < 256, np.maximum(1 - add(np.where(counts > 0, shorter, 0)), 1e-12), 1)
            weight = np.where(total > 0, kinds / np.maximum(total + kinds, 1) / rest, 1)
            of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(keys)]))
            p = np.where(counts > 0, counts / np.maximum(total + np.where(kinds < 256, kinds, 0), 1)[of], weight[of] * shorter)
            self.grams[k], self.cost[k] = Places(keys), -np.log2(p).astype(np.float32)
            self.contexts[k], self.escape[k] = Places(keys[starts] >> 8), -np.log2(weight).astype(np.float32)
            below, below_keys = p, keys

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The cost of the last byte of each four bytes, by language."""
        found = self.grams[ORDER].find(grams)
        out = self.cost[ORDER].take(found, axis=0, mode="clip") if len(self.cost[ORDER]) else np.zeros((len(grams), len(self.langs)), np.float32)
        left = np.flatnonzero(found < 0)
        out[left] = 0
        x = grams[left]
        for k in range(ORDER, 0, -1):  # escape from the context of order k, then look in the next shorter one
            if not len(left):
                break
            context = self.contexts[k].find(x >> np.uint32(8))
            known = context >= 0
            out[left[known]] += self.escape[k][context[known]]
            x = x & np.uint32((1 << 8 * k) - 1)
            found = self.grams[k - 1].find(x) if k > 1 else x.astype(np.int32)
            hit = found >= 0
            out[left[hit]] += self.cost[k - 1][found[hit]]
            left, x = left[~hit], x[~hit]
        return out


def code_lengths(trees: list[Trees], texts: list[bytes]) -> np.ndarray:
    """A row for each text, a column for each language of all ``trees``."""
    out = np.zeros((len(texts), sum(len(t.langs) for t in trees)))
    group: list[tuple[int, bytes]] = []
    held = 0
    for i, text in enumerate(texts):
        for at in range(0, len(text), _PIECE):
            piece = (text[at - ORDER : at] if at else _PAD) + text[at : at + _PIECE]
            group.append((i, piece))
            held += len(piece)
            if held >= _PIECE:
                _add(trees, group, out)
                group, held = [], 0
    if group:
        _add(trees, group, out)
    return out


def _add(trees: list[Trees], group: list[tuple[int, bytes]], out: np.ndarray) -> None:
    x = np.frombuffer(b"".join(p for _, p in group), np.uint8).astype(np.uint32)
    grams = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    starts = np.cumsum([0, *(len(p) for _, p in group[:-1])])
    texts = np.array([i for i, _ in group])
    first = 0
    for t in trees:
        bits = t.bits(grams)
        for s in starts[1:]:  # the context of a piece isn't coded
            bits[s - ORDER : s] = 0
        sums = np.add.reduceat(bits, starts, axis=0, dtype=np.float64)
        np.add.at(out[:, first : first + len(t.langs)], texts, sums)
        first += len(t.langs)


def _grams(docs: DataFrame) -> DataFrame:
    """lang, gram (four bytes as a number), n: how often each occurs in the texts of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(_PAD + text.encode())
            for lang, parts in texts.items():
                x = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
                coded = np.ones(len(x) - ORDER, bool)
                for end in np.cumsum([len(p) for p in parts[:-1]]):  # texts lie side by side: what comes before one isn't coded
                    coded[end - ORDER : end] = False
                grams, n = np.unique(((x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:])[coded], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def sample(docs: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` labelled training rows of each language, the same ones each time."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = own.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0) & (remainder(F.col("doc_id"), 5) != 0))
    # Rows with small hashes come first. Counts by size of hash tell how small: few more than ``rows`` are then ranked.
    size = F.floor(F.log2(F.col("h") + F.lit(1)) * 4)
    ranked = known.select("doc_id", "lang", F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h")).withColumn("b", size)
    smaller = F.sum("n").over(Window.partitionBy("lang").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranked.groupBy("lang", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("smaller", F.coalesce(smaller, F.lit(0)))
    most = cut(sizes.where(F.col("smaller") < rows).groupBy("lang").agg(F.max("b").alias("most")), "sizes")
    ranked = ranked.join(most, "lang").where(F.col("b") <= F.col("most"))
    first = ranked.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= rows)
    first = cut(first.select("doc_id", "lang").distinct(), "sampled")
    if first.count() <= _BROADCAST_IDS:  # else a corpus of very many languages, and texts are shuffled to meet the ids
        first = F.broadcast(first)
    return known.join(first, ["doc_id", "lang"], "left_semi")


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> list[Trees]:
    """Trees from the labelled rows of ``docs`` whose crc32(doc_id) mod 5 isn't 0, for some languages each."""
    grams = cut(_grams(sample(docs, sample_rows)), "grams")
    langs = [r.lang for r in grams.select("lang").distinct().orderBy("lang").limit(max_languages + 1).collect()]
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages in lang: map labels that are no languages to null, or raise max_languages")
    out = []
    for at in range(0, len(langs), _TOGETHER):
        own = sorted(langs)[at : at + _TOGETHER]
        found = grams.where(F.col("lang").isin(own)).select((F.array_position(F.lit(own), F.col("lang")) - 1).cast("int").alias("lang"), "gram", "n").toArrow()
        out.append(Trees(own, *(found[c].to_numpy() for c in ("lang", "gram", "n"))))
    return out


def predictor(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES):
    """A function of a text column: struct<lang_pred string, score double>, learned from ``docs``."""
    small_batches(docs.sparkSession)
    trees = learn(docs, sample_rows, max_languages)
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    names = np.array([*(x for t in trees for x in t.langs), UNKNOWN], object)
    letter = regex.compile(r"\p{L}").search

    def judge(column: pa.Array) -> pa.Array:
        texts = [t.encode() if t is not None and letter(t) else b"" for t in column.to_pylist()]
        pick, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        some = np.array([bool(t) for t in texts], bool)
        if len(names) > 1 and some.any():
            bits = code_lengths(sent.value, [t for t in texts if t])
            best = bits.argmin(1)
            pick[some] = best
            score[some] = 1 / np.exp2(np.maximum(bits[np.arange(len(bits)), best][:, None] - bits, -1000)).sum(1)
        return pa.StructArray.from_arrays([pa.array(names[pick], pa.string()), pa.array(score)], names=["lang_pred", "score"])

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            parts = [judge(column.slice(at, 1024)) for at in range(0, len(column), 1024)]
            yield pa.concat_arrays(parts) if parts else judge(column)

    return lambda text: predict(text.cast("string"))


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``."""
    predict = predictor(docs, sample_rows, max_languages)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), predict(F.col("text")).alias("v"))
    return read.select("doc_id", "held_out", "v.lang_pred", "v.score")
