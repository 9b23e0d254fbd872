"""Language-model scores from a hashed maximum-entropy model, beside a smoothed unigram base.

Model. All words of the ``TABLE`` are leaves of a tree of classes, and one more leaf holds the tokens outside it. The
tree is Huffman's, with ``WIDTH`` branches, so it deepens with the vocabulary. P(token | history) is a product over the
token's path: at each class a softmax over its branches. The features are the token before, the two before, and the one
that a skip leaves, hashed with the class into one table of weights, whose rows grow with the number of classes; biases
are logarithms of corpus counts. Tokens outside the table share their leaf by smoothed corpus count, so the
probabilities over all tokens sum to one.

Training. Every training text is used once: it belongs to one of ``ROUNDS`` rounds. In a round the tasks sum the
gradient (observed less expected feature counts) and the expected counts; blocks of the sums are added up in Spark, and
the driver, which holds only the table of weights, steps along the gradient scaled by the counts.

Counts cover all training tokens and stay distributed. The ``TABLE`` most frequent tokens are broadcast; documents list
their other tokens, which meet the counts in a join. Texts themselves are never shuffled.

Scale: a task sends at most the distinct words of its batches and, in a round, 8 MB of sums with a full table. A frequent token never reaches the join,
so its keys are even, but for tokens that occur in held-out texts alone; Spark splits such skew.

Edge cases: null is empty text, which is a single end token; with nothing to train on, all tokens are unknown. A null
doc_id counts as remainder 0, so it is held out. Rows that repeat an id are scored each.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remainder, small_batches

WIDTH = 32
TABLE = 1 << 17
HASHED = 1 << 13
ROUNDS = 3
RATE = 0.6
SMOOTH = 3.0
_BLOCK_ROWS = 128
_CHUNK = 1 << 16
_PART = 1 << 12
END = b""  # words are never empty


def tokens(column: pa.Array) -> pa.ListArray:
    """The tokens of each text, as Arrow splits at ASCII white space: a blank after the last word makes the end, and a text
    without words is the end alone."""
    text = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.string()), "")))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(text, ""), "", pc.binary_join_element_wise(text, " ", "")))


def _read(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), (remainder(doc_id, 10) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))


def token_counts(docs: DataFrame) -> DataFrame:
    """word, n over all training texts; the empty word is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = pc.value_counts(tokens(batch.column(0)).flatten())
            yield pa.RecordBatch.from_arrays([seen.field("values").cast(pa.binary()), seen.field("counts")], names=["word", "n"])

    own = _read(docs).where(~F.col("held_out")).select("text").mapInArrow(run, "word binary, n long")
    return own.groupBy("word").agg(F.sum("n").alias("n"))


def tree(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Huffman's tree of ``WIDTH`` branches over leaves of positive mass: for leaves and then classes, the class above (-1
    for none) and the branch there; and the number of classes."""
    m = len(mass)
    heap = [(x, i) for i, x in enumerate(mass.tolist()) if x > 0]
    heapq.heapify(heap)
    above, branch, n = {}, {}, 0
    size = (len(heap) - 2) % (WIDTH - 1) + 2
    while len(heap) > 1:
        parts = [heapq.heappop(heap) for _ in range(size)]
        for j, (_, i) in enumerate(reversed(parts)):
            above[i], branch[i] = m + n, j
        heapq.heappush(heap, (sum(x for x, _ in parts), m + n))
        n, size = n + 1, WIDTH
    get = lambda d, none, kind: np.array([d.get(i, none) for i in range(m + n)], kind)
    return get(above, -1, np.int64), get(branch, 0, np.int64), n


class Model:
    """Words, weights and the rest that scoring needs; made from a table of fixed size."""

    def __init__(self, words: list[bytes], counts: np.ndarray, n: int, v: int) -> None:
        """``words`` by falling count; ``n`` and ``v``: all training tokens, and distinct ones."""
        self.n, self.v = n, v
        self.words = pa.array(words, pa.binary())  # their ids are 2 and on; 0: another token, 1: before the text
        self.base = np.r_[0, 0, np.log10(counts + 0.1)]
        other = n - counts.sum() + 0.1 * (v - len(words) + 1)
        self.rest = math.log10(other)  # what smoothed counts of tokens outside the table sum to
        self.above, self.branch, classes = tree(np.r_[other, 0, counts])
        self.first = len(self.base)  # the number of the first class
        mass = np.r_[other, 0, counts, np.zeros(classes)]
        own = np.zeros((classes, WIDTH))
        for i in [*np.flatnonzero(self.above[: self.first] >= 0), *range(self.first, self.first + classes)]:  # a class comes after its parts
            if i >= self.first:
                mass[i] = own[i - self.first].sum()
            if self.above[i] >= 0:
                own[self.above[i] - self.first, self.branch[i]] = mass[i]
        self.shares = (own / own.sum(1, keepdims=True)).astype(np.float32)  # of a class's corpus count; exp of the biases
        self.rows = max(HASHED, 1 << (4 * classes).bit_length())
        self.factors = np.ones((self.rows, WIDTH), np.float32)  # exp of the weights

    def places(self, texts: pa.ListArray | list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all tokens, and where each text begins."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.list_(pa.binary()))
        found = pc.index_in(texts.flatten().cast(pa.binary()), value_set=self.words)
        sizes = pc.list_value_length(texts).to_numpy().astype(np.int64)
        return pc.fill_null(found, -2).to_numpy().astype(np.int64) + 2, np.cumsum(sizes) - sizes

    def steps(self, ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The steps up the tree, by parts of the tokens: which tokens; then of each step the token's place among them, rows
        of features (3 a step), the class and the branch that came."""
        one = np.r_[1, ids[:-1]]
        two = np.r_[1, 1, ids[:-2]][: len(ids)]
        one[starts] = 1
        two[starts] = 1
        two[starts[starts + 1 < len(ids)] + 1] = 1
        for i in range(0, len(ids), _CHUNK):
            part = slice(i, min(i + _CHUNK, len(ids)))
            at, own, found = np.arange(part.stop - i), ids[part], []
            while len(at):
                some = np.flatnonzero(self.above[own] >= 0)
                at, own = at[some], own[some]
                found.append((at, own))
                own = self.above[own]
            at, own = (np.concatenate(x) for x in zip(*found))
            classes = self.above[own] - self.first
            yield part, at, self._features(classes, one[part].astype(np.uint64)[at], two[part].astype(np.uint64)[at]), classes, self.branch[own]

    def _features(self, classes: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        numbers = np.arange(self.first, self.first + len(self.shares)).astype(np.uint64)
        out = np.empty((3, len(classes)), np.int64)
        for tag, history in ((1, (one,)), (2, (one, two)), (3, (two,))):
            begun = _mix(np.full(len(numbers), tag * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64), numbers)
            for i in range(0, len(classes), _PART):
                h = np.take(begun, classes[i : i + _PART])
                for x in history:
                    _mix(h, x[i : i + _PART])
                h *= np.uint64(0x9E3779B97F4A7C15)
                h >>= np.uint64(64 - self.rows.bit_length() + 1)
                out[tag - 1, i : i + _PART] = h
        return out

    def products(self, features: np.ndarray, classes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """By parts that stay in cache: which steps, for each branch its share times the factors of the features, and the
        sums over branches. Probabilities are their quotients. What is given is overwritten by the next part."""
        held = np.empty((2, _PART, WIDTH), np.float32)
        for i in range(0, len(classes), _PART):
            part = slice(i, min(i + _PART, len(classes)))
            x, y = held[:, : part.stop - i]
            np.take(self.shares, classes[part], axis=0, out=x, mode="clip")
            for f in features:
                np.take(self.factors, f[part], axis=0, out=y, mode="clip")
                x *= y  # no overflow: shares are at most 1, and a round moves a factor by at most exp(RATE)
            yield part, x, np.einsum("ij->i", x)  # a product with ones would start the threads of BLAS

    def gradient(self, texts: pa.ListArray | list[list[bytes]], out: np.ndarray) -> None:
        """Adds observed and expected counts of features to ``out`` (2, rows, WIDTH)."""
        seen, expected = out[0].reshape(-1), np.empty((self.rows, WIDTH), np.float32)
        for _, _, features, classes, label in self.steps(*self.places(texts)):
            p, one = np.empty((len(classes), WIDTH), np.float32), np.ones(len(classes))
            for part, x, total in self.products(features, classes):
                np.divide(x, total[:, None], out=p[part])
            expected[:] = 0
            for f in features:
                np.add.at(seen, f * WIDTH + label, one)
                _add_rows(expected, f, p)
            out[1] += expected

    def step(self, sums: np.ndarray) -> None:
        """One update: the gradient over the larger of observed and expected counts."""
        gradient, expected = sums[:, 0], sums[:, 1]
        self.factors *= np.exp(RATE * gradient / (np.maximum(expected, expected + gradient) + SMOOTH)).astype(np.float32)

    def score(self, texts: pa.ListArray | list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text, of tokens in the table: sum of log10(c + 0.1) for the base and for the model, and how many are
        known; then how many are outside the table; and the ids."""
        ids, starts = self.places(texts)
        logs = np.zeros(len(ids))
        for some, at, features, classes, label in self.steps(ids, starts):
            p = np.empty(len(at))
            for part, x, total in self.products(features, classes):
                np.divide(x[np.arange(len(x)), label[part]], total, out=p[part])
            logs[some] = np.bincount(at, weights=np.log10(np.maximum(p, 1e-30)), minlength=some.stop - some.start)
        add = lambda x: np.add.reduceat(x, starts)
        other = add((ids == 0).astype(np.int64))
        return add(np.take(self.base, ids)), add(logs), np.diff(np.r_[starts, len(ids)]) - other, other, ids


def _mix(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Takes ``x`` into the hashes ``h``, in place."""
    h ^= x
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _add_rows(out: np.ndarray, rows: np.ndarray, p: np.ndarray) -> None:
    """``out[rows] += p`` where rows repeat. What goes to one row is cut into pieces of 1, 2, 4 ... ``_PART``; pieces of one
    size are added up together, by halves, and no row is twice among them."""
    order = np.argsort(rows.astype(np.uint16) if len(out) <= 1 << 16 else rows, kind="stable")
    rows = rows[order]
    at = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    size, own = np.diff(np.r_[at, len(rows)]), rows[at]
    length = 1
    while length <= _PART:
        some = np.flatnonzero(size & length if length < _PART else size >= length)
        each = _PART // length
        for i in range(0, len(some), each):
            s = some[i : i + each]
            x = np.take(p, np.take(order, at[s] + np.arange(length)[:, None]), axis=0)
            half = length
            while half > 1:
                half //= 2
                x[:half] += x[half : 2 * half]
            out[own[s]] += x[0]
        at[some] += length
        size[some] -= length
        if length < _PART or not (size >= length).any():  # what is longer has several of the largest pieces
            length *= 2


def _rare(texts: pa.ListArray, ids: np.ndarray, sizes: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """For each text its tokens outside the table, and how often each is there."""
    at = np.flatnonzero(ids == 0)
    found = texts.flatten().take(pa.array(at)).cast(pa.binary()).dictionary_encode()
    n = max(1, len(found.dictionary))
    keys, times = np.unique(np.repeat(np.arange(len(texts)), sizes)[at] * n + found.indices.to_numpy(), return_counts=True)
    begin = pa.array(np.searchsorted(keys // n, np.arange(len(texts) + 1)), pa.int32())
    return pa.ListArray.from_arrays(begin, found.dictionary.take(pa.array(keys % n))), pa.ListArray.from_arrays(begin, pa.array(times, pa.int32()))


def _summed(rows: DataFrame, height: int) -> np.ndarray:
    """Adds up blocks of sums by their numbers; the result has the size of the table, ``height`` rows."""
    shape = (_BLOCK_ROWS, 2, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.setdefault(i, np.zeros(shape))
                total[i] += np.frombuffer(data.as_buffer(), np.float32).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in total.values()], pa.binary())], names=["block", "sums"])

    out = np.zeros((height, 2, WIDTH))
    for row in rows.repartition("block").mapInArrow(run, "block int, sums binary").toLocalIterator():
        out[row.block * _BLOCK_ROWS : (row.block + 1) * _BLOCK_ROWS] = np.frombuffer(row.sums, np.float32).reshape(shape)
    return out


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS, table: int = TABLE) -> Model:
    """A model from all training texts of ``docs``, whose token counts are ``counts``."""
    sc = docs.sparkSession.sparkContext
    bucket = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n")).collect()
    n, v = sum(r.n for r in sizes), sum(r.k for r in sizes)
    least, held = 1 << 30, 0
    for r in sorted(sizes, key=lambda r: -r.b):
        held += r.k
        if held > table:
            break
        least = r.b
    top = counts.where((bucket >= least) | (F.col("word") == F.lit(END))).toArrow()
    rows = sorted(zip(top["word"].to_pylist(), top["n"].to_pylist()), key=lambda x: (x[0] != END, -x[1], x[0]))
    model = Model([w for w, _ in rows], np.array([c for _, c in rows], np.int64), n, v)
    own = _read(docs).where(~F.col("held_out"))
    for i in range(rounds if n else 0):
        sent = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            out = np.zeros((2, sent.value.rows, WIDTH))
            for batch in batches:
                sent.value.gradient(tokens(batch.column(0)), out)
            out[0] -= out[1]
            blocks = np.ascontiguousarray(out.transpose(1, 0, 2), np.float32).reshape(-1, _BLOCK_ROWS * 2 * WIDTH)
            some = np.flatnonzero(blocks.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([blocks[b].tobytes() for b in some], pa.binary())], names=["block", "sums"])

        part = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == i).select("text")
        model.step(_summed(part.mapInArrow(run, "block int, sums binary"), model.rows))
        sent.unpersist()
    return model


def score(docs: DataFrame, rounds: int = ROUNDS, table: int = TABLE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    counts = cut(token_counts(docs), "token-counts")
    model = train(docs, counts, rounds, table)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = sent.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = tokens(batch.column(2))
            base, logs, known, other, ids = m.score(texts)
            sizes = pc.list_value_length(texts).to_numpy().astype(np.int64)
            words, times = _rare(texts, ids, sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(texts))), batch.column(0), batch.column(1), pa.array(sizes), pa.array(known), pa.array(other), pa.array(base), pa.array(logs), words, times,
                ],
                names=["row_id", "doc_id", "held_out", "n_tokens", "known", "other", "base", "logs", "words", "times"],
            )
            row += len(texts)

    schema = "row_id long, doc_id long, held_out boolean, n_tokens long, known long, other long, base double, logs double, words array<binary>, times array<int>"
    scored = cut(_read(docs).mapInArrow(run, schema), "scored")
    rare = scored.select("row_id", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row_id", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(counts, "word", "left").withColumn("c", F.coalesce("n", F.lit(0)))
    sums = met.groupBy("row_id").agg(F.sum(F.col("times") * F.log10(F.col("c") + F.lit(0.1))).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    whole = math.log10(model.n + 0.1 * (model.v + 1))
    return scored.drop("words", "times").join(sums, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("logs") + more - F.col("other") * F.lit(model.rest)).alias("score"),
    )
