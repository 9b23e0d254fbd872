"""Benchmark decontamination by winnowing.

Every text is a sequence of words; hashes of ``K`` consecutive words are taken at each place, and of every ``WINDOW - K
+ 1`` neighbouring hashes the smallest is kept. Two texts that share ``WINDOW`` words therefore keep a common hash
inside the shared span, whatever surrounds it. The kept hashes of documents meet those of the benchmark, and each
meeting is extended: the benchmark windows that contain it are compared word by word, and the words of those that
really occur are hit. An item of fewer than ``WINDOW`` words is a single window of its own length, found by its hash.

Scale: the benchmark is read in blocks of at most ``block_words`` words, which bounds what a worker holds. There is one
pass over the documents, without any shuffle; each batch of documents meets one block after the other.

Edge cases: null or empty text has no words; an item without words matches nothing; items that repeat an id count once.
An item with a null id hits words like any other, but has no id to be listed among the items found. No benchmark at all
hits nothing. Rows that repeat an id are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 10
K = 5
BLOCK_WORDS = 1_000_000
#: Texts are hashed together up to about this many bytes.
_CHUNK = 1 << 20
#: ASCII other than letters and digits separates words; A-Z become a-z; bytes of other characters stay.
_TABLE = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def _gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words at each place of ``hashes`` where they fit."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
        out ^= out >> np.uint64(29)
    return out


def winnow(grams: np.ndarray, w: int) -> np.ndarray:
    """Places whose hash is the least of some ``w`` neighbours (all of fewer); ties are all kept."""
    n = len(grams)
    if n <= w:
        return np.flatnonzero(grams == grams.min()) if n else np.zeros(0, np.int64)
    least = grams[: n - w + 1].copy()
    for i in range(1, w):
        np.minimum(least, grams[i : n - w + 1 + i], out=least)
    keep = np.zeros(n, bool)
    for i in range(w):
        keep[i : n - w + 1 + i] |= grams[i : n - w + 1 + i] == least
    return np.flatnonzero(keep)


class Benchmark:
    """One block of the benchmark, ready to be looked up: winnowed hashes and the windows that contain them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int, k: int) -> None:
        self.window, self.k = window, k
        self.windows: dict[bytes, set[str]] = {}
        kept: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ws = words(text)
            if not ws:
                continue
            size = min(window, len(ws))
            for i in range(len(ws) - size + 1):
                names = self.windows.setdefault(b" ".join(ws[i : i + size]), set())
                if item is not None:
                    names.add(item)
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
            grams = _gram_hashes(hashes, k if size == window else size)
            places = winnow(grams, window - k + 1) if size == window else np.array([0])
            kept.setdefault(size, []).append(grams[places])
        #: By length of window: the hashes to meet.
        self.kept = {size: np.unique(np.concatenate(x)) for size, x in kept.items()}

    def hits(self, texts: list[str | None]) -> list[tuple[int, np.ndarray, set[str]]]:
        """For each text: number of words, places of words hit, items found."""
        out: list[tuple[int, np.ndarray, set[str]]] = []
        group: list[list[bytes]] = []
        held = 0
        for text in texts:
            group.append(words(text))
            held += len(text or "")
            if held >= _CHUNK:
                out += self._hits(group)
                group, held = [], 0
        return out + self._hits(group)

    def _hits(self, group: list[list[bytes]]) -> list[tuple[int, np.ndarray, set[str]]]:
        sizes = np.array([len(x) for x in group], np.int64)
        ends = np.cumsum(sizes)
        hashes = np.fromiter((h for x in group for h in map(xxhash.xxh3_64_intdigest, x)), np.uint64, int(sizes.sum()))
        found: dict[int, tuple[list[int], set[str]]] = {}
        for size, kept in self.kept.items():
            k = self.k if size == self.window else size
            grams = _gram_hashes(hashes, k)
            places = winnow(grams, size - k + 1)
            at = np.searchsorted(kept, grams[places])
            places = places[kept[np.minimum(at, len(kept) - 1)] == grams[places]]
            # texts lie side by side here; a hash across two of them only starts a comparison that fails
            seen: set[tuple[int, int]] = set()
            for d, p in zip(np.searchsorted(ends, places, side="right").tolist(), places.tolist()):
                ws = group[d]
                p -= int(ends[d] - sizes[d])
                for i in range(max(0, p - size + k), min(p, len(ws) - size) + 1):
                    if (d, i) in seen:
                        continue
                    seen.add((d, i))
                    if (items := self.windows.get(b" ".join(ws[i : i + size]))) is not None:
                        spans, names = found.setdefault(d, ([], set()))
                        spans.extend(range(i, i + size))
                        names |= items
        none = np.zeros(0, np.int64)
        return [(int(n), np.unique(np.array(found[d][0], np.int64)), found[d][1]) if d in found else (int(n), none, set()) for d, n in enumerate(sizes)]


@lru_cache(maxsize=2)
def _prepared(block: tuple[tuple[str | None, str], ...], window: int, k: int) -> Benchmark:
    return Benchmark(list(block), window, k)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[tuple[tuple[str | None, str], ...]]:
    """The benchmark's items, streamed to the driver a partition at a time, in blocks of bounded size."""
    items, held = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).where("t is not null")
    for row in rows.toLocalIterator():
        size = len(words(row.t))
        if items and held + size > block_words:
            yield tuple(items)
            items, held = [], 0
        items.append((row.i, row.t))
        held += size
    yield tuple(items)


def hits(benchmark: DataFrame | None, spark: SparkSession, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS):
    """A function of a text column: struct<n_words long, hit array<int>, items array<string>>."""
    small_batches(spark)
    blocks = [spark.sparkContext.broadcast(b) for b in _blocks(benchmark, block_words)] if benchmark is not None else []

    def judge(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        rows = [(len(words(t)), np.zeros(0, np.int64), set()) for t in texts] if not blocks else []
        for sent in blocks:
            more = _prepared(sent.value, window, k).hits(texts)
            rows = [(n, np.union1d(a, b) if len(b) else a, x | y) for (n, a, x), (_, b, y) in zip(rows, more)] if rows else more
        cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]
        return pa.StructArray.from_arrays(cols, names=["n_words", "hit", "items"])

    @F.arrow_udf("struct<n_words: bigint, hit: array<int>, items: array<string>>")
    def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            size = 1024 if len(blocks) < 2 else max(1, len(column))  # with several blocks, each is prepared once a batch
            parts = [judge(column.slice(at, size)) for at in range(0, len(column), size)]
            yield pa.concat_arrays(parts) if parts else judge(column)

    return lambda text: find(text.cast("string"))


def contamination(docs: DataFrame, benchmark: DataFrame | None, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, hit (places of words inside benchmark windows, ascending), items (sorted ids) for every row."""
    find = hits(benchmark, docs.sparkSession, window, k, block_words)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), find(F.col("text")).alias("v")).select("doc_id", "v.n_words", "v.hit", "v.items")
