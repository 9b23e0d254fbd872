"""Near-duplicate documents: 64-bit SimHash, linked through pivot distance tables.

A fingerprint f is described by its Hamming distances to fixed reference fingerprints (pivots). By the triangle
inequality two fingerprints that differ in at most ``RADIUS`` bits differ by at most ``RADIUS`` in every coordinate,
so a pair with a larger coordinate difference is discarded without being compared.

To find the pairs without trying all of them, the 64 bits are cut into ``BLOCKS`` blocks and the pivots are read block
by block as well. Three differing bits touch at most three of five blocks, so at least two blocks agree entirely and
there every coordinate difference is zero: an equi-join on the coordinates of each pair of blocks meets every link.
Within such a bucket the distances to the whole pivots discard, and exact distances verify what survives. Only a
spanning forest of each bucket's links is returned, so a dense group gives as many rows as it has members, not pairs.

Scale: exact copies collapse to one fingerprint before anything is joined; the joined rows are 10 per distinct
fingerprint, some 25 bytes each. A bucket of more than ``cell`` fingerprints is dealt out in a grid of cells, which
keeps every pair and bounds what a task holds. Components come from alternating large and small stars in Spark.

Edge cases: null and blank texts have fingerprint zero and are linked like others; a null doc_id takes part, and its
component is the smallest id reachable (null if there is none); rows that repeat a doc_id stay separate rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, id_and_text

RADIUS = 3
SHINGLE = 3
BLOCKS = 5
PIVOTS = 24
BLOCK_PIVOTS = 12
CELL = 20_000
_MASK64 = (1 << 64) - 1


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the XXH64 of their numbers, so about 32 bits lie between any two."""
    return [xxhash.xxh64_intdigest(b"pivot %d" % i, 0) for i in range(n)]


def block_masks(n: int = BLOCKS) -> list[int]:
    """Cuts 64 bits into ``n`` runs whose lengths differ by one at most."""
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < k:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(k))))
    n = max(1, len(words) - k + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns ``keep`` for every row of ``docs``; no shuffle."""
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, k) for t in _texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", *keep])

    return id_and_text(docs, keep=keep).mapInArrow(run, ", ".join(["doc_id long", "fp long", *(f"{c} {kinds[c]}" for c in keep)]))


def _texts(column: pa.Array) -> Iterator[str | None]:
    """One text at a time, so that a batch isn't held twice."""
    for at in range(0, len(column), 64):
        yield from column.slice(at, 64).to_pylist()


def _keyed(fps: DataFrame, blocks: int) -> DataFrame:
    """t, k1, k2, fp: for each choice of blocks that may agree, the pivot coordinates over them."""
    agree = blocks - RADIUS
    if not 1 <= agree <= 2:
        raise ValueError("blocks must be RADIUS + 1 or RADIUS + 2")
    fp, refs = F.col("fp"), pivots(BLOCK_PIVOTS)

    def coordinates(mask: int):
        packed = F.lit(0).cast("long")
        for i, p in enumerate(refs):  # at most 16 bits in a block, so five bits hold a distance
            d = F.bit_count(fp.bitwiseXOR(F.lit(_signed(p))).bitwiseAND(F.lit(_signed(mask)))).cast("long")
            packed = packed.bitwiseOR(F.shiftleft(d, 5 * i))
        return packed

    cols = [coordinates(m) for m in block_masks(blocks)]
    named = fps.select("fp", *[c.alias(f"c{i}") for i, c in enumerate(cols)])
    picks = [
        F.struct(F.lit(t).alias("t"), F.col(f"c{ids[0]}").alias("k1"), F.col(f"c{ids[-1]}").alias("k2"))
        for t, ids in enumerate(combinations(range(blocks), agree))
    ]
    return named.select("fp", F.explode(F.array(*picks)).alias("x")).select("x.t", "x.k1", "x.k2", "fp")


def _close(a: np.ndarray, b: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Which places of ``a`` and ``b`` hold linked fingerprints: pivots discard, exact distances verify."""
    left = np.arange(len(a))
    for p in refs:
        x = np.bitwise_count(a[left] ^ p).astype(np.int8) - np.bitwise_count(b[left] ^ p).astype(np.int8)
        left = left[np.abs(x) <= RADIUS]
        if not len(left):
            return left
    return left[np.bitwise_count(a[left] ^ b[left]) <= RADIUS]


def forest(fps: np.ndarray, refs: np.ndarray) -> list[tuple[int, int]]:
    """Links that join everything joined by links of at most RADIUS bits among ``fps``: one fewer than members."""
    n = len(fps)
    order = np.argsort(np.bitwise_count(fps ^ refs[0]), kind="stable")
    fps = fps[order]
    table = np.stack([np.bitwise_count(fps ^ p).astype(np.int8) for p in refs[: min(len(refs), 8)]])
    ends = np.searchsorted(table[0], table[0] + RADIUS, side="right")
    label, links = np.arange(n), []
    for i in range(n - 1):
        j = np.arange(i + 1, ends[i])
        j = j[label[j] != label[i]]  # already joined: nothing to learn
        for row in table[1:]:
            if not len(j):
                break
            j = j[np.abs(row[j] - row[i]) <= RADIUS]
        j = j[np.bitwise_count(fps[j] ^ fps[i]) <= RADIUS]
        for x in j:
            if label[x] != label[i]:
                links.append((int(fps[i]), int(fps[x])))
                label[label == label[x]] = label[i]
    return links


def _link_groups(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Links within runs of equal keys, as rows of two fingerprints."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    out = []
    small = (sizes > 1) & (sizes <= 16)
    if small.any():
        first, second = [], []
        for size in np.unique(sizes[small]):
            s = starts[small & (sizes == size)]
            for i, j in combinations(range(size), 2):
                first.append(s + i)
                second.append(s + j)
        first, second = np.concatenate(first), np.concatenate(second)
        hit = _close(fps[first], fps[second], refs)
        out.append(np.stack([fps[first[hit]], fps[second[hit]]], 1))
    for s, size in zip(starts[sizes > 16], sizes[sizes > 16]):
        if found := forest(fps[s : s + size], refs):
            out.append(np.array(found, np.uint64))
    return np.concatenate(out) if out else np.zeros((0, 2), np.uint64)


def links(distinct: DataFrame, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """u, v: for distinct fingerprints ``fp``, links whose connected components are those of all links."""
    keyed = _keyed(distinct, blocks)
    keys = ["t", "k1", "k2"]
    hot = cut(keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell), "hot-buckets")
    parts = F.coalesce(F.ceil(F.col("n") / cell), F.lit(1)).cast("int")
    dealt = (
        keyed.join(hot, keys, "left")
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp"
        )  # cells that meet by a clash of hashes only compare more pairs
    )
    refs = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pv = np.array(refs, np.uint64)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def found(last: bool) -> pa.RecordBatch:
            keys, fps = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            end = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
            pairs = _link_groups(keys[:end], fps[:end], pv) if end else np.zeros((0, 2), np.uint64)
            held[:] = [(keys[end:], fps[end:])]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i]).view(np.int64)) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)))
                if sum(len(h[0]) for h in held) >= 1 << 17:
                    yield found(False)
        if held and sum(len(h[0]) for h in held):
            yield found(True)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """u, v: each node of ``edges`` that isn't its component's smallest, with that smallest node."""
    e = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state, before = None, None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e
        state = now
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.*").where("u <> v").distinct(), "edges")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(docs: DataFrame, k: int = SHINGLE, blocks: int = BLOCKS, cell: int = CELL, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component), component_id and the columns ``keep`` for every row."""
    fps = cut(fingerprints(docs, k, keep), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    stars = components(links(nodes.select("fp"), blocks, cell))
    rooted = nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = cut(rooted.join(names, "root").select("fp", "root", "component_id"), "classes")
    return fps.join(classes, "fp").select("doc_id", "fp", "root", "component_id", *keep)


def near_duplicates(docs: DataFrame, k: int = SHINGLE, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) for every row of ``docs``."""
    return grouped(docs, k, blocks, cell).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def copies(rows: DataFrame, **options) -> DataFrame:
    """__file, __at of the rows of a ``placed`` table that go: of each group of near duplicates one row stays, that with the
    smallest doc_id (null ids last), and of rows that repeat this id the first in place."""
    own = cut(grouped(rows, keep=("__file", "__at"), **options), "groups")
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__file", "__at")).alias("x"))
    return own.select("__file", "__at").join(first.select("x.__file", "x.__at"), ["__file", "__at"], "left_anti")
