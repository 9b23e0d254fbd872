"""Seeded sampling, splits and ids. Draws are orders of md5(seed, key): uniform, repeatable, and the same in any engine."""

from __future__ import annotations

import hashlib
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import cut


def draw_key(seed: str, *keys: Column | str) -> Column:
    """The text that orders a draw."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("-", F.lit(seed), *(c.cast("string") for c in cols)))


def draw_number(seed: str, *keys: Column | str) -> Column:
    """A number from 0 to 2**32 - 1."""
    return F.conv(F.substring(draw_key(seed, *keys), 1, 8), 16, 10).cast("long")


def balanced_sample(df: DataFrame, key: str, item: str, n: int, seed: str) -> DataFrame:
    """``n`` rows, one of each key in turn until keys run out. No key can give more than ``n``, and each task hands on no
    more than that."""
    dealt = df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(draw_key(seed, item), item))).where(F.col("_r") <= n)
    return dealt.orderBy("_r", draw_key(seed, key), key).limit(n).drop("_r")


def ranked(df: DataFrame, group: list[str], key: Column, order: list[Column | str]) -> DataFrame:
    """``df`` with ``_rank`` (from 0) and ``_size``: the place of a row in its group by ``key``, a hexadecimal digest, then
    ``order``, and the rows of the group. A group is ranked in 4,096 parts by the first digits of the key, and the sizes of
    the parts before are added, so a group with a third of all rows is spread as well."""
    own = df.withColumn("_key", key).withColumn("_part", F.substring("_key", 1, 3))
    parts = own.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy(*group)
    earlier = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_part").alias("_p"), earlier.alias("_before"), F.sum("_n").over(of).alias("_size"))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy("_key", *order))
    met = own.withColumn("_inside", inside).join(parts, same)
    return met.withColumn("_rank", F.col("_before") + F.col("_inside") - 1).select(*df.columns, "_rank", "_size")


def first_k(df: DataFrame, keys: list[str], item: str, k: int, seed: str) -> DataFrame:
    """At most ``k`` rows of each group, drawn without replacement; ``rank`` tells the order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(draw_key(seed, item), item))).where(F.col("rank") <= k)


def require_k(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Raises where a group has under ``k`` rows."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return df.withColumn("_ok", F.when(n < k, F.raise_error(F.concat(F.lit("too few rows in "), F.concat_ws("/", *keys)))).otherwise(F.lit(1))).where("_ok = 1").drop("_ok")


def distinct_labels(df: DataFrame, label: str, item: str, k: int, seed: str) -> DataFrame:
    """The first row of each label in drawn order, and of those the first ``k``."""
    firsts = first_k(df, [label], item, 1, seed).drop("rank")
    return firsts.withColumn("pick", draw_key(seed, item)).orderBy("pick", item).limit(k).drop("pick")


def first_of_duplicates(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by ``order``; an aggregate, so tasks hand on one row a group."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in rest)), F.struct(*order)).alias("_first"))
    return first.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns))


def matched_negatives(positives: DataFrame, tiles: DataFrame, hard: DataFrame, held: DataFrame, seed: str, hard_ratio: float = 0.5) -> DataFrame:
    """For each positive (pos_id, contract_id, category) a tile without the category.

    ``tiles`` has all tiles (contract_id, tile), ``hard`` the free ones of contracts that hold the category elsewhere
    (contract_id, category, tile), ``held`` the categories of each contract (contract_id, category). A coin picks the kind,
    the other stands in if there is none. An easy negative takes one of the contracts without the category uniformly, then
    one of its tiles. Contracts are put in drawn order once; which of them the k-th without a category is follows from k and
    the gaps between its holders, so neither contracts and categories nor positives and candidates are written out in pairs.
    """
    numbered = hard.withColumn("k", F.row_number().over(Window.partitionBy("contract_id", "category").orderBy(draw_key(seed, "tile"), "tile")) - 1)
    n_hard = hard.groupBy("contract_id", "category").agg(F.count(F.lit(1)).alias("n_hard"))
    n_tiles = tiles.groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_tiles"))
    owners = cut(ranked(n_tiles.withColumn("_all", F.lit(1)), ["_all"], draw_key(seed, "contract_id"), ["contract_id"]).select("contract_id", "n_tiles", F.col("_rank").alias("at"), F.col("_size").alias("n")))
    # holders of a category in order of place: ``free`` contracts without it come before, equal for those side by side
    by_category = Window.partitionBy("category")
    places = held.join(owners, "contract_id").withColumn("free", F.col("at") - F.row_number().over(by_category.orderBy("at")) + 1)
    runs = places.groupBy("category", "free").agg(F.count(F.lit(1)).alias("own"), F.first("n").alias("n"))
    runs = runs.select("category", "n", "own", "free", F.lead("free").over(by_category.orderBy("free")).alias("upto"), F.sum("own").over(by_category.orderBy("free")).alias("skipped"))
    n_easy = runs.groupBy("category").agg((F.first("n") - F.sum("own")).alias("n_easy"))
    p = positives.join(n_hard, ["contract_id", "category"], "left").join(n_easy, "category", "left").na.fill(0, ["n_hard", "n_easy"])
    p = p.withColumn("wants_hard", draw_number(f"{seed}-coin", "pos_id") < F.lit(hard_ratio * 4294967296))
    kind = F.when((F.col("n_hard") > 0) & (F.col("wants_hard") | (F.col("n_easy") == 0)), "same_contract").when(F.col("n_easy") > 0, "other_contract")
    p = cut(p.withColumn("neg_type", kind).withColumn("draw", draw_number(seed, "pos_id")))  # it is named twice
    near = p.where("neg_type = 'same_contract'").withColumn("k", F.pmod("draw", F.greatest("n_hard", F.lit(1)))).join(numbered, ["contract_id", "category", "k"])
    near = near.select("pos_id", "category", "neg_type", F.col("contract_id").alias("neg_contract_id"), "tile")
    far = p.where("neg_type = 'other_contract'").withColumn("k", F.pmod("draw", F.greatest("n_easy", F.lit(1))))
    gaps = runs.select(F.col("category").alias("_c"), "free", "upto", "skipped")
    inside = (F.col("category") == F.col("_c")) & (F.col("free") <= F.col("k")) & (F.col("upto").isNull() | (F.col("k") < F.col("upto")))
    far = far.join(gaps, inside, "left").withColumn("at", F.col("k") + F.coalesce("skipped", F.lit(0)))
    far = far.join(owners.withColumnRenamed("contract_id", "neg_contract_id").drop("n"), "at").withColumn("t", F.pmod(draw_number(f"{seed}-tile", "pos_id"), "n_tiles"))
    some = tiles.withColumn("t", F.row_number().over(Window.partitionBy("contract_id").orderBy("tile")) - 1).withColumnRenamed("contract_id", "neg_contract_id")
    far = far.join(some, ["neg_contract_id", "t"])
    return near.unionByName(far.select("pos_id", "category", "neg_type", "neg_contract_id", "tile"))


class _Splitter:
    """Deals items into splits, one label after another, the one with the fewest items left first.

    Items and labels are numbers. What each split lacks is a table of labels by splits and a row of room by splits; labels
    wait in a heap with the number of items they had when they were put there, and one whose number has changed since is
    passed over, as it is in the heap again with the new one.
    """

    def __init__(self, labels_of: list[list[int]], n_labels: int, fractions: np.ndarray) -> None:
        self.labels_of = labels_of
        self.holders: list[list[int]] = [[] for _ in range(n_labels)]
        for item, own in enumerate(labels_of):
            for label in own:
                self.holders[label].append(item)
        self.left = np.array([len(h) for h in self.holders], np.int64)
        self.lacks = np.outer(self.left, fractions)
        self.room = fractions * len(labels_of)
        self.split = np.full(len(labels_of), -1, np.int64)

    def _deal(self, item: int, first: np.ndarray | None) -> None:
        wishes = (-self.room,) if first is None else (-self.room, -first)
        split = np.lexsort((np.arange(len(self.room)), *wishes))[0]
        self.split[item] = split
        self.room[split] -= 1
        own = self.labels_of[item]
        self.lacks[own, split] -= 1
        self.left[own] -= 1

    def run(self) -> np.ndarray:
        heap = [(n, label) for label, n in enumerate(self.left.tolist()) if n]
        heapq.heapify(heap)
        while heap:
            n, label = heapq.heappop(heap)
            if n != self.left[label]:
                continue
            waiting = [i for i in self.holders[label] if self.split[i] < 0]
            for item in waiting:
                self._deal(item, self.lacks[label])
            for other in {x for i in waiting for x in self.labels_of[i]}:
                if self.left[other]:
                    heapq.heappush(heap, (int(self.left[other]), other))
        for item in np.flatnonzero(self.split < 0).tolist():
            self._deal(item, None)
        return self.split


def stratified_split(labels: DataFrame, fractions: list[tuple[str, float]], seed: str) -> DataFrame:
    """item_id, split from (item_id, labels): the rarest label that has items left comes first; its items, in drawn order,
    go where the label lacks most, then where there is most room, then to the split named first. Items without a label come
    last. This is sequential by its rule, so ids and label sets, not texts, go through one task; ``split_by_rank`` is the
    form for corpora of any size."""
    names = [name for name, _ in fractions]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        drawn = pdf.assign(draw=[hashlib.md5(f"{seed}-{i}".encode()).hexdigest() for i in pdf["item_id"]]).sort_values(["draw", "item_id"])
        known = sorted({x for own in drawn["labels"] for x in own})
        number = {label: i for i, label in enumerate(known)}
        split = _Splitter([[number[x] for x in own] for own in drawn["labels"]], len(known), np.array([f for _, f in fractions], float)).run()
        return pd.DataFrame({"item_id": drawn["item_id"].to_numpy(), "split": [names[i] for i in split]})

    kind = dict(labels.dtypes)["item_id"]
    return labels.select("item_id", F.array_distinct("labels").alias("labels"), F.lit(1).alias("_all")).groupBy("_all").applyInPandas(run, f"item_id {kind}, split string")


def split_by_rank(df: DataFrame, item: str, stratum: str, fractions: list[tuple[str, float]], seed: str) -> DataFrame:
    """``df`` with ``split``: in each stratum the drawn rank decides by cumulative fractions. Strata are ranked in parts, so
    neither a large one nor a single task holds them up."""
    share = (F.col("_rank") + F.lit(0.5)) / F.col("_size")
    split, upto = None, 0.0
    for name, fraction in fractions[:-1]:
        upto += fraction
        split = F.when(share <= upto, name) if split is None else split.when(share <= upto, name)
    found = ranked(df, [stratum], draw_key(seed, item), [item])
    return found.withColumn("split", split.otherwise(fractions[-1][0]) if split is not None else F.lit(fractions[-1][0])).drop("_rank", "_size")


def with_ids(df: DataFrame, prefix: Column, group: list[str], key: Column, order: list[Column | str]) -> DataFrame:
    """``id``: prefix and a padded position in the group by ``key`` (a digest) and ``order``, taken before anything is
    dropped, so ids may have gaps."""
    return ranked(df, group, key, order).withColumn("id", F.concat(prefix, F.format_string("-%05d", "_rank"))).drop("_rank", "_size")
