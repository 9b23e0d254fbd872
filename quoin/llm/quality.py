"""Quality rules: repetition inside a document from its suffix array, beside simple counts.

The words of many documents lie side by side in one array, numbered apart by document so that nothing matches across
them. Prefix doubling sorts the suffixes, two rankings at a time. Longest common prefixes of neighbours come from the text
order: a suffix whose neighbour continues the neighbour of the suffix before it has one word less in common, so only the
others are compared word by word, and these comparisons sum up to n log n. A run of neighbours with at least ``n`` words in
common is an interval: one substring of ``n`` words with all its places. The longest common prefix of a suffix with a
neighbour is a maximal repeated substring from there.

The verdict, beside the base rules: the spans of repeats of at least n words, united, cover at most ``COVERED[n]`` percent
of the words; a single substring of n words makes up at most ``MOST[n]`` percent, all its places together; and no repeat is
longer than ``max_longest`` words. A document under ``VERDICT_WORDS`` words is judged by the base rules only, as two places
of one phrase are a large part of it.

Scale: one pass, no shuffle. Arrays hold about ``CHUNK_WORDS`` words, or one document if it is longer (some 100 bytes a
word). Edge cases: null or blank text has no words and fails for having under ``MIN_WORDS``; rows that repeat an id are
judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANKS, id_and_text

MIN_WORDS = 10
MIN_REPEAT = 5
#: Largest share of words in repeats of MIN_REPEAT words and more, in percent, by contract.
MAX_COVERED = 20
#: Longest repeat in words.
MAX_LONGEST = 100
#: Largest shares in percent, by words of the repeat: all repeats united, and the places of a single one.
COVERED = {6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
MOST = {2: 20, 3: 18, 4: 16}
VERDICT_WORDS = 50
CHUNK_WORDS = 1 << 18
SYMBOLS = b"#*$%&|<>"


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order. ``words`` are numbers."""
    n = len(words)
    _, rank, size = np.unique(words, return_inverse=True, return_counts=True)
    rank = (np.cumsum(size) - size)[rank]  # a group's rank is the place of its first member in sorted order
    k = 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(active):
        after = active + k
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        order = np.lexsort((second, rank[active]))
        a, r, s = active[order], rank[active][order], second[order]
        new_group = np.r_[True, r[1:] != r[:-1]]
        new_part = new_group | np.r_[True, s[1:] != s[:-1]]
        at = np.arange(len(a))
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        part_start = np.maximum.accumulate(np.where(new_part, at, 0))
        rank = rank.copy()
        rank[a] = r + part_start - group_start
        k *= 2
        sizes = np.bincount(np.cumsum(new_part) - 1)
        active = a[(sizes > 1)[np.cumsum(new_part) - 1]]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


def common_prefixes(words: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For each suffix in order the words that it shares with the one before it (0 for the first)."""
    n = len(words)
    before = np.full(n, -1, np.int64)  # by place: the suffix before this one in order
    before[suffixes[1:]] = suffixes[:-1]
    place = np.arange(n)
    some = before >= 0
    # where the words in front agree too, the suffix in front has one word more in common: nothing to compare
    follows = np.zeros(n, bool)
    inner = np.flatnonzero(some & (place > 0) & (before > 0))
    follows[inner] = words[inner - 1] == words[before[inner] - 1]
    length = np.zeros(n, np.int64)
    x = np.flatnonzero(some & ~follows)
    y, step = before[x], 0
    while len(x) and step < 64:
        fits = np.maximum(x, y) + step < n
        x, y = x[fits], y[fits]
        same = words[x + step] == words[y + step]
        x, y = x[same], y[same]
        length[x] += 1
        step += 1
    for a, b in zip(x.tolist(), y.tolist()):  # few are this long: stretches of growing size
        m, size = step, 256
        while True:
            p, q = words[a + m : a + m + size], words[b + m : b + m + size]
            p, q = p[: len(q)], q[: len(p)]
            off = np.flatnonzero(p != q)
            m += int(off[0]) if len(off) else len(p)
            if len(off) or len(p) < size:
                break
            size = min(4 * size, 1 << 20)
        length[a] = m
    start = np.maximum.accumulate(np.where(~follows, place, 0))
    return np.maximum(length[start] - (place - start), 0)[suffixes]


def repeats(ids: np.ndarray, docs: np.ndarray, sizes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each place, the most words from there that occur elsewhere in the same document too; and for each of ``sizes``
    how often the substring of so many words that is most frequent in a document occurs there, by document (0 for none
    that repeats).

    ``ids`` numbers the words, ``docs`` the documents, ascending.
    """
    n = len(ids)
    last = int(docs[-1]) + 1 if n else 0
    if n < 2:
        return np.zeros(n, np.int64), [np.zeros(last, np.int64) for _ in sizes]
    words = (docs.astype(np.int64) << 32) | ids
    suffixes = suffix_array(words)
    shared = common_prefixes(words, suffixes)
    out = np.zeros(n, np.int64)
    out[suffixes] = np.maximum(shared, np.r_[shared[1:], 0])
    most = []
    for size in sizes:
        interval = np.cumsum(shared < size) - 1
        times = np.bincount(interval)
        first = np.flatnonzero(shared < size)
        top = np.zeros(last, np.int64)
        np.maximum.at(top, docs[suffixes[first]], np.where(times > 1, times, 0))
        most.append(top)
    return out, most


def _covered(reach: np.ndarray, docs: np.ndarray, least: int, n_docs: int) -> np.ndarray:
    """By document, the words in repeats of at least ``least`` words."""
    marks = np.zeros(len(reach) + 1, np.int64)
    starts = np.flatnonzero(reach >= least)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + reach[starts], -1)
    return np.bincount(docs, weights=np.cumsum(marks)[: len(reach)] > 0, minlength=n_docs).astype(np.int64)


def _measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The figures of some texts, and ``repetitive``: whether one of the limits by length is passed."""
    numbers: dict[bytes, int] = {}
    n_words, chars, symbols, dup_lines = [], [], [], []
    ids: list[int] = []
    for text in texts:
        data = (text or "").encode()
        words = data.split()
        n_words.append(len(words))
        ids += [numbers.setdefault(w, len(numbers)) for w in words]
        chars.append(len(text or "") - len(data) + len(data.translate(None, BLANKS)))
        symbols.append(len(data) - len(data.translate(None, SYMBOLS)))
        seen, dups = set(), 0
        for line in data.split(b"\n"):
            if line.strip(BLANKS):
                dups += line in seen
                seen.add(line)
        dup_lines.append(dups)
    sizes = np.array(n_words, np.int64)
    n = len(sizes)
    docs = np.repeat(np.arange(n), sizes)
    reach, most = repeats(np.array(ids, np.int64), docs, tuple(MOST))
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, docs, reach)
    over = np.zeros(n, bool)
    for least, share in COVERED.items():
        over |= 100 * _covered(reach, docs, least, n) > share * sizes
    for (size, share), top in zip(MOST.items(), most):
        over |= 100 * size * np.pad(top, (0, n - len(top))) > share * sizes
    return {
        "n_words": sizes, "word_chars": np.array(chars, np.int64), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(dup_lines, np.int64),
        "n_repeat_words": _covered(reach, docs, MIN_REPEAT, n), "longest_repeat": longest, "repetitive": over & (sizes >= VERDICT_WORDS),
    }


def measured(texts: list[str | None]) -> Iterator[dict[str, np.ndarray]]:
    """The figures of all texts, some at a time."""
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or "") // 6 + 1
        if held >= CHUNK_WORDS:
            yield _measure(part)
            part, held = [], 0
    if part:
        yield _measure(part)


def quality(docs: DataFrame, min_words: int = MIN_WORDS, max_covered: int = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """doc_id, the figures, base_failed and kept for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part, done = batch.slice(at, 2048), 0
                for m in measured(part.column(1).to_pylist()):
                    size = len(m["n_words"])
                    failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > max_covered * m["n_words"])
                    kept = ~failed & ~m.pop("repetitive") & (m["longest_repeat"] <= max_longest)
                    cols = m | {"base_failed": failed, "kept": kept}
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(done, size), *map(pa.array, cols.values())], names=["doc_id", *cols])
                    done += size

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, longest_repeat long, base_failed boolean, kept boolean"
    return id_and_text(docs).mapInArrow(run, schema)
