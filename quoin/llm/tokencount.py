"""Token counts by a map-side lookup in two tiers.

The lengths of frequent pre-tokens are counted on a bounded sample, put into one compact table and broadcast; pre-tokens
that aren't in it are encoded once a worker and kept in the worker's own bounded cache. Which pre-tokens are in the
table changes the speed and never a count, so no pre-token is shuffled.

Scale: one pass, no shuffle; the table holds at most ``table_words`` words, a worker's cache ``cache_words``. The
sample is ``sample_rows`` texts of at most ``SAMPLE_CHARS`` characters, which the driver counts.

Texts are cut up as the library does it: special strings first, then normal form and lower case, then the pattern of the
pre-tokens. For Latin-1, which is its own normal form, the standard modules do the same faster; other texts go through
the library's normaliser and splitter, whose Unicode version decides, and then meet the same two tiers.

Edge cases: null is empty text with no tokens; special strings in a text count one each; a long text is cut up some
characters at a time, at blanks, which no pre-token holds. Rows that repeat an id are counted each.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text

SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 20_000
TABLE_WORDS = 1 << 16
CACHE_WORDS = 300_000
_STEP = 1 << 16
#: Pre-tokens of the lower-casing word scheme (fixed by the tokenizer's format), its classes written out for Latin-1.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PRE_TOKEN = rf"[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_N}]|[^\t-\r\x20\x85\xa0{_L}{_N}]+"


class Counts(dict):
    """pre-token -> number of tokens: the broadcast tier below, the worker's own cache on top."""

    def __init__(self, encode, frequent: dict[str, int], room: int) -> None:
        super().__init__(frequent)
        self.encode, self.frequent, self.room = encode, frequent, len(frequent) + room

    def __missing__(self, word: str) -> int:
        n = self.encode(word)
        if len(word) <= 64:
            if len(self) >= self.room:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class TokenCounter:
    """Counts the tokens of texts as the library does."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None, cache_words: int = CACHE_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None
        self.find = re.compile(LATIN_PRE_TOKEN).findall
        self.normalize = tokenizer.normalizer.normalize_str
        with open(path, encoding="utf-8") as f:
            pattern = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        model = tokenizer.model.tokenize
        self.counts = Counts(lambda word: len(model(letters(word)[0][0])), frequent or {}, cache_words)

    def pre_tokens(self, text: str | None) -> Iterator[tuple[list[str], int]]:
        """The normalised pre-tokens, and the number of special strings, of one stretch of the text after another."""
        text, at = text or "", 0
        while at < len(text):
            end = text.find(" ", at + _STEP)
            part = text[at : end if end >= 0 else len(text)]
            at += len(part)
            parts = self.cut(part) if any(s in part for s in self.special) else [part]
            words = []
            for p in parts:
                words += self.find(p.lower()) if _latin(p) else [w for w, _ in self.split(self.normalize(p))]
            yield words, len(parts) - 1

    def count(self, text: str | None) -> int:
        return sum(sum(map(self.counts.__getitem__, words)) + special for words, special in self.pre_tokens(text))


def frequent_lengths(docs: DataFrame, path: str, sample_rows: int = SAMPLE_ROWS, table_words: int = TABLE_WORDS) -> tuple[bytes, bytes]:
    """Frequent pre-tokens of a bounded sample, joined by newlines, and their token counts as 16-bit integers."""

    # reads as few partitions as it takes: which words are in the table changes the speed and no count
    rows = id_and_text(docs).where(F.length("text") <= SAMPLE_CHARS).select("text").limit(sample_rows).collect()
    seen, counter = Counter(), TokenCounter(path)
    for row in rows:
        for found, _ in counter.pre_tokens(row.text):
            seen.update(w for w in found if len(w) <= 64)
    words = sorted(seen, key=lambda w: (-seen[w], w))[:table_words]
    lengths = [min(65535, counter.counts[w]) for w in words]
    return "\n".join(words).encode(), np.array(lengths, "<u2").tobytes()


@lru_cache(maxsize=2)
def _counter(path: str, words: bytes, lengths: bytes, cache_words: int) -> TokenCounter:
    names = words.decode().split("\n") if words else []
    return TokenCounter(path, dict(zip(names, np.frombuffer(lengths, "<u2").tolist())), cache_words)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, sample_rows: int = SAMPLE_ROWS, table_words: int = TABLE_WORDS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_rows, table_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, *sent.value, cache_words)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(1).to_pylist()
                n = np.fromiter(map(counter.count, texts), np.int64, len(texts))
                size = np.fromiter((len((t or "").encode()) for t in texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
