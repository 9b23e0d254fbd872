"""Byte-level BPE as a streaming transducer with bounded lookahead.

Encoding. A prefix of the input has exactly one encoding, and its last token follows from the encodings of shorter
prefixes: it is the token ending there that stays apart from the last token before it when merges run in order. So one
pass from the left gives the last token of each prefix. What follows can still change the tokens near the end, but only
through a chain of overlapping merges, each earlier in the merge list than the one it disturbs. ``lookahead`` follows
these chains through the whole list and gives the number of bytes after which nothing can change. A token is emitted
once that many bytes have been read past its end; what is kept is a window of that length, however long the input.

Decoding. Token bytes go through an incremental UTF-8 state machine, which holds at most an unfinished character.

A text comes in parts. Its pre-tokens and special strings are found in a window: what could still change with the next
part waits, and of a pre-token that outgrows the window all but its end goes to the transducer at once. Tokens leave as they
become stable, to the digest and the decoder. Most pre-tokens repeat; a worker keeps a bounded cache of their encodings,
and clears it when it is full.

Scale: no shuffle at all; a worker holds the merge list, the caches, one Arrow batch and a window. Edge cases: null is empty
text and has no tokens; special strings in a text become their own ids, as the tokenizer file asks; a very long text, be
it one pre-token, takes no more memory than the batch it comes in; rows that repeat an id are encoded each.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text

#: Pre-tokens of the byte-level scheme (fixed by the tokenizer's format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern over Latin-1, its classes written out, for the faster standard module.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r\x20\x85\xa0"
LATIN_PRE_TOKEN = rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_CACHE_WORDS = 150_000
_CACHE_PAIRS = 150_000
_CACHED_BYTES = 64
#: Bytes that are decoded from a batch at once, and characters of a pre-token beyond which it isn't held.
_PART = 1 << 16
_LONG = 1 << 12


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones are themselves, others follow 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class State:
    """The longest end of what was read that begins a token: ``ends`` are the tokens that end here, with their lengths."""

    __slots__ = ("ends", "next")

    def __init__(self, ends: tuple[tuple[int, int], ...]) -> None:
        self.ends, self.next = ends, {}


class Merges:
    """Tokens as numbers, and what the merge list says about their neighbours."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]) -> None:
        self.ids = tokens
        self.bytes_of: dict[int, bytes] = {i: t for t, i in tokens.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: rank, left, right of the merge that makes it
        for r, (a, b) in enumerate(merges):
            left, right = tokens[a], tokens[b]
            self.rank.setdefault((left, right), r)
            self.parts.setdefault(tokens[a + b], (r, left, right))
        self.longest = max(map(len, tokens))
        self.pairs: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.whole_ids = {t: i for t, i in tokens.items() if self.whole(i)}
        self.prefixes = {t[:n] for t in self.whole_ids for n in range(1, len(t) + 1)}
        self.states = {b"": State(())}
        self.lookahead = self._lookahead()

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one end of ``token`` as merges are undone, each with the rank of the merge that uses it up."""
        out, used = [], 1 << 60
        while True:
            out.append((token, used))
            if token not in self.parts:
                return out
            used, token = self.parts[token][0], self.parts[token][1 + side]

    def _lookahead(self) -> int:
        """Bytes to read after a token before it is sure to stay, over all chains of merges in the list."""
        reach: dict[int, int] = {}  # token: bytes past its end that a merge taking it as its left part looks at
        most = 0
        for left, right in self.rank:  # in order of rank, so that a chain only gets earlier to the right
            n = len(self.bytes_of[right])
            beyond = max((reach.get(t, 0) for t, _ in self.spine(right, 1)), default=0)
            reach[left] = max(reach.get(left, 0), n + beyond)
            most = max(most, reach[left])
        return most

    def apart(self, a: int, b: int, before: int = 1 << 60) -> bool:
        """Whether no merge of rank under ``before`` ever joins the end of ``a`` with the start of ``b``."""
        rank = self.rank
        for x, x_used in self.spine(a, 1):
            for y, y_used in self.spine(b, 0):
                r = rank.get((x, y))
                # at equal rank the leftmost pair is merged first: a's own merge wins, b's own loses
                if r is not None and r < x_used and r <= y_used and r < before:
                    return False
        return True

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        known = self._whole.get(token)
        if known is None:
            if token not in self.parts:
                known = len(self.bytes_of[token]) == 1
            else:
                r, a, b = self.parts[token]
                known = self.whole(a) and self.whole(b) and self.apart(a, b, r)
            self._whole[token] = known
        return known

    def follows(self, a: int, b: int) -> bool:
        """``apart``, remembered: the pairs met are few beside the words they come from."""
        if len(self.pairs) >= _CACHE_PAIRS:
            self.pairs.clear()
        known = self.pairs[a << 24 | b] = self.apart(a, b)
        return known

    def step(self, read: bytes) -> State:
        """The state that the last bytes read lead to; there are no more states than beginnings of tokens."""
        at = max(0, len(read) - self.longest)
        while read[at:] not in self.prefixes:
            at += 1
            if at >= len(read):
                raise ValueError("bytes that no token covers")
        end = read[at:]
        found = self.states.get(end)
        if found is None:
            ids = self.whole_ids
            found = self.states[end] = State(tuple((ids[end[i:]], len(end) - i) for i in range(len(end)) if end[i:] in ids))
        return found


class Encoder:
    """Takes bytes of one pre-token as they come; ``feed`` and ``close`` give the tokens that are sure to stay."""

    def __init__(self, merges: Merges) -> None:
        self.m, self.state = merges, merges.states[b""]
        self.data = bytearray()  # what has been read and not emitted
        self.tail = b""  # the emitted bytes before it that a state may look at
        self.ends: list[tuple[int, int]] = [(-1, 0)]  # last token of what was emitted, then of each prefix of ``data``

    def _read(self, data: bytes) -> None:
        m, state, ends, n = self.m, self.state, self.ends, len(self.data)
        pairs, follows = m.pairs.get, m.follows
        self.data += data
        for byte in data:
            n += 1
            after = state.next.get(byte)
            if after is None:
                after = state.next[byte] = m.step(self.tail + bytes(self.data[max(0, n - m.longest) : n]))
            state = after
            for one in state.ends:
                token, size = one
                if size <= n:  # a token that began before a sure boundary isn't one
                    before = ends[n - size][0]
                    if before < 0:
                        break
                    known = pairs(before << 24 | token)
                    if known or known is None and follows(before, token):
                        break
            ends.append(one)
        self.state = state

    def _emit(self, final: bool) -> list[int]:
        """Tokens that end before the lookahead, or all."""
        ends, at, out = self.ends, len(self.data), []
        sure, upto = at if final else at - self.m.lookahead, 0
        while at > 0:
            one = ends[at]
            if at <= sure:
                upto = upto or at
                out.append(one[0])
            at -= one[1]
        out.reverse()
        if upto and not final:
            self.ends = [(out[-1], 0), *ends[upto + 1 :]]
            self.tail = (self.tail + bytes(self.data[:upto]))[-self.m.longest :]
            del self.data[:upto]
        return out

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        step = 4 * self.m.lookahead
        for at in range(0, len(data), step):
            self._read(data[at : at + step])
            if len(self.data) >= step:
                out += self._emit(False)
        return out

    def close(self) -> list[int]:
        return self._emit(True)


class Decoder:
    """Turns tokens into text as they come: bytes of a character that isn't finished wait for the next token."""

    def __init__(self, bytes_of: list[bytes]) -> None:
        self.bytes_of = bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int], final: bool = False) -> str:
        return self.machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)), final)


class Cache(dict):
    """pre-token -> its ids as little-endian 32-bit integers."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        encoder = Encoder(self.merges)
        ids = encoder.feed(data) + encoder.close()
        out = _packed(ids)
        if len(data) <= _CACHED_BYTES:
            if len(self) >= _CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


class Codec:
    """A byte-level BPE tokenizer read from its JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]]
        self.merges = Merges({raw(t): i for t, i in vocab.items()}, [(raw(a), raw(b)) for a, b in pairs])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in self.merges.ids.items():
            self.bytes_of[i] = token
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self._find, self._latin = regex.compile(PRE_TOKEN).findall, re.compile(LATIN_PRE_TOKEN).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.cache = Cache(self.merges)

    def find(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._find(text)
        return self._latin(text)

    def stream(self, parts: Iterable[str]) -> Iterator[bytes]:
        """The ids of a text that comes in parts, as little-endian 32-bit integers, as soon as they are sure."""
        run = Run(self)
        hold = max(map(len, self.special), default=1) - 1
        held = ""
        for part in parts:
            held += part
            while self.cut and (found := self.cut.search(held)):
                yield from run.take(held[: found.start()], True)
                yield self.special[found[0]].to_bytes(4, "little")
                held = held[found.end() :]
            sure = max(0, len(held) - hold)  # the rest may begin a special string
            yield from run.take(held[:sure], False)
            held = held[sure:]
        yield from run.take(held, True)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text."""
        return b"".join(self.stream([text or ""]))

    def digests(self, parts: Iterable[str]) -> tuple[int, str, str]:
        """The number of tokens, and the digests of the ids and of the decoded text."""
        n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.bytes_of)
        for ids in self.stream(parts):
            n += len(ids) // 4
            ids_sha.update(ids)
            text_sha.update(decoder.feed(struct.unpack(f"<{len(ids) // 4}I", ids)).encode())
        text_sha.update(decoder.feed([], True).encode())
        return n, ids_sha.hexdigest(), text_sha.hexdigest()

    def decode(self, ids: bytes) -> Iterator[str]:
        """Pieces of the text, each from a bounded number of tokens."""
        decoder = Decoder(self.bytes_of)
        numbers = np.frombuffer(ids, "<u4")
        for at in range(0, len(numbers), 1 << 14):
            yield decoder.feed(numbers[at : at + (1 << 14)].tolist())
        yield decoder.feed([], True)


class Run:
    """Cuts a stretch between special strings into pre-tokens, as its text comes."""

    #: What goes on with a letter, a number, white space, and anything else.
    KINDS = [regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"\s+", r"[^\s\p{L}\p{N}]+")]

    def __init__(self, codec: Codec) -> None:
        self.codec, self.left = codec, ""
        self.open: tuple[Encoder, regex.Pattern] | None = None  # a pre-token under way, and what goes on with it

    def take(self, text: str, last: bool) -> Iterator[bytes]:
        """Reads on; ``last`` says that the stretch ends here."""
        text, self.left = self.left + text, ""
        if self.open:
            text = yield from self._go_on(text, last)
        if not text:
            return
        cache = self.codec.cache
        words = self.codec.find(text)
        if not last:  # a contraction has three characters: a match that ends within two of the end isn't sure
            kept = len(text)
            while words and kept > len(text) - 2:
                kept -= len(words.pop())
            self.left = text[kept:]
        if words:
            yield b"".join(map(cache.__getitem__, words))
        if len(self.left) > _LONG and not last:
            head, text = self.left[:1], self.left
            first = text[1] if head == " " and not text[1].isspace() else head
            kind = next(k for k in self.KINDS if k.match(first))
            n = 0 if kind is self.KINDS[2] or first == head else 1
            self.open, self.left = (Encoder(self.codec.merges), kind), ""
            yield _packed(self.open[0].feed(text[:n].encode()))
            self.left = (yield from self._go_on(text[n:], False)) or self.left

    def _go_on(self, text: str, last: bool) -> Iterator[bytes]:
        """Feeds what belongs to the pre-token under way; the rest is returned."""
        encoder, kind = self.open
        found = kind.match(text)
        n = found.end() if found else 0
        ends = last or n < len(text)
        if kind is self.KINDS[2] and n and not (last and n == len(text)):
            n -= 1  # the last blank before a word isn't the run's
        out = encoder.feed(text[:n].encode())
        if ends:
            out += encoder.close()
            self.open = None
        yield _packed(out)
        if ends:
            return text[n:]
        self.left = text[n:]
        return ""


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def parts_of(data: pa.Buffer) -> Iterator[str]:
    """Text from UTF-8, some bytes at a time."""
    machine, view = codecs.getincrementaldecoder("utf-8")(), memoryview(data)
    for at in range(0, len(view), _PART):
        yield machine.decode(view[at : at + _PART], at + _PART >= len(view))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), decoded (the text that the ids give) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                texts = ["".join(c.decode(x)) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as ``encode``, with digests taken as the tokens leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [c.digests(parts_of(x.as_buffer()) if x.is_valid else ()) for x in part.column(1)]
                cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
