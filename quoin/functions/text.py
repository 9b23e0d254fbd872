"""Column functions over text: white-space normalisation, folding, grounding, token F1, cropping and display strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as white space, as a Java character class (without brackets).
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS_NO_NEWLINE = WS.replace(r"\t-\r", r"\t\x0b-\r")
# Characters whose case fold holds ASCII letters that plain lower-casing misses; marks become blanks.
_FOLDS = {
    "ß": "ss", "ẞ": "ss", "ſ": "s", "ŉ": " n", "ǰ": "j ", "ẖ": "h ", "ẗ": "t ", "ẘ": "w ", "ẙ": "y ", "ẚ": "a ",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st",
}
MIN_FRAGMENT = 3
CROP_WIDTH = 1000


def normalize_ws(text: Column) -> Column:
    """Each run of white space becomes a newline if it holds one, else a space; the ends are kept."""
    # matches begin where no white space precedes and give nothing back, so a run is read once
    return F.regexp_replace(F.regexp_replace(text, rf"(?<![{WS}])[{_WS_NO_NEWLINE}]*+\n[{WS}]*+", "\n"), rf"[{_WS_NO_NEWLINE}]++", " ")


def _is_ws(char: Column) -> Column:
    return F.coalesce(char.rlike(f"^[{WS}]$"), F.lit(False))


def remap(text: Column, offset: Column) -> Column:
    """Where an offset into ``text`` (from 0) lies in ``normalize_ws(text)``."""
    head = F.regexp_replace(F.substring(text, F.lit(1), offset), f"[{WS}]+", " ")
    inside = (offset > 0) & _is_ws(F.substring(text, offset, F.lit(1))) & _is_ws(F.substring(text, offset + 1, F.lit(1)))
    return F.length(head) - F.when(inside, 1).otherwise(0)


def shrink(normalized: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A range of normalised text without white space at its edges (there is at most one on either side)."""
    s = start + F.when((start < end) & _is_ws(F.substring(normalized, start + 1, F.lit(1))), 1).otherwise(0)
    return s, end - F.when((s < end) & _is_ws(F.substring(normalized, end, F.lit(1))), 1).otherwise(0)


def fold(text: Column) -> Column:
    """Lower-case ASCII letters and digits in words, one space between words."""
    # replacing in every text costs a fraction of asking first: a match before the next one made both five times as slow
    for char, plain in _FOLDS.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z]+", " "))


# What ``fold`` does to bytes: A-Z become a-z, all but letters and digits blanks; these characters come to hold ASCII ones.
_FOLD_TABLE = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
_FOLD_BYTES = {c.encode(): plain.encode() for c, plain in {**_FOLDS, "\u0130": "i ", "\u212a": "k"}.items()}
_SPECIAL = re.compile(b"|".join(_FOLD_BYTES))


def fold_bytes(text: bytes) -> bytes:
    """``fold`` of UTF-8, outside the engine."""
    if not text.isascii():
        text = _SPECIAL.sub(lambda m: _FOLD_BYTES[m[0]], text)
    return b" ".join(text.translate(_FOLD_TABLE).split())


def label_key(text: Column) -> Column:
    """White space collapsed and trimmed, case folded."""
    single = {c: f for c in map(chr, range(0x80, 0x3000)) if len(f := c.casefold()) == 1 and f != c.lower() and len(c.lower()) == 1}
    plain = F.translate(F.lower(text), "".join(c.lower() for c in single), "".join(single.values()))
    special = plain
    for char in _FOLDS:
        special = F.replace(special, F.lit(char.lower()), F.lit(char.casefold()))
    folded = F.when(plain.rlike(f"[{''.join(sorted({c.lower() for c in _FOLDS}))}]"), special).otherwise(plain)
    return F.btrim(F.regexp_replace(folded, f"[{WS}]+", " "), F.lit(" "))


def strip_ws(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{WS}]++|(?<![{WS}])[{WS}]++\z", "")


def fragments(quote: Column) -> Column:
    """Folded parts of a quote between ellipses, of at least MIN_FRAGMENT characters."""
    return F.filter(F.transform(F.split(quote, rf"[{WS}]*(?:\[\.\.\.\]|\.\.\.|…)[{WS}]*"), fold), lambda f: F.length(f) >= MIN_FRAGMENT)


def fragment_in(fragment: Column, haystack: Column) -> Column:
    """Whether folded text holds a folded fragment; a number at the fragment's edge must be whole."""
    left = F.when(fragment.rlike("^[0-9]"), F.lit("(?<![0-9])")).otherwise(F.lit(""))
    right = F.when(fragment.rlike("[0-9]$"), F.lit("(?![0-9])")).otherwise(F.lit(""))
    edged = fragment.rlike("^[0-9]|[0-9]$")
    return F.contains(haystack, fragment) & F.when(edged, F.rlike(haystack, F.concat(left, fragment, right))).otherwise(F.lit(True))


def is_grounded(quote: Column, haystack: Column) -> Column:
    """Whether every fragment of a quote is in ``haystack`` (already folded); false without fragments."""
    parts = fragments(quote)
    return (F.size(parts) > 0) & F.forall(parts, lambda f: fragment_in(f, haystack))


def words(text: Column) -> Column:
    """The folded words of a text; none for blank text."""
    return F.array_remove(F.split(fold(text), " "), "")


def shared_words(a: Column, b: Column) -> Column:
    """How many words two bags share, from one pass over both in order."""
    tagged = F.array_sort(F.concat(F.transform(a, lambda w: F.struct(w.alias("w"), F.lit(0).alias("side"))), F.transform(b, lambda w: F.struct(w.alias("w"), F.lit(1).alias("side")))))
    none = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("w"), none.alias("a"), none.alias("b"), none.alias("shared"))

    def more(s: Column, x: Column) -> Column:
        again, second = s["w"] == x["w"], x["side"] == 1
        in_a = F.when(again, s["a"]).otherwise(none) + F.when(second, none).otherwise(none + 1)
        in_b = F.when(again, s["b"]).otherwise(none) + F.when(second, none + 1).otherwise(none)
        return F.struct(x["w"].alias("w"), in_a.alias("a"), in_b.alias("b"), (s["shared"] + F.when(second & (in_b <= in_a), none + 1).otherwise(none)).alias("shared"))

    return F.aggregate(tagged, start, more)["shared"]


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 over bags of folded words; 1 if both are empty, 0 if one is or nothing is shared."""

    def f1(bags: Column) -> Column:
        p, g = bags["p"], bags["g"]
        none = (F.size(p) == 0) | (F.size(g) == 0)
        return F.when(none, (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * shared_words(p, g) / F.greatest(F.size(p) + F.size(g), F.lit(1)))

    return let(F.struct(words(predicted).alias("p"), words(gold).alias("g")), f1)


def crop_around(text: Column, quote: Column, width: int = CROP_WIDTH) -> Column:
    """About ``width`` characters of ``text`` that hold all of ``quote`` (or the start, if it is null), cut at spaces."""
    some = quote.isNotNull() & (F.length(quote) > 0)
    row = F.struct(text.alias("t"), F.length(text).alias("n"), F.coalesce(F.length(quote), F.lit(0)).alias("q"), F.coalesce(F.instr(text, quote), F.lit(1)).alias("at1"), some.alias("some"))

    def cut(r: Column) -> Column:
        at = r["at1"] - 1
        start = F.when(r["some"], F.greatest(F.lit(0), F.least(at - F.floor((width - r["q"]) / 2), r["n"] - width))).otherwise(0).cast("int")
        return F.struct(*(r[c].alias(c) for c in ("t", "n", "q", "some")), at.alias("at"), start.alias("start"), F.least(r["n"], start + width).alias("end"))

    def forward(r: Column) -> Column:  # a word cut at the left edge goes, unless the quote begins in it
        space = F.instr(F.substring(r["t"], r["start"] + 1, r["n"]), F.lit(" "))
        ok = (r["start"] > 0) & (space > 0) & (~r["some"] | (r["start"] + space <= r["at"]))
        return F.struct(*(r[c].alias(c) for c in ("t", "n", "q", "some", "at", "end")), (r["start"] + F.when(ok, space).otherwise(0)).alias("start"))

    def back(r: Column) -> Column:  # so does one cut at the right edge, unless the quote ends in it
        gap = F.instr(F.reverse(F.substring(r["t"], r["start"] + 1, r["end"] - r["start"])), F.lit(" "))
        ok = (r["end"] < r["n"]) & (gap > 0) & (~r["some"] | (r["end"] - gap >= r["at"] + r["q"]))
        return F.when(r["n"] <= width, r["t"]).otherwise(F.substring(r["t"], r["start"] + 1, r["end"] - F.when(ok, gap).otherwise(0) - r["start"]))

    return let(let(let(row, cut), forward), back)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def confidence_bucket(p: Column) -> Column:
    return F.when(p >= 0.9, "high").when(p >= 0.7, "medium").otherwise("low")


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", 100 * x)


def shown(value: Column, kind: Column, lo: Column, hi: Column) -> Column:
    """A figure as a report shows it: an en dash for null, percents with one decimal, numbers with three, and intervals."""
    pct = F.concat(percent(value), F.when(lo.isNotNull(), F.format_string(" [%.1f, %.1f]", 100 * lo, 100 * hi)).otherwise(""))
    num = F.concat(F.format_string("%.3f", value), F.when(lo.isNotNull(), F.format_string(" [%.3f, %.3f]", lo, hi)).otherwise(""))
    return F.when(value.isNull(), F.lit("–")).when(kind == "pct", pct).otherwise(num)


def shown_confidence(p: Column) -> Column:
    """A whole percent that is never 0 % or 100 %."""
    return F.when(p >= 0.995, ">99%").when(p < 0.005, "<1%").otherwise(F.format_string("%.0f%%", 100 * p))
