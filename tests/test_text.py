"""Text functions against plain Python, with characters that engines treat differently."""

import collections
import random
import re
import time

from pyspark.sql import functions as F

from quoin.functions import text as T
from quoin.functions.parsing import first_json_object, parse_label, parse_qa

ODD = ["", " ", "a  b", "x \t\n y", "\x1cq\x1d", "Straße ﬁne ſo ŉx ẞ", "İstanbul Ⅷ 60%", "a　\u0085b\r\n\r\nc  ", "日本 ​語", "“Curly” – dash"]


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def plain_normal(text):
    return re.sub(r"\s+", lambda m: "\n" if "\n" in m[0] else " ", text)


def plain_fold(text):
    return re.sub(r"[^0-9a-z]+", " ", text.casefold()).strip()


def test_normalize_and_remap_follow_python(spark):
    rnd = random.Random(1)
    texts = ODD + ["".join(rnd.choice("ab \t\n  .") for _ in range(rnd.randint(0, 25))) for _ in range(60)]
    rows, want = [], []
    for t in texts:
        norm = plain_normal(t)
        where, out, i = [], 0, 0
        for m in re.finditer(r"\s+|\S", t):
            where += [out] * len(m[0])
            out += 1
        where.append(out)
        for p in range(len(t) + 1):
            rows.append((t, p))
            want.append((norm, where[p]))
    got = one(spark, rows, "t string, p int", T.normalize_ws(F.col("t")), T.remap(F.col("t"), F.col("p")))
    assert got == want


def test_fold_follows_casefold(spark):
    assert [r[0] for r in one(spark, [(t,) for t in ODD], "t string", T.fold(F.col("t")))] == [plain_fold(t) for t in ODD]


def test_grounding_by_parts_and_edges(spark):
    lease = "Rent of €4,250 falls due on day 12 of every quarter; the tenant's deposit (3,100) bears no interest. See annex B-7."
    cases = {
        "RENT OF 4 250": True, "250 falls due": True, "50 falls due": False, "day 1": False, "day 12": True, "day 12 of every quart": True, "enant s deposit": True, "deposit 3 100 bears": True, "deposit 3 10": False,
        "rent of ... no interest": True, "no interest [...] rent of": True, "rent of … no dogs": False, "annex b 7": True, "...": False, "B-": False, " ; ": False, "": False, "quarter tenant": False,
    }
    got = one(spark, [(q, lease) for q in cases], "q string, e string", T.is_grounded(F.col("q"), T.fold(F.col("e"))))
    assert dict(zip(cases, (g[0] for g in got))) == cases


def test_long_runs_of_blanks_take_linear_time(spark):
    texts = [" " * 1_000_000 + "x", "a" + "\t " * 500_000 + "\n" + " " * 1_000_000, "\n" * 1_000_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    start = time.time()
    got = df.select(F.length(T.normalize_ws(F.col("t"))), F.length(T.strip_ws(F.col("t")))).collect()
    assert [tuple(r) for r in got] == [(2, 1), (2, 1), (1, 0)] and time.time() - start < 10


def test_label_key_is_casefold(spark):
    odd = ["STRASSE ẞß", "ŉ ǰ ẖẗẘẙẚ", "ﬀﬁﬂﬃﬄﬅﬆ ſ", "ΑΣ ς µ", "  a\u3000 B ", "plain Label"]
    got = one(spark, [(t,) for t in odd], "t string", T.label_key(F.col("t")))
    assert [g[0] for g in got] == [" ".join(t.split()).casefold() for t in odd]


def test_token_f1_of_long_bags(spark):
    a, b = " ".join(f"w{i % 700}" for i in range(20_000)), " ".join(f"w{i % 900}" for i in range(15_000))
    start = time.time()
    (got,) = one(spark, [(a, b)], "p string, g string", T.token_f1(F.col("p"), F.col("g")))[0]
    assert abs(got - plain_f1(a, b)) < 1e-12 and time.time() - start < 10


def plain_f1(p, g):
    p, g = plain_fold(p).split(), plain_fold(g).split()
    if not p or not g:
        return float(p == g)
    n = sum((collections.Counter(p) & collections.Counter(g)).values())
    return 2 * n / (len(p) + len(g))


def test_token_f1(spark):
    pairs = [("a b b", "b b c"), ("", ""), (".", "x"), ("x", ""), ("same words", "Same, words!"), ("one", "two"), ("a a a", "a")]
    got = one(spark, pairs, "p string, g string", T.token_f1(F.col("p"), F.col("g")))
    assert all(abs(a[0] - plain_f1(*b)) < 1e-12 for a, b in zip(got, pairs))


def test_crop_holds_the_quote_and_cuts_at_spaces(spark):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdef") for _ in range(rnd.randint(1, 12))) for _ in range(80))
    rows = [(text, text[i : i + 25], 80) for i in range(0, len(text) - 25, 7)] + [(text, None, 80), ("short", "or", 80)]
    got = one(spark, rows, "t string, q string, w int", T.crop_around(F.col("t"), F.col("q"), 80))
    for (t, q, w), (c,) in zip(rows, got):
        assert c in t and len(c) <= w and (q or "") in c
    assert got[-1][0] == "short" and text.startswith(got[-2][0]) and text[len(got[-2][0])] == " "


def test_parse_qa_ladder(spark):
    cases = [
        ('{"present": true, "evidence": ["a", " b ", " "]}', (True, ["a", "b"], True)),
        ('```json\n{"present": true, "evidence": ["a"]}\n```', (True, ["a"], True)),
        ('Well {not json} then {"evidence": [], "present": false} bye', (False, [], True)),
        ('{"present": true, "evidence": "one"}', (True, ["one"], False)),
        ('{"present": true, "evidence": ["a", 3]}', (True, [], False)),
        ('{"present": true, "evidence": ["a", null]}', (True, [], False)),
        ('{"present": true, "evidence": [null]}', (True, [], False)),
        ('{"present": true, "evidence": 3}', (True, [], False)),
        ('{"present": true}', (True, [], True)),
        ('{"present": true, "evidence": null}', (True, [], True)),
        ('{"present": false, "evidence": ["a"]}', (False, [], True)),
        ('{"present": "true", "evidence": []}', (None, [], False)),
        ('{"PRESENT" : TRUE, "evid', (True, [], False)),
        ('{"present": false, "evidence": ["cut', (False, [], False)),
        ('{"other": 1} {"present": true, "evidence": []}', (True, [], False)),
        ("[1, 2]", (None, [], False)),
        ("yes", (None, [], False)),
        ("", (None, [], False)),
    ]
    got = one(spark, [(o,) for o, _ in cases], "o string", parse_qa(F.col("o")).alias("p"))
    for (o, want), (p,) in zip(cases, got):
        assert (p.present, p.evidence, p.valid) == want, o


def test_parse_label_ladder(spark):
    labels = ["Governing Law", "License", "License Grant", "Audit Rights"]
    cases = [
        ("Governing Law", ("Governing Law", True)), ("  governing   law\n", ("Governing Law", True)), ("Answer: License.", ("License", True)), ('"License Grant"', ("License Grant", True)),
        ("**Audit Rights**", ("Audit Rights", True)), ("Clause type: audit rights", ("Audit Rights", True)), ("It is a license grant, not a license", ("License Grant", False)), ("none", (None, False)), ("", (None, False)),
    ]
    got = one(spark, [(o,) for o, _ in cases], "o string", parse_label(F.col("o"), labels).alias("p"))
    assert [(p.label, p.valid) for (p,) in got] == [w for _, w in cases]


def test_first_json_object_skips_other_values(spark):
    got = one(spark, [("[{}] x",), ("{{\"a\": 1}",), ("none",)], "o string", F.to_json(first_json_object(F.col("o"))))
    assert [g[0] for g in got] == ["{}", '{"a":1}', None]


def test_display(spark):
    rows = [(0.995,), (0.004,), (0.5,), (0.9,), (0.7,)]
    got = one(spark, rows, "p double", T.shown_confidence(F.col("p")), T.confidence_bucket(F.col("p")))
    assert got == [(">99%", "high"), ("<1%", "low"), ("50%", "low"), ("90%", "high"), ("70%", "medium")]
    rows = [(None, "pct", None, None), (0.125, "pct", 0.1, 0.2), (0.5, "num", None, None), (0.5, "num", 0.25, 0.75)]
    got = one(spark, rows, "v double, k string, lo double, hi double", T.shown(F.col("v"), F.col("k"), F.col("lo"), F.col("hi")))
    assert [g[0] for g in got] == ["–", "12.5% [10.0, 20.0]", "0.500", "0.500 [0.250, 0.750]"]
