"""Each training-data operator against a plain version of its contract, on small tables with awkward rows."""

import collections
import gzip
import hashlib
import itertools
import math
import os
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quoin.llm import bpe, common, decontam, langid, license, linededup, lm, quality, simhash, tokencount, warc

SCHEMA = "doc_id long, text string, lang string, fp string, component_id string, n long, word string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def make_docs():
    rnd = random.Random(3)
    vocab = [a + b for a in ("ta", "so", "mi", "ré", "lo", "The") for b in ("n", "rk", "", "st,", "x.")]
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        own = [w + ("ing" if lang == "en" else "ung") for w in vocab]
        lines = [" ".join(rnd.choice(own) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            lines.append("A line that many of these documents share")
        if i % 10 == 7:
            lines.append("Licensed under the Apache License, Version 2.0.")
        rows.append((i, "\n".join(lines), lang))
    rows += [(100, rows[4][1], "en"), (101, rows[4][1] + " end", "en"), (102, rows[4][1], None), (102, rows[4][1], None)]
    rows += [(103, None, "en"), (104, "", "de"), (105, " \n\t ", "de"), (106, "12 34 !?", None), (None, "no id here at all", "en")]
    rows += [(107, "word " * 3000, "en"), (108, "x<|endoftext|>y <|startoftext|>", "en"), (109, "日本語 “quoted” é ΑΣ İ 🎉", "de"), (110, "a" * 3000, "en")]
    return [(i, t, lang, "clash", "clash", 1, "clash") for i, t, lang in rows]


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected):
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == sorted(expected, key=repr)


def brute_fp(text):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(("blocks", "cell"), [(5, 20_000), (4, 2)])
def test_simhash(docs, rows, blocks, cell):
    fps = [(r[0], brute_fp(r[1])) for r in rows]
    comp = brute_components(sorted({f for _, f in fps}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, f in fps:
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    same(simhash.near_duplicates(docs, blocks=blocks, cell=cell), [(i, f"{f:016x}", least.get(comp[f])) for i, f in fps])


def test_simhash_links_planted_fingerprints(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base[:20]:
        for n in (1, 2, 3, 4):
            fps.add(b ^ sum(1 << k for k in rnd.sample(range(64), n)))
    fps |= {base[0] ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = brute_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    stars = {r.u: r.v for r in simhash.components(simhash.links(df, cell=30)).collect()}
    got = collections.defaultdict(set)
    for f in fps:
        got[stars.get(signed(f), signed(f))].add(f)
    expected = collections.defaultdict(set)
    for f, root in want.items():
        expected[root].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    ids = list(range(80))
    random.Random(1).shuffle(ids)
    stars = simhash.components(spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")).collect()
    assert {(r.u, r.v) for r in stars} == {(i, 0) for i in range(1, 80)}


@pytest.fixture(scope="module")
def classifier(docs):
    return license.train(docs)


def test_license(docs, rows, classifier):
    got = collections.Counter((r.doc_id, r.n_licences, r.families, r.probability is not None) for r in license.scan(docs, classifier).collect())
    has = lambda t: "Apache" in (t or "")
    assert got == collections.Counter((i, int(has(t)), "Apache-2.0" if has(t) else "", has(t)) for i, t, *_ in rows)


#: Notices in words of their own, and what they are; none is a template.
NOTICES = [
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("Use is governed by the GNU Lesser General Public License version 3, see COPYING.", "LGPL-3.0"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC"),
    ("// SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("/* SPDX-License-Identifier: GPL-3.0-or-later */", "GPL-3.0"), ("This file is part of Foo and covered by the GNU Affero General Public License v3 or later.", "AGPL-3.0"),
    ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT', "MIT"),
    ("Distributed under the MIT License.", "MIT"), ("The code is released under the Apache License 2.0", "Apache-2.0"), ("Text available under CC BY-SA 3.0", "CC-BY-SA-3.0"), ("Licensed under the terms of the Eclipse Public License v2.0.", "EPL-2.0"),
    ("Licensed under GPLv2.", "GPL-2.0"), ("licensed under the 3-clause BSD license", "BSD-3-Clause"), ("You may use this work under the terms of the Boost Software License, Version 1.0.", "BSL-1.0"), ("Released under the Mozilla Public License 1.1", "MPL-1.1"),
    ("This font is licensed under the SIL Open Font License, Version 1.1.", "OFL-1.1"), ("Distributed under the terms of the Artistic License 2.0", "Artistic-2.0"), ("This is free and unencumbered software released into the public domain.", "Unlicense"),
]
OTHERS = [
    "The apache of the mit released a version under water.", "general public version license gnu the under", "We signed a license agreement last year, version 2 of it.", "Licensed under the Apache License, Version 7.0.", "GNU General Public License, version 31",
    "The driving license was issued in Spain.", "Creative work without attribution", "", "software version 2.0 was released under pressure",
]


def test_license_versions_and_siblings(spark, classifier):
    texts = [t for t, _ in NOTICES] + OTHERS + [f"some words\n\n{NOTICES[0][0]}\n\n{NOTICES[1][0]}"]
    df = spark.createDataFrame([*((3, t) for t in texts), (None, NOTICES[2][0]), (None, "no notice")], "doc_id long, text string")
    got = license.scan(df, classifier).select("families", "n_licences", "probability").collect()
    right = sum(g.families == want for g, (_, want) in zip(got, NOTICES))
    assert right >= 0.9 * len(NOTICES) and [g.families for g in got[:9]] == [w for _, w in NOTICES[:9]], [(g.families, w) for g, (_, w) in zip(got, NOTICES) if g.families != w]
    assert [(g.families, g.n_licences, g.probability) for g in got[len(NOTICES) : len(NOTICES) + len(OTHERS)]] == [("", 0, None)] * len(OTHERS)
    assert [tuple(g)[:2] for g in got[-3:]] == [("Apache-1.1,GPL-2.0", 2), ("CC-BY-SA-4.0", 1), ("", 0)] and 0.5 <= got[-3].probability <= 1


def brute_notices(text, model):
    """Confirmed paragraphs of a text: every group of lines scored and compared, nothing left out beforehand."""
    lines = [license._words(x) for x in text.split("\n")]
    told, own = license.templates(), license.phrases()
    most, found = max(len(w) for t in told.values() for w in t), []
    for i, line in enumerate(lines):
        group, j, after = list(line), i, 0
        while line:
            p = model.probabilities([group])[0]
            f = int(p[:-1].argmax())
            if p[f] >= license.THRESHOLD:
                family = model.families[f]
                said = f" {' '.join(group)} "
                named = any(re.search(rf" {x}(?= )" + (r"(?! [1-9][0-9]*(?![a-z0-9]))" if x[-1].isdigit() else ""), said) for x in own[family])
                match = max(len(license._triples(group) & license._triples(t)) / len(license._triples(t)) for t in told[family])
                if named and match >= license.CONFIRM:
                    found.append((j, j - i, i, family, p[f]))
            if j + 1 >= len(lines) or not lines[j + 1] or after >= most:
                break
            j += 1
            after += len(lines[j])
            group += lines[j]
    kept = []
    for last, _, place, family, p in sorted(found):
        if not kept or kept[-1][0] < place:
            kept.append((last, place, family, p))
    return kept


def test_license_equals_a_plain_version(spark, docs, rows, classifier):
    mit = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files."
    gpl = "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU\n# General Public License version 3."
    rnd = random.Random(3)
    pool = [w for own in license.templates().values() for t in own for w in t]
    texts = [mit, gpl, f"{gpl}\n\n{mit}\nLicensed under CC BY 4.0.", *(t for t, _ in NOTICES), *OTHERS]
    texts += ["\n".join(" ".join(rnd.choice(pool) for _ in range(rnd.randint(0, 9))) for _ in range(5)) for _ in range(30)]
    texts += [t.replace(" ", "\n", 2) for t, _ in NOTICES[:6]] + [f"{a[0]} {b[0]}" for a, b in zip(NOTICES, NOTICES[3:])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: brute_notices(t, classifier) for i, t in enumerate(texts)}
    assert sum(map(bool, want.values())) > 25 and {w[2] for w in want[2]} == {"GPL-3.0", "MIT", "CC-BY-4.0"}
    for prefilter in (True, False):
        got = {r.doc_id: r for r in license.scan(df, classifier, prefilter=prefilter).collect()}
        for i, found in want.items():
            assert (got[i].n_licences, got[i].families) == (len(found), ",".join(sorted({w[2] for w in found}))), texts[i]
            assert not found or math.isclose(got[i].probability, min(w[3] for w in found), rel_tol=1e-6)
    row = license.paragraphs(df.where("doc_id = 1"), classifier).first()
    assert (row.place, row.family) == (1, "GPL-3.0") and row.match >= license.CONFIRM


def test_license_samples_by_hash(docs):
    a, b = license.train(docs), license.train(docs.repartition(7))
    assert (a.weights == b.weights).all() and a.temperature == b.temperature


def test_bpe(docs, rows):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    want = []
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        back = tok.decode(ids, skip_special_tokens=False)
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    same(bpe.encode_digests(docs, path), want)
    full = {(r.doc_id, len(r.ids), r.decoded) for r in bpe.encode(docs, path).collect()}
    assert full == {(w[0], w[1], r[1] or "") for w, r in zip(want, rows)}


def test_bpe_streams_with_bounded_window():
    path = P.path("byte_bpe_50k.json")
    codec, tok = bpe.codec(path), Tokenizer.from_file(path)
    rnd = random.Random(2)
    for alphabet in ("a", "ab", "=-", "thein", "aàé"):
        text = "".join(rnd.choice(alphabet) for _ in range(20_000))
        data, out, most = text.encode(), [], 0
        if len(codec.find(text)) > 1:
            continue
        encoder = bpe.Encoder(codec.merges)
        for at in range(0, len(data), 97):
            out += encoder.feed(data[at : at + 97])
            most = max(most, len(encoder.data))
        assert most <= 4 * codec.merges.lookahead + 97 + codec.merges.longest
        assert out + encoder.close() == tok.encode(text, add_special_tokens=False).ids


def test_bpe_of_texts_in_parts(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    codec, tok = bpe.codec(path), Tokenizer.from_file(path)
    monkeypatch.setattr(bpe, "_LONG", 6)
    rnd = random.Random(3)
    pools = ["ab c'", " \n\t ", "'re've'll", "12½", "!?'", "日本é🎉", ["<|endoftext|>", "<|endof"], "a", " "]
    for _ in range(1500):
        pool = rnd.sample(pools, rnd.randint(1, 3))
        text = "".join(rnd.choice(rnd.choice(pool)) for _ in range(rnd.randint(0, 60)))
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 12)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        ids = tok.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(codec.stream(parts)), "<u4").tolist() == ids, repr((text, parts))


def test_bpe_holds_a_window_of_a_long_text():
    codec = bpe.codec(P.path("byte_bpe_50k.json"))
    codec.digests(["warm it up, é"])
    for text in ("A word, “another”; and so on\n" * 200_000, "x" * 1_000_000):
        data = pa.py_buffer(text.encode())
        tracemalloc.start()
        n, _, decoded = codec.digests(bpe.parts_of(data))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert decoded == hashlib.sha256(data).hexdigest() and n > 1000 and most < 8 << 20


def test_bpe_decoder_waits_for_whole_characters():
    codec = bpe.codec(P.path("byte_bpe_50k.json"))
    decoder = bpe.Decoder(codec.bytes_of)
    ids = np.frombuffer(codec.encode("é🎉"), "<u4").tolist()
    assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], True) == "é🎉"


def test_token_counts(docs, rows):
    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    want = [(r[0], len((r[1] or "").encode()), n := len(tok.encode(r[1] or "", add_special_tokens=False).ids), n > 2048) for r in rows]
    same(tokencount.count_tokens(docs, path), want)
    same(tokencount.count_tokens(docs, path, sample_rows=3, table_words=5, cache_words=7), want)


def test_token_counts_of_any_script_meet_the_tiers():
    path = P.path("word_bpe_49k.json")
    tok, counter = Tokenizer.from_file(path), tokencount.TokenCounter(path, {"日本": 1000})
    rnd = random.Random(1)
    pools = ["abcXYZ '’s’t’re“”—…  \n\t", "日本語テキスト中文", "ПриветΣΑςσ İıǰJ\u030cǄ", "e\u0301éàǖ ﬁẞ \xa0\u2003\u3000", "🎉👩\u200d👩ا ل ع ر ب ي ه๑ᛰⅧ½²", ["<|endoftext|>", " <|startoftext|>xé"]]
    for _ in range(1500):
        text = "".join(rnd.choice(rnd.choice(pools)) if rnd.random() < 0.8 else chr(rnd.choice([rnd.randrange(32, 0xD7FF), rnd.randrange(0x10000, 0x1FFFF)])) for _ in range(rnd.randint(0, 40)))
        if "日本" not in text:
            assert counter.count(text) == len(tok.encode(text, add_special_tokens=False).ids), repr(text)
    assert counter.count("x 日本 “日本”") == 2003 + counter.counts["“"] + counter.counts["”"] - 2  # the broadcast tier is asked for every script
    long = "Ein «langer» Text… " * 20_000
    assert len(list(counter.pre_tokens(long))) > 3 and counter.count(long) == len(tok.encode(long, add_special_tokens=False).ids)


@pytest.mark.parametrize("block_words", [10**6, 12])
def test_decontamination(spark, docs, rows, block_words):
    long = decontam.words(rows[8][1])
    items = [(3, rows[0][1]), (20, rows[2][1][:90]), (7, "no id, here"), (8, ""), (9, None), (11, "totally other words than the ones in use here and there"), (11, "word word"), (12, " ".join(w.decode() for w in long[2:13]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    want = []
    for i, text, *_ in rows:
        words, hit, names = split(text), set(), set()
        for item, t in items:
            own = split(t)
            size = min(10, len(own))
            grams = {tuple(own[j : j + size]) for j in range(len(own) - size + 1)} if size else set()
            for j in range(len(words) - size + 1 if size else 0):
                if tuple(words[j : j + size]) in grams:
                    hit |= set(range(j, j + size))
                    names.add(str(item))
        want.append((i, len(words), sorted(hit), sorted(names)))
    assert any(w[2] for w in want)
    same(decontam.contamination(docs, bench, block_words=block_words), want)


def test_decontamination_without_a_benchmark(spark):
    texts = spark.createDataFrame([(1, "zero one"), (None, None)], "doc_id long, text string")
    same(decontam.contamination(texts, None), [(1, 2, [], []), (None, 0, [], [])])


@pytest.mark.parametrize("block_words", [10**6, 2])
def test_decontamination_by_items_without_id(spark, block_words):
    bench = spark.createDataFrame([(None, "one two three"), (4, "two three"), (None, None)], "item_id long, text string")
    texts = spark.createDataFrame([(1, "zero one two three"), (2, "two three"), (3, "one two")], "doc_id long, text string")
    same(decontam.contamination(texts, bench, block_words=block_words), [(1, 4, [1, 2, 3], ["4"]), (2, 2, [0, 1], ["4"]), (3, 2, [], [])])
    same(decontam.contamination(texts, bench.where("item_id is null"), block_words=block_words), [(1, 4, [1, 2, 3], []), (2, 2, [], []), (3, 2, [], [])])


def test_winnowing_guarantee():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        shared = rnd.integers(0, 50, 10).astype(np.uint64)
        a = np.r_[rnd.integers(0, 50, 13).astype(np.uint64), shared, rnd.integers(0, 50, 5).astype(np.uint64)]
        b = np.r_[rnd.integers(0, 50, 4).astype(np.uint64), shared]
        kept = [set(g[decontam.winnow(g, 6)].tolist()) for g in (decontam._gram_hashes(x, 5) for x in (a, b))]
        assert kept[0] & kept[1] & set(decontam._gram_hashes(shared, 5).tolist())


def test_lm(docs, rows):
    split = lambda t: WORD.findall(lower(t or "")) + [""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    counts = collections.Counter(w for r in rows if not held(r[0]) for w in split(r[1]))
    n, v = sum(counts.values()), len(counts)
    for table in (1 << 17, 20):
        got = lm.score(docs, table=table).collect()
        assert len(got) == len(rows)
        want = sorted(((r[0], held(r[0]), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) for r in rows for w in [split(r[1])]), key=repr)
        for g, e in zip(sorted((tuple(g)[:6] for g in got), key=repr), want):
            assert g[:5] == e[:5] and math.isclose(g[5], e[5], rel_tol=1e-9)
        assert sum(g.score for g in got) > sum(g.base_score for g in got)


def test_lm_probabilities_sum_to_one(docs):
    counts = lm.token_counts(docs)
    model = lm.train(docs, counts, table=40)
    words = {r.word: r.n for r in counts.collect()}
    texts = [[b"the", w] for w in words] + [[b"the", b"\0unseen"]]
    p = 0.0
    for text in texts:
        _, logs, _, other, ids = model.score([text])
        _, first, _, first_other, _ = model.score([text[:1]])
        more = math.log10(words.get(text[1], 0) + 0.1) if ids[1] == 0 else 0
        p += 10 ** (logs[0] - first[0] + more - (other[0] - first_other[0]) * model.rest)
    assert abs(p - 1) < 1e-4


def test_lm_context_tells_rare_words_apart(spark):
    rnd = random.Random(5)
    texts = [" ".join(f"a{i} b{i}" for i in rnd.sample(range(1200), 80)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = lm.train(docs, lm.token_counts(docs))
    score = lambda i, j: model.score([[f"a{i}".encode(), f"b{j}".encode()]])[1][0]
    gains = [score(i, i) - score(i, (i + 600) % 1200) for i in range(0, 1200, 3)]  # over 2,400 words, all about as frequent
    assert sum(g > 0.3 for g in gains) > 0.8 * len(gains)


def lm_model(words, texts):
    counts = collections.Counter(w for t in texts for w in t)
    top = sorted(counts, key=lambda w: (w != lm.END, -counts[w], w))[:words]
    return lm.Model(top, np.array([counts[w] for w in top]), sum(counts.values()), len(counts))


def test_lm_tokens():
    texts = ["", " ", None, "a", " a  B ", "\t\n\x0b\x0c\rA\x85b \x1cX\xa0y\n", "\xc9A \u3000 z\0 ", "x" * 5000]
    want = [[w.encode() for w in WORD.findall(lower(t or ""))] + [lm.END] for t in texts]
    for column in (pa.array(texts), pa.array([None, *texts])[1:]):
        got = lm.tokens(column)
        assert [[w.encode() for w in t] for t in got.to_pylist()] == want
        model = lm.Model([lm.END, b"a"], np.array([5, 3]), 9, 3)
        ids, starts = model.places(got)
        assert ids.tolist() == [{b"": 2, b"a": 3}.get(w, 0) for t in want for w in t]
        sizes = [len(t) for t in want]
        assert starts.tolist() == [sum(sizes[:i]) for i in range(len(sizes))]
        words, times = lm._rare(got, ids, np.array(sizes))
        rare = [collections.Counter(w for w in t if w not in (b"", b"a")) for t in want]
        assert [dict(zip(*x)) for x in zip(words.to_pylist(), times.to_pylist())] == rare


def test_lm_long_text_in_bounded_memory():
    text = [[*(b"w%d" % (i * i % 3001) for i in range(400_000)), lm.END]]
    model = lm_model(2000, text)
    out = np.zeros((2, model.rows, lm.WIDTH))
    for run in (model.score, lambda t: model.gradient(t, out)):
        tracemalloc.start()
        run(text)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6  # one table of all its probabilities has over 51 MB, and several were held


def test_lm_works_in_one_thread():
    rnd = random.Random(6)
    texts = [[*(b"w%d" % min(int(rnd.paretovariate(0.5)), 5000) for _ in range(400)), lm.END] for _ in range(300)]
    model = lm_model(4000, texts)
    out = np.zeros((2, model.rows, lm.WIDTH))
    for run in (model.score, lambda t: model.gradient(t, out)):
        run(texts)
        all_threads, own = time.process_time(), time.thread_time()
        for _ in range(3):
            run(texts)
        all_threads, own = time.process_time() - all_threads, time.thread_time() - own
        assert all_threads < 1.2 * own + 0.05  # threads of BLAS spin between the small products of a task


def test_lm_gradient_against_plain_sums(monkeypatch):
    rnd = random.Random(7)
    texts = [[*(b"w%d" % min(int(rnd.paretovariate(0.7)), 900) for _ in range(rnd.choice((0, 1, 2, 300)))), lm.END] for _ in range(60)]
    model = lm_model(600, texts)
    model.factors = np.exp(np.random.default_rng(8).normal(0, 0.5, model.factors.shape)).astype(np.float32)
    monkeypatch.setattr(lm, "_PART", 64)  # rows with several of the largest pieces
    for chunk in (1 << 16, 1000):
        monkeypatch.setattr(lm, "_CHUNK", chunk)  # a text over several parts
        got, want, logs = np.zeros((2, model.rows, lm.WIDTH)), np.zeros((2, model.rows, lm.WIDTH)), 0.0
        model.gradient(texts, got)
        mask, numbers = (1 << 64) - 1, {w: i + 2 for i, w in enumerate(model.words.to_pylist())}
        for text in texts:
            ids = [1, 1, *(numbers.get(w, 0) for w in text)]
            for two, one, own in zip(ids, ids[1:], ids[2:]):
                while model.above[own] >= 0:
                    c, rows = int(model.above[own]), []
                    for tag, parts in ((1, (c, one)), (2, (c, one, two)), (3, (c, two))):
                        h = tag * 0x9E3779B97F4A7C15 & mask
                        for x in parts:
                            h = (h ^ x) * 0xD6E8FEB86659FD93 & mask
                            h ^= h >> 32
                        rows.append((h * 0x9E3779B97F4A7C15 & mask) >> (64 - model.rows.bit_length() + 1))
                    p = model.shares[c - model.first].astype(float) * model.factors[rows].astype(float).prod(0)
                    p /= p.sum()
                    for r in rows:
                        want[0, r, model.branch[own]] += 1
                        want[1, r] += p
                    logs += math.log10(p[model.branch[own]])
                    own = c
        assert (got[0] == want[0]).all() and np.allclose(got[1], want[1], rtol=1e-5, atol=1e-5)
        assert math.isclose(model.score(texts)[1].sum(), logs, rel_tol=1e-6)


def brute_quality(text):
    words = WORD.findall(text or "")
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def brute_verdict(text):
    """Whether the method keeps a text that passes the base rules, from all its substrings."""
    words = WORD.findall(text or "")
    n, grams = len(words), {}

    def places(size):
        if size not in grams:
            grams[size] = collections.defaultdict(list)
            for i in range(n - size + 1):
                grams[size][tuple(words[i : i + size])].append(i)
        return [p for p in grams[size].values() if len(p) > 1]

    if places(101):
        return False
    if n < 50:
        return True
    for size, share in ((6, 14), (7, 13), (8, 12), (9, 11), (10, 10)):
        if 100 * len({j for p in places(size) for i in p for j in range(i, i + size)}) > share * n:
            return False
    return all(100 * size * len(p) <= share * n for size, share in ((2, 20), (3, 18), (4, 16)) for p in places(size))


def test_quality(spark, docs, rows):
    rnd = random.Random(12)
    fresh = lambda n: [f"w{rnd.getrandbits(40)}" for _ in range(n)]
    long = fresh(101)
    planted = {
        "phrase": sum((["buy", "it", "now", *fresh(9)] for _ in range(30)), []), "pair": sum((["click", "here", *fresh(6)] for _ in range(30)), []), "line": (x := fresh(9)) + fresh(60) + x + fresh(30),
        "long": long + fresh(2400) + long, "hundred": long[:100] + fresh(2400) + long[:100], "plain": fresh(300), "few": (y := fresh(4)) + fresh(30) + y,
    }
    texts = {1000 + i: " ".join(w) for i, w in enumerate(planted.values())}
    more = docs.select("doc_id", "text").union(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    want = []
    for i, text in [*((r[0], r[1]) for r in rows), *texts.items()]:
        b = brute_quality(text)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        want.append((i, *b, failed, not failed and brute_verdict(text)))
    same(quality.quality(more).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"), want)
    assert dict(zip(planted, (w[7] for w in want[len(rows) :]))) == {"phrase": False, "pair": False, "line": False, "long": False, "hundred": True, "plain": True, "few": True}
    assert not any(w[6] for w in want[len(rows) :])


def test_suffix_array_repeats():
    rnd = random.Random(4)
    for _ in range(150):
        n, kinds = rnd.randint(0, 40), rnd.randint(1, 3)
        ids = np.array([rnd.randrange(kinds) for _ in range(n)], np.int64)
        docs = np.sort(np.array([rnd.randint(0, 2) for _ in range(n)], np.int64))
        reach, most = quality.repeats(ids, docs, (2, 3))
        for i, got in enumerate(reach):
            best = 0
            for j in range(n):
                if i != j and docs[i] == docs[j]:
                    k = 0
                    while max(i, j) + k < n and docs[i + k] == docs[j + k] == docs[i] and ids[i + k] == ids[j + k]:
                        k += 1
                    best = max(best, k)
            assert best == got
        for size, top in zip((2, 3), most):
            for d, got in enumerate(top):
                x = ids[docs == d].tolist()
                times = max(collections.Counter(tuple(x[i : i + size]) for i in range(len(x) - size + 1)).values(), default=0)
                assert got == (times if times > 1 else 0)


def test_suffix_array_of_a_long_copy():
    words = np.tile(np.random.default_rng(1).integers(0, 9, 40_000), 3)
    reach, _ = quality.repeats(words, np.zeros(len(words), np.int64))
    assert reach[0] == 80_000 and reach[40_000] == 80_000


def test_line_dedup(docs, rows):
    holders = collections.defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(-1 if i is None else i)
    want = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i]
        want.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    assert any(w[3] for w in want)
    same(linededup.dedup_lines(docs), want)


def test_marks_find_their_rows(spark):
    docs = spark.range(0, 90_000, 1, 2).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    rows = common.placed(docs)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    gone = rows.where("pmod(hash(doc_id), 3) = 0").select("__file", "__at")
    left = common.without(rows, lambda: gone)
    assert "SortMergeJoin" not in plan(left) and plan(left).count("Exchange") == 1  # the marks'
    same(left.select("doc_id"), [tuple(r) for r in docs.where("pmod(hash(doc_id), 3) <> 0").select("doc_id").collect()])
    assert common.without(rows, lambda: gone.limit(0)).count() == 90_000


def test_scratch_is_deleted(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with common.scratch():
        rows = common.placed(docs)
        kept = [rows.inputFiles()[0], common.cut(docs, "x").inputFiles()[0]]
        assert all(os.path.exists(f.removeprefix("file://")) for f in kept)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in kept)


def test_language(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] for r in rows}
    for g in got:
        if g.doc_id in (103, 104, 105, 106):
            assert (g.lang_pred, g.score) == ("und", 0.0)
        assert g.held_out == (zlib.crc32(("" if g.doc_id is None else str(g.doc_id)).encode()) % 5 == 0) and 0 <= g.score <= 1
        assert g.lang_pred in ("en", "de", "und")
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 60 and len(text[r[0]]) > 60}
    held = [g for g in got if g.held_out and g.doc_id in truth]
    assert held and sum(g.lang_pred == truth[g.doc_id] for g in held) >= 0.9 * len(held)


def brute_distribution(texts, context, order=3):
    """Probabilities of all bytes after ``context``, from raw texts: counts, escapes and exclusion by the book."""
    below = [1 / 256] * 256
    for k in range(order + 1):
        seen = collections.Counter()
        for t in texts:
            padded = b"   " + t
            for i in range(3, len(padded)):
                if padded[i - k : i] == context[len(context) - k :]:
                    seen[padded[i]] += 1
        if seen:
            total, kinds = sum(seen.values()), len(seen)
            left = sum(below[b] for b in range(256) if b not in seen)
            below = [seen[b] / (total + kinds) if b in seen else kinds / (total + kinds) * below[b] / left for b in range(256)]
    return below


def test_language_code_lengths_are_exact(spark):
    """Against escapes and exclusion worked out from raw texts, in more languages than are coded together."""
    rnd = random.Random(4)
    langs = [f"l{i:02}" for i in range(11)]
    texts = {x: ["".join(rnd.choice("abé 日"[: 2 + i % 4] + x) for _ in range(60)) for _ in range(3)] for i, x in enumerate(langs)}
    free = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(free.pop(), t, x) for x in langs for t in texts[x]]
    trees = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert [x for t in trees for x in t.langs] == langs and len(trees) == 2
    for text in (texts["l03"][0][:25], "zq\u0416 new", ""):
        data = text.encode()
        got = langid.code_lengths(trees, [b"other", data])[1]
        for x, bits in zip(langs, got):
            raw = [t.encode() for t in texts[x]]
            want = sum(-math.log2(brute_distribution(raw, (b"   " + data)[i : i + 3])[data[i]]) for i in range(len(data)))
            assert math.isclose(bits, want, rel_tol=1e-5, abs_tol=1e-9)
    long = (texts["l05"][0] * 9_000).encode()  # more than one piece
    whole = langid.code_lengths(trees, [long, long[:-1], long[-4:]])
    assert len(long) > langid._PIECE and np.allclose(whole[0] - whole[1], langid.code_lengths(trees, [long[-4:]])[0] - langid.code_lengths(trees, [long[-4:-1]])[0], atol=1e-2)


def test_language_many_labels(spark):
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    df = spark.createDataFrame([(i, "some text", f"label {i}") for i in free[:20]], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 12 languages"):
        langid.learn(df, max_languages=12)


def test_warc(spark, tmp_path):
    html = ["<p>same</p>" * 20, "short", None, "", "a\r\n\r\nWARC/1.1\r\n\r\nb" * 9, "é" * 200, "<p>same</p>" * 20]
    pages = [(i, f"http://h{i % 3}.example.org/{9 - i}?q={i}#x" if i else None, html[i % len(html)], "clash") for i in range(40)] + [(3, "http://x.example/\r\n", html[0], "clash"), (3, "again", html[0], "c"), (None, "http://[bad", html[5], "c")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload_digest string").repartition(5)
    got = warc.archive(df, str(tmp_path / "warc"), bytes_per_file=900).collect()
    digest = lambda h: hashlib.sha256((h or "").encode()).hexdigest()
    first = {}
    for i, _, h, _ in pages:
        if len((h or "").encode()) >= 100 and i is not None:
            first[digest(h)] = min(i, first.get(digest(h), i))
    want = []
    for i, _, h, _ in pages:
        f = first.get(digest(h))
        again = f is not None and f != i
        want.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", f if again else None))
    assert sorted(((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) for g in got), key=repr) == sorted(want, key=repr)
    assert all(g.intact for g in got)
    files = list((tmp_path / "warc").rglob("part-*.gz"))
    assert len(files) > 5 and all(len(gzip.decompress(f.read_bytes())) < 900 + 6000 for f in files)


@pytest.mark.parametrize("rows_per_range", [10, 25, 10**6])
def test_warc_histories_go_over_ranges(spark, rows_per_range):
    rnd = random.Random(2)
    pages = [(i, "http://hot.example/" if i % 3 else f"http://h{i % 7}.example/{i % 4}", f"<p>{i}</p>", f"2024-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)} 0{rnd.randint(0, 9)}:00:00") for i in range(150)]
    pages += [(200, "http://hot.example/", "x", None), (None, "http://hot.example/", "y", "2024-05-05 05:05:05")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, captured_at string").repartition(4)
    got = warc.archive(df, rows_per_range=rows_per_range, bytes_per_file=2_000).orderBy("range", "place").collect()
    order = [(g.url_key, g.captured_at, g.page_id is None, g.page_id or 0) for g in got]
    assert len(got) == len(pages) and order == sorted(order) and len({g.range for g in got}) == (1 if rows_per_range > 1000 else max(g.range for g in got) + 1)
    seen = collections.Counter()
    for g in got:
        seen[g.url_key] += 1
        assert g.history == seen[g.url_key]
    assert next(g for g in got if g.page_id == 200).captured_at == warc.DATE


def test_warc_tells_broken_payloads(spark, tmp_path):
    path = str(tmp_path / "warc")
    warc.write(spark.createDataFrame([(1, "http://a.example", "payload")], "page_id long, url string, html string"), path)
    file = next((tmp_path / "warc").rglob("part-*.gz"))
    file.write_bytes(gzip.compress(gzip.decompress(file.read_bytes()).replace(b"payload\r", b"pay1oad\r")))
    for crc in (tmp_path / "warc").rglob(".*.crc"):
        crc.unlink()
    assert [r.intact for r in warc.merged(warc.runs(spark, path)).collect()] == [False]


def test_loser_tree():
    rnd = random.Random(6)
    for k in (0, 1, 2, 3, 7, 12):
        runs = [sorted((rnd.randint(0, 9), i) for _ in range(rnd.randint(0, 8))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda r: r)) == sorted(sum(runs, []))


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        simhash.near_duplicates(empty), license.scan(empty), bpe.encode_digests(empty, P.path("byte_bpe_50k.json")), decontam.contamination(empty, bench), lm.score(empty),
        quality.quality(empty), linededup.dedup_lines(empty), langid.identify(empty), warc.archive(pages), tokencount.count_tokens(empty, P.path("word_bpe_49k.json")),
    ):
        assert df.count() == 0


def test_license_anchors_miss_nothing():
    words = license.anchors()
    assert len(words) < 30 and all(any(w in p for w in words) for own in license.phrases().values() for p in own)
    for family, own in license.templates().items():
        assert all(re.search(license.pattern(license.phrases()[family]), " ".join(t)) for t in own)
