"""Licence notices: a trained paragraph classifier over sparse word n-grams, confirmed by templates.

Paragraphs are lines, and for wrapped notices groups of neighbouring lines with words: the lines after the first go on
until they hold as many words as the longest template. Of confirmed groups that overlap, the one that ends first stays,
and of those the shortest. Words and pairs of words are hashed into ``FEATURES`` places, and a multinomial logistic
regression with an ``unknown`` class gives each family a probability. It is fitted on the driver to a bounded labelled
set: variants of the templates below, and at most ``SAMPLE_LINES`` lines of the corpus, chosen by their hashes among
``SAMPLE_ROWS`` texts chosen by theirs, that hold no template's phrase. A temperature, fitted to lines kept aside,
calibrates the probabilities; a family is predicted only at ``threshold`` or above.

A prediction is confirmed by the templates of its own family and version: one of the family's phrases, which name it with
its version or are its own wording, stands in the paragraph with no other number after it, and enough of one template's
word triples do. So another version or a sibling licence is never confirmed by what the two have in common.

Scoring uses DataFrame functions only. Since a confirmed paragraph holds a phrase, texts without any word that all
phrases need (``anchors``) aren't split, and groups without a phrase aren't scored; no result changes by that.

Scale: one pass without shuffle; each row is decided where it is. The model is a constant of the plan with ``FEATURES``
weights a family. Edge cases: null and empty texts have no licence paragraphs; rows that repeat an id, or have none, are
decided each; very long texts only cost the lines that they have.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 1 << 13
SAMPLE_ROWS = 200
SAMPLE_LINES = 1_000
THRESHOLD = 0.5
CONFIRM = 0.6
UNKNOWN = "unknown"
# Names of licences by family, with their versions, as they are commonly worded.
NAMES: dict[str, list[str]] = {
    "0BSD": ["Zero-Clause BSD license", "BSD Zero Clause License"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3", "GNU AGPL version 3", "AGPLv3"],
    "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1", "Apache Software License 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache 2 license"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "two-clause BSD license", "2-clause BSD license"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License", "three-clause BSD license", "3-clause BSD license"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License", "four-clause BSD license"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0"],
    "CC-BY-3.0": ["Creative Commons Attribution 3.0", "CC BY 3.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0", "CC BY 4.0"],
    "CC-BY-SA-3.0": ["Creative Commons Attribution-ShareAlike 3.0", "CC BY-SA 3.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0", "Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0", "Attribution-NonCommercial 4.0 International"],
    "CC-BY-ND-4.0": ["Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0", "Attribution-NoDerivatives 4.0 International"],
    "CC-BY-NC-SA-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC-SA 4.0", "Attribution-NonCommercial-ShareAlike 4.0 International"],
    "CC-BY-NC-ND-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC BY-NC-ND 4.0", "Attribution-NonCommercial-NoDerivatives 4.0 International"],
    "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License 1.0", "CDDL version 1.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"],
    "EUPL-1.2": ["European Union Public Licence, version 1.2", "EUPL, version 1.2", "European Union Public License 1.2", "EUPL v1.2"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL version 2", "GPLv2", "GPL version 2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU GPL version 3", "GPLv3", "GPL version 3"],
    "ISC": ["ISC License", "ISC licence"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "LGPLv2.1", "LGPL version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3", "GNU LGPL version 3", "LGPLv3", "LGPL version 3"],
    "MIT": ["MIT License", "MIT licence", "Expat License"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"],
    "OFL-1.1": ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"],
    "PostgreSQL": ["PostgreSQL License", "PostgreSQL licence"],
    "Unlicense": ["Unlicense"],
    "WTFPL": ["WTFPL", "Do What The F*ck You Want To Public License"],
    "Zlib": ["zlib License", "zlib/libpng license"],
}
# How notices name a licence, and wordings of their own by family, each with the phrase that only it has.
GRANTS = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under a {} License.", "This software is distributed under the terms of the {}.", "You can redistribute it and/or modify it under the terms of the {}.", "See LICENSE: {}", "Licensed under {}.", "{}"]
WORDINGS: dict[str, list[tuple[str, str]]] = {
    "MIT": [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "granted free of charge to any person obtaining a copy of this software"),
        ("The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", "merchantability fitness for a particular purpose and noninfringement"),
    ],
    "BSD-3-Clause": [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "redistribution and use in source and binary forms with or without modification are permitted"),
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "nor the names of its contributors may be used to endorse or promote products"),
    ],
    "BSD-4-Clause": [("All advertising materials mentioning features or use of this software must display the following acknowledgement.", "all advertising materials mentioning features or use of this software must display")],
    "ISC": [
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "with or without fee is hereby granted provided that the above copyright notice"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "this permission notice appear in all copies"),
    ],
    "0BSD": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided as is and the author disclaims all warranties.", "with or without fee is hereby granted the software is provided")],
    "GPL-2.0": [("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License.", "gnu general public license as published by the free software foundation either version 2")],
    "GPL-3.0": [("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.", "gnu general public license as published by the free software foundation either version 3")],
    "AGPL-3.0": [("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License.", "gnu affero general public license as published by the free software foundation either version 3")],
    "LGPL-2.1": [("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License.", "gnu lesser general public license as published by the free software foundation either version 2 1")],
    "LGPL-3.0": [("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License.", "gnu lesser general public license as published by the free software foundation either version 3")],
    "Apache-2.0": [("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "apache license version 2 0 the license you may not use this file")],
    "MPL-2.0": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "source code form is subject to the terms of the mozilla public license v 2 0")],
    "Unlicense": [("This is free and unencumbered software released into the public domain.", "free and unencumbered software released into the public domain")],
    "Zlib": [("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "in no event will the authors be held liable for any damages arising from the use of this software")],
    "BSL-1.0": [("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.", "to any person or organization obtaining a copy of the software and accompanying documentation")],
}
_SPLIT = r"[^a-z0-9]+"


def _words(text: str) -> list[str]:
    return [w for w in re.split(_SPLIT, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def _triples(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 3]) for i in range(len(words) - 2)} or {" ".join(words)}


def templates() -> dict[str, list[list[str]]]:
    """The words of every template by family: each name in each grant, the tag of the family, and its own wordings."""
    out = {}
    for family, names in NAMES.items():
        texts = [g.format(n) for n in names for g in GRANTS] + [f"SPDX-License-Identifier: {family}", *(t for t, _ in WORDINGS.get(family, []))]
        out[family] = [_words(t) for t in texts]
    return out


def phrases() -> dict[str, list[str]]:
    """What a confirmed paragraph holds by family: a name, the tag, or a phrase of a wording, as words joined by blanks."""
    return {f: sorted({" ".join(_words(n)) for n in names} | {" ".join(_words(f"license identifier {f}"))} | {p for _, p in WORDINGS.get(f, [])}) for f, names in NAMES.items()}


def pattern(some: list[str]) -> str:
    """A pattern for any of some phrases in words joined by blanks; one that ends in a number must be the whole version."""
    whole = [p + r"(?! [1-9]\d*\b)" if p[-1].isdigit() else p for p in some]
    return r"\b(?:" + "|".join(sorted(whole, key=lambda p: (-len(p), p))) + r")\b"


def anchors() -> list[str]:
    """Words of which every phrase holds one as a part, few, as most phrases hold ``licen``; two words for short ones."""
    left, out = {p for own in phrases().values() for p in own}, []
    parts = {p: {w for w in p.split(" ") if len(w) >= 3} | ({"licen"} if "licen" in p else set()) or {" ".join(p.split(" ")[:2])} for p in left}
    while left:
        pick = max(sorted(set().union(*(parts[p] for p in left))), key=lambda w: (sum(w in parts[p] for p in left), len(w), w))
        out.append(pick)
        left = {p for p in left if pick not in parts[p]}
    return out


def _word_column(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _SPLIT), "")


def _feature_column(words: Column) -> Column:
    """Places of the words and pairs of words."""
    place = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(FEATURES)).cast("int")
    pairs = F.zip_with(words, F.slice(words, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    return F.transform(F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0)))), place)


def _features(words: list[str]) -> list[int]:
    import zlib

    return [zlib.crc32(w.encode()) % FEATURES for w in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]]


class Classifier:
    """Weights over families and ``unknown`` (the last), biases and a temperature."""

    def __init__(self, families: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.families, self.weights, self.bias, self.temperature = families, weights, bias, temperature

    def probabilities(self, lines: list[list[str]]) -> np.ndarray:
        z = np.stack([self.weights[_features(x)].sum(0) if x else np.zeros(len(self.families) + 1) for x in lines]) + self.bias
        p = np.exp((z - z.max(1, keepdims=True)) / self.temperature)
        return p / p.sum(1, keepdims=True)


def fit(negatives: list[str], seed: int = 7, epochs: int = 100, rate: float = 0.5, decay: float = 1e-3) -> Classifier:
    """Gradient descent over all template variants and lines of other kinds."""
    rnd = random.Random(seed)
    told = templates()
    families = list(told)
    known = re.compile(pattern([p for own in phrases().values() for p in own])).search
    lines, labels = [], []
    for f, (family, own) in enumerate(told.items()):
        by_rule = own[: len(NAMES[family]) * len(GRANTS)]
        for words in own:
            for i in range(3 if words in by_rule else 12):
                lines.append([*(["copyright", "holder"] * (i % 3 == 2)), *(w for w in words if not i or rnd.random() > 0.08)])
                labels.append(f)
    others = [w for w in map(_words, negatives) if w and not known(" ".join(w))]
    shared = [w for own in told.values() for words in own for w in words]
    bags = [[rnd.choice(shared) for _ in range(rnd.randint(3, 14))] for _ in range(400)]  # the words without the order
    others += [w for w in bags if not known(" ".join(w))]
    lines += others
    labels += [len(families)] * len(others)
    order = list(range(len(lines)))
    rnd.shuffle(order)
    aside, used = order[::5], [i for j, i in enumerate(order) if j % 5]
    k = len(families) + 1
    feats = [np.array(_features(lines[i]), np.int64) for i in used]
    places, cols = np.unique(np.concatenate(feats), return_inverse=True)
    x = np.zeros((len(used), len(places)), np.float32)
    np.add.at(x, (np.repeat(np.arange(len(used)), [len(f) for f in feats]), cols), 1)
    y = np.eye(k, dtype=np.float32)[[labels[i] for i in used]]
    scale = (1 / np.sqrt(np.maximum(1, x.sum(1))))[:, None]
    w, b, aw, ab = np.zeros((len(places), k), np.float32), np.zeros(k, np.float32), np.full((len(places), k), 1e-6, np.float32), np.full(k, 1e-6, np.float32)
    for _ in range(epochs):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        g = y - p / p.sum(1, keepdims=True)
        gw, gb = x.T @ (g * scale) - decay * len(used) * w, g.sum(0)
        aw += gw**2
        ab += gb**2
        w += rate * gw / np.sqrt(aw)
        b += rate * gb / np.sqrt(ab)
    weights = np.zeros((FEATURES, k))
    weights[places] = np.round(w, 3)
    model = Classifier(families, weights, np.round(b.astype(float), 3), 1.0)
    held, truth = [lines[i] for i in aside], np.array([labels[i] for i in aside])
    losses = {}
    for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0):
        model.temperature = t
        losses[t] = -np.log(np.maximum(model.probabilities(held)[np.arange(len(held)), truth], 1e-12)).mean()
    model.temperature = min(losses, key=losses.get)
    return model


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _table(values: np.ndarray) -> Column:
    """A constant array; made from one text, as a literal for each number would be slow to build."""
    return F.split(F.lit(",".join(f"{x:g}" for x in values.astype(float).tolist())), ",").cast("array<double>")


def _groups(by_line: Column) -> Column:
    """place, last, words of each line, then with one more line, two more and so on, up to the next line without a word or
    until the lines after the first hold as many words as the longest template."""
    most = max(len(words) for own in templates().values() for words in own)
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines"), F.lit(True).alias("on"))

    def further(a: Column, line: Column) -> Column:
        on = a["on"] & (F.size(line) > 0) & (a["n"] < most)
        return F.struct((a["n"] + F.size(line)).alias("n"), (a["lines"] + on.cast("int")).alias("lines"), on.alias("on"))

    def from_line(line: Column, i: Column) -> Column:
        more = F.when(F.size(line) > 0, F.aggregate(F.slice(by_line, i + 2, F.lit(most)), start, further)["lines"]).otherwise(-1)
        counts = F.slice(F.sequence(F.lit(1), F.lit(most + 1)), F.lit(1), more + 1)
        return F.transform(counts, lambda k: F.struct(i.alias("place"), (i + k - 1).alias("last"), F.flatten(F.slice(by_line, i + 1, k)).alias("words")))

    return F.flatten(F.transform(by_line, from_line))


def notices(text: Column, model: Classifier, threshold: float = THRESHOLD, confirm: float = CONFIRM, prefilter: bool = True) -> Column:
    """array<struct<place, last, family, probability, match>> of a text's confirmed paragraphs, in order of place.

    Without ``prefilter`` every text is split and every group scored; the result is the same."""
    own, told = phrases(), templates()
    some = [p for f in model.families for p in own[f]]
    edge, bias = model.weights[:, :-1] - model.weights[:, -1:], model.bias[:-1] - model.bias[-1]
    tables = F.array(*(_table(edge[:, f]) for f in range(len(model.families))))
    offsets = F.array(*(F.lit(float(b)) for b in bias))
    # constants of the plan, picked by the number of the family
    own_pattern = F.array(*(F.lit(pattern(own[f])) for f in model.families))
    own_triples = F.array(*(F.split(F.lit("|".join(";".join(sorted(_triples(w))) for w in told[f])), r"\|") for f in model.families))

    def judged(g: Column) -> Column:
        feats = _feature_column(g["words"])
        z = F.zip_with(tables, offsets, lambda t, b: (F.aggregate(feats, F.lit(0.0), lambda a, i: a + F.get(t, i)) + b) / F.lit(model.temperature))
        return _let(z, lambda z: _let(F.array_max(z), lambda top: F.struct(
            *(g[c].alias(c) for c in ("place", "last", "words")), (F.array_position(z, top).cast("int") - 1).alias("f"),
            F.aggregate(z, F.exp(-top), lambda a, x: a + F.exp(x - top)).alias("norm"),
        )))

    def matched(g: Column) -> Column:
        w = g["words"]
        triples = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(3)), " "))).otherwise(F.array(F.array_join(w, " ")))
        share = _let(F.array_distinct(triples), lambda t: F.array_max(F.transform(F.get(own_triples, g["f"]), lambda one: _let(F.split(one, ";"), lambda o: F.size(F.array_intersect(o, t)) / F.size(o)))))
        named = F.rlike(F.array_join(w, " "), F.get(own_pattern, g["f"]))
        return F.struct(g["place"].alias("place"), g["last"].alias("last"), F.get(F.lit(model.families), g["f"]).alias("family"), (1 / g["norm"]).alias("probability"), F.when(named, share).otherwise(0.0).alias("match"))

    groups = _let(F.transform(F.split(text, "\n"), _word_column), _groups)
    if prefilter:
        groups = F.filter(groups, lambda g: F.rlike(F.array_join(g["words"], " "), F.lit(pattern(some))))
    likely = F.filter(F.transform(groups, judged), lambda g: 1 / g["norm"] >= threshold)
    found = F.filter(F.transform(likely, matched), lambda g: g["match"] >= confirm)
    in_order = F.array_sort(F.transform(found, lambda g: F.struct(g["last"].alias("last"), (g["last"] - g["place"]).alias("more"), *(g[c].alias(c) for c in ("place", "family", "probability", "match")))))
    apart = lambda a, x: F.when(F.coalesce(F.get(a, F.size(a) - 1)["last"], F.lit(-1)) < x["place"], F.concat(a, F.array(x))).otherwise(a)
    kept = _let(in_order, lambda s: F.aggregate(s, F.slice(s, 1, 0), apart))
    if not prefilter:
        return F.coalesce(kept, F.slice(kept, 1, 0))
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = F.lit("|".join(a.replace(" ", "[^a-z0-9]+") for a in anchors() if " " in a))
    held = _let(low, lambda t: F.exists(F.lit([a for a in anchors() if " " not in a]), lambda a: F.contains(t, a)) | F.rlike(t, pairs))
    return F.when(held, kept)


def paragraphs(docs: DataFrame, model: Classifier, threshold: float = THRESHOLD, confirm: float = CONFIRM) -> DataFrame:
    """doc_id, place (from 0), family, probability, match of every confirmed paragraph."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(notices(F.col("text").cast("string"), model, threshold, confirm)).alias("x"))
    return found.select("doc_id", "x.place", "x.family", "x.probability", "x.match")


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_lines: int = SAMPLE_LINES) -> Classifier:
    """A classifier whose other lines are at most ``sample_lines`` lines of ``sample_rows`` texts, both the first by hash."""
    texts = docs.select(F.col("text").cast("string").alias("text")).where(F.length("text") > 0).orderBy(F.xxhash64("text")).limit(sample_rows)
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).where("length(line) between 1 and 2000").distinct().orderBy(F.xxhash64("line"), "line").limit(sample_lines)
    return fit([r.line for r in lines.collect()])


def scan(docs: DataFrame, model: Classifier | None = None, threshold: float = THRESHOLD, confirm: float = CONFIRM, prefilter: bool = True) -> DataFrame:
    """doc_id, n_paragraphs (lines with a word), n_licences (confirmed), families (sorted, comma-joined), probability (the
    least of the confirmed, null without any) for every row."""
    model = model or train(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike("[A-Za-z0-9]")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lines.cast("long").alias("n_paragraphs"), notices(text, model, threshold, confirm, prefilter).alias("x"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("x", lambda n: n["family"]))), ",")
    return rows.select("doc_id", "n_paragraphs", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n_licences"), F.coalesce(names, F.lit("")).alias("families"), F.array_min(F.transform("x", lambda n: n["probability"])).alias("probability"))
