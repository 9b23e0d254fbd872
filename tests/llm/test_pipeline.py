"""The corpus pipeline, stage by stage, on a small table."""

import collections
import hashlib
import random
import re

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from quoin.llm.common import fresh_path


@pytest.fixture(scope="module")
def folder(spark):
    path = fresh_path(spark, "pipeline-test")
    text = "The quick red fox walks over lazy grey dogs while seven other animals watch from behind {} old stone wall"
    shared = "This footer line is found in many documents"
    rows = [
        (1, text.format("an") + "\n" + shared, "en", "a", 0, "x"), (2, text.format("an") + "\n" + shared, "en", "a", 0, "x"), (3, "Completely other words about rivers\n" + shared, "en", "b", 0, "x"),
        (4, None, "en", "b", 0, "x"), (5, "1234 !!", "de", "b", 0, "x"), (6, "Eine ganz andere Sprache steht in diesem Text ohne Wiederholung", "de", "c", 0, "x"),
        (7, "leak: one two three four five six seven eight nine ten eleven", "en", "c", 0, "x"),
    ]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "One two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.schema.names == docs.schema.names
        docs = spark.createDataFrame(out.collect(), out.schema)
        kept.append(sorted(r.doc_id for r in docs.collect()))
    assert kept == [[1, 2, 3, 6, 7], [1, 2, 3, 6, 7], [1, 3, 6, 7], [1, 3, 6]]
    texts = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert "footer" not in texts[1][0] and texts[1][1] == len(texts[1][0]) and "footer" in texts[3][0] and texts[3][1] == 0


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == [1, 3, 6] and all(r.n_tokens > 0 for r in rows)


def test_null_and_repeated_ids_are_decided_by_row(spark, folder):
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
    leak = "leak: one two three four five six seven eight nine ten eleven"
    clean = ["Rivers run slowly past the mill where nobody grinds corn in winter", "Under bright lamps a tailor counts buttons by size and by colour"]
    rows = [(i, t, "en", "a", 0, "x") for i in (None, 5) for t in (*clean, leak, "1234 !!")]
    kept = lambda stage, r: sorted((str(x.doc_id), x.text) for x in stage(spark, spark.createDataFrame(r, schema), folder).collect())
    want = lambda *texts: sorted((i, t) for i in ("None", "5") for t in texts)
    assert kept(corpus_pipeline.language, rows) == want(*clean, leak)
    assert kept(corpus_pipeline.decontamination, rows) == want(*clean, "1234 !!")
    one = [(None, clean[0], "en", "a", 0, "x")] * 3 + [(5, clean[1], "en", "a", 0, "x")] * 2 + [(None, clean[1], "en", "a", 0, "x")]
    assert kept(corpus_pipeline.near_duplicates, one) == sorted([("None", clean[0]), ("5", clean[1])])


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_pipeline(rows, bench):
    """What the stages return, from their contracts, for (id, text) rows."""
    rows = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    least = lambda i: -1 if i is None else i
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            holders[key(x)].add(least(i))
    rows = [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == least(i))) for i, t in rows]

    def fp(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams] if words else [0]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    fps = [fp(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for g, (i, t) in zip(group, rows):
        first.setdefault(g, []).append((i is None, i or 0, t))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {tuple(w[i : i + 10]) for w in map(split, bench) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = lambda t: not any(tuple(w[i : i + n]) in windows for w in [split(t)] for n in sizes for i in range(len(w) - n + 1))
    kept = [{(None if none else i, t) for none, i, t in members if (none, i) == min(m[:2] for m in members) and clean(t)} for members in first.values()]
    return [k for k in kept if k]


def test_run_equals_a_plain_version(spark):
    rnd = random.Random(9)
    vocab = ["river", "stone", "window", "Garden", "paper", "wheel", "candle", "harbor", "mirror", "basket", "ladder", "copper", "é日", "quiet"]
    say = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randint(0, 99)) for _ in range(n))
    bench = [say(14), "Short item here"]
    foot = "This footer line is found in many documents"
    rows = [(i, say(30) + "\n" + say(9)) for i in range(20)]
    rows += [(i, t + "\n" + foot) for i, t in [(20, say(25)), (21, say(25)), (None, say(25)), (22, say(25))]]
    rows += [(30, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (5, rows[5][1]), (5, say(20)), (None, say(20))]
    rows += [(31, say(5) + " " + bench[0] + " " + say(5)), (5, bench[0]), (None, bench[0]), (32, say(8) + "! short ITEM, here")]
    rows += [(33, None), (33, say(12)), (34, ""), (35, "12 %"), (None, None), (36, say(60_000)), (37, foot), (37, foot), (38, "\n".join([foot] * 3))]
    path = fresh_path(spark, "plain")
    spark.createDataFrame([(i, t, "en", 7, "x") for i, t in rows], "doc_id long, text string, lang string, fp long, doomed string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))

    def digest(i, t):
        ids = tok.encode(t, add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    got = [tuple(r) for r in corpus_pipeline.run(spark, path).collect()]
    groups = [{digest(*r) for r in g} for g in brute_pipeline(rows, bench)]
    assert len(got) == len(groups) and all(sum(g in members for g in got) == 1 for members in groups)


def test_empty_tables(spark):
    path = fresh_path(spark, "empty")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
