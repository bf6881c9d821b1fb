"""The pipeline's stages against brute force on a small corpus, and on odd tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_edges import CLASHES, components, docs, family, leaked, prose, rows

BAD = ["grumblefoot", "snarkle"]


def corpus():
    rnd = random.Random(12)
    out = [(i, prose(rnd, 40 + i % 30), f"s{i % 4}") for i in range(160)]
    for i in range(0, 160, 5):  # a fifth is toxic
        words = out[i][1].split()
        for _ in range(3):
            words.insert(rnd.randrange(len(words)), rnd.choice(BAD))
        out[i] = (i, " ".join(words), out[i][2])
    out += [(200 + i, t, "s1") for i, t in enumerate(family(rnd, out[1][1].split(), 20, 1))]
    tests = [(1, prose(rnd, 30)), (2, prose(rnd, 25))]
    out += [(300 + i, prose(rnd, 20) + " " + tests[i % 2][1] + " " + prose(rnd, 200), "s2") for i in range(6)]
    return out, tests


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    data, tests = corpus()
    path = str(tmp_path_factory.mktemp("corpus"))
    docs(spark, data).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(any(b in t for b in BAD))) for d, t, _ in data], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(tests, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_decisions(spark, folder):
    data, tests = corpus()
    stages = dict(corpus_pipeline.STAGES)
    names = list(stages)
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    columns = kept.columns
    expected = {d: t for d, t, _ in data if not any(b in t for b in BAD)}
    kept = stages[names[0]](spark, kept, folder)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == set(expected)
    groups = {}
    for d, _, c in components([(d, t) for d, t in expected.items()]):
        groups.setdefault(c, d)
    kept = stages[names[1]](spark, kept, folder)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == set(groups)
    clean = {d for d in groups if not leaked([(d, expected[d])], tests)}
    kept = stages[names[2]](spark, kept, folder)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == clean and len(groups) - len(clean) == 6
    mixed = stages[names[3]](spark, kept, folder)
    assert mixed.columns == columns
    words = {d: expected[d].split() for d in clean}
    for r in mixed.collect():
        at, own = 0, words[r["doc_id"]]
        for w in r["text"].split():  # its words, in order
            at = own.index(w, at) + 1
    last = stages[names[4]](spark, mixed, folder)
    assert last.count() == mixed.count() and {"shard", "slot"} <= set(last.columns)


def test_run(spark, folder):
    found = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    key = lambda d: sorted((r["doc_id"], r["text"], r["shard"], r["slot"]) for r in d.collect())
    assert len(corpus_pipeline.STAGES) == 5 and found.count() > 0 and [k[:3] for k in key(found)] == [k[:3] for k in key(again)]


@pytest.mark.parametrize("kind", ["plain", "clashing", "empty"])
@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_odd_tables(spark, folder, stage, kind):
    frame = docs(spark, [] if kind == "empty" else rows(), kind == "clashing")
    found = dict(corpus_pipeline.STAGES)[stage](spark, frame, folder)
    assert set(found.columns) >= set(frame.columns) - {"shard", "slot"} and len(set(found.columns)) == len(found.columns)
    n = found.count()
    assert n == 0 if kind == "empty" else n > 0
    if kind == "clashing":
        assert found.where(F.coalesce(*[F.col(f"`{c}`") for c in CLASHES if c not in ("shard", "slot")]) != "own").count() == 0
