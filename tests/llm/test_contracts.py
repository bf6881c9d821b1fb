"""The queries themselves, over a small folder of tables, against brute force and their contracts."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from augur.llm import mixing
from augur.llm.queries import QUERIES
from tests.llm.test_edges import base_spans, components, leaked, prose, removed, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BAD = ["vile", "loathsome", "wretch"]


def held(doc_id, k, rest):
    return zlib.crc32(str(doc_id).encode()) % k == rest


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with copies, nulls, empties, long texts and personal data; labels by words; a benchmark."""
    folder, rnd = str(tmp_path_factory.mktemp("contracts")), random.Random(12)
    data = [(i, t, s) for i, t, s in rows() if i is not None]
    labels = []
    for i in range(1000, 1400):
        words = prose(rnd, 40).split()
        toxic, poor = i % 3 == 0, i % 2 == 0
        for _ in range(3 if toxic else 0):
            words[rnd.randrange(40)] = rnd.choice(BAD)
        if poor:
            words = [w.upper() + "!!!" for w in words]
        data.append((i, " ".join(words), f"s{i % 5}" if i % 11 else None))
        labels.append((i, int(not poor), int(toxic)))
    data += [(2000, "write a.b@mail.example.org or +1 (415) 555-0100, card 4111 1111 1111 1111 and 10.1.2.3", "s1"), (2001, 'token = "' + "0a1b2c3d" * 5 + '" 300.1.1.1 4111111111111112', "s1")]
    items = [(1, data[0][1]), (2, " ".join(data[1][1].split()[5:25])), (3, prose(rnd, 30)), (4, None)]
    spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long")).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return folder, data, labels, items


@pytest.mark.parametrize(("name", "column", "k", "rest", "cut"), [("op2_quality", "quality", 3, 1, 0.5), ("op8_toxicity", "toxic", 4, 2, 0.3)])
def test_scores(spark, tables, tmp_path, name, column, k, rest, cut):
    folder, data, labels, _ = tables
    found = {r["doc_id"]: r for r in QUERIES[name](spark, folder).collect()}
    assert len(found) == len({d for d, *_ in data})
    assert all(r["held_out"] == held(d, k, rest) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for d, r in found.items())
    truth = {d: (q if column == "quality" else t) for d, q, t in labels}
    asked = [d for d in truth if held(d, k, rest)]
    assert sum(found[d]["predicted"] == truth[d] for d in asked) >= 0.9 * len(asked)
    # labels of held-out rows, languages and sources teach nothing
    other = str(tmp_path)
    spark.read.parquet(f"{folder}/documents.parquet").withColumns({"lang": F.lit("xx"), "source": F.lit("other")}).write.parquet(f"{other}/documents.parquet")
    flipped = [(d, 1 - q if held(d, k, rest) else q, 1 - t if held(d, k, rest) else t) for d, q, t in labels]
    spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.parquet(f"{other}/labels.parquet")
    again = {r["doc_id"]: r["score"] for r in QUERIES[name](spark, other).collect()}
    assert all(again[d] == pytest.approx(r["score"], abs=1e-9) for d, r in found.items())


def test_pii(spark, tables):
    folder, data, *_ = tables
    found = {r["doc_id"]: r for r in QUERIES["op3_pii"](spark, folder).collect()}
    for d in (2000, 2001, 42, 43, 45):
        text = next(t for i, t, _ in data if i == d)
        spans = [s for s in base_spans(text or "").split(",") if s]
        assert [found[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s.startswith(k + ":") for s in spans) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, found[d]["spans"].split(","))) >= set(spans) and found[d]["n_spans"] == len(list(filter(None, found[d]["spans"].split(","))))


def test_sharding(spark, tables):
    folder, data, *_ = tables
    found = QUERIES["op4_sharding"](spark, folder).collect()
    size = lambda t: 16 + len((t or "").encode())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == collections.Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in data)
    slots = collections.defaultdict(list)
    for r in found:
        assert 0 <= r["shard"] <= 39 and r["law"] == "rows"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[i]) for i in range(40)]
    assert max(counts) - min(counts) <= 1


def watered(sizes):
    """Targets by filling: who reaches three times their size stops, the rest is shared again by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, total, capped = {s: i % 3 + 1 for i, s in enumerate(names)}, sum(sizes.values()), {}
    while True:
        left, free = total - sum(capped.values()), [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, tables):
    folder, data, *_ = tables
    found = QUERIES["op7_mixing"](spark, folder).collect()
    words = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for _, t, s in data:
        sizes[s] += words(t)
    source = {d: s for d, _, s in data}
    target = watered(sizes)
    assert collections.Counter((r["doc_id"], r["size"]) for r in found) == collections.Counter((d, words(t)) for d, t, _ in data)
    taken = collections.Counter()
    for r in found:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in sizes)
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, QUERIES["op7_mixing"](spark, folder).collect()))
    # the words that a document's blocks hold, counted one by one
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    placed, sources, slots = mixing.plan(docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie")))
    uses = collections.Counter((r["s"], r["block"]) for r in slots.collect())
    blocks = {r["s"]: (r["blocks"], r["quota"]) for r in sources.collect()}
    per_source = collections.Counter(s for (s, _), n in uses.items() for _ in range(n))
    assert all(per_source[s] == quota for s, (_, quota) in blocks.items())
    for s, (n, quota) in blocks.items():  # a permutation a pass: no block is taken again before all have been
        counts = [uses[s, b] for b in range(n)]
        assert not n or (max(counts) - min(counts) <= 1 and sum(counts) == quota)
    own = collections.Counter()
    for r in placed.collect():
        for w in range(r["_start"], r["_start"] + r["size"]):
            own[r["doc_id"], r["size"]] += uses[r["s"], w // mixing.BLOCK]
    told = collections.Counter()
    for r in found:
        told[r["doc_id"], r["size"]] += r["taken"]
    assert +own == +told


def test_exact_queries(spark, tables):
    folder, data, _, items = tables
    found = QUERIES["op6_jaccard"](spark, folder).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == components(data)
    found = QUERIES["op10_substrings"](spark, folder).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed(data)
    found = QUERIES["op5_decontamination"](spark, folder).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == sorted((x[0], x[1]) for x in leaked(data, [i for i in items if i[1]]))


def test_edited_trees_stay_balanced():
    """op1: large inserts into one place are dealt out over leaves again, without encoding what is known."""
    from augur.llm import tokens

    vocabulary = open(tokens.VOCABULARY, "rb").read()
    encode, rnd = tokens.encoding_of(vocabulary).encode_ordinary, random.Random(2)
    text = prose(rnd, 50)
    tree = tokens.Tree(text, tokens.Counts(vocabulary))
    for n in (20, 4000, 30, 6000, 5):
        at, new = rnd.randrange(len(text)), " " + prose(rnd, n) + " "
        before = tree.encoded
        tree.edit(at, at + 3, new)
        text = text[:at] + new + text[at + 3 :]
        assert tree.text() == text and tree.tokens[1] == len(encode(text)) and max(map(len, tree.leaves)) <= tokens.CROWDED * tokens.LEAF
        assert tree.encoded - before <= len(new) + 5 * tokens.CROWDED * tokens.LEAF * 12
