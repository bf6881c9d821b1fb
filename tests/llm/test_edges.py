"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns: each operator against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from augur.llm import decontamination, jaccard, mixing, neighbours, pii, quality, sharding, substrings, tokens, toxicity

WORDS = "the of and to in is it on as by at from with for that this".split()
CLASHES = ["_place", "_tie", "_n", "size", "name", "score", "shard", "slot", "tie", "component", "_words", "m0", "_text", "bucket", "block", "taken", "_exact", "edits_", "extra__0"]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "s", "ed", "ly", "er"]) for _ in range(n))


def rows(seed=1):
    rnd = random.Random(seed)
    base = [prose(rnd, 60) for _ in range(12)]
    out = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(20, 30):  # near copies
        words = base[i % 4].split()
        words[rnd.randrange(len(words))] = "changed"
        out.append((i, " ".join(words), "s0"))
    out += [(40, base[5], "s1"), (41, base[5], None), (41, base[5], None), (42, None, "s2"), (43, "", "s0"), (None, base[6], "s1"), (None, None, None), (44, " \t\n ", "s0"), (45, prose(rnd, 9000), "s1"), (46, "one", "s0"), (47, "one", "s2"), (48, "x" * 30_000, "s0")]
    return out


def docs(spark, data=None, clash=False):
    df = spark.createDataFrame(rows() if data is None else data, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text").cast("long"))
    for c in CLASHES if clash else ():
        df = df.withColumn(c, F.lit("own"))
    return df


@pytest.fixture(params=["plain", "clashing", "empty"])
def frame(request, spark):
    return docs(spark, [] if request.param == "empty" else None, request.param == "clashing")


def test_tokens(frame):
    rnd = random.Random(3)
    edits = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text")) for a, b, t in ((5, 9, "new  words"), (0, 0, "\n"), (10**6, 10**7, " end"), (3, 400, "x'll"))])
    found = tokens.count_edited(frame.withColumn("edits", edits)).collect()
    encode = tokens.encoding(tokens.VOCABULARY).encode_ordinary
    assert len(found) == frame.count()
    texts = collections.Counter()
    for r in frame.collect():
        t = r["text"] or ""
        before = len(encode(t))
        for a, b, new in ((5, 9, "new  words"), (0, 0, "\n"), (10**6, 10**7, " end"), (3, 400, "x'll")):
            a = min(a, len(t))
            t = t[:a] + new + t[max(a, min(b, len(t))) :]
        texts[r["doc_id"], before, len(encode(t)), t] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_tokens_edited"], r["text_edited"]) for r in found) == texts
    counts = tokens.Counts(open(tokens.VOCABULARY, "rb").read())
    for _ in range(300):
        t = "".join(rnd.choice(["a", "bc", "don't", " ", "  ", "\n", " ", "\x1c", "1", "é", "!", "😀", "'s", "\t"]) for _ in range(rnd.randrange(300)))
        tree = tokens.Tree(t, counts)
        a = rnd.randrange(len(t) + 1)
        tree.edit(a, a + 7, " in ")
        t = t[:a] + " in " + t[a + 7 :]
        assert tree.text() == t and tree.tokens[1] == len(encode(t))
    assert tokens.count_edited(frame.withColumn("edits", F.lit(None).cast(tokens.EDITS))).where("n_tokens <> n_tokens_edited").count() == 0


def labels(spark, frame, word):
    return frame.select("doc_id", F.contains(F.coalesce("text", F.lit("")), F.lit(word)).cast("int").alias("label")).unionByName(spark.createDataFrame([(None, 1), (1, None), (999, 1)], "doc_id long, label int"))


def test_quality(spark, frame):
    found = quality.quality_scores(frame, quality.train(frame, labels(spark, frame, "the")))
    assert found.count() == frame.count() and "text" not in found.columns
    assert found.where("score is null or not score between 0 and 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_quality_learns(spark):
    rnd = random.Random(5)
    data = [(i, prose(rnd, 40) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rnd, 40).split()), "s") for i in range(300)]
    d = docs(spark, data)
    own = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(150)], "doc_id long, label int")
    found = quality.quality_scores(d, quality.train(d, own)).where("doc_id >= 150").collect()
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in found) >= 0.97 * len(found)


def test_toxicity(spark, frame):
    model = toxicity.train(frame, labels(spark, frame, "the"))
    found = toxicity.toxicity_scores(frame, model)
    assert found.count() == frame.count()
    assert found.where("score is null or not score between 0 and 1").count() == 0


def test_toxicity_learns_words_and_meets_misspelt_ones(spark):
    rnd = random.Random(6)
    bad = ["grumblefoot", "snarkle"]

    def text(i):
        words = prose(rnd, 40).split()
        for _ in range(3 if i % 4 == 0 else 0):
            words.insert(rnd.randrange(40), rnd.choice(bad))
        return " ".join(words)

    d = docs(spark, [(i, text(i), "s") for i in range(400)])
    own = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, label int")
    model = toxicity.train(d, own)
    assert {t for t, _ in model.terms} == set(bad)
    probe = docs(spark, [(1, "you are a grumblefoot", "s"), (2, "you grumbl3fot snarkel snarkles", "s"), (3, 'he said "snarkle" as a word', "s"), (4, "all is well with snarks", "s")])
    score = {r["doc_id"]: r["score"] for r in toxicity.toxicity_scores(probe, model).collect()}
    assert score[1] > 0.3 and score[4] < 0.3 and score[3] < score[1]
    match = toxicity.Automaton(model.terms).match
    assert match("snarkle")[1] == 0 and match("snarkl")[1] == 1 and match("snarkkle")[1] == 1 and match("grumblfot")[1] == 2 and match("snark") is None and match("") is None


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_brute_force():
    rnd = random.Random(7)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(n))
    terms = sorted({word(rnd.randrange(3, 11)) for _ in range(25)})
    match = toxicity.Automaton([(t, False) for t in terms]).match
    for _ in range(2000):
        w = word(rnd.randrange(0, 12))
        best = min(levenshtein(w, t) for t in terms if True) if terms else 99
        near = [levenshtein(w, t) for t in terms if levenshtein(w, t) <= toxicity.edits(t)]
        found = match(w)
        assert (found is None) == (not near), (w, best)
        assert found is None or found[1] == min(near)


BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))) or (kind == "card" and not (13 <= len(digits) <= 19 and luhn)) or (kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii(spark, frame):
    found = pii.private_spans(frame).select("doc_id", pii.joined(F.col("_base")).alias("b"), pii.joined(F.col("_spans")).alias("s"))
    assert found.count() == frame.count() and found.where("b <> ''").count() == 0


def test_pii_against_brute_force(spark):
    rnd = random.Random(8)
    data = [(1, "a@b.c%d@e.f x@y x@y.z.w.", None), (2, "1.2.3.4.5.6.7.8 999.1.2.3.4.5 01.002.3.4é1.1.1.1", None), (3, "4539 1488 0343 6467 1 4539-1488-0343-6467 5--5", None), (4, "+1 (766) 555-2373 😀 +123456789- +49 30 1234567", None), (5, "1.1.1.1 " * 1200, None), (6, "a." * 6000 + "@b" + ".c" * 5000, None), (7, "9" * 20_000, None)]
    data += [(100 + i, "".join(rnd.choice("0123456789.+-() @ab") for _ in range(rnd.randrange(150))), None) for i in range(300)]
    found = pii.private_spans(docs(spark, data)).select("doc_id", pii.joined(F.col("_base")).alias("b"), pii.joined(F.col("_spans")).alias("s")).collect()
    expected = {i: base_spans(t) for i, t, _ in data}
    assert {r["doc_id"]: r["b"] for r in found} == expected
    assert all(set(filter(None, r["b"].split(","))) <= set(r["s"].split(",")) for r in found)  # a text without base spans may have others


def test_pii_adds_what_the_base_drops_but_no_invalid_numbers(spark):
    data = [(1, "Des +1 (826) 555-4081 190.137.223.204 du", None), (2, "thinst 2390409500648960 on", None), (3, 'token = "186661156f3f9905942d70850a01cbf23a203f82" x', None), (4, "nothing at all", None)]
    data += [(10 + i, f"call +1 (826) 555-{1000 + i} or me{i}@mail.example.com from 10.1.2.{i}", None) for i in range(60)]
    found = {r["doc_id"]: r["s"] for r in pii.private_spans(docs(spark, data)).select("doc_id", pii.joined(F.col("_spans")).alias("s")).collect()}
    assert found[1] == "ip:22:37,phone:4:21" and found[2] == "" and found[3].startswith("secret:9:49") and found[4] == ""


def test_sharding(frame):
    found = sharding.shard_documents(frame, 7).collect()
    assert len(found) == frame.count()
    by = collections.defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert not found or max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 7


def test_sharding_moves_little(spark):
    keys = docs(spark, [(i, "t", "s") for i in range(4000)])
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard_documents(keys, n).collect()} for n in (10, 11))
    assert sum(a[i] != b[i] for i in a) < 0.45 * len(a)  # a plain modulus would move ten elevenths


def items(spark):
    return spark.createDataFrame([(1, rows()[0][1]), (1, rows()[0][1]), (2, "one"), (3, None), (None, " ".join(rows()[5][1].split()[10:40])), (5, "")], "item_id long, text string")


def leaked(data, tests):
    plain = lambda t: [w for w in (decontamination.EDGES.sub("", w.lower()) for w in (t or "").split()) if w]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out = collections.Counter()
    for doc, text, *_ in data:
        for item, own in set(tests):
            w = plain(own)
            k = min(5, len(w))
            both = grams(w, k) & grams(plain(text), k) if k else set()
            if k and len(both) >= 0.8 * len(grams(w, k)):
                out[doc, item, len(both)] += 1
    return out


def test_decontamination(spark, frame):
    tests = [tuple(r) for r in items(spark).collect()]
    expected = leaked([(r["doc_id"], r["text"]) for r in frame.collect()], tests)
    found = decontamination.leaks(frame, items(spark))
    assert collections.Counter((r["doc_id"], r["item_id"], r["n_shared"]) for r in found.collect()) == expected
    assert decontamination.leaks(frame, items(spark).limit(0)).count() == 0
    kept = decontamination.clean(frame, items(spark))
    assert kept.columns == frame.columns
    dirty = [r for r in frame.collect() if leaked([(r["doc_id"], r["text"])], tests)]
    assert kept.count() == frame.count() - len(dirty)


def test_sketches_never_tell_more_than_what_sets_do_not_share():
    draw = np.random.default_rng(2)
    for n in (4, 60, 127, 129, 900, 5000, 20_000):
        for share in (0.5, 0.8, 0.9, 1.0):
            a = draw.integers(0, 1 << 62, n)
            b = np.concatenate([a[: int(share * n)], draw.integers(0, 1 << 62, int(1.2 * n) - int(share * n))])
            p, q = jaccard.sketch(a), jaccard.sketch(b)
            apart = jaccard.unlike(p, jaccard.folded(q[None], len(p)))[0]
            assert apart <= len(np.setxor1d(a, b))
            assert share > 0.5 or n < 60 or n > 4000 or 9 * apart > len(a) + len(b)


def alike(kind, n, seed=4):
    """n texts of one template that are alike by about 0.6 to 0.7, none of which link."""
    rnd = random.Random(seed)
    words = [f"w{rnd.randrange(10**6)}" for _ in range(240)]
    out = []
    for i in range(n):
        own = list(words)
        if kind == "edits":
            for at in rnd.sample(range(240), 8):
                own[at] = f"e{rnd.randrange(10**6)}"
        elif kind == "slots":  # fields that take one of 40 values
            for at in range(10, 240, 24):
                own[at] = f"v{rnd.randrange(40)}"
        else:  # a passage that all share, and a list of values of their own
            own = words[:180] + [f"v{rnd.randrange(60)}" for _ in range(60)]
        out.append((i, " ".join(own), "s0"))
    return out


@pytest.mark.parametrize("kind", ["edits", "slots", "lists"])
def test_families_that_do_not_link_give_no_square_of_candidates(spark, monkeypatch, kind):
    told = []
    real = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda d, s, pairs, b: told.append(pairs.count()) or real(d, s, pairs, b))
    counts = []
    for n in (200, 400, 800):
        told.clear()
        data = alike(kind, n)
        found = jaccard.near_duplicates(docs(spark, data)).collect()
        links = n * 1.0 - len({r["component_id"] for r in found})
        counts.append(sum(told) / (n + links))
    assert max(counts) <= 40 and counts[2] <= 1.5 * counts[0] + 1, counts


@pytest.mark.parametrize(("meet", "pack"), [(3, 7), (40, 30_000)])
def test_blocks_of_common_shingles_lose_no_link(spark, monkeypatch, meet, pack):
    monkeypatch.setattr(jaccard, "MEET", meet)
    monkeypatch.setattr(jaccard, "PACK_DOCS", pack)
    monkeypatch.setattr(jaccard, "COMMON", 2)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    rnd = random.Random(8)
    data = alike("edits", 60, 9)
    for i in range(60, 90):  # near copies of some of them
        own = data[rnd.randrange(60)][1].split()
        own[rnd.randrange(240)] = f"n{i}"
        data.append((i, " ".join(own), "s0"))
    found = jaccard.near_duplicates(docs(spark, data)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == components(data)


def test_decontamination_misses_no_small_item():
    rnd = random.Random(11)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    own = [words(n + 4) for n in (1,) * 4000 + (2, 3, 4, 5, 6, 7) * 300]  # items of n shingles
    block = decontamination.build([(i, " ".join(w)) for i, w in enumerate(own)])
    cut = [w[:-1] if len(w) >= 9 and i % 4 else w for i, w in enumerate(own)]  # of five to seven shingles one may be missing
    texts = [" ".join(words(20) + w + words(20)).encode() for w in cut]
    found = decontamination.matches(block, decontamination.Hashes(decontamination.plain), texts)
    assert sorted(found) == [(i, i, len(w) - 4) for i, w in enumerate(cut)]


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset({tuple(w)} if w else ())


def components(data):
    sets = [shingles(t) for _, t, *_ in data]
    parent = list(range(len(data)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[top(i)] = top(j)
    low = {}
    for i, (d, *_) in enumerate(data):
        low.setdefault(top(i), []).append(d)
    least = lambda ids: min((d for d in ids if d is not None), default=None)
    return collections.Counter((data[i][0], len(s), least(low[top(i)]) if s else data[i][0]) for i, s in enumerate(sets))


def family(rnd, words, n, most):
    """Near copies of one text, of which some link only through others."""
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rnd.randrange(most + 1)):
            w[rnd.randrange(len(w))] = f"w{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard(frame):
    found = jaccard.near_duplicates(frame).collect()
    data = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == components(data)
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    groups = {c for _, n, c in components(data) if n}
    assert kept.where("text rlike '[^ \\\\t\\\\n]'").count() == len(groups)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_of_families(spark, seed):
    """More than COMMON near copies of one text, short texts around the smallest sizes, and a passage that many texts share."""
    rnd = random.Random(seed)
    passage = prose(rnd, 30)
    texts = family(rnd, [f"b{i}" for i in range(80)], 90, 6) + family(rnd, [f"c{i}" for i in range(30)], 60, 2) + [prose(rnd, rnd.randrange(3, 40)) + " " + passage for _ in range(60)]
    texts += [" ".join(f"{k}{i}" for i in range(n)) + " " + e for k in "de" for n in range(1, 12) for e in ("", "x", "y z")]
    data = [(i, t, "s") for i, t in enumerate(rnd.sample(texts, len(texts)))]
    found = jaccard.near_duplicates(docs(spark, data)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == components(data)


def test_mixing(spark, frame):
    mixed = mixing.mix_documents(frame)
    assert set(mixed.columns) == set(frame.columns)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total, taken = collections.Counter(), collections.Counter()
    for r in frame.collect():
        total[r["source"]] += size(r["text"])
    for r in mixed.collect():
        taken[r["source"]] += size(r["text"])
    everything = sum(total.values())
    assert all(taken[s] <= 3 * n for s, n in total.items())
    assert abs(sum(taken.values()) - everything) <= 3 * mixing.BLOCK * (len(total) + 1)


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert found["a"] == 30 and abs(found["b"] - 1980 * 2 / 5) < 1e-6 and abs(found["c"] - 1980 * 3 / 5) < 1e-6 and found[None] == 0


def nearest(data, top=20):
    good = {i: np.array(v, float) for i, v in data if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % 20 == 0:
            score = sorted(((-float(np.float32(v).astype(float) @ np.float32(w).astype(float)), i) for i, w in good.items() if i != q))
            out[q] = [i for _, i in score[:top]]
    return out


def test_neighbours(spark):
    rnd = np.random.default_rng(9)
    data = [(i, [float(x) for x in rnd.integers(-3, 4, 8)]) for i in range(300)] + [(None, [1.0] * 8), (400, None), (401, [0.0] * 8), (402, [float("nan")] + [1.0] * 7), (403, [None] + [1.0] * 7), (404, [float("inf")] + [1.0] * 7)] + [(500 + i, [2.0] * 8) for i in range(40)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(1))
    expected, got = nearest(data), collections.defaultdict(list)
    for r in sorted(neighbours.search(frame).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append(r["vec_id"])
    assert set(got) == set(expected) and all(len(got[q]) == 20 for q in got)
    assert sum(len(set(got[q]) & set(expected[q])) for q in got) >= 0.9 * sum(map(len, expected.values()))
    few = spark.createDataFrame(data[:6], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in neighbours.search(few).orderBy("rank").collect()] == nearest(data[:6])[0]
    assert neighbours.search(few.limit(0)).count() == 0 and neighbours.search(few.unionByName(few)).count() == 5


def removed(data, span=13):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t, *_ in data]
    least = {}
    key = lambda d: (d is None, d or 0)
    for (d, *_), w in zip(data, words, strict=True):
        for i in range(len(w) - span + 1):
            g = tuple(w[i : i + span])
            least[g] = min(least.get(g, key(d)), key(d))
    out = collections.Counter()
    for (d, *_), w in zip(data, words, strict=True):
        gone = {j for i in range(len(w) - span + 1) if least[tuple(w[i : i + span])] < key(d) for j in range(i, i + span)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[d, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substrings(frame):
    found = substrings.drop_repeats(frame).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed([(r["doc_id"], r["text"]) for r in frame.collect()])


def test_substrings_of_passages_and_runs(spark):
    rnd = random.Random(11)
    passage = prose(rnd, 50)
    data = [(i, prose(rnd, rnd.randrange(30)) + " " + passage + " " + prose(rnd, 5), "s") for i in range(30)]
    data += [(100, "a " * 40, "s"), (101, "a " * 30 + "b", "s"), (102, "a b " * 20, "s"), (103, "b a " * 21, "s"), (104, "a b c " * 15, "s"), (105, "x a b c a b c a b c a b c a b c", "s")]
    found = substrings.drop_repeats(docs(spark, data)).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed(data)


def test_contract_columns(spark):
    """Held-out folds are crc32 of doc_id as text."""
    from augur.llm.queries import QUERIES

    for name, k, rest in (("op2_quality", 3, 1), ("op8_toxicity", 4, 2)):
        found = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        assert found and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % k == rest) for r in found)


@pytest.mark.parametrize("seed", [3, 4])
def test_jaccard_of_small_sets(spark, seed):
    rnd, texts = random.Random(seed), []
    for n in (5, 6, 8, 9, 10, 11, 13, 15, 16, 20, 25, 30, 40, 60):
        for k in range(6):
            base = [f"{n}w{k}x{i}" for i in range(n)]
            texts += [" ".join(w) for w in (base, base[1:], base[:-1], [*base, f"z{rnd.randrange(9)}"], [*base[1:], f"e{rnd.randrange(9)}"], [f"c{rnd.randrange(9)}", *base[1:]])]
    data = [(i, t, "s") for i, t in enumerate(rnd.sample(texts, len(texts)))]
    found = jaccard.near_duplicates(docs(spark, data)).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == components(data)


@pytest.mark.parametrize("deletions", [0, 1, 3, 6])
def test_pigeonhole_with_deletions(monkeypatch, deletions):
    """Of linked sets, what they share weighs more than the slack left to either, for any split into segments."""

    def plan(size, differ):
        d = min(deletions, differ // 2 + 1)
        exact = max(1, differ + 12 - 2 * d)
        return exact, d, exact + 2 * d - differ - 1

    jaccard.bands.cache_clear()
    monkeypatch.setattr(jaccard, "allocation", plan)
    rnd = np.random.default_rng(deletions)
    try:
        for _ in range(300):
            n = int(rnd.integers(5, 120))
            a = rnd.integers(0, 2**63, n).astype(np.uint64)
            gone = int(rnd.integers(0, n // 5 + 1))
            new = int(rnd.integers(0, (n - gone) // 4 + 1)) if gone == 0 else 0
            b = np.concatenate([a[gone:], rnd.integers(0, 2**63, new).astype(np.uint64)])
            assert 100 * (n - gone) >= 80 * (n + new)
            code, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
            entry, owner, weight, left = jaccard.entries_of(doc, code, np.array([len(a), len(b)]))
            own = [{int(e): int(w) for e, o, w in zip(entry, owner, weight, strict=True) if o == k} for k in range(4)]
            best = [(sum(own[i][e] for e in own[i].keys() & own[j].keys()), max(left[i], left[j])) for i in (0, 1) for j in (2, 3) if i + j < 4 + (i == 0)]
            assert any(w > max(slack, 0) for w, slack in best if w), (n, gone, new, best)
    finally:
        jaccard.bands.cache_clear()
