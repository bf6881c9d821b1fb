"""Clustering (11), importance resampling (12) and chat formatting (13) against brute force, templates of all kinds, and edge cases."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from augur.llm import chat, clustering, resampling
from tests.llm.test_edges import docs, frame, prose  # noqa: F401

# --- importance resampling ---


def runs(text):
    words = [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def resampled(data, target, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) by the definition; equal scores and ids in any order."""
    bucket = lambda run: zlib.crc32(run.encode()) % 10_000
    own, other = {}, {}
    for texts, counts in (([t for _, t in data], own), (target, other)):
        for t in texts:
            for run in runs(t)[1]:
                counts[bucket(run)] = counts.get(bucket(run), 0) + 1
    s, t = sum(own.values()), sum(other.values())
    gain = lambda b: math.floor(1000 * math.log(float(other.get(b, 0) + 1) * float(s + 10_000) / (float(own.get(b, 0) + 1) * float(t + 10_000))))
    out = []
    for doc_id, text in data:
        n, found = runs(text)
        weight = math.floor(Fraction(sum(gain(bucket(r)) for r in found), len(found))) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=str)


def test_resampling(spark, frame):  # noqa: F811
    data = [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]
    target = [data[0][1], "The OF and-to; in it" * 5, None, ""] if data else ["the of"]
    found = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    rows = found.select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, rows), key=str) == resampled(data, target)
    kept = resampling.drawn(frame, found)
    assert kept.columns == frame.columns and kept.count() == sum(r["rank"] is not None for r in rows)
    assert not resampling.resample(frame, spark.createDataFrame([], "text string")).where("n_features = 0 and weight <> 0").count()


def test_copies_are_drawn_one_by_one(spark):
    """A third of the rows is one row again and again: no hot key, and every copy has a rank of its own."""
    data = [(5, prose(random.Random(5), 40))] * 300 + [(i, prose(random.Random(i), 40)) for i in range(100, 700)]
    found = resampling.resample(spark.createDataFrame(data, "doc_id long, text string").repartition(7), spark.createDataFrame([(data[0][1],)], "text string"), percent=50)
    rows = found.collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 451))
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in rows if r["rank"]) == sorted(x for x in resampled(data, [data[0][1]], 50) if x[4])
    plan = found._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan


# --- clustering ---


def lloyd(vectors, k=8, rounds=10):
    """(vec_id, cluster, distance) and centroids, every distance computed in whole numbers."""
    kept = [(i, [math.floor(1024 * float(v)) for v in x]) for i, x in vectors if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [x for _, x in start]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        for j in range(len(centres)):
            members = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if members:
                centres[j] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    return sorted(((i, near(x)[1], near(x)[0]) for i, x in kept), key=str), centres


def mixed(seed, n=160, centres=5, spread=0.2):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(centres, 64))
    return [(i, (middle[i % centres] + spread * draw.normal(size=64)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("case", ["plain", "copies", "few", "empty", "broken"])
def test_clustering(spark, case):
    data = {
        "plain": mixed(1), "copies": [(i % 90, x) for i, x in enumerate([mixed(2)[0][1]] * 60 + [x for _, x in mixed(3, 60)])], "few": mixed(4, 5), "empty": [],
        "broken": [*mixed(5, 40), (900, None), (901, [1.0]), (902, [float("nan")] * 64), (903, [float("inf")] + [0.0] * 63), (904, [None] + [0.0] * 63), (None, [0.5] * 64), (905, [-60_000.25] * 64), (906, [60_000.0] * 64)],
    }[case]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("own"), "x": F.lit(1), "delta": F.lit(2)}).repartition(3)
    found = clustering.cluster(df)
    rows, centres = lloyd(data)
    assert sorted(map(tuple, found.rows.collect()), key=str) == rows and found.centres == centres
    assert found.inertia == [sum(d for _, j, d in rows if j == c) for c in range(len(centres))]


def test_bounds_spare_distances(spark):
    """On vectors with structure most assignments are certified by bounds, and the listed centroids become fewer."""
    data = mixed(6, 600, 12, 0.05)
    found = clustering.cluster(spark.createDataFrame(data, "vec_id long, embedding array<float>"), k=16, n_rounds=12)
    assert found.rescans[0] == 600 * 16 and sum(found.rescans[1:]) < 0.3 * 600 * 16 * len(found.rescans[1:])
    assert found.listed[0] == 4 and found.listed[-1] < found.listed[0]
    rows, centres = lloyd(data, 16, 12)
    assert found.centres == centres and sorted(map(tuple, found.rows.collect()), key=str) == rows


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 4))
def test_steps_are_exact(seed, k, b):
    """Small whole numbers, so ties are frequent: every step agrees with all distances, ties to the smaller number."""
    draw = np.random.default_rng(seed)
    x, centres = draw.integers(-3, 4, (50, 3)), draw.integers(-3, 4, (k, 3))
    at = clustering.Bounds(np.full(50, -1), *[np.zeros(0)] * 4)
    drift = np.zeros(k)
    for _ in range(6):
        at, needed, _ = clustering.step(x, at, centres, drift, b)
        d = clustering.squares(x, centres)
        assert (at.own == d.argmin(1)).all() and (needed <= b).all()
        root = np.sqrt(d)
        assert (at.upper >= root[np.arange(50), at.own]).all()
        for i in range(50):
            named = set(at.listed[i].tolist())
            assert all(low <= root[i, j] for j, low in zip(at.listed[i], at.lower[i], strict=True)) and all(at.rest[i] <= root[i, j] for j in range(k) if j != at.own[i] and j not in named)
        moved = centres + draw.integers(-1, 2, centres.shape) * (draw.random(k) < 0.5)[:, None]
        drift = np.sqrt(((moved - centres) ** 2).sum(1)) * (1 + clustering.SLACK)
        centres = moved


# --- chat formatting ---


class Greeting:
    """Begins with a system turn of its own unless the conversation has one."""

    def render(self, turns):
        own = [] if turns and turns[0][0] == "system" else [("system", "Be brief.")]
        return "".join(f"<{r}>{t}</{r}>" for r, t in [*own, *turns])


class Forgetting:
    """Strips the thoughts of all but the last turn."""

    def render(self, turns):
        return "".join(f"[{r}] {t if i == len(turns) - 1 else re.sub('<think>.*?</think>', '', t)}\n" for i, (r, t) in enumerate(turns))


class Trimming:
    def render(self, turns):
        return "".join(f"{r}: {t.strip()}\n" for r, t in turns)


class Farsighted:
    """Marks every turn by the length of the first one."""

    def render(self, turns):
        return "".join(f"{len(turns[0][1])}/{r}={t};" for r, t in turns)


def pieces_of(template, turns):
    rendering = chat.Rendering(template, frozenset(["assistant"]), {})
    return [rendering.add(r, t) for r, t in turns], rendering


def test_blackbox_templates():
    turns = [("user", "user"), ("assistant", "a<think>b</think>c"), ("user", ""), ("assistant", " assistant ")]
    for template in (Greeting(), chat.Marked(), Farsighted()):
        found, _ = pieces_of(template, turns)
        whole = "".join(p[2] for p in found)
        assert whole == template.render(turns) and not any(p[6] for p in found)
        texts = [chat.Marked().escape(t) if isinstance(template, chat.Marked) else t for _, t in turns]
        if isinstance(template, Farsighted):  # a marking that depends on the text itself can't be probed with another one
            texts[0] = None
        assert [p[4] if p[4] is None else whole[p[4] : p[5]] for p in found] == texts
    found, _ = pieces_of(Greeting(), [("system", "own"), ("user", "x")])
    assert [p[1] for p in found] == [0, 0] and found[0][2] == "<system>own</system>"
    found, _ = pieces_of(Forgetting(), turns)
    assert [p[6] for p in found] == [False, False, True, False] and [p[1] for p in found] == [0, 0, 1, 1]
    assert found[2][2] == Forgetting().render(turns[:3]) and found[1][2][found[1][4] - found[1][3] : found[1][5] - found[1][3]] == turns[1][1]
    found, _ = pieces_of(Trimming(), turns)
    assert [p[4] is None for p in found] == [False, False, False, True]  # the trimmed text can't be read back


def test_prefixes_are_shortened_only_where_it_is_certain():
    turns = [(("user", "assistant")[i % 2], f"turn {i}") for i in range(500)]
    for template, local in ((chat.Marked(), True), (Greeting(), True), (Farsighted(), False)):
        found, rendering = pieces_of(template, turns)
        assert "".join(p[2] for p in found) == template.render(turns) and rendering.local == local
        assert (len(rendering.prefix) < 2 * chat.TURNS) == local


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:b", "", "###", "\\"]), st.text(st.sampled_from(list("\\#</turn> :a\n😀")), max_size=25)), max_size=6))
def test_marked_is_reversible(turns):
    template = chat.Marked()
    written = template.render(turns)
    assert list(template.parse(written)) == turns
    inner = [template.escape(t) for _, t in turns]
    assert all(e[m.start() - 1 : m.start()] == "\\" for e in inner for m in re.finditer("(?=###|</turn>)", e))
    found, _ = pieces_of(template, turns)
    assert "".join(p[2] for p in found) == written and [template.unescape(written[p[4] : p[5]]) for p in found] == [t for _, t in turns]


def digests(data):
    out = {}
    for conv in {d[0] for d in data}:
        turns = [(r or "", t or "") for _, n, r, t in sorted((d for d in data if d[0] == conv), key=lambda d: (d[1] is None, d[1] or 0, d[2] or "", d[3] or ""))]
        learned = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(chat.Marked().render(turns)))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_chat(spark, clash):
    data = [(i, j, ("user", "assistant")[j % 2], f"text {i} {j} \\ ### </turn>" * (j + 1)) for i in range(30) for j in range(i % 7)]
    data += [(None, 0, "user", "a"), (None, None, None, None), (99, 3, "assistant", ""), (99, 3, "assistant", ""), (99, 3, "assistant", None), (99, None, "assistant", "last"), (100, 0, "assistant", "é😀" * 600_000)]
    data += [(200, j, ("user", "assistant")[j % 2], f"long {j}") for j in range(3_000)]  # most rows are one conversation
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(5)
    for c in ("turn_index", "piece", "start", "loss") if clash else ():
        df = df.withColumn(c, F.lit("own"))
    pieces = chat.format_conversations(df)
    for found in (chat.read_back(pieces, ordered=True), chat.read_back(pieces.repartition(3))):
        rows = found.collect()
        assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in rows} == digests(data)
        assert all(r["n_rewrites"] == r["n_opaque"] == 0 and r["n_samples"] == 1 for r in rows) and len(rows) == len(digests(data))
    assert chat.format_conversations(df.limit(0)).count() == 0 and chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_a_rewritten_history_is_learned_once(spark):
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", "<think>x</think>a"), (1, 2, "user", "r"), (1, 3, "assistant", "<think>y</think>b")]
    rows = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), Forgetting()).orderBy("turn_index").collect()
    assert [r["sample"] for r in rows] == [0, 0, 1, 1] and [r["rewrites"] for r in rows] == [False, False, True, False]
    learned = [r["piece"][r["text_start"] - r["start"] : r["text_end"] - r["start"]] for r in rows if r["loss"]]
    assert learned == ["<think>x</think>a", "<think>y</think>b"]


# --- toxicity: short terms, and scores by a plain version ---


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def plain_features(text, terms):
    """exact, fuzzy, quoted and density of a text: every word against every term by a table of edits."""
    from augur.llm import toxicity as tox

    words, exact, fuzzy, told = text.split(), 0, 0, 0
    for at, raw in enumerate(words):
        w = tox.normal(raw)
        whole = [(distance(w, t), False) for t, _ in terms]
        stems = [(min(distance(w[:k], t) for k in range(len(w) + 1)), True) for t, stem in terms if stem]
        reached = [d for (d, _), (t, _) in zip(whole, terms, strict=True) if d <= tox.edits(t)] + [d for (d, _), t in zip(stems, [t for t, stem in terms if stem], strict=True) if d <= tox.edits(t)]
        if not reached:
            continue
        if tox.quoted(words, at):
            told += 1
        elif min(reached):
            fuzzy += 1
        else:
            exact += 1
    return math.log1p(exact), math.log1p(fuzzy), math.log1p(told), 10 * (exact + fuzzy) / (10 + len(words))


def plain_lexicon_counts(texts):
    """(df, tf) of every word over (text, label)."""
    counts = {}
    for text, label in texts:
        for w in {re.sub(r"^[\W_]+|[\W_]+$", "", x) for x in text.lower().split()} - {""}:
            df, tf = counts.get(w, (0, 0))
            counts[w] = df + 1, tf + label
    return counts


def test_short_terms_are_learned_and_scores_are_those_of_a_plain_version(spark):
    from augur.llm import toxicity as tox

    rnd, data, labels = random.Random(17), [], []
    for i in range(400):
        words, toxic = prose(rnd, 30).split(), i % 4 == 0
        for _ in range(2 if toxic else 0):
            words[rnd.randrange(30)] = rnd.choice(["zug", "qx", "blorvath", "blorvathing", '"zug"', "Zug!"])
        if i % 9 == 0:
            words[rnd.randrange(30)] = rnd.choice(["zig", "blorvoth", "blorvat", "zugs"])
        data.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*data, (900, None), (901, "")], "doc_id long, text string")
    model = tox.train(df, spark.createDataFrame(labels, "doc_id long, label int"))
    assert ("zug", False) in model.terms and ("qx", False) in model.terms
    counts = plain_lexicon_counts([(t, y) for (_, t), (_, y) in zip(data, labels, strict=True)])
    assert all(counts[t][1] >= tox.SHARE * counts[t][0] for t, stem in model.terms if not stem)
    found = {r["doc_id"]: r["score"] for r in tox.toxicity_scores(df, model, with_text=False).collect()}
    for doc_id, text in [*data, (900, ""), (901, "")]:
        z = sum(w * f for w, f in zip(model.weights, [*plain_features(text, model.terms), 1.0], strict=True))
        assert found[doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), text


# --- substring dedup: rows without doc_id ---


def test_rows_without_doc_id_are_spread_and_count_as_one(spark):
    """10,000 of them: no part holds more than its share; they lose what a document has, and nothing to each other."""
    import collections

    from augur.llm import substrings
    from tests.llm.test_edges import removed

    rnd = random.Random(23)
    shared, own = prose(rnd, 40), prose(rnd, 30)
    data = [(1, shared), (2, own)]
    data += [(None, f"{prose(rnd, 6)} n{i} {shared if i % 400 == 0 else own if i % 401 == 0 else ''} {prose(rnd, 5)}") for i in range(10_000)] + [(None, f"a {shared} b")] * 3
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    found = collections.Counter(map(tuple, substrings.drop_repeats(df, with_text=False).drop("kept").collect()))
    assert found == removed([(i, t, None) for i, t in data])
    ties = np.array([r[0] for r in df.where("doc_id is null").select(F.xxhash64("text")).collect()])
    batch = substrings.pa.RecordBatch.from_pydict({"doc_id": substrings.pa.array([None] * len(ties), substrings.pa.int64()), "tie": ties})
    parts = np.bincount(substrings.part_of(substrings.ids_of(batch), 50), minlength=50)
    assert parts.max() < 3 * len(ties) / 50
