"""The index of op9 beyond one part: crowds of near copies and equal vectors, doubles, blocks of queries, recall."""

import numpy as np
import pytest

from augur.llm import neighbours


def truth(x, ids, step=20, top=20):
    found = {}
    for i in np.flatnonzero(ids % step == 0):
        score = neighbours.exact(x, np.repeat(x[i : i + 1], len(x), axis=0))
        score[i] = -np.inf
        found[int(ids[i])] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score))[:top]]
    return found


def vectors(kind, n=1500, d=24):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(n, d))
    if kind == "crowd":  # near copies of one vector
        x[: n // 3] = x[0] + 1e-3 * draw.normal(size=(n // 3, d))
    if kind == "equal":
        x[: n // 3] = x[0]
    if kind == "clusters":
        x = x[draw.integers(0, 10, n)] + 0.05 * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("kind", ["plain", "crowd", "equal", "clusters"])
@pytest.mark.parametrize("element", ["float", "double"])
def test_recall(spark, monkeypatch, kind, element):
    monkeypatch.setattr(neighbours, "PART_ROWS", 200)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 30)
    x = vectors(kind).astype(np.float32 if element == "float" else np.float64)
    ids = np.arange(len(x)) * 5
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], f"vec_id long, embedding array<{element}>")
    found, true, hits = {}, truth(x, ids), 0
    for r in neighbours.search(frame).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert found.keys() == true.keys()
    for q, own in true.items():
        got = [found[q][k] for k in sorted(found[q])]
        assert sorted(found[q]) == list(range(1, 21)) and got == sorted(got, key=lambda v: (-v[1], v[0]))
        known = dict(own)
        assert all(known.get(v, s) == s for v, s in got)  # exactly the measure, on the original vectors
        hits += len({v for v, _ in got} & known.keys())
    assert hits >= 0.9 * 20 * len(true)


def test_windows_whose_first_names_collide_are_told_apart(spark, monkeypatch):
    """op10 with 64-bit names that hold two bits only: the second names decide."""
    import collections
    import random

    from augur.llm import substrings
    from tests.llm.test_edges import docs, removed

    real = substrings.window_names
    monkeypatch.setattr(substrings, "window_names", lambda words: (real(words)[0] % np.uint64(4), real(words)[1]))
    rnd = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    data = []
    for i in range(60):
        words = [f"w{rnd.randrange(50)}" for _ in range(120)]
        if i % 3 == 0:
            words[30:30] = passage
        data.append((i, " ".join(words), "s0"))
    found = substrings.drop_repeats(docs(spark, data)).collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == removed(data)
