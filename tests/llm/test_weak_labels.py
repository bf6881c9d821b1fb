"""op3's weak supervision: EM against a plain version, decisions that follow the labelers' reliabilities, looser candidates of any length."""

import math
import random

import pytest
from pyspark.sql import functions as F

from augur.llm import pii


def plain_em(rows, rounds=pii.ROUNDS):
    """EM over single candidates, one by one."""
    share, odds = 0.5, [{1: (0.7, 0.2), -1: (0.2, 0.7), 0: (0.1, 0.1)} for _ in range(pii.VOTES)]
    prior = {1: (7, 2), -1: (2, 7), 0: (1, 1)}
    for _ in range(rounds):
        post = []
        for votes in rows:
            yes, no = share, 1 - share
            for j, v in enumerate(votes):
                yes, no = yes * odds[j][v][0], no * odds[j][v][1]
            post.append(yes / (yes + no))
        true = sum(post)
        share = (true + 1) / (len(rows) + 2)
        odds = [{v: ((sum(p for p, r in zip(post, rows) if r[j] == v) + prior[v][0]) / (true + 10), (sum(1 - p for p, r in zip(post, rows) if r[j] == v) + prior[v][1]) / (len(rows) - true + 10)) for v in (1, -1, 0)} for j in range(pii.VOTES)]
    return share, odds


def test_em_against_a_plain_version():
    rnd = random.Random(6)
    rows = []
    for _ in range(400):
        truth = rnd.random() < 0.3
        rows.append(tuple(rnd.choices((1 if truth else -1, -1 if truth else 1, 0), (good, 0.9 - good, 0.1))[0] for good in (0.85, 0.8, 0.75, 0.6, 0.7)))
    counts = {r: rows.count(r) for r in set(rows)}
    share, odds = pii.reliabilities(counts)
    plain_share, plain = plain_em(rows)
    assert share == pytest.approx(plain_share, rel=1e-6)
    for a, b in zip(odds, plain, strict=True):
        assert all(a[v][i] == pytest.approx(b[v][i], rel=1e-6) for v in (1, -1, 0) for i in (0, 1))


def counted(context_is_right):
    """Spans after an opening mark (feature bits 32) and others. The context labeler goes with the others' votes, or against them."""
    for_, against = (1, -1) if context_is_right else (-1, 1)
    return {((1, 1, for_, 1, 1), 32): 200, ((-1, -1, against, -1, -1), 0): 200, ((0, 0, 1, 0, 0), 64): 40, ((0, 0, -1, 0, 0), 128): 40}


def test_decisions_follow_the_reliabilities():
    score = lambda w, f: w[-1] + sum(w[i] for i in range(len(pii.FEATURES)) if f >> i & 1)
    right, wrong = pii.classifier(counted(True)), pii.classifier(counted(False))
    for w in (right, wrong):
        assert score(w, 32) > 0 > score(w, 0)
    # spans on which the context labeler alone votes: the same votes, but its reliability says the opposite
    assert score(right, 64) > 0 > score(wrong, 64)
    assert score(right, 128) < 0 < score(wrong, 128)


@pytest.mark.parametrize(("kind", "text", "span"), [
    ("secret", 'token = "{}"', "a1B2" * 40), ("email", "write to {} now", "x" * 90 + " [at] " + "mail-" * 20 + "s [dot] example [dot] org"), ("ip", "the host {} fell", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"), ("ip", "the server {} fell", "93[.]184[.]216[.]34"),
    ("card", "a card {} of mine", "4111.1111.1111.1111"), ("email", "mail to {} please", "jane at example dot org"),
])
def test_looser_candidates_of_any_length(spark, kind, text, span):
    body = text.replace("{}", span)
    docs = spark.createDataFrame([(1, body), (2, None)], "doc_id long, text string")
    found = {r["doc_id"]: r["_candidates"] for r in pii.candidates(docs).collect()}
    start = body.index(span)
    assert (pii.KINDS.index(kind), start, start + len(span)) in [(c["kind"], c["start"], c["end"]) for c in found[1] if c["loose"]] and found[2] == []


def test_thousands_of_candidates_in_one_text(spark):
    n = 3000
    text = " ".join(f"u{i}@mail.example.org and {'ab12' * 10}" for i in range(n))
    r = pii.private_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("_base").alias("base"), F.size("_spans").alias("all")).first()
    assert (r["base"], r["all"]) == (n, 2 * n) and math.isfinite(n)
