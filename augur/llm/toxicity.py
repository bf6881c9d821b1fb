"""Toxicity (8): Levenshtein automata intersected with a lexicon trie, and context-window scores.

The lexicon is learned: over a bounded sample of labelled documents, words (and word stems that many such words share)
whose documents are toxic far beyond chance, by a likelihood ratio that holds for as many terms as were tried; copies of
a document are one witness. There is no cap on terms and no least length of one: the bound on labelled documents is the only one. The terms form a trie; running the
Levenshtein automata of all terms against it gives one deterministic automaton, whose states (sets of trie nodes with
the edits spent) are made as texts need them, so a clean word ends after two or three letters. A term of 5 letters may
be met with one edit, of 9 with two.

Each hit is scored by its context window: quotation marks around it or words of attribution before it tell of
quotation, not abuse. A logistic model over the hits of the sample turns both into a score.

Nulls: a null text counts as empty, and an empty text gets the score of a text without hits. Labels that are null, or
whose doc_id is null, teach nothing; of several labels of one document the largest holds. Repeated rows are scored each.
An empty table has no result, and without labels of both classes every document has the smoothed share of the one class.
Very long texts are read word by word, whole. Extra columns are kept.
"""

from __future__ import annotations

import dataclasses
import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.quality import newton
from augur.llm.util import labelled_sample, save, shielded, small_batches, table

#: Labelled documents that are fitted at most (a sample by hash).
MAX_LABELLED = 20_000

#: A term's documents are toxic by this share at least; chance terms that are let through on average, among all that are tried.
SHARE, CHANCE_TERMS = 0.8, 0.05

#: Letters of a stem; words it must have at least.
STEMS, STEM_WORDS = (4, 5, 6, 7, 8), 3

#: Words on either side of a hit that are its context; states of the automaton kept at once.
WINDOW, MAX_STATES = 8, 50_000

#: Marks and words that introduce a quotation; signs written for letters.
QUOTES = "\"“”„«»‹›"
ATTRIBUTION = frozenset("said says say called calls quote quoted quoting wrote writes term word slur dit écrit cité sagte schrieb zitat dijo escribió citó".split())
LEET = str.maketrans("013457@$", "oieastas")

EDGES = re.compile(r"^[\W_]+|[\W_]+$")
THRESHOLD, PENALTY = 0.3, 0.1

#: Rows that a task gives back at once.
SLICE = 128
FEATURES = ("exact", "fuzzy", "quoted", "density")


def chance_ratio(tried: int) -> float:
    """The likelihood ratio (G squared, chi-square with one degree of freedom) that CHANCE_TERMS of `tried` terms pass by chance: x with erfc(sqrt(x / 2)) = CHANCE_TERMS / tried."""
    low, high = 0.0, 400.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > CHANCE_TERMS / max(1, tried) else (low, mid)
    return high


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


def normal(word: str) -> str:
    return word.lower() if word.isalpha() else EDGES.sub("", word.lower()).translate(LEET)


class Automaton:
    """terms: (term, is it a stem?). match(word): (index of the nearest term, edits), or None."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.most = [0]  # edits that any term below allows
        for i, (term, _) in enumerate(terms):
            node = 0
            self.most[0] = max(self.most[0], edits(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits(term))
            if self.ends[node] is None:
                self.ends[node] = i
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.whole: list[tuple[int, int] | None] = []  # the term if the word ends here
        self.stem: list[tuple[int, int] | None] = []  # the stem that has been met here
        self.start = self.state({0: 0})

    def state(self, reached: dict[int, int]) -> int:
        """The number of a set of nodes with the edits spent, after leaving letters out; -1 if it is empty."""
        work = list(reached)
        while work:
            node = work.pop()
            spent = reached[node] + 1
            for child in self.children[node].values():
                if spent <= self.most[child] and spent < reached.get(child, 99):
                    reached[child] = spent
                    work.append(child)
        if not reached:
            return -1
        key = frozenset(reached.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(reached)
            self.moves.append({})
            ends = [(e, self.ends[n]) for n, e in reached.items() if self.ends[n] is not None and e <= edits(self.terms[self.ends[n]][0])]
            best, stem = min(ends, default=None), min([x for x in ends if self.terms[x[1]][1]], default=None)
            self.whole.append(best and (best[1], best[0]))
            self.stem.append(stem and (stem[1], stem[0]))
        return self.ids[key]

    def step(self, at: int, c: str) -> int:
        reached: dict[int, int] = {}

        def reach(node: int, spent: int) -> None:
            if spent <= self.most[node] and spent < reached.get(node, 99):
                reached[node] = spent

        for node, spent in self.sets[at].items():
            reach(node, spent + 1)
            for letter, child in self.children[node].items():
                reach(child, spent + (letter != c))
        to = self.moves[at][c] = self.state(reached)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > MAX_STATES:
            self.reset()
        at, stem, moves = self.start, None, self.moves
        for c in word:
            to = moves[at].get(c)
            at = self.step(at, c) if to is None else to
            if at < 0:
                return stem
            found = self.stem[at]
            if found is not None and (stem is None or found[1] < stem[1]):
                stem = found
        whole = self.whole[at]
        return whole if stem is None or (whole is not None and whole[1] <= stem[1]) else stem


def quoted(words: list[str], at: int) -> bool:
    """Whether the hit at this place stands in quotation marks, or a word of attribution introduces it."""
    before, after = " ".join(words[max(0, at - WINDOW) : at]), " ".join(words[at + 1 : at + 1 + WINDOW])
    own = words[at]
    opens = any(q in before or own.startswith(q) for q in QUOTES)
    closes = any(q in after or own.rstrip(".,;:!?").endswith(q) for q in QUOTES)
    return opens and closes or any(normal(w) in ATTRIBUTION for w in words[max(0, at - WINDOW) : at])


def text_features(text: str, automaton: Automaton, known: dict) -> tuple[float, float, float, float]:
    words = text.split()
    hits = {}
    for w in set(words):
        found = known.get(w, 0)
        if found == 0:
            found = automaton.match(normal(w))
            if found is not None:
                known[w] = found  # only hits are kept: they are few
        if found is not None:
            hits[w] = found
    exact = fuzzy = told = 0
    for at, w in enumerate(words) if hits else ():
        if w in hits:
            if quoted(words, at):
                told += 1
            elif hits[w][1]:
                fuzzy += 1
            else:
                exact += 1
    return float(np.log1p(exact)), float(np.log1p(fuzzy)), float(np.log1p(told)), 10 * (exact + fuzzy) / (10 + len(words))


def features(docs: DataFrame, terms: list[tuple[str, bool]], with_text: bool = False) -> DataFrame:
    """docs (text, any others) with exact, fuzzy, quoted and density; without text, unless with_text. The terms are those of at most MAX_LABELLED documents."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    names = [c for c in docs.columns if with_text or c != "text"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = Automaton(shared.value), {}
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            if len(known) > MAX_STATES:
                known.clear()
            found = np.array([text_features(t.as_py() or "", automaton, known) for t in batch.column("text")], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(found[:, i]) for i in range(len(FEATURES))]], names=[*names, *[f"_{f}" for f in FEATURES]])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], *[f"_{f} double" for f in FEATURES]])
    return docs.mapInArrow(find, schema)


def witnesses(texts: DataFrame, stems: set[str], words: set[str]) -> DataFrame:
    """(term, stem, df, tf): in how many ways a term is met, by the two words before it, so that copies of a text count once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple[str, bool, str, int]] = set()
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                last = before = ""
                for raw in text.split():
                    w = raw.lower() if raw.isalpha() else EDGES.sub("", raw.lower())
                    if w in words:
                        out.add((w, False, before, label))
                    out.update((w[:k], True, before, label) for k in STEMS if w[:k] in stems and len(w) > k)
                    last, before = w, f"{last} {w}"
            cols = list(zip(*sorted(out), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.string(), pa.int64()), strict=True)], names=["term", "stem", "before", "label"])

    met = texts.select("text", F.col("label").cast("long")).mapInArrow(find, "term string, stem boolean, before string, label long")
    return met.groupBy("term", "stem", "before").agg(F.avg("label").alias("share")).groupBy("term", "stem").agg(F.count("*").alias("df"), F.sum("share").alias("tf"))


def lexicon(texts: DataFrame) -> list[tuple[str, bool]]:
    """Terms of the labelled texts (text, label), stems first. All of them come from at most MAX_LABELLED documents."""
    rows = texts.agg(F.count("*").alias("n"), F.sum("label").alias("t")).first()
    n, toxic = rows["n"] or 0, rows["t"] or 0
    if not 0 < toxic < n:
        return []
    word = F.regexp_replace(F.col("w"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    counts = save(
        texts.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"))).alias("w"))
        .groupBy(word.alias("term")).agg(F.count("*").alias("df"), F.sum("label").alias("tf")).where("term <> ''"),
        "counts",
    )
    chance = chance_ratio(counts.count())

    def strong(c: DataFrame) -> DataFrame:
        base = toxic / n
        part = lambda k, of, p: F.when(k > 0, k * F.log(k / (of * p))).otherwise(0.0)
        g = 2 * (part(F.col("tf"), F.col("df"), base) + part(F.col("df") - F.col("tf"), F.col("df"), 1 - base))
        return c.withColumn("g", g).where((F.col("tf") >= SHARE * F.col("df")) & (F.col("g") >= chance))

    stems = (
        counts.where(F.length("term") > min(STEMS)).withColumn("stem", F.explode(F.array(*[F.when(F.length("term") > k, F.substring("term", 1, k)) for k in STEMS]))).where("stem is not null")
        .groupBy(F.col("stem").alias("term")).agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.count("*").alias("words"), F.max("tf").alias("largest"))
        .where((F.col("words") >= STEM_WORDS) & (F.col("largest") * 2 <= F.col("tf"))).drop("words", "largest")
    )
    likely = [{r["term"] for r in strong(c).select("term").collect()} for c in (stems, counts)]  # of the labelled sample
    witnessed = strong(witnesses(texts, *likely)).orderBy(F.desc("g"), "term").collect()
    best = {r["term"]: r["tf"] for r in witnessed if r["stem"]}
    found: list[tuple[str, bool]] = []
    for stem in sorted(best, key=lambda t: (-len(t), t)):  # a longer stem goes before a shorter one of which it has nearly all
        if not any(t.startswith(stem) and best[t] >= 0.95 * best[stem] for t, _ in found):
            found.append((stem, True))
    found = [(t, True) for t, _ in found if not any(t != o and t.startswith(o) for o, _ in found)]
    for r in witnessed:
        if not r["stem"] and not any(stem and r["term"].startswith(t) for t, stem in found):
            found.append((r["term"], False))
    return found


@dataclasses.dataclass
class Model:
    terms: list[tuple[str, bool]]
    weights: list[float]  # of the features, then the intercept


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, label. Fits at most MAX_LABELLED documents."""
    sample = save(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(labelled_sample(labels, MAX_LABELLED)), "doc_id"), "labelled")
    terms = lexicon(sample)
    rows = np.array(sorted(tuple(r) for r in features(sample, terms).select("doc_id", "label", *[f"_{f}" for f in FEATURES]).collect()), dtype=float).reshape(-1, 2 + len(FEATURES))
    y = rows[:, 1]
    prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not 0 < y.sum() < len(y):
        return Model(terms, [0.0] * len(FEATURES) + [prior])
    return Model(terms, newton(np.concatenate([rows[:, 2:], np.ones((len(y), 1))], axis=1), y, PENALTY).tolist())


@shielded("text")
def toxicity_scores(docs: DataFrame, model: Model, with_text: bool = True) -> DataFrame:
    """docs (without text, unless with_text) with score and predicted (1 from THRESHOLD on). A doc's text is never shuffled."""
    found = features(docs, model.terms, with_text)
    total = functools.reduce(lambda a, b: a + b, [F.col(f"_{f}") * w for f, w in zip(FEATURES, model.weights, strict=False)], F.lit(model.weights[-1]))
    scored = found.withColumn("score", 1 / (1 + F.exp(-total))).drop(*[f"_{f}" for f in FEATURES])
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


@shielded("text")
def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (text, any others) that don't score as toxic, as they are."""
    return toxicity_scores(docs, model).where("predicted = 0").select(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text; labels are learned but from rows whose crc32 of doc_id mod 4 is not 2. Edge cases as in the module's docstring."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    quarter = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    model = train(docs, labels.where(quarter != 2).select("doc_id", F.col("toxic").alias("label")))
    return toxicity_scores(docs, model, with_text=False).select("doc_id", F.coalesce(quarter == 2, F.lit(False)).alias("held_out"), "score", "predicted")
