"""Benchmark decontamination (5): size-partitioned MinHash containment search, verified by exact shingle containment.

Words are lower-cased and lose signs at their edges; a set is the distinct 5-word shingles. Test items are partitioned
by set size, each partition [u / 2, u). For each partition a document is cut into windows of 2 * u shingles, every u,
so a passage as long as an item lies in one window, and a containment of 0.8 is a Jaccard similarity of 0.19 or more
with that window. A window and an item are candidates if one of FUNCTIONS minima agrees: that misses a leak of exactly
0.8 with a chance of 1e-6, and a whole item with less. Candidates are verified with the shingles of the whole document.

Test items come in blocks of bounded size: each block's sets are broadcast and all documents pass it, with no shuffle
at all. Items of fewer than five words count as one shingle of all their words, and are looked up directly. So are sets
of fewer than SMALLEST shingles, which windows would dilute: of n shingles a leak lacks n - needed(n) at most, so any
n - needed(n) + 1 of them hold one that it has, and no leak is missed.

Nulls: a null text has no words; documents and items without words match nothing. Repeated document rows each give
their rows; repeated (item_id, text) rows count once. Extra columns are ignored by leaks() and kept by clean().
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.util import shielded, small_batches, table
from augur.llm.words import Hashes, U, chunks, mix, multipliers, shingle_hashes

SHINGLE, CONTAINED, FUNCTIONS, SMALLEST = 5, 0.8, 64, 8

#: Test items, and bytes of their texts, that are broadcast at once.
BLOCK_ITEMS, BLOCK_BYTES = 50_000, 16 << 20

EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def plain(word: bytes) -> bytes:
    return EDGES.sub("", word.decode("utf-8", "replace").lower()).encode()


def words_of(known: Hashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normalised words of the texts, and how many each has; words of signs alone are no words."""
    words, counts = known.of(texts)
    real = words != 0
    owner = np.repeat(np.arange(len(texts)), counts)[real]
    return words[real], np.bincount(owner, minlength=len(texts))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all k consecutive words of one text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    code = shingle_hashes(words, k, 40 + k)
    inside = owner[: len(code)] == owner[k - 1 :] if len(code) else np.zeros(0, bool)
    return code[inside], owner[: len(code)][inside]


MULTIPLIERS = multipliers(2 * FUNCTIONS, 50)


def functions(code: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash function, of values that are well mixed already."""
    return (code ^ MULTIPLIERS[2 * i]) * MULTIPLIERS[2 * i + 1]


@dataclasses.dataclass
class Partition:
    """Items of set sizes below `below`: for each function the sorted minima and their items."""

    below: int
    minima: list[np.ndarray]
    items: list[np.ndarray]


@dataclasses.dataclass
class Block:
    ids: list[int | None]
    sets: list[np.ndarray]
    partitions: list[Partition]
    short: dict[int, dict[int, list[int]]]  # words of an item -> its hash -> items
    few: dict[int, list[int]]  # shingles that are looked up -> items of small sets


def needed(n: int) -> int:
    """Shingles of n that a leak has at least."""
    return math.ceil(CONTAINED * n)


def build(rows: list[tuple[int | None, str | None]]) -> Block:
    block = Block([r[0] for r in rows], [], [], {}, {})
    known = Hashes(plain)
    by_band: dict[int, list[int]] = {}
    for i, (_, text) in enumerate(rows):
        words, counts = words_of(known, [(text or "").encode()])
        n = len(words)
        code = np.unique(shingles(words, counts, min(n, SHINGLE))[0]) if n else np.zeros(0, U)
        block.sets.append(code)
        if 0 < n < SHINGLE:
            block.short.setdefault(n, {}).setdefault(int(code[0]), []).append(i)
        elif 0 < len(code) < SMALLEST:
            for c in code[: len(code) - needed(len(code)) + 1]:
                block.few.setdefault(int(c), []).append(i)
        elif n:
            by_band.setdefault(1 << int(len(code)).bit_length(), []).append(i)
    for below, items in sorted(by_band.items()):
        part = Partition(below, [], [])
        for f in range(FUNCTIONS):
            low = np.array([functions(block.sets[i], f).min() for i in items], U)
            order = np.argsort(low)
            part.minima.append(low[order])
            part.items.append(np.array(items)[order])
        block.partitions.append(part)
    return block


def candidates(partitions: list[Partition], code: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
    """(text, item) that agree in a minimum of one window. code, owner: the shingles of some texts, in order."""
    if not len(code):
        return set()
    first = np.concatenate(([True], owner[1:] != owner[:-1]))
    place = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
    cuts = [np.flatnonzero(first | (place % p.below == 0)) for p in partitions]  # stretches of `below` shingles; two make a window
    same = [np.append(owner[c][1:] == owner[c][:-1], False) for c in cuts]
    found = set()
    for f in range(FUNCTIONS):
        value = functions(code, f)
        for part, start, whole in zip(partitions, cuts, same, strict=True):
            low = np.minimum.reduceat(value, start)
            low = np.where(whole, np.minimum(low, np.append(low[1:], low[-1:])), low)
            minima = part.minima[f]
            a = np.searchsorted(minima, low)
            hit = np.flatnonzero(minima[np.minimum(a, len(minima) - 1)] == low)
            for w, i, j in zip(hit, a[hit], np.searchsorted(minima, low[hit], "right"), strict=True):
                found.update((int(owner[start[w]]), int(x)) for x in part.items[f][i:j])
    return found


def matches(block: Block, known: Hashes, texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(text, item, shared shingles) of the leaks, sorted."""
    words, counts = words_of(known, texts)
    code, owner = shingles(words, counts, SHINGLE)
    pairs = candidates(block.partitions, code, owner)
    hit = np.isin(code, np.array(list(block.few), U))
    pairs.update((int(o), i) for c, o in zip(code[hit], owner[hit], strict=True) for i in block.few[int(c)])
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    out, own, at = [], np.zeros(0, U), -1
    for text, item in sorted(pairs):
        if text != at:
            own, at = code[bounds[text] : bounds[text + 1]], text
        shared = int(np.isin(block.sets[item], own).sum())
        if shared >= CONTAINED * len(block.sets[item]):
            out.append((text, item, shared))
    for n, items in block.short.items():
        code, owner = shingles(words, counts, n)
        hit = np.isin(code, np.array(list(items), U))
        out.extend(sorted({(int(o), i, 1) for c, o in zip(code[hit], owner[hit], strict=True) for i in items[int(c)]}))
    return out


def blocks(items: DataFrame) -> Iterator[Block]:
    """The test items (item_id, text), a block of bounded size at a time."""
    items = items.select("item_id", "text").distinct()
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    count = max(1, -(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    for b in range(count):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b).collect()
        yield build(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))


def bytes_of_text(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.withColumn("text", F.col("text").cast("binary"))


LEAKS = "doc_id long, item_id long, n_shared long, n_item long, containment double"


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of every document row and item with a containment of CONTAINED or more."""
    docs = bytes_of_text(docs.select(F.col("doc_id").cast("long"), "text"))
    out = docs.sparkSession.createDataFrame([], LEAKS)
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, block = Hashes(plain), shared.value
            for piece, texts in chunks(batches):
                ids = piece.column("doc_id").to_pylist()
                found = [(ids[t], block.ids[i], s, len(block.sets[i]), s / len(block.sets[i])) for t, i, s in matches(block, known, texts)]
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], k) for c, k in enumerate(kinds)], names=["doc_id", "item_id", "n_shared", "n_item", "containment"])

        out = out.unionByName(docs.mapInArrow(find, LEAKS))
    return out


@shielded("text")
def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (text, any others) without the rows that hold a test item."""
    for block in blocks(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Hashes(plain)
            for piece, texts in chunks(batches):
                dirty = {t for t, _, _ in matches(shared.value, known, texts)}
                yield piece.filter(pa.array([t not in dirty for t in range(len(texts))]))

        plan = bytes_of_text(docs)
        docs = plan.mapInArrow(keep, plan.schema).withColumn("text", F.col("text").cast("string"))
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and test item of which it holds 0.8 of the shingles or more, over whole texts. Edge cases as in the module's docstring."""
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
