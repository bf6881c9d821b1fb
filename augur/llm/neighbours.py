"""Approximate nearest neighbours (9): inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample. Every vector gets its nearest centroid's cell and codes of its
residual's subvectors. A query probes the cells with the largest inner products; in them, asymmetric distance tables
(the query against all codewords) give estimates. What the coding has left of a vector tells how far its estimate may
be off: all rows that may be among the best by ERRORS standard errors are reranked exactly on the original vectors, few
where estimates tell rows apart, and a whole crowd of near copies where they don't.

How many cells a query probes is not a constant: CALIBRATION queries are compared with every row exactly, and the
smallest share of the rows is taken whose cells hold CELL_RECALL of their true neighbours. Clustered vectors get a few
cells, vectors without structure a third of all rows.

Cells that lie close together are packed into parts of about PART_ROWS rows, so a query needs few parts where the
vectors have structure; a cell that holds more (a third of all vectors may be copies) is split over several parts. Parts
grow with the table up to MOST_PART_ROWS and queries come in blocks of QUERY_BLOCK, so a task holds one part and one
block at most. A query is sent once to each part that holds cells it probes, and each part gives it its TOP best only.

Vectors that are null, zero or hold null or non-finite components take no part, nor rows without vec_id or of another
length than most. Equal scores go to the smaller vec_id. Of rows that share a vec_id the one with the best score holds
(as queries: any one of them). An empty table has no result. Extra columns are ignored. Vectors of doubles are scored as
doubles, all others as floats; the index itself holds floats.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.llm.util import save, table
from augur.llm.words import grouped

#: Vectors that are fitted at most (a sample by hash); rows of a cell on average, and vectors of the sample for each.
SAMPLE, CELL_ROWS, CELL_SAMPLE = 20_000, 8, 5

#: Queries that calibrate the probing, and the share of their true neighbours that the probed cells are to hold.
CALIBRATION, CELL_RECALL = 200, 0.95

#: Subvectors, codewords of each; standard errors of an estimate that decide what is reranked.
SUBVECTORS, CODEWORDS, ERRORS = 16, 256, 2.0

#: Rows of a part; queries of a block, those that are estimated at once, and pairs that are reranked at once.
PART_ROWS, MOST_PART_ROWS, PARTS, QUERY_BLOCK, AT_ONCE, PAIRS = 4_000, 64_000, 2_000, 200_000, 64, 200_000
TOP, QUERY_STEP, SEED, ROUNDS = 20, 20, 20_269, 8


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    draw = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[draw.permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.add.reduceat(x[np.argsort(own, kind="stable")], (np.cumsum(n) - n)[n > 0], axis=0)
        centres[n > 0] = total / n[n > 0, None]
    return centres


@dataclasses.dataclass
class Index:
    centres: np.ndarray
    codebooks: list[np.ndarray]  # for each subvector
    cuts: np.ndarray  # where subvectors begin

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int) -> Index:
        centres = kmeans(sample, max(1, min(rows // CELL_ROWS, len(sample) // CELL_SAMPLE)), SEED)
        near = nearest(centres, kmeans(centres, max(1, min(len(centres) // 8, PARTS)), SEED + 100))
        centres = centres[np.argsort(near, kind="stable")]  # neighbours get neighbouring numbers, so parts hold what lies close together
        residual = sample - centres[nearest(sample, centres)]
        cuts = np.linspace(0, sample.shape[1], min(SUBVECTORS, sample.shape[1]) + 1).astype(int)
        return cls(centres, [kmeans(residual[:, a:b], CODEWORDS, SEED + 1 + i) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))], cuts)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and the lengths of what these leave of the vectors."""
        cell = nearest(x, self.centres)
        parts = self.parts(x - self.centres[cell])
        codes = [nearest(p, book) for p, book in zip(parts, self.codebooks, strict=True)]
        left = sum((((p - book[code]) ** 2).sum(1) for p, book, code in zip(parts, self.codebooks, codes, strict=True)), np.zeros(len(x), np.float32))
        return cell, np.stack(codes, axis=1).astype(np.uint8), np.sqrt(left).astype(np.float32)

    def estimates(self, queries: np.ndarray, cell: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of queries (rows) with coded vectors (their cells and codes), by the queries' distance tables."""
        own, place = np.unique(cell, return_inverse=True)
        out = np.take(queries @ self.centres[own].T, place, axis=1)
        for p, book, code in zip(self.parts(queries), self.codebooks, codes.T, strict=True):
            out += np.take(p @ book.T, code, axis=1)
        return out


def fewest(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows without those that have `most` equal vectors of smaller ids before them, which no query can want."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    return np.sort(order[np.arange(len(order)) - np.searchsorted(same[order], same[order]) < most])


def matrix(column: pa.ChunkedArray | pa.Array, kind: type = np.float32) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(kind) if len(column) else np.zeros((0, 1), kind)


def exact(x: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with those of queries, in double precision, summed in order of the components."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d].astype(np.float64) * queries[:, d].astype(np.float64)
    return total


def packed(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The first part of each cell, and over how many parts it is split."""
    first, split, at, held = np.zeros(len(rows), int), np.maximum(1, -(-rows // most)), 0, 0
    for c, n in enumerate(rows):
        if held and (held + n > most or split[c] > 1):
            at, held = at + 1, 0
        first[c], held = at, held + n
        if split[c] > 1:
            at, held = at + split[c], 0
    return first, split


def best_of(query: np.ndarray, vec: np.ndarray, score: np.ndarray, top: int) -> pa.Table:
    """The `top` best rows of each query."""
    order = np.lexsort((vec, -score, query))
    query, vec, score = query[order], vec[order], score[order]
    start = np.searchsorted(query, query)
    keep = np.arange(len(query)) - start < top
    return pa.table([query[keep], vec[keep], score[keep]], names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def merged(*found: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]


def needed(coded: DataFrame, index: Broadcast, rows: np.ndarray, top: int) -> float:
    """The share of all rows that the best cells of a query must hold, so that they hold CELL_RECALL of the true neighbours of CALIBRATION queries."""
    asked = coded.orderBy(F.xxhash64(F.lit(SEED + 1), "vec_id"), "vec_id").limit(CALIBRATION).toArrow()
    ids, q = asked.column("vec_id").to_numpy(), matrix(asked.column("embedding"))

    def scan(batches):  # noqa: ANN001, ANN202
        best = merged((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
        for b in batches:
            vec, cell = b.column("vec_id").to_numpy(), b.column("cell").to_numpy()
            score = np.where(vec[None, :] == ids[:, None], -np.inf, q @ matrix(b.column("embedding")).T)
            own = np.argsort(-score, axis=1, kind="stable")[:, :top]
            who = np.repeat(np.arange(len(q)), own.shape[1])
            best = merged(best, (who, cell[own].ravel().astype(np.int64), np.take_along_axis(score, own, 1).ravel()))
            order = np.lexsort((-best[2], best[0]))
            best = [c[order] for c in best]
            keep = (np.arange(len(order)) - np.searchsorted(best[0], best[0]) < top) & (best[2] > -np.inf)
            best = [c[keep] for c in best]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query", "cell", "score"])

    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "cell"))
    true = coded.select("vec_id", "embedding", "cell").mapInArrow(scan, "query long, cell long, score double").withColumn("rank", rank).where(F.col("rank") <= top).select("query", "cell").toArrow()  # CALIBRATION * top rows at most
    if not true.num_rows:
        return 1.0
    order = np.argsort(-(q @ index.value.centres.T), axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1) / rows.sum()
    reached = np.zeros_like(held)
    np.put_along_axis(reached, order, held, axis=1)
    share = reached[true.column("query").to_numpy(), true.column("cell").to_numpy()]
    return float(np.sort(share)[int(np.ceil(CELL_RECALL * len(share))) - 1])


def search(vectors: DataFrame, top: int = TOP, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors (vec_id, embedding) with vec_id divisible by step its nearest."""
    spark = vectors.sparkSession
    element = "double" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "float"
    kind = np.float64 if element == "double" else np.float32
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    vectors = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(f"array<{element}>")).where(F.col("vec_id").isNotNull() & good)
    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    vectors = vectors.where(F.size("embedding") == sizes["d"])
    sample = vectors.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(SAMPLE).toArrow()
    index = spark.sparkContext.broadcast(Index.fit(matrix(sample.column("embedding")), sizes["n"]))

    def encode(batches):  # noqa: ANN001, ANN202
        for b in batches:
            cell, codes, left = index.value.encode(matrix(b.column("embedding")))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("embedding"), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left)], names=["vec_id", "embedding", "cell", "codes", "left"])

    coded = save(vectors.mapInArrow(encode, f"vec_id long, embedding array<{element}>, cell int, codes binary, left float"), "cells")
    counts = {r["cell"]: r["n"] for r in coded.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # SAMPLE / CELL_SAMPLE rows at most
    rows = np.array([counts.get(c, 0) for c in range(len(index.value.centres))])
    first, split = packed(rows, int(np.clip(sizes["n"] // PARTS, PART_ROWS, MOST_PART_ROWS)))
    share = needed(coded, index, rows, top)

    def probe(batches):  # noqa: ANN001, ANN202
        for b in batches:
            q = matrix(b.column("embedding"))
            order = np.argsort(-(q @ index.value.centres.T), axis=1, kind="stable")
            enough = np.cumsum(rows[order], axis=1) >= share * rows.sum()
            probes = np.where(enough.any(1), enough.argmax(1) + 1, len(rows))
            who: list[tuple[int, int, np.ndarray]] = []
            for i in range(len(q)):
                cells = order[i, : probes[i]]
                cells = cells[rows[cells] > 0]
                held = np.repeat(cells, split[cells])  # once for each part of a cell that is split
                part = first[held] + np.arange(len(held)) - np.repeat(np.cumsum(split[cells]) - split[cells], split[cells])
                part, held, start, _ = grouped(part, held)
                who.extend((i, int(part[a]), held[a:b]) for a, b in zip(start, np.append(start[1:], len(part)), strict=False))
            at = pa.array([w[0] for w in who], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("embedding").take(at), pa.array([w[1] for w in who], pa.int32()), pa.array([w[2] for w in who], pa.list_(pa.int32()))], names=["query_id", "embedding", "part", "cells"])

    queries = coded.where(F.col("vec_id") % step == 0).dropDuplicates(["vec_id"]).select("vec_id", "embedding")
    queries = queries.mapInArrow(probe, f"query_id long, embedding array<{element}>, part int, cells array<int>")
    blocks = max(1, -(-sizes["n"] // step // QUERY_BLOCK))
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "query_id"), F.lit(blocks)).cast("int"))
    of = lambda values: F.element_at(F.lit(values.tolist()), F.col("cell") + 1)
    coded = coded.withColumn("part", (of(first) + F.pmod(F.xxhash64("vec_id"), of(split))).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def look(queries: pa.Table, own: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and queries.num_rows:
            ids, x, cell = own.column("vec_id").to_numpy(), matrix(own.column("embedding"), kind), own.column("cell").to_numpy()
            codes = np.frombuffer(b"".join(own.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            few = fewest(x, ids, top + 1)  # the query itself may be one of them
            left = own.column("left").to_numpy()[few]
            ids, x, cell, codes = ids[few], x[few], cell[few], np.ascontiguousarray(codes[few].T).astype(np.intp).T
            asked, q, cells = queries.column("query_id").to_numpy(), matrix(queries.column("embedding"), kind), queries.column("cells").to_pylist()
            held, place = np.unique(cell, return_inverse=True)
            best, off = min(len(ids), top), ERRORS * left / np.sqrt(x.shape[1])
            for i in range(0, len(asked), AT_ONCE):
                some, mine = asked[i : i + AT_ONCE], q[i : i + AT_ONCE]
                probed = np.array([np.isin(held, c, assume_unique=True) for c in cells[i : i + AT_ONCE]])[:, place]
                estimate = np.where(probed & (ids[None, :] != some[:, None]), index.value.estimates(mine.astype(np.float32), cell, codes), -np.inf)
                error = np.sqrt((mine * mine).sum(1))[:, None] * off[None, :]
                least = -np.partition(error - estimate, best - 1, axis=1)[:, best - 1]  # the top-th best of what is sure
                who, near = np.nonzero((estimate + error >= least[:, None]) & (estimate > -np.inf))
                score = np.concatenate([exact(x[near[j : j + PAIRS]], mine[who[j : j + PAIRS]]) for j in range(0, len(who), PAIRS)] or [np.zeros(0)])
                found = best_of(some[who], ids[near], score, top)
                out.append(tuple(c.to_numpy() for c in found.columns))
        return best_of(*merged(*out), top)

    found = queries.groupBy("part", "block").cogroup(coded.groupBy("part", "block")).applyInArrow(look, FOUND)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of each row of embeddings whose vec_id is divisible by 20, over all rows; edge cases as in the module's docstring."""
    return search(table(spark, sf_dir, "embeddings"))
