"""Centroid clustering (11): k-means with Drake's adaptive bounds, exact in whole numbers.

A vector's components are floor(1024 x). With every vector are kept its centroid, an upper bound of the distance to it,
the few centroids that were next nearest with a lower bound each, and one lower bound for all the rest. When centroids
have moved, the bounds move by as much; where the upper bound stays below all lower ones the assignment stands unseen.
Otherwise the distance to the own centroid is computed, then those to the listed centroids, and only where the remainder
bound can't rule out the others, all of them. Distances that decide are squared and exact; bounds are floating-point
numbers widened by SLACK, and a tie is never certified by a bound, so ties go to the smaller number as if every
distance had been computed. The number of listed centroids adapts: it falls to the most that any vector needed.

A round is one pass over the vectors, which writes them with their new bounds to the shared folder; vectors that have
changed their centroid are summed in the same pass into at most k rows of a task (what they leave and what they join).
The driver sees k sums and counts a round and makes the next centroids from them in whole numbers of any size. Nothing
else is collected, no vector is shuffled, and a lost executor costs a part of one round. When no centroid moves, the
remaining rounds couldn't change anything and are left out.

Vectors that are null, of another length, or with null or non-finite components take no part. Repeated rows are vectors
like others. A null vec_id is hashed as an empty name. With fewer vectors than k there are fewer centroids; an empty table
has no result. Components beyond 2**27 (an x of 131,072) are taken as 2**27, so squared distances fit in 63 bits. Extra
columns are ignored.
"""

from __future__ import annotations

import dataclasses
import decimal
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.util import save, table

#: Clusters, rounds, components; what a component is multiplied with, and its largest size.
K, ROUNDS, WIDTH, SCALE, LARGEST = 8, 10, 64, 1024, 1 << 27

#: Listed centroids at first (a share of k, and at least) and at least later; relative widening of bounds; salt of the start.
LISTED_SHARE, LISTED, LISTED_LEAST, SLACK, SALT = 0.25, 3, 2, 1e-9, "3"

#: A row is a vector with its bounds, or what the vectors of one task changed for a centroid: its sums by component and its
#: count (delta), what the task computed (scans) and needed at most, and in the last pass the sum of the distances.
STATE = "vec_id long, x array<int>, cluster int, distance long, upper double, listed array<int>, lower array<double>, rest double, delta array<long>, needed int, scans long, inertia decimal(38,0)"
ARROW = pa.schema([
    ("vec_id", pa.int64()), ("x", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64()), ("upper", pa.float64()), ("listed", pa.list_(pa.int32())), ("lower", pa.list_(pa.float64())),
    ("rest", pa.float64()), ("delta", pa.list_(pa.int64())), ("needed", pa.int32()), ("scans", pa.int64()), ("inertia", pa.decimal128(38, 0)),
])


@dataclasses.dataclass
class Bounds:
    """Of n vectors: own centroid, upper bound to it, listed centroids (n x b) with lower bounds, bound of the rest; -1 in own: none yet."""

    own: np.ndarray
    upper: np.ndarray
    listed: np.ndarray
    lower: np.ndarray
    rest: np.ndarray


def squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centres: in doubles where these hold every sum, else in 64-bit integers."""
    if not len(x):
        return np.zeros((0, len(centres)), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centres).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:
        a, c = x.astype(np.float64), centres.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def pairs(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to the centre beside it."""
    return ((x - centres) ** 2).sum(-1)


def relist(d: np.ndarray, own: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From all squared distances: the b next nearest centroids, their distances, the distance of the nearest other one."""
    other = np.sqrt(d.astype(np.float64))
    other[np.arange(len(d)), own] = np.inf
    order = np.argsort(other, axis=1, kind="stable")
    sorted_ = np.take_along_axis(other, order, axis=1)
    rest = sorted_[:, b] if b < d.shape[1] else np.full(len(d), np.inf)
    return order[:, :b].astype(np.int32), sorted_[:, :b] * (1 - SLACK), rest * (1 - SLACK)


def step(x: np.ndarray, at: Bounds, centres: np.ndarray, drift: np.ndarray, b: int) -> tuple[Bounds, np.ndarray, int]:
    """Bounds after the centroids have moved by drift, how many listed centroids each vector needed, distances computed."""
    n, k = len(x), len(centres)
    b = min(b, k - 1)
    if not n or (at.own < 0).any():  # the first round sees all centroids
        d = squares(x, centres)
        own = d.argmin(1).astype(np.int32) if n else np.zeros(0, np.int32)
        upper = np.sqrt(d[np.arange(n), own].astype(np.float64)) * (1 + SLACK)
        return Bounds(own, upper, *relist(d, own, b)), np.zeros(n, np.int32), n * k
    b = min(b, at.listed.shape[1])
    own, needed, scans = at.own.copy(), np.zeros(n, np.int32), 0
    upper = (at.upper + drift[own]) * (1 + SLACK)
    lower = (at.lower - drift[at.listed]) * (1 - SLACK)
    rest = (at.rest - drift.max(initial=0.0)) * (1 - SLACK)
    listed = at.listed
    if b < listed.shape[1]:  # fewer are listed from now on: the rest bound covers those that leave
        rest = np.minimum(rest, lower[:, b:].min(1))
        listed, lower = listed[:, :b], lower[:, :b]
    listed, lower = listed.copy(), lower.copy()
    nearest_other = lambda rows: np.minimum(lower[rows].min(1, initial=np.inf), rest[rows])
    open_ = np.flatnonzero(~(upper < nearest_other(np.arange(n))))
    if len(open_):  # the distance to the own centroid, exactly
        scans += len(open_)
        upper[open_] = np.sqrt(pairs(x[open_], centres[own[open_]]).astype(np.float64)) * (1 + SLACK)
        open_ = open_[~(upper[open_] < nearest_other(open_))]
    if len(open_):  # own and listed centroids, exactly; the smaller number wins a tie
        scans += len(open_) * b
        some = np.concatenate([own[open_, None], listed[open_]], axis=1)
        d = np.stack([pairs(x[open_], centres[some[:, j]]) for j in range(b + 1)], axis=1)
        order = np.lexsort((some, d))
        some, d = np.take_along_axis(some, order, 1), np.take_along_axis(d, order, 1)
        root = np.sqrt(d.astype(np.float64))
        certain = root[:, 0] * (1 + SLACK) < rest[open_]
        rows = open_[certain]
        needed[rows] = (lower[rows] <= upper[rows, None]).sum(1)
        own[rows], upper[rows] = some[certain, 0], root[certain, 0] * (1 + SLACK)
        listed[rows], lower[rows] = some[certain, 1:], root[certain, 1:] * (1 - SLACK)
        rows = open_[~certain]
        if len(rows):  # the rest can't be ruled out: all centroids
            scans += len(rows) * k
            d = squares(x[rows], centres)
            own[rows] = d.argmin(1)
            upper[rows] = np.sqrt(d[np.arange(len(rows)), own[rows]].astype(np.float64)) * (1 + SLACK)
            listed[rows], lower[rows], rest[rows] = relist(d, own[rows], b)
            needed[rows] = b
    return Bounds(own, upper, listed, lower, rest), needed, scans


def changes(x: np.ndarray, was: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """k rows: by how much the sums of the components, and last the count, of each centroid change."""
    out = np.zeros((k, x.shape[1] + 1), np.int64)
    moved = np.flatnonzero(was != own)
    for at, sign in ((own[moved], 1), (was[moved], -1)):
        for j in np.unique(at[at >= 0]):
            rows = moved[at == j]
            out[j, :-1] += sign * x[rows].sum(0)
            out[j, -1] += sign * len(rows)
    return out


def matrix(column: pa.Array, rows: int, kind: type) -> np.ndarray:
    """A column of equally long lists as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // max(1, rows)).astype(kind)


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1], pa.array(values.reshape(-1), kind))


def rounds(centres: list[list[int]], drift: list[float], b: int, last: bool):  # noqa: ANN201
    """The pass of one round over batches of vectors; last: distances are told in place of bounds."""
    k = len(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_centres, moved = np.array(centres, np.int64).reshape(k, WIDTH), np.array(drift)
        delta, inertia, most, scans = np.zeros((k, WIDTH + 1), np.int64), [0] * k, 0, 0

        def filled(rows: int, **columns: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns.get(f.name), pa.Array) else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in ARROW], schema=ARROW)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column("x"), n, np.int64)
            was = batch.column("cluster").fill_null(-1).to_numpy(zero_copy_only=False)
            at = Bounds(was, *((batch.column("upper").to_numpy(zero_copy_only=False), matrix(batch.column("listed"), n, np.int32), matrix(batch.column("lower"), n, np.float64), batch.column("rest").to_numpy(zero_copy_only=False)) if was[0] >= 0 else [np.zeros(0)] * 4))
            now, needed, computed = step(x, at, at_centres, moved, b)
            scans, most = scans + computed, max(most, int(needed.max(initial=0)))
            if last:
                d = pairs(x, at_centres[now.own])
                for j in np.unique(now.own):
                    inertia[j] += sum(d[now.own == j].tolist())
                yield filled(n, vec_id=batch.column("vec_id"), cluster=now.own, distance=d)
            else:
                delta += changes(x, was, now.own, k)
                yield filled(n, vec_id=batch.column("vec_id"), x=batch.column("x").cast(ARROW.field("x").type), cluster=now.own, upper=now.upper, listed=lists(now.listed, pa.int32()), lower=lists(now.lower, pa.float64()), rest=now.rest)
        yield filled(k, cluster=list(range(k)), delta=lists(delta, pa.int64()), needed=[most] * k, scans=[scans if j == 0 else 0 for j in range(k)], inertia=[decimal.Decimal(v) for v in inertia])

    return run


def whole(vectors: DataFrame) -> DataFrame:
    """The vectors (vec_id, embedding) that take part, as STATE without a centroid."""
    scaled = F.transform("embedding", lambda v: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), v.cast("double") * SCALE))).cast("int"))
    usable = (F.size("embedding") == WIDTH) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long"), scaled.alias("x"))
    empty = [p.split(" ") for p in STATE.replace("decimal(38,0)", "decimal(38|0)").split(", ")[2:]]
    return kept.select("vec_id", "x", *[F.lit(None).cast(kind.replace("|", ",")).alias(name) for name, kind in empty])


def first_centres(state: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors with the smallest hashes of their vec_id; equal ids by their components."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r["x"]) for r in state.select(name.alias("name"), "x").orderBy("name", "x").limit(k).collect()]


@dataclasses.dataclass
class Clusters:
    """rows: vec_id, cluster, distance. By cluster: centre, inertia. rescans: distances computed in each pass."""

    rows: DataFrame
    centres: list[list[int]]
    inertia: list[int]
    rescans: list[int]
    listed: list[int]


def told(state: DataFrame) -> tuple[list[tuple[int, int, int]], int, int]:
    """What a pass changed: (centroid, position, sum), of k * (WIDTH + 1) numbers; the most listed centroids needed; distances computed."""
    tasks = state.where("delta is not null")
    sums = tasks.select("cluster", F.posexplode("delta").alias("at", "value")).groupBy("cluster", "at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    most = tasks.agg(F.max("needed").alias("needed"), F.sum("scans").alias("scans")).first()
    return [(r["cluster"], r["at"], int(r["value"])) for r in sums.collect()], most["needed"] or 0, most["scans"] or 0


def cluster(vectors: DataFrame, k: int = K, n_rounds: int = ROUNDS, salt: str = SALT) -> Clusters:
    """vectors: vec_id, embedding, any others. Edge cases as in the module's docstring."""
    state = whole(vectors.select("vec_id", "embedding"))
    centres = first_centres(state, k, salt)
    k = len(centres)
    if not k:
        return Clusters(state.select("vec_id", "cluster", "distance"), [], [], [], [])
    sums, drift, b, rescans, listed = [[0] * (WIDTH + 1) for _ in range(k)], [0.0] * k, max(LISTED, round(LISTED_SHARE * k)), [], []
    for _ in range(n_rounds):
        state = save(state.where("delta is null").mapInArrow(rounds(centres, drift, b, last=False), STATE), "clusters")
        changed, needed, scans = told(state)
        rescans.append(scans)
        listed.append(min(b, k - 1))
        for j, at, value in changed:
            sums[j][at] += value
        moved = [[s // total[-1] for s in total[:-1]] if total[-1] else centre for total, centre in zip(sums, centres, strict=True)]
        drift = [math.sqrt(sum((p - q) ** 2 for p, q in zip(new, old, strict=True))) * (1 + SLACK) for new, old in zip(moved, centres, strict=True)]
        b = max(LISTED_LEAST, min(b, needed)) if len(listed) > 1 else b
        if moved == centres:
            break
        centres = moved
    state = save(state.where("delta is null").mapInArrow(rounds(centres, drift, b, last=True), STATE).select("vec_id", "cluster", "distance", "delta", "scans", "inertia"), "clustered")
    tasks = state.where("delta is not null").groupBy("cluster").agg(F.sum("inertia").alias("inertia"), F.sum("scans").alias("scans")).collect()
    inertia = [0] * k
    for r in tasks:
        inertia[r["cluster"]] = int(r["inertia"])
    return Clusters(state.where("delta is null").select("vec_id", "cluster", "distance"), centres, inertia, [*rescans, sum(r["scans"] for r in tasks)], listed)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all embeddings after ten rounds. Edge cases as in the module's docstring."""
    found = cluster(table(spark, sf_dir, "embeddings"))
    digest = lambda centre: hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest()
    known = [(j, inertia, sum(found.inertia), digest(centre)) for j, (centre, inertia) in enumerate(zip(found.centres, found.inertia, strict=True))]
    of_cluster = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


_FINITE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NOT NULL AND isfinite(v))) = 64"
_ASSIGN = "SELECT id, arg_min(j, d * 16 + j) AS j, min(d) AS d FROM (SELECT id, j, list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, {centres} c) GROUP BY id"


def _sql() -> str:
    """Every round is two steps of the statement: the nearest centroids, then the floors of the means."""
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({_ASSIGN.format(centres=f'c{r}')})")
        steps.append(
            f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT j, list(f ORDER BY i) AS x FROM (SELECT j, i, floor(sum(v.x[i])::DOUBLE / count(*))::BIGINT AS f FROM a{r} JOIN v USING (id), range(1, 65) t(i) GROUP BY j, i) GROUP BY j) m USING (j))"
        )
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {_FINITE}),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS j, x FROM v QUALIFY j < {K}), {", ".join(steps)}, z AS ({_ASSIGN.format(centres=f"c{ROUNDS}")})
  SELECT vec_id, z.j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY z.j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM z JOIN v USING (id) JOIN c{ROUNDS} c ON c.j = z.j"""


SQL = _sql()
