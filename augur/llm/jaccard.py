"""N-gram Jaccard join (6): universe-partition pigeonhole.

A document's set is its distinct 5-word shingles, each hashed to 64 bits, as is the set itself: equal sets are one node.
Sets that link, 100 * |A & B| >= 80 * |A | B|, have sizes in one band or in neighbouring ones, and differ in at most
H = a quarter of the band's largest size. A band's allocation cuts the universe of shingles into segments by hash. An
exact segment (weight 1) is indexed by its subset; one with deletions (weight 2) also by its one-deletion neighbourhood,
so it finds a difference of one. The weights add up to H + slack + 1, so a linked pair agrees in segments of weight
slack + 1 at least. The split that costs least in entries and chance matches is taken.

The slack makes the count of what two sets share a filter: linked sets share entries that weigh more than the slack
that empty segments leave to either. Entries of up to COMMON members give their pairs, counted over all entries; a
common entry gives a star, its members against the most central one. What half a set's slack can't cover of common
entries that still join several components makes it an over set: those are compared by prefixes (of a linked pair, the
rarest fifth of the shingles share one), and their candidates must pass bounds on what they can share, by parity sketches
of one to two bits a shingle. So neither copies by the thousand nor families that are alike but don't link are a square
of pairs. Every candidate is verified with the shingles of its whole texts.
"""

from __future__ import annotations

import collections
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.llm.components import connected
from augur.llm.util import save, shielded, small_batches, table
from augur.llm.words import Hashes, U, by_part, chunks, long, mix, shingle_hashes, short

SHINGLE, SMALLEST, COMMON, PIVOTS = 5, 4, 24, 8

#: Bits of a sketch, by the set's size; members of a common shingle that meet in one task.
LEAST_BITS, MOST_BITS, MEET = 256, 8192, 2_000

#: Tasks over which the rows of one set or component are spread.
SPREAD = 16

#: For the allocation: share of the sets that hold a common shingle, and what a chance match costs, in entries.
RARE, COMPARED = 0.2, 20

#: Bytes of text that a bucket of entries or of comparisons stands for; entries and documents that a task packs at once.
BUCKET_BYTES, PACK_ENTRIES, PACK_DOCS = 12 << 20, 2_000_000, 30_000


@functools.cache
def bands(up_to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest sizes of the bands, and (exact segments, segments with deletions, slack) of each."""
    low, high, plans = [], [], []
    at = SMALLEST
    while not low or at <= up_to:
        low.append(at)
        high.append(at * 8 // 5)
        plans.append(allocation(at, high[-1] // 4))
        at = high[-1] + 1
    return np.array(low), np.array(high), np.array(plans)


def allocation(size: int, differ: int) -> tuple[int, int, int]:
    """The split that costs least: an entry costs 1, and what chance matches of its few shingles cost in comparisons."""
    best = None
    for deletions in range(min(differ + 1, 8) + 1):
        slack = 0 if deletions == 1 and differ < 2 else 2
        for _ in range(8):
            exact = max(0, differ + slack + 1 - 2 * deletions)
            parts = exact + deletions
            if not parts:
                break
            tokens = size / parts
            none = math.exp(-tokens) if parts > 1 else 0.0  # one segment holds all
            unsure = none * (1 + tokens + tokens * tokens / 2)
            skipped = exact * none + 2 * deletions * unsure
            slack = min(math.ceil(skipped + 3 * math.sqrt(skipped)) + 2 * (parts > 1), 2 * differ + 4)
        if not parts:
            continue
        alike = math.exp(-tokens * (1 - RARE))
        one = 1 - none + COMPARED * (alike - none)
        cost = exact * one + deletions * (one + tokens + COMPARED * tokens * alike)
        left = exact + 2 * deletions - differ - 1
        cost += 1000 * (skipped > left)  # most sets would be over their slack
        if left >= 0 and (best is None or cost < best[0]):
            best = cost, (exact, deletions, left)
    return best[1]


def shingle_sets(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of the distinct shingles, sorted. Fewer than SHINGLE words count as one shingle."""
    doc, stop = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts)
    code = shingle_hashes(words, SHINGLE, 21)
    inside = doc[: len(code)] == doc[SHINGLE - 1 :] if len(code) else np.zeros(0, bool)
    code, doc = code[inside], doc[: len(inside)][inside]
    for n in range(1, SHINGLE):
        few = np.flatnonzero(counts == n)
        if len(few):
            code = np.append(code, shingle_hashes(words, n, 30 + n)[(stop - counts)[few]])
            doc = np.append(doc, few)
    order = np.lexsort((code, doc))
    code, doc = code[order], doc[order]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])))[: len(code)]
    return doc[new], code[new]


def set_names(doc: np.ndarray, code: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of each document's set (as int64), and its size."""
    size, total = np.bincount(doc, minlength=docs), np.zeros(docs, U)
    np.add.at(total, doc, mix(code ^ U(77)))
    return mix(total + size.astype(U)).view(np.int64), size


def entries_of(doc: np.ndarray, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(entry, owner, weight) of all entries, and by owner the slack left. Owner: twice the document, plus 1 in the band below its own."""
    low, high, plans = bands(int(size.max(initial=SMALLEST)))
    own = np.searchsorted(low, size, side="right") - 1
    out, left = [], np.zeros(2 * len(size), np.int64)
    for side in (0, 1):
        band = np.maximum(own - side, 0)
        real = (size >= SMALLEST) & (own >= side) & ((side == 0) | (4 * size <= 5 * high[band]))
        exact, deletions, slack = (plans[band] * real[:, None]).T
        segments = exact + deletions
        base = np.cumsum(segments) - segments
        mine = real[doc]
        d, salt = doc[mine], mix(band.astype(U) + U(500))
        x = mix(code[mine] ^ salt[d])
        segment = base[d] + (x % segments[d].astype(U)).astype(np.int64)
        n = int(segments.sum())
        order = np.argsort(segment, kind="stable")
        held = np.bincount(segment, minlength=n)
        total = np.zeros(n, U)
        if len(order):
            total[held > 0] = np.add.reduceat(x[order], (np.cumsum(held) - held)[held > 0])
        owner = np.repeat(np.arange(len(size)), segments)
        index = np.arange(n) - base[owner]
        twice = index >= exact[owner]
        tag = mix(salt[owner] + index.astype(U))
        # not told: what no shingle or only an empty deletion would name; unsure: what a linked set might not tell
        spare, unsure = np.where(twice, held <= 1, held == 0), np.where(twice, held <= 2, held == 0)
        slack = slack - np.bincount(owner, weights=unsure * (1 + twice), minlength=len(size)).astype(np.int64)
        told = ~spare | (slack < 0)[owner]
        out.append((mix(total + tag)[told], 2 * owner[told] + side, (1 + twice)[told]))
        gone = np.flatnonzero(twice[segment] & told[segment])
        at = segment[gone]
        out.append((mix(total[at] - x[gone] + tag[at]), 2 * owner[at] + side, np.full(len(at), 2)))
        left[side::2] = slack
    return *(np.concatenate([o[i] for o in out]) for i in range(3)), left


def batch(kinds: dict[str, pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def rows(kinds: dict[str, pa.DataType], found: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(kinds, [[f[i] for f in found] for i in range(len(kinds))])])


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with tie, which tells texts apart; text as bytes."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.lit(6), "text").alias("tie"), F.col("text").cast("binary").alias("text"))


#: part 0: pairs of small entries; 1: entries of a bucket; 2: stars of common entries; 3: members; 4: memberships of common entries.
PACKED = "bucket int, part int, a binary, b binary, names binary, sizes binary, left binary, weights binary"
PACK = {"bucket": pa.int32(), "part": pa.int32()} | {k: pa.binary() for k in ("a", "b", "names", "sizes", "left", "weights")}


def first_of(*sorted_: np.ndarray) -> np.ndarray:
    """Whether each item differs from the one before it."""
    if not len(sorted_[0]):
        return np.zeros(0, bool)
    return np.concatenate(([True], functools.reduce(np.logical_or, [s[1:] != s[:-1] for s in sorted_])))


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 5 * np.minimum(a, b) >= 4 * np.maximum(a, b)


Sets = collections.namedtuple("Sets", "name size side left weight")  # of memberships: the set, its size, band, slack and the entry's weight


def told(bucket: int, part: int, own: Sets, a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """A row of pairs of places, with the weight they share here and the smaller slack; sets from the band above meet in their own band."""
    keep = near(own.size[a], own.size[b]) & (own.side[a] + own.side[b] < 2) & (own.name[a] != own.name[b])
    a, b = a[keep], b[keep]
    swap = own.name[a] > own.name[b]
    low, high = (np.where(swap, b, a), np.where(swap, a, b)) if part == 0 else (a, b)
    order = np.lexsort((own.side[high], own.side[low], own.name[high], own.name[low]))
    low, high = low[order], high[order]
    new = np.flatnonzero(first_of(own.name[low], own.name[high], own.side[low], own.side[high]))
    if not len(new):
        return []
    return [(bucket, part, own.name[low][new].tobytes(), own.name[high][new].tobytes(), None, (own.side[low] + 2 * own.side[high])[new].astype(np.int32).tobytes(), np.minimum(own.left[low], own.left[high])[new].astype(np.int32).tobytes(), np.add.reduceat(own.weight[low].astype(np.int64), new).astype(np.int32).tobytes())]


def stars(bucket: int, entry: np.ndarray, own: Sets, places: np.ndarray, most: int) -> tuple[list[tuple], np.ndarray]:
    """Of common entries (places, sorted by entry) the rows of their stars, and which of the places are their `most` most central sets.

    The members of an entry are told against its most central set.
    """
    distinct, who = np.unique(own.name[places], return_inverse=True)
    central = np.bincount(np.ravel(who), minlength=len(distinct))[np.ravel(who)]
    order = np.lexsort((own.name[places], -central, entry[places]))
    ranked = places[order]
    start = np.flatnonzero(first_of(entry[ranked]))
    count = np.diff(np.append(start, len(ranked)))
    top = np.zeros(len(places), bool)
    top[order] = np.arange(len(ranked)) - np.repeat(start, count) < most
    return told(bucket, 2, own, np.repeat(ranked[start], count), ranked), top


def memberships(bucket: int, entry: np.ndarray, own: Sets) -> tuple:
    """A row of common entries (64 bits) with their sets."""
    distinct, who = np.unique(own.name, return_inverse=True)
    return bucket, 4, entry.astype(np.int64).tobytes(), np.ravel(who).astype(np.uint32).tobytes(), distinct.tobytes(), own.side.astype(np.int32).tobytes(), own.left.astype(np.int32).tobytes(), own.weight.astype(np.int8).tobytes()


def index(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed members, pairs, stars, and common entries with their sets.

    An entry that more than COMMON sets of one pack have is common already: its COMMON + 1 most central ones alone go to
    the entry's bucket, the others stay in rows of their pack. So no bucket gets all of a huge family.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, entries, count, turn = Hashes(bytes.lower), [], 0, 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            names, size, left, entry, owner, weight, ids, none, ties = (np.concatenate([h[i] for h in held]) for i in range(9))
            yield batch(PACK, [[(turn + int(ties[0])) % buckets], [3], [ids.tobytes()], [none.tobytes()], [names.tobytes()], [size.astype(np.int32).tobytes()], [ties.tobytes()], [None]])
            _, first = np.unique(names, return_index=True)  # one document tells for all with its set
            tells = np.zeros(len(names), bool)
            tells[first] = True
            tells = tells[owner // 2]
            entry, owner, weight = entry[tells], owner[tells], weight[tells]
            order = np.argsort(entry, kind="stable")
            entry, owner, weight = entry[order], owner[order], weight[order]
            start = np.flatnonzero(first_of(entry))
            count = np.diff(np.append(start, len(entry)))
            hot = np.flatnonzero(np.repeat(count, count) > COMMON)
            if len(hot):
                own = Sets(names[owner // 2], size[owner // 2], owner % 2, left[owner], weight)
                at_home = (turn + int(ties[0])) % buckets
                found, top = stars(at_home, entry, own, hot, COMMON + 1)
                rest = hot[~top]
                code = ((entry[rest] >> U(32)) % U(buckets) << U(32)) | (entry[rest] & U(0xFFFFFFFF))
                yield from rows(PACK, [*found, memberships(at_home, code, Sets(*(x[rest] for x in own)))]).to_batches()
                keep = np.ones(len(entry), bool)
                keep[rest] = False
                entry, owner, weight = entry[keep], owner[keep], weight[keep]
            for b, at in by_part(((entry >> U(32)) % U(buckets)).astype(np.int32)):
                distinct, place = short(owner[at])
                side = (distinct % 2).astype(np.int32)
                yield batch(PACK, [[b], [1], [entry[at].astype(np.uint32).tobytes()], [place], [names[distinct // 2].tobytes()], [(2 * size[distinct // 2] + side).astype(np.int32).tobytes()], [left[distinct].astype(np.int32).tobytes()], [weight[at].astype(np.int8).tobytes()]])

        for piece, texts in chunks(batches):
            doc, code = shingle_sets(*known.of(texts))
            names, size = set_names(doc, code, len(texts))
            entry, owner, weight, left = entries_of(doc, code, size)
            ids = piece.column("doc_id")
            held.append((names, size, left, entry, owner + 2 * count, weight.astype(np.int8), ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), piece.column("tie").to_numpy()))
            entries, count = entries + len(entry), count + len(texts)
            if entries >= PACK_ENTRIES or count >= PACK_DOCS:
                yield from flush()
                held, entries, count, turn = [], 0, 0, turn + 1
        if held:
            yield from flush()

    def meet(group: pa.Table) -> pa.Table:
        bucket, parts, found = group.column("bucket")[0].as_py(), [], []
        for r in group.to_pylist():
            if r["part"] > 1:
                found.append(tuple(r[k] for k in PACK))
                continue
            names = np.frombuffer(r["names"], np.int64)
            at = long(r["b"], len(names))
            parts.append((np.frombuffer(r["a"], np.uint32), names[at], np.frombuffer(r["sizes"], np.int32)[at], np.frombuffer(r["left"], np.int32)[at], np.frombuffer(r["weights"], np.int8)))
        if not parts:
            return rows(PACK, found)
        entry = np.concatenate([p[0] for p in parts])
        order = np.argsort(entry, kind="stable")
        start = np.flatnonzero(first_of(entry[order]))
        count = np.diff(np.append(start, len(entry)))
        order = order[np.repeat(count, count) > 1]
        entry = entry[order]
        name, size, left, weight = (np.concatenate([p[i] for p in parts])[order] for i in range(1, 5))
        order = np.lexsort((size % 2, name, entry))
        order = order[first_of(entry[order], name[order])]
        entry, name, left, weight = entry[order], name[order], left[order], weight[order]
        own = Sets(name, size[order] // 2, size[order] % 2, left, weight)
        start = np.flatnonzero(first_of(entry))
        count = np.diff(np.append(start, len(entry)))
        many, last = np.repeat(count, count), np.repeat(start + count, count)
        small = np.flatnonzero((many > 1) & (many <= COMMON))
        one = [small[small + gap < last[small]] for gap in range(1, COMMON)]
        found.extend(told(bucket, 0, own, np.concatenate(one), np.concatenate([a + gap for gap, a in enumerate(one, 1)])))
        hot = np.flatnonzero(many > COMMON)
        if len(hot):
            found.extend(stars(bucket, entry, own, hot, 0)[0])
            found.append(memberships(bucket, (U(bucket) << U(32)) | entry[hot].astype(U), Sets(*(x[hot] for x in own))))
        return rows(PACK, found)

    return docs.mapInArrow(pack, PACKED).groupBy("bucket").applyInArrow(meet, PACKED)


MEMBER = {"doc_id": pa.int64(), "tie": pa.int64(), "name": pa.int64(), "size": pa.int64()}
PAIR = {"a": pa.int64(), "b": pa.int64()}
COUNTED = PAIR | {"sides": pa.int64(), "left": pa.int64(), "weight": pa.int64()}


def members(packed: DataFrame) -> DataFrame:
    """doc_id, tie, name (null: an empty set) and size of each document's set."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                size = np.frombuffer(r["sizes"], np.int32)
                ids = pa.array(np.frombuffer(r["a"], np.int64), mask=np.frombuffer(r["b"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(r["left"], np.int64)), pa.array(np.frombuffer(r["names"], np.int64), mask=size == 0), pa.array(size.astype(np.int64))], names=list(MEMBER))

    return packed.where("part = 3").mapInArrow(unpack, "doc_id long, tie long, name long, size long")


def counted(packed: DataFrame, part: int) -> DataFrame:
    """a, b, left, weight: what pairs share over all buckets, in one band."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield batch(COUNTED, [np.frombuffer(r[k], np.int64) for k in ("a", "b")] + [np.frombuffer(r[k], np.int32).astype(np.int64) for k in ("sizes", "left", "weights")])

    pairs = packed.where(F.col("part") == part).mapInArrow(unpack, "a long, b long, sides long, left long, weight long")
    return pairs.groupBy("a", "b", "sides").agg(F.min("left").alias("left"), F.sum("weight").alias("weight"))


def candidates(packed: DataFrame) -> DataFrame:
    """Pairs (a, b) that small entries can't rule out, and each set's best pivots of common entries (PIVOTS at most: stars only save work, what they miss is compared by prefixes)."""
    shared = counted(packed, 0).where("weight > greatest(left, 0) div 2").select("a", "b")
    best = F.row_number().over(W.partitionBy("b").orderBy(F.desc("weight"), "a"))
    stars = counted(packed, 2).withColumn("n", best).where(F.col("n") <= PIVOTS).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return shared.unionByName(stars).distinct()


def over(packed: DataFrame, labels: DataFrame) -> DataFrame:
    """name of the sets for which common entries that join several components weigh more than half their slack in one of their bands.

    labels: node, component; a set without a label is a component of its own.
    """
    kinds = {k: pa.int64() for k in ("entry", "name", "side", "left", "weight")}

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                names = np.frombuffer(r["names"], np.int64)[np.frombuffer(r["b"], np.uint32)]
                yield batch(kinds, [np.frombuffer(r["a"], np.int64), names, *(np.frombuffer(r[k], t) for k, t in (("sizes", np.int32), ("left", np.int32), ("weights", np.int8)))])

    # equal sets of several packs are one node, and of a set that meets an entry in two bands one counts
    held = packed.where("part = 4").mapInArrow(unpack, "entry long, name long, side long, left long, weight long")
    held = save(held.groupBy("entry", "name").agg(F.min(F.struct("side", "left", "weight")).alias("m")).select("entry", "name", "m.*"), "common")
    known = held.join(labels.withColumnRenamed("node", "name"), "name", "left").select("entry", F.coalesce("component", "name").alias("component"))
    mixed = known.groupBy("entry").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("entry")
    heavy = held.join(mixed, "entry", "left_semi").groupBy("name", "side").agg(F.sum("weight").alias("w"), F.min("left").alias("left"))
    return heavy.where("w > greatest(left, 0) div 2").select("name").distinct()


def texts_of(docs: DataFrame, homes: DataFrame, sets: DataFrame) -> DataFrame:
    """bucket, name, text of homes (bucket, name); one text for each."""
    one = sets.where("name is not null").groupBy("name").agg(F.min(F.struct("tie", F.coalesce("doc_id", F.lit(1 << 62)).alias("id"))).alias("key"))
    wanted = homes.join(one, "name").select("bucket", "name", F.col("key.tie").alias("tie"), F.col("key.id").alias("id"))
    return docs.withColumn("id", F.coalesce("doc_id", F.lit(1 << 62))).join(wanted, ["tie", "id"]).select("bucket", "name", "text")


def sets_in(own: pa.Table) -> dict[int, np.ndarray]:
    """name -> sorted shingles, of a table (name, text)."""
    known, out = Hashes(bytes.lower), {}
    for piece, texts in chunks(own.to_batches()):
        doc, code = shingle_sets(*known.of(texts))
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        out |= {n: code[bounds[i] : bounds[i + 1]] for i, n in enumerate(piece.column("name").to_pylist())}
    return out


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """Edges (a, b) that join the same sets as those of the pairs (a, b) that link.

    A pair is compared in the bucket of its b; a (a pivot, if there is one) is sent to each bucket that needs it.
    """
    dealt = save(pairs.select(F.pmod(F.xxhash64("b"), F.lit(buckets)).cast("int").alias("bucket"), "a", "b"), "pairs")
    homes = dealt.select((F.col("bucket") + 0).alias("bucket"), F.explode(F.array("a", "b")).alias("name")).distinct()

    def compare(pairs: pa.Table, own: pa.Table) -> pa.Table:
        sets, root = sets_in(own), {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        found = []
        for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist(), strict=True):
            if (x := top(a)) == (y := top(b)):
                continue
            p, q = sets[a], sets[b]
            both = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * both >= 80 * (len(p) + len(q) - both):
                root[max(x, y)] = min(x, y)
                found.append((a, b))
        return rows(PAIR, found)

    return dealt.groupBy("bucket").cogroup(texts_of(docs, homes, sets).groupBy("bucket")).applyInArrow(compare, "a long, b long")


def sketch(token: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by hash classes, as bits: one to two for each shingle, MOST_BITS at most."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(2 * len(token) - 1).bit_length()))
    odd = np.bincount((mix(token.view(U) + U(91)) % U(bits)).astype(np.int64), minlength=bits) % 2
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(U)


def folded(parities: np.ndarray, words: int) -> np.ndarray:
    """The rows' sketches with fewer classes, as the same shingles give them."""
    return np.bitwise_xor.reduce(parities.reshape(len(parities), -1, words), axis=1)


def unlike(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A lower bound on the shingles that just one of two sets has: an odd class of one that is even of the other holds such a shingle."""
    return np.bitwise_count(own ^ others).sum(1, dtype=np.int64)


def by_prefix(docs: DataFrame, sets: DataFrame, names: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b), in different components, of the named sets that share one of the rarest shingles of each (prefix filter) and can still link.

    What two sets don't share is bounded from below by their sketches before a pair is told, so families that are alike,
    but not enough, give no pairs. A shingle with many members is met in blocks of about MEET of them, block by block.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, code in sets_in(pa.Table.from_batches([b])).items():
                yield batch({"name": pa.int64(), "token": pa.int64(), "size": pa.int64()}, [np.full(len(code), name), code.view(np.int64), np.full(len(code), len(code))])

    homes = names.withColumn("bucket", F.lit(0))
    held = save(texts_of(docs, homes, sets).select("name", "text").mapInArrow(tokens, "name long, token long, size long"), "tokens")
    often = held.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")

    def prefix(group: pa.Table) -> pa.Table:
        token = group.column("token").to_numpy()
        parities = sketch(token).tobytes()
        order = np.lexsort((token, group.column("df").to_numpy()))
        order = order[: len(order) // 5 + 1]
        return group.take(order).append_column("place", pa.array(np.arange(len(order)))).append_column("sketch", pa.array([parities] * len(order), pa.binary()))

    # of A's shingles a fifth at most is missing from a linked B, so one of the rarest fifth plus one is shared, and so for B;
    # and what stands before the first they share, they don't share
    ranked = held.join(often, "token", "left").select("name", "token", "size", F.coalesce("df", F.lit(1)).alias("df")).groupBy("name").applyInArrow(prefix, "name long, token long, size long, df long, place long, sketch binary")
    ranked = ranked.where("df > 1").join(labels.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))

    blocks = F.ceil(F.col("df") / MEET).cast("int")
    own = F.pmod(F.xxhash64(F.lit(MEET), "name"), blocks).cast("int")
    meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(own, b).alias("x"), F.greatest(own, b).alias("y")))
    dealt = ranked.withColumn("own", own).withColumn("meet", F.explode(meets)).select("token", "meet.x", "meet.y", "own", "name", "component", "size", "place", "sketch")

    def cross(group: pa.Table) -> pa.Table:
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        name, label, size, place, own = (group.column(c).to_numpy() for c in ("name", "component", "size", "place", "own"))
        order = np.argsort(size, kind="stable")
        name, label, size, rest, own = name[order], label[order], size[order], (size - place)[order], own[order]
        parities = group.column("sketch").combine_chunks().take(pa.array(order))
        words = pc.binary_length(parities).to_numpy(zero_copy_only=False) // 8
        reach, found = np.searchsorted(4 * size, 5 * size, side="right"), [np.zeros((2, 0), np.int64)]
        for level in np.unique(words):  # larger sets have as many classes or more, those in reach twice as many at most
            within = np.flatnonzero((words == level) | (words == 2 * level))
            bits = np.concatenate([folded(np.frombuffer(b"".join(parities.take(pa.array(at)).to_pylist()), U).reshape(len(at), -1), level) for at in (within[words[within] == level], within[words[within] != level]) if len(at)])
            for i, here in enumerate(within[words[within] == level]):
                other = np.arange(i + 1, np.searchsorted(within, reach[here]))
                to = within[other]
                most = np.minimum(rest[here], rest[to])  # shared, if this is the first shingle they share
                keep = (label[to] != label[here]) & (100 * most >= 80 * (size[here] + size[to] - most)) & ((own[to] != own[here]) if x != y else True)
                other, to = other[keep], to[keep]
                apart = unlike(bits[i], bits[other])  # linked sets of n shingles together differ in n / 9 at most
                to = to[9 * apart <= size[here] + size[to]]
                found.append(np.sort(np.stack([np.full(len(to), name[here]), name[to]]), axis=0))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.Table.from_batches([batch(PAIR, [pairs[0], pairs[1]])])

    return dealt.groupBy("token", "x", "y").applyInArrow(cross, "a long, b long").distinct()


def components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, (node, component) of the sets that link with another)."""
    docs = keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, size // BUCKET_BYTES)
    packed = save(index(docs, buckets), "index")
    sets = members(packed)
    links = save(verified(docs, sets, candidates(packed), buckets), "links")
    labels = connected(links)
    pairs = by_prefix(docs, sets, save(over(packed, labels), "over"), labels)
    more = save(verified(docs, sets, pairs, buckets), "links")
    return sets, connected(links.unionByName(more)) if not more.isEmpty() else labels


def spread_join(rows: DataFrame, single: DataFrame, key: str) -> DataFrame:
    """Left join with a side that has one row for each key, SPREAD times over, so that no task has all rows of a key. rows: doc_id, tie, any others."""
    salt = F.pmod(F.xxhash64(F.lit(8), "doc_id", "tie"), F.lit(SPREAD)).cast("int")
    copies = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return rows.withColumn("_salt", salt).join(copies, [key, "_salt"], "left").drop("_salt")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, tie, n_shingles and component_id of each row of docs (doc_id, text, any others).

    A null or wordless text has no shingles and is a component of its own. A row without doc_id takes part, but names no
    component unless all rows of its component are without (component_id is null then). Repeated rows give repeated rows.
    Where one document must be chosen, a row without doc_id counts as 2**62, so ids from there on come no sooner than it.
    """
    sets, labels = components(docs)
    own = spread_join(sets, labels.withColumnRenamed("node", "name"), "name").withColumn("component", F.coalesce("component", "name"))
    least = own.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = spread_join(own, least, "component")
    return found.select("doc_id", "tie", F.col("size").alias("n_shingles"), F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("component", F.xxhash64("doc_id", "tie")).alias("component"))


@shielded("doc_id", "text")
def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, any others) without near copies: of each component the row with the smallest doc_id."""
    key = [F.coalesce("doc_id", F.lit(1 << 62)).alias("_id"), F.col("tie").alias("_tie")]
    keep = near_duplicates(docs).where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(*key)).alias("k")).select("k._id", "k._tie", F.lit(True).alias("_keep"))
    marked = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62)), "_tie": F.xxhash64(F.lit(6), "text")})
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    copies = F.row_number().over(W.partitionBy("_id", "_tie").orderBy(F.lit(0)))
    kept = marked.where(~blank).join(keep, ["_id", "_tie"]).withColumn("_n", copies).where("_n = 1")
    return kept.select(*docs.columns).unionByName(docs.where(blank))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, over whole texts; edge cases as near_duplicates states."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
