"""Substring dedup (10): recompression.

Rounds of recompression rename each document's words: a run of equal symbols gets one name, then neighbouring symbols
whose names fall left and right get the pair's name. A name is a 64-bit fingerprint of what it stands for, so all
tasks give equal substrings equal names without asking each other, and whether two neighbours merge depends on them
alone: equal substrings get the same symbols inside, whatever surrounds them.

After ROUNDS rounds, every window of 13 words in which no word and no two words repeat at once holds a symbol, with
CONTEXT words on either side, that all its occurrences parse alike (a run or pair can be cut off only at the ends: at
most two words and two symbols are lost at each). These anchors, and the other windows themselves, are counted over
all documents in Spark: one that only one document has rules its windows out. The windows that hold a shared
anchor are then compared by a second, independent naming of all 13 words, to find the smallest doc_id of each: 64 bits,
16 more, and the bucket (22 bits at 100 TB), so that among 1e13 windows a false equality is expected once in some 1e5
such corpora. Names of anchors (64 bits) only choose candidates: if two collide, windows are compared in vain.

Both countings deal (bucket, packed arrays) rows: a task sends one entry for an anchor or window however many of its
documents hold it, so huge groups of copies don't meet in one task. Text is shuffled once, as compressed bytes, and
reused. A doc_id of 2**63 - 1 is taken for a null one: both come after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.util import small_batches, table
from augur.llm.words import Hashes, U, by_part, chunks, grouped, long, mix, multipliers, shingle_hashes, short

WINDOW, ROUNDS, CONTEXT = 13, 2, 2

#: Bytes of text a part holds and a bucket of anchors or windows stands for; entries and documents that a task packs at once.
PART_BYTES, BUCKET_BYTES, PACK_ENTRIES, PACK_DOCS = 4 << 20, 20 << 20, 2_000_000, 30_000

#: How texts are compressed while they are shuffled.
PRESS = "zstd"

#: A null doc_id comes after all others.
#: Where the ids of rows without doc_id begin; to each other, and to doc_ids from here on, they count as one document's.
LAST = 1 << 62

ENTRIES = "bucket int, part int, keys binary, owners binary, ids binary, ties binary, places binary"


def compress(name: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """One round over symbols (name, first word, word after the last, document): names for runs, then for pairs."""
    if not len(name):
        return name, start, end, doc
    first = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]))))
    count = np.diff(np.append(first, len(name))).astype(U)
    end = end[np.append(first[1:], len(name)) - 1]
    name, start, doc = name[first], start[first], doc[first]
    name = np.where(count > 1, mix(name + U(salt) * count), name)
    left = (mix(name ^ U(salt)) >> U(63)).astype(bool)
    pair = np.append(left[:-1] & ~left[1:] & (doc[1:] == doc[:-1]), False)
    keep = ~np.concatenate(([False], pair[:-1]))
    joined = mix(name * multipliers(1, salt)[0] + np.append(name[1:], U(0)))
    return np.where(pair, joined, name)[keep], start[keep], np.where(pair, np.append(end[1:], 0), end)[keep], doc[keep]


def anchors(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first word, word after the last, document) of each anchor: a symbol with its context, or a repetitive window."""
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words))
    stop = np.cumsum(counts)
    name, start, end, owner = words, place, place + 1, doc
    for r in range(ROUNDS):
        name, start, end, owner = compress(name, start, end, owner, 11 + 2 * r)
    fits = (start - CONTEXT >= (stop - counts)[owner]) & (end + CONTEXT <= stop[owner]) & (end - start + 2 * CONTEXT <= WINDOW)
    name, start, end, owner = name[fits], start[fits] - CONTEXT, end[fits] + CONTEXT, owner[fits]
    code = name * multipliers(1, 5)[0]
    for i, m in enumerate(multipliers(2 * CONTEXT, 6)):
        code += words[start + i if i < CONTEXT else end - 1 - (i - CONTEXT)] * m
    code = mix(code)
    if len(words) < WINDOW:
        return code, start, end, owner
    once = np.concatenate((words[1:] == words[:-1], [False]))
    twice = np.concatenate(((words[2:-1] == words[:-3]) & (words[3:] == words[1:-2]), [False] * 3))
    held = lambda flags, span: np.concatenate(([0], np.cumsum(flags)))[WINDOW - span + 1 :] - np.concatenate(([0], np.cumsum(flags)))[: -(WINDOW - span + 1)]  # noqa: E731  flags that lie in each window
    windows = len(words) - WINDOW + 1
    odd = np.flatnonzero(((held(once, 2)[:windows] > 0) | (held(twice, 4)[:windows] > 0)) & (doc[:windows] == doc[WINDOW - 1 :]))
    whole = mix(shingle_hashes(words, WINDOW, 9)[odd] + U(1))
    return np.append(code, whole), np.append(start, odd), np.append(end, odd + WINDOW), np.append(owner, doc[odd])


def window_names(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent names of every WINDOW consecutive words; crosses texts, callers drop those."""
    return shingle_hashes(words, WINDOW, 9), mix(shingle_hashes(mix(words ^ U(0xA5A5)), WINDOW, 10))


def named(code: np.ndarray, other: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """As words.grouped, by both names."""
    order = np.lexsort((other, code))
    code, other = code[order], other[order]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (other[1:] != other[:-1])))[: len(code)]
    first = np.flatnonzero(new)
    return code, other, *(r[order] for r in rest), first, np.cumsum(new) - 1


def coded(code: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((code >> U(32)) % U(buckets)).astype(np.int32), code.astype(np.uint32)


def rows(found: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pylist(found, schema)


def arrow(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def narrow(place: np.ndarray) -> bytes:
    """Places in a text, in two bytes each where that is enough."""
    return place.astype(np.uint16 if place.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def wide(place: bytes, n: int) -> np.ndarray:
    return np.frombuffer(place, np.uint16 if len(place) == 2 * n else np.uint32).astype(np.uint32)


def plain(own: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tie, length, pressed) with their text, a few at a time; a null text has become an empty one."""
    press = pa.Codec(PRESS)
    for b in own.to_batches(max_chunksize=200):
        texts = [press.decompress(z, n, asbytes=True) if n else b"" for n, z in zip(b.column("length").to_pylist(), b.column("pressed").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(texts, pa.binary())], names=["doc_id", "tie", "text"])


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(U)) % U(parts)).astype(np.int32)


def ids_of(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The doc_ids; a row without one gets an id by its text, so that such rows are spread over all parts."""
    column = (lambda c: batch.column(c)) if isinstance(batch, pa.RecordBatch) else (lambda c: batch.column(c).combine_chunks())
    ids, ties = column("doc_id"), column("tie").to_numpy(zero_copy_only=False)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), LAST + (ties & (LAST - 1)), ids.fill_null(0).to_numpy(zero_copy_only=False))


def ranks(ids: np.ndarray) -> np.ndarray:
    """ids as they are compared: rows without doc_id are one document, the last."""
    return np.minimum(ids, LAST)


def shared_anchors(docs: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Packed (document, anchor) pairs of the anchors that more than one doc_id has, by part of the document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, schema = Hashes(), arrow(ENTRIES)
        codes, owners, ids, entries, docs_held = [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            held = np.concatenate(ids)
            code, owner, first, group = grouped(np.concatenate(codes), np.concatenate(owners))
            if not len(code):
                return
            smallest, largest = np.minimum.reduceat(held[owner], first), np.maximum.reduceat(held[owner], first)
            found = []
            bucket, key = coded(code, buckets)
            for b, at in by_part(bucket[first]):
                distinct, place = short(owner[first[at]])
                found.append({"bucket": b, "keys": key[first[at]].tobytes(), "owners": place, "ids": held[distinct].tobytes()})
            local = np.flatnonzero((smallest != largest)[group])
            for p, at in by_part(part_of(held[owner[local]], parts)):  # known to be shared already
                distinct, place = short(owner[local[at]])
                found.append({"bucket": p % buckets, "part": p, "keys": bucket[local[at]].astype(np.uint32).tobytes() + key[local[at]].tobytes(), "owners": place, "ids": held[distinct].tobytes()})
            yield from rows(found, schema).to_batches(max_chunksize=64)

        for piece, texts in chunks(batches):
            words, counts = known.of(texts)
            code, _, _, owner = anchors(words, counts)
            codes.append(code)
            owners.append((owner + docs_held).astype(np.int32))
            ids.append(ids_of(piece))
            entries, docs_held = entries + len(code), docs_held + len(texts)
            if entries >= PACK_ENTRIES or docs_held >= PACK_DOCS:
                yield from flush()
                codes, owners, ids, entries, docs_held = [], [], [], 0, 0
        if docs_held:
            yield from flush()

    def count(group: pa.Table) -> pa.Table:
        found, keys, ids = [], [], []
        bucket = group.column("bucket")[0].as_py()
        for r in group.to_pylist():
            if r["part"] is None:
                own = np.frombuffer(r["ids"], np.int64)
                keys.append(np.frombuffer(r["keys"], np.uint32))
                ids.append(own[long(r["owners"], len(own))])
            else:
                found.append(r)
        if keys:
            key, own, first, group_of = grouped(np.concatenate(keys), np.concatenate(ids))
            shared = np.flatnonzero((np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first))[group_of])
            for p, at in by_part(part_of(own[shared], parts)):
                distinct, place = short(own[shared[at]])
                k = key[shared[at]]
                found.append({"bucket": bucket, "part": p, "keys": np.full(len(k), bucket, np.uint32).tobytes() + k.tobytes(), "owners": place, "ids": distinct.tobytes()})
        return rows(found, arrow(ENTRIES))

    return docs.select("doc_id", "tie", "text").mapInArrow(pack, ENTRIES).groupBy("bucket").applyInArrow(count, ENTRIES).select("part", "keys", "owners", "ids")


def unpacked(flags: pa.Table) -> np.ndarray:
    """Sorted fingerprints of the (doc_id, anchor) pairs."""
    out = [np.zeros(0, U)]
    for r in flags.to_pylist():
        ids, both = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["keys"], np.uint32).astype(U)
        n = len(both) // 2
        out.append(pair_code(ids[long(r["owners"], len(ids))], both[:n], both[n:]))
    return np.sort(np.concatenate(out))


def pair_code(ids: np.ndarray, bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
    return mix(mix(ids.astype(U)) + ((bucket.astype(U) << U(32)) | key.astype(U)))


def within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def repeated_windows(docs: DataFrame, flags: DataFrame, buckets: int, parts: int) -> DataFrame:
    """Packed (row, first word) of the windows that a smaller doc_id has too, by part. docs: part, doc_id, tie, length, pressed."""

    def pack(own: pa.Table, flagged: pa.Table) -> pa.Table:
        known, ordered = Hashes(), unpacked(flagged)
        codes, others, owners, places, ids, ties, held = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for piece, texts in chunks(plain(own)) if len(ordered) else ():
            words, counts = known.of(texts)
            own_ids = ids_of(piece)
            code, start, end, owner = anchors(words, counts)
            hit = within(pair_code(own_ids[owner], *coded(code, buckets)), ordered)
            start, end, owner = start[hit], end[hit], owner[hit]
            stop = np.cumsum(counts)
            low, high = np.maximum(end - WINDOW, (stop - counts)[owner]), np.minimum(start, stop[owner] - WINDOW) + 1
            marks = np.zeros(len(words) + 1, np.int64)
            real = high > low
            np.add.at(marks, low[real], 1)
            np.add.at(marks, high[real], -1)
            at = np.flatnonzero(np.cumsum(marks[:-1]) > 0)
            doc = np.repeat(np.arange(len(counts)), counts)[at]
            if len(at):
                code, other = window_names(words)
                codes.append(code[at])
                others.append(other[at])
            owners.append(doc + held)
            places.append(at - (stop - counts)[doc])
            ids.append(own_ids)
            ties.append(piece.column("tie").to_numpy(zero_copy_only=False))
            held += len(texts)
        ids, ties = np.concatenate(ids), np.concatenate(ties)
        code, other, owner, place, first, group = named(np.concatenate(codes), np.concatenate(others), np.concatenate(owners), np.concatenate(places))
        found = []
        if len(code):
            rank = ranks(ids)[owner]
            least = np.minimum.reduceat(rank, first)[group] == rank
            part = own.column("part")[0].as_py()
            for b, at in by_part(np.where(least, ((other >> U(16)) % U(buckets)).astype(np.int64), -1)):
                distinct, index = short(owner[at])
                entry = {"bucket": b, "keys": code[at].tobytes() + other[at].astype(np.uint16).tobytes(), "owners": index, "ids": ids[distinct].tobytes(), "ties": ties[distinct].tobytes(), "places": narrow(place[at])}
                found.append(entry | {"bucket": part % buckets, "part": part, "keys": None} if b < 0 else entry)
        return rows(found, arrow(ENTRIES))

    def least(group: pa.Table) -> pa.Table:
        found, keys, others, ids, ties, places = [], [], [], [], [], []
        for r in group.to_pylist():
            if r["part"] is not None:
                found.append(r)
                continue
            own, tie = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ties"], np.int64)
            at = long(r["owners"], len(own))
            keys.append(np.frombuffer(r["keys"], U, len(at)))
            others.append(np.frombuffer(r["keys"], np.uint16, len(at), 8 * len(at)))
            ids.append(own[at])
            ties.append(tie[at])
            places.append(wide(r["places"], len(at)))
        if keys:
            _, _, own, tie, place, first, group_of = named(np.concatenate(keys), np.concatenate(others), np.concatenate(ids), np.concatenate(ties), np.concatenate(places))
            later = np.flatnonzero(np.minimum.reduceat(ranks(own), first)[group_of] < ranks(own))
            own, tie, place = own[later], tie[later], place[later]
            row, at_row = np.unique(np.stack([own, tie]), axis=1, return_inverse=True) if len(own) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            for p, at in by_part(part_of(own, parts)):
                distinct, index = short(np.ravel(at_row)[at])
                found.append({"bucket": 0, "part": p, "owners": index, "ids": row[0][distinct].tobytes(), "ties": row[1][distinct].tobytes(), "places": narrow(place[at])})
        return rows(found, arrow(ENTRIES))

    packed = docs.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(pack, ENTRIES)
    return packed.groupBy("bucket").applyInArrow(least, ENTRIES).select("part", "owners", "ids", "ties", "places")


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


def drop_repeats(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by a space; null unless with_text).

    A word goes if a window of 13 words that covers it also starts in a document with a smaller doc_id. A null text
    has no words; a null doc_id comes after all others; rows with one doc_id, or with none, don't count against each other.
    Rows without doc_id are spread over the tasks by their texts, so they may be very many; rows of one doc_id meet in one
    task. A doc_id of 2**62 or more counts as none when it is compared. Repeated rows are kept each; no rows give none.
    Columns of docs other than doc_id and text are ignored.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("tie"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = max(16, size // PART_BYTES), max(16, size // BUCKET_BYTES)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = pa.Codec(PRESS, compression_level=1)
        for b in batches:
            texts = [t or b"" for t in b.column("text").to_pylist()]
            pressed = [press.compress(t, asbytes=True) if t else b"" for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tie"), pa.array(part_of(ids_of(b), parts)), pa.array(list(map(len, texts)), pa.int64()), pa.array(pressed, pa.binary())], names=["doc_id", "tie", "part", "length", "pressed"])

    dealt = docs.select("doc_id", "tie", "text").mapInArrow(deal, "doc_id long, tie long, part int, length long, pressed binary")

    def finish(own: pa.Table, covers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return rows([], arrow(KEPT))
        ids, ties, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for r in covers.to_pylist():
            i, t = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["ties"], np.int64)
            at = long(r["owners"], len(i))
            ids.append(i[at])
            ties.append(t[at])
            places.append(wide(r["places"], len(at)))
        row, place, first, _ = grouped(pair_code(np.concatenate(ids), np.zeros(1, U), np.concatenate(ties)), np.concatenate(places))
        slices = {int(row[a]): place[a:b] for a, b in zip(first, np.append(first[1:], len(row)), strict=False)}
        codes = pair_code(ids_of(own), np.zeros(1, U), own.column("tie").combine_chunks().to_numpy(zero_copy_only=False))
        found, at = [], 0
        for piece, texts in chunks(plain(own)):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), texts, strict=True):
                words = text.split()
                gone = slices.get(int(codes[at]))
                at += 1
                removed = 0
                if gone is not None:
                    mark = np.zeros(len(words) + 1, np.int64)
                    np.add.at(mark, gone, 1)
                    np.add.at(mark, gone + WINDOW, -1)
                    keep = np.cumsum(mark[:-1]) == 0
                    removed = int(len(words) - keep.sum())
                    total = len(words)
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                else:
                    total = len(words)
                kept = b" ".join(words)
                found.append({"doc_id": doc_id, "n_words": total, "n_removed": removed, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if with_text else None})
        return rows(found, arrow(KEPT))

    covers = repeated_windows(dealt, shared_anchors(docs, buckets, parts), buckets, parts)
    out = dealt.groupBy("part").cogroup(covers.groupBy("part")).applyInArrow(finish, KEPT)
    return out.withColumn("kept", F.col("kept").cast("string"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every whole text without the passages of documents with smaller doc_ids; edge cases as drop_repeats states."""
    return drop_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")
