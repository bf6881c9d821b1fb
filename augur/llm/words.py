"""Word hashing inside tasks: whole texts as arrays of 64-bit word hashes, a bounded chunk of documents at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Distinct words whose hashes a task remembers, and bytes of text that are in hand at once (one longer text is one chunk).
KNOWN_WORDS, CHUNK_BYTES = 250_000, 1 << 20

U = np.uint64
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def multipliers(n: int, salt: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U) + U(salt << 20)) | U(1)


class Hashes(dict):
    """word -> hash, for the words met; forgets them all when there are KNOWN_WORDS. normal: bytes -> bytes, before hashing."""

    def __init__(self, normal: Callable[[bytes], bytes] | None = None):
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        plain = self.normal(word) if self.normal else word
        found = self[word] = xxhash.xxh64_intdigest(plain) if plain else 0
        return found

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of the texts, one text after the other, and the number of words of each."""
        split = [t.split() for t in texts]  # bytes.split() cuts at space, tab, LF, VT, FF and CR: the words of WORD
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter((h for words in split for h in map(self.__getitem__, words)), U, int(counts.sum())), counts


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about `size` bytes in column text (binary; null counts as empty), and those texts."""
    for batch in batches:
        lengths = np.array([0 if v is None else v for v in pc.binary_length(batch.column("text")).to_pylist()], dtype=np.int64)
        part = (np.cumsum(lengths) - lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, [t or b"" for t in piece.column("text").to_pylist()]


def shingle_hashes(words: np.ndarray, k: int, salt: int = 1) -> np.ndarray:
    """Hashes of every k consecutive words; crosses texts, callers drop those."""
    n = max(0, len(words) - k + 1)
    out = np.zeros(n, dtype=U)
    for j, m in enumerate(multipliers(k, salt)):
        out += words[j : j + n] * m
    return mix(out)


def starts(changed: np.ndarray) -> np.ndarray:
    """Places where a sorted array's next group begins, from changed[i]: item i + 1 differs from item i."""
    return np.flatnonzero(np.concatenate(([True], changed)))


def grouped(key: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """key and others sorted by key (stable), then the first place of each group and each item's group."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = starts(key[1:] != key[:-1]) if len(key) else np.zeros(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key)))) if len(key) else np.zeros(0, np.int64)
    return key, *(o[order] for o in others), first, group


def by_part(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, the places that hold it), for each part."""
    part, place, first, _ = grouped(part, np.arange(len(part)))
    return [(int(part[a]), place[a:b]) for a, b in zip(first, np.append(first[1:], len(part)), strict=False)]


def short(owner: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The distinct owners and, as bytes, 32-bit places among them."""
    distinct, place = np.unique(owner, return_inverse=True)
    return distinct, place.astype(np.uint32 if len(distinct) > 65_535 else np.uint16).tobytes()


def long(place: bytes, distinct: int) -> np.ndarray:
    return np.frombuffer(place, np.uint32 if distinct > 65_535 else np.uint16)
