"""Token counts (1): edit-aware counting with a pre-token segment tree for each document.

A text is cut where a character that is no white space meets a space, tab or line break: the tokenizer's pre-tokens
never cross such a place and don't look back over it, so the pieces' counts add up to the text's. A document's tree
has LEAF pieces in a leaf and in each inner node the sums of characters and tokens below. An edit finds its leaves by
the character sums; they and a leaf on either side (boundary context) are cut and counted anew, and the sums above
them are updated. What lies outside is never encoded again.

Edits apply in order, each to the text that the one before left; places are code points, and places beyond the end
count as the end. A null text counts as empty and can be edited; null edits (or a null list) change nothing. Repeated
rows and extra columns pass through, but for columns named like the results.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.util import shielded, small_batches, table

#: The vocabulary (ranks of a byte-level BPE) and its pre-token pattern (a fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces in a leaf, and how many times as many make it crowded; pieces whose counts a task remembers, and the longest of those.
LEAF, CROWDED, KNOWN_PIECES, LONGEST_KNOWN = 32, 4, 250_000, 64

CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])")
EDITS = "array<struct<start:int,end:int,text:string>>"


@functools.cache
def encoding_of(vocabulary: bytes):  # noqa: ANN201
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str):  # noqa: ANN201
    with open(path, "rb") as file:
        return encoding_of(file.read())


class Counts(dict):
    """piece -> its number of tokens; forgets all when there are KNOWN_PIECES."""

    def __init__(self, vocabulary: bytes):
        self.encode = encoding_of(vocabulary).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) <= LONGEST_KNOWN:
            if len(self) >= KNOWN_PIECES:
                self.clear()
            self[piece] = n
        return n


class Tree:
    """Sums over the leaves of one text; node i has the children 2 * i and 2 * i + 1.

    A leaf that edits have filled beyond CROWDED * LEAF pieces is dealt out again, with all others and with the counts
    that are known, so nothing is encoded for it; that comes once in as many inserted pieces as it takes to fill a leaf.
    """

    def __init__(self, text: str, counts: Counts):
        self.counts, self.encoded, pieces = counts, 0, CUT.split(text)
        self.deal(pieces, list(map(counts.__getitem__, pieces)))

    def deal(self, pieces: list[str], tokens: list[int]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        self.sizes = [tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i in range(len(self.leaves)):
            self.measure(i)
        for node in range(self.width - 1, 0, -1):
            self.add(node)

    def measure(self, leaf: int) -> None:
        self.chars[self.width + leaf] = sum(map(len, self.leaves[leaf]))
        self.tokens[self.width + leaf] = sum(self.sizes[leaf])

    def add(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds this place, and where the leaf starts; the end of the text belongs to the last leaf."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if place - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def context(self, leaf: int, step: int) -> int:
        """The next leaf in this direction that holds text, or the last there is."""
        leaf += step
        while 0 < leaf < len(self.leaves) - 1 and not self.chars[self.width + leaf]:
            leaf += step
        return min(max(leaf, 0), len(self.leaves) - 1)

    def edit(self, start: int, end: int, text: str) -> None:
        size = self.chars[1]
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first, at = self.find(start)
        last = self.find(max(start, end - 1))[0]
        low, high = self.context(first, -1), self.context(last, 1)
        at -= sum(self.chars[self.width + low : self.width + first])
        old = "".join("".join(self.leaves[i]) for i in range(low, high + 1))
        new = old[: start - at] + text + old[end - at :]
        self.encoded += len(new)
        pieces, slots = CUT.split(new), high - low + 1
        share = max(1, -(-len(pieces) // slots))
        for i in range(slots):
            self.leaves[low + i] = pieces[i * share : (i + 1) * share]
            self.sizes[low + i] = list(map(self.counts.__getitem__, self.leaves[low + i]))
            self.measure(low + i)
        if share > CROWDED * LEAF:
            self.deal([p for leaf in self.leaves for p in leaf], [n for sizes in self.sizes for n in sizes])
            return
        low, high = (self.width + low) // 2, (self.width + high) // 2
        while high:
            for node in range(max(low, 1), high + 1):
                self.add(node)
            low, high = low // 2, high // 2

    def text(self) -> str:
        return "".join(map("".join, self.leaves))


RESULTS = {"n_tokens": pa.int64(), "n_tokens_edited": pa.int64(), "n_chars_encoded": pa.int64(), "text_edited": pa.string()}


@shielded("text", "edits")
def count_edited(docs: DataFrame, vocabulary: str = VOCABULARY, with_text: bool = True) -> DataFrame:
    """docs (text, edits as EDITS, any others) without edits, with the tokens before and after, the characters that were encoded again, and the new text (null unless with_text)."""
    small_batches(docs.sparkSession)
    with open(vocabulary, "rb") as file:  # the driver alone needs the file: a vocabulary is about a megabyte
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    names = [c for c in docs.columns if c not in ("edits", *RESULTS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(shared.value)
        for batch in batches:
            found = []
            for text, edits in zip(batch.column("text"), batch.column("edits").to_pylist(), strict=True):
                tree = Tree(text.as_py() or "", counts)
                before = tree.tokens[1]
                for e in edits or ():
                    if e is not None and e["start"] is not None:
                        tree.edit(e["start"], e["start"] if e["end"] is None else e["end"], e["text"] or "")
                found.append((before, tree.tokens[1], tree.encoded, tree.text() if with_text else None))
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate(RESULTS.values())]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *columns], names=[*names, *RESULTS])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], "n_tokens long, n_tokens_edited long, n_chars_encoded long, text_edited string"])
    return docs.select(*names, "edits").mapInArrow(count, schema)


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits of every document: a heading before its middle, a quarter's ten characters gone, ten of the last quarter replaced."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.coalesce(F.length("text"), F.lit(0))
    edit = lambda start, end, text: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(text).alias("text"))
    half, quarter, late = F.floor(n / 2), F.floor(n / 4), F.floor(3 * n / 4)
    docs = docs.withColumn("edits", F.array(edit(half, half, "\nEdited: 2 words\n"), edit(quarter, quarter + 10, ""), edit(late, late + 10, " replaced ")))
    return count_edited(docs, with_text=False).select("doc_id", "n_tokens", "n_tokens_edited", "n_chars_encoded")
