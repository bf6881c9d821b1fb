"""Chat formatting (13): incremental black-box rendering.

A template is any object with render(turns) -> str; nothing else is asked about how it writes a conversation. Successive
prefixes of a conversation are rendered and each output is compared with the one before: if that is its beginning, the
rest is what the new turn added (its piece); if not, the template has rewritten history, which is recorded, and a new
sample starts with the whole output, of which only the new turn counts. Where a text lies in its piece is found the same
way: the turn is rendered with two one-character texts, and what both outputs share at their beginning and end is the
role's marking (the first turn, which may come with a preamble, is always probed itself). The found span must give the text back when unescaped; if it doesn't (a template that trims, say), the
turn is probed again in its place, and after that it has no span and no loss.

The output has a row for each turn, never for a whole conversation: pieces in order are the formatted text, and their
start, text_start and text_end are places in it (code points, end exclusive). What a template may look back at can't be
told from some of its outputs, so every turn is rendered after all turns before it: work grows with the square of a
conversation's length, memory with its length. A template may declare a bound, reach: a turn's piece depends on that turn
and at most so many turns before it, and history is never rewritten. Then turns beyond it are let go, a conversation of any
length passes through a task in constant memory, and work grows with its length; the library's own template declares 0.
A declaration is tried whenever turns are let go, and one that doesn't hold is an error. All turns of a conversation pass
through one task in order, as their rendering and their digests are sequential by definition: with a declared reach, a
conversation with a third of all rows takes that task's time, not its memory.

Nulls, empties, ties, repeats, clashing names: a null text or role is empty. Turns come by number, those without one
last, equal ones by role and text; repeated rows are turns of their own. Rows without conv_id are one conversation. An
empty text has an empty span. An empty table has an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.llm.util import small_batches, table

#: Turns that a shortened prefix keeps at least; turns and characters of an output batch.
TURNS, BATCH_TURNS, BATCH_CHARS = 16, 1_000, 8_000_000

PIECES = "conv_id long, turn_index long, sample int, role string, piece string, start long, text_start long, text_end long, loss boolean, rewrites boolean"
PIECES_ARROW = pa.schema([("conv_id", pa.int64()), ("turn_index", pa.int64()), ("sample", pa.int32()), ("role", pa.string()), ("piece", pa.string()), ("start", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.bool_())])

DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_samples int, n_rewrites long, n_opaque long"
DIGEST_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_samples", pa.int32()), ("n_rewrites", pa.int64()), ("n_opaque", pa.int64())])

Turn = tuple[str, str]


class Marked:
    """The library's own template: `### role: text</turn>` and a line feed for each turn.

    A backslash escapes itself, and every place in a text where `###` or `</turn>` would begin (in a role also a colon), so
    markers stand only where a turn begins or ends and every text can be read back.
    """

    reach = 0

    IN_TEXT, IN_ROLE, ESCAPED = re.compile(r"\\|#(?=##)|<(?=/turn>)"), re.compile(r"[\\:]|#(?=##)|<(?=/turn>)"), re.compile(r"\\([\\#<:])")
    WRITTEN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"### {self.escape(role, self.IN_ROLE)}: {self.escape(text)}</turn>\n" for role, text in turns)

    def escape(self, text: str, where: re.Pattern = IN_TEXT) -> str:
        return where.sub(r"\\\g<0>", text)

    def unescape(self, text: str) -> str:
        return self.ESCAPED.sub(r"\1", text)

    def parse(self, written: str) -> Iterator[Turn]:
        """The turns of a formatted text."""
        at = 0
        while at < len(written):
            found = self.WRITTEN.match(written, at)
            if not found:
                raise ValueError(f"no turn at {at}")
            yield self.unescape(found[1]), self.unescape(found[2])
            at = found.end()


def shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    return len(os.path.commonprefix([a, b]))


class Rendering:
    """The pieces of one conversation, turn by turn. loss: roles whose texts are learned.

    prefix: the last turns; local: so far they have given their last one the piece that it has after all turns. older: the
    turns before them, rendered with them, for a template without a declared reach.
    """

    def __init__(self, template: object, loss: frozenset[str], markings: dict[str, tuple[str, str] | None]) -> None:
        self.template, self.loss, self.markings = template, loss, markings
        self.plain = getattr(template, "unescape", lambda text: text)
        self.reach: int | None = getattr(template, "reach", None)
        self.keep = max(TURNS, (self.reach or 0) + 1)
        self.older: list[Turn] = []
        self.prefix: list[Turn] = []
        self.before, self.length, self.sample, self.index, self.local = "", 0, 0, 0, True

    def add(self, role: str, text: str) -> tuple:
        """(index, sample, piece, start, text_start, text_end, rewrites) of the next turn."""
        output = self.template.render([*self.older, *self.prefix, (role, text)])
        rewrites = not output.startswith(self.before)
        if rewrites:  # the whole output is a new sample; the turn's own part begins where its text can be found
            self.sample, self.length, base = self.sample + 1, 0, 0
        else:
            base = len(self.before)
        piece = output[base:]
        span = self.span(role, text, piece, base, known=self.index > 0 and not rewrites)
        out = (self.index, self.sample, piece, self.length, None if span is None else self.length + span[0], None if span is None else self.length + span[1], rewrites)
        self.length += len(piece)
        self.index += 1
        self.prefix.append((role, text))
        self.before = output
        if self.local and len(self.prefix) >= 2 * self.keep:
            self.shorten(piece, rewrites)
        return out

    def shorten(self, piece: str, rewrites: bool) -> None:
        """The prefix becomes its last turns. Those before are let go if a declared reach doesn't extend to them, and else stay as older ones."""
        short = self.prefix[-self.keep :]
        less, output = self.template.render(short[:-1]), self.template.render(short)
        self.local = not rewrites and output.startswith(less) and output[len(less) :] == piece
        if self.reach is not None and not self.local:
            raise ValueError(f"the template looks back farther than the {self.reach} turns it declares")
        if self.reach is not None:
            self.prefix, self.before = short, output
        elif self.local:
            self.older += self.prefix[: -self.keep]
            self.prefix = short

    def span(self, role: str, text: str, piece: str, base: int, known: bool) -> tuple[int, int] | None:
        """Where the text lies in its piece, which begins at base of the output. known: markings found at other turns may hold here."""
        if known:
            if role not in self.markings:
                self.markings[role] = self.probe(role, base)
            found = self.inside(piece, self.markings[role], text)
            if found:
                return found
        return self.inside(piece, self.probe(role, base), text)

    def probe(self, role: str, base: int) -> tuple[str, str] | None:
        """What stands before and after any text of the role as the next turn."""
        one, two = (self.template.render([*self.older, *self.prefix, (role, c)])[base:] for c in "ab")
        head = shared(one, two)
        tail = len(one) - head - 1
        return (one[:head], one[len(one) - tail :]) if tail >= 0 and len(one) == len(two) and one[head + 1 :] == two[head + 1 :] and one[head : head + 1] == "a" else None

    def inside(self, piece: str, marking: tuple[str, str] | None, text: str) -> tuple[int, int] | None:
        if marking is None:
            return None
        head, tail = marking
        end = len(piece) - len(tail)
        if end >= len(head) and piece.startswith(head) and piece.endswith(tail) and self.plain(piece[len(head) : end]) == text:
            return len(head), end
        return None


def in_batches(rows: Iterator[tuple], schema: pa.Schema, width: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches, limited by rows and by the characters of the column at width."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[width]) if width is not None else 0
        if len(held) >= BATCH_TURNS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(column, f.type) for column, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def render_turns(template: object, loss: frozenset[str]):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            of, now, markings = object(), None, {}
            for batch in batches:
                for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if conv != of:
                        of, now = conv, Rendering(template, loss, markings)
                    index, sample, piece, start, text_start, text_end, rewrites = now.add(role, text)
                    yield conv, index, sample, role, piece, start, text_start, text_end, role in loss and text_start is not None, rewrites

        yield from in_batches(rows(), PIECES_ARROW, 4)

    return run


def by_conversation(rows: DataFrame, *order: object) -> DataFrame:
    """All rows of a conversation in one partition, in order."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_conversations(turns: DataFrame, template: object | None = None, loss: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns (conv_id, turn, role, text, any others) as PIECES, a conversation's one after another and in order."""
    small_batches(turns.sparkSession)
    text = turns.select(F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = by_conversation(text, F.asc_nulls_last("turn"), "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(render_turns(template or Marked(), frozenset(loss)), PIECES)


def reread(template: object):  # noqa: ANN201
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            of, now = object(), None
            for batch in batches:
                for row in batch.to_pylist():
                    if row["conv_id"] != of:
                        if now:
                            yield of, *now.told()
                        of, now = row["conv_id"], Reading(template)
                    now.add(row)
            if now:
                yield of, *now.told()

        yield from in_batches(rows(), DIGEST_ARROW)

    return run


class Reading:
    """Digests of a conversation from its pieces alone."""

    def __init__(self, template: object) -> None:
        self.template, self.plain = template, getattr(template, "unescape", lambda text: text)
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.rewrites = self.opaque = self.sample = 0

    def add(self, row: dict) -> None:
        piece, start = row["piece"], row["start"]
        written = list(self.template.parse(piece))
        for role, text in written[-1:] if row["rewrites"] else written:  # a rewriting output repeats the turns before
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        if row["loss"]:
            learned = self.plain(piece[row["text_start"] - start : row["text_end"] - start])
            self.loss.update(learned.encode())
            self.loss_chars += len(learned)
        self.opaque += row["text_start"] is None
        self.rewrites += row["rewrites"]
        self.chars += len(piece)
        self.sample = row["sample"]

    def told(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.sample + 1, self.rewrites, self.opaque


def read_back(pieces: DataFrame, template: object | None = None, ordered: bool = False) -> DataFrame:
    """A row for each conversation with DIGEST, parsed from the pieces by the template's parse(); every piece must hold whole turns.

    ordered: pieces come as format_conversations() gives them, one conversation after another, so they needn't be sorted again.
    """
    rows = pieces if ordered else by_conversation(pieces, "turn_index")
    return rows.mapInArrow(reread(template or Marked()), DIGEST)


#: A conversation whose texts hold the template's own markers.
TRICKY = r"\### Assistant: </turn> ok"


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back. Edge cases as in the module's docstring."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(tricky)), ordered=True)


_TEXT = r"(length(t) + length(t) - length(replace(t, '\', '')) + coalesce(list_sum(list_transform(regexp_extract_all(t, '###+'), lambda r: length(r) - 2)), 0) + (length(t) - length(replace(t, '</turn>', ''))) // 7)"
_ROLE = _TEXT.replace("(t", "(r0").replace("lambda r:", "lambda r:") + " + length(r0) - length(replace(r0, ':', ''))"

SQL = rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS r0, coalesce(text, '') AS t FROM conversations UNION ALL SELECT -7, 0, 'user', '{TRICKY}' UNION ALL SELECT -7, 1, 'assistant', '{TRICKY}')
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r0 || chr(10) || t || chr(10), '' ORDER BY turn NULLS LAST, r0, t)) AS turns_sha256,
    coalesce(sum(length(t)) FILTER (r0 = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS LAST, r0, t) FILTER (r0 = 'assistant'), '')) AS loss_sha256,
    sum(4 + {_ROLE} + 2 + {_TEXT} + 8)::BIGINT AS formatted_chars, 1::INT AS n_samples, 0::BIGINT AS n_rewrites, 0::BIGINT AS n_opaque FROM c GROUP BY 1"""
