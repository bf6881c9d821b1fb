"""Chat formatting (13): templates that look back far, and only now and then, against outputs of all turns."""

import pytest

from augur.llm import chat
from tests.llm.test_new_operators import Greeting, pieces_of


class Recalling:
    """Every 50th turn repeats the first one."""

    def render(self, turns):
        return "".join(f"{r}={t}{'~' + turns[0][1] if i % 50 == 49 else ''};" for i, (r, t) in enumerate(turns))


class Windowed:
    """Writes only the last 100 turns, and so rewrites history from there on."""

    def render(self, turns):
        return "".join(f"{r}={t};" for r, t in turns[-100:])


class Recapping:
    """Sums up a conversation of more than 70 turns in a line at its beginning."""

    def render(self, turns):
        return ("" if len(turns) <= 70 else f"({len(turns) // 70} x 70 turns)") + "".join(f"{r}={t};" for r, t in turns)


class Echoing:
    """Repeats what was said 40 turns ago, and says so."""

    reach = 40

    def render(self, turns):
        return "".join(f"{r}={t}{'~' + turns[i - 40][1] if i >= 40 else ''};" for i, (r, t) in enumerate(turns))


class Forgetful(Recalling):
    reach = 3

    def render(self, turns):
        return "".join(f"{len(turns[0][1])}/{r}={t};" for r, t in turns)


TURNS = [(("user", "assistant")[i % 2], f"turn {i}") for i in range(230)]


def outputs(template, turns):
    """(piece, start, rewrites) of each turn by the outputs of all turns up to it."""
    before, start, out = "", 0, []
    for k in range(1, len(turns) + 1):
        output = template.render(turns[:k])
        rewrites = not output.startswith(before)
        start, piece = (0, output) if rewrites else (start, output[len(before) :])
        out.append((piece, start, rewrites))
        start, before = start + len(piece), output
    return out


@pytest.mark.parametrize("kind", [Recalling, Windowed, Recapping, Echoing, Greeting, chat.Marked])
def test_every_turn_is_rendered_after_all_before_it(kind):
    found, rendering = pieces_of(kind(), TURNS)
    assert [(p[2], p[3], p[6]) for p in found] == outputs(kind(), TURNS)
    if hasattr(kind, "reach"):
        assert not rendering.older and len(rendering.prefix) < 2 * max(chat.TURNS, kind.reach + 1)
    else:
        assert [*rendering.older, *rendering.prefix] == TURNS


def test_a_declaration_that_does_not_hold():
    with pytest.raises(ValueError, match="looks back farther than the 3 turns"):
        pieces_of(Forgetful(), [("user", "long" * i) for i in range(1, 60)])


def test_long_memory_in_spark(spark):
    data = [(c, i, r, t) for c in (1, 2) for i, (r, t) in enumerate(TURNS[: 120 * c])]
    rows = chat.format_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3), Recalling()).orderBy("turn_index").collect()
    for c in (1, 2):
        assert "".join(r["piece"] for r in rows if r["conv_id"] == c) == Recalling().render(TURNS[: 120 * c])
