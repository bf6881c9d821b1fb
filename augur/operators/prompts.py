"""Prompts as expressions: templates with sections and nested lists are put together as Column trees, so rendering is a projection.

A part is a function from a scope (names to Columns) to a Column of text:

    text("  {p.date}: {p.value}\\n")                     values by name, fields by a dot; doubled braces are braces
    each("history", "p", part, between="\\n", empty="  (none)")    a part for each element of an array; {n} is its number
    when("label", part, otherwise)                        a part where a value is there and not empty
    seq(part, part, ...)                                  one after another
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scope = dict[str, Column]
Part = Callable[[Scope], Column]


def value(scope: Scope, path: str) -> Column:
    name, *fields = path.split(".")
    found = scope[name]
    for f in fields:
        found = found[f]
    return found


def text(template: str) -> Part:
    pieces = list(string.Formatter().parse(template))

    def render(scope: Scope) -> Column:
        out = []
        for literal, field, _, _ in pieces:
            out += [F.lit(literal)] if literal else []
            out += [F.coalesce(value(scope, field).cast("string"), F.lit(""))] if field is not None else []
        return F.concat(*out) if out else F.lit("")

    return render


def seq(*parts: Part) -> Part:
    return lambda scope: F.concat(*[p(scope) for p in parts])


def each(path: str, name: str, part: Part, between: str = "\n", empty: str = "") -> Part:
    def render(scope: Scope) -> Column:
        items = value(scope, path)
        rows = F.transform(items, lambda x, i: part(scope | {name: x, "n": (i + 1).cast("string")}))
        return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(rows, between, "")).otherwise(F.lit(empty))

    return render


def when(path: str, part: Part, otherwise: Part | None = None) -> Part:
    def render(scope: Scope) -> Column:
        there = F.coalesce(value(scope, path).cast("string") != "", F.lit(False))
        return F.when(there, part(scope)).otherwise(otherwise(scope) if otherwise else F.lit(""))

    return render


def number(x: Column) -> Column:
    """A double as it is published: the shortest digits, without an exponent."""
    fixed = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), "0+$", ""), r"\.$", ".0")
    return F.when((x == 0) | F.abs(x).between(1e-3, 9_999_999.0), x.cast("string")).otherwise(fixed)


#: The texts of the prompts, word for word what entrants are sent; points of history that a context shows.
CONTEXTS = {"none": 0, "recent10": 10, "news": 10, "web": 10}
HEADER = (
    "You are forecasting the next scheduled release of a public opinion tracker.\nPublished by: {publisher}\nQuestion: {question}\nUnit: {unit}\nHow the tracker is measured: {methodology}\nRelease schedule: {cadence}\nScheduled release date: {release}\n"
)
NO_HISTORY = "No history of this series is provided.\n"
WITH_HISTORY = "Recent published values of this series (oldest first, one point per release):\n{history}\n"
FOOTER = (
    "Give your predictive distribution over the value that will be released. Reply with exactly one JSON object and no other text:\n{{\"mean\": <number>, \"sd\": <number>}}\nsd is your standard deviation in the same unit and must be greater than 0."
)
PROFILE_NOUN = "subgroup"
PROFILE_HEADER = (
    "You are forecasting the next scheduled release of a tracker, broken down into its {noun}s.\nPublished by: {publisher}\nQuestion: {question}\nUnit: {unit}\nHow the tracker is measured: {methodology}\nRelease schedule: {cadence}\nScheduled release date: {release}\n"
    "You are forecasting all {count} {noun}s below as one joint answer. They are cuts of the same measurement on the same day: they move together, and they also move apart in ways the overall level alone does not determine. "
    "You are being scored on the whole profile, so the relationships between {noun}s matter as much as their levels.\n"
)
PROFILE_NO_HISTORY = "No history of these {noun}s is provided.\nThe {noun}s to forecast are:\n"
PROFILE_WITH_HISTORY = "Recent published values for each {noun} (oldest first, one point per release):\n"
PROFILE_FOOTER = (
    "Give a predictive distribution for every {noun} listed above. Reply with exactly one JSON object and no other text, keyed by the {noun} ids exactly as they appear above:\n{{\"<{noun} id>\": {{\"mean\": <number>, \"sd\": <number>}}, ...}}\n"
    "Every {noun} id must be present. A partial answer cannot be scored and is discarded. sd is your standard deviation for that {noun}, in the same unit, and must be greater than 0."
)
RANKING_HEADER = (
    "You are forecasting an ordered list, not a number.\nPublished by: {publisher}\nQuestion: {question}\nAnswer format: {unit}\nHow the ranking is measured: {methodology}\nMeasurement window: {week_start} through {week_end}, inclusive.\n"
    "Release schedule: {cadence}\nScheduled release date: {release}\n{universe}"
)
RANKING_NO_HISTORY = "No past weeks of this ranking are provided.\n"
RANKING_WITH_HISTORY = "The true ranked list for each recent completed week (oldest first, rank 1 first within each week):\n"
RANKING_FOOTER = (
    "Give exactly {length} items in the order you predict, highest first. Reply with exactly one JSON object and no other text:\n{{\"ranking\": [\"<rank 1>\", \"<rank 2>\", ...]}}\n"
    "Exactly {length} items, each appearing exactly once, written exactly as described above. Do not give probabilities, confidence levels or ranges: this round is scored on the list itself -- how much of the true list you "
    "recovered and how nearly in the right order -- and anything else in the reply is discarded."
)
RANKING_SUPERFC = (
    "Work through the following before answering, in this order.\n1. Outside view. How much does this list normally change week to week? How many entries typically survive from one week to the next, and how far do they move? What would simply repeating last week's list get right?\n"
    "2. Inside view. What is specific to this week -- scheduled events, releases, anniversaries, anything already in motion that would put a new item high or push an existing one down? Say where each belongs in the order.\n"
    "3. Pre-mortem. Assume your list turns out badly wrong. Write the most likely reason, then correct for it.\n"
    "4. Check the tail. The positions you are least sure of are usually the lower ones. Make sure each is still your best single guess rather than a placeholder, since a wrong item there costs the same as a wrong item anywhere.\n"
)
SUPERFC = (
    "Work through the following before answering, in this order.\n1. Outside view. What is the base rate here? What has this series done historically, how much does it move between releases, and what would a naive extrapolation predict?\n"
    "2. Inside view. What is specific to this release -- events, timing, anything that would move this particular number away from the base rate? Say how much each is worth, in the unit of the series.\n"
    "3. Pre-mortem. Assume your answer turns out badly wrong. Write the most likely reason, then correct for it.\n"
    "4. Calibrate. Your sd should be wide enough that the true value falls inside one sd about two thirds of the time. Check it against how much this series actually moves between releases.\n"
)
NEWS = "Recent world events, from the Wikipedia Current Events portal, as the pages stood at {news.asof}. This is the same digest given to every entrant; nothing after {news.asof} is included.\n{news.text}\n"
SEARCH = "Results of the searches you asked for, retrieved at {search.asof}. Every entrant searches the same index with the same settings; the queries below are your own.\n"
QUERY_TURN = (
    "Before answering, you may search the web. Reply with exactly one JSON object and no other text:\n{{\"queries\": [\"<search query>\", ...]}}\nAt most {most} queries. They will be run verbatim against a news index covering the last {days} days, "
    "and the results will come back to you before you forecast. Ask for what would actually change your estimate.\n"
)
PERSONA_HEADER = "You are answering a public opinion survey as the person described below. Answer the way that person would answer, not the way you would.\n\n{persona}\n\nAnswer honestly and in character. Do not explain, hedge, or mention that you are playing a role.\n"
PERSONA_FOOTER = "Reply with exactly one JSON object and no other text, using one of the listed options for each key:\n"

POINTS = each("points", "p", text("  {p.date}: {p.value}"), empty="  (none)")
CELLS = each("cells", "c", seq(text("  {c.id}"), when("c.label", text("  ({c.label})")), text("\n"), each("c.history", "p", text("    {p.date}: {p.value}"), empty="    (none)")))
WEEKS = each("weeks", "w", seq(text("  week ending {w.date}\n"), each("w.items", "item", text("    {n}. {item}"))), empty="  (none)")
RESULTS = each(
    "search.results", "r",
    seq(text('  Query: "{r.query}"\n'), each("r.results", "x", seq(text("    - "), when("x.title", text("{x.title}"), text("untitled")), when("x.published", text(" ({x.published})")), when("x.content", text("\n      {x.content}"))), empty="    (no results)")), empty="  (no results)",
)


def last(points: Column, n: int) -> Column:
    return F.slice(points, F.greatest(F.size(points) - n, F.lit(0)) + 1, max(n, 1)) if n else F.slice(points, 1, 0)


def shown(points: Column) -> Column:
    """Points (date, value) with both as they are printed."""
    return F.transform(F.coalesce(points, F.array().cast("array<struct<date:date,value:double>>")), lambda p: F.struct(p["date"].cast("string").alias("date"), number(p["value"]).alias("value")))


def scope_of(rounds: DataFrame, **more: Column) -> Scope:
    """The columns of a round, with what is said where one isn't there: publisher, question, unit, methodology, cadence, release_at."""
    own = lambda c, default: F.coalesce(F.col(c), F.lit(default)) if c in rounds.columns else F.lit(default)
    release = F.substring(F.col("release_at").cast("string"), 1, 10)
    return {c: F.col(c) for c in rounds.columns} | {"publisher": own("publisher", "not stated"), "question": own("question", ""), "unit": own("unit", ""), "methodology": own("methodology", "not stated"), "cadence": own("cadence", "not stated"), "release": release} | more


def needed(column: str, context: str, rounds: DataFrame, there: Column) -> Column:
    """Nothing, or the job's failure: a condition without what makes it one would be another condition's copy."""
    if column not in rounds.columns:
        raise ValueError(f"the {context} condition needs a column {column}")
    return F.when(F.coalesce(there, F.lit(False)), F.lit("")).otherwise(F.raise_error(F.lit(f"the {context} condition needs {column}")).cast("string"))


def evidence(rounds: DataFrame, context: str, scope: Scope) -> Column:
    """The block of a context: news (struct of asof, text), or search (struct of asof, results: query and results of title, published, content)."""
    if context == "news":
        return F.concat(needed("news", context, rounds, F.col("news.text") != ""), text(NEWS)(scope))
    if context == "web":
        day = lambda x: F.substring(x["published"].cast("string"), 1, 10)
        line = lambda x: F.trim(F.regexp_replace(F.coalesce(x["content"], F.lit("")), r"\s+", " "))
        results = F.transform("search.results", lambda r: F.struct(r["query"].alias("query"), F.transform(r["results"], lambda x: F.struct(x["title"].alias("title"), day(x).alias("published"), line(x).alias("content"))).alias("results")))
        held = scope | {"search": F.struct(F.coalesce("search.asof", F.lit("lock time")).alias("asof"), results.alias("results"))}
        return F.concat(needed("search", context, rounds, F.size("search.results") > 0), seq(text(SEARCH), RESULTS, text("\n"))(held))
    return F.lit("")


def known(context: str, elicitation: str) -> int:
    if context not in CONTEXTS:
        raise ValueError(f"unknown context {context!r}; known: {sorted(CONTEXTS)}")
    if elicitation not in ("direct", "superfc"):
        raise ValueError(f"unknown elicitation {elicitation!r}")
    return CONTEXTS[context]


def number_prompt(rounds: DataFrame, context: str = "recent10", elicitation: str = "direct", asked: Part = text(FOOTER)) -> Column:
    """The prompt of rounds about a number: the round's columns and history (an array of date, value, oldest first)."""
    n = known(context, elicitation)
    scope = scope_of(rounds, points=shown(last(F.col("history"), n)))
    body = text(NO_HISTORY) if n == 0 else seq(text(WITH_HISTORY.split("{")[0]), POINTS, text("\n"))
    return F.concat(text(HEADER)(scope), body(scope), evidence(rounds, context, scope), F.lit(SUPERFC if elicitation == "superfc" else ""), asked(scope))


def profile_prompt(rounds: DataFrame, context: str = "recent10", elicitation: str = "direct") -> Column:
    """The prompt of rounds about a profile. rounds: the round's columns, and cells: an array of id, label, history in the order that is scored; noun if it has one."""
    n = known(context, elicitation)
    cells = F.transform("cells", lambda c: F.struct(c["id"].alias("id"), c["label"].alias("label"), shown(last(c["history"], n)).alias("history")))
    scope = scope_of(rounds, cells=cells, count=F.size("cells"), noun=F.coalesce("noun", F.lit(PROFILE_NOUN)) if "noun" in rounds.columns else F.lit(PROFILE_NOUN))
    body = seq(text(PROFILE_NO_HISTORY), each("cells", "c", text("  {c.id}")), text("\n")) if n == 0 else seq(text(PROFILE_WITH_HISTORY), CELLS, text("\n"))
    return F.concat(text(PROFILE_HEADER)(scope), body(scope), evidence(rounds, context, scope), F.lit(SUPERFC if elicitation == "superfc" else ""), text(PROFILE_FOOTER)(scope))


def ranking_prompt(rounds: DataFrame, context: str = "recent10", elicitation: str = "direct", asked: Part = text(RANKING_FOOTER)) -> Column:
    """The prompt of rounds about a list: the round's columns, week_start, week_end, length, universe, and weeks: an array of date, items, oldest first."""
    n = known(context, elicitation)
    scope = scope_of(rounds, weeks=last(F.col("weeks"), n))
    body = text(RANKING_NO_HISTORY) if n == 0 else seq(text(RANKING_WITH_HISTORY), WEEKS, text("\n"))
    return F.concat(text(RANKING_HEADER)(scope), body(scope), evidence(rounds, context, scope), F.lit(RANKING_SUPERFC if elicitation == "superfc" else ""), asked(scope))


def query_prompt(rounds: DataFrame, prompt: Callable[..., Column] = number_prompt, context: str = "web", most: int = 3, days: int = 14) -> Column:
    """The first turn of the web condition: the same framing, and the request for searches in place of the answer's format."""
    turn = text(QUERY_TURN)
    return prompt(rounds, "recent10" if context == "web" else context, "direct", lambda scope: turn(scope | {"most": F.lit(most), "days": F.lit(days)}))


def persona_prompt(personas: DataFrame) -> Column:
    """What a respondent is asked. personas: persona (its description), items: an array of key, text, options."""
    scope = {"persona": F.col("persona"), "items": F.transform("items", lambda i: F.struct(i["key"].alias("key"), i["text"].alias("text"), F.array_join(i["options"], " / ").alias("options")))}
    lines = each("items", "i", text("- {i.key}: {i.text}\n  Options: {i.options}"))
    shape = each("items", "i", text('"{i.key}": "<{i.options}>"'), between=", ")
    return seq(text(PERSONA_HEADER), text("\nQuestions:\n"), lines, text("\n\n"), text(PERSONA_FOOTER), text("{{"), shape, text("}}"))(scope)
