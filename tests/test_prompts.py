"""Prompts: sections, nested lists, conditions, and what is refused."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from augur.operators import prompts

SEARCH = "struct<asof:string,results:array<struct<query:string,results:array<struct<title:string,published:string,content:string>>>>>"


@pytest.fixture
def rounds(spark):
    history = [(dt.date(2026, 8, d), v) for d, v in ((1, 40.0), (8, 41.25))]
    found = (None, [("q one", [("T", "2026-08-09T01:00Z", " a  b\n"), (None, None, "")]), ("q two", [])])
    schema = f"series string, publisher string, question string, unit string, methodology string, release_at string, history array<struct<date:date,value:double>>, news struct<asof:string,text:string>, search {SEARCH}"
    return spark.createDataFrame([("s", "P", "Q?", "%", None, "2026-08-15T14:00:00Z", history, ("now", "- x"), found), ("t", None, None, None, None, "2026-08-15", None, (None, ""), (None, []))], schema)


def of(rounds, prompt, series="s"):
    return rounds.where(F.col("series") == series).select(prompt).first()[0]


def test_number_prompts(rounds):
    whole = of(rounds, prompts.number_prompt(rounds))
    assert whole == (
        "You are forecasting the next scheduled release of a public opinion tracker.\nPublished by: P\nQuestion: Q?\nUnit: %\nHow the tracker is measured: not stated\nRelease schedule: not stated\nScheduled release date: 2026-08-15\n"
        "Recent published values of this series (oldest first, one point per release):\n  2026-08-01: 40.0\n  2026-08-08: 41.25\n"
        'Give your predictive distribution over the value that will be released. Reply with exactly one JSON object and no other text:\n{"mean": <number>, "sd": <number>}\nsd is your standard deviation in the same unit and must be greater than 0.'
    )
    assert "(none)\nGive" in of(rounds, prompts.number_prompt(rounds), "t") and "Published by: not stated" in of(rounds, prompts.number_prompt(rounds), "t")
    bare = of(rounds, prompts.number_prompt(rounds, "none", "superfc"))
    assert "No history of this series" in bare and "41.25" not in bare and "4. Calibrate." in bare
    asked = of(rounds, prompts.query_prompt(rounds))
    assert asked.startswith(whole.split("Give your")[0]) and asked.endswith("Ask for what would actually change your estimate.\n") and "At most 3 queries" in asked


def test_conditions_carry_what_makes_them_one(rounds):
    assert "as the pages stood at now." in of(rounds, prompts.number_prompt(rounds, "news"))
    web = of(rounds, prompts.number_prompt(rounds, "web"))
    assert 'retrieved at lock time.' in web and '  Query: "q one"\n    - T (2026-08-09)\n      a b\n    - untitled\n  Query: "q two"\n    (no results)\nGive' in web
    for context in ("news", "web"):
        with pytest.raises(Exception, match=f"the {context} condition needs"):
            of(rounds, prompts.number_prompt(rounds, context), "t")
        with pytest.raises(ValueError, match="needs a column"):
            prompts.number_prompt(rounds.drop("news", "search"), context)
    with pytest.raises(ValueError, match="unknown context"):
        prompts.number_prompt(rounds, "all")
    with pytest.raises(ValueError, match="unknown elicitation"):
        prompts.number_prompt(rounds, "none", "loud")


def test_profile_and_list_prompts(spark):
    cells = [("dem", "Democrats", [(dt.date(2026, 8, 1), -80.5)]), ("ind", None, [])]
    profile = spark.createDataFrame([("2026-08-15", cells)], "release_at string, cells array<struct<id:string,label:string,history:array<struct<date:date,value:double>>>>")
    text = profile.select(prompts.profile_prompt(profile)).first()[0]
    assert "(oldest first, one point per release):\n  dem  (Democrats)\n    2026-08-01: -80.5\n  ind\n    (none)\nGive a predictive distribution for every subgroup" in text and "all 2 subgroups below" in text and '{"<subgroup id>": {"mean"' in text
    assert "The subgroups to forecast are:\n  dem\n  ind\nGive" in profile.select(prompts.profile_prompt(profile, "none")).first()[0]
    weeks = [(f"2026-08-{d:02d}", ["A", "B"]) for d in (2, 9)]
    ranking = spark.createDataFrame([("2026-08-15", "a", "b", 2, "Any title.\n", weeks)], "release_at string, week_start string, week_end string, length int, universe string, weeks array<struct<date:string,items:array<string>>>")
    text = ranking.select(prompts.ranking_prompt(ranking)).first()[0]
    assert "Any title.\nThe true ranked list" in text and "  week ending 2026-08-02\n    1. A\n    2. B\n  week ending 2026-08-09\n    1. A\n    2. B\nGive exactly 2 items" in text


def test_personas_and_numbers(spark):
    asked = spark.createDataFrame([("A voter.", [("k", "Do you?", ["yes", "no"]), ("m", "And?", ["a"])])], "persona string, items array<struct<key:string,text:string,options:array<string>>>")
    text = asked.select(prompts.persona_prompt(asked)).first()[0]
    assert "would.\n\nA voter.\n\nAnswer" in text and text.endswith('Questions:\n- k: Do you?\n  Options: yes / no\n- m: And?\n  Options: a\n\nReply with exactly one JSON object and no other text, using one of the listed options for each key:\n{"k": "<yes / no>", "m": "<a>"}')
    values = [40.0, 0.0, -0.5, 12345678.25, 0.0005, 5430000.0, 98765432.0]
    assert [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(prompts.number(F.col("v"))).collect()] == [repr(v) for v in values]
