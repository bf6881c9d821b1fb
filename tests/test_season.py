"""Answers, the manifest, the registry and workbooks beyond what the queries show: refusals, ties, nulls, empties."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from augur.operators import answers, boards, season
from augur.sources import documents, registry


def test_numbers_are_stored_as_answered(spark):
    said = [('{"mean": 7.9, "sd": 0.004}', None), ('{"mean": 1, "sd": 0}', "sd"), ('x {"a": {"mean": 1, "sd": 1}} y', None), ("none", "no JSON object"), (None, "no JSON object"), ('{"mean": 1e9, "sd": 1}', "mean"), ('{"mean": 1}', "needs mean and sd")]
    rows = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(said)], "i int, reply string").orderBy("i").select(answers.number_answer(F.col("reply")).alias("a")).collect()
    assert [r["a"]["problem"] for r in rows] == [p for _, p in said] and (rows[0]["a"]["mean"], rows[0]["a"]["sd"]) == (7.9, 0.004)


def test_lists_are_never_mended(spark):
    replies = ['{"ranking": ["roblox", "Main_Page"]}', '{"ranking": ["roblox", " Roblox "]}', '{"ranking": ["roblox", ""]}', '["a b", "c"]', '{"ranking": [["a"], "b"]}', None]
    found = answers.with_ranking(spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string"), 2, exclusions="main_page_and_namespaces_v1").orderBy("i").collect()
    assert [(r["problem"], r["items"]) for r in found] == [("excluded", None), ("repeated", None), ("title", None), (None, ["A_b", "C"]), ("not a list of strings", None), ("no ranking", None)]


def test_ids(spark):
    models = spark.createDataFrame([("m",), ("m-news",)], "model string")
    ids = ["m", "m-web", "m-news-superfc", "m-persona", "m-zeroshot-persona", "x-web"]
    found = {r["entrant"]: (r["model"], r["context"], r["elicitation"]) for r in answers.resolved_ids(spark.createDataFrame([(i,) for i in ids], "entrant string"), models).collect()}
    assert found == {"m": ("m", "recent10", "direct"), "m-web": ("m", "web", "direct"), "m-news-superfc": ("m", "news", "superfc"), "m-persona": (None, None, None), "m-zeroshot-persona": ("m", "none", "persona"), "x-web": (None, None, None)}
    assert spark.range(1).select(answers.entrant_id(F.lit("m"), F.lit("web"), F.lit("persona"))).first()[0] is None


def test_teams_take_the_first_member_that_answered(spark):
    scores = spark.createDataFrame([("r1", "a", 2.0), ("r1", "b", 1.0), ("r2", "b", 3.0), ("r2", "z", 9.0)], "round_id string, entrant string, loss double")
    members = spark.createDataFrame([("t", "a", 1), ("t", "b", 2)], "team string, entrant string, place int")
    assert sorted(map(tuple, boards.as_teams(scores, members).collect())) == [("r1", "t", 2.0), ("r2", "t", 3.0), ("r2", "z", 9.0)]


def test_behavioural_weeks(spark):
    good = ("2026-09-20T12:00:00Z", "2026-09-28T15:00:00Z")
    rows = [
        ("wiki-2026-09-27", "wikipedia", *good, None), ("wiki-2026-09-26", "wikipedia", *good, "week ends on another day"), ("wiki", "wikipedia", *good, "no week"), ("wiki-2026-09-27", "wikipedia", "2026-09-21T00:00:00Z", good[1], "locks within the measured week"),
        ("trends-2026-09-26", "trends", "2026-09-19T12:00:00Z", "2026-09-25T15:00:00Z", "releases before the week ends"), ("x", "civiqs", "2026-09-23T12:00:00Z", "2026-09-25T12:00:00Z", None), ("x", "civiqs", "2026-09-22T12:00:00Z", "2026-09-24T12:00:00Z", "not a Friday"),
        ("x", "umich", "2026-09-22 12:00", "2026-09-24T12:00:00Z", "stamp"), ("x", "umich", "2026-09-22T12:00:00Z", "2026-09-24T13:00:00Z", "not 48 hours"), ("x", "umich", "2026-09-22T12:00:00Z", "2026-09-22T12:00:00Z", "lock not before release"),
    ]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, round_id string, source string, lock_at string, release_at string, want string")
    frame = frame.withColumns({"target_type": F.lit("continuous_normal"), "tracker": F.lit("t"), "week_start": F.lit(None).cast("date"), "week_end": F.lit(None).cast("date")})
    assert all(r["got"] == r["want"] for r in frame.select("want", season.schedule_problem().alias("got")).collect())


def test_monthly_rounds_refuse_a_release_in_its_own_month(spark):
    horizons = spark.createDataFrame([("s", "sce", "1y")], "series string, prefix string, suffix string")
    releases = spark.createDataFrame([("2026-10", dt.date(2026, 10, 8))], "month string, day date")
    with pytest.raises(Exception, match="follow its month"):
        season.monthly_candidates(horizons, releases, spark.createDataFrame([], "round_id string"), "2026-09", "2026-10-01", 3).collect()


def test_runs_with_a_broken_digest_are_refused(spark):
    lines = spark.createDataFrame([("f", 1, "e", "zz", None)], "file string, line int, entrant string, prompt_sha256 string, topline double")
    with pytest.raises(Exception, match="invalid record"):
        season.restored_runs(lines, lines)[0].collect()


def test_panel_spread_and_plan(spark):
    sd = spark.createDataFrame([(3.0, 4.0), (3.0, None), (0.1, 0.1)], "se double, step double").select(season.panel_sd(F.col("se"), F.col("step"))).collect()
    assert [r[0] for r in sd] == [5.0, 6.0, 0.5]
    with pytest.raises(Exception, match="without a start"):
        season.task_plan(spark.createDataFrame([("s", dt.date(2026, 1, d), 1.0) for d in range(1, 12)], "series string, date date, value double"), spark.createDataFrame([("e", None)], "entrant string, start date")).collect()


def test_registry(spark):
    table = spark.createDataFrame([(dt.date(2026, 1, 1), 40.0, 30.0), (dt.date(2026, 1, 8), 35.1, None)], "date date, bull double, bear double")
    specs = [s for s in registry.REGISTRY if s.source == "aaii"]
    obs = registry.build_all({"aaii": table}, specs)
    assert [tuple(r) for r in obs.collect()] == [("aaii_bull_bear_spread", dt.date(2026, 1, 1), 10.0)]
    with pytest.raises(ValueError, match="umich"):
        registry.build_all({"aaii": table}, registry.REGISTRY, unavailable=[s.source for s in registry.REGISTRY if s.source not in ("aaii", "umich")])
    assert [r[0] for r in registry.empty_series(obs, [*specs, registry.Series("none", "x")], spark).collect()] == ["none"]
    assert len({s.series for s in registry.REGISTRY}) == len(registry.REGISTRY) == 77


SHEET = "subgroup string, pollster string, sponsors string, population string, start_date string, end_date string, n string, approve string, disapprove string, row long"


def sheet(spark, *rows):
    base = {"subgroup": "All polls", "pollster": "YouGov", "sponsors": "The Economist", "population": "A", "start_date": "9/4/2026", "end_date": "9/7/2026", "n": "1500", "approve": "40.5", "disapprove": "55.25"}
    return spark.createDataFrame([tuple({**base, "row": i, **r}[c.split()[0]] for c in SHEET.split(", ")) for i, r in enumerate(rows)], SHEET)


def series_of(spark, *rows):
    table = sheet(spark, *rows)
    found = registry.build_all({"sb_approval": table}, [s for s in registry.REGISTRY if s.source == "sb_approval"]).collect()
    return {(r["series"], str(r["date"])): r["value"] for r in found}


def test_polls_of_other_sponsors_and_bases_are_other_series(spark):
    """Sponsors are parts of the text, populations and cuts whole ones; all regardless of case."""
    found = series_of(spark, {}, {"sponsors": "CBS News", "approve": "1"}, {"sponsors": None, "approve": "2"}, {"population": " rv ", "subgroup": "voters", "approve": "43"}, {"population": "RV", "start_date": "9/11/2026", "end_date": "9/14/2026", "approve": "42"})
    assert found == {("yougov_approval", "2026-09-05"): 40.5, ("yougov_rv_approval", "2026-09-05"): 43.0, ("yougov_rv_approval", "2026-09-12"): 42.0}


def test_a_moved_base_starts_where_it_became_the_published_one(spark):
    stray = {"subgroup": "Strong", "population": "RV", "start_date": "2/1/2025", "end_date": "2/4/2025"}
    assert series_of(spark, stray, {"subgroup": "strong", "population": "RV", "approve": "21"}) == {("yougov_rv_strong_approval", "2026-09-05"): 21.0}


def test_of_one_date_the_poll_that_ended_last_holds(spark):
    first, long, later_row = {"approve": "30"}, {"start_date": "9/3/2026", "end_date": "9/8/2026", "approve": "31"}, {"approve": "32"}
    assert series_of(spark, first, later_row) == {("yougov_approval", "2026-09-05"): 32.0}
    assert series_of(spark, first, long, later_row) == {("yougov_approval", "2026-09-05"): 31.0}
    assert not series_of(spark, {"approve": "x"}, {"disapprove": ""}, {"end_date": "9/1/2026"}, {"start_date": "2026-09-04"})


CAPTURE = "key string, capture_day date, end_date date, choices array<string>, points array<struct<date:date,values:array<double>>>, net struct<plus:array<string>,less:array<string>>"


def captures(spark, *rows):
    return spark.createDataFrame([(registry.APPROVAL, d, e, c, p, n) for d, e, c, p, n in rows], CAPTURE)


def shown(spark, *rows, series="civiqs_net_approval"):
    specs = [s for s in registry.REGISTRY if s.series == series]
    specs = [registry.dataclasses.replace(s, key=registry.APPROVAL) for s in specs]
    return {str(r["date"]): r["value"] for r in registry.build_all({"civiqs": captures(spark, *rows)}, specs).collect()}


def test_a_revised_history_moves_no_point_that_was_displayed(spark):
    """Fridays as the first capture from that day on shows them; a capture that ends the day before shows its own last day."""
    day, two = (lambda d: dt.date(2026, 8, d)), ["Approve", "Disapprove"]
    points = lambda base, *days: [(day(d), [float(base + d), 10.0]) for d in days]
    first = (day(13), day(12), two, points(0, *range(1, 13)), None)  # a Thursday
    second = (day(14), day(13), two, points(100, *range(5, 14)), None)  # Friday: shows Thursday
    third = (day(22), day(21), two, points(200, *range(12, 22)), None)  # the Friday before was captured a day late
    assert shown(spark, first) == {"2026-08-07": -3.0}
    assert shown(spark, first, second) == {"2026-08-07": -3.0, "2026-08-14": 103.0}
    assert shown(spark, first, second, third) == {"2026-08-07": -3.0, "2026-08-14": 103.0, "2026-08-21": 211.0}
    gap = (day(31), day(30), two, points(300, 29, 30), None)  # its tail has no point for the 28th: skipped
    assert shown(spark, first, second, third, gap).keys() == {"2026-08-07", "2026-08-14", "2026-08-21"}


def test_nets_are_declared_and_never_guessed(spark):
    day, five = dt.date(2026, 8, 7), ["Very good", "Fairly good", "Fairly bad", "Very bad", "Unsure"]
    point = [(day, [10.0, 20.0, 15.5, 30.25, 4.0])]
    assert shown(spark, (day, day, five, point, None), series="civiqs_net_econ_now") == {"2026-08-07": -15.75}
    assert shown(spark, (day, day, five, point, (["Very good"], ["Unsure"]))) == {"2026-08-07": 6.0}
    assert not shown(spark, (day, day, five, [(day, [10.0, None, 1.0, 1.0, 1.0])], None), series="civiqs_net_econ_now")
    with pytest.raises(Exception, match="no net"):
        shown(spark, (day, day, five, point, None))
    with pytest.raises(Exception, match="not in a capture"):
        shown(spark, (day, day, five[:3], [(day, [1.0, 2.0, 3.0])], None), series="civiqs_net_econ_now")
    assert shown(spark, (day, None, ["Angry", "Proud"], [(day, [33.0, 4.0])], None), series="civiqs_angry_share") == {"2026-08-07": 33.0}


def retail(spark, marks):
    cells = [(9, c, m) for c, m in marks.items()] + [(12, "A", "441"), (12, "B", "Motor  vehicle"), (12, "E", "5"), (12, "J", "1.5"), (12, "K", "(S)"), (12, "L", "3"), (14, "A", "444"), (14, "B", "Building"), (15, "B", " stores"), (15, "J", "7"), (15, "K", "8"), (15, "L", "9"), (16, "A", "999"), (16, "J", "1")]
    return documents.retail_release(spark.createDataFrame([("p", "s", r, c, t) for r, c, t in cells], "path string, sheet string, row int, column string, text string"), ["441", "444"])


def test_retail_releases_are_read_by_their_marks(spark):
    marks = {"E": "(a)", "F": "(p)", "J": " (a) ", "K": "(p)", "L": "(r)"}
    found = {(r["code"], r["measure"]): r["value"] for r in retail(spark, marks).collect()}
    assert found == {("441", "nsa_advance"): 5.0, ("441", "nsa_preliminary"): None, ("441", "sa_advance"): 1.5, ("441", "sa_preliminary"): None, ("441", "sa_revised"): 3.0, ("444", "nsa_advance"): None, ("444", "nsa_preliminary"): None, ("444", "sa_advance"): 7.0, ("444", "sa_preliminary"): 8.0, ("444", "sa_revised"): 9.0}
    assert {r["label"] for r in retail(spark, marks).collect()} == {"Motor vehicle", "Building stores"}
    with pytest.raises(Exception, match="mark its columns"):
        retail(spark, {k: v for k, v in marks.items() if k != "L"}).collect()
