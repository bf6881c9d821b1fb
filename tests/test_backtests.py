"""Boards on matched points, schedules, crowds of profiles, weighted panels, and the entry without the training-data operators."""

import datetime as dt
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from augur.operators import boards, crowd, panel, season

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
D = dt.date(2026, 8, 1)


def day(n):
    return D + dt.timedelta(days=n)


def test_a_trajectory_is_over_matched_points(spark):
    rows = [("s", day(i), e, float(v)) for i, by in enumerate(({"a": 1, "b": 3, "persistence": 2}, {"a": 9, "persistence": 2}, {"a": 3, "b": 1, "persistence": 2}, {"a": 5, "b": 5, "persistence": 4})) for e, v in by.items()]
    found = boards.matched_trajectory(spark.createDataFrame(rows, "series string, date date, entrant string, loss double"), ["series", "date"], ["persistence"]).collect()
    by = {(r["n"], r["entrant"]): (r["date"], r["loss"], r["skill"], r["place"]) for r in found}
    assert by[1, "a"] == (day(0), 1.0, 0.5, 1) and by[2, "a"] == (day(2), 2.0, 0.0, 1) and by[2, "b"] == (day(2), 2.0, 0.0, 2) and by[3, "persistence"][1] == pytest.approx(8 / 3)
    assert {n for n, _ in by} == {1, 2, 3} and len(by) == 9
    one = spark.createDataFrame(rows[:3], "series string, date date, entrant string, loss double")
    assert boards.matched_trajectory(one, ["series", "date"], ["persistence"]).count() == 0  # a line needs two points
    many = spark.createDataFrame([("s", day(i), e, 1.0) for i in range(100) for e in ("a", "persistence")], "series string, date date, entrant string, loss double")
    assert sorted({r["n"] for r in boards.matched_trajectory(many, ["series", "date"], ["persistence"]).collect()}) == sorted({max(round(c * 100 / 30), 1) for c in range(1, 31)})


def contract(spark, series, days=(), history=()):
    s = spark.createDataFrame([series], "series string, source string, weekday int, entry int, release int, hour int")
    frame = lambda values, name: spark.createDataFrame([(series[0], d) for d in values], f"series string, {name} date")
    r = season.schedule_contract(s, frame(days, "day"), frame(history, "date")).first()
    return r["weekday"], r["hour"], r["problem"]


def test_schedules_follow_calendars_that_the_waves_confirm(spark):
    tuesday, weekly = dt.date(2026, 8, 4), lambda first, n: [first + dt.timedelta(days=7 * i) for i in range(n)]
    dated = ("s", "field_dates", None, 1, 1, 14)
    assert contract(spark, dated, weekly(tuesday, 8)) == (1, 14, None)
    assert contract(spark, ("s", "field_dates", None, 1, 2, 14), weekly(tuesday, 9)) == (2, 14, None)
    assert contract(spark, dated, weekly(tuesday, 7))[2] == "too few waves" and contract(spark, ("s", "field_dates", None, None, None, None), weekly(tuesday, 8))[2] == "no calendar is recorded"
    late = weekly(tuesday, 8)
    late[-1] += dt.timedelta(days=1)
    assert contract(spark, dated, late)[2] is None  # one slip is allowed
    late[3] += dt.timedelta(days=1)
    assert contract(spark, dated, late)[2] == "slips"
    assert contract(spark, dated, [*weekly(tuesday, 6), *weekly(tuesday + dt.timedelta(days=56), 2)])[2] is None and contract(spark, dated, [tuesday + dt.timedelta(days=14 * i) for i in range(8)])[2] == "slips"
    with pytest.raises(Exception, match="must come before"):
        contract(spark, ("s", "field_dates", None, 1, 3, 14), weekly(tuesday, 8))
    friday = dt.date(2026, 8, 7)
    assert contract(spark, ("s", "sampled", 4, None, None, None), (), weekly(friday, 30)) == (4, 14, None)
    assert contract(spark, ("s", "sampled", 4, None, None, None), (), [friday - dt.timedelta(days=1), *weekly(friday, 26)])[2] is None  # beyond the last 26
    assert contract(spark, ("s", "sampled", 4, None, None, None), (), [friday - dt.timedelta(days=1), *weekly(friday, 25)])[2] == "read off its weekday on 2026-08-06"
    assert contract(spark, ("s", "sampled", 7, None, None, None), (), weekly(friday, 3))[2] == "no sampled weekday" and contract(spark, ("s", "feed", 4, 1, 1, 14))[2] == "no calendar is known"


def test_a_crowd_of_profiles_pools_complete_ones(spark):
    normal = lambda m, s=1.0: (m, s, None)
    rows = [("r", "a", {"x": normal(0.0), "y": normal(1.0)}), ("r", "b", {"x": normal(10.0), "y": normal(3.0), "z": normal(9.0)}), ("r", "c", {"x": normal(5.0)}), ("r", "d", {"x": normal(5.0), "y": normal(5.0, 0.0)}), ("q", "a", {"x": normal(0.0), "y": normal(0.0)})]
    f = spark.createDataFrame(rows, "round_id string, entrant string, profile map<string,struct<mean:double,sd:double,quantiles:map<string,double>>>")
    found = {(r["round_id"], r["cell"]): r for r in crowd.crowd_profiles(f, ["round_id"], ["x", "y"]).collect()}
    assert set(found) == {("r", "x"), ("r", "y")} and all(r["members"] == 2 for r in found.values())
    assert found["r", "x"]["mean"] == pytest.approx(5.0, abs=1e-4) and found["r", "y"]["mean"] == pytest.approx(2.0, abs=1e-4) and found["r", "x"]["quantiles"]["0.5"] == round(found["r", "x"]["quantiles"]["0.5"], 4)


def test_panels_are_weighted_for_their_population(spark):
    people = spark.createDataFrame([("a", 1.0, 0.5), ("b", 3.0, 0.0), ("c", 1.0, 1.0)], "id string, w double, registered double")
    weights = lambda p: {r["id"]: round(r["w"], 6) for r in panel.population_weights(people, p).collect()}
    assert weights("A") == weights(None) == weights("a") == {"a": 0.2, "b": 0.6, "c": 0.2}
    assert weights("RV") == weights("lv") == {"a": 0.333333, "b": 0.0, "c": 0.666667}
    with pytest.raises(Exception, match="left the panel empty"):
        panel.population_weights(people.withColumn("registered", F.lit(0.0)), "RV").collect()


def test_an_error_within_the_training_data_operators_is_not_their_absence(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "tests", "__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=copy, capture_output=True, text=True, check=False)
    every = run()
    if (copy / "augur/llm").exists():
        (copy / "augur/llm/words.py").write_text("import no_such_package\n")
        assert "no_such_package" in run().stderr
        shutil.rmtree(copy / "augur/llm")
        (copy / "corpus_pipeline.py").unlink()
        rest = run()
        assert rest.returncode == 0 and int(rest.stdout) < int(every.stdout)
