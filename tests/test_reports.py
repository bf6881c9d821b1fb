"""Readers of report texts, indexes and workbooks' waves: what they take and what they refuse."""

import datetime as dt

import pytest

from augur.sources import readers

REPORT = "Do you approve or disapprove?\nBase: 1,204 voters\nApprove 41%\nDisapprove  55%\nUnsure: 4%\nProduced on May 7, 2026\n"


def pages(spark, *bodies):
    return spark.createDataFrame([(b,) for b in bodies], "body string")


def test_topline_report(spark):
    assert tuple(readers.topline_report(pages(spark, REPORT)).first()) == (dt.date(2026, 5, 7), 1204, 41.0, 55.0, 4.0)


@pytest.mark.parametrize(("old", "new", "problem"), [("1,204", "204", "small base"), ("55%", "45%", "add up"), ("approve or disapprove", "like", "wording")])
def test_refused_reports(spark, old, new, problem):
    with pytest.raises(Exception, match=problem):
        readers.topline_report(pages(spark, REPORT.replace(old, new))).collect()


def test_group_table(spark):
    found = readers.group_table(pages(spark, "x\n  January 2026   50.1 60.2\nFebruary 2026 51.0 61.0 \nMarch 2026 n/a 1.0\n"), ["a", "b"]).orderBy("month", "group").collect()
    assert [tuple(r) for r in found] == [(dt.date(2026, 1, 1), "a", 50.1), (dt.date(2026, 1, 1), "b", 60.2), (dt.date(2026, 2, 1), "a", 51.0), (dt.date(2026, 2, 1), "b", 61.0)]


def test_contiguous_months(spark):
    rows = spark.createDataFrame([(dt.date(2025, 12, 1), 3.0), (dt.date(2026, 1, 1), 3.5)], "month date, value double")
    assert readers.contiguous_months(rows, "2025-12-01", 0, 10).count() == 2
    for args, problem in ((("2025-11-01", 0, 10), "first month"), (("2025-12-01", 0, 3.2), "range")):
        with pytest.raises(Exception, match=problem):
            readers.contiguous_months(rows, *args).collect()
    with pytest.raises(Exception, match="gap"):
        readers.contiguous_months(rows.unionByName(spark.createDataFrame([(dt.date(2026, 3, 1), 3.0)], "month date, value double")), "2025-12-01", 0, 10).collect()


def test_complete_waves(spark):
    rows = [(dt.date(2026, 1, d), c, m, 0.5) for d in (1, 8) for c in "xy" for m in "pq" if (d, c, m) != (8, "y", "q")]
    found = readers.complete_waves(spark.createDataFrame(rows, "date date, cell string, measure string, value double"), ["x", "y"], ["p", "q"])
    assert {r["date"].day for r in found.collect()} == {1} and found.count() == 4


def test_catalogue_and_filters(spark):
    found = readers.catalogue(pages(spark, '{"trackers":[{"name":"b","slug":"s2","updated":0},{"name":"a","slug":"s1","updated":86400000}]}')).collect()
    assert [(r["name"], r["updated"].day) for r in found] == [("a", 2), ("b", 1)]
    with pytest.raises(Exception, match="without trackers"):
        readers.catalogue(pages(spark, '{"trackers":[]}')).collect()
    s = spark.createDataFrame([(1, {"a": "x", "b": "y"}, {"b": "y", "a": "x"}), (2, {"a": "x"}, {})], "id int, asked map<string,string>, applied map<string,string>")
    assert [r["id"] for r in readers.ignored_filters(s).collect()] == [2]
