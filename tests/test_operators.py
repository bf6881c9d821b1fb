"""Operators by small gold cases: refusals, ties, folds, freezes."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from augur.functions import calendar as C
from augur.functions import text as T
from augur.operators import boards, crowd, health, nulls, panel, polls, profiles, rankings, resolution, rules
from augur.plans import registry
from augur.plans.fixtures import profile_cells
from augur.sources import documents, readers, sinks


def day(n):
    return dt.date(2026, 1, 1) + dt.timedelta(days=n)


def series(spark, values, name="s", step=1):
    return spark.createDataFrame([(name, day(i * step), float(v)) for i, v in enumerate(values)], "series string, date date, value double")


def test_nulls_against_plain_code(spark):
    rnd = random.Random(4)
    values = [50 + rnd.gauss(0, 3) for _ in range(40)]
    found = {r["date"]: r for r in nulls.with_nulls(series(spark, values), places=None).collect()}
    past = values[:30]
    r = found[day(30)]
    xs, ys = list(range(22, 30)), past[-8:]
    slope, icept = np.polyfit(xs, ys, 1)
    level = past[0]
    for v in past[1:]:
        level = 0.4 * v + 0.6 * level
    assert r["persistence_mean"] == past[-1] and r["persistence_sd"] == 1.5
    assert r["trend_mean"] == pytest.approx(icept + slope * 30)
    rse = math.sqrt(sum((y - icept - slope * x) ** 2 for x, y in zip(xs, ys, strict=True)) / 6)
    assert r["trend_sd"] == pytest.approx(max(1.5 * rse, 1) * math.sqrt(1 + 1 / 30))
    assert r["ewma_mean"] == pytest.approx(level) and r["climatology_mean"] == pytest.approx(np.mean(past[-24:])) and r["climatology_sd"] == pytest.approx(np.std(past[-24:], ddof=1))
    assert found[day(0)]["persistence_mean"] is None and found[day(2)]["trend_mean"] == values[1] and found[day(1)]["climatology_sd"] == 1.0


def test_trend_is_clamped(spark):
    obs = spark.createDataFrame([("s", day(i), float(i)) for i in range(10)] + [("s", day(9 + 60), 0.0)], "series string, date date, value double")
    r = nulls.with_nulls(obs, places=None).where(F.col("date") == day(69)).first()
    assert r["trend_mean"] == pytest.approx(9 + 21) and r["trend_sd"] == pytest.approx(math.sqrt(1 + 60 / 30))


def test_warmup_comes_before_since(spark):
    found = nulls.walk_forward(series(spark, range(20)), F.lit(day(10)).cast("date"))
    assert found.agg(F.min("date")).first()[0] == day(10) and found.count() == 40


def test_noise_floor_recovers(spark):
    rnd = random.Random(11)
    level, values = 0.0, []
    for _ in range(4000):
        level += rnd.gauss(0, 0.5)
        values.append(level + rnd.gauss(0, 2.0))
    r = nulls.noise_floor(series(spark, values)).first()
    assert r["noise"] == pytest.approx(2.0, abs=0.1) and r["movement"] == pytest.approx(0.5, abs=0.2)
    assert nulls.noise_floor(series(spark, [1, 2, 3])).count() == 0


def test_house_effects_shrink_and_include_themselves(spark):
    rows = [("a", day(0), day(0), 1000, 50.0), ("b", day(0), day(0), 1000, 54.0), ("c", day(0), day(0), 0, 90.0)]
    p = spark.createDataFrame(rows, "pollster string, date date, end_date date, n int, value double")
    found = {r["pollster"]: r["effect"] for r in polls.house_effects(p, polls.anchor_of(p)).collect()}
    assert found == pytest.approx({"a": -0.5, "b": 0.5, "c": 9.5})
    average = polls.adjusted_average(p, spark.createDataFrame([(day(0),), (day(60),)], "asof date"), polls.house_effects(p, polls.anchor_of(p))).orderBy("asof").collect()
    assert average[0]["value"] == pytest.approx(52.0) and average[0]["polls"] == 2 and average[1]["value"] is None


def test_one_poll_a_date(spark):
    p = spark.createDataFrame([("x", day(0), day(2), 1.0), ("y", day(0), day(2), 2.0), ("z", day(0), day(1), 3.0)], "pollster string, date date, end_date date, value double")
    assert polls.to_series(p).first()["value"] == 2.0


def test_deadlines(spark):
    locks = ["2026-09-14 12:00:00", "2026-09-14 12:00:01", "2026-09-20 00:00:00"]
    found = spark.createDataFrame([(x,) for x in locks], "t string").select(F.col("t").cast("timestamp").alias("t")).select(F.date_format(C.deadline_for(F.col("t")), "yyyy-MM-dd HH"), C.batch_of(F.col("t")), C.governed_by_batch(F.col("t"))).collect()
    assert [tuple(r) for r in found] == [("2026-09-07 12", "batch-2026-09-07", False), ("2026-09-14 12", "batch-2026-09-14", True), ("2026-09-14 12", "batch-2026-09-14", True)]
    assert spark.range(1).select(C.iso_week(F.lit("2027-01-01").cast("date"))).first()[0] == "2026-W53"


def scored(spark, rows):
    return spark.createDataFrame(rows, "round_id string, entrant string, loss double")


def test_pairwise_ties(spark):
    rows = [("r", "a", 1.0), ("r", "b", 2.0), ("r", "c", 3.0), ("r", "d", 3.0), ("r", "e", 9.0), ("alone", "a", 1.0)]
    found = {r["entrant"]: r for r in boards.pairwise_points(scored(spark, rows)).collect()}
    assert found["c"]["points"] == found["d"]["points"] == 37.5 and found["c"]["top3"] == 0.5 and found["a"]["points"] == 100 and found["e"]["points"] == 0
    assert boards.pairwise_board(scored(spark, rows)).where("entrant = 'c'").first()["place"] == 3


def test_missing_answers(spark):
    rows = [("1", "a", 1.0), ("1", "b", 2.0), ("2", "a", 1.0), ("2", "c", 2.0), ("1", "persistence", 2.0), ("2", "persistence", 2.0)]
    live = {r["entrant"]: r["skill"] for r in boards.mean_of_skills(scored(spark, rows)).collect()}
    assert live["a"] == 0.5 and live["b"] == 0.0
    pairwise = {r["entrant"]: r["pairwise"] for r in boards.pairwise_board(scored(spark, rows)).collect()}
    assert pairwise["a"] == 100 and pairwise["b"] == pairwise["c"] == 12.5


def test_main_board_boundary(spark):
    rows = [("r1", "a", "2026-09-01 00:00:00", "number", 1.0, 2.0), ("r2", "a", "2026-09-14 12:00:00", "number", 1.4, 2.0), ("r3", "a", "2026-09-15 00:00:00", "profile", 1.4, 2.0), ("r4", "b", "2026-09-16 00:00:00", "number", 2.1, 2.0)]
    s = spark.createDataFrame(rows, "round_id string, entrant string, t string, shape string, loss double, null_loss double").withColumn("lock_at", F.col("t").cast("timestamp"))
    found = {r["entrant"]: r for r in boards.main_board(s, "2026-09-14 12:00:00").collect()}
    assert found["a"]["skill"] == pytest.approx(0.3) and found["b"]["skill"] == pytest.approx(-0.05) and found["a"]["answered"] == pytest.approx(2 / 3) and found["a"]["mean_crps"] == 1.4


def test_spearman(spark):
    rows = [("g", i, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (2, 2), (2, 3), (4, 4)])] + [("two", 1, 1.0, 1.0), ("two", 2, 2.0, 2.0), *[("flat", i, 1.0, float(i)) for i in range(4)]]
    found = {r["g"]: r["rho"] for r in boards.spearman(spark.createDataFrame(rows, "g string, i int, x double, y double"), ["g"], "x", "y").collect()}
    assert found["g"] == pytest.approx(0.9486832980505138) and found["two"] is None and found["flat"] is None


def test_energy(spark):
    assert profiles.energy(np.array([[3.0], [4.0]]), np.zeros(2)) == 5
    rnd = np.random.default_rng(3)
    x, y = rnd.normal(size=(3, 20)), rnd.normal(size=3)
    brute = np.mean([np.linalg.norm(x[:, i] - y) for i in range(20)]) - 0.5 * np.mean([[np.linalg.norm(x[:, i] - x[:, j]) for i in range(20)] for j in range(20)])
    assert profiles.energy(x, y) == pytest.approx(brute)
    s = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in x])
    assert spark.range(1).select(profiles.energy_native(s, F.array(*[F.lit(float(v)) for v in y]))).first()[0] == pytest.approx(brute)


def test_profile_shift_is_all_level(spark):
    cells = spark.createDataFrame([(1, c, 10.0 + c, 1.0, 15.0 + c) for c in range(4)], "id int, cell int, mean double, sd double, outcome double")
    v = profiles.with_energy(profiles.vectors(profiles.cell_samples(cells, 60), ["id"]))
    r = v.select("structure", profiles.level_score(F.col("samples"), F.col("outcome")).alias("level")).first()
    assert r["level"] == pytest.approx(5, abs=0.5) and r["structure"] < 0.6
    with pytest.raises(Exception, match="positive"):
        profiles.cell_samples(cells.withColumn("sd", F.lit(0.0)), 10).collect()


def test_every_profile_is_scored(spark, tmp_path):
    rnd = np.random.default_rng(5)
    data = [(i, [float(v) for v in rnd.normal(size=20)], 1) for i in (0, 59, 60, 61, 5000)]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    cells = profile_cells(spark, str(tmp_path))
    drawn = profiles.with_energy(profiles.vectors(profiles.cell_samples(cells), ["vec_id"])).withColumn("level", profiles.level_score(F.col("samples"), F.col("outcome")))
    expected = {r["vec_id"]: [r["energy"], r["structure"], r["level"]] for r in drawn.collect()}
    found = {r["vec_id"]: [r["energy"], r["structure"], r["level"]] for r in registry.QUERIES["profile_scores"](spark, str(tmp_path)).collect()}
    joint = {r["vec_id"]: [r["energy"], r["structure"], r["level"]] for r in profiles.joint_scores(cells, ["vec_id"]).collect()}
    assert sorted(found) == sorted(joint) == [0, 59, 60, 61, 5000]
    assert all(joint[k] == pytest.approx(expected[k]) and found[k] == pytest.approx(joint[k], abs=1e-5) for k in expected)
    assert {r["entrant"]: r["rounds"] for r in registry.QUERIES["profile_board"](spark, str(tmp_path)).collect()} == {"own": 5, "persistence": 5}


def test_crowd_needs_two(spark):
    f = spark.createDataFrame([("r", "a", (0.0, 1.0, {})), ("r", "b", (2.0, 1.0, {"0.5": 2.0})), ("q", "a", (0.0, 1.0, {}))], "round_id string, entrant string, topline struct<mean:double,sd:double,quantiles:map<string,double>>")
    found = crowd.crowd_numbers(f, ["round_id"]).collect()
    assert [r["round_id"] for r in found] == ["r"] and found[0]["mean"] == pytest.approx(1.0, abs=1e-4) and found[0]["quantiles"]["0.975"] == 2.0


def test_budget_skips_and_goes_on(spark):
    jobs = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(c)).alias("cost"), F.lit(f"j{i}").alias("id")) for i, c in enumerate([4, 9, 4, 1, 4])])
    assert spark.range(1).select(health.affordable(jobs, 10.0)).first()[0] == ["j0", "j2", "j3"]


def test_resolution(spark):
    obs = series(spark, [1, 2, 3, 4, 5], "x")
    rounds = spark.createDataFrame([("r", "x", day(2), day(3)), ("late", "x", day(9), day(9))], "round_id string, series string, freeze_date date, release_date date")
    assert [tuple(r) for r in resolution.frozen_value(obs, rounds).where("round_id = 'r'").collect()] == [("r", day(1), 2.0)]
    months = spark.createDataFrame([("u", dt.date(2026, 7, 1), 42.8), ("u", dt.date(2026, 8, 1), 40.2), ("u", dt.date(2026, 9, 1), 35.2), ("f", dt.date(2026, 8, 1), 40.2), ("c", dt.date(2026, 9, 11), 1.0), ("c", dt.date(2026, 9, 18), 2.0), ("n", dt.date(2026, 8, 1), 1.0)], "series string, date date, value double")
    due = spark.createDataFrame([(s, s, dt.date(2026, 9, 16), s == "c") for s in "ufcn"], "round_id string, series string, lock_day date, daily boolean")
    frozen = spark.createDataFrame([("u", dt.date(2026, 7, 1), 42.8), ("u", dt.date(2026, 8, 1), 39.1), ("f", dt.date(2026, 8, 1), 39.1), ("c", dt.date(2026, 9, 4), 0.5), ("n", dt.date(2026, 8, 1), 1.0)], "round_id string, date date, value double")
    # a new period goes before a revision, a revision counts where there is none, and a daily source needs a reading from the lock on
    assert sorted(map(tuple, resolution.first_release(months, due, frozen).collect())) == [("c", dt.date(2026, 9, 18), 2.0), ("f", dt.date(2026, 8, 1), 40.2), ("u", dt.date(2026, 9, 1), 35.2)]
    assert resolution.cell_outcomes(obs, rounds).count() == 1
    claims = spark.createDataFrame([("a", "x", day(3), 2), ("b", "x", day(3), 1), ("c", "y", day(3), 3)], "round_id string, series string, observed_date date, season_order int")
    prior = spark.createDataFrame([("x", day(3), True), ("y", day(3), False)], "series string, observed_date date, voided boolean")
    assert [r["round_id"] for r in resolution.one_claim(claims, prior).collect()] == ["b"]


def test_rankings(spark):
    totals = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 9), (2, "a", 1)], "w int, item string, views long")
    assert [(r["place"], r["item"]) for r in rankings.top_n(totals, ["w"], "item", "views", 2).orderBy("place").collect()] == [(1, "c"), (2, "a")]
    problems = spark.createDataFrame([(["a", "a", "z"],), (["a", "b"],)], "l array<string>").select(rankings.list_problems(F.col("l"), F.lit(["a", "b"]), F.lit(["z"]), 2)).collect()
    assert [r[0] for r in problems] == [["length", "duplicate", "outside_basket", "excluded"], []]


def test_panel(spark):
    rows = [("i", "approve", 2.0), ("i", "disapprove", 1.0), ("i", "unsure", 1.0), ("j", "approve", 1.0)]
    a = spark.createDataFrame(rows, "item string, option string, w double")
    assert a.where("item = 'i'").agg(panel.net_share(["approve"], ["disapprove"])).first()[0] == 25
    assert panel.sentiment_index(a, [], "approve", "disapprove").first()["index"] == pytest.approx((125 + 200) / 6.7558 + 2.0)
    assert set(panel.AGGREGATORS) >= {"approve_share", "net_approve_share", "party_margin"} and panel.renormalised(a, F.col("item") == "i").agg(F.sum("w")).first()[0] == pytest.approx(1)


def test_rules(spark):
    t = spark.createDataFrame([(1, "low"), (2, "high"), (3, "?"), (4, None)], "id int, level string")
    assert [r[0] for r in t.orderBy("id").select(rules.at_least(F.col("level"), "high", ["low", "high"])).collect()] == [False, True, False, None]


def test_text(spark):
    t = spark.createDataFrame([("  foo  bar_",), ("Éa b",), ("donald TRUMP",), ("_ _",), ("x" * 256,), ("x" * 257,), (None,)], "t string").select(T.canonical_title(F.col("t")), T.title_problem(F.col("t"))).collect()
    assert [tuple(r) for r in t] == [("Foo_bar", None), ("Éa_b", None), ("Donald_TRUMP", None), (None, "empty"), ("X" + "x" * 255, None), (None, "too long"), (None, "missing")]
    with pytest.raises(ValueError, match="unknown exclusion rule"):
        T.excluded(F.lit("x"), "other")
    m = spark.range(1).select(T.strip_markup(F.lit("[[A|The ''A'']] met [[B]] {{cite|x}} <ref>z</ref> [https://x.org here] {{ill|Name|ar|x}} <b>b</b> [https://y.org]"))).first()[0]
    assert m == "The A met B (here) Name b"
    assert spark.range(1).select(T.strip_junk(F.lit(")]}',\n{\"a\":1}"))).first()[0] == '{"a":1}'
    said = [("HTTP 503 oh", "provider HTTP 503", False), ("Read timed  out", "provider timeout", False), ("HTTP 404", "provider HTTP 404", True), ("HTTP 429: insufficient_quota", "provider HTTP 429", True), ("status: 401", "provider call failed", False), ("no OPEN_KEY in the environment", "provider credential not configured", True), ("page structure changed", "provider call failed", False), (None, "provider call failed", False)]
    e = spark.createDataFrame([(i, m) for i, (m, _, _) in enumerate(said)], "i int, m string").orderBy("i").select(T.public_error(F.col("m")), T.terminal(F.col("m")), T.terminal(F.col("m"), source=True)).collect()
    assert [(r[0], r[1]) for r in e] == [x[1:] for x in said] and e[6][2]


def test_readers(spark, tmp_path):
    raw = spark.createDataFrame([("January (P)", "2026", "50.5"), ("February", "2026", "x"), ("March", "2026", "51")], "month string, year string, value string")
    assert [(r["date"].month, r["value"], r["preliminary"]) for r in readers.monthly(raw).orderBy("date").collect()] == [(1, 50.5, True), (3, 51.0, False)]
    body = '{"timeline":[{"time":1767225600,"value":[5]},{"time":1767830400,"value":[6],"isPartial":true}]}'
    t = readers.weekly_timeline(spark.createDataFrame([("q", ")]}'\n" + body)], "query string, body string"))
    assert [(r["value"], r["partial"]) for r in t.orderBy("week_start").collect()] == [(5.0, False), (6.0, True)]
    with pytest.raises(Exception, match="gap"):
        readers.weekly_timeline(spark.createDataFrame([("q", body.replace("1767830400", "1767830401"))], "query string, body string")).collect()
    head = "<th>Reported Date</th><th> Bullish </th><th>Neutral</th><th>Bearish</th>"
    line = lambda day, *shares: f'<tr><td align="left" class="tableTxt"> {day} </td>' + "".join(f'<td align="right" class="tableTxt">{x}%</td>' for x in shares) + "</tr>"
    read = lambda body, asof=dt.date(2026, 1, 8): [(r["date"], r["spread"]) for r in readers.sentiment_rows(spark.createDataFrame([(body, asof)], "body string, asof date")).orderBy("date").collect()]
    good = head + line("January 7", "40.0", "30.0", "30.0") + line("Dec 31", "34.7", "27.4", "37.9") + line("December 17", "35", "30.0", "35.0")
    assert read(good) == [(dt.date(2025, 12, 17), 0.0), (dt.date(2025, 12, 31), -3.2), (dt.date(2026, 1, 7), 10.0)]
    for body, asof, problem in (
        (good.replace("Neutral", "x"), dt.date(2026, 1, 8), "header"), (good.replace("40.0", "50.0"), dt.date(2026, 1, 8), "add up"), (head, dt.date(2026, 1, 8), "without rows"), (good, dt.date(2026, 2, 8), "stale"),
        (good.replace("Dec 31", "January 7"), dt.date(2026, 1, 8), "weekly sequence"), (good.replace("Dec 31", "Foo 31"), dt.date(2026, 1, 8), "month"), (good.replace("Dec 31", "Feb 30"), dt.date(2026, 1, 8), "(?i)date"),
    ):
        with pytest.raises(Exception, match=problem):
            read(body, asof)
    top = lambda body, d=dt.date(2026, 1, 2): sorted(map(tuple, readers.top_articles(spark.createDataFrame([(d, body)], "day date, body string")).collect()))
    listed = '{"items":[{"year":"2026","month":"01","day":"02","articles":[{"article":"A","views":5},{"article":"B","views":7},{"article":"","views":1}]}]}'
    assert top(listed) == [(dt.date(2026, 1, 2), "A", 5), (dt.date(2026, 1, 2), "B", 7)]
    for body, problem in (('{"items":[]}', "without items"), (listed.replace('"02"', '"03"'), "another day"), (listed.replace('"B"', '"A"'), "twice"), (listed.replace('"A"', '""').replace('"B"', '""'), "without articles")):
        with pytest.raises(Exception, match=problem):
            top(body)
    week = '{"timeline":[{"time":1767225600,"value":[5,1]},{"time":1767830400,"value":[6,2]}]}'
    basket = lambda body: readers.basket_timeline(spark.createDataFrame([(body,)], "body string"), ["p", "q"])
    assert basket(week).count() == 4
    for body, problem in ((week.replace("1767830400", "1767830401"), "gap"), (week.replace("[6,2]", "[6]"), "each query")):
        with pytest.raises(Exception, match=problem):
            basket(body).collect()
    wiki = "'''Sport'''\n* Parent\n** [[A|leaf]] one\n** leaf two\n* ''leaf'' three\n** leaf two\n"
    b = readers.bullets(spark.createDataFrame([(day(0), wiki)], "day date, body string")).orderBy("place").collect()
    assert [(r["category"], r["item"]) for r in b] == [("Sport", "leaf one"), ("Sport", "leaf two")]
    snap = spark.createDataFrame([("k", day(5), '{"choices":["yes","no"],"points":[[1767225600000,0.5,0.25]]}')], "key string, capture_day date, body string")
    assert readers.net_of(readers.tracker_points(snap), ["yes"], ["no"]).first()["value"] == 25.0
    (tmp_path / "r1").mkdir()
    (tmp_path / "r1" / "me.json").write_text('{"topline": {"mean": 7.9, "sd": 3.5},\n "notes": "n"}')
    f = readers.forecasts(spark, str(tmp_path)).first()
    assert (f["round_id"], f["entrant"], f["topline"]["mean"]) == ("r1", "me", 7.9)


def test_documents(spark, tmp_path):
    assert documents.first_json('so {x} then {"a": "}"} end') == '{"a": "}"}' and documents.first_json("none") is None and documents.first_json(None) is None
    import zipfile

    ns, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:  # the first sheet's file is the second
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="One" r:id="rId7"/><sheet name="Two" r:id="rId2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{rel}/worksheet" Target="{t}"/>' for i, t in (("rId2", "worksheets/sheet1.xml"), ("rId7", "/xl/worksheets/sheet2.xml"))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Month</t></si></sst>")
        for i, value in ((1, "1.5"), (2, "7.5")):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet {ns}><sheetData><row><c r="B1" t="s"><v>0</v></c></row><row><c r="B2"><v>{value}</v></c></row></sheetData></worksheet>')
    cells = documents.workbooks(spark, str(tmp_path))
    assert sorted((r["sheet"], r["header"], r["text"]) for r in documents.by_header(cells, 1).collect()) == [("One", "Month", "7.5"), ("Two", "Month", "1.5")]
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One"/></sheets></workbook>')
    with pytest.raises(ValueError, match="relationships"):
        documents.workbook_cells((tmp_path / "c.xlsx").read_bytes())
    assert documents.first_json('[1] {"a": 1}') == '{"a": 1}' and documents.first_json('{"a": [2]}', kind="array") == "[2]"
    with pytest.raises(Exception, match="no JSON object"):
        spark.range(1).select(documents.embedded_json(F.lit("[1]"), required=True)).collect()


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    sinks.append_new(a, path, ["k"])
    sinks.append_new(spark.createDataFrame([(2, "changed"), (3, "z")], "k int, v string"), path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "x"), (2, "y"), (3, "z")]
    assert sinks.conflicts(spark.createDataFrame([(2, "n"), (1, "x")], "k int, v string"), a, ["k"]).first()["k"] == 2
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_once(a, path)
