"""The whole series registry over landed tables of every source, which are derived from orders and events by one text in two dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.plans.fixtures import table
from augur.plans.registry import query
from augur.sources import readers, registry

POPULATIONS, SPONSORS = ("a", "RV", "lv", "A ", "rv"), ("The Economist", "CBS News", "")
SUBGROUPS, POLLSTERS = ("All polls", "economy ", "Immigration", "TRADE", "Cost", "Strong", "Weak", "Voters"), (*registry.HOUSES, "YouGov/CBS", "Quinnipiac")
PARTIES, QUERIES = ("dem", "ind", "rep"), ("Tesla", "iPhone", "Samsung")
#: Trackers by key with their choices.
NETS = {s.key: [*s.plus, *s.less, "Unsure"] for s in registry.REGISTRY if s.source == "civiqs" and s.plus}
KEYS = {s.key: NETS.get(s.key, ["Approve", "Disapprove", "Neither"]) for s in registry.REGISTRY if s.source == "civiqs"}


class Spark:
    by = staticmethod(lambda a, b: f"({a} div {b})")
    listed = staticmethod(lambda values: f"array({', '.join(values)})")
    pick = staticmethod(lambda values, i: f"element_at(array({', '.join(repr(v) for v in values)}), CAST({i} AS INT) + 1)")
    plus = staticmethod(lambda d, n: f"date_add({d}, CAST({n} AS INT))")
    later = staticmethod(lambda d, n: f"add_months({d}, {n})")
    each = staticmethod(lambda values, name: f"LATERAL VIEW explode({values}) e_{name} AS {name}")
    weekday = staticmethod(lambda d: f"weekday({d})")
    month = staticmethod(lambda d: f"CAST(trunc({d}, 'MM') AS DATE)")


class Duck:
    by = staticmethod(lambda a, b: f"({a} // {b})")
    listed = staticmethod(lambda values: f"[{', '.join(values)}]")
    pick = staticmethod(lambda values, i: f"([{', '.join(repr(v) for v in values)}])[{i} + 1]")
    plus = staticmethod(lambda d, n: f"({d} + CAST({n} AS INTEGER))")
    later = staticmethod(lambda d, n: f"CAST({d} + INTERVAL {n} MONTH AS DATE)")
    each = staticmethod(lambda values, name: f", unnest({values}) e_{name}({name})")
    weekday = staticmethod(lambda d: f"(isodow({d}) - 1)")
    month = staticmethod(lambda d: f"CAST(date_trunc('month', {d}) AS DATE)")


def landed(q: type) -> dict[str, str]:
    """Each landed table as a statement over orders and events."""
    o = f"(SELECT o_orderkey AS k, o_custkey AS c, {q.later('CAST(o_orderdate AS DATE)', 324)} AS d, o_orderstatus AS s FROM orders) o"
    text = lambda d: f"concat(month({d}), '/', day({d}), '/', year({d}))"
    hundredths = lambda least, span: f"concat({least} + {q.by(f'(k % {span})', 100)}, '.', lpad(CAST(k % 100 AS STRING), 2, '0'))"
    poll = f"k AS row, {q.pick(SUBGROUPS, 'k % 8')} AS subgroup, {q.pick(POLLSTERS, q.by('k', 8) + ' % 8')} AS pollster, {q.pick(SPONSORS, 'k % 3')} AS sponsors, {q.pick(POPULATIONS, q.by('k', 64) + ' % 5')} AS population, {text('d')} AS start_date, CASE WHEN k % 41 = 0 THEN 'n/a' ELSE {text(q.plus('d', 'k % 6 - 1'))} END AS end_date, CASE WHEN k % 7 = 0 THEN '' ELSE CAST(k % 3000 AS STRING) END AS n"
    week = f"SELECT {q.plus('d', '5 - ' + q.weekday('d'))} AS saturday, {{own}} AS j, sum(k) AS v, count(*) AS n FROM {o} GROUP BY 1, 2"
    month = f"SELECT {q.month('d')} AS date, {{own}} AS party, CAST(sum(k) % 900 AS DOUBLE) / 10 AS value, CAST(sum(k) % 70 AS DOUBLE) / 10 AS infl_1y, CAST(sum(k) % 50 AS DOUBLE) / 10 AS infl_3y FROM {o} {{where}} GROUP BY 1, 2"
    days = "SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY 1, 2"
    offsets = q.each(q.listed(["-3", "4", "11"]), "shift")
    cells = q.each(q.listed([str(i) for i in range(16)]), "i")
    measures = q.each(q.listed(["'approve'", "'disapprove'"]), "measure")
    return {
        "sb_approval": f"SELECT {poll}, CASE WHEN k % 43 = 0 THEN 'x' ELSE {hundredths(30, 2000)} END AS approve, {hundredths(40, 1500)} AS disapprove FROM {o}",
        "sb_generic": f"SELECT {poll}, {hundredths(35, 1100)} AS dem, CASE WHEN k % 47 = 0 THEN '' ELSE {hundredths(36, 900)} END AS rep, CAST(k % 19 - 9 AS STRING) AS net FROM {o}",
        "finals": month.format(own="1", where="WHERE s = 'F'"), "preliminary": month.format(own="1", where=""), "umichparty": month.format(own=q.pick(PARTIES, "c % 3"), where=""), "sce": month.format(own="1", where=""),
        "aaii": f"SELECT date, CAST(max(CASE WHEN event_type = 'click' THEN n END) % 50 AS DOUBLE) + 0.37 AS bull, CAST(max(CASE WHEN event_type = 'view' THEN n END) % 50 AS DOUBLE) AS bear FROM ({days}) a GROUP BY 1",
        "hhpoll": f"SELECT date, CAST(sum(n) % 60 AS DOUBLE) AS approve FROM ({days}) a GROUP BY 1",
        "wikipedia": f"SELECT CASE event_type WHEN 'click' THEN 'Donald_Trump' WHEN 'view' THEN 'Taylor_Swift' ELSE event_type END AS article, date, n * 137 AS views FROM ({days}) a",
        "trends": f"SELECT {q.pick(QUERIES, 'j')} AS query, {q.plus('saturday', 'shift')} AS capture_day, saturday AS week_end, CAST((v + shift) % 101 AS DOUBLE) AS value, shift < 0 AS partial FROM ({week.format(own='c % 3')}) w {offsets}",
        "baskets": f"SELECT {q.plus('saturday', 'shift')} AS capture_day, saturday AS week_end, shift < 0 AS partial, {', '.join(f'CASE WHEN n % 5 = 0 THEN 0.0E0 ELSE CAST((v * {i + 1} + shift) % 97 AS DOUBLE) END AS q{i}' for i in range(5))} FROM ({week.format(own='1')}) w {offsets}",
        "yougov_xtab": f"SELECT {q.plus('saturday', '2')} AS date, {q.pick([label for _, label in registry.XTAB_CELLS], 'i')} AS cell, measure, CASE WHEN v % 13 = 0 AND i = 3 THEN NULL ELSE CAST((v + i * 7) % 101 AS DOUBLE) / 100 END AS value FROM ({week.format(own='1')}) w {cells} {measures}",
        "shares": f"SELECT date, event_type, CAST({q.by('n * 10000', 'sum(n) OVER (PARTITION BY date)')} AS BIGINT) AS share FROM ({days}) a",
    }




def archive(shares: DataFrame) -> DataFrame:
    """Captures of every tracker on every third day, from daily shares (in hundredths of a point) of event types.

    A capture holds the days before it, the newest eight unless it is the first; shares change a little from one to the next,
    and some are missing.
    """
    types = [r[0] for r in shares.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    daily = shares.groupBy("date").pivot("event_type", types).agg(F.max("share"))
    keys = shares.sparkSession.createDataFrame([(i, k, c) for i, (k, c) in enumerate(KEYS.items())], "i int, key string, choices array<string>")
    captures = daily.where("dayofmonth(date) % 3 = 1").select(F.col("date").alias("capture_day"))
    grid = captures.crossJoin(F.broadcast(keys))  # the archive's own grid: days by a few trackers
    own = daily.select("date", F.array(*[F.coalesce(t, F.lit(0)) for t in types]).alias("own"))
    kept = grid.join(own, (F.col("date") < F.col("capture_day")) & ((F.col("date") >= F.date_sub("capture_day", 8)) | (F.dayofmonth("capture_day") == 4)))
    share = lambda c, j: F.when((F.col("i") + F.dayofmonth("date") + j) % 11 != 0, (F.get("own", j % len(types)) + (F.col("i") + F.dayofmonth("capture_day") + j) % 7 * 10) / 100.0)
    points = kept.withColumn("values", F.transform("choices", share))
    found = points.groupBy("i", "key", "capture_day", "choices").agg(F.array_sort(F.collect_list(F.struct("date", "values"))).alias("points"))
    declared = F.when(F.col("i") % 3 == 1, F.struct(F.array(F.lit("Approve"), F.lit("Neither")).alias("plus"), F.array(F.lit("Disapprove")).alias("less")))
    return found.select("key", "capture_day", F.when(F.col("i") % 2 == 0, F.date_sub("capture_day", 1)).alias("end_date"), "choices", "points", declared.alias("net"))


def sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    given = {n: table(spark, d, n) for n in ("orders", "events")}
    views = {n: spark.sql(text.replace("FROM orders", "FROM {orders}").replace("FROM events", "FROM {events}"), **{k: v for k, v in given.items() if f"FROM {k}" in text}) for n, text in landed(Spark).items()}
    names = [f"q{i}" for i in range(5)]
    basket = views["baskets"].select("capture_day", "week_end", "partial", F.create_map(*[x for q, n in zip(registry.BASKET, names, strict=True) for x in (F.lit(q), F.col(n))]).alias("values"))
    monthly = readers.finals_first(views["finals"].select("date", "value"), views["preliminary"].select("date", "value"))
    plain = {n: views[n] for n in ("sb_approval", "sb_generic", "umichparty", "sce", "aaii", "hhpoll", "wikipedia", "trends", "yougov_xtab")}
    return plain | {"umich": monthly, "trends_basket": basket, "civiqs": archive(views["shares"])}


def _polls(sheet: str, value: str, series: str, subgroups: tuple[str, ...], pollster: str, population: str | None = None, since: str | None = None) -> str:
    """One series of a sheet in SQL, from the rules as they are published: exact cuts and population, pollster and sponsor as parts of the text."""
    rules = [f"subgroup IN ({', '.join(repr(s.lower()) for s in subgroups)})", f"contains(lower(pollster), {pollster.lower()!r})"]
    rules += ["contains(lower(sponsors), 'economist')"] if pollster == "YouGov" else []
    rules += [f"population = {population!r}"] if population else []
    rules += [f"end_date >= DATE {since!r}"] if since else []
    return f"SELECT {series!r} AS series, date, round_even({value}, 2) AS value FROM t_{sheet} WHERE {' AND '.join(rules)} QUALIFY row_number() OVER (PARTITION BY date ORDER BY end_date DESC, pollster DESC, row DESC) = 1"


def _registry_sql() -> str:
    tables = landed(Duck)
    ctes = [f"{n} AS ({text.replace('AS STRING', 'AS VARCHAR')})" for n, text in tables.items()]
    day = lambda c: f"try_strptime({c}, '%m/%d/%Y')::DATE"
    for sheet, shares in (("sb_approval", ("approve", "disapprove")), ("sb_generic", ("dem", "rep", "net"))):
        ctes.append(
            f"t_{sheet} AS (SELECT * REPLACE (CAST(start_date + INTERVAL (CAST((end_date - start_date) // 2 AS INTEGER)) DAY AS DATE) AS date) FROM (SELECT row, lower(trim(subgroup)) AS subgroup, trim(pollster) AS pollster, sponsors, upper(trim(population)) AS population, {day('start_date')} AS start_date, {day('end_date')} AS end_date, NULL::DATE AS date, {', '.join(f'try_cast({c} AS DOUBLE) AS {c}' for c in shares)} FROM {sheet}) WHERE start_date IS NOT NULL AND end_date >= start_date AND {' AND '.join(f'{c} IS NOT NULL' for c in shares)})"
        )
    p, out = _polls, []
    for series, subgroups, pollster, population, since in (
        ("yougov_approval", ("All polls",), "YouGov", "A", None), ("mc_approval", ("All polls",), "Morning Consult", "RV", None), ("yougov_econ_approval", ("Economy",), "YouGov", None, None), ("yougov_immig_approval", ("Immigration",), "YouGov", None, None),
        ("yougov_rv_approval", ("Voters", "All polls"), "YouGov", "RV", None), ("yougov_strong_approval", ("Strong",), "YouGov", "A", None), ("yougov_rv_strong_approval", ("Strong",), "YouGov", "RV", "2026-09-06"), ("yougov_weak_approval", ("Weak",), "YouGov", "A", None),
        ("yougov_cost_approval", ("Cost",), "YouGov", "A", None), ("yougov_trade_approval", ("Trade",), "YouGov", "A", None), ("mc_econ_approval", ("Economy",), "Morning Consult", "RV", None), ("mc_immig_approval", ("Immigration",), "Morning Consult", "RV", None),
        ("mc_trade_approval", ("Trade",), "Morning Consult", "RV", None), ("mc_strong_approval", ("Strong",), "Morning Consult", "RV", None), ("mc_weak_approval", ("Weak",), "Morning Consult", "RV", None), ("rasmussen_approval", ("All polls",), "Rasmussen Reports", "LV", None),
        ("rmg_approval", ("All polls",), "RMG Research", "RV", None), ("ipsos_approval", ("All polls",), "Ipsos", "A", None), ("navigator_approval", ("All polls",), "Global Strategy Group/GBAO (Navigator Research)", "RV", None),
    ):
        out.append(p("sb_approval", "approve", series, subgroups, pollster, population, since))
    out += [p("sb_generic", "net", f"{name}_generic_margin", ("All polls",), house) for name, house in (("yougov", "YouGov"), ("ipsos", "Ipsos"), ("mc", "Morning Consult"))]
    out.append("SELECT 'umich_sentiment', date, value FROM finals UNION ALL SELECT 'umich_sentiment', date, value FROM preliminary ANTI JOIN finals USING (date)")
    out.append("SELECT 'umich_party_' || party, date, value FROM umichparty")
    out.append("SELECT 'aaii_bull_bear_spread', date, round_even(bull - bear, 2) FROM aaii WHERE bull - bear IS NOT NULL")
    out.append("SELECT 'sce_inflation_1y', date, infl_1y FROM sce UNION ALL SELECT 'sce_inflation_3y', date, infl_3y FROM sce")
    out.append("SELECT 'hh_trump_approval', date, approve FROM hhpoll")
    out.append("SELECT CASE article WHEN 'Donald_Trump' THEN 'wiki_views_trump' ELSE 'wiki_views_taylor_swift' END, date + CAST(7 - isodow(date) AS INTEGER) AS w, round_even(sum(views) / 1000.0, 1)::DOUBLE FROM wikipedia WHERE article IN ('Donald_Trump', 'Taylor_Swift') GROUP BY article, w HAVING count(*) = 7")
    out.append("SELECT 'trends_' || lower(query), week_end, arg_min(value, capture_day) FROM trends WHERE NOT partial AND query IN ('Tesla', 'iPhone') GROUP BY query, week_end")
    first = "(SELECT * FROM baskets WHERE NOT partial QUALIFY row_number() OVER (PARTITION BY week_end ORDER BY capture_day) = 1)"
    out += [f"SELECT 'trends_share_{q.lower()}', week_end, round_even(100.0 * q{i} / (q0 + q1 + q2 + q3 + q4), 2) FROM {first} WHERE q0 + q1 + q2 + q3 + q4 > 0" for i, q in enumerate(registry.BASKET)]
    labels = ", ".join(f"('{label}', 'yougov_xtab_approve_{cell}')" for cell, label in registry.XTAB_CELLS)
    out.append(f"SELECT s, date, round_even(value * 100, 4) FROM yougov_xtab JOIN (VALUES {labels}) l(cell, s) USING (cell) WHERE measure = 'approve' AND date IN (SELECT date FROM yougov_xtab WHERE measure = 'approve' GROUP BY 1 HAVING count(value) = 16)")
    # trackers: one row a choice, so nets are sums; then the first capture from each Friday on
    keys = ", ".join(f"({i}, {k!r}, {c!r})" for i, (k, c) in enumerate(KEYS.items()))
    sides = ", ".join(f"({s.series!r}, {s.key!r}, {'NULL::VARCHAR[]' if s.plus is None else list(s.plus)}, {'NULL::VARCHAR[]' if s.less is None else list(s.less) or '[]::VARCHAR[]'})" for s in registry.REGISTRY if s.source == "civiqs")
    ctes += [
        "types AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS j, count(*) OVER () AS m FROM (SELECT DISTINCT event_type FROM shares))", f"keys AS (SELECT * FROM (VALUES {keys}) k(i, key, choices))", f"sides AS (SELECT * FROM (VALUES {sides}) s(series, key, plus, less))",
        "caps AS (SELECT i, key, choices, date AS capture_day FROM (SELECT DISTINCT date FROM shares) d, keys WHERE day(date) % 3 = 1)", "grid AS (SELECT d.date, event_type, coalesce(share, 0) AS share FROM (SELECT DISTINCT date FROM shares) d CROSS JOIN types LEFT JOIN shares USING (date, event_type))",
        "cells AS (SELECT i, key, capture_day, g.date, choices[c.j + 1] AS choice, (g.share + (i + day(capture_day) + c.j) % 7 * 10) / 100.0 AS v FROM caps, unnest(range(0, len(choices))) c(j) JOIN types t ON t.j = c.j % t.m JOIN grid g USING (event_type) WHERE g.date < capture_day AND (g.date >= capture_day - 8 OR day(capture_day) = 4) AND (i + day(g.date) + c.j) % 11 <> 0)",
        "nets AS (SELECT series, i, capture_day, date, round_even(round_even(coalesce(sum(v) FILTER (list_contains(p, choice)), 0), 2) - round_even(coalesce(sum(v) FILTER (list_contains(l, choice)), 0), 2), 2) AS v FROM (SELECT c.*, series, coalesce(plus, CASE WHEN i % 3 = 1 THEN ['Approve', 'Neither'] ELSE ['Approve'] END) AS p, coalesce(less, ['Disapprove']) AS l FROM cells c JOIN sides USING (key)) GROUP BY ALL HAVING count(*) FILTER (list_contains(p, choice)) = len(any_value(p)) AND count(*) FILTER (list_contains(l, choice)) = len(any_value(l)))",
        "shown AS (SELECT series, i, capture_day, CASE WHEN i % 2 = 0 THEN capture_day - 1 ELSE max(date) END AS end_date, min(date) AS least FROM nets GROUP BY 1, 2, 3)", "span AS (SELECT series, arg_min(least, capture_day) AS a, max(capture_day) AS b FROM shown GROUP BY 1)", "fridays AS (SELECT series, CAST(t.d AS DATE) AS date FROM span, unnest(generate_series(a, b, INTERVAL 1 DAY)) t(d) WHERE isodow(t.d) = 5)",
        "served AS (SELECT f.series, f.date, arg_min(s.capture_day, s.capture_day) AS capture_day, arg_min(s.end_date, s.capture_day) AS end_date FROM fridays f JOIN shown s ON s.series = f.series AND s.capture_day >= f.date GROUP BY 1, 2)",
    ]
    out.append("SELECT s.series, s.date, n.v FROM served s JOIN nets n ON n.series = s.series AND n.capture_day = s.capture_day AND n.date = least(s.end_date, s.date)")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(f'SELECT * FROM ({x}) x{i}' for i, x in enumerate(out))}"


@query(_registry_sql())
def whole_registry(spark: SparkSession, d: str) -> DataFrame:
    """Every registered series, by REGISTRY itself, from a landed table of each source: polls by cut, house, sponsor and population, trackers as displayed, first complete prints."""
    return registry.build_all(sources(spark, d))
