"""The series registry: what each derived series takes from its source, as rows of specifications, and all of them as one table.

A source is a landed table, scanned once for all of its series: the specifications are joined to its rows (they are a few
dozen rows, so their side is broadcast), and what decides between rows of one date is an aggregate, never a sort of a source.
Archived sources (trackers that rewrite their history, search interest) are tables of dated captures, and a series shows
what was displayed at the time: a value never moves because a later capture revised it.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class Series:
    """series: its id. value: the column that it takes, or minus: from which another is taken.

    Rows must equal one of the values of each column in filters, and hold the text of each column in contains; both
    regardless of case and surrounding spaces. since: the first day on which a poll may end. key: the archive it reads; plus
    and less: choices whose sums make a net there (none: the net that the capture itself declares, else approve less
    disapprove); weekday (0 is Monday): the days that are sampled.
    """

    series: str
    source: str
    value: str = "value"
    minus: str | None = None
    filters: tuple[tuple[str, tuple[str, ...]], ...] = ()
    contains: tuple[tuple[str, str], ...] = ()
    since: str | None = None
    key: str | None = None
    plus: tuple[str, ...] | None = None
    less: tuple[str, ...] | None = None
    weekday: int | None = None
    scale: float = 1.0
    places: int | None = None


def where(**filters: str | tuple[str, ...]) -> tuple[tuple[str, tuple[str, ...]], ...]:
    return tuple((k, (v,) if isinstance(v, str) else tuple(v)) for k, v in sorted(filters.items()))


def polled(series: str, pollster: str, subgroup: str | tuple[str, ...] = "All polls", population: str | None = None, source: str = "sb_approval", value: str = "approve", since: str | None = None) -> Series:
    """A series of the poll sheets. Of the polls of YouGov only the Economist's count; the sheet files others under the same name."""
    sponsor = (("sponsors", "Economist"),) if pollster == "YouGov" else ()
    own = where(subgroup=subgroup, **({"population": population} if population else {}))
    return Series(series, source, value, filters=own, contains=(("pollster", pollster), *sponsor), since=since, places=2)


def archive_key(name: str, **filters: str) -> str:
    """The archive of a tracker, or of one of its subgroups."""
    return "/".join([name, *(f"{k}={v}" for k, v in sorted(filters.items()))])


APPROVAL = "approve_president_trump_2025"


def tracked(series: str, name: str = APPROVAL, plus: tuple[str, ...] | None = None, less: tuple[str, ...] | None = None, **filters: str) -> Series:
    """A tracker's Friday values."""
    return Series(series, "civiqs", key=archive_key(name, **filters), plus=plus, less=less, weekday=4)


#: The registered series with the filters, choices and names that their sources use.
HOUSES = ("YouGov", "Morning Consult", "Rasmussen Reports", "RMG Research", "Ipsos", "Global Strategy Group/GBAO (Navigator Research)")
TRACKER_CELLS = (
    ("dem", "party", "Democrat"), ("ind", "party", "Independent"), ("age_18_34", "age", "18-34"), ("age_35_49", "age", "35-49"), ("age_50_64", "age", "50-64"), ("age_65_up", "age", "65+"), ("race_white", "race", "White"),
    ("race_black", "race", "Black or African-American"), ("race_hispanic", "race", "Hispanic/Latino"), ("race_other", "race", "Other"), ("edu_noncollege", "education", "Non-College Graduate"), ("edu_college", "education", "College Graduate"),
    ("edu_postgrad", "education", "Postgraduate"), ("male", "gender", "Male"), ("female", "gender", "Female"),
)
XTAB_CELLS = (
    ("dem", "Democrat"), ("ind", "Independent"), ("rep", "Republican"), ("age_under_30", "Under 30"), ("age_30_44", "30-44"), ("age_45_64", "45-64"), ("age_65_up", "65+"), ("race_white", "White"), ("race_black", "Black"),
    ("race_hispanic", "Hispanic"), ("male", "Male"), ("female", "Female"), ("edu_hs_or_less", "HS or less"), ("edu_some_college", "Some college"), ("edu_college_grad", "College grad"), ("edu_postgrad", "Postgrad"),
)
BASKET = ("Tesla", "iPhone", "Samsung", "Netflix", "Disney")

REGISTRY: tuple[Series, ...] = (
    Series("umich_sentiment", "umich"),
    polled("yougov_approval", "YouGov", population="A"),
    polled("mc_approval", "Morning Consult", population="RV"),
    polled("yougov_generic_margin", "YouGov", source="sb_generic", value="net"),
    polled("yougov_econ_approval", "YouGov", "Economy"),
    polled("yougov_immig_approval", "YouGov", "Immigration"),
    polled("yougov_rv_approval", "YouGov", ("Voters", "All polls"), "RV"),
    polled("yougov_strong_approval", "YouGov", "Strong", "A"),
    polled("yougov_rv_strong_approval", "YouGov", "Strong", "RV", since="2026-09-06"),
    polled("yougov_weak_approval", "YouGov", "Weak", "A"),
    polled("yougov_cost_approval", "YouGov", "Cost", "A"),
    polled("yougov_trade_approval", "YouGov", "Trade", "A"),
    polled("mc_econ_approval", "Morning Consult", "Economy", "RV"),
    polled("mc_immig_approval", "Morning Consult", "Immigration", "RV"),
    polled("mc_trade_approval", "Morning Consult", "Trade", "RV"),
    polled("mc_strong_approval", "Morning Consult", "Strong", "RV"),
    polled("mc_weak_approval", "Morning Consult", "Weak", "RV"),
    polled("rasmussen_approval", HOUSES[2], population="LV"),
    polled("rmg_approval", HOUSES[3], population="RV"),
    polled("ipsos_approval", HOUSES[4], population="A"),
    polled("navigator_approval", HOUSES[5], population="RV"),
    polled("ipsos_generic_margin", "Ipsos", source="sb_generic", value="net"),
    polled("mc_generic_margin", "Morning Consult", source="sb_generic", value="net"),
    tracked("civiqs_net_approval"),
    tracked("civiqs_net_approval_rep", party="Republican"),
    tracked("civiqs_net_econ_now", "economy_us_now", ("Very good", "Fairly good"), ("Very bad", "Fairly bad")),
    tracked("civiqs_net_econ_direction", "economy_us_direction", ("Getting better",), ("Getting worse",)),
    tracked("civiqs_net_family_finances", "economy_family_retro", ("Gotten better",), ("Gotten worse",)),
    tracked("civiqs_net_inflation_concern", "inflation_impact", ("Very concerned", "Somewhat concerned"), ("Not concerned at all", "A little concerned")),
    tracked("civiqs_angry_share", "describe_feeling_us", ("Angry",), ()),
    *(tracked(f"civiqs_net_approval_{cell}", **{axis: label}) for cell, axis, label in TRACKER_CELLS),
    Series("wiki_views_trump", "wikipedia", filters=where(article="Donald_Trump")),
    Series("wiki_views_taylor_swift", "wikipedia", filters=where(article="Taylor_Swift")),
    *(Series(f"umich_party_{party}", "umichparty", filters=where(party=party)) for party in ("dem", "ind", "rep")),
    Series("aaii_bull_bear_spread", "aaii", "bull", minus="bear", places=2),
    Series("sce_inflation_1y", "sce", "infl_1y"), Series("sce_inflation_3y", "sce", "infl_3y"),
    Series("hh_trump_approval", "hhpoll", "approve"),
    Series("trends_tesla", "trends", filters=where(query="Tesla")), Series("trends_iphone", "trends", filters=where(query="iPhone")),
    *(Series(f"trends_share_{q.lower()}", "trends_basket", filters=where(query=q), places=2) for q in BASKET),
    *(Series(f"yougov_xtab_approve_{cell}", "yougov_xtab", filters=where(cell=label), scale=100.0, places=4) for cell, label in XTAB_CELLS),
)

SPECS = "series string, source string, filters map<string,array<string>>, contains map<string,string>, since date, key string, plus array<string>, less array<string>, weekday int, value string, minus string, scale double, places int"


def specifications(spark, specs: Iterable[Series] = REGISTRY) -> DataFrame:  # noqa: ANN001
    """The registry as rows."""
    import datetime as dt

    plain = lambda v: v.strip().lower()
    rows = [
        (s.series, s.source, {k: [plain(v) for v in values] for k, values in s.filters}, {k: plain(v) for k, v in s.contains}, dt.date.fromisoformat(s.since) if s.since else None, s.key, None if s.plus is None else list(s.plus), None if s.less is None else list(s.less), s.weekday, s.value, s.minus, s.scale, s.places)
        for s in specs
    ]
    return spark.createDataFrame(rows, SPECS)


def half_even(value: Column, places: Column | int) -> Column:
    """value as it is where places is null."""
    wanted = F.lit(places) if isinstance(places, int) else places
    return F.when(wanted.isNull(), value).when(wanted == 0, F.bround(value, 0)).when(wanted == 1, F.bround(value, 1)).when(wanted == 2, F.bround(value, 2)).otherwise(F.bround(value, 4))


#: Columns that filters and contains may name; the first of LEADS that a table has is what its rows meet specifications on.
FILTERED = ("subgroup", "pollster", "population", "sponsors", "article", "party", "query", "cell")
LEADS = ("subgroup", "article", "party", "query", "cell")


def matched(table: DataFrame, specs: list[Series]) -> DataFrame:
    """Rows of a source (_t) with each specification (_s) whose filters they pass: an equi-join on one filter, the others decide within."""
    spark, lead = table.sparkSession, next((c for c in LEADS if c in table.columns), None)
    rows = table.select(F.struct("*").alias("_t"))
    folded = lambda c: F.lower(F.trim(F.coalesce(F.col("_t")[c].cast("string"), F.lit(""))))
    named = [c for c in FILTERED if c in table.columns]
    own = F.create_map(*[x for c in named for x in (F.lit(c), folded(c))]) if named else F.create_map().cast("map<string,string>")
    every = F.forall(F.map_entries("_s.filters"), lambda e: F.array_contains(e["value"], F.try_element_at(own, e["key"])))
    some = F.forall(F.map_entries("_s.contains"), lambda e: F.contains(F.try_element_at(own, e["key"]), e["value"]))
    fits = F.coalesce(every & some, F.lit(False))
    parts = []
    if keyed := [s for s in specs if lead in dict(s.filters)]:
        wanted = specifications(spark, keyed).select(F.struct("*").alias("_s"), F.explode(F.col("filters")[lead]).alias("_lead"))
        parts.append(rows.join(F.broadcast(wanted), (folded(lead) == F.col("_lead")) & fits).drop("_lead"))
    if free := [s for s in specs if lead not in dict(s.filters)]:  # no filter to meet on: every row meets these few
        parts.append(rows.join(F.broadcast(specifications(spark, free).select(F.struct("*").alias("_s"))), fits if any(s.filters or s.contains for s in free) else F.lit(True)))
    return reduce(DataFrame.unionByName, parts)


def taken(table: DataFrame) -> Column:
    """The value that a specification takes of a row, scaled, not rounded."""
    numbers = F.create_map(*[x for f in table.schema.fields if f.dataType.typeName() in ("double", "float", "long", "integer", "short", "decimal") for x in (F.lit(f.name), F.col("_t")[f.name].cast("double"))])
    value = F.when(F.col("_s.minus").isNull(), F.element_at(numbers, F.col("_s.value"))).otherwise(F.element_at(numbers, F.col("_s.value")) - F.element_at(numbers, F.coalesce("_s.minus", "_s.value")))
    return F.when(F.col("_s.scale") == 1.0, value).otherwise(value * F.col("_s.scale"))


def dated(table: DataFrame, specs: list[Series]) -> DataFrame:
    """Series of a source with a value a date: filters and columns only. Where rows say when a poll ended and whose it is, the last one of a date holds."""
    order = [c for c in ("end_date", "pollster") if c in table.columns]
    rows = matched(table, specs).select("_s.series", F.col("_t")["date"].alias("date"), half_even(taken(table), F.col("_s.places")).alias("value"), *[F.col("_t")[c].alias(c) for c in order]).where("value is not null")
    return rows.groupBy("series", "date").agg(F.max_by("value", F.struct(*order, "value")).alias("value")) if "end_date" in order else rows.select("series", "date", "value")


def polls(sheet: DataFrame, specs: list[Series]) -> DataFrame:
    """Series of a poll sheet (as landed, all text): of the polls of one date the one that ended last, then the last pollster by name, then the last row (column row, if there is one, else the value)."""
    from augur.operators.polls import typed

    found = typed(sheet)
    late = F.col("_s.since").isNull() | (F.col("_t")["end_date"] >= F.col("_s.since"))
    last = F.col("_t")["row"] if "row" in found.columns else taken(found)
    rows = matched(found, specs).where(late).select("_s.series", F.col("_t")["date"].alias("date"), taken(found).alias("value"), F.col("_s.places").alias("places"), F.struct(F.col("_t")["end_date"].alias("end_date"), F.col("_t")["pollster"].alias("pollster"), last.alias("row")).alias("order"))
    return rows.where("value is not null").groupBy("series", "date").agg(F.max_by(half_even(F.col("value"), F.col("places")), "order").alias("value"))


def tracker(archive: DataFrame, specs: list[Series]) -> DataFrame:
    """Series of a tracker that rewrites its history, as it was displayed: a day has what the first capture from then on shows for that day, or for its own last one if that lies before.

    archive: key, capture_day, end_date (its last day; null: that of its points), choices, points (date and a share for each
    choice, in points), net (the choices it adds and takes away itself, or null). Days begin with the first capture's first
    point. Every capture holds the points it can be asked for, so nothing is joined but the specifications.
    """
    joined = archive.join(F.broadcast(specifications(archive.sparkSession, specs).select("series", "key", "plus", "less", "weekday")), "key")
    pair = F.array_contains("choices", "Approve") & F.array_contains("choices", "Disapprove")
    missing = F.raise_error(F.concat(F.lit("no net in a capture of "), "key")).cast("array<string>")
    side = lambda spec, own, name: F.coalesce(F.col(spec), F.col("net")[own], F.when(pair, F.array(F.lit(name))), missing)
    sided = joined.withColumns({"_plus": side("plus", "plus", "Approve"), "_less": side("less", "less", "Disapprove")})

    def total(names: str) -> Callable[[Column], Column]:
        """The sum of the named choices of a point; null if one has no value."""
        return lambda p: F.bround(F.aggregate(F.transform(F.col(names), lambda c: F.try_element_at(p["values"], F.array_position("choices", c).cast("int"))), F.lit(0.0), lambda a, v: a + v), 2)

    unknown = F.exists(F.concat("_plus", "_less"), lambda c: ~F.array_contains("choices", c))
    checked = F.when(unknown, F.raise_error(F.concat(F.lit("a choice is not in a capture of "), "key")).cast(archive.schema["points"].dataType)).otherwise(F.col("points"))
    valued = F.filter(F.transform(checked, lambda p: F.struct(p["date"].alias("date"), F.bround(total("_plus")(p) - total("_less")(p), 2).alias("value"))), lambda p: p["value"].isNotNull())
    shown = sided.withColumn("_shown", valued).where(F.size("_shown") > 0).withColumn("_dates", F.transform("_shown", lambda p: p["date"]))
    w = W.partitionBy("series").orderBy("capture_day")
    start = F.coalesce(F.date_add(F.lag("capture_day").over(w), 1), F.array_min("_dates"))
    served = shown.select("series", "weekday", "capture_day", F.coalesce("end_date", F.array_max("_dates")).alias("_end"), start.alias("_start"), F.map_from_entries("_shown").alias("_values"))
    days = served.where("_start <= capture_day").withColumn("date", F.explode(F.sequence("_start", "capture_day"))).where("weekday is null or weekday(date) = weekday")
    return days.select("series", "date", F.try_element_at("_values", F.least("_end", "date")).alias("value")).where("value is not null")


def weekly_views(days: DataFrame, specs: list[Series]) -> DataFrame:
    """Thousands of views in complete weeks. days: article, date, views."""
    from augur.operators.rankings import weekly_thousands

    own = matched(days, specs).select("_s.series", F.col("_t")["date"].alias("date"), F.col("_t")["views"].alias("value"))
    return weekly_thousands(own, ["series"]).select("series", "date", "value")


def first_complete(captures: DataFrame) -> DataFrame:
    """query, date (of the week's end), value: what the first capture shows that has the week complete."""
    return captures.where("not partial").groupBy("query", F.col("week_end").alias("date")).agg(F.min_by("value", "capture_day").alias("value"))


def interest(captures: DataFrame, specs: list[Series]) -> DataFrame:
    """captures: query, capture_day, week_end, value, partial."""
    return dated(first_complete(captures), specs)


def basket_shares(captures: DataFrame, specs: list[Series]) -> DataFrame:
    """Percent of the basket that each query has in a week, as the first capture shows it that has the week complete. A week of zeros is none.

    captures: capture_day, week_end, partial, and values, a map of the basket's queries.
    """
    weeks = captures.where("not partial").groupBy(F.col("week_end").alias("date")).agg(F.min_by("values", "capture_day").alias("values"))
    total = F.aggregate(F.map_values("values"), F.lit(0.0), lambda a, v: a + v)
    shares = weeks.select("date", total.alias("_total"), F.explode("values").alias("query", "_own")).where("_total > 0").select("date", "query", (100.0 * F.col("_own") / F.col("_total")).alias("value"))
    return dated(shares, specs)


def waves(cells: DataFrame, specs: list[Series]) -> DataFrame:
    """Crosstab cells (date, cell, measure, value as a fraction): the approving share of the waves that have every registered cell."""
    from augur.sources.readers import complete_waves

    return dated(complete_waves(cells, [label for _, label in XTAB_CELLS], ["approve"]), specs)


#: How a source's table becomes its series; other sources have a value a date.
BUILDERS: dict[str, Callable[[DataFrame, list[Series]], DataFrame]] = {
    "sb_approval": polls, "sb_generic": polls, "civiqs": tracker, "wikipedia": weekly_views, "trends": interest, "trends_basket": basket_shares, "yougov_xtab": waves,
}


def build_all(sources: dict[str, DataFrame], registry: Iterable[Series] = REGISTRY, unavailable: Iterable[str] = ()) -> DataFrame:
    """obs (series, date, value) of every registered series.

    sources: landed tables by source, as its builder reads them. A source that is neither there nor named as unavailable is
    an error; series of unavailable sources are left out together, and no other source steps in.
    """
    held = [s for s in registry if s.source not in set(unavailable)]
    missing = sorted({s.source for s in held} - sources.keys())
    if missing:
        raise ValueError(f"no table for sources: {', '.join(missing)}")
    by_source: dict[str, list[Series]] = {}
    for s in held:
        by_source.setdefault(s.source, []).append(s)
    built = [BUILDERS.get(k, dated)(sources[k], specs) for k, specs in sorted(by_source.items())]
    return reduce(DataFrame.unionByName, [b.select("series", "date", F.col("value").cast("double").alias("value")) for b in built])


def empty_series(obs: DataFrame, registry: Iterable[Series], spark) -> DataFrame:  # noqa: ANN001
    """series of the registry that were built to no point at all, which must not be published."""
    known = spark.createDataFrame([(s.series,) for s in registry], "series string")
    return known.join(obs.select("series"), "series", "left_anti")
