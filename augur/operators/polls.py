"""Poll averages: recency and size weights, shrunken house effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days a poll counts, its half-life, days a house is judged by, and the polls of no effect it is shrunk by.
WINDOW_DAYS, HALFLIFE_DAYS, HOUSE_DAYS, SHRINK = 21, 10.0, 180, 3.0


def weight(age: Column, n: Column) -> Column:
    return F.when(age.between(0, WINDOW_DAYS), F.pow(F.lit(0.5), age / HALFLIFE_DAYS) * F.sqrt(F.least(n, F.lit(3000)) / 1000.0)).otherwise(0.0)


def daily(polls: DataFrame, by: list[str]) -> DataFrame:
    """Polls of one day have one age: sums of the size weights, per day and `by`."""
    size = F.sqrt(F.least("n", F.lit(3000)) / 1000.0)
    return polls.groupBy("date", *by).agg(F.sum(size).alias("w"), F.sum(size * F.col("value")).alias("wv"), F.count(F.when(F.col("n") > 0, 1)).alias("polls"))


def reached(days: DataFrame, by: list[str], dates: DataFrame | None = None) -> DataFrame:
    """(asof, *by, w, wv, polls): each day's sums under the weights of every date that sees it.

    A day reaches at most WINDOW_DAYS + 1 dates, so an equi-join on the date replaces the range join.
    """
    spread = days.withColumn("age", F.explode(F.sequence(F.lit(0), F.lit(WINDOW_DAYS)))).withColumn("asof", F.date_add("date", F.col("age")))
    if dates is not None:
        spread = spread.join(dates, "asof", "left_semi")
    decay = F.pow(F.lit(0.5), F.col("age") / HALFLIFE_DAYS)
    return spread.groupBy("asof", *by).agg(F.sum(F.col("w") * decay).alias("w"), F.sum(F.col("wv") * decay).alias("wv"), F.sum("polls").alias("polls"))


def raw_average(polls: DataFrame, dates: DataFrame) -> DataFrame:
    """asof, value: the weighted mean at each of the dates (asof); null where no poll counts."""
    found = reached(daily(polls, []), [], dates)
    return dates.join(found, "asof", "left").select("asof", F.when(F.col("w") > 0, F.col("wv") / F.col("w")).alias("value"))


def house_effects(polls: DataFrame, anchor: DataFrame) -> DataFrame:
    """pollster, effect: mean gap to the average of the poll's own day, over the days before the anchor (one row: anchor), shrunk."""
    recent = polls.join(F.broadcast(anchor), F.datediff("anchor", "date").between(0, HOUSE_DAYS))
    base = raw_average(polls, recent.select(F.col("date").alias("asof")).distinct())
    gaps = recent.join(base.select(F.col("asof").alias("date"), F.col("value").alias("base")), "date").where("base is not null")
    return gaps.groupBy("pollster").agg((F.sum(F.col("value") - F.col("base")) / (F.count("*") + SHRINK)).alias("effect"), F.count("*").alias("polls"))


def adjusted_average(polls: DataFrame, dates: DataFrame, effects: DataFrame) -> DataFrame:
    """asof, value, polls: the average of the polls less their house's effect, and how many count."""
    adjusted = polls.join(effects.select("pollster", "effect"), "pollster", "left").withColumn("value", F.col("value") - F.coalesce("effect", F.lit(0.0)))
    found = reached(daily(adjusted, []), [], dates)
    return dates.join(found, "asof", "left").select("asof", F.when(F.col("w") > 0, F.col("wv") / F.col("w")).alias("value"), F.coalesce("polls", F.lit(0)).alias("polls"))


def anchor_of(polls: DataFrame) -> DataFrame:
    return polls.agg(F.max("date").alias("anchor"))


def weekly_series(polls: DataFrame, weeks: int = 52) -> DataFrame:
    """date, value, polls: averages at weekly steps back from the newest poll, with the house effects of that day."""
    anchor = anchor_of(polls)
    dates = anchor.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda w: F.date_sub("anchor", w * 7))).alias("asof"))
    return adjusted_average(polls, dates, house_effects(polls, anchor)).where("value is not null").withColumnRenamed("asof", "date")


def to_series(polls: DataFrame) -> DataFrame:
    """One value a date: the poll that ended last, and of those the last pollster by name."""
    return polls.groupBy("date").agg(F.max_by("value", F.struct("end_date", "pollster", "value")).alias("value"))


def poll_history(polls: DataFrame) -> DataFrame:
    """One value a date, adults before other populations."""
    return polls.groupBy("date").agg(F.max_by("value", F.struct(F.col("population") == "a", "end_date", "pollster", "value")).alias("value"))


def typed(sheet: DataFrame) -> DataFrame:
    """Poll records of a sheet as landed (all text): its dates, the field midpoint as date, sizes and shares as numbers.

    Rows with bad or reversed dates go, and those without one of the shares that the sheet has (approve and disapprove;
    dem, rep and net; or value); a missing size counts as 0. Approval gets its net; the population is in capitals.
    """
    shares = [c for c in ("approve", "disapprove", "dem", "rep", "net", "value") if c in sheet.columns]
    day = lambda c: F.try_to_timestamp(F.trim(c), F.lit("M/d/yyyy")).cast("date")
    number = lambda c: F.expr(f"try_cast(trim({c}) as double)")
    found = sheet.withColumns({
        "start_date": day("start_date"), "end_date": day("end_date"), "n": F.coalesce(F.floor(number("n")).cast("int"), F.lit(0)), **{c: number(c) for c in shares},
        "pollster": F.trim(F.coalesce("pollster", F.lit(""))), "population": F.upper(F.trim(F.coalesce("population", F.lit("")))),
    }).where(" and ".join(["start_date is not null", "end_date >= start_date", *(f"{c} is not null and not isnan({c})" for c in shares)]))
    if "net" not in shares and "approve" in shares:
        found = found.withColumn("net", F.bround(F.col("approve") - F.col("disapprove"), 2))
    return found.withColumn("date", F.date_add("start_date", F.floor(F.datediff("end_date", "start_date") / 2).cast("int")))


def records(sheet: DataFrame, subgroups: list[str] | None = None, pollster: str | None = None, population: str | None = None, sponsor: str | None = None, since: str | None = None) -> DataFrame:
    """Typed records of one of the subgroups and of the population, from pollsters and sponsors that hold these texts, all regardless of case; since: the first day on which a poll may end."""
    found = typed(sheet)
    if subgroups:
        found = found.where(F.lower(F.trim("subgroup")).isin([s.strip().lower() for s in subgroups]))
    for column, text in (("pollster", pollster), ("sponsors", sponsor)):
        if text:
            found = found.where(F.contains(F.lower(column), F.lit(text.lower())))
    if population:
        found = found.where(F.col("population") == population.upper())
    return found.where(F.col("end_date") >= F.lit(since).cast("date")) if since else found


def running_average(obs: DataFrame, days: int) -> DataFrame:
    """obs with avg_before: the mean over the trailing days, this day included."""
    day = F.datediff("date", F.lit("1970-01-01"))
    return obs.withColumn("avg_before", F.avg("value").over(W.partitionBy("series").orderBy(day).rangeBetween(-days, 0)))
