"""Ranked lists: totals of complete weeks, orders, and a crowd's list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.functions.calendar import week_end
from augur.functions.scores import exact_positions, kendall_loss, rbo
from augur.functions.text import canonical_title, excluded


def complete_weeks(daily: DataFrame, by: list[str]) -> DataFrame:
    """by, week_end, total: sums over Monday to Sunday of the weeks that have all seven days. daily: by, date, value."""
    weeks = daily.groupBy(*by, week_end(F.col("date")).alias("week_end")).agg(F.sum("value").alias("total"), F.countDistinct("date").alias("days"))
    return weeks.where("days = 7").drop("days")


def top_n(totals: DataFrame, by: list[str], item: str, value: str, n: int) -> DataFrame:
    """by, place, item, value: the n largest, ties by item. Groups that hold fewer than n are refused (left out)."""
    order = W.partitionBy(*by).orderBy(F.desc(value), item)
    placed = totals.withColumns({"place": F.row_number().over(order), "_items": F.count("*").over(W.partitionBy(*by))})
    return placed.where((F.col("place") <= n) & (F.col("_items") >= n)).select(*by, "place", item, value)


def lists(placed: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, items: the placed items as one array."""
    return placed.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", item))).alias("_l")).select(*by, F.col("_l")[item].alias("items"))


def shares(values: DataFrame, by: list[str]) -> DataFrame:
    """values with share: percent of its group's total; groups without a total are left out."""
    total = F.sum("value").over(W.partitionBy(*by))
    return values.withColumn("_total", total).where("_total <> 0").withColumn("share", 100 * F.col("value") / F.col("_total")).drop("_total")


def list_scores(predicted: Column, truth: Column, p: float, length: int) -> list[Column]:
    return [(1 - rbo(predicted, truth, p, F.lit(length))).alias("loss"), F.size(F.array_intersect(predicted, truth)).alias("overlap"), exact_positions(predicted, truth).alias("exact_positions")]


def basket_scores(predicted: Column, truth: Column) -> list[Column]:
    return [kendall_loss(predicted, truth).alias("loss"), exact_positions(predicted, truth).alias("exact_positions")]


def crowd_list(answers: DataFrame, by: list[str], length: int, members: int = 2) -> DataFrame:
    """by, place, item: by how many name an item, then by mean place, then by name. answers: by, entrant, place, item."""
    counts = answers.groupBy(*by, "item").agg(F.count("*").alias("votes"), F.avg("place").alias("mean_place"))
    enough = answers.groupBy(*by).agg(F.countDistinct("entrant").alias("_m")).where(F.col("_m") >= members)
    order = W.partitionBy(*by).orderBy(F.desc("votes"), "mean_place", "item")
    return counts.join(enough, by, "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= length).select(*by, "place", "item", "votes", "mean_place")


def list_problems(answer: Column, basket: Column, excluded: Column, length: int) -> Column:
    """Names of what is wrong with a list: empty if nothing is."""
    return F.array_compact(F.array(
        F.when(F.size(answer) != length, "length"), F.when(F.size(F.array_distinct(answer)) != F.size(answer), "duplicate"),
        F.when(basket.isNotNull() & (F.size(F.array_except(answer, basket)) > 0), "outside_basket"), F.when(F.size(F.array_intersect(answer, excluded)) > 0, "excluded"),
    ))


def quantile_problems(quantiles: Column) -> Column:
    """Names of what is wrong with a map of quantiles: no median, levels outside 0 to 1, values that fall."""
    entries = F.array_sort(F.transform(F.map_entries(quantiles), lambda e: F.struct(e["key"].cast("double").alias("level"), e["value"].alias("value"))))
    falls = F.exists(F.zip_with(F.slice(entries, F.lit(1), F.size(entries) - 1), F.slice(entries, F.lit(2), F.size(entries) - 1), lambda a, b: a["value"] > b["value"]), lambda x: x)
    return F.array_compact(F.array(F.when(~F.exists(entries, lambda e: e["level"] == 0.5), "no_median"), F.when(F.exists(entries, lambda e: (e["level"] <= 0) | (e["level"] >= 1)), "level"), F.when((F.size(entries) > 1) & falls, "order")))


def weekly_thousands(daily: DataFrame, by: list[str]) -> DataFrame:
    """by, date (the Sunday), value: sums of complete weeks in thousands, to one decimal. daily: by, date, value."""
    return complete_weeks(daily, by).select(*by, F.col("week_end").alias("date"), F.bround(F.col("total") / 1000.0, 1).alias("value"))


def ranked_weeks(daily: DataFrame, weeks: DataFrame, n: int, rule: str) -> DataFrame:
    """week_end, place, title: the n largest of each wanted week, without what a rule keeps out; titles are made canonical after the cut.

    daily: date, title, views. weeks: week_end. The job fails on a week that lacks a day, and on one that keeps fewer than n titles.
    """
    dated = daily.withColumn("week_end", week_end(F.col("date"))).join(weeks.select("week_end").distinct(), "week_end", "left_semi")
    days = weeks.select("week_end").distinct().join(dated.groupBy("week_end").agg(F.countDistinct("date").alias("_days")), "week_end", "left")
    whole = days.select(F.when(F.col("_days") == 7, F.col("week_end")).otherwise(F.raise_error(F.concat(F.lit("a partial week: "), F.col("week_end").cast("string"))).cast("date")).alias("week_end"))
    totals = dated.where(~excluded(F.col("title"), rule)).groupBy("week_end", "title").agg(F.sum("views").alias("views"))
    order, every = W.partitionBy("week_end").orderBy(F.desc("views"), "title"), W.partitionBy("week_end")
    placed = totals.withColumns({"place": F.row_number().over(order), "_kept": F.count("*").over(every)}).where(F.col("place") <= n)
    enough = F.when(F.col("_kept") >= n, F.col("place")).otherwise(F.raise_error(F.lit("too few titles for the list")).cast("int"))
    return placed.join(whole, "week_end").select("week_end", enough.alias("place"), canonical_title(F.col("title")).alias("title"))
