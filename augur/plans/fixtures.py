"""Canonical tables as projections of the driver's tables, and the same as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(x: Column | str, places: int = 6) -> Column:
    """Half up, a hair early, so that the last bits of a sum (its order is free) never decide."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 10**places + 0.50001) / float(10**places)


def r(x: str, places: int = 6) -> str:
    """The same in SQL."""
    return f"(floor(({x}) * {10**places} + 0.50001) / {float(10**places)})"


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date")).agg(rounded(F.avg("value"), 4).alias("value"))


OBS = f"obs AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, {r('avg(value)', 4)} AS value FROM events GROUP BY 1, 2)"


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, day = table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date")
    span = (F.col("o_orderkey") % 5).cast("int")
    return o.select(
        F.col("o_orderpriority").alias("pollster"), day.alias("start_date"), F.date_add(day, span).alias("end_date"), F.date_add(day, F.floor(span / 2).cast("int")).alias("date"), (F.col("o_orderkey") % 2500).cast("int").alias("n"),
        F.element_at(F.array(F.lit("a"), F.lit("rv"), F.lit("lv")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("population"), rounded(40 + (F.col("o_totalprice") % 2000) / 100, 1).alias("value"),
    )


POLLS = f"""polls AS (SELECT o_orderpriority AS pollster, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS end_date,
  CAST(o_orderdate AS DATE) + CAST((o_orderkey % 5) // 2 AS INTEGER) AS date, CAST(o_orderkey % 2500 AS INTEGER) AS n, CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'rv' ELSE 'lv' END AS population,
  {r('40 + (o_totalprice % 2000) / 100', 1)} AS value FROM orders)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, date, entrant, mean, sd: a round is a series and date."""
    e = table(spark, sf_dir, "events")
    spread = F.greatest(rounded(F.coalesce(F.stddev_samp("value"), F.lit(1.0)), 4), F.lit(0.5))
    return e.groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("entrant")).agg(rounded(F.avg("value"), 4).alias("mean"), spread.alias("sd"))


FORECASTS = f"""fc AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, 'm' || (user_id % 5) AS entrant, {r('avg(value)', 4)} AS mean, greatest({r('coalesce(stddev_samp(value), 1.0)', 4)}, 0.5) AS sd FROM events GROUP BY 1, 2, 3)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """round_id, series, date, entrant, loss: absolute errors of the entrants, and of persistence as an entrant."""
    from pyspark.sql import Window as W

    o = obs(spark, sf_dir)
    w = W.partitionBy("series").orderBy("date")
    known = o.withColumn("last", F.lag("value").over(w)).where("last is not null")
    null = known.select("series", "date", F.lit("persistence").alias("entrant"), F.col("last").alias("mean"))
    every = forecasts(spark, sf_dir).select("series", "date", "entrant", "mean").unionByName(null)
    return every.join(known, ["series", "date"]).select(F.concat_ws("/", "series", F.col("date").cast("string")).alias("round_id"), "series", "date", "entrant", rounded(F.abs(F.col("mean") - F.col("value")), 4).alias("loss"))


SCORES = f"""{OBS}, {FORECASTS}, known AS (SELECT * FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY date) AS last FROM obs) WHERE last IS NOT NULL),
  every_ AS (SELECT series, date, entrant, mean FROM fc UNION ALL SELECT series, date, 'persistence', last FROM known),
  scores AS (SELECT series || '/' || CAST(date AS VARCHAR) AS round_id, series, date, entrant, {r('abs(mean - value)', 4)} AS loss FROM every_ JOIN known USING (series, date))"""


def profile_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, entrant, cell, mean, sd, outcome: 16 cells of every vector, each answered by its neighbour's component."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 16)).alias("cell", "x"))
    return rows.select("vec_id", F.col("label").alias("entrant"), "cell", rounded(F.col("x").cast("double") * 100 + F.col("cell") % 3, 3).alias("mean"), (F.lit(4.0) + F.col("cell") % 4).alias("sd"), rounded(F.col("x").cast("double") * 90, 3).alias("outcome"))


PROFILE_CELLS = f"""pc AS (SELECT vec_id, label, c - 1 AS cell, {r('CAST(embedding[c] AS DOUBLE) * 100 + (c - 1) % 3', 3)} AS mean, 4.0 + (c - 1) % 4 AS sd, {r('CAST(embedding[c] AS DOUBLE) * 90', 3)} AS outcome FROM embeddings, range(1, 17) t(c))"""


def brand_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """week_end, brand, revenue of lineitem by part brand."""
    from augur.functions.calendar import week_end

    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("day"), F.floor(F.col("l_extendedprice")).cast("long").alias("revenue"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy(week_end(F.col("day")).alias("week_end"), "brand").agg(F.sum("revenue").alias("revenue"))


BRAND_WEEKS = """bw AS (SELECT CAST(l_shipdate AS DATE) + CAST(7 - isodow(l_shipdate) AS INTEGER) AS week_end, p_brand AS brand, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pid, grp, w, item, option: labels of documents as answers of weighted respondents."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id").withColumn("w", 1.0 + F.col("n_chars") % 7)
    items = F.array(F.struct(F.lit("quality").alias("item"), F.when(F.col("quality") == 1, "approve").otherwise("disapprove").alias("option")), F.struct(F.lit("toxic").alias("item"), F.when(F.col("toxic") == 1, "disapprove").when(F.col("n_chars") % 5 == 0, F.lit(None)).otherwise("approve").alias("option")))
    return rows.select(F.col("doc_id").alias("pid"), F.col("lang").alias("grp"), "w", F.explode(items).alias("i")).select("pid", "grp", "w", "i.item", "i.option")


PANEL = """base_ AS (SELECT doc_id, lang, n_chars, quality, toxic, 1.0 + n_chars % 7 AS w FROM labels JOIN documents USING (doc_id)),
  panel AS (SELECT doc_id AS pid, lang AS grp, w, 'quality' AS item, CASE WHEN quality = 1 THEN 'approve' ELSE 'disapprove' END AS option FROM base_
    UNION ALL SELECT doc_id, lang, w, 'toxic', CASE WHEN toxic = 1 THEN 'disapprove' WHEN n_chars % 5 = 0 THEN NULL ELSE 'approve' END FROM base_)"""
