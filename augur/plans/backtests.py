"""Queries: boards of backtests on matched points, schedules of releases, crowds of profiles, panels weighted for a population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.operators import boards, crowd, panel, season
from augur.plans.fixtures import SCORES, r, rounded, table
from augur.plans.fixtures import scores as score_table
from augur.plans.forecasting import quantile_sql
from augur.plans.registry import query

LEVELS_SQL = "range(1, 40)"


@query(f"""WITH {SCORES}, e AS (SELECT count(DISTINCT entrant) AS m FROM scores WHERE entrant <> 'persistence'), k AS (SELECT series, date FROM scores WHERE entrant <> 'persistence' GROUP BY 1, 2 HAVING count(DISTINCT entrant) = (SELECT m FROM e)),
  p AS (SELECT k.*, row_number() OVER (ORDER BY k.date, k.series) AS n, count(*) OVER () AS c FROM k SEMI JOIN (SELECT series, date FROM scores WHERE entrant = 'persistence') q ON q.series = k.series AND q.date = k.date), marks AS (SELECT DISTINCT greatest(CAST(round_even(i * greatest(c / 30.0, 1), 0) AS INTEGER), 1) AS n FROM (SELECT max(c) AS c FROM p), range(1, 31) t(i) WHERE i <= c),
  s AS (SELECT p.n, s.date, entrant, avg(loss) OVER (PARTITION BY entrant ORDER BY p.n) AS loss FROM scores s JOIN p USING (series, date)), t AS (SELECT s.* FROM s SEMI JOIN marks USING (n)), u AS (SELECT t.*, z.loss AS nl FROM t JOIN t z ON z.n = t.n AND z.entrant = 'persistence')
  SELECT n, date, entrant, {r('loss')} AS loss, {r('CASE WHEN nl = 0 THEN 0.0 ELSE 1 - loss / nl END', 5)} AS skill FROM u""")
def matched_trajectory(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative losses and skills over the points that every entrant answered, at thirty checkpoints."""
    scores = score_table(spark, d).select("series", "date", "entrant", "loss")
    found = boards.matched_trajectory(scores, ["series", "date"], ["persistence"])
    return found.select("n", "date", "entrant", rounded("loss").alias("loss"), rounded("skill", 5).alias("skill"))


@query(f"""WITH {SCORES}, o AS (SELECT * FROM scores WHERE date < DATE '2024-01-20' OR entrant = 'persistence'), a AS (SELECT DISTINCT round_id FROM o WHERE entrant <> 'persistence'), b AS (SELECT entrant, loss FROM o WHERE entrant <> 'persistence' UNION ALL SELECT entrant, loss FROM o SEMI JOIN a USING (round_id) WHERE entrant = 'persistence')
  SELECT entrant, {r('avg(loss)')} AS loss, count(*) AS n FROM b GROUP BY 1""")
def pooled_board(spark: SparkSession, d: str) -> DataFrame:
    """Mean losses with the null on the very points that entrants answered."""
    scores = score_table(spark, d).where("date < '2024-01-20' or entrant = 'persistence'")
    return boards.pooled_baselines(scores, ["persistence"], ["round_id"]).groupBy("entrant").agg(rounded(F.avg("loss")).alias("loss"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT c_custkey AS series, CASE c_custkey % 3 WHEN 0 THEN 'field_dates' WHEN 1 THEN 'sampled' ELSE 'feed' END AS source, c_custkey % 9 AS weekday, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 7 END AS entry FROM customer),
  h AS (SELECT o_custkey AS series, CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE ((CASE WHEN o_custkey % 3 = 1 THEN o_custkey % 9 ELSE o_custkey % 7 END) - isodow(o_orderdate) + 8) % 7 END AS INTEGER) AS day FROM orders),
  w AS (SELECT series, day, lead(day) OVER (PARTITION BY series ORDER BY day DESC) AS before, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS n FROM h), f AS (SELECT w.series, count(*) AS waves, count(*) FILTER (isodow(day) - 1 <> entry) + count(*) FILTER (n < 8 AND before IS NOT NULL AND day - before NOT BETWEEN 1 AND 8) AS slips FROM w JOIN s USING (series) WHERE n <= 8 GROUP BY 1),
  x AS (SELECT w.series, min(day) FILTER (isodow(day) - 1 <> weekday) AS off FROM w JOIN s USING (series) WHERE n <= 26 GROUP BY 1),
  p AS (SELECT s.*, CASE source WHEN 'field_dates' THEN CASE WHEN entry IS NULL THEN 'no calendar is recorded' WHEN coalesce(waves, 0) < 8 THEN 'too few waves' WHEN slips > 1 THEN 'slips' END WHEN 'sampled' THEN CASE WHEN weekday > 6 THEN 'no sampled weekday' WHEN off IS NOT NULL THEN 'read off its weekday on ' || off END ELSE 'no calendar is known' END AS problem FROM s LEFT JOIN f USING (series) LEFT JOIN x USING (series))
  SELECT series, CASE WHEN problem IS NULL THEN CASE source WHEN 'sampled' THEN weekday ELSE (entry + 1) % 7 END END AS weekday, CASE WHEN problem IS NULL THEN 14 END AS hour, problem FROM p""")
def schedule_contracts(spark: SparkSession, d: str) -> DataFrame:
    """When series are released, by a recorded calendar that the last waves confirm or by the weekday on which they were read; or why it can't be said."""
    k = F.col("c_custkey")
    entry = F.when(k % 4 != 0, k % 7)
    series = table(spark, d, "customer").select(k.alias("series"), F.when(k % 3 == 0, "field_dates").when(k % 3 == 1, "sampled").otherwise("feed").alias("source"), (k % 9).alias("weekday"), entry.alias("entry"), ((entry + 1) % 7).alias("release"), F.lit(14).alias("hour"))
    c, day = F.col("o_custkey"), F.col("o_orderdate").cast("date")
    aim = F.when(c % 3 == 1, c % 9).otherwise(c % 7)
    moved = F.date_add(day, F.when(c % 5 == 0, F.lit(0)).otherwise((aim - F.weekday(day) + 7) % 7).cast("int"))
    seen = table(spark, d, "orders").select(c.alias("series"), moved.alias("day"))
    found = season.schedule_contract(series, seen, seen.withColumnRenamed("day", "date"))
    return found.select("series", F.col("weekday").cast("long").alias("weekday"), "hour", "problem")


@query(f"""WITH f AS (SELECT CAST(ts AS DATE) AS date, 'm' || user_id % 5 AS entrant, event_type AS cell, {r('avg(value)', 4)} AS mean, greatest({r('coalesce(stddev_samp(value), 1.0)', 4)}, 0.5) AS sd FROM events WHERE NOT (user_id % 5 = 3 AND event_type = 'click' AND day(ts) % 4 = 0) GROUP BY 1, 2, 3),
  w AS (SELECT date, entrant FROM f GROUP BY 1, 2 HAVING count(*) = 5), x AS (SELECT date, cell, entrant, mean + sd * {quantile_sql('(i / 40.0)')} AS x FROM f SEMI JOIN w USING (date, entrant), {LEVELS_SQL} t(i))
  SELECT date, cell, count(DISTINCT entrant) AS members, {r('avg(x)', 3)} AS mean, {r('stddev_pop(x)', 3)} AS sd, {r('quantile_cont(x, 0.5)', 3)} AS middle FROM x GROUP BY 1, 2 HAVING count(DISTINCT entrant) >= 2""")
def crowd_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The crowd of every day's profiles, cell by cell, of the members whose profiles are complete."""
    e = table(spark, d, "events").where("not (user_id % 5 = 3 and event_type = 'click' and day(ts) % 4 = 0)")
    spread = F.greatest(rounded(F.coalesce(F.stddev_samp("value"), F.lit(1.0)), 4), F.lit(0.5))
    rows = e.groupBy(F.col("ts").cast("date").alias("date"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("entrant"), F.col("event_type").alias("cell")).agg(rounded(F.avg("value"), 4).alias("mean"), spread.alias("sd"))
    topline = F.struct("mean", "sd", F.expr("map_from_arrays(array_repeat('', 0), array_repeat(0D, 0))").alias("quantiles"))
    profiles = rows.groupBy("date", "entrant").agg(F.map_from_entries(F.collect_list(F.struct("cell", topline.alias("t")))).alias("profile"))
    found = crowd.crowd_profiles(profiles, ["date"], ["click", "error", "purchase", "signup", "view"], None)
    return found.select("date", "cell", "members", rounded("mean", 3).alias("mean"), rounded("sd", 3).alias("sd"), rounded(F.element_at("quantiles", F.lit("0.5")), 3).alias("middle"))


@query(f"""WITH p AS (SELECT doc_id, lang, 1.0 + n_chars % 7 AS w, (n_chars % 10) / 10.0 AS registered FROM documents), a AS (SELECT 'A' AS population, doc_id, lang, w FROM p UNION ALL SELECT 'RV', doc_id, lang, w * registered FROM p), t AS (SELECT population, sum(w) AS s FROM a GROUP BY 1)
  SELECT population, lang, {r('sum(w / s)')} AS share FROM a JOIN t USING (population) GROUP BY 1, 2""")
def population_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a panel's groups among adults and among registered voters."""
    people = table(spark, d, "documents").select("doc_id", "lang", (1.0 + F.col("n_chars") % 7).alias("w"), ((F.col("n_chars") % 10) / 10.0).alias("registered"))
    each = [panel.population_weights(people, p).withColumn("population", F.lit(p)) for p in ("A", "RV")]
    return each[0].unionByName(each[1]).groupBy("population", "lang").agg(rounded(F.sum("w")).alias("share"))
