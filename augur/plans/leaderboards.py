"""Queries: boards, pairwise standings, season analytics, ranked lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.functions import scores as S
from augur.operators import boards, rankings
from augur.plans.fixtures import BRAND_WEEKS, SCORES, brand_weeks, r, rounded, table
from augur.plans.fixtures import scores as score_table
from augur.plans.registry import query

#: Shares of a Poisson of mean 1 up to 0, 1, ..., 7: where a uniform draw turns into the next weight.
POISSON = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(8)]

BASE = "base AS (SELECT round_id, loss AS null_loss FROM scores WHERE entrant = 'persistence')"
SKILL = "CASE WHEN null_loss = 0 THEN 0.0 ELSE 1 - loss / null_loss END"


@query(f"WITH {SCORES}, {BASE} SELECT entrant, {r(f'avg({SKILL})')} AS skill, {r('avg(loss)')} AS mean_loss, count(*) AS rounds FROM scores JOIN base USING (round_id) GROUP BY 1")
def live_board(spark: SparkSession, d: str) -> DataFrame:
    return boards.mean_of_skills(score_table(spark, d)).select("entrant", rounded("skill").alias("skill"), rounded("mean_loss").alias("mean_loss"), "rounds")


@query(f"""WITH {SCORES}, m AS (SELECT series, entrant, avg(loss) AS l, count(*) AS n FROM scores GROUP BY 1, 2) SELECT m.series, m.entrant, {r('m.l')} AS mean_loss, m.n, {r('CASE WHEN p.l = 0 THEN 0.0 ELSE 1 - m.l / p.l END')} AS skill FROM m JOIN m p ON m.series = p.series AND p.entrant = 'persistence'""")
def per_series_board(spark: SparkSession, d: str) -> DataFrame:
    return boards.skill_of_means(score_table(spark, d), ["series"]).select("series", "entrant", rounded("mean_loss").alias("mean_loss"), "n", rounded("skill").alias("skill"))


@query(f"""WITH {SCORES}, f AS (SELECT round_id FROM scores GROUP BY 1 HAVING count(DISTINCT entrant) = (SELECT count(DISTINCT entrant) FROM scores)), k AS (SELECT * FROM scores SEMI JOIN f USING (round_id)), {BASE.replace('FROM scores', 'FROM k')}
  SELECT entrant, {r(f'avg({SKILL})')} AS skill, count(*) AS rounds FROM k JOIN base USING (round_id) GROUP BY 1""")
def matched_board(spark: SparkSession, d: str) -> DataFrame:
    return boards.mean_of_skills(boards.answered_all(score_table(spark, d), "round_id")).select("entrant", rounded("skill").alias("skill"), "rounds")


@query(f"""WITH {SCORES}, s AS (SELECT * FROM scores WHERE NOT (entrant = 'm3' AND date > DATE '2024-01-20')), f AS (SELECT entrant FROM s GROUP BY 1 HAVING count(DISTINCT round_id) = (SELECT count(DISTINCT round_id) FROM s)) SELECT entrant, count(*) AS rounds, {r('avg(loss)')} AS mean_loss FROM s SEMI JOIN f USING (entrant) GROUP BY 1""")
def full_coverage_board(spark: SparkSession, d: str) -> DataFrame:
    s = score_table(spark, d).where("not (entrant = 'm3' and date > date'2024-01-20')")
    return boards.full_coverage(s, "round_id").groupBy("entrant").agg(F.count("*").alias("rounds"), rounded(F.avg("loss")).alias("mean_loss"))


@query(f"""WITH {SCORES}, {BASE}, s AS (SELECT *, CASE WHEN series IN ('click', 'view') THEN 'number' ELSE 'profile' END AS shape FROM scores JOIN base USING (round_id) WHERE date >= DATE '2024-01-10')
  SELECT entrant, {r(f'avg({SKILL})')} AS skill, {r("avg(CASE WHEN shape = 'number' THEN loss END)")} AS mean_crps, {r('count(DISTINCT round_id) / (SELECT count(DISTINCT round_id) FROM s)')} AS answered FROM s GROUP BY 1""")
def main_board(spark: SparkSession, d: str) -> DataFrame:
    s = score_table(spark, d)
    s = s.join(s.where("entrant = 'persistence'").select("round_id", F.col("loss").alias("null_loss")), "round_id").withColumns({"shape": F.when(F.col("series").isin("click", "view"), "number").otherwise("profile"), "lock_at": F.col("date").cast("timestamp")})
    return boards.main_board(s, "2024-01-10").select("entrant", rounded("skill").alias("skill"), rounded("mean_crps").alias("mean_crps"), rounded("answered").alias("answered"))


POINTS = f"""{SCORES}, pl AS (SELECT *, count(*) OVER (PARTITION BY round_id) AS n, rank() OVER (PARTITION BY round_id ORDER BY loss) AS place, count(*) OVER (PARTITION BY round_id, loss) AS tied FROM scores),
  pts AS (SELECT *, 100 * (n - place - tied + 1 + 0.5 * (tied - 1)) / (n - 1) AS points, greatest(0, least(tied, 4 - place)) / tied AS top3 FROM pl WHERE n > 1)"""


@query(f"WITH {POINTS} SELECT round_id, entrant, CAST(place AS BIGINT) AS place, CAST(tied AS BIGINT) AS tied, {r('points')} AS points, {r('top3')} AS top3 FROM pts")
def pairwise_points(spark: SparkSession, d: str) -> DataFrame:
    return boards.pairwise_points(score_table(spark, d)).select("round_id", "entrant", F.col("place").cast("long").alias("place"), "tied", rounded("points").alias("points"), rounded("top3").alias("top3"))


@query(f"""WITH {POINTS}, b AS (SELECT entrant, sum(points) / (SELECT count(DISTINCT round_id) FROM pts) AS p, sum(top3) / (SELECT count(DISTINCT round_id) FROM pts) AS t, count(*) AS answered FROM pts GROUP BY 1)
  SELECT entrant, {r('p')} AS pairwise, {r('t')} AS top3, answered, CAST(rank() OVER (ORDER BY round(p, 9) DESC) AS BIGINT) AS place FROM b""")
def pairwise_board(spark: SparkSession, d: str) -> DataFrame:
    return boards.pairwise_board(score_table(spark, d)).select("entrant", rounded("pairwise").alias("pairwise"), rounded("top3").alias("top3"), "answered", F.col("place").cast("long").alias("place"))


TRAJECTORY = f"""{POINTS}, rd AS (SELECT date, count(DISTINCT round_id) AS k FROM pts GROUP BY 1), rs AS (SELECT date, sum(k) OVER (ORDER BY date) AS so_far FROM rd), dl AS (SELECT entrant, date, sum(points) AS p FROM pts GROUP BY 1, 2),
  tr AS (SELECT e.entrant, rs.date, sum(coalesce(p, 0.0)) OVER (PARTITION BY e.entrant ORDER BY rs.date) / so_far AS pairwise FROM (SELECT DISTINCT entrant FROM pts) e CROSS JOIN rs LEFT JOIN dl ON dl.entrant = e.entrant AND dl.date = rs.date)"""


@query(f"WITH {TRAJECTORY} SELECT entrant, date, {r('pairwise')} AS pairwise FROM tr")
def pairwise_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return boards.pairwise_trajectory(score_table(spark, d)).select("entrant", "date", rounded("pairwise").alias("pairwise"))


@query(f"""WITH {TRAJECTORY}, p AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY round(pairwise, 9) DESC, entrant) AS k FROM tr) SELECT entrant, count(*) AS days_top, count(*) FILTER (k = 1) AS days_first FROM p WHERE k <= 3 GROUP BY 1""")
def daily_leaders(spark: SparkSession, d: str) -> DataFrame:
    return boards.leaders(boards.pairwise_trajectory(score_table(spark, d)))


@query(f"""WITH {POINTS}, w AS (SELECT CAST(date_trunc('week', date) AS DATE) AS week, * FROM pts), k AS (SELECT week, count(DISTINCT round_id) AS n FROM w GROUP BY 1), s AS (SELECT week, entrant, sum(points) AS p FROM w GROUP BY 1, 2)
  SELECT k.week, e.entrant, {r('coalesce(p, 0.0) / n')} AS mean_points FROM k CROSS JOIN (SELECT DISTINCT entrant FROM pts) e LEFT JOIN s ON s.week = k.week AND s.entrant = e.entrant""")
def weekly_pairwise(spark: SparkSession, d: str) -> DataFrame:
    return boards.weekly_means(boards.pairwise_points(score_table(spark, d))).select("week", "entrant", rounded("mean_points").alias("mean_points"))


@query(f"""WITH {SCORES}, dy AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM scores)), c AS (SELECT c, CASE WHEN (c * (SELECT max(i) FROM dy) / 29.0) % 1 = 0.5 AND floor(c * (SELECT max(i) FROM dy) / 29.0) % 2 = 0 THEN floor(c * (SELECT max(i) FROM dy) / 29.0) ELSE floor(c * (SELECT max(i) FROM dy) / 29.0 + 0.5) END AS i FROM range(0, 30) t(c)),
  ch AS (SELECT date, min(c) AS checkpoint FROM dy JOIN c ON CAST(c.i AS BIGINT) = dy.i GROUP BY 1), da AS (SELECT entrant, date, sum(loss) AS s, count(*) AS k FROM scores GROUP BY 1, 2), ru AS (SELECT entrant, date, sum(s) OVER w / sum(k) OVER w AS l FROM da WINDOW w AS (PARTITION BY entrant ORDER BY date)),
  b AS (SELECT checkpoint, ru.date, ru.entrant, CASE WHEN p.l = 0 THEN 0.0 ELSE 1 - ru.l / p.l END AS skill FROM ru JOIN ch USING (date) JOIN ru p ON p.date = ru.date AND p.entrant = 'persistence')
  SELECT CAST(checkpoint AS BIGINT) AS checkpoint, date, entrant, {r('skill')} AS skill, CAST(rank() OVER (PARTITION BY checkpoint ORDER BY round(skill, 9) DESC) AS BIGINT) AS place FROM b""")
def rank_trajectory(spark: SparkSession, d: str) -> DataFrame:
    return boards.rank_trajectory(score_table(spark, d)).select(F.col("checkpoint").cast("long").alias("checkpoint"), "date", "entrant", rounded("skill").alias("skill"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {SCORES} SELECT a.entrant AS a, b.entrant AS b, count(*) FILTER (a.loss < b.loss) AS wins, count(*) FILTER (a.loss = b.loss) AS ties, count(*) AS n FROM scores a JOIN scores b ON a.round_id = b.round_id AND a.entrant <> b.entrant GROUP BY 1, 2""")
def head_to_head(spark: SparkSession, d: str) -> DataFrame:
    return boards.head_to_head(score_table(spark, d))


@query(f"""WITH {SCORES}, g AS (SELECT round_id, min(loss) FILTER (entrant = 'persistence') AS own, min(loss) FILTER (entrant <> 'persistence') AS rest FROM scores GROUP BY 1) SELECT round_id, own < rest AS beats FROM g WHERE own IS NOT NULL AND rest IS NOT NULL""")
def beats_every_model(spark: SparkSession, d: str) -> DataFrame:
    return boards.beats_all(score_table(spark, d), "persistence")


@query(f"""WITH {SCORES}, m AS (SELECT series, entrant, avg(loss) AS x, avg(loss) FILTER (date < DATE '2024-01-15') AS y FROM scores GROUP BY 1, 2), k AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2.0 AS ry FROM m)
  SELECT series, {r('corr(rx, ry)')} AS rho, count(*) AS n FROM k GROUP BY 1""")
def early_standings(spark: SparkSession, d: str) -> DataFrame:
    """How the first two weeks' order agrees with the final one."""
    m = score_table(spark, d).groupBy("series", "entrant").agg(F.avg("loss").alias("x"), F.avg(F.when(F.col("date") < F.lit("2024-01-15").cast("date"), F.col("loss"))).alias("y"))
    return boards.spearman(m, ["series"], "x", "y").select("series", rounded("rho").alias("rho"), "n")


@query(f"""WITH {SCORES}, m AS (SELECT median(loss) AS med, entrant FROM scores GROUP BY 2) SELECT entrant, {r('med')} AS median_loss FROM m""")
def median_losses(spark: SparkSession, d: str) -> DataFrame:
    return score_table(spark, d).groupBy("entrant").agg(rounded(F.median("loss")).alias("median_loss"))


GAPS = f"""{SCORES}, pl AS (SELECT *, count(*) OVER (PARTITION BY round_id) AS n, rank() OVER (PARTITION BY round_id ORDER BY loss) AS place, count(*) OVER (PARTITION BY round_id, loss) AS tied FROM scores), po AS (SELECT *, 100 * (n - place - tied + 1 + 0.5 * (tied - 1)) / (n - 1) AS points FROM pl WHERE n > 1),
  bs AS (SELECT entrant, row_number() OVER (ORDER BY round(sum(points), 6) DESC, entrant) AS k FROM po GROUP BY 1 QUALIFY k <= 2), g AS (SELECT round_id, sum(CASE WHEN k = 1 THEN points ELSE -points END) AS gap FROM po JOIN bs USING (entrant) GROUP BY 1),
  dr AS (SELECT b, gap, CAST('0x' || substr(sha256(b || ':' || round_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM g, range(0, 5000) t(b)), wt AS (SELECT b, gap, {' + '.join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in POISSON)} AS w FROM dr), mn AS (SELECT b, sum(w * gap) / sum(w) AS m FROM wt GROUP BY 1)"""


@query(f"""WITH {GAPS} SELECT {r('quantile_cont(m, 0.025)', 4)} AS low, {r('quantile_cont(m, 0.975)', 4)} AS high, count(*) AS resamples FROM mn""")
def bootstrap_gap(spark: SparkSession, d: str) -> DataFrame:
    """The gap of the first two of the pairwise board with an interval: resampled rounds as Poisson weights, one pass and no copies of rows."""
    points = boards.pairwise_points(score_table(spark, d))
    totals = points.groupBy("entrant").agg(F.round(F.sum("points"), 6).alias("total"))  # a row for each entrant
    best = totals.withColumn("k", F.row_number().over(boards.W.partitionBy(F.lit(0)).orderBy(F.desc("total"), "entrant"))).where("k <= 2").select("entrant", "k")
    gaps = points.join(F.broadcast(best), "entrant").groupBy("round_id").agg(F.sum(F.when(F.col("k") == 1, F.col("points")).otherwise(-F.col("points"))).alias("gap"))
    uniform = lambda b: F.conv(F.substring(F.sha2(F.concat_ws(":", b, "round_id"), 256), 1, 8), 16, 10).cast("long") / 4294967296.0
    weight = lambda u: sum((F.when(u > c, 1).otherwise(0) for c in POISSON), F.lit(0))
    drawn = gaps.select("round_id", "gap", F.explode(F.sequence(F.lit(0), F.lit(4999))).alias("b")).withColumn("w", weight(uniform(F.col("b"))))
    means = drawn.groupBy("b").agg((F.sum(F.col("w") * F.col("gap")) / F.sum("w")).alias("m"))
    return means.agg(rounded(F.percentile("m", F.lit(0.025)), 4).alias("low"), rounded(F.percentile("m", F.lit(0.975)), 4).alias("high"), F.count("*").alias("resamples"))


TOP = f"{BRAND_WEEKS}, pl AS (SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY revenue DESC, brand) AS place, count(*) OVER (PARTITION BY week_end) AS k FROM bw), top AS (SELECT week_end, place, brand, revenue FROM pl WHERE place <= 10 AND k >= 10)"


@query(f"WITH {TOP} SELECT week_end, CAST(place AS BIGINT) AS place, brand, revenue FROM top")
def weekly_top_ten(spark: SparkSession, d: str) -> DataFrame:
    return rankings.top_n(brand_weeks(spark, d), ["week_end"], "brand", "revenue", 10).select("week_end", F.col("place").cast("long").alias("place"), "brand", "revenue")


LISTS = f"{TOP}, ls AS (SELECT week_end, list(brand ORDER BY place) AS items FROM top GROUP BY 1), pr AS (SELECT a.week_end, b.items AS predicted, a.items AS truth FROM ls a JOIN ls b ON b.week_end = a.week_end - 7)"


def list_pairs(spark: SparkSession, d: str) -> DataFrame:
    """week_end, predicted (the list of a week before), truth."""
    lists = rankings.lists(rankings.top_n(brand_weeks(spark, d), ["week_end"], "brand", "revenue", 10), ["week_end"], "brand")
    before = lists.select(F.date_add("week_end", 7).alias("week_end"), F.col("items").alias("predicted"))
    return lists.join(before, "week_end").select("week_end", "predicted", F.col("items").alias("truth"))


@query(f"""WITH {LISTS} SELECT week_end, {r('1 - list_sum([0.1 * pow(0.9, d - 1) * len(list_intersect(predicted[1:d], truth[1:d])) / d for d in range(1, 11)]) / (1 - pow(0.9, 10))')} AS loss, CAST(len(list_intersect(predicted, truth)) AS BIGINT) AS overlap, CAST(list_sum([CASE WHEN predicted[i] = truth[i] THEN 1 ELSE 0 END for i in range(1, 11)]) AS BIGINT) AS exact_positions FROM pr""")
def ranked_list_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = list_pairs(spark, d).select("week_end", *rankings.list_scores(F.col("predicted"), F.col("truth"), 0.9, 10))
    return scored.select("week_end", rounded("loss").alias("loss"), F.col("overlap").cast("long").alias("overlap"), F.col("exact_positions").cast("long").alias("exact_positions"))


BASKET = f"{BRAND_WEEKS}, bk AS (SELECT week_end, list(brand ORDER BY revenue DESC, brand) AS items FROM bw GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT p_brand) FROM part)), pr AS (SELECT a.week_end, b.items AS p, a.items AS t FROM bk a JOIN bk b ON b.week_end = a.week_end - 7)"


@query(f"""WITH {BASKET} SELECT week_end, {r('list_sum([list_sum([CASE WHEN j > i AND list_position(t, p[i]) > list_position(t, p[j]) THEN 1 ELSE 0 END for j in range(1, len(p) + 1)]) for i in range(1, len(p) + 1)]) / (len(p) * (len(p) - 1) / 2.0)')} AS loss FROM pr""")
def basket_order_scores(spark: SparkSession, d: str) -> DataFrame:
    """The order of all brands in the weeks that sold each, by the week before."""
    brands = table(spark, d, "part").agg(F.countDistinct("p_brand").alias("n"))  # one row
    own = brand_weeks(spark, d).groupBy("week_end").agg(F.array_sort(F.collect_list(F.struct((-F.col("revenue")).alias("r"), "brand"))).alias("l")).join(F.broadcast(brands), F.size("l") == F.col("n")).select("week_end", F.col("l.brand").alias("items"))
    pairs = own.join(own.select(F.date_add("week_end", 7).alias("week_end"), F.col("items").alias("p")), "week_end")
    return pairs.select("week_end", rounded(S.kendall_loss(F.col("p"), F.col("items"))).alias("loss"))


@query(f"WITH {BRAND_WEEKS} SELECT week_end, brand, {r('100.0 * revenue / sum(revenue) OVER (PARTITION BY week_end)')} AS share FROM bw")
def weekly_shares(spark: SparkSession, d: str) -> DataFrame:
    return rankings.shares(brand_weeks(spark, d).withColumnRenamed("revenue", "value"), ["week_end"]).select("week_end", "brand", rounded("share").alias("share"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, 'm' || (user_id % 5) AS entrant, event_type AS item, count(*) AS n FROM events GROUP BY 1, 2, 3), a AS (SELECT *, row_number() OVER (PARTITION BY day, entrant ORDER BY n DESC, item) AS place FROM e), k AS (SELECT * FROM a WHERE place <= 3),
  v AS (SELECT day, item, count(*) AS votes, avg(place) AS mp FROM k GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY votes DESC, mp, item) AS place FROM v) SELECT day, CAST(place AS BIGINT) AS place, item, votes FROM p WHERE place <= 3 AND day IN (SELECT day FROM k GROUP BY 1 HAVING count(DISTINCT entrant) >= 2)""")
def crowd_lists(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("entrant"), F.col("event_type").alias("item")).agg(F.count("*").alias("n"))
    order = boards.W.partitionBy("day", "entrant").orderBy(F.desc("n"), "item")
    answers = counts.withColumn("place", F.row_number().over(order)).where("place <= 3")
    return rankings.crowd_list(answers, ["day"], 3).select("day", F.col("place").cast("long").alias("place"), "item", "votes")


@query("""SELECT CAST(ts AS DATE) + CAST(7 - isodow(ts) AS INTEGER) AS week_end, event_type, floor(sum(value) * 1000 + 0.50001) / 1000.0 AS total FROM events GROUP BY 1, 2 HAVING count(DISTINCT CAST(ts AS DATE)) = 7""")
def complete_weeks(spark: SparkSession, d: str) -> DataFrame:
    daily = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("date")).agg(F.sum("value").alias("value"))
    return rankings.complete_weeks(daily, ["event_type"]).select("week_end", "event_type", rounded("total", 3).alias("total"))


@query("""WITH m AS (SELECT min(s_name) AS entrant, s_nationkey AS vendor, CAST(floor(s_acctbal / 1000) AS BIGINT) AS cutoff FROM supplier GROUP BY 2, 3) SELECT a.entrant AS newer, b.entrant AS older FROM m a JOIN m b ON a.vendor = b.vendor AND a.cutoff > b.cutoff""")
def same_family_pairs(spark: SparkSession, d: str) -> DataFrame:
    """One model for each nation and class of balance, out of all suppliers: a vendor has a dozen classes, so its pairs have a bound."""
    models = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("vendor"), F.floor(F.col("s_acctbal") / 1000).cast("long").alias("cutoff")).agg(F.min("s_name").alias("entrant"))
    return boards.same_family_pairs(models)


@query("""WITH g AS (SELECT DISTINCT s_name || '-' || (s_suppkey % 3) AS entrant FROM supplier), b AS (SELECT s_name AS base FROM supplier UNION ALL SELECT 'Supplier'), k AS (SELECT entrant, base, row_number() OVER (PARTITION BY entrant ORDER BY length(base) DESC) AS n FROM g JOIN b ON entrant = base OR starts_with(entrant, base || '-')) SELECT entrant, base FROM k WHERE n = 1""")
def entrant_roster(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    registered = s.select(F.col("s_name").alias("entrant")).unionByName(spark.range(1).select(F.lit("Supplier").alias("entrant")))
    return boards.roster(s.select(F.concat_ws("-", "s_name", (F.col("s_suppkey") % 3).cast("string")).alias("entrant")).distinct(), registered)
