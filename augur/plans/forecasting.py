"""Queries: poll averages, nulls, backtests, scores, profiles, panels, crowd."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.functions import scores as S
from augur.functions.special import ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, TAIL, erf, normal_quantile
from augur.operators import boards, crowd, nulls, panel, polls, profiles
from augur.plans.fixtures import FORECASTS, OBS, PANEL, POLLS, PROFILE_CELLS, profile_cells, r, rounded
from augur.plans.fixtures import forecasts as forecast_table
from augur.plans.fixtures import obs as obs_table
from augur.plans.fixtures import panel as panel_table
from augur.plans.fixtures import polls as poll_table
from augur.plans.registry import query

#: erf in DuckDB: the same series, its double factorial through gamma.
ERF = "(sign({x}) * CASE WHEN abs({x}) >= 6 THEN 1.0 ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) * list_sum(list_transform(range(0, 121), lambda n: pow(2.0, n) * pow(abs({x}), 2 * n + 1) * sqrt(pi()) / (pow(2.0, n + 1) * gamma(n + 1.5)))) END)"


def erf_sql(x: str) -> str:
    return ERF.replace("{x}", x)


def horner_sql(coefficients: list[float], x: str) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r})::DOUBLE)"
    return out


def quantile_sql(p: str) -> str:
    """The standard normal's quantile, by the same rational functions."""
    tail = lambda q: f"({horner_sql(ACKLAM_C, q)} / {horner_sql(ACKLAM_D, q)})"
    mid = f"(({p}) - 0.5)"
    return f"(CASE WHEN {p} < {TAIL} THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 1 - {TAIL} THEN -{tail(f'sqrt(-2 * ln(1 - ({p})))')} ELSE {horner_sql(ACKLAM_A, f'({mid} * {mid})')} * {mid} / {horner_sql(ACKLAM_B, f'({mid} * {mid})')} END)"


def crps_sql(mean: str, sd: str, y: str) -> str:
    z = f"(({y} - {mean}) / {sd})"
    return f"({sd} * ({z} * {erf_sql(f'({z} / sqrt(2.0))')} + 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) - 1 / sqrt(pi())))"


def joint_sql(cells: str, by: str, draws: int) -> str:
    """CTEs: js has energy, structure and level of each `by` of the relation cells (by, cell of 16, mean, sd, outcome)."""
    return f"""z AS (SELECT dim, list({quantile_sql('p')} ORDER BY h) AS z FROM (SELECT dim, (i + 0.5) / {draws} AS p, sha256('{profiles.SEED}:' || dim || ':' || i) AS h FROM range(0, 16) a(dim), range(0, {draws}) b(i)) GROUP BY dim),
  vs AS (SELECT {by}, d, list(mean + sd * z[d] ORDER BY cell)::DOUBLE[16] AS x, list(outcome ORDER BY cell)::DOUBLE[16] AS y FROM {cells} JOIN z ON dim = cell, range(1, {draws + 1}) t(d) GROUP BY ALL),
  vm AS (SELECT *, list_avg(x::DOUBLE[]) AS mx, list_avg(y::DOUBLE[]) AS my FROM vs), vc AS MATERIALIZED (SELECT *, list_transform(x::DOUBLE[], lambda v: v - mx)::DOUBLE[16] AS cx, list_transform(y::DOUBLE[], lambda v: v - my)::DOUBLE[16] AS cy FROM vm),
  one AS (SELECT {by}, avg(array_distance(x, y)) AS e1, avg(array_distance(cx, cy)) AS s1, avg(abs(mx - my)) AS l1 FROM vc GROUP BY ALL),
  two AS (SELECT {', '.join(f'a.{c}' for c in by.split(', '))}, sum(array_distance(a.x, b.x)) / {draws}.0 / {draws} AS e2, sum(array_distance(a.cx, b.cx)) / {draws}.0 / {draws} AS s2, sum(abs(a.mx - b.mx)) / {draws}.0 / {draws} AS l2 FROM vc a JOIN vc b ON {' AND '.join(f'a.{c} = b.{c}' for c in by.split(', '))} AND a.d < b.d GROUP BY ALL),
  js AS (SELECT {by}, e1 - e2 AS energy, s1 - s2 AS structure, l1 - l2 AS level FROM one JOIN two USING ({by}))"""


WALK = f"""{OBS}, steps AS (SELECT *, row_number() OVER w - 1 AS n_before, lag(value) OVER w AS last, avg(value) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS clim FROM obs WINDOW w AS (PARTITION BY series ORDER BY date))"""


@query(f"""WITH {WALK} SELECT series, {r('CASE WHEN avg(abs(value - last)) = 0 THEN 0.0 ELSE 1 - avg(abs(value - clim)) / avg(abs(value - last)) END')} AS skill, count(*) AS n FROM steps WHERE n_before >= 8 GROUP BY series""")
def walk_forward_skill(spark: SparkSession, d: str) -> DataFrame:
    w = nulls.series_window()
    o = obs_table(spark, d).withColumns({"n_before": F.row_number().over(w) - 1, "last": F.lag("value").over(w), "clim": F.avg("value").over(w.rowsBetween(-24, -1))}).where(F.col("n_before") >= nulls.WARMUP)
    base, own = F.avg(F.abs(F.col("value") - F.col("last"))), F.avg(F.abs(F.col("value") - F.col("clim")))
    return o.groupBy("series").agg(rounded(S.skill(own, base)).alias("skill"), F.count("*").alias("n"))


NULLS = f"""{OBS}, x AS (SELECT *, CAST(date - DATE '1970-01-01' AS DOUBLE) AS d, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM obs),
  st AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series ORDER BY date)) AS step FROM x),
  past AS (SELECT a.series, a.date, a.value, a.d, a.i, count(*) FILTER (b.i >= a.i - 8) AS n, regr_slope(b.value, b.d) FILTER (b.i >= a.i - 8) AS slope, regr_intercept(b.value, b.d) FILTER (b.i >= a.i - 8) AS icept,
    regr_syy(b.value, b.d) FILTER (b.i >= a.i - 8) AS syy, regr_sxy(b.value, b.d) FILTER (b.i >= a.i - 8) AS sxy, max(b.d) AS last_d, max_by(b.value, b.i) AS last, avg(b.value) FILTER (b.i >= a.i - 24) AS clim, coalesce(stddev_samp(b.value) FILTER (b.i >= a.i - 24), 0.0) AS clim_sd,
    greatest(coalesce(avg(b.step) FILTER (b.i >= a.i - 12), 1.0), 1.0) AS ewma_sd, sum(CASE WHEN b.i = 1 THEN pow(0.6, a.i - 2) ELSE 0.4 * pow(0.6, a.i - 1 - b.i) END * b.value) AS ewma
    FROM x a JOIN st b ON a.series = b.series AND b.i < a.i GROUP BY ALL)"""


@query(f"""WITH {NULLS} SELECT series, date, value, CAST(i - 1 AS BIGINT) AS n_before, {r('last')} AS persistence_mean, {r('CASE WHEN n >= 3 THEN icept + slope * least(d, last_d + 21) ELSE last END')} AS trend_mean,
  {r('CASE WHEN n >= 3 THEN greatest(1.5 * sqrt(greatest(syy - slope * sxy, 0.0) / greatest(n - 2, 1)), 1.0) * sqrt(1 + (d - last_d) / 30.0) ELSE 1.5 END', 4)} AS trend_sd, {r('ewma')} AS ewma_mean, {r('ewma_sd')} AS ewma_sd, {r('clim')} AS climatology_mean, {r('greatest(clim_sd, 1.0)')} AS climatology_sd FROM past""")
def null_forecasts(spark: SparkSession, d: str) -> DataFrame:
    wide = nulls.with_nulls(obs_table(spark, d), places=None).where("n_before > 0")
    names = ("persistence_mean", "trend_mean", "ewma_mean", "ewma_sd", "climatology_mean", "climatology_sd")
    return wide.select("series", "date", "value", F.col("n_before").cast("long").alias("n_before"), *[rounded(c).alias(c) for c in names], rounded("trend_sd", 4).alias("trend_sd"))


@query(f"""WITH {WALK}, e AS (SELECT series, date, 'persistence' AS entrant, last AS m, value FROM steps WHERE n_before >= 8 UNION ALL SELECT series, date, 'climatology', clim, value FROM steps WHERE n_before >= 8),
  l AS (SELECT *, abs(m - value) AS loss, (SELECT max(date) FROM steps) - date AS age FROM e), s AS (SELECT 'all' AS span, * FROM l UNION ALL SELECT '6m', * FROM l WHERE age <= 183 UNION ALL SELECT '30d', * FROM l WHERE age <= 30 UNION ALL SELECT 'last', * FROM l WHERE age = 0),
  b AS (SELECT span, entrant, avg(loss) AS mean_loss, count(*) AS n FROM s GROUP BY 1, 2)
  SELECT b.span, b.entrant, {r('b.mean_loss')} AS mean_loss, b.n, {r('CASE WHEN p.mean_loss = 0 THEN 0.0 ELSE 1 - b.mean_loss / p.mean_loss END')} AS skill FROM b JOIN b p ON b.span = p.span AND p.entrant = 'persistence'""")
def backtest_spans(spark: SparkSession, d: str) -> DataFrame:
    w = nulls.series_window()
    o = obs_table(spark, d).withColumns({"n_before": F.row_number().over(w) - 1, "last": F.lag("value").over(w), "clim": F.avg("value").over(w.rowsBetween(-24, -1))}).where(F.col("n_before") >= nulls.WARMUP)
    both = F.explode(F.array(F.struct(F.lit("persistence").alias("entrant"), F.col("last").alias("m")), F.struct(F.lit("climatology").alias("entrant"), F.col("clim").alias("m"))))
    long = o.select("series", "date", "value", both.alias("f")).select("series", "date", "f.entrant", F.abs(F.col("f.m") - F.col("value")).alias("loss"))
    return boards.spans(long, []).select("span", "entrant", rounded("mean_loss").alias("mean_loss"), "n", rounded("skill").alias("skill"))


CRPS_WALK = f"""{NULLS}, wide AS (SELECT series, date, value, i - 1 AS n_before, last AS persistence_mean, 1.5 AS persistence_sd, CASE WHEN n >= 3 THEN icept + slope * least(d, last_d + 21) ELSE last END AS trend_mean, CASE WHEN n >= 3 THEN greatest(1.5 * sqrt(greatest(syy - slope * sxy, 0.0) / greatest(n - 2, 1)), 1.0) * sqrt(1 + (d - last_d) / 30.0) ELSE 1.5 END AS trend_sd, ewma AS ewma_mean, ewma_sd, clim AS climatology_mean, greatest(clim_sd, 1.0) AS climatology_sd FROM past),
  lg AS ({' UNION ALL '.join(f"SELECT series, date, '{b}' AS entrant, {b}_mean AS m, {b}_sd AS s, value FROM wide WHERE n_before >= 8" for b in nulls.BASELINES)}), ls AS (SELECT series, entrant, {crps_sql('m', 's', 'value')} AS loss FROM lg), bm AS (SELECT series, entrant, avg(loss) AS l, count(*) AS n FROM ls GROUP BY 1, 2)"""


@query(f"""WITH {CRPS_WALK} SELECT b.series, b.entrant, {r('b.l', 5)} AS mean_loss, b.n, {r('CASE WHEN p.l = 0 THEN 0.0 ELSE 1 - b.l / p.l END', 5)} AS skill FROM bm b JOIN bm p ON b.series = p.series AND p.entrant = 'persistence'""")
def walk_forward_crps(spark: SparkSession, d: str) -> DataFrame:
    """The four nulls by CRPS, as they are (walk_forward publishes them to two decimals where a report wants that)."""
    wide = nulls.with_nulls(obs_table(spark, d), places=None).where(F.col("n_before") >= nulls.WARMUP)
    losses = nulls.long_nulls(wide).select("series", "entrant", S.crps_normal(F.col("mean"), F.col("sd"), F.col("outcome")).alias("loss"))
    return boards.skill_of_means(losses, ["series"]).select("series", "entrant", rounded("mean_loss", 5).alias("mean_loss"), "n", rounded("skill", 5).alias("skill"))


@query(f"""WITH {OBS}, {FORECASTS} SELECT series, date, entrant, {r(crps_sql('mean', 'sd', 'value'), 5)} AS crps FROM fc JOIN obs USING (series, date)""")
def crps_of_normals(spark: SparkSession, d: str) -> DataFrame:
    return forecast_table(spark, d).join(obs_table(spark, d), ["series", "date"]).select("series", "date", "entrant", rounded(S.crps_normal(F.col("mean"), F.col("sd"), F.col("value")), 5).alias("crps"))


@query(f"""SELECT CAST(i AS BIGINT) AS i, {r(erf_sql('(i / 50.0)'), 9)} AS erf FROM range(-360, 361) t(i)""")
def erf_table(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(-360, 361).select(F.col("id").alias("i"), rounded(erf(F.col("id") / 50.0), 9).alias("erf"))


@query(f"""WITH {OBS}, e AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, quantile_cont(value, [0.1, 0.5, 0.9]) AS q FROM events GROUP BY 1, 2),
  p AS (SELECT series, date, value, q, [0.1, 0.5, 0.9] AS lv FROM e JOIN obs USING (series, date))
  SELECT series, date, {r('list_sum([2 * CASE WHEN value >= q[i] THEN lv[i] * (value - q[i]) ELSE (1 - lv[i]) * (q[i] - value) END for i in [1, 2, 3]]) / 3')} AS crps FROM p""")
def crps_of_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date")).agg(F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    quantiles = F.map_from_arrays(F.array(F.lit("0.1"), F.lit("0.5"), F.lit("0.9")), "q")
    return e.join(obs_table(spark, d), ["series", "date"]).select("series", "date", rounded(S.crps_quantiles(quantiles, F.col("value"))).alias("crps"))


@query(f"""WITH {OBS}, e AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, list(value) AS xs FROM events GROUP BY 1, 2), p AS (SELECT * FROM e JOIN obs USING (series, date))
  SELECT series, date, {r('list_avg(list_transform(xs, lambda x: abs(x - value))) - 0.5 * list_avg(list_transform(xs, lambda x: list_avg(list_transform(xs, lambda y: abs(x - y)))))')} AS crps FROM p""")
def crps_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Every value of a day is a draw; draws are ranked in a window, so no day is collected into a row."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date"), F.col("value").alias("x"))
    return crowd.crps_of_draws(e, obs_table(spark, d), ["series", "date"]).select("series", "date", rounded("crps").alias("crps"))


@query(f"""WITH p AS (SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n FROM events GROUP BY 1, 2), q AS (SELECT date, event_type, n / sum(n) OVER (PARTITION BY date) AS p, row_number() OVER (PARTITION BY date ORDER BY event_type) - 1 AS i, row_number() OVER (PARTITION BY date ORDER BY n DESC, event_type) AS best FROM p),
  c AS (SELECT *, sum(p) OVER (PARTITION BY date ORDER BY i) AS cum, max(CASE WHEN best = 1 THEN i END) OVER (PARTITION BY date) AS won FROM q)
  SELECT date, {r('sum(pow(cum - CASE WHEN i >= won THEN 1.0 ELSE 0.0 END, 2)) / (count(*) - 1)')} AS rps FROM c GROUP BY date""")
def ranked_probability(spark: SparkSession, d: str) -> DataFrame:
    counts = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("ts").cast("date").alias("date"), "event_type").agg(F.count("*").alias("n"))
    bins = counts.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("event_type", "n"))).alias("b"), F.sum("n").alias("total"), F.min_by("event_type", F.struct(-F.col("n"), F.col("event_type"))).alias("best"))
    return bins.select("date", rounded(S.rps(F.transform("b", lambda x: x["n"] / F.col("total")), F.array_position(F.col("b.event_type"), F.col("best")) - 1)).alias("rps"))


@query(f"""WITH {OBS}, s AS (SELECT *, value - lag(value) OVER w AS d FROM obs WINDOW w AS (PARTITION BY series ORDER BY date)), t AS (SELECT series, d, lead(d) OVER (PARTITION BY series ORDER BY date) AS nx FROM s WHERE d IS NOT NULL),
  m AS (SELECT series, avg(d) AS m, count(*) AS n FROM t GROUP BY 1 HAVING count(*) >= 3), c AS (SELECT series, sum(pow(d - m, 2)) / any_value(n) AS v, sum((d - m) * (nx - m)) / any_value(n) AS c FROM t JOIN m USING (series) GROUP BY 1), k AS (SELECT series, v, least(greatest(-c, 0.0), v / 2) AS m2 FROM c)
  SELECT series, {r('sqrt(m2)')} AS noise, {r('sqrt(greatest(v - 2 * m2, 0.0))', 5)} AS movement FROM k""")
def noise_floor(spark: SparkSession, d: str) -> DataFrame:
    return nulls.noise_floor(obs_table(spark, d)).select("series", rounded("noise").alias("noise"), rounded("movement", 5).alias("movement"))


@query(f"""WITH {OBS}, s AS (SELECT *, abs(value - lag(value, 7) OVER w) AS m, value - lag(value) OVER w AS st FROM obs WINDOW w AS (PARTITION BY series ORDER BY date)), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS n FROM s)
  SELECT series, {r('avg(m)')} AS movement, {r('stddev_samp(st) FILTER (n <= 24)')} AS step_sd FROM k WHERE n <= 60 GROUP BY series""")
def series_movement(spark: SparkSession, d: str) -> DataFrame:
    o = obs_table(spark, d)
    return nulls.weekly_movement(o).join(nulls.step_sd(o), "series").select("series", rounded("movement").alias("movement"), rounded("step_sd").alias("step_sd"))


def w_sql(day: str, asof: str, n: str) -> str:
    return f"(CASE WHEN {asof} - {day} BETWEEN 0 AND 21 THEN pow(0.5, ({asof} - {day}) / 10.0) * sqrt(least({n}, 3000) / 1000.0) ELSE 0.0 END)"


EFFECTS = f"""{POLLS}, anchor AS (SELECT max(date) AS a FROM polls), recent AS (SELECT * FROM polls, anchor WHERE a - date BETWEEN 0 AND 180), days AS (SELECT DISTINCT date FROM recent),
  base AS (SELECT d.date, sum({w_sql('p.date', 'd.date', 'p.n')} * p.value) / nullif(sum({w_sql('p.date', 'd.date', 'p.n')}), 0) AS b FROM days d JOIN polls p ON p.date BETWEEN d.date - 21 AND d.date GROUP BY 1),
  effects AS (SELECT pollster, sum(value - b) / (count(*) + 3.0) AS effect, count(*) AS polls FROM recent JOIN base USING (date) WHERE b IS NOT NULL GROUP BY 1)"""


@query(f"WITH {EFFECTS} SELECT pollster, {r('effect')} AS effect, polls FROM effects")
def house_effects(spark: SparkSession, d: str) -> DataFrame:
    p = poll_table(spark, d)
    return polls.house_effects(p, polls.anchor_of(p)).select("pollster", rounded("effect").alias("effect"), "polls")


@query(f"""WITH {EFFECTS}, dates AS (SELECT CAST(a - 7 * CAST(w AS INTEGER) AS DATE) AS seen FROM anchor, range(0, 52) t(w)),
  av AS (SELECT seen, sum({w_sql('p.date', 'seen', 'p.n')} * (p.value - coalesce(effect, 0.0))) / nullif(sum({w_sql('p.date', 'seen', 'p.n')}), 0) AS v, count(*) FILTER ({w_sql('p.date', 'seen', 'p.n')} > 0) AS polls FROM dates JOIN polls p ON p.date BETWEEN seen - 21 AND seen LEFT JOIN effects USING (pollster) GROUP BY 1)
  SELECT seen AS date, {r('v')} AS value, polls FROM av WHERE v IS NOT NULL""")
def poll_average_weekly(spark: SparkSession, d: str) -> DataFrame:
    return polls.weekly_series(poll_table(spark, d)).select("date", rounded("value").alias("value"), "polls")


@query(f"""WITH {POLLS} SELECT date, value FROM (SELECT date, value, row_number() OVER (PARTITION BY date ORDER BY end_date DESC, pollster DESC, value DESC) AS k FROM polls) WHERE k = 1""")
def poll_series(spark: SparkSession, d: str) -> DataFrame:
    return polls.to_series(poll_table(spark, d))


@query(f"""WITH {POLLS} SELECT date, value FROM (SELECT date, value, row_number() OVER (PARTITION BY date ORDER BY population = 'a' DESC, end_date DESC, pollster DESC, value DESC) AS k FROM polls) WHERE k = 1""")
def poll_history(spark: SparkSession, d: str) -> DataFrame:
    return polls.poll_history(poll_table(spark, d))


@query(f"""WITH {OBS} SELECT series, date, {r('avg(value) OVER (PARTITION BY series ORDER BY date RANGE BETWEEN INTERVAL 21 DAYS PRECEDING AND CURRENT ROW)')} AS avg_before FROM obs""")
def trailing_average(spark: SparkSession, d: str) -> DataFrame:
    return polls.running_average(obs_table(spark, d), 21).select("series", "date", rounded("avg_before").alias("avg_before"))




@query(f"""WITH e AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, 'm' || (user_id % 5) AS entrant, value FROM events),
  lv AS (SELECT i / 40.0 AS lv FROM range(1, 40) t(i)), n AS (SELECT series, date, entrant, list_sort(list(value)) AS xs FROM e GROUP BY 1, 2, 3),
  v AS (SELECT series, date, entrant, [xs[1], list_avg(xs), xs[len(xs)]] AS q FROM n), x AS (SELECT series, date, entrant, CASE WHEN lv <= 0.1 THEN q[1] WHEN lv >= 0.9 THEN q[3] WHEN lv <= 0.5 THEN q[1] + (lv - 0.1) / 0.4 * (q[2] - q[1]) ELSE q[2] + (lv - 0.5) / 0.4 * (q[3] - q[2]) END AS x FROM v, lv)
  SELECT series, date, count(DISTINCT entrant) AS members, {r('avg(x)', 4)} AS mean, {r('stddev_pop(x)', 4)} AS sd, {r('quantile_cont(x, 0.5)', 4)} AS median FROM x GROUP BY 1, 2 HAVING count(DISTINCT entrant) >= 2""")
def crowd_numbers(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("entrant")).agg(F.min("value").alias("a"), F.avg("value").alias("b"), F.max("value").alias("c"))
    q = F.map_from_arrays(F.array(F.lit("0.1"), F.lit("0.5"), F.lit("0.9")), F.array("a", "b", "c"))
    answers = e.select("series", "date", "entrant", F.struct(F.lit(0.0).alias("mean"), F.lit(1.0).alias("sd"), q.alias("quantiles")).alias("topline"))
    found = crowd.crowd_numbers(answers, ["series", "date"], None)
    return found.select("series", "date", "members", rounded("mean", 4).alias("mean"), rounded("sd", 4).alias("sd"), rounded(F.element_at("quantiles", "0.5"), 4).alias("median"))


@query(f"""WITH {FORECASTS}, lv AS (SELECT i / 40.0 AS lv FROM range(1, 40) t(i)), x AS (SELECT series, date, entrant, mean + sd * {quantile_sql('lv')} AS x FROM fc, lv), c AS (SELECT series, date, count(DISTINCT entrant) AS members, avg(x) AS mean, stddev_pop(x) AS sd, quantile_cont(x, [i / 40.0 for i in range(1, 40)]) AS q FROM x GROUP BY 1, 2 HAVING count(DISTINCT entrant) >= 2)
  SELECT series, date, members, {r('mean', 3)} AS mean, {r('sd', 3)} AS sd, {r('q[1]', 3)} AS low, {r('q[20]', 3)} AS middle, {r('q[39]', 3)} AS high, {r('list_sum(q)', 2)} AS total FROM c""")
def crowd_of_normals(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of normal answers: their quantiles at 39 levels, pooled."""
    f = forecast_table(spark, d).withColumn("topline", F.struct("mean", "sd", F.expr("map_from_arrays(array_repeat('', 0), array_repeat(0D, 0))").alias("quantiles")))
    found, q = crowd.crowd_numbers(f, ["series", "date"], None), F.map_values("quantiles")
    return found.select("series", "date", "members", rounded("mean", 3).alias("mean"), rounded("sd", 3).alias("sd"), *[rounded(F.get(q, F.lit(i)), 3).alias(n) for n, i in (("low", 0), ("middle", 19), ("high", 38))], rounded(F.aggregate(q, F.lit(0.0), lambda acc, x: acc + x), 2).alias("total"))


@query(f"""WITH p AS (SELECT CAST(i AS BIGINT) AS id, i / 1000.0 AS p FROM range(1, 1000) t(i)) SELECT id, {r(quantile_sql('p'), 9)} AS z FROM p""")
def normal_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(1, 1000).select(F.col("id"), rounded(normal_quantile(F.lit(0.0), F.lit(1.0), F.col("id") / 1000), 9).alias("z"))


@query(f"""WITH {PANEL}, b AS (SELECT grp, item, 100 * sum(CASE WHEN option = 'approve' THEN w ELSE 0 END) / sum(w) AS plus, 100 * sum(CASE WHEN option = 'disapprove' THEN w ELSE 0 END) / sum(w) AS minus, sum(w) AS w, sum(w * w) AS w2, count(*) AS n FROM panel WHERE option IS NOT NULL GROUP BY 1, 2)
  SELECT grp, item, {r('plus')} AS share, {r('plus - minus')} AS net, {r('100 * sqrt(plus / 100 * (1 - plus / 100) / (w * w / w2))')} AS se, n FROM b""")
def panel_shares(spark: SparkSession, d: str) -> DataFrame:
    p = panel_table(spark, d).where("option is not null")
    share = panel.share(["approve"])
    return p.groupBy("grp", "item").agg(rounded(share).alias("share"), rounded(panel.net_share(["approve"], ["disapprove"])).alias("net"), rounded(panel.panel_error(share / 100)).alias("se"), F.count("*").alias("n"))


@query(f"""WITH {PANEL}, b AS (SELECT grp, item, 100 * sum(CASE WHEN option = 'approve' THEN w ELSE 0 END) / sum(w) - 100 * sum(CASE WHEN option = 'disapprove' THEN w ELSE 0 END) / sum(w) + 100 AS b FROM panel WHERE option IS NOT NULL GROUP BY 1, 2)
  SELECT grp, {r('sum(b) / 6.7558 + 2.0')} AS index FROM b GROUP BY 1""")
def sentiment_index(spark: SparkSession, d: str) -> DataFrame:
    return panel.sentiment_index(panel_table(spark, d), ["grp"], "approve", "disapprove").select("grp", rounded("index").alias("index"))


@query(f"""WITH {PANEL} SELECT grp, item, option, {r('sum(w)')} AS w FROM panel WHERE option IS NOT NULL GROUP BY 1, 2, 3""")
def panel_tally(spark: SparkSession, d: str) -> DataFrame:
    return panel.tally(panel_table(spark, d), ["grp"]).select("grp", "item", "option", rounded("w").alias("w"))


@query(f"""WITH {PANEL}, k AS (SELECT pid, w FROM panel WHERE item = 'quality' AND grp <> 'en') SELECT pid, {r('w / (SELECT sum(w) FROM k)', 9)} AS w FROM k""")
def panel_weights(spark: SparkSession, d: str) -> DataFrame:
    p = panel_table(spark, d).where("item = 'quality'")
    return panel.renormalised(p, F.col("grp") != "en").select("pid", rounded("w", 9).alias("w"))


@query(f"""WITH {PROFILE_CELLS}, {joint_sql('pc', 'vec_id', profiles.DRAWS)}, cs AS (SELECT vec_id, avg({crps_sql('mean', 'sd', 'outcome')}) AS mean_cell_crps, count(*) AS cells FROM pc GROUP BY 1)
  SELECT vec_id, {r('energy', 5)} AS energy, {r('structure', 5)} AS structure, {r('level', 5)} AS level, {r('mean_cell_crps', 5)} AS mean_cell_crps, cells FROM js JOIN cs USING (vec_id)""")
def profile_scores(spark: SparkSession, d: str) -> DataFrame:
    """Energy, level and structure of 400 joint draws of 16 cells, and the mean CRPS of the cells."""
    cells = profile_cells(spark, d)
    found = profiles.joint_scores(cells, ["vec_id"]).join(profiles.cell_scores(cells, ["vec_id"]), "vec_id")
    return found.select("vec_id", *[rounded(c, 5).alias(c) for c in ("energy", "structure", "level", "mean_cell_crps")], "cells")


@query(f"""WITH c AS (SELECT vec_id, [{r('CAST(embedding[i] AS DOUBLE) * 90', 3)} for i in range(1, 5)] AS y, [[{r('CAST(embedding[i + 4 * k] AS DOUBLE) * 100', 3)} for i in range(1, 5)] for k in range(1, 9)] AS xs FROM embeddings)
  SELECT vec_id, {r('list_avg([list_distance(x, y) for x in xs]) - 0.5 * list_avg([list_avg([list_distance(a, b) for b in xs]) for a in xs])', 5)} AS energy FROM c""")
def energy_native(spark: SparkSession, d: str) -> DataFrame:
    """The energy score as an expression, for eight draws of four cells."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    at = lambda i, scale: rounded(F.get("embedding", F.lit(i - 1)).cast("double") * scale, 3)
    samples = F.array(*[F.array(*[at(i + 4 * k, 100) for k in range(1, 9)]) for i in range(1, 5)])
    return e.select("vec_id", samples.alias("s"), F.array(*[at(i, 90) for i in range(1, 5)]).alias("y")).select("vec_id", rounded(profiles.energy_native(F.col("s"), F.col("y")), 5).alias("energy"))
