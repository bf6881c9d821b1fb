"""Queries: answers, the season's manifest, teams and windows, backtest plans, the series registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.functions import calendar as C
from augur.operators import answers, boards, nulls, panel, rankings, rules, season
from augur.plans.fixtures import OBS, SCORES, r, rounded, table
from augur.plans.fixtures import obs as obs_table
from augur.plans.fixtures import scores as score_table
from augur.plans.registry import query
from augur.sources import readers, registry


def picked(n: str, choices: list[str]) -> Column:
    return F.element_at(F.lit(choices), (F.expr(n) % len(choices) + 1).cast("int"))


def pick(n: str, choices: list[str]) -> str:
    return "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in choices) + f"][({n}) % {len(choices)} + 1]"


MEANS, SDS = ["1.5", "-7", "1e8", "2e3", "NaN", '"x"'], ["0.5", "0", "1e6", "2e6", "0.004"]
EXTRAS = ["", ', "quantiles": []', ', "note": "a"', "", "", ""]


@query(f"""WITH e AS (SELECT event_id, {pick('event_id', MEANS)} AS m, {pick('event_id // 7', SDS)} AS s, {pick('event_id // 3', EXTRAS)} AS x, event_id % 11 = 0 AS nested, event_id % 13 = 0 AS without FROM events),
  p AS (SELECT *, CASE WHEN without THEN 'no JSON object' WHEN nested THEN 'needs mean and sd' WHEN contains(x, 'quantiles') THEN 'quantiles' WHEN m IN ('"x"', 'NaN') THEN 'not a number' WHEN s IN ('0', '2e6') THEN 'sd' WHEN m = '1e8' THEN 'mean' END AS problem FROM e)
  SELECT event_id, problem, CASE WHEN problem IS NULL THEN CAST(m AS DOUBLE) END AS mean, CASE WHEN problem IS NULL THEN CAST(s AS DOUBLE) END AS sd FROM p""")
def number_answers(spark: SparkSession, d: str) -> DataFrame:
    """Replies with prose around a distribution, or with none, a nested one, or one out of bounds."""
    body = F.concat(F.lit('{"mean": '), picked("event_id", MEANS), F.lit(', "sd": '), picked("event_id div 7", SDS), picked("event_id div 3", EXTRAS), F.lit("}"))
    body = F.when(F.col("event_id") % 11 == 0, F.lit('{"cell": {"a": 1}, "mean": 1}')).otherwise(body)
    reply = F.when(F.col("event_id") % 13 == 0, F.lit("I can't tell.")).otherwise(F.concat(F.lit("I think "), body, F.lit(" fits.")))
    return table(spark, d, "events").select("event_id", answers.number_answer(reply).alias("a")).select("event_id", "a.*")


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'missing cells' WHEN 2 THEN 'cells that were not asked for' WHEN 3 THEN 'b: sd' WHEN 4 THEN 'no JSON object' END AS problem, CASE event_id % 5 WHEN 0 THEN CAST(event_id + 0.5 AS DOUBLE) END AS mean_a FROM events""")
def profile_answers(spark: SparkSession, d: str) -> DataFrame:
    cell = lambda name, sd: F.concat(F.lit(f'"{name}": {{"mean": '), F.col("event_id").cast("string"), F.lit(f'.5, "sd": {sd}}}'))
    wrap = lambda *cells: F.concat(F.lit("so {it} is {"), F.concat_ws(", ", *cells), F.lit("}"))
    k = F.col("event_id") % 5
    reply = F.when(k == 1, wrap(cell("a", 1))).when(k == 2, wrap(cell("a", 1), cell("b", 1), cell("c", 1))).when(k == 3, wrap(cell("a", 1), cell("b", 0))).when(k == 4, F.lit("[1, 2]")).otherwise(wrap(cell("a", 1), cell("b", 2)))
    found = answers.with_profile(table(spark, d, "events").select("event_id", reply.alias("reply")), ["a", "b"])
    return found.select("event_id", "problem", F.try_element_at("profile", F.lit("a"))["mean"].alias("mean_a"))


@query("""WITH e AS (SELECT event_id, event_id % 7 AS k FROM events) SELECT event_id, CASE k WHEN 1 THEN 'length' WHEN 2 THEN 'outside the basket' WHEN 3 THEN 'repeated' WHEN 4 THEN 'no ranking' WHEN 5 THEN 'not a list of strings' END AS problem, CASE k WHEN 0 THEN 'Tesla,iPhone,Disney' WHEN 6 THEN 'iPhone,Tesla,Disney' END AS items FROM e""")
def ranking_answers(spark: SparkSession, d: str) -> DataFrame:
    replies = ['Here: {"ranking": [" tesla", "IPHONE", "Disney "]}', '{"ranking": ["Tesla", "Disney"]}', '["Tesla", "Disney", "Netflix"]', '{"ranking": ["Tesla", "Disney", "tesla"]}', '{"list": 1}', '{"ranking": ["Tesla", 5, "Disney"]}', 'first ["iphone", "Tesla", "disney"] then {"a": 1}']
    found = answers.with_ranking(table(spark, d, "events").select("event_id", picked("event_id", replies).alias("reply")), 3, ["Tesla", "iPhone", "Disney"])
    return found.select("event_id", "problem", F.array_join("items", ",").alias("items"))


SUFFIXES = ["", "-web", "-news-superfc", "-zeroshot-persona", "-persona", "-superfc", "-zeroshot"]


@query(f"""WITH e AS (SELECT s_suppkey, s_name || {pick('s_suppkey', SUFFIXES)} AS entrant, s_name AS model, s_suppkey % 7 AS k FROM supplier)
  SELECT entrant, CASE WHEN k <> 4 THEN model END AS model, CASE k WHEN 0 THEN 'recent10' WHEN 1 THEN 'web' WHEN 2 THEN 'news' WHEN 3 THEN 'none' WHEN 5 THEN 'recent10' WHEN 6 THEN 'none' END AS context, CASE WHEN k IN (2, 5) THEN 'superfc' WHEN k = 3 THEN 'persona' WHEN k <> 4 THEN 'direct' END AS elicitation, k <> 4 AS again FROM e""")
def entrant_conditions(spark: SparkSession, d: str) -> DataFrame:
    """What an entrant's id says of its model and condition, and whether the id can be built again from that."""
    s = table(spark, d, "supplier")
    ids = s.select(F.concat("s_name", picked("s_suppkey", SUFFIXES)).alias("entrant"))
    found = answers.resolved_ids(ids, s.select(F.col("s_name").alias("model")))
    return found.withColumn("again", F.coalesce(answers.entrant_id(F.col("model"), F.col("context"), F.col("elicitation")) == F.col("entrant"), F.lit(False)))


SCORED = "e AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN value WHEN 2 THEN -1.0 WHEN 3 THEN 'nan'::DOUBLE ELSE value END AS crps, CASE WHEN event_id % 6 = 4 THEN value WHEN event_id % 12 = 0 THEN value / 2 END AS energy, CASE event_id % 5 WHEN 0 THEN 'test-jay' WHEN 1 THEN 'ewma' ELSE 'm' || user_id END AS entrant, CASE WHEN event_id % 7 = 0 THEN 'MOCK answer' WHEN event_id % 7 = 1 THEN 'fine' END AS notes FROM events)"


@query(f"""WITH {SCORED} SELECT event_id, CASE event_id % 6 WHEN 0 THEN energy WHEN 1 THEN crps WHEN 5 THEN crps END AS loss, NOT coalesce(starts_with(notes, 'MOCK'), false) AND entrant <> 'test-jay' AS scoreable, NOT coalesce(starts_with(notes, 'MOCK'), false) AND entrant NOT IN ('test-jay', 'ewma') AS competes FROM e""")
def single_losses(spark: SparkSession, d: str) -> DataFrame:
    k, v = F.col("event_id") % 6, F.col("value")
    crps = F.when(k == 2, F.lit(-1.0)).when(k == 3, F.lit(float("nan"))).when(k != 0, v)
    energy = F.when(k == 4, v).when(F.col("event_id") % 12 == 0, v / 2)
    score = F.struct(crps.alias("crps"), energy.alias("energy"), F.lit(None).cast("double").alias("loss"))
    entrant = F.when(F.col("event_id") % 5 == 0, "test-jay").when(F.col("event_id") % 5 == 1, "ewma").otherwise(F.concat(F.lit("m"), "user_id"))
    notes = F.when(F.col("event_id") % 7 == 0, "MOCK answer").when(F.col("event_id") % 7 == 1, "fine")
    return table(spark, d, "events").select("event_id", answers.loss_of(score).alias("loss"), answers.scoreable(entrant, notes).alias("scoreable"), answers.competes(entrant, notes).alias("competes"))


@query(f"""WITH c AS (SELECT vec_id, [{r('CAST(embedding[i] AS DOUBLE) * 100', 3)} for i in range(1, 5)] AS m FROM embeddings) SELECT vec_id, CASE WHEN m[2] < 0 OR m[4] < -20 THEN 'missing ' || ((m[2] < 0)::INT + (m[4] < -20)::INT) || ' of 4 cells' END AS problem, CASE WHEN NOT (m[2] < 0 OR m[4] < -20) THEN m[1] END AS first, CASE WHEN NOT (m[2] < 0 OR m[4] < -20) THEN m[4] END AS last FROM c""")
def crosstab_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Cells as vectors; a profile with a hole is refused."""
    cells = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 4)).alias("i", "x")).select("vec_id", F.concat(F.lit("c"), "i").alias("cell"), rounded(F.col("x").cast("double") * 100, 3).alias("mean"), F.lit(1.0).alias("sd"))
    held = cells.withColumn("mean", F.when(~((F.col("cell") == "c1") & (F.col("mean") < 0) | (F.col("cell") == "c3") & (F.col("mean") < -20)), F.col("mean")))
    return answers.submission_vectors(held, ["c0", "c1", "c2", "c3"], ["vec_id"]).select("vec_id", "problem", F.get("means", F.lit(0)).alias("first"), F.get("means", F.lit(3)).alias("last"))


RULES_TEXT = ["the archived snapshot of the page", "the latest value", "by hand", "certified results"]


@query(f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS place, 'r-' || o_orderkey // 2 * 2 || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE '-' || o_orderkey END AS rid, o_orderkey % 17 AS q, o_orderkey % 9 AS hr, o_orderkey % 5 AS sh, o_orderkey % 4 AS ru, o_orderkey % 23 = 0 AS nosource, o_orderstatus, o_orderpriority, o_custkey, CAST(o_orderdate AS TIMESTAMP) AS t, CAST(o_orderdate AS DATE) AS day FROM orders),
  x AS (SELECT *, rid AS k, CASE WHEN o_orderkey % 3 = 0 THEN '[' || o_orderkey END AS z, CASE sh WHEN 0 THEN 'ranking_list' WHEN 1 THEN 'other' ELSE 'continuous_normal' END AS shape, t + to_hours(CAST(CASE WHEN hr = 0 THEN -3 WHEN hr < 3 THEN 24 ELSE 48 END AS BIGINT)) AS rel, CASE WHEN nosource THEN NULL WHEN o_orderpriority = '5-LOW' THEN 'civiqs' ELSE 'umich' END AS source, {pick('ru', RULES_TEXT)} AS rule FROM o),
  y AS (SELECT *, q <> 0 AS whole, q <> 0 AND shape <> 'other' AS shaped, q <> 0 AND shape <> 'other' AND source IS NOT NULL AS known, CASE WHEN shape <> 'ranking_list' THEN strftime(rel, '%Y-%m-%d') END AS rday FROM x),
  w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY place) > 1 AS again, row_number() OVER (PARTITION BY shape, o_custkey, rday, known ORDER BY place) > 1 AS dup FROM y),
  p AS (SELECT k AS round_id, 'missing' AS kind, 'unit' AS problem FROM w WHERE NOT whole UNION ALL SELECT k, 'text', 'a text is empty' FROM w WHERE whole AND q = 1 UNION ALL SELECT k, 'repeated', 'round_id' FROM w WHERE whole AND again UNION ALL SELECT k, 'shape', 'unknown shape' FROM w WHERE whole AND shape = 'other' UNION ALL SELECT k, 'shape', 'a list round without its list' FROM w WHERE whole AND shape = 'ranking_list' AND q = 2
    UNION ALL SELECT k, 'source', 'neither registered nor audited' FROM w WHERE shaped AND source IS NULL UNION ALL SELECT k, 'rights', 'unresolved' FROM w WHERE known AND source = 'umich' AND o_orderstatus = 'X' UNION ALL SELECT k, 'rights', 'refused' FROM w WHERE known AND source = 'civiqs'
    UNION ALL SELECT k, 'schedule', CASE WHEN t >= rel THEN 'lock not before release' WHEN shape = 'ranking_list' AND CAST(t AS DATE) >= day - 3 THEN 'locks within the measured week' WHEN source = 'civiqs' AND isodow(rel) <> 5 THEN 'not a Friday' WHEN rel - t <> INTERVAL 48 HOURS THEN 'not 48 hours' END FROM w WHERE known
    UNION ALL SELECT k, 'rule', CASE ru WHEN 1 THEN 'moves' WHEN 2 THEN 'names no artifact' END FROM w WHERE known AND ru IN (1, 2) UNION ALL SELECT k, 'target', 'already published' FROM w WHERE known AND dup) SELECT round_id, kind, problem FROM p WHERE problem IS NOT NULL""")
def season_problems(spark: SparkSession, d: str) -> DataFrame:
    """All that keeps a manifest's rounds, as orders, from being published."""
    key, text = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    t = F.col("o_orderdate").cast("timestamp")
    release = t + F.make_dt_interval(F.lit(0), F.when(key % 9 == 0, -3).when(key % 9 < 3, 24).otherwise(48))
    rid = F.concat(F.lit("r-"), F.floor(key / 2) * 2, F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("-"), key)))
    shape = F.when(key % 5 == 0, "ranking_list").when(key % 5 == 1, "other").otherwise("continuous_normal")
    q = key % 17
    rounds = table(spark, d, "orders").select(
        rid.alias("round_id"), key.alias("place"), F.lit("t").alias("tracker"), F.lit("s").alias("series"), F.when(q == 1, "  ").otherwise("what?").alias("question"), F.when(q != 0, "points").alias("unit"), text(release).alias("release_at"), F.lit(True).alias("release_estimated"), text(t).alias("lock_at"), picked("o_orderkey", RULES_TEXT).alias("resolve"),
        shape.alias("target_type"), F.when(key % 23 == 0, F.lit(None)).when(F.col("o_orderpriority") == "5-LOW", "civiqs").otherwise("umich").alias("source"), F.lit(False).alias("has_cells"), ((key % 5 == 0) & (q != 2)).alias("has_ranking"), F.col("o_custkey").cast("string").alias("identity"),
        F.date_sub(t.cast("date"), 3).alias("week_start"), (F.date_sub(t.cast("date"), 3)).alias("week_end"))
    rights = spark.createDataFrame([("umich", "approved"), ("civiqs", "refused")], "source string, state string")
    return season.round_problems(rounds, rights)


@query(f"""WITH {OBS}, st AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY date) AS s, lead(value) OVER (PARTITION BY series ORDER BY date) - value AS nx FROM obs), m AS (SELECT series, avg(s) AS m FROM st WHERE s IS NOT NULL GROUP BY 1), v AS (SELECT series, sum(pow(s - m, 2)) / count(*) AS v, sum((s - m) * (nx - m)) / count(*) AS c FROM st JOIN m USING (series) WHERE s IS NOT NULL GROUP BY 1),
  n AS (SELECT series, sqrt(least(greatest(-c, 0.0), v / 2)) AS noise, sqrt(greatest(v - 2 * least(greatest(-c, 0.0), v / 2), 0.0)) AS mv FROM v), p AS (SELECT series, count(*) AS points FROM obs GROUP BY 1)
  SELECT series, {r('CASE WHEN noise = 0 THEN 1e9 ELSE mv / noise END', 4)} AS ratio, CASE WHEN series = 'view' THEN 'rights' WHEN series = 'signup' THEN 'retired_template' WHEN series = 'click' THEN 'schedule' WHEN points < 12 THEN 'history' WHEN mv <= 1e-6 THEN 'volatility' ELSE 'ok' END AS verdict FROM n JOIN p USING (series)""")
def series_gate(spark: SparkSession, d: str) -> DataFrame:
    """The ordered publishing gate over every series, with its movement against its noise."""
    o, name = obs_table(spark, d), F.col("series")
    signal = nulls.signal_to_noise(o).withColumn("movement", F.when(F.col("movement") > 1e-6, F.col("movement")).otherwise(0.0))
    points = o.groupBy("series").agg(F.count("*").alias("points"))
    facts = signal.join(points, "series").select("series", "ratio", "movement", "points", F.when(name == "view", "unresolved").otherwise("approved").alias("state"), (name == "signup").alias("retired"), F.lit(False).alias("parked"), F.lit(False).alias("declined"), F.lit(True).alias("supported"), F.when(name == "click", "slips").alias("schedule"))
    return season.publishing_gate(facts).join(facts, "series").select("series", rounded(F.when(F.col("ratio") == float("inf"), 1e9).otherwise(F.col("ratio")), 4).alias("ratio"), "verdict")


@query("""WITH e AS (SELECT o_custkey AS series, CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY 1, 2), k AS (SELECT *, isodow(day) - 1 <> 2 AS off, day - lag(day) OVER (PARTITION BY series ORDER BY day) AS gap, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS n FROM e)
  SELECT series, CASE WHEN count(*) < 8 THEN 'too few waves' WHEN count(*) FILTER (off) + count(*) FILTER (n < 8 AND NOT coalesce(gap BETWEEN 1 AND 8, true)) > 1 THEN 'slips' END AS problem FROM k WHERE n <= 8 GROUP BY 1""")
def calendar_slips(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("series"), F.col("o_orderdate").cast("date").alias("day")).distinct()
    return season.calendar_slips(e.withColumn("weekday", F.lit(2)))


OPEN = "k AS (SELECT o_orderkey AS round_id, CASE o_orderstatus WHEN 'F' THEN 'resolved' ELSE 'open' END AS status, CAST(o_orderdate AS TIMESTAMP) AS lock_at FROM orders)"


@query(f"WITH {OPEN} SELECT round_id, strftime(lock_at, '%Y-%m-%d') AS deadline FROM k WHERE status = 'open' AND lock_at > TIMESTAMP '2000-06-01 12:00:00'")
def rounds_open(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("round_id"), F.when(F.col("o_orderstatus") == "F", "resolved").otherwise("open").alias("status"), F.col("o_orderdate").cast("timestamp").alias("lock_at"))
    return season.open_rounds(season.publishable(o, "2000-06-01 12:00:00"), "2000-06-01 12:00:00").select("round_id", F.date_format("deadline", "yyyy-MM-dd").alias("deadline"))


@query("""WITH l AS (SELECT c_custkey AS round_id, '2000-01-01' AS lock_at FROM customer WHERE c_acctbal >= 0), g AS (SELECT o_custkey AS round_id, '2000-01-01' AS lock_at, CASE WHEN max(o_orderpriority) = '5-LOW' THEN strftime(max(o_orderdate), '%Y-%m-%d') END AS withdrawn_at FROM orders GROUP BY 1) SELECT * FROM l UNION ALL SELECT round_id, lock_at FROM g WHERE coalesce(withdrawn_at, '') > lock_at AND NOT EXISTS (SELECT 1 FROM l WHERE l.round_id = g.round_id)""")
def rounds_as_asked(spark: SparkSession, d: str) -> DataFrame:
    live = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("round_id"), F.lit("2000-01-01").alias("lock_at"))
    gone = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("round_id")).agg(F.max("o_orderpriority").alias("p"), F.max("o_orderdate").alias("t"))
    gone = gone.select("round_id", F.lit("2000-01-01").alias("lock_at"), F.when(F.col("p") == "5-LOW", F.date_format("t", "yyyy-MM-dd")).alias("withdrawn_at"), F.lit("x").alias("withdrawn_reason"))
    return season.as_asked(live, gone)


@query("""WITH f AS (SELECT o_custkey AS round_id, o_orderpriority AS field, max(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), u AS (SELECT o_custkey AS round_id, o_orderpriority AS field, max(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) SELECT round_id, field, coalesce(u.value, f.value) AS value FROM f FULL JOIN u USING (round_id, field)""")
def merged_snapshots(spark: SparkSession, d: str) -> DataFrame:
    side = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("round_id"), F.col("o_orderpriority").alias("field")).agg(F.max("o_orderkey").alias("value"))
    return season.merge_snapshots(side("F"), side("O"))


PLAN = f"{OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS b FROM obs), en AS (SELECT n_name AS entrant, n_regionkey AS model, DATE '2024-01-05' + CAST(n_nationkey AS INTEGER) AS start FROM nation), tk AS (SELECT series, date, value AS outcome, b AS n_before, entrant, model FROM n JOIN en ON date >= start WHERE b >= 8)"


def plan_of(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("entrant"), F.col("n_regionkey").alias("model"), F.date_add(F.lit("2024-01-05").cast("date"), F.col("n_nationkey")).alias("start"))
    return season.task_plan(obs_table(spark, d), n).join(n.select("entrant", "model"), "entrant")


@query(f"WITH {PLAN} SELECT series, date, outcome, n_before, entrant FROM tk")
def backtest_plan(spark: SparkSession, d: str) -> DataFrame:
    return plan_of(spark, d).select("series", "date", "outcome", F.col("n_before").cast("long").alias("n_before"), "entrant")


@query(f"""WITH {PLAN}, c AS (SELECT *, series = 'view' AS cached FROM tk), m AS (SELECT r_regionkey AS model, 1.0 + r_regionkey AS i, 5.0 + r_regionkey AS o, r_regionkey % 2 = 0 AS reasoning FROM region WHERE r_regionkey <> 3) SELECT entrant, count(*) AS calls, {r('sum(400 / 1e6 * coalesce(i, 2.0) + CASE WHEN coalesce(reasoning, false) THEN 500 ELSE 150 END / 1e6 * coalesce(o, 10.0))')} AS usd FROM c LEFT JOIN m USING (model) WHERE NOT cached GROUP BY 1""")
def backtest_costs(spark: SparkSession, d: str) -> DataFrame:
    models = table(spark, d, "region").where("r_regionkey <> 3").select(F.col("r_regionkey").alias("model"), (1.0 + F.col("r_regionkey")).alias("per_in"), (5.0 + F.col("r_regionkey")).alias("per_out"), (F.col("r_regionkey") % 2 == 0).alias("reasoning"))
    return season.estimated_costs(plan_of(spark, d).withColumn("cached", F.col("series") == "view"), models).select("entrant", "calls", rounded("usd").alias("usd"))


@query(f"""WITH {OBS}, k AS (SELECT series, value - lag(value) OVER (PARTITION BY series ORDER BY date) AS st, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS n FROM obs), s AS (SELECT series, stddev_samp(st) AS sd FROM k WHERE n <= 24 GROUP BY 1) SELECT series, {r('greatest(sqrt(4.0 + sd * sd), 0.5)', 3)} AS sd FROM s""")
def panel_spreads(spark: SparkSession, d: str) -> DataFrame:
    return nulls.step_sd(obs_table(spark, d)).select("series", rounded(season.panel_sd(F.lit(2.0), F.col("step_sd")), 3).alias("sd"))


@query("""SELECT o_orderkey AS round_id, o_orderpriority AS series, o_orderstatus AS status FROM orders""")
def public_projection(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("round_id"), F.col("o_orderpriority").alias("series"), F.col("o_orderstatus").alias("status"), "o_totalprice", "o_custkey")
    return season.public_rows(o)


WINDOWS = f"""{SCORES}, tm AS (SELECT round_id, date, CASE WHEN entrant IN ('m1', 'm2') THEN 'team' ELSE entrant END AS entrant, loss, CASE entrant WHEN 'm2' THEN 1 WHEN 'm1' THEN 2 ELSE 0 END AS pl FROM scores WHERE NOT (entrant = 'm2' AND day(date) % 3 = 0)), t1 AS (SELECT round_id, date, entrant, min_by(loss, pl) AS loss FROM tm GROUP BY 1, 2, 3),
  sc AS (SELECT 'all' AS win, * FROM t1 UNION ALL SELECT 's0', * FROM t1 WHERE date >= DATE '2024-01-10' AND entrant <> 'm4' UNION ALL SELECT 'matched', * FROM t1 WHERE round_id IN (SELECT round_id FROM t1 GROUP BY 1 HAVING count(DISTINCT entrant) = (SELECT count(DISTINCT entrant) FROM t1))),
  pl AS (SELECT *, count(*) OVER (PARTITION BY win, round_id) AS n, rank() OVER (PARTITION BY win, round_id ORDER BY loss) AS place, count(*) OVER (PARTITION BY win, round_id, loss) AS tied FROM sc), po AS (SELECT *, 100 * (n - place - tied + 1 + 0.5 * (tied - 1)) / (n - 1) AS points, greatest(0, least(tied, 3 - place + 1)) / tied AS top3 FROM pl WHERE n > 1), nr AS (SELECT win, count(DISTINCT round_id) AS k FROM po GROUP BY 1)"""


@query(f"""WITH {WINDOWS} SELECT win AS "window", entrant, {r('sum(points) / any_value(k)')} AS pairwise, {r('sum(top3) / any_value(k)')} AS top3, count(*) AS answered FROM po JOIN nr USING (win) GROUP BY 1, 2""")
def pairwise_windows(spark: SparkSession, d: str) -> DataFrame:
    """Standings over all rounds, the season's and the matched ones; two entrants are a team whose second member steps in where the first has no score."""
    s = score_table(spark, d).where("not (entrant = 'm2' and day(date) % 3 = 0)").select("round_id", "entrant", "loss", F.col("date").cast("timestamp").alias("lock_at"))
    members = spark.createDataFrame([("team", "m2", 1), ("team", "m1", 2)], "team string, entrant string, place int")
    found = boards.pairwise_windows(boards.as_teams(s, members), "2024-01-10", ["persistence", "team", "m0", "m3"])
    return found.select("window", "entrant", rounded("pairwise").alias("pairwise"), rounded("top3").alias("top3"), "answered")


@query(f"""WITH {SCORES}, s AS (SELECT * FROM scores WHERE NOT (entrant = 'm2' AND day(date) % 3 = 0)), b AS (SELECT round_id, loss AS nl FROM s WHERE entrant = 'persistence'), k AS (SELECT s.*, nl FROM s JOIN b USING (round_id)), f AS (SELECT entrant FROM k GROUP BY 1 HAVING count(DISTINCT round_id) = (SELECT count(DISTINCT round_id) FROM k)) SELECT entrant, {r('avg(CASE WHEN nl = 0 THEN 0.0 ELSE 1 - loss / nl END)', 5)} AS skill, {r('avg(loss)')} AS loss, count(*) AS rounds FROM k SEMI JOIN f USING (entrant) GROUP BY 1""")
def matched_shapes(spark: SparkSession, d: str) -> DataFrame:
    s = score_table(spark, d).where("not (entrant = 'm2' and day(date) % 3 = 0)")
    return boards.matched_shape_board(s, ["loss"]).select("entrant", rounded("skill", 5).alias("skill"), rounded("loss").alias("loss"), "rounds")


@query(f"""WITH {SCORES}, m AS (SELECT entrant, avg(loss) AS l FROM scores GROUP BY 1) SELECT row_number() OVER (ORDER BY l DESC, entrant) AS place, entrant, {r('l', 4)} AS loss FROM m""")
def published_board(spark: SparkSession, d: str) -> DataFrame:
    board = score_table(spark, d).groupBy("entrant").agg(F.avg("loss").alias("loss"))
    return boards.board_rows(board, "loss").select(F.col("place").cast("long").alias("place"), "entrant", rounded("loss", 4).alias("loss"))


@query(f"""WITH {SCORES}, pl AS (SELECT *, count(*) OVER (PARTITION BY round_id) AS n, rank() OVER (PARTITION BY round_id ORDER BY loss) AS place, count(*) OVER (PARTITION BY round_id, loss) AS tied FROM scores), po AS (SELECT *, 100 * (n - place - tied + 1 + 0.5 * (tied - 1)) / (n - 1) AS points FROM pl WHERE n > 1), rd AS (SELECT date, count(DISTINCT round_id) AS k FROM po GROUP BY 1), rn AS (SELECT date, sum(k) OVER (ORDER BY date) AS k FROM rd), en AS (SELECT DISTINCT entrant FROM po), dy AS (SELECT entrant, date, sum(points) AS p FROM po GROUP BY 1, 2)
  SELECT entrant, count(*) AS days, {r('sum(v)', 3)} AS total FROM (SELECT en.entrant, rn.date, sum(coalesce(p, 0.0)) OVER (PARTITION BY en.entrant ORDER BY rn.date) / k AS v FROM en CROSS JOIN rn LEFT JOIN dy ON dy.entrant = en.entrant AND dy.date = rn.date) GROUP BY 1""")
def trajectory_arrays(spark: SparkSession, d: str) -> DataFrame:
    found = boards.series_of_days(boards.pairwise_trajectory(score_table(spark, d)), 9)
    return found.select("entrant", F.size("dates").cast("long").alias("days"), rounded(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query("""WITH s AS (SELECT event_type AS series, max(CAST(ts AS DATE)) + 953 AS last, CAST(length(event_type) % 7 AS INTEGER) AS wd FROM events GROUP BY 1), f AS (SELECT *, last + 7 + CAST((wd - (isodow(last + 7) - 1) + 7) % 7 AS INTEGER) AS first FROM s), k AS (SELECT series, CAST(first + CAST(7 * w AS INTEGER) AS TIMESTAMP) + INTERVAL 14 HOURS AS rel FROM f, range(0, 60) t(w)),
  c AS (SELECT series, rel, rel - INTERVAL 48 HOURS AS lock, 'mc-' || isoyear(rel) || '-w' || lpad(CAST(week(rel) AS VARCHAR), 2, '0') || '-' || series AS round_id FROM k WHERE rel > TIMESTAMP '2026-09-20 09:00:00' AND date_trunc('week', rel - INTERVAL 48 HOURS - INTERVAL 12 HOURS - INTERVAL 1 MICROSECOND) + INTERVAL 12 HOURS >= TIMESTAMP '2026-09-14 12:00:00'),
  l AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY rel) AS n FROM c WHERE lock > TIMESTAMP '2026-09-20 09:00:00' AND floor(epoch(rel - TIMESTAMP '2026-09-20 09:00:00') / 86400) <= 56 AND round_id NOT LIKE '%-w40-click') SELECT series, round_id, strftime(lock, '%Y-%m-%d %H') AS lock_at FROM l WHERE n <= 5""")
def scalar_rounds(spark: SparkSession, d: str) -> DataFrame:
    """The next five rounds of every series, one of which is listed already."""
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("series")).agg(F.date_add(F.max("ts").cast("date"), 953).alias("last"))
    s = s.select("series", F.lit("mc").alias("prefix"), F.col("series").alias("suffix"), "last", (F.length("series") % 7).alias("weekday"), F.lit(14).alias("hour"))
    taken = spark.createDataFrame([("mc-2026-w40-click",)], "round_id string")
    return season.scalar_candidates(s, taken, "2026-09-20 09:00:00", 5).select("series", "round_id", F.date_format("lock_at", "yyyy-MM-dd HH").alias("lock_at"))


@query("""WITH k AS (SELECT n_nationkey % 4 AS f, n_nationkey, DATE '2026-08-31' + CAST(7 * w AS INTEGER) AS ws, TIMESTAMP '2026-08-29 12:00:00' + to_days(CAST(7 * w AS INTEGER)) AS lock, TIMESTAMP '2026-09-08 15:00:00' + to_days(CAST(7 * w AS INTEGER)) AS rel FROM nation, range(1, 30) t(w)),
  c AS (SELECT *, 'f' || n_nationkey || '-' || CASE WHEN f < 2 THEN CAST(ws + 6 AS VARCHAR) ELSE isoyear(rel) || '-w' || lpad(CAST(week(rel) AS VARCHAR), 2, '0') END || CASE WHEN f = 3 THEN '-cells' ELSE '' END AS round_id FROM k), l AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY rel) AS n FROM c WHERE lock > TIMESTAMP '2026-10-01' AND floor(epoch(rel - TIMESTAMP '2026-10-01') / 86400) <= 56)
  SELECT 'f' || n_nationkey AS family, round_id, strftime(lock, '%Y-%m-%d %H') AS lock_at, strftime(rel, '%Y-%m-%d %H') AS release_at, CASE WHEN f < 2 THEN ws + 6 END AS week_end FROM l WHERE n <= 4""")
def weekly_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Lists, baskets and profiles of two kinds, each family a week on from its newest round."""
    f, stamp = F.col("n_nationkey") % 4, lambda t: F.lit(t).cast("timestamp")
    week = lambda day: F.when(f < 2, F.lit(day).cast("date"))
    name = F.concat(F.lit("f"), "n_nationkey")
    templates = table(spark, d, "nation").select(name.alias("family"), name.alias("prefix"), F.when(f == 3, "cells").otherwise("").alias("suffix"), F.when(f < 2, "week_end").otherwise("iso_week").alias("named_by"), stamp("2026-08-29 12:00:00").alias("lock_at"), stamp("2026-09-08 15:00:00").alias("release_at"), week("2026-08-31").alias("week_start"), week("2026-09-06").alias("week_end"))
    found = season.weekly_candidates(templates, spark.createDataFrame([], "round_id string"), "2026-10-01", 4)
    return found.select("family", "round_id", F.date_format("lock_at", "yyyy-MM-dd HH").alias("lock_at"), F.date_format("release_at", "yyyy-MM-dd HH").alias("release_at"), "week_end")


@query("""WITH m AS (SELECT r_regionkey AS k, strftime(DATE '2026-09-01' + to_months(CAST(r_regionkey AS INTEGER)), '%Y-%m') AS month, CAST(DATE '2026-10-08' + to_months(CAST(r_regionkey AS INTEGER)) AS DATE) AS day FROM region WHERE r_regionkey <> 3), c AS (SELECT month, CAST(day AS TIMESTAMP) + INTERVAL 15 HOURS AS rel FROM m WHERE k BETWEEN 1 AND 2), h AS (SELECT unnest(['1y', '3y']) AS h)
  SELECT 'sce_' || h AS series, 'sce-' || month || '-' || h AS round_id, strftime(rel, '%Y-%m-%d %H') AS release_at FROM c, h WHERE floor(epoch(rel - TIMESTAMP '2026-10-20') / 86400) <= 56 AND rel - INTERVAL 48 HOURS > TIMESTAMP '2026-10-20'""")
def monthly_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of a monthly survey for two horizons, up to the first month that the calendar lacks."""
    month = lambda day: F.add_months(F.lit(day).cast("date"), F.col("r_regionkey"))
    releases = table(spark, d, "region").where("r_regionkey <> 3").select(F.date_format(month("2026-09-01"), "yyyy-MM").alias("month"), month("2026-10-08").alias("day"))
    horizons = spark.createDataFrame([("sce_1y", "sce", "1y"), ("sce_3y", "sce", "3y")], "series string, prefix string, suffix string")
    found = season.monthly_candidates(horizons, releases, spark.createDataFrame([], "round_id string"), "2026-09", "2026-10-20", 6)
    return found.select("series", "round_id", F.date_format("release_at", "yyyy-MM-dd HH").alias("release_at"))


@query("""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) SELECT day, strftime(CAST(day AS TIMESTAMP) + to_days(CAST(k AS INTEGER)) + INTERVAL 14 HOURS, '%Y-%m-%d %H') AS asof FROM d, range(1, 17) t(k)""")
def archive_times(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.col("ts").cast("date").alias("day")).distinct()
    return season.archive_times(days).select("day", F.date_format("asof", "yyyy-MM-dd HH").alias("asof"))


@query("""WITH l AS (SELECT event_type AS file, event_id AS line, 'u' || user_id AS entrant, sha256(CAST(floor(value / 10) AS INT)::VARCHAR) AS h, CASE WHEN event_id % 4 <> 0 THEN value END AS topline FROM events), c AS (SELECT DISTINCT entrant, h FROM l WHERE file = 'click'), u AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY entrant, h ORDER BY file DESC, line DESC) = 1), m AS (SELECT u.*, c.h IS NOT NULL AS old FROM u LEFT JOIN c USING (entrant, h))
  SELECT (SELECT count(DISTINCT file) FROM l) AS files, (SELECT count(*) FROM l) AS lines, count(*) AS "unique", (SELECT count(*) FROM l) - count(*) AS superseded, count(*) FILTER (NOT old) AS restored, count(*) FILTER (old) AS skipped_existing, count(*) FILTER (NOT old AND topline IS NOT NULL) AS successful, count(*) FILTER (NOT old AND topline IS NULL) AS failures FROM m""")
def restored_runs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select(F.col("event_type").alias("file"), F.col("event_id").alias("line"), F.concat(F.lit("u"), "user_id").alias("entrant"), F.sha2(F.floor(F.col("value") / 10).cast("string"), 256).alias("prompt_sha256"), F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("topline"))
    return season.restored_runs(lines, lines.where("file = 'click'"))[1]


PARTY = "CASE doc_id % 4 WHEN 0 THEN 'strongly_approve' WHEN 1 THEN 'somewhat_approve' WHEN 2 THEN CASE WHEN toxic = 1 THEN 'disapprove' ELSE 'approve' END ELSE CASE WHEN quality = 1 THEN 'party_a' ELSE 'party_b' END END"


@query(f"""WITH p AS (SELECT lang AS grp, 1.0 + n_chars % 7 AS w, {PARTY} AS o FROM labels JOIN documents USING (doc_id)), s AS (SELECT grp, sum(w) AS a, {', '.join(f"sum(CASE WHEN o = '{o}' THEN w ELSE 0 END) AS {o}" for o in ('approve', 'disapprove', 'party_a', 'party_b', 'strongly_approve', 'somewhat_approve'))} FROM p GROUP BY 1)
  SELECT grp, {r('100 * approve / a')} AS approve_share, {r('100 * (approve - disapprove) / a')} AS net_approve_share, {r('100 * (party_a - party_b) / a')} AS party_margin, {r('100 * strongly_approve / a')} AS strong_share, {r('100 * somewhat_approve / a')} AS weak_share, {r('100 * (strongly_approve + somewhat_approve) / a')} AS four_point_share FROM s""")
def panel_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """Every registered aggregator over each group of the panel."""
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("grp"), (1.0 + F.col("n_chars") % 7).alias("w"))
    k = F.col("doc_id") % 4
    option = F.when(k == 0, "strongly_approve").when(k == 1, "somewhat_approve").when(k == 2, F.when(F.col("toxic") == 1, "disapprove").otherwise("approve")).otherwise(F.when(F.col("quality") == 1, "party_a").otherwise("party_b"))
    rows = table(spark, d, "labels").join(docs, "doc_id").select("grp", "w", option.alias("option"))
    return rows.groupBy("grp").agg(*[rounded(build()).alias(name) for name, build in panel.AGGREGATORS.items()])



@query(f"""WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS pollster, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS end_date, o_totalprice AS v FROM orders), p AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY date ORDER BY end_date DESC, pollster DESC, v DESC) = 1), u AS (SELECT * FROM o WHERE pollster IN ('1-URGENT', '2-HIGH') QUALIFY row_number() OVER (PARTITION BY date ORDER BY end_date DESC, pollster DESC, v DESC) = 1), e AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (event_type = 'view') AS b FROM events GROUP BY 1)
  SELECT 'polls_all' AS series, date, {r('v', 3)} AS value FROM p UNION ALL SELECT 'polls_urgent', date, {r('v / 1000', 3)} FROM u UNION ALL SELECT 'clicks_less_views', date, a - b FROM e""")
def registered_series(spark: SparkSession, d: str) -> DataFrame:
    """Series of two sources by their specifications: one poll a date, a filter of pollsters, a difference of columns."""
    specs = (registry.Series("polls_all", "polls"), registry.Series("polls_urgent", "polls", filters=registry.where(pollster=("1-URGENT", "2-HIGH")), scale=0.001), registry.Series("clicks_less_views", "counts", "a", minus="b"), registry.Series("gone", "lost"))
    day = F.col("o_orderdate").cast("date")
    polls = table(spark, d, "orders").select(day.alias("date"), F.col("o_orderpriority").alias("pollster"), F.date_add(day, (F.col("o_orderkey") % 3).cast("int")).alias("end_date"), F.col("o_totalprice").alias("value"))
    counts = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.count_if(F.col("event_type") == "click").alias("a"), F.count_if(F.col("event_type") == "view").alias("b"))
    found = registry.build_all({"polls": polls, "counts": counts}, specs, unavailable=["lost"])
    return found.select("series", "date", rounded("value", 3).alias("value"))


@query("""WITH d AS (SELECT p_name AS title, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), w AS (SELECT title, date + CAST(7 - isodow(date) AS INTEGER) AS date, sum(v) AS t FROM d GROUP BY 1, 2 HAVING count(DISTINCT d.date) = 7) SELECT title, date, round_even(t / 1000.0, 1) AS value FROM w""")
def weekly_thousands(spark: SparkSession, d: str) -> DataFrame:
    return rankings.weekly_thousands(title_days(spark, d).withColumnRenamed("views", "value"), ["title"])


def title_days(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy(F.col("p_name").alias("title"), F.col("l_shipdate").cast("date").alias("date")).agg(F.sum("l_quantity").cast("long").alias("views"))


@query("""WITH d AS (SELECT p_name AS title, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), w AS (SELECT *, date + CAST(7 - isodow(date) AS INTEGER) AS week_end FROM d), f AS (SELECT week_end FROM w GROUP BY 1 HAVING count(DISTINCT date) = 7 AND count(DISTINCT title) >= 10), t AS (SELECT week_end, title, sum(v) AS v FROM w SEMI JOIN f USING (week_end) GROUP BY 1, 2)
  SELECT week_end, row_number() OVER (PARTITION BY week_end ORDER BY v DESC, title) AS place, upper(title[1]) || replace(substr(title, 2), ' ', '_') AS title FROM t QUALIFY place <= 10""")
def ranked_weeks(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest titles of every complete week."""
    daily = title_days(spark, d)
    weeks = daily.groupBy(C.week_end(F.col("date")).alias("week_end")).agg(F.countDistinct("date").alias("days"), F.countDistinct("title").alias("titles")).where("days = 7 and titles >= 10")
    return rankings.ranked_weeks(daily, weeks, 10, "main_page_and_namespaces_v1").select("week_end", F.col("place").cast("long").alias("place"), "title")


@query("""SELECT o_orderkey FROM orders WHERE CASE WHEN o_orderstatus = 'O' THEN true WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN false ELSE epoch(CAST(o_orderdate AS TIMESTAMP)) - epoch(TIMESTAMP '1998-03-03 12:00:00') >= 43200 END""")
def answers_still_due(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "O").alias("filed"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("in_window"), F.col("o_orderdate").cast("timestamp").alias("lock_at"))
    return o.where(rules.still_due("1998-03-03 12:00:00")).select("o_orderkey")


@query("""WITH f AS (SELECT o_custkey AS round_id, o_orderpriority AS field, max(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), u AS (SELECT o_custkey AS round_id, o_orderpriority AS field, max(o_orderkey) AS value FROM orders WHERE o_orderstatus = 'O' GROUP BY 1, 2) SELECT round_id, field, coalesce(f.value, u.value) AS value FROM f FULL JOIN u USING (round_id, field)""")
def frozen_once(spark: SparkSession, d: str) -> DataFrame:
    side = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("round_id"), F.col("o_orderpriority").alias("field")).agg(F.max("o_orderkey").alias("value"))
    return season.freeze_once(side("F"), side("O"))


@query("""WITH p AS (SELECT CAST(ts AS DATE) AS date, event_type AS choice, round_even(100.0 * count(*) / 1000, 2) AS v FROM events GROUP BY 1, 2), w AS (SELECT date, max(v) FILTER (choice = 'click') AS click, max(v) FILTER (choice = 'view') AS view FROM p GROUP BY 1) SELECT * FROM w QUALIFY row_number() OVER (ORDER BY date DESC) <= 20""")
def tracker_snapshots(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("choice")).agg(F.bround(100.0 * F.count("*") / 1000, 2).alias("value"))
    points = p.select(F.lit("k").alias("key"), F.lit("2024-02-01").cast("date").alias("capture_day"), "date", "choice", "value")
    return readers.tracker_snapshot(points, ["click", "view"], 20).select("date", "click", "view")
