"""Queries: calendar, AS-OF joins, freezing and resolution, set differences, validation, text, health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.functions import calendar as C
from augur.functions import text as T
from augur.operators import asof, health, polls, rankings, resolution, rules
from augur.plans.fixtures import OBS, POLLS, r, rounded, table
from augur.plans.fixtures import obs as obs_table
from augur.plans.fixtures import polls as poll_table
from augur.plans.registry import query
from augur.sources import documents, readers, sinks


@query("""WITH l AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 48 AS BIGINT)) AS t FROM orders), m AS (SELECT *, date_trunc('week', t) + INTERVAL 12 HOURS AS noon FROM l)
  SELECT o_orderkey, strftime(CASE WHEN noon >= t THEN noon - INTERVAL 7 DAYS ELSE noon END, '%Y-%m-%d %H:%M') AS deadline, 'batch-' || strftime(CASE WHEN noon >= t THEN noon - INTERVAL 7 DAYS ELSE noon END, '%Y-%m-%d') AS batch, strftime(t - INTERVAL 24 HOURS, '%Y-%m-%d %H:%M') AS window_opens, strftime(t - INTERVAL 7 DAYS, '%Y-%m-%d %H:%M') AS published,
  isoyear(t) || '-W' || lpad(CAST(week(t) AS VARCHAR), 2, '0') AS iso_week, CAST(t AS DATE) + CAST(7 - isodow(t) AS INTEGER) AS week_end, year(t) * 12 + month(t) AS month_index, false AS governed FROM m""")
def round_calendar(spark: SparkSession, d: str) -> DataFrame:
    lock = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 48).cast("int"))
    o, text = table(spark, d, "orders").select("o_orderkey", lock.alias("t")), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    t, day = F.col("t"), F.col("t").cast("date")
    return o.select("o_orderkey", text(C.deadline_for(t)).alias("deadline"), C.batch_of(t).alias("batch"), text(C.window_opens_at(t)).alias("window_opens"), text(C.published_at(t)).alias("published"), C.iso_week(day).alias("iso_week"), C.week_end(day).alias("week_end"), C.month_index(day).cast("long").alias("month_index"), C.governed_by_batch(t).alias("governed"))


@query(f"""SELECT o_orderkey, {r("epoch(CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 300 AS BIGINT)) - CAST(o_orderdate AS TIMESTAMP)) / 86400.0")} AS horizon FROM orders""")
def horizons(spark: SparkSession, d: str) -> DataFrame:
    lock = F.col("o_orderdate").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", rounded(C.horizon_days(lock, lock + F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 300).cast("int")))).alias("horizon"))


ROUNDS = "rounds AS (SELECT event_type || '-' || k AS round_id, event_type AS series, DATE '2024-01-05' + CAST(3 * k AS INTEGER) AS freeze_date, DATE '2024-01-07' + CAST(3 * k AS INTEGER) AS release_date, k AS season_order FROM (SELECT DISTINCT event_type FROM events), range(0, 9) t(k))"

#: What had been read of each day by noon: the frozen histories, of which the last day is revised later.
NOON = f"noon AS (SELECT event_type AS series, CAST(ts AS DATE) AS date, {r('avg(value)', 4)} AS value FROM events WHERE hour(ts) < 12 GROUP BY 1, 2), due AS (SELECT event_type || '-' || k AS round_id, event_type AS series, DATE '2024-01-04' + CAST(3 * k AS INTEGER) AS last_day, DATE '2024-01-06' + CAST(3 * k AS INTEGER) AS lock_day, event_type = 'view' AS daily FROM (SELECT DISTINCT event_type FROM events), range(0, 10) t(k))"


def rounds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k").cast("int") * 3
    series = table(spark, d, "events").select(F.col("event_type").alias("series")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))))
    return series.select(F.concat_ws("-", "series", "k").alias("round_id"), "series", F.date_add(F.lit("2024-01-05").cast("date"), k).alias("freeze_date"), F.date_add(F.lit("2024-01-07").cast("date"), k).alias("release_date"), F.col("k").alias("season_order"))


@query(f"WITH {OBS}, {ROUNDS}, k AS (SELECT round_id, date, value, row_number() OVER (PARTITION BY round_id ORDER BY date DESC) AS n FROM rounds JOIN obs USING (series) WHERE date < freeze_date) SELECT round_id, date, value FROM k WHERE n <= 10")
def frozen_histories(spark: SparkSession, d: str) -> DataFrame:
    return resolution.frozen_history(obs_table(spark, d), rounds(spark, d), 10).select("round_id", "date", "value")


@query(f"WITH {OBS}, {ROUNDS} SELECT round_id, max(date) AS date, max_by(value, date) AS value FROM rounds JOIN obs USING (series) WHERE date < freeze_date GROUP BY 1")
def frozen_values(spark: SparkSession, d: str) -> DataFrame:
    return resolution.frozen_value(obs_table(spark, d), rounds(spark, d))


@query(f"""WITH {OBS}, {NOON}, fr AS (SELECT round_id, n.date, CASE WHEN n.date = last_day THEN n.value ELSE o.value END AS value FROM due JOIN noon n USING (series) JOIN obs o USING (series, date) WHERE n.date <= last_day), lf AS (SELECT round_id, max(date) AS last FROM fr GROUP BY 1),
  c AS (SELECT round_id, o.date, o.value, o.date <= last AS old FROM due JOIN lf USING (round_id) JOIN obs o USING (series) WHERE o.date >= last AND (NOT daily OR o.date >= lock_day) AND NOT EXISTS (SELECT 1 FROM fr WHERE fr.round_id = due.round_id AND fr.date = o.date AND fr.value = o.value))
  SELECT round_id, date AS observed_date, value FROM c QUALIFY row_number() OVER (PARTITION BY round_id ORDER BY old, date, value) = 1""")
def first_releases(spark: SparkSession, d: str) -> DataFrame:
    e, o = table(spark, d, "events"), obs_table(spark, d)
    noon = e.where(F.hour("ts") < 12).groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("date")).agg(rounded(F.avg("value"), 4).alias("noon"))
    k, start = F.col("k") * 3, lambda day: F.lit(day).cast("date")
    due = e.select(F.col("event_type").alias("series")).distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select(
        F.concat_ws("-", "series", "k").alias("round_id"), "series", F.date_add(start("2024-01-04"), k).alias("last_day"), F.date_add(start("2024-01-06"), k).alias("lock_day"), (F.col("series") == "view").alias("daily"))
    frozen = due.join(noon, "series").where("date <= last_day").join(o, ["series", "date"]).select("round_id", "date", F.when(F.col("date") == F.col("last_day"), F.col("noon")).otherwise(F.col("value")).alias("value"))
    return resolution.first_release(o, due, frozen)


@query(f"WITH {OBS}, {ROUNDS}, k AS (SELECT round_id, freeze_date, max(date) AS date, max_by(value, date) AS value FROM rounds JOIN obs USING (series) WHERE date <= release_date GROUP BY 1, 2) SELECT round_id, date, value FROM k WHERE date >= freeze_date")
def cell_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return resolution.cell_outcomes(obs_table(spark, d), rounds(spark, d))


@query(f"""WITH {ROUNDS}, k AS (SELECT round_id, series, release_date - CAST(season_order % 2 * 3 AS INTEGER) AS observed_date, season_order FROM rounds), p AS (SELECT series, observed_date, season_order = 4 AS voided FROM k WHERE season_order IN (4, 6)), o AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT voided AND p.series = k.series AND p.observed_date = k.observed_date))
  SELECT round_id, series, observed_date FROM (SELECT *, row_number() OVER (PARTITION BY series, observed_date ORDER BY season_order, round_id) AS n FROM o) WHERE n = 1""")
def single_claims(spark: SparkSession, d: str) -> DataFrame:
    claims = rounds(spark, d).select("round_id", "series", F.date_sub("release_date", (F.col("season_order") % 2 * 3).cast("int")).alias("observed_date"), "season_order")
    prior = claims.where("season_order in (4, 6)").select("series", "observed_date", (F.col("season_order") == 4).alias("voided"))
    return resolution.one_claim(claims, prior).select("round_id", "series", "observed_date")


@query("""WITH u AS (SELECT user_id, ts, max_by(value, event_id) AS value FROM events GROUP BY 1, 2) SELECT q.event_id, u.value FROM events q ASOF LEFT JOIN u ON q.user_id = u.user_id AND q.ts > u.ts""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the value of its user's event before it."""
    e = table(spark, d, "events")
    seen = e.groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return asof.asof_backward(e.select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", "ts", ["value"], strict=True, stretch=1_000_000).select("event_id", "value")


@query("""WITH u AS (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2) SELECT q.event_id, u.value FROM events q ASOF LEFT JOIN u ON q.user_id = u.user_id AND q.ts <= u.ts""")
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    """Every event with the value of its user's first purchase from then on."""
    e = table(spark, d, "events")
    seen = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    return asof.asof_forward(e.select("event_id", "user_id", "ts"), seen, ["user_id"], "ts", "ts", ["value"], stretch=1_000_000).select("event_id", "value")


@query(f"""WITH {OBS}, cap AS (SELECT series, date AS capture_day, date - 1 AS end_date FROM obs WHERE day(date) % 4 = 1), pts AS (SELECT c.series, c.capture_day, o.date, o.value + day(c.capture_day) / 100.0 AS value FROM cap c JOIN obs o ON o.series = c.series AND o.date <= c.end_date), sh AS (SELECT o.series, o.date AS day, min(c.capture_day) AS capture_day FROM obs o JOIN cap c ON c.series = o.series AND c.capture_day >= o.date GROUP BY 1, 2)
  SELECT sh.series, sh.day, {r('p.value', 4)} AS value FROM sh JOIN pts p ON p.series = sh.series AND p.capture_day = sh.capture_day AND p.date = least(sh.capture_day - 1, sh.day)""")
def as_displayed(spark: SparkSession, d: str) -> DataFrame:
    o = obs_table(spark, d)
    captures = o.where(F.day("date") % 4 == 1).select("series", F.col("date").alias("capture_day"), F.date_sub("date", 1).alias("end_date"))
    points = captures.join(o, "series").where("date <= end_date").select("series", "capture_day", "date", (F.col("value") + F.day("capture_day") / 100.0).alias("value"))
    return resolution.as_displayed(o.select("series", F.col("date").alias("day")), captures, points).select("series", "day", rounded("value", 4).alias("value"))


@query("""WITH s AS (SELECT event_type AS series, CAST(ts AS DATE) + CAST(7 - isodow(ts) AS INTEGER) AS week_end, CAST(ts AS DATE) AS capture_day, max(event_id) AS value FROM events GROUP BY 1, 2, 3), k AS (SELECT *, isodow(capture_day) < 6 AS partial FROM s) SELECT series, week_end, min_by(value, capture_day) AS value, min(capture_day) AS capture_day FROM k WHERE NOT partial GROUP BY 1, 2""")
def first_prints(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("ts").cast("date")
    s = table(spark, d, "events").groupBy(F.col("event_type").alias("series"), C.week_end(day).alias("week_end"), day.alias("capture_day")).agg(F.max("event_id").alias("value"))
    return resolution.first_prints(s.withColumn("partial", F.weekday("capture_day") < 5))


@query("""WITH k AS (SELECT o_orderkey, o_orderstatus = 'F' AND o_orderkey % 2 = 0 AS resolved, CAST(o_orderdate AS TIMESTAMP) AS lock_at, CAST(o_orderdate AS TIMESTAMP) + INTERVAL 48 HOURS AS release_at FROM orders) SELECT o_orderkey, CASE WHEN resolved THEN 'resolved' WHEN lock_at > TIMESTAMP '1998-06-01' THEN 'open' WHEN release_at > TIMESTAMP '1998-06-01' THEN 'locked' ELSE 'awaiting_resolution' END AS status FROM k""")
def round_statuses(spark: SparkSession, d: str) -> DataFrame:
    lock = F.col("o_orderdate").cast("timestamp")
    o = table(spark, d, "orders").select("o_orderkey", ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 2 == 0)).alias("resolved"), lock.alias("lock_at"), (lock + C.hours(48)).alias("release_at"))
    return resolution.round_status(o, "1998-06-01").select("o_orderkey", "status")


@query("""WITH v AS (SELECT 'u' || user_id AS entrant, event_type AS round_id, event_id AS version, ts AS received_at, TIMESTAMP '2024-01-20' AS lock_at FROM events) SELECT entrant, round_id, max_by(version, (received_at, version)) AS version FROM v WHERE received_at < lock_at GROUP BY 1, 2""")
def last_before_lock(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("entrant"), F.col("event_type").alias("round_id"), F.col("event_id").alias("version"), F.col("ts").alias("received_at"), F.lit("2024-01-20").cast("timestamp_ntz").alias("lock_at"))
    return resolution.last_before_lock(v).select("entrant", "round_id", "version")


@query("""WITH m AS (SELECT event_type AS source, user_id % 4 AS key, max(ts) AS fetched_at FROM events GROUP BY 1, 2), b AS (SELECT DISTINCT event_type AS source, 1.0 + length(event_type) % 3 AS stale, 3.0 + length(event_type) % 3 AS failing FROM events WHERE event_type <> 'view' UNION ALL SELECT 'nowhere', 1.0, 2.0), j AS (SELECT source, fetched_at, stale, failing, epoch(TIMESTAMP '2024-02-02' - date_trunc('second', fetched_at)) / 86400.0 AS age FROM m FULL JOIN b USING (source)),
  k AS (SELECT source, max(CASE WHEN fetched_at IS NULL OR stale IS NULL THEN 1 WHEN age > failing THEN 3 WHEN age > stale THEN 2 ELSE 0 END) AS w FROM j GROUP BY 1) SELECT source, ['ok', 'unknown', 'stale', 'failing'][w + 1] AS state FROM k""")
def source_health(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    manifest = e.groupBy(F.col("event_type").alias("source"), (F.col("user_id") % 4).alias("key")).agg(F.max("ts").cast("timestamp").alias("fetched_at"))
    budgets = e.where("event_type <> 'view'").select(F.col("event_type").alias("source")).distinct().unionByName(spark.range(1).select(F.lit("nowhere").alias("source")))
    n = F.when(F.col("source") == "nowhere", 0).otherwise(F.length("source") % 3)
    budgets = budgets.select("source", (1.0 + n).alias("stale_days"), F.when(F.col("source") == "nowhere", 2.0).otherwise(3.0 + n).alias("failing_days"))
    return health.source_health(manifest, budgets, "2024-02-02").select("source", "state")


@query("""WITH f AS (SELECT 'c' || o_custkey AS entrant, CAST(max(o_orderdate) AS DATE) AS last_filed FROM orders GROUP BY 1), g AS (SELECT 'c' || c_custkey AS entrant, CASE WHEN c_custkey % 50 = 0 THEN DATE '2000-01-01' END AS known FROM customer) SELECT entrant, last_filed, coalesce(known, CASE WHEN DATE '2001-08-01' - last_filed > 14 THEN last_filed + 14 END) AS retired_at FROM f FULL JOIN g USING (entrant)""")
def retirement(spark: SparkSession, d: str) -> DataFrame:
    filed = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("entrant"), F.col("o_orderdate").alias("filed_at"))
    known = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("entrant"), F.when(F.col("c_custkey") % 50 == 0, F.lit("2000-01-01").cast("date")).alias("retired_at"))
    return health.retirement(filed, known, "2001-08-01")


@query("""WITH c AS (SELECT user_id AS entrant, ts AS tm, CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN 'http ' || (400 + event_id % 130) END AS error, event_id FROM events) SELECT entrant, count(*) AS calls, count(error) AS failures, strftime(max(tm), '%Y-%m-%d %H:%M:%S') AS last_at, array_to_string(list_slice(list(error ORDER BY tm DESC, error DESC) FILTER (error IS NOT NULL), 1, 5), ',') AS last_failures FROM c GROUP BY 1""")
def call_records(spark: SparkSession, d: str) -> DataFrame:
    error = F.when((F.col("event_type") == "error") | (F.col("event_id") % 7 == 0), F.concat(F.lit("http "), 400 + F.col("event_id") % 130))
    calls = table(spark, d, "events").select(F.col("user_id").alias("entrant"), F.col("ts").alias("at"), error.alias("error"))
    found = health.call_records(calls)
    return found.select("entrant", "calls", "failures", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), F.nullif(F.array_join("last_failures", ","), F.lit("")).alias("last_failures"))


@query(f"""WITH p AS (SELECT s_suppkey AS entrant, 1.0 + s_suppkey % 5 AS per_in, 2.0 + s_suppkey % 7 AS per_out FROM supplier WHERE s_suppkey % 9 <> 0), c AS (SELECT l_suppkey AS entrant, CASE WHEN l_orderkey % 31 <> 0 THEN CAST(l_quantity AS BIGINT) END AS i, CAST(l_linenumber AS BIGINT) * 100 AS o FROM lineitem) SELECT entrant, {r('coalesce(sum((i * per_in + o * per_out) / 1e6), 0.0)')} AS cost, count(*) FILTER (i IS NULL OR o IS NULL) AS unmetered FROM c LEFT JOIN p USING (entrant) GROUP BY 1""")
def call_costs(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entrant"), F.when(F.col("l_orderkey") % 31 != 0, F.col("l_quantity").cast("long")).alias("tokens_in"), (F.col("l_linenumber").cast("long") * 100).alias("tokens_out"))
    prices = table(spark, d, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("entrant"), (1.0 + F.col("s_suppkey") % 5).alias("per_in"), (2.0 + F.col("s_suppkey") % 7).alias("per_out"))
    return health.costs(calls, prices).select("entrant", rounded("cost").alias("cost"), "unmetered")


@query("""WITH RECURSIVE j AS (SELECT o_custkey AS c, o_orderkey AS id, floor(o_totalprice / 1000) AS cost, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders), w AS (SELECT c, k, CASE WHEN cost <= 400 THEN cost ELSE 0.0 END AS spent, CASE WHEN cost <= 400 THEN CAST(id AS VARCHAR) END AS bought FROM j WHERE k = 1 UNION ALL SELECT j.c, j.k, CASE WHEN spent + cost <= 400 THEN spent + cost ELSE spent END, CASE WHEN spent + cost <= 400 THEN CAST(id AS VARCHAR) END FROM w JOIN j ON j.c = w.c AND j.k = w.k + 1)
  SELECT c AS custkey, count(bought) AS n_bought, coalesce(string_agg(bought, ',' ORDER BY k) FILTER (bought IS NOT NULL), '') AS bought FROM w GROUP BY 1""")
def affordable_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The greedy purchase of each customer's jobs under a ceiling; one that doesn't fit is skipped."""
    job = F.struct("o_orderdate", "o_orderkey", F.floor(F.col("o_totalprice") / 1000).cast("double").alias("cost"), F.col("o_orderkey").cast("string").alias("id"))
    jobs = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_sort(F.collect_list(job)).alias("jobs"))
    bought = jobs.withColumn("ids", health.affordable(F.col("jobs"), 400.0))
    return bought.select("custkey", F.size("ids").cast("long").alias("n_bought"), F.array_join("ids", ",").alias("bought"))


@query("""WITH a AS (SELECT DISTINCT 'u' || user_id AS entrant, event_type || CAST(ts AS DATE) AS round_id, event_type AS series FROM events), h AS (SELECT DISTINCT 'u' || user_id AS entrant, event_type || CAST(ts AS DATE) AS round_id FROM events WHERE value > 20), m AS (SELECT 'click' AS series, 'web' AS domain UNION ALL SELECT 'view', 'web' UNION ALL SELECT 'purchase', 'trade') SELECT entrant, coalesce(domain, 'unplaced') AS domain, count(*) AS asked, count(h.round_id) AS answered FROM a LEFT JOIN m USING (series) LEFT JOIN h USING (entrant, round_id) GROUP BY 1, 2""")
def answers_by_domain(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("entrant"), F.concat("event_type", F.col("ts").cast("date").cast("string")).alias("round_id"), F.col("event_type").alias("series"), "value")
    domains = spark.createDataFrame([("click", "web"), ("view", "web"), ("purchase", "trade")], "series string, domain string")
    return health.answered_by_domain(asked.drop("value").distinct(), asked.where("value > 20"), domains)


@query("""WITH f AS (SELECT event_type AS source, ts AS fetched_at, event_id, CAST(floor(value / 40) AS VARCHAR) AS content FROM events), g AS (SELECT source, fetched_at, max_by(content, event_id) AS content FROM f GROUP BY 1, 2), h AS (SELECT *, lag(content) OVER w AS b FROM g WINDOW w AS (PARTITION BY source ORDER BY fetched_at)), m AS (SELECT *, CASE WHEN b IS NULL OR b <> content THEN fetched_at END AS mv FROM h)
  SELECT source, strftime(fetched_at, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at, sha256(content) AS sha256, strftime(max(mv) OVER (PARTITION BY source ORDER BY fetched_at ROWS UNBOUNDED PRECEDING), '%Y-%m-%d %H:%M:%S.%f') AS changed_at FROM m""")
def content_changes(spark: SparkSession, d: str) -> DataFrame:
    fetches = table(spark, d, "events").groupBy(F.col("event_type").alias("source"), F.col("ts").alias("fetched_at")).agg(F.max_by(F.format_string("%d.0", F.floor(F.col("value") / 40)), "event_id").alias("content"))
    found, text = health.changed_at(fetches), lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return found.select("source", text("fetched_at").alias("fetched_at"), "sha256", text("changed_at").alias("changed_at"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'rights' WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'retired' WHEN o_totalprice < 20000 THEN 'history' WHEN o_totalprice > 400000 THEN 'volatility' ELSE 'ok' END AS verdict FROM orders""")
def publishing_gate(spark: SparkSession, d: str) -> DataFrame:
    checks = [("rights", F.col("o_orderpriority") == "5-LOW"), ("retired", (F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 3 == 0)), ("history", F.col("o_totalprice") < 20000), ("volatility", F.col("o_totalprice") > 400000)]
    return table(spark, d, "orders").select("o_orderkey", rules.gate(checks).alias("verdict"))


@query("""WITH k AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS series, CAST(o_orderdate AS TIMESTAMP) AS l, CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(CASE WHEN o_orderkey % 5 = 0 THEN -3 WHEN o_orderkey % 4 = 0 THEN 24 ELSE 48 END AS BIGINT)) AS e, CASE WHEN o_orderkey % 13 <> 0 THEN 'open' END AS rights FROM orders)
  SELECT o_orderkey, 'missing_series' AS problem FROM k WHERE series IS NULL UNION ALL SELECT o_orderkey, 'reversed' FROM k WHERE e <= l UNION ALL SELECT o_orderkey, 'not_48h' FROM k WHERE e > l AND e - l <> INTERVAL 48 HOURS UNION ALL SELECT o_orderkey, 'weekend' FROM k WHERE isodow(e) >= 6 UNION ALL SELECT o_orderkey, 'rights' FROM k WHERE rights IS NULL OR rights <> 'open'""")
def round_violations(spark: SparkSession, d: str) -> DataFrame:
    key, lock = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    hours = F.when(key % 5 == 0, -3).when(key % 4 == 0, 24).otherwise(48)
    o = table(spark, d, "orders").select("o_orderkey", F.when(key % 11 != 0, F.col("o_orderpriority")).alias("series"), lock.alias("lock_at"), (lock + F.make_dt_interval(F.lit(0), hours)).alias("release_at"), F.when(key % 13 != 0, "open").alias("rights"))
    return rules.violations(o, "o_orderkey", rules.round_checks())


@query("""SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return rules.duplicates(table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day")), ["o_custkey", "day"])


@query("""SELECT user_id, 'missing' AS problem FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'view' AND value > 30) UNION ALL SELECT user_id, 'unexpected' FROM (SELECT user_id FROM events WHERE event_type = 'view' AND value > 30 EXCEPT SELECT user_id FROM events WHERE event_type = 'click')""")
def exact_answers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return rules.exact_set(e.where("event_type = 'click'"), e.where("event_type = 'view' and value > 30"), ["user_id"])


@query("""WITH o AS (SELECT o_custkey AS k, sha256(max(o_orderstatus)) AS h FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1), n AS (SELECT o_custkey AS k, sha256(max(o_orderstatus)) AS h FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1) SELECT k, CASE WHEN o.h IS NULL THEN 'created' WHEN n.h IS NULL THEN 'kept' WHEN o.h = n.h THEN 'unchanged' ELSE 'replaced' END AS verdict FROM n FULL JOIN o USING (k)""")
def file_verdicts(spark: SparkSession, d: str) -> DataFrame:
    side = lambda rest: table(spark, d, "orders").where(F.col("o_orderpriority") != rest).groupBy(F.col("o_custkey").alias("k")).agg(F.sha2(F.max("o_orderstatus"), 256).alias("h"))
    return rules.verdicts(side("5-LOW"), side("1-URGENT"), ["k"], "h")


@query("""SELECT o_orderkey FROM orders WHERE epoch(CAST(o_orderdate AS TIMESTAMP)) - epoch(TIMESTAMP '1998-03-03 12:00:00') BETWEEN 1800 AND 86400 AND o_orderstatus <> 'F'""")
def jobs_due(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("lock_at"), F.when(F.col("o_orderstatus") == "F", F.lit(1)).alias("answered_at"))
    return o.where(rules.job_still_due("1998-03-03 12:00:00")).select("o_orderkey")


@query("""SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH') AS trusted FROM orders""")
def evidence_levels(spark: SparkSession, d: str) -> DataFrame:
    """Orders by an ordinal level; one that is not among the levels never reaches a threshold."""
    return table(spark, d, "orders").select("o_orderkey", rules.at_least(F.col("o_orderpriority"), "2-HIGH", ["5-LOW", "3-MEDIUM", "2-HIGH", "1-URGENT"]).alias("trusted"))


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id % 7 AS entrant, list(event_type ORDER BY event_id)[1:4] AS items FROM events GROUP BY 1, 2) SELECT day, entrant, array_to_string(list_filter([CASE WHEN len(items) <> 3 THEN 'length' END, CASE WHEN len(list_distinct(items)) <> len(items) THEN 'duplicate' END, CASE WHEN len(list_filter(items, lambda x: x NOT IN ('click', 'view', 'purchase'))) > 0 THEN 'outside_basket' END, CASE WHEN list_contains(items, 'error') THEN 'excluded' END], lambda x: x IS NOT NULL), ',') AS problems FROM e""")
def list_problems(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), (F.col("user_id") % 7).alias("entrant")).agg(F.slice(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), 1, 4)["event_type"].alias("items"))
    return e.select("day", "entrant", F.array_join(rankings.list_problems(F.col("items"), F.lit(["click", "view", "purchase"]), F.lit(["error"]), 3), ",").alias("problems"))


@query("""WITH q AS (SELECT o_orderkey, [0.1, CASE WHEN o_orderkey % 3 = 0 THEN 0.4 ELSE 0.5 END, CASE WHEN o_orderkey % 7 = 0 THEN 1.5 ELSE 0.9 END] AS lv, [o_totalprice, o_totalprice + o_orderkey % 5 - 1, o_totalprice + 10] AS v FROM orders)
  SELECT o_orderkey, array_to_string(list_filter([CASE WHEN NOT list_contains(lv, 0.5) THEN 'no_median' END, CASE WHEN lv[3] >= 1 THEN 'level' END, CASE WHEN v[1] > v[2] OR v[2] > v[3] THEN 'order' END], lambda x: x IS NOT NULL), ',') AS problems FROM q""")
def quantile_problems(spark: SparkSession, d: str) -> DataFrame:
    q = F.map_from_arrays(F.array(F.lit("0.1"), F.when(F.col("o_orderkey") % 3 == 0, "0.4").otherwise("0.5"), F.when(F.col("o_orderkey") % 7 == 0, "1.5").otherwise("0.9")), F.array(F.col("o_totalprice"), F.col("o_totalprice") + F.col("o_orderkey") % 5 - 1, F.col("o_totalprice") + 10))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(rankings.quantile_problems(q), ",").alias("problems"))


@query(f"""WITH {POLLS} SELECT pollster, upper(population) AS population, count(*) AS n, {r('avg(value)')} AS mean FROM polls WHERE contains(lower(pollster), 'urgent') OR contains(lower(pollster), 'high') GROUP BY 1, 2""")
def poll_filters(spark: SparkSession, d: str) -> DataFrame:
    p = poll_table(spark, d)
    raw = p.select(F.lit("All").alias("subgroup"), "pollster", "population", F.date_format("start_date", "M/d/yyyy").alias("start_date"), F.date_format("end_date", "M/d/yyyy").alias("end_date"), F.col("n").cast("string").alias("n"), F.col("value").cast("string").alias("value"))
    found = polls.records(raw, ["ALL"], "urgent").unionByName(polls.records(raw, ["all"], "HIGH", since="1990-01-01"))
    return found.groupBy("pollster", "population").agg(F.count("*").alias("n"), rounded(F.avg("value")).alias("mean"))


TITLES = f"""t AS (SELECT 'd' || doc_id AS id, text AS t FROM documents UNION ALL SELECT 'p' || p_partkey, CASE p_size WHEN 1 THEN 'main page ' WHEN 2 THEN ' special:' || p_name WHEN 3 THEN 'Talk:_' || p_name ELSE p_name END FROM part), w AS (SELECT id, trim(regexp_replace(t, '{T.SPACE}+', '_', 'g'), '_') AS t FROM t), g AS (SELECT id, t, CASE WHEN t IS NULL THEN 'missing' WHEN t = '' THEN 'empty' WHEN length(t) > 256 THEN 'too long' END AS problem FROM w), k AS (SELECT id, problem, CASE WHEN problem IS NULL THEN upper(t[1]) || substr(t, 2) END AS title FROM g)"""


@query(f"""WITH {TITLES} SELECT id, title, problem, title IN ({', '.join(f"'{x}'" for x in T.RULES['main_page_and_namespaces_v1'][0])}) OR {' OR '.join(f"starts_with(title, '{x}')" for x in T.RULES['main_page_and_namespaces_v1'][1])} AS excluded FROM k""")
def titles(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts and part names as article titles; what is refused says why."""
    size, name = F.col("p_size"), F.col("p_name")
    parts = table(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.when(size == 1, "main page ").when(size == 2, F.concat(F.lit(" special:"), name)).when(size == 3, F.concat(F.lit("Talk:_"), name)).otherwise(name).alias("t"))
    t = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t")).unionByName(parts)
    return T.titled(t, "t", "main_page_and_namespaces_v1").select("id", "title", "problem", "excluded")


def markup_sql(x: str) -> str:
    for pattern, stays in T.MARKUP:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{stays.replace('$1', chr(92) + '1')}', 'g')"
    return f"trim({x})"


WIKITEXT = "'* [[' || url || '|the page]] of {{ill|Name ' || page_id || '|fr}}, {{cite|x}} [[plain]] bold [' || url || ' (Source)] <ref name=\"a\">' || page_id || '</ref><ref/> ' || html"


@query(f"""SELECT page_id, {markup_sql(f'({WIKITEXT})')} AS plain FROM pages""")
def plain_wikitext(spark: SparkSession, d: str) -> DataFrame:
    """Whole pages as wikitext without its markup."""
    parts = ["* [[", F.col("url"), "|the page]] of {{ill|Name ", F.col("page_id").cast("string"), "|fr}}, {{cite|x}} [[plain]] '''bold''' [", F.col("url"), " (Source)] <ref name=\"a\">", F.col("page_id").cast("string"), "</ref><ref/> ", F.col("html")]
    return table(spark, d, "pages").select("page_id", T.strip_markup(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).alias("plain"))


@query(r"""SELECT page_id, regexp_replace(url || '__' || length(html), '[^A-Za-z0-9._-]+', '_', 'g') AS key, regexp_replace(e, '-web(-superfc)?$', '') AS family, CASE WHEN ends_with(e, '-web-superfc') THEN 'web-superfc' WHEN ends_with(e, '-web') THEN 'web' ELSE 'plain' END AS harness FROM (SELECT *, 'model' || page_id % 3 || CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-web' ELSE '-web-superfc' END AS e FROM pages)""")
def identifiers(spark: SparkSession, d: str) -> DataFrame:
    e = F.concat(F.lit("model"), F.col("page_id") % 3, F.element_at(F.lit(["", "-web", "-web-superfc"]), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, d, "pages").withColumn("e", e).select("page_id", T.archive_key(F.col("url"), F.length("html").cast("string")).alias("key"), T.family(F.col("e")).alias("family"), T.harness(F.col("e")).alias("harness"))


MESSAGES = ("HTTP 429 slow down", "HTTP 401", "https 503 http  503:", "it timed  out", "bad non-JSON reply", "http 404", "No xyz_key in the environment", "finish_reason=length", "Rate limit hit", "connection reset", "billing: no credits remaining", " ", "something else", "organization has been disabled")


@query(r"""WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, [{messages}][event_id % 14 + 1] AS m FROM events), t AS (SELECT event_id, k, CASE WHEN trim(m) = '' THEN 'unknown error' ELSE lower(trim(regexp_replace(m, '\s+', ' ', 'g'))) END AS t FROM e),
  s AS (SELECT *, nullif(regexp_extract(t, '\bhttp\s+([0-9]{3})\b', 1), '') AS s FROM t)
  SELECT event_id, k, CASE WHEN s IS NOT NULL THEN 'provider HTTP ' || s WHEN regexp_matches(t, '\bno [a-z0-9_]+ in the environment\b') THEN 'provider credential not configured' WHEN contains(t, 'output limit') OR contains(t, 'finish_reason=length') THEN 'provider output limit' WHEN contains(t, 'timeout') OR contains(t, 'timed out') THEN 'provider timeout'
    WHEN contains(t, 'rate limit') THEN 'provider rate limit' WHEN contains(t, 'stream') OR contains(t, 'connection') THEN 'provider transport failure' WHEN contains(t, 'parse') OR contains(t, 'non-json') OR contains(t, 'no text') THEN 'provider response invalid' ELSE 'provider call failed' END AS label,
    coalesce(s IN ('401', '403', '404'), false) OR regexp_matches(t, '\bno [a-z0-9_]+ in the environment\b|invalid_api_key|incorrect api key|account_deactivated|organization has been disabled|does not exist or you do not have access|permission denied|forbidden|unauthorized|authentication|insufficient_quota|credit_balance_exhausted|no credits remaining|billing|unknown entrant|unknown model|no configured route') AS terminal FROM s""".replace("{messages}", ", ".join(f"'{m}'" for m in MESSAGES)))
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    message = F.element_at(F.lit(list(MESSAGES)), (F.col("event_id") % 14 + 1).cast("int"))
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").select("event_id", k.alias("k"), T.public_error(message).alias("label"), T.terminal(message).alias("terminal"))


@query("""SELECT conv_id, turn, sha256('{"role":"' || role || '","turn":' || turn || ',"length":' || length(text) || '}') AS digest, contains(text, '?') AS asks FROM conversations""")
def call_identities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.identity(F.col("role"), F.col("turn"), F.length("text").alias("length")).alias("digest"), F.contains("text", F.lit("?")).alias("asks"))


@query("""WITH l AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY role, length(text) ORDER BY conv_id DESC, turn DESC) AS n FROM conversations) SELECT role, length(text) AS len, conv_id, turn FROM l WHERE n = 1""")
def last_file_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").withColumn("len", F.length("text"))
    return sinks.last_wins(rows, ["role", "len"], "conv_id", "turn").select("role", F.col("len").cast("long").alias("len"), "conv_id", "turn")


@query("""SELECT a.date, a.value, a.preliminary FROM (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, count(*) AS value, false AS preliminary FROM orders WHERE month(o_orderdate) % 3 <> 0 GROUP BY 1 UNION ALL SELECT CAST(date_trunc('month', o_orderdate) AS DATE), count(*), true FROM orders WHERE month(o_orderdate) % 3 = 0 GROUP BY 1) a""")
def finals_and_preliminary(spark: SparkSession, d: str) -> DataFrame:
    months = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(F.count("*").alias("value"))
    finals = months.where(F.month("date") % 3 != 0).withColumn("preliminary", F.lit(False))
    return readers.finals_first(finals, months.withColumn("preliminary", F.lit(True)))


@query("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, '{"z": {"k": ' || k || '}, "a": "' || event_id || '}é"}' AS json, sha256('{"a":"' || event_id || '}\\u00e9","z":{"k":' || k || '}}') AS sha256 FROM e""")
def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    """The first whole JSON object in free text, and its hash with sorted keys, in ASCII."""
    reply = F.concat(F.lit('answer {so} far [1]: {"z": '), "props", F.lit(', "a": "'), "event_id", F.lit('}é"} thanks {"b": 1}'))
    e = table(spark, d, "events").select("event_id", reply.alias("reply"))
    return e.withColumn("json", documents.embedded_json(F.col("reply"))).select("event_id", "json", documents.canonical_hash(F.col("json")).alias("sha256"))


@query("""SELECT n_name, r_name, count(*) AS customers, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS in_debt FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY CUBE (n_name, r_name)""")
def domain_cube(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.cube("n_name", "r_name").agg(F.count("*").alias("customers"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))


@query("""SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders""")
def never_filed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT c_custkey FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000""")
def in_both(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey").intersect(table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")))


@query("""WITH e AS (SELECT user_id, ts, value, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 48 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM e GROUP BY user_id, s""")
def user_sessions(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) <= 48 * 3_600_000_000, 0).otherwise(1)
    e = table(spark, d, "events").withColumn("new", gap).withColumn("s", F.sum("new").over(w))
    return e.groupBy("user_id", "s").agg(F.date_format(F.min("ts"), "yyyy-MM-dd HH:mm:ss").alias("started"), F.count("*").alias("n")).drop("s")


@query("""SELECT CAST(ts AS DATE) AS date, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1""")
def wide_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("date")).pivot("event_type", ["click", "view", "purchase"]).count().na.fill(0)
