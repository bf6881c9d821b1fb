"""Queries: the season's calendar, shape boards, trackers, text corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.operators import asof, boards, digests, profiles, rankings, rules
from augur.plans.fixtures import BRAND_WEEKS, OBS, PROFILE_CELLS, SCORES, brand_weeks, profile_cells, r, rounded, table
from augur.plans.fixtures import obs as obs_table
from augur.plans.fixtures import scores as score_table
from augur.plans.forecasting import joint_sql
from augur.plans.leaderboards import LISTS, list_pairs
from augur.plans.registry import query


@query("""WITH s AS (SELECT DISTINCT event_type AS series, length(event_type) % 7 AS weekday FROM events), c AS (SELECT series, TIMESTAMP '2026-09-14' + to_days(CAST(7 * w + weekday AS INTEGER)) + INTERVAL 12 HOURS AS rel FROM s, range(0, 6) t(w))
  SELECT series || '-' || strftime(rel, '%Y-%m-%d') AS round_id, strftime(rel - INTERVAL 2 DAYS, '%Y-%m-%d %H') AS lock_at FROM c WHERE rel - INTERVAL 2 DAYS > TIMESTAMP '2026-09-16 12:00:00'""")
def round_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select(F.col("event_type").alias("series"), (F.length("event_type") % 7).alias("weekday")).distinct()
    return rules.candidates(s, "2026-09-16 12:00:00", 6).select("round_id", F.date_format("lock_at", "yyyy-MM-dd HH").alias("lock_at"))


@query("""WITH e AS (SELECT DISTINCT user_id AS series, CAST(ts AS DATE) AS date FROM events), s AS (SELECT *, date - lag(date) OVER (PARTITION BY series ORDER BY date) AS step, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS n FROM e) SELECT series, count(*) FILTER (step <> 1) AS slips, count(*) AS seen FROM s WHERE n <= 8 AND step IS NOT NULL GROUP BY 1""")
def schedule_slips(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("ts").cast("date").alias("date")).distinct()
    return rules.schedule_slips(e, 8, 1)


@query("""WITH m AS (SELECT o_custkey AS entrant, CAST(max(o_orderdate) AS DATE) AS cutoff FROM orders GROUP BY 1) SELECT entrant, cutoff, cutoff + 30 AS usable_from, (SELECT max(cutoff) + 30 FROM m) AS common_start FROM m""")
def usable_windows(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("entrant")).agg(F.max("o_orderdate").cast("date").alias("cutoff"))
    return rules.usable_from(m)


@query("""SELECT event_id, strftime(ts + INTERVAL 6 HOURS, '%Y-%m-%d %H:%M:%S') AS next_retry, ts + INTERVAL 6 HOURS >= TIMESTAMP '2024-01-15' AS at_risk FROM events""")
def retry_ledger(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "events").select("event_id", F.col("ts").alias("failed_at"), F.lit("2024-01-15").cast("timestamp_ntz").alias("deadline"))
    return rules.retries(f).select("event_id", F.date_format("next_retry", "yyyy-MM-dd HH:mm:ss").alias("next_retry"), "at_risk")


@query(f"""WITH {LISTS}, n AS (SELECT a.week_end, b.predicted FROM pr a JOIN pr b ON b.week_end = a.week_end - 7), f AS (SELECT week_end, 'persistence' AS entrant, predicted AS p, truth FROM pr UNION ALL SELECT pr.week_end, 'two_weeks', n.predicted, truth FROM pr JOIN n USING (week_end)),
  s AS (SELECT week_end, entrant, 1 - list_sum([0.1 * pow(0.9, d - 1) * len(list_intersect(p[1:d], truth[1:d])) / d for d in range(1, 11)]) / (1 - pow(0.9, 10)) AS loss, len(list_intersect(p, truth)) AS overlap FROM f), b AS (SELECT week_end, loss AS nl FROM s WHERE entrant = 'persistence')
  SELECT entrant, {r('avg(CASE WHEN nl = 0 THEN 0.0 ELSE 1 - loss / nl END)', 5)} AS skill, {r('avg(loss)')} AS loss, {r('avg(overlap)')} AS overlap, count(*) AS rounds FROM s JOIN b USING (week_end) GROUP BY 1""")
def ranking_board(spark: SparkSession, d: str) -> DataFrame:
    pairs = list_pairs(spark, d)
    older = pairs.select(F.date_add("week_end", 7).alias("week_end"), F.col("predicted").alias("p"))
    every = pairs.select("week_end", F.lit("persistence").alias("entrant"), F.col("predicted").alias("p"), "truth").unionByName(pairs.join(older, "week_end").select("week_end", F.lit("two_weeks").alias("entrant"), "p", "truth"))
    scored = every.select(F.col("week_end").alias("round_id"), "entrant", *rankings.list_scores(F.col("p"), F.col("truth"), 0.9, 10))
    return boards.shape_board(scored, ["loss", "overlap"]).select("entrant", rounded("skill", 5).alias("skill"), rounded("loss").alias("loss"), rounded("overlap").alias("overlap"), "rounds")


@query(f"""WITH {PROFILE_CELLS}, both_ AS (SELECT vec_id AS round_id, 'own' AS entrant, cell, mean, sd, outcome FROM pc UNION ALL SELECT vec_id, 'persistence', cell, mean, sd * 2, outcome FROM pc), {joint_sql('both_', 'round_id, entrant', 100)}, n AS (SELECT round_id, energy AS null_energy FROM js WHERE entrant = 'persistence')
  SELECT entrant, {r('avg(CASE WHEN null_energy = 0 THEN 0.0 ELSE 1 - energy / null_energy END)', 5)} AS skill, {r('avg(energy)', 5)} AS energy, {r('avg(structure)', 5)} AS structure, {r('avg(level)', 5)} AS level, count(*) AS rounds FROM js JOIN n USING (round_id) GROUP BY 1""")
def profile_board(spark: SparkSession, d: str) -> DataFrame:
    """Energy, level and structure by entrant against a null that spreads wider."""
    cells = profile_cells(spark, d)
    both = cells.withColumn("who", F.lit("own")).unionByName(cells.withColumn("who", F.lit("persistence")).withColumn("sd", F.col("sd") * 2))
    scored = profiles.joint_scores(both.select(F.col("vec_id").alias("round_id"), F.col("who").alias("entrant"), "cell", "mean", "sd", "outcome"), ["round_id", "entrant"], 100)
    return boards.shape_board(scored, ["energy", "structure", "level"]).select("entrant", *[rounded(c, 5).alias(c) for c in ("skill", "energy", "structure", "level")], "rounds")


@query(f"""WITH {BRAND_WEEKS}, c AS (SELECT week_end FROM bw GROUP BY 1 HAVING count(*) >= 10), k AS (SELECT week_end FROM c ORDER BY week_end DESC LIMIT 12), p AS (SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY revenue DESC, brand) AS place FROM bw SEMI JOIN k USING (week_end)) SELECT week_end, array_to_string(list(brand ORDER BY place), ',') AS items FROM p WHERE place <= 10 GROUP BY 1""")
def published_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = rankings.lists(rankings.top_n(brand_weeks(spark, d), ["week_end"], "brand", "revenue", 10), ["week_end"], "brand")
    return asof.last_rows(lists.withColumn("all", F.lit(1)), ["all"], "week_end", 12).select("week_end", F.array_join("items", ",").alias("items"))


@query(f"""WITH {OBS}, n AS (SELECT series, max(date) AS d, max_by(value, date) AS v FROM obs GROUP BY 1) SELECT n.series, n.d AS date, n.v AS value, {r('n.v - max_by(o.value, o.date)', 4)} AS change FROM n LEFT JOIN obs o ON o.series = n.series AND n.d - o.date >= 14 GROUP BY 1, 2, 3, n.v""")
def latest_trackers(spark: SparkSession, d: str) -> DataFrame:
    return boards.trackers(obs_table(spark, d), 14).select("series", "date", "value", rounded("change", 4).alias("change"))


@query(f"""WITH {SCORES}, {OBS.replace('obs AS', 'o2 AS')} SELECT round_id, max(value) AS outcome, string_agg(entrant || '=' || CAST(CAST(round(loss * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY entrant) AS scores, true AS resolved FROM scores JOIN o2 USING (series, date) GROUP BY 1""")
def attached_scores(spark: SparkSession, d: str) -> DataFrame:
    s = score_table(spark, d)
    rounds = s.select("round_id").distinct()
    outcomes = s.select("round_id", "series", "date").distinct().join(obs_table(spark, d), ["series", "date"]).select("round_id", F.col("value").alias("outcome"))
    found = boards.attach_scores(rounds, s, outcomes)
    text = F.array_join(F.transform(F.map_entries("scores"), lambda e: F.concat_ws("=", e["key"], F.round(e["value"] * 10000).cast("long"))), ",")
    return found.select("round_id", "outcome", text.alias("scores"), "resolved")


@query(f"""WITH p AS (SELECT event_type AS series, CAST(ts AS DATE) AS period, user_id % 3 AS capture, {r('avg(value)', 1)} AS value FROM events GROUP BY 1, 2, 3), f AS (SELECT *, row_number() OVER w AS k, lead(value) OVER w AS nx FROM p WINDOW w AS (PARTITION BY series, period ORDER BY capture)), g AS (SELECT *, value - lag(value) OVER (PARTITION BY series ORDER BY period) AS step FROM f WHERE k = 1) SELECT series, count(*) AS periods, count(*) FILTER (nx <> value) AS revised, {r('avg(abs(step))')} AS mean_change FROM g GROUP BY 1""")
def first_print_revisions(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.col("ts").cast("date").alias("period"), (F.col("user_id") % 3).alias("capture")).agg(rounded(F.avg("value"), 1).alias("value"))
    return boards.revisions(p).select("series", "periods", "revised", rounded("mean_change").alias("mean_change"))


@query("""WITH l AS (SELECT conv_id AS revision, turn AS place, role || length(text) % 9 AS item FROM conversations) SELECT revision, place, item FROM l""")
def dictionary_round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("revision"), F.col("turn").alias("place"), F.concat("role", F.length("text") % 9).alias("item"))
    return digests.decoded(*digests.encoded(rows))


@query("""WITH l AS (SELECT conv_id, turn, text AS item, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) SELECT conv_id, '- ' || string_agg(item, chr(10) || '- ' ORDER BY n) AS digest FROM l WHERE n <= 3 GROUP BY 1""")
def conversation_digests(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("place"), F.col("text").alias("item"))
    return digests.digest(items, ["conv_id"], 3)


@query(f"""WITH {OBS}, k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date DESC) AS n FROM obs) SELECT series, string_agg(CAST(date AS VARCHAR) || ': ' || printf('%.2f', floor(value * 100 + 0.50001) / 100), chr(10) ORDER BY date) AS lines FROM k WHERE n <= 10 GROUP BY 1""")
def prompt_histories(spark: SparkSession, d: str) -> DataFrame:
    return digests.history_lines(obs_table(spark, d).withColumn("value", rounded("value", 2)), 10)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id END AS filed FROM documents""")
def note_fields(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ok; filed=d"), "doc_id", F.lit("; x"))).otherwise("nothing").alias("notes"))
    return digests.notes_fields(n).select("doc_id", "filed")
