"""Queries: workbooks, trees of replies, merged tables and intake, each landed from the driver's tables first."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from augur.operators import health, prompts, rankings
from augur.plans.fixtures import BRAND_WEEKS, OBS, brand_weeks, r, rounded, table
from augur.plans.fixtures import obs as obs_table
from augur.plans.registry import query
from augur.plans.streams import drained, utc
from augur.session import shared_dir
from augur.sources import books, corpus, registry, trees, versions
from augur.streaming import intake

CELLS = [label for _, label in registry.XTAB_CELLS]


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/augur/{name}-{uuid.uuid4().hex}"


@query("""SELECT CAST(date_trunc('month', o_orderdate) + INTERVAL 216 MONTH AS DATE) AS date, CAST(sum(o_orderkey) % 200 AS DOUBLE) / 10 AS infl_1y, CAST(sum(o_orderkey) % 150 AS DOUBLE) / 10 AS infl_3y FROM orders GROUP BY 1""")
def workbook_months(spark: SparkSession, d: str) -> DataFrame:
    """Monthly medians of a workbook's cells, by the names of their columns; sums of orders by month stand in the cells."""
    month = F.add_months(F.trunc("o_orderdate", "MM"), 216)
    rows = table(spark, d, "orders").groupBy(month.alias("m")).agg(F.sum("o_orderkey").alias("v"))
    texts = {"A": F.date_format("m", "yyyyMM"), "B": F.lit("99.9"), "C": (F.col("v") % 150 / 10).cast("string"), "D": (F.col("v") % 200 / 10).cast("string")}
    at = (F.months_between("m", F.lit("2013-01-01")) + 5).cast("int")
    cell = lambda row, column, text: F.struct(F.lit("w").alias("path"), F.lit(books.MONTH_SHEET).alias("sheet"), row.alias("row"), F.lit(column).alias("column"), text.alias("text"))
    data = rows.select(F.explode(F.array(*[cell(at, c, t) for c, t in texts.items()])).alias("c")).select("c.*")
    heads = spark.createDataFrame([("w", books.MONTH_SHEET, 4, c, t) for c, t in (("B", "25th Percentile"), ("C", books.HEADERS["infl_3y"]), ("D", books.HEADERS["infl_1y"]))], data.schema)
    return books.monthly_medians(data.unionByName(heads), least_rows=12)


_WAVES = f"""m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS m, o_custkey % 3 AS p, CAST(sum(o_orderkey) AS BIGINT) AS v FROM orders GROUP BY 1, 2)"""


@query(f"""WITH {_WAVES}, l AS (SELECT unnest({[books.TOPLINE, *CELLS]!r}) AS cell, unnest(range(0, 17)) AS i), k AS (SELECT * FROM (VALUES ('approve', 0), ('disapprove', 1), ('not_sure', 2), ('unweighted_base', 3), ('base', 4)) t(measure, j)),
  c AS (SELECT p, m, cell, measure, CASE WHEN v % 11 = 0 AND i = 5 AND j = 1 THEN NULL WHEN j < 3 THEN round_even(CAST((v + i * 7 + j * 13) % 101 AS DOUBLE) / 100 * 100, 4) ELSE CAST((v + i + j) % 900 AS DOUBLE) END AS value FROM m, l, k)
  SELECT 'b' || p AS path, CAST(m AS VARCHAR) AS date, cell, measure, value FROM c WHERE (p, m) IN (SELECT (p, m) FROM c GROUP BY p, m HAVING count(value) = 85)""")
def workbook_waves(spark: SparkSession, d: str) -> DataFrame:
    """The complete waves of three crosstab workbooks: a sheet for the topline and each cell, a column for each month."""
    month = F.trunc("o_orderdate", "MM")
    rows = table(spark, d, "orders").groupBy(month.alias("m"), (F.col("o_custkey") % 3).alias("p")).agg(F.sum("o_orderkey").alias("v"))
    sheets = F.explode(F.transform(F.lit([books.TOPLINE, *CELLS]), lambda s, i: F.struct(s.alias("sheet"), i.alias("i")))).alias("s")
    labels = F.explode(F.transform(F.lit(["", *books.LABELS]), lambda s, j: F.struct(s.alias("label"), (j - 1).alias("j")))).alias("l")
    grid = rows.select("m", "p", "v", sheets).select("*", labels).select("m", "p", "v", "s.*", "l.*")
    share = ((F.col("v") + F.col("i") * 7 + F.col("j") * 13) % 101 / 100).cast("string")
    base = ((F.col("v") + F.col("i") + F.col("j")) % 900).cast("string")
    text = F.when(F.col("j") < 0, F.col("m").cast("string")).when((F.col("v") % 11 == 0) & (F.col("i") == 5) & (F.col("j") == 1), "").when(F.col("j") < 3, share).otherwise(base)
    place = {"path": F.concat(F.lit("b"), "p"), "sheet": F.col("sheet"), "row": F.col("j") + 2}
    cells = grid.select(*[c.cast("int" if n == "row" else "string").alias(n) for n, c in place.items()], F.date_format("m", "'C'yyyyMM").alias("column"), text.alias("text"))
    first = grid.select(*[c.cast("int" if n == "row" else "string").alias(n) for n, c in place.items()], F.lit("A").alias("column"), F.when(F.col("j") < 0, "Approve or disapprove?").otherwise(F.col("label")).alias("text")).distinct()
    return books.crosstab_waves(cells.unionByName(first), CELLS).select("path", "date", "cell", "measure", "value")


@query("""WITH c AS (SELECT 'r' || user_id % 30 AS round_id, 'e' || user_id % 20 AS entrant, CASE WHEN event_type = 'error' THEN 'http ' || (400 + event_id % 130) END AS error, ts, event_id FROM events WHERE user_id % 30 IN (3, 4)),
  f AS (SELECT round_id, entrant, error IS NOT NULL AS failed, max(ts) AS logged, max_by(error, (ts, event_id)) AS error FROM c GROUP BY 1, 2, 3) SELECT entrant, count(*) AS calls, count(error) AS failures, strftime(max(logged), '%Y-%m-%d %H:%M:%S') AS last_at FROM f GROUP BY 1""")
def reply_tree(spark: SparkSession, d: str) -> DataFrame:
    """Calls of two rounds by entrant, from a tree of reply files, which is landed from all events and read by its format: other rounds' folders are not listed."""
    trees.register(spark)
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("http "), 400 + F.col("event_id") % 130))
    calls = table(spark, d, "events").select(F.concat(F.lit("r"), F.col("user_id") % 30).alias("round_id"), F.concat(F.lit("e"), F.col("user_id") % 20).alias("entrant"), error.alias("error"), "ts", "event_id")
    files = calls.groupBy("round_id", "entrant", F.col("error").isNotNull().alias("failed")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("logged_at"), F.max_by("error", F.struct("ts", "event_id")).alias("error"))
    root = own_folder(spark, "replies")
    landed = files.select("round_id", "entrant", "failed", F.lit("").alias("path"), F.lit(None).cast("timestamp").alias("modified"), F.to_json(F.struct("entrant", "logged_at", "error")).alias("body"))
    landed.write.format(trees.FORMAT).mode("append").save(root)
    found = spark.read.format(trees.FORMAT).load(root).where(F.col("round_id").isin("r3", "r4"))
    reply = F.from_json("body", "struct<entrant:string,logged_at:string,error:string>")
    told = health.call_records(found.select(reply.alias("r")).select("r.entrant", F.col("r.logged_at").cast("timestamp").alias("at"), "r.error"))
    return told.select("entrant", "calls", "failures", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"))


@query("""WITH u AS (SELECT o_custkey % 500 AS round_id, o_orderpriority AS field, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS step, max(o_orderkey) AS value FROM orders GROUP BY 1, 2, 3)
  SELECT round_id, field, CASE WHEN count(*) FILTER (step < 2) > 0 THEN max_by(value, step) FILTER (step < 2) ELSE max(value) END AS value FROM u GROUP BY 1, 2""")
def staged_merges(spark: SparkSession, d: str) -> DataFrame:
    """Fields of rounds after three merges into one table: a first load, updates that replace, and late ones that only add."""
    path = own_folder(spark, "merged")
    side = lambda s: table(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy((F.col("o_custkey") % 500).alias("round_id"), F.col("o_orderpriority").alias("field")).agg(F.max("o_orderkey").alias("value"))
    for status, wins in (("F", "new"), ("O", "new"), ("P", "old")):
        versions.merge(path, side(status), ["round_id", "field"], ["round_id"], wins)
    return versions.read(spark, path, "round_id bigint, field string, value bigint")


_INTAKE = """WITH s AS (SELECT 'k' || user_id || '-' || event_type AS key, event_id AS seq, ts, event_type || event_id % 3 AS body FROM events), f AS (SELECT *, first_value(body) OVER w AS b, first_value(seq) OVER w AS q, first_value(ts) OVER w AS t FROM s WINDOW w AS (PARTITION BY key ORDER BY ts, seq))
  SELECT key, seq, CASE WHEN NOT length(key) BETWEEN 8 AND 200 THEN 'invalid' WHEN seq = q THEN 'accepted' WHEN body = b THEN 'repeated' ELSE 'refused' END AS outcome, CASE WHEN length(key) BETWEEN 8 AND 200 THEN strftime(t, '%Y-%m-%d %H:%M:%S.%f') END AS first_at FROM f"""


def submissions(e: DataFrame) -> DataFrame:
    return e.select(F.concat(F.lit("k"), "user_id", F.lit("-"), "event_type").alias("key"), F.col("event_id").alias("seq"), "ts", F.concat("event_type", F.col("event_id") % 3).alias("body"))


@query(_INTAKE)
def judged_submissions(spark: SparkSession, d: str) -> DataFrame:
    """Submissions as accepted, repeated, refused or invalid."""
    rows = submissions(utc(table(spark, d, "events"))).select("key", "seq", F.col("ts").alias("at"), F.sha2("body", 256).alias("digest"))
    return intake.judged(rows).select("key", "seq", "outcome", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_at"))


@query(_INTAKE)
def stream_intake(spark: SparkSession, d: str) -> DataFrame:
    """The same by keyed state."""
    told = drained(spark, d, lambda e: intake.intake(submissions(e)), "append").where("key is not null")
    return told.select("key", "seq", "outcome", F.date_format("first_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("first_at"))


@query("""WITH c AS (SELECT DATE '2026-01-01' + CAST(conv_id % 7 AS INTEGER) AS day, conv_id AS revision, CAST(turn AS INTEGER) AS place, role AS category, text FROM conversations), n AS (SELECT day, count(DISTINCT (category, text)) AS n_items FROM c GROUP BY 1) SELECT c.*, n_items FROM c JOIN n USING (day)""")
def growing_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Revisions after three loads, of which each holds what the one before held: texts by their references, and how many items each day's pool holds."""
    path = own_folder(spark, "corpus")
    turns = table(spark, d, "conversations").select(F.date_add(F.lit("2026-01-01").cast("date"), (F.col("conv_id") % 7).cast("int")).alias("day"), F.col("conv_id").alias("revision"), F.col("turn").cast("int").alias("place"), F.col("role").alias("category"), "text")
    for share in (2, 4, 5):
        corpus.load(path, turns.where(F.col("revision") % 5 < share))
    pools = corpus.held(spark, f"{path}/items", corpus.ITEMS).groupBy("day").agg(F.count("*").alias("n_items"))
    return corpus.read(spark, path).join(F.broadcast(pools), "day")


def sql_text(template: str, **values: str) -> str:
    """A template as SQL's concatenation."""
    parts = []
    for literal, field, _, _ in string.Formatter().parse(template):
        parts += ["'" + literal.replace("'", "''") + "'"] if literal else []
        parts += [f"CAST({values[field]} AS VARCHAR)"] if field is not None else []
    return " || ".join(parts)


_ROUND = {"publisher": "'p ' || s", "question": "'what of ' || s", "unit": "'points'", "methodology": "'not stated'", "cadence": "'daily'", "release": "'2024-02-01'"}
_POINTS = "array_to_string(list_transform(list_slice(h, greatest(len(h) - 9, 1), len(h)), lambda p: '{pad}' || p.d || ': ' || p.v), chr(10))"


@query(f"""WITH {OBS}, o AS (SELECT series AS s, list({{'d': CAST(date AS VARCHAR), 'v': CAST(value AS VARCHAR)}} ORDER BY date) AS h FROM obs GROUP BY 1)
  SELECT s AS series, 'recent10' AS kind, {sql_text(prompts.HEADER, **_ROUND)} || {sql_text(prompts.WITH_HISTORY, history=_POINTS.format(pad='  '))} || {sql_text(prompts.SUPERFC + prompts.FOOTER)} AS prompt FROM o
  UNION ALL SELECT s, 'none', {sql_text(prompts.HEADER + prompts.NO_HISTORY + prompts.FOOTER, **_ROUND)} FROM o
  UNION ALL SELECT s, 'news', {sql_text(prompts.HEADER, **_ROUND)} || {sql_text(prompts.WITH_HISTORY, history=_POINTS.format(pad='  '))} || {sql_text(prompts.NEWS.replace('news.', ''), asof="'today'", text="'- ' || s || ' moved'")} || {sql_text(prompts.FOOTER)} FROM o
  UNION ALL SELECT s, 'query', {sql_text(prompts.HEADER, **_ROUND)} || {sql_text(prompts.WITH_HISTORY, history=_POINTS.format(pad='  '))} || {sql_text(prompts.QUERY_TURN, most='3', days='14')} FROM o""")
def number_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of rounds about a number, in four conditions."""
    rounds = obs_table(spark, d).groupBy("series").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("history")).select(
        "series", "history", F.concat(F.lit("p "), "series").alias("publisher"), F.concat(F.lit("what of "), "series").alias("question"), F.lit("points").alias("unit"), F.lit("daily").alias("cadence"), F.lit("2024-02-01T14:00:00Z").alias("release_at"),
        F.struct(F.lit("today").alias("asof"), F.concat(F.lit("- "), "series", F.lit(" moved")).alias("text")).alias("news"),
    )
    kinds = {"recent10": prompts.number_prompt(rounds, "recent10", "superfc"), "none": prompts.number_prompt(rounds, "none"), "news": prompts.number_prompt(rounds, "news"), "query": prompts.query_prompt(rounds)}
    every = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("prompt")) for k, p in kinds.items()]))
    return rounds.select("series", every.alias("p")).select("series", "p.*")


_PROFILE = {"publisher": "'not stated'", "question": "''", "unit": "'points'", "methodology": "'a panel'", "cadence": "'not stated'", "release": "'2024-02-01'", "noun": "'group'", "count": "len(cells)"}


@query(f"""WITH u AS (SELECT user_id % 20 AS g, event_type AS e, CAST(ts AS DATE) AS date, {r('avg(value)', 2)} AS v FROM events GROUP BY 1, 2, 3), c AS (SELECT g, e, list({{'d': CAST(date AS VARCHAR), 'v': CAST(v AS VARCHAR)}} ORDER BY date) AS h FROM u GROUP BY 1, 2),
  t AS (SELECT g, list(e ORDER BY e) AS cells, string_agg('  ' || e || CASE WHEN e < 'd' THEN '  (group ' || e || ')' ELSE '' END || chr(10) || {_POINTS.format(pad='    ')}, chr(10) ORDER BY e) AS lines FROM c GROUP BY 1)
  SELECT g, {sql_text(prompts.PROFILE_HEADER + prompts.PROFILE_WITH_HISTORY, **_PROFILE)} || lines || chr(10) || {sql_text(prompts.PROFILE_FOOTER, **_PROFILE)} AS prompt FROM t""")
def profile_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of rounds about a profile: a nested list, cells with their histories."""
    daily = table(spark, d, "events").groupBy((F.col("user_id") % 20).alias("g"), F.col("event_type").alias("id"), F.col("ts").cast("date").alias("date")).agg(rounded(F.avg("value"), 2).alias("value"))
    cells = daily.groupBy("g", "id").agg(F.array_sort(F.collect_list(F.struct("date", "value"))).alias("history"))
    own = F.struct("id", F.when(F.col("id") < "d", F.concat(F.lit("group "), "id")).alias("label"), "history")
    rounds = cells.groupBy("g").agg(F.array_sort(F.collect_list(own)).alias("cells")).withColumns({"unit": F.lit("points"), "methodology": F.lit("a panel"), "noun": F.lit("group"), "release_at": F.lit("2024-02-01T14:00:00Z")})
    return rounds.select("g", prompts.profile_prompt(rounds).alias("prompt"))


_RANKING = {"publisher": "'not stated'", "question": "'which ten'", "unit": "'a list'", "methodology": "'not stated'", "cadence": "'weekly'", "release": "'2001-01-09'", "week_start": "'2001-01-01'", "week_end": "'2001-01-07'", "universe": "'Brands.' || chr(10)", "length": "10"}


@query(f"""WITH {BRAND_WEEKS}, p AS (SELECT *, row_number() OVER (PARTITION BY week_end ORDER BY revenue DESC, brand) AS place FROM bw), l AS (SELECT week_end, string_agg('    ' || place || '. ' || brand, chr(10) ORDER BY place) AS lines FROM p WHERE place <= 10 GROUP BY 1 HAVING count(*) = 10),
  k AS (SELECT isodow(week_end) AS one, week_end, lines FROM l QUALIFY row_number() OVER (ORDER BY week_end DESC) <= 10), w AS (SELECT one, string_agg('  week ending ' || week_end || chr(10) || lines, chr(10) ORDER BY week_end) AS weeks FROM k GROUP BY 1)
  SELECT 'recent10' AS kind, {sql_text(prompts.RANKING_HEADER + prompts.RANKING_WITH_HISTORY, **_RANKING)} || weeks || chr(10) || {sql_text(prompts.RANKING_SUPERFC + prompts.RANKING_FOOTER, **_RANKING)} AS prompt FROM w
  UNION ALL SELECT 'none', {sql_text(prompts.RANKING_HEADER + prompts.RANKING_NO_HISTORY + prompts.RANKING_FOOTER, **_RANKING)} FROM w""")
def ranking_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of a round about a list, with the lists of its last ten weeks and without."""
    lists = rankings.lists(rankings.top_n(brand_weeks(spark, d), ["week_end"], "brand", "revenue", 10), ["week_end"], "brand").where(F.size("items") == 10)
    recent = lists.orderBy(F.desc("week_end")).limit(10)  # ten weeks are the feature
    weeks = recent.agg(F.array_sort(F.collect_list(F.struct(F.col("week_end").cast("string").alias("date"), "items"))).alias("weeks"))
    texts = {"question": "which ten", "unit": "a list", "cadence": "weekly", "release_at": "2001-01-09T14:00:00Z", "week_start": "2001-01-01", "week_end": "2001-01-07", "universe": "Brands.\n"}
    rounds = weeks.withColumns({k: F.lit(v) for k, v in texts.items()} | {"length": F.lit(10)})
    kinds = {"recent10": prompts.ranking_prompt(rounds, "recent10", "superfc"), "none": prompts.ranking_prompt(rounds, "none")}
    return rounds.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), p.alias("prompt")) for k, p in kinds.items()])).alias("p")).select("p.*")
