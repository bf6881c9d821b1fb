"""Landed files as DataFrames: explicit schemas, no inference, refusals as errors of the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Column types of the poll sheet: all text, typed by operators.polls.records.
POLL_SHEET = "poll_id string, subgroup string, pollster string, sponsors string, population string, start_date string, end_date string, n string, value string, url string, created string"
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
TOPLINE = "struct<mean:double,sd:double,quantiles:map<string,double>>"
FORECAST = f"round_id string, entrant string, topline {TOPLINE}, profile map<string,struct<mean:double,sd:double>>, ranking array<string>, notes string"
BACKTEST = f"entrant string, model string, series string, date date, outcome double, prompt_sha256 string, topline {TOPLINE}, error string, raw string, usage struct<tokens_in:bigint,tokens_out:bigint>, harness string"
SEARCH = "query string, params map<string,string>, fetched_at timestamp, results array<struct<title:string,url:string,published:string,content:string>>"


def refuse_unless(condition: Column, value: Column, message: str) -> Column:
    """value where the condition holds; the job fails where it doesn't."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("string"))


def poll_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=POLL_SHEET, mode="FAILFAST")


def two_columns(spark: SparkSession, path: str) -> DataFrame:
    """date, value of a sheet in which a dot stands for no value."""
    return spark.read.csv(path, header=True, schema="date date, value double", nullValue=".").dropna()


def monthly(raw: DataFrame) -> DataFrame:
    """date (first of month), value, preliminary. raw: month (its name, maybe with a mark (P)), year, value, all text."""
    name = F.trim(F.regexp_replace("month", r"\(P\)", ""))
    place = F.array_position(F.lit(list(MONTHS)), name).cast("int")
    return raw.select(F.make_date(F.col("year").cast("int"), F.nullif(place, F.lit(0)), F.lit(1)).alias("date"), F.expr("try_cast(value as double)").alias("value"), F.contains("month", F.lit("(P)")).alias("preliminary")).where("date is not null and value is not null")


def finals_first(finals: DataFrame, preliminary: DataFrame) -> DataFrame:
    """All final months, and preliminary ones that have no final."""
    return finals.unionByName(preliminary.join(finals.select("date"), "date", "left_anti"))


def forecasts(spark: SparkSession, path: str) -> DataFrame:
    """forecasts/<round>/<entrant>.json with the ids that the path gives where a file names none."""
    rows = spark.read.schema(FORECAST).json(f"{path}/*/*.json", multiLine=True).withColumn("_path", F.input_file_name())
    return rows.select(F.coalesce("round_id", F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)).alias("round_id"), F.coalesce("entrant", F.regexp_extract("_path", r"([^/]+)\.json$", 1)).alias("entrant"), "topline", "profile", "ranking", "notes")


def backtest_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BACKTEST).json(path)


def search_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH).json(path, multiLine=True)


def fresh(records: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """Of each query the newest record that is not too old."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("fetched_at")
    return records.where(age <= ttl_seconds).withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("fetched_at")))).where("_n = 1").drop("_n")


def pageviews(body: DataFrame) -> DataFrame:
    """date, title, views of bodies (column body, JSON with items)."""
    items = F.from_json("body", "struct<items:array<struct<article:string,timestamp:string,views:bigint>>>")["items"]
    return body.select(F.explode(items).alias("i")).select(F.to_date(F.substring("i.timestamp", 1, 8), "yyyyMMdd").alias("date"), F.col("i.article").alias("title"), F.col("i.views").alias("views"))


def weekly_timeline(body: DataFrame) -> DataFrame:
    """query, week_start, value, partial of JSON timelines. Fails on a step that is not seven days."""
    from augur.functions.text import strip_junk

    parsed = F.from_json(strip_junk(F.col("body")), "struct<timeline:array<struct<time:bigint,value:array<double>,isPartial:boolean>>>")["timeline"]
    rows = body.select("query", F.explode(parsed).alias("t")).select("query", F.col("t.time").alias("time"), F.get("t.value", F.lit(0)).alias("value"), F.coalesce("t.isPartial", F.lit(False)).alias("partial"))
    step = F.col("time") - F.lag("time").over(W.partitionBy("query").orderBy("time"))
    checked = rows.withColumn("_step", step).withColumn("query", refuse_unless(F.coalesce(F.col("_step") == 604_800, F.lit(True)), F.col("query"), "a weekly timeline has a gap"))
    return checked.select("query", F.timestamp_seconds("time").cast("date").alias("week_start"), "value", "partial")


def basket_timeline(body: DataFrame, queries: list[str]) -> DataFrame:
    """week_start, query, value: one value for each query of a basket. The job fails on a week without a value for each and on a step that is not seven days."""
    parsed = F.from_json("body", "struct<timeline:array<struct<time:bigint,value:array<double>>>>")["timeline"]
    values = "array<double>"
    times = F.transform(parsed, lambda t: t["time"])
    steady = F.forall(F.zip_with(F.slice(times, F.lit(1), F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, F.lit(2), F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: b - a), lambda gap: gap == 604_800)
    weeks = body.select(F.explode(F.when(F.size(times) < 2, parsed).when(steady, parsed).otherwise(refused("a weekly timeline has a gap", "array<struct<time:bigint,value:array<double>>>"))).alias("t"))
    whole = F.when(F.size("t.value") == len(queries), F.col("t.value")).otherwise(refused("a week without a value for each query", values))
    rows = weeks.select("t.time", F.explode(F.arrays_zip(F.lit(queries).alias("query"), whole.alias("value"))).alias("p"))
    return rows.select(F.timestamp_seconds("time").cast("date").alias("week_start"), "p.query", "p.value")


#: The survey table's header and rows, what its shares may miss of 100, days between rows and days since the newest.
SENTIMENT_HEADER = r"(?s)>\s*Reported Date\s*<.*?>\s*Bullish\s*<.*?>\s*Neutral\s*<.*?>\s*Bearish\s*<"
SENTIMENT_ROW = r'(?s)<td\s+align="left"\s+class="tableTxt">\s*([A-Za-z]{3,9})\s+(\d{1,2})\s*</td>' + r'\s*<td\s+align="right"\s+class="tableTxt">\s*(\d{1,3}(?:\.\d+)?)%\s*</td>' * 3
SHARE_TOLERANCE, MOST_GAP_DAYS, MOST_STALE_DAYS = 1.0, 45, 21


def refused(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def sentiment_rows(page: DataFrame) -> DataFrame:
    """date, bull, neutral, bear, spread of weekly HTML tables (column body, newest first; dates without a year; column asof, the reply's own date).

    The year falls by one whenever a date does not lie before the one above it: a fold over the rows. The job fails on
    another header, a date that is none, rows that are not 1 to 45 days apart, shares that don't add up to 100, a page
    without rows and one whose newest row is more than 21 days old.
    """
    part = lambda c, i: F.regexp_extract(c, SENTIMENT_ROW, i)
    month = lambda name: F.coalesce(F.nullif(F.array_position(F.lit(list(MONTHS)), name), F.lit(0)), F.nullif(F.array_position(F.lit([m[:3] for m in MONTHS]), F.when(name == "Sept", "Sep").otherwise(name)), F.lit(0)), refused("a row without a month", "bigint")).cast("int")
    texts = F.when(F.col("body").rlike(SENTIMENT_HEADER), F.regexp_extract_all("body", F.lit(SENTIMENT_ROW), F.lit(0))).otherwise(refused("the table's header is another", "array<string>"))
    cells = F.transform(texts, lambda c: F.struct(month(part(c, 1)).alias("month"), part(c, 2).cast("int").alias("day"), *[part(c, i).cast("double").alias(n) for i, n in ((3, "bull"), (4, "neutral"), (5, "bear"))]))
    none = F.expr("array_repeat(named_struct('date', cast(null as date), 'bull', 0D, 'neutral', 0D, 'bear', 0D), 0)")

    def step(s: Column, c: Column) -> Column:
        first, year = s["last"].isNull(), F.year(F.coalesce(s["last"], F.col("asof")))
        guess = F.make_date(year, c["month"], c["day"])
        date = F.when(F.when(first, guess > F.col("asof")).otherwise(guess >= s["last"]), F.make_date(year - 1, c["month"], c["day"])).otherwise(guess)
        gap = F.datediff(s["last"], date)
        date = F.when(date.isNull(), refused("a date that is none", "date")).when(first | gap.between(1, MOST_GAP_DAYS), date).otherwise(refused("rows are no weekly sequence", "date"))
        return F.struct(date.alias("last"), F.concat(s["rows"], F.array(F.struct(date.alias("date"), *[c[n].alias(n) for n in ("bull", "neutral", "bear")]))).alias("rows"))

    folded = page.withColumn("_rows", F.aggregate(cells, F.struct(F.lit(None).cast("date").alias("last"), none.alias("rows")), step)["rows"])
    newest = F.get(F.col("_rows"), F.lit(0))["date"]
    kind = folded.schema["_rows"].dataType.simpleString()
    fine = F.when(F.size("_rows") == 0, refused("a page without rows", kind)).when(F.datediff(F.col("asof"), newest) > MOST_STALE_DAYS, refused("a stale page", kind)).otherwise(F.col("_rows"))
    rows = folded.select(F.explode(fine).alias("r")).select("r.*")
    total = F.col("bull") + F.col("neutral") + F.col("bear")
    share = lambda c: F.when(F.abs(total - 100) <= SHARE_TOLERANCE, F.col(c)).otherwise(refused("shares don't add up to 100", "double")).alias(c)
    return rows.select("date", *[share(c) for c in ("bull", "neutral", "bear")], F.round(F.col("bull") - F.col("bear"), 2).alias("spread"))


def top_articles(days: DataFrame) -> DataFrame:
    """day, title, views of daily lists (columns day, a date; body, JSON with items of articles).

    The job fails on a list without items or articles, on one of another day than was asked for, and on a title that a
    day lists twice. Articles without a title or views are left out.
    """
    kind = "array<struct<article:string,views:bigint>>"
    item = F.get(F.from_json("body", f"struct<items:array<struct<year:string,month:string,day:string,articles:{kind}>>>")["items"], F.lit(0))
    own = F.concat_ws("-", F.coalesce(item["year"], F.lit("")), F.lpad(F.coalesce(item["month"], F.lit("")), 2, "0"), F.lpad(F.coalesce(item["day"], F.lit("")), 2, "0"))
    held = F.filter(item["articles"], lambda a: a["article"].isNotNull() & (a["article"] != "") & a["views"].isNotNull())
    titles = F.transform(held, lambda a: a["article"])
    fine = (
        F.when(item.isNull(), refused("a day without items", kind)).when(own != F.col("day").cast("string"), refused("a list of another day", kind))
        .when(F.size(F.array_distinct(titles)) != F.size(titles), refused("a day lists a title twice", kind)).when(F.coalesce(F.size(held), F.lit(0)) < 1, refused("a day without articles", kind)).otherwise(held)
    )
    return days.select("day", F.explode(fine).alias("a")).select("day", F.col("a.article").alias("title"), "a.views")


def tracker_points(snapshots: DataFrame) -> DataFrame:
    """key, capture_day, date, choice, value in percent. snapshots: key, capture_day, body (JSON: choices, points of [ms, share, ...])."""
    kind = "struct<choices:array<string>,points:array<array<double>>>"
    parsed = F.from_json("body", kind)
    # an unknown name gets an index page instead of an error, and a page without points would be an empty series
    parsed = F.when(F.coalesce(F.size(parsed["points"]), F.lit(0)) > 0, parsed).otherwise(refused("a page without a tracker's points", kind))
    rows = snapshots.select("key", "capture_day", parsed.alias("p")).select("key", "capture_day", "p.choices", F.explode("p.points").alias("row"))
    pairs = F.arrays_zip(F.col("choices").alias("choice"), F.slice("row", 2, F.size("choices")).alias("share"))
    return rows.select("key", "capture_day", F.timestamp_millis(F.get("row", F.lit(0)).cast("long")).cast("date").alias("date"), F.explode(pairs).alias("c")).select("key", "capture_day", "date", "c.choice", F.round(F.col("c.share") * 100, 2).alias("value"))


def tracker_snapshot(points: DataFrame, choices: list[str], keep: int | None = 60) -> DataFrame:
    """key, capture_day, date and a column for each choice: all dates that any choice has, the newest `keep` of each capture (None: all)."""
    wide = points.groupBy("key", "capture_day", "date").pivot("choice", choices).agg(F.max("value"))
    if keep is None:
        return wide
    newest = F.row_number().over(W.partitionBy("key", "capture_day").orderBy(F.desc("date")))
    return wide.withColumn("_n", newest).where(F.col("_n") <= keep).drop("_n")


def net_of(points: DataFrame, plus: list[str], minus: list[str]) -> DataFrame:
    """key, capture_day, date, value: sums of choices that a date has all of, the second from the first."""
    own = points.where(F.col("choice").isin(plus + minus)).groupBy("key", "capture_day", "date").agg(F.sum(F.when(F.col("choice").isin(plus), F.col("value")).otherwise(-F.col("value"))).alias("value"), F.countDistinct("choice").alias("n"))
    return own.where(F.col("n") == len(plus) + len(minus)).drop("n")


#: The headings whose items a digest takes.
CATEGORIES = ("Politics and elections", "Business and economy", "Law and crime", "Armed conflicts and attacks", "Disasters and accidents", "Health and environment", "International relations")


def bullets(pages: DataFrame, categories: tuple[str, ...] | None = None) -> DataFrame:
    """day, category, place, item of wikitext (day, body): leaves only, without markup, the first of equal items; of all headings, or of those named."""
    from augur.functions.text import strip_markup

    lines = pages.select("day", F.posexplode(F.split("body", "\n")).alias("at", "line"))
    w = W.partitionBy("day").orderBy("at")
    depth = F.length(F.regexp_extract("line", r"^(\*+)", 1))
    marked = lines.withColumns({"depth": depth, "heading": F.nullif(F.regexp_extract("line", r"^'''(.+?)'''", 1), F.lit(""))})
    marked = marked.withColumn("category", F.last("heading", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).where("depth > 0 and category is not null")
    if categories is not None:
        marked = marked.where(F.col("category").isin(*categories))
    leaf = F.coalesce(F.lead("depth").over(w) <= F.col("depth"), F.lit(True)) | (F.lead("category").over(w) != F.col("category"))
    items = marked.withColumn("leaf", leaf).where("leaf").select("day", strip_markup(F.col("category")).alias("category"), "at", strip_markup(F.regexp_replace("line", r"^\*+\s*", "")).alias("item")).where("item <> ''")
    first = F.row_number().over(W.partitionBy("day", "item").orderBy("at"))
    return items.withColumn("_n", first).where("_n = 1").select("day", "category", F.row_number().over(w).alias("place"), "item")


def topline_report(pages: DataFrame, least_base: int = 500) -> DataFrame:
    """date, base, approve, disapprove, unsure of report texts (column body). Refuses a small base, shares that don't add up to 100, and another wording."""
    share = lambda word: F.regexp_extract("body", rf"(?im)^\s*{word}[^0-9\n]*([0-9]+(?:\.[0-9]+)?)\s*%", 1).cast("double")
    rows = pages.select(
        "body", F.try_to_timestamp(F.regexp_extract("body", r"(?i)produced(?: on)? ([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1), F.lit("MMMM d, yyyy")).cast("date").alias("date"),
        F.regexp_replace(F.regexp_extract("body", r"(?i)base:?\s*([0-9,]+)", 1), ",", "").cast("int").alias("base"), share("approve").alias("approve"), share("disapprove").alias("disapprove"), share("(?:unsure|don't know)").alias("unsure"),
    )
    total = F.col("approve") + F.col("disapprove") + F.col("unsure")
    problem = F.when(~F.regexp_like("body", F.lit("(?i)approve or disapprove")), "another wording").when(F.col("date").isNull(), "no date").when(F.col("base") < least_base, "a small base").when(F.abs(total - 100) > 1.5, "shares don't add up to 100")
    return rows.withColumn("date", F.when(problem.isNull(), F.col("date")).otherwise(F.raise_error(F.concat(F.lit("a report was refused: "), problem)).cast("date"))).drop("body")


def group_table(pages: DataFrame, groups: list[str]) -> DataFrame:
    """month, group, value of texts (column body) with lines of a month, a year and a number for each group."""
    line = r"(?m)^\s*(" + "|".join(MONTHS) + r")\s+([0-9]{4})" + r"\s+([0-9]+\.[0-9])" * len(groups) + r"\s*$"
    lines = pages.select(F.explode(F.regexp_extract_all("body", F.lit(line), F.lit(0))).alias("line"))
    part = lambda i: F.regexp_extract("line", line, i)
    month = F.make_date(part(2).cast("int"), F.array_position(F.lit(list(MONTHS)), part(1)).cast("int"), F.lit(1))
    return lines.select(month.alias("month"), F.explode(F.array(*[F.struct(F.lit(g).alias("group"), part(3 + i).cast("double").alias("value")) for i, g in enumerate(groups)])).alias("g")).select("month", "g.group", "g.value")


def contiguous_months(rows: DataFrame, first: str, low: float, high: float) -> DataFrame:
    """rows (month, value) as they are; fails on a gap, on a value out of range and on another first month."""
    index = F.year("month") * 12 + F.month("month")
    step = index - F.lag(index).over(W.partitionBy(F.lit(0)).orderBy("month"))  # a row for each month
    problem = F.when(step.isNull() & (F.col("month") != F.lit(first).cast("date")), "another first month").when(step != 1, "a gap").when(~F.col("value").between(low, high), "a value out of range")
    checked = rows.withColumn("_problem", problem)
    return checked.withColumn("value", F.when(F.col("_problem").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("monthly values were refused: "), F.col("_problem"))).cast("double"))).drop("_problem")


def complete_waves(cells: DataFrame, labels: list[str], measures: list[str]) -> DataFrame:
    """cells (date, cell, measure, value) of the waves that have every measure of every cell."""
    wanted = cells.where(F.col("cell").isin(labels) & F.col("measure").isin(measures) & F.col("value").isNotNull())
    full = wanted.groupBy("date").agg(F.countDistinct("cell", "measure").alias("_n")).where(F.col("_n") == len(labels) * len(measures)).select("date")
    return wanted.join(full, "date", "left_semi")


def catalogue(body: DataFrame) -> DataFrame:
    """name, slug, updated of an index (column body, JSON with trackers), by name. Refuses an empty one."""
    parsed = F.from_json("body", "struct<trackers:array<struct<name:string,slug:string,updated:bigint>>>")["trackers"]
    held = F.when(F.size(parsed) > 0, parsed).otherwise(F.raise_error(F.lit("an index without trackers")).cast("array<struct<name:string,slug:string,updated:bigint>>"))
    return body.select(F.explode(held).alias("t")).select("t.name", "t.slug", F.timestamp_millis("t.updated").alias("updated")).orderBy("name")


def ignored_filters(snapshots: DataFrame) -> DataFrame:
    """Snapshots whose reply was made with other filters than were asked for. Columns: asked, applied (maps)."""
    plain = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"], e["value"])))
    return snapshots.where(~plain("asked").eqNullSafe(plain("applied")))
