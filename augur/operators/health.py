"""Source health, run ledgers, retirement, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States from best to worst; days after which an entrant that files nothing is retired.
STATES, RETIRE_DAYS = ("ok", "unknown", "stale", "failing"), 14


def source_health(manifest: DataFrame, budgets: DataFrame, now: str) -> DataFrame:
    """source, state, age_days: each key's age against two budgets, a source by its worst key. Either side may lack a source.

    manifest: source, key, fetched_at. budgets: source, stale_days, failing_days.
    """
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("fetched_at")) / 86400.0
    rank = F.when(F.col("fetched_at").isNull() | F.col("stale_days").isNull(), 1).when(age > F.col("failing_days"), 3).when(age > F.col("stale_days"), 2).otherwise(0)
    joined = manifest.join(budgets, "source", "full").withColumns({"_rank": rank, "age_days": age})
    return joined.groupBy("source").agg(F.max("_rank").alias("_w"), F.max("age_days").alias("age_days")).select("source", F.element_at(F.lit(list(STATES)), F.col("_w") + 1).alias("state"), "age_days")


def retirement(filed: DataFrame, registered: DataFrame, today: str) -> DataFrame:
    """entrant, last_filed, retired_at: the day the window of silence closed, for those silent for longer; registered dates hold first."""
    last = filed.groupBy("entrant").agg(F.max("filed_at").cast("date").alias("last_filed"))
    closed = F.date_add("last_filed", RETIRE_DAYS)
    silent = F.when(F.datediff(F.lit(today).cast("date"), "last_filed") > RETIRE_DAYS, closed)
    return last.join(registered.select("entrant", F.col("retired_at").alias("_known")), "entrant", "full").select("entrant", "last_filed", F.coalesce("_known", silent).alias("retired_at"))


def call_records(calls: DataFrame, keep: int = 5) -> DataFrame:
    """entrant, calls, failures, last_at, last_failures (newest first, at most `keep`). calls: entrant, at, error."""
    newest = F.slice(F.sort_array(F.collect_list(F.when(F.col("recent") <= keep, F.struct("at", "error"))), asc=False), 1, keep)
    from pyspark.sql import Window as W

    order = W.partitionBy("entrant", F.col("error").isNull()).orderBy(F.desc("at"))
    ranked = calls.withColumn("recent", F.when(F.col("error").isNotNull(), F.row_number().over(order)))
    return ranked.groupBy("entrant").agg(F.count("*").alias("calls"), F.count("error").alias("failures"), F.max("at").alias("last_at"), newest["error"].alias("last_failures"))


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """entrant, cost, unmetered: tokens by price, and calls without usage. calls: entrant, tokens_in, tokens_out. prices: entrant, per_in, per_out (of a million)."""
    cost = (F.col("tokens_in") * F.col("per_in") + F.col("tokens_out") * F.col("per_out")) / 1e6
    return calls.join(prices, "entrant", "left").groupBy("entrant").agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("cost"), F.count_if(F.col("tokens_in").isNull() | F.col("tokens_out").isNull()).alias("unmetered"))


def affordable(jobs: Column, ceiling: float) -> Column:
    """Ids that a budget buys in order: one that doesn't fit is skipped and later ones may fit. jobs: array of (order keys.., cost, id), sorted."""
    start = F.struct(F.lit(0.0).alias("spent"), F.expr("array_repeat(cast(null as string), 0)").alias("ids"))

    def step(s: Column, j: Column) -> Column:
        fits = s["spent"] + j["cost"] <= ceiling
        return F.struct(F.when(fits, s["spent"] + j["cost"]).otherwise(s["spent"]).alias("spent"), F.when(fits, F.concat(s["ids"], F.array(j["id"]))).otherwise(s["ids"]).alias("ids"))

    return F.aggregate(jobs, start, step, lambda s: s["ids"])


def answered_by_domain(asked: DataFrame, answers: DataFrame, domains: DataFrame) -> DataFrame:
    """entrant, domain, asked, answered; zero counts stay, series without a domain are unplaced. asked: entrant, round_id, series."""
    placed = asked.join(domains, "series", "left").withColumn("domain", F.coalesce("domain", F.lit("unplaced")))
    joined = placed.join(answers.select("entrant", "round_id").distinct().withColumn("_hit", F.lit(1)), ["entrant", "round_id"], "left")
    return joined.groupBy("entrant", "domain").agg(F.count("*").alias("asked"), F.count("_hit").alias("answered"))


def changed_at(fetches: DataFrame) -> DataFrame:
    """fetches (source, fetched_at, content) with sha256 and changed_at: when the content last became what it is."""
    from pyspark.sql import Window as W

    w = W.partitionBy("source").orderBy("fetched_at")
    hashed = fetches.withColumn("sha256", F.sha2("content", 256)).withColumn("_before", F.lag("sha256").over(w))
    moved = F.when(~F.col("sha256").eqNullSafe(F.col("_before")), F.col("fetched_at"))
    return hashed.withColumn("changed_at", F.last(moved, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_before", "content")
