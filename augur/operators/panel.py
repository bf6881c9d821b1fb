"""Survey panels: weighted shares, nets, indices and their sampling error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Divisor and constant of the sentiment index.
INDEX_DIVISOR, INDEX_CONSTANT = 6.7558, 2.0


def renormalised(panel: DataFrame, keep: Column) -> DataFrame:
    """The rows of panel (w, any others) that are kept, their weights scaled to sum to 1."""
    kept = panel.where(keep)
    return kept.crossJoin(F.broadcast(kept.agg(F.sum("w").alias("_all")))).withColumn("w", F.col("w") / F.col("_all")).drop("_all")  # one row


def population_weights(panel: DataFrame, population: str | None) -> DataFrame:
    """panel (w, registered, any others) weighted for the population that a tracker reports: adults (A, or none named) by their own weights, voters (RV, LV) by these times the rate of registration.

    Nobody is left out, so a small panel stays whole; weights sum to 1. A population that nobody is in fails the job.
    """
    raw = panel if (population or "A").upper() == "A" else panel.withColumn("w", F.col("w") * F.col("registered"))
    total = raw.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("_all"))  # one row
    held = total.select(F.when(F.col("_all") > 0, F.col("_all")).otherwise(F.raise_error(F.lit(f"population {population!r} left the panel empty")).cast("double")).alias("_all"))
    return raw.crossJoin(F.broadcast(held)).withColumn("w", F.col("w") / F.col("_all")).drop("_all")


def tally(answers: DataFrame, by: list[str]) -> DataFrame:
    """by, item, option, w: weights of those who answered."""
    return answers.where("option is not null").groupBy(*by, "item", "option").agg(F.sum("w").alias("w"))


def share(options: list[str]) -> Column:
    """Percent of the weight on the options. Over rows (option, w)."""
    return 100 * F.sum(F.when(F.col("option").isin(options), F.col("w")).otherwise(0.0)) / F.sum("w")


def net_share(plus: list[str], minus: list[str]) -> Column:
    return share(plus) - share(minus)


def sentiment_index(answers: DataFrame, by: list[str], plus: str, minus: str) -> DataFrame:
    """by, index: over the items, percent favourable less percent unfavourable plus 100, summed and scaled."""
    items = answers.where("option is not null").groupBy(*by, "item").agg((net_share([plus], [minus]) + 100).alias("balance"))
    return items.groupBy(*by).agg((F.sum("balance") / INDEX_DIVISOR + INDEX_CONSTANT).alias("index"))


def panel_error(p: Column) -> Column:
    """Standard error of a share p in percent, by Kish's effective size. Over rows (w)."""
    effective = F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))
    return 100 * F.sqrt(p * (1 - p) / effective)


#: Named aggregators, each over rows (option, w).
AGGREGATORS = {
    "approve_share": lambda: share(["approve"]), "net_approve_share": lambda: net_share(["approve"], ["disapprove"]), "party_margin": lambda: net_share(["party_a"], ["party_b"]),
    "strong_share": lambda: share(["strongly_approve"]), "weak_share": lambda: share(["somewhat_approve"]), "four_point_share": lambda: share(["strongly_approve", "somewhat_approve"]),
}
