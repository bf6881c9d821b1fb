"""Leaderboards. Which average comes first differs by board, so each says it in its name and shares no flagless helper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.functions.scores import skill


def with_null(scores: DataFrame, by: list[str], null: str, loss: str) -> DataFrame:
    """scores with null_loss, that of the null in the same group: a window, so no second scan."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # without `by` there is a row for each entrant
    return scores.withColumn("null_loss", F.max(F.when(F.col("entrant") == null, F.col(loss))).over(group))


def mean_of_skills(scores: DataFrame, key: str = "round_id", null: str = "persistence") -> DataFrame:
    """entrant, skill, rounds: the live board, the mean of per-round skill. scores: key, entrant, loss."""
    known = with_null(scores, [key], null, "loss").where("null_loss is not null")
    return known.groupBy("entrant").agg(F.avg(skill(F.col("loss"), F.col("null_loss"))).alias("skill"), F.avg("loss").alias("mean_loss"), F.count("*").alias("rounds"))


def skill_of_means(scores: DataFrame, by: list[str], null: str = "persistence") -> DataFrame:
    """by, entrant, skill, mean_loss, n: the backtest board, the skill of mean losses."""
    means = scores.groupBy(*by, "entrant").agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("n"))
    return with_null(means, by, null, "mean_loss").where("null_loss is not null").withColumn("skill", skill(F.col("mean_loss"), F.col("null_loss"))).drop("null_loss")


def answered_all(scores: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that every entrant has answered."""
    roster = scores.agg(F.countDistinct("entrant").alias("_roster"))  # one row
    here = F.size(F.collect_set("entrant").over(W.partitionBy(key)))  # at most the roster
    return scores.withColumn("_n", here).join(F.broadcast(roster), F.col("_n") == F.col("_roster")).drop("_n", "_roster")


def full_coverage(scores: DataFrame, key: str) -> DataFrame:
    """Rows of the entrants who have answered every key."""
    asked = scores.agg(F.countDistinct(key).alias("_asked"))
    full = scores.groupBy("entrant").agg(F.countDistinct(key).alias("_n")).join(F.broadcast(asked), F.col("_n") == F.col("_asked")).select("entrant")
    return scores.join(full, "entrant", "left_semi")


def spans(scores: DataFrame, by: list[str]) -> DataFrame:
    """Boards over all dates, the last 183 and 30 days and the last date, anchored at the newest date."""
    last = scores.agg(F.max("date").alias("_last"))
    age = F.datediff("_last", "date")
    span = F.explode(F.array_compact(F.array(F.lit("all"), F.when(age <= 183, "6m"), F.when(age <= 30, "30d"), F.when(age == 0, "last"))))
    return skill_of_means(scores.crossJoin(F.broadcast(last)).withColumn("span", span).drop("_last"), ["span", *by])


def main_board(scores: DataFrame, total_since: str) -> DataFrame:
    """entrant, skill, mean_crps, answered: skill over all shapes of rounds that lock from a start on; mean_crps over number rounds only.

    scores: round_id, entrant, lock_at, shape, loss, null_loss.
    """
    live = scores.where(F.col("lock_at") >= F.lit(total_since).cast("timestamp"))
    total = live.agg(F.countDistinct("round_id").alias("_total"))
    board = live.groupBy("entrant").agg(F.avg(skill(F.col("loss"), F.col("null_loss"))).alias("skill"), F.avg(F.when(F.col("shape") == "number", F.col("loss"))).alias("mean_crps"), F.countDistinct("round_id").alias("_n"))
    return board.crossJoin(F.broadcast(total)).withColumn("answered", F.col("_n") / F.col("_total")).drop("_n", "_total")


def pairwise_points(scores: DataFrame, key: str = "round_id") -> DataFrame:
    """scores with place, tied and points: the share of rivals beaten, half of a tie; rounds of fewer than two methods are out."""
    by_loss, every = W.partitionBy(key).orderBy("loss"), W.partitionBy(key)
    placed = scores.withColumns({"n": F.count("*").over(every), "place": F.rank().over(by_loss), "tied": F.count("*").over(W.partitionBy(key, "loss"))}).where("n > 1")
    top = F.greatest(F.lit(0), F.least(F.col("tied"), 3 - F.col("place") + 1)) / F.col("tied")
    return placed.withColumn("points", 100 * (F.col("n") - F.col("place") - F.col("tied") + 1 + 0.5 * (F.col("tied") - 1)) / (F.col("n") - 1)).withColumn("top3", top)


def pairwise_board(scores: DataFrame, key: str = "round_id", tolerance: int = 9) -> DataFrame:
    """entrant, pairwise, top3, place: means over all rounds; a missing answer counts as zero points."""
    points = pairwise_points(scores, key)
    rounds = points.agg(F.countDistinct(key).alias("_rounds"))
    board = points.groupBy("entrant").agg(F.sum("points").alias("_p"), F.sum("top3").alias("_t"), F.count("*").alias("answered")).crossJoin(F.broadcast(rounds))
    board = board.select("entrant", (F.col("_p") / F.col("_rounds")).alias("pairwise"), (F.col("_t") / F.col("_rounds")).alias("top3"), "answered")
    return board.withColumn("place", F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.round("pairwise", tolerance)))))


def pairwise_trajectory(scores: DataFrame) -> DataFrame:
    """entrant, date, pairwise: cumulative means, the last of each day. scores: round_id, entrant, date, loss."""
    points = pairwise_points(scores)
    rounds = points.select("round_id", "date").distinct().groupBy("date").agg(F.count("*").alias("new"))
    rounds = rounds.withColumn("so_far", F.sum("new").over(W.partitionBy(F.lit(0)).orderBy("date")))  # one row a day
    daily = points.groupBy("entrant", "date").agg(F.sum("points").alias("p"))
    grid = points.select("entrant").distinct().join(rounds.select("date", "so_far"), how="cross")  # the result's own size: entrants by days
    filled = grid.join(daily, ["entrant", "date"], "left").withColumn("total", F.sum(F.coalesce("p", F.lit(0.0))).over(W.partitionBy("entrant").orderBy("date")))
    return filled.select("entrant", "date", (F.col("total") / F.col("so_far")).alias("pairwise"))


def rank_trajectory(scores: DataFrame, checkpoints: int = 30) -> DataFrame:
    """checkpoint, date, entrant, skill, place: cumulative boards at evenly spaced dates. Places in the list of dates round half to even."""
    days = scores.select("date").distinct().withColumn("i", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1)
    n = days.agg(F.max("i").alias("last"))
    steps = n.select(F.explode(F.sequence(F.lit(0), F.lit(checkpoints - 1))).alias("c"), "last").withColumn("i", F.bround(F.col("c") * F.col("last") / (checkpoints - 1)).cast("int"))
    chosen = days.join(F.broadcast(steps.groupBy("i").agg(F.min("c").alias("checkpoint"))), "i").select("date", "checkpoint")
    daily = scores.groupBy("entrant", "date").agg(F.sum("loss").alias("s"), F.count("*").alias("k"))
    upto = W.partitionBy("entrant").orderBy("date")
    running = daily.withColumns({"s": F.sum("s").over(upto), "k": F.sum("k").over(upto)}).join(F.broadcast(chosen), "date")
    base = running.where(F.col("entrant") == "persistence").select("date", (F.col("s") / F.col("k")).alias("null_loss"))
    board = running.join(base, "date").withColumn("skill", skill(F.col("s") / F.col("k"), F.col("null_loss")))
    return board.withColumn("place", F.rank().over(W.partitionBy("checkpoint").orderBy(F.desc(F.round("skill", 9))))).select("checkpoint", "date", "entrant", "skill", "place")


def average_ranks(df: DataFrame, by: list[str], value: str) -> Column:
    """The rank of a value within `by`, ties sharing the mean of theirs."""
    return (2 * F.rank().over(W.partitionBy(*by).orderBy(value)) + F.count("*").over(W.partitionBy(*by, value)) - 1) / 2


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, rho, n: correlation of average ranks; null with fewer than three pairs or no spread."""
    ranked = df.withColumns({"_rx": average_ranks(df, by, x), "_ry": average_ranks(df, by, y)})
    return ranked.groupBy(*by).agg(F.covar_pop("_rx", "_ry").alias("_c"), (F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("_s"), F.count("*").alias("n")).select(*by, F.when((F.col("n") >= 3) & (F.col("_s") > 0), F.try_divide("_c", "_s")).alias("rho"), "n")


def head_to_head(scores: DataFrame, key: str = "round_id") -> DataFrame:
    """a, b, wins, ties, n: rounds in which a has the smaller loss. The pairs are the entrants of a round, a bounded roster."""
    left, right = scores.select(key, F.col("entrant").alias("a"), F.col("loss").alias("la")), scores.select(key, F.col("entrant").alias("b"), F.col("loss").alias("lb"))
    return left.join(right, key).where("a <> b").groupBy("a", "b").agg(F.count_if(F.col("la") < F.col("lb")).alias("wins"), F.count_if(F.col("la") == F.col("lb")).alias("ties"), F.count("*").alias("n"))


def beats_all(scores: DataFrame, challenger: str, key: str = "round_id") -> DataFrame:
    """key, beats: whether the challenger has the smallest loss of all."""
    return scores.groupBy(key).agg(F.min(F.when(F.col("entrant") == challenger, F.col("loss"))).alias("own"), F.min(F.when(F.col("entrant") != challenger, F.col("loss"))).alias("rest")).where("own is not null and rest is not null").select(key, (F.col("own") < F.col("rest")).alias("beats"))


def weekly_means(points: DataFrame) -> DataFrame:
    """week, entrant, mean_points: missing answers count as zero."""
    dated = points.withColumn("week", F.date_trunc("week", "date").cast("date"))
    weeks = dated.groupBy("week").agg(F.countDistinct("round_id").alias("rounds"))
    grid = dated.select("entrant").distinct().join(weeks, how="cross")  # the result's own size
    return grid.join(dated.groupBy("week", "entrant").agg(F.sum("points").alias("p")), ["week", "entrant"], "left").select("week", "entrant", (F.coalesce("p", F.lit(0.0)) / F.col("rounds")).alias("mean_points"))


def leaders(trajectory: DataFrame, k: int = 3) -> DataFrame:
    """entrant, days_top, days_first: how often an entrant was among the k best of a day."""
    placed = trajectory.withColumn("place", F.row_number().over(W.partitionBy("date").orderBy(F.desc(F.round("pairwise", 9)), "entrant")))
    return placed.where(F.col("place") <= k).groupBy("entrant").agg(F.count("*").alias("days_top"), F.count_if(F.col("place") == 1).alias("days_first"))


def same_family_pairs(models: DataFrame) -> DataFrame:
    """newer, older: models of one vendor with different cutoffs. models: entrant, vendor, cutoff."""
    a, b = models.alias("a"), models.alias("b")
    return a.join(b, (F.col("a.vendor") == F.col("b.vendor")) & (F.col("a.cutoff") > F.col("b.cutoff"))).select(F.col("a.entrant").alias("newer"), F.col("b.entrant").alias("older"))


def roster(generated: DataFrame, registered: DataFrame) -> DataFrame:
    """entrant, base: the longest registered id that an entrant's id is or begins with before a dash."""
    prefixes = generated.withColumn("_parts", F.split("entrant", "-")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_parts"))))
    prefixes = prefixes.withColumn("base", F.array_join(F.slice("_parts", F.lit(1), F.col("_k")), "-"))
    return prefixes.join(registered.select(F.col("entrant").alias("base")), "base").groupBy("entrant").agg(F.max_by("base", "_k").alias("base"))


def shape_board(scores: DataFrame, measures: list[str], null: str = "persistence") -> DataFrame:
    """entrant, skill, the mean of each measure, rounds: for profiles and lists, whose loss is the first measure. scores: round_id, entrant, measures."""
    known = with_null(scores, ["round_id"], null, measures[0]).where("null_loss is not null")
    return known.groupBy("entrant").agg(F.avg(skill(F.col(measures[0]), F.col("null_loss"))).alias("skill"), *[F.avg(m).alias(m) for m in measures], F.count("*").alias("rounds"))


def attach_scores(rounds: DataFrame, scores: DataFrame, outcomes: DataFrame) -> DataFrame:
    """rounds with outcome, resolved and scores (a map of entrant to loss); rounds without either stay as they are."""
    kept = scores.groupBy("round_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entrant", "loss")))).alias("scores"))
    return rounds.join(outcomes.select("round_id", "outcome"), "round_id", "left").join(kept, "round_id", "left").withColumn("resolved", F.col("outcome").isNotNull())


def trackers(obs: DataFrame, days: int = 30) -> DataFrame:
    """series, date, value, change: the newest value and how it moved since the last one at least `days` days older."""
    newest = obs.groupBy("series").agg(F.max_by(F.struct("date", "value"), "date").alias("n"))
    older = obs.join(newest, "series").where(F.datediff("n.date", "date") >= days).groupBy("series").agg(F.max_by("value", "date").alias("before"))
    return newest.join(older, "series", "left").select("series", "n.date", "n.value", (F.col("n.value") - F.col("before")).alias("change"))


def revisions(prints: DataFrame) -> DataFrame:
    """series, periods, revised, mean_change: how many first prints the next capture changed. prints: series, period, capture, value."""
    w = W.partitionBy("series", "period").orderBy("capture")
    both = prints.withColumns({"k": F.row_number().over(w), "following": F.lead("value").over(w)}).where("k = 1")
    firsts = both.withColumn("step", F.col("value") - F.lag("value").over(W.partitionBy("series").orderBy("period")))
    return firsts.groupBy("series").agg(F.count("*").alias("periods"), F.count_if(F.col("following") != F.col("value")).alias("revised"), F.avg(F.abs("step")).alias("mean_change"))


def as_teams(scores: DataFrame, members: DataFrame, key: str = "round_id") -> DataFrame:
    """scores with teams in place of their members: of a round the first member, in declared order, who has a score. members: team, entrant, place. Others stand for themselves."""
    own = scores.join(F.broadcast(members), "entrant", "left")  # a roster of bounded size
    others = [c for c in scores.columns if c not in ("entrant", key)]
    chosen = own.where("team is not null").groupBy(key, "team").agg(F.min_by(F.struct(*others), F.struct("place", "entrant")).alias("_r")).select(key, F.col("team").alias("entrant"), "_r.*")
    return own.where("team is null").select(*scores.columns).unionByName(chosen.select(*scores.columns))


def pairwise_windows(scores: DataFrame, since: str, season: list[str]) -> DataFrame:
    """window, entrant, pairwise, top3, answered, place over three scopes: all rounds and methods; s0, the season's methods in rounds that lock from its start on; matched, the rounds that every method answered.

    scores: round_id, entrant, loss, lock_at.
    """
    live = scores.where((F.col("lock_at") >= F.lit(since).cast("timestamp")) & F.col("entrant").isin(season))
    scopes = {"all": scores, "s0": live, "matched": answered_all(scores, "round_id")}
    found = [pairwise_board(s).withColumn("window", F.lit(name)) for name, s in scopes.items()]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("window", "entrant", "pairwise", "top3", "answered", "place")


def matched_shape_board(scores: DataFrame, measures: list[str], null: str = "persistence") -> DataFrame:
    """As shape_board, of the entrants who answered every scored round only: the table to cite."""
    known = with_null(scores, ["round_id"], null, measures[0]).where("null_loss is not null").drop("null_loss")
    return shape_board(full_coverage(known, "round_id"), measures, null)


def board_rows(board: DataFrame, score: str, places: int = 4) -> DataFrame:
    """The board in published order: place, entrant, and its numbers rounded; ties by name."""
    numbers = [c for c, kind in board.dtypes if kind == "double"]
    order = W.partitionBy(F.lit(0)).orderBy(F.desc(score), "entrant")  # a row for each entrant
    return board.withColumn("place", F.row_number().over(order)).select("place", "entrant", *[F.round(c, places).alias(c) for c in numbers], *[c for c in board.columns if c not in ("place", "entrant", *numbers)])


def series_of_days(trajectory: DataFrame, places: int = 2) -> DataFrame:
    """entrant, dates, values: each entrant's cumulative means as two arrays in order of days, for a chart. trajectory: entrant, date, pairwise."""
    points = F.array_sort(F.collect_list(F.struct("date", F.round("pairwise", places).alias("value"))))
    return trajectory.groupBy("entrant").agg(points.alias("_p")).select("entrant", F.col("_p.date").alias("dates"), F.col("_p.value").alias("values"))


def pooled_baselines(scores: DataFrame, baselines: list[str], by: list[str]) -> DataFrame:
    """Rows of the baselines on the points (by) that any other entrant answered, and of all others: one release set for a backtest's board. scores: by, entrant, any others."""
    null = F.col("entrant").isin(*baselines)
    asked = scores.where(~null).select(*by).distinct()
    return scores.where(~null).unionByName(scores.where(null).join(asked, by, "left_semi"))


def matched_trajectory(scores: DataFrame, by: list[str], baselines: list[str], null: str = "persistence", checkpoints: int = 30) -> DataFrame:
    """n, date, entrant, loss, skill, place: cumulative means over the first n points that every entrant answered, at evenly spaced n.

    scores: by (a point), date, entrant, loss. Points come by date, then by key; all curves are over the same points. skill is
    against the null's mean over the same points, places go by skill, then name. Points are releases: one window orders them.
    """
    roster = scores.where(~F.col("entrant").isin(*baselines)).agg(F.countDistinct("entrant").alias("_all"))  # one row
    answered = scores.where(~F.col("entrant").isin(*baselines)).groupBy(*by, "date").agg(F.countDistinct("entrant").alias("_n")).crossJoin(F.broadcast(roster)).where("_n = _all")
    nulled = answered.join(scores.where(F.col("entrant") == null).select(*by), by, "left_semi")
    every = W.partitionBy(F.lit(0))
    points = nulled.select(*by, F.row_number().over(every.orderBy("date", *by)).alias("n"), F.count("*").over(every).alias("_points"))
    step = F.greatest(F.col("_points") / checkpoints, F.lit(1.0))
    c = F.sequence(F.lit(1), F.least(F.lit(checkpoints), F.col("_points").cast("int")))
    at = F.array_contains(F.transform(c, lambda i: F.greatest(F.bround(i * step, 0).cast("int"), F.lit(1))), F.col("n"))
    run = W.partitionBy("entrant").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    sums = scores.join(points.where("_points >= 2").withColumn("_at", at), by).withColumn("loss", F.avg("loss").over(run)).where("_at")
    nulls = sums.where(F.col("entrant") == null).select("n", F.col("loss").alias("_null"))
    skilled = sums.join(nulls, "n").withColumn("skill", skill(F.col("loss"), F.col("_null")))
    return skilled.select("n", "date", "entrant", "loss", "skill", F.row_number().over(W.partitionBy("n").orderBy(F.desc("skill"), "entrant")).alias("place"))
