"""The season's manifest: what makes a round publishable, and which rounds a reader may see. Every check is a row, so all problems of all rounds come in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.functions.calendar import batch_of, deadline_for, effective_deadline, governed_by_batch

#: Shapes of rounds, fields that each must have, stamps, words of rules that move, and words that pin one down.
SHAPES = ("continuous_normal", "profile_energy", "ranking_list")
REQUIRED = ("round_id", "tracker", "series", "question", "unit", "release_at", "release_estimated", "lock_at", "resolve", "target_type")
TEXTS = ("round_id", "tracker", "series", "question", "unit", "resolve")
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
MOVING = r"(?i)\b(latest|most recent|current value|whatever is available|fallback)\b"
ANCHOR = r"(?i)(archive|snapshot|published|publication|release date|release post|report|pdf|workbook|dashboard|screenshot|official|certified|results page|endpoint|api|sca\.isr|conference-board)"
HOURS, FRIDAY = 48, 4
BEHAVIOUR = ("wikipedia", "trends", "trends_basket")


def stamp(c: str) -> Column:
    """A UTC stamp to the second as a timestamp; null for any other text."""
    return F.when(F.col(c).rlike(STAMP), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd'T'HH:mm:ssX")))


def schedule_problem() -> Column:
    """What is wrong with a round's times; null if nothing is. Columns: release_at, lock_at (stamps as text), round_id, target_type, tracker, source, week_start, week_end."""
    release, lock = stamp("release_at"), stamp("lock_at")
    ranking = F.col("target_type") == "ranking_list"
    named = F.nullif(F.regexp_extract("round_id", r"20[0-9]{2}-[0-9]{2}-[0-9]{2}", 0), F.lit("")).try_cast("date")
    end = F.when(ranking, F.col("week_end")).otherwise(named)
    start = F.when(ranking, F.col("week_start")).otherwise(F.date_sub(named, 6))
    behaviour = ranking | F.col("source").isin(*BEHAVIOUR)
    weekday = F.when(F.col("source") == "wikipedia", 6).otherwise(5)
    return (
        F.when(release.isNull() | lock.isNull(), "stamp").when(lock >= release, "lock not before release")
        .when(behaviour & end.isNull(), "no week").when(behaviour & ~ranking & (F.weekday(end) != weekday), "week ends on another day")
        .when(behaviour & (lock.cast("date") >= start), "locks within the measured week").when(behaviour & (release.cast("date") < end), "releases before the week ends").when(behaviour, F.lit(None).cast("string"))
        .when((F.col("source") == "civiqs") & (F.weekday(release) != FRIDAY), "not a Friday").when(F.col("tracker") == "midterm_special", F.lit(None).cast("string"))
        .when(F.unix_timestamp(release) - F.unix_timestamp(lock) != HOURS * 3600, "not 48 hours")
    )


def shape_problem() -> Column:
    """Columns: target_type, has_cells, has_ranking."""
    shape = F.col("target_type")
    return (
        F.when(~shape.isin(*SHAPES), "unknown shape").when((shape == "continuous_normal") & (F.col("has_cells") | F.col("has_ranking")), "a number with cells or a list")
        .when((shape == "profile_energy") & ~F.col("has_cells"), "a profile without cells").when((shape == "profile_energy") & F.col("has_ranking"), "a profile with a list")
        .when((shape == "ranking_list") & ~F.col("has_ranking"), "a list round without its list").when((shape == "ranking_list") & F.col("has_cells"), "a list round with cells")
    )


def round_problems(rounds: DataFrame, rights: DataFrame, open_rights: tuple[str, ...] = ("approved", "approved-no-redistribution")) -> DataFrame:
    """round_id, kind, problem: all that keeps rounds from being published.

    rounds: REQUIRED, place (its order in the manifest), source (null where no audited source is known), has_cells,
    has_ranking, identity (what is observed), week_start, week_end. rights: source, state.
    A round that misses a field or has an unknown shape or source is not judged further, as it can't be.
    """
    target_day = F.when(F.col("target_type") != "ranking_list", F.substring("release_at", 1, 10))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in REQUIRED]))
    blank = lambda c: F.trim(F.col(c)) == ""
    whole = F.size(missing) == 0
    shaped = whole & F.col("target_type").isin(*SHAPES)
    known = shaped & F.col("source").isNotNull()
    held = rounds.join(rights.select("source", "state"), "source", "left").withColumns({
        "_again": F.row_number().over(W.partitionBy("round_id").orderBy("place")) > 1,
        "_target": F.row_number().over(W.partitionBy("target_type", "identity", target_day, known).orderBy("place")) > 1,
    })
    rule = F.trim("resolve")
    checks = [
        ("missing", F.when(~whole, F.array_join(missing, ", "))), ("text", F.when(whole & reduce(lambda a, c: a | blank(c), TEXTS, F.lit(False)), "a text is empty")), ("repeated", F.when(whole & F.col("_again"), "round_id")),
        ("shape", F.when(whole, shape_problem())), ("source", F.when(shaped & F.col("source").isNull(), "neither registered nor audited")),
        ("rights", F.when(known & ~F.coalesce(F.col("state"), F.lit("unresolved")).isin(*open_rights), F.coalesce(F.col("state"), F.lit("unresolved")))), ("schedule", F.when(known, schedule_problem())),
        ("rule", F.when(known & rule.rlike(MOVING), "moves").when(known & ~rule.rlike(ANCHOR), "names no artifact")), ("target", F.when(known & F.col("_target"), "already published")),
    ]
    rows = F.array_compact(F.array(*[F.when(p.isNotNull(), F.struct(F.lit(k).alias("kind"), p.alias("problem"))) for k, p in checks]))
    return held.select(F.coalesce("round_id", F.concat(F.lit("rounds["), "place", F.lit("]"))).alias("round_id"), F.explode(rows).alias("p")).select("round_id", "p.*")


#: Points and movement that a series needs; waves whose calendar is checked, slips among them, the longest gap in days.
MIN_HISTORY, MIN_MOVEMENT, CHECKED_WAVES, MAX_SLIPS, MAX_GAP_DAYS = 12, 0.0, 8, 1, 8


def publishing_gate(series: DataFrame, open_rights: tuple[str, ...] = ("approved", "approved-no-redistribution"), min_history: int = MIN_HISTORY) -> DataFrame:
    """series, verdict: the first check that closes the gate, in the published order; ok if none does.

    series: series, state (rights), retired, parked, declined (booleans), supported (has a template), schedule (its
    problem, null if it has none), points, movement (real movement of the series that the round resolves by).
    """
    verdict = (
        F.when(~F.coalesce(F.col("state"), F.lit("unresolved")).isin(*open_rights), "rights").when(F.col("retired"), "retired_template").when(F.col("parked"), "parked_cadence").when(F.col("declined"), "declined_family")
        .when(~F.col("supported"), "unsupported_family").when(F.col("schedule").isNotNull(), "schedule").when(F.col("points") < min_history, "history").when(F.coalesce(F.col("movement"), F.lit(0.0)) <= MIN_MOVEMENT, "volatility")
    )
    return series.select("series", F.coalesce(verdict, F.lit("ok")).alias("verdict"))


def calendar_slips(entries: DataFrame) -> DataFrame:
    """series, problem: whether the newest waves entered as the calendar says. entries: series, day (a wave's entry), weekday (the declared one).

    Fewer than CHECKED_WAVES waves are no evidence; else entries off the weekday and gaps that are too long are slips, of which MAX_SLIPS are allowed.
    """
    w = W.partitionBy("series").orderBy(F.desc("day"))
    recent = entries.withColumns({"_n": F.row_number().over(w), "_gap": F.datediff("day", F.lead("day").over(w))}).where(F.col("_n") <= CHECKED_WAVES)
    off, gap = F.weekday("day") != F.col("weekday"), (F.col("_n") < CHECKED_WAVES) & ~F.coalesce(F.col("_gap").between(1, MAX_GAP_DAYS), F.lit(True))
    found = recent.groupBy("series").agg(F.count("*").alias("_waves"), (F.count_if(off) + F.count_if(gap)).alias("_slips"))
    return found.select("series", F.when(F.col("_waves") < CHECKED_WAVES, "too few waves").when(F.col("_slips") > MAX_SLIPS, "slips").alias("problem"))


#: Readings whose weekday is checked, and the hour at which a sampled tracker is read.
CHECKED_READINGS, SAMPLED_HOUR = 26, 14


def schedule_contract(series: DataFrame, entries: DataFrame, history: DataFrame) -> DataFrame:
    """series, weekday, hour, problem: when a series' next releases come, or why it can't be said.

    series: series, source (`field_dates`: dated by field midpoints, `sampled`: read on a weekday, or another), weekday (the
    sampled one), entry, release, hour (of the recorded calendar, or null). entries: series, day (on which a wave entered).
    history: series, date. Dates of field work say nothing of releases, so those series follow their calendar alone, while
    the newest waves confirm it; it must release on the day of entry or the day after, or the lock could not come before the
    entry: another calendar fails the job. A sampled series must have had its weekday in its last CHECKED_READINGS.
    """
    field, sampled = F.col("source") == "field_dates", F.col("source") == "sampled"
    late = F.pmod(F.col("release") - F.col("entry"), F.lit(7)) > 1
    entry = F.when(field & late, F.raise_error(F.concat(F.lit("the lock must come before the entry of "), "series")).cast("int")).otherwise(F.col("entry"))
    w = W.partitionBy("series").orderBy(F.desc("day"))
    recent = entries.withColumns({"_n": F.row_number().over(w), "_gap": F.datediff("day", F.lead("day").over(w))}).where(F.col("_n") <= CHECKED_WAVES).join(series.select("series", entry.alias("_entry")), "series")
    waves = recent.groupBy("series").agg(F.count("*").alias("_waves"), (F.count_if(F.weekday("day") != F.col("_entry")) + F.count_if((F.col("_n") < CHECKED_WAVES) & ~F.coalesce(F.col("_gap").between(1, MAX_GAP_DAYS), F.lit(True)))).alias("_slips"))
    readings = history.join(series.where(sampled).select("series", F.col("weekday").alias("_weekday")), "series").withColumn("_n", F.row_number().over(W.partitionBy("series").orderBy(F.desc("date")))).where(F.col("_n") <= CHECKED_READINGS)
    off = readings.groupBy("series").agg(F.min(F.when(F.weekday("date") != F.col("_weekday"), F.col("date"))).alias("_off"))
    joined = series.join(waves, "series", "left").join(off, "series", "left")
    problem = (
        F.when(field & entry.isNull(), "no calendar is recorded").when(field & (F.coalesce("_waves", F.lit(0)) < CHECKED_WAVES), "too few waves").when(field & (F.col("_slips") > MAX_SLIPS), "slips").when(~field & ~sampled, "no calendar is known")
        .when(sampled & ~F.coalesce(F.col("weekday").between(0, 6), F.lit(False)), "no sampled weekday").when(sampled & F.col("_off").isNotNull(), F.concat(F.lit("read off its weekday on "), "_off"))
    )
    fine = problem.isNull()
    return joined.select("series", F.when(fine, F.when(field, F.col("release")).otherwise(F.col("weekday"))).cast("int").alias("weekday"), F.when(fine, F.when(field, F.col("hour")).otherwise(F.lit(SAMPLED_HOUR))).cast("int").alias("hour"), problem.alias("problem"))


def publishable(rounds: DataFrame, now: str) -> DataFrame:
    """Rounds that can still reach entrants. rounds: lock_at, any others."""
    return rounds.where(effective_deadline(F.col("lock_at")) > F.lit(now).cast("timestamp"))


def open_rounds(rounds: DataFrame, now: str) -> DataFrame:
    """Open rounds as served, with deadline and batch, in order of deadline, lock and id. The published status may be stale, so the deadline decides again. rounds: round_id, status, lock_at."""
    lock = F.col("lock_at")
    served = rounds.where((F.col("status") == "open") & (effective_deadline(lock) > F.lit(now).cast("timestamp"))).withColumns({"deadline": effective_deadline(lock), "batch": F.when(governed_by_batch(lock), batch_of(lock)), "monday": deadline_for(lock)})
    return served.orderBy("deadline", "lock_at", "round_id")


def as_asked(live: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """The season as entrants were asked it: live rounds, and those withdrawn after their lock under an id that isn't live. withdrawn: as live, with withdrawn_at and withdrawn_reason."""
    asked = withdrawn.where("coalesce(withdrawn_at, '') > lock_at").join(live.select("round_id"), "round_id", "left_anti")
    return live.unionByName(asked.select(*live.columns))


def merge_snapshots(frozen: DataFrame, updates: DataFrame) -> DataFrame:
    """round_id, field, value: fields of a round's snapshot, each replaced by its update; what no update names stays. Both: round_id, field, value."""
    kept = frozen.select("round_id", "field", "value").join(updates.select("round_id", "field").distinct(), ["round_id", "field"], "left_anti")
    return kept.unionByName(updates.select("round_id", "field", "value"))


def task_plan(history: DataFrame, entrants: DataFrame, warmup: int = 8) -> DataFrame:
    """series, date, outcome, n_before, entrant: every call of a backtest. history: series, date, value. entrants: entrant, start (its first day to be scored; refused if null).

    An entrant has a task for each release from its start on that has `warmup` points before it. The entrants are a roster of bounded size.
    """
    n = F.row_number().over(W.partitionBy("series").orderBy("date")) - 1
    releases = history.withColumn("n_before", n).where(F.col("n_before") >= warmup).select("series", "date", F.col("value").alias("outcome"), "n_before")
    start = F.coalesce(F.col("start"), F.raise_error(F.lit("an entrant without a start")).cast("date"))
    return releases.join(F.broadcast(entrants.select("entrant", start.alias("start"))), F.col("date") >= F.col("start")).drop("start")


#: Tokens of a call that is still to be made, and the price (of a million, in and out) of an unlisted model.
IN_TOKENS, OUT_TOKENS, REASONING_TOKENS, PRICE_IN, PRICE_OUT = 400, 150, 500, 2.0, 10.0


def estimated_costs(tasks: DataFrame, models: DataFrame) -> DataFrame:
    """entrant, calls, usd of the calls that aren't cached. tasks: entrant, model, cached. models: model, per_in, per_out, reasoning."""
    out = F.when(F.coalesce(F.col("reasoning"), F.lit(False)), REASONING_TOKENS).otherwise(OUT_TOKENS)
    usd = IN_TOKENS / 1e6 * F.coalesce(F.col("per_in"), F.lit(PRICE_IN)) + out / 1e6 * F.coalesce(F.col("per_out"), F.lit(PRICE_OUT))
    return tasks.where("not cached").join(models, "model", "left").groupBy("entrant").agg(F.count("*").alias("calls"), F.sum(usd).alias("usd"))


#: The smallest spread of a panel's forecast.
MIN_PANEL_SD = 0.5


def panel_sd(se: Column, step_sd: Column, scale: float = 1.0) -> Column:
    """The spread that a panel reports: its sampling error and the series' own steps in quadrature; twice the error where there are no steps."""
    own = se * scale
    return F.greatest(F.round(F.when(step_sd.isNull(), own * 2.0).otherwise(F.sqrt(own * own + step_sd * step_sd)), 3), F.lit(MIN_PANEL_SD))


#: The fields of a round that the public may see.
PUBLIC = ("round_id", "tracker", "series", "question", "unit", "release_at", "release_estimated", "lock_at", "resolve", "target_type", "status")


def public_rows(rounds: DataFrame) -> DataFrame:
    """rounds without anything but their public fields, as far as they have them."""
    return rounds.select(*[c for c in PUBLIC if c in rounds.columns])


#: How far ahead rounds are listed, in weeks.
MAX_WEEKS_AHEAD = 8


def _listed(dated: DataFrame, by: str, taken: DataFrame, now: str, weeks: int) -> DataFrame:
    """The first `weeks` rounds of each `by` that can still be answered, of a listed week, and not taken yet. dated: by, round_id, lock_at, release_at."""
    at = F.lit(now).cast("timestamp")
    ahead = F.floor((F.unix_timestamp("release_at") - F.unix_timestamp(at)) / 86_400)
    free = dated.where((effective_deadline(F.col("lock_at")) > at) & (ahead <= MAX_WEEKS_AHEAD * 7)).join(taken.select("round_id"), "round_id", "left_anti")
    return free.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy("release_at", "round_id"))).where(F.col("_n") <= weeks).drop("_n")


def scalar_candidates(series: DataFrame, taken: DataFrame, now: str, weeks: int) -> DataFrame:
    """series, round_id, lock_at, release_at of the next releases: the first declared weekday a week or more after the newest point, then weekly, each locked 48 hours before.

    series: series, prefix and suffix (of its round ids), last (its newest date), weekday (0 is Monday), hour. taken: round_id.
    """
    soonest = F.date_add("last", 7)
    first = F.date_add(soonest, F.pmod(F.col("weekday") - F.weekday(soonest), F.lit(7)).cast("int"))
    span = F.greatest(F.lit(0), F.ceil((F.datediff(F.lit(now).cast("date"), first) + 7 * (MAX_WEEKS_AHEAD + 1)) / 7)).cast("int")
    weekly = series.withColumn("_first", first).withColumn("_week", F.explode(F.sequence(F.lit(0), span)))
    release = F.date_add("_first", F.col("_week") * 7).cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("hour"))
    dated = weekly.withColumns({"release_at": release, "lock_at": release - F.make_dt_interval(F.lit(0), F.lit(HOURS))}).where((F.col("release_at") > F.lit(now).cast("timestamp")) & governed_by_batch(F.col("lock_at")))
    named = dated.withColumn("round_id", F.concat_ws("-", "prefix", iso_week_id(F.col("release_at")), "suffix"))
    return _listed(named, "series", taken, now, weeks).select("series", "round_id", "lock_at", "release_at")


def iso_week_id(at: Column) -> Column:
    """2026-w38 of a time, by the ISO year and week."""
    return F.format_string("%d-w%02d", F.extract(F.lit("YEAROFWEEK"), at), F.weekofyear(at))


def weekly_candidates(templates: DataFrame, taken: DataFrame, now: str, weeks: int) -> DataFrame:
    """family, round_id, lock_at, release_at, week_start, week_end of the rounds that follow each family's newest one: all of its times a week on, again and again.

    templates: family, prefix, suffix, named_by (iso_week or week_end), lock_at, release_at, week_start, week_end (null for
    families without a measured week): the newest reviewed round. Lists, baskets and both kinds of profiles are such families.
    """
    span = F.greatest(F.lit(1), F.ceil((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("release_at")) / 604_800) + MAX_WEEKS_AHEAD + 1).cast("int")
    later = templates.withColumn("_k", F.explode(F.sequence(F.lit(1), span)))
    shift, step = lambda c: F.col(c) + F.make_dt_interval(F.col("_k") * 7), lambda c: F.date_add(F.col(c), F.col("_k") * 7)
    moved = later.withColumns({"lock_at": shift("lock_at"), "release_at": shift("release_at"), "week_start": step("week_start"), "week_end": step("week_end")})
    name = F.when(F.col("named_by") == "week_end", F.col("week_end").cast("string")).otherwise(iso_week_id(F.col("release_at")))
    named = moved.withColumn("round_id", F.concat_ws("-", "prefix", name, F.nullif("suffix", F.lit(""))))
    return _listed(named, "family", taken, now, weeks).select("family", "round_id", "lock_at", "release_at", "week_start", "week_end")


def monthly_candidates(horizons: DataFrame, releases: DataFrame, taken: DataFrame, last: str, now: str, weeks: int, hour: int = 15) -> DataFrame:
    """series, round_id, lock_at, release_at of the survey months after `last` (yyyy-MM), up to the first month that the release calendar lacks.

    horizons: series, prefix, suffix. releases: month (yyyy-MM), day. A release dated within or before its month fails the job.
    """
    index = lambda c: F.substring(c, 1, 4).cast("int") * 12 + F.substring(c, 6, 2).cast("int")
    follows = F.when(F.date_format("day", "yyyy-MM") > F.col("month"), F.col("day")).otherwise(F.raise_error(F.lit("a release that doesn't follow its month")).cast("date"))
    ahead = releases.where(F.col("month") > F.lit(last)).select("month", follows.alias("day")).withColumn("_gap", index(F.col("month")) - index(F.lit(last)) - F.row_number().over(W.partitionBy(F.lit(0)).orderBy("month")))  # a row a month
    at = F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(hour))
    dated = ahead.where("_gap = 0").join(F.broadcast(horizons)).withColumns({"release_at": at, "lock_at": at - F.make_dt_interval(F.lit(0), F.lit(HOURS)), "round_id": F.concat_ws("-", "prefix", "month", "suffix")})
    return _listed(dated, "series", taken, now, weeks).select("series", "round_id", "lock_at", "release_at")


#: Days after a page's own on which it is archived, and the hour.
ARCHIVE_DAYS, ARCHIVE_HOUR = 16, 14


def archive_times(pages: DataFrame) -> DataFrame:
    """day, asof: the times at which a day's page is archived. pages: day."""
    return pages.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(ARCHIVE_DAYS)))).select("day", (F.date_add("day", F.col("_k")).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(ARCHIVE_HOUR))).alias("asof"))


def restored_runs(lines: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the records to restore, one row of counts). The last record of a call wins, by file, then line; what is cached already stays.

    lines: file, line, entrant, prompt_sha256, topline (null for a failure), any others. cached: entrant, prompt_sha256.
    A record without an entrant or with a digest that is none fails the job.
    """
    key = ["entrant", "prompt_sha256"]
    bad = F.col("entrant").isNull() | ~F.coalesce(F.col("prompt_sha256").rlike("^[0-9a-f]{64}$"), F.lit(False))
    checked = lines.withColumn("entrant", F.when(bad, F.raise_error(F.concat_ws(":", "file", F.col("line").cast("string"), F.lit("invalid record"))).cast("string")).otherwise(F.col("entrant")))
    last = checked.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("file"), F.desc("line")))).where("_n = 1").drop("_n")
    marked = last.join(cached.select(*key).distinct().withColumn("_cached", F.lit(True)), key, "left")
    new = F.col("_cached").isNull()
    kept = marked.agg(F.count("*").alias("unique"), F.count_if(new).alias("restored"), F.count_if(~new).alias("skipped_existing"), F.count_if(new & F.col("topline").isNotNull()).alias("successful"), F.count_if(new & F.col("topline").isNull()).alias("failures"))
    counts = lines.agg(F.countDistinct("file").alias("files"), F.count("*").alias("lines")).join(F.broadcast(kept)).withColumn("superseded", F.col("lines") - F.col("unique"))  # one row each
    return marked.where(new).drop("_cached"), counts


def freeze_once(frozen: DataFrame, values: DataFrame) -> DataFrame:
    """round_id, field, value: what was frozen stays as it is, only fields that a round hasn't are added. Both: round_id, field, value."""
    return frozen.select("round_id", "field", "value").unionByName(values.join(frozen.select("round_id", "field").distinct(), ["round_id", "field"], "left_anti").select("round_id", "field", "value"))
