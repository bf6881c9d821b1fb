"""Replies of models as answers: distributions, profiles, ranked lists, and the ids of who answered.

Nothing is ever filled in or cut: an answer is taken whole or refused with the name of what is wrong. A refusal is a
value (problem), so one bad reply never fails a job over millions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augur.functions.text import canonical_title, excluded, title_problem
from augur.sources.documents import embedded_json

#: Bounds that keep garbage out, not judgements of what is likely.
MOST_SD, MOST_MEAN = 1e6, 1e7

#: What an id says of the context a model saw and of how it was asked; contexts that each way of asking can carry.
CONTEXTS = {"recent10": "", "none": "-zeroshot", "news": "-news", "web": "-web"}
ELICITATIONS = {"direct": "", "superfc": "-superfc", "persona": "-persona"}
CARRIES = {"direct": ("none", "recent10", "news", "web"), "superfc": ("none", "recent10", "news", "web"), "persona": ("none",)}

RAW = "map<string,string>"


def first_problem(*checks: tuple[Column, str | Column]) -> Column:
    return reduce(lambda acc, c: acc.when(c[0], c[1]), checks[1:], F.when(*checks[0]))


def distribution(fields: Column) -> Column:
    """struct (problem, mean, sd) of a reply's object, given as a map of raw values. The numbers are stored as answered."""
    mean, sd = F.try_element_at(fields, F.lit("mean")).try_cast("double"), F.try_element_at(fields, F.lit("sd")).try_cast("double")
    problem = first_problem(
        (fields.isNull(), "no object"), (F.map_contains_key(fields, "quantiles"), "quantiles"), (~(F.map_contains_key(fields, "mean") & F.map_contains_key(fields, "sd")), "needs mean and sd"),
        (mean.isNull() | sd.isNull() | F.isnan(mean) | F.isnan(sd), "not a number"), (~((sd > 0) & (sd <= MOST_SD)), "sd"), (F.abs(mean) > MOST_MEAN, "mean"),
    )
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), mean).alias("mean"), F.when(problem.isNull(), sd).alias("sd"))


def number_answer(reply: Column) -> Column:
    """struct (problem, mean, sd) of the first pair of braces without braces inside: a nested object is no number's answer."""
    text = F.nullif(F.regexp_extract(reply, r"\{[^{}]*\}", 0), F.lit(""))
    found = distribution(F.from_json(text, RAW))
    return F.when(text.isNull(), F.struct(F.lit("no JSON object").alias("problem"), F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sd"))).otherwise(found)


def with_profile(replies: DataFrame, cells: list[str], reply: str = "reply") -> DataFrame:
    """replies with problem and profile (cell to mean and sd): exactly the cells that were asked for, each a good answer."""
    parsed = replies.withColumn("_fields", F.from_json(embedded_json(F.col(reply)), RAW))
    asked = F.lit(cells)
    each = F.transform(asked, lambda c: F.struct(c.alias("cell"), distribution(F.from_json(F.try_element_at(F.col("_fields"), c), RAW)).alias("d")))
    parsed = parsed.withColumn("_cells", F.when(F.col("_fields").isNotNull(), each))
    bad = F.get(F.filter("_cells", lambda c: c["d"]["problem"].isNotNull()), F.lit(0))
    problem = first_problem(
        (F.col("_fields").isNull(), "no JSON object"), (F.size(F.array_except(asked, F.map_keys("_fields"))) > 0, "missing cells"), (F.size(F.array_except(F.map_keys("_fields"), asked)) > 0, "cells that were not asked for"),
        (bad.isNotNull(), F.concat(bad["cell"], F.lit(": "), bad["d"]["problem"])),
    )
    profile = F.map_from_entries(F.transform("_cells", lambda c: F.struct(c["cell"], F.struct(c["d"]["mean"].alias("mean"), c["d"]["sd"].alias("sd")))))
    return parsed.withColumn("problem", problem).withColumn("profile", F.when(F.col("problem").isNull(), profile)).drop("_fields", "_cells")


def normalized(items: Column, length: int, basket: list[str] | None = None, exclusions: str | None = None) -> Column:
    """struct (problem, items) of an ordered list: titles in canonical form, or words of a basket by its own spelling. Content is never mended."""
    if basket is None:
        clean = F.transform(items, canonical_title)
        wrong = F.exists(items, lambda x: title_problem(x).isNotNull())
        barred = F.exists(clean, lambda x: excluded(x, exclusions)) if exclusions else F.lit(False)
    else:
        spelled = F.map_from_arrays(F.lit([b.casefold() for b in basket]), F.lit(basket))
        clean = F.transform(items, lambda x: F.try_element_at(spelled, F.lower(F.trim(x))))
        wrong, barred = F.lit(False), F.exists(clean, lambda x: x.isNull())
    problem = first_problem(
        (items.isNull(), "no list"), (F.size(items) != length, "length"), (wrong, "title"), (barred, "excluded" if basket is None else "outside the basket"), (F.size(F.array_distinct(clean)) != F.size(clean), "repeated"),
    )
    return F.struct(problem.alias("problem"), F.when(problem.isNull(), clean).alias("items"))


def with_ranking(replies: DataFrame, length: int, basket: list[str] | None = None, exclusions: str | None = None, reply: str = "reply") -> DataFrame:
    """replies with problem and items: the list under `ranking` of the first object, or the first array of a reply without one."""
    parsed = replies.withColumns({"_object": F.try_element_at(F.from_json(embedded_json(F.col(reply)), RAW), F.lit("ranking")), "_array": embedded_json(F.col(reply), kind="array")})
    parsed = parsed.withColumn("_raw", F.coalesce("_object", "_array"))
    strings = F.coalesce(F.schema_of_variant(F.try_parse_json("_raw")).isin("ARRAY<STRING>", "ARRAY<VOID>"), F.lit(False))
    parsed = parsed.withColumn("_items", F.when(strings, F.from_json("_raw", "array<string>")))
    found = normalized(F.col("_items"), length, basket, exclusions)
    problem = first_problem((F.col("_raw").isNull(), "no ranking"), (~strings, "not a list of strings"), (F.lit(True), found["problem"]))
    return parsed.withColumn("problem", problem).withColumn("items", F.when(F.col("problem").isNull(), found["items"])).drop("_object", "_array", "_raw", "_items")


def entrant_id(model: Column, context: Column, elicitation: Column) -> Column:
    """The id of a model under a condition; null for an unknown condition or one that the way of asking can't carry."""
    pairs = [(c, e) for e, held in CARRIES.items() for c in held]
    return reduce(lambda acc, p: acc.when((context == p[0]) & (elicitation == p[1]), F.concat(model, F.lit(CONTEXTS[p[0]] + ELICITATIONS[p[1]]))), pairs, F.when(F.lit(False), F.lit(None).cast("string")))


def resolved_ids(ids: DataFrame, models: DataFrame) -> DataFrame:
    """ids (entrant) with model, context and elicitation, null for an unknown one: the longest suffixes of each axis that leave a registered model. models: model."""
    longest = lambda axis: sorted(axis.items(), key=lambda kv: -len(kv[1]))
    pairs = [(c, cs + es, e) for e, es in longest(ELICITATIONS) for c, cs in longest(CONTEXTS) if c in CARRIES[e]]
    entrant = F.col("entrant")
    rest = lambda suffix: F.substr(entrant, F.lit(1), F.length(entrant) - len(suffix))
    readings = F.array_compact(F.array(*[F.when(F.endswith(entrant, F.lit(s)), F.struct(F.lit(i).alias("i"), rest(s).alias("model"), F.lit(c).alias("context"), F.lit(e).alias("elicitation"))) for i, (c, s, e) in enumerate(pairs)]))
    known = ids.select("entrant").distinct().select("entrant", F.explode(readings).alias("r")).join(models.select(F.col("model").alias("_known")).distinct(), F.col("r.model") == F.col("_known"))
    best = known.groupBy("entrant").agg(F.min("r").alias("r")).select("entrant", "r.model", "r.context", "r.elicitation")
    return ids.join(best, "entrant", "left")


#: A label of answers that stand in for a model, ids that answer for the house, and nulls.
MOCK, HOUSE, NULLS = "MOCK", ("test-jay", "just4test"), ("persistence", "trend", "ewma", "climatology")


def scoreable(entrant: Column, notes: Column) -> Column:
    """Whether an answer may be scored: no placeholder and none of the house's test accounts."""
    return ~F.coalesce(F.startswith(notes, F.lit(MOCK)), F.lit(False)) & ~entrant.isin(*HOUSE)


def competes(entrant: Column, notes: Column) -> Column:
    """Whether an answer is a member of the crowd: scoreable, and no null."""
    return scoreable(entrant, notes) & ~entrant.isin(*NULLS)


def loss_of(score: Column) -> Column:
    """The one loss of a score (struct with crps, energy and loss): null if it has none or several, or one that is not finite or negative."""
    kinds = F.array_compact(F.array(score["crps"], score["energy"], score["loss"]))
    v = F.get(kinds, F.lit(0))
    return F.when((F.size(kinds) == 1) & ~F.isnan(v) & (v >= 0) & (v < float("inf")), v)


def submission_vectors(cells: DataFrame, names: list[str], by: list[str]) -> DataFrame:
    """by, problem, means, sds in order of the names; a missing cell refuses the whole profile. cells: by, cell, mean, sd."""
    held = cells.where(F.col("cell").isin(names) & F.col("mean").isNotNull() & F.col("sd").isNotNull())
    every = cells.select(*by).distinct().join(held.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("cell", F.struct("mean", "sd")))).alias("_m")), by, "left")
    missing = F.when(F.col("_m").isNull(), F.lit(len(names))).otherwise(F.size(F.array_except(F.lit(names), F.map_keys("_m"))))
    problem = F.when(missing > 0, F.concat(F.lit("missing "), missing.cast("string"), F.lit(f" of {len(names)} cells")))
    pick = lambda part: F.when(problem.isNull(), F.transform(F.lit(names), lambda n: F.try_element_at(F.col("_m"), n)[part]))
    return every.select(*by, problem.alias("problem"), pick("mean").alias("means"), pick("sd").alias("sds"))
