"""Mixing sources to target weights (7): native DataFrame operations only.

Each source's documents, in a pseudorandom order, are one stream of words packed into blocks of BLOCK words. Every
output shard of SHARD_SLOTS slots draws its source counts from one multinomial; a source drawn more often than its
quota hands the surplus slots to those drawn less, so the totals are exact. A source's k-th slot takes block
permutation(k) of its stream, by index, with a new permutation on each pass; k stays below three passes, so no word is
taken more than three times.

Nulls: a null text has no words and a size of 0, so nothing is taken of it; null is a source like others, the last one;
a null doc_id takes part. Sources without words have a target of 0, and a table without words makes an empty mix. Ties:
sources go by code point, documents by a hash of their id and text, then by the text's hash and their size; repeated
rows each have their own place in the stream. Extra columns are kept by mix_documents, also when their names clash.
The number of sources is taken to be small: their targets come from one window over a row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.llm.util import WORD, in_range, running_total, save, shielded, spread, table

BLOCK, SHARD_SLOTS, PASSES, ROUNDS, SEED = 128, 1024, 3, 24, 20_240


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with s (index by code point, null last), weight and target.

    Weights 1, 2, 3, repeating, share the total; a target stops at PASSES times its source's size and the excess goes
    to the others by weight. With sources ordered by cap / weight the capped ones come first, so the final share of a
    unit of weight is the largest of the shares that remain after each prefix. One row a source.
    """
    every, ordered = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy("_ratio", "s")
    return (
        sizes.withColumn("s", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", F.col("s") % 3 + 1)
        .withColumn("_cap", PASSES * F.col("source_size").cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_left", F.sum(F.col("source_size").cast("double")).over(every) - F.sum("_cap").over(ordered.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_left", F.coalesce("_left", F.sum(F.col("source_size").cast("double")).over(every)))
        .withColumn("_share", F.max(F.col("_left") / F.sum("weight").over(ordered.rowsBetween(0, W.unboundedFollowing))).over(every))
        .withColumn("target", F.least("_cap", F.greatest(F.lit(0.0), F.col("_share") * F.col("weight"))))
        .drop("_cap", "_ratio", "_left", "_share")
    )


def permuted(k: Column, n: Column, *salts: Column) -> Column:
    """A pseudorandom permutation of 0..n-1, of any n: ROUNDS rounds of swap-or-not."""

    def step(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, *salts), n) - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit(SEED + 1), r, F.greatest(x, y), *salts), F.lit(2)) == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k, step)


def plan(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with size, s and their _start in the source's stream; sources; slots) of a frame with doc_id, source, size, _tie.

    slots (shard, slot, s, block) is the mix: block i of source s is words i * BLOCK up to (i + 1) * BLOCK of its stream.
    """
    docs = save(docs.withColumn("_place", spread("doc_id", "_tie")), "sizes")
    sources = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n")))
    blocks = F.ceil(F.col("source_size") / BLOCK)
    quota = F.when(F.col("source_size") > 0, F.least(PASSES * blocks, F.round(F.col("target") * blocks / F.col("source_size")))).otherwise(0).cast("long")
    sources = save(sources.withColumns({"blocks": blocks, "quota": quota}).withColumn("_to", F.sum("quota").over(W.partitionBy(F.lit(0)).orderBy("s"))).withColumn("_from", F.col("_to") - F.col("quota")), "sources")
    rows, total = (int(x or 0) for x in sources.agg(F.sum("_n"), F.sum("quota")).first())
    spark = docs.sparkSession
    slots = spark.range(total).select(F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.col("id").alias("slot"), F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(max(1, total))).alias("_u"))
    drawn = save(in_range(slots, "_u", sources.select("s", "_from", "_to"), total).drop("_u"), "drawn")
    counts = save(drawn.groupBy("s", "shard").agg(F.count("*").alias("_here")), "counts")
    shards = total // SHARD_SLOTS + 1
    before = running_total(counts, ["s"], "shard", [], F.col("_here"), "_before", shards, max(1, shards.bit_length()))
    k = drawn.withColumn("_i", F.row_number().over(W.partitionBy("s", "shard").orderBy("slot")) - 1).join(before.drop("_here"), ["s", "shard"]).withColumn("_k", F.col("_i") + F.col("_before")).drop("_i", "_before")
    ends = lambda c: F.sum(c).over(W.partitionBy(F.lit(0)).orderBy("s"))
    moves = (
        sources.select("s", "blocks", "quota").join(counts.groupBy("s").agg(F.sum("_here").alias("_drawn")), "s", "left")
        .withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
        .withColumns({"_over": F.greatest(F.col("_drawn") - F.col("quota"), F.lit(0)), "_under": F.greatest(F.col("quota") - F.col("_drawn"), F.lit(0))})
        .withColumns({"_over_from": ends("_over") - F.col("_over"), "_to": ends("_under")})
        .withColumn("_from", F.col("_to") - F.col("_under"))
    )
    k = k.join(moves.select("s", "blocks", "quota", "_over_from"), "s")
    kept = k.where("_k < quota").select("shard", "slot", "s", "blocks", "_k")
    surplus = k.where("_k >= quota").select("shard", "slot", (F.col("_k") - F.col("quota") + F.col("_over_from")).alias("_e"))
    moved = in_range(surplus, "_e", moves.select("s", "blocks", F.col("_drawn").alias("_had"), "_from", "_to", F.col("_from").alias("_first")), total)
    slots = kept.unionByName(moved.select("shard", "slot", "s", "blocks", (F.col("_had") + F.col("_e") - F.col("_first")).alias("_k")))
    slots = slots.withColumn("block", permuted(F.expr("_k % blocks"), F.col("blocks"), F.col("s"), F.expr("_k div blocks"))).select("shard", "slot", "s", "block")
    placed = running_total(docs.join(sources.select("source", "s", "source_size", "target"), docs["source"].eqNullSafe(sources["source"])).drop(sources["source"]), ["s"], "_place", ["_tie", "size"], F.col("size"), "_start", rows)
    return placed, sources, slots


def uses_by_document(placed: DataFrame, slots: DataFrame) -> DataFrame:
    """A row for each document and block it shares words with: _lo, _hi (word places in the document) and uses."""
    uses = slots.groupBy("s", "block").agg(F.count("*").alias("uses"))
    spans = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"_start div {BLOCK}"), F.expr(f"(_start + size - 1) div {BLOCK}"))))
    return spans.join(uses, ["s", "block"]).withColumns({"_lo": F.greatest(F.lit(0), F.col("block") * BLOCK - F.col("_start")), "_hi": F.least("size", (F.col("block") + 1) * BLOCK - F.col("_start"))})


@shielded("doc_id", "source", "text", "n_chars")
def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of docs: of each document one row for each pass that takes words of it.

    A row's text holds the words (with the white space before each) that its pass takes; n_chars, if there, is theirs.
    """
    every = docs.columns  # two hashes tell rows apart: 126 bits
    docs = docs.withColumns({"_row": spread(*every), "_other": F.xxhash64(F.lit(SEED), *reversed(every)), "size": words(F.col("text"))})
    placed, _, slots = plan(docs.select("doc_id", "source", "size", F.col("_row").alias("_tie"), "_other"))
    spans = uses_by_document(placed, slots).groupBy(F.col("_tie").alias("_row"), "_other", "_start").agg(F.array_sort(F.collect_list(F.struct("_lo", "_hi", "uses"))).alias("_spans"))
    tokens = F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    taken = docs.dropDuplicates(["_row", "_other"]).join(spans, ["_row", "_other"])  # equal rows have a span list each
    taken = taken.withColumn("_tokens", tokens).withColumn("_pass", F.explode(F.sequence(F.lit(0), F.array_max("_spans.uses") - 1)))
    text = F.array_join(F.flatten(F.transform(F.filter("_spans", lambda b: b["uses"] > F.col("_pass")), lambda b: F.slice(F.col("_tokens"), b["_lo"].cast("int") + 1, (b["_hi"] - b["_lo"]).cast("int")))), "")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return taken.withColumns(new).drop("_row", "_other", "_start", "size", "_spans", "_tokens", "_pass")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document its size, its source's size and target, and the words that the mix takes of it. Edge cases as in the module's docstring."""
    docs = table(spark, sf_dir, "documents")
    placed, sources, slots = plan(docs.select("doc_id", "source", words(F.col("text")).alias("size"), F.xxhash64("text").alias("_tie")))
    placed = placed.withColumn("_id", F.struct("_place", "_tie", "_start", "s"))
    taken = uses_by_document(placed, slots).groupBy("_id").agg(F.sum(F.col("uses") * (F.col("_hi") - F.col("_lo"))).alias("taken"))
    return placed.join(taken, "_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
