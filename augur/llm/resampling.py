"""Target-distribution importance resampling (12), in DataFrame functions only.

Every document's runs of one and two words are exploded and hashed (crc32 modulo BUCKETS). Grouped counts of the buckets
in all documents and in all target texts give each bucket a gain, the logarithm of how much likelier the target is to
use it; the table of BUCKETS gains is broadcast and joined to the exploded runs, and a document's weight is the floored
mean of its gains. Gumbel noise from a hash of doc_id turns weights into scores, so that the highest scores are a draw
without replacement in proportion to exp(weight / 1000). A distributed sort orders the scores; ranks are positions in a
sorted partition plus the rows of the partitions before it.

Texts are read twice and never shuffled: what is shuffled is one row of numbers for each document. Equal documents of one
input partition are one such row with a number of copies, so a text that fills a third of the table is no hot key, and
copies are told apart again before the sort, whose ranges therefore stay even.

Nulls, empties, ties, repeats, clashing names: a null text counts as empty; a text without words has weight 0 and is not
drawn while least_words is over 0. A null doc_id draws its noise by the empty name and comes last among ties. Repeated rows are documents like
others and get ranks of their own. Empty documents give an empty result; an empty target has no counts, so all gains come
from the documents. Extra columns are ignored by resample() and kept by drawn().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from augur.llm.util import save, table

#: Buckets of features, rows that a document must have words, share drawn in percent, salt of the noise.
BUCKETS, LEAST_WORDS, PERCENT, SALT = 10_000, 20, 25, "7"

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: What stands for a document from its exploded runs on: its id, two hashes of its text, the partition it was read in.
KEYS = ["doc_id", "_name", "_name2", "_part"]


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL), BETWEEN_WORDS), "")


def runs(found: Column) -> Column:
    """All runs of one and two consecutive words, joined by one space."""
    firsts = F.greatest(F.size(found) - 1, F.lit(0))
    return F.concat(found, F.zip_with(F.slice(found, 1, firsts), F.slice(found, 2, firsts), lambda a, b: F.concat_ws(" ", a, b)))


def bucket(run: Column) -> Column:
    return F.pmod(F.crc32(run.cast("binary")), F.lit(BUCKETS)).cast("int")


def counts(texts: DataFrame, out: str) -> DataFrame:
    """Runs of all texts by bucket."""
    found = texts.select(words(F.col("text")).alias("_words")).select(F.explode(runs(F.col("_words"))).alias("_run"))
    return found.select(bucket(F.col("_run")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(out))


def gains(docs: DataFrame, target: DataFrame) -> DataFrame:
    """BUCKETS rows (bucket, gain): floor(1000 ln) of the smoothed share in the target over that in the documents."""
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(counts(docs, "s"), "bucket", "left").join(counts(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    whole = W.partitionBy(F.lit(0))
    s, t, all_s, all_t = (c.cast("double") for c in (F.col("s"), F.col("t"), F.sum("s").over(whole), F.sum("t").over(whole)))
    return both.select("bucket", F.floor(1000 * F.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))).cast("long").alias("gain"))


def named(docs: DataFrame) -> DataFrame:
    """docs with two hashes of the text."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_name": F.xxhash64(text), "_name2": F.xxhash64(F.lit(12), text)})


def weights(docs: DataFrame, gain: DataFrame) -> DataFrame:
    """A row for each document with KEYS, or for equal ones of one partition: _copies, n_words, n_features, weight."""
    rows = named(docs.select("doc_id", "text")).select("doc_id", "_name", "_name2", F.spark_partition_id().alias("_part"), words(F.col("text")).alias("_words"))
    exploded = rows.select(*KEYS, F.posexplode_outer(runs(F.col("_words"))).alias("_at", "_run")).select(*KEYS, "_at", bucket(F.col("_run")).alias("bucket"))
    summed = exploded.join(F.broadcast(gain), "bucket", "left").groupBy(*KEYS).agg(
        F.count(F.when(F.coalesce("_at", F.lit(0)) == 0, 1)).alias("_copies"), F.count("bucket").alias("_n"), F.sum("gain").alias("_sum")
    )
    floored = F.when(F.col("_n") > 0, F.expr("(_sum - pmod(_sum, _n)) div _n")).otherwise(F.lit(0)).cast("long")
    features = F.expr("_n div _copies")
    return summed.select(*KEYS, "_copies", features.alias("n_features"), F.expr("(_n div _copies + 1) div 2").alias("n_words"), floored.alias("weight"))


def noise(doc_id: Column, salt: str = SALT) -> Column:
    """Floor of 1000 times a standard Gumbel variate, from the first 32 bits of a hash."""
    head = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((head + 0.5) / 4294967296.0))).cast("long")


def in_order(rows: DataFrame, *order: Column) -> DataFrame:
    """rows with rank (1, 2, ...) by a distributed sort: a row's place in its partition after those of the partitions before.

    The sorted rows are saved, so places are read back, not computed again. The sums of partitions are as many as there
    are partitions. order should tell rows apart, or equal ones share a partition.
    """
    part = F.spark_partition_id()
    places = rows.orderBy(*order).withColumns({"_range": part, "_place": F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)})
    places = save(places, "order")
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = places.groupBy("_range").agg(F.count("*").alias("_rows")).select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return places.join(F.broadcast(starts), "_range").withColumn("rank", F.col("_start") + F.col("_place") + 1).drop("_range", "_place", "_start")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, salt: str = SALT) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, hashes of its text, n_words, n_features, weight, score, and rank if drawn.

    Of the N documents with least_words or more, floor(percent * N / 100) are drawn, by score; target has a column text.
    """
    scored = save(weights(docs, F.broadcast(save(gains(docs, target), "gains"))).withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt)), "weights")
    each = scored.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_copies")
    fit = F.col("n_words") >= least_words
    n = scored.where(fit).agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("n")).first()["n"]
    ranked = in_order(each.where(fit), F.desc("score"), F.asc_nulls_last("doc_id"), "_name", "_name2", "_part", "_copy")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= n * percent // 100, F.col("rank")))
    rest = each.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_part", "_copy")


def drawn(docs: DataFrame, resampled: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that resample() drew. Equal rows of which some were drawn stay together: they tie at the last rank."""
    keys = ["doc_id", "_name", "_name2"]
    hidden = {c: f"extra__{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    own = named(docs.select(*[F.col(f"`{c}`").alias(hidden.get(c, c)) for c in docs.columns]))
    chosen = resampled.where("rank is not null").select(*[F.col(k).alias(f"_of{k}") for k in keys]).distinct()
    kept = own.join(chosen, [F.col(k).eqNullSafe(F.col(f"_of{k}")) for k in keys], "left_semi")
    return kept.select(*[F.col(hidden.get(c, c)).alias(c) for c in docs.columns])


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents drawn towards the benchmark's distribution. Edge cases as in the module's docstring."""
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def crc32_sql(text: str) -> str:
    """DuckDB's crc32 of a text by bytes; entries is the list of the 256 bytes' remainders, made by rule in SQL."""
    return f"""(4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::BIGINT)), lambda c, b: xor(c // 256, entries[(xor(c, b) % 256) + 1])))"""


_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
_RUNS = r"SELECT {id} AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM {table}"

SQL = rf"""WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(0, 256) r(i) UNION ALL SELECT i, {_STEP}, k + 1 FROM bits WHERE k < 8),
  crc AS (SELECT list(c ORDER BY i) AS entries FROM bits WHERE k = 8),
  d AS ({_RUNS.format(id="row_number() OVER ()", table="documents").replace("SELECT", "SELECT doc_id,", 1)}), b AS ({_RUNS.format(id="item_id", table="benchmark")}),
  dr AS (SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda j: ws[j] || ' ' || ws[j + 1]))) AS g FROM d),
  br AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda j: ws[j] || ' ' || ws[j + 1]))) AS g FROM b),
  names AS (SELECT DISTINCT g FROM (SELECT g FROM dr UNION ALL SELECT g FROM br)), h AS (SELECT g, {crc32_sql("g")} % 10000 AS bucket FROM names, crc),
  s AS (SELECT bucket, count(*) AS s FROM dr JOIN h USING (g) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM br JOIN h USING (g) GROUP BY 1),
  a AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS all_t),
  gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), a),
  w AS (SELECT id, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM dr JOIN h USING (g) JOIN gain USING (bucket) GROUP BY 1),
  x AS (SELECT id, doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (id)),
  r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_words >= 20)
  SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (id)"""
