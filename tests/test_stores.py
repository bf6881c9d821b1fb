"""Trees of files, merged tables, intake and workbooks: what is read and written, what is refused, what stays."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from augur.sources import books, corpus, trees, versions
from augur.streaming import intake

TREE = "round_id string, entrant string, failed boolean, path string, modified timestamp, body string"


def files(spark, *rows):
    return spark.createDataFrame([(r, e, f, "", None, b) for r, e, f, b in rows], TREE)


@pytest.fixture
def tree(spark, tmp_path):
    trees.register(spark)
    root = str(tmp_path / "replies")
    files(spark, ("r1", "a", False, '{"x":1}'), ("r1", "b", True, "{}"), ("r2", "a", False, "é"), ("r3", "c", False, "")).write.format(trees.FORMAT).mode("append").save(root)
    return root


def test_a_tree_is_written_and_read(spark, tree):
    assert sorted(os.listdir(f"{tree}/r1")) == ["a.json", "failures"]
    found = spark.read.format(trees.FORMAT).load(tree)
    assert sorted((r["round_id"], r["entrant"], r["failed"], r["body"]) for r in found.collect()) == [("r1", "a", False, '{"x":1}'), ("r1", "b", True, "{}"), ("r2", "a", False, "é"), ("r3", "c", False, "")]
    assert all(r["modified"] is not None and r["path"].endswith(".json") for r in found.collect())
    assert spark.read.format(trees.FORMAT).load(tree + "/nowhere").count() == 0


def test_filters_reach_the_source(spark, tree):
    """A round that isn't wanted is never listed: a folder that can't be read does no harm."""
    found = spark.read.format(trees.FORMAT).load(tree)
    assert found.where("round_id = 'r1' and entrant in ('a', 'c')").select("body").collect() == [("{\"x\":1}",)]
    assert found.where("round_id in ('r2', 'r9') and round_id = 'r2'").count() == 1
    assert found.where("failed").select("entrant").collect() == [("b",)]
    reader = trees.TreeReader(tree)
    assert not list(reader.pushFilters([trees.EqualTo(("round_id",), "r2")])) and [leaf.entrant for part in reader.partitions() for leaf in part.files] == ["a"]
    other = trees.Filter()
    assert list(reader.pushFilters([other])) == [other]


def test_files_are_written_once(spark, tree):
    files(spark, ("r1", "a", False, '{"x":1}')).write.format(trees.FORMAT).mode("append").save(tree)
    with pytest.raises(Exception, match="written once"):
        files(spark, ("r1", "a", False, "other")).write.format(trees.FORMAT).mode("append").save(tree)
    with pytest.raises(Exception, match="only added to"):
        files(spark, ("r1", "a", False, "other")).write.format(trees.FORMAT).mode("overwrite").save(tree)
    for bad in ("../x", ""):
        with pytest.raises(Exception, match="no file name"):
            files(spark, (bad, "a", False, "{}")).write.format(trees.FORMAT).mode("append").save(tree)
    assert spark.read.format(trees.FORMAT).load(tree).where("round_id = 'r1' and not failed").first()["body"] == '{"x":1}'


def test_a_tree_streams_new_files_only(spark, tree, tmp_path):
    def run():
        query = spark.readStream.format(trees.FORMAT).load(tree).select("round_id", "entrant").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        q = query.start()
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.schema("round_id string, entrant string").parquet(str(tmp_path / "out")).collect()))

    first = run()
    assert first == [("r1", "a"), ("r1", "b"), ("r2", "a"), ("r3", "c")] and run() == first
    files(spark, ("r9", "z", False, "{}")).write.format(trees.FORMAT).mode("append").save(tree)
    assert run() == [*first, ("r9", "z")]


SNAPSHOT = "round_id string, field string, value string"


def fields(spark, *rows):
    return spark.createDataFrame(list(rows), SNAPSHOT)


def merged(spark, path, *rows, wins="new"):
    versions.merge(path, fields(spark, *rows), ["round_id", "field"], ["round_id"], wins, buckets=8)
    return sorted(map(tuple, versions.read(spark, path, SNAPSHOT).collect()))


def parquet_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_a_merge_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "locks")
    assert versions.read(spark, path, SNAPSHOT).count() == 0
    every = [(f"r{i}", "history", "1") for i in range(30)]
    assert merged(spark, path, *every) == sorted(every)
    before, (_, entries) = parquet_files(path), versions.manifest(spark, path)
    found = merged(spark, path, ("r3", "history", "2"), ("r3", "frozen", "x"), ("new", "history", "3"))
    assert found == sorted([*(r for r in every if r[0] != "r3"), ("r3", "history", "2"), ("r3", "frozen", "x"), ("new", "history", "3")])
    number, after = versions.manifest(spark, path)
    assert number == 2 and {b for b in after if after[b] != entries.get(b)} == {r[0] for r in fields(spark, ("r3", "", ""), ("new", "", "")).select(versions.bucket_of(["round_id"], 8)).collect()}
    assert parquet_files(path).items() >= before.items()


def test_what_is_there_wins_where_a_merge_only_adds(spark, tmp_path):
    path = str(tmp_path / "resolved")
    merged(spark, path, ("r1", "answer", "40"))
    assert merged(spark, path, ("r1", "answer", "41"), ("r2", "answer", "5"), wins="old") == [("r1", "answer", "40"), ("r2", "answer", "5")]
    assert merged(spark, path, ("r1", "answer", None)) == [("r1", "answer", None), ("r2", "answer", "5")]
    with pytest.raises(Exception, match="several updates"):
        merged(spark, path, ("r1", "answer", "1"), ("r1", "answer", "2"))
    with pytest.raises(ValueError, match="new or old"):
        merged(spark, path, ("r1", "answer", "1"), wins="both")


def test_an_interrupted_write_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "locks")
    old = merged(spark, path, ("r1", "a", "1"), ("r2", "a", "1"))

    def stop(*_):
        raise RuntimeError("the driver was lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", stop)
        with pytest.raises(RuntimeError, match="lost"):
            merged(spark, path, ("r1", "a", "2"))
    assert sorted(map(tuple, versions.read(spark, path, SNAPSHOT).collect())) == old
    assert merged(spark, path, ("r1", "a", "3")) == [("r1", "a", "3"), ("r2", "a", "1")]
    with pytest.raises(Exception, match="(?i)exists"):  # a second writer of the same manifest
        versions.commit(spark, path, 2, {0: "x"})


def test_intake_holds_the_first_body_of_a_key(spark, tmp_path):
    t = dt.datetime(2026, 8, 1)
    rows = [("key-00001", 1, t, "a"), ("key-00001", 2, t + dt.timedelta(hours=1), "a"), ("key-00001", 3, t + dt.timedelta(hours=2), "b"), ("short", 4, t, "a"), (None, 5, t, "a"), ("key-00002", 6, t, None), ("k" * 201, 7, t, "a")]
    data = spark.createDataFrame(rows, "key string, seq long, ts timestamp, body string")
    expected = {1: "accepted", 2: "repeated", 3: "refused", 4: "invalid", 5: "invalid", 6: "accepted", 7: "invalid"}
    assert {r["seq"]: r["outcome"] for r in intake.judged(data.select("key", "seq", F.col("ts").alias("at"), F.sha2("body", 256).alias("digest"))).collect()} == expected
    for i, part in enumerate((data.where("seq <> 3"), data.where("seq = 3").unionByName(spark.createDataFrame([("key-00001", 8, t + dt.timedelta(hours=3), "a")], data.schema)))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"n={i}"))
    source = spark.readStream.schema(data.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    intake.write_outcomes(intake.intake(source), out, check).awaitTermination()
    told = lambda: {(r["seq"], r["outcome"], r["first_at"]) for r in spark.read.parquet(out).collect()}
    found = told()
    assert {(s, o) for s, o, _ in found} == set(expected.items()) | {(8, "repeated")} and {f for s, _, f in found if s in (1, 2, 3, 8)} == {t}
    assert sorted(d for d in os.listdir(out) if d.startswith("outcome=")) == ["outcome=accepted", "outcome=invalid", "outcome=refused", "outcome=repeated"]
    n = spark.read.parquet(out).count()
    batch = spark.read.parquet(out).where("batch = 0")  # a batch that is written again replaces itself
    rows0 = spark.createDataFrame(batch.collect(), batch.schema)
    rows0.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("outcome", "batch").parquet(out)
    assert spark.read.parquet(out).count() == n and told() == found


CELL = "path string, sheet string, row int, column string, text string"


def months(spark, rows, headers=None, sheet=books.MONTH_SHEET, **named):
    heads = headers or {"B": "25th Percentile one-year ahead expected inflation rate", "C": books.HEADERS["infl_3y"], "D": books.HEADERS["infl_1y"]}
    cells = [("w", "Decoy", 4, "A", "201306"), ("w", sheet, 1, "A", "title")] + [("w", sheet, 4, c, t) for c, t in heads.items()] + [("w", sheet, 5 + i, c, t) for i, row in enumerate(rows) for c, t in row.items()]
    return sorted(map(tuple, books.monthly_medians(spark.createDataFrame(cells, CELL), **({"least_rows": 1} | named)).collect()))


GOOD = {"B": "1.9", "C": "3.4", "D": "3.1"}


def test_medians_are_read_by_header(spark):
    assert months(spark, [{"A": "201306", **GOOD}, {"A": "201307.0", "C": "3.3", "D": "3.2", "B": "9"}, {"A": "a note"}]) == [(dt.date(2013, 6, 1), 3.1, 3.4), (dt.date(2013, 7, 1), 3.2, 3.3)]


@pytest.mark.parametrize(
    ("rows", "named", "problem"),
    [
        ([{"A": "201306", **GOOD}], {"sheet": "Inflation expectations (rebased)"}, "no sheet named"), ([{"A": "201306", **GOOD}], {"headers": {"C": books.HEADERS["infl_3y"], "D": "Median (rebased)"}}, "renamed or split"),
        ([{"A": "201306", **GOOD}], {"headers": {"D": "x"}}, "before naming"), ([{"A": "201306", "C": "3.4", "D": "n/a"}], {}, "not a number"), ([{"A": "201306", "C": "3.4"}], {}, "not a number"), ([{"A": "201306", **GOOD, "D": "201307"}], {}, "wrong place"),
        ([{"A": "201306", **GOOD, "D": "-12"}], {}, "wrong place"), ([{"A": "201306", **GOOD}, {"A": "201308", **GOOD}], {}, "jumps from"), ([{"A": "201306", **GOOD}, {"A": "201306", **GOOD}], {}, "jumps from"), ([{"A": "201307", **GOOD}, {"A": "201306", **GOOD}], {}, "jumps from"),
        ([{"A": "201313", **GOOD}], {}, "YYYYMM"), ([{"A": "201306", **GOOD}] * 3, {"least_rows": books.LEAST_MONTHS}, "parsed to 3 rows"),
        ([{"A": f"{2014 + i // 12}{i % 12 + 1:02d}", **GOOD} for i in range(158)], {"least_rows": books.LEAST_MONTHS}, "starts at 2014-01-01"),
    ],
)
def test_months_that_are_refused(spark, rows, named, problem):
    with pytest.raises(Exception, match=problem):
        months(spark, rows, **named)


def crosstab(spark, change=lambda sheet, row, column, text: text, labels=("Democrat", "Republican"), dates=("2026-08-10", "2026-08-17")):
    cells = []
    for sheet in (books.TOPLINE, *labels, "Adults"):
        rows = [{"A": "Do you approve?", **{c: d for c, d in zip("BC", dates, strict=True)}}] + [{"A": label, "B": "0.41" if i < 3 else "700", "C": "0.5" if i < 3 else "650"} for i, label in enumerate(books.LABELS)]
        cells += [("w", sheet, i, c, change(sheet, i, c, t)) for i, row in enumerate(rows, 1) for c, t in row.items()]
    cells = [c for c in cells if c[4] is not None]
    return books.crosstab_waves(spark.createDataFrame(cells, CELL).repartition(5), list(labels))


def test_waves_of_a_crosstab_workbook(spark):
    found = crosstab(spark).collect()
    assert len(found) == 2 * 3 * 5 and {r["question"] for r in found} == {"Do you approve?"}
    assert {(r["date"], r["value"]) for r in found if r["measure"] == "approve"} == {("2026-08-10", 41.0), ("2026-08-17", 50.0)} and {r["value"] for r in found if r["measure"] == "base"} == {700.0, 650.0}
    hole = crosstab(spark, lambda s, i, c, t: "" if (s, i, c) == ("Democrat", 2, "C") else t)
    assert {r["date"] for r in hole.collect()} == {"2026-08-10"}
    books.register(spark)
    assert spark.sql("SELECT count(*) FROM crosstab_waves(TABLE({cells}), 'Democrat')", cells=spark.createDataFrame([("w", s, i, c, t) for s in (books.TOPLINE, "Democrat") for i, c, t in ((1, "A", "q"), (1, "B", "2026-08-10"), *((2 + j, x, y) for j, label in enumerate(books.LABELS) for x, y in (("A", label), ("B", "0.5"))))], CELL)).first()[0] == 10


@pytest.mark.parametrize(
    ("change", "problem"),
    [
        (lambda s, i, c, t: "2026-08-18" if (s, i, c) == ("Republican", 1, "C") else t, "date axis"), (lambda s, i, c, t: "Another question?" if (s, i, c) == ("Republican", 1, "A") else t, "different question"),
        (lambda s, i, c, t: "x" if s == "Democrat" and i == 2 and c != "A" else t, "zero complete waves"), (lambda s, i, c, t: "2026-08-10" if i == 1 and c == "C" else t, "repeated"),
    ],
)
def test_workbooks_whose_sheets_disagree_are_refused(spark, change, problem):
    with pytest.raises(Exception, match=problem):
        crosstab(spark, change).collect()


def revisions(spark, *rows):
    return spark.createDataFrame([(dt.date(2026, 8, d), r, i, c, t) for d, r, items in rows for i, (c, t) in enumerate(items)], "day date, revision long, place int, category string, text string")


def test_a_corpus_stores_every_item_once(spark, tmp_path):
    path, a, b, c = str(tmp_path / "corpus"), ("Law", "one"), ("Law", "two"), ("Health", "one")
    assert corpus.load(path, revisions(spark, (1, 10, [a, b]), (1, 11, [b, a, c, a]), (2, 20, [a]))) == {"items": 4, "revisions": 7}
    before = parquet_files(path)
    assert corpus.load(path, revisions(spark, (1, 11, [b, a, c, a]), (2, 20, [a]))) == {"items": 0, "revisions": 0}
    assert {f for f in parquet_files(path) if "/items/" in f} == {f for f in before if "/items/" in f}
    assert corpus.load(path, revisions(spark, (1, 12, [b, ("Law", None), c]), (1, 11, [("Law", "other")]))) == {"items": 1, "revisions": 3}
    found = {}
    for r in corpus.read(spark, path).orderBy("place").collect():
        found.setdefault(r["revision"], []).append((r["category"], r["text"]))
    assert found == {10: [a, b], 11: [b, a, c, a], 12: [b, ("Law", None), c], 20: [a]}
    assert corpus.load(path, revisions(spark).limit(0)) == {"items": 0, "revisions": 0}


def test_a_bloom_filter_loses_nothing(spark):
    ids = spark.range(5_000).select(F.sha2(F.col("id").cast("string"), 256).alias("item_id"))
    size = 2 * corpus.BITMAP
    filter_ = corpus.bloom(ids.where("true"), "item_id", size)
    assert corpus.maybe(ids, "item_id", filter_, size).count() == 5_000
    others = spark.range(10_000, 30_000).select(F.sha2(F.col("id").cast("string"), 256).alias("item_id"))
    assert corpus.maybe(others, "item_id", filter_, size).count() < 20_000 * 0.05
