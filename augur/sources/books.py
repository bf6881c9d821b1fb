"""Workbooks as tables: monthly medians by the names of their columns, and the waves of a crosstab workbook, whose sheets must agree."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from augur.sources.readers import refused

#: The sheet of monthly medians and the headers of its columns, rows it has at least, its first month, and what a median lies between.
MONTH_SHEET = "Inflation expectations"
HEADERS = {"infl_1y": "Median one-year ahead expected inflation rate", "infl_3y": "Median three-year ahead expected inflation rate"}
LEAST_MONTHS, FIRST_MONTH, LEAST_MEDIAN, MOST_MEDIAN = 150, "2013-06-01", -5.0, 25.0

#: The topline's sheet, and the rows of a sheet by their labels.
TOPLINE = "US Registered Voters"
LABELS = {"Approve": "approve", "Disapprove": "disapprove", "Not sure": "not_sure", "Unweighted base": "unweighted_base", "Base": "base"}
SHARES = ("approve", "disapprove", "not_sure")


def monthly_medians(cells: DataFrame, least_rows: int = LEAST_MONTHS) -> DataFrame:
    """date, infl_1y, infl_3y of one workbook's cells (path, sheet, row, column, text, as documents.workbooks gives them).

    Columns are found by their whole headers in the first row that has one, never by place. The job fails without the
    sheet, on a header row that names only some of them, on months before it, on a month or median that is none, on a gap or
    a repeated month, on fewer than least_rows months, and (for whole histories) on another first month.
    """
    own = cells.where(F.col("sheet") == MONTH_SHEET)
    there = cells.agg(F.count_if(F.col("sheet") == MONTH_SHEET).alias("_cells"), F.min(F.when((F.col("sheet") == MONTH_SHEET) & F.col("text").isin(*HEADERS.values()), F.col("row"))).alias("_head"))
    month = F.regexp_extract("text", r"^((?:19|20)[0-9]{4})(?:\.|$)", 1)
    keys = own.where("column = 'A'").select("row", month.alias("_month")).where("_month <> ''")
    named = own.where(F.col("text").isin(*HEADERS.values())).join(F.broadcast(there), F.col("row") == F.col("_head")).groupBy("text").agg(F.min("column").alias("column"))
    columns = named.agg(*[F.max(F.when(F.col("text") == h, F.col("column"))).alias(f"_{k}") for k, h in HEADERS.items()])  # one row
    facts = there.crossJoin(columns).crossJoin(keys.agg(F.count("*").alias("_months"), F.min("row").alias("_first")))
    missing = F.filter(F.array(*[F.when(F.col(f"_{k}").isNull(), F.lit(h)) for k, h in HEADERS.items()]), lambda h: h.isNotNull())
    problem = (
        F.when(F.col("_cells") == 0, F.lit(f"no sheet named {MONTH_SHEET!r}")).when(F.col("_head").isNull() | (F.col("_first") < F.col("_head")), F.lit("the sheet reached its data rows before naming its columns"))
        .when(F.size(missing) > 0, F.concat(F.lit("the header row is missing "), F.array_join(missing, ", "), F.lit(": renamed or split"))).when(F.col("_months") < least_rows, F.concat(F.lit("the sheet parsed to "), "_months", F.lit(" rows")))
    )
    checked = facts.select(*[F.when(problem.isNull(), F.col(f"_{k}")).otherwise(F.raise_error(problem)).alias(f"_{k}") for k in HEADERS])
    date = F.try_to_timestamp(F.concat("_month", F.lit("01")), F.lit("yyyyMMdd")).cast("date")
    rows = checked.join(keys, F.lit(True), "left").select("row", F.coalesce(date, refused("not a YYYYMM month", "date")).alias("date"), *[f"_{k}" for k in HEADERS])
    texts = own.select("row", "column", "text")
    for k in HEADERS:
        value = F.expr("try_cast(text as double)")
        held = rows.join(texts, (rows["row"] == texts["row"]) & (rows[f"_{k}"] == texts["column"]), "left").select(rows["row"].alias("row"), "date", *[f"_{h}" for h in HEADERS], *[h for h in HEADERS if h in rows.columns], value.alias(k))
        bad = F.when(F.col(k).isNull() | F.isnan(k), refused("a month's median is not a number; a misread", "double")).when(~((F.col(k) > LEAST_MEDIAN) & (F.col(k) < MOST_MEDIAN)), refused("not a median expected inflation rate: a column was read out of the wrong place", "double"))
        rows = held.withColumn(k, bad.otherwise(F.col(k)))
    first = FIRST_MONTH if least_rows >= LEAST_MONTHS else None
    return in_sequence(rows.select("row", "date", *HEADERS), first)


def in_sequence(rows: DataFrame, first: str | None) -> DataFrame:
    """Months in the order of the sheet's rows, without a gap or a repeated one; first: the month that they begin with."""
    from pyspark.sql import Window as W

    w = W.partitionBy(F.lit(0)).orderBy("row")  # a row for each month of one survey
    before = F.lag("date").over(w)
    problem = F.when(before.isNull() & (F.lit(first).cast("date") != F.col("date")), F.concat(F.lit("the history starts at "), "date")).when(before.isNotNull() & (F.add_months(before, 1) != F.col("date")), F.concat(F.lit("the history jumps from "), before, F.lit(" to "), "date"))
    checked = rows.withColumn("_problem", problem)
    return checked.select(F.when(F.col("_problem").isNull(), F.col("date")).otherwise(F.raise_error(F.col("_problem")).cast("date")).alias("date"), *HEADERS)


@udtf
class CrosstabWaves:
    """crosstab_waves(TABLE(cells), labels): the waves of each workbook (path) that have every measure of the topline and of all labels, comma-separated.

    cells: path, sheet, row, column, text. Row 1 of a sheet is its question and the waves' dates; other rows begin with their
    labels. All sheets must have the same question and dates in the same columns, or their cells couldn't be aligned. Refused:
    a sheet without rows, a repeated date, a sheet of another axis, a workbook without a complete wave. Rows of one workbook
    come together and in order, and are all that is held at once.
    """

    @staticmethod
    def analyze(cells: AnalyzeArgument, labels: AnalyzeArgument) -> AnalyzeResult:
        if not cells.isTable:
            raise ValueError("the first argument is a table of cells")
        missing = {"path", "sheet", "row", "column", "text"} - {f.name for f in cells.dataType.fields}
        if missing or not labels.value:
            raise ValueError(f"cells without {', '.join(sorted(missing))}" if missing else "labels: the cells that a wave must have")
        schema = StructType()  # there is no session here to read DDL
        for name in ("path", "date", "question", "cell", "measure"):
            schema = schema.add(name, StringType())
        return AnalyzeResult(schema.add("value", DoubleType()), partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("sheet"), OrderingColumn("row")])

    def __init__(self) -> None:
        self.path, self.wanted, self.sheets = None, [], {}

    def eval(self, cell, labels: str) -> None:  # noqa: ANN001
        self.path, self.wanted = cell["path"], labels.split(",")
        self.sheets.setdefault(cell["sheet"], {}).setdefault(cell["row"], {})[cell["column"]] = cell["text"]

    def terminate(self) -> Iterator[tuple]:
        question = dates = None
        values: dict[str, dict[str, dict[str, str]]] = {}
        for name in sorted(self.sheets):
            rows = self.sheets[name]
            head = rows.get(1, {})
            if question is None:
                question, dates = head.get("A"), {c: t for c, t in head.items() if c != "A" and t}
                if len(set(dates.values())) != len(dates):
                    raise ValueError(f"{self.path}: a wave's date is repeated")
            elif head.get("A") != question or {c: t for c, t in head.items() if c != "A" and t} != dates:
                raise ValueError(f"{self.path}: sheet {name!r} has a different question or date axis; its cells can't be aligned")
            values[name] = {LABELS[r["A"]]: r for r in rows.values() if r.get("A") in LABELS}
        found = []
        for column, date in (dates or {}).items():
            wave = []
            try:
                for cell in [TOPLINE, *self.wanted]:
                    for label in LABELS.values():
                        number = float(values[cell][label][column])
                        wave.append((self.path, date, question, cell, label, round(number * 100, 4) if label in SHARES else number))
            except (KeyError, ValueError):
                continue
            found.append(wave)
        if self.sheets and not found:
            raise ValueError(f"{self.path}: zero complete waves")
        for wave in sorted(found, key=lambda w: w[0][1]):
            yield from wave


def crosstab_waves(cells: DataFrame, labels: list[str]) -> DataFrame:
    """path, date, question, cell, measure, value: see CrosstabWaves."""
    return CrosstabWaves(cells.asTable(), F.lit(",".join(labels)))


def register(spark: SparkSession) -> None:
    """crosstab_waves for SQL."""
    spark.udtf.register("crosstab_waves", CrosstabWaves)
