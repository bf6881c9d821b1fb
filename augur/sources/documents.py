"""Formats that need a parser per file: JSON inside free text and workbooks. Small helpers in Arrow batches; Spark deals the files."""

from __future__ import annotations

import io
import json
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Namespaces and types of workbooks.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
WORKSHEET = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet"


#: What a JSON value of each kind opens with.
OPENINGS = {"object": r"\{", "array": r"\[", "any": r"[\[{]"}


def first_json(text: str | None, marker: str = "", kind: str = "object") -> str | None:
    """The first complete JSON value of this kind after the marker, as text."""
    if text is None:
        return None
    at = text.find(marker)
    decoder = json.JSONDecoder()
    for m in re.finditer(OPENINGS[kind], text[at + len(marker) :]) if at >= 0 else ():
        start = at + len(marker) + m.start()
        try:
            return text[start : decoder.raw_decode(text, start)[1]]
        except ValueError:
            continue
    return None


def embedded_json(text: Column, marker: str = "", kind: str = "object", required: bool = False) -> Column:
    """As first_json, over a column; null where there is none, or (required) the job fails."""

    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: first_json(t, marker, kind))

    found = find(text)
    return F.coalesce(found, F.raise_error(F.lit(f"no JSON {kind} in a reply")).cast("string")) if required else found


def canonical_hash(document: Column) -> Column:
    """SHA-256 of JSON text with sorted keys, no spaces and \\u escapes for what is not ASCII; null for what is no JSON."""

    @F.pandas_udf("string")
    def canonical(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return F.sha2(canonical(document), 256)


def exact_round(x: Column, places: int) -> Column:
    """Rounding of the binary value itself, half to even, as a published table needs where ties decide."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or v != v else round(v, places))

    return rounded(x)


def sheet_members(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(sheet, member of the archive), by the workbook's relationships: the order of sheets says nothing about their files."""
    if "xl/_rels/workbook.xml.rels" not in book.namelist():
        raise ValueError("a workbook without relationships: sheets can't be told apart")
    targets: dict[str, str] = {}
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship"):
        if not r.get("Id") or r.get("Id") in targets:
            raise ValueError("a relationship without an id of its own")
        targets[r.get("Id")] = r.get("Target", "") if r.get("Type") == WORKSHEET else ""
    found: list[tuple[str, str]] = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
        name, target = s.get("name"), targets.get(s.get(f"{RELATION}id") or "")
        member = posixpath.normpath(target.lstrip("/") if (target or "").startswith("/") else posixpath.join("xl", target or ""))
        if not name or not target or member not in book.namelist() or any(name == n or member == m for n, m in found):
            raise ValueError(f"sheet {name!r} has no file of its own")
        found.append((name, member))
    return found


def workbook_cells(content: bytes) -> list[tuple[str, int, str, str]]:
    """(sheet, row, column letters, text) of a workbook's cells."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{SHEET}si")] if "xl/sharedStrings.xml" in names else []
        for sheet, member in sheet_members(book):
            for cell in ElementTree.fromstring(book.read(member)).iter(f"{SHEET}c"):
                value, place = cell.find(f"{SHEET}v"), re.match(r"([A-Z]+)([0-9]+)", cell.get("r", ""))
                text = "".join(t.text or "" for t in cell.iter(f"{SHEET}t")) if cell.get("t") == "inlineStr" else None if value is None else shared[int(value.text)] if cell.get("t") == "s" else value.text
                if place and text is not None:
                    out.append((sheet, int(place[2]), place[1], text))
    return out


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, column, text of every cell of the workbooks under a path: one row of binaryFile becomes many."""

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(p, *c) for c in workbook_cells(content)], columns=["path", "sheet", "row", "column", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cells, "path string, sheet string, row int, column string, text string")


#: Rows of a retail release's headers and marks, what the marks stand for, and the columns of its two blocks.
MARK_ROW, MARKS, BLOCKS = 9, {"(a)": "advance", "(p)": "preliminary", "(r)": "revised"}, {"nsa": "CDEFGHI", "sa": "JKLMN"}


def retail_release(cells: DataFrame, codes: list[str]) -> DataFrame:
    """path, code, label, measure, value of retail workbooks' cells (as workbooks gives them; first sheet only).

    Columns are found by their marks, never by place; a workbook that doesn't mark all it must fails the job. Numbers of a
    category may stand in the row below its code. A value in parentheses is suppressed: its row stays, with a null value.
    """
    text = F.trim("text")
    block = F.when(F.col("column").isin(*BLOCKS["nsa"]), "nsa").when(F.col("column").isin(*BLOCKS["sa"]), "sa")
    role = F.element_at(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv]), text)
    marked = cells.where(F.col("row") == MARK_ROW).select("path", "column", F.concat_ws("_", block, F.when(text.isin(*MARKS), role)).alias("measure"), block.alias("b")).where(F.col("b").isNotNull() & F.contains("measure", F.lit("_")))
    columns = marked.groupBy("path", "measure").agg(F.min("column").alias("column"))
    need = ["nsa_advance", "sa_advance", "sa_preliminary", "sa_revised"]
    known = columns.groupBy("path").agg(F.collect_set("measure").alias("_m"))
    paths = cells.select("path").distinct().join(known, "path", "left")
    fine = paths.select(F.when(F.size(F.array_except(F.lit(need), F.coalesce("_m", F.array().cast("array<string>")))) == 0, F.col("path")).otherwise(F.raise_error(F.lit("a release that doesn't mark its columns")).cast("string")).alias("path"))
    code = cells.where((F.col("column") == "A") & text.isin(*codes)).select("path", F.col("row").alias("at"), text.alias("code"))
    advance = columns.where("measure = 'sa_advance'").select("path", "column")
    direct = cells.join(advance, ["path", "column"]).select("path", F.col("row").alias("at"), F.lit(True).alias("_here"))
    placed = code.join(fine, "path").join(direct, ["path", "at"], "left").withColumn("row", F.when(F.col("_here"), F.col("at")).otherwise(F.col("at") + 1))
    names = cells.where("column = 'B'").select("path", F.col("row").alias("_r"), F.col("text").alias("_b"))
    labels = placed.join(names, "path").where((F.col("_r") == F.col("at")) | (F.col("_r") == F.col("row"))).groupBy("path", "code").agg(F.array_sort(F.collect_list(F.struct("_r", "_b"))).alias("_l"))
    wanted = placed.join(columns, "path")
    found = wanted.join(cells.select("path", "row", "column", "text"), ["path", "row", "column"], "left").join(labels, ["path", "code"], "left")
    return found.select("path", "code", F.trim(F.regexp_replace(F.array_join(F.col("_l._b"), ""), r"\s+", " ")).alias("label"), "measure", F.when(~F.startswith(F.trim("text"), F.lit("(")), F.trim("text").try_cast("double")).alias("value"))


def by_header(cells: DataFrame, header_row: int) -> DataFrame:
    """path, sheet, row, header, text: cells named by the text above them, whatever their place."""
    heads = cells.where(F.col("row") == header_row).select("path", "sheet", "column", F.col("text").alias("header"))
    return cells.where(F.col("row") > header_row).join(heads, ["path", "sheet", "column"]).select("path", "sheet", "row", "header", "text")
