"""Workbook scan (S8, S9): a folder of .xlsx files as Spark jobs.

``binaryFile`` lists the workbooks; ``mapInPandas`` opens each one (zip +
XML from the standard library, streamed with ``iterparse``) and yields long
cells ``(file, sheet, row, col, value, formula)`` in bounded batches.  The
sheet inventory is an aggregate of those cells; a sheet becomes a table by
pivoting its cells on the column ordinal, named by the header row.  A cell
with a formula and no cached value keeps its formula text (S9).
"""

from __future__ import annotations

import datetime as _dt
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofsheet.sources.delimited import header_names

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
      "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
      "p": "http://schemas.openxmlformats.org/package/2006/relationships"}
CELLS_SCHEMA = "file string, sheet string, sheet_index int, row long, col int, value string, formula string"
BATCH = 100_000
# Built-in number formats that display dates/times.
DATE_FORMAT_IDS = set(range(14, 23)) | {45, 46, 47}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n  # 1-based


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Indices of cell styles whose number format is a date."""
    try:
        root = ET.fromstring(z.read("xl/styles.xml"))
    except KeyError:
        return set()
    custom = {}
    for nf in root.iterfind("m:numFmts/m:numFmt", NS):
        code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", nf.get("formatCode", ""))
        custom[int(nf.get("numFmtId"))] = bool(re.search(r"[ymdhs]", code, re.I))
    out = set()
    for i, xf in enumerate(root.iterfind("m:cellXfs/m:xf", NS)):
        fid = int(xf.get("numFmtId", "0"))
        if fid in DATE_FORMAT_IDS or custom.get(fid):
            out.add(i)
    return out


def _serial_to_iso(v: str) -> str:
    d = _dt.datetime(1899, 12, 30) + _dt.timedelta(days=float(v))
    return d.isoformat(sep=" ") if d.time() != _dt.time(0) else d.date().isoformat()


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels.iterfind("p:Relationship", NS)}
    out = []
    for s in wb.iterfind("m:sheets/m:sheet", NS):
        t = target[s.get(f"{{{NS['r']}}}id")]
        out.append((s.get("name"), t.lstrip("/") if t.startswith("/") else "xl/" + t))
    return out


def open_random_access(path: str):
    """A seekable handle through pyarrow.fs (local, HDFS, object stores):
    the zip directory is read by seeking, not by loading the file."""
    from pyarrow import fs
    filesystem, inner = fs.FileSystem.from_uri(path)
    return filesystem.open_input_file(inner)


def iter_cells(path: str, handle):
    """Yield (sheet, sheet_index, row, col, value, formula) of every cell."""
    z = zipfile.ZipFile(handle)
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{NS['m']}}}t")))
    dates = _date_styles(z)
    for idx, (name, part) in enumerate(_sheets(z)):
        yield name, idx, 0, 0, None, None  # names the sheet, also where it has no cell
        with z.open(part) as fh:
            for _, el in ET.iterparse(fh):
                if el.tag != f"{{{NS['m']}}}c":
                    continue
                ref = el.get("r")
                t = el.get("t", "n")
                f_el, v_el = el.find("m:f", NS), el.find("m:v", NS)
                formula = ("=" + f_el.text) if f_el is not None and f_el.text else None
                value = v_el.text if v_el is not None else None
                if t == "s" and value is not None:
                    value = shared[int(value)]
                elif t == "inlineStr":
                    value = "".join(x.text or "" for x in el.iter(f"{{{NS['m']}}}t"))
                elif t == "b" and value is not None:
                    value = "TRUE" if value == "1" else "FALSE"
                elif t == "n" and value is not None and int(el.get("s", "0")) in dates:
                    value = _serial_to_iso(value)
                if value is None and formula is None:
                    el.clear()
                    continue
                row = int(re.sub(r"[A-Z]+", "", ref))
                yield name, idx, row, _col_index(ref), value, formula
                el.clear()


def _cells(batches):
    for pdf in batches:
        for path in pdf["path"]:
            handle = open_random_access(path)
            buf = []
            for cell in iter_cells(path, handle):
                buf.append((path, *cell))
                if len(buf) >= BATCH:
                    yield pd.DataFrame(buf, columns=CELLS_SCHEMA_COLS)
                    buf = []
            if buf:
                yield pd.DataFrame(buf, columns=CELLS_SCHEMA_COLS)


CELLS_SCHEMA_COLS = ["file", "sheet", "sheet_index", "row", "col", "value", "formula"]


def workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """Long cells of every sheet of every workbook under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path).select("path")
    return files.repartition(max(1, files.rdd.getNumPartitions())).mapInPandas(_cells, CELLS_SCHEMA)


def workbook_inventory(spark: SparkSession, path: str, cells: DataFrame | None = None) -> DataFrame:
    """``file, sheet, rows, columns, has_data`` (extent = last used
    cell; a sheet without cells is listed with 0 and 0)."""
    cells = cells if cells is not None else workbook_cells(spark, path)
    return (cells.groupBy("file", "sheet", "sheet_index")
                 .agg(F.max("row").alias("rows"), F.max("col").alias("columns"))
                 .withColumn("has_data", (F.col("rows") > 1) & (F.col("columns") > 0))
                 .orderBy("file", "sheet_index").drop("sheet_index"))


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, cells: DataFrame | None = None) -> DataFrame:
    """One sheet as a table; header from row 1 (S5 naming), cached value
    or else the formula text, whitespace-only → null, ``__source_row`` = the
    sheet row number."""
    cells = cells if cells is not None else workbook_cells(spark, path)
    if sheet is None:
        first = cells.groupBy("sheet", "sheet_index").agg(F.max("row").alias("r")).where("r > 1") \
            .orderBy("sheet_index").limit(1).collect()
        if not first:
            raise ValueError("the workbook holds no data to analyse")
        sheet = first[0]["sheet"]
    sc = cells.where(F.col("sheet") == sheet).withColumn("cell", F.coalesce("value", "formula"))
    heads = sc.where(F.col("row") == 1).groupBy("file").agg(F.sort_array(F.collect_list(F.struct("col", "cell"))).alias("head"))
    heads = heads.groupBy("head").agg(F.count("*").alias("files")).limit(2).collect()  # one row of names
    if not heads:
        raise ValueError(f"sheet {sheet!r} not found or empty")
    if len(heads) > 1:
        raise ValueError(f"the workbooks' sheets {sheet!r} have different headers")
    header = heads[0]["head"]
    width = max(r["col"] for r in header)
    width = max(width, sc.agg(F.max("col")).collect()[0][0])
    by_col = {r["col"]: r["cell"] for r in header}
    names = header_names([by_col.get(i) for i in range(1, width + 1)])
    body = sc.where(F.col("row") > 1)
    wide = body.groupBy(F.col("file").alias("__source_file"), F.col("row").alias("__source_row")).pivot("col", list(range(1, width + 1))).agg(F.first("cell"))
    # blank rows inside the used range stay as empty rows (a spreadsheet
    # reader keeps them); the row range is generated by Spark, not listed
    rows = (sc.groupBy(F.col("file").alias("__source_file")).agg(F.max("row").cast("long").alias("last")).where("last > 1")
            .select("__source_file", F.explode(F.sequence(F.lit(2).cast("long"), "last")).alias("__source_row")))
    wide = rows.join(wide, ["__source_file", "__source_row"], "left")
    several = ["__source_file"] if heads[0]["files"] > 1 else []  # rows of several workbooks tell their file
    blank = r"(?U)^\s*$"
    return wide.select(*several, "__source_row", *[
        F.when(F.col(f"`{i}`").rlike(blank), None).otherwise(F.col(f"`{i}`")).alias(n)
        for i, n in zip(range(1, width + 1), names)])
