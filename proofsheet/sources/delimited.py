"""Delimited-file scan.

1. A sniff job over the folder: ``binaryFile`` lists the files (its
   ``content`` column is pruned), and ``mapInPandas`` reads only the first
   64 KB of each file through ``pyarrow.fs`` to choose the encoding (first of
   utf-8-sig, utf-8, cp1256 that decodes strictly, an incomplete trailing
   character dropped), the delimiter (the standard-library sniffer limited
   to , ; TAB | over the first 32 K characters, default comma), reject binary
   files (NUL in the first 8 KB) and take the header.  Files chosen as UTF-8
   are then proven to be so over every line, in splits.
2. One scan per (encoding, delimiter, header) group with an all-string schema
   plus an overflow column: ``splits.read_records``, which reads quoted line
   ends in many tasks, or ``spark.read.csv`` with ``multiline=False`` for files
   known to have none (backslash escapes there).  A row with too many
   fields fills the overflow column and rejects its file; a short row is
   padded with nulls.  Whitespace-only cells become null (S6).
"""

from __future__ import annotations

import csv
import io
import re
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofsheet.functions import vocab as V
from proofsheet.sources.splits import read_records

SNIFF_SCHEMA = "path string, encoding string, delimiter string, header array<string>, error string"
SAMPLE_BYTES = 65536
OVERFLOW = "__overflow"


def _open_head(path: str, n: int) -> bytes:
    """The first ``n`` bytes, and more up to the end of the first line."""
    from pyarrow import fs
    filesystem, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    with filesystem.open_input_stream(inner) as f:
        head = f.read(n)
        while b"\n" not in head and b"\r" not in head and (more := f.read(n)):
            head += more
        return head


def decode_sample(raw: bytes) -> tuple[str | None, str | None, str | None]:
    """(text, encoding, error) for a file head."""
    if b"\x00" in raw[:8192]:
        return None, None, "binary content"
    for enc in V.CSV_ENCODINGS:
        data = raw
        for _ in range(4):  # drop an incomplete multi-byte tail at the cut
            try:
                return data.decode(enc, errors="strict"), enc, None
            except UnicodeDecodeError as exc:
                if exc.start >= len(data) - 3 and len(raw) >= SAMPLE_BYTES:
                    data = data[:exc.start]
                    continue
                break
    return None, None, "unknown text encoding"


def sniff_delimiter(text: str) -> str:
    """S3: the standard-library sniffer restricted to the candidates, over
    the first 32 K characters; comma when it cannot decide."""
    try:
        return csv.Sniffer().sniff(text[:32768], delimiters="".join(V.CSV_DELIMITERS)).delimiter
    except csv.Error:
        return ","


def header_names(cells: list[str]) -> list[str]:
    """An empty header cell is ``Unnamed: <index>`` (as a pandas reader
    names it); others are stripped and a whitespace-only one becomes prefix +
    1-based ordinal; repeats get ``.1``, ``.2``."""
    out, seen = [], {}
    for i, c in enumerate(cells):
        name = f"Unnamed: {i}" if c in (None, "") else (c.strip() or f"{V.BLANK_HEADER_PREFIX}{i + 1}")
        if name in seen:
            seen[name] += 1
            name = f"{name}.{seen[name]}"
        else:
            seen[name] = 0
        out.append(name)
    return out


def _sniff(batches):
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            try:
                text, enc, err = decode_sample(_open_head(path, SAMPLE_BYTES))
            except OSError as exc:  # unreadable file
                text, enc, err = None, None, f"unreadable: {exc}"
            if err:
                rows.append((path, None, None, None, err))
                continue
            text = text.lstrip("﻿")
            delim = sniff_delimiter(text)
            first = next(csv.reader(io.StringIO(text), delimiter=delim), [])
            rows.append((path, enc, delim, header_names(first), None if first else "empty file"))
        yield pd.DataFrame(rows, columns=["path", "encoding", "delimiter", "header", "error"])


def sniff_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its encoding, delimiter, header or error."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInPandas(_sniff, SNIFF_SCHEMA)


def undecodable_files(spark: SparkSession, paths: list[str]) -> set[str]:
    """Those of ``paths`` with a line that is not UTF-8.  The head only
    suggests an encoding; this proves it over the whole of every file, in
    splits (a line end never falls inside a character)."""
    if not paths:
        return set()
    lines = spark.read.text(paths)
    found = lines.where(~F.is_valid_utf8("value")).select(F.col("_metadata.file_path")).distinct().collect()  # names of files
    plain = {re.sub("^file:/+", "file:/", unquote(r[0])) for r in found}
    return {p for p in paths if re.sub("^file:/+", "file:/", p) in plain}


def read_delimited(spark: SparkSession, path: str, multiline: bool = True, strict: bool = True) -> DataFrame:
    """All files of ``path`` as one string-typed DataFrame with
    ``__source_file``.  Raises on rejected files when ``strict``, else leaves
    them out; cp1256 decodes any byte, so only UTF-8 needs a proof."""
    sniffed = [r.asDict() for r in sniff_files(spark, path).collect()]  # one row per file (a listing, not data)
    broken = undecodable_files(spark, [r["path"] for r in sniffed if not r["error"] and r["encoding"].startswith("utf-8")])
    for r in sniffed:
        if r["path"] in broken:
            r["error"] = f"not {r['encoding']} throughout"
    bad = [r for r in sniffed if r["error"]]
    if bad and strict:
        raise ValueError("rejected files: " + "; ".join(f"{r['path']}: {r['error']}" for r in bad))
    groups: dict[tuple, list[str]] = {}
    for r in sniffed:
        if not r["error"]:
            groups.setdefault((r["encoding"], r["delimiter"], tuple(r["header"])), []).append(r["path"])
    frames = []
    for (enc, delim, header), paths in groups.items():
        if multiline:
            frames.append(read_records(spark, paths, list(header), delim, "utf-8" if enc.startswith("utf-8") else enc, OVERFLOW))
            continue
        schema = T.StructType([T.StructField(h, T.StringType()) for h in header]
                              + [T.StructField(OVERFLOW, T.StringType())])
        df = (spark.read.schema(schema)
              .option("header", True).option("enforceSchema", True)
              .option("sep", delim).option("encoding", "UTF-8" if enc.startswith("utf-8") else enc.upper())
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt_unused")
              .csv(paths))
        frames.append(df.withColumn("__source_file", F.input_file_name()))
    if not frames:
        raise ValueError("no readable delimited file")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    if strict:
        over = out.where(F.col(OVERFLOW).isNotNull()).select("__source_file").limit(1).collect()
        if over:
            raise ValueError(f"row with too many fields in {over[0][0]}")
    cols = [c for c in out.columns if c not in (OVERFLOW,)]
    blank = r"(?U)^\s*$"
    return out.select(*[F.when(F.col(f"`{c}`").rlike(blank), None).otherwise(F.col(f"`{c}`")).alias(c)
                        if not c.startswith("__") else F.col(c) for c in cols])


def shape_guard(df: DataFrame, max_rows: int | None = None, max_columns: int | None = None) -> None:
    """Optional row/column caps; an empty table is rejected."""
    cols = [c for c in df.columns if not c.startswith("__")]
    if max_columns is not None and len(cols) > max_columns:
        raise ValueError("too many columns")
    if max_rows is not None and df.limit(max_rows + 1).count() > max_rows:
        raise ValueError("too many rows")
    if df.isEmpty():
        raise ValueError("no data to analyse")
