"""Quoted delimited files read in many tasks.

A line end inside a quoted field does not end a record, so a byte range of a
file cannot tell by itself where its records begin.  Three passes settle it:

1. Every file is cut into ranges of about SPLIT_BYTES that begin behind a line
   feed.  There the scan is in one of two states, between records or inside a
   quoted field, and a task finds for its range the state at its end for both.
2. Per file these maps are composed in order, one small row a range: a prefix
   scan that gives every range its true state at its begin.
3. A task reads the records that begin in its range.  In a range that begins
   inside a quoted field it first passes over the rest of that record; its last
   record is read to its end, however far behind the range that is.

The rules are those of the standard ``csv`` reader: a quote opens a field only
at the field's begin, two quotes inside it are one, and what follows the
closing quote belongs to the field.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT_BYTES = 64 << 20
CHUNK, BATCH_ROWS, BATCH_BYTES = 1 << 20, 10_000, 8 << 20
RANGE = "path string, part long, begin long, finish long, size long"


def open_file(path: str):
    from pyarrow import fs
    filesystem, inner = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return io.BufferedReader(filesystem.open_input_file(inner), CHUNK)


class Scan:
    """Where a scan stands: inside a quoted field or not, and behind which
    byte.  Jumps from quote to quote; what lies between is passed over at once."""

    def __init__(self, delimiter: str, quoted: bool):
        self.opening = re.compile(b"[" + re.escape(delimiter.encode()) + rb'\r\n]"')
        self.quoted, self.last = quoted, b"\n"

    def feed(self, data: bytes) -> None:
        """Bytes follow the one in ``last``; a quote that ends them inside a field waits for the next byte as ``Q"``."""
        data = self.last + data
        at = 1  # what lies before is decided
        while True:
            if self.quoted:
                at = data.find(b'"', at)
                if at < 0:
                    self.last = b"x"
                    return
                if at + 1 == len(data):
                    self.last = b'Q"'  # closing, or the first of two
                    return
                if data[at + 1:at + 2] == b'"':
                    at += 2
                    continue
                self.quoted = False
                at += 1
            else:
                found = self.opening.search(data, at - 1)
                if not found:
                    self.last = data[-1:]
                    return
                self.quoted, at = True, found.end()

    def step(self, data: bytes) -> None:
        if not data:
            return
        if self.last == b'Q"':  # still in the quoted state, with one quote undecided
            if data[:1] == b'"':
                self.last, data = b"x", data[1:]
            else:
                self.quoted, self.last = False, b'"'
        if data:
            self.feed(data)

    def inside(self) -> bool:
        """Inside a quoted field, with all fed bytes decided."""
        return self.quoted and self.last != b'Q"'


def behind_line(f, at: int, size: int) -> int:
    """The first place behind a line feed at or after ``at``; ``at`` 0 is one."""
    if at <= 0:
        return 0
    if at >= size:
        return size
    f.seek(at - 1)
    while chunk := f.read(CHUNK):
        found = chunk.find(b"\n")
        if found >= 0:
            return f.tell() - len(chunk) + found + 1
    return size


def ranges(spark: SparkSession, paths: list[str], split_bytes: int) -> DataFrame:
    """(path, part, begin, finish, size): nominal ranges, one a task."""
    files = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("size"))
    parts = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / split_bytes) - 1, F.lit(0)))).alias("part"))
    return parts.select("path", "part", (F.col("part") * split_bytes).alias("begin"), F.least((F.col("part") + 1) * split_bytes, "size").alias("finish"), "size")


def end_states(parts: DataFrame, delimiter: str) -> DataFrame:
    """(path, part, begin, finish, size, plain, quoted): true begin and end of each range, and whether its end is
    inside a quoted field when its begin is not, or is."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                with open_file(r.path) as f:
                    begin, finish = behind_line(f, r.begin, r.size), behind_line(f, r.finish, r.size)
                    f.seek(begin)
                    plain, quoted, left = Scan(delimiter, False), Scan(delimiter, True), finish - begin
                    quoted.last = b"x"
                    while left > 0 and (chunk := f.read(min(CHUNK, left))):
                        left -= len(chunk)
                        plain.step(chunk)
                        quoted.step(chunk)
                rows.append((r.path, r.part, begin, finish, r.size, plain.inside(), quoted.inside()))
            yield pd.DataFrame(rows, columns=["path", "part", "begin", "finish", "size", "plain", "quoted"])

    return parts.mapInPandas(run, RANGE + ", plain boolean, quoted boolean")


def begin_states(ends: DataFrame) -> DataFrame:
    """(path, part, begin, finish, size, inside): the maps of a file's ranges composed in order."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        state, inside = False, []
        for plain, quoted in zip(pdf["plain"], pdf["quoted"]):
            inside.append(state)
            state = bool(quoted if state else plain)
        return pdf.assign(inside=inside)[["path", "part", "begin", "finish", "size", "inside"]]

    return ends.groupBy("path").applyInPandas(compose, RANGE + ", inside boolean")


class Lines:
    """The lines of a file from ``begin`` on, with the place behind the last one given out."""

    def __init__(self, f, begin: int, encoding: str):
        self.f, self.at, self.encoding = f, begin, encoding
        f.seek(begin)

    def raw(self) -> Iterator[bytes]:
        for line in self.f:
            for piece in line.splitlines(True) if b"\r" in line else (line,):
                self.at += len(piece)
                yield piece

    def __iter__(self) -> Iterator[str]:
        for i, line in enumerate(self.raw()):
            text = line.decode(self.encoding)
            yield text[1:] if i == 0 and self.at == len(line) and text[:1] == "﻿" else text


def records(path: str, begin: int, finish: int, inside: bool, delimiter: str, encoding: str) -> Iterator[list[str]]:
    """The records that begin in a range, without blank lines and the header."""
    if begin >= finish:
        return
    with open_file(path) as f:
        if inside:  # to the end of the record that began before
            lines, scan = Lines(f, begin, encoding), Scan(delimiter, True)
            scan.last = b"x"
            for line in lines.raw():
                scan.step(line)
                if not scan.quoted:  # a line end outside quotes
                    break
            begin = lines.at
            if begin >= finish:
                return
        lines = Lines(f, begin, encoding)
        reader = csv.reader(lines, delimiter=delimiter)
        header, at = begin == 0, begin
        while at < finish:
            cells = next(reader, None)
            if cells is None:
                return
            at = lines.at
            if cells and not header:
                yield cells
            header = header and not cells


def read_records(spark: SparkSession, paths: list[str], header: list[str], delimiter: str, encoding: str, overflow: str,
                 split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of files with one header as strings, ``overflow`` (the cells
    beyond the header, or null) and ``__source_file``.  Partitions hold ranges in
    the order of the files' bytes."""
    from proofsheet.session import saved
    width = len(header)
    ends = end_states(ranges(spark, paths, split_bytes).repartition("path", "part"), delimiter)
    states = saved(begin_states(ends))  # one row a range
    tasks = max(1, states.count())
    order = ["path", "part"]
    states = states.repartitionByRange(tasks, *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        rows: list[list[str | None]] = []
        size = 0

        def batch(path):
            columns = [pa.array(c, pa.string()) for c in zip(*rows)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([path] * len(rows), pa.string())], names)

        for b in batches:
            for r in b.to_pylist():
                for cells in records(r["path"], r["begin"], r["finish"], r["inside"], delimiter, encoding):
                    size += sum(map(len, cells))
                    extra = delimiter.join(cells[width:]) if len(cells) > width else None
                    rows.append([*cells[:width], *[None] * (width - len(cells)), extra])
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch(r["path"])
                        rows, size = [], 0
                if rows:
                    yield batch(r["path"])
                    rows, size = [], 0

    names = [*header, overflow, "__source_file"]
    from pyspark.sql import types as T
    return states.mapInArrow(run, T.StructType([T.StructField(n, T.StringType()) for n in names]))
